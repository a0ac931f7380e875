"""Filling fixed-capacity containers (problem 6): bound-certified repacking.

A text above the capacity is cut into full pieces and a rest; other texts stay whole. Items of a kind are dealt by hash into partitions of about
`group` items. Each is packed by best-fit decreasing, and dual feasible functions give a lower bound on its containers. A partition that
meets its bound is done. Those with a gap give up the items of their emptiest containers, which are dealt again over fewer
partitions and packed anew, as long as that saves containers; an exchange that saves none is undone and ends the rounds. No partition ever holds more than a few times `group` items.

Nulls: a null or empty text is one piece of 0 tokens. Kinds without a positive capacity are left out. Repeated rows are packed each; ties go
by document id. Empty tables give no containers. The table of kinds is small and read on the driver.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuequarry.llm.tokens import token_counts
from issuequarry.session import Scratch


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """Least number of containers by two families of dual feasible functions: thresholds (large items count whole, small ones nothing) and rounding. counts: items of each size."""
    some = sizes > 0
    n = np.zeros(capacity + 1, np.int64)
    np.add.at(n, sizes[some], 1 if counts is None else counts[some])
    x = np.arange(capacity + 1)
    best = -(-int((n * x).sum()) // capacity)
    count, mass = np.concatenate((np.cumsum(n[::-1])[::-1], [0])), np.concatenate(([0], np.cumsum(n * x)))
    e = np.arange(0, capacity // 2 + 1)
    large = count[np.minimum(capacity - e + 1, capacity + 1)]
    middle = mass[capacity - e + 1] - mass[e]
    best = max(best, int(np.max(large + -(-middle // capacity))))
    for k in range(1, 21):
        whole = (k + 1) * x % capacity == 0
        u = np.where(whole, x * k, (k + 1) * x // capacity * capacity)  # in parts of capacity * k
        best = max(best, -(-int((n * u).sum()) // (capacity * k)))
    return best


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item; sizes must come in falling order. Open bins are kept by free space, with one bit for each space in use."""
    free: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bins, out = 0, 0, []
    for s in sizes:
        fit = used >> s
        if fit:
            space = s + (fit & -fit).bit_length() - 1
            b = free[space].pop()
            if not free[space]:
                used ^= 1 << space
        else:
            b, space, bins = bins, capacity, bins + 1
        space -= s
        if not free[space]:
            used |= 1 << space
        free[space].append(b)
        out.append(b)
    return out


SCHEMA = "container_kind string, capacity bigint, doc_id bigint, piece int, tokens bigint, n bigint, part bigint, bin bigint, place bigint, open boolean"
ITEMS = "container_kind string, capacity bigint, doc_id bigint, piece int, tokens bigint, n bigint, part bigint"


def _pack(t: pa.Table) -> pa.Table:
    capacity = t.column("capacity")[0].as_py()
    t = t.sort_by([("n", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
    n = t.column("n").to_numpy()
    bins = np.array(best_fit_decreasing(n.tolist(), capacity), np.int64)
    count = int(bins.max()) + 1
    fill = np.bincount(bins, weights=n).astype(np.int64)
    gap = count - lower_bound(n, capacity)
    give = np.zeros(count, bool)
    if gap > 0:
        give[np.argsort(fill, kind="stable")[: max(4 * gap, count // 10)]] = True
        give &= fill < capacity
    o = np.argsort(bins, kind="stable")
    before = np.cumsum(n[o]) - n[o]
    first = np.searchsorted(bins[o], np.arange(count))
    place = np.empty(len(n), np.int64)
    place[o] = before - before[first][bins[o]]
    return t.append_column("bin", pa.array(bins)).append_column("place", pa.array(place)).append_column("open", pa.array(give[bins]))


def pack(df: DataFrame, kinds: DataFrame, key: str = "doc_id", text: str = "text", group: int = 20_000) -> DataFrame:
    """container_kind, container, place (tokens before it in the container), doc_id, piece (from 0), offset (tokens of the document before it), tokens."""
    spark = df.sparkSession
    scratch = Scratch(spark, "packing")
    kind = [(r.container_kind, r.capacity_tokens) for r in kinds.select("container_kind", "capacity_tokens").distinct().orderBy("container_kind").collect() if r.capacity_tokens and r.capacity_tokens > 0]
    if not kind:
        kind = [("none", 1)]
        df = df.limit(0)
    sizes = scratch.keep(token_counts(df.select(F.col(key).cast("bigint").alias("doc_id"), text), "doc_id", text))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).cast("bigint").alias("capacity")) for k, c in kind]))
    docs = sizes.select("doc_id", "tokens", each.alias("x")).select("doc_id", "tokens", "x.*")
    pieces = F.greatest(F.ceil(F.col("tokens") / F.col("capacity")), F.lit(1)).cast("int")
    items = docs.select("container_kind", "capacity", "doc_id", F.explode(F.sequence(F.lit(0), pieces - 1)).alias("piece"), "tokens").withColumn("n", F.least(F.col("capacity"), F.col("tokens") - F.col("piece") * F.col("capacity")))
    total = {r.container_kind: r.m for r in items.filter("n < capacity").groupBy("container_kind").agg(F.count("*").alias("m")).collect()}
    full = items.filter("n = capacity").select("container_kind", F.concat_ws("/", "container_kind", F.lit("full"), "doc_id", "piece").alias("container"), F.lit(0).cast("bigint").alias("place"), "doc_id", "piece", "capacity", "n")
    now, done, before, last = items.filter("n < capacity"), [full], None, None
    for r in itertools.count():
        parts = F.lit(1)
        for k, m in total.items():
            parts = F.when(F.col("container_kind") == k, F.lit(math.ceil(m / group))).otherwise(parts)
        dealt = now.withColumn("part", F.pmod(F.xxhash64(F.lit(r), "doc_id", "piece"), parts))
        packed = scratch.keep(dealt.select(*[x.split()[0] for x in ITEMS.split(", ")]).groupBy("container_kind", "part").applyInArrow(_pack, SCHEMA))
        used = packed.select("container_kind", "part", "bin").distinct().count()
        name = F.concat_ws("/", "container_kind", F.lit(r), "part", "bin").alias("container")
        if before is not None and used >= before:  # the exchange saved nothing: the packing before it stays
            done.append(last)
            break
        cols = ["container_kind", name, "place", "doc_id", "piece", "capacity", "n"]
        done.append(packed.filter("not open").select(*cols))
        last = packed.filter("open").select(*cols)
        now = packed.filter("open").drop("bin", "place", "open")
        before = packed.filter("open").select("container_kind", "part", "bin").distinct().count()
        total = {x.container_kind: x.m for x in now.groupBy("container_kind").agg(F.count("*").alias("m")).collect()}
        if not total:
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionAll(d)
    return out.select("container_kind", "container", "place", F.col("doc_id").alias(key), "piece", (F.col("piece") * F.col("capacity")).alias("offset"), F.col("n").alias("tokens"))


def fill_report(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """Containers, tokens and share of the capacity in use per kind, beside the lower bound over the sizes of the whole kind (at most capacity different ones)."""
    hist = packed.groupBy("container_kind", "tokens").agg(F.count("*").alias("m"))
    caps = {r.container_kind: r.capacity_tokens for r in kinds.collect()}

    def bound(t: pa.Table) -> pa.Table:
        k = t.column("container_kind")[0].as_py()
        x, m = t.column("tokens").to_numpy(), t.column("m").to_numpy()
        return pa.table({"container_kind": [k], "lower_bound": pa.array([lower_bound(x, caps[k], m)], pa.int64())})

    low = hist.groupBy("container_kind").applyInArrow(bound, "container_kind string, lower_bound bigint")
    per = packed.groupBy("container_kind", "container").agg(F.sum("tokens").alias("t")).groupBy("container_kind").agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"))
    return kinds.select("container_kind", "capacity_tokens").join(per, "container_kind").join(low, "container_kind").withColumn("fill", F.col("tokens") / (F.col("containers") * F.col("capacity_tokens")))
