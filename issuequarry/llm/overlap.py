"""Same or near-same records across splits by an edit-distance segment join (problem 3).

A text is written as the string of its distinct word runs in the corpus order from rare to frequent; reordered sentences change only the
runs at their borders. The insert/delete distance of two such strings is the number of runs that only one has, and likeness t
bounds it. An evaluation string may lose at most k = |A| - ceil(t |A|) symbols, so of k + 1 segments cut from its rare end one survives
whole; segments are single runs (three or five words of text), since an insertion could break a longer one. They are matched with
the runs of training strings at allowed positions, the early ones (shingles.py). Matches are verified with a banded dynamic program
over the two strings.

Nulls: a null text is an empty one; texts without a run match equal texts only. Equal sets meet by key, without the join. Repeated rows each
count. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuequarry.llm.shingles import Batch, blocks, cell_of, copied_keys, each_batch, looked_up, numbered, run_sets
from issuequarry.session import Scratch

EVAL, TRAIN = 1, 2


def banded_common(a: list[int], b: list[int], most: int) -> int:
    """Length of the longest common subsequence of two strings of distinct symbols, -1 if more than `most` inserts and deletes are needed.

    One bit a column of the dynamic program, a row a symbol of b; cells off the band (whose path would cost more than `most`) are left out.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return -1
    at = {x: i for i, x in enumerate(a)}
    ones = (1 << n) - 1
    v = ones
    for j, x in enumerate(b):
        i = at.get(x)
        if i is None or abs(i - j) + abs((n - i) - (m - j)) > most:
            continue
        u = v & (1 << i)
        v = (v + u) | (v - u)
    common = n - (v & ones).bit_count()
    return common if n + m - 2 * common <= most else -1


class PairFinder:
    """Verified (evaluation, training) pairs of the blocks of a task."""

    def __init__(self, t: float, sketch, bits: int):
        self.t, self.sketch, self.bits, self.seen = t, sketch, bits, set()

    def __call__(self, b: Batch) -> list[np.ndarray]:
        t = self.t
        levels = np.frombuffer(self.sketch.value, np.uint8)
        doc = np.repeat(np.arange(len(b.n)), b.n)
        string = b.h[np.lexsort((b.h, looked_up(levels, cell_of(b.h, self.bits), 4), doc))]
        i, j, _ = b.pairs(t, True)
        ev = b.side[i] == EVAL
        i, j = np.where(ev, i, j), np.where(ev, j, i)
        most = np.floor((1 - t) / (1 + t) * (b.n[i] + b.n[j]) + 1e-9).astype(np.int64)
        out: list[tuple[int, int]] = []
        if len(self.seen) > 1_000_000:
            self.seen.clear()
        for x, y, d in zip(i.tolist(), j.tolist(), most.tolist(), strict=True):
            pair = (int(b.k[x]), int(b.k[y]))
            if pair in self.seen:
                continue
            self.seen.add(pair)
            c = banded_common(string[b.at[x] : b.at[x + 1]].tolist(), string[b.at[y] : b.at[y + 1]].tolist(), d)
            if c >= 0 and c >= t * (b.n[x] + b.n[y] - c) - 1e-9 and not c == b.n[x] == b.n[y]:  # equal sets meet by key
                out.append(pair)
        return [np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)]


def split_overlaps(evals: dict[str, DataFrame], train: DataFrame, key: str = "row_id", text: str = "text", width: int = 5, t: float = 0.8) -> DataFrame:
    """(split_name, eval_row_id, train_row_id) of all pairs of likeness t or more."""
    scratch = Scratch(train.sparkSession, "overlap")
    names = sorted(evals)
    sides = [run_sets(evals[s], key, text, width, EVAL).withColumn("split", F.lit(i)) for i, s in enumerate(names)]
    base = scratch.keep(numbered(reduce(DataFrame.unionAll, [*sides, run_sets(train, key, text, width, TRAIN).withColumn("split", F.lit(-1))])))
    rows, sketch, _ = blocks(base, copied_keys(base), t, scratch, two_sided=True)
    links = scratch.keep(each_batch(rows, lambda: PairFinder(t, *sketch), "e bigint, t bigint").distinct())
    keys = scratch.keep(base.select("side", "split", "row_id", "id", "k"))
    linked = keys.select(F.col("id"), "k").join(links.select(F.col("e").alias("id")).unionAll(links.select("t")).distinct(), "id", "left_semi")
    by_key = links.join(linked.select(F.col("id").alias("e"), F.col("k").alias("ek")), "e").join(linked.select(F.col("id").alias("t"), F.col("k").alias("tk")), "t").select("ek", "tk")
    ev = keys.filter(F.col("side") == EVAL).select(F.col("split"), F.col("row_id").alias("eval_row_id"), F.col("k").alias("ek"))
    tr = keys.filter(F.col("side") == TRAIN).select(F.col("row_id").alias("train_row_id"), F.col("k").alias("tk"))
    same = ev.join(tr, F.col("ek") == F.col("tk")).select("split", "eval_row_id", "train_row_id")
    near = ev.join(by_key, "ek").join(tr, "tk").select("split", "eval_row_id", "train_row_id")
    name = F.element_at(F.array(*[F.lit(s) for s in names]), F.col("split") + 1)
    scratch.drop_but(keys, links)
    return same.unionAll(near).select(name.alias("split_name"), "eval_row_id", "train_row_id")


def overlap_report(pairs: DataFrame, evals: dict[str, DataFrame], key: str = "row_id", group: str = "repository") -> DataFrame:
    """Rows, overlapping rows and pairs per split and clean name of the group column (null and blank names as null)."""
    name = F.lower(F.regexp_replace(F.col(group), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    rows = reduce(DataFrame.unionAll, [d.select(F.lit(s).alias("split_name"), F.col(key).cast("bigint").alias("eval_row_id"), F.when(name != "", name).alias(group)) for s, d in sorted(evals.items())])
    per = pairs.groupBy("split_name", "eval_row_id").agg(F.count("*").alias("n"))
    return rows.join(per, ["split_name", "eval_row_id"], "left").groupBy("split_name", group).agg(
        F.count("*").alias("rows"), F.count("n").alias("overlapping_rows"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs")
    )
