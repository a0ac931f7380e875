"""Samples with target category proportions (problem 1).

Units are the different issue ids of a category; the last load of an issue stands for it. For each plan the category quotas come from one
scale factor: max(minimum, factor * share), never more than there is, with the sum of the plan's size. A two-way table of category and
stratum shares each quota out in proportion to what is there, and controlled rounding by maximum flow makes it integer with both margins kept. A stratum is a clean
repository of at least one in `own` units (so there are at most `own` of these), a part of the smaller ones (hashed into `strata` parts, whose margins hold together), or
the units without a repository. Each cell then takes its exact quota by random key: whole key ranges below the cut from a histogram, and a ranking inside the one range that holds
the cut, so no cell is ever sorted in one task. Where a category runs out the others fill the plan's size; the report tells the share that each reached and which lie above their target.

Nulls: rows without a category or an issue id are no units; a null share counts 0, a null minimum 0. An issue with two categories counts in
both. Ties of the load time go to the larger row id. Empty tables give quotas of 0. The plan table is small and read on the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict, deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from issuequarry.llm.names import clean_name, trimmed
from issuequarry.session import Scratch

RANGES = 1024


def max_flow(n: int, edges: list[tuple[int, int, int]], s: int, t: int) -> list[int]:
    """Flow on each edge (from, to, capacity), by shortest augmenting paths."""
    to, cap, adj = [], [], defaultdict(list)
    for a, b, c in edges:
        adj[a].append(len(to)), to.append(b), cap.append(c)
        adj[b].append(len(to)), to.append(a), cap.append(0)
    while True:
        via, queue = {s: -1}, deque([s])
        while queue and t not in via:
            x = queue.popleft()
            for e in adj[x]:
                if cap[e] > 0 and to[e] not in via:
                    via[to[e]] = e
                    queue.append(to[e])
        if t not in via:
            return [cap[2 * i + 1] for i in range(len(edges))]
        path, x = [], t
        while x != s:
            path.append(via[x])
            x = to[via[x] ^ 1]
        push = min(cap[e] for e in path)
        for e in path:
            cap[e] -= push
            cap[e ^ 1] += push


def controlled_rounding(table: list[list[float]], rows: list[int]) -> list[list[int]]:
    """Every cell becomes its floor or ceiling, row sums are exactly `rows`, column sums the floor or ceiling of theirs."""
    eps = 1e-9
    nr, nc = len(table), len(table[0]) if table else 0
    low = [[math.floor(x + eps) for x in r] for r in table]
    col = [sum(r[j] for r in table) for j in range(nc)]
    base = [sum(r[j] for r in low) for j in range(nc)]
    s, t, ss, tt = nr + nc, nr + nc + 1, nr + nc + 2, nr + nc + 3
    edges, cells, need = [], [], defaultdict(int)

    def add(a: int, b: int, lower: int, upper: int) -> None:
        edges.append((a, b, upper - lower))
        need[b] += lower
        need[a] -= lower

    for i in range(nr):
        for j in range(nc):
            if table[i][j] - low[i][j] > eps:
                cells.append((i, j, len(edges)))
                add(i, nr + j, 0, 1)
    for i in range(nr):
        r = rows[i] - sum(low[i])
        add(s, i, r, r)
    for j in range(nc):
        add(nr + j, t, math.floor(col[j] + eps) - base[j], math.ceil(col[j] - eps) - base[j])
    add(t, s, 0, 1 << 60)
    demands = [(ss, v, x) if x > 0 else (v, tt, -x) for v, x in need.items() if x]
    flow = max_flow(nr + nc + 4, edges + demands, ss, tt)
    if any(flow[len(edges) + i] < d[2] for i, d in enumerate(demands)):
        raise ValueError("the margins cannot be kept")
    for i, j, e in cells:
        low[i][j] += flow[e]
    return low


def category_quotas(size: int, share: list[float], least: list[float], there: list[int]) -> list[int]:
    """Integer quotas: max(least, factor * share), at most what is there, summing to `size` where there is enough."""
    n = len(share)
    floor = [min(m, a) for m, a in zip(least, there, strict=True)]
    size = min(size, sum(there))
    if sum(floor) >= size:
        want = [x * size / sum(floor) if sum(floor) else 0.0 for x in floor]
    else:
        def at(f: float) -> list[float]:
            return [min(a, max(m, f * s)) for s, m, a in zip(share, floor, there, strict=True)]

        lo, hi = 0.0, 1.0
        while sum(at(hi)) < size - 1e-9 and hi < 1e18:
            hi *= 2
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if sum(at(mid)) < size else (lo, mid)
        want = at(hi)
    q = [math.floor(x + 1e-9) for x in want]
    for i in sorted(range(n), key=lambda i: (q[i] - want[i], i)):
        if sum(q) < size and q[i] < there[i] and want[i] - q[i] > 1e-9:
            q[i] += 1
    return q


def draw(df: DataFrame, plans: DataFrame, category: str = "canonical_label", unit: str = "issue_id", key: str = "row_id", stratum: str = "repository", loaded: str = "ingested_at", strata: int = 64, own: int = 256, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, report). sample: plan_name, category, unit, key. report: per plan row what was wanted, there, and drawn, the share of the plan's sample that this is, and flags."""
    spark = df.sparkSession
    scratch = Scratch(spark, "quota")
    part = clean_name(F.col(stratum))
    names_of = df.select(part.alias("r")).groupBy("r").agg(F.count("*").alias("m"))
    total = names_of.agg(F.sum("m")).first()[0] or 0
    large = names_of.filter((F.col("m") * own >= total) & F.col("r").isNotNull())
    number = {r.r: i for i, r in enumerate(large.orderBy("r").select("r").collect())}  # at most `own` names
    known = F.create_map(*[F.lit(x) for kv in number.items() for x in kv])[part] if number else F.lit(None).cast("int")
    of = F.when(part.isNull(), F.lit(-1)).otherwise(F.coalesce(known, F.pmod(F.xxhash64(part), F.lit(strata)) + own)).cast("int")
    rows = df.select(
        F.upper(trimmed(F.col(category))).alias("c"), F.col(unit).alias("u"), F.struct(F.col(loaded).alias("a"), F.col(key).alias("b"), of.alias("s")).alias("x")
    ).filter("c <> '' and u is not null")
    units = scratch.keep(
        rows.groupBy("c", "u").agg(F.max("x").alias("x"))
        .select("c", "u", F.col("x.b").alias("b"), F.col("x.s").alias("s"), F.xxhash64(F.lit(seed), F.col("u")).alias("h")).withColumn("g", F.shiftrightunsigned("h", 54).cast("int"))
    )
    hist = scratch.keep(units.groupBy("c", "s", "g").agg(F.count("*").alias("m")))
    there: dict[str, dict[int, int]] = defaultdict(dict)
    wanted = [r.asDict() for r in plans.select("plan_name", F.upper(trimmed(F.col(category))).alias("c"), "target_share", "min_rows", "sample_rows").collect()]
    names = sorted({w["c"] for w in wanted if w["c"]})
    for r in hist.filter(F.col("c").isin(names)).groupBy("c", "s").agg(F.sum("m").alias("m")).collect():  # categories of the plans x strata
        there[r.c][r.s] = r.m
    quota, report = [], []
    by_plan = defaultdict(list)
    for w in wanted:
        by_plan[w["plan_name"]].append(w)
    cols = sorted({s for x in there.values() for s in x})
    for plan, ws in by_plan.items():
        ws.sort(key=lambda w: w["c"] or "")
        share, least = [w["target_share"] or 0.0 for w in ws], [w["min_rows"] or 0 for w in ws]
        a = [sum(there[w["c"]].values()) if w["c"] in there else 0 for w in ws]
        n = max((w["sample_rows"] or 0 for w in ws), default=0)
        q = category_quotas(n, share, least, a)
        table = [[q[i] * there[w["c"]].get(s, 0) / a[i] if a[i] else 0.0 for s in cols] for i, w in enumerate(ws)]
        cells = controlled_rounding(table, q) if cols else []
        for i, w in enumerate(ws):
            report.append((plan, w["c"], w["target_share"], w["min_rows"], w["sample_rows"], float(max(least[i], share[i] * (w["sample_rows"] or 0))), a[i]))
            quota += [(plan, w["c"], s, cells[i][j]) for j, s in enumerate(cols) if cells and cells[i][j]]
    q = F.broadcast(spark.createDataFrame(quota, "plan_name string, c string, s int, q long"))  # plans x categories x (own + strata + 1) rows
    upto = hist.withColumn("upto", F.sum("m").over(Window.partitionBy("c", "s").orderBy("g")))  # at most RANGES rows a window
    reach = upto.join(q, ["c", "s"]).filter(F.col("upto") >= F.col("q")).groupBy("plan_name", "c", "s", "q").agg(F.min(F.struct("g", "upto", "m")).alias("x"))
    cuts = reach.groupBy("c", "s").agg(F.collect_list(F.struct("plan_name", F.col("x.g").alias("cut"), (F.col("q") - F.col("x.upto") + F.col("x.m")).alias("left"))).alias("p"))
    hit = units.join(F.broadcast(cuts), ["c", "s"]).select("c", "u", "b", "s", "h", "g", F.inline("p")).filter("g <= cut")  # categories x (own + strata + 1) rows
    order = Window.partitionBy("plan_name", "c", "s").orderBy("h", "u")  # the one range of each cell that holds its cut
    border = hit.filter("g = cut").withColumn("r", F.row_number().over(order)).filter("r <= left")
    sample = scratch.keep(hit.filter("g < cut").select("plan_name", "c", "u", "b").unionAll(border.select("plan_name", "c", "u", "b")))
    drawn = sample.groupBy("plan_name", "c").agg(F.count("*").alias("drawn"))
    told = spark.createDataFrame(report, "plan_name string, c string, target_share double, min_rows long, sample_rows long, wanted double, available long")
    full = told.join(drawn, ["plan_name", "c"], "left").select(
        "plan_name", F.col("c").alias(category), "target_share", "min_rows", "sample_rows", "wanted", "available", F.coalesce("drawn", F.lit(0)).alias("drawn"), (F.col("available") < F.col("wanted")).alias("too_few")
    ).withColumn("reached_share", F.coalesce(F.try_divide(F.col("drawn"), F.sum("drawn").over(Window.partitionBy("plan_name"))), F.lit(0.0))).withColumn("over_target", F.col("drawn") > F.ceil(F.col("wanted")))
    return sample.select("plan_name", F.col("c").alias(category), F.col("u").alias(unit), F.col("b").alias(key)), full
