"""Near-duplicate groups by a binary trie self-join (problem 5).

Sets of word runs are sparse 0/1 vectors; the likeness t bounds the dimensions in which two may differ. The join walks a trie over
these vectors from rare to frequent dimensions. Its upper part is cut by a shuffle: pairs that agree on none of the first dimensions
of both have used up their budget (shingles.py), the others meet in a block. Below, every block is a trie over 256 parity bits of its
sets, which never differ more often than the sets do. Pairs of nodes are walked together, differing bits add up, and a pair is pruned when
they exceed the error budget. What is left walks a second trie, over 512 parity bits. Pairs that reach its leaves are verified on the whole
sets. No step loses a link; hot blocks go to the second trie at once.

Nulls and empty texts: a null text is an empty one; texts without a run join only equal texts. Copies: one representative of each
distinct set enters the join and its copies follow it. Repeated row ids and extra columns do no harm. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuequarry.llm.components import connected_components
from issuequarry.llm.shingles import Batch, blocks, bloom, copied_keys, each_batch, handed_out, numbered, only_in, run_sets
from issuequarry.session import Scratch

class LinkFinder:
    """Verified links of the blocks of a task. A pair whose ends are already linked through others needs no link of its own."""

    def __init__(self, t: float):
        self.t, self.over = t, {}

    def top(self, x: int) -> int:
        over = self.over
        while (y := over.get(x, x)) != x:
            over[x] = x = over.get(y, y)
        return x

    def __call__(self, b: Batch) -> list[np.ndarray]:
        i, j, acc = b.pairs(self.t, False)
        o = np.argsort(acc, kind="stable")
        out: list[tuple[int, int]] = []
        k = b.k
        for x, y in zip(i[o].tolist(), j[o].tolist(), strict=True):
            p, q = self.top(int(k[x])), self.top(int(k[y]))
            if p == q:
                continue
            both = len(np.intersect1d(b.runs(x), b.runs(y), assume_unique=True))
            if both >= self.t * (b.n[x] + b.n[y] - both) - 1e-9:
                self.over[max(p, q)] = min(p, q)
                out.append((int(k[x]), int(k[y])))
        return [np.array([x[0] for x in out], np.int64), np.array([x[1] for x in out], np.int64)]


def near_duplicate_groups(df: DataFrame, key: str = "row_id", text: str = "text", width: int = 5, t: float = 0.8) -> DataFrame:
    """(group_id, row_id) of every row in a group of two or more; group_id is the smallest row id of the group."""
    spark = df.sparkSession
    scratch = Scratch(spark, "neardup")
    base = scratch.keep(numbered(run_sets(df, key, text, width)))
    copied = scratch.keep(copied_keys(base))
    rows, _, known = blocks(base, copied, t, scratch)
    links = each_batch(rows, lambda: LinkFinder(t), "a bigint, b bigint")
    comp = scratch.keep(connected_components(links.unionAll(known) if known else links, scratch))
    linked = only_in(base.select("id", "k"), *handed_out(spark, bloom(comp.select("node"))))
    of_set = scratch.keep(comp.join(linked, F.col("node") == F.col("id")).select("k", "component"))
    some = handed_out(spark, bloom(of_set.select("k").unionAll(copied.select("k"))))  # other rows stand alone
    rows = only_in(base.select("k", "row_id"), *some).distinct().join(of_set, "k", "left")
    of = scratch.keep(rows.select("row_id", F.when(F.col("component").isNull(), F.struct(F.lit(0).alias("x"), F.col("k").alias("y"))).otherwise(F.struct(F.lit(1).alias("x"), F.col("component").alias("y"))).alias("g")))
    groups = of.groupBy("g").agg(F.min("row_id").alias("group_id"), F.count("*").alias("m")).filter("m > 1").select("g", "group_id")
    out = of.join(groups, "g").select("group_id", "row_id")
    scratch.drop_but(of)
    return out
