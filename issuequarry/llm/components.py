"""Connected components by alternating large-star and small-star, on written tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuequarry.session import Scratch


def _large_star(e: DataFrame) -> DataFrame:
    both = e.select(F.col("u"), F.col("v")).unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter(F.col("u") != F.col("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(low, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, most: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reached. edges: any two columns of one ordered type.

    Nulls and loops are left out; repeated edges count once; no edges give no rows. Every round writes its edges to the shared folder
    and ends when a round changes nothing (by count and hash sum of the edges). A node's smallest neighbour is found by partial
    aggregation, and the join that hands it out is one that adaptive execution splits where a node is hot.
    """
    a, b = edges.columns
    now = scratch.keep(
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))).distinct()
    )
    mark = None
    for _ in range(most):
        after = scratch.keep(_small_star(_large_star(now)))
        r = after.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        scratch.drop(now)
        now = after
        if (r.n, r.h) == mark:
            break
        mark = (r.n, r.h)
    else:
        raise RuntimeError("components did not settle")
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
