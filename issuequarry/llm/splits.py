"""Splits that keep related records together (problem 2).

Rows that share a clean repository name or an issue id, directly or through other rows, form a component. Repositories are few next to rows, so
the graph holds repositories only: two are linked where one issue id stands under both. Components come from alternating large-star
and small-star. A row without a repository goes with its issue, a row with neither is alone. Null or blank issue ids link nothing.

Component identifiers are hashed into ranges proportional to the shares. The hash has a salt: of `salts` of them the one is taken under which the large components
(those of more than 1/1000 of all rows, so fewer than a thousand) fall so that the shares come nearest to the targets; the small ones spread evenly under any. Every component, large or
small, gets its split by the same hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuequarry.llm.components import connected_components
from issuequarry.llm.names import clean_name, digest_bits, trimmed
from issuequarry.session import Scratch


def _issue(c: str) -> Column:
    return F.when(trimmed(F.col(c)) != "", F.col(c))


def entity_components(df: DataFrame, scratch: Scratch, name: str = "repository", issue: str = "issue_id") -> DataFrame:
    """(node, component) of the clean names that are linked to others."""
    both = df.select(clean_name(F.col(name)).alias("r"), _issue(issue).alias("i")).filter("r is not null and i is not null").distinct()
    low = both.groupBy("i").agg(F.min("r").alias("m"), F.max("r").alias("x")).filter("m < x").select("i", "m")
    return connected_components(both.join(low, "i").filter("r > m").select("r", "m").distinct(), scratch)


def linked_names(components: DataFrame) -> DataFrame:
    """(repository_a, repository_b), a < b, of all names in one component."""
    a, b = components.alias("a"), components.alias("b")
    return a.join(b, (F.col("a.component") == F.col("b.component")) & (F.col("a.node") < F.col("b.node"))).select(F.col("a.node").alias("repository_a"), F.col("b.node").alias("repository_b"))


def row_components(df: DataFrame, scratch: Scratch, key: str = "row_id", name: str = "repository", issue: str = "issue_id") -> DataFrame:
    """(key, entity): the component of every row as one string."""
    comp = scratch.keep(entity_components(df, scratch, name, issue))
    rows = df.select(F.col(key), clean_name(F.col(name)).alias("r"), _issue(issue).alias("i"))
    named = rows.filter("r is not null").join(comp.withColumnRenamed("node", "r"), "r", "left").select(key, "i", F.concat(F.lit("r:"), F.coalesce("component", "r")).alias("entity"))
    of_issue = named.filter("i is not null").groupBy("i").agg(F.min("entity").alias("e"))
    rest = rows.filter("r is null").join(of_issue, "i", "left")
    other = F.coalesce("e", F.concat(F.lit("i:"), F.col("i")), F.concat(F.lit("n:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    return named.select(key, "entity").unionAll(rest.select(key, other.alias("entity")))


def grouped_split(df: DataFrame, targets: DataFrame, key: str = "row_id", name: str = "repository", issue: str = "issue_id", seed: int = 42, salts: int = 256) -> DataFrame:
    """(key, entity, split_name). targets: split_name, target_share (a small table; shares are scaled to sum 1, null or negative ones count 0)."""
    scratch = Scratch(df.sparkSession, "splits")
    rows = scratch.keep(row_components(df, scratch, key, name, issue))
    goal = {r.split_name: max(0.0, r.target_share or 0.0) for r in targets.select("split_name", "target_share").orderBy("split_name").collect()}
    if not goal or sum(goal.values()) <= 0:
        raise ValueError("no split has a positive share")
    goal = {s: g / sum(goal.values()) for s, g in goal.items() if g > 0}

    def pick(salt) -> Column:
        place = digest_bits(F.concat(salt.cast("string"), F.lit(":"), F.col("entity")), 13) / float(1 << 52)
        out, at = F.lit(list(goal)[-1]), 1.0
        for s in reversed(list(goal)[:-1]):
            at -= goal[list(goal)[list(goal).index(s) + 1]]
            out = F.when(place < at, F.lit(s)).otherwise(out)
        return out

    size = scratch.keep(rows.groupBy("entity").agg(F.count("*").alias("m")))
    total = size.agg(F.sum("m")).first()[0] or 0
    large = size.filter(F.col("m") * 1000 > total).select("entity", "m", F.explode(F.sequence(F.lit(seed), F.lit(seed + salts - 1))).alias("salt"))
    got: dict[int, dict[str, int]] = {s: dict.fromkeys(goal, 0) for s in range(seed, seed + salts)}
    for r in large.groupBy("salt", pick(F.col("salt")).alias("s")).agg(F.sum("m").alias("m")).collect():  # salts x splits
        got[r.salt][r.s] = r.m
    rest = total - sum(got[seed].values())
    best = min(got, key=lambda x: (max(abs(got[x][s] + rest * g - total * g) for s, g in goal.items()), x))
    return rows.select(key, "entity", pick(F.lit(best)).alias("split_name"))


def split_shares(split: DataFrame, targets: DataFrame) -> DataFrame:
    """Rows, entities and share reached per split, beside the target. The entity counts come from one row an entity."""
    per = split.groupBy("split_name", "entity").agg(F.count("*").alias("m")).groupBy("split_name").agg(F.sum("m").alias("rows"), F.count("*").alias("entities"))
    total = per.agg(F.sum("rows").alias("total"))
    return targets.select("split_name", "target_share").join(per, "split_name", "left").crossJoin(total).select(
        "split_name", "target_share", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("entities", F.lit(0)).alias("entities"), F.coalesce(F.col("rows") / F.col("total"), F.lit(0.0)).alias("share")
    )
