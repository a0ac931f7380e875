"""Mixing sources to target weights (problem 7): weighted fair queueing.

Documents of a source stand in a random order (hash of seed and key). A document's virtual finish time in a mix is the cumulative tokens of its
source, counted over repeated passes, divided by the source's weight. All uses are served in the order of the time at which half of the document is through (finish less half its own
service), and the queue is cut where the mix's total budget is used up, at whichever end of the last document is nearer. So every source holds its share to half a document. A source that
runs out after max_uses passes leaves the queue, and the others go on up to the budget; the report shows the share that each reached and which ran out.

Cumulative tokens come from sums of key ranges of each source and a running sum inside each range, and the cut from sums of time ranges of each mix and a running sum inside the one range
that holds it, so neither a source with a third of all rows nor a mix is sorted in one task. Nulls: rows of no source, shares or totals of null, and uses below one take no part; a null text has
0 tokens. Repeated rows are documents of their own; ties of the order go by source, key and use. Empty tables give an empty mix. The table of mixes is small and read on the driver.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from issuequarry.llm.names import clean_name, digest_bits
from issuequarry.llm.tokens import token_counts
from issuequarry.session import Scratch

RANGES = 1024  # of time, a mix


def horizon(total: float, sources: list[tuple[float, float]]) -> float:
    """Virtual time at which fair queueing has served `total` tokens of sources (weight, tokens there with all uses); infinite if there are fewer. A source is served by its weight until it runs out."""
    ends = sorted((cap / w, w, cap) for w, cap in sources)
    served, weight = 0.0, sum(w for _, w, _ in ends)
    at = 0.0
    for end, w, _ in ends:
        if served + weight * (end - at) >= total:
            return at + (total - served) / weight
        served += weight * (end - at)
        at, weight = end, weight - w
    return math.inf


def mix(df: DataFrame, targets: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(mix, report). mix: mix_name, source, key, use (from 1), tokens, finish (virtual finish time). report: per target row what was wanted, there and reached."""
    spark = df.sparkSession
    scratch = Scratch(spark, "mixing")
    wanted = targets.select("mix_name", clean_name(F.col("source")).alias("s"), F.col("source").alias("named"), "target_share", F.col("max_uses").cast("bigint").alias("max_uses"), F.col("total_tokens").cast("bigint").alias("total_tokens"))
    some = wanted.select("s").distinct()
    rows = token_counts(df.select(F.col(key).cast("bigint").alias("d"), clean_name(F.col(source)).alias("s"), text).join(some, "s", "left_semi"), "d", text, ["s"])
    sizes = scratch.keep(rows.withColumn("h", digest_bits(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("d").cast("string"), F.lit(""))))))
    n = sizes.count()
    ranges = 1 << max(4, math.ceil(math.log2(n / 50_000 + 1)))
    sizes = sizes.withColumn("g", F.shiftrightunsigned("h", 60 - int(math.log2(ranges))))
    per = scratch.keep(sizes.groupBy("s", "g").agg(F.sum("tokens").alias("t"), F.max("tokens").alias("most")))
    before = per.select("s", "g", (F.sum("t").over(Window.partitionBy("s").orderBy("g")) - F.col("t")).alias("before"))  # a row for each range of a source
    inner = F.sum("tokens").over(Window.partitionBy("s", "g").orderBy("h", "d").rowsBetween(Window.unboundedPreceding, 0))
    queue = scratch.keep(sizes.withColumn("inner", inner).join(before, ["s", "g"]).select("s", "d", "tokens", (F.col("before") + F.col("inner")).alias("upto")))
    there = per.groupBy("s").agg(F.sum("t").alias("there"), F.max("most").alias("most"))
    plan = scratch.keep(wanted.join(there, "s", "left").withColumns({"there": F.coalesce("there", F.lit(0)), "most": F.coalesce("most", F.lit(0))}))  # as many rows as the small table
    by_mix = defaultdict(list)
    for r in plan.collect():
        if r.target_share and r.target_share > 0 and r.total_tokens and r.total_tokens > 0 and r.max_uses and r.max_uses >= 1 and r.there > 0 and r.s:
            by_mix[r.mix_name].append(r)
    served = []
    for rs in by_mix.values():
        # by then the budget is surely used up: rounding to halves of documents leaves out at most one document a source
        end = horizon(rs[0].total_tokens + sum(r.most for r in rs), [(r.target_share, r.there * r.max_uses) for r in rs])
        end = min(end, max(r.there * r.max_uses / r.target_share for r in rs))
        served += [(r.mix_name, r.s, r.target_share, r.total_tokens, r.there, end, min(r.max_uses, math.ceil(end * r.target_share / r.there))) for r in rs]
    passes = spark.createDataFrame(served, "mix_name string, s string, target_share double, total_tokens long, there long, end double, uses long").withColumn("use", F.explode(F.sequence(F.lit(1).cast("bigint"), F.greatest("uses", F.lit(1)))))
    upto = (F.col("use") - 1) * F.col("there") + F.col("upto")
    uses = (
        queue.join(passes, "s").withColumn("finish", upto / F.col("target_share")).withColumn("middle", F.col("finish") - F.col("tokens") / (2 * F.col("target_share")))
        .filter(F.col("middle") <= F.col("end")).withColumn("g", F.least(F.floor(F.col("middle") / F.col("end") * RANGES), F.lit(RANGES - 1)).cast("int"))
    )
    uses = scratch.keep(uses.select("mix_name", "s", "d", "use", "tokens", "finish", "middle", "g", "total_tokens"))
    sums = uses.groupBy("mix_name", "g").agg(F.sum("tokens").alias("t"))
    sums = sums.select("mix_name", "g", (F.sum("t").over(Window.partitionBy("mix_name").orderBy("g")) - F.col("t")).alias("before"), "t")  # at most RANGES rows a mix
    placed = uses.join(sums, ["mix_name", "g"])
    whole = placed.filter(F.col("before") + F.col("t") <= F.col("total_tokens"))
    order = Window.partitionBy("mix_name", "g").orderBy("middle", "s", "d", "use").rowsBetween(Window.unboundedPreceding, 0)
    border = placed.filter((F.col("before") < F.col("total_tokens")) & (F.col("before") + F.col("t") > F.col("total_tokens"))).withColumn("upto", F.col("before") + F.sum("tokens").over(order))
    border = border.filter(F.col("upto") - F.col("tokens") / 2 <= F.col("total_tokens"))
    names = ["mix_name", "s", "d", "use", "tokens", "finish"]
    mixed = scratch.keep(whole.select(*names).unionAll(border.select(*names)).repartitionByRange("mix_name", "finish").sortWithinPartitions("mix_name", "finish", "d"))
    got = mixed.groupBy("mix_name", "s").agg(F.sum("tokens").alias("got"), F.count("*").alias("uses"))
    all_ = F.sum("got").over(Window.partitionBy("mix_name"))
    report = plan.join(got, ["mix_name", "s"], "left").withColumn("got", F.coalesce("got", F.lit(0))).select(
        "mix_name", F.col("named").alias("source"), "target_share", "max_uses", "total_tokens", (F.col("target_share") * F.col("total_tokens")).alias("wanted_tokens"), F.col("there").alias("source_tokens"),
        F.col("got").alias("reached_tokens"), F.coalesce("uses", F.lit(0)).alias("uses"), (F.col("got") / F.col("total_tokens")).alias("share_of_budget"), F.try_divide(F.col("got"), all_).alias("share_of_mix"),
        (F.col("there") * F.col("max_uses") < F.col("target_share") * F.col("total_tokens")).alias("too_few"), (F.col("got") >= F.col("there") * F.col("max_uses")).alias("ran_out"),
    )
    scratch.drop_but(mixed, plan)
    return mixed.select("mix_name", F.col("s").alias("source"), F.col("d").alias(key), "use", "tokens", "finish"), report
