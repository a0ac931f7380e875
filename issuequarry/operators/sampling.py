"""Exact, deterministic samples and splits. Rows are ordered by md5(seed:key); a class is never sorted whole: ranges of the digest are counted, whole ranges are taken, and
only the range that holds the cut is ranked."""

from __future__ import annotations

import hashlib
import heapq
import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from issuequarry.functions.text import is_blank


def order_key(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def take_first(df: DataFrame, group: str, key: str, quota: DataFrame, seed: int) -> DataFrame:
    """Of each group its first `quota` rows by md5(seed:key), ties by key. quota: (group, quota)."""
    d = df.withColumn("__h", order_key(key, seed)).withColumn("__b", F.substring("__h", 1, 3))
    hist = d.groupBy(group, "__b").agg(F.count("*").alias("m")).withColumn("upto", F.sum("m").over(Window.partitionBy(group).orderBy("__b")))
    cut = hist.join(quota, group).filter(F.col("upto") - F.col("m") < F.col("quota")).select(group, "__b", (F.col("quota") - F.col("upto") + F.col("m")).alias("__left"), (F.col("upto") > F.col("quota")).alias("__border"))
    hit = d.join(cut, [group, "__b"])
    ranked = hit.filter("__border").withColumn("__r", F.row_number().over(Window.partitionBy(group, "__b").orderBy("__h", key))).filter("__r <= __left").drop("__r")
    return hit.filter("NOT __border").unionByName(ranked).select(*df.columns)


def quotas(counts: DataFrame, group: str, size: int | Column) -> DataFrame:
    """Largest-remainder quotas of `size` over the groups' counts n, ties by group; at most what is there."""
    all_ = Window.partitionBy(F.lit(1))  # as many rows as classes
    size = F.least(F.lit(size) if isinstance(size, int) else size, F.sum("n").over(all_)).cast("long")
    c = counts.withColumn("__p", size * F.col("n")).withColumn("__t", F.sum("n").over(all_)).withColumn("__s", size)
    c = c.withColumn("__f", F.expr("__p div __t")).withColumn("__m", F.col("__p") % F.col("__t"))
    c = c.withColumn("__rest", F.col("__s") - F.sum("__f").over(all_)).withColumn("__k", F.row_number().over(all_.orderBy(F.desc("__m"), group)))
    return c.select(group, (F.col("__f") + (F.col("__k") <= F.col("__rest")).cast("long")).alias("quota"))


NO_LABEL = "\x00"  # stands for a missing label where labels are strata


def _strata(df: DataFrame, label: str) -> DataFrame:
    return df.withColumn("__c", F.coalesce(F.col(label), F.lit(NO_LABEL)))


def stratified_limit(df: DataFrame, size: int | None, label: str = "canonical_label", key: str = "row_id", seed: int = 42) -> DataFrame:
    """Exactly `size` rows (all without a size, or if there are no more) with the natural shares of the labels; rows without a label are a stratum of their own."""
    if size is None:
        return df
    if size <= 0:
        raise ValueError("size must be positive")
    d = _strata(df, label)
    return take_first(d, "__c", key, quotas(d.groupBy("__c").agg(F.count("*").alias("n")), "__c", size), seed).select(*df.columns)


def persisted_limit(df: DataFrame, size: int | None, folder: str, name: str, label: str = "canonical_label", key: str = "row_id", seed: int = 42) -> DataFrame:
    """As stratified_limit, with the chosen keys written below `folder` once and read again by a later call for the same rows. A missing or blank label is refused.

    The selection is named by its split, size, seed and a digest of the input's keys and labels (their number and a sum of hashes, so that no row is collected).
    """
    if size is not None and size <= 0:
        raise ValueError("size must be positive")
    r = df.agg(F.count("*").alias("n"), F.count_if(is_blank(F.col(label))).alias("bad"), F.sum(F.xxhash64(key, label).cast("decimal(38,0)")).alias("h")).first()
    if size is None or r.n <= size:
        return df
    if r.bad:
        raise ValueError(f"{r.bad} rows with a missing or blank {label}")
    digest = hashlib.sha256(json.dumps([r.n, str(r.h), key, label]).encode()).hexdigest()[:16]
    safe = re.sub("[^A-Za-z0-9_.-]+", "-", name.strip()).strip("-.") or "split"
    path = f"{folder.rstrip('/')}/{safe}-n{size}-seed{seed}-{digest}"
    spark = df.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        stratified_limit(df.select(key, label), size, label, key, seed).select(key).write.mode("overwrite").parquet(path)
    return df.join(spark.read.parquet(path), key, "left_semi")


def balanced_sample(df: DataFrame, size: int, label: str = "canonical_label", key: str = "row_id", seed: int = 42) -> DataFrame:
    """size div classes rows of each label, at most what is there; all rows if they are no more than size."""
    d = df.filter(F.col(label).isNotNull())
    c = d.groupBy(label).agg(F.count("*").alias("n"))
    all_ = Window.partitionBy(F.lit(1))
    q = c.select(label, F.when(F.sum("n").over(all_) <= size, F.col("n")).otherwise(F.least(F.col("n"), F.floor(F.lit(size) / F.count("*").over(all_)))).alias("quota"))
    return take_first(d, label, key, q, seed)


def holdout(df: DataFrame, share: float, key: str = "row_id", seed: int = 42) -> DataFrame:
    """ceil(share * rows) rows at random."""
    d = df.withColumn("__g", F.lit(1))
    q = d.groupBy("__g").agg(F.ceil(F.count("*") * F.lit(share)).alias("quota"))
    return take_first(d, "__g", key, q, seed).drop("__g")


def plain_sample(df: DataFrame, size: int, key: str = "row_id", seed: int = 42) -> DataFrame:
    """The first `size` rows by md5(seed:key)."""
    return df.orderBy(order_key(key, seed), key).limit(size)


def stratified_split(df: DataFrame, share: float, label: str = "canonical_label", key: str = "row_id", seed: int = 42) -> DataFrame:
    """Adds split: validation for ceil(share * rows) rows by label quotas, else train. Rows without a label are a stratum of their own, so none is lost.
    If any stratum has one row only, the rows are split plainly at random."""
    _share(share)
    d = _strata(df, label)
    c = d.groupBy("__c").agg(F.count("*").alias("n"))
    all_ = Window.partitionBy(F.lit(1))  # as many rows as labels
    lone = F.min("n").over(all_) < 2
    c = c.select(F.when(lone, F.lit("")).otherwise(F.col("__c")).alias("__stratum"), "__c", "n")
    per = c.groupBy("__stratum").agg(F.sum("n").alias("n"))
    q = quotas(per, "__stratum", F.ceil(F.sum("n").over(all_) * F.lit(share)))
    d = d.select(key, "__c").join(c.select("__c", "__stratum"), "__c").select(key, "__stratum")
    val = take_first(d, "__stratum", key, q, seed).select(key).withColumn("__v", F.lit(True))
    return df.join(val, key, "left").withColumn("split", F.when(F.col("__v"), "validation").otherwise("train")).drop("__v")


def group_split(df: DataFrame, share: float, group: str = "repository", seed: int = 42) -> DataFrame:
    """Adds split: whole groups, ceil(share * groups) of them in validation; a null group is one group."""
    _share(share)
    g = df.select(F.coalesce(F.col(group), F.lit("")).alias("__g")).distinct().withColumn("__one", F.lit(1))
    q = g.groupBy("__one").agg(F.ceil(F.count("*") * F.lit(share)).alias("quota"))
    val = take_first(g, "__one", "__g", q, seed).select("__g", F.lit(True).alias("__v"))
    return df.withColumn("__g", F.coalesce(F.col(group), F.lit(""))).join(val, "__g", "left").withColumn("split", F.when(F.col("__v"), "validation").otherwise("train")).drop("__g", "__v")


def repeated_ids(df: DataFrame, key: str = "issue_id") -> DataFrame:
    """Ids that stand more than once, with their rows."""
    return df.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


def shared_between(train: DataFrame, validation: DataFrame, key: str = "issue_id") -> DataFrame:
    """Distinct ids of both splits."""
    return train.select(key).intersect(validation.select(key))


def make_validation_split(df: DataFrame, share: float = 0.15, seed: int = 42, key: str = "row_id", issue: str | None = None) -> tuple[DataFrame, str]:
    """By repository where every row has one and there are several, else by label. With the name of the id column, ids must be unique before and apart after; the
    first five others are named."""
    _share(share)
    missing = [c for c in ("canonical_label", *([issue] if issue else [])) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if issue:
        bad = [r[0] for r in repeated_ids(df, issue).orderBy(issue).limit(5).collect()]
        if bad:
            raise ValueError(f"ids that repeat: {bad}")
    out, how = None, "stratified_no_repository_metadata"
    if "repository" in df.columns:
        r = df.agg(F.count_if(F.col("repository").isNull()).alias("null"), F.min("repository").alias("a"), F.max("repository").alias("b")).first()
        if not r.null and r.a != r.b:
            out, how = group_split(df, share, seed=seed), "repository_grouped"
    if out is None:
        out = stratified_split(df, share, key=key, seed=seed)
    if issue:
        bad = [r[0] for r in shared_between(out.filter("split = 'train'"), out.filter("split = 'validation'"), issue).orderBy(issue).limit(5).collect()]
        if bad:
            raise RuntimeError(f"ids in both splits: {bad}")
    return out, how


def _share(share: float) -> None:
    if not 0 < share < 1:
        raise ValueError("the share must be between 0 and 1")


def _dealt(loads: list[int], size: int, many: int) -> tuple[list[int], list[int]]:
    """Folds of `many` groups of one size, each to the lightest fold, as a beginning and a cycle that repeats after it. Loads are brought up to date."""
    folds = len(loads)
    heap = [(n, i) for i, n in enumerate(loads)]
    heapq.heapify(heap)
    start: list[int] = []
    while many and heap[0][0] + size <= max(n for n, _ in heap):  # until all loads lie within one group of each other
        n, i = heapq.heappop(heap)
        start.append(i)
        heapq.heappush(heap, (n + size, i))
        many -= 1
    cycle = [i for _, i in sorted(heap)]
    loads[:] = [n for n, _ in sorted(heap, key=lambda x: x[1])]
    for j, i in enumerate(cycle):
        loads[i] += size * (many // folds + (j < many % folds))
    return start, cycle


def group_folds(df: DataFrame, folds: int = 5, group: str = "project") -> DataFrame:
    """(group, fold, n): the largest group to the lightest fold, ties by md5 of the name; rows without a group have no fold.

    Groups of one size are dealt alike: a beginning, then a cycle of the folds. So the driver needs only how many groups each size has (at most the root of twice
    the rows, and mostly few), and the place of a group among those of its size gives its fold. Places are counted by ranges of the digest, so that even all groups of
    one row are never sorted in one task.
    """
    sizes = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    hist = sizes.groupBy("n").agg(F.count("*").alias("m")).orderBy(F.desc("n")).collect()
    if sum(r.m for r in hist) < folds:
        raise ValueError(f"{sum(r.m for r in hist)} groups for {folds} folds")
    loads, plan = [0] * folds, []
    for r in hist:
        start, cycle = _dealt(loads, r.n, r.m)
        plan.append((r.n, start, cycle))
    known = df.sparkSession.createDataFrame(plan, "n long, start array<int>, cycle array<int>")
    d = sizes.withColumn("__h", F.md5(F.col(group).cast("string"))).withColumn("__b", F.substring("__h", 1, 3))
    per = d.groupBy("n", "__b").agg(F.count("*").alias("__m"))  # at most 4,096 rows a size
    before = per.select("n", "__b", (F.sum("__m").over(Window.partitionBy("n").orderBy("__b")) - F.col("__m")).alias("__before"))
    d = d.withColumn("__in", F.row_number().over(Window.partitionBy("n", "__b").orderBy("__h", group)))
    x = d.join(before, ["n", "__b"]).withColumn("__r", F.col("__before") + F.col("__in") - 1).join(known, "n")
    later = F.element_at("cycle", ((F.col("__r") - F.size("start")) % F.size("cycle") + 1).cast("int"))
    return x.select(group, F.when(F.col("__r") < F.size("start"), F.try_element_at("start", (F.col("__r") + 1).cast("int"))).otherwise(later).alias("fold"), "n")


def cross_validation(df: DataFrame, folds: int = 5, group: str = "project"):
    """(train, validation) of each fold; a group is whole on one side."""
    d = df.join(group_folds(df, folds, group).select(group, "fold"), group)
    for i in range(folds):
        yield d.filter(F.col("fold") != i).drop("fold"), d.filter(F.col("fold") == i).drop("fold")
