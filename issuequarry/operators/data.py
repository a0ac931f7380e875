"""Harmonising, filters, checks, deduplication and set operations on issue tables. Every operator maps DataFrames to a lazy DataFrame unless it says it raises."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from issuequarry.functions import text as T


def harmonize(df: DataFrame, label: str, title: str | None = None, body: str | None = None, issue_id: str | None = None, repository: str | None = None, ordinal: str | None = None) -> DataFrame:
    """The canonical columns beside the source's own; rows with neither title nor body are dropped; without an id column the ordinal is the id."""
    part = lambda c: T.clean_text(F.col(c)) if c else F.lit("")
    cols = {"title": part(title), "body": part(body), "original_label": F.col(label)}
    cols["issue_id"] = (F.col(issue_id) if issue_id else F.col(ordinal) if ordinal else F.monotonically_increasing_id()).cast("string")
    if repository:
        cols["repository"] = part(repository)
    out = df.withColumns(cols).filter("title <> '' OR body <> ''").withColumn("text", T.issue_text(F.col("title"), F.col("body")))
    return out.withColumns({"canonical_label": T.canonical_label(F.col("original_label")), "text_hash": T.text_hash(F.col("text"))}).withColumn("binary_label", T.binary_label(F.col("canonical_label")))


def unmapped_labels(df: DataFrame) -> DataFrame:
    """Distinct source labels without a canonical one."""
    return df.filter(F.col("canonical_label").isNull()).select("original_label").distinct()


def keep_first(df: DataFrame, by: str = "text_hash", ordinal: str = "row_id") -> DataFrame:
    """The first row of each value by the ordinal; null is a value. The winners are found on two columns by partial aggregation, and only they take their row along."""
    first = df.groupBy(by).agg(F.min(ordinal).alias("__first"))
    return df.join(first, F.col("__first") == F.col(ordinal), "left_semi")


def first_rows(df: DataFrame, carry: list[str], by: str = "text_hash", ordinal: str = "row_id") -> DataFrame:
    """(by, ordinal, the carried columns) of the first row of each value: one grouping and no join, for columns that are short."""
    return df.groupBy(by).agg(F.min(F.struct(ordinal, *carry)).alias("__x")).select(by, "__x.*")


def overlap(left: DataFrame, right: DataFrame, by: str = "text_hash") -> DataFrame:
    """Rows of right whose value is in left."""
    return right.join(left.select(by).distinct(), by, "left_semi").select(*right.columns)


def without_overlap(train: DataFrame, test: DataFrame, by: str = "text_hash") -> DataFrame:
    """Rows of train whose value isn't in test; nulls stay."""
    return train.join(test.select(by).distinct(), by, "left_anti").select(*train.columns)


def shared_ids(df: DataFrame, key: str = "issue_id") -> DataFrame:
    """One row: the rows that share their id with another."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("affected"))


def checked_unique(df: DataFrame, key: str = "issue_id") -> DataFrame:
    """df, or an error that names five ids which still repeat."""
    bad = [r[0] for r in df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").orderBy(key).limit(5).select(key).collect()]
    if bad:
        raise ValueError(f"ids that repeat: {bad}")
    return df


def checked_apart(train: DataFrame, test: DataFrame, by: str = "text_hash") -> DataFrame:
    """train, or an error if it shares a value with test."""
    if not overlap(test, train, by).isEmpty():
        raise RuntimeError(f"train and test share values of {by}")
    return train


def unique_ids(df: DataFrame, key: str = "issue_id", digest: str = "text_hash") -> DataFrame:
    """If any id repeats, every id becomes id:hash16 and the old one source_issue_id; else source_issue_id is null."""
    flag = df.groupBy(key).agg(F.count("*").alias("n")).agg((F.max("n") > 1).alias("__any"))
    out = df.drop("source_issue_id").crossJoin(F.broadcast(flag))  # one row
    return out.withColumns({"source_issue_id": F.when(F.col("__any"), F.col(key)), key: F.when(F.col("__any"), T.internal_id(F.col(key), F.col(digest))).otherwise(F.col(key))}).drop("__any")


def exclude_projects(df: DataFrame, held_out: DataFrame, project: str = "project") -> DataFrame:
    """Rows of other projects; rows without a project stay."""
    return df.join(held_out.select(project).distinct(), project, "left_anti").select(*df.columns)


def misclassified(df: DataFrame, truth: str, prediction: str = "prediction") -> DataFrame:
    """Rows whose prediction isn't the truth; a null on either side is a miss."""
    return df.filter(F.coalesce(F.col(truth) != F.col(prediction), F.lit(True)))


def need(df: DataFrame, *columns: str) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def stage2_rows(df: DataFrame, label: str = "canonical_label") -> DataFrame:
    """Bugs of a known class, the two classes of stage 3 folded into one."""
    need(df, label, "text", "project")
    return df.filter(F.col(label).isin(*T.STAGE2, *T.STAGE3)).withColumn(label, T.fold_stage2(F.col(label)))


def stage3_rows(df: DataFrame, label: str = "canonical_label") -> DataFrame:
    need(df, label, "text", "project")
    return df.filter(F.col(label).isin(*T.STAGE3))


def not_empty(df: DataFrame, what: str) -> DataFrame:
    """df, or an error if it has no row (one small job)."""
    if df.isEmpty():
        raise ValueError(f"no rows: {what}")
    return df


def union_outer(*frames: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def validation_report(df: DataFrame, text: str = "text", label: str = "canonical_label", expected: tuple[str, ...] = T.STAGE1) -> DataFrame:
    """One row: rows, blank texts, null labels and labels outside the expected ones."""
    t, x = F.col(text), F.col(label)
    return df.agg(F.count("*").alias("rows"), F.count_if(T.is_blank(t)).alias("blank_texts"), F.count_if(x.isNull()).alias("null_labels"), F.count_if(~x.isin(*expected)).alias("unexpected_labels"))


def validate(df: DataFrame, text: str = "text", label: str = "canonical_label", expected: tuple[str, ...] | None = None) -> int:
    """Raises ValueError for missing columns, no rows, blank texts or unexpected labels; else the number of rows."""
    missing = [c for c in (text, label) if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    r = validation_report(df, text, label, expected or T.STAGE1).first()
    if not r.rows:
        raise ValueError("the table is empty")
    if r.blank_texts:
        raise ValueError(f"{r.blank_texts} blank texts")
    if expected and r.unexpected_labels:
        raise ValueError(f"{r.unexpected_labels} unexpected labels")
    return r.rows


def variant_checks(splits: dict[str, DataFrame]) -> DataFrame:
    """(check, violations) over train_clean, validation_clean and test: shared hashes with test, shared ids of train and validation."""
    def shared(a: str, b: str, by: str) -> DataFrame:
        both = splits[a].select(by).filter(F.col(by).isNotNull()).distinct().join(splits[b].select(by).distinct(), by, "left_semi")
        return both.agg(F.count("*").alias("violations")).select(F.lit(f"{a}/{b}/{by}").alias("check"), "violations")

    pairs = [("train_clean", "test", "text_hash"), ("validation_clean", "test", "text_hash"), ("train_clean", "validation_clean", "issue_id")]
    return reduce(DataFrame.unionAll, [shared(*p) for p in pairs])


def inspect(df: DataFrame, label: str = "canonical_label", text: str = "text") -> DataFrame:
    """Rows and blank texts per label."""
    return df.groupBy(label).agg(F.count("*").alias("rows"), F.count_if(T.is_blank(F.col(text))).alias("blank_texts"))


def inspected(df: DataFrame, name: str, label: str = "canonical_label", text: str = "text") -> dict[str, int]:
    """Sorted class counts (a row a label on the driver) of a table that a model is to read; an empty one, a blank text or label is refused."""
    if not name.strip():
        raise ValueError("a table needs a name")
    need(df, label, text)
    rows = inspect(df, label, text).collect()
    if not rows:
        raise ValueError(f"{name} is empty")
    if any(r.blank_texts for r in rows):
        raise ValueError(f"{name} has {sum(r.blank_texts for r in rows)} blank texts")
    if any(r[label] is None or not r[label].strip() for r in rows):
        raise ValueError(f"{name} has rows without a label")
    return {r[label]: r.rows for r in sorted(rows, key=lambda r: r[label])}


def label_domain_gap(validation: DataFrame, train: DataFrame, label: str = "canonical_label") -> DataFrame:
    """Labels of validation that train lacks."""
    return validation.select(label).filter(F.col(label).isNotNull()).distinct().join(train.select(label).distinct(), label, "left_anti")


def statistics(df: DataFrame, label: str = "canonical_label", repository: str = "repository", digest: str = "text_hash") -> DataFrame:
    """One row: rows, labelled rows, distinct repositories, duplicate hashes (null is a value). One grouping a column, each with partial aggregation; no row is expanded."""
    one = df.agg(F.count("*").alias("rows"), F.count(label).alias("labelled"))
    names = df.filter(F.col(repository).isNotNull()).groupBy(repository).agg(F.lit(1)).agg(F.count("*").alias("repositories"))
    hashes = df.groupBy(digest).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_hashes"))
    return one.crossJoin(names).crossJoin(hashes)  # one row each


def sorted_class_counts(df: DataFrame, label: str = "canonical_label") -> DataFrame:
    """Class counts in the order of their labels."""
    return class_counts(df, label).orderBy(label)


def first_seen_codes(df: DataFrame, label: str = "canonical_label", ordinal: str = "row_id") -> DataFrame:
    """(label, code): labels numbered from 0 in the order in which they first stand in the table."""
    first = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.min(ordinal).alias("__first"))
    return first.select(label, (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("__first")) - 1).alias("code"))  # a row a label


def sorted_codes(df: DataFrame, label: str = "canonical_label") -> DataFrame:
    """(label, code): labels numbered from 0 in their order."""
    names = df.filter(F.col(label).isNotNull()).select(label).distinct()
    return names.select(label, (F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(label)) - 1).alias("code"))


def class_counts(df: DataFrame, label: str = "canonical_label") -> DataFrame:
    return df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n"))


def class_weights(df: DataFrame, label: str = "canonical_label") -> DataFrame:
    """total / (classes * count) of each label."""
    c = class_counts(df, label)
    all_ = Window.partitionBy(F.lit(1))  # as many rows as labels
    return c.select(label, (F.sum("n").over(all_) / (F.count("*").over(all_) * F.col("n"))).alias("weight"))
