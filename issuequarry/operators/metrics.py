"""Classification metrics from one confusion table (a row a pair of labels)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, prediction: str) -> DataFrame:
    """(truth, prediction, n) over the union of the labels of both sides, zeros included; rows with a null are left out."""
    c = df.filter(F.col(truth).isNotNull() & F.col(prediction).isNotNull()).groupBy(F.col(truth).alias("truth"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))
    labels = c.select(F.col("truth").alias("x")).unionAll(c.select("prediction")).distinct()
    grid = labels.select(F.col("x").alias("truth")).crossJoin(labels.select(F.col("x").alias("prediction")))  # labels squared
    return grid.join(c, ["truth", "prediction"], "left").select("truth", "prediction", F.coalesce("n", F.lit(0)).alias("n"))


def per_class(c: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support); 0 where a denominator is 0."""
    hit = F.sum(F.when(F.col("truth") == F.col("prediction"), F.col("n")).otherwise(0))
    t = c.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), hit.alias("hit"))
    p = c.groupBy(F.col("prediction").alias("label")).agg(F.sum("n").alias("guessed"))
    zero = lambda a, b: F.when(b == 0, F.lit(0.0)).otherwise(F.try_divide(a, b))
    x = t.join(p, "label")
    return x.select(
        "label", zero(F.col("hit"), F.col("guessed")).alias("precision"), zero(F.col("hit"), F.col("support")).alias("recall"), zero(2 * F.col("hit"), F.col("guessed") + F.col("support")).alias("f1"), "support", "hit", "guessed"
    )


def summary(c: DataFrame) -> DataFrame:
    """(metric, value): accuracy, macro, micro and weighted F1, balanced accuracy, Matthews correlation."""
    p = per_class(c)
    s, h = F.sum("support").cast("double"), F.sum("hit").cast("double")
    tp, pp, tt = F.sum(F.col("support") * F.col("guessed")).cast("double"), F.sum(F.col("guessed") * F.col("guessed")).cast("double"), F.sum(F.col("support") * F.col("support")).cast("double")
    den = F.sqrt((s * s - pp) * (s * s - tt))
    one = p.agg(
        (h / s).alias("accuracy"), F.avg("f1").alias("macro_f1"), (h / s).alias("micro_f1"), (F.sum(F.col("f1") * F.col("support")) / s).alias("weighted_f1"),
        F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"), F.when(den == 0, F.lit(0.0)).otherwise(F.try_divide(h * s - tp, den)).alias("mcc"),
    )
    return one.select(F.expr(f"stack({len(one.columns)}, " + ", ".join(f"'{m}', {m}" for m in one.columns) + ") AS (metric, value)"))


def report(c: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of every class, and the rows accuracy, macro avg and weighted avg over all rows (accuracy stands in all three columns)."""
    p = per_class(c)
    s = F.sum("support")
    mean = {m: {"macro avg": F.avg(m), "weighted avg": F.sum(F.col(m) * F.col("support")) / s, "accuracy": F.sum("hit") / s} for m in ("precision", "recall", "f1")}
    rows = ("accuracy", "macro avg", "weighted avg")
    one = p.agg(*[mean[m][r].alias(f"{m}_{i}") for m in mean for i, r in enumerate(rows)], s.alias("support"))
    total = one.select(F.expr("stack(3, " + ", ".join(f"'{r}', precision_{i}, recall_{i}, f1_{i}" for i, r in enumerate(rows)) + ") AS (label, precision, recall, f1)"), "support")
    return p.select("label", "precision", "recall", "f1", "support").unionByName(total)


def training_metrics(c: DataFrame) -> DataFrame:
    """What a trainer watches: the F1 scores and the Matthews correlation."""
    return summary(c).filter("metric LIKE '%_f1' OR metric = 'mcc'")


def classification_metrics(df: DataFrame, truth: str, prediction: str) -> dict:
    """Scores, sorted labels, confusion matrix and report of a scored table, from one confusion table (labels squared rows). No rows, or a null on either side, is an error."""
    missing = [x for x in (truth, prediction) if x not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    n = df.agg(F.count("*").alias("n"), F.count_if(F.col(truth).isNull() | F.col(prediction).isNull()).alias("null")).first()
    if not n.n or n.null:
        raise ValueError(f"metrics need rows with truth and prediction: {n.n} rows, {n.null} with a null")
    table = confusion(df, truth, prediction).collect()
    c = df.sparkSession.createDataFrame(table, "truth string, prediction string, n long")
    labels = sorted({r.truth for r in table})
    at = {(r.truth, r.prediction): r.n for r in table}
    per = {r.label: {x: r[x] for x in ("precision", "recall", "f1", "support")} for r in report(c).collect()}
    return {**{r.metric: r.value for r in summary(c).collect()}, "labels": labels, "confusion_matrix": [[at[a, b] for b in labels] for a in labels], "per_class": per}
