"""Linear text classifier on TF-IDF vectors, batched scoring of any model, and the label hierarchy."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path
from typing import Any, Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Transformer
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from issuequarry.functions import text as T
from issuequarry.operators import data as D
from issuequarry.operators import metrics as M
from issuequarry.operators import tfidf as X
from issuequarry.plans import linear as L
from issuequarry.session import Scratch
from issuequarry.sources.tables import write_json


class TextPredictor(Protocol):
    """A plug-in: texts to labels."""

    def predict(self, texts: list[str]) -> list[str]: ...


def predict_in_batches(df: DataFrame, make: Callable[[], TextPredictor], text: str = "text", out: str = "prediction", batch: int = 1000) -> DataFrame:
    """df with the plug-in's labels. The plug-in is made once a task and sees at most `batch` texts at a time."""
    if batch <= 0:
        raise ValueError("batch must be positive")

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for f in frames:
            labels: list[str] = []
            for i in range(0, len(f), batch):
                labels += list(model.predict(f[text].iloc[i : i + batch].tolist()))
            yield f.assign(**{out: labels})

    return df.mapInPandas(work, StructType([*df.schema.fields, StructField(out, StringType())]))


def resolved_config(values: Mapping[str, Any] | None = None) -> dict[str, Any]:
    """Every setting of a TF-IDF run as it will be used, and the counters of the run that `values` has."""
    v = dict(values or {})
    out = X.TfidfConfig.from_mapping(v).as_dict()
    out |= {"class_weight": v.get("class_weight", "balanced"), "classifier_max_iter": int(v.get("classifier_max_iter", 5000)), "seed": int(v.get("seed", 42))}
    return out | {k: v[k] for k in ("max_train_samples", "source_training_rows", "training_rows", "training_class_counts") if k in v}


def require_model_text(df: DataFrame, text: str = "text") -> DataFrame:
    """df, or an error if the column is missing or has a null or blank text (one aggregate)."""
    D.need(df, text)
    bad = df.filter(T.is_blank(F.col(text))).limit(1).count()
    if bad:
        raise ValueError(f"{text} has missing or blank values")
    return df


@dataclass
class LinearTextModel:
    """Vocabulary (block, term, idf, idx; at most as many rows as the settings allow), linear machines one versus rest (machines x features and intercept), and the labels by code."""

    config: dict[str, Any]
    labels: list[str]
    vocabulary: DataFrame
    svm: np.ndarray

    def vectors(self, df: DataFrame, text: str, scratch: Scratch) -> DataFrame:
        return _vectors(df, text, X.TfidfConfig.from_mapping(self.config), self.vocabulary.toArrow(), scratch)

    def predict(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with prediction. Texts without a known term get the zero vector."""
        scratch = Scratch(df.sparkSession, "predict")
        d = scratch.keep(df.withColumn("__key", F.monotonically_increasing_id()))
        names = F.array(*[F.lit(x) for x in self.labels])
        config = X.TfidfConfig.from_mapping(self.config)
        scored = L.scored(d, "__key", text, config, _terms(self.vocabulary.toArrow(), config), self.svm).select("__key", F.element_at(names, F.col("code") + 1).alias("prediction"))
        return d.join(scored, "__key").select(*df.columns, "prediction")

    def save(self, path: str) -> None:
        self.vocabulary.write.mode("overwrite").parquet(f"{path}/vocabulary")
        machines = pa.table({"machine": pa.array(range(len(self.svm)), pa.int32()), "w": pa.array([x.tobytes() for x in self.svm], pa.binary())})
        self.vocabulary.sparkSession.createDataFrame(machines).coalesce(1).write.mode("overwrite").parquet(f"{path}/classifier")
        self.vocabulary.sparkSession.createDataFrame([(json.dumps({"config": self.config, "labels": self.labels}),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/settings")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LinearTextModel:
        from pyspark.errors import AnalysisException

        try:
            v = json.loads(spark.read.text(f"{path}/settings").first().value)
        except AnalysisException:
            raise FileNotFoundError(path) from None
        return cls(v["config"], v["labels"], spark.read.parquet(f"{path}/vocabulary"), np.stack([np.frombuffer(r.w) for r in spark.read.parquet(f"{path}/classifier").orderBy("machine").collect()]))


def _terms(vocab: pa.Table, config: X.TfidfConfig) -> dict[str, tuple[pa.Array, np.ndarray]]:
    """Terms and idf of each block, in the order of their numbers."""
    of = {b: vocab.filter(pc.field("block") == b).sort_by("idx") for b in X.block_names(config)}
    return {b: (v["term"].combine_chunks(), v["idf"].to_numpy()) for b, v in of.items()}


def _vectors(df: DataFrame, text: str, config: X.TfidfConfig, vocab: pa.Table, scratch: Scratch) -> DataFrame:
    """(__key, features): sparse vectors of the rows of df by __key. They are written as arrays and read as vectors, whose stored layout is the same."""
    from pyspark.ml.linalg import VectorUDT

    path = scratch.keep(X.vectors(df, "__key", text, config, _terms(vocab, config))).scratch_path
    return df.sparkSession.read.schema(StructType([df.select("__key").schema[0], StructField("features", VectorUDT())])).parquet(path)


def fit_linear(df: DataFrame, text: str = "text", label: str = "canonical_label", values: Mapping[str, Any] | None = None) -> LinearTextModel:
    """TF-IDF features of the settings, and one linear support vector machine a class with squared hinge loss, the penalty of C = 1 and class weights. Rows without a label take no part; a blank text is refused.

    The size of a model depends on features x classes only; the vocabulary is counted over all rows.
    """
    c = resolved_config(values)
    config = X.TfidfConfig.from_mapping(c)
    D.need(df, text, label)
    scratch = Scratch(df.sparkSession, "tfidf-fit")
    d = scratch.keep(require_model_text(df, text).filter(F.col(label).isNotNull()).select(F.monotonically_increasing_id().alias("__key"), F.col(text).alias("text"), F.col(label).alias("label")))
    rows = d.count()
    if not rows:
        raise ValueError("no labelled rows")
    parts, kept, found = [], 0, []
    for block, v in X.vocabularies(d, "__key", "text", rows, config).items():
        v = v.sort_by("term")
        parts.append(pa.table({"block": pa.array([block] * len(v), pa.string()), "term": v["term"], "idf": X.idf(v["df"].to_numpy(), rows), "idx": np.arange(kept, kept + len(v), dtype=np.int32)}))
        kept += len(v)
        found.append(v)
    vocab = pa.concat_tables(parts)  # at most max_features rows a block
    codes = D.sorted_codes(d, "label")
    weight = D.class_weights(d, "label") if c["class_weight"] == "balanced" else D.class_counts(d, "label").select("label", F.lit(1.0).alias("weight"))
    known = d.join(F.broadcast(codes.join(weight, "label")), "label").select("__key", "text", F.col("code").cast("double").alias("label"), "weight")  # a row a label
    labels = [r.label for r in codes.orderBy("code").collect()]
    dense = L.planes(*[np.concatenate([v[x].to_numpy() for v in found]) for x in ("df", "tf")], rows, [len(v) for v in found], config)
    train = scratch.keep(L.stored(known, "__key", "text", config, _terms(vocab, config), "label", "weight", dense))
    svm = L.fit(train, vocab["idf"].to_numpy(), len(labels), dense, rows, c["classifier_max_iter"])
    words = scratch.keep(df.sparkSession.createDataFrame(vocab))
    scratch.drop_but(words)
    return LinearTextModel(c, labels, words, svm)


def predict_linear(model: LinearTextModel, df: DataFrame, text: str = "text") -> DataFrame:
    return model.predict(df, text)


def audited(weighted: DataFrame, name: str = "matrix") -> tuple[DataFrame, Observation]:
    """A long table of weights as it is, and an observation that gets its entries and bytes (without row pointers) once it has been computed; no further pass is made."""
    seen = Observation(name)
    n = F.count(F.lit(1))
    return weighted.observe(seen, n.alias("nnz"), (n * 8).alias("bytes"), F.max("weight").alias("greatest")), seen


class MatrixAudit(Transformer):
    """A pipeline stage that hands a long table of weights on as it is and observes its entries and bytes while it is computed."""

    def __init__(self, name: str = "matrix"):
        super().__init__()
        self.name, self.seen = name, None

    def _transform(self, dataset: DataFrame) -> DataFrame:
        out, self.seen = audited(dataset, self.name)
        return out

    def figures(self) -> dict[str, Any]:
        """What was seen, once the transformed table has been computed."""
        return dict(self.seen.get) if self.seen else {}


def evaluate(scored: DataFrame, truth: str, output: str | None = None, drop: tuple[str, ...] = ()) -> dict[str, Any]:
    """Metrics of a scored table; below `output` also metrics.json and predictions.parquet (without the columns to drop)."""
    values = M.classification_metrics(scored, truth, "prediction")
    if output:
        scored.drop(*drop).write.mode("overwrite").parquet(f"{output}/predictions.parquet")
        write_json(Path(output) / "metrics.json", values)
    return values


def evaluate_hierarchy(scored: DataFrame, output: str | None = None) -> dict[str, Any]:
    """Metrics of final_label against prediction; below `output` also hierarchy_metrics.json."""
    values = M.classification_metrics(scored, "final_label", "prediction")
    if output:
        write_json(Path(output) / "hierarchy_metrics.json", values)
    return values


def hierarchy(df: DataFrame, stages: tuple[Callable[[DataFrame], DataFrame], ...]) -> DataFrame:
    """Each stage adds `prediction` to its rows; stage 2 sees bugs only, stage 3 only those that aren't BOH. Adds stage1, stage2, stage3, final_label."""
    one = stages[0](df).withColumnRenamed("prediction", "stage1")
    bug = F.coalesce(F.col("stage1") == "BUG", F.lit(False))
    rest = one.filter(~bug).withColumns({"stage2": F.lit(None).cast("string"), "stage3": F.lit(None).cast("string")})
    two = stages[1](one.filter(bug)).withColumnRenamed("prediction", "stage2")
    boh = F.coalesce(F.col("stage2") == "BOH", F.lit(False))
    done = two.filter(boh).withColumn("stage3", F.lit(None).cast("string"))
    three = stages[2](two.filter(~boh)).withColumnRenamed("prediction", "stage3")
    return rest.unionByName(done).unionByName(three).withColumn("final_label", T.route(F.col("stage1"), F.col("stage2"), F.col("stage3")))
