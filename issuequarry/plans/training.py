"""Training runs. The linear run is complete; of the runs that fine-tune a transformer the whole data plane is here: inputs, checks, samples, class weights, token tables,
prediction tables and manifests. The gradient steps need a deep-learning library, which is asked for only where they would begin."""

from __future__ import annotations

import importlib
import importlib.metadata
from collections.abc import Callable, Mapping
from dataclasses import asdict, dataclass, fields
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuequarry.operators import data as D
from issuequarry.operators import sampling as S
from issuequarry.operators import tokens as K
from issuequarry.plans import models
from issuequarry.session import Scratch
from issuequarry.sources import tables as IO

# Base models of the stages.
BASE_MODELS = {"stage1": "microsoft/deberta-v3-small", "stage2": "answerdotai/ModernBERT-base", "stage3": "answerdotai/ModernBERT-base", "dapt": "answerdotai/ModernBERT-base"}


# Names and defaults of the settings in model files.
@dataclass(frozen=True)
class TransformerConfig:
    """Settings of a fine-tuning run, by their names in model files."""

    model_name: str
    max_length: int = 256
    batch_size: int = 8
    learning_rate: float = 2e-5
    epochs: int = 5
    gradient_accumulation_steps: int = 1
    seed: int = 42
    early_stopping_patience: int = 2
    max_steps: int = -1
    tokenization_batch_size: int = 512
    tokenization_writer_batch_size: int = 512
    dataloader_num_workers: int = 0
    dataset_cache_dir: str | None = None

    def __post_init__(self) -> None:
        if min(self.tokenization_batch_size, self.tokenization_writer_batch_size) <= 0:
            raise ValueError("token batches must be positive")
        if self.dataloader_num_workers < 0:
            raise ValueError("the number of workers can't be negative")

    @classmethod
    def of(cls, stage: str, values: Mapping[str, Any] | None = None) -> TransformerConfig:
        own = {f.name for f in fields(cls)}
        return cls(**{"model_name": BASE_MODELS[stage], **{k: v for k, v in (values or {}).items() if k in own}})


def library(name: str, for_what: str):
    """A library that isn't needed otherwise, or an error that says what it is needed for."""
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise ImportError(f"{for_what} needs the package {name}, which isn't installed") from e


def version_of(package: str) -> str:
    try:
        return importlib.metadata.version(package)
    except importlib.metadata.PackageNotFoundError:
        return "unavailable"


def whole_validation(max_eval_samples: int | None) -> None:
    if max_eval_samples is not None:
        raise ValueError("evaluation always takes the whole validation split")


def load_inputs(spark: SparkSession, train: str | DataFrame, validation: str | DataFrame, limit: int | None = None, cache: str | None = None, seed: int = 42) -> tuple[DataFrame, DataFrame, bool]:
    """(train, validation, whether predictions keep the text). Paths are read with the columns that are needed, and the training rows limited by a persisted selection; tables are taken
    as they are, of train only text and label."""
    if isinstance(train, str) and isinstance(validation, str):
        t = IO.read_columns(spark, train, ["row_id", "text", "canonical_label"])
        v = IO.read_columns(spark, validation, ["row_id", "issue_id", "text", "canonical_label"])
        if limit is not None:
            t = S.persisted_limit(t, limit, cache, "train", seed=seed) if cache else S.stratified_limit(t, limit, seed=seed)
        return t, v, False
    if isinstance(train, str) or isinstance(validation, str):
        raise TypeError("train and validation must both be paths or both be tables")
    for d in (train, validation):
        D.need(d, "text", "canonical_label")
    return models.require_model_text(train).select(*[c for c in ("row_id", "text", "canonical_label") if c in train.columns]), models.require_model_text(validation), True


def balanced_weights(labels: list[str], counts: Mapping[str, int]) -> list[float]:
    """total / (classes * count), in the order of the labels."""
    total = sum(counts.values())
    return [total / (len(labels) * counts[x]) for x in labels]


def transformer_inputs(train: DataFrame, validation: DataFrame, config: TransformerConfig, cache: str, make: Callable | None = None, keep_text: bool = True, key: str = "row_id") -> dict[str, Any]:
    """What a trainer reads: token tables of both splits, labels, class weights, counts, and the columns of validation that go along with its predictions."""
    counts = {n: D.inspected(d, n) for n, d in (("train", train), ("validation", validation))}
    labels = sorted(counts["train"])
    if extra := sorted(set(counts["validation"]) - set(labels)):
        raise ValueError(f"labels of validation that train lacks: {extra}")
    codes = {x: i for i, x in enumerate(labels)}
    name = config.model_name if make else "crc"
    return {
        "train": K.cached_tokens(train, cache, "train", key, codes, config.max_length, make, name), "validation": K.cached_tokens(validation, cache, "validation", key, codes, config.max_length, make, name),
        "labels": labels, "weights": balanced_weights(labels, counts["train"]), "counts": counts, "metadata": validation if keep_text else validation.drop("text"),
    }


def prediction_table(metadata: DataFrame, scores: DataFrame, labels: list[str], key: str = "row_id") -> DataFrame:
    """The columns kept of validation and the label of the greatest score. scores: key and an array of doubles."""
    from issuequarry.functions.text import argmax_label

    return metadata.join(scores.select(key, argmax_label(F.col("scores"), labels).alias("prediction")), key)


def run_tfidf(spark: SparkSession, output: str, data_dir: str | None = None, train: str | None = None, validation: str | None = None, config: str | None = None, max_train_samples: int | None = None, max_eval_samples: int | None = None) -> dict[str, Any]:
    """Fits on the (limited) training split and evaluates the whole validation split; writes model, training_config.json and validation/."""
    whole_validation(max_eval_samples)
    values = IO.settings(config, {"seed": 42})
    source = IO.read_columns(spark, IO.split_path("train", data_dir, train), ["row_id", "text", "canonical_label"])
    rows = source.count()
    used = S.stratified_limit(source, max_train_samples, seed=int(values["seed"])) if max_train_samples is None or max_train_samples <= 0 or rows > max_train_samples else source
    counts = {r.canonical_label: r.n for r in D.class_counts(used).collect()}
    values |= {"max_train_samples": max_train_samples, "source_training_rows": rows, "training_rows": sum(counts.values()), "training_class_counts": counts}
    model = models.fit_linear(used, values=values)
    model.save(f"{output}/model")
    IO.write_json(f"{output}/training_config.json", models.resolved_config(values))
    return models.evaluate(model.predict(spark.read.parquet(IO.split_path("validation", data_dir, validation))), "canonical_label", f"{output}/validation")


def run_stage(spark: SparkSession, stage: str, output: str, data_dir: str | None = None, train: str | None = None, validation: str | None = None, config: str | None = None, max_train_samples: int | None = None,
              max_eval_samples: int | None = None, max_steps: int | None = None, fit: Callable[[dict[str, Any], TransformerConfig], DataFrame] | None = None) -> dict[str, Any]:
    """A run of stage1, stage2 or stage3. `fit` gets the inputs and settings and returns (row_id, scores) of validation; without it a deep-learning library is asked for after all
    data has been prepared."""
    if stage == "stage1":
        whole_validation(max_eval_samples)
    c = TransformerConfig.of(stage, {**IO.settings(config, {}), **({} if max_steps is None else {"max_steps": max_steps})})
    cache = c.dataset_cache_dir or f"{output.rstrip('/')}/cache"
    paths = [IO.split_path("train", data_dir, train), IO.split_path("validation", data_dir, validation)]
    if stage == "stage1":
        t, v, keep = load_inputs(spark, *paths, max_train_samples, cache, c.seed)
    else:
        pick = D.stage2_rows if stage == "stage2" else D.stage3_rows
        t, v = (D.not_empty(pick(spark.read.parquet(p)), stage) for p in paths)
        S.group_folds(t, min(5, t.select("project").filter("project IS NOT NULL").distinct().count()))  # the split by project must be possible
        t, v, keep = load_inputs(spark, t, v)
    inputs = transformer_inputs(t, v, c, cache, keep_text=keep)
    IO.write_json(f"{output}/training_config.json", asdict(c))
    if fit is None:
        library("torch", f"fine-tuning {stage}"), library("transformers", f"fine-tuning {stage}")
        raise NotImplementedError("pass `fit`: the data is ready, the gradient steps are the caller's")
    scored = prediction_table(inputs["metadata"], fit(inputs, c), inputs["labels"])
    scored.write.mode("overwrite").parquet(f"{output}/validation_predictions.parquet")
    values = models.M.classification_metrics(scored, "canonical_label", "prediction")
    IO.write_json(f"{output}/validation_metrics.json", values)
    return values


def pretraining_corpus(corpus: DataFrame, held_out: DataFrame | None = None, strict: bool = False, seed: int = 42, key: str = "row_id") -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """(train, validation, manifest) of an unlabelled corpus: projects held out, then ceil(a tenth) of the rows for validation. held_out: a table with `project`."""
    D.need(corpus, "text", key)
    if strict:
        if held_out is None or "project" not in corpus.columns:
            raise ValueError("a strict run needs the column project and the projects held out")
        corpus = D.exclude_projects(corpus, held_out)
    corpus = D.not_empty(corpus, "all projects are held out" if strict else "the corpus")
    validation = S.holdout(corpus.select(key), 0.1, key, seed)
    parts = corpus.join(validation, key, "left_anti"), corpus.join(validation, key, "left_semi")
    n = [p.count() for p in parts]
    names = sorted(r[0] for r in held_out.select("project").filter("project IS NOT NULL").distinct().collect()) if held_out is not None else []  # a given list
    return *parts, {"base_model": BASE_MODELS["dapt"], "train_rows": n[0], "validation_rows": n[1], "strict_exclude_eval_projects": strict, "excluded_projects": names}


def run_pretraining(spark: SparkSession, train: str | None, output: str, config: str | None = None) -> dict[str, Any]:
    """Writes both parts of the corpus, padded token tables and corpus_manifest.json; masking is the trainer's."""
    if not train:
        raise ValueError("a corpus is needed (--train)")
    v = IO.settings(config, {"held_out_projects": None, "strict_exclude_eval_projects": False, "seed": 42, "max_length": 256, "model_name": BASE_MODELS["dapt"]})
    held = spark.createDataFrame([(p,) for p in v["held_out_projects"]], "project string") if v["held_out_projects"] is not None else None
    corpus = spark.read.parquet(train)
    if "row_id" not in corpus.columns:
        corpus = Scratch(spark, "corpus").keep(corpus.withColumn("row_id", F.monotonically_increasing_id()))
    *parts, manifest = pretraining_corpus(corpus, held, v["strict_exclude_eval_projects"], v["seed"])
    for name, p in zip(("train", "validation"), parts, strict=True):
        K.padded_to_max(p.select("row_id", "text"), max_length=v["max_length"]).write.mode("overwrite").parquet(f"{output}/{name}-tokens.parquet")
    manifest["base_model"] = v["model_name"]
    IO.write_json(f"{output}/corpus_manifest.json", manifest)
    return manifest
