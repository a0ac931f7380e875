"""Token tables for sequence models: ids with labels, attention masks, padding, and a cache by fingerprint.

Native tokens (crc_tokens) stay in the JVM. Any other tokenizer runs in Arrow batches: a factory makes it once a task, and it maps a list of texts to lists of ids.
Nulls and blank texts are refused where a model is to read them; empty tables give empty tables. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator, Mapping
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from issuequarry.functions import text as T
from issuequarry.operators import data as D

Tokenizer = Callable[[list[str]], list[list[int]]]


def padded(ids: Column, width: Column | int, pad: int = 0) -> Column:
    """ids, filled up to `width`."""
    w = F.lit(width) if isinstance(width, int) else width
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(w - F.size(ids), F.lit(0)).cast("int")))


def attention_mask(ids: Column, width: Column | int | None = None) -> Column:
    """1 for each token, 0 for padding up to `width`."""
    ones = F.array_repeat(F.lit(1), F.size(ids))
    return ones if width is None else padded(ones, width)


def padded_to_max(df: DataFrame, text: str = "text", max_length: int = 256, pad: int = 0) -> DataFrame:
    """df's other columns with input_ids and attention_mask of exactly max_length, cut and padded."""
    if max_length <= 0:
        raise ValueError("max_length must be positive")
    d = df.withColumn("__ids", F.slice(T.crc_tokens(F.col(text), max_length), 1, max_length))
    return d.select(*[c for c in df.columns if c != text], padded(F.col("__ids"), max_length, pad).alias("input_ids"), attention_mask(F.col("__ids"), max_length).alias("attention_mask"))


def dynamic_padding(df: DataFrame, batch: Column, ids: str = "input_ids", pad: int = 0) -> DataFrame:
    """df with ids padded to the widest row of their batch, and attention_mask. The widths are found by partial aggregation and joined back, a row a batch."""
    d = df.withColumn("__batch", batch)
    wide = d.groupBy("__batch").agg(F.max(F.size(ids)).alias("__w"))
    d = d.join(wide, "__batch")
    return d.select(*[padded(F.col(c), F.col("__w"), pad).alias(c) if c == ids else F.col(c) for c in df.columns], attention_mask(F.col(ids), F.col("__w")).alias("attention_mask"))


def label_codes(df: DataFrame, label: str = "canonical_label") -> dict[str, int]:
    """Labels numbered in their order (a row a label on the driver)."""
    return {r[label]: r.code for r in D.sorted_codes(df, label).collect()}


def tokenized(df: DataFrame, key: str, codes: Mapping[str, int], max_length: int = 256, make: Callable[[], Tokenizer] | None = None, text: str = "text", label: str = "canonical_label") -> DataFrame:
    """(key, input_ids, attention_mask, labels), cut to max_length and not padded. A null or blank text, or a label without a code, fails the job."""
    if max_length <= 0:
        raise ValueError("max_length must be positive")
    code = F.create_map(*[F.lit(x) for kv in codes.items() for x in kv])[F.col(label)]
    checked = F.when(T.is_blank(F.col(text)), F.raise_error(F.lit("model input has a missing or blank text")).cast("string")).otherwise(F.col(text))
    number = F.when(code.isNull(), F.raise_error(F.concat(F.lit("no code for label "), F.coalesce(F.col(label), F.lit("null")))).cast("int")).otherwise(code).alias("labels")
    if make is None:
        d = df.select(key, T.crc_tokens(checked, max_length).alias("input_ids"), number)
    else:
        kind = df.schema[key].dataType.simpleString()

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tokens = make()
            for b in batches:
                ids = [x[:max_length] for x in tokens(b.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), b.column(2)], [key, "input_ids", "labels"])

        d = df.select(key, checked.alias("__text"), number).mapInArrow(work, f"`{key}` {kind}, input_ids array<int>, labels int")
    return d.select(key, "input_ids", attention_mask(F.col("input_ids")).alias("attention_mask"), "labels")


def fingerprint(df: DataFrame, key: str, text: str, settings: Mapping[str, Any]) -> str:
    """SHA-256 of the settings and of the rows: their number and a sum of hashes of key and text, so no row is collected."""
    r = df.agg(F.count("*").alias("n"), F.sum(F.xxhash64(key, text).cast("decimal(38,0)")).alias("h")).first()
    return hashlib.sha256(json.dumps({**settings, "rows": r.n, "content": str(r.h)}, sort_keys=True, default=str).encode()).hexdigest()


def cached_tokens(df: DataFrame, folder: str, split: str, key: str, codes: Mapping[str, int], max_length: int = 256, make: Callable[[], Tokenizer] | None = None, tokenizer: str = "crc", text: str = "text", label: str = "canonical_label") -> DataFrame:
    """The token table of a split, written once below `folder` under its fingerprint and read again by later calls with the same rows and settings."""
    settings = {"split": split, "tokenizer": tokenizer, "max_length": max_length, "labels": dict(codes), "padding": "dynamic", "version": 1}
    path = f"{folder.rstrip('/')}/{split}-tokens-{fingerprint(df, key, text, settings)}"
    spark = df.sparkSession
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        tokenized(df, key, codes, max_length, make, text, label).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
