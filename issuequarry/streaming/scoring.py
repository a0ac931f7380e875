"""Streams of issues: harmonised text and labels, deduplicated within a watermark, scored batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from issuequarry.functions import text as T


def clean_stream(stream: DataFrame, at: str = "ingested_at", late: str = "1 day") -> DataFrame:
    """Canonical text, label and hash; a hash is passed once within the watermark."""
    out = stream.withColumns({"title": T.clean_text(F.col("title")), "body": T.clean_text(F.col("body"))}).filter("title <> '' OR body <> ''")
    out = out.withColumn("text", T.issue_text(F.col("title"), F.col("body"))).withColumns({"canonical_label": T.canonical_label(F.col("original_label")), "text_hash": T.text_hash(F.col("text"))})
    return out.withWatermark(at, late).dropDuplicatesWithinWatermark(["text_hash"])


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Starts a query that writes each scored batch once: a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, n: int) -> None:
        score(batch).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
