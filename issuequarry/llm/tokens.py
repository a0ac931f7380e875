"""Token counts: longest runs of letters, digits and underscores, or of other characters that aren't white space."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def word_tokens() -> Callable[[str], int]:
    find = re.compile(r"\w+|[^\w\s]+").findall
    return lambda t: len(find(t))


def vocabulary_tokens(path: str) -> Callable[[], Callable[[str], int]]:
    """Counts by a public tokenizer file (JSON); path must be readable on the executors."""

    def make() -> Callable[[str], int]:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda x: len(t.encode(x, add_special_tokens=False).ids)

    return make


def token_counts(df: DataFrame, key: str, text: str, keep: list | None = None, make: Callable[[], Callable[[str], int]] = word_tokens) -> DataFrame:
    """key, the kept columns (names or aliased columns) and tokens; a null text has 0."""
    rows = df.select(key, *(keep or []), F.col(text).cast("string").alias("__text"))
    names = [f.name for f in rows.schema[:-1]] + ["tokens"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = make()
        for b in batches:
            n = pa.array([count(t) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names)

    return rows.mapInArrow(work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", tokens bigint")
