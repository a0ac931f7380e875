"""Texts that look the same (problem 4): corpus n-gram scores, the consistent form of columns, and pairs stored differently.

Nulls: a null text has the form '' where pairs are looked for (a null body is an empty body), and stays null in the table of
forms. Empty texts keep ''. Repeated rows each count. Extra columns pass through by name and can't clash: the work is done on
fixed positions.
"""

from __future__ import annotations

import math
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuequarry.llm.textform import LOOKALIKES, ConsistentForm, count_bigrams, script_of
from issuequarry.session import Scratch

APART = "αι"  # confusable by the table, but a reader sees another shape, or a lost dot


def confusable_letters(spark: SparkSession) -> dict[str, str]:
    """Look-alike letters of Latin, Cyrillic, Greek, Armenian, Coptic, Cherokee and Lisu beyond LOOKALIKES, from the confusables of the Unicode Consortium as Spark's own ICU has them.

    Letters of one skeleton, case and a single character are one class, with at most one member a script (two letters of one script are never the same to a reader). A small
    Greek or Cyrillic letter must agree with its class in capitals too, since the table is generous there (a small ghe for an r). Classes without a Latin member are named by their first.
    """
    letters = [chr(c) for c in range(0x41, 0x1_0000) if script_of(chr(c)) and unicodedata.category(chr(c)) in ("Lu", "Ll", "Lo") and not unicodedata.decomposition(chr(c))]
    bone = dict(zip(letters, spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build().getSkeleton("\n".join(letters)).split("\n"), strict=True))
    known = {m for first, others in LOOKALIKES.items() for m in first + others}
    by: dict[tuple[str, bool], list[str]] = defaultdict(list)
    for c in letters:
        if len(bone[c]) == 1 and c not in APART and (script_of(c) != "L" or ord(c) < 0x80):
            by[bone[c], unicodedata.category(c) == "Ll"].append(c)
    out: dict[str, str] = {}
    for cs in by.values():
        cs.sort(key=lambda c: ("LCGAKHS".index(script_of(c)), ord(c)))
        first = next((c for c in cs if c in LOOKALIKES), cs[0])
        scripts = {script_of(m) for m in LOOKALIKES.get(first, "")} | {script_of(first)}
        for c in cs:
            small = unicodedata.category(c) == "Ll" and script_of(c) in "CG"
            if c in known or script_of(c) in scripts or small and bone.get(c.upper()) != bone.get(first.upper()):
                continue
            scripts.add(script_of(c))
            out[first] = out.get(first, "") + c
    return out


def bigram_scores(df: DataFrame, columns: list[str]) -> dict[str, float]:
    """Log shares of letter pairs within each script over all rows of the columns; pairs never seen share the score `other`.

    The partial counts of a task are one dictionary, bounded by the letters of four alphabets squared, and so is the result that the
    driver gets (letters of seven scripts only, some hundreds).
    """

    more = confusable_letters(df.sparkSession)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, counts = ConsistentForm(None, more), {}
        for b in batches:
            for i in range(b.num_columns):
                count_bigrams(b.column(i).to_pylist(), form, counts)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["pair", "n"])

    rows = (
        df.select(*[F.col(c).cast("string").alias(f"c{i}") for i, c in enumerate(columns)])
        .mapInArrow(partial, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()
    )
    total: dict[str, int] = {}
    for r in rows:
        total[script_of(r.pair[0])] = total.get(script_of(r.pair[0]), 0) + r.n
    scores = {r.pair: math.log(r.n / total[script_of(r.pair[0])]) / 4 for r in rows}
    scores["other"] = -4.0
    return scores


def consistent_columns(df: DataFrame, columns: list[str], key: str, scores: dict[str, float] | None = None) -> DataFrame:
    """key and, for each column, <column>_form. Null stays null."""
    form = ConsistentForm(scores, confusable_letters(df.sparkSession))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [b.column(0)] + [pa.array([None if t is None else form(t) for t in b.column(i).to_pylist()], pa.string()) for i in range(1, b.num_columns)]
            yield pa.RecordBatch.from_arrays(out, names)

    names = [key] + [f"{c}_form" for c in columns]
    kind = df.schema[key].dataType.simpleString()
    schema = ", ".join([f"`{key}` {kind}"] + [f"`{n}` string" for n in names[1:]])
    return df.select(key, *[F.col(c).cast("string") for c in columns]).mapInArrow(work, schema)


def _halves(x: bytes) -> tuple[int, int]:
    return int.from_bytes(x[:8], "little", signed=True), int.from_bytes(x[8:], "little", signed=True)


def same_look_keys(df: DataFrame, columns: list[str], key: str, scores: dict[str, float] | None = None) -> DataFrame:
    """row_id, 128-bit hashes of the consistent forms (f1, f2) and of the stored texts (s1, s2) of the columns together."""
    form = ConsistentForm(scores, confusable_letters(df.sparkSession))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(1, b.num_columns)]
            f1, f2, s1, s2 = [], [], [], []
            for texts in zip(*cols, strict=True):
                stored = "\x00".join(t or "" for t in texts)
                seen = "\x00".join(form(t or "") for t in texts)
                a, c = _halves(xxhash.xxh3_128_digest(seen.encode("utf-8", "surrogatepass")))
                d, e = (a, c) if seen == stored else _halves(xxhash.xxh3_128_digest(stored.encode("utf-8", "surrogatepass")))
                f1.append(a), f2.append(c), s1.append(d), s2.append(e)
            yield pa.RecordBatch.from_arrays([b.column(0)] + [pa.array(x, pa.int64()) for x in (f1, f2, s1, s2)], ["row_id", "f1", "f2", "s1", "s2"])

    return df.select(F.col(key).cast("bigint").alias("row_id"), *[F.col(c).cast("string") for c in columns]).mapInArrow(
        work, "row_id bigint, f1 bigint, f2 bigint, s1 bigint, s2 bigint"
    )


def mixed_forms(keys: DataFrame) -> DataFrame:
    """Keys of the forms that are stored in more than one way."""
    mixed = (
        keys.groupBy("f1", "f2")
        .agg(F.min("s1").alias("lo"), F.max("s1").alias("hi"), F.min("s2").alias("lo2"), F.max("s2").alias("hi2"))
        .filter((F.col("lo") != F.col("hi")) | (F.col("lo2") != F.col("hi2"))).select("f1", "f2")
    )
    return keys.join(mixed, ["f1", "f2"], "left_semi")


def same_look_groups(keys: DataFrame) -> DataFrame:
    """(group_id, row_id, variant_id) of the rows whose form is stored in more than one way: the least row of the form, and the least row stored in the same way. One row a row, however many look the same."""
    kept = Scratch(keys.sparkSession, "lookalike").keep(mixed_forms(keys))
    group = kept.groupBy("f1", "f2").agg(F.min("row_id").alias("group_id"))
    variant = kept.groupBy("f1", "f2", "s1", "s2").agg(F.min("row_id").alias("variant_id"))
    return kept.join(variant, ["f1", "f2", "s1", "s2"]).join(group, ["f1", "f2"]).select("group_id", "row_id", "variant_id")


def same_look_pairs(keys: DataFrame) -> DataFrame:
    """row_id_a < row_id_b of equal form and different stored text. Forms stored in one way only are dropped before the join."""
    kept = mixed_forms(Scratch(keys.sparkSession, "lookalike").keep(keys))
    a, b = kept.alias("a"), kept.alias("b")
    same = (F.col("a.f1") == F.col("b.f1")) & (F.col("a.f2") == F.col("b.f2"))
    differ = (F.col("a.s1") != F.col("b.s1")) | (F.col("a.s2") != F.col("b.s2"))
    return a.join(b, same & differ & (F.col("a.row_id") < F.col("b.row_id"))).select(F.col("a.row_id").alias("row_id_a"), F.col("b.row_id").alias("row_id_b"))
