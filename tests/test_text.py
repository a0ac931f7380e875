import hashlib
import re

import pytest
from pyspark.sql import functions as F

from issuequarry.functions import text as T

CASES = [None, "", " \t", "a b", "a\u001cb", "Straße", "STRASSE", "İX", "line1\nline2", "　x  y "]


def test_clean_and_hash_match_python(spark):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(CASES)], "i int, x string")
    got = {r.i: (r.c, r.h) for r in df.select("i", T.clean_text(F.col("x")).alias("c"), T.text_hash(F.col("x")).alias("h")).collect()}
    for i, x in enumerate(CASES):
        want = re.sub(r"\s+", " ", x or "").strip()
        assert got[i] == (want, hashlib.sha256(want.casefold().encode()).hexdigest())


def test_label_rules(spark):
    raw = ["Bug", "bug,regression", "not a bug", "bugs", "debug", "docker", "feature question", None]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(raw)], "i int, x string")
    got = [r[0] for r in df.orderBy("i").select(T.canonical_label(F.col("x"))).collect()]
    assert got == ["BUG", "BUG", "BUG", None, None, "DOCUMENTATION", "ENHANCEMENT", None]


def test_routing(spark):
    df = spark.createDataFrame([("QUESTION", None, None), ("BUG", "BOH", None), ("BUG", "MAN", "NAM")], "a string, b string, c string")
    assert [r[0] for r in df.select(T.route(F.col("a"), F.col("b"), F.col("c"))).collect()] == ["QUESTION", "BOH", "NAM"]
    with pytest.raises(Exception, match="illegal stage 2"):
        spark.createDataFrame([("BUG", "X", None)], "a string, b string, c string").select(T.route(F.col("a"), F.col("b"), F.col("c"))).collect()


def test_abstention_and_argmax(spark):
    df = spark.createDataFrame([("A", [0.2, 0.8]), ("B", [0.5, 0.5])], "l string, p array<double>")
    r = df.select(T.abstain(F.col("l"), F.col("p"), 0.7), T.argmax_label(F.col("p"), ["X", "Y"])).collect()
    assert [tuple(x) for x in r] == [("A", "Y"), ("ABSTAIN", "X")]
    with pytest.raises(ValueError):
        T.abstain(F.col("l"), F.col("p"), 1.0)


def test_crc_tokens(spark):
    import zlib

    row = spark.createDataFrame([("crash  now",)], "t string").select(T.crc_tokens(F.col("t"), 8)).first()[0]
    assert row == [1, 3 + zlib.crc32(b"crash") % 30000, 3 + zlib.crc32(b"now") % 30000, 2]
