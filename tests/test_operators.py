import math
from collections import Counter
from itertools import groupby, pairwise

import pytest
from pyspark.sql import functions as F

from issuequarry.operators import data as D
from issuequarry.operators import metrics as M
from issuequarry.operators import sampling as S
from issuequarry.operators import tfidf as X
from issuequarry.queries import QUERIES as Q


def test_dedup_overlap_and_leakage(spark):
    train = spark.createDataFrame([(1, "a", "1"), (2, "a", "2"), (3, "b", "3"), (9, None, "9")], "row_id long, text_hash string, issue_id string")
    test = spark.createDataFrame([(4, "a"), (5, "c")], "row_id long, text_hash string")
    assert sorted(r.row_id for r in D.keep_first(train).collect()) == [1, 3, 9]
    assert [r.row_id for r in D.overlap(train, test).collect()] == [4]
    assert sorted(r.row_id for r in D.without_overlap(train, test).collect()) == [3, 9]


def test_colliding_ids_are_made_unique(spark):
    df = spark.createDataFrame([("7", "a" * 64), ("7", "b" * 64)], "issue_id string, text_hash string")
    out = D.unique_ids(df).collect()
    assert {r.source_issue_id for r in out} == {"7"} and len({r.issue_id for r in out}) == 2
    assert D.shared_ids(df).first().affected == 2
    assert {r.issue_id for r in D.unique_ids(df.limit(1)).collect()} == {"7"}


def test_postconditions(spark):
    df = spark.createDataFrame([("1", "a"), ("1", "b"), ("2", "c")], "issue_id string, text_hash string")
    with pytest.raises(ValueError, match="'1'"):
        D.checked_unique(df)
    assert D.checked_unique(df.filter("text_hash <> 'b'")).count() == 2
    with pytest.raises(RuntimeError, match="text_hash"):
        D.checked_apart(df, df.limit(1))
    assert D.checked_apart(df, df.limit(0)).count() == 3
    with pytest.raises(ValueError, match="no rows"):
        D.not_empty(df.limit(0), "x")
    with pytest.raises(ValueError, match="project"):
        D.stage2_rows(df.withColumnsRenamed({"issue_id": "canonical_label", "text_hash": "text"}))
    assert D.inspected(df.withColumnsRenamed({"issue_id": "canonical_label", "text_hash": "text"}), "x") == {"1": 2, "2": 1}
    for bad in (df.limit(0), df.withColumn("text_hash", F.lit(" ")), df.withColumn("issue_id", F.lit(None).cast("string"))):
        with pytest.raises(ValueError):
            D.inspected(bad.withColumnsRenamed({"issue_id": "canonical_label", "text_hash": "text"}), "x")
    one = D.statistics(spark.createDataFrame([("A", "r", "h"), (None, None, "h"), ("A", "r", None), ("B", "s", None)], "canonical_label string, repository string, text_hash string")).first()
    assert tuple(one) == (4, 3, 2, 2)


def test_misclassified_counts_nulls(spark):
    df = spark.createDataFrame([("A", "A"), (None, None), (None, "A"), ("B", None)], "t string, prediction string")
    assert D.misclassified(df, "t").count() == 3


def test_validation_raises(spark):
    with pytest.raises(ValueError, match="empty"):
        D.validate(spark.createDataFrame([], "text string, canonical_label string"))
    with pytest.raises(ValueError, match="blank"):
        D.validate(spark.createDataFrame([(" \t", "BUG")], "text string, canonical_label string"))
    with pytest.raises(ValueError, match="missing"):
        D.validate(spark.createDataFrame([("x",)], "text string"))


def rows(spark):
    return spark.createDataFrame([(i, "BUG" if i < 80 else "QUESTION", f"r{i % 12}") for i in range(100)], "row_id long, canonical_label string, repository string")


def test_stratified_limit_is_exact_and_stable(spark):
    a = S.stratified_limit(rows(spark), 50)
    assert {r.canonical_label: r["count"] for r in a.groupBy("canonical_label").count().collect()} == {"BUG": 40, "QUESTION": 10}
    assert sorted(r.row_id for r in a.collect()) == sorted(r.row_id for r in S.stratified_limit(rows(spark).repartition(7), 50).collect())
    assert S.stratified_limit(rows(spark), 500).count() == 100
    with pytest.raises(ValueError):
        S.stratified_limit(rows(spark), 0)


def test_splits(spark):
    d, how = S.make_validation_split(rows(spark), 0.25)
    assert how == "repository_grouped" and d.groupBy("repository").agg(F.count_distinct("split").alias("n")).filter("n > 1").isEmpty()
    assert d.filter("split = 'validation'").select("repository").distinct().count() == 3
    d, how = S.make_validation_split(rows(spark).drop("repository"), 0.25)
    assert how == "stratified_no_repository_metadata" and d.filter("split = 'validation'").count() == 25
    assert S.balanced_sample(rows(spark), 60).groupBy("canonical_label").count().agg(F.sum("count")).first()[0] == 50
    folds = S.group_folds(rows(spark).select(F.col("repository").alias("project")), 5)
    assert folds.select("fold").distinct().count() == 5
    with pytest.raises(ValueError):
        S.group_folds(rows(spark).select(F.lit("p").alias("project")), 5)


def test_metrics_edge_cases(spark):
    c = M.confusion(spark.createDataFrame([("BUG", "BUG"), ("QUESTION", "BUG")], "t string, p string"), "t", "p")
    assert {(r.truth, r.prediction): r.n for r in c.collect()} == {("BUG", "BUG"): 1, ("BUG", "QUESTION"): 0, ("QUESTION", "BUG"): 1, ("QUESTION", "QUESTION"): 0}
    m = {r.metric: r.value for r in M.summary(c).collect()}
    assert m["accuracy"] == m["micro_f1"] == 0.5 and m["mcc"] == 0.0 and m["balanced_accuracy"] == 0.5 and abs(m["macro_f1"] - 1 / 3) < 1e-12


def test_tfidf_formula(spark):
    df = spark.createDataFrame([(1, "crash save crash"), (2, "crash load")], "k long, t string")
    got = {(r.k, r.term): r.weight for r in X.tfidf(df, "k", "t", X.TfidfConfig(feature_mode="word", word_ngram_range=(1, 1), word_min_df=1, word_max_df=1.0)).collect()}
    idf = lambda n: math.log(3 / (1 + n)) + 1
    w = {"crash": (1 + math.log(2)) * idf(2), "save": idf(1)}
    norm = math.sqrt(sum(x * x for x in w.values()))
    assert abs(got[1, "crash"] - w["crash"] / norm) < 1e-9 and abs(got[1, "save"] - w["save"] / norm) < 1e-9
    with pytest.raises(ValueError):
        X.TfidfConfig(feature_mode="x")


def whole_text(spark, path, copies, words):
    """Rows of one long text that share no word of their titles, and a short one."""
    text = " ".join(words)
    rows = [(i, f"title {i}", text) for i in range(copies)] + [(copies, "title", words[0] + " other other")]
    spark.createDataFrame(rows, "row_id long, title string, text string").coalesce(2).write.parquet(f"{path}/train_clean.parquet")
    return {r[0]: r[2].split() for r in rows}


def weights_by_hand(grams, rows, min_df, most):
    tf = {k: Counter(g) for k, g in grams.items()}
    df, total = Counter(x for c in tf.values() for x in c), sum(tf.values(), Counter())
    vocab = sorted((x for x, n in df.items() if min_df <= n <= 0.98 * rows), key=lambda x: (-total[x], x))[:most]
    kept = set(vocab)
    w = {(k, x): (1 + math.log(n)) * (math.log((1 + rows) / (1 + df[x])) + 1) for k, c in tf.items() for x, n in c.items() if x in kept}
    norm = Counter()
    for (k, _), x in w.items():
        norm[k] += x * x
    return {x: (df[x], total[x]) for x in vocab}, {(k, x): v / math.sqrt(norm[k]) for (k, x), v in w.items()}


def word_grams(docs):
    return {k: w + [f"{a} {b}" for a, b in pairwise(w)] for k, w in docs.items()}


def close(got, want):
    return got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_word_queries_take_the_whole_text(spark, tmp_path):
    docs = whole_text(spark, tmp_path, 3, [f"w{i}" for i in range(1500)] + ["w7"])
    vocab, want = weights_by_hand(word_grams(docs), 4, 3, 200_000)
    assert len(vocab) > 2000
    assert {r.term: (r.df, r.tf) for r in Q["l05_vocabulary_whole"](spark, str(tmp_path)).collect()} == vocab
    assert close({(r.row_id, r.term): r.weight for r in Q["t02_tfidf_word_whole"](spark, str(tmp_path)).collect()}, want)
    n = len({k for k, _ in want})
    assert tuple(Q["a16_matrix_bytes_whole"](spark, str(tmp_path)).first()) == (n, len(want), len(want) * 8 + (n + 1) * 4)


def test_union_keeps_all_features(spark, tmp_path):
    docs = whole_text(spark, tmp_path, 5, [f"w{i * 7919 % 99991:05d}" for i in range(11_000)])
    edged = {k: [f" {x} " for x in w] for k, w in docs.items()}
    chars = {k: [x[i : i + n] for x in w for n in (3, 4, 5) for i in range(len(x) - n + 1)] for k, w in edged.items()}
    got = {b: {(r.row_id, r.term): r.weight for r in rows} for b, rows in groupby(sorted(Q["t04_tfidf_union"](spark, str(tmp_path)).collect(), key=lambda r: r.block), key=lambda r: r.block)}
    for block, grams, least, most in (("word", word_grams(docs), 3, 200_000), ("char", chars, 5, 150_000)):
        vocab, want = weights_by_hand(grams, 6, least, most)
        assert len(vocab) > 20_000 and close(got[block], want)


def test_plans(spark):
    plan = D.without_overlap(spark.range(9).selectExpr("string(id) AS text_hash"), spark.range(3).selectExpr("string(id) AS text_hash"))._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" in plan


def test_weights_need_no_join_of_terms(spark):
    df = spark.createDataFrame([(1, "crash save crash"), (2, "crash load")], "k long, t string")
    plan = X.tfidf(df, "k", "t", X.TfidfConfig())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan


def test_small_chunks_and_repeated_keys(spark, monkeypatch):
    """A key's rows are counted together, whatever the batches, chunks and terms held are."""
    texts = [(i // 3, " ".join(f"w{i * j % 13}" for j in range(i % 7))) for i in range(60)] + [(None, "w1 w2"), (None, "w1 é"), (99, None)]
    df = spark.createDataFrame(texts, "k long, t string")
    docs, edged = {}, {}
    for k, x in texts:
        w = (x or "").split()
        docs.setdefault(k, []).extend([y for y in w if len(y) > 1] + [f"{a} {b}" for a, b in pairwise([y for y in w if len(y) > 1])])
        edged.setdefault(k, []).extend(g for y in w for n in (3, 4, 5) for g in [f" {y} "[i : i + n] for i in range(len(y) + 3 - n)])
    for key, value in (("CHUNK", 24), ("HELD", 3), ("OUT", 2)):
        monkeypatch.setattr(X, key, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        got = X.tfidf(df, "k", "t", X.TfidfConfig()).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for block, grams, least in (("word", docs, 3), ("char", edged, 5)):
        _, want = weights_by_hand(grams, len(texts), least, 200_000)
        assert want and close({(r.k, r.term): r.weight for r in got if r.block == block}, want)
    assert X.tfidf(df.limit(0), "k", "t", X.TfidfConfig()).count() == 0
