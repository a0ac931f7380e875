import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuequarry import cli, monitor
from issuequarry.operators import data as D
from issuequarry.operators import metrics as M
from issuequarry.operators import sampling as S
from issuequarry.operators import tfidf as X
from issuequarry.operators import tokens as K
from issuequarry.plans import models, training

WORDS = {"BUG": "crash error trace fails broken", "QUESTION": "how can where what why", "DOCUMENTATION": "readme guide page typo chapter"}


def issues(spark, n=90, first=0):
    r = random.Random(n)
    labels = sorted(WORDS)
    rows = [(first + i, f"i{first + i}", " ".join(r.choice(WORDS[labels[i % 3]].split()) for _ in range(8)) + f" w{i % 7}", labels[i % 3], f"p{i % 6}") for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, issue_id string, text string, canonical_label string, project string")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("data")
    issues(spark).write.parquet(f"{d}/train_clean.parquet")
    issues(spark, 30, 1000).write.parquet(f"{d}/validation_clean.parquet")
    return d


def test_settings_by_their_file_names():
    c = models.resolved_config({"feature_mode": "word", "word_max_df": 0.5, "char_max_df": 9, "sublinear_tf": False, "word_ngram_range": [1, 3], "training_rows": 5, "other": 1})
    assert c["feature_mode"] == "word" and c["word_max_df"] == 0.5 and c["char_max_df"] == 9 and c["sublinear_tf"] is False and c["word_ngram_range"] == (1, 3)
    assert (c["classifier_max_iter"], c["class_weight"], c["seed"], c["training_rows"]) == (5000, "balanced", 42, 5) and "other" not in c
    assert X.TfidfConfig.from_mapping(None) == X.TfidfConfig()
    for bad in ({"word_max_features": 0}, {"feature_mode": "char"}, {"word_ngram_range": [2, 1]}):
        with pytest.raises(ValueError):
            X.TfidfConfig.from_mapping(bad)


def test_plain_counts_and_df_bounds(spark):
    df = spark.createDataFrame([(1, "aa aa bb"), (2, "aa cc"), (3, "aa dd")], "k long, t string")
    c = X.TfidfConfig(feature_mode="word", word_ngram_range=(1, 1), word_min_df=1, word_max_df=2, sublinear_tf=False)
    assert {r.term for r in X.tfidf(df, "k", "t", c).collect()} == {"bb", "cc", "dd"}
    c = X.TfidfConfig(feature_mode="word", word_ngram_range=(1, 1), word_min_df=0.9, word_max_df=1.0, sublinear_tf=False)
    assert {(r.k, r.term, r.weight) for r in X.tfidf(df, "k", "t", c).collect()} == {(i, "aa", 1.0) for i in (1, 2, 3)}
    with pytest.raises(TypeError):
        X.matrix_bytes(df, "k")


def test_short_words_are_one_gram(spark):
    got = {(r.term, r.tf) for r in X.char_counts(spark.createDataFrame([(1, "a bc")], "k long, t string"), "k", "t").collect()}
    assert got == {(" a ", 1), (" bc", 1), ("bc ", 1), (" bc ", 1)}


def test_linear_run(spark, folder, tmp_path):
    (tmp_path / "c.yaml").write_text("feature_mode: word_char\nword_min_df: 1\nchar_min_df: 1\nword_max_features: 200\nchar_max_features: 300\nclassifier_max_iter: 30\nseed: 7\n")
    args = ["train-tfidf", "--data-dir", str(folder), "--output-dir", str(tmp_path / "o"), "--config", str(tmp_path / "c.yaml"), "--max-train-samples", "60"]
    got = cli.run(cli.parser().parse_args(args), spark)
    assert got["accuracy"] > 0.9 and got["labels"] == sorted(WORDS) and sum(map(sum, got["confusion_matrix"])) == 30
    c = json.loads((tmp_path / "o" / "training_config.json").read_text())
    assert (c["training_rows"], c["source_training_rows"], c["training_class_counts"], c["seed"]) == (60, 90, dict.fromkeys(sorted(WORDS), 20), 7)
    again = cli.run(cli.parser().parse_args(["evaluate-stage1", "--model-path", str(tmp_path / "o" / "model"), "--test", str(folder / "validation_clean.parquet"), "--output-dir", str(tmp_path / "e")]), spark)
    assert again["confusion_matrix"] == got["confusion_matrix"] and json.loads((tmp_path / "e" / "metrics.json").read_text())["accuracy"] == got["accuracy"]
    with pytest.raises(ValueError, match="whole validation"):
        cli.run(cli.parser().parse_args([*args, "--max-eval-samples", "5"]), spark)
    with pytest.raises(FileNotFoundError):
        models.LinearTextModel.load(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="blank"):
        models.fit_linear(spark.createDataFrame([(" ", "BUG")], "text string, canonical_label string"))


def test_vectors_equal_the_long_form(spark):
    d = issues(spark, 12)
    values = {"word_min_df": 1, "char_min_df": 1, "classifier_max_iter": 1, "word_max_df": 1.0, "char_max_df": 1.0}
    m = models.fit_linear(d, values=values)
    from issuequarry.session import Scratch

    got = {r["__key"]: r.features for r in m.vectors(d.select(F.col("row_id").alias("__key"), "text"), "text", Scratch(spark, "t")).collect()}
    idx = {(r.block, r.term): r.idx for r in m.vocabulary.collect()}
    want = X.tfidf(d.select("row_id", "text"), "row_id", "text", X.TfidfConfig.from_mapping(m.config)).collect()
    assert all(abs(got[r.row_id][idx[r.block, r.term]] - r.weight) < 1e-9 for r in want)
    assert sum(v.numNonzeros() for v in got.values()) == len(want) and {v.size for v in got.values()} == {len(idx)}


def test_stage_runs(spark, folder, tmp_path):
    def fit(inputs, config):
        t = inputs["train"].first()
        assert t.input_ids[0] == 1 and len(t.input_ids) == len(t.attention_mask) and config.max_steps == 3
        n = len(inputs["labels"])
        return inputs["validation"].select("row_id", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i == F.col("labels"), 0.9).otherwise(0.1)).alias("scores"))

    got = training.run_stage(spark, "stage1", str(tmp_path / "o"), data_dir=str(folder), max_train_samples=45, max_steps=3, fit=fit)
    assert got["accuracy"] == 1.0 and "text" not in spark.read.parquet(str(tmp_path / "o" / "validation_predictions.parquet")).columns
    assert json.loads((tmp_path / "o" / "training_config.json").read_text())["model_name"] == training.BASE_MODELS["stage1"]
    bugs = issues(spark).withColumn("canonical_label", F.element_at(F.array(*map(F.lit, ("BOH", "ARB", "NAM"))), (F.col("row_id") % 3 + 1).cast("int")))
    for x in ("train_clean", "validation_clean"):
        bugs.write.parquet(f"{tmp_path}/bugs/{x}.parquet")
    seen = {}
    for stage, labels in (("stage2", ["BOH", "MAN"]), ("stage3", ["ARB", "NAM"])):
        training.run_stage(spark, stage, str(tmp_path / stage), data_dir=str(tmp_path / "bugs"), max_steps=3, fit=lambda i, c, s=stage: seen.setdefault(s, i) and fit(i, c))
        assert seen[stage]["labels"] == labels and "text" in spark.read.parquet(str(tmp_path / stage / "validation_predictions.parquet")).columns
    assert training.balanced_weights(["A", "B"], {"A": 1, "B": 3}) == [2.0, 4 / 6]
    with pytest.raises(ValueError, match="whole validation"):
        training.run_stage(spark, "stage1", str(tmp_path / "x"), data_dir=str(folder), max_eval_samples=1)
    with pytest.raises(ValueError, match="lacks"):
        training.transformer_inputs(issues(spark).filter("canonical_label = 'BUG'"), issues(spark), training.TransformerConfig.of("stage1"), str(tmp_path / "c"))
    with pytest.raises(TypeError):
        training.load_inputs(spark, str(folder), issues(spark))
    with pytest.raises(ValueError):
        training.TransformerConfig.of("stage2", {"tokenization_batch_size": 0})
    with pytest.raises(ImportError, match="no_such_package"):
        training.library("no_such_package", "this")


def test_pretraining(spark, folder, tmp_path):
    m = training.run_pretraining(spark, str(folder / "train_clean.parquet"), str(tmp_path / "p"))
    assert (m["train_rows"], m["validation_rows"]) == (81, 9)
    assert spark.read.parquet(str(tmp_path / "p" / "train-tokens.parquet")).select(F.size("input_ids").alias("n")).distinct().collect()[0].n == 256
    held = spark.createDataFrame([("p0",), (None,)], "project string")
    a, b, m = training.pretraining_corpus(issues(spark), held, strict=True)
    assert a.unionAll(b).filter("project = 'p0'").isEmpty() and m["excluded_projects"] == ["p0"] and m["train_rows"] + m["validation_rows"] == 75
    with pytest.raises(ValueError):
        training.pretraining_corpus(issues(spark), strict=True)
    with pytest.raises(ValueError, match="held out"):
        training.pretraining_corpus(issues(spark).filter("project = 'p0'"), held, strict=True)


def test_token_tables(spark, tmp_path):
    d = issues(spark, 12)
    codes = K.label_codes(d)
    assert codes == {x: i for i, x in enumerate(sorted(WORDS))}
    a = K.cached_tokens(d, str(tmp_path), "train", "row_id", codes, 6)
    b = K.cached_tokens(d, str(tmp_path), "train", "row_id", codes, 6)
    assert len(list(tmp_path.iterdir())) == 1 and sorted(a.collect()) == sorted(b.collect())
    K.cached_tokens(d.limit(5), str(tmp_path), "train", "row_id", codes, 6)
    assert len(list(tmp_path.iterdir())) == 2
    own = K.tokenized(d, "row_id", codes, 6, lambda: lambda texts: [list(range(len(t.split()))) for t in texts])
    assert {len(r.input_ids) for r in own.collect()} == {6}
    wide = K.dynamic_padding(K.tokenized(d.withColumn("text", F.expr("CASE WHEN row_id = 3 THEN 'x' ELSE text END")), "row_id", codes, 9), F.floor(F.col("row_id") / 4))
    assert {(len(r.input_ids), len(r.attention_mask)) for r in wide.select("input_ids", "attention_mask").collect()} == {(9, 9)} if "attention_mask" not in wide.columns[:-1] else True
    full = K.padded_to_max(d.select("row_id", "text"), max_length=1).first()
    assert len(full.input_ids) == len(full.attention_mask) == 1
    for bad in (d.withColumn("text", F.lit(" ")), d.withColumn("canonical_label", F.lit("NEW"))):
        with pytest.raises(Exception, match="blank text|no code"):
            K.tokenized(bad, "row_id", codes).collect()
    with pytest.raises(ValueError):
        K.padded_to_max(d, max_length=0)
    assert D.first_seen_codes(d).orderBy("code").first().canonical_label == sorted(WORDS)[0]


def test_splits_lose_no_row(spark):
    rows = spark.createDataFrame([(i, None if i < 10 else "A" if i < 60 else "B") for i in range(100)], "row_id long, canonical_label string")
    d, _ = S.make_validation_split(rows, 0.25)
    assert d.count() == 100 and {r.canonical_label: r.n for r in d.filter("split = 'validation'").groupBy("canonical_label").agg(F.count("*").alias("n")).collect()} in ({None: 3, "A": 12, "B": 10}, {None: 2, "A": 13, "B": 10}, {None: 3, "A": 13, "B": 9})
    lone = rows.withColumn("canonical_label", F.expr("CASE WHEN row_id = 5 THEN 'ONE' ELSE 'A' END"))
    d, _ = S.make_validation_split(lone, 0.25)
    assert d.filter("split = 'validation'").count() == 25
    twice = rows.withColumn("issue_id", F.expr("string(row_id div 2)"))
    with pytest.raises(ValueError, match="repeat"):
        S.make_validation_split(twice, 0.25, issue="issue_id")
    with pytest.raises(ValueError, match="missing"):
        S.make_validation_split(rows.drop("canonical_label"), 0.25)
    assert S.stratified_limit(rows, None).count() == 100 and S.stratified_limit(rows, 20).filter("canonical_label IS NULL").count() == 2


def test_persisted_selection(spark, tmp_path):
    rows = spark.createDataFrame([(i, "A" if i % 5 else "B") for i in range(100)], "row_id long, canonical_label string")
    one = S.persisted_limit(rows, 30, str(tmp_path), "a b/c")
    two = S.persisted_limit(rows.repartition(3), 30, str(tmp_path), "a b/c")
    assert sorted(one.collect()) == sorted(two.collect()) and one.count() == 30
    assert len(list(tmp_path.iterdir())) == 1 and list(tmp_path.iterdir())[0].name.startswith("a-b-c-n30-seed42-")
    assert S.persisted_limit(rows, 500, str(tmp_path), "x").count() == 100
    with pytest.raises(ValueError, match="blank"):
        S.persisted_limit(rows.withColumn("canonical_label", F.expr("CASE WHEN row_id = 3 THEN ' ' ELSE 'A' END")), 30, str(tmp_path), "x")


def test_folds_equal_greedy_dealing(spark):
    r = random.Random(5)
    sizes = [r.choice([1, 1, 1, 2, 3, 5, 8, 40]) for _ in range(60)]
    df = spark.createDataFrame([(f"g{i}",) for i, n in enumerate(sizes) for _ in range(n)] + [(None,)], "project string")
    got = S.group_folds(df, 4).collect()
    import hashlib

    loads, want = [0] * 4, {}
    for n, _, g in sorted((-n, hashlib.md5(f"g{i}".encode()).hexdigest(), f"g{i}") for i, n in enumerate(sizes)):
        f = loads.index(min(loads))
        want[g], loads[f] = f, loads[f] - n
    assert {x.project: x.fold for x in got} == want
    parts = list(S.cross_validation(df, 4))
    assert sum(v.count() for _, v in parts) == sum(sizes) and all(a.join(v, "project", "left_semi").isEmpty() for a, v in parts)


def test_metrics_report_and_errors(spark):
    df = spark.createDataFrame([("A", "A"), ("B", "A"), ("B", "B")], "t string, p string")
    m = M.classification_metrics(df, "t", "p")
    assert m["labels"] == ["A", "B"] and m["confusion_matrix"] == [[1, 0], [1, 1]] and m["per_class"]["accuracy"]["f1"] == pytest.approx(2 / 3) and m["per_class"]["macro avg"]["recall"] == 0.75
    for bad in (df.limit(0), df.withColumn("p", F.lit(None).cast("string")), df.drop("p")):
        with pytest.raises(ValueError):
            M.classification_metrics(bad, "t", "p")
    assert {r.metric for r in M.training_metrics(M.confusion(df, "t", "p")).collect()} == {"macro_f1", "micro_f1", "weighted_f1", "mcc"}


def test_audit_sees_the_matrix_once(spark):
    w, seen = models.audited(spark.createDataFrame([(1, "a", 0.5), (1, "b", 0.25)], "k long, term string, weight double"))
    assert w.count() == 2 and seen.get["nnz"] == 2 and seen.get["bytes"] == 16
    m = models.MatrixAudit("again")
    assert m.transform(w.select("k", "term", "weight")).count() == 2 and m.figures()["nnz"] == 2


def test_monitor(spark, folder, caplog):
    a, b = (monitor.token_benchmark(spark, str(folder / "train_clean.parquet"), m, 8) for m in ("native", "python"))
    assert a["tokens"] == b["tokens"] == 90 * 8 and a["rows"] == 90
    assert monitor.memory()["rss"] > 0 and monitor.log_memory("x", rows=3)["rows"] == 3
    assert monitor.versions()["pyspark"] != "unavailable" and training.version_of("no-such-package") == "unavailable"
    assert cli.main(["version"]) == 0


def test_machines_are_at_the_optimum_of_squared_hinge(spark):
    """The gradient by hand, from the long form, is nearly nothing; every machine is fitted in the same passes."""
    d = spark.createDataFrame([(i, f"{('crash', 'please add', 'how')[i % 3]} w{i % 5} w{i % 7} thing", ("BUG", "ENHANCEMENT", "QUESTION")[i % 3 if i % 10 else 0]) for i in range(40)], "row_id long, text string, canonical_label string")
    m = models.fit_linear(d, values={"word_min_df": 1, "char_min_df": 1, "word_max_df": 1.0, "char_max_df": 1.0})
    rows, place = d.collect(), {(r.block, r.term): (r.idx, r.idf) for r in m.vocabulary.collect()}
    x = np.zeros((len(rows), len(place) + 1))
    x[:, -1] = 1
    for r in X.tfidf(d.select("row_id", "text"), "row_id", "text", X.TfidfConfig.from_mapping(m.config)).collect():
        x[r.row_id, place[r.block, r.term][0]] = r.weight
    by = np.append([v for _, v in sorted(place.values())], 1.0)
    count = {label: sum(r.canonical_label == label for r in rows) for label in m.labels}
    cost = np.array([len(rows) / (3 * count[r.canonical_label]) for r in rows])
    for label, w in zip(m.labels, m.svm / by, strict=True):
        y = np.array([1.0 if r.canonical_label == label else -1.0 for r in rows])
        g = lambda w, y=y: w - 2 * x.T @ (cost * y * np.maximum(0, 1 - y * (x @ w)))
        assert np.linalg.norm(g(w)) <= 1.01e-3 * np.linalg.norm(g(0 * w))
    best = [m.labels[i] for i in (x @ (m.svm / by).T).argmax(1)]
    assert {r.row_id: r.prediction for r in m.predict(d).collect()} == dict(enumerate(best))


def test_machines_need_few_passes_and_keep_the_optimum(spark, monkeypatch):
    """Bits of frequent terms, entries left by them and terms used more than DEEP times; the preconditioner changes the passes, not the machines."""
    from issuequarry.plans import linear as L

    r = random.Random(5)
    rows = [(i, " ".join(r.choice(("crash", "please add", "how", "the page")) for _ in range(r.choice((3, 9, 30)))) + f" w{r.randrange(9)} x{r.randrange(60)} z" + "z" * (i % 4), ("BUG", "ENHANCEMENT", "QUESTION")[i % 3 if i % 10 else 0]) for i in range(200)]
    d = spark.createDataFrame(rows, "row_id long, text string, canonical_label string")
    monkeypatch.setattr(L, "OFTEN", 0.3)
    real, passes, got = L.lbfgs, {}, {}

    def counted(x, steps, pre=None):
        fit = real(x, steps, tol=1e-5, pre=pre if name == "with" else None)
        out = next(fit)
        while True:
            answer = yield out
            passes[name] = passes.get(name, 0) + 1
            try:
                out = fit.send(answer)
            except StopIteration as end:
                return end.value

    monkeypatch.setattr(L, "lbfgs", counted)
    for name in ("with", "without"):
        got[name] = models.fit_linear(d, values={"word_min_df": 1, "char_min_df": 1, "word_max_df": 1.0, "char_max_df": 1.0})
    assert passes["with"] < 0.7 * passes["without"], passes
    m, place = got["with"], {(r.block, r.term): (r.idx, r.idf) for r in got["with"].vocabulary.collect()}
    x = np.zeros((len(rows), len(place) + 1))
    x[:, -1] = 1
    for r in X.tfidf(d.select("row_id", "text"), "row_id", "text", X.TfidfConfig.from_mapping(m.config)).collect():
        x[r.row_id, place[r.block, r.term][0]] = r.weight
    by = np.append([v for _, v in sorted(place.values())], 1.0)
    for label, w, v in zip(m.labels, m.svm / by, got["without"].svm / by, strict=True):
        y = np.array([1.0 if r[2] == label else -1.0 for r in rows])
        cost = np.array([len(rows) / (3 * sum(q[2] == r[2] for q in rows)) for r in rows])
        g = lambda w, y=y, cost=cost: w - 2 * x.T @ (cost * y * np.maximum(0, 1 - y * (x @ w)))
        assert np.linalg.norm(g(w)) <= 1e-4 * np.linalg.norm(g(0 * w)) and np.abs(w - v).max() < 0.01 * np.abs(v).max()
