import random
import unicodedata
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from issuequarry.llm import lookalike, mixing, neardup, overlap, packing, quota_sample, shingles, splits, stuffing
from issuequarry.llm.components import connected_components
from issuequarry.llm.textform import LOOKALIKES, ConsistentForm
from issuequarry.session import Scratch

TEXT = "row_id long, text string"


# --- p4


def test_forms_equal_for_same_look():
    f = ConsistentForm()
    same = [("Minuten", "Μіnutеn"), ("a b", "a b"), ("ab", "a­‍b"), ("é", "é"), ("Ab1", "Ａｂ１"), ("バグ", "ﾊﾞｸﾞ"), ("x\ny", "x\r\ny")]
    for a, b in same:
        assert f(a) == f(b), (a, b)
    for a, b in [("sidebar", "5idebar"), ("über", "uber"), ("A", "a"), ("a b", "a  b"), ("x²", "x2"), ("か", "が"), ("й", "и"), ("l", "1")]:
        assert f(a) != f(b), (a, b)
    assert f("\U0001f469‍\U0001f4bb") == "\U0001f469‍\U0001f4bb" and f("") == ""


def test_form_ignores_which_member_is_stored():
    f, r = ConsistentForm(), random.Random(1)
    for text in ("Окно не открывается после сохранения copy", "The scope of a pipe is here", "νον", "сор"):
        for _ in range(20):
            t = "".join(r.choice([c, *LOOKALIKES.get(c, "")]) for c in f.classes(text))
            assert f(t) == f(text)
    assert unicodedata.name(f("Окно не открывается")[0]).startswith("CYRILLIC")


def test_letters_of_further_scripts(spark):
    more = lookalike.confusable_letters(spark)
    f = ConsistentForm(None, more)
    for a, b in [("Г", "Γ"), ("П", "Π"), ("Ф", "Φ"), ("Ⅳ", "IV"), ("ꓮꓐ", "AB"), ("Ꭺ", "A"), ("ո", "n"), ("\u2c9f", "o")]:
        assert f(a) == f(b), (a, b)
    for a, b in [("г", "r"), ("σ", "o"), ("α", "a"), ("ι", "i"), ("l", "I"), ("O", "0"), ("rn", "m"), ("σ", "ο"), ("п", "n")]:
        assert f(a) != f(b), (a, b)
    for text in ("ᎠᏂᏴᏫᏯ ᏣᎳᎩ", "Γραφή και ήχος", "Графика и звук", "ꓡꓲ-ꓢꓴ ꓐꓯ", "հայերեն գիր"):  # whole words of one script stay in it
        assert f(text) == unicodedata.normalize("NFC", text), (text, f(text))
        assert f(unicodedata.normalize("NFD", text)) == f(text)
    for text in ("строку в cursor.yaml снова", "Gali_benchmark снова пропускает строку", "FIGA и слово"):  # rare letters are never written
        assert f(text) == ConsistentForm()(text), (f(text), ConsistentForm()(text))
    every = [x + c for c, o in {**LOOKALIKES, **more}.items() for x in o]
    assert all(f(x[0]) == f(x[1]) for x in every)


def test_groups_of_one_look(spark):
    rows = [(i, "" if i % 2 else "\u200b", None) for i in range(300)] + [(900, "a", ""), (901, "a", "")]
    df = spark.createDataFrame(rows, "row_id long, title string, body string")
    got = lookalike.same_look_groups(lookalike.same_look_keys(df, ["title", "body"], "row_id")).collect()
    assert sorted((r.group_id, r.row_id, r.variant_id) for r in got) == [(0, i, i % 2) for i in range(300)]


def test_same_look_pairs(spark):
    rows = [(1, "ab", None), (2, "a​b", ""), (3, "ab", ""), (4, "AB", ""), (5, None, None), (5, None, None)]
    df = spark.createDataFrame(rows, "row_id long, title string, body string").withColumn("f1", F.lit(0))
    keys = lookalike.same_look_keys(df, ["title", "body"], "row_id", lookalike.bigram_scores(df, ["title", "body"]))
    assert sorted(map(tuple, lookalike.same_look_pairs(keys).collect())) == [(1, 2), (2, 3)]
    assert lookalike.same_look_pairs(lookalike.same_look_keys(df.limit(0), ["title", "body"], "row_id")).count() == 0
    forms = lookalike.consistent_columns(df, ["title"], "row_id").collect()
    assert [r.title_form for r in forms if r.row_id == 5] == [None, None]


# --- p3 and p5


def corpus(seed=3, n=120):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefgh") + str(r.randrange(60))
    out = []
    for i in range(n):
        w = [word() for _ in range(r.randrange(12, 60))]
        out.append(" ".join(w))
        for _ in range(r.randrange(3)):
            v = list(w)
            for _ in range(r.randrange(4)):
                v[r.randrange(len(v))] = word()
            cut = r.randrange(len(v))
            out.append(" ".join(v[cut:] + v[:cut]) if r.random() < 0.3 else " ".join(v))
    return [*out, "", None, "x", "x", out[0], out[0].upper(), "common boiler plate text of many words here " * 3 + "tail one", "common boiler plate text of many words here " * 3 + "tail two"]


def sets(texts, w=3):
    import re

    out = []
    for t in texts:
        x = re.findall(r"[^\W_]+", (t or "").lower())
        out.append((frozenset(zip(*[x[i:] for i in range(w)], strict=False)), (t or "").lower()))
    return out


def alike(a, b, t=0.6):
    return a[1] == b[1] or bool(a[0] or b[0]) and len(a[0] & b[0]) >= t * len(a[0] | b[0]) - 1e-12


@pytest.mark.parametrize("hot", [512, 3])
def test_near_duplicate_groups_match_brute_force(spark, monkeypatch, hot):
    from functools import partial

    monkeypatch.setattr(neardup, "blocks", partial(shingles.blocks, hot_count=hot, chunk=4))
    texts = corpus()
    s = sets(texts)
    up = list(range(len(s)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in combinations(range(len(s)), 2):
        if alike(s[i], s[j]):
            a, b = sorted((top(i), top(j)))
            up[b] = a
    groups = defaultdict(list)
    for i in range(len(s)):
        groups[top(i)].append(i)
    want = sorted((g, i) for g, m in groups.items() if len(m) > 1 for i in m)
    df = spark.createDataFrame(list(enumerate(texts)), TEXT).withColumn("k", F.lit("clash"))
    assert sorted(map(tuple, neardup.near_duplicate_groups(df, width=3, t=0.6).collect())) == want


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicate_groups(spark.createDataFrame([], TEXT)).count() == 0


@pytest.mark.parametrize("hot", [512, 3])
def test_overlaps_match_brute_force(spark, monkeypatch, hot):
    from functools import partial

    monkeypatch.setattr(overlap, "blocks", partial(shingles.blocks, hot_count=hot, chunk=4))
    texts = corpus(5)
    s = sets(texts)
    ev, tr = [i for i in range(len(s)) if i % 3 == 0], [i for i in range(len(s)) if i % 3]
    want = sorted(("e", i, j) for i in ev for j in tr if alike(s[i], s[j]))
    frame = lambda ids: spark.createDataFrame([(i, texts[i]) for i in ids], TEXT)
    got = overlap.split_overlaps({"e": frame(ev)}, frame(tr), width=3, t=0.6)
    assert sorted(map(tuple, got.collect())) == want
    rep = overlap.overlap_report(got, {"e": frame(ev).withColumn("repository", F.lit(" R "))}).first()
    assert (rep.repository, rep.rows, rep.pairs) == ("r", len(ev), len(want))
    assert overlap.split_overlaps({"e": frame([]) if ev is None else frame(ev).limit(0)}, frame(tr)).count() == 0


def test_no_pair_is_lost_to_hashing(spark):
    """Pairs of likeness 0.6 whose minimum hashes differ in far more bits than is usual."""
    pairs = [[" ".join([f"w{s}x{i}" for i in range(14)] + [f"{x}{s}x{i}" for i in range(4)]) for x in "ab"] for s in (951, 1656, 15325)]
    frame = lambda rows: spark.createDataFrame(rows, TEXT)
    a, b = ([(2 * i + j, p[j]) for i, p in enumerate(pairs)] for j in (0, 1))
    assert sorted(map(tuple, neardup.near_duplicate_groups(frame(a + b), width=3, t=0.6).collect())) == [(0, 0), (0, 1), (2, 2), (2, 3), (4, 4), (4, 5)]
    assert sorted(map(tuple, overlap.split_overlaps({"e": frame(a)}, frame(b), width=3, t=0.6).collect())) == [("e", 0, 1), ("e", 2, 3), ("e", 4, 5)]


@pytest.mark.parametrize("hot", [512, 20])
def test_pairs_at_the_threshold_against_all_pairs(spark, monkeypatch, hot):
    """1,200 sets of words from one small vocabulary, with planted pairs of likeness exactly 0.6 of several sizes: every link is found, by groups and by pairs."""
    from functools import partial

    for m in (neardup, overlap):
        monkeypatch.setattr(m, "blocks", partial(shingles.blocks, hot_count=hot, chunk=64))
    r = random.Random(9)
    words = [f"w{i}" for i in range(700)]
    docs = []
    for i in range(400):
        size = r.choice([3, 9, 30, 60])
        some = r.sample(words, size + 2 * (size // 3))
        docs += [some[:size] + some[size : size + size // 3], some[:size] + some[size + size // 3 :], r.sample(words, r.choice([5, 20, 80]))]
    x = np.zeros((len(docs), 700), np.int32)
    for i, d in enumerate(docs):
        x[i, [int(w[1:]) for w in d]] = 1
    both = x @ x.T
    n = x.sum(axis=1)
    link = both >= 0.6 * (n[:, None] + n[None, :] - both) - 1e-9
    assert sum(abs(both[3 * i, 3 * i + 1] / (n[3 * i] + n[3 * i + 1] - both[3 * i, 3 * i + 1]) - 0.6) < 1e-9 for i in range(400)) == 400
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)], TEXT)
    label = np.arange(len(docs))
    shingles.joined(label, *np.nonzero(link))
    count = Counter(label.tolist())
    want = sorted((g, i) for i, g in enumerate(label.tolist()) if count[g] > 1)
    assert sorted(map(tuple, neardup.near_duplicate_groups(df, width=1, t=0.6).collect())) == want
    ev = [i for i in range(len(docs)) if i % 3 == 0]
    want = sorted(("e", i, j) for i in ev for j in range(len(docs)) if j % 3 and link[i, j])
    assert sorted(map(tuple, overlap.split_overlaps({"e": df.filter("row_id % 3 = 0")}, df.filter("row_id % 3 > 0"), width=1, t=0.6).collect())) == want


def test_partner_sketch_keeps_every_partner():
    """Rows of pairs that fit at their first common run are known to each other, whatever else the cells hold."""
    r = np.random.default_rng(4)
    n = r.integers(1, 400, 3000)
    pos = (r.random(3000) * (n - np.ceil(0.6 * n) + 1)).astype(np.int64)
    h, side = r.integers(0, 40, 3000).astype(np.uint64), np.ones(3000, np.int32)
    for two in (False, True):
        side = r.integers(1, 3, 3000) if two else side
        bits = 16
        cells = np.bincount(shingles.sized_cell(h, side, shingles.size_class(n), shingles.place_of(pos / n, 0.6), bits), minlength=1 << bits)
        x = np.minimum(cells, 3).astype(np.uint8).reshape(-1, 4)
        packed = x[:, 0] | x[:, 1] << 2 | x[:, 2] << 4 | x[:, 3] << 6
        known = shingles.has_partner(h, n, pos, side, 0.6, packed, bits, two)
        a, b = np.nonzero((h[:, None] == h[None, :]) & ~np.eye(3000, dtype=bool))
        if two:
            a, b = a[side[a] != side[b]], b[side[a] != side[b]]
        ok = shingles.fits(a, b, n, pos, 0.6)
        assert len(np.unique(a[ok])) > 300 and known[a[ok]].all() and not known.all()


def test_trie_join_finds_all_pairs_in_budget():
    r = np.random.default_rng(1)
    v = r.integers(0, 2**63, (60, 2), dtype=np.uint64)
    v[30:] = v[:30] ^ (np.uint64(1) << r.integers(0, 63, (30, 2)).astype(np.uint64))
    root, n = np.repeat([0, 1], 30)[r.permutation(60)], np.full(60, 9)
    i, j, d = shingles.trie_self_join(v, root, (np.array([0, 1]), np.array([0, 1])), n, 0.5, 40)
    got = {tuple(sorted(x)): y for *x, y in zip(i.tolist(), j.tolist(), d.tolist(), strict=True)}
    want = {(a, b): int(np.bitwise_count(v[a] ^ v[b]).sum()) for a, b in combinations(range(60), 2) if root[a] == root[b]}
    assert got == {k: x for k, x in want.items() if x <= 40}


def test_banded_program():
    r = random.Random(2)
    for _ in range(200):
        a, b = sorted(r.sample(range(40), 20)), sorted(r.sample(range(40), 20))
        n = len(set(a) & set(b))
        for most in (4, 20, 40):
            assert overlap.banded_common(a, b, most) == (n if 40 - 2 * n <= most else -1)


# --- p1


def test_controlled_rounding_keeps_both_margins():
    r = random.Random(4)
    for _ in range(50):
        rows = [r.randrange(1, 30) for _ in range(4)]
        w = [[r.random() for _ in range(7)] for _ in rows]
        table = [[q * x / sum(ws) for x in ws] for q, ws in zip(rows, w, strict=True)]
        got = quota_sample.controlled_rounding(table, rows)
        assert [sum(x) for x in got] == rows
        for j in range(7):
            assert abs(sum(x[j] for x in got) - sum(x[j] for x in table)) < 1
        assert all(abs(a - b) < 1 for x, y in zip(got, table, strict=True) for a, b in zip(x, y, strict=True))


def test_quotas():
    assert quota_sample.category_quotas(100, [0.5, 0.3, 0.2], [0, 0, 0], [999, 999, 999]) == [50, 30, 20]
    assert quota_sample.category_quotas(100, [0.9, 0.1], [0, 30], [999, 999]) == [70, 30]
    assert quota_sample.category_quotas(100, [0.5, 0.5], [0, 0], [10, 999]) == [10, 90]
    assert quota_sample.category_quotas(100, [0.5, 0.5], [0, 0], [10, 20]) == [10, 20]


def test_draw(spark):
    rows = [(i, f"i{i % 180}", "bug " if i % 3 else "Question", None if i % 7 == 0 else f"R{i % 5}", i) for i in range(200)] + [(900, None, "BUG", "r", 1), (901, "x", None, "r", 1)]
    df = spark.createDataFrame(rows, "row_id long, issue_id string, canonical_label string, repository string, ingested_at long").withColumn("q", F.lit(1))
    plans = spark.createDataFrame([("p", "BUG", 0.5, None, 60), ("p", "QUESTION", 0.5, 10, 60), ("big", "QUESTION", 1.0, None, 5000)], "plan_name string, canonical_label string, target_share double, min_rows long, sample_rows long")
    sample, report = quota_sample.draw(df, plans)
    got = sample.collect()
    assert len({(r.plan_name, r.issue_id) for r in got}) == len(got)
    assert Counter((r.plan_name, r.canonical_label) for r in got if r.plan_name == "p") == {("p", "BUG"): 30, ("p", "QUESTION"): 30}
    rep = {(r.plan_name, r.canonical_label): r for r in report.collect()}
    assert rep["big", "QUESTION"].too_few and rep["big", "QUESTION"].drawn == rep["big", "QUESTION"].available == 60
    assert rep["p", "BUG"].reached_share == 0.5 and not rep["p", "BUG"].over_target
    assert all(r.drawn == 0 for r in quota_sample.draw(df.limit(0), plans)[1].collect())
    few = spark.createDataFrame([("q", "BUG", 0.2, None, 150), ("q", "QUESTION", 0.8, None, 150)], "plan_name string, canonical_label string, target_share double, min_rows long, sample_rows long")
    rep = {r.canonical_label: r for r in quota_sample.draw(df, few)[1].collect()}
    assert rep["BUG"].over_target and rep["BUG"].drawn == 90 and rep["QUESTION"].too_few
    # a repository is a stratum of its own: its part of a category is drawn to within one
    where = {r.issue_id: r.repository for r in df.filter("issue_id is not null").orderBy("ingested_at").collect()}
    part = Counter(where[r.issue_id] for r in got if (r.plan_name, r.canonical_label) == ("p", "BUG"))
    there = Counter(where[i] for i in {r.issue_id for r in df.filter("canonical_label = 'bug ' and issue_id is not null").collect()})
    assert all(abs(part[x] - 30 * m / sum(there.values())) < 1 for x, m in there.items())


# --- p2


def test_components_match_brute_force(spark, tmp_path):
    r = random.Random(6)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(3, 3), (None, 4)]
    got = {x.node: x.component for x in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    up = list(range(80))
    for _ in range(80):
        for a, b in edges:
            if a is not None:
                up[a] = up[b] = min(up[a], up[b])
    nodes = {x for e in edges for x in e if e[0] is not None and e[0] != e[1]}
    assert got == {x: up[x] for x in nodes}
    assert connected_components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t")).count() == 0


def test_grouped_split(spark):
    rows = [(i, None if i % 11 == 0 else f" Repo{i % 37} ", None if i % 13 == 0 else f"i{i // 2}") for i in range(2000)] + [(5000, "", " "), (5001, None, None)]
    df = spark.createDataFrame(rows, "row_id long, repository string, issue_id string").withColumn("entity", F.lit(1))
    goal = spark.createDataFrame([("train", 0.7), ("validation", 0.15), ("test", 0.15)], "split_name string, target_share double")
    d = df.drop("entity").join(splits.grouped_split(df, goal), "row_id")
    assert d.count() == len(rows)
    for c in ("issue_id", "repository"):
        x = d.withColumn("c", F.lower(F.trim(c))).filter("c <> ''")
        assert x.groupBy("c").agg(F.count_distinct("split_name").alias("n")).filter("n > 1").isEmpty()
    assert splits.split_shares(splits.grouped_split(df.limit(0), goal), goal).count() == 3
    apart = spark.createDataFrame([(i, f"r{i % 9 if i % 3 else i}", f"i{i}") for i in range(2000)], "row_id long, repository string, issue_id string")
    shares = {r.split_name: (r.share, r.target_share) for r in splits.split_shares(splits.grouped_split(apart, goal), goal).collect()}
    assert all(abs(a - b) < 0.05 for a, b in shares.values()), shares  # six repositories hold two thirds of the rows
    pairs = spark.createDataFrame([(1, "b", "x"), (2, "A ", "x"), (3, "C", "y"), (4, "a", "y"), (5, "d", "z")], "row_id long, repository string, issue_id string")
    assert sorted(map(tuple, splits.linked_names(splits.entity_components(pairs, Scratch(spark, "t"))).collect())) == [("a", "b"), ("a", "c"), ("b", "c")]


# --- p6


def test_bounds_and_packing():
    r = random.Random(7)
    for _ in range(30):
        c = r.choice([10, 50, 256])
        x = sorted((r.randrange(0, c) for _ in range(r.randrange(1, 80))), reverse=True)
        bins = packing.best_fit_decreasing(x, c)
        fill = Counter()
        for b, s in zip(bins, x, strict=True):
            fill[b] += s
        assert max(fill.values()) <= c and packing.lower_bound(np.array(x), c) <= max(bins) + 1
    assert packing.lower_bound(np.array([6, 6, 6]), 10) == 3
    assert packing.lower_bound(np.array([6, 3]), 10, np.array([3, 5])) == packing.lower_bound(np.array([6] * 3 + [3] * 5), 10) == 4


def test_containers(spark):
    r = random.Random(8)
    docs = [(i, " ".join(["w"] * r.randrange(0, 90))) for i in range(300)] + [(900, None), (901, " ".join(["w"] * 128)), (901, "a b")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("tokens", F.lit("clash"))
    kinds = spark.createDataFrame([("k", 64), ("none", None)], "container_kind string, capacity_tokens long")
    out = packing.pack(df, kinds, group=40)
    assert out.agg(F.sum("tokens")).first()[0] == sum(len((t or "").split()) for _, t in docs)
    assert out.groupBy("container").agg(F.sum("tokens").alias("t")).filter("t > 64").isEmpty()
    whole = out.groupBy("doc_id").agg(F.count("*").alias("n"))
    assert whole.filter("doc_id < 900 AND n > 1").count() == sum(len(t.split()) > 64 for i, t in docs if i < 900)
    rep = packing.fill_report(out, kinds).first()
    assert rep.lower_bound <= rep.containers <= 1.1 * rep.lower_bound + 2
    assert packing.pack(df.limit(0), kinds).count() == 0


# --- p7


def test_mix(spark):
    docs = [(i, f" S{i % 3}", "w " * (1 + i % 9)) for i in range(900)] + [(990, None, "w"), (991, "s0", None)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").withColumn("h", F.lit(1))
    goal = spark.createDataFrame([("m", "s0", 0.5, 1, 1000), ("m", "s1", 0.3, 1, 1000), ("m", "s2", 0.2, 1, 1000), ("n", "s0", 1.0, 2, 10**6), ("n", "gone", None, 1, 10**6)], "mix_name string, source string, target_share double, max_uses int, total_tokens long")
    got, rep = mixing.mix(df, goal)
    r = {(x.mix_name, x.source): x for x in rep.collect()}
    for s, share in (("s0", 500), ("s1", 300), ("s2", 200)):
        assert abs(r["m", s].reached_tokens - share) <= 9 and not r["m", s].too_few
    assert r["n", "s0"].too_few and r["n", "s0"].reached_tokens == 2 * r["n", "s0"].source_tokens
    assert got.groupBy("mix_name", "doc_id").count().filter("mix_name = 'm' AND count > 1 OR count > 2").isEmpty()
    assert mixing.mix(df.limit(0), goal)[0].count() == 0


def test_mix_goes_on_to_its_budget(spark):
    docs = [(i, "small" if i < 20 else "big" if i < 500 else "more", "w " * (5 + i % 7)) for i in range(900)]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    goal = spark.createDataFrame([("m", s, w, u, 2000) for s, w, u in (("small", 0.5, 2), ("big", 0.3, 1), ("more", 0.2, 1))], "mix_name string, source string, target_share double, max_uses int, total_tokens long")
    got, rep = mixing.mix(df, goal)
    r = {x.source: x for x in rep.collect()}
    assert r["small"].ran_out and r["small"].too_few and r["small"].reached_tokens == 2 * r["small"].source_tokens and not r["big"].ran_out
    assert abs(sum(x.reached_tokens for x in r.values()) - 2000) <= 6  # half a document
    assert abs(r["big"].reached_tokens / r["more"].reached_tokens - 1.5) < 0.05
    assert mixing.horizon(10, [(1.0, 2.0), (1.0, 100.0)]) == 8.0 and mixing.horizon(10, [(1.0, 2.0)]) == float("inf")


# --- p8


def test_stuffed_pages(spark):
    prose = "The page about the gateway should explain how the token is read. It would help if the cache could be kept after the upgrade. "
    trace = "Traceback:\n" + "  at Foo.bar(baz.kt:12)\n  at Foo.qux(baz.kt:13)\n" * 9
    pages = [
        (1, prose + "How do I reset the buffer when the network is slow? The old client never writes more than two records into a file."), (2, prose + trace), (3, "Tags: " + ", ".join(["free tool", "best driver", "crack", "serial key"] * 9)), (4, "\n".join(f"http://a{i}.example/x{i}/y" for i in range(20))),
        (5, "tool driver free best " * 20), (6, prose * 3 + "http://a.example/x"), (7, None), (8, ""), (9, "free tool"), (10, "\n".join(f"pkg{i}==1.{i}.0" for i in range(30))),
    ]
    df = spark.createDataFrame(pages, "doc_id long, text string").withColumn("signs", F.lit("clash"))
    got = {r.doc_id for r in stuffing.label_pages(df).filter("stuffed").collect()}
    assert got == {3, 4, 5}
    assert stuffing.label_pages(df.limit(0)).count() == 0


def test_pages_of_other_languages(spark):
    """Prose and verse that the fit has never seen are no cases; lists of their words are."""
    prose = {
        "fi": "Sivu kertoo miten tunnus luetaan ja miksi se vanhenee. Jos palvelin ei vastaa, asiakas odottaa hetken ja yrittää uudelleen. Tiedosto jää levylle eikä sitä poisteta. Vanha versio toimi ilman tätä asetusta, mutta uusi ei.",
        "tr": "Bu sayfa belirtecin nasıl okunduğunu ve neden eskidiğini anlatır. Sunucu yanıt vermezse istemci biraz bekler ve yeniden dener. Dosya diskte kalır ve silinmez. Eski sürüm bu ayar olmadan çalışıyordu.",
        "th": "หน้านี้อธิบายวิธีอ่านโทเค็นและเหตุผลที่มันหมดอายุ ถ้าเซิร์ฟเวอร์ไม่ตอบสนองไคลเอนต์จะรอสักครู่แล้วลองอีกครั้ง ไฟล์จะอยู่บนดิสก์และไม่ถูกลบออก\n" * 3,
        "hi": "यह पृष्ठ बताता है कि टोकन कैसे पढ़ा जाता है और वह क्यों पुराना होता है। सर्वर उत्तर न दे तो ग्राहक थोड़ी देर रुकता है और फिर प्रयास करता है। फ़ाइल डिस्क पर रहती है और मिटाई नहीं जाती।",
        "sw": "Ukurasa huu unaeleza jinsi tokeni inavyosomwa na kwa nini inaisha. Seva isipojibu, mteja husubiri kidogo na kujaribu tena. Faili hubaki kwenye diski wala haifutwi. Toleo la zamani lilifanya kazi bila mpangilio huu.",
        "zh": "本页说明如何读取令牌以及它为什么会过期。如果服务器没有响应，客户端会稍等片刻再重试。文件保留在磁盘上，不会被删除。",
    }
    verse = "Slow rivers carry autumn leaves downstream\nbeneath a bridge of weathered stone\nwhere children once had built a dream\nand every echo sang alone\nthe evening gathers all its light\nin windows turning gold and red\nuntil the hills dissolve in night\nand nothing more is left unsaid\nyet morning finds the water clear\nwith silver threads along the sand\nas if the river waited here\nto lay the daylight in my hand"
    keys = [f"{a}{b}" for a in ("gata", "veno", "rilo", "sumi", "pode", "laki") for b in ("tool", "card", "ware", "disk", "link")]
    pages = [*prose.values(), verse, " ".join(keys * 20), ", ".join(["halpa ohjelma", "paras ajuri", "ilmainen lataus"] * 20), "\n".join(f"{a} {b}" for a in keys[:12] for b in ("max", "mini", "pro"))]
    pages += ["\n".join(f"https://h{i}.shop/x/{i}" for i in range(30)), " ".join(f"h{i}.shop" for i in range(40))]
    df = spark.createDataFrame(list(enumerate(pages)), "doc_id long, text string")
    got = {r.doc_id: r for r in stuffing.label_pages(df).collect()}
    assert {i for i, r in got.items() if r.stuffed} == set(range(len(prose) + 1, len(pages))), [(i, r.words, round(r.share, 2)) for i, r in got.items()]


def test_model_of_pages():
    assert stuffing.plain_signs(stuffing.START) == 2
    start = (stuffing.START[0], stuffing.START[1], [r[::-1] for r in stuffing.START[2]])
    assert stuffing.plain_signs(start) < 2  # then every page is searched
    r = random.Random(3)
    for _ in range(200):
        signs, words = [r.randrange(2) for _ in range(9)], [r.randrange(1, 40) for _ in range(9)]
        assert stuffing.viterbi(signs, words, stuffing.START, 2) == stuffing.viterbi(signs, words, stuffing.START, 0)
