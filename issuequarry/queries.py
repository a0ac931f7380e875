"""Queries of the core operators with their SQL. Names follow the operator inventory; scalar operators start with txt, token operators with tok."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from issuequarry.functions import text as T
from issuequarry.operators import data as D
from issuequarry.operators import metrics as M
from issuequarry.operators import sampling as S
from issuequarry.operators import tfidf as X
from issuequarry.operators import tokens as K
from issuequarry.session import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_CLASS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _clean(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_CLASS}+', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_CLASS}+|{_CLASS}+$', '', 'g')"


def _label(x: str) -> str:
    c = f"lower({_clean(x)})"
    return f"CASE WHEN {c} = 'bug' OR starts_with({c}, 'bug,') OR contains({c}, ' bug') THEN 'BUG' WHEN contains({c}, 'feature') OR contains({c}, 'enhancement') THEN 'ENHANCEMENT' WHEN contains({c}, 'question') THEN 'QUESTION' WHEN contains({c}, 'doc') THEN 'DOCUMENTATION' END"


def _hash(x: str) -> str:
    return f"sha256(replace(lower({_clean(x)}), 'ß', 'ss'))"


def _issues(table: str) -> str:
    """The harmonised columns of a table in SQL."""
    return f"""(SELECT *, {_hash("text")} AS h, CASE WHEN canon = 'BUG' THEN 'BUG' ELSE 'NON_BUG' END AS bin FROM (SELECT row_id, issue_id, {_clean("repository")} AS repository, title, body, '[TITLE]' || chr(10) || title || chr(10) || chr(10) || '[DESCRIPTION]' || chr(10) || body AS text, original_label, {_label("original_label")} AS canon
        FROM (SELECT row_id, issue_id, repository, original_label, {_clean("title")} AS title, {_clean("body")} AS body FROM {table}) WHERE title <> '' OR body <> ''))"""


def issues(spark: SparkSession, d: str, name: str) -> DataFrame:
    raw = t(spark, d, name).select("row_id", F.col("issue_id").alias("id"), F.col("title").alias("raw_title"), F.col("body").alias("raw_body"), F.col("original_label").alias("raw_label"), F.col("repository").alias("raw_repository"))
    return D.harmonize(raw, "raw_label", "raw_title", "raw_body", "id", "raw_repository").drop("id", "raw_title", "raw_body", "raw_label", "raw_repository")


# --- text and labels


@query(f"SELECT row_id, {_clean('title')} AS title, {_clean('body')} AS body FROM train_clean")
def txt01_clean_text(spark, d):
    return t(spark, d, "train_clean").select("row_id", T.clean_text(F.col("title")).alias("title"), T.clean_text(F.col("body")).alias("body"))


@query(f"SELECT row_id, '[TITLE]' || chr(10) || {_clean('title')} || chr(10) || chr(10) || '[DESCRIPTION]' || chr(10) || {_clean('body')} AS text FROM train_clean")
def txt02_issue_text(spark, d):
    return t(spark, d, "train_clean").select("row_id", T.issue_text(T.clean_text(F.col("title")), T.clean_text(F.col("body"))).alias("text"))


@query(f"SELECT row_id, '[TITLE]' || chr(10) || {_strip('coalesce(title, chr(32))')} || chr(10) || chr(10) || '[DESCRIPTION]' || chr(10) || {_strip('coalesce(body, chr(32))')} AS text FROM test")
def txt03_inference_text(spark, d):
    return t(spark, d, "test").select("row_id", T.inference_text(F.col("title"), F.col("body")).alias("text"))


@query(f"SELECT row_id, {_label('original_label')} AS canonical_label FROM train_clean")
def txt04_canonical_label(spark, d):
    return t(spark, d, "train_clean").select("row_id", T.canonical_label(F.col("original_label")).alias("canonical_label"))


@query(f"SELECT row_id, CASE WHEN {_label('original_label')} = 'BUG' THEN 'BUG' ELSE 'NON_BUG' END AS binary_label FROM train_clean")
def txt05_binary_label(spark, d):
    return t(spark, d, "train_clean").select("row_id", T.binary_label(T.canonical_label(F.col("original_label"))).alias("binary_label"))


@query(f"SELECT row_id, {_hash('text')} AS text_hash FROM train_clean")
def txt06_text_hash(spark, d):
    return t(spark, d, "train_clean").select("row_id", T.text_hash(F.col("text")).alias("text_hash"))


@query(f"SELECT row_id, issue_id, title, body, text, original_label, canon AS canonical_label, bin AS binary_label, h AS text_hash, repository FROM {_issues('train_clean')}")
def txt11_harmonize(spark, d):
    return issues(spark, d, "train_clean")


@query(f"SELECT row_id, issue_id || ':' || substr({_hash('text')}, 1, 16) AS internal_id FROM train_clean")
def txt12_internal_id(spark, d):
    return t(spark, d, "train_clean").select("row_id", T.internal_id(F.col("issue_id"), T.text_hash(F.col("text"))).alias("internal_id"))


@query("SELECT DISTINCT repository, coalesce(nullif(regexp_replace(regexp_replace(repository, '[^A-Za-z0-9_.-]+', '-', 'g'), '^[-.]+|[-.]+$', '', 'g'), ''), 'split') AS safe FROM train_clean")
def txt16_safe_name(spark, d):
    return t(spark, d, "train_clean").select("repository", T.safe_name(F.col("repository")).alias("safe")).distinct()


@query("SELECT vec_id, CASE WHEN list_max(embedding) >= 0.2 THEN cast(label AS VARCHAR) ELSE 'ABSTAIN' END AS decision FROM embeddings")
def txt17_abstain(spark, d):
    return t(spark, d, "embeddings").select("vec_id", T.abstain(F.col("label").cast("string"), F.col("embedding"), 0.2).alias("decision"))


@query("SELECT vec_id, 'L' || (list_position(embedding, list_max(embedding)) - 1) AS best FROM embeddings")
def txt18_argmax(spark, d):
    v = t(spark, d, "embeddings")
    width = len(v.select("embedding").first()[0])
    return v.select("vec_id", T.argmax_label(F.col("embedding"), [f"L{i}" for i in range(width)]).alias("best"))


_STAGES = """(SELECT row_id, project, canonical_label, text, CASE WHEN row_id % 3 = 0 THEN 'QUESTION' ELSE 'BUG' END AS s1, CASE WHEN row_id % 3 = 0 THEN NULL WHEN upper(trim(canonical_label)) = 'BOH' THEN 'BOH' ELSE 'MAN' END AS s2,
    CASE WHEN row_id % 3 > 0 AND upper(trim(canonical_label)) <> 'BOH' THEN CASE WHEN upper(trim(canonical_label)) = 'ARB' THEN 'ARB' ELSE 'NAM' END END AS s3 FROM mandelbugs)"""


def _stages(spark, d):
    m, x = t(spark, d, "mandelbugs"), F.upper(F.trim("canonical_label"))
    bug = F.col("row_id") % 3 > 0
    return m.withColumns({
        "s1": F.when(bug, "BUG").otherwise("QUESTION"), "s2": F.when(bug, F.when(x == "BOH", "BOH").otherwise("MAN")),
        "s3": F.when(bug & (x != "BOH"), F.when(x == "ARB", "ARB").otherwise("NAM")),
    })


@query(f"SELECT row_id, coalesce(nullif(s3, ''), nullif(s2, ''), s1) AS final_label FROM {_STAGES}")
def txt19_final_label(spark, d):
    return _stages(spark, d).select("row_id", T.final_label(F.col("s1"), F.col("s2"), F.col("s3")).alias("final_label"))


@query(f"SELECT row_id, CASE WHEN s1 <> 'BUG' THEN s1 WHEN s2 = 'BOH' THEN s2 ELSE s3 END AS label FROM {_STAGES}")
def t16_route(spark, d):
    return _stages(spark, d).select("row_id", T.route(F.col("s1"), F.col("s2"), F.col("s3")).alias("label"))


@query()
def tok22_crc_tokens(spark, d):
    return t(spark, d, "train_clean").select("row_id", T.crc_tokens(F.col("text"), 256).alias("input_ids"))


@query(f"""WITH z AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS z),
    w AS (SELECT row_id, list_filter(regexp_split_to_array(coalesce(text, ''), '{_CLASS}+'), lambda x: x <> '')[1:254] AS w FROM train_clean), p AS (SELECT row_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
    h AS (SELECT x, hex(encode(x)) AS h FROM (SELECT DISTINCT x FROM p)), b AS (SELECT x, list_transform(range(0, length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS b FROM h),
    k AS (SELECT x, 3 + xor(list_reduce(list_prepend(4294967295, b), lambda c, v: xor(c >> 8, z[(xor(c, v) & 255) + 1])), 4294967295) % 30000 AS k FROM b, z), j AS (SELECT row_id, string_agg(k, ' ' ORDER BY i) AS t FROM p JOIN k USING (x) GROUP BY 1)
    SELECT row_id, '1 ' || coalesce(t || ' ', '') || '2' AS ids FROM train_clean LEFT JOIN j USING (row_id)""")
def tok22_token_text(spark, d):
    """The token ids as text."""
    return t(spark, d, "train_clean").select("row_id", F.array_join(T.crc_tokens(F.col("text"), 256).cast("array<string>"), " ").alias("ids"))


@query(f"SELECT row_id, 2 + least(254, len(list_filter(regexp_split_to_array(text, '{_CLASS}+'), lambda x: x <> ''))) AS tokens FROM train_clean")
def tok21_token_lengths(spark, d):
    return t(spark, d, "train_clean").select("row_id", F.size(T.crc_tokens(F.col("text"), 256)).cast("bigint").alias("tokens"))


@query(f"""WITH l AS (SELECT row_id, row_id // 512 AS b, 2 + least(254, len(list_filter(regexp_split_to_array(text, '{_CLASS}+'), lambda x: x <> ''))) AS n FROM train_clean)
    SELECT row_id, max(n) OVER (PARTITION BY b) AS width, n AS used FROM l""")
def tok23_dynamic_padding(spark, d):
    """Rows padded to the widest of their batch of 512 row ids."""
    x = t(spark, d, "train_clean").select("row_id", F.floor(F.col("row_id") / 512).alias("b"), T.crc_tokens(F.col("text"), 256).alias("ids"))
    wide = x.groupBy("b").agg(F.max(F.size("ids")).alias("w"))
    padded = x.join(wide, "b").select("row_id", F.concat("ids", F.array_repeat(F.lit(0), (F.col("w") - F.size("ids")).cast("int"))).alias("input_ids"), F.size("ids").alias("used"))
    return padded.select("row_id", F.size("input_ids").cast("bigint").alias("width"), F.col("used").cast("bigint").alias("used"))


# --- filters and checks


@query(f"SELECT row_id, {_clean('title')} AS title FROM train_clean WHERE {_clean('title')} <> '' OR {_clean('body')} <> ''")
def f01_nonblank(spark, d):
    return issues(spark, d, "train_clean").select("row_id", "title")


@query("SELECT row_id, CASE WHEN canonical_label IN ('ARB', 'NAM') THEN 'MAN' ELSE canonical_label END AS canonical_label FROM mandelbugs WHERE canonical_label IN ('BOH', 'MAN', 'ARB', 'NAM')")
def f02_stage2_filter(spark, d):
    return D.stage2_rows(t(spark, d, "mandelbugs")).select("row_id", "canonical_label")


@query("SELECT row_id, canonical_label FROM mandelbugs WHERE canonical_label IN ('ARB', 'NAM')")
def f03_stage3_filter(spark, d):
    return D.stage3_rows(t(spark, d, "mandelbugs")).select("row_id", "canonical_label")


@query("SELECT row_id, project FROM mandelbugs m WHERE NOT EXISTS (SELECT 1 FROM validation_predictions p WHERE p.project = m.project)")
def f04_heldout_exclusion(spark, d):
    return D.exclude_projects(t(spark, d, "mandelbugs"), t(spark, d, "validation_predictions")).select("row_id", "project")


@query("SELECT issue_id, canonical_label, prediction, scored_at FROM validation_predictions WHERE coalesce(canonical_label <> prediction, TRUE)")
def f05_misclassified(spark, d):
    return D.misclassified(t(spark, d, "validation_predictions"), "canonical_label").select("issue_id", "canonical_label", "prediction", "scored_at")


@query(f"SELECT count(*) AS rows, count(*) FILTER (text IS NULL OR {_strip('text')} = '') AS blank_texts, count(*) FILTER (canonical_label IS NULL) AS null_labels, count(*) FILTER (canonical_label NOT IN ('BUG', 'ENHANCEMENT', 'QUESTION', 'DOCUMENTATION')) AS unexpected_labels FROM train_clean")
def v01_validation_report(spark, d):
    return D.validation_report(t(spark, d, "train_clean"))


@query(f"SELECT DISTINCT original_label FROM {_issues('train_clean')} WHERE canon IS NULL")
def v02_unmapped_labels(spark, d):
    return D.unmapped_labels(issues(spark, d, "train_clean"))


@query("""SELECT 'train_clean/test/text_hash' AS "check", count(*) AS violations FROM (SELECT DISTINCT text_hash FROM train_clean WHERE text_hash IN (SELECT text_hash FROM test WHERE text_hash IS NOT NULL))
    UNION ALL SELECT 'validation_clean/test/text_hash', count(*) FROM (SELECT DISTINCT text_hash FROM validation_clean WHERE text_hash IN (SELECT text_hash FROM test WHERE text_hash IS NOT NULL))
    UNION ALL SELECT 'train_clean/validation_clean/issue_id', count(*) FROM (SELECT DISTINCT issue_id FROM train_clean WHERE issue_id IN (SELECT issue_id FROM validation_clean WHERE issue_id IS NOT NULL))""")
def v04_variant_checks(spark, d):
    return D.variant_checks({x: t(spark, d, x) for x in ("train_clean", "validation_clean", "test")})


@query(f"SELECT canonical_label, count(*) AS rows, count(*) FILTER (text IS NULL OR {_strip('text')} = '') AS blank_texts FROM train_clean GROUP BY 1")
def v06_inspect_counts(spark, d):
    return D.inspect(t(spark, d, "train_clean"))


@query("SELECT DISTINCT prediction AS canonical_label FROM validation_predictions WHERE prediction IS NOT NULL AND prediction NOT IN (SELECT canonical_label FROM train_clean WHERE canonical_label IS NOT NULL)")
def v07_label_domain(spark, d):
    return D.label_domain_gap(t(spark, d, "validation_predictions").select(F.col("prediction").alias("canonical_label")), t(spark, d, "train_clean"))


# --- deduplication, joins, set operations


@query(f"SELECT row_id, h AS text_hash FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY row_id) AS r FROM {_issues('train_clean')}) WHERE r = 1")
def w01_dedup_keep_first(spark, d):
    return D.first_rows(issues(spark, d, "train_clean"), []).select("row_id", "text_hash")


@query("""SELECT row_id, CASE WHEN a THEN issue_id || ':' || substr(text_hash, 1, 16) ELSE issue_id END AS issue_id, CASE WHEN a THEN issue_id END AS source_issue_id
    FROM test, (SELECT max(n) > 1 AS a FROM (SELECT count(*) AS n FROM test GROUP BY issue_id))""")
def w02_unique_ids(spark, d):
    return D.unique_ids(t(spark, d, "test")).select("row_id", "issue_id", "source_issue_id")


@query("SELECT row_id, text_hash FROM test WHERE text_hash IN (SELECT text_hash FROM train_clean)")
def j01_overlap(spark, d):
    return D.overlap(t(spark, d, "train_clean"), t(spark, d, "test")).select("row_id", "text_hash")


@query(f"SELECT row_id, h AS text_hash FROM {_issues('train_clean')} x WHERE NOT EXISTS (SELECT 1 FROM {_issues('test')} y WHERE y.h = x.h)")
def j02_leakage_free(spark, d):
    return D.without_overlap(issues(spark, d, "train_clean"), issues(spark, d, "test")).select("row_id", "text_hash")


@query("SELECT row_id, issue_id, canonical_label, source_issue_id, NULL::VARCHAR AS project FROM train_clean UNION ALL SELECT row_id, issue_id, canonical_label, NULL, project FROM mandelbugs")
def o01_union_outer(spark, d):
    return D.union_outer(t(spark, d, "train_clean").select("row_id", "issue_id", "canonical_label", "source_issue_id"), t(spark, d, "mandelbugs").select("row_id", "issue_id", "canonical_label", "project"))


@query("SELECT issue_id FROM train_clean INTERSECT SELECT issue_id FROM validation_clean")
def o03_id_intersect(spark, d):
    return t(spark, d, "train_clean").select("issue_id").intersect(t(spark, d, "validation_clean").select("issue_id"))


@query("SELECT original_label FROM train_clean EXCEPT SELECT original_label FROM test")
def o04_except(spark, d):
    return t(spark, d, "train_clean").select("original_label").subtract(t(spark, d, "test").select("original_label"))


@query(f"""WITH tr AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY row_id) AS r FROM {_issues('train_clean')}), te AS (SELECT h FROM {_issues('test')})
    SELECT repository, count(*) AS rows, min(h) AS least_hash FROM tr WHERE r = 1 AND h NOT IN (SELECT h FROM te) GROUP BY 1""")
def leakage_free_train(spark, d):
    """Deduplicated training rows that aren't in the official test, per repository."""
    clean = D.without_overlap(D.first_rows(issues(spark, d, "train_clean"), ["repository"]), issues(spark, d, "test"))
    return clean.groupBy("repository").agg(F.count("*").alias("rows"), F.min("text_hash").alias("least_hash"))


# --- statistics


@query("SELECT count(*) AS rows, count(canonical_label) AS labelled, count(DISTINCT repository) AS repositories, count(*) - count(DISTINCT text_hash) - max((text_hash IS NULL)::INT) AS duplicate_hashes FROM train_clean")
def a01_dataset_stats(spark, d):
    return D.statistics(t(spark, d, "train_clean"))


@query("SELECT canonical_label, count(*) AS n FROM train_clean WHERE canonical_label IS NOT NULL GROUP BY 1")
def a02_class_counts(spark, d):
    return D.class_counts(t(spark, d, "train_clean"))


@query("SELECT coalesce(sum(n), 0)::BIGINT AS affected FROM (SELECT count(*) AS n FROM test GROUP BY issue_id) WHERE n > 1")
def a04_shared_source_ids(spark, d):
    return D.shared_ids(t(spark, d, "test"))


@query("SELECT canonical_label, round(sum(n) OVER () / (count(*) OVER () * n), 9) AS weight FROM (SELECT upper(trim(canonical_label)) AS canonical_label, count(*) AS n FROM train_clean WHERE canonical_label IS NOT NULL GROUP BY 1)")
def a05_class_weights(spark, d):
    return D.class_weights(t(spark, d, "train_clean").select(F.upper(F.trim("canonical_label")).alias("canonical_label"))).select("canonical_label", F.round("weight", 9).alias("weight"))


_CONF = """c AS (SELECT canonical_label AS truth, prediction, count(*) AS n FROM validation_predictions WHERE canonical_label IS NOT NULL AND prediction IS NOT NULL GROUP BY ALL),
    l AS (SELECT truth AS x FROM c UNION SELECT prediction FROM c), g AS (SELECT a.x AS truth, b.x AS prediction, coalesce(n, 0) AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.truth = a.x AND c.prediction = b.x),
    p AS (SELECT x AS label, (SELECT sum(n) FROM g WHERE truth = x) AS support, (SELECT sum(n) FROM g WHERE prediction = x) AS guessed, (SELECT sum(n) FROM g WHERE truth = x AND prediction = x) AS hit FROM l),
    q AS (SELECT label, support, guessed, hit, CASE WHEN guessed = 0 THEN 0 ELSE hit / guessed END AS precision, CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall, CASE WHEN support + guessed = 0 THEN 0 ELSE 2 * hit / (support + guessed) END AS f1 FROM p)"""


def _confusion(spark, d):
    return M.confusion(t(spark, d, "validation_predictions"), "canonical_label", "prediction")


@query(f"WITH {_CONF} SELECT truth, prediction, n FROM g")
def a07_confusion(spark, d):
    return _confusion(spark, d)


@query(f"WITH {_CONF} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM q")
def a12_per_class(spark, d):
    return M.per_class(_confusion(spark, d)).select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


_SUM = """SELECT metric, round(value, 9) AS value FROM (SELECT sum(hit) / sum(support) AS accuracy, avg(f1) AS macro_f1, sum(hit) / sum(support) AS micro_f1, sum(f1 * support) / sum(support) AS weighted_f1, avg(recall) FILTER (support > 0) AS balanced_accuracy,
    CASE WHEN (sum(support)::DOUBLE ** 2 - sum(guessed ** 2)) * (sum(support)::DOUBLE ** 2 - sum(support ** 2)) = 0 THEN 0 ELSE (sum(hit)::DOUBLE * sum(support) - sum(support::DOUBLE * guessed)) / sqrt((sum(support)::DOUBLE ** 2 - sum(guessed ** 2)) * (sum(support)::DOUBLE ** 2 - sum(support ** 2))) END AS mcc FROM q)
    UNPIVOT (value FOR metric IN (accuracy, macro_f1, micro_f1, weighted_f1, balanced_accuracy, mcc))"""


@query(f"""WITH {_CONF} SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support::BIGINT AS support FROM q
    UNION ALL SELECT 'accuracy', round(sum(hit) / sum(support), 9), round(sum(hit) / sum(support), 9), round(sum(hit) / sum(support), 9), sum(support)::BIGINT FROM q
    UNION ALL SELECT 'macro avg', round(avg(precision), 9), round(avg(recall), 9), round(avg(f1), 9), sum(support)::BIGINT FROM q
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 9), round(sum(recall * support) / sum(support), 9), round(sum(f1 * support) / sum(support), 9), sum(support)::BIGINT FROM q""")
def a12_report(spark, d):
    return M.report(_confusion(spark, d)).select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"WITH {_CONF} SELECT * FROM ({_SUM}) WHERE metric IN ('macro_f1', 'micro_f1', 'weighted_f1', 'mcc')")
def a15_training_metrics(spark, d):
    return M.training_metrics(_confusion(spark, d)).select("metric", F.round("value", 9).alias("value"))


@query(f"WITH {_CONF} {_SUM}")
def a13_metrics(spark, d):
    return M.summary(_confusion(spark, d)).select("metric", F.round("value", 9).alias("value"))


@query(f"""WITH {_CONF.replace("canonical_label AS truth, prediction, count(*) AS n FROM validation_predictions WHERE canonical_label IS NOT NULL AND prediction IS NOT NULL", "coalesce(nullif(s3, ''), nullif(s2, ''), s1) AS truth, canonical_label AS prediction, count(*) AS n FROM " + _STAGES)} {_SUM}""")
def a14_hierarchy_metrics(spark, d):
    x = _stages(spark, d).select(T.final_label(F.col("s1"), F.col("s2"), F.col("s3")).alias("final_label"), F.col("canonical_label").alias("prediction"))
    return M.summary(M.confusion(x, "final_label", "prediction")).select("metric", F.round("value", 9).alias("value"))


# --- samples and splits


def _labelled(spark, d):
    return t(spark, d, "train_clean").select("row_id", F.upper(F.trim("canonical_label")).alias("canonical_label"), F.lower(F.trim("repository")).alias("repository"))


def _with_label(spark, d):
    return _labelled(spark, d).filter("canonical_label IS NOT NULL")


_LAB = "(SELECT row_id, upper(trim(canonical_label)) AS c, md5('42:' || row_id) AS h FROM train_clean WHERE canonical_label IS NOT NULL)"


def _stratified(size: str, out: str) -> str:
    return f"""WITH x AS (SELECT * FROM {_LAB}), n AS (SELECT c, count(*) AS n, sum(count(*)) OVER ()::BIGINT AS t FROM x GROUP BY c), z AS (SELECT least({size}, max(t))::BIGINT AS s FROM n),
    q AS (SELECT c, s * n // t AS f, row_number() OVER (ORDER BY s * n % t DESC, c) AS k, s - sum(s * n // t) OVER () AS rest FROM n, z),
    r AS (SELECT row_id, c, row_number() OVER (PARTITION BY c ORDER BY h, row_id) AS r FROM x) SELECT row_id, {out} FROM r JOIN q USING (c)"""


@query(_stratified("500", "c AS canonical_label") + " WHERE r <= f + (k <= rest)::INT")
def x05_stratified_limit(spark, d):
    return S.stratified_limit(_with_label(spark, d), 500).select("row_id", "canonical_label")


@query(_stratified("ceil(max(t) * 0.15)", "CASE WHEN r <= f + (k <= rest)::INT THEN 'validation' ELSE 'train' END AS split"))
def x02_stratified_split(spark, d):
    return S.stratified_split(_with_label(spark, d), 0.15).select("row_id", "split")


@query(f"""WITH x AS (SELECT * FROM {_LAB}), r AS (SELECT row_id, c, row_number() OVER (PARTITION BY c ORDER BY h, row_id) AS r FROM x)
    SELECT row_id, c AS canonical_label FROM r WHERE r <= (SELECT 400 // count(DISTINCT c) FROM x) OR (SELECT count(*) FROM x) <= 400""")
def x04_balanced_sample(spark, d):
    return S.balanced_sample(_labelled(spark, d), 400).select("row_id", "canonical_label")


@query("""WITH g AS (SELECT DISTINCT coalesce(lower(trim(repository)), '') AS g FROM train_clean), r AS (SELECT g, row_number() OVER (ORDER BY md5('42:' || g), g) AS r FROM g)
    SELECT row_id, CASE WHEN r <= (SELECT ceil(count(*) * 0.15) FROM g) THEN 'validation' ELSE 'train' END AS split FROM train_clean JOIN r ON g = coalesce(lower(trim(repository)), '')""")
def x01_group_split(spark, d):
    return S.group_split(_labelled(spark, d), 0.15).select("row_id", "split")


@query("SELECT row_id FROM (SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS r FROM train_clean) WHERE r <= (SELECT ceil(count(*) * 0.1) FROM train_clean)")
def x09_holdout(spark, d):
    return S.holdout(t(spark, d, "train_clean").select("row_id"), 0.1)


_FOLDS = """g AS (SELECT lower(trim(project)) AS g, count(*) AS n FROM mandelbugs WHERE project IS NOT NULL GROUP BY 1), o AS (SELECT g, n, row_number() OVER (ORDER BY n DESC, md5(g), g) AS i FROM g),
    f AS (SELECT 0::BIGINT AS i, [0, 0, 0, 0, 0]::BIGINT[] AS loads, NULL::VARCHAR AS project, NULL::BIGINT AS n, 0::BIGINT AS fold
    UNION ALL SELECT o.i, list_transform(range(1, 6), lambda j: loads[j] + CASE WHEN j = list_position(loads, list_min(loads)) THEN o.n ELSE 0 END), o.g, o.n, list_position(loads, list_min(loads)) - 1 FROM f JOIN o ON o.i = f.i + 1)"""


@query(f"WITH RECURSIVE {_FOLDS} SELECT project, fold::INT AS fold, n FROM f WHERE i > 0")
def x08_group_kfold(spark, d):
    return S.group_folds(t(spark, d, "mandelbugs").select(F.lower(F.trim("project")).alias("project")))


@query(_stratified("700", "c AS canonical_label") + " WHERE r <= f + (k <= rest)::INT")
def x06_persisted_limit(spark, d):
    """The selection is written once and read back."""
    return S.persisted_limit(_with_label(spark, d), 700, f"{shared_dir(spark)}/selections", "train").select("row_id", "canonical_label")


@query(f"WITH RECURSIVE {_FOLDS} SELECT row_id, fold::INT AS fold FROM mandelbugs JOIN f ON f.project = lower(trim(mandelbugs.project)) WHERE i > 0")
def x08_cross_validation(spark, d):
    """Every row with the fold that it validates in."""
    m = t(spark, d, "mandelbugs").select("row_id", F.lower(F.trim("project")).alias("project"))
    return D.union_outer(*[v.select("row_id", F.lit(i).alias("fold")) for i, (_, v) in enumerate(S.cross_validation(m))])


@query("SELECT row_id FROM train_clean ORDER BY md5('42:' || row_id), row_id LIMIT 250")
def x10_plain_sample(spark, d):
    return S.plain_sample(t(spark, d, "train_clean").select("row_id"), 250)


@query("SELECT row_id, CASE WHEN r <= (SELECT ceil(count(*) * 0.2) FROM mandelbugs) THEN 'validation' ELSE 'train' END AS split FROM (SELECT row_id, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS r FROM mandelbugs)")
def x02_plain_fallback(spark, d):
    """A class of one row: the split is plainly random, and no row is lost."""
    m = t(spark, d, "mandelbugs").select("row_id")
    least = m.agg(F.min("row_id").alias("m"))
    m = m.crossJoin(least).select("row_id", F.when(F.col("row_id") == F.col("m"), "ODD").otherwise("SAME").alias("canonical_label"))
    return S.stratified_split(m, 0.2).select("row_id", "split")


@query("SELECT issue_id, count(*) AS rows FROM test GROUP BY 1 HAVING count(*) > 1")
def v08_repeated_ids(spark, d):
    return S.repeated_ids(t(spark, d, "test"))


@query("SELECT issue_id FROM train_clean INTERSECT SELECT issue_id FROM validation_clean")
def v08_shared_ids(spark, d):
    return S.shared_between(t(spark, d, "train_clean"), t(spark, d, "validation_clean"))


@query("SELECT issue_id FROM test GROUP BY 1 HAVING count(*) > 1 ORDER BY 1 LIMIT 5")
def l03_first_offending_ids(spark, d):
    return S.repeated_ids(t(spark, d, "test")).orderBy("issue_id").limit(5).select("issue_id")


@query("SELECT row_id, title, canonical_label FROM train_clean ORDER BY row_id LIMIT 5")
def l04_head(spark, d):
    return t(spark, d, "train_clean").select("row_id", "title", "canonical_label").orderBy("row_id").limit(5)


@query("SELECT canonical_label, count(*) AS n FROM train_clean WHERE canonical_label IS NOT NULL GROUP BY 1 ORDER BY 1")
def l01_sorted_counts(spark, d):
    return D.sorted_class_counts(t(spark, d, "train_clean"))


@query("SELECT x FROM (SELECT canonical_label AS x FROM validation_predictions UNION SELECT prediction FROM validation_predictions) WHERE x IS NOT NULL ORDER BY 1")
def l02_label_union(spark, d):
    v = t(spark, d, "validation_predictions")
    return v.select(F.col("canonical_label").alias("x")).union(v.select("prediction")).filter("x IS NOT NULL").distinct().orderBy("x")


@query("SELECT upper(trim(canonical_label)) AS canonical_label, row_number() OVER (ORDER BY upper(trim(canonical_label))) - 1 AS code FROM train_clean WHERE canonical_label IS NOT NULL GROUP BY 1")
def txt14_sorted_codes(spark, d):
    return D.sorted_codes(_labelled(spark, d))


@query("SELECT c AS canonical_label, row_number() OVER (ORDER BY f) - 1 AS code FROM (SELECT upper(trim(canonical_label)) AS c, min(row_id) AS f FROM train_clean WHERE canonical_label IS NOT NULL GROUP BY 1)")
def txt15_first_seen_codes(spark, d):
    return D.first_seen_codes(_labelled(spark, d))


@query(f"SELECT row_id, 128::BIGINT AS width, 2 + least(126, len(list_filter(regexp_split_to_array(text, '{_CLASS}+'), lambda x: x <> ''))) AS used FROM train_clean")
def tok20_max_padding(spark, d):
    x = K.padded_to_max(t(spark, d, "train_clean").select("row_id", "text"), max_length=128)
    return x.select("row_id", F.size("input_ids").cast("bigint").alias("width"), F.aggregate("attention_mask", F.lit(0), lambda a, b: a + b).cast("bigint").alias("used"))


@query(f"""WITH c AS (SELECT upper(trim(canonical_label)) AS c, row_number() OVER (ORDER BY upper(trim(canonical_label))) - 1 AS k FROM train_clean WHERE canonical_label IS NOT NULL GROUP BY 1)
    SELECT row_id, 2 + least(254, len(list_filter(regexp_split_to_array(text, '{_CLASS}+'), lambda x: x <> ''))) AS tokens, k AS labels FROM train_clean JOIN c ON c = upper(trim(canonical_label)) WHERE text IS NOT NULL AND {_strip('text')} <> ''""")
def tok21_labelled_tokens(spark, d):
    x = t(spark, d, "train_clean").select("row_id", "text", F.upper(F.trim("canonical_label")).alias("canonical_label")).filter(F.col("canonical_label").isNotNull() & ~T.is_blank(F.col("text")))
    return K.tokenized(x, "row_id", K.label_codes(x)).select("row_id", F.size("input_ids").cast("bigint").alias("tokens"), F.col("labels").cast("bigint").alias("labels"))


@query("SELECT issue_id, repository, canonical_label, CASE row_id % 4 WHEN 0 THEN 'BUG' WHEN 1 THEN 'DOCUMENTATION' WHEN 2 THEN 'ENHANCEMENT' ELSE 'QUESTION' END AS prediction FROM validation_clean")
def k04_prediction_table(spark, d):
    """Predictions beside the columns kept of validation, without its text."""
    from issuequarry.plans.training import prediction_table

    v = t(spark, d, "validation_clean").select("row_id", "issue_id", "repository", "canonical_label", "text")
    scores = v.select("row_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i == F.col("row_id") % 4, F.lit(0.7)).otherwise(F.lit(0.1))).alias("scores"))
    return prediction_table(v.drop("text"), scores, ["BUG", "DOCUMENTATION", "ENHANCEMENT", "QUESTION"]).drop("row_id")


@query("SELECT 'train' AS split, row_id, canonical_label FROM train_clean UNION ALL SELECT 'validation', row_id, canonical_label FROM validation_clean")
def s11_load_inputs(spark, d):
    from issuequarry.plans.training import load_inputs

    a, b, _ = load_inputs(spark, f"{d}/train_clean.parquet", f"{d}/validation_clean.parquet")
    return a.select(F.lit("train").alias("split"), "row_id", "canonical_label").unionAll(b.select(F.lit("validation"), "row_id", "canonical_label"))


@query("""SELECT row_id, project, CASE WHEN r <= ceil(n * 0.1) THEN 'validation' ELSE 'train' END AS split FROM (SELECT row_id, project, row_number() OVER (ORDER BY md5('42:' || row_id), row_id) AS r, count(*) OVER () AS n
    FROM mandelbugs m WHERE NOT EXISTS (SELECT 1 FROM (SELECT project FROM mandelbugs WHERE canonical_label = 'NAM') h WHERE h.project = m.project))""")
def t13_pretraining_corpus(spark, d):
    """Projects held out, then a tenth for validation."""
    from issuequarry.plans.training import pretraining_corpus

    m = t(spark, d, "mandelbugs")
    a, b, _ = pretraining_corpus(m, m.filter("canonical_label = 'NAM'").select("project"), strict=True)
    return a.select("row_id", "project", F.lit("train").alias("split")).unionAll(b.select("row_id", "project", F.lit("validation")))


# --- text features


_GRAMS = r"""w AS (SELECT row_id, regexp_extract_all(lower(coalesce(title, '')), '[\p{L}\p{N}_]{2,}') AS w FROM train_clean),
    e AS (SELECT row_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM w), c AS (SELECT row_id, term, count(*) AS tf FROM e GROUP BY ALL),
    v AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM c GROUP BY term HAVING count(*) >= 3 AND count(*) <= 0.98 * (SELECT count(*) FROM train_clean) ORDER BY tf DESC, term LIMIT 2000)"""


@query(f"WITH {_GRAMS} SELECT term, df, tf FROM v")
def l05_vocabulary(spark, d):
    x = t(spark, d, "train_clean").select("row_id", "title")
    return X.vocabulary(X.term_counts(x, "row_id", X.word_terms(F.col("title"))), x.count(), 3, 0.98, 2000)


@query(f"""WITH {_GRAMS}, x AS (SELECT row_id, term, (1 + ln(c.tf)) * (ln((1.0 + (SELECT count(*) FROM train_clean)) / (1 + df)) + 1) AS w FROM c JOIN v USING (term))
    SELECT row_id, 'word' AS block, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight FROM x""")
def t02_tfidf_word(spark, d):
    return X.tfidf(t(spark, d, "train_clean").select("row_id", "title"), "row_id", "title", X.TfidfConfig(feature_mode="word", word_max_features=2000)).withColumn("weight", F.round("weight", 6))


_WHOLE = _GRAMS.replace("lower(coalesce(title, ''))", "lower(coalesce(text, ''))").replace("LIMIT 2000", "LIMIT 200000")
_CHARS = rf"""cw AS (SELECT row_id, unnest(list_filter(regexp_split_to_array(lower(coalesce(text, '')), '{_CLASS}+'), lambda x: x <> '')) AS w FROM train_clean), cm AS (SELECT row_id, ' ' || w || ' ' AS w, count(*) AS m FROM cw GROUP BY ALL),
    cg AS (SELECT row_id, m, unnest(list_concat(list_transform(range(1, greatest(length(w) - 3, 0) + 2), lambda i: substr(w, i, 3)), CASE WHEN length(w) >= 4 THEN list_transform(range(1, length(w) - 2), lambda i: substr(w, i, 4)) ELSE [] END,
    CASE WHEN length(w) >= 5 THEN list_transform(range(1, length(w) - 3), lambda i: substr(w, i, 5)) ELSE [] END)) AS term FROM cm), cc AS (SELECT row_id, term, sum(m)::BIGINT AS tf FROM cg GROUP BY ALL),
    cv AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS tf FROM cc GROUP BY term HAVING count(*) >= 5 AND count(*) <= 0.98 * (SELECT count(*) FROM train_clean) ORDER BY tf DESC, term LIMIT 150000)"""


def _weighted(block: str, counts: str, vocab: str) -> str:
    return f"""SELECT row_id, '{block}' AS block, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY row_id)), 6) AS weight
        FROM (SELECT row_id, term, (1 + ln(c.tf)) * (ln((1.0 + (SELECT count(*) FROM train_clean)) / (1 + df)) + 1) AS w FROM {counts} c JOIN {vocab} USING (term))"""


def _round6(c: str):
    """A weight to six places, halves up as in the SQL, without a decimal object a row."""
    return F.floor(F.col(c) * 1e6 + 0.5) / F.lit(1e6)


@query(f"WITH {_WHOLE} {_weighted('word', 'c', 'v')}")
def t02_tfidf_text(spark, d):
    """The word block of the model text at the operator's own limits."""
    return t02_tfidf_word_whole(spark, d).withColumn("weight", F.round("weight", 6))


@query(f"WITH {_CHARS} {_weighted('char', 'cc', 'cv')}")
def t03_tfidf_char(spark, d):
    """The character block of the model text at the operator's own limits."""
    return X.tfidf(t(spark, d, "train_clean").select("row_id", "text"), "row_id", "text", X.TfidfConfig(), ["char"]).withColumn("weight", _round6("weight"))


@query(f"WITH {_WHOLE}, {_CHARS} {_weighted('word', 'c', 'v')} UNION ALL {_weighted('char', 'cc', 'cv')}")
def t04_tfidf_text(spark, d):
    return t04_tfidf_union(spark, d).withColumn("weight", _round6("weight"))


@query(f"WITH {_WHOLE}, x AS (SELECT row_id FROM c JOIN v USING (term)) SELECT count(*) AS nnz, count(*) * 8 AS bytes FROM x")
def a17_matrix_audit(spark, d):
    """What an observation of the matrix sees while it is computed once."""
    from issuequarry.plans.models import audited

    m, seen = audited(t02_tfidf_word_whole(spark, d))
    m.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([(seen.get["nnz"], seen.get["bytes"])], "nnz long, bytes long")


@query(f"WITH {_WHOLE} SELECT term, df, tf FROM v")
def l05_vocabulary_whole(spark, d):
    """The vocabulary of the model text at the operator's own limits."""
    c, x = X.TfidfConfig(feature_mode="word"), t(spark, d, "train_clean").select("row_id", "text")
    return X.vocabulary(X.term_counts(x, "row_id", X.word_terms(F.col("text"), *c.word_ngram_range)), x.count(), c.word_min_df, c.word_max_df, c.word_max_features)


@query()
def t02_tfidf_word_whole(spark, d):
    return X.tfidf(t(spark, d, "train_clean").select("row_id", "text"), "row_id", "text", X.TfidfConfig(feature_mode="word"))


@query(f"WITH {_WHOLE} SELECT count(DISTINCT row_id) AS rows, count(*) AS nnz, count(*) * 8 + (count(DISTINCT row_id) + 1) * 4 AS bytes FROM c JOIN v USING (term)")
def a16_matrix_bytes_whole(spark, d):
    return X.matrix_bytes(t02_tfidf_word_whole(spark, d), "row_id")


@query()
def t04_tfidf_union(spark, d):
    return X.tfidf(t(spark, d, "train_clean").select("row_id", "text"), "row_id", "text", X.TfidfConfig())


@query(f"WITH {_GRAMS} SELECT count(DISTINCT row_id) AS rows, count(*) AS nnz, count(*) * 8 + (count(DISTINCT row_id) + 1) * 4 AS bytes FROM c JOIN v USING (term)")
def a16_matrix_bytes(spark, d):
    return X.matrix_bytes(X.tfidf(t(spark, d, "train_clean").select("row_id", "title"), "row_id", "title", X.TfidfConfig(feature_mode="word", word_max_features=2000)), "row_id")


@query("SELECT text, canonical_label FROM train_clean")
def s06_projected_scan(spark, d):
    return t(spark, d, "train_clean").select("text", "canonical_label")


def _parts(name: str, rows: str, suffix: str) -> str:
    return f"""SELECT CASE WHEN r <= (SELECT ceil(count(DISTINCT repository) * 0.15) FROM {rows}) THEN 'validation{suffix}' ELSE '{name}' END AS split, canon AS canonical_label
        FROM {rows} JOIN (SELECT repository, row_number() OVER (ORDER BY md5('42:' || repository), repository) AS r FROM (SELECT DISTINCT repository FROM {rows})) USING (repository)"""


@query(f"""WITH k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY row_id) AS n FROM {_issues('train_clean')}) WHERE n = 1), te AS (SELECT * FROM {_issues('test')}), c AS (SELECT * FROM k WHERE h NOT IN (SELECT h FROM te))
    SELECT split, canonical_label, count(*) AS rows FROM ({_parts('train_benchmark', 'k', '')} UNION ALL {_parts('train_clean', 'c', '_clean')} UNION ALL SELECT 'test', canon FROM te) GROUP BY ALL""")
def prepare_splits(spark, d):
    """Rows and labels of every split of the preparation plan over train_clean and test."""
    from issuequarry.plans.prepare import prepare_frames

    out, _ = prepare_frames(issues(spark, d, "train_clean"), issues(spark, d, "test"))
    return D.union_outer(*[x.select(F.lit(n).alias("split"), "canonical_label") for n, x in out.items()]).groupBy("split", "canonical_label").agg(F.count("*").alias("rows"))


@query()
def t05_linear_svm(spark, d):
    """Metrics on validation_clean of the linear classifier fitted on train_clean."""
    from issuequarry.plans.models import fit_linear, predict_linear

    x = lambda n: t(spark, d, n).select("row_id", "text", F.upper(F.trim("canonical_label")).alias("canonical_label")).filter("canonical_label IS NOT NULL")
    return M.summary(M.confusion(predict_linear(fit_linear(x("train_clean")), x("validation_clean")), "canonical_label", "prediction"))


@query("SELECT row_id, CASE WHEN contains(lower(text), 'expected') THEN 'BUG' ELSE 'QUESTION' END AS prediction FROM validation_clean")
def t07_batched_predict(spark, d):
    """A plug-in model, made once a task and fed in batches."""
    from issuequarry.plans.models import predict_in_batches

    class Rule:
        def predict(self, texts: list[str]) -> list[str]:
            return ["BUG" if "expected" in x.lower() else "QUESTION" for x in texts]

    return predict_in_batches(t(spark, d, "validation_clean").select("row_id", "text"), Rule).select("row_id", "prediction")


@query(f"SELECT row_id, CASE WHEN s1 <> 'BUG' THEN s1 WHEN s2 = 'BOH' THEN s2 ELSE s3 END AS final_label FROM {_STAGES}")
def t15_hierarchy(spark, d):
    """Three stages, each over the rows that the one before passes on."""
    from issuequarry.plans.models import hierarchy

    x = _stages(spark, d)
    return hierarchy(x, tuple(lambda f, c=c: f.withColumn("prediction", F.col(c)) for c in ("s1", "s2", "s3"))).select("row_id", "final_label")
