"""Queries of the training-data operators, and SQL where DuckDB can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from issuequarry.llm import lookalike, mixing, neardup, overlap, packing, quota_sample, splits, stuffing
from issuequarry.session import Scratch


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of train_clean rows that look the same in title and body and are stored differently."""
    df, cols = _t(spark, d, "train_clean"), ["title", "body"]
    return lookalike.same_look_pairs(lookalike.same_look_keys(df, cols, "row_id", lookalike.bigram_scores(df, cols)))


def p4_forms(spark: SparkSession, d: str) -> DataFrame:
    """row_id with the consistent title and body."""
    df, cols = _t(spark, d, "train_clean"), ["title", "body"]
    return lookalike.consistent_columns(df, cols, "row_id", lookalike.bigram_scores(df, cols))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    """Rows whose look is stored in more than one way, with their group and variant."""
    df, cols = _t(spark, d, "train_clean"), ["title", "body"]
    return lookalike.same_look_groups(lookalike.same_look_keys(df, cols, "row_id", lookalike.bigram_scores(df, cols)))


def _evals(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    return {x: _t(spark, d, x) for x in ("test", "validation_clean")}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of an evaluation row and a train_clean row of likeness 0.6 or more over runs of three words."""
    return overlap.split_overlaps(_evals(spark, d), _t(spark, d, "train_clean"), width=3, t=0.6)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps per evaluation split and repository, at five words and likeness 0.8."""
    ev = _evals(spark, d)
    return overlap.overlap_report(overlap.split_overlaps(ev, _t(spark, d, "train_clean")), ev)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of train_clean rows linked by likeness 0.6 or more over runs of three words."""
    return neardup.near_duplicate_groups(_t(spark, d, "train_clean"), width=3, t=0.6)


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """Groups at five words and likeness 0.8."""
    return neardup.near_duplicate_groups(_t(spark, d, "train_clean"))


def _draw(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return quota_sample.draw(_t(spark, d, "train_clean"), _t(spark, d, "sample_target"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of sample_target whose label has too few issues."""
    return _draw(spark, d)[1].filter("too_few").select("plan_name", "canonical_label")


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """The drawn issues of every plan."""
    return _draw(spark, d)[0]


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """What was wanted, there and drawn per plan and label."""
    return _draw(spark, d)[1]


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of clean repository names that must share a split."""
    return splits.linked_names(splits.entity_components(_t(spark, d, "train_clean"), Scratch(spark, "splits")))


def p2_components(spark: SparkSession, d: str) -> DataFrame:
    """Every linked repository name with the least name of its component."""
    return splits.entity_components(_t(spark, d, "train_clean"), Scratch(spark, "splits"))


def p2_split(spark: SparkSession, d: str) -> DataFrame:
    """The split of every train_clean row."""
    return splits.grouped_split(_t(spark, d, "train_clean"), _t(spark, d, "split_target"))


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached per split."""
    goal = _t(spark, d, "split_target")
    return splits.split_shares(splits.grouped_split(_t(spark, d, "train_clean"), goal), goal)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that must be split, per kind of container."""
    return packing.pack(_t(spark, d, "documents"), _t(spark, d, "container_kind")).filter("piece = 1").select("container_kind", "doc_id")


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    """Container and place of every piece."""
    return packing.pack(_t(spark, d, "documents"), _t(spark, d, "container_kind"))


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    """Containers used beside the lower bound."""
    kinds = _t(spark, d, "container_kind")
    return packing.fill_report(packing.pack(_t(spark, d, "documents"), kinds), kinds)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Rows of mix_target that cannot be met."""
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_target"))[1].filter("too_few").select("mix_name", "source")


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed documents in the order of virtual finish time."""
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_target"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached per mix and source."""
    return mixing.mix(_t(spark, d, "documents"), _t(spark, d, "mix_target"))[1]


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages that are mostly repeated keywords, lists of links or product tags."""
    return stuffing.label_pages(_t(spark, d, "documents")).filter("stuffed").select("doc_id")


def p8_labels(spark: SparkSession, d: str) -> DataFrame:
    """Words of every page under each label."""
    return stuffing.label_pages(_t(spark, d, "documents"))


_ALL = (
    p1_found, p1_sample, p1_report, p2_found, p2_components, p2_split, p2_shares, p3_found, p3_report, p4_found, p4_groups, p4_forms, p5_found, p5_groups,
    p6_found, p6_containers, p6_report, p7_found, p7_mix, p7_report, p8_found, p8_labels,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
_BARE = r"regexp_replace({}, '^[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+|[\s\x0b\x1c-\x1f\x{{85}}\p{{Z}}]+$', '', 'g')"
_PLACE = "('0x' || substr(md5({} || ':' || entity), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE"
_SPLIT = f"""
        WITH RECURSIVE raw AS (SELECT row_id, nullif(lower({_BARE.format("repository")}), '') AS r, CASE WHEN {_BARE.format("issue_id")} <> '' THEN issue_id END AS i FROM train_clean),
        e AS (SELECT DISTINCT r, i FROM raw WHERE r IS NOT NULL AND i IS NOT NULL), m AS (SELECT i FROM e GROUP BY i HAVING count(*) > 1),
        l AS (SELECT DISTINCT a.r AS x, b.r AS y FROM e a JOIN e b USING (i) SEMI JOIN m USING (i) WHERE a.r <> b.r),
        reach AS (SELECT x, y FROM l UNION SELECT p.x, l.y FROM reach p JOIN l ON p.y = l.x), comp AS (SELECT x AS r, least(x, min(y)) AS c FROM reach GROUP BY x),
        named AS (SELECT row_id, i, 'r:' || coalesce(c, r) AS entity FROM raw LEFT JOIN comp USING (r) WHERE r IS NOT NULL), of_issue AS (SELECT i, min(entity) AS e FROM named WHERE i IS NOT NULL GROUP BY i),
        ent AS (SELECT row_id, entity FROM named UNION ALL SELECT row_id, coalesce(e, 'i:' || i, 'n:' || row_id) FROM raw LEFT JOIN of_issue USING (i) WHERE r IS NULL),
        size AS (SELECT entity, count(*) AS m FROM ent GROUP BY 1), big AS (SELECT * FROM size WHERE m * 1000 > (SELECT sum(m) FROM size)),
        g AS (SELECT split_name AS s, target_share / (SELECT sum(target_share) FROM split_target) AS g, row_number() OVER (ORDER BY split_name) AS i FROM split_target),
        cuts AS (SELECT max(s) FILTER (i = 1) AS s1, max(s) FILTER (i = 2) AS s2, max(s) FILTER (i = 3) AS s3, 1.0::DOUBLE - max(g) FILTER (i = 3) AS t2, 1.0::DOUBLE - max(g) FILTER (i = 3) - max(g) FILTER (i = 2) AS t1 FROM g),
        salted AS (SELECT salt, m, CASE WHEN p < t1 THEN s1 WHEN p < t2 THEN s2 ELSE s3 END AS s FROM (SELECT salt, m, t1, t2, s1, s2, s3, {_PLACE.format("salt")} AS p FROM big, range(42, 298) z(salt), cuts)),
        got AS (SELECT z.salt, g.s, g.g, coalesce(sum(m), 0)::DOUBLE AS m FROM range(42, 298) z(salt) CROSS JOIN g LEFT JOIN salted ON salted.salt = z.salt AND salted.s = g.s GROUP BY ALL),
        far AS (SELECT salt, max(abs(m + ((SELECT sum(m) FROM size) - (SELECT coalesce(sum(m), 0) FROM big)) * g - (SELECT sum(m) FROM size) * g)) AS far FROM got GROUP BY 1), best AS (SELECT salt FROM far ORDER BY far, salt LIMIT 1)
        """
_MIX = """
        WITH s AS (SELECT doc_id AS d, lower(trim(source)) AS s, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+')) AS n FROM documents),
        t AS (SELECT mix_name, lower(trim(source)) AS s, source AS named, target_share, max_uses::BIGINT AS max_uses, total_tokens FROM mix_target),
        q AS (SELECT s, d, coalesce(n, 0)::BIGINT AS n, sum(coalesce(n, 0)) OVER (PARTITION BY s ORDER BY ('0x' || substr(md5('42:' || d), 1, 15))::BIGINT, d)::BIGINT AS upto FROM s WHERE s IN (SELECT s FROM t)), h AS (SELECT s, sum(n)::BIGINT AS n FROM q GROUP BY s),
        u AS (SELECT mix_name, q.s, d, use, q.n AS tokens, ((use - 1) * h.n + upto) / target_share AS finish, total_tokens, ((use - 1) * h.n + upto) / target_share - q.n / (2 * target_share) AS middle
            FROM q JOIN h USING (s) JOIN t USING (s), LATERAL (SELECT unnest(range(1, max_uses + 1)) AS use) WHERE target_share > 0 AND total_tokens > 0 AND h.n > 0),
        o AS (SELECT *, sum(tokens) OVER (PARTITION BY mix_name ORDER BY middle, s, d, use) AS upto FROM u), x AS (SELECT mix_name, s, d, use::BIGINT AS use, tokens, finish FROM o WHERE upto - tokens / 2 <= total_tokens)"""
ORACLE: dict[str, str] = {
    "p1_found": """
        WITH n AS (SELECT upper(trim(canonical_label)) AS c, count(DISTINCT issue_id) AS n FROM train_clean GROUP BY 1)
        SELECT plan_name, upper(trim(canonical_label)) AS canonical_label FROM sample_target t LEFT JOIN n ON n.c = upper(trim(t.canonical_label))
        WHERE coalesce(n, 0) < greatest(coalesce(min_rows, 0), target_share * sample_rows)""",
    "p1_report": """
        WITH RECURSIVE n AS (SELECT upper(trim(canonical_label)) AS c, count(DISTINCT issue_id) AS n FROM train_clean WHERE trim(canonical_label) <> '' GROUP BY 1),
        w AS (SELECT plan_name, upper(trim(t.canonical_label)) AS c, target_share, min_rows, sample_rows, coalesce(n, 0)::BIGINT AS a, coalesce(target_share, 0) AS s, least(coalesce(min_rows, 0), coalesce(n, 0)) AS m FROM sample_target t LEFT JOIN n ON n.c = upper(trim(t.canonical_label))),
        p AS (SELECT plan_name, list(c ORDER BY c) AS cs, list(s ORDER BY c) AS s, list(m ORDER BY c) AS m, list(a ORDER BY c) AS a, least(max(sample_rows), sum(a))::BIGINT AS size FROM w GROUP BY 1),
        d AS (SELECT *, list_min(list_filter(list_transform(range(0, 61), lambda j: 2.0 ** j), lambda f: list_sum(list_transform(range(1, len(s) + 1), lambda k: least(a[k], greatest(m[k], f * s[k])))) >= size - 1e-9 OR f >= 1e18)) AS top FROM p),
        b AS (SELECT plan_name, 0.0::DOUBLE AS lo, top::DOUBLE AS hi, 0 AS i FROM d
            UNION ALL SELECT b.plan_name, CASE WHEN t < size THEN (lo + hi) / 2 ELSE lo END, CASE WHEN t < size THEN hi ELSE (lo + hi) / 2 END, i + 1
            FROM (SELECT b.*, d.size, list_sum(list_transform(range(1, len(d.s) + 1), lambda k: least(d.a[k], greatest(d.m[k], (b.lo + b.hi) / 2 * d.s[k])))) AS t FROM b JOIN d USING (plan_name) WHERE i < 200) b),
        v AS (SELECT d.*, CASE WHEN list_sum(m) >= size THEN list_transform(m, lambda x: x * size / list_sum(m)) ELSE list_transform(range(1, len(s) + 1), lambda k: least(a[k], greatest(m[k], hi * s[k]))) END AS want FROM d JOIN b USING (plan_name) WHERE i = 200),
        x AS (SELECT plan_name, size, unnest(cs) AS c, unnest(want)::DOUBLE AS want, unnest(a) AS a FROM v), q AS (SELECT *, floor(want + 1e-9)::BIGINT AS q FROM x),
        e AS (SELECT *, size - sum(q) OVER (PARTITION BY plan_name) AS lack, q < a AND want - q > 1e-9 AS can FROM q),
        r AS (SELECT plan_name, c, q + CASE WHEN can AND row_number() OVER (PARTITION BY plan_name, can ORDER BY q - want, c) <= lack THEN 1 ELSE 0 END AS drawn FROM e),
        o AS (SELECT w.*, greatest(coalesce(min_rows, 0), s * coalesce(sample_rows, 0))::DOUBLE AS wanted, drawn FROM w JOIN r USING (plan_name, c))
        SELECT plan_name, c AS canonical_label, target_share, min_rows, sample_rows, wanted, a AS available, drawn::BIGINT AS drawn, a < wanted AS too_few, drawn::DOUBLE / sum(drawn) OVER (PARTITION BY plan_name) AS reached_share, drawn > ceil(wanted) AS over_target FROM o""",
    "p2_components": _SPLIT + "SELECT r AS node, c AS component FROM comp",
    "p2_split": _SPLIT + "SELECT row_id, entity, CASE WHEN p < t1 THEN s1 WHEN p < t2 THEN s2 ELSE s3 END AS split_name FROM (SELECT row_id, entity, t1, t2, s1, s2, s3, " + _PLACE.format("(SELECT salt FROM best)") + " AS p FROM ent, cuts)",
    "p2_shares": _SPLIT + """, o AS (SELECT entity, CASE WHEN p < t1 THEN s1 WHEN p < t2 THEN s2 ELSE s3 END AS split_name FROM (SELECT entity, t1, t2, s1, s2, s3, """ + _PLACE.format("(SELECT salt FROM best)") + """ AS p FROM ent, cuts))
        SELECT t.split_name, target_share, count(entity) AS rows, count(DISTINCT entity) AS entities, count(entity) / (SELECT count(*) FROM o)::DOUBLE AS share FROM split_target t LEFT JOIN o USING (split_name) GROUP BY ALL""",
    "p2_found": """
        WITH RECURSIVE e AS (
            SELECT DISTINCT lower(trim(repository)) AS r, issue_id AS i FROM train_clean WHERE trim(repository) <> '' AND trim(issue_id) <> ''),
        m AS (SELECT i FROM e GROUP BY i HAVING count(*) > 1),
        l AS (SELECT DISTINCT a.r AS x, b.r AS y FROM e a JOIN e b USING (i) SEMI JOIN m USING (i) WHERE a.r <> b.r),
        reach AS (SELECT x, y FROM l UNION SELECT p.x, l.y FROM reach p JOIN l ON p.y = l.x)
        SELECT DISTINCT x AS repository_a, y AS repository_b FROM reach WHERE x < y""",
    "p6_found": """
        WITH s AS (SELECT doc_id, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+')) AS n FROM documents)
        SELECT container_kind, doc_id FROM s, container_kind WHERE n > capacity_tokens""",
    "p7_mix": _MIX + " SELECT mix_name, s AS source, d AS doc_id, use, tokens, finish FROM x",
    "p7_report": _MIX + """, g AS (SELECT mix_name, s, sum(tokens)::BIGINT AS got, count(*) AS uses FROM x GROUP BY ALL)
        SELECT mix_name, named AS source, target_share, max_uses, total_tokens, target_share * total_tokens AS wanted_tokens, coalesce(h.n, 0) AS source_tokens, coalesce(got, 0) AS reached_tokens, coalesce(uses, 0) AS uses, coalesce(got, 0) / total_tokens AS share_of_budget,
        coalesce(got, 0) / sum(got) OVER (PARTITION BY mix_name) AS share_of_mix, coalesce(h.n, 0) * max_uses < target_share * total_tokens AS too_few, coalesce(got, 0) >= coalesce(h.n, 0) * max_uses AS ran_out FROM t LEFT JOIN h USING (s) LEFT JOIN g USING (mix_name, s)""",
    "p7_found": """
        WITH s AS (SELECT lower(trim(source)) AS s, len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s\\x0b\\x1c-\\x1f\\x{85}\\p{Z}]+')) AS n FROM documents),
        t AS (SELECT s, sum(n) AS n FROM s GROUP BY s)
        SELECT mix_name, source FROM mix_target m LEFT JOIN t ON t.s = lower(trim(m.source)) WHERE coalesce(n, 0) * max_uses < target_share * total_tokens""",
}
