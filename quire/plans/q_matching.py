"""Queries: fuzzy scores, match status, threshold sweep (H7, H8, I9,
B21, C13-C15, D5, F2) over ``query_names`` and ``gold_matches``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import matching as M
from quire.plans.jobs import matching_job
from quire.plans.registry import register
from quire.sources.fixtures import fixture, with_fixtures


def _cands(spark, sf_dir):
    return fixture(spark, sf_dir, "gold_matches").select("name", "rnk", "candidate_key", "description")


def _names(spark, sf_dir):
    return fixture(spark, sf_dir, "query_names")


def _mask(c: str, b: str) -> str:
    return (f"list_sum(list_transform(generate_series(1, length({b})), lambda jj: CASE WHEN substring({b}, jj, 1) = {c} "
            f"THEN CAST(1 AS BIGINT) << (jj - 1) ELSE CAST(0 AS BIGINT) END))")


def _lcs(a: str, b: str) -> str:
    """Bit-parallel LCS length (strings up to 62 characters)."""
    full = f"((CAST(1 AS BIGINT) << length({b})) - 1)"
    masks = f"list_transform(generate_series(1, length({a})), lambda ii: {_mask(f'substring({a}, ii, 1)', b)})"
    v = f"list_reduce({masks}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {full}, {full})"
    return f"(CASE WHEN length({a}) = 0 OR length({b}) = 0 THEN 0 ELSE length({b}) - bit_count({v}) END)"


def _ratio(a: str, b: str) -> str:
    return f"(CASE WHEN length({a}) + length({b}) = 0 THEN 100.0 ELSE 200.0 * {_lcs(a, b)} / (length({a}) + length({b})) END)"


_QK = "replace(replace(lower(n.name), ' ', '_'), '.', '')"
_CK = "replace(replace(lower(c.candidate_key), ' ', '_'), '.', '')"
_SCORED = f""",
sc AS (SELECT n.name, c.rnk, c.candidate_key, c.description, {_ratio(_QK, _CK)} AS score
       FROM (SELECT DISTINCT name FROM query_names) n JOIN gold_matches c ON c.name = n.name),
best AS (SELECT name, arg_max(score, {{'s': score, 'r': -rnk}}) AS score, arg_max(candidate_key, {{'s': score, 'r': -rnk}}) AS key,
                arg_min(description, rnk) AS first_description FROM sc GROUP BY name)"""


@register("fuzzy_scores", with_fixtures(
    _SCORED + "\nSELECT name, rnk, candidate_key, round(score, 6) AS score FROM sc", "query_names", "gold_matches"))
def q_fuzzy_scores(spark, sf_dir):
    """Fuzzy ratio of every (name, candidate) pair."""
    s = M.fuzzy_scores(_names(spark, sf_dir), _cands(spark, sf_dir))
    return s.select("name", "rnk", "candidate_key", F.round("score", 6).alias("score"))


@register("match_status", with_fixtures(_SCORED + """
SELECT n.name,
       CASE WHEN b.score IS NULL THEN 'NO_RESULTS'
            WHEN b.first_description = 'Topics referred to by the same term' THEN 'MULTIPLE_MATCHES'
            WHEN b.score < 50 THEN 'NO_MATCH' ELSE 'MATCHED' END AS status,
       CASE WHEN b.score IS NOT NULL AND b.first_description <> 'Topics referred to by the same term' AND b.score >= 50
            THEN b.key END AS key,
       round(b.score, 6) AS score
FROM (SELECT DISTINCT name FROM query_names) n LEFT JOIN best b USING (name)""", "query_names", "gold_matches"))
def q_match_status(spark, sf_dir):
    """Status and key per queried name (threshold 50)."""
    m = M.match_status(_names(spark, sf_dir), _cands(spark, sf_dir))
    return m.select("name", "status", "key", F.round("score", 6).alias("score"))


@register("threshold_sweep", with_fixtures(_SCORED + """,
g AS (SELECT name, string_split(regexp_replace(url, '[/\\n]+$', ''), '/')[-1] AS gold_key FROM query_names),
j AS (SELECT g.gold_key, b.score, b.key FROM g LEFT JOIN best b USING (name)),
x AS (SELECT j.*, t FROM j, (SELECT unnest(generate_series(10, 100, 5)) AS t) ts),
a AS (SELECT t, count_if(score >= t AND key = gold_key) AS tp, count_if(score >= t AND key <> gold_key) AS fp,
             count_if(score IS NULL OR score < t) AS fn FROM x GROUP BY t)
SELECT CAST(t AS INTEGER) AS t, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS precision,
       round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall
FROM a""", "query_names", "gold_matches"))
def q_threshold_sweep(spark, sf_dir):
    """Precision / recall at thresholds 10, 15, ..., 100."""
    s = M.threshold_sweep(_names(spark, sf_dir), _cands(spark, sf_dir))
    return s.select("t", "tp", "fp", "fn", F.round("precision", 6).alias("precision"),
                    F.round("recall", 6).alias("recall"))


@register("candidate_pages", with_fixtures("""
SELECT name, rnk, candidate_key, 'https://en.wikipedia.org/wiki/' || candidate_key AS url,
       CASE WHEN rnk = 2 OR description IS NULL THEN 'a Wikipedia article'
            WHEN description = 'Topics referred to by the same term' THEN 'Multiple matches' ELSE description END AS description,
       contains(lower(candidate_key), lower(string_split_regex(name, '\\s+')[1])) AS first_name_in_key
FROM gold_matches""", "gold_matches"))
def q_candidate_pages(spark, sf_dir):
    """Page URL per candidate key, default description for a
    missing one (second results carry none here), first-name check."""
    from quire.functions.fuzzy import description_or_default, first_name_in_key, page_url
    c = _cands(spark, sf_dir).withColumn(
        "description", F.when(F.col("rnk") != 2, F.col("description")))
    return c.select("name", "rnk", "candidate_key", page_url("candidate_key").alias("url"),
                    description_or_default("description").alias("description"),
                    first_name_in_key("name", "candidate_key").alias("first_name_in_key"))


@register("attached_pages", with_fixtures(_SCORED + """,
st AS (SELECT n.name, b.key, b.score,
              CASE WHEN b.score IS NULL THEN 'NO_RESULTS'
                   WHEN b.first_description = 'Topics referred to by the same term' THEN 'MULTIPLE_MATCHES'
                   WHEN b.score < 50 THEN 'NO_MATCH' ELSE 'MATCHED' END AS status
       FROM (SELECT DISTINCT name FROM query_names) n LEFT JOIN best b USING (name)),
pg AS (SELECT candidate_key AS key, 'page of ' || min(name) AS source FROM gold_matches WHERE rnk = 1 GROUP BY candidate_key)
SELECT st.name, st.status, CASE WHEN status = 'MATCHED' THEN st.key END AS key, pg.source
FROM st LEFT JOIN pg ON status = 'MATCHED' AND pg.key = st.key""", "query_names", "gold_matches"))
def q_attached_pages(spark, sf_dir):
    """Matched names with their page; other statuses pass through."""
    c = _cands(spark, sf_dir)
    pages = c.where("rnk = 1").groupBy(F.col("candidate_key").alias("key")).agg(F.concat(F.lit("page of "), F.min("name")).alias("source"))
    m, _ = matching_job(_names(spark, sf_dir), c, pages=pages)
    return m.select("name", "status", "key", "source")
