"""Queries: degree paragraphs, markdown, sentences, windows, spans,
records; token cost (B17, B18, C16, D6, D8, D9, D13, E4, E7, G1, H23-H29)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import degrees as DG
from quire.operators.metrics import token_cost
from quire.operators.sections import html_sections
from quire.plans import sqltext as S
from quire.plans.registry import register
from quire.sources.fixtures import fixture, with_fixtures

_SECS = "," + S.blocks_ctes("wiki_pages") + S.sections_ctes()
_ST = ",\nsn AS (SELECT page_id, title, sec_rank, k - 1 AS k, arr[k] AS s FROM (SELECT page_id, title, sec_rank, arr, " \
      "unnest(generate_series(1, len(arr))) AS k FROM (SELECT page_id, title, sec_rank, {split} AS arr FROM stext) a) b)"


def _secs(spark, sf_dir):
    return html_sections(fixture(spark, sf_dir, "wiki_pages"))


def _dedup_numbered(src: str, val: str) -> str:
    """Distinct values per section in first order, renumbered from 0."""
    return (f"SELECT page_id, title, sec_rank, CAST(row_number() OVER (PARTITION BY page_id, title, sec_rank ORDER BY k) - 1 AS INTEGER) AS n, "
            f"{val} FROM (SELECT *, row_number() OVER (PARTITION BY page_id, title, sec_rank, {val} ORDER BY k) AS r FROM {src}) z WHERE r = 1")


@register("degree_paragraphs", with_fixtures(
    _SECS + f"\nSELECT page_id, title, sec_rank, pos, text FROM secs WHERE {S.mentions('text')}", "wiki_pages"))
def degree_paragraphs(spark, sf_dir):
    """Paragraphs with strict degree wording."""
    return DG.degree_paragraphs(_secs(spark, sf_dir))


@register("degree_markdown", with_fixtures(_SECS + _ST.format(split=S.sentences("text")) + f""",
hits AS (SELECT * FROM secs WHERE {S.mentions('text')}),
bt AS (SELECT page_id, title, min({{'r': sec_rank, 'p': pos}}) AS fk,
              string_agg('- ' || text, chr(10) ORDER BY sec_rank, pos, text) AS items FROM hits GROUP BY page_id, title),
smd AS (SELECT page_id, string_agg(CASE WHEN title = '_lead_' THEN '# Lead' ELSE '## ' || title END || chr(10) || items || chr(10),
                                   chr(10) ORDER BY fk) AS strict_md FROM bt GROUP BY page_id),
ls AS (SELECT page_id, sec_rank, k, s FROM sn WHERE {S.mentions('s', 'loose')}),
ld AS (SELECT page_id, s, min({{'r': sec_rank, 'k': k}}) AS f FROM ls GROUP BY page_id, s),
lmd AS (SELECT page_id, '## Degree Mentions' || string_agg(chr(10) || '- ' || s, '' ORDER BY f) AS loose_md FROM ld GROUP BY page_id)
SELECT p.page_id, CASE WHEN NOT regexp_matches(p.source, '<[a-zA-Z][^>]*>') THEN 'NOT HTML'
                       WHEN s.strict_md IS NOT NULL THEN s.strict_md
                       ELSE coalesce(l.loose_md, '## Degree Mentions') END AS sentences
FROM wiki_pages p LEFT JOIN smd s USING (page_id) LEFT JOIN lmd l USING (page_id)""", "wiki_pages"))
def degree_markdown(spark, sf_dir):
    """J4 (C16/D9): markdown of strict hits per page, loose fallback."""
    return DG.degree_markdown(fixture(spark, sf_dir, "wiki_pages"))


def _tidy(x: str) -> str:
    x = f"regexp_replace({x}, '(?:\\[\\s*\\d+\\s*\\]\\s*)+', '', 'g')"
    x = f"regexp_replace({x}, '\\s+([,.])', '\\1', 'g')"
    return S.strip(f"regexp_replace({x}, '\\s{{2,}}', ' ', 'g')")


@register("degree_sentences", with_fixtures(
    _SECS + _ST.format(split=S.sentences(_tidy("text"))) +
    f"\nSELECT page_id, title, sec_rank, CAST(k AS INTEGER) AS k, s AS sentence FROM sn WHERE {S.mentions('s')}",
    "wiki_pages"))
def degree_sentences(spark, sf_dir):
    """Strict-hit sentences of cleaned section texts."""
    return DG.degree_sentences(_secs(spark, sf_dir))


@register("degree_windows", with_fixtures(
    _SECS + ",\nsa AS (SELECT page_id, title, sec_rank, " + S.sentences("text") + " AS arr FROM stext)" + f""",
hi AS (SELECT page_id, title, sec_rank, arr, k FROM (SELECT *, unnest(generate_series(1, len(arr))) AS k FROM sa) z
       WHERE {S.mentions('arr[k]')}),
ctx AS (SELECT page_id, title, sec_rank, k,
               {S.strip("array_to_string(list_slice(arr, greatest(k - 1, 1), least(k + 1, len(arr))), ' ')")} AS context FROM hi)
""" + _dedup_numbered("ctx", "context"), "wiki_pages"))
def degree_windows(spark, sf_dir):
    """+-1 sentence windows around strict hits, distinct in order."""
    return DG.degree_windows(_secs(spark, sf_dir), 1).withColumn("n", F.col("n").cast("int"))


def _spans_sql(chars: int) -> str:
    from quire.functions.degrees import STRICT
    safe = S.word_safe("text")
    return f""",
sp AS (SELECT page_id, title, sec_rank, text, string_split_regex({safe}, {S.q(STRICT)}) AS pieces,
              regexp_extract_all({safe}, {S.q(STRICT)}, 0) AS found FROM stext),
sk AS (SELECT *, unnest(generate_series(1, len(found))) AS k FROM sp WHERE len(found) > 0),
so AS (SELECT page_id, title, sec_rank, text, k,
              CAST(list_sum(list_transform(list_slice(pieces, 1, k), lambda p: length(p)))
              + coalesce(list_sum(list_transform(list_slice(found, 1, k - 1), lambda m: length(m))), 0) AS BIGINT) AS st,
              CAST(length(found[k]) AS BIGINT) AS ml FROM sk),
ctx AS (SELECT page_id, title, sec_rank, k,
               {S.strip(f"substring(text, greatest(st - {chars}, 0) + 1, least(st + ml + {chars}, length(text)) - greatest(st - {chars}, 0))")} AS span
        FROM so)
""" + _dedup_numbered("ctx", "span")


@register("degree_spans", with_fixtures(_SECS + _spans_sql(100), "wiki_pages"))
def degree_spans(spark, sf_dir):
    """Strict matches +-100 characters, distinct in order."""
    return DG.degree_spans(_secs(spark, sf_dir), 100).withColumn("n", F.col("n").cast("int"))


@register("token_cost", with_fixtures("""
SELECT call_id, input_tokens, output_tokens,
       round(CAST(input_tokens AS DOUBLE) / 1e6 * 0.07 + CAST(output_tokens AS DOUBLE) / 1e6 * 1.10, 9) AS cost,
       round(sum(CAST(input_tokens AS DOUBLE) / 1e6 * 0.07 + CAST(output_tokens AS DOUBLE) / 1e6 * 1.10)
             OVER (ORDER BY call_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 9) AS total_cost
FROM usage""", "usage"))
def q_token_cost(spark, sf_dir):
    """Cost per call and running total (distributed prefix sum)."""
    out = token_cost(fixture(spark, sf_dir, "usage"), "call_id")
    return out.select("call_id", "input_tokens", "output_tokens", F.round("cost", 9).alias("cost"),
                      F.round("total_cost", 9).alias("total_cost"))


# The notebook's pattern without look-around, written apart: what stands before and after an abbreviation is
# matched as a character.  Enough to tell whether a sentence has one.
_BEFORE, _AFTER = r"(?:^|[^0-9A-Za-z_.])", r"(?:[\s.]|$)"
_NOTEBOOK = (r"(?i)" + "|".join([
    _BEFORE + r"B\.?(?:A|S|Sc|F\.A|B\.A|Phil)" + _AFTER,
    _BEFORE + r"M\.?(?:A|S|Sc|Res|Phil|F\.A|B\.A|Ed)" + _AFTER,
    _BEFORE + r"(?:Ph|J|M|Ed|Sc|D|LL)\.?D" + _AFTER,
    r"\bBachelor of (?:Arts|Science|Fine Arts|Philosophy|Laws)\b",
    r"\bMaster of (?:Arts|Science|Research|Philosophy|Education|Laws)\b",
    r"\bDoctor of (?:Philosophy|Science|Medicine|Engineering)\b", r"\bJuris Doctor\b", r"\bDr\.?\s*rer\.?\s*nat\b"]))


@register("degree_sentences_notebook", with_fixtures(
    _SECS + _ST.format(split=S.sentences(_tidy("text"))) +
    f"\nSELECT page_id, title, sec_rank, CAST(k AS INTEGER) AS k, s AS sentence FROM sn "
    f"WHERE regexp_matches({S.word_safe('s')}, {S.q(_NOTEBOOK)})", "wiki_pages"))
def degree_sentences_notebook(spark, sf_dir):
    """Sentences matching the notebook's alternative strict pattern
    (full degree names, look-around context)."""
    return DG.degree_sentences(_secs(spark, sf_dir), kind="notebook")
