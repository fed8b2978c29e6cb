"""Queries: page blocks, sections, heading tree, section text, keywords,
infobox pairs (B15, B16, B19-B22, E1-E3, E8, G2, H19-H22) over ``wiki_pages``."""

from __future__ import annotations

from quire.operators import sections as SEC
from quire.plans import sqltext as S
from quire.plans.registry import register
from quire.sources.fixtures import fixture, with_fixtures

_BLOCKS = "," + S.blocks_ctes("wiki_pages")
_SECS = _BLOCKS + S.sections_ctes()


def _pages(spark, sf_dir):
    return fixture(spark, sf_dir, "wiki_pages")


@register("page_blocks", with_fixtures(_BLOCKS + "\nSELECT page_id, pos, kind, level, text FROM blocks", "wiki_pages"))
def page_blocks(spark, sf_dir):
    """Paragraph and heading blocks of every page, junk removed."""
    return SEC.html_blocks(_pages(spark, sf_dir)).drop("container")


@register("html_sections", with_fixtures(_SECS + "\nSELECT page_id, title, sec_rank, pos, text FROM secs", "wiki_pages"))
def html_sections(spark, sf_dir):
    """Lead, heading and infobox section paragraphs."""
    return SEC.html_sections(_pages(spark, sf_dir))


@register("heading_tree", with_fixtures(_BLOCKS + """,
hh AS (SELECT * FROM blocks WHERE kind = 'h')
SELECT a.page_id, a.pos, a.level, a.text AS title,
       (SELECT max(b.pos) FROM hh b WHERE b.page_id = a.page_id AND b.pos < a.pos AND b.level < a.level) AS parent_pos
FROM hh a""", "wiki_pages"))
def heading_tree(spark, sf_dir):
    """parent = nearest previous heading of a strictly lower level."""
    return SEC.heading_tree(_pages(spark, sf_dir))


@register("section_text", with_fixtures(_BLOCKS + """,
hh AS (SELECT page_id, pos, depth, text, CAST(substring(tag, 2, 1) AS INTEGER) AS level FROM allb WHERE tag LIKE 'h%'),
he AS (SELECT a.page_id, a.pos, a.level, a.text AS title,
              least(coalesce((SELECT min(b.pos) FROM hh b WHERE b.page_id = a.page_id AND b.pos > a.pos AND b.level <= a.level),
                             1099511627776),
                    coalesce((SELECT min(c.pos) FROM allb c WHERE c.page_id = a.page_id AND c.pos > a.pos AND c.depth < a.depth),
                             1099511627776)) AS h_end FROM hh a)
SELECT he.page_id, he.pos, he.level, he.title,
       coalesce(""" + S.strip("string_agg(b.text, ' ' ORDER BY b.pos)") + """, '') AS content
FROM he LEFT JOIN allb b ON b.page_id = he.page_id AND b.pos > he.pos AND b.pos < he.h_end
       AND (b.tag <> '' OR b.text <> '')
GROUP BY he.page_id, he.pos, he.level, he.title""", "wiki_pages"))
def section_text(spark, sf_dir):
    """Heading content up to the next same-or-higher heading."""
    return SEC.section_text(_pages(spark, sf_dir))


_KW_CASE = "CASE " + " ".join(f"WHEN contains(text, {S.q(k)}) THEN {S.q(k)}" for k in SEC.KEYWORDS) + " END"


@register("title_keywords", with_fixtures(_BLOCKS + f"""
SELECT page_id, pos, level, text AS title, {_KW_CASE} AS keyword
FROM blocks WHERE kind = 'h' AND ({_KW_CASE}) IS NOT NULL""", "wiki_pages"))
def title_keywords(spark, sf_dir):
    """Headings holding a keyword; first keyword in list order."""
    return SEC.title_keywords(_pages(spark, sf_dir))


@register("infobox_pairs", with_fixtures(_SECS + "\nSELECT page_id, rk AS row, key, value FROM ibox", "wiki_pages"))
def infobox_pairs(spark, sf_dir):
    """header/cell pairs of the first infobox table."""
    return SEC.infobox_pairs(_pages(spark, sf_dir))


@register("keyword_sections", with_fixtures(_BLOCKS + f""",
hh AS (SELECT page_id, pos, depth, text, CAST(substring(tag, 2, 1) AS INTEGER) AS level FROM allb WHERE tag LIKE 'h%'),
he AS (SELECT a.page_id, a.pos, a.level, a.text AS title,
              least(coalesce((SELECT min(b.pos) FROM hh b WHERE b.page_id = a.page_id AND b.pos > a.pos AND b.level <= a.level),
                             1099511627776),
                    coalesce((SELECT min(c.pos) FROM allb c WHERE c.page_id = a.page_id AND c.pos > a.pos AND c.depth < a.depth),
                             1099511627776)) AS h_end FROM hh a),
st AS (SELECT he.page_id, he.pos, he.level, he.title,
              coalesce(""" + S.strip("string_agg(b.text, ' ' ORDER BY b.pos)") + f""", '') AS content
       FROM he LEFT JOIN allb b ON b.page_id = he.page_id AND b.pos > he.pos AND b.pos < he.h_end
       AND (b.tag <> '' OR b.text <> '')
       GROUP BY he.page_id, he.pos, he.level, he.title)
SELECT page_id, pos, level, title, {_KW_CASE.replace('text', 'title')} AS keyword, content
FROM st WHERE ({_KW_CASE.replace('text', 'title')}) IS NOT NULL""", "wiki_pages"))
def keyword_sections(spark, sf_dir):
    """B19 + E3: text of every section whose heading holds a keyword (the
    first keyword in list order), nested subsections included."""
    from pyspark.sql import functions as F
    st = SEC.section_text(_pages(spark, sf_dir))
    k = st.withColumn("keyword", SEC.keyword_of("title"))
    return k.where(F.col("keyword").isNotNull()).select("page_id", "pos", "level", "title", "keyword", "content")
