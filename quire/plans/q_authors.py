"""Queries: author entities over ``bylines``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.names import fix_caps, is_valid_author, needs_entity_model
from quire.functions.text import py_strip
from quire.operators.authors import extract_authors, standardise_authors, uninvert_occurrences
from quire.plans import sqltext as S
from quire.plans.registry import register
from quire.sources.fixtures import fixture, with_fixtures

def occ_ctes(src: str = "bylines", p: str = "") -> str:
    """Author-occurrence CTEs (prefixed names) over ``src(id_articulo, autor)``."""
    return f""",
{p}bl AS (SELECT id_articulo, {S.strip('autor')} AS b FROM {src}),
{p}simple AS (SELECT id_articulo,
                  list_transform(list_filter(list_transform(string_split(b, ';'), lambda p: {S.strip('p')}),
                                             lambda p: length(p) > 0), lambda p: {S.fixcaps('p')}) AS arr
           FROM {p}bl WHERE b IS NOT NULL AND b <> '' AND NOT {S.gate('b')}),
{p}occ AS (SELECT id_articulo, i - 1 AS name_pos, arr[i] AS autor
        FROM (SELECT id_articulo, arr, unnest(generate_series(1, len(arr))) AS i FROM {p}simple) x
        WHERE arr[i] IS NOT NULL AND {S.ntok('arr[i]')} > 1),
{p}rawdim AS (SELECT autor, CAST(row_number() OVER (ORDER BY id_articulo, name_pos) - 1 AS BIGINT) AS id_autor
           FROM (SELECT *, row_number() OVER (PARTITION BY autor ORDER BY id_articulo, name_pos) AS r FROM {p}occ) z
           WHERE r = 1),
{p}un AS (SELECT id_articulo, name_pos, autor, {S.uninvert('autor')} AS author_name FROM {p}occ)"""


_OCC = occ_ctes()

def final_ctes(src: str = "bylines", p: str = "") -> str:
    """Standardised-author CTEs: ``{p}valid`` occurrences and ``{p}fdim``."""
    return occ_ctes(src, p) + f""",
{p}nm0 AS (SELECT author_name AS name, min({{'a': id_articulo, 'p': name_pos}}) AS f FROM {p}un GROUP BY author_name),
{p}nm AS (SELECT CAST(row_number() OVER (ORDER BY f) - 1 AS BIGINT) AS id, name FROM {p}nm0),
{S.cluster_ctes(p + 'nm', 0.85, p + 'c_').strip()},
{p}mapped AS (SELECT u.id_articulo, u.name_pos, k.canonical AS autor FROM {p}un u JOIN {p}c_canon k ON u.author_name = k.name),
{p}valid AS (SELECT * FROM {p}mapped WHERE {S.valid_author('autor')}),
{p}fdim AS (SELECT autor, CAST(row_number() OVER (ORDER BY id_articulo, name_pos) - 1 AS BIGINT) AS id_autor
         FROM (SELECT *, row_number() OVER (PARTITION BY autor ORDER BY id_articulo, name_pos) AS r FROM {p}valid) z
         WHERE r = 1)"""


_FINAL = final_ctes()


def _bylines(spark, sf_dir):
    return fixture(spark, sf_dir, "bylines")


@register("byline_gate", with_fixtures(
    f"SELECT id_articulo, {S.gate(S.strip('autor'))} AS gated FROM bylines", "bylines"))
def byline_gate(spark, sf_dir):
    """Which bylines the entity model would have to read."""
    b = _bylines(spark, sf_dir)
    return b.select("id_articulo", needs_entity_model(py_strip("autor")).alias("gated"))


@register("fix_caps", with_fixtures(
    f"SELECT id_articulo, {S.fixcaps('autor')} AS fixed FROM bylines WHERE autor IS NOT NULL", "bylines"))
def q_fix_caps(spark, sf_dir):
    """H1: capitalise all-caps tokens of every byline."""
    b = _bylines(spark, sf_dir).where(F.col("autor").isNotNull())
    return b.select("id_articulo", fix_caps("autor").alias("fixed"))


@register("author_dim", with_fixtures(_OCC + "\nSELECT autor, id_autor FROM rawdim", "bylines"))
def author_dim(spark, sf_dir):
    """Raw author dimension in first-appearance order."""
    return extract_authors(_bylines(spark, sf_dir)).dim


@register("author_links", with_fixtures(
    _OCC + "\nSELECT o.id_articulo, d.id_autor FROM occ o JOIN rawdim d USING (autor)", "bylines"))
def author_links(spark, sf_dir):
    """article/author bridge (repeats kept)."""
    return extract_authors(_bylines(spark, sf_dir)).links


@register("authored_articles", with_fixtures(
    _OCC + "\nSELECT * FROM bylines WHERE id_articulo IN (SELECT id_articulo FROM occ)", "bylines"))
def authored_articles(spark, sf_dir):
    """Articles with at least one author (semi join)."""
    return extract_authors(_bylines(spark, sf_dir)).articles


@register("uninvert_names", with_fixtures(
    _OCC + "\nSELECT id_articulo, CAST(name_pos AS BIGINT) AS name_pos, autor, author_name FROM un", "bylines"))
def uninvert_names(spark, sf_dir):
    """H3/H4: ``Last, First; rest`` -> ``First Last rest`` per occurrence."""
    occ = extract_authors(_bylines(spark, sf_dir)).occurrences
    return uninvert_occurrences(occ).select("id_articulo", "name_pos", "autor", "author_name")


@register("valid_authors", with_fixtures(
    _OCC + f"\nSELECT DISTINCT author_name, {S.valid_author('author_name')} AS valid FROM un", "bylines"))
def valid_authors(spark, sf_dir):
    """Validity of every distinct standardised spelling."""
    occ = uninvert_occurrences(extract_authors(_bylines(spark, sf_dir)).occurrences)
    return occ.select("author_name").distinct().select("author_name", is_valid_author("author_name").alias("valid"))


@register("author_final_dim", with_fixtures(_FINAL + "\nSELECT autor, id_autor FROM fdim", "bylines",
                                            recursive=True))
def author_final_dim(spark, sf_dir):
    """Canonical, valid authors renumbered."""
    return standardise_authors(extract_authors(_bylines(spark, sf_dir)).occurrences)[0]


@register("author_final_links", with_fixtures(
    _FINAL + "\nSELECT v.id_articulo, d.id_autor FROM valid v JOIN fdim d USING (autor)", "bylines",
    recursive=True))
def author_final_links(spark, sf_dir):
    """article/final-author bridge."""
    return standardise_authors(extract_authors(_bylines(spark, sf_dir)).occurrences)[1]


@register("author_occurrence_rank", with_fixtures(
    _OCC + """
SELECT id_articulo, CAST(name_pos AS BIGINT) AS name_pos, autor,
       CAST(row_number() OVER (PARTITION BY autor ORDER BY id_articulo, name_pos) AS INTEGER) AS rank
FROM occ""", "bylines"))
def author_occurrence_rank(spark, sf_dir):
    """1-based occurrence rank of every author name, in article order
    (hot-key safe: a name can be numbered by many tasks)."""
    from quire.operators.ids import rank_in_group
    occ = extract_authors(_bylines(spark, sf_dir)).occurrences
    return rank_in_group(occ, "autor", ["id_articulo", "name_pos"]).select("id_articulo", "name_pos", "autor", "rank")


@register("author_first_occurrence", with_fixtures(
    _OCC + """
SELECT autor, id_articulo, CAST(name_pos AS BIGINT) AS name_pos
FROM (SELECT *, row_number() OVER (PARTITION BY autor ORDER BY id_articulo, name_pos) AS r FROM occ) z
WHERE r = 1""", "bylines"))
def author_first_occurrence(spark, sf_dir):
    """D3: the first occurrence of every author name (keep-first, not an
    arbitrary duplicate)."""
    from quire.operators.ids import keep_first
    occ = extract_authors(_bylines(spark, sf_dir)).occurrences
    return keep_first(occ, "autor", ["id_articulo", "name_pos"]).select("autor", "id_articulo", "name_pos")
