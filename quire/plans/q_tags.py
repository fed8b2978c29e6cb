"""Queries: tag star schema (G3, H6, B14, D1, C4, C5) over ``tag_source``."""

from __future__ import annotations

from quire.operators.tags import extract_tags
from quire.plans.registry import register
from quire.sources.fixtures import fixture, with_fixtures

def occ_ctes(src: str = "tag_source", p: str = "") -> str:
    """Tag-occurrence CTEs (prefixed names) over ``src``."""
    return f"""
{p}occ AS (
  SELECT id_articulo, i AS tag_pos,
         regexp_replace(arr[i], '^\\s+|\\s+$', '', 'g') AS tags
  FROM (SELECT id_articulo, arr, unnest(generate_series(1, len(arr))) AS i
        FROM (SELECT id_articulo,
                     string_split(concat_ws(';', coalesce(materia, ''), coalesce(lugar_articulo, ''),
                                            coalesce(personas, ''), replace(coalesce(empresa, ''), 'Nombre: ', '')), ';') AS arr
              FROM {src}) s) e
),
{p}valid AS (SELECT * FROM {p}occ WHERE tags <> '' AND lower(tags) <> 'nan'),
{p}dim AS (
  SELECT tags, row_number() OVER (ORDER BY fa, fp) - 1 AS id_tags
  FROM (SELECT tags, arg_min(id_articulo, struct_pack(a := id_articulo, p := tag_pos)) AS fa,
               arg_min(tag_pos, struct_pack(a := id_articulo, p := tag_pos)) AS fp
        FROM {p}valid GROUP BY tags) f
)"""


_OCC = occ_ctes()


def _tags(spark, sf_dir):
    return extract_tags(fixture(spark, sf_dir, "tag_source"))


@register("tag_dim", with_fixtures(
    "," + _OCC.strip() + "\nSELECT CAST(id_tags AS BIGINT) AS id_tags, tags FROM dim", "tag_source"))
def tag_dim(spark, sf_dir):
    """Tag dimension: distinct valid tags numbered in first-appearance order."""
    return _tags(spark, sf_dir).dim


@register("tag_links", with_fixtures(
    "," + _OCC.strip() + "\nSELECT v.id_articulo, CAST(d.id_tags AS BIGINT) AS id_tags FROM valid v JOIN dim d USING (tags)",
    "tag_source"))
def tag_links(spark, sf_dir):
    """Article/tag bridge; a tag repeated in one article gives repeated links."""
    return _tags(spark, sf_dir).links


@register("tagged_articles", with_fixtures(
    "," + _OCC.strip() + "\nSELECT * FROM tag_source t WHERE id_articulo IN (SELECT id_articulo FROM valid)",
    "tag_source"))
def tagged_articles(spark, sf_dir):
    """Articles holding at least one valid tag (semi join)."""
    return _tags(spark, sf_dir).articles
