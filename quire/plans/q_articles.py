"""Queries: article cleaning, dense ids, row slice, corpus projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators.clean import clean_articles, select_corpus
from quire.operators.ids import dense_ids, row_slice
from quire.plans import sqltext as S
from quire.plans.registry import register
from quire.sources.fixtures import fixture, with_fixtures
from quire.sources.tables import table

_CLEAN_SQL = f"""
SELECT pos, coalesce(titulo, 'Unknown') AS titulo, autor, texto_completo, publicacion,
       {S.coerce_ts('fecha_de_publicacion')} AS fecha_de_publicacion, editorial, tipo_fuente
FROM raw_articles
WHERE autor IS NOT NULL AND texto_completo IS NOT NULL AND publicacion IS NOT NULL
  AND {S.coerce_ts('fecha_de_publicacion')} IS NOT NULL AND editorial IS NOT NULL
  AND tipo_fuente IS NOT NULL AND idioma IS NOT NULL AND idioma = 'English'"""


@register("clean_articles", with_fixtures(_CLEAN_SQL, "raw_articles"))
def q_clean_articles(spark, sf_dir):
    """Date coercion, default title, required fields, language, drops."""
    return clean_articles(fixture(spark, sf_dir, "raw_articles"))


@register("dense_ids", with_fixtures(
    f"SELECT c.*, CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS id_articulo FROM ({_CLEAN_SQL}) c",
    "raw_articles"))
def q_dense_ids(spark, sf_dir):
    """Cleaned articles numbered 0..n-1 in surviving row order."""
    return dense_ids(clean_articles(fixture(spark, sf_dir, "raw_articles")), "pos", "id_articulo")


@register("row_slice", """
SELECT doc_id AS article_id, text, doc_id AS pos, row_no
FROM (SELECT doc_id, text, CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS row_no FROM documents) d
WHERE row_no >= 25""")
def q_row_slice(spark, sf_dir):
    """The corpus from row 25 on (open-ended slice over dense row numbers)."""
    docs = table(spark, sf_dir, "documents").withColumn("pos", F.col("doc_id"))
    return row_slice(select_corpus(docs, "text", "doc_id"), "pos", start=25)


@register("corpus_projection", "SELECT doc_id AS article_id, text FROM documents")
def q_corpus_projection(spark, sf_dir):
    """Validated projection onto the canonical ``article_id, text``."""
    return select_corpus(table(spark, sf_dir, "documents"), "text", "doc_id")
