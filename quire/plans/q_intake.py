"""Queries: export dates, newest export, high-water mark, corpus
selection, streaming intake (A5, B24, D7, H30, K1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import intake as I
from quire.plans import sqltext as S
from quire.plans.registry import register
from quire.session import scratch
from quire.sources.fixtures import fixture, with_fixtures
from quire.streaming.intake import read_sink, start_intake

_PUB = ("try_strptime(nullif(" + S.strip("regexp_extract(value, 'Fecha de publicación: (.+)', 1)")
        + ", ''), '%b %d, %Y')::DATE")
_NEWEST = "(SELECT arg_max({{'event_id': event_id, 'mtime': mtime, 'value': value}}, {{'m': mtime, 'e': event_id}}) AS b FROM export_docs)"


def _exports(spark, sf_dir):
    return fixture(spark, sf_dir, "export_docs")


@register("export_dates", with_fixtures(f"SELECT event_id, {_PUB} AS pub_date FROM export_docs", "export_docs"))
def export_dates(spark, sf_dir):
    """Publication date of every export text."""
    return _exports(spark, sf_dir).select("event_id", I.publication_date("value").alias("pub_date"))


@register("newest_export", with_fixtures(
    "SELECT b.event_id AS event_id, b.mtime AS mtime, b.value AS value FROM " + _NEWEST.format(), "export_docs"))
def newest_export(spark, sf_dir):
    """The most recently modified export."""
    return I.newest_export(_exports(spark, sf_dir), "event_id")


@register("high_water_mark", with_fixtures(
    "SELECT event_id, mtime, " + _PUB + " AS start_date FROM (SELECT b.event_id AS event_id, b.mtime AS mtime, "
    "b.value AS value FROM " + _NEWEST.format() + ") n", "export_docs"))
def high_water_mark(spark, sf_dir):
    """K1/Q16: next inclusive start date from the newest export."""
    return I.high_water_mark(_exports(spark, sf_dir), "event_id")


@register("corpus_selection", with_fixtures(
    "SELECT * FROM selection_source WHERE publicacion IN (" + ", ".join(S.q(p) for p in I.PUBLICATIONS) + ")"
    " AND regexp_matches(texto_completo, '(?i)(^|[^\\p{L}\\p{N}])(opinion|op\\-ed|editorial)($|[^\\p{L}\\p{N}])')"
    " AND tipo_documento IN ('Commentary', 'Editorial', 'News') AND tipo_fuente = 'Newspapers' AND idioma = 'English'"
    " AND (fecha >= (SELECT " + _PUB + " FROM (SELECT b.value AS value FROM " + _NEWEST.format() + ") n)"
    " OR (SELECT " + _PUB + " FROM (SELECT b.value AS value FROM " + _NEWEST.format() + ") n) IS NULL)",
    "selection_source", "export_docs"))
def corpus_selection(spark, sf_dir):
    """Archive filters plus the inclusive high-water mark."""
    start = I.high_water_mark(_exports(spark, sf_dir), "event_id").first()["start_date"]
    return I.select_corpus_since(fixture(spark, sf_dir, "selection_source"), start, "fecha",
                                 publication="publicacion", text="texto_completo", doc_type="tipo_documento",
                                 source_type="tipo_fuente", language="idioma")


@register("stream_intake", with_fixtures(
    f"SELECT CAST(event_id AS VARCHAR) AS id, mtime, {_PUB} AS pub_date, event_id % 3 <> 0 AS is_late FROM export_docs", "export_docs"))
def stream_intake(spark, sf_dir):
    """K1: exports arrive in two parts, the second with every tenth export of the
    first again; each part is taken in by a run of the file stream
    (availableNow) with dates parsed.  The sink has every export once, in the
    batch of its first arrival."""
    base = scratch(spark, "intake")
    src = _exports(spark, sf_dir).select(F.col("event_id").cast("string").alias("event_id"), "mtime", "value")
    first, again = F.expr("cast(event_id AS BIGINT) % 3 = 0"), F.expr("cast(event_id AS BIGINT) % 10 = 0")
    for part in (src.where(first), src.where(~first | again)):
        part.write.mode("append").parquet(f"{base}/source")
        start_intake(spark, f"{base}/source", f"{base}/sink", f"{base}/checkpoint", fmt="parquet",
                     schema=src.schema, id_col="event_id").awaitTermination()
    sink = read_sink(spark, f"{base}/sink")
    return sink.select("id", "mtime", "pub_date", (F.col("batch") > 0).alias("is_late"))
