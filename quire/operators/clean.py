"""Article cleaning and corpus projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The cleaning step's required fields and dropped columns.
REQUIRED = ("autor", "texto_completo", "publicacion", "fecha_de_publicacion",
            "editorial", "tipo_fuente", "idioma")
DROPPED = ("resumen", "seccion", "lugar_publicacion", "idioma", "tipo_documento", "id_proQuest",
           "url", "copyright", "ultima_actualizacion", "anio_publicación",
           "pais_publicacion", "materia_publicacion")


# Date layouts accepted besides ISO (archive exports write
# "Mar 3, 2021"); anything else becomes null, like a coercing parser.
DATE_FORMATS = ("MMM d, yyyy", "MMMM d, yyyy", "M/d/yyyy", "yyyy/M/d")


def coerce_timestamp(c) -> F.Column:
    """B1: ISO timestamps/dates or one of ``DATE_FORMATS``; null otherwise.
    A text without a four-digit year (a time of day) is not a date."""
    x = F.col(c) if isinstance(c, str) else c
    x = x.cast("string")
    parsed = F.coalesce(F.try_to_timestamp(x), *[F.try_to_timestamp(x, F.lit(f)) for f in DATE_FORMATS])
    return F.when(x.rlike("[0-9]{4}"), parsed)


def clean_articles(df: DataFrame, required: Sequence[str] = REQUIRED, language: str = "English",
                   drop: Sequence[str] = DROPPED, date_col: str = "fecha_de_publicacion",
                   title_col: str = "titulo") -> DataFrame:
    """B1 unparsable dates -> null, B2 default title, B3 required fields,
    B4 exact language, B5 drop columns (missing names ignored)."""
    out = df.withColumn(date_col, coerce_timestamp(date_col))
    out = out.fillna({title_col: "Unknown"})
    out = out.dropna(subset=list(required))
    out = out.where(F.col("idioma") == F.lit(language))
    return out.drop(*drop)


def select_corpus(df: DataFrame, text_col: str, id_col: str | None = None) -> DataFrame:
    """B8 validate + project, B9 canonical names ``article_id``, ``text``.

    The text column is checked first, as in the reference."""
    if text_col not in df.columns:
        raise ValueError(f"Text column '{text_col}' not found in data. Available: {df.columns}")
    if id_col is not None and id_col not in df.columns:
        raise ValueError(f"ID column '{id_col}' not found in data. Available: {df.columns}")
    cols = [F.col(text_col).alias("text")]
    cols.insert(0, F.col(id_col).alias("article_id") if id_col else F.lit(None).cast("string").alias("article_id"))
    extra = [c for c in ("pos",) if c in df.columns and c not in (text_col, id_col)]
    return df.select(*cols, *extra)
