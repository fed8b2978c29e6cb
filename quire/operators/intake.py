"""Incremental collection: export files, publication dates, high-water
mark, corpus selection (A5, B24, D7, H30, K1 batch side).

The browser automation of the reference is not rebuilt; its search filters
become a predicate over an article table and its "start from the newest
downloaded file" rule becomes a high-water mark over the export table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import col, py_strip

DATE_LINE = r"Fecha de publicación: (.+)"
DATE_FORMAT = "MMM d, yyyy"

# Publications of the archive search (exact names).
PUBLICATIONS = (
    "Star Tribune Blogs (Minneapolis, MN)", "Chicago Tribune (Online)", "New York Post", "Tampa Bay Times",
    "New York Times", "Newsday", "New York Times Book Review", "Boston Globe (Online)", "The Washington Post",
    "Star Tribune", "Boston Globe (pre-1997 Fulltext)", "WSJ : the Magazine from the Wall Street Journal",
    "USA Today (Online)", "Chicago Tribune Blogs (Chicago, IL)", "Washington Post    Blogs",
    "New York Times (Online)", "Boston Globe", "Los Angeles Times Blogs (Los Angeles, CA)", "USA TODAY",
    "Chicago Tribune (pre-1997 Fulltext)", "Los Angeles Times (Online)", "Wall Street Journal (Online)",
    "New York Times Magazine", "USA TODAY (pre-1997 Fulltext)", "Los Angeles Times (pre-1997 Fulltext)",
    "Chicago Tribune", "The Washington Post (Online)", "Los Angeles Times", "Wall Street Journal",
    "Tampa Bay Times (Online)", "The Washington Post (pre-1997 Fulltext)",
)
# Full-text terms, document types, source type, language.
OPINION_TERMS = ("opinion", "op-ed", "editorial")
DOC_TYPES = ("Commentary", "Editorial", "News")
SOURCE_TYPE = "Newspapers"
LANGUAGE = "English"


def publication_date(value) -> Column:
    """First ``Fecha de publicación: ...`` line parsed as ``MMM d, yyyy``
    (null when absent or unparsable)."""
    raw = py_strip(F.regexp_extract(col(value), DATE_LINE, 1))
    return F.try_to_date(F.when(raw != "", raw), DATE_FORMAT)


def newest_export(exports: DataFrame, id_col: str, mtime_col: str = "mtime") -> DataFrame:
    """The export with the latest modification time (id breaks ties).
    ``max_by`` is a partial aggregate: one candidate per task is shuffled."""
    cols = [c for c in exports.columns]
    best = exports.agg(F.max_by(F.struct(*cols), F.struct(F.col(mtime_col), F.col(id_col))).alias("_b"))
    return best.select(*[F.col(f"_b.{c}").alias(c) for c in cols])


def high_water_mark(exports: DataFrame, id_col: str, mtime_col: str = "mtime",
                    value_col: str = "value") -> DataFrame:
    """K1/Q16: (id, mtime, start_date) - the newest export's publication
    date is the next start date, inclusive; overlap is removed by id."""
    n = newest_export(exports.select(id_col, mtime_col, value_col), id_col, mtime_col)
    return n.select(id_col, mtime_col, publication_date(value_col).alias("start_date"))


def selection_predicate(publication: str = "publicacion", text: str = "texto_completo",
                        doc_type: str = "tipo_documento", source_type: str = "tipo_fuente",
                        language: str = "idioma", publications: Sequence[str] = PUBLICATIONS) -> Column:
    """B24 without the date bound: exact publication, opinion wording in
    the full text (whole words, case-insensitive), document type, source
    type and language."""
    words = "|".join(t.replace("-", r"\-") for t in OPINION_TERMS)
    return (F.col(publication).isin(list(publications))
            & F.col(text).rlike(rf"(?i)(^|[^\p{{L}}\p{{N}}])({words})($|[^\p{{L}}\p{{N}}])")
            & F.col(doc_type).isin(list(DOC_TYPES))
            & (F.col(source_type) == SOURCE_TYPE) & (F.col(language) == LANGUAGE))


def select_corpus_since(articles: DataFrame, start_date, date_col: str = "fecha", **cols) -> DataFrame:
    """The filtered corpus from ``start_date`` on (inclusive).  A null
    start (no dated export yet) means no lower bound."""
    pred = selection_predicate(**cols)
    if start_date is not None:
        pred = pred & (F.col(date_col) >= F.lit(start_date))
    return articles.where(pred)
