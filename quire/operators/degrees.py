"""Degree text extraction and degree records (B17, B18, C16, D8, D9, D13,
E4, G1, H25, H26, H28, H29).

Everything downstream of ``html_sections`` is grouped per page (or per
section of a page): each group is bounded by one page's text.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import degrees as D
from quire.functions.html import is_html, strip_citations, tidy
from quire.functions.text import py_strip
from quire.operators.sections import LEAD, html_sections
from quire.session import materialize

NOT_HTML = "NOT HTML"
FALLBACK_HEADER = "## Degree Mentions"

DEGREE_SCHEMA = T.StructType([T.StructField("studies", T.ArrayType(T.StructType([
    T.StructField("degree_type", T.StringType()),
    T.StructField("degree_field", T.ArrayType(T.StringType())),
])))])


def degree_paragraphs(sections: DataFrame, kind: str = "strict") -> DataFrame:
    """Section paragraphs that mention a degree."""
    return sections.where(D.mentions("text", kind))


def section_texts(sections: DataFrame) -> DataFrame:
    """(page_id, title, sec_rank, text): one text per section instance, its
    paragraphs joined by a blank in block order."""
    g = sections.groupBy("page_id", "title", "sec_rank").agg(
        F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("_p"))
    return g.select("page_id", "title", "sec_rank",
                    F.array_join(F.transform("_p", lambda x: x["text"]), " ").alias("text"))


def degree_markdown(pages: DataFrame, id_col: str = "page_id", html_col: str = "source") -> DataFrame:
    """J4 (D9 + C16): (page_id, sentences) markdown per page.

    Strict hits grouped by section title (equal titles merge, first
    appearance order) -> ``# Lead`` / ``## title`` blocks; a page without
    strict hits gets its loose sentences (distinct, in order) under
    ``## Degree Mentions``; a non-HTML value gives ``NOT HTML``."""
    # both branches below read the sections: parse the HTML once and store it
    secs = materialize(html_sections(pages, id_col, html_col))
    hits = degree_paragraphs(secs)
    by_title = hits.groupBy("page_id", "title").agg(
        F.array_sort(F.collect_list(F.struct("sec_rank", "pos", "text"))).alias("_h"))
    block = F.concat(
        F.when(F.col("title") == LEAD, F.lit("# Lead")).otherwise(F.concat(F.lit("## "), "title")), F.lit("\n"),
        F.array_join(F.transform("_h", lambda x: F.concat(F.lit("- "), x["text"])), "\n"), F.lit("\n"))
    first = F.struct(F.col("_h")[0]["sec_rank"].alias("r"), F.col("_h")[0]["pos"].alias("p"))
    strict_md = (by_title.select("page_id", F.struct(first.alias("k"), block.alias("b")).alias("s"))
                 .groupBy("page_id").agg(F.array_sort(F.collect_list("s")).alias("_s"))
                 .select("page_id", F.array_join(F.transform("_s", lambda x: x["b"]), "\n").alias("strict_md")))
    sents = section_texts(secs).select("page_id", "sec_rank", F.posexplode_outer(D.sentences("text")).alias("k", "s"))
    loose = sents.where(D.mentions("s", "loose")).select("page_id", "sec_rank", "k", py_strip("s").alias("s"))
    loose_md = (loose.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("sec_rank", "k", "s"))).alias("_l"))
                .select("page_id", F.array_distinct(F.transform("_l", lambda x: x["s"])).alias("_d")))
    loose_md = loose_md.select("page_id", F.concat(F.lit(FALLBACK_HEADER), F.array_join(
        F.transform("_d", lambda s: F.concat(F.lit("\n- "), s)), "")).alias("loose_md"))
    base = pages.select(F.col(id_col).alias("page_id"), F.coalesce(is_html(F.col(html_col)), F.lit(False)).alias("_html"))
    out = base.join(strict_md, "page_id", "left").join(loose_md, "page_id", "left")
    md = (F.when(~F.col("_html"), F.lit(NOT_HTML))
           .when(F.col("strict_md").isNotNull(), F.col("strict_md"))
           .otherwise(F.coalesce("loose_md", F.lit(FALLBACK_HEADER))))
    return out.select("page_id", md.alias("sentences"))


def degree_sentences(sections: DataFrame, kind: str = "strict") -> DataFrame:
    """(page_id, title, sec_rank, k, sentence) - citations stripped
    (H23), punctuation tidied (H24), sentence split (H25), hits kept."""
    t = section_texts(sections)
    clean = tidy(strip_citations(F.col("text")))
    s = t.select("page_id", "title", "sec_rank", F.posexplode_outer(D.sentences(clean)).alias("k", "sentence"))
    return s.where(D.mentions("sentence", kind))


def degree_windows(sections: DataFrame, window: int = 1, kind: str = "strict") -> DataFrame:
    """(page_id, title, sec_rank, n, context) sentence windows per section."""
    t = section_texts(sections).select("page_id", "title", "sec_rank", D.sentences("text").alias("_s"))
    w = t.select("page_id", "title", "sec_rank",
                 F.posexplode_outer(D.sentence_windows("_s", window, kind)).alias("n", "context"))
    return w.where(F.col("context").isNotNull())


def degree_spans(sections: DataFrame, chars: int = 100, kind: str = "strict") -> DataFrame:
    """(page_id, title, sec_rank, n, span) character spans per section."""
    t = section_texts(sections).select("page_id", "title", "sec_rank", "text",
                                       D.word_safe("text").alias("_safe"))
    pat = D.PATTERNS[kind]
    t = t.select("page_id", "title", "sec_rank", "text", F.split("_safe", pat, -1).alias("_pieces"),
                 F.regexp_extract_all("_safe", F.lit(pat), 0).alias("_found"))
    s = t.select("page_id", "title", "sec_rank",
                 F.posexplode_outer(D.spans_from_parts("text", "_pieces", "_found", chars)).alias("n", "span"))
    return s.where(F.col("span").isNotNull())


class DegreeRecords(NamedTuple):
    valid: DataFrame       # id, author_name, degrees
    quarantine: DataFrame  # id, author_name, raw


def degree_records(df: DataFrame, json_col: str = "degrees_json", id_col: str = "id",
                   name_col: str = "author_name") -> DegreeRecords:
    """Decode the model's JSON into ``studies`` and shape
    ``id, author_name, degrees[]``.  Records whose JSON does not parse, or
    whose degrees lack a required field, go to the quarantine table.
    ``NONE`` as a degree type means no completed degree; it is kept."""
    parsed = df.select(F.col(id_col).alias("id"), F.col(name_col).alias("author_name"),
                       F.col(json_col).alias("raw"), F.from_json(F.col(json_col), DEGREE_SCHEMA).alias("_d"))
    studies = F.col("_d.studies")
    ok = (studies.isNotNull() & F.forall(studies, lambda s: s["degree_type"].isNotNull()
                                          & s["degree_field"].isNotNull()))
    ok = F.coalesce(ok, F.lit(False))
    valid = parsed.where(ok).select("id", "author_name", F.transform(studies, lambda s: F.struct(
        s["degree_type"].alias("degree_type"), s["degree_field"].alias("degree_field"))).alias("degrees"))
    bad = parsed.where(~ok).select("id", "author_name", "raw")
    return DegreeRecords(valid, bad)
