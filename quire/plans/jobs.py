"""End-to-end jobs J1-J7: compositions of the operators, DataFrame in,
DataFrames out.  Nothing is collected; sinks are distributed writes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators import arguments as A
from quire.operators.authors import author_occurrences, standardise_authors
from quire.operators.clean import clean_articles
from quire.operators.dedup import dedup_sets, embedding_tokens, lsh_keep_first, portable_shingles, shingle_sets
from quire.operators.degrees import degree_markdown, degree_records
from quire.operators.ids import dense_ids
from quire.operators.intake import high_water_mark, publication_date
from quire.operators.matching import attach_pages, match_status, threshold_sweep
from quire.operators.results import flatten_arguments, result_stats
from quire.operators.tags import extract_tags
from quire.session import stored, stored_counted


class ArticleStar(NamedTuple):
    articles: DataFrame    # cleaned, authored, de-duplicated, tagged articles
    authors: DataFrame     # autor, id_autor
    rel_authors: DataFrame  # id_articulo, id_autor
    tags: DataFrame        # id_tags, tags
    rel_tags: DataFrame    # id_articulo, id_tags
    counts: DataFrame      # D10: one row of stage counters


METHODS = ("shingles", "lsh", "embedding")


def duplicate_ids(articles: DataFrame, method: str = "shingles", threshold: float = 0.9, id_col: str = "id_articulo",
                  text_col: str = "texto_completo", embeddings: DataFrame | None = None) -> DataFrame:
    """(id_col): articles that repeat an earlier kept one.

    ``shingles``: exact Jaccard similarity of word shingles; ``lsh``: the
    MinHash LSH relation (64 hashes, 3 bands of 21 rows) over word shingles;
    ``embedding``: that relation over the float16 elements of ``embeddings``
    (id_col, embedding), the reference's own choice.  An article without an
    embedding is no duplicate."""
    if method == "shingles":
        kept = dedup_sets(shingle_sets(articles, id_col, text_col, 3), id_col, id_col, "tokens", threshold).kept
    elif method == "lsh":
        kept = lsh_keep_first(portable_shingles(articles, id_col, text_col, 3), id_col, id_col, "tokens")
    elif method == "embedding":
        if embeddings is None:
            raise ValueError("method 'embedding' needs a table of embeddings")
        sets = embeddings.join(articles.select(id_col), id_col, "left_semi").select(id_col, embedding_tokens("embedding").alias("tokens"))
        kept = lsh_keep_first(sets, id_col, id_col, "tokens")
    else:
        raise ValueError(f"unknown method {method!r}, expected one of {METHODS}")
    return kept.where(~F.col("kept")).select(F.col("id").alias(id_col))


def numbered_articles(raw: DataFrame, order_by: str = "pos") -> DataFrame:
    """Cleaned articles with their dense ids: ``raw`` is read and written once,
    and the ids join it where it is read."""
    return dense_ids(stored(clean_articles(raw)), order_by, "id_articulo").drop(order_by)


def _whole(clean: DataFrame, some: DataFrame) -> DataFrame:
    """The cleaned articles, texts included, that ``some`` holds."""
    return clean.join(some.select("id_articulo"), "id_articulo", "left_semi")


def article_job(raw: DataFrame, order_by: str = "pos", threshold: float = 0.9,
                enforce_fk: bool = False, extractor=None, method: str = "shingles",
                embeddings: DataFrame | None = None, known_duplicates: DataFrame | None = None) -> ArticleStar:
    """Clean -> dense ids -> authors -> standardised authors ->
    near-duplicate removal (keep-first) -> tags.

    ``method`` and ``embeddings`` choose the relation (``duplicate_ids``); saved
    duplicates (A14: ``known_duplicates``, a table of id_articulo) replace it.
    Every intermediate table is written once and read by all that follows; the
    counters (D10) are counted while it is written.  The texts are written once,
    as cleaned: later tables go without and meet them by id where they are read.

    Like the reference, author links are built before de-duplication and
    are not re-filtered afterwards (Q17) unless ``enforce_fk``."""
    clean = numbered_articles(raw, order_by)
    heads = stored(clean.drop("texto_completo"))
    occ = stored(author_occurrences(heads, "id_articulo", "autor", extractor))
    authored, n_authored = stored_counted(heads.join(occ.select("id_articulo"), "id_articulo", "left_semi"))  # C5
    dim, links = standardise_authors(occ)
    dim, n_final = stored_counted(dim)
    gone = known_duplicates if known_duplicates is not None else duplicate_ids(_whole(clean, authored), method, threshold, embeddings=embeddings)
    deduped, n_kept = stored_counted(authored.join(gone.select("id_articulo"), "id_articulo", "left_anti"))
    tg = extract_tags(deduped, "id_articulo")
    (articles, n_tagged), (tags, n_tags), (rel_tags, n_tag_links) = (stored_counted(x) for x in (tg.articles, tg.dim, tg.links))
    if enforce_fk:
        links = links.join(articles.select("id_articulo"), "id_articulo", "left_semi")
    links, n_links = stored_counted(links)
    numbers = {"raw_authors": occ.select("autor").distinct().count(), "final_authors": n_final, "kept_articles": n_kept,
               "duplicate_articles": n_authored - n_kept, "tagged_articles": n_tagged, "tags": n_tags,
               "tag_links": n_tag_links, "author_links": n_links}
    counts = raw.sparkSession.range(1).select(*[F.lit(n).cast("long").alias(k) for k, n in numbers.items()])
    return ArticleStar(_whole(clean, articles), dim, links, tags, rel_tags, counts)


class Arguments(NamedTuple):
    results: DataFrame
    flat: DataFrame
    stats: DataFrame


def socratic_job(articles: DataFrame, phase1: DataFrame, phase2: DataFrame, phase3: DataFrame,
                 mode: str = "reference") -> Arguments:
    """J2 (combine step): responses of the three phases -> results, flat
    rows, statistics.  The request tables are built by the ``*_requests``
    operators between the service calls."""
    r = A.socratic_results(articles, phase1, phase2, phase3, mode)
    return Arguments(r, flatten_arguments(r), result_stats(r))


def direct_job(articles: DataFrame, phase1: DataFrame, phase2: DataFrame, mode: str = "reference") -> Arguments:
    """J3 (combine step) for the two-phase direct pipeline."""
    r = A.direct_results(articles, phase1, phase2, mode)
    return Arguments(r, flatten_arguments(r), result_stats(r))


def degree_text_job(pages: DataFrame, id_col: str = "id", name_col: str = "author_name",
                    html_col: str = "source") -> DataFrame:
    """(id, author_name, sentences) markdown per page (A12 shape)."""
    md = degree_markdown(pages, id_col, html_col)
    return pages.select(F.col(id_col).alias("page_id"), F.col(name_col).alias("author_name")) \
                .join(md, "page_id").select(F.col("page_id").alias("id"), "author_name", "sentences")


def degree_request_job(parsed: DataFrame, prompt: str, model: str = A.DEFAULT_MODEL) -> DataFrame:
    """J5 (request step): one request ``d_<id>`` per author with degree text,
    the prompt followed by a new line and the text.  Pages that are no HTML and
    empty texts have nothing to ask."""
    asked = parsed.where(F.col("sentences").isNotNull() & ~F.col("sentences").isin("", "NOT HTML"))
    return A.build_requests(asked, F.concat_ws("_", F.lit("d"), F.col("id").cast("string")),
                            F.concat(F.lit(prompt + "\n"), F.col("sentences")), model)


def degree_profile_job(responses: DataFrame, json_col: str = "degrees_json"):
    """Model JSON per author -> (valid profiles, quarantine)."""
    return degree_records(responses, json_col)


def matching_job(names: DataFrame, candidates: DataFrame, gold: DataFrame | None = None,
                 threshold: float = 50, pages: DataFrame | None = None):
    """Match status per name, with the matched page's columns if ``pages``
    (key, ...) are given (B22: a status passes through without a page), plus the
    threshold sweep when a gold set is given."""
    m = match_status(names, candidates, "name", threshold)
    if pages is not None:
        m = attach_pages(m, pages)
    return m, (threshold_sweep(gold, candidates) if gold is not None else None)


def intake_job(exports: DataFrame, id_col: str):
    """J7 (batch side): dated exports and the next inclusive start date."""
    dated = exports.withColumn("pub_date", publication_date("value"))
    return dated, high_water_mark(exports, id_col)
