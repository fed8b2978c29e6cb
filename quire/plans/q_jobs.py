"""Queries: end-to-end jobs (J1, J4, J5) and degree records (H28, H29,
A13, D10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.plans import jobs as J
from quire.plans.registry import ORACLE, register
from quire.sources.fixtures import fixture, with_fixtures


def _star(spark, sf_dir):
    return J.article_job(fixture(spark, sf_dir, "job_raw_articles"))


def _job_ctes() -> str:
    """The article job as CTEs over ``job_raw_articles`` (oracle side)."""
    from quire.plans.q_authors import final_ctes
    from quire.plans.q_dedup import _greedy, _pairs, docs_ctes
    from quire.plans.q_tags import occ_ctes as tag_occ
    from quire.plans.sqltext import coerce_ts
    ts = coerce_ts("fecha_de_publicacion")
    return """,
cl AS (SELECT coalesce(titulo, 'Unknown') AS titulo, autor, texto_completo, publicacion,
              """ + ts + """ AS fecha_de_publicacion, editorial, tipo_fuente,
              materia, lugar_articulo, personas, empresa,
              CAST(row_number() OVER (ORDER BY pos) - 1 AS BIGINT) AS id_articulo
       FROM job_raw_articles
       WHERE autor IS NOT NULL AND texto_completo IS NOT NULL AND publicacion IS NOT NULL
         AND """ + ts + """ IS NOT NULL AND editorial IS NOT NULL
         AND tipo_fuente IS NOT NULL AND idioma IS NOT NULL AND idioma = 'English')""" + final_ctes("cl", "a_") + """,
aa AS (SELECT * FROM cl WHERE id_articulo IN (SELECT id_articulo FROM a_occ)),
dsrc AS (SELECT id_articulo AS doc_id, texto_completo AS text FROM aa)""" + docs_ctes("dsrc", "d_") \
        + _pairs("d_dset", "(SELECT id, tokens FROM d_dsh)", "d_") + _greedy("d_dsh", "d_") + """,
kept AS (SELECT n.id FROM d_nodes n WHERE list_contains((SELECT kept FROM d_fin), n.id)),
dd AS (SELECT * FROM aa WHERE id_articulo IN (SELECT id FROM kept)),""" + tag_occ("dd", "t_")


def _job_articles_oracle() -> str:
    return with_fixtures(_job_ctes() + """
SELECT titulo, autor, publicacion, fecha_de_publicacion, editorial, tipo_fuente, materia, lugar_articulo,
       personas, empresa, id_articulo
FROM dd WHERE id_articulo IN (SELECT id_articulo FROM t_valid)""", "job_raw_articles", recursive=True)


def _job_counts_oracle() -> str:
    return with_fixtures(_job_ctes() + """
SELECT (SELECT count(*) FROM a_rawdim) AS raw_authors, (SELECT count(*) FROM a_fdim) AS final_authors,
       (SELECT count(*) FROM dd) AS kept_articles, (SELECT count(*) FROM aa) - (SELECT count(*) FROM dd) AS duplicate_articles,
       (SELECT count(*) FROM dd WHERE id_articulo IN (SELECT id_articulo FROM t_valid)) AS tagged_articles,
       (SELECT count(*) FROM t_dim) AS tags, (SELECT count(*) FROM t_valid) AS tag_links,
       (SELECT count(*) FROM a_valid) AS author_links""", "job_raw_articles", recursive=True)


def _job_lsh_oracle() -> str:
    from quire.plans.q_dedup import lsh_ctes
    body = _job_ctes()
    a, b = body.index("dsrc AS (") - 2, body.index("dd AS (")
    return with_fixtures(body[:a] + """,
dsrc AS (SELECT id_articulo AS doc_id, texto_completo AS text FROM aa),
""" + lsh_ctes("dsrc") + """,
kept AS (SELECT n.id FROM nodes n WHERE list_contains((SELECT kept FROM fin), n.id)),
""" + body[b:] + """
SELECT id_articulo, titulo FROM dd WHERE id_articulo IN (SELECT id_articulo FROM t_valid)""", "job_raw_articles", recursive=True)


DEGREE_PROMPT = "List the academic degrees that the text says its subject holds, as JSON."


def _degree_request_oracle() -> str:
    return ("SELECT 'd_' || id AS custom_id, 'List the academic degrees that the text says its subject holds, as JSON.' || chr(10) || sentences "
            "AS prompt FROM (" + _degree_text_oracle() + ") t WHERE sentences NOT IN ('', 'NOT HTML')")


def _degree_text_oracle() -> str:
    from quire.plans import q_degrees  # noqa: F401  (registers degree_markdown)
    return ("SELECT page_id AS id, 'Author ' || CAST(page_id AS VARCHAR) AS author_name, sentences FROM ("
            + ORACLE["degree_markdown"] + ") q")


@register("job_articles", _job_articles_oracle())
def job_articles(spark, sf_dir):
    """Cleaned, authored, de-duplicated, tagged articles - the whole
    article job (clean, dense ids, author split, shingle de-duplication,
    tags)."""
    return _star(spark, sf_dir).articles.drop("texto_completo")


@register("job_stage_counts", _job_counts_oracle())
def job_stage_counts(spark, sf_dir):
    """One row of stage counters of the article job."""
    return _star(spark, sf_dir).counts


_VALID_SQL = """,
parsed AS (SELECT id, author_name, degrees_json,
                  CASE WHEN json_valid(degrees_json) THEN json_extract(degrees_json, '$.studies') END AS st FROM degree_json),
elems AS (SELECT id, author_name, k, json_extract_string(st, '$[' || (k - 1) || '].degree_type') AS degree_type,
                 json_extract(st, '$[' || (k - 1) || '].degree_field') AS degree_field
          FROM (SELECT *, unnest(generate_series(1, CAST(json_array_length(st) AS BIGINT))) AS k FROM parsed WHERE st IS NOT NULL AND json_type(st) = 'ARRAY') x),
bad AS (SELECT DISTINCT id FROM elems WHERE degree_type IS NULL OR degree_field IS NULL
        UNION SELECT id FROM parsed WHERE st IS NULL OR json_type(st) <> 'ARRAY'),
valid AS (SELECT * FROM elems WHERE id NOT IN (SELECT id FROM bad))"""


@register("degree_records", with_fixtures(_VALID_SQL + """
SELECT id, author_name, CAST(k - 1 AS INTEGER) AS k, degree_type,
       array_to_string(CAST(degree_field AS VARCHAR[]), '; ') AS degree_field
FROM valid""", "degree_json"))
def degree_records(spark, sf_dir):
    """Validated degree records, one row per degree."""
    v = J.degree_profile_job(fixture(spark, sf_dir, "degree_json")).valid
    return v.select("id", "author_name", F.posexplode_outer("degrees").alias("k", "d")).where(F.col("d").isNotNull()).select(
        "id", "author_name", "k", F.col("d.degree_type").alias("degree_type"),
        F.array_join("d.degree_field", "; ").alias("degree_field"))


@register("degree_quarantine", with_fixtures(_VALID_SQL + """
SELECT p.id, p.author_name FROM parsed p WHERE p.id IN (SELECT id FROM bad)""", "degree_json"))
def degree_quarantine(spark, sf_dir):
    """Replies that do not decode into complete degree records."""
    return J.degree_profile_job(fixture(spark, sf_dir, "degree_json")).quarantine.select("id", "author_name")


@register("job_degree_text", _degree_text_oracle())
def job_degree_text(spark, sf_dir):
    """(id, author_name, sentences) degree markdown per author page."""
    p = fixture(spark, sf_dir, "wiki_pages").select(
        F.col("page_id").alias("id"), F.concat(F.lit("Author "), F.col("page_id").cast("string")).alias("author_name"),
        "source")
    return J.degree_text_job(p)


@register("saved_duplicates", _job_articles_oracle())
def saved_duplicates(spark, sf_dir):
    """The article job again with the duplicates that an earlier run
    saved instead of a search: the same articles."""
    from quire.operators.authors import author_occurrences
    from quire.session import scratch
    from quire.sources.writers import read_duplicates, save_duplicates
    raw, path = fixture(spark, sf_dir, "job_raw_articles"), scratch(spark, "duplicates")
    clean = J.numbered_articles(raw)
    authored = clean.join(author_occurrences(clean, "id_articulo", "autor").select("id_articulo"), "id_articulo", "left_semi")
    save_duplicates(J.duplicate_ids(authored), "id_articulo", path)
    return J.article_job(raw, known_duplicates=read_duplicates(spark, path)).articles.drop("texto_completo")


@register("job_lsh_articles", _job_lsh_oracle())
def job_lsh_articles(spark, sf_dir):
    """J1 with the MinHash LSH relation: ids of the articles that it keeps."""
    return J.article_job(fixture(spark, sf_dir, "job_raw_articles"), method="lsh").articles.select("id_articulo", "titulo")


@register("degree_requests", _degree_request_oracle())
def degree_requests(spark, sf_dir):
    """Requests for degree records from the degree text of author pages."""
    r = J.degree_request_job(job_degree_text(spark, sf_dir), DEGREE_PROMPT)
    return r.select("custom_id", F.get(F.col("body.messages"), 0)["content"].alias("prompt"))
