"""Derived inputs: driver tables reshaped into the schemas the operators take.

Each text below runs unchanged in Spark SQL and in DuckDB.  A stand-in input
only supplies rows of the right shape; the operators never rely on how the
rows were made.  The CASE branches only put a shape around the source text:
no row of a driver table is filtered away and no text is left out (but
``degree_json`` takes only the role of a turn, not its text).  A call
within a conversation is keyed by both padded numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.sources.tables import register_tables

FIXTURE_SQL: dict[str, str] = {
    # articles as exported by the news archive (schema of the raw CSV)
    "raw_articles": """
SELECT doc_id AS pos,
       CASE WHEN doc_id % 13 = 0 THEN NULL ELSE concat('Title ', CAST(doc_id AS STRING)) END AS titulo,
       CASE WHEN doc_id % 17 = 0 THEN NULL ELSE concat('Ann Author', CAST(doc_id % 9 AS STRING)) END AS autor,
       text AS texto_completo,
       source AS publicacion,
       CASE WHEN doc_id % 11 = 0 THEN 'not a date'
            ELSE concat('2020-01-', lpad(CAST(doc_id % 28 + 1 AS STRING), 2, '0')) END AS fecha_de_publicacion,
       CASE WHEN doc_id % 19 = 0 THEN NULL ELSE 'House' END AS editorial,
       'Newspapers' AS tipo_fuente,
       CASE lang WHEN 'en' THEN 'English' WHEN 'fr' THEN 'French' WHEN 'de' THEN 'German' ELSE 'Spanish' END AS idioma,
       'x' AS url, 'y' AS copyright
FROM documents""",
    # bylines in the shapes the author job meets
    "bylines": """
SELECT p_partkey AS id_articulo,
       CASE p_partkey % 8
         WHEN 0 THEN concat(f, ' ', l)
         WHEN 1 THEN concat(upper(l), ', ', upper(f))
         WHEN 2 THEN concat(l, ', ', f)
         WHEN 3 THEN concat(l, ', ', f, '; Jr')
         WHEN 4 THEN concat(upper(f), ' ', upper(l))
         WHEN 5 THEN concat(f, ' ', l, ' Editorial Staff')
         WHEN 6 THEN concat(f, ' ', l, ' and Kim Doe')
         ELSE concat('By ', f, ' ', l) END AS autor
FROM (SELECT p_partkey,
             concat(upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2)) AS f,
             concat(upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2)) AS l
      FROM part) t""",
    # distinct author spellings for the clustering step
    "author_names": """
SELECT min(p_partkey) AS pos, name
FROM (SELECT p_partkey,
             CASE p_partkey % 6 WHEN 0 THEN concat(p_name, ' jr') WHEN 1 THEN concat(p_name, '.')
                                WHEN 2 THEN replace(p_name, ' ', ' m ') ELSE p_name END AS name
      FROM part) t
GROUP BY name""",
    # the four tag columns of an article
    "tag_source": """
SELECT p_partkey AS id_articulo,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat(p_type, ';', lower(p_brand)) END AS materia,
       CASE WHEN p_partkey % 3 = 0 THEN 'nan' WHEN p_partkey % 3 = 1 THEN '' ELSE 'Bogota' END AS lugar_articulo,
       CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE concat(' ', p_name, ' ; ') END AS personas,
       CASE WHEN p_partkey % 10 = 0 OR p_partkey % 7 = 0 THEN NULL ELSE concat('Nombre: ', p_brand) END AS empresa
FROM part""",
    # completion texts holding numbered / bulleted lists (phase 1 answers)
    "list_responses": """
SELECT doc_id AS i, concat('c_', CAST(doc_id AS STRING)) AS custom_id,
       CASE WHEN doc_id % 9 = 0 THEN text ELSE concat('Intro line', chr(10), '1. ', replace(text, chr(10), concat(chr(10), '- '))) END AS content
FROM documents""",
    # completion texts holding Claim / Premises blocks (last phase answers)
    "argument_responses": """
SELECT conv_id AS i, turn AS j,
       CASE turn % 4
         WHEN 0 THEN concat('Claim: ', role, ' says: yes', chr(10), 'Premises: ignored', chr(10), '1. ', replace(text, chr(10), concat(chr(10), '- ')))
         WHEN 1 THEN concat('Premises:', chr(10), '- first', chr(10), 'Claim: late', chr(10), '2. ', text)
         WHEN 2 THEN concat('no structure here ', text)
         ELSE concat('Claim: a', chr(10), 'Claim: b', chr(10), 'Premises:', chr(10), '- p ', text) END AS content
FROM conversations""",
    # phase-2 completions of the direct job: premise lists per conclusion
    "premise_responses": """
SELECT concat(lpad(CAST(conv_id AS STRING), 19, '0'), '_', lpad(CAST(turn AS STRING), 10, '0')) AS line,
       concat('p_', CAST(conv_id AS STRING), '_', CAST(turn AS STRING)) AS custom_id,
       concat('1. ', replace(text, chr(10), concat(chr(10), '- '))) AS content
FROM conversations""",
    # phase-2 completions of the Socratic job: one answer per question
    "answer_responses": """
SELECT concat(lpad(CAST(conv_id AS STRING), 19, '0'), '_', lpad(CAST(turn AS STRING), 10, '0')) AS line,
       concat('qa_', CAST(conv_id AS STRING), '_', CAST(turn AS STRING)) AS custom_id,
       CASE WHEN turn % 5 = 4 THEN concat(' ', text, ' ') ELSE text END AS content
FROM conversations""",
    # raw batch-result lines; several lines share an id, some lack choices
    "response_json": """
SELECT concat(lpad(CAST(conv_id AS STRING), 19, '0'), '_', lpad(CAST(turn AS STRING), 10, '0')) AS line,
       CASE WHEN conv_id % 5 = 0 THEN to_json(named_struct('custom_id', concat('c_', CAST(conv_id AS STRING)),
                 'response', named_struct('body', named_struct('id', turn, 'note', text))))
            ELSE to_json(named_struct('custom_id', concat('c_', CAST(conv_id AS STRING)),
                 'response', named_struct('body', named_struct('choices', array(named_struct('message',
                     named_struct('content', concat(' ', text, ' ')))))))) END AS value
FROM conversations""",
    # encyclopedia pages: every page kept, markup varied by a CASE
    "wiki_pages": """
SELECT page_id,
       CASE page_id % 50
         WHEN 0 THEN replace(replace(html, '<', '('), '>', ')')
         WHEN 1 THEN concat('<body><div class="mw-parser-output"><p>Kim Doe holds a <b>Ph.D.</b>, awarded in 1990.</p><h2>Work</h2><p>Wrote books.</p>', html, '</div><p>Footer graduated.</p></body>')
         WHEN 2 THEN replace(html, '</article>', '<h2>Life &amp; work</h2><div class="reflist"><div>first &#91;1&#93;</div><ol class="references"><li>second</li></ol></div><p>Born in Bogot&aacute; &#91; 1 &#93; , he earned a B.A.&nbsp;in law.</p><table class="navbox"><tr><td><table><tr><td>inner</td></tr></table>PhD list</td></tr></table> A loose &amp;lt; tail.<p>She said &#x201C;MA&#x201d; &#150; no &unknown; name. He is a B.Sc. now. A.B.A. stays out. MAs too. One Ph.D, one JD. Master of Laws at last. LLD</p></article>')
         WHEN 3 THEN replace(html, '<article>', '<article><table class="infobox vcard"><tr><th>Career<td>Writer<tr><th>Works</th><td><table><tr><td>1990</td><td>One</td></tr><tr><th>Alma mater</th><td>Inner School</td></tr></table> and more</td></tr><tr><th>Education</th><td>Town College (<b>BA</b>); City &lsquo;School&rsquo;</td></tr></table>')
         ELSE replace(replace(html, '<article>', CASE WHEN page_id % 3 = 0
           THEN '<article><table class="infobox"><tr><th>Education</th><td>Town College (BA); City School (JD)</td></tr><tr><th>Born</th><td>1960</td></tr></table>'
           ELSE '<article>' END),
         '</article>', CASE page_id % 4
           WHEN 0 THEN '<h2>Early life</h2><p>He earned a B.A. in 1980. He then moved.</p><h3>Study</h3><p>She holds a Ph.D. in law.</p><h2>References</h2><p>Master list.</p></article>'
           WHEN 1 THEN '<h2>Career</h2><p>Worked as a writer [ 3 ] , then taught.</p><h2>Career</h2><p>She graduated late.</p></article>'
           WHEN 2 THEN '<h2>Notes</h2><p>Doctorate listed here.</p></article>'
           ELSE '<h2>Life</h2><p>Studied for a degree but left.</p></article>' END)
       END AS source
FROM pages""",
    # encyclopedia search results per queried author name, plus the gold URL
    "gold_matches": """
SELECT name, rnk, candidate_key, description,
       concat('https://example.org/wiki/', replace(name, ' ', '_'), '/') AS url
FROM (
  SELECT p_name AS name, 1 AS rnk, min(replace(p_name, ' ', '_')) AS candidate_key,
         CASE WHEN p_name LIKE 'blue%' THEN 'Topics referred to by the same term' ELSE 'a page' END AS description
  FROM part GROUP BY p_name
  UNION ALL
  SELECT p_name, 2, concat(min(p_brand), '_x'), 'a page' FROM part GROUP BY p_name
) t""",
    # every queried author name (names without any search result included)
    "query_names": """
SELECT min(p_partkey) AS id, p_name AS name,
       concat('https://example.org/wiki/', replace(p_name, ' ', '_'), '/') AS url
FROM part GROUP BY p_name
UNION ALL
SELECT -min(p_partkey), concat(p_name, ' unlisted'), concat('https://example.org/wiki/', replace(p_name, ' ', '_'), '/')
FROM part GROUP BY p_name""",
    # archive records with the fields the collection filters look at
    "selection_source": """
SELECT doc_id,
       CASE doc_id % 4 WHEN 0 THEN 'New York Times' WHEN 1 THEN 'Chicago Tribune'
                       WHEN 2 THEN 'Daily Planet' ELSE 'Boston Globe' END AS publicacion,
       CASE doc_id % 3 WHEN 0 THEN concat(text, ' An editorial view.') WHEN 1 THEN concat('Opinion: ', text)
                       ELSE text END AS texto_completo,
       CASE doc_id % 5 WHEN 0 THEN 'Blog' WHEN 1 THEN 'Editorial' WHEN 2 THEN 'News' ELSE 'Commentary' END AS tipo_documento,
       CASE WHEN doc_id % 7 = 0 THEN 'Blogs, Podcasts, & Websites' ELSE 'Newspapers' END AS tipo_fuente,
       CASE lang WHEN 'en' THEN 'English' ELSE 'Other' END AS idioma,
       DATE '2021-01-01' + CAST(doc_id % 180 AS INTEGER) AS fecha
FROM documents""",
    # raw article export for the whole article job (bylines and tags joined on)
    "job_raw_articles": """
SELECT d.doc_id AS pos,
       CASE WHEN d.doc_id % 13 = 0 THEN NULL ELSE concat('Title ', CAST(d.doc_id AS STRING)) END AS titulo,
       b.autor, d.text AS texto_completo, d.source AS publicacion,
       CASE WHEN d.doc_id % 11 = 0 THEN 'not a date'
            ELSE concat('2020-01-', lpad(CAST(d.doc_id % 28 + 1 AS STRING), 2, '0')) END AS fecha_de_publicacion,
       'House' AS editorial, 'Newspapers' AS tipo_fuente,
       CASE d.lang WHEN 'en' THEN 'English' ELSE 'Other' END AS idioma,
       t.materia, t.lugar_articulo, t.personas, t.empresa, 'x' AS url
FROM documents d
LEFT JOIN (SELECT p_partkey AS id_articulo,
                  CASE p_partkey % 3 WHEN 0 THEN concat(p_name, ' ', p_brand) WHEN 1 THEN concat(upper(p_name), ', ', p_type)
                                     ELSE concat(p_type, ', ', p_name) END AS autor
           FROM part) b ON b.id_articulo = d.doc_id
LEFT JOIN (SELECT p_partkey AS id_articulo, concat(p_type, ';', lower(p_brand)) AS materia,
                  CASE WHEN p_partkey % 3 = 0 THEN 'nan' ELSE 'Bogota' END AS lugar_articulo,
                  concat(' ', p_name, ' ; ') AS personas, concat('Nombre: ', p_brand) AS empresa FROM part) t
       ON t.id_articulo = d.doc_id""",
    # model replies with degree records, some incomplete or not JSON
    "degree_json": """
SELECT concat(lpad(CAST(conv_id AS STRING), 19, '0'), '_', lpad(CAST(turn AS STRING), 10, '0')) AS id, role AS author_name,
       CASE turn % 4
         WHEN 0 THEN concat('{"studies": [{"degree_type": "BA", "degree_field": ["', role, '", "Law"]}, ',
                            '{"degree_type": "PhD", "degree_field": ["History"]}]}')
         WHEN 1 THEN '{"studies": [{"degree_type": "NONE", "degree_field": []}]}'
         WHEN 2 THEN '{"studies": [{"degree_type": "PhD"}]}'
         ELSE 'not json at all' END AS degrees_json
FROM conversations""",
    # token usage per model call
    "usage": """
SELECT concat(lpad(CAST(conv_id AS STRING), 19, '0'), '_', lpad(CAST(turn AS STRING), 10, '0')) AS call_id,
       CAST(CASE WHEN role = 'assistant' THEN 0 ELSE length(text) END AS BIGINT) AS input_tokens,
       CAST(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END AS BIGINT) AS output_tokens
FROM conversations""",
    # downloaded export files: modification time and whole-file text
    "export_docs": """
SELECT event_id, ts AS mtime,
       concat('Title', chr(10), 'Fecha de publicación: ', CASE WHEN event_id % 10 = 0 THEN 'unknown' ELSE 'Mar 3, 2021' END, chr(10), 'body') AS value
FROM events""",
}


# The same inputs built with the oracle engine's own JSON functions.
ORACLE_FIXTURE_SQL: dict[str, str] = {
    "response_json": """
SELECT concat(lpad(CAST(conv_id AS STRING), 19, '0'), '_', lpad(CAST(turn AS STRING), 10, '0')) AS line,
       CASE WHEN conv_id % 5 = 0 THEN CAST(json_object('custom_id', concat('c_', CAST(conv_id AS STRING)),
                 'response', json_object('body', json_object('id', turn, 'note', text))) AS VARCHAR)
            ELSE CAST(json_object('custom_id', concat('c_', CAST(conv_id AS STRING)),
                 'response', json_object('body', json_object('choices', json_array(json_object('message',
                     json_object('content', concat(' ', text, ' '))))))) AS VARCHAR) END AS value
FROM conversations""",
}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Run one derived-input text over the driver tables of ``sf_dir``."""
    register_tables(spark, sf_dir)
    return spark.sql(FIXTURE_SQL[name])


def with_fixtures(sql: str, *names: str, recursive: bool = False) -> str:
    """Prefix an oracle query with the derived inputs it reads, as CTEs."""
    ctes = ",\n".join(f"{n} AS ({ORACLE_FIXTURE_SQL.get(n, FIXTURE_SQL[n])})" for n in names)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{sql}"
