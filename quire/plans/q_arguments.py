"""Queries: batch request / response tables and argument results
(H9-H18, B23, B26, C7-C10, D4, E5, F1, F3, A7, A8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions.lists import list_items, parse_argument
from quire.operators import arguments as A
from quire.operators.ids import dense_ids
from quire.operators.results import flatten_arguments, result_stats
from quire.plans import sqltext as S
from quire.plans.registry import register
from quire.sources.fixtures import fixture, with_fixtures
from quire.sources.tables import table

# ------------------------------------------------------------ Spark inputs --


def _articles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("article_id"), "text")
    return dense_ids(docs, "article_id", "i")


def _phase(spark, sf_dir, name, prefix=None):
    r = fixture(spark, sf_dir, name)
    if name == "list_responses":
        r = r.select(F.col("i").alias("line"), "custom_id", "content")
    if name == "argument_responses":
        r = r.select(F.struct("i", "j").alias("line"),
                     F.concat_ws("_", F.lit("arg"), F.col("i").cast("string"), F.col("j").cast("string"))
                     .alias("custom_id"), "content")
    if prefix:
        r = r.withColumn("custom_id", F.regexp_replace("custom_id", "^c_", prefix + "_"))
    return r


def _direct(spark, sf_dir):
    return A.direct_results(_articles(spark, sf_dir), _phase(spark, sf_dir, "list_responses"),
                            _phase(spark, sf_dir, "premise_responses"))


def _socratic(spark, sf_dir):
    return A.socratic_results(_articles(spark, sf_dir), _phase(spark, sf_dir, "list_responses", "q"),
                              _phase(spark, sf_dir, "answer_responses"),
                              _phase(spark, sf_dir, "argument_responses"))


# ------------------------------------------------------------ oracle CTEs --

_ART = ",\nart AS (SELECT CAST(row_number() OVER (ORDER BY doc_id) - 1 AS BIGINT) AS i, doc_id AS article_id, text FROM documents)"


def _latest(src: str, prefix: str, two: bool) -> str:
    pat = f"^{prefix}_(\\d+)" + ("_(\\d+)$" if two else "$")
    j = f", CAST(regexp_extract(custom_id, '{pat}', 2) AS BIGINT) AS j" if two else ""
    return (f"(SELECT CAST(regexp_extract(custom_id, '{pat}', 1) AS BIGINT) AS i{j}, content FROM "
            f"(SELECT custom_id, arg_max(content, line) AS content FROM {src} WHERE content <> '' "
            f"GROUP BY custom_id) z WHERE regexp_matches(custom_id, '{pat}'))")


def _explode(src: str, keys: str, list_expr: str, name: str, pos: str = "j") -> str:
    return (f"(SELECT {keys}, k - 1 AS {pos}, arr[k] AS {name} FROM "
            f"(SELECT {keys}, arr, unnest(generate_series(1, len(arr))) AS k FROM "
            f"(SELECT {keys}, {list_expr} AS arr FROM {src}) a) b)")


_P1 = "(SELECT i AS line, custom_id, content FROM list_responses)"
_Q1 = "(SELECT i AS line, regexp_replace(custom_id, '^c_', 'q_') AS custom_id, content FROM list_responses)"
_P3 = ("(SELECT {'i': i, 'j': j} AS line, 'arg_' || CAST(i AS VARCHAR) || '_' || CAST(j AS VARCHAR) AS custom_id, "
       "content FROM argument_responses)")

_DIRECT = _ART + f""",
concl AS {_explode(_latest(_P1, 'c', False), 'i', S.list_items('content'), 'conclusion')},
prem AS (SELECT i, j, {S.list_items('content')} AS premises FROM {_latest('premise_responses', 'p', True)} x),
args AS (SELECT c.i, c.j, c.conclusion, coalesce(p.premises, []) AS premises FROM concl c LEFT JOIN prem p USING (i, j)),
per AS (SELECT i, count(*) AS n_args, sum(len(premises)) AS n_prem FROM args GROUP BY i),
res AS (SELECT a.i, a.article_id, a.text, coalesce(p.n_args, 0) > 0 AS success,
               CASE WHEN coalesce(p.n_args, 0) > 0 THEN NULL ELSE 'No arguments extracted' END AS error_message,
               CAST(coalesce(p.n_args, 0) AS INTEGER) AS n_conclusions, CAST(coalesce(p.n_args, 0) AS INTEGER) AS n_arguments,
               CAST(coalesce(p.n_prem, 0) AS BIGINT) AS n_premises
        FROM art a LEFT JOIN per p USING (i))"""

_ARG_LINES = f""",
al AS (SELECT i, j, k, {S.strip('arr[k]')} AS l FROM
       (SELECT i, j, arr, unnest(generate_series(1, len(arr))) AS k FROM
        (SELECT i, j, string_split(coalesce(content, ''), chr(10)) AS arr FROM argsrc) a) b),
ak AS (SELECT *, CASE WHEN starts_with(l, 'Claim:') THEN 'claim' WHEN starts_with(l, 'Premises:') THEN 'prem' END AS kind
       FROM al),
asec AS (SELECT *, last_value(kind IGNORE NULLS) OVER (PARTITION BY i, j ORDER BY k
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS section FROM ak),
aclaim AS (SELECT i, j, arg_max({S.strip("substring(l, instr(l, ':') + 1)")}, k) AS claim FROM asec WHERE kind = 'claim' GROUP BY i, j),
aprem AS (SELECT i, j, k, {S.item_of('l')} AS premise FROM asec
          WHERE kind IS NULL AND section = 'prem' AND length(l) > 0 AND regexp_matches(l, '^(\\p{{Nd}}|-)')),
aprem2 AS (SELECT i, j, count(*) AS premises_count, string_agg(premise, ' | ' ORDER BY k) AS premises_concatenated
           FROM aprem WHERE length(premise) > 0 GROUP BY i, j),
parsed AS (SELECT s.i, s.j, coalesce(c.claim, '') AS claim, CAST(coalesce(p.premises_count, 0) AS INTEGER) AS premises_count,
                  coalesce(p.premises_concatenated, '') AS premises_concatenated
           FROM (SELECT DISTINCT i, j FROM argsrc) s LEFT JOIN aclaim c USING (i, j) LEFT JOIN aprem2 p USING (i, j))"""

_SOCRATIC = _ART + f""",
qs AS {_explode(_latest(_Q1, 'q', False), 'i', S.list_items('content', 10), 'question')},
ans AS (SELECT i, j, content AS answer FROM {_latest('answer_responses', 'qa', True)} x),
argsrc AS (SELECT i, j, content FROM {_latest(_P3, 'arg', True)} x)""" + _ARG_LINES + """,
items AS (SELECT q.i, q.j, q.question, a.answer, p.claim, p.premises_count, p.premises_concatenated
          FROM qs q JOIN ans a USING (i, j) JOIN parsed p USING (i, j)),
nq AS (SELECT i, count(*) AS n_q FROM qs GROUP BY i),
ni AS (SELECT i, count(*) AS n_args, sum(premises_count) AS n_prem FROM items GROUP BY i),
res AS (SELECT a.i, a.article_id, a.text, coalesce(n.n_args, 0) > 0 AS success,
               CASE WHEN coalesce(n.n_args, 0) > 0 THEN NULL ELSE 'No arguments extracted' END AS error_message,
               CAST(coalesce(q.n_q, 0) AS INTEGER) AS n_questions, CAST(coalesce(n.n_args, 0) AS INTEGER) AS n_arguments,
               CAST(coalesce(n.n_prem, 0) AS BIGINT) AS n_premises
        FROM art a LEFT JOIN nq q USING (i) LEFT JOIN ni n USING (i))"""


def _sum_premises(arr):
    return F.aggregate(F.transform(arr, lambda a: F.size(a["premises"])), F.lit(0).cast("long"),
                       lambda acc, x: acc + x)


# ------------------------------------------------------------------ keys --

@register("list_items", with_fixtures(
    "SELECT custom_id, CAST(item_pos AS INTEGER) AS item_pos, item FROM " +
    _explode("list_responses", "custom_id", S.list_items("content"), "item", "item_pos"), "list_responses"))
def q_list_items(spark, sf_dir):
    """Items of numbered / bulleted lines, whole texts."""
    r = fixture(spark, sf_dir, "list_responses")
    x = r.select("custom_id", F.posexplode_outer(list_items("content")).alias("item_pos", "item"))
    return x.where(F.col("item").isNotNull())


@register("argument_parse", with_fixtures(
    ",\nargsrc AS (SELECT i, j, content FROM argument_responses)" + _ARG_LINES +
    "\nSELECT i, j, claim, premises_count, premises_concatenated FROM parsed", "argument_responses"))
def q_argument_parse(spark, sf_dir):
    """Claim + premises of Claim / Premises blocks."""
    r = fixture(spark, sf_dir, "argument_responses").select("i", "j", parse_argument("content").alias("a"))
    return r.select("i", "j", F.col("a.claim").alias("claim"),
                    F.size("a.premises").cast("int").alias("premises_count"),
                    F.array_join("a.premises", " | ").alias("premises_concatenated"))


@register("response_text", with_fixtures(
    "SELECT line, json_extract_string(value, '$.custom_id') AS custom_id, coalesce("
    + S.strip("json_extract_string(value, '$.response.body.choices[0].message.content')")
    + ", '') AS content FROM response_json", "response_json"))
def q_response_text(spark, sf_dir):
    """Result lines -> (line, custom_id, trimmed content or '')."""
    return A.parse_responses(fixture(spark, sf_dir, "response_json"))


@register("latest_responses", with_fixtures(
    "SELECT custom_id, arg_max(content, line) AS content FROM (SELECT line, json_extract_string(value, '$.custom_id') AS custom_id, coalesce("
    + S.strip("json_extract_string(value, '$.response.body.choices[0].message.content')")
    + ", '') AS content FROM response_json) r WHERE content <> '' GROUP BY custom_id", "response_json"))
def q_latest_responses(spark, sf_dir):
    """The last non-empty response per custom_id wins."""
    return A.latest_content(A.parse_responses(fixture(spark, sf_dir, "response_json")))


@register("llm_requests", with_fixtures(
    _ART + "\nSELECT 'c_' || CAST(i AS VARCHAR) AS custom_id, 'POST' AS method, '/v1/chat/completions' AS url, "
    "'gpt-4o-mini' AS model, CAST(0.1 AS DOUBLE) AS temperature, 'user' AS role, "
    + S.render(A.CONCLUSION_PROMPT, text="text") + " AS prompt FROM art", "list_responses"))
def q_llm_requests(spark, sf_dir):
    """Phase-1 batch requests, one per article (flattened body)."""
    req = A.direct_phase1_requests(_articles(spark, sf_dir))
    m = F.get(F.col("body.messages"), 0)
    return req.select("custom_id", "method", "url", F.col("body.model").alias("model"),
                      F.col("body.temperature").alias("temperature"), m["role"].alias("role"),
                      m["content"].alias("prompt"))


@register("premise_requests", with_fixtures(
    _ART + f""",
concl AS {_explode(_latest(_P1, 'c', False), 'i', S.list_items('content'), 'conclusion')}
SELECT 'p_' || CAST(c.i AS VARCHAR) || '_' || CAST(c.j AS VARCHAR) AS custom_id,
       {S.render(A.PREMISE_PROMPT, text='a.text', conclusion='c.conclusion')} AS prompt
FROM concl c JOIN art a USING (i)""", "list_responses"))
def q_premise_requests(spark, sf_dir):
    """Phase-2 fan-out, one request per parsed conclusion."""
    arts = _articles(spark, sf_dir)
    concl = A.direct_conclusions(_phase(spark, sf_dir, "list_responses"))
    req = A.direct_phase2_requests(arts, concl)
    return req.select("custom_id", F.get(F.col("body.messages"), 0)["content"].alias("prompt"))


@register("direct_results", with_fixtures(
    _DIRECT + "\nSELECT i, article_id, success, error_message, n_conclusions, n_arguments, n_premises FROM res",
    "list_responses", "premise_responses"))
def q_direct_results(spark, sf_dir):
    """Direct two-phase results per article."""
    r = _direct(spark, sf_dir)
    return r.select("i", "article_id", "success", "error_message",
                    F.size("conclusions").alias("n_conclusions"), F.size("arguments").alias("n_arguments"),
                    _sum_premises(F.col("arguments")).alias("n_premises"))


_FLAT_DIRECT = _DIRECT + """,
dnum AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY j) AS INTEGER) AS argument_index FROM args)
SELECT r.article_id, r.text, r.success, r.error_message, n.argument_index, '' AS question, '' AS answer,
       coalesce(n.conclusion, '') AS claim, CAST(coalesce(len(n.premises), 0) AS INTEGER) AS premises_count,
       coalesce(array_to_string(n.premises, ' | '), '') AS premises_concatenated,
       coalesce(n.premises[1], '') AS premise_1, coalesce(n.premises[2], '') AS premise_2, coalesce(n.premises[3], '') AS premise_3,
       coalesce(n.premises[4], '') AS premise_4, coalesce(n.premises[5], '') AS premise_5
FROM res r LEFT JOIN dnum n USING (i)"""


@register("direct_flat", with_fixtures(_FLAT_DIRECT, "list_responses", "premise_responses"))
def q_direct_flat(spark, sf_dir):
    """One CSV-ready row per conclusion with its premises."""
    return flatten_arguments(_direct(spark, sf_dir))


@register("csv_round_trip", with_fixtures(_FLAT_DIRECT, "list_responses", "premise_responses"))
def q_csv_round_trip(spark, sf_dir):
    """The flat rows written as CSV (quotes, line breaks and all) and read
    back; an empty field reads as empty text."""
    from quire.session import scratch
    from quire.sources.writers import write_results_csv
    flat, path = flatten_arguments(_direct(spark, sf_dir)), scratch(spark, "csv")
    if write_results_csv(flat, path) == 0:
        return flat
    back = (spark.read.schema(flat.schema).option("header", True).option("multiLine", True).option("escape", '"')
            .option("nullValue", "\u0000").option("emptyValue", "").csv(path))
    text = ("question", "answer", "claim", "premises_concatenated", *(f"premise_{k}" for k in range(1, 6)))
    return back.select(*[F.coalesce(c, F.lit("")).alias(c) if c in text else F.when(F.col(c) != "", F.col(c)).alias(c)
                         if c == "error_message" else c for c in flat.columns])


@register("socratic_results", with_fixtures(
    _SOCRATIC + "\nSELECT i, article_id, success, error_message, n_questions, n_arguments, n_premises FROM res",
    "list_responses", "answer_responses", "argument_responses"))
def q_socratic_results(spark, sf_dir):
    """Socratic three-phase results per article."""
    r = _socratic(spark, sf_dir)
    return r.select("i", "article_id", "success", "error_message",
                    F.size("questions").alias("n_questions"), F.size("arguments").alias("n_arguments"),
                    _sum_premises(F.col("arguments")).alias("n_premises"))


_FLAT_SOC = _SOCRATIC + """,
pitems AS (SELECT i.*, p.k, p.premise FROM items i LEFT JOIN (SELECT i, j, k, premise,
             row_number() OVER (PARTITION BY i, j ORDER BY k) AS pn FROM aprem WHERE length(premise) > 0) p
           ON p.i = i.i AND p.j = i.j AND p.pn <= 5),
wide AS (SELECT i, j, any_value(question) AS question, any_value(answer) AS answer, any_value(claim) AS claim,
                any_value(premises_count) AS premises_count, any_value(premises_concatenated) AS premises_concatenated,
                list(premise ORDER BY k) FILTER (WHERE premise IS NOT NULL) AS p5
         FROM pitems GROUP BY i, j),
numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY i ORDER BY j) AS INTEGER) AS argument_index FROM wide)
SELECT r.article_id, r.text, r.success, r.error_message, n.argument_index,
       coalesce(n.question, '') AS question, coalesce(n.answer, '') AS answer, coalesce(n.claim, '') AS claim,
       CAST(coalesce(n.premises_count, 0) AS INTEGER) AS premises_count,
       coalesce(n.premises_concatenated, '') AS premises_concatenated,
       coalesce(n.p5[1], '') AS premise_1, coalesce(n.p5[2], '') AS premise_2, coalesce(n.p5[3], '') AS premise_3,
       coalesce(n.p5[4], '') AS premise_4, coalesce(n.p5[5], '') AS premise_5
FROM res r LEFT JOIN numbered n USING (i)"""


@register("flat_arguments", with_fixtures(_FLAT_SOC, "list_responses", "answer_responses", "argument_responses"))
def q_flat_arguments(spark, sf_dir):
    """One CSV-ready row per argument (blank row if none)."""
    return flatten_arguments(_socratic(spark, sf_dir))


@register("result_stats", with_fixtures(
    _SOCRATIC + """
SELECT count(*) AS total_articles, CAST(count_if(success) AS BIGINT) AS successful_articles,
       CAST(count(*) - count_if(success) AS BIGINT) AS failed_articles, CAST(sum(n_arguments) AS BIGINT) AS total_arguments,
       CASE WHEN count(*) > 0 THEN sum(n_arguments) / count(*) ELSE 0.0 END AS avg_arguments
FROM res""", "list_responses", "answer_responses", "argument_responses"))
def q_result_stats(spark, sf_dir):
    """Totals of a Socratic run."""
    return result_stats(_socratic(spark, sf_dir))
