"""Argument mining over batch request / response tables (H9-H11, H15,
B23, C7-C10, L3, L4).

The language-model service sits *between* Spark jobs: each phase is one job
that writes a request table, and one job that joins the returned response
table by ``custom_id``.  Every phase is therefore a restartable table, and
the fan-out from one article to its items is ``posexplode`` + equi joins.

Article positions ``i`` are dense 0..n-1 ids (the reference enumerates its
rows); item positions ``j`` are 0-based list positions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.lists import list_items, parse_argument
from quire.session import stored_counted

ENDPOINT = "/v1/chat/completions"
DEFAULT_MODEL = "gpt-4o-mini"
NO_ARGS = "No arguments extracted"
#: So many response ids that repeat go to every task.
FEW_AGAIN = 250_000

# Default prompt templates (L4).  They are parameters: pass your own texts
# with the same slots to reproduce another prompt set.
CONCLUSION_PROMPT = ("List every conclusion the author argues for in the text below, "
                     "one per line, numbered.\n\nText:\n{text}")
PREMISE_PROMPT = ("List the premises that support the conclusion, one per line, numbered.\n\n"
                  "Conclusion: {conclusion}\n\nText:\n{text}")
QUESTION_PROMPT = ("List the questions the text below answers, one per line, numbered.\n\n"
                   "Text:\n{text}")
ANSWER_PROMPT = "Answer the question using the article.\n\nQuestion: {question}\n\nArticle:\n{article}"
ARGUMENT_PROMPT = ("Build an argument from the question and answer.\nReply as\nClaim: ...\nPremises:\n"
                   "1. ...\n\nQuestion: {question}\nAnswer: {answer}")


def render_prompt(template: str, **slots: Column) -> Column:
    """Fill each named slot once.  The template is split on the driver;
    the row values are concatenated, never searched, so a ``{text}`` inside
    an article is not expanded again."""
    pieces: list[Column] = []
    for literal, field, spec, conv in string.Formatter().parse(template):
        if literal:
            pieces.append(F.lit(literal))
        if field is not None:
            if spec or conv:
                raise ValueError("format specs are not supported in prompt slots")
            pieces.append(F.coalesce(slots[field].cast("string"), F.lit("None")))
    return F.concat(*pieces) if pieces else F.lit("")


def build_requests(df: DataFrame, custom_id: Column, prompt: Column, model: str = DEFAULT_MODEL,
                   temperature: float = 0.1) -> DataFrame:
    """One request row per input row (JSON-ready struct columns)."""
    body = F.struct(F.lit(model).alias("model"),
                    F.array(F.struct(F.lit("user").alias("role"), prompt.alias("content"))).alias("messages"),
                    F.lit(float(temperature)).alias("temperature"))
    return df.select(custom_id.alias("custom_id"), F.lit("POST").alias("method"),
                     F.lit(ENDPOINT).alias("url"), body.alias("body"))


def request_json(requests: DataFrame) -> DataFrame:
    """A8 payload: one JSON line per request."""
    return requests.select(F.to_json(F.struct("custom_id", "method", "url", "body")).alias("value"))


def latest_content(responses: DataFrame, order_col: str = "line") -> DataFrame:
    """(custom_id, content) - the last non-empty content per id wins
    (a later record overwrites an earlier one; empty ones are skipped)."""
    r = responses.where(F.col("content") != "")
    return r.groupBy("custom_id").agg(F.max_by("content", order_col).alias("content"))


def _latest_in_place(responses: DataFrame) -> DataFrame:
    """``latest_content`` without a shuffle of the contents that have their id to
    themselves: ids are counted first, and only those of several records meet."""
    r = responses.where(F.col("content") != "")
    again, n = stored_counted(r.groupBy("custom_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("custom_id").alias("_again")))
    if n > FEW_AGAIN:
        return latest_content(responses)
    if n == 0:
        return r.select("custom_id", "content")
    several = F.col("custom_id").eqNullSafe(F.col("_again"))
    return (r.join(F.broadcast(again), several, "left_anti").select("custom_id", "content")
            .union(latest_content(r.join(F.broadcast(again), several, "left_semi"))))


def _ids(prefix: str, *parts: Column) -> Column:
    """H9: ``prefix_i`` / ``prefix_i_j``."""
    return F.concat_ws("_", F.lit(prefix), *[p.cast("string") for p in parts])


def _split_ids(responses: DataFrame, prefix: str, two: bool) -> DataFrame:
    """H9 parse: keep ids of this phase and read ``i`` (and ``j``)."""
    pat = rf"^{prefix}_(\d+)" + (r"_(\d+)$" if two else "$")
    r = responses.where(F.col("custom_id").rlike(pat))
    r = r.withColumn("i", F.regexp_extract("custom_id", pat, 1).cast("long"))
    if two:
        r = r.withColumn("j", F.regexp_extract("custom_id", pat, 2).cast("long"))
    return r


# ---------------------------------------------------------------- direct --

def direct_phase1_requests(articles: DataFrame, template: str = CONCLUSION_PROMPT,
                           model: str = DEFAULT_MODEL) -> DataFrame:
    """Requests ``c_i`` (articles: i, article_id, text)."""
    return build_requests(articles, _ids("c", F.col("i")), render_prompt(template, text=F.col("text")), model)


def direct_conclusions(phase1: DataFrame, mode: str = "reference") -> DataFrame:
    """(i, j, conclusion) from phase-1 responses (custom_id, content, line)."""
    r = _split_ids(latest_content(phase1), "c", False)
    x = r.select("i", F.posexplode_outer(list_items("content", mode)).alias("j", "conclusion"))
    return x.where(F.col("conclusion").isNotNull())


def direct_phase2_requests(articles: DataFrame, conclusions: DataFrame,
                           template: str = PREMISE_PROMPT, model: str = DEFAULT_MODEL) -> DataFrame:
    """C7 fan-out: one request ``p_i_j`` per conclusion."""
    x = conclusions.join(articles.select("i", "text"), "i")
    return build_requests(x, _ids("p", F.col("i"), F.col("j")),
                          render_prompt(template, text=F.col("text"), conclusion=F.col("conclusion")), model)


def direct_results(articles: DataFrame, phase1: DataFrame, phase2: DataFrame,
                   mode: str = "reference") -> DataFrame:
    """Every conclusion kept; missing premises -> [].  H15 labels.

    The lists of an article meet by ``i`` as wholes and their items inside the row,
    so a content is shuffled once, and not item by item."""
    concl = _split_ids(_latest_in_place(phase1), "c", False).select("i", list_items("content", mode).alias("_c"))
    concl = concl.groupBy("i").agg(F.collect_list("_c").alias("_c"))  # c_1 and c_01 are both article 1
    prem = _split_ids(_latest_in_place(phase2), "p", True).select("i", "j", list_items("content", mode).alias("premises"))
    prem = (prem.repartition("i").groupBy("i", "j").agg(F.collect_list("premises").alias("_p"))
            .groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "_p"))).alias("_p")))
    numbered = F.flatten(F.transform("_c", lambda own: F.transform(own, lambda c, j: F.struct(j.cast("long").alias("j"), c.alias("conclusion")))))
    args = concl.join(prem, "i", "left").select("i", "_p", F.filter(numbered, lambda c: c["conclusion"].isNotNull()).alias("_c"))
    none = F.array(F.array().cast("array<string>"))
    per_article = args.select("i", F.array_sort(F.flatten(F.transform("_c", lambda c: F.transform(
        F.coalesce(F.try_element_at("_p", c["j"]), none),
        lambda p: F.struct(c["j"].alias("j"), c["conclusion"].alias("conclusion"), p.alias("premises")))))).alias("_a"))
    per_article = per_article.select(
        "i",
        F.transform("_a", lambda a: a["conclusion"]).alias("conclusions"),
        F.transform("_a", lambda a: F.struct(a["conclusion"].alias("conclusion"),
                                             a["premises"].alias("premises"))).alias("arguments"))
    return _label(articles.join(per_article, "i", "left"), "conclusions",
                  "array<struct<conclusion:string,premises:array<string>>>")


# -------------------------------------------------------------- socratic --

def socratic_phase1_requests(articles: DataFrame, template: str = QUESTION_PROMPT,
                             model: str = DEFAULT_MODEL) -> DataFrame:
    return build_requests(articles, _ids("q", F.col("i")), render_prompt(template, text=F.col("text")), model)


def socratic_questions(phase1: DataFrame, mode: str = "reference", limit: int = 10) -> DataFrame:
    """(i, j, question): first ``limit`` questions per article (F1)."""
    r = _split_ids(latest_content(phase1), "q", False)
    x = r.select("i", F.posexplode_outer(list_items("content", mode, limit)).alias("j", "question"))
    return x.where(F.col("question").isNotNull())


def socratic_phase2_requests(articles: DataFrame, questions: DataFrame,
                             template: str = ANSWER_PROMPT, model: str = DEFAULT_MODEL) -> DataFrame:
    x = questions.join(articles.select("i", "text"), "i")
    return build_requests(x, _ids("qa", F.col("i"), F.col("j")),
                          render_prompt(template, question=F.col("question"), article=F.col("text")), model)


def socratic_answers(phase2: DataFrame) -> DataFrame:
    """(i, j, answer) - only non-empty answers go on."""
    return _split_ids(latest_content(phase2), "qa", True).select("i", "j", F.col("content").alias("answer"))


def socratic_phase3_requests(questions: DataFrame, answers: DataFrame,
                             template: str = ARGUMENT_PROMPT, model: str = DEFAULT_MODEL) -> DataFrame:
    x = questions.join(answers, ["i", "j"])
    return build_requests(x, _ids("arg", F.col("i"), F.col("j")),
                          render_prompt(template, question=F.col("question"), answer=F.col("answer")), model)


def socratic_results(articles: DataFrame, phase1: DataFrame, phase2: DataFrame, phase3: DataFrame,
                     mode: str = "reference") -> DataFrame:
    """An item counts only with a non-empty answer and an argument."""
    q = socratic_questions(phase1, mode)
    a = socratic_answers(phase2)
    g = _split_ids(latest_content(phase3), "arg", True).select(
        "i", "j", parse_argument("content", mode).alias("arg"))
    items = q.join(a, ["i", "j"]).join(g, ["i", "j"])
    args = items.groupBy("i").agg(F.array_sort(F.collect_list(
        F.struct("j", "question", "answer", F.col("arg.claim").alias("claim"),
                 F.col("arg.premises").alias("premises")))).alias("_a"))
    args = args.select("i", F.transform("_a", lambda x: F.struct(
        x["question"].alias("question"), x["answer"].alias("answer"), x["claim"].alias("claim"),
        x["premises"].alias("premises"))).alias("arguments"))
    qs = q.groupBy("i").agg(F.array_sort(F.collect_list(F.struct("j", "question"))).alias("_q"))
    qs = qs.select("i", F.transform("_q", lambda x: x["question"]).alias("questions"))
    out = articles.join(qs, "i", "left").join(args, "i", "left")
    return _label(out, "questions",
                  "array<struct<question:string,answer:string,claim:string,premises:array<string>>>")


def _label(df: DataFrame, items_col: str, arg_type: str) -> DataFrame:
    """H15 (batch semantics, Q11): success = at least one argument."""
    out = (df.withColumn(items_col, F.coalesce(items_col, F.array().cast("array<string>")))
             .withColumn("arguments", F.coalesce("arguments", F.array().cast(arg_type))))
    ok = F.size("arguments") > 0
    return (out.withColumn("success", ok)
               .withColumn("error_message", F.when(ok, F.lit(None).cast("string")).otherwise(F.lit(NO_ARGS))))



def parse_responses(lines: DataFrame, value_col: str = "value", line_col: str = "line") -> DataFrame:
    """A7/H12 over raw result lines: (line, custom_id, content).  Malformed
    or null lines give a null id and '' content, as the reference does."""
    from quire.functions.lists import response_content
    from quire.sources.readers import RESPONSE_SCHEMA
    r = lines.select(line_col, F.from_json(F.col(value_col), RESPONSE_SCHEMA).alias("_r"))
    return r.select(line_col, F.col("_r.custom_id").alias("custom_id"),
                    response_content(F.col("_r.response")).alias("content"))


def run_completions(requests: DataFrame, complete, batch_size: int = 64) -> DataFrame:
    """L3: an optional in-cluster completion step.  ``complete`` maps a list
    of prompts to a list of completion texts (a client of the user's
    choosing); it runs per Arrow batch inside the tasks via ``mapInPandas``
    and returns the response table (custom_id, content, line) that the
    phase operators join - the same shape as results read back from the
    batch service."""
    import pandas as pd

    flat = requests.select("custom_id", F.get(F.col("body.messages"), 0)["content"].alias("prompt"))

    def fn(batches):
        for pdf in batches:
            out = []
            for start in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[start:start + batch_size]
                out.extend(complete(list(chunk["prompt"])))
            yield pd.DataFrame({"custom_id": pdf["custom_id"], "content": [("" if c is None else str(c).strip())
                                                                          for c in out]})
    res = flat.mapInPandas(fn, "custom_id string, content string")
    return res.withColumn("line", F.lit(0).cast("long"))
