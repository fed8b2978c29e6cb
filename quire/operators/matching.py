"""Author-name -> encyclopedia page matching and threshold evaluation
(B21, B22, C13-C15, D5, F2).

The search service is replaced by a *candidate table* (name, rank, key,
description); matching is an equi join on the name, a fuzzy score per
candidate, and a top-1 per name by ``max_by`` (a partial aggregate, so a
name with very many candidates never gathers them in one task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions.fuzzy import DISAMBIGUATION, candidate_key, key_from_url, query_key, ratio

NO_RESULTS = "NO_RESULTS"
MULTIPLE_MATCHES = "MULTIPLE_MATCHES"
NO_MATCH = "NO_MATCH"
MATCHED = "MATCHED"
THRESHOLDS = tuple(range(10, 101, 5))


def fuzzy_scores(names: DataFrame, candidates: DataFrame, name_col: str = "name",
                 strip_dots: bool = True) -> DataFrame:
    """(name, rnk, candidate_key, description, score) for every
    candidate of every name."""
    c = candidates.withColumnRenamed(name_col, "name") if name_col != "name" else candidates
    n = names.select(F.col(name_col).alias("name")).distinct()
    j = n.join(c, "name").select("name", "rnk", "candidate_key", "description",
                                 query_key(F.col("name")).alias("_q"),
                                 candidate_key(F.col("candidate_key"), strip_dots).alias("_c"))
    # the keys are staged as columns: the ratio's inner loops read them per cell
    return j.select("name", "rnk", "candidate_key", "description", ratio("_q", "_c").alias("score"))


def best_candidates(scored: DataFrame) -> DataFrame:
    """F2: best score per name, first rank on ties; plus the first result's
    description (for the disambiguation test)."""
    return scored.groupBy("name").agg(
        F.max_by(F.struct("score", "candidate_key", "rnk"), F.struct(F.col("score"), -F.col("rnk"))).alias("_b"),
        F.min_by("description", "rnk").alias("first_description"),
    ).select("name", F.col("_b.score").alias("score"), F.col("_b.candidate_key").alias("key"),
             F.col("_b.rnk").alias("rnk"), "first_description")


def match_status(names: DataFrame, candidates: DataFrame, name_col: str = "name",
                 threshold: float = 50, strip_dots: bool = True) -> DataFrame:
    """B21 (Q14: status and key in separate columns).  Every name appears:
    no candidates -> NO_RESULTS; first result a disambiguation page ->
    MULTIPLE_MATCHES; best score below ``threshold`` -> NO_MATCH; else
    MATCHED with the candidate's key."""
    best = best_candidates(fuzzy_scores(names, candidates, name_col, strip_dots))
    n = names.select(F.col(name_col).alias("name")).distinct()
    j = n.join(best, "name", "left")
    status = (F.when(F.col("score").isNull(), F.lit(NO_RESULTS))
               .when(F.col("first_description") == DISAMBIGUATION, F.lit(MULTIPLE_MATCHES))
               .when(F.col("score") < threshold, F.lit(NO_MATCH))
               .otherwise(F.lit(MATCHED)))
    return j.select("name", status.alias("status"),
                    F.when(status == MATCHED, F.col("key")).alias("key"), "score")


def attach_pages(matches: DataFrame, pages: DataFrame, key_col: str = "key") -> DataFrame:
    """Only matched names look up a page; statuses pass through."""
    return matches.join(pages.withColumnRenamed(key_col, "key"), "key", "left")


def threshold_sweep(gold: DataFrame, candidates: DataFrame, name_col: str = "name", url_col: str = "url",
                    thresholds: Sequence[int] = THRESHOLDS) -> DataFrame:
    """Precision and recall of top-1 matching per threshold.

    TP: score >= t and the predicted key equals the gold key (from the URL);
    FP: score >= t and a different key; FN: no candidates or score < t.
    Each scored name carries the threshold list as an array column that is
    exploded in place (no join), then one aggregation per threshold."""
    g = gold.select(F.col(name_col).alias("name"), key_from_url(F.col(url_col)).alias("gold_key"))
    best = best_candidates(fuzzy_scores(g, candidates, "name"))
    j = g.join(best, "name", "left")
    t = F.array(*[F.lit(int(x)) for x in thresholds])
    x = j.select("gold_key", "score", "key", F.explode(t).alias("t"))
    hit = F.col("score").isNotNull() & (F.col("score") >= F.col("t"))
    agg = x.groupBy("t").agg(
        F.count_if(hit & (F.col("key") == F.col("gold_key"))).alias("tp"),
        F.count_if(hit & (F.col("key") != F.col("gold_key"))).alias("fp"),
        F.count_if(~F.coalesce(hit, F.lit(False))).alias("fn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(F.lit(0.0))
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(F.lit(0.0))
    return agg.select("t", "tp", "fp", "fn", prec.alias("precision"), rec.alias("recall"))
