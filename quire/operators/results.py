"""Result shaping: flat argument rows and run statistics (H16-H18, H34,
D4, E5, F3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flatten_arguments(results: DataFrame, max_premises: int = 5) -> DataFrame:
    """One row per argument; an article without arguments gives one
    blank row with count 0.  E5 1-based ordinal, H17 full premise count,
    H16 ' | ' join over all premises, F3 first ``max_premises`` in columns.
    Direct results carry ``conclusion``: it fills ``claim`` (Q12 fixed)."""
    arg = F.col("_arg")
    fields = results.schema["arguments"].dataType.elementType.fieldNames()
    has = lambda f: f in fields
    x = results.select("article_id", "text", "success", "error_message",
                       F.posexplode_outer("arguments").alias("_k", "_arg"))
    claim = arg["claim"] if has("claim") else F.lit(None).cast("string")
    if has("conclusion"):
        claim = F.coalesce(claim, arg["conclusion"])
    premises = arg["premises"]
    present = arg.isNotNull()
    cols = [
        "article_id", "text", "success", "error_message",
        F.when(present, F.col("_k") + 1).cast("int").alias("argument_index"),
        F.coalesce(arg["question"] if has("question") else F.lit(None).cast("string"), F.lit("")).alias("question"),
        F.coalesce(arg["answer"] if has("answer") else F.lit(None).cast("string"), F.lit("")).alias("answer"),
        F.coalesce(claim, F.lit("")).alias("claim"),
        F.coalesce(F.size(premises), F.lit(0)).cast("int").alias("premises_count"),
        F.coalesce(F.array_join(premises, " | "), F.lit("")).alias("premises_concatenated"),
    ]
    cols += [F.coalesce(F.get(premises, k), F.lit("")).alias(f"premise_{k + 1}") for k in range(max_premises)]
    return x.select(*cols)


def result_stats(results: DataFrame) -> DataFrame:
    """One row of totals (one partial + final aggregation)."""
    agg = results.agg(
        F.count(F.lit(1)).alias("total_articles"),
        F.count_if(F.col("success")).alias("successful_articles"),
        F.coalesce(F.sum(F.size("arguments")), F.lit(0)).alias("total_arguments"))
    return agg.select(
        "total_articles", "successful_articles",
        (F.col("total_articles") - F.col("successful_articles")).alias("failed_articles"),
        "total_arguments",
        F.when(F.col("total_articles") > 0, F.col("total_arguments") / F.col("total_articles"))
         .otherwise(F.lit(0.0)).alias("avg_arguments"))
