"""Cost and counters.

A running total over all rows would be a window without partition keys -
every row through one task.  ``running_sum`` is the distributed prefix sum:
range-partition on the order key, checkpoint, total per partition (one row
per partition), prefix-sum those totals, add each partition's offset to its
local running sum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize

# Token prices in dollars per million tokens (input, output).
PRICE_IN = 0.07
PRICE_OUT = 1.10


def running_sum(df: DataFrame, order_by: str | Sequence[str], value_col: str, out_col: str,
                num_partitions: int | None = None) -> DataFrame:
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialize(df.repartitionByRange(n, *keys).withColumn("_pid", F.spark_partition_id()))
    totals = laid.groupBy("_pid").agg(F.sum(value_col).alias("_t"))
    offsets = totals.select("_pid", F.coalesce(F.sum("_t").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_off"))
    local = F.sum(value_col).over(Window.partitionBy("_pid").orderBy(*keys)
                                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (laid.join(F.broadcast(offsets), "_pid")
                .withColumn(out_col, F.col("_off") + local).drop("_pid", "_off"))


def token_cost(usage: DataFrame, order_by: str = "call_id", price_in: float = PRICE_IN,
               price_out: float = PRICE_OUT) -> DataFrame:
    """Cost per call and the running total in call order."""
    cost = (F.col("input_tokens").cast("double") / 1e6 * price_in
            + F.col("output_tokens").cast("double") / 1e6 * price_out)
    return running_sum(usage.withColumn("cost", cost), order_by, "cost", "total_cost")


def stage_counts(**tables: DataFrame) -> DataFrame:
    """One row of row counts, one column per named table.  Each count
    is a partial + final aggregate; the one-row results are combined by a
    union + max, never by a cross join."""
    parts = []
    names = list(tables)
    for name, df in tables.items():
        parts.append(df.agg(*[(F.count(F.lit(1)) if n == name else F.lit(None).cast("long")).alias(n)
                              for n in names]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(*[F.max(n).alias(n) for n in names])
