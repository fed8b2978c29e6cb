"""Order-dependent numbering: dense ids, first-appearance dimensions, slices.

A distributed scan promises no row order, so every operator here takes an
explicit ``order_by`` (one or more columns that are unique per row).

Dense ids use the two-pass offset scheme instead of a global
``row_number()`` (which would pull every row through one task), over the order
keys alone:

1. the keys are range-partitioned and sorted inside each partition;
2. they are stored with partition and place, so the numbering below sees one
   fixed layout even if an executor is lost and a stage is recomputed;
3. rows per partition are counted (one row per partition: a proven size bound of
   ``numPartitions`` rows), and the prefix sums of the counts are broadcast;
4. id = offset of the partition + place inside the partition, and the table of
   keys and ids joins the rows late: no other column is stored, and columns that
   nobody reads are not read.

Keys that repeat have no place of their own: then (a count tells) whole rows are
laid out instead, and equal keys are numbered in any order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.session import materialize, stored

#: So many numbers of a whole-number key go to every task (about 50 bytes each).
FEW_NUMBERS = 1 << 22

_LOCAL_BITS = 33  # monotonically_increasing_id keeps the row index in the low 33 bits


def _cols(order_by) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def _laid_out(df: DataFrame, keys: list[str], num_partitions: int | None) -> DataFrame:
    """``df`` in key order: range partitions, stored with ``_pid`` and ``_mid``."""
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
                    .withColumn("_pid", F.spark_partition_id()).withColumn("_mid", F.monotonically_increasing_id()))


def _numbered(laid: DataFrame, id_col: str) -> DataFrame:
    counts = laid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("long"), _LOCAL_BITS)
    return (laid.join(F.broadcast(offsets), "_pid").withColumn(id_col, (F.col("_off") + local).cast("long"))
            .drop("_pid", "_mid", "_off"))


def dense_keys(df: DataFrame, order_by: str | Sequence[str], id_col: str = "id",
               num_partitions: int | None = None) -> DataFrame | None:
    """(order keys, ``id_col``): the numbering 0..n-1 as a table of its own, or
    None if a key repeats."""
    keys = _cols(order_by)
    laid = _laid_out(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys, num_partitions)
    if not laid.where("_rows > 1").isEmpty():
        return None
    return _numbered(laid.drop("_rows"), id_col)


def _late(df: DataFrame, numbers: DataFrame, keys: list[str], few: int = 0) -> DataFrame:
    """``df`` with the numbers of its keys; null keys match, too.  Up to ``few``
    numbers of a whole-number key are sent to the tasks: no text is shuffled."""
    names = {k: f"_key_{i}" for i, k in enumerate(keys)}
    numbers = numbers.withColumnsRenamed(names)
    if few and len(keys) == 1 and df.schema[keys[0]].dataType.simpleString() in ("int", "bigint"):
        key = F.col(names[keys[0]])
        rows, filled = numbers.agg(F.count(F.lit(1)), F.count(key)).first()
        if rows == filled <= few:
            return df.join(F.broadcast(numbers), F.col(keys[0]) == key).drop(*names.values())
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in names.items()]
    return df.join(numbers, on).drop(*names.values())


def dense_ids(df: DataFrame, order_by: str | Sequence[str], id_col: str = "id",
              num_partitions: int | None = None) -> DataFrame:
    """Append ``id_col`` = 0..n-1 following ``order_by`` (ascending)."""
    keys = _cols(order_by)
    numbers = dense_keys(df, keys, id_col, num_partitions)
    return _numbered(_laid_out(df, keys, num_partitions), id_col) if numbers is None else _late(df, numbers, keys, FEW_NUMBERS)


def first_appearance_dim(occ: DataFrame, value_col: str, order_by: str | Sequence[str],
                         id_col: str, out_col: str | None = None) -> DataFrame:
    """Distinct values numbered 0..n-1 in order of first appearance; ``_rows``
    keeps how many occurrences each value has (for skew-aware joins).

    The first position per value is a partial + final aggregation (map-side
    combine), so a value held by a third of all rows costs one row per task.
    """
    keys = _cols(order_by)
    first = occ.groupBy(value_col).agg(F.min(F.struct(*keys)).alias("_first"), F.count(F.lit(1)).alias("_rows"))
    first = first.select(value_col, "_rows", *[F.col(f"_first.{k}").alias(f"_f{i}") for i, k in enumerate(keys)])
    dim = dense_ids(first, [f"_f{i}" for i in range(len(keys))], id_col)
    dim = dim.drop(*[f"_f{i}" for i in range(len(keys))])
    if out_col and out_col != value_col:
        dim = dim.withColumnRenamed(value_col, out_col)
    return dim


def row_slice(df: DataFrame, order_by: str | Sequence[str], start: int = 0,
              end: int | None = None, n: int | None = None, id_col: str = "row_no") -> DataFrame:
    """Rows ``[start, end)``; else ``[start, start+n)``; else ``[start, ...)``.

    ``end`` wins over ``n`` (the reference's precedence)."""
    cond = F.col(id_col) >= F.lit(start)
    if end is not None:
        cond = cond & (F.col(id_col) < F.lit(end))
    elif n is not None:
        cond = cond & (F.col(id_col) < F.lit(start + n))
    numbers = dense_keys(df, order_by, id_col)
    if numbers is None:
        return dense_ids(df, order_by, id_col).where(cond)
    return _late(df, numbers.where(cond), _cols(order_by))  # rows outside the slice meet no key


def keep_first(df: DataFrame, key_cols: str | Sequence[str], order_by: str | Sequence[str]) -> DataFrame:
    """First row per key in ``order_by`` order (not ``dropDuplicates``, which
    keeps an arbitrary row).  ``min_by`` over a struct is a partial aggregate,
    so a hot key does not gather its rows into one task."""
    keys, order = _cols(key_cols), _cols(order_by)
    others = [c for c in df.columns if c not in keys]
    packed = F.struct(*[F.col(c) for c in others])
    out = df.groupBy(*keys).agg(F.min_by(packed, F.struct(*order)).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in others])


def rank_in_group(df: DataFrame, key_cols: str | Sequence[str], order_by: str | Sequence[str],
                  out_col: str = "rank", num_partitions: int | None = None) -> DataFrame:
    """1-based occurrence rank of each row inside its key, in
    ``order_by`` order (``row_number`` semantics).

    A window partitioned by the key would send a key holding a third of all
    rows to one task.  Instead rows are range-partitioned on (key, order), so
    a hot key spans many partitions; each (partition, key) piece is numbered
    locally, and the piece's offset is the count of the same key in earlier
    partitions (a table of at most one row per partition and key)."""
    keys, order = _cols(key_cols), _cols(order_by)
    n = num_partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = materialize(df.repartitionByRange(n, *keys, *order).withColumn("_pid", F.spark_partition_id()))
    local = F.row_number().over(Window.partitionBy("_pid", *keys).orderBy(*order))
    counts = laid.groupBy("_pid", *keys).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", *keys, F.coalesce(F.sum("_n").over(
        Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0)).alias("_off"))
    return (laid.withColumn("_loc", local).join(offsets, ["_pid", *keys])
                .withColumn(out_col, (F.col("_off") + F.col("_loc")).cast("int")).drop("_pid", "_loc", "_off"))
