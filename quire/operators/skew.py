"""Equi joins that stay balanced when one key holds a large share of rows.

``lookup_join`` joins a large table with a lookup table that has one row per
key (a dimension, a representative per fingerprint, a frequency per token).
Keys holding more than ``hot_rows`` rows of the large side are found with a
partial aggregation; there are at most ``rows / hot_rows`` of them, so that
key list is broadcast with a proven bound.  Rows of a hot key are spread over
``salts`` buckets by a hash of the row, and only the hot keys' lookup rows
are copied once per bucket; every other key joins unchanged (bucket 0).  The
result equals the plain join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SALTS = 32


def hot_keys(big: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows (at most rows / hot_rows keys)."""
    counts = big.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return counts.where(F.col("_n") > hot_rows).select(*keys).withColumn("_hot", F.lit(True))


def lookup_join(big: DataFrame, small: DataFrame, keys: str | Sequence[str], how: str = "inner",
                hot_rows: int = HOT_ROWS, salts: int = SALTS, count_col: str | None = None) -> DataFrame:
    """``count_col``: a column of ``small`` that already holds the number of
    ``big`` rows per key (a dimension built by grouping those rows, a
    frequency table); it spares the extra counting pass."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    if count_col is None:
        hot = hot_keys(big, keys, hot_rows)
    else:
        hot = small.where(F.col(count_col) > hot_rows).select(*keys).withColumn("_hot", F.lit(True))
    hot = F.broadcast(hot)
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in big.columns]), F.lit(salts))
    big2 = (big.join(hot, keys, "left")
               .withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0)).cast("long"))
               .drop("_hot"))
    copies = F.when(F.col("_hot"), F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))) \
              .otherwise(F.array(F.lit(0).cast("long")))
    small2 = (small.join(hot, keys, "left")
                   .withColumn("_salt", F.explode(copies))
                   .drop("_hot"))
    return big2.join(small2, keys + ["_salt"], how).drop("_salt")


#: Rows of a list that one task compares with as many others.
BLOCK = 1000


def meet_in_lists(rows: DataFrame, key: str, id_col: str, block: int = BLOCK) -> tuple[DataFrame, list, object]:
    """Prepare the pairs of rows that share a ``key``: a self join of the
    returned rows (aliased ``a`` and ``b``) on the returned conditions meets each
    pair of different rows of a list, in both directions, once.

    Keys of one row meet nothing and are left out.  A list of more than ``block``
    rows is dealt into blocks by a hash of ``id_col``, and each pair of blocks is
    a group of its own: no task holds more than two blocks of a list, however
    long it is."""
    m = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_m")).where("_m > 1")
    sized = lookup_join(rows, m, key, count_col="_m").withColumn("_blocks", F.ceil(F.col("_m") / block))
    dealt = (sized.withColumn("_own", F.pmod(F.xxhash64(id_col), F.col("_blocks")))
             .withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)))
             .withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other"))
             .drop("_m", "_blocks", "_other"))
    meet = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in (key, "_i", "_j")]
    once = (F.col("a._i") == F.col("a._j")) | (F.col("a._own") != F.col("b._own"))  # one block's own pairs meet once
    return dealt, meet, once
