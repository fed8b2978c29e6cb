"""Writers (A8-A14).  Every sink is a distributed write; nothing is
collected to the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Part of every Spark; it reads the files (*.zstd) by their name.
ZSTD = "org.apache.parquet.hadoop.codec.ZstandardCodec"


def write_requests(requests: DataFrame, path: str) -> None:
    """Batch-request JSON lines (non-ASCII text kept as is)."""
    (requests.select(F.to_json(F.struct("custom_id", "method", "url", "body")).alias("value"))
     .write.mode("overwrite").text(path))


def write_star(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, int]:
    """The output tables of the article job, one folder each.

    D10: each table carries a ``DataFrame.observe`` row counter, filled in
    while the table is written (no extra pass); the counts are returned."""
    counts = {}
    for name, df in tables.items():
        obs = Observation(f"rows_{name}")
        w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
        if fmt == "csv":
            w.option("header", True).option("escape", '"').csv(f"{path}/{name}")
        else:
            w.parquet(f"{path}/{name}")
        counts[name] = int(obs.get["rows"])
    return counts


def write_results_json(results: DataFrame, path: str) -> None:
    """A10: nested result records as JSON lines (one file per task)."""
    results.write.mode("overwrite").json(path)


def write_results_csv(flat: DataFrame, path: str, compression: str = ZSTD) -> int:
    """Flattened results with a header, in one run of the plan; the rows
    are counted while they are written and returned.  Without rows there is no
    file.  An article's rows all carry its text, one after the other: compressed,
    the copies take next to nothing, plain, many times the input.  zstd finds a copy
    up to 2 MB back (lz4 64 KB in blocks of 256 KB, gzip 32 KB), however long the text is."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    (flat.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
     .option("header", True).option("escape", '"').option("compression", compression).csv(path))
    n = int(seen.get["rows"])
    if n == 0:
        where = flat.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(flat.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    return n


def write_parsed(parsed: DataFrame, path: str) -> None:
    """``id, author_name, sentences`` only."""
    parsed.select("id", "author_name", "sentences").write.mode("overwrite").parquet(path)


def write_degrees(profiles: DataFrame, path: str) -> None:
    """One JSON record per author with nested degrees."""
    profiles.select("id", "author_name", "degrees").write.mode("overwrite").json(path)


def save_duplicates(duplicates: DataFrame, id_col: str, path: str) -> None:
    """Persist the duplicate ids (not positions) for later runs."""
    duplicates.select(id_col).write.mode("overwrite").parquet(path)


def read_duplicates(spark: SparkSession, path: str) -> DataFrame:
    """The ids that ``save_duplicates`` wrote."""
    return spark.read.parquet(path)


def reuse_duplicates(df: DataFrame, id_col: str, path: str) -> DataFrame:
    """Drop the saved duplicate ids with an anti join."""
    return df.join(read_duplicates(df.sparkSession, path), id_col, "left_anti")
