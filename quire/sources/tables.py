"""Driver tables: Parquet scans registered as temp views.

Scans are lazy; Catalyst prunes columns and pushes filters into each scan,
so registering all tables costs nothing until a query touches one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def register_tables(spark: SparkSession, sf_dir: str, names=DRIVER_TABLES) -> None:
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
