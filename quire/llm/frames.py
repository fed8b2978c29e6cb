"""Spark helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import stored
from quire.sources.tables import table

__all__ = ["documents", "table", "stored", "remainder", "text_key", "documents_of", "labelled_part"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def documents_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the named columns only: columns of the caller with
    other names never meet the operator's own."""
    return docs.select("doc_id", "text", *more)


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (-1 for a null id)."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % modulus, F.lit(-1)).cast("int")


def text_key() -> Column:
    """With doc_id it names a document: rows equal in both are one document."""
    return F.coalesce(F.xxhash64("text"), F.lit(0))


def labelled_part(docs: DataFrame, labels: DataFrame, label: str, modulus: int, kept_out: int,
                  sample: int) -> DataFrame:
    """(doc_id, text, y) of a sample of the labelled rows that may be learnt
    from (remainder not ``kept_out``): the ``sample`` labels with the smallest
    hash of the id, the same whatever the partitioning.  The bound makes the
    broadcast safe.  Rows equal in id and text count once, and the bound holds
    for the joined rows, too, by the same order: an id that is often repeated
    fills no driver.  A document with both labels counts once for each; null
    ids and labels are left out."""
    l = (labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y"))
         .where(F.col("_id").isNotNull() & F.col("y").isin(0, 1) & (remainder("_id", modulus) != kept_out))
         .distinct().orderBy(F.xxhash64("_id"), "_id", "y").limit(sample))
    joined = (documents_of(docs).join(F.broadcast(l), F.col("doc_id") == F.col("_id"))
              .select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "y").withColumn("key", text_key()))
    return (joined.dropDuplicates(["doc_id", "key", "y"]).orderBy(F.xxhash64("doc_id"), "doc_id", "y", "key").limit(sample)
            .repartition("doc_id", "key").drop("key"))
