"""Readers with explicit schemas (A1-A7, A15).  Nothing is inferred.

Every reader that feeds an order-sensitive operator also returns a ``pos``
column: a struct (file path, block start, row in block) that sorts in file
order, because a distributed scan promises no row order of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE_COLUMNS = (
    "titulo", "autor", "texto_completo", "publicacion", "fecha_de_publicacion", "editorial",
    "tipo_fuente", "idioma", "materia", "lugar_articulo", "personas", "empresa",
    # the export's other columns, dropped by the cleaning step
    "resumen", "seccion", "lugar_publicacion", "tipo_documento", "id_proQuest", "url",
    "copyright", "ultima_actualizacion", "anio_publicación", "pais_publicacion", "materia_publicacion",
)
ARTICLE_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ARTICLE_COLUMNS])

AUTHOR_LIST_SCHEMA = T.StructType([T.StructField("id", T.LongType()),
                                   T.StructField("author_name", T.StringType())])
GOLD_SCHEMA = T.StructType([T.StructField("author_name", T.StringType()),
                            T.StructField("urls", T.StringType())])
PAGE_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("author_name", T.StringType()),
                            T.StructField("key", T.StringType()), T.StructField("source", T.StringType())])

RESPONSE_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([
        T.StructField("body", T.StructType([
            T.StructField("choices", T.ArrayType(T.StructType([
                T.StructField("message", T.StructType([T.StructField("content", T.StringType())])),
            ]))),
        ])),
    ])),
])


def file_pos() -> F.Column:
    """Order key of a row inside the files of a scan: (file, block, row)."""
    return F.struct(F.col("_metadata.file_path").alias("file"),
                    F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("row"))


def _csv(spark: SparkSession, schema: T.StructType, path: str, multiline: bool = True) -> DataFrame:
    return (spark.read.schema(schema)
            .option("header", True).option("multiLine", multiline).option("escape", '"')
            .option("mode", "PERMISSIVE").csv(path))


def _is_parquet(spark: SparkSession, path: str, fmt: str | None) -> bool:
    """The format by name, by the path's suffix, or by that of a file in the
    folder; anything else is an error."""
    def suffix(name: str) -> str | None:
        return next((f for f in ("parquet", "csv") if name.lower().rstrip("/").endswith("." + f)), None)

    fmt = fmt or suffix(path)
    if fmt is None:  # file names only, no content
        inside = spark.read.format("binaryFile").load(path).select("path").limit(1).collect()
        fmt = suffix(inside[0]["path"]) if inside else None
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"say which format this is, parquet or csv: {path}")
    return fmt == "parquet"


def read_articles(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A1: raw article export (CSV with quoted multi-line cells, or Parquet).
    A path without a suffix is read as its files' names say."""
    if _is_parquet(spark, path, fmt):
        df = spark.read.parquet(path)
    else:
        df = _csv(spark, ARTICLE_SCHEMA, path)
    return df.withColumn("pos", file_pos())


def read_corpus(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A2: scan chosen by file extension; anything else is an error."""
    low = path.lower()
    if low.endswith(".csv"):
        if schema is None:
            raise ValueError("a CSV corpus needs an explicit schema")
        df = _csv(spark, schema, path)
    elif low.endswith(".parquet"):
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"Unsupported file format: {path}")
    return df.withColumn("pos", file_pos())


def read_author_list(spark: SparkSession, path: str) -> DataFrame:
    """A3: author-name list; a missing file gives an empty table."""
    try:
        return _csv(spark, AUTHOR_LIST_SCHEMA, path, multiline=False)
    except Exception:  # noqa: BLE001 - the reference returns an empty frame
        return spark.createDataFrame([], AUTHOR_LIST_SCHEMA)


def read_pages(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """A4: page table with an HTML column (Parquet, or multi-line CSV)."""
    if _is_parquet(spark, path, fmt):
        return spark.read.parquet(path)
    return _csv(spark, PAGE_SCHEMA, path)


def read_export_files(spark: SparkSession, path_glob: str) -> DataFrame:
    """A5: whole text files with their modification time."""
    return (spark.read.text(path_glob, wholetext=True)
            .select(F.col("_metadata.file_path").alias("path"),
                    F.col("_metadata.file_modification_time").alias("mtime"),
                    "value"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """One term per line; trimmed; blank lines dropped; ``rank`` keeps
    the list order (term files are small: one row per file, then exploded)."""
    lines = spark.read.text(path, wholetext=True)
    x = lines.select(F.posexplode(F.split("value", r"\r?\n")).alias("rank", "term"))
    x = x.withColumn("term", F.regexp_replace("term", r"^\s+|\s+$", ""))
    return x.where(F.length("term") > 0)


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Batch-result JSON lines; blank lines skipped, malformed lines kept
    with null fields; ``line`` orders records inside the files."""
    raw = spark.read.text(path).withColumn("line", file_pos())
    raw = raw.where(F.regexp_replace("value", r"\s", "") != "")
    return raw.select("line", F.from_json("value", RESPONSE_SCHEMA).alias("r"), F.col("value").alias("raw")) \
              .select("line", "r.custom_id", "r.response", "raw")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """Gold set ``author_name, urls``."""
    return _csv(spark, GOLD_SCHEMA, path, multiline=False)
