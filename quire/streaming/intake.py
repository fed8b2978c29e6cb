"""K1: incremental intake of export files on Structured Streaming.

The file source's checkpoint keeps the log of files already read;
``trigger(availableNow=True)`` processes whatever has arrived and stops (the
batch-style schedule of the reference).  Neither a file's age nor an export's
date drops anything: the source's age limit is set beyond any file, and there is
no watermark.

Rows go to the sink through ``foreachBatch``.  A batch keeps one row per id,
leaves out the ids that earlier batches have written (an anti join with the
sink's id column: the inclusive start day, Q16) and overwrites its own folder
``run=<the checkpoint's id>/batch=<number>``.  A batch that is run again after a
failure therefore gives the same folder, a new checkpoint over an old sink
overwrites nothing, and the query keeps no ids in its state.  The next high-water
mark is the newest publication date in the sink.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from quire.operators.intake import publication_date

#: The source forgets and skips files that are older than the newest by more than this.
MAX_FILE_AGE = "36500d"
SINK_SCHEMA = "id string, mtime timestamp, value string, pub_date date, run string, batch long"


def intake_stream(spark: SparkSession, source_dir: str, fmt: str = "text",
                  schema: T.StructType | None = None, id_col: str | None = None,
                  value_col: str = "value") -> DataFrame:
    """Streaming DataFrame of (id, mtime, value, pub_date) over new files.

    ``fmt='text'`` reads each file whole (one export = one row, the file
    path is the id); other formats read export rows with ``schema``, which may
    repeat an id."""
    source = spark.readStream.option("maxFileAge", MAX_FILE_AGE)
    if fmt == "text":
        s = (source.text(source_dir, wholetext=True)
             .select(F.col("_metadata.file_path").alias("id"),
                     F.col("_metadata.file_modification_time").alias("mtime"), F.col("value")))
    else:
        if schema is None or id_col is None:
            raise ValueError("a row-format source needs a schema and an id column")
        s = source.schema(schema).format(fmt).load(source_dir)
        s = s.select(F.col(id_col).cast("string").alias("id"), F.col("mtime").cast("timestamp").alias("mtime"),
                     F.col(value_col).alias("value"))
    return s.withColumn("pub_date", publication_date("value"))


def read_sink(spark: SparkSession, sink_dir: str) -> DataFrame:
    """The rows taken in so far: id, mtime, value, pub_date, run, batch.  No row if
    nothing has been written yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(sink_dir)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], SINK_SCHEMA)
    return spark.read.schema(SINK_SCHEMA).option("basePath", sink_dir).parquet(sink_dir)


def write_batch(rows: DataFrame, run: str, batch: int, sink_dir: str) -> None:
    """One batch into its folder of the sink: the newest row of each id that
    no earlier batch has.  Null ids cannot be told apart and all stay."""
    earlier = read_sink(rows.sparkSession, sink_dir).where((F.col("run") != run) | (F.col("batch") < batch)).select("id")
    own = F.when(F.col("id").isNull(), F.monotonically_increasing_id())
    newest = (rows.groupBy("id", own.alias("own")).agg(F.max(F.struct("mtime", "value", "pub_date")).alias("r"))
              .select("id", "r.*"))
    (newest.join(earlier, "id", "left_anti").write.mode("overwrite")
     .parquet(f"{sink_dir.rstrip('/')}/run={run}/batch={batch}"))


def start_intake(spark: SparkSession, source_dir: str, sink_dir: str, checkpoint_dir: str,
                 **kwargs) -> StreamingQuery:
    """Run the intake once over all new files into a Parquet sink."""
    def write(rows: DataFrame, batch: int) -> None:
        # the checkpoint holds the id that its query keeps through all its runs
        run = rows.sparkSession.read.json(f"{checkpoint_dir.rstrip('/')}/metadata").first()["id"]
        write_batch(rows, run, batch, sink_dir)

    return (intake_stream(spark, source_dir, **kwargs).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start())


def sink_high_water_mark(spark: SparkSession, sink_dir: str) -> DataFrame:
    """Next inclusive start date: the newest publication date taken in."""
    return read_sink(spark, sink_dir).agg(F.max("pub_date").alias("start_date"))
