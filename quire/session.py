"""Session helpers: the configuration every job relies on, and lineage cuts."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # iterative operators checkpoint every round: drop files no longer referenced
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def local_session(cores: str | int = "*", shuffle_partitions: int = 8,
                  app: str = "quire", extra: dict | None = None) -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    conf = dict(BASE_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf["spark.driver.memory"] = "16g"
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's ``spark.checkpoint.dir``; only a local master may
    fall back to a scratch folder of its own."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        try:
            conf = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            conf = None
    if conf:
        sc.setCheckpointDir(conf)
        return sc.getCheckpointDir() or conf
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running iterative operators")
    path = tempfile.mkdtemp(prefix="quire-ckpt-")
    sc.setCheckpointDir(path)
    return path


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared checkpoint dir.

    Used inside iterative operators and before order-sensitive numbering so
    that a lost executor recomputes from stored rows, not from a long plan.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` once as Parquet into the shared checkpoint folder and read
    it back: cuts the lineage, so that a lost executor rereads rows instead of
    redoing the plan, and later steps read only the columns they need.  The
    folder goes when the driver's Python ends."""
    spark = df.sparkSession
    path = scratch(spark, "stored")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``stored`` and the number of rows, counted while they are written."""
    seen = Observation(f"rows-{uuid.uuid4().hex}")
    out = stored(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return out, int(seen.get["rows"])


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder that goes when the driver's
    Python ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001 - the session has ended; the folder belongs to the cluster
        pass
