"""Writing intermediate tables, so that chains of joins do not recompute their inputs.

Tables go below ``spark.checkpoint.dir``, the folder that driver and executors share. Without that setting a
local session, where driver and executors are one process, gets a folder of its own; on a cluster it is an error,
since each executor would write to its own disk. A written table survives lost executors. The session's folder
goes when its process ends."""
from __future__ import annotations

import atexit
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_ROOT = "voxtable.stage.root"
_FACTOR = "spark.sql.sources.fileCompressionFactor"
_SPLIT, _DEFAULT_SPLIT, _SPLIT_SIZE = "spark.sql.files.maxPartitionBytes", "134217728b", 16 << 20
_BATCH, _BATCH_SIZE = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that all machines of the session share."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="voxtable-")


def root(spark: SparkSession) -> str:
    """The session's folder.

    Positions and times take a byte or two a row in Parquet and some hundred in memory, so Spark would broadcast tables of
    millions of rows by the size of their files. Unless the session says otherwise, files count ten times, and a task reads
    16 MB of them and not 128, whose rows would not fit its memory: sorted, they would be spilled."""
    known = spark.conf.get(_ROOT, None)
    if known is None:
        known = f"{shared_folder(spark)}/voxtable-{uuid.uuid4().hex[:12]}"
        spark.conf.set(_ROOT, known)
        if float(spark.conf.get(_FACTOR)) == 1:
            spark.conf.set(_FACTOR, "10.0")
        if spark.conf.get(_SPLIT) == _DEFAULT_SPLIT:
            spark.conf.set(_SPLIT, str(_SPLIT_SIZE))
        atexit.register(_remove, spark, known)
    return known


def _remove(spark: SparkSession, path: str) -> None:
    context = spark.sparkContext
    if context._jsc is None or context._jsc.sc().isStopped():
        return
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partitions rows for a Python operator. Python work per byte is high, so these partitions are
    kept at the configured count and not merged by size; a grouped operator on the keys reuses them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    known = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if known is None else spark.conf.set(key, known)


def small_batches(spark: SparkSession):
    """Rows go to Python in batches of a few MB, since batches are bounded by rows otherwise, and texts can be long."""
    return _set(spark, _BATCH, _BATCH_SIZE)


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the session's folder."""
    return f"{root(spark)}/{name}-{uuid.uuid4().hex[:8]}"


def stage(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """Writes the table once as Parquet and reads it back. A split is made of whole row groups, so these are as small as a split.

    What the write shuffled goes as it ends; otherwise the shuffles of all tables of a query stay on the disk until the driver happens
    to collect its garbage. ``rows``: the most rows of a row group. Spark decodes up to 4,096 rows of one row group at once, whatever
    their length, so tables whose rows are long arrays need it: such rows may take a few bytes in the file and half a MB each in memory."""
    path = new_path(df.sparkSession, name)
    with small_batches(df.sparkSession), _set(df.sparkSession, _CLEAN, "true"):
        w = df.write.option("compression", "zstd").option("parquet.block.size", str(_SPLIT_SIZE))
        (w.option("parquet.block.row.count.limit", str(rows)) if rows else w).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
