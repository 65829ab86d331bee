"""Small helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes that go to a Python worker at once, at most: long texts would make larger batches costly. With each, what Spark takes where nobody sets it.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("1000", "10000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("16m", "67108864b")}
#: Spark removes the shuffle files of a finished query at once.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of sf_dir. Where the session leaves the batches to Python workers at Spark's own size, they are made small."""
    for key, (value, unset) in BATCH.items():
        if spark.conf.get(key) == unset:
            spark.conf.set(key, value)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local session may do without it."""
    where = spark.conf.get("spark.checkpoint.dir", "")
    if not where:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        where = found.get() if found.isDefined() else ""
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="inkdiff-checkpoints-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialize(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write df once to the shared folder and read it back.

    This cuts the lineage and survives the loss of any executor. `discard` removes the files, at the latest the end of
    the session's process does.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkdiff-{label}-{uuid.uuid4().hex}"
    with _setting(spark, CLEANUP, "true"):
        df.write.option("compression", compression).parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*written: DataFrame | None) -> None:
    """Remove what `materialize` wrote; nothing may read these tables any more."""
    for df in written:
        if df is not None:
            _remove(df.sparkSession, df.written_to)


@contextlib.contextmanager
def _setting(spark: SparkSession, key: str, value: str):
    """A setting of the session for as long as the block runs."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may be gone by then
        pass


def input_splits(df: DataFrame) -> int:
    """Partitions of the scan: a measure of the input's size known without running a job."""
    return max(1, df._jdf.rdd().getNumPartitions())
