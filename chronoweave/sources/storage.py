"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of a batch that is handed to Python, where the session sets no bound of its own: rows may hold
#: whole texts, shingle sets or packed edges, and executors keep several copies of a batch.
BATCH_BYTES = "8m"


def bound_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if key not in spark.conf.getAll:
        spark.conf.set(key, BATCH_BYTES)


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the cluster names it; a folder of this process where that is unset and the
    session is local."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    held = context._jsc.sc().getCheckpointDir()
    if named:
        if not held.isDefined():
            context.setCheckpointDir(named)
        return named.rstrip("/")
    if held.isDefined():
        return held.get().rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="chronoweave-")
    context.setCheckpointDir(f"file://{own}")
    atexit.register(shutil.rmtree, own, True)
    return f"file://{own}"


def new_folder(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark)}/chronoweave/{what}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def folders(spark: SparkSession, path: str) -> list[str]:
    """The names of what lies in a folder, none where there is no such folder."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().getName() for f in system.listStatus(target)] if system.exists(target) else []


def write_table(spark: SparkSession, df: DataFrame, path: str) -> DataFrame:
    """Write a frame to a folder, in place of what was there, and read it back. What the step shuffled is of no use
    once its table is written: Spark may delete it then."""
    held = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, held)
    back = spark.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def materialize(spark: SparkSession, df: DataFrame, what: str) -> DataFrame:
    """Write a frame and read it back: the plan starts anew and survives lost executors. The path is in the
    frame's ``written_to`` attribute."""
    return write_table(spark, df, new_folder(spark, what))


def release(spark: SparkSession, df: DataFrame) -> None:
    delete_folder(spark, df.written_to)


def materialize_counting(spark: SparkSession, df: DataFrame, what: str, condition: Column) -> tuple[DataFrame, int]:
    """As materialize, with the number of rows that meet a condition, counted while they are written."""
    seen = Observation()
    back = materialize(spark, df.observe(seen, F.count_if(condition).alias("n")), what)
    return back, seen.get.get("n") or 0
