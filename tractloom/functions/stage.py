"""Cut a plan at a result that several later steps read."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: str | None = None


def stage_dir(spark: SparkSession) -> str:
    """Folder for this session's staged tables, below the shared ``spark.checkpoint.dir``.

    A single-process local session without that setting gets a temporary folder; on any other
    master executors could not see such a folder, so the missing setting is an error.
    """
    global _local_root
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="spark-stage-")
            atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
        root = _local_root
    return f"{root.rstrip('/')}/staged/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str | None = None) -> DataFrame:
    """Write ``df`` once as a Parquet table and read it back.

    Later steps then scan only the columns they need, with known sizes, instead of running the
    plan again; losing executors does not lose the table. A table written again under the same
    ``name`` replaces the earlier one, so a loop that alternates two names keeps two tables.
    """
    spark = df.sparkSession
    path = f"{stage_dir(spark)}/{name or uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *names: str) -> None:
    """Delete staged tables of this session by name, once no later step reads them."""
    jvm = spark.sparkContext._jvm
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{stage_dir(spark)}/{name}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Delete all staged tables of this session; data frames built on them end with it."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(stage_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
