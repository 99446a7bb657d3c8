"""Scratch tables on shared storage: where a job's lineage ends."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_root: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; where it is unset, a temporary folder, in local mode only."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return _local_root.setdefault("root", "file://" + tempfile.mkdtemp(prefix="spark-"))


def scratch_path(spark: SparkSession, what: str) -> str:
    return f"{scratch_root(spark)}/{what}-{uuid.uuid4().hex}"


#: Tasks that small tables are still dealt to.
LEAST_TASKS = 12


def sized(df: DataFrame, rows: int, each: int = 100_000) -> DataFrame:
    """df, just shuffled, in a task for each `each` of so many rows, LEAST_TASKS at least: loops over small tables don't run and write a task for each shuffle partition."""
    return df.coalesce(max(LEAST_TASKS, -(-rows // each)))


#: Whether Spark deletes a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str, compression: str = "snappy") -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and a lost executor costs only its tasks.

    What was shuffled on the way is deleted at once, not when the driver happens to collect its garbage: loops would hold the files of many rounds.
    """
    spark = df.sparkSession
    path = scratch_path(spark, what)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
