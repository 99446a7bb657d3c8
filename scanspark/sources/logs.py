"""Event logs and timing reports: JSON lines to ordered rows, in batch or as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT = "run_id string, seq long, type string, ts timestamp, payload string, prev_sha string, sha string"
SPAN = "count long, failure_count long, inclusive_wall_ns long, exclusive_wall_ns long, inclusive_cpu_ns long, exclusive_cpu_ns long"


def event_suffix(events: DataFrame, cursor: int) -> DataFrame:
    """Events from a sequence number on."""
    return events.filter(F.col("seq") >= cursor)


def read_event_log(spark: SparkSession, path: str, cursor: int = 0, stream: bool = False) -> DataFrame:
    """JSON lines of EVENT, from cursor on; broken lines are errors. As a stream, the checkpoint is the cursor of what was read."""
    reader = spark.readStream if stream else spark.read
    return event_suffix(reader.schema(EVENT).option("mode", "FAILFAST").json(path), cursor)


def read_timing_reports(spark: SparkSession, path: str) -> DataFrame:
    """trial_id, name and the counters of each span of timing reports (one JSON object a file: trial_id and a map of spans)."""
    rows = spark.read.schema(f"trial_id string, spans map<string, struct<{SPAN.replace(' long', ': long')}>>").option("multiLine", True).json(path)
    return rows.select("trial_id", F.explode("spans").alias("name", "s")).select("trial_id", "name", "s.*")


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """Snapshots (session_id, seq, snapshot_id, ts) with valid: one id each, sequences ascending with time."""
    from pyspark.sql import Window

    rows = spark.read.schema("session_id string, seq long, snapshot_id string, ts timestamp").json(path)
    w = Window.partitionBy("session_id").orderBy("seq")
    once = F.count(F.lit(1)).over(Window.partitionBy("session_id", "snapshot_id")) == 1
    return rows.withColumn("valid", once & F.coalesce((F.col("ts") >= F.lag("ts").over(w)) & (F.col("seq") > F.lag("seq").over(w)), F.lit(True)))
