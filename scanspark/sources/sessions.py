"""Recorded sessions, image arrays and versioned tables: reading, appending once, checking."""

from __future__ import annotations

import ast
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scanspark.operators.metrics import table_hash
from scanspark.sources.scratch import stored

MANIFEST = "schema_version int, session_id string, views array<struct<seq: int, view_id: string, files: array<struct<path: string, sha256: string>>>>"
LABEL = "view_id string, side string, incidence_deg double"
SCHEMA_VERSION = 1


def read_session(spark: SparkSession, path: str) -> DataFrame:
    """One row for each view of the manifests under path, with valid and reasons: unknown schema, a sequence given twice, a path that is absolute or leaves the session."""
    m = spark.read.schema(MANIFEST).option("multiLine", True).json(path)
    v = m.select("schema_version", "session_id", F.explode("views").alias("v")).select("schema_version", "session_id", "v.*")
    twice = F.count(F.lit(1)).over(Window.partitionBy("session_id", "seq")) > 1
    escapes = F.exists("files", lambda f: f["path"].startswith("/") | f["path"].rlike(r"(^|/)\.\.(/|$)"))
    why = [(F.coalesce(F.col("schema_version") != SCHEMA_VERSION, F.lit(True)), "schema"), (twice, "sequence"), (F.coalesce(escapes, F.lit(False)), "path")]
    reasons = F.array_compact(F.array(*(F.when(bad, name) for bad, name in why)))
    return v.withColumns({"reasons": reasons, "valid": F.size(reasons) == 0})


def explode_frames(spark: SparkSession, path: str, column: str = "value") -> DataFrame:
    """path, v, u and the value of each pixel of the two-dimensional .npy arrays under path; a file is decoded by the task that reads it."""

    def decode(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame["path"], frame["content"], strict=True):
                a = read_npy(bytes(content))
                v, u = np.indices(a.shape)
                yield pd.DataFrame({"path": name, "v": v.ravel().astype(np.int32), "u": u.ravel().astype(np.int32), column: a.ravel().astype(float)})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(decode, f"path string, v int, u int, {column} double")


def read_npy(content: bytes) -> np.ndarray:
    """A C-ordered two-dimensional array of numbers; anything else (pickled objects too) is an error."""
    if content[:6] != b"\x93NUMPY":
        raise ValueError("not an .npy file")
    wide = content[6] >= 2
    size = int.from_bytes(content[8 : 12 if wide else 10], "little")
    start = (12 if wide else 10) + size
    head = ast.literal_eval(content[start - size : start].decode("latin-1"))
    kind = np.dtype(head["descr"])
    if kind.hasobject or head["fortran_order"] or len(head["shape"]) != 2:
        raise ValueError("only C-ordered two-dimensional arrays of numbers are read")
    return np.frombuffer(content, kind, offset=start).reshape(head["shape"])


def append_new(frame: DataFrame, path: str, keys: list[str], partition: str | None = None) -> DataFrame:
    """Appends the rows of frame whose keys the table at path doesn't have yet, one of each key, and returns all others (refused).

    Of rows of one key that with the smallest hash is appended. The rows are marked and stored before the table changes.
    """
    spark = frame.sparkSession
    try:
        there = spark.read.parquet(path).select(*keys).distinct().withColumn("__there", F.lit(True))
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        there = None
    order = Window.partitionBy(*keys).orderBy(F.xxhash64(*frame.columns), *frame.columns)
    marked = frame.withColumn("__nth", F.row_number().over(order))
    marked = marked.withColumn("__there", F.lit(None).cast("boolean")) if there is None else marked.join(there, keys, "left")
    marked = stored(marked.select(*frame.columns, ((F.col("__nth") == 1) & F.col("__there").isNull()).alias("__new")), "append")
    writer = marked.filter("__new").select(*frame.columns).write.mode("append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
    return marked.filter("NOT __new").select(*frame.columns)


def verify_checksums(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path, ok for each file of a manifest (path, sha256): false if it is missing or its content (files: path, content) differs."""
    own = files.select("path", F.sha2("content", 256).alias("own"))
    return manifest.join(own, "path", "left").select("path", F.coalesce(F.col("own") == F.col("sha256"), F.lit(False)).alias("ok"))


def tree_hash(files: DataFrame) -> DataFrame:
    """Files, bytes and a SHA-256 of the set of files (path, content), whatever their order.

    Each file's path and content hash are hashed; these hashes, sorted, are hashed in 4096 buckets by their first three digits, and the buckets' hashes in order.
    """
    sha = F.sha2(F.concat_ws(" ", "path", F.sha2("content", 256)), 256)
    each = files.select(F.length("content").cast("long").alias("n"), sha.alias("sha"))
    listed = lambda c: F.sha2(F.array_join(F.sort_array(F.collect_list(c)), ""), 256)
    parts = each.groupBy(F.substring("sha", 1, 3).alias("bucket")).agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), listed("sha").alias("sha"))
    return parts.agg(F.coalesce(F.sum("k"), F.lit(0)).alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"), listed(F.concat("bucket", "sha")).alias("sha256"))


def write_snapshot(rows: DataFrame, path: str, map_id: int, seq: int) -> str:
    """Writes one version of a map once: the same content again changes nothing, other content under the id is refused. Returns the content's hash."""
    spark = rows.sparkSession
    digest = table_hash(rows).first()["sha256"]
    target = f"{path}/map_id={map_id}/seq={seq}"
    try:
        there = table_hash(spark.read.schema(rows.schema).parquet(target)).first()["sha256"]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there = None
    if there is None:
        rows.write.parquet(target)
    elif there != digest:
        raise ValueError(f"map {map_id} has other content at sequence {seq}")
    return digest


def read_snapshot(spark: SparkSession, path: str, map_id: int, seq: int, schema, digest: str) -> DataFrame:
    """The rows of a map version, if their hash is still the one given."""
    rows = spark.read.schema(schema).parquet(f"{path}/map_id={map_id}/seq={seq}")
    if table_hash(rows).first()["sha256"] != digest:
        raise ValueError("the snapshot's content has changed")
    return rows


def read_label_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Labels as JSON lines; other keys than LABEL's are an error."""
    allowed = {part.split()[0] for part in LABEL.split(", ")}
    extra = spark.read.text(path).filter("length(trim(value)) > 0").select(F.explode(F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, sorted(allowed))))).alias("key"))
    if found := [r["key"] for r in extra.distinct().limit(5).collect()]:
        raise ValueError(f"unknown label keys: {found}")
    return spark.read.schema(LABEL).option("mode", "FAILFAST").json(path)


def write_clouds(points: DataFrame, path: str) -> None:
    """Points of registered clouds, one folder for each session."""
    points.write.mode("append").partitionBy("session_id").parquet(path)


def export_overlay(points: DataFrame, path: str, label: str) -> None:
    """Labelled points as CSV with a header."""
    points.withColumn("label", F.lit(label)).write.mode("append").option("header", True).csv(path)


def write_depth_metrics(errors: DataFrame, metrics: DataFrame, path: str) -> DataFrame:
    """Keeps views' error pixels (errors: view_id, ..) and their metrics row (view_id, ..) under path, and returns the metrics rows of views already there (refused).

    Each call is a batch: its pixels go to errors/batch=<number>, sorted by view, and are written before its metrics rows, which hold the number. A batch without metrics rows
    is what a broken run left; the next call takes its number and replaces it, so a view is there whole or not at all. There is one writer at a time.
    """
    spark = errors.sparkSession
    try:
        there = spark.read.schema(metrics.select("view_id", F.lit(0).cast("long").alias("batch")).schema).parquet(f"{path}/metrics")
        there = stored(there, "views-there")
        batch = there.agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        there, batch = None, 0
    new = metrics.select("view_id").distinct() if there is None else metrics.select("view_id").distinct().join(there.hint("merge"), "view_id", "left_anti")
    pixels = errors.join(stored(new, "views-new").hint("shuffle_hash"), "view_id", "left_semi").sortWithinPartitions("view_id")
    pixels.write.mode("overwrite").parquet(f"{path}/errors/batch={batch}")
    return append_new(metrics.withColumn("batch", F.lit(batch).cast("long")), f"{path}/metrics", ["view_id"]).drop("batch")


def export_metrics(metrics: DataFrame, path: str, lengths: dict[str, str], shares: list[str]) -> None:
    """Metrics rows of pairs as CSV with a header: lengths (column in metres: name) in millimetres with six decimals, shares with nine, reasons joined by "; ", others as they are; null is empty."""
    cell = lambda c, places: F.when(c.isNotNull(), F.format_string(f"%.{places}f", c.cast("double")))

    def written(c: str):
        if c in lengths:
            return cell(F.col(c) * 1000, 6).alias(lengths[c])
        if c in shares:
            return cell(F.col(c), 9).alias(c)
        return F.array_join(c, "; ").alias(c) if metrics.schema[c].dataType.typeName() == "array" else F.col(c)

    metrics.select(*map(written, metrics.columns)).write.mode("append").option("header", True).csv(path)


STEREO_META = "schema_version int, source struct<view_id: string, sequence_index: int, frame_number: long>, files map<string, struct<path: string, sha256: string>>"
STEREO_SCHEMAS = (1, 2)


def read_stereo_results(spark: SparkSession, path: str) -> DataFrame:
    """view_id, seq, frame_number, v, u, disparity_px, valid, confidence (null where a result has none) and depth_m of each pixel of the results under path.

    A result is a folder with metadata.json, which names its .npy arrays (disparity_px, valid_mask, depth_m and, perhaps, confidence) and their
    SHA-256. An unknown schema, a missing array, another hash or unlike shapes are an error. The arrays of one result (an image) meet in one task.
    """
    folder = lambda c: F.regexp_replace(c, "/[^/]*$", "")
    wanted = ["disparity_px", "valid_mask", "depth_m", "confidence"]
    meta = spark.read.schema(STEREO_META).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").json(path)
    meta = meta.select(folder(F.col("_metadata.file_path")).alias("root"), "schema_version", "source.*", F.explode("files").alias("name", "file")).filter(F.col("name").isin(wanted))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    bare = lambda c: F.regexp_replace(c, "^file:/+", "file:/")
    rows = meta.withColumn("at", bare(F.concat_ws("/", "root", "file.path"))).join(files.select(bare(F.col("path")).alias("at"), "content"), "at", "left")
    rows = rows.select("root", "schema_version", "view_id", F.col("sequence_index").alias("seq"), "frame_number", "name", "content", F.coalesce(F.sha2("content", 256) == F.col("file.sha256"), F.lit(False)).alias("same"))

    def decode(parts: pd.DataFrame) -> pd.DataFrame:
        first = parts.iloc[0]
        if first["schema_version"] not in STEREO_SCHEMAS or not parts["same"].all() or set(wanted[:3]) - set(parts["name"]):
            raise ValueError(f"invalid stereo result {first['root']}")
        arrays = {name: read_npy(bytes(content)) for name, content in zip(parts["name"], parts["content"], strict=True)}
        if len({a.shape for a in arrays.values()}) > 1:
            raise ValueError(f"arrays of unlike shapes in {first['root']}")
        v, u = np.indices(arrays["depth_m"].shape)
        out = {"view_id": first["view_id"], "seq": first["seq"], "frame_number": first["frame_number"], "v": v.ravel(), "u": u.ravel()}
        out |= {"disparity_px": arrays["disparity_px"].ravel().astype(float), "valid": arrays["valid_mask"].ravel().astype(bool)}
        out |= {"confidence": arrays["confidence"].ravel().astype(float) if "confidence" in arrays else None, "depth_m": arrays["depth_m"].ravel().astype(float)}
        return pd.DataFrame(out)

    return rows.groupBy("root").applyInPandas(decode, "view_id string, seq int, frame_number long, v int, u int, disparity_px double, valid boolean, confidence double, depth_m double")


def run_model(frames: DataFrame, model, schema: str) -> DataFrame:
    """A user's callable (pandas DataFrame to pandas DataFrame) over batches of frames, on the executors."""

    def applied(parts: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_pandas(model(part.to_pandas()), preserve_index=False)

    return frames.mapInArrow(applied, schema)


POSE_JSON = "struct<tx: double, ty: double, tz: double>"
VIEW_JSON = f"struct<view_id: long, seq: int, robot: struct<before: {POSE_JSON}, after: {POSE_JSON}, selected: {POSE_JSON}>, sync: struct<bracket_ms: double, offset_ms: double>>"


def flatten_view_metadata(views: DataFrame, column: str = "metadata") -> DataFrame:
    """View JSON to typed columns: the selected robot pose, how far the robot moved around the frame, and the synchronisation figures."""
    v = views.select(F.from_json(column, VIEW_JSON, {"mode": "FAILFAST"}).alias("v")).select("v.*")
    moved = F.sqrt(sum(((F.col(f"robot.after.{t}") - F.col(f"robot.before.{t}")) ** 2 for t in ("ty", "tz")), (F.col("robot.after.tx") - F.col("robot.before.tx")) ** 2))
    return v.select("view_id", "seq", "robot.selected.*", moved.alias("moved_m"), "sync.*")


def write_ledger(ledger: DataFrame, path: str, ledger_id: str, generation: int) -> None:
    """One generation of a coverage ledger; a generation is never overwritten."""
    ledger.write.mode("error").parquet(f"{path}/ledger_id={ledger_id}/generation={generation}")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The newest generation of each ledger."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("ledger_id").agg(F.max("generation").alias("generation"))
    return rows.join(newest, ["ledger_id", "generation"])


def read_clouds(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
