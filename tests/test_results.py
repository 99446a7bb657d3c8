"""Stereo results, depth metrics, expiry of maps and capsules against boxes: known answers and brute-force twins."""

import datetime as dt
import hashlib
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanspark.operators.joins import capsule_box_findings
from scanspark.sources import sessions
from scanspark.streaming import maps as stream_maps


def put(folder, name, a):
    buffer = io.BytesIO()
    np.save(buffer, a)
    (folder / f"{name}.npy").write_bytes(buffer.getvalue())
    return {"path": f"{name}.npy", "sha256": hashlib.sha256(buffer.getvalue()).hexdigest()}


def results(root, names):
    for k, name in enumerate(names):
        folder = root / name
        folder.mkdir(parents=True)
        depth = np.arange(6, dtype=np.float32).reshape(2, 3) + k
        arrays = {"disparity_px": depth * 2, "valid_mask": depth > 2, "depth_m": depth} | ({"confidence": depth / 10} if k else {})
        files = {n: put(folder, n, a) for n, a in arrays.items()} | {"left_rectified": put(folder, "left_rectified", np.zeros((2, 3), np.uint8))}
        source = {"view_id": name, "sequence_index": k, "frame_number": 10 + k}
        (folder / "metadata.json").write_text(json.dumps({"schema_version": 1 + k, "source": source, "files": files}))


def test_stereo_results(spark, tmp_path):
    results(tmp_path, ["a", "b"])
    rows = {(r.view_id, r.v, r.u): r for r in sessions.read_stereo_results(spark, str(tmp_path)).collect()}
    assert len(rows) == 12
    a, b = rows["a", 1, 0], rows["b", 1, 2]
    assert (a.seq, a.frame_number, a.disparity_px, a.valid, a.confidence, a.depth_m) == (0, 10, 6.0, True, None, 3.0)
    assert (b.seq, b.disparity_px, b.valid, round(b.confidence, 6), b.depth_m) == (1, 12.0, True, 0.6, 6.0)
    (tmp_path / "a/depth_m.npy").write_bytes((tmp_path / "b/depth_m.npy").read_bytes())
    with pytest.raises(Exception, match="invalid stereo result"):
        sessions.read_stereo_results(spark, str(tmp_path)).collect()


def test_depth_metrics_are_written_once(spark, tmp_path):
    path = str(tmp_path / "out")
    errors = spark.createDataFrame([(v, u, 0.1 * v) for v in (1, 2) for u in range(3)], "view_id long, u long, err double")
    metrics = errors.groupBy("view_id").agg(F.avg("err").alias("mean"))
    assert sessions.write_depth_metrics(errors.filter("view_id = 1"), metrics.filter("view_id = 1"), path).count() == 0
    again = errors.withColumn("err", F.lit(9.0))
    refused = sessions.write_depth_metrics(again, again.groupBy("view_id").agg(F.avg("err").alias("mean")), path)
    assert [r.view_id for r in refused.collect()] == [1]
    got = spark.read.parquet(f"{path}/errors").groupBy("view_id").agg(F.count("*").alias("n"), F.max("err").alias("e")).orderBy("view_id").collect()
    assert [(r.view_id, r.n, r.e) for r in got] == [(1, 3, 0.1), (2, 3, 9.0)]


def test_metrics_as_text(spark, tmp_path):
    rows = spark.createDataFrame([(1, 0.0012345, 0.5, ["n", "rmse"]), (2, None, None, [])], "pair_id long, rmse double, inlier double, reasons array<string>")
    sessions.export_metrics(rows.coalesce(1), str(tmp_path / "csv"), {"rmse": "rmse_mm"}, ["inlier"])
    lines = [r.value for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert lines == ["pair_id,rmse_mm,inlier,reasons", "1,1.234500,0.500000000,n; rmse", '2,,,""']


def at(s):
    return dt.datetime.fromtimestamp(s, dt.UTC)


MAPS = "map_id long, version long, state string, built timestamp"


def test_maps_expire(spark):
    rows = [(1, 0, "READY", at(0)), (1, 1, "READY", at(95)), (2, 0, "READY", at(89)), (3, 0, "READY", at(90)), (4, 0, "EMPTY", at(0)), (5, 0, "READY", None), (6, 0, "READY", at(101))]
    got = stream_maps.expired_maps(spark.createDataFrame(rows, MAPS), 10.0, F.timestamp_seconds(F.lit(100))).collect()
    assert sorted((r.map_id, r.version, r.state) for r in got) == [(2, 1, "STALE"), (5, 1, "STALE"), (6, 1, "STALE")]


def test_a_stream_of_maps_expires(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    batches = [[(1, 0, "READY", at(1000)), (2, 0, "READY", at(1001)), (3, 0, "EMPTY", at(1000))], [(1, 1, "READY", at(1008))], [(None, 0, "BEAT", at(1012))], [(None, 1, "BEAT", at(1030))], [(None, 2, "BEAT", at(1031))]]
    for rows in batches:
        spark.createDataFrame(rows, MAPS).coalesce(1).write.mode("append").parquet(source)
        stream = stream_maps.map_expiry(spark.readStream.schema(MAPS).parquet(source), 10.0)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.schema(stream_maps.EXPIRED).parquet(out).collect()
    assert sorted((r.map_id, r.version) for r in got) == [(1, 2), (2, 1)]


def test_capsules_meet_boxes(spark):
    rnd = np.random.default_rng(7)
    ends, corners = rnd.uniform(-1, 1, (80, 2, 3)), np.sort(rnd.uniform(-1, 1, (12, 2, 3)), axis=1)
    ends[:20, 1, 0], ends[20:30, 1] = ends[:20, 0, 0], ends[20:30, 0]
    capsules = spark.createDataFrame([(k, 0, 0.05, *map(float, e.ravel())) for k, e in enumerate(ends)], "sample_id long, n long, r double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    boxes = spark.createDataFrame([(k, *map(float, c.ravel())) for k, c in enumerate(corners)], "box_id long, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double")
    got = sorted((r.sample_id, r.box_id) for r in capsule_box_findings(capsules, boxes, 0.01, 0.4).collect())
    assert len(got) == len(set(got))
    t = np.linspace(0, 1, 4001)[:, None]
    sampled, wide = set(), set()
    for k, (p, q) in enumerate(ends):
        line = p + t * (q - p)
        for b, (low, high) in enumerate(corners):
            inside = lambda e: ((line >= low - e) & (line <= high + e)).all(1).any()  # noqa: B023, E731
            sampled |= {(k, b)} if inside(0.06) else set()
            wide |= {(k, b)} if inside(0.0615) else set()
    assert sampled <= set(got) <= wide
