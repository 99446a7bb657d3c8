"""Work that follows the rows, not their pairs: what dense places and copies cost, and that results stay those of brute force."""

from __future__ import annotations

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scanspark.functions import columns as C
from scanspark.operators import geometry, graph, joins, maps, planning, ranks, reports, surface
from scanspark.sources import sessions
from scanspark.sources.scratch import stored

PLACE = "k long, i long, x double, y double, z double"


def cloud(n: int, seed: int, copies: int = 1) -> list[tuple]:
    """n places, most of them within a millimetre, some far off, each `copies` times."""
    rng = np.random.default_rng(seed)
    at = np.concatenate([rng.normal(0, 1e-3, (n - n // 10, 3)), rng.normal(0, 0.5, (n // 10, 3))])
    return [(int(j % 2), int(j + len(at) * c), *map(float, p)) for c in range(copies) for j, p in enumerate(at)]


def gaps(a: list[tuple], b: list[tuple]) -> np.ndarray:
    p, q = np.array([r[2:] for r in a]), np.array([r[2:] for r in b])
    x, y, z = (q[None, :, i] - p[:, None, i] for i in range(3))
    other = np.array([r[0] for r in a])[:, None] != np.array([r[0] for r in b])[None]
    return np.where(other, np.inf, x * x + y * y + z * z)


@pytest.mark.parametrize("copies", [1, 5])
def test_nearest_in_dense_places_is_that_of_brute_force(spark, copies):
    a, b = cloud(150, 1), cloud(300, 2, copies)
    got = joins.nearest_neighbor(spark.createDataFrame(a, PLACE), spark.createDataFrame(b, PLACE).withColumnRenamed("i", "j"), 0.3, "i", "j", ["k"]).collect()
    d = gaps(a, b)
    best = d.argmin(1)
    want = {a[n][1]: b[m][1] if d[n, m] <= 0.09 else None for n, m in enumerate(best)}
    assert len(got) == len(a) and {r.i: r.j for r in got} == want


def test_neighbours_of_copies_are_those_of_brute_force(spark):
    a = cloud(40, 3, 6)
    got = joins.knn(spark.createDataFrame(a, PLACE), 8, 0.3, "i", ["k"]).collect()
    d = gaps(a, a)
    np.fill_diagonal(d, np.inf)
    ids = np.array([r[1] for r in a])
    want = {(a[n][1], int(ids[m]), rank + 1) for n in range(len(a)) for rank, m in enumerate(np.lexsort((ids, d[n]))[:8])}
    assert {(r.point_id, r.neighbor_id, r["rank"]) for r in got} == want


def test_radius_starts_where_a_cell_holds_few(spark):
    rows = spark.createDataFrame(cloud(2000, 4), PLACE)
    assert joins.start_radius(rows, 0.5, ["k"]) < 2e-3
    assert joins.start_radius(rows.limit(0), 0.5, ["k"]) == 0.5


def test_evidence_prefers_the_first_of_equals(spark):
    samples = spark.createDataFrame([(0, 1, 7, 0.0, 0.0, 0.0), (0, 2, 7, 5.0, 0.0, 0.0)], "side long, sample_id long, patch_id long, x double, y double, z double")
    seen = [(0, 10, 3, 0.1, 0.05, 0.0, 0.0), (0, 11, 2, 0.2, -0.05, 0.0, 0.0), (0, 12, 2, 0.3, 0.05, 0.0, 0.0), (1, 13, 0, 0.4, 0.0, 0.0, 0.0)]
    got = maps.surface_evidence(samples, spark.createDataFrame(seen, "side long, point_id long, seq long, cosine double, x double, y double, z double"), 0.1)
    assert {r.sample_id: (r.distance, r.cosine) for r in got.collect()} == {1: (0.05, 0.2), 2: (None, None)}


def test_views_in_one_pose_are_one_place(spark, monkeypatch):
    """300 views in one pose and one beside them are two places to the search for duplicates."""
    met = []
    real = joins.radius_join
    monkeypatch.setattr(reports, "radius_join", lambda a, *args, **more: (met.append(a.count()), real(a, *args, **more))[1])
    turn = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    views = [(1, i, "p", 0.3, 1.0, 1.0, 0.1, 0.1, *turn, 0.0 if i < 300 else 0.2, 0.0, -0.3) for i in range(301)]
    schema = "plan_id long, view_id long, patch_id string, distance double, projection double, visibility double, footprint_u double, footprint_v double, " + ", ".join(f"{c} double" for c in C.POSE)
    patches = spark.createDataFrame([(1, "p", "front", "surface", 0.0, 0.0, 0.0, 0.0, 0.0, -1.0)], "plan_id long, patch_id string, side string, region string, cx double, cy double, cz double, mx double, my double, mz double")
    rows, _ = reports.inspect_plan(spark.createDataFrame(views, schema), patches, reports.PlanLimits(0.3))
    assert met == [2]
    assert {r.view_id for r in rows.filter("reasons LIKE '%duplicate%'").collect()} == set(range(300))


def test_pixels_of_views_are_kept_by_batch(spark, tmp_path, monkeypatch):
    """300 views are one folder, and what a broken run left is replaced."""
    path = str(tmp_path / "out")
    errors = spark.range(900).select((F.col("id") % 300).alias("view_id"), F.col("id").alias("u"), F.lit(0.5).alias("err"))
    metrics = errors.groupBy("view_id").agg(F.avg("err").alias("mean"))
    with monkeypatch.context() as broken, pytest.raises(RuntimeError):
        broken.setattr(sessions, "append_new", lambda *_: (_ for _ in ()).throw(RuntimeError("broken")))
        sessions.write_depth_metrics(errors, metrics, path)
    sessions.write_depth_metrics(errors.filter("view_id < 200"), metrics.filter("view_id < 200"), path)
    assert sessions.write_depth_metrics(errors, metrics, path).count() == 200
    assert sorted(d for d in os.listdir(f"{path}/errors") if "=" in d) == ["batch=0", "batch=1"]
    got = spark.read.parquet(f"{path}/errors").groupBy("view_id").count().collect()
    assert len(got) == 300 and {r["count"] for r in got} == {3}


def test_ranks_are_exact_and_rank_few_values(spark):
    """Ties, far values, nulls and a group of one row; of 40,000 values a hundredth at most is ranked."""
    rows = spark.range(40_000).select((F.col("id") % 2).alias("k"), F.when(F.col("id") % 2 == 0, F.pow(F.xxhash64("id") / 1e18, 3)).otherwise(F.floor(F.col("id") / 9000) * 1.0).alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(2, 5.0), (2, None), (3, None)], "k long, v double")).cache()
    for q in (0.0, 0.5, 0.95, 1.0):
        want = {r.k: r.p for r in rows.groupBy("k").agg(F.percentile("v", q).alias("p")).collect() if r.p is not None}
        assert {r.k: r.p for r in ranks.percentile(rows, ["k"], "v", q, "p").collect()} == pytest.approx(want)
    kept, real = [], ranks.stored
    try:
        ranks.stored = lambda df, what: (kept.append(real(df, what)), kept[-1])[1]
        ranks.nearest_rank(rows, ["k"], "v", 0.95, "p").collect()
    finally:
        ranks.stored = real
    assert kept[-1].count() < 400


def test_pairs_of_a_key_are_work_for_many_tasks(spark):
    same = [F.lit(1.0 if c in ("r00", "r11", "r22") else 0.0).alias(c) for c in C.POSE]
    poses = spark.range(40).select(F.lit(1).alias("k"), F.col("id").alias("i"), *same)
    sides = spark.range(40).select(F.lit(1).alias("k"), "id", (F.col("id") % 2 - 0.5).alias("off"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for pairs, n in ((joins.pose_pairs(poses, "k", "i"), 780), (joins.opposing_pairs(sides, ["k"], "off", "id"), 400)):
            got = pairs.groupBy(F.spark_partition_id()).count().collect()
            assert len(got) > 1 and sum(r["count"] for r in got) == n
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_opposing_pairs_pack_and_are_whole(spark, monkeypatch, tmp_path):
    """Files hold a family's pairs in a fraction of a byte each; cuts of any size give all pairs, of families that have both sides and no null key."""
    sides = spark.range(4000).select(F.lit(1).alias("k"), F.xxhash64("id").alias("id"), (F.col("id") % 2 - 0.5).alias("off"))
    joins.opposing_pairs(sides, ["k"], "off", "id").write.parquet(f"{tmp_path}/pairs")
    sizes = [p.stat().st_size for p in tmp_path.rglob("*.parquet")]
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert got.count() == got.distinct().count() == 2000 * 2000
    assert sum(sizes) < 0.6 * 2000 * 2000 and max(sizes) < 0.3 * sum(sizes)
    for name, size in (("MEET", 3), ("IDS", 2), ("PART_IDS", 4), ("ROWS", 20), ("FEW_ROWS", 20)):
        monkeypatch.setattr(joins, name, size, raising=False)
    rows = [(k, f, i, float(i % 3 - 1)) for i in range(90) for k, f in [[(1, "a"), (1, "b"), (2, "a"), (None, "a")][i % 4]]] + [(3, "a", 200, 1.0), (4, "b", 201, -1.0), (1, "a", 202, None)]
    got = joins.opposing_pairs(spark.createDataFrame(rows, "k long, f string, id long, off double"), ["k", "f"], "off", "id").select("k", "f", "negative_id", "positive_id").collect()
    assert sorted(map(tuple, got)) == sorted((k, f, i, j) for k, f, i, o in rows for m, g, j, p in rows if k and (k, f) == (m, g) and (o or 0) < 0 < (p or 0))


def test_poses_that_are_alike_are_weighted(spark, monkeypatch):
    turns = [(1.0, 0.0), (0.0, 1.0), (-1.0, 0.0)]
    poses = [(1, i, c, -s, 0.0, s, c, 0.0, 0.0, 0.0, 1.0, float(i % 2), 0.0, 0.0) for i in range(60) for c, s in [turns[i % 3]]]
    frame = spark.createDataFrame(poses, "k long, i long, " + ", ".join(f"{c} double" for c in C.POSE))
    met, real = [], joins.pose_pairs
    monkeypatch.setattr(surface, "pose_pairs", lambda rows, *more: (met.append(rows.count()), real(rows, *more))[1])
    got = surface.pose_observability(frame, "k", "i").first()
    assert met == [6]
    assert (got.most_deg, got.most_m, got.axis_diversity) == pytest.approx((180.0, 1.0, 0.0))


def test_voxels_of_rays_are_held_in_bounded_memory():
    n = 20_000
    ends = np.random.default_rng(5).uniform(20, 90, (3, n))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in (np.zeros(n, np.int64), np.zeros(n, np.int64), *np.zeros((3, n)), *ends)], ["map_id", "seq", *geometry.RAY])
    tracemalloc.start()
    rows = sum(b.num_rows for b in geometry.voxel_batches(iter([batch]), 2.0, 0.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows > 10_000 and peak < 150e6, peak


def test_components_by_radius_are_those_of_all_pairs(spark, monkeypatch):
    """Clouds, chains whose cells' smallest ids lie apart, copies, and points that are nowhere; 1,500 points in one spot meet as one cell."""
    rng = np.random.default_rng(6)
    at = np.concatenate([rng.uniform(0, 1, (150, 3)), rng.normal(0.5, 0.03, (100, 3)), np.linspace((0, 0, 2), (3, 0, 2), 40)])
    rows = [(int(i % 2), int(i), *map(float, x)) for i, x in enumerate(np.concatenate([at, at[:20]]))] + [(0, 900, float("nan"), 0.0, 0.0), (0, 901, None, 0.0, 0.0)]
    points = spark.createDataFrame(rows, PLACE)
    for r in (0.05, 0.12, 0.2):
        near = joins.radius_join(points, points, r, "i", "i", ["k"])
        want = {x.node: x.root for x in graph.components(near, "i_a", "i_b").collect()}
        got = {x.node: x.root for x in graph.radius_components(points, r, "i", ["k"]).collect()}
        assert {n: x for n, x in got.items() if n in want} == want and all(n == x for n, x in got.items() if n not in want)
        assert len(got) == len(rows) - 2
    met, real = [], graph.components
    monkeypatch.setattr(graph, "components", lambda links, *more: (met.append(links.count()), real(links, *more))[1])
    spot = spark.range(1500).select(F.lit(0).alias("k"), F.col("id").alias("i"), (F.col("id") * 1e-6).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    assert graph.radius_components(spot, 0.1, "i", ["k"]).agg(F.count("*"), F.max("root")).first() == (1500, 0)
    assert max(met) <= 1


@pytest.mark.parametrize("tile", [7, 1024])
def test_pairs_of_a_table_with_itself_are_those_of_brute_force(spark, monkeypatch, tile):
    """By key and with copies, one id twice, and points that are nowhere."""
    monkeypatch.setattr(joins, "TILE", tile, raising=False)
    monkeypatch.setattr(joins, "AT_ONCE", 50 * tile, raising=False)
    rows = [*cloud(200, 8), *cloud(20, 9, 3), (0, 1, 0.3, 0.3, 0.3)]
    lost = [(0, 900, float("nan"), 0.0, 0.0), (0, 901, None, 0.0, 0.0), (None, 902, 0.0, 0.0, 0.0), (1, 903, 0.0, float("inf"), 0.0), (1, 904, 0.0, 0.0, float("-inf"))]
    d = gaps(rows, rows)
    for r in (0.001, 0.4):
        points = spark.createDataFrame(rows + lost, PLACE)
        got = sorted(map(tuple, joins.radius_join(points, points, r, "i", "i", ["k"]).select("k", "i_a", "i_b", "d2").collect()))
        assert got == sorted((rows[a][0], rows[a][1], rows[b][1], float(d[a, b])) for a, b in zip(*np.nonzero(d <= r * r), strict=True))
    none = points.limit(0)
    assert joins.radius_join(none, none, 0.1, "i", "i").isEmpty()


def test_pairs_of_a_dense_cell_come_from_many_tasks_and_pack(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(joins, "TILE", 100, raising=False)
    monkeypatch.setattr(joins, "TESTS", 100_000, raising=False)
    at = np.random.default_rng(10).uniform(0, 0.05, (1500, 3))
    points = spark.createDataFrame([(0, i, *map(float, x)) for i, x in enumerate(at)], PLACE)
    joins.radius_join(points, points, 0.1, "i", "i").select("i_a", "i_b", F.round("d2", 9).alias("d2")).write.parquet(f"{tmp_path}/pairs")
    sizes = [p.stat().st_size for p in tmp_path.rglob("*.parquet")]
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 1500 * 1500
    assert len(sizes) > 8 and max(sizes) < 0.3 * sum(sizes)
    assert sum(sizes) < 8 * 1500 * 1500


def test_pairs_of_copies_are_whole_and_pack(spark, tmp_path):
    """40 points at each place, some ids null or equal; files hold a distance about once for all pairs of two places."""
    rows = [*cloud(12, 11, 40), (0, None, 0.3, 0.3, 0.3), (0, None, 0.3, 0.3, 0.3), (0, 5, -0.0, 0.0, 0.0), (0, 5, 0.0, 0.0, 0.0)]
    d = gaps(rows, rows)
    points = spark.createDataFrame(rows, PLACE)
    got = joins.radius_join(points, points, 0.4, "i", "i", ["k"]).select("k", F.coalesce("i_a", F.lit(-1)), F.coalesce("i_b", F.lit(-1)), "d2").collect()
    no = lambda i: -1 if i is None else i
    assert sorted(map(tuple, got)) == sorted((rows[a][0], no(rows[a][1]), no(rows[b][1]), float(d[a, b])) for a, b in zip(*np.nonzero(d <= 0.16), strict=True))
    at = np.random.default_rng(12).uniform(0, 0.05, (60, 3))
    points = spark.createDataFrame([(0, 60 * c + i, *map(float, x)) for c in range(40) for i, x in enumerate(at)], PLACE)
    joins.radius_join(points, points, 0.1, "i", "i").select("i_a", "i_b", "d2").write.parquet(f"{tmp_path}/pairs")
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == 2400 * 2400
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 1.2 * 2400 * 2400


def test_boxes_at_one_place_are_tested_once(spark):
    rng = np.random.default_rng(9)
    ends = rng.uniform(-1, 1, (200, 2, 3))
    capsules = [(k, 0, 0.05, *map(float, e.ravel())) for k, e in enumerate(ends)]
    corners = [tuple(map(float, np.sort(rng.uniform(-1, 1, (2, 3)), axis=0).ravel())) for _ in range(4)]
    boxes = [(k, *corners[k % 4]) for k in range(1400)] + [(None, *corners[0]), (7, *corners[1]), (2000, None, *corners[0][1:])]
    columns = ", ".join(f"{a}{k} double" for k in (0, 1) for a in "xyz")
    c, b = spark.createDataFrame(capsules, f"sample_id long, n long, r double, {columns}"), spark.createDataFrame(boxes, f"box_id long, {columns}")
    got = joins.capsule_box_findings(c, b, 0.01, 0.4)
    # By place, each box alone.
    one = [joins.capsule_box_findings(c, spark.createDataFrame([(0, *at)], f"box_id long, {columns}"), 0.01, 0.4).select("sample_id").collect() for at in corners]
    want = sorted((r.sample_id, -1 if i is None else i) for i, *at in boxes if None not in at for r in one[corners.index(tuple(at))])
    assert sorted((r.sample_id, -1 if r.box_id is None else r.box_id) for r in got.collect()) == want
    # Rows out come from many tasks.
    assert got.rdd.getNumPartitions() > 4


def test_findings_of_boxes_are_tasks_by_rows_out(spark, monkeypatch):
    """One place of boxes that all capsules meet, one of them with a null id: cuts of any size give all findings, and tasks follow these, not a fixed number of parts."""
    for name, size in (("MEET", 30), ("IDS", 16), ("PART_IDS", 64), ("ROWS", 500), ("FEW_ROWS", 500)):
        monkeypatch.setattr(joins, name, size, raising=False)
    columns = ", ".join(f"{a}{k} double" for k in (0, 1) for a in "xyz")
    c = spark.createDataFrame([(k, k % 3, 0.05, *[0.001 * k] * 6) for k in range(250)], f"sample_id long, n long, r double, {columns}")
    b = spark.createDataFrame([(k or None, *[-1.0] * 3, *[1.0] * 3) for k in range(200)], f"box_id long, {columns}")
    got = joins.capsule_box_findings(c, b, 0.01, 0.4)
    assert got.rdd.getNumPartitions() == 100
    assert max(r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()) < 250 * 200 / 8
    assert sorted(map(tuple, got.select("sample_id", "n", F.coalesce("box_id", F.lit(0))).collect())) == [(k, k % 3, i) for k in range(250) for i in range(200)]


def test_widest_gaps_are_those_of_brute_force_without_rows_for_pairs(spark):
    rng = np.random.default_rng(4)
    xy = np.concatenate([rng.normal(0, 0.05, (1500, 2)), rng.normal(0, 0.5, (100, 2)), np.zeros((40, 2)), [[9.0, 9.0]]])
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xy)] + [(-1, None, 0.0)], "point_id long, x double, y double")
    want = {}
    for i, p in enumerate(xy):
        d = np.delete(xy, i, 0) - p
        d = d[d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] <= 0.08 * 0.08]
        a = np.sort(np.arctan2(d[:, 1], d[:, 0]))
        if len(a):
            want[i] = round(float(np.degrees(np.diff(a, append=a[0] + 2 * np.pi).max())), 6)
    got = planning.widest_gaps(points, 0.08, 120.0)
    rows = got.collect()
    assert {r.point_id: round(r.gap_deg, 6) for r in rows} == want and len(rows) == len(want)
    assert all(r.boundary == (r.gap_deg > 120) for r in rows)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_stored_tables_leave_no_shuffle_files(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    shuffled = lambda: {f for f in str(disk.getAllFiles().mkString("\n")).split("\n") if "shuffle_" in f}
    before = shuffled()
    stored(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counts")
    assert not shuffled() - before
