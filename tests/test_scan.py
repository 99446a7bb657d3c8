"""Scan operators: known answers, brute-force twins, batch against stream, and every query against its SQL."""

import json
import math
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanspark.functions import columns as C
from scanspark.operators import geometry, joins, maps, metrics, pixels, planning
from scanspark.plans import registry
from scanspark.sources import logs, sessions
from scanspark.streaming import maps as stream_maps
from scanspark.streaming import telemetry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_depth_to_meters(spark):
    px = spark.createDataFrame([(0, 0, 0, 1000), (0, 0, 1, 0), (0, 1, 0, 500), (0, 1, 1, 2000)], "view_id int, v int, u int, raw_depth int")
    assert [r.depth_m for r in pixels.depth_to_meters(px, 0.001).orderBy("v", "u").collect()] == pytest.approx([1.0, None, 0.5, 2.0])
    with pytest.raises(ValueError):
        pixels.depth_to_meters(px, 0)


def test_back_project_and_transform(spark):
    px = spark.createDataFrame([(0, 0, 0, 1.0), (0, 0, 1, 1.0), (0, 1, 1, 2.0), (0, 1, 0, 0.05), (0, 1, 2, 3.0)], "view_id int, v int, u int, depth_m double")
    kept = pixels.depth_range_sample(px, 0.1, 2.0, 1)
    got = pixels.back_project(kept, 2.0, 2.0, 1.0, 0.5).orderBy("v", "u").select("x", "y", "z").collect()
    assert [tuple(r) for r in got] == [(-0.5, -0.25, 1.0), (0.0, -0.25, 1.0), (0.0, 0.5, 2.0)]
    pose = spark.createDataFrame([(0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 1.0, 2.0, 3.0)], "view_id int, " + ", ".join(f"{c} double" for c in C.POSE))
    first = pixels.transform_points(pixels.back_project(kept, 2.0, 2.0, 1.0, 0.5), pose).orderBy("v", "u").first()
    assert (first.x, first.y, first.z) == (0.5, 1.75, 4.0)


def test_z_buffer_keeps_the_nearest(spark):
    p = spark.createDataFrame([(0, 1.0, 0.0, 1.0), (0, 1.0, 0.0, 0.5), (0, 11.0, 0.0, 1.0)], "view_id int, pu double, pv double, z double")
    assert [tuple(r) for r in pixels.z_buffer(p, width=3, height=2).collect()] == [(0, 0, 1, 0.5)]


def test_self_mask(spark):
    m = spark.createDataFrame([(0, 0, u, d) for u, d in enumerate([1.0, 0.7, 1.3, None])], "view_id int, v int, u int, depth_m double")
    p = spark.createDataFrame([(0, 0, u, 1.0) for u in range(4)], "view_id int, v int, u int, depth_m double")
    got = pixels.self_mask(m, p, 0.05, 0.05).orderBy("u").collect()
    assert [r.masked for r in got] == [True, False, True, False] and sum(bool(r.matched) for r in got) == 1


def test_rays_free_votes_and_states(spark):
    rays = spark.createDataFrame([(0, s, 0.25, 0.25, 0.25, 0.25, 0.25, 1.5) for s in (0, 1, 2)], "map_id long, seq long, sx double, sy double, sz double, ex double, ey double, ez double")
    crossed = geometry.ray_voxels(rays, 0.5)
    assert sorted((r.seq, r.iz) for r in crossed.collect()) == [(s, z) for s in range(3) for z in range(3)]
    hits = maps.occupied_voxels(rays.select("map_id", "seq", F.col("ex").alias("x"), F.col("ey").alias("y"), F.col("ez").alias("z")), 0.5, (2, 2, 8))
    state = {r.iz: (r.free_votes, r.state) for r in maps.occupancy_state(maps.free_votes(crossed, hits), hits).collect()}
    assert state == {0: (3, "FREE"), 1: (3, "FREE"), 2: (3, "FREE"), 3: (0, "OCCUPIED")}


def test_votes_stay_when_a_voxel_is_hit_later(spark):
    long = spark.createDataFrame([(0, 0, 0, 3, s) for s in (0, 1, 2, 4)], "map_id long, ix long, iy long, iz long, seq long")
    hit = spark.createDataFrame([(0, 0, 0, 3, 3)], "map_id long, ix long, iy long, iz long, first_seq long")
    votes = maps.free_votes(long, hit)
    got = maps.occupancy_state(votes, hit).first()
    assert (got.free_votes, got.state) == (3, "OCCUPIED")
    with pytest.raises(ValueError):
        maps.occupancy_state(votes, hit, 1)


def test_crossed_voxels_equal_sampled_rays():
    rng = np.random.default_rng(3)
    start, end = rng.uniform(-3, 3, (200, 3)), rng.uniform(-3, 3, (200, 3))
    ray, voxel = geometry.crossed_voxels(start, end, 0.5)
    got = {}
    for r, v in zip(ray.tolist(), map(tuple, voxel.tolist())):
        got.setdefault(r, []).append(v)
    for i in range(200):
        t = np.linspace(0, 1, 20_001)[:, None]
        sampled = set(map(tuple, np.floor((start[i] + t * (end[i] - start[i])) / 0.5).astype(int).tolist())) - {tuple(np.floor(end[i] / 0.5).astype(int).tolist())}
        assert len(got.get(i, [])) == len(set(got.get(i, []))) and sampled <= set(got.get(i, []))
    edge_ray, edge = geometry.crossed_voxels(np.array([[0.25, 0.25, 0.25]]), np.array([[1.75, 1.75, 1.75]]), 0.5)
    assert edge.tolist() == [[0, 0, 0], [1, 1, 1], [2, 2, 2]] and len(edge_ray) == 3


def test_radius_join_nearest_and_knn_equal_brute_force(spark):
    rnd = random.Random(1)
    pts = [(i, *(rnd.uniform(-1, 1) for _ in range(3))) for i in range(120)]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a[1:], b[1:]))
    df = spark.createDataFrame(pts, "point_id long, x double, y double, z double")
    got = {(r.point_id_a, r.point_id_b) for r in joins.radius_join(df, df, 0.3, "point_id", "point_id").collect()}
    assert got == {(a[0], b[0]) for a in pts for b in pts if d2(a, b) <= 0.09}
    near = {}
    for r in joins.knn(df, 3, 0.1, "point_id").collect():
        near.setdefault(r.point_id, []).append((r.rank, r.neighbor_id))
    for a in pts:
        assert [n for _, n in sorted(near[a[0]])] == [b[0] for b in sorted((b for b in pts if b[0] != a[0]), key=lambda b: (d2(a, b), b[0]))[:3]]


def test_bracket_join(spark):
    states = spark.createDataFrame([("t", i, us) for i, us in enumerate([0, 10, 20])], "trace_id string, id long, us long")
    frames = spark.createDataFrame([("t", 1, 4), ("t", 2, 5), ("t", 3, 16), ("t", 4, 20), ("t", 5, 21), ("u", 6, 5)], "trace_id string, frame_id long, us long")
    got = {r.frame_id: (r.before_id, r.after_id, r.selected_id, r.bracket) for r in joins.bracket_join(frames, states, "trace_id", "us", "id").collect()}
    assert got == {1: (0, 1, 0, 10), 2: (0, 1, 0, 10), 3: (1, 2, 2, 10), 4: (2, 2, 2, 0), 5: (None,) * 4, 6: (None,) * 4}


def test_depth_strata(spark):
    rows = [("a", "front", 5.0, 0.0), ("a", "front", 5.0, 0.01), ("b", "back", 25.0, 0.02)]
    got = {r.stratum: (r.views, r.pixels, round(r.mae, 9)) for r in metrics.depth_strata(spark.createDataFrame(rows, "view_id string, side string, incidence_deg double, err double"), (0, 15, 30, 90)).collect()}
    assert got["all"] == (2, 3, 0.01) and set(got) == {"all", "side:front", "side:back", "incidence:[0,15]deg", "incidence:[15,30]deg"}
    assert all(got[k][0] == 1 for k in got if k != "all")


def test_trial_summary_and_hotspots(spark):
    rows = [("slow", 10 * i, 10 * i - 3) for i in range(1, 6)] + [("fast", i, i) for i in range(1, 6)]
    s = metrics.trial_summary(spark.createDataFrame(rows, "name string, wall long, cpu long"), ["name"], ["wall", "cpu"])
    got = {(r.name, r.series): (r.p50, r.p95) for r in s.collect()}
    assert got["slow", "wall"] == (30, 50) and got["slow", "cpu"][0] == 27
    assert [r.name for r in metrics.hotspot_rank(s, "name").filter("series = 'wall'").orderBy("rank").collect()] == ["slow", "fast"]


def test_fine_gain(spark):
    def gain(coverage, rmse, consistency, quality=1.0, bonus=0.0):
        c = [F.lit(v) for v in (1.0, coverage)] + [F.lit(rmse).cast("double"), 0.003] + [F.lit(v) for v in (consistency, quality, quality, quality, bonus)]
        return spark.range(1).select(planning.fine_gain(*c).alias("g")).first().g

    assert gain(0.5, 0.004, 0.4) == pytest.approx(0.5)  # 0.7 * 0.5 + 0.3 * 0.5 * 1: the error is over its limit
    assert gain(0.5, 0.0015, 0.4) == pytest.approx(0.7 * 0.5 + 0.3 * 0.5 * 0.6)
    assert gain(0.5, None, 1.0) == pytest.approx(0.5) and gain(1.0, 0.0, 1.0) == 0.0
    assert gain(0.0, None, 0.0, 0.5, 0.2) == pytest.approx((0.7 + 0.2) * 0.5) and gain(2.0, 0.004, 0.4, 3.0) == pytest.approx(0.3)


def test_neighbours_far_away_are_found(spark):
    points = spark.createDataFrame([(i, g, 1000.0 * i, 0.0, 0.0) for g in (0, 1) for i in range(4 if g else 2)], "point_id long, g int, x double, y double, z double")
    got = sorted(map(tuple, joins.knn(points, 2, 0.01, "point_id", ["g"]).select("g", "point_id", "neighbor_id").collect()))
    assert got == [(0, 0, 1), (0, 1, 0), (1, 0, 1), (1, 0, 2), (1, 1, 0), (1, 1, 2), (1, 2, 1), (1, 2, 3), (1, 3, 1), (1, 3, 2)]
    assert joins.knn(points.limit(0), 2, 0.01, "point_id").count() == 0


def test_appending_refuses_what_is_there_and_repeated_keys(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 1, "b"), (1, 2, "c")], "session_id long, seq long, v string")
    assert sessions.append_new(rows, str(tmp_path / "w"), ["session_id", "seq"]).count() == 1
    assert sorted(r.v for r in sessions.append_new(rows, str(tmp_path / "w"), ["session_id", "seq"]).collect()) == ["a", "b", "c"]
    assert spark.read.parquet(str(tmp_path / "w")).count() == 2


def test_coverage_is_additive_and_counts_an_observation_once(spark):
    pts = [(o, 1, 0.05 * i, 0.05 * j, 0.01) for o in (1, 2) for i in range(4) for j in range(4)]
    p = spark.createDataFrame(pts, "observation_id long, side int, x double, y double, z double")
    bins = maps.coverage_bins(p, (0, 0, 0), (0.2, 0.2, 0.01), 1, 1, 4, 0.001)
    empty = bins.limit(0)
    once = maps.coverage_update(empty, bins, empty)
    twice = maps.coverage_update(once, bins, bins)
    assert {r.n for r in once.collect()} == {2} and once.count() == 16
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))
    done = {r.side: r.completion for r in maps.patch_completion(once, 1, 1, 4, 2, 1.0).collect()}
    assert done == {1: 1.0, -1: 0.0}


def test_hash_chain_and_table_hash(spark):
    rows = metrics.chain_hashes(spark.createDataFrame([(1, i, f"p{i}") for i in range(4)], "run_id long, seq long, payload string"))
    linked = rows.withColumn("prev_sha", F.expr("lag(sha) OVER (PARTITION BY run_id ORDER BY seq)"))
    assert metrics.hash_chain_check(linked).filter("NOT intact").count() == 0
    broken = linked.withColumn("payload", F.when(F.col("seq") == 2, "other").otherwise(F.col("payload")))
    assert [r.seq for r in metrics.hash_chain_check(broken).filter("NOT intact").collect()] == [2]
    assert metrics.table_hash(rows).first().sha256 == metrics.table_hash(rows.orderBy(F.desc("seq")).repartition(3)).first().sha256


def test_rodrigues_and_pose_algebra(spark):
    v = [F.lit(0.0), F.lit(0.0), F.lit(math.pi / 2)]
    r = C.axis_angle_rotation(v)
    pose = (r, [F.lit(1.0), F.lit(2.0), F.lit(3.0)])
    back = C.compose(pose, C.invert(pose))
    got = spark.range(1).select(*C.flat(back)).first()
    assert list(got) == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1, 0, 0, 0], abs=1e-12)
    assert spark.range(1).select(C.rotation_angle_deg(r).alias("a")).first().a == pytest.approx(90)


def test_principal_axes_and_normals_of_a_plane(spark):
    pts = [(i, 0.1 * (i % 10), 0.07 * (i // 10), 0.0) for i in range(100)]
    p = spark.createDataFrame(pts, "point_id long, x double, y double, z double").withColumn("k", F.lit(1))
    f = geometry.pca_frame(p, "k").first()
    assert abs(f.a0x) == pytest.approx(1, abs=1e-6) and f.e2 == pytest.approx(0, abs=1e-12)
    n = geometry.estimate_normals(p, 6, 0.2, (0, 0, -1)).collect()
    assert len(n) == 100 and all(r.nz == pytest.approx(-1) for r in n)


def test_sessions_arrays_and_snapshots(spark, tmp_path):
    good = {"schema_version": 1, "session_id": "s", "views": [{"seq": i, "view_id": f"v{i}", "files": [{"path": f"v{i}/d.npy", "sha256": "x"}]} for i in range(2)]}
    bad = {"schema_version": 2, "session_id": "t", "views": [{"seq": 0, "view_id": "a", "files": [{"path": "../x", "sha256": ""}]}, {"seq": 0, "view_id": "b", "files": [{"path": "/x", "sha256": ""}]}]}
    (tmp_path / "m").mkdir()
    for name, m in (("a", good), ("b", bad)):
        (tmp_path / "m" / f"{name}.json").write_text(json.dumps(m))
    got = {r.view_id: r.reasons for r in sessions.read_session(spark, str(tmp_path / "m")).collect()}
    assert got == {"v0": [], "v1": [], "a": ["schema", "sequence", "path"], "b": ["schema", "sequence", "path"]}
    (tmp_path / "f").mkdir()
    image = np.arange(6, dtype=np.uint16).reshape(2, 3)
    np.save(tmp_path / "f" / "d.npy", image)
    px = sessions.explode_frames(spark, str(tmp_path / "f"))
    assert sorted((r.v, r.u, r.value) for r in px.collect()) == [(v, u, float(image[v, u])) for v in range(2) for u in range(3)]
    rows = spark.createDataFrame([(1, 2), (3, 4)], "ix int, votes int")
    digest = sessions.write_snapshot(rows, str(tmp_path / "maps"), 1, 1)
    assert sessions.write_snapshot(rows.orderBy(F.desc("ix")), str(tmp_path / "maps"), 1, 1) == digest
    with pytest.raises(ValueError):
        sessions.write_snapshot(rows.limit(1), str(tmp_path / "maps"), 1, 1)
    assert sessions.read_snapshot(spark, str(tmp_path / "maps"), 1, 1, rows.schema, digest).count() == 2


def test_append_checksums_and_labels(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1), ("s", 2)], "session_id string, seq int")
    assert sessions.append_new(rows, str(tmp_path / "v"), ["session_id", "seq"]).count() == 0
    assert sessions.append_new(rows.union(rows.withColumn("seq", F.col("seq") + 2)), str(tmp_path / "v"), ["session_id", "seq"]).count() == 2
    assert spark.read.parquet(str(tmp_path / "v")).count() == 4
    files = spark.createDataFrame([("a", bytearray(b"x")), ("b", bytearray(b"y"))], "path string, content binary")
    manifest = files.select("path", F.sha2("content", 256).alias("sha256")).union(spark.createDataFrame([("c", "z")], "path string, sha256 string"))
    assert {r.path: r.ok for r in sessions.verify_checksums(files.filter("path <> 'b'"), manifest).collect()} == {"a": True, "b": False, "c": False}
    assert sessions.tree_hash(files).first()[:2] == (2, 2)
    (tmp_path / "l.json").write_text('{"view_id": "v", "side": "front", "incidence_deg": 5}\n')
    assert sessions.read_label_manifest(spark, str(tmp_path / "l.json")).first().incidence_deg == 5
    (tmp_path / "l2.json").write_text('{"view_id": "v", "other": 1}\n')
    with pytest.raises(ValueError):
        sessions.read_label_manifest(spark, str(tmp_path / "l2.json"))


def stream(query_of, source, out, checkpoint, **options):
    q = query_of(source).writeStream.format("memory").queryName(out).option("checkpointLocation", str(checkpoint)).outputMode(options.get("mode", "append")).start()
    q.processAllAvailable()
    q.stop()


def test_streams_equal_batches(spark, tmp_path):
    path = str(tmp_path / "in")
    rows = spark.createDataFrame([(t, i, 1000 * i, 1000 * i, float(i)) for t in range(3) for i in range(50)], "trace_id long, id long, us long, ctrl_us long, value double")
    rows.coalesce(1).write.parquet(path)
    source = spark.readStream.schema(rows.schema).parquet(path)
    stream(lambda s: telemetry.rate_limited_stream(s, 7000), source, "limited", tmp_path / "c1")
    batch = {(r.trace_id, r.id) for r in telemetry.rate_limited_trace(rows, 7000).collect()}
    assert {(r.trace_id, r.id) for r in spark.table("limited").collect()} == {x for x in batch if x[1] != 49} | {(t, 49) for t in range(3)}
    timed = lambda s: telemetry.windowed_ticks(s.select(F.timestamp_micros(F.col("us") * 1000).alias("ts"), F.lit("k").alias("kind"), "value"), "10 seconds", late="1 second")
    stream(timed, source, "ticks", tmp_path / "c2", mode="complete")
    assert sorted(map(tuple, spark.table("ticks").collect())) == sorted(map(tuple, timed(rows).collect()))


def test_ledger_from_a_stream_counts_once(spark, tmp_path):
    add = stream_maps.append_bins(str(tmp_path / "bins"))
    bins = spark.createDataFrame([(1, 1, 0, 0, 0, 0, 5), (2, 1, 0, 0, 0, 0, 1)], "observation_id long, side int, row int, col int, by int, bx int, n long")
    add(bins, 0)
    add(bins, 0)
    add(bins, 1)
    assert [r.n for r in stream_maps.ledger(spark.read.parquet(str(tmp_path / "bins"))).collect()] == [6]


def test_event_logs_and_reports(spark, tmp_path):
    (tmp_path / "e.json").write_text("".join(json.dumps({"run_id": "r", "seq": i, "type": "t", "payload": "p"}) + "\n" for i in range(4)))
    assert [r.seq for r in logs.read_event_log(spark, str(tmp_path / "e.json"), 2).collect()] == [2, 3]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.json").write_text(json.dumps({"trial_id": "a", "spans": {"x": {"count": 2, "inclusive_wall_ns": 5}, "y": {"count": 1}}}))
    got = {r["name"]: r["count"] for r in logs.read_timing_reports(spark, str(tmp_path / "t")).collect()}
    assert got == {"x": 2, "y": 1}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got = registry.queries()[name](spark, DATA)
    want = con.sql(registry.oracle_sql()[name])
    names = sorted(got.columns)
    assert names == sorted(want.columns)
    at = [want.columns.index(n) for n in names]
    assert sorted(repr(tuple(r[n] for n in names)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())


def test_mesh_of_a_ball_is_closed(spark):
    from scanspark.operators import surface

    n = 8
    rows = [(1, x, y, z, math.dist((x, y, z), (4, 4, 4)) - 2.6, 5.0) for x in range(n + 1) for y in range(n + 1) for z in range(n + 1)]
    mesh = surface.extract_mesh(spark.createDataFrame(rows, "side int, ix long, iy long, iz long, d double, w double"), 0.1, 1.0)
    edges = maps.mesh_edges(mesh.withColumn("mesh_id", F.lit(1)))
    assert edges.count() > 100 and edges.filter("n <> 2").count() == 0
    t = np.array([[r[f"{p}{a}"] for p in "abc" for a in "xyz"] for r in mesh.collect()]).reshape(-1, 3, 3)
    volume = np.einsum("ni,ni->n", t[:, 0], np.cross(t[:, 1], t[:, 2])).sum() / 6
    assert volume == pytest.approx(4 / 3 * math.pi * 0.26**3, rel=0.1)


def test_height_surface_and_protrusion(spark):
    from scanspark.operators import surface

    pts = [(1, i, x := 0.1 * (i % 20), y := 0.1 * (i // 20), 0.2 * x * x - 0.1 * y + 0.05 + (0.5 if 105 <= i < 109 else 0.0)) for i in range(400)]
    p = spark.createDataFrame(pts, "k int, point_id long, x double, y double, z double")
    got = surface.segment_protrusion(p, ["k"], "point_id", 0.2, 0.15, 3).collect()
    assert sorted(r.point_id for r in got) == [105, 106, 107, 108] and all(r.passed and r.size == 4 for r in got)


def test_pose_sets(spark):
    from scanspark.operators import surface

    def turn(axis, deg):
        k, s, c = np.array(axis, float), math.sin(math.radians(deg)), math.cos(math.radians(deg))
        m = np.array([[0, -k[2], k[1]], [k[2], 0, -k[0]], [-k[1], k[0], 0]])
        return np.eye(3) + s * m + (1 - c) * m @ m

    rows = [(1, i, *turn((0, 0, 1), d).ravel().tolist(), 0.1 * i, 0.0, 0.0) for i, d in enumerate((-10, 0, 10))]
    rows += [(2, i, *r.ravel().tolist(), 0.0, 0.0, 0.0) for i, r in enumerate((np.eye(3), turn((0, 0, 1), 30), turn((1, 0, 0), 30)))]
    p = spark.createDataFrame(rows, "k int, i int, " + ", ".join(f"{c} double" for c in C.POSE))
    loop = {r.k: r for r in surface.pose_loop_metrics(p, "k").collect()}
    assert loop[1].most_deg == pytest.approx(10, abs=1e-5) and loop[1].rmse_m == pytest.approx(0.1 * math.sqrt(2 / 3))
    seen = {r.k: r for r in surface.pose_observability(p, "k", "i").collect()}
    assert seen[1].most_deg == pytest.approx(20, abs=1e-5) and seen[1].axis_diversity == pytest.approx(0, abs=1e-6) and seen[2].axis_diversity > 0.3
