"""Queries on joins, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanspark.functions import columns as C
from scanspark.operators import joins as J
from scanspark.operators import reports as R
from scanspark.operators import pixels as P
from scanspark.plans import adapters as A
from scanspark.plans.adapters import sql
from scanspark.plans.pixel_queries import CAMERA, NATIVE, native, r6, stereo, STEREO

Q: dict = {}
SQL: dict[str, str] = {}
NEAR = "near AS (SELECT a.point_id AS p, b.point_id AS q, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM points a JOIN points b ON true)"
PAIRS = """pairs AS (
  SELECT a.session_id, a.view_id AS a, b.view_id AS b, sqrt((b.tx - a.tx) * (b.tx - a.tx) + (b.ty - a.ty) * (b.ty - a.ty) + (b.tz - a.tz) * (b.tz - a.tz)) AS translation,
         degrees(acos(greatest(least((a.r00 * b.r00 + a.r01 * b.r01 + a.r10 * b.r10 + a.r11 * b.r11 + a.r22 * b.r22 - 1) / 2, 1), -1))) AS rotation_deg
  FROM views a JOIN views b ON a.session_id = b.session_id)"""


def query(name: str, *parts: str):
    def add(f):
        Q[name] = f
        if parts:
            SQL[name] = sql(*parts)
        return f

    return add


@query("paired_depth", A.PIXELS, NATIVE, STEREO, "SELECT view_id, v, u, round(CAST(n.depth_m AS DOUBLE), 6) AS native_m, round(s.depth_m, 6) AS stereo_m, round(CAST(n.depth_m AS DOUBLE) - s.depth_m, 6) AS error_m FROM native n JOIN stereo s USING (view_id, v, u) WHERE n.depth_m IS NOT NULL")
def _(spark, sf):
    n = native(spark, sf).filter("depth_m IS NOT NULL").select(*P.PIXEL, F.col("depth_m").cast("double").alias("n"))
    j = n.join(stereo(spark, sf), P.PIXEL)
    return j.select(*P.PIXEL, F.round("n", 6).alias("native_m"), F.round("depth_m", 6).alias("stereo_m"), F.round(F.col("n") - F.col("depth_m"), 6).alias("error_m"))


@query("radius_join", A.POINTS, NEAR, "SELECT p AS point_id_a, q AS point_id_b, round(d2, 9) AS d2 FROM near WHERE d2 <= 0.01")
def _(spark, sf):
    p = A.points(spark, sf)
    # As DuckDB rounds; Spark's round goes through a decimal for each row.
    return J.radius_join(p, p, 0.1, "point_id", "point_id").select("point_id_a", "point_id_b", (F.floor(F.col("d2") * 1e9 + 0.5) / 1e9).alias("d2"))


@query("nearest_neighbor", A.POINTS, NEAR, """best AS (SELECT p, min_by(q, struct_pack(d := d2, q := q)) AS nearest_id, sqrt(min(d2)) AS distance FROM near JOIN points b ON b.point_id = q WHERE d2 <= 0.01 AND b.side = 1 GROUP BY 1)""",
"SELECT point_id, nearest_id, round(distance, 6) AS distance FROM points LEFT JOIN best ON p = point_id WHERE side = 0")
def _(spark, sf):
    p = A.points(spark, sf)
    b = p.filter("side = 1").withColumnRenamed("point_id", "nearest_id")
    return J.nearest_neighbor(p.filter("side = 0"), b, 0.1, "point_id", "nearest_id").select("point_id", "nearest_id", *r6("distance"))


@query("knn", A.POINTS, NEAR, "SELECT p AS point_id, q AS neighbor_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY d2, q) AS rank FROM near WHERE p <> q) WHERE rank <= 4")
def _(spark, sf):
    return J.knn(A.points(spark, sf), 4, 0.05, "point_id").select("point_id", "neighbor_id", F.col("rank").cast("long"))


@query("overlap_residuals", A.PIXELS, NATIVE, STEREO, f"""c AS (SELECT view_id, (u - {A.CX}) * z / {A.FX} AS x, (v - {A.CY}) * z / {A.FY} AS y, z FROM (SELECT *, CAST(depth_m AS DOUBLE) AS z FROM native) WHERE z IS NOT NULL),
p AS (SELECT view_id, CAST(round_even({A.FX} * (x + 0.002) / z + {A.CX}, 0) AS BIGINT) AS u, CAST(round_even({A.FY} * y / z + {A.CY}, 0) AS BIGINT) AS v, z FROM c)""",
"SELECT view_id, v, u, round(depth_m - z, 6) + 0.0 AS residual FROM p JOIN stereo USING (view_id, v, u) WHERE abs(depth_m - z) <= 0.0505")
def _(spark, sf):
    c = P.back_project(native(spark, sf).filter("depth_m IS NOT NULL"), *CAMERA).withColumn("x", F.col("x") + 0.002)
    p = P.project_points(c, *CAMERA).select("view_id", F.rint("pu").cast("long").alias("u"), F.rint("pv").cast("long").alias("v"), "z")
    j = p.join(stereo(spark, sf), P.PIXEL)
    return j.select(*P.PIXEL, (F.round(F.col("depth_m") - F.col("z"), 6) + 0.0).alias("residual")).filter(F.abs(F.col("depth_m") - F.col("z")) <= 0.0505)


@query("visibility_join", A.PIXELS, NATIVE, STEREO, """t AS (SELECT view_id, v + 0.25::DOUBLE AS pv, u + 0.5::DOUBLE AS pu, CAST(depth_m AS DOUBLE) AS z FROM native WHERE depth_m IS NOT NULL),
j AS (SELECT t.view_id, coalesce(t.z <= s.depth_m + 0.0105, false) AS visible FROM t LEFT JOIN stereo s ON s.view_id = t.view_id AND s.v = floor(pv) AND s.u = floor(pu))""",
"SELECT view_id, count(*) AS n, count(*) FILTER (WHERE visible) AS n_visible FROM j GROUP BY 1")
def _(spark, sf):
    t = native(spark, sf).filter("depth_m IS NOT NULL").select("view_id", (F.col("v") + 0.25).alias("pv"), (F.col("u") + 0.5).alias("pu"), F.col("depth_m").cast("double").alias("z"))
    got = J.visibility_join(t, stereo(spark, sf).withColumnRenamed("depth_m", "z"), 0.0105)
    return got.groupBy("view_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("visible").cast("long")).alias("n_visible"))


FRAMES = """states AS (SELECT * FROM samples WHERE id % 3 <> 0), frames AS (SELECT * FROM samples WHERE id % 3 = 0)"""


@query("bracket_join", A.SAMPLES, FRAMES, """b AS (SELECT f.trace_id, f.id AS frame_id, f.us, s.id AS before_id, s.us AS b_us FROM frames f ASOF LEFT JOIN states s ON f.trace_id = s.trace_id AND f.us >= s.us),
a AS (SELECT b.*, s.id AS after_id, s.us AS a_us FROM b ASOF LEFT JOIN states s ON b.trace_id = s.trace_id AND b.us <= s.us)""",
"""SELECT trace_id, frame_id, CASE WHEN ok THEN before_id END AS before_id, CASE WHEN ok THEN after_id END AS after_id,
CASE WHEN ok THEN CASE WHEN us - b_us <= a_us - us THEN before_id ELSE after_id END END AS selected_id, CASE WHEN ok THEN a_us - b_us END AS bracket FROM (SELECT *, before_id IS NOT NULL AND after_id IS NOT NULL AS ok FROM a)""")
def _(spark, sf):
    s = A.samples(spark, sf)
    return J.bracket_join(s.filter("id % 3 = 0").withColumnRenamed("id", "frame_id"), s.filter("id % 3 <> 0"), "trace_id", "us", "id")


@query("pose_pairs", A.VIEWS, PAIRS, "SELECT session_id, a, b, round(translation, 6) AS translation, round(rotation_deg, 6) AS rotation_deg FROM pairs WHERE a < b")
def _(spark, sf):
    return J.pose_pairs(A.views(spark, sf), "session_id", "view_id").select("session_id", "a", "b", *r6("translation", "rotation_deg"))


@query("view_independence", A.VIEWS, PAIRS, "SELECT view_id, NOT EXISTS (SELECT 1 FROM pairs p WHERE p.a = view_id AND p.b % 2 = 0 AND translation < 0.6 AND rotation_deg < 100) AS independent FROM views WHERE view_id % 2 = 1")
def _(spark, sf):
    v = A.views(spark, sf)
    got = J.view_independence(v.filter("view_id % 2 = 1"), v.filter("view_id % 2 = 0"), "session_id", "view_id", 0.6, 100)
    return got.select("view_id", "independent")


def spheres(spark, sf):
    return A.views(spark, sf).select(F.col("view_id").alias("sphere_id"), F.col("tx").alias("x"), F.col("ty").alias("y"), F.col("tz").alias("z"), (0.1 + F.col("view_id") % 3 * 0.125).alias("r"))


SPHERES = """spheres AS (SELECT view_id AS sphere_id, tx AS x, ty AS y, tz AS z, 0.1::DOUBLE + view_id % 3 * 0.125::DOUBLE AS r FROM views),
sv AS (SELECT sphere_id, ix, iy, iz FROM spheres, (SELECT unnest(range(-16, 16)) AS ix), (SELECT unnest(range(-16, 16)) AS iy), (SELECT unnest(range(-16, 16)) AS iz)
  WHERE pow(greatest(ix * 0.125 - x, 0, x - (ix + 1) * 0.125), 2) + pow(greatest(iy * 0.125 - y, 0, y - (iy + 1) * 0.125), 2) + pow(greatest(iz * 0.125 - z, 0, z - (iz + 1) * 0.125), 2) <= r * r)"""


@query("sphere_voxels", A.VIEWS, SPHERES, "SELECT * FROM sv")
def _(spark, sf):
    return J.sphere_voxels(spheres(spark, sf), 0.125)


STATES = """states AS (SELECT view_id % 4 AS map_id, CAST(floor(x / 0.125) AS BIGINT) AS ix, CAST(floor(y / 0.125) AS BIGINT) AS iy, CAST(floor(z / 0.125) AS BIGINT) AS iz,
  CASE WHEN count(*) > 8 THEN 'OCCUPIED' WHEN count(*) > 2 THEN 'FREE' ELSE 'UNKNOWN' END AS state FROM points GROUP BY 1, 2, 3, 4)"""


def states(spark, sf):
    p = A.points(spark, sf)
    n = F.count(F.lit(1))
    return p.groupBy((F.col("view_id") % 4).alias("map_id"), *(C.voxel(F.col(a), 0.125).alias(f"i{a}") for a in "xyz")).agg(F.when(n > 8, "OCCUPIED").when(n > 2, "FREE").otherwise("UNKNOWN").alias("state"))


@query("sphere_query", A.VIEWS, A.POINTS, SPHERES, STATES, """j AS (SELECT sphere_id, coalesce(state, 'UNKNOWN') AS state FROM sv LEFT JOIN states s ON s.map_id = sphere_id % 4 AND s.ix = sv.ix AND s.iy = sv.iy AND s.iz = sv.iz)""",
"""SELECT sphere_id, count(*) AS queried, count(*) FILTER (WHERE state = 'OCCUPIED') AS occupied, count(*) FILTER (WHERE state = 'UNKNOWN') AS unknown, count(*) FILTER (WHERE state = 'FREE') AS free,
count(*) FILTER (WHERE state <> 'FREE') > 0 AS blocked FROM j GROUP BY 1""")
def _(spark, sf):
    sv = J.sphere_voxels(spheres(spark, sf), 0.125)
    sv = sv.withColumn("map_id", F.col("sphere_id") % 4)  # each sphere asks one of the four maps
    j = sv.join(states(spark, sf), ["map_id", "ix", "iy", "iz"], "left").withColumn("state", F.coalesce("state", F.lit("UNKNOWN")))
    n = lambda s: F.sum((F.col("state") == s).cast("long"))
    return j.groupBy("sphere_id").agg(F.count(F.lit(1)).alias("queried"), n("OCCUPIED").alias("occupied"), n("UNKNOWN").alias("unknown"), n("FREE").alias("free"), (n("FREE") < F.count(F.lit(1))).alias("blocked"))


BOXES = "boxes AS (SELECT s_suppkey AS box_id, (s_suppkey % 4 - 2) * 0.125::DOUBLE AS x0, (s_suppkey % 4) * 0.125::DOUBLE AS x1, -0.25::DOUBLE AS y0, (s_suppkey % 3) * 0.125::DOUBLE AS y1, -0.125::DOUBLE AS z0, 0.25::DOUBLE AS z1 FROM supplier)"


def boxes(spark, sf):
    k = F.col("s_suppkey")
    return A.table(spark, sf, "supplier").select(
        k.alias("box_id"), ((k % 4 - 2) * 0.125).alias("x0"), (k % 4 * 0.125).alias("x1"), F.lit(-0.25).alias("y0"), (k % 3 * 0.125).alias("y1"), F.lit(-0.125).alias("z0"), F.lit(0.25).alias("z1")
    )


@query("voxel_in_boxes", A.POINTS, STATES, BOXES, """SELECT map_id, ix, iy, iz, CASE WHEN state = 'UNKNOWN' AND EXISTS (SELECT 1 FROM boxes WHERE ix * 0.125 >= x0 AND (ix + 1) * 0.125 <= x1 AND iy * 0.125 >= y0 AND (iy + 1) * 0.125 <= y1 AND iz * 0.125 >= z0 AND (iz + 1) * 0.125 <= z1)
THEN 'ACCEPTED_FREE' ELSE state END AS state FROM states""")
def _(spark, sf):
    return J.voxel_in_boxes(states(spark, sf), boxes(spark, sf), 0.125).select("map_id", "ix", "iy", "iz", "state")


@query("box_voxel_counts", A.POINTS, STATES, BOXES, """SELECT map_id, box_id, count(*) AS known, count(*) FILTER (WHERE state = 'OCCUPIED') AS occupied, count(*) FILTER (WHERE state = 'FREE') AS free FROM boxes JOIN states
ON (ix + 0.5) * 0.125 BETWEEN x0 AND x1 AND (iy + 0.5) * 0.125 BETWEEN y0 AND y1 AND (iz + 0.5) * 0.125 BETWEEN z0 AND z1 GROUP BY 1, 2""")
def _(spark, sf):
    j = J.box_cells(boxes(spark, sf), 0.125).join(states(spark, sf), ["ix", "iy", "iz"])
    n = lambda s: F.sum((F.col("state") == s).cast("long"))
    return j.groupBy("map_id", "box_id").agg(F.count(F.lit(1)).alias("known"), n("OCCUPIED").alias("occupied"), n("FREE").alias("free"))


@query("capsule_findings", A.POINTS, """c AS (SELECT point_id // 8 AS sample_id, point_id % 8 AS n, 0.02 AS r, x AS x0, y AS y0, z AS z0, x + 0.1 AS x1, y AS y1, z AS z1 FROM points)""",
"""SELECT sample_id, i, j FROM (SELECT a.sample_id, a.n AS i, b.n AS j,
  least(greatest(0, abs(b.x0 - a.x0) - 0.1) , 1e9) AS gx, (b.y0 - a.y0) AS gy, (b.z0 - a.z0) AS gz FROM c a JOIN c b USING (sample_id) WHERE b.n >= a.n + 2) WHERE sqrt(gx * gx + gy * gy + gz * gz) <= 0.06""")
def _(spark, sf):
    p = A.points(spark, sf)
    c = p.select(F.floor(F.col("point_id") / 8).alias("sample_id"), (F.col("point_id") % 8).alias("n"), F.lit(0.02).alias("r"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"), (F.col("x") + 0.1).alias("x1"), F.col("y").alias("y1"), F.col("z").alias("z1"))
    return J.capsule_findings(c, 0.02).select("sample_id", "i", "j")


def slab(a: str) -> tuple[str, str]:
    still, low, high = f"abs({a}e - {a}s) < 1e-12", f"({a}0 - 0.04 - {a}s)", f"({a}1 + 0.04 - {a}s)"
    way = f"CASE WHEN {still} THEN NULL ELSE {a}e - {a}s END"
    return f"CASE WHEN {still} THEN CASE WHEN {low} <= 0 AND {high} >= 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END ELSE least({low} / ({way}), {high} / ({way})) END", f"CASE WHEN {still} THEN 1.0::DOUBLE ELSE greatest({low} / ({way}), {high} / ({way})) END"


@query("capsule_box_findings", A.POINTS, BOXES, """c AS (SELECT point_id AS sample_id, x AS xs, y AS ys, z AS zs, x + 0.1::DOUBLE * (point_id % 3 - 1) AS xe, y + 0.1::DOUBLE * (point_id % 2) AS ye, z AS ze FROM points)""",
f"SELECT sample_id, box_id FROM c JOIN boxes ON greatest(0, {slab('x')[0]}, {slab('y')[0]}, {slab('z')[0]}) <= least(1, {slab('x')[1]}, {slab('y')[1]}, {slab('z')[1]})")
def _(spark, sf):
    k = F.col("point_id")
    c = A.points(spark, sf).select(k.alias("sample_id"), F.lit(0).alias("n"), F.lit(0.02).alias("r"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"), (F.col("x") + 0.1 * (k % 3 - 1)).alias("x1"), (F.col("y") + 0.1 * (k % 2)).alias("y1"), F.col("z").alias("z1"))
    return J.capsule_box_findings(c, boxes(spark, sf), 0.02, 0.5).select("sample_id", "box_id")


CORNERS = "l AS (SELECT l_orderkey % 500 AS pair_id, l_partkey % 40 AS corner_id, min(l_quantity) AS u, min(l_tax) AS v FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1, 2), r AS (SELECT l_orderkey % 500 AS pair_id, l_partkey % 40 AS corner_id, min(l_quantity) AS u, min(l_tax) AS v FROM lineitem WHERE l_linenumber = 3 GROUP BY 1, 2)"


def corners(spark, sf, where):
    t = A.table(spark, sf, "lineitem").filter(where)
    return t.groupBy((F.col("l_orderkey") % 500).alias("pair_id"), (F.col("l_partkey") % 40).alias("corner_id")).agg(F.min("l_quantity").alias("u"), F.min("l_tax").alias("v"))


@query("stereo_match", CORNERS, "SELECT pair_id, corner_id, u, v, u_right, v_right FROM (SELECT l.*, r.u AS u_right, r.v AS v_right, count(*) OVER (PARTITION BY pair_id) AS n FROM l JOIN r USING (pair_id, corner_id)) WHERE n >= 6")
def _(spark, sf):
    return J.stereo_match(corners(spark, sf, "l_linenumber <= 2"), corners(spark, sf, "l_linenumber = 3"))


@query("uncovered_candidates", A.CANDIDATES, """c AS (SELECT *, CASE candidate_id % 4 WHEN 0 THEN 'rejected' WHEN 1 THEN 'geometry_only' ELSE 'endpoint_feasible' END AS status FROM candidates),
done AS (SELECT DISTINCT plan_id, side, row, col FROM candidates WHERE (row + col) % 2 = 0)""",
"SELECT candidate_id, CASE status WHEN 'rejected' THEN 'blocked' WHEN 'endpoint_feasible' THEN 'ordered' ELSE 'deferred' END AS outcome FROM c ANTI JOIN done USING (plan_id, side, row, col)")
def _(spark, sf):
    c = A.candidates(spark, sf)
    s = F.col("candidate_id") % 4
    c = c.withColumn("status", F.when(s == 0, "rejected").when(s == 1, "geometry_only").otherwise("endpoint_feasible"))
    done = c.filter("(row + col) % 2 = 0").select("plan_id", "side", "row", "col").distinct()
    left = c.join(done, ["plan_id", "side", "row", "col"], "left_anti")
    return left.select("candidate_id", F.when(F.col("status") == "rejected", "blocked").when(F.col("status") == "endpoint_feasible", "ordered").otherwise("deferred").alias("outcome"))


@query("exclude_captured", A.CANDIDATES, """captured AS (SELECT l_partkey AS candidate_id, count(*) AS attempts, max(l_tax) > 0.07 AS done FROM lineitem WHERE l_linenumber = 1 AND l_quantity > 40 GROUP BY 1)""",
"SELECT candidate_id, coalesce(attempts, 0) AS attempts FROM candidates LEFT JOIN captured USING (candidate_id) WHERE NOT coalesce(done, false) AND coalesce(attempts, 0) < 3")
def _(spark, sf):
    t = A.table(spark, sf, "lineitem").filter("l_linenumber = 1 AND l_quantity > 40").groupBy(F.col("l_partkey").alias("candidate_id"))
    t = t.agg(F.count(F.lit(1)).alias("attempts"), (F.max("l_tax") > 0.07).alias("done"))
    c = A.candidates(spark, sf).select("candidate_id")
    left = c.join(t.filter("done").select("candidate_id"), "candidate_id", "left_anti").join(t.select("candidate_id", "attempts"), "candidate_id", "left")
    return left.select("candidate_id", F.coalesce("attempts", F.lit(0)).alias("attempts")).filter("attempts < 3")


@query("duplicate_source_reject", "p AS (SELECT l_suppkey, l_linenumber, l_partkey, count(*) AS n FROM lineitem GROUP BY 1, 2, 3)", "SELECT l_suppkey AS view_id, l_linenumber AS v, l_partkey AS u, n FROM p WHERE n > 1")
def _(spark, sf):
    t = A.table(spark, sf, "lineitem")
    return t.groupBy(F.col("l_suppkey").alias("view_id"), F.col("l_linenumber").alias("v"), F.col("l_partkey").alias("u")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("required_regions_missing", A.CANDIDATES, "need AS (SELECT * FROM (SELECT DISTINCT plan_id FROM candidates), (VALUES ('front'), ('back')) s(side), (SELECT unnest(range(0, 8))::INTEGER AS row))", "SELECT plan_id, side, row FROM need ANTI JOIN (SELECT * FROM candidates WHERE score > 0.49) c USING (plan_id, side, row)")
def _(spark, sf):
    c = A.candidates(spark, sf)
    need = c.select("plan_id").distinct().withColumn("side", F.explode(F.array(F.lit("front"), F.lit("back")))).withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return need.join(c.filter("score > 0.49").select("plan_id", "side", "row"), ["plan_id", "side", "row"], "left_anti")


CALIBRATED = """k AS (SELECT session_id, view_id, seq, 0.05::DOUBLE + CASE WHEN view_id % 7 = 0 THEN 0.000001::DOUBLE ELSE 0 END AS kx FROM views)"""


@query("calibration_consistency", A.VIEWS, CALIBRATED, "SELECT session_id, view_id, round(abs(kx - first_value(kx) OVER w), 9) AS off, abs(kx - first_value(kx) OVER w) <= 1e-9 AS consistent FROM k WINDOW w AS (PARTITION BY session_id ORDER BY seq)")
def _(spark, sf):
    """The rectified camera stands 5 cm beside the raw one, in every seventh view a micrometre further."""
    v = A.views(spark, sf)
    r, t = C.pose()
    off = F.lit(0.05) + F.when(F.col("view_id") % 7 == 0, 0.000001).otherwise(0.0)
    beside = C.flat((r, [x + row[0] * off for x, row in zip(t, r, strict=True)]), "p_")
    got = R.calibration_consistency(v.select("*", *beside), ["session_id"])
    return got.select("session_id", "view_id", F.round("off", 9).alias("off"), "consistent")


@query("target_pose_match", A.VIEWS, "SELECT view_id, round(sqrt(pow((view_id % 4) * 0.01, 2) + pow((view_id % 3) * 0.008, 2)), 6) AS translation, sqrt(pow((view_id % 4) * 0.01, 2) + pow((view_id % 3) * 0.008, 2)) <= 0.0205 AS matched FROM views")
def _(spark, sf):
    v = A.views(spark, sf)
    planned = v.select("view_id", *(F.col(t).alias("p" + t) for t in C.TRANSLATION))
    k = F.col("view_id")
    got = v.withColumns({"tx": F.col("tx") + k % 4 * 0.01, "ty": F.col("ty") + k % 3 * 0.008}).join(planned, "view_id")
    gap = C.norm([F.col(t) - F.col("p" + t) for t in C.TRANSLATION])
    return got.select("view_id", F.round(gap, 6).alias("translation"), (gap <= 0.0205).alias("matched"))


@query("opposing_pairs", A.CANDIDATES, "c AS (SELECT *, candidate_id // 10 % 5 - 2 AS off FROM candidates)", "SELECT a.plan_id, a.side, a.row, a.candidate_id AS negative_id, b.candidate_id AS positive_id FROM c a JOIN c b ON a.plan_id = b.plan_id AND a.side = b.side AND a.row = b.row AND a.off < 0 AND b.off > 0")
def _(spark, sf):
    c = A.candidates(spark, sf).withColumn("off", F.floor(F.col("candidate_id") / 10) % 5 - 2)
    return J.opposing_pairs(c, ["plan_id", "side", "row"], "off", "candidate_id")


@query("pose_novelty", A.VIEWS, PAIRS, "SELECT view_id, NOT EXISTS (SELECT 1 FROM pairs p WHERE p.a = view_id AND p.b % 2 = 0 AND translation < 0.6 AND rotation_deg < 100) AS novel FROM views WHERE view_id % 2 = 1")
def _(spark, sf):
    v = A.views(spark, sf)
    return J.nearest_accepted(v.filter("view_id % 2 = 1"), v.filter("view_id % 2 = 0"), "session_id", "view_id", 0.6, 100).select("view_id", "novel")


@query("duplicate_pose_mark", A.VIEWS, PAIRS, "SELECT view_id, EXISTS (SELECT 1 FROM pairs p WHERE p.a = view_id AND p.b <> view_id AND translation <= 0.3 AND rotation_deg <= 100) AS duplicate FROM views")
def _(spark, sf):
    v = A.views(spark, sf)
    near = J.pose_pairs(v, "session_id", "view_id").filter("translation <= 0.3 AND rotation_deg <= 100")
    ids = near.select(F.explode(F.array("a", "b")).alias("view_id")).distinct().withColumn("duplicate", F.lit(True))
    return v.select("view_id").join(ids, "view_id", "left").select("view_id", F.coalesce("duplicate", F.lit(False)).alias("duplicate"))
