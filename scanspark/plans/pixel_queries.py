"""Queries on pixels and poses, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanspark.functions import columns as C
from scanspark.operators import pixels as P
from scanspark.plans import adapters as A
from scanspark.plans.adapters import sql

Q: dict = {}
SQL: dict[str, str] = {}
CAMERA = (A.FX, A.FY, A.CX, A.CY)
NATIVE = """native AS (SELECT *, CASE WHEN raw_depth > 0 THEN CAST(raw_depth AS FLOAT) * CAST(0.001 AS FLOAT) END AS depth_m FROM pixels)"""
CLOUD = f"""cloud AS (SELECT *, (u - {A.CX}) * z / {A.FX} AS x, (v - {A.CY}) * z / {A.FY} AS y FROM (SELECT *, CAST(depth_m AS DOUBLE) AS z FROM native))"""
DISPARITY = "disp AS (SELECT view_id, v, u, valid, raw_depth / 100.0::DOUBLE AS disparity FROM pixels)"
PROJECTED = f"""projected AS (
  SELECT *, CASE WHEN z > 0 THEN {A.FX} * x / z + {A.CX} END AS pu, CASE WHEN z > 0 THEN {A.FY} * y / z + {A.CY} END AS pv FROM cloud)"""


def r6(*names: str):
    return [F.round(n, 6).alias(n) for n in names]


def native(spark, sf):
    return P.depth_to_meters(A.pixels(spark, sf), 0.001)


def cloud(spark, sf):
    return P.back_project(native(spark, sf), *CAMERA)


def disp(spark, sf):
    return A.pixels(spark, sf).select("view_id", "v", "u", "valid", (F.col("raw_depth") / 100.0).alias("disparity"))


def query(name: str, *parts: str):
    def add(f):
        Q[name] = f
        if parts:
            SQL[name] = sql(*parts)
        return f

    return add


@query("depth_to_meters", A.PIXELS, NATIVE, "SELECT view_id, v, u, round(CAST(depth_m AS DOUBLE), 6) AS depth_m FROM native")
def _(spark, sf):
    return native(spark, sf).select(*P.PIXEL, F.round(F.col("depth_m").cast("double"), 6).alias("depth_m"))


@query("disparity_to_depth", A.PIXELS, DISPARITY, "SELECT view_id, v, u, round(CASE WHEN disparity > 0 AND valid THEN 500.0 * 0.05 / disparity END, 6) AS depth_m FROM disp")
def _(spark, sf):
    return P.disparity_to_depth(disp(spark, sf), F.lit(A.FX), F.lit(0.05)).select(*P.PIXEL, *r6("depth_m"))


@query("rectified_region_filter", A.PIXELS, DISPARITY, "SELECT view_id, v, u FROM disp WHERE u >= 50 AND u < 1500 AND v >= 2 AND v < 7 AND u - disparity >= 40 AND u - disparity < 1400 AND v >= 1 AND v < 6")
def _(spark, sf):
    return P.rectified_region_filter(disp(spark, sf), (50, 2, 1500, 7), (40, 1, 1400, 6)).select(*P.PIXEL)


@query("lr_consistency", A.PIXELS, DISPARITY, """r AS (SELECT view_id, v, u AS x, disparity + u % 3 - 1 AS rd FROM disp WHERE disparity + u % 3 - 1 > 0),
j AS (SELECT d.*, abs(disparity - rd) AS e FROM disp d LEFT JOIN r ON r.view_id = d.view_id AND r.v = d.v AND r.x = CAST(round_even(d.u - disparity, 0) AS BIGINT))""",
"SELECT view_id, v, u, round(e, 6) AS lr_error, coalesce(e <= 1.5 AND u - disparity >= 0, false) AS consistent, round(CASE WHEN e IS NULL THEN 0 ELSE exp(-e / 1.5) END, 6) AS lr_confidence FROM j")
def _(spark, sf):
    left = disp(spark, sf)
    right = left.withColumn("disparity", F.col("disparity") + F.col("u") % 3 - 1)
    return P.lr_consistency(left, right, 1.5).select(*P.PIXEL, *r6("lr_error"), "consistent", *r6("lr_confidence"))


@query("confidence_filter", A.PIXELS, """SELECT view_id, round(avg(CAST(valid AS DOUBLE)), 6) AS valid_fraction, round(avg(CASE WHEN valid AND confidence >= 0.75 THEN 1.0::DOUBLE ELSE 0 END), 6) AS accepted_fraction,
round(avg(CASE WHEN valid AND confidence >= 0.75 THEN confidence END), 6) AS mean_confidence FROM pixels GROUP BY 1""")
def _(spark, sf):
    return P.confidence_report(A.pixels(spark, sf), 0.75).select("view_id", *r6("valid_fraction", "accepted_fraction", "mean_confidence"))


@query("depth_range_sample", A.PIXELS, NATIVE, "SELECT view_id, v, u, count(*) OVER (PARTITION BY view_id) >= 60 AS passed FROM native WHERE depth_m BETWEEN 1.2 AND 1.8 AND v % 2 = 0 AND u % 2 = 0")
def _(spark, sf):
    return P.depth_range_sample(native(spark, sf), 1.2, 1.8, 2, 60).select(*P.PIXEL, "passed")


@query("back_project", A.PIXELS, NATIVE, CLOUD, "SELECT view_id, v, u, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM cloud WHERE z IS NOT NULL")
def _(spark, sf):
    return cloud(spark, sf).filter("z IS NOT NULL").select(*P.PIXEL, *r6("x", "y", "z"))


@query("project_points", A.POINTS, f"SELECT point_id, round(CASE WHEN z > 0 THEN {A.FX} * x / z + {A.CX} END, 4) AS pu, round(CASE WHEN z > 0 THEN {A.FY} * y / z + {A.CY} END, 4) AS pv FROM points")
def _(spark, sf):
    return P.project_points(A.points(spark, sf), *CAMERA).select("point_id", F.round("pu", 4).alias("pu"), F.round("pv", 4).alias("pv"))


@query("project_distorted", A.POINTS, f"""n AS (SELECT point_id, x / z AS a, y / z AS b, (x / z) * (x / z) + (y / z) * (y / z) AS r2 FROM points WHERE z > 0.05),
d AS (SELECT *, (1 + r2 * (0.1 + r2 * (-0.02 + r2 * 0.001))) / greatest(1 + r2 * (0.05 + r2 * (0.01 + r2 * 0.002)), 1e-12) AS k FROM n)""",
f"""SELECT point_id, round({A.FX} * (a * k + 2 * 0.001 * a * b + 0.0005 * (r2 + 2 * a * a)) + {A.CX}, 4) AS pu, round({A.FY} * (b * k + 0.001 * (r2 + 2 * b * b) + 2 * 0.0005 * a * b) + {A.CY}, 4) AS pv FROM d""")
def _(spark, sf):
    got = P.project_distorted(A.points(spark, sf).filter("z > 0.05"), *CAMERA, (0.1, -0.02, 0.001, 0.05, 0.01, 0.002), (0.001, 0.0005))
    return got.select("point_id", F.round("pu", 4).alias("pu"), F.round("pv", 4).alias("pv"))


@query("transform_points", A.PIXELS, A.VIEWS, NATIVE, CLOUD, """SELECT c.view_id, v, u, round(r00 * x + r01 * y + r02 * z + tx, 6) AS x, round(r10 * x + r11 * y + r12 * z + ty, 6) AS y, round(r20 * x + r21 * y + r22 * z + tz, 6) AS z
FROM cloud c JOIN views USING (view_id) WHERE c.z IS NOT NULL""")
def _(spark, sf):
    return P.transform_points(cloud(spark, sf).filter("z IS NOT NULL"), A.views(spark, sf)).select(*P.PIXEL, *r6("x", "y", "z"))


@query("compose_pose", A.VIEWS, """SELECT view_id, a.r00 * b.r00 + a.r01 * b.r10 + 0.0 AS r00, a.r10 * b.r01 + a.r11 * b.r11 + 0.0 AS r11, a.r00 * b.tx + a.r01 * b.ty + a.r02 * b.tz + a.tx + 0.0 AS tx,
a.r10 * b.tx + a.r11 * b.ty + a.r12 * b.tz + a.ty + 0.0 AS ty, a.r20 * b.tx + a.r21 * b.ty + a.r22 * b.tz + a.tz + 0.0 AS tz
FROM views a JOIN (SELECT view_id - 1 AS view_id, * EXCLUDE (view_id) FROM views) b USING (view_id)""")
def _(spark, sf):
    v = A.views(spark, sf)
    b = v.select((F.col("view_id") - 1).alias("view_id"), *(F.col(c).alias("b_" + c) for c in C.POSE))
    made = C.flat(C.compose(C.pose(), C.pose("b_")))
    return v.join(b, "view_id").select("view_id", *made).select("view_id", *((F.col(c) + 0.0).alias(c) for c in ("r00", "r11", "tx", "ty", "tz")))


@query("invert_pose", A.VIEWS, """SELECT view_id, r00 + 0.0 AS r00, r10 + 0.0 AS r01, r01 + 0.0 AS r10, -(r00 * tx + r10 * ty + r20 * tz) + 0.0 AS tx, -(r01 * tx + r11 * ty + r21 * tz) + 0.0 AS ty, -(r02 * tx + r12 * ty + r22 * tz) + 0.0 AS tz FROM views""")
def _(spark, sf):
    back = A.views(spark, sf).select("view_id", *C.flat(C.invert(C.pose())))
    return back.select("view_id", *((F.col(c) + 0.0).alias(c) for c in ("r00", "r01", "r10", "tx", "ty", "tz")))


@query("rotation_angle", A.VIEWS, "SELECT view_id, round(degrees(acos(greatest(least((r00 + r11 + r22 - 1) / 2, 1), -1))), 6) AS angle_deg FROM views")
def _(spark, sf):
    return A.views(spark, sf).select("view_id", F.round(C.rotation_angle_deg(C.pose()[0]), 6).alias("angle_deg"))


def pose_checks(tolerance: float = 1e-7):
    r, _ = C.pose()
    rows = [F.abs(C.dot(r[i], r[j]) - (1.0 if i == j else 0.0)) for i in range(3) for j in range(i, 3)]
    return C.reasons(("orthonormal", F.greatest(*rows) <= tolerance), ("determinant", F.abs(C.dot(r[0], C.cross(r[1], r[2])) - 1) <= tolerance))


@query("validate_pose", A.VIEWS, """SELECT view_id, abs(f * f * (r00 * r00 + r01 * r01) - 1) <= 1e-7 AS passed, CASE WHEN f = 1 THEN '' ELSE 'orthonormal,determinant' END AS reasons FROM (SELECT *, CASE WHEN view_id % 10 = 3 THEN 1.5 ELSE 1.0 END AS f FROM views)""")
def _(spark, sf):
    f = F.when(F.col("view_id") % 10 == 3, 1.5).otherwise(1.0)
    v = A.views(spark, sf).withColumns({c: F.col(c) * f for c in C.ROTATION})
    return v.select("view_id", (F.size(pose_checks()) == 0).alias("passed"), F.concat_ws(",", pose_checks()).alias("reasons"))


@query("pose_residual_gate", A.VIEWS, """p AS (SELECT view_id, (view_id % 5) * 0.0008::DOUBLE AS dt, (view_id % 3) * 0.2::DOUBLE AS da FROM views)""",
"SELECT view_id, round(dt, 6) AS translation_m, round(da, 6) AS rotation_deg, dt <= 0.002 AND da <= 0.3 AS passed, concat_ws(',', CASE WHEN dt > 0.002 THEN 'translation' END, CASE WHEN da > 0.3 THEN 'rotation' END) AS reasons FROM p")
def _(spark, sf):
    p = A.views(spark, sf).select("view_id", ((F.col("view_id") % 5) * 0.0008).alias("dt"), ((F.col("view_id") % 3) * 0.2).alias("da"))
    why = C.reasons(("translation", F.col("dt") <= 0.002), ("rotation", F.col("da") <= 0.3))
    return p.select("view_id", F.round("dt", 6).alias("translation_m"), F.round("da", 6).alias("rotation_deg"), (F.size(why) == 0).alias("passed"), F.concat_ws(",", why).alias("reasons"))


@query("box_support_select", A.POINTS, """SELECT view_id, count(*) AS n_input, count(*) FILTER (WHERE i) AS n_kept, round(min(x) FILTER (WHERE i), 6) AS min_x, round(max(z) FILTER (WHERE i), 6) AS max_z,
count(*) FILTER (WHERE i) >= 20 AND count(*) FILTER (WHERE i) / count(*) >= 0.5 AS passed FROM (SELECT *, x BETWEEN -0.15 AND 0.15 AND y BETWEEN -0.15 AND 0.15 AND z BETWEEN -0.15 AND 0.15 AS i FROM points) GROUP BY 1""")
def _(spark, sf):
    got = P.box_support_select(A.points(spark, sf), [-0.15] * 3, [0.15] * 3, 20, 0.5)
    return got.select("view_id", "n_input", "n_kept", *r6("min_x", "max_z"), "passed")


STEREO = "stereo AS (SELECT view_id, v, u, raw_stereo / 1000.0::DOUBLE AS depth_m FROM pixels WHERE u % 3 <> 0)"


def stereo(spark, sf):
    return A.pixels(spark, sf).filter("u % 3 <> 0").select(*P.PIXEL, (F.col("raw_stereo") / 1000.0).alias("depth_m"))


@query("self_mask", A.PIXELS, NATIVE, STEREO, """SELECT view_id, v, u, coalesce(p > 0 AND m >= p - 0.0105, false) AS masked, coalesce(p > 0 AND m >= p - 0.0105, false) AND m <= p + 0.0105 AS matched
FROM (SELECT n.view_id, n.v, n.u, CAST(n.depth_m AS DOUBLE) AS m, s.depth_m AS p FROM native n LEFT JOIN stereo s USING (view_id, v, u))""")
def _(spark, sf):
    px = native(spark, sf).withColumn("depth_m", F.col("depth_m").cast("double"))
    return P.self_mask(px, stereo(spark, sf), 0.0105, 0.0105).select(*P.PIXEL, "masked", "matched")


@query("dilate_mask", A.PIXELS, """o AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) t(dv, du))""",
"SELECT DISTINCT view_id, v + dv AS v, u + du AS u FROM pixels, o WHERE raw_depth = 0 AND v + dv BETWEEN 0 AND 7 AND u + du BETWEEN 0 AND 19999")
def _(spark, sf):
    return P.dilate_mask(A.pixels(spark, sf).filter("raw_depth = 0"), P.disc(1), A.WIDTH, A.HEIGHT)


@query("z_buffer", A.PIXELS, NATIVE, CLOUD, PROJECTED, """o AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) t(dv, du))""",
"""SELECT view_id, CAST(round_even(pv, 0) AS BIGINT) + dv AS v, CAST(round_even(pu, 0) AS BIGINT) + du AS u, round(min(z), 6) AS z FROM projected, o
WHERE z > 0 AND round_even(pv, 0) + dv BETWEEN 0 AND 7 AND round_even(pu, 0) + du BETWEEN 0 AND 19999 GROUP BY 1, 2, 3""")
def _(spark, sf):
    p = P.project_points(cloud(spark, sf).select("view_id", "x", "y", "z"), *CAMERA)
    return P.z_buffer(p, P.disc(1), A.WIDTH, A.HEIGHT).select(*P.PIXEL, *r6("z"))


@query("depth_band", A.PIXELS, NATIVE, CLOUD, PROJECTED, """o AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) t(dv, du))""",
"""SELECT view_id, CAST(round_even(pv, 0) AS BIGINT) + dv AS v, CAST(round_even(pu, 0) AS BIGINT) + du AS u, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max FROM projected, o
WHERE z > 0 AND round_even(pv, 0) + dv BETWEEN 0 AND 7 AND round_even(pu, 0) + du BETWEEN 0 AND 19999 GROUP BY 1, 2, 3""")
def _(spark, sf):
    p = P.project_points(cloud(spark, sf).select("view_id", "x", "y", "z"), *CAMERA)
    return P.depth_band(p, P.disc(1), A.WIDTH, A.HEIGHT).select(*P.PIXEL, *r6("z_min", "z_max"))


@query("reference_depth_mask", A.PIXELS, NATIVE, STEREO, """SELECT n.view_id, n.v, n.u, coalesce(CAST(n.depth_m AS DOUBLE) BETWEEN s.depth_m - 0.0105 AND s.depth_m + 0.0205, false) AS target FROM native n LEFT JOIN stereo s USING (view_id, v, u)""")
def _(spark, sf):
    px = native(spark, sf).withColumn("depth_m", F.col("depth_m").cast("double"))
    return P.reference_depth_mask(px, stereo(spark, sf).withColumnRenamed("depth_m", "z"), 0.0105, 0.0205).select(*P.PIXEL, "target")


@query("projected_support_mask", A.PIXELS, NATIVE, STEREO, """o AS (SELECT * FROM (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)) t(dv, du)),
b AS (SELECT view_id, v + dv AS v, u + du AS u, min(depth_m) AS lo, max(depth_m) AS hi FROM stereo, o WHERE depth_m > 0 AND v + dv BETWEEN 0 AND 7 AND u + du BETWEEN 0 AND 19999 GROUP BY 1, 2, 3)""",
"SELECT view_id, v, u FROM native JOIN b USING (view_id, v, u) WHERE CAST(depth_m AS DOUBLE) >= lo - 0.0105 AND CAST(depth_m AS DOUBLE) <= hi + 0.0105")
def _(spark, sf):
    px = native(spark, sf).withColumn("depth_m", F.col("depth_m").cast("double"))
    ref = stereo(spark, sf).select("view_id", F.col("v").alias("pv"), F.col("u").alias("pu"), F.col("depth_m").alias("z"))
    return P.projected_support_mask(px, P.depth_band(ref, P.disc(1), A.WIDTH, A.HEIGHT), 0.0105).select(*P.PIXEL)


@query("polygon_roi", A.PIXELS, "SELECT view_id, v, u FROM pixels WHERE v >= 1 AND v <= 6 AND u >= 100 AND u <= 100 + (v - 1) * 200")
def _(spark, sf):
    return P.polygon_roi(A.pixels(spark, sf), [(100, 1), (1100, 6), (100, 6)]).select(*P.PIXEL)


@query("valid_domain_boundary", A.PIXELS, """SELECT view_id, v, u FROM (SELECT *, min(v) OVER w AS v0, max(v) OVER w AS v1, min(u) OVER w AS u0, max(u) OVER w AS u1 FROM pixels WHERE valid WINDOW w AS (PARTITION BY view_id))
WHERE v <= v0 + 1 OR v >= v1 - 1 OR u <= u0 + 1 OR u >= u1 - 1""")
def _(spark, sf):
    return P.valid_domain_boundary(A.pixels(spark, sf), 1).select(*P.PIXEL)


@query("smooth_depth_filter", A.PIXELS, """f AS (SELECT 0 AS view_id, v, u // 8 AS u, min(raw_depth) / 1000.0::DOUBLE AS depth_m FROM pixels WHERE raw_depth > 0 GROUP BY 2, 3),
o AS (SELECT * FROM (VALUES (-1), (0), (1)) a(dv), (VALUES (-1), (0), (1)) b(du)),
g AS (SELECT view_id, v + dv AS v, u + du AS u FROM f, o GROUP BY 1, 2, 3 HAVING count(*) = 9 AND max(depth_m) - min(depth_m) <= 0.0605)""",
"SELECT v, u, depth_m FROM f JOIN g USING (view_id, v, u)")
def _(spark, sf):
    f = A.pixels(spark, sf).filter("raw_depth > 0").groupBy("v", F.floor(F.col("u") / 8).alias("u")).agg((F.min("raw_depth") / 1000.0).alias("depth_m")).withColumn("view_id", F.lit(0))
    return P.smooth_depth_filter(f, 1, 0.0605).select("v", "u", "depth_m")


@query("robust_range_filter", A.POINTS_BIG, """m AS (SELECT map_id, quantile_cont(y, 0.5) AS med FROM points_big GROUP BY 1),
d AS (SELECT map_id, quantile_cont(abs(y - med), 0.5) AS mad, any_value(med) AS med FROM points_big JOIN m USING (map_id) GROUP BY 1)""",
"SELECT map_id AS view_id, count(*) AS n, round(max(y), 4) AS highest FROM points_big JOIN d USING (map_id) WHERE y <= med + greatest(1.0 * 1.4826 * mad, 0.5) GROUP BY 1")
def _(spark, sf):
    p = A.points_big(spark, sf).withColumnRenamed("map_id", "view_id")
    return P.robust_range_filter(p, "y", 1.0, 0.5, 0.2).groupBy("view_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("y"), 4).alias("highest"))


@query("voxel_centroids", A.POINTS_BIG, """SELECT map_id, CAST(floor(x / 5) AS BIGINT) AS ix, CAST(floor(y / 5) AS BIGINT) AS iy, CAST(floor(z / 5) AS BIGINT) AS iz, round(avg(x), 9) AS x, round(avg(y), 9) AS y, round(avg(z), 9) AS z, count(*) AS n
FROM points_big GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    return P.voxel_centroids(A.points_big(spark, sf), 5.0, "map_id").select("map_id", "ix", "iy", "iz", *(F.round(a, 9).alias(a) for a in "xyz"), "n")
