"""Queries on surfaces and pose sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanspark.operators import maps as M
from scanspark.operators import surface as S
from scanspark.plans import adapters as A
from scanspark.plans.adapters import sql
from scanspark.plans.pixel_queries import r6

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, *parts: str):
    def add(f):
        Q[name] = f
        if parts:
            SQL[name] = sql(*parts)
        return f

    return add


@query("fuse_views", A.POINTS, "v AS (SELECT side, view_id, CAST(floor(x / 0.1) AS BIGINT) AS ix, CAST(floor(y / 0.1) AS BIGINT) AS iy, CAST(floor(z / 0.1) AS BIGINT) AS iz, avg(x) AS x, avg(y) AS y, avg(z) AS z, count(*) AS n FROM points GROUP BY ALL)",
"SELECT side, ix, iy, iz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS views, CAST(sum(n) AS BIGINT) AS n FROM v GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return S.fuse_views(A.points(spark, sf), 0.1).select("side", "ix", "iy", "iz", *r6("x", "y", "z"), "views", "n")


@query("build_proxy")
def _(spark, sf):
    return S.build_proxy(A.points(spark, sf), 0.05, 0.01, 0.02, "view_id").select("view_id", "n", *r6("l0", "h0", "l1", "h1", "l2", "h2"))


@query("fit_height_surface")
def _(spark, sf):
    return S.fit_height_surface(A.points(spark, sf), ["view_id"]).select("point_id", "view_id", *r6("height", "residual"))


@query("segment_protrusion")
def _(spark, sf):
    return S.segment_protrusion(A.points(spark, sf), ["side"], "point_id", 0.1, 0.15, 10).select("side", "point_id", "component", "size", "second", "passed")


ST = "st AS (SELECT point_id, view_id, x + 0.5 AS s, y + 0.5 AS t, degrees(acos(greatest(least(z / sqrt(x * x + y * y + z * z), 1), -1))) AS curvature_deg FROM points)"


def st(spark, sf):
    from scanspark.functions import columns as C

    p = [F.col(a) for a in "xyz"]
    return A.points(spark, sf).select("point_id", "view_id", (F.col("x") + 0.5).alias("s"), (F.col("y") + 0.5).alias("t"), C.angle_deg(F.try_divide(p[2], C.norm(p))).alias("curvature_deg"))


@query("partition_surface", A.POINTS, ST, """l AS (SELECT *, CASE WHEN s <= 0.3 THEN 'root' WHEN s >= 0.7 THEN 'tip' WHEN t <= 0.3 THEN 'leading' WHEN t >= 0.7 THEN 'trailing' ELSE 'main' END AS region, CAST(floor(t / 0.25) AS INTEGER) AS row, CAST(floor(s / 0.25) AS INTEGER) AS col FROM st)""",
"SELECT point_id, format('{:s}_r{:02d}_c{:02d}', region, row, col) AS patch_id FROM (SELECT *, count(*) OVER (PARTITION BY view_id, region, row, col) AS n FROM l) WHERE n >= 3")
def _(spark, sf):
    return S.partition_surface(st(spark, sf), "view_id", 0.3, 0.25, 0.25, 3).select("point_id", "patch_id")


@query("adaptive_split")
def _(spark, sf):
    return S.adaptive_split(st(spark, sf), ["view_id"], 60.0, 5).select("point_id", "view_id", "leaf")


@query("extract_mesh")
def _(spark, sf):
    p = A.points_big(spark, sf)
    cell = p.groupBy((F.col("map_id") % 2).alias("side"), *(F.floor(F.col(a) / n).cast("long").alias(f"i{a}") for a, n in (("x", 3), ("y", 6), ("z", 2)))).agg(F.count(F.lit(1)).alias("w"))
    field = F.sqrt(F.pow(F.col("ix") - 8, 2) + F.pow(F.col("iy") - 8, 2) + F.pow(F.col("iz") - 2, 2)) - 5.3
    mesh = S.extract_mesh(cell.withColumn("d", field), 1.0, 1.0)
    return M.mesh_edges(mesh.withColumnRenamed("side", "mesh_id")).groupBy("mesh_id").agg(F.count(F.lit(1)).alias("edges"), F.sum(F.col("boundary").cast("long")).alias("boundary_edges"), (F.max("n") <= 2).alias("manifold"))


@query("foreground_select")
def _(spark, sf):
    t = A.table(spark, sf, "lineitem")
    f = t.groupBy(F.col("l_linenumber").alias("v"), F.floor(F.col("l_partkey") / 8).alias("u")).agg((1 + F.min("l_quantity") * 0.02).alias("depth_m"))
    f = f.withColumn("view_id", F.floor(F.col("u") / 50)).withColumn("u", F.col("u") % 50)
    return S.foreground_select(f, 0.01, 0.03, 3, 0.95)


@query("pose_loop_metrics")
def _(spark, sf):
    g = S.pose_loop_metrics(A.views(spark, sf), "session_id")
    return g.select("session_id", "n", *(F.round(c, 4).alias(c) for c in ("rmse_m", "rmse_deg", "most_deg")))


@query("pose_observability")
def _(spark, sf):
    g = S.pose_observability(A.views(spark, sf), "session_id", "view_id")
    return g.select("session_id", *(F.round(c, 4).alias(c) for c in ("most_deg", "most_m", "axis_diversity")))
