"""Queries on rays, moments and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanspark.operators import geometry as G
from scanspark.operators import maps as M
from scanspark.plans import adapters as A
from scanspark.plans.adapters import sql
from scanspark.plans.pixel_queries import r6
from scanspark.streaming import telemetry

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, *parts: str):
    def add(f):
        Q[name] = f
        if parts:
            SQL[name] = sql(*parts)
        return f

    return add


def rays(spark, sf):
    p = A.points_big(spark, sf)
    return p.select("map_id", "seq", F.lit(0.3).alias("sx"), F.lit(0.2).alias("sy"), F.lit(0.1).alias("sz"), F.col("x").alias("ex"), F.col("y").alias("ey"), F.col("z").alias("ez"))


@query("ray_voxels")
def _(spark, sf):
    return G.ray_voxels(rays(spark, sf), 2.0)


@query("ray_free_votes")
def _(spark, sf):
    hits = M.occupied_voxels(A.points_big(spark, sf), 2.0, (26, 60, 5))
    return M.free_votes(G.ray_voxels(rays(spark, sf), 2.0, margin=1.0), hits)


@query("pca_frame", A.POINTS, "SELECT view_id, count(*) AS n, round(avg(x), 6) AS mx, round(covar_pop(x, x) + covar_pop(y, y) + covar_pop(z, z), 6) AS total FROM points GROUP BY 1")
def _(spark, sf):
    f = G.pca_frame(A.points(spark, sf), "view_id")
    return f.select("view_id", "n", *r6("mx"), F.round(F.col("e0") + F.col("e1") + F.col("e2"), 6).alias("total"))


@query("oriented_box")
def _(spark, sf):
    return G.oriented_box(A.points(spark, sf), "view_id").select("view_id", "n", *r6("l0", "h0", "l1", "h1", "l2", "h2"))


@query("estimate_normals")
def _(spark, sf):
    return G.estimate_normals(A.points(spark, sf), 8, 0.08, (0.0, 0.0, 1.0)).select("point_id", *r6("nx", "ny", "nz"))


@query("split_two_faces")
def _(spark, sf):
    return G.split_two_faces(A.points(spark, sf), "view_id", "z").select("point_id", "view_id", "face")


@query("connected_components")
def _(spark, sf):
    t = A.table(spark, sf, "lineitem")
    f = t.groupBy(F.col("l_linenumber").alias("v"), F.floor(F.col("l_partkey") / 8).alias("u")).agg((1 + F.min("l_quantity") * 0.02).alias("depth_m")).withColumn("view_id", F.lit(0))
    return G.pixel_components(f, 0.01, 0.03).select("v", "u", "component_v", "component_u")


SQL["connected_components"] = """WITH RECURSIVE f AS (SELECT l_linenumber AS v, l_partkey // 8 AS u, 1 + min(l_quantity) * 0.02::DOUBLE AS depth_m FROM lineitem GROUP BY 1, 2),
e AS (SELECT a.v, a.u, b.v AS v2, b.u AS u2 FROM f a JOIN f b ON (b.v = a.v AND b.u IN (a.u - 1, a.u + 1)) OR (b.u = a.u AND b.v IN (a.v - 1, a.v + 1)) WHERE abs(a.depth_m - b.depth_m) <= greatest(0.01, 0.03 * least(a.depth_m, b.depth_m))),
r AS (SELECT v, u, v AS cv, u AS cu FROM f UNION SELECT e.v2, e.u2, r.cv, r.cu FROM r JOIN e ON e.v = r.v AND e.u = r.u)
SELECT v, u, min(struct_pack(cv := cv, cu := cu)).cv AS component_v, min(struct_pack(cv := cv, cu := cu)).cu AS component_u FROM r GROUP BY 1, 2"""


@query("rate_limited_trace")
def _(spark, sf):
    return telemetry.rate_limited_trace(A.samples(spark, sf), 4 * 3_600_000_000)


@query("settled_windows")
def _(spark, sf):
    return telemetry.settled_windows(A.samples(spark, sf), 40.0, 3_600_000_000)


@query("register_step")
def _(spark, sf):
    p = A.points(spark, sf)
    n = G.estimate_normals(p, 8, 0.08, (0.0, 0.0, 1.0))
    target = p.join(n, "point_id").withColumnRenamed("point_id", "target_id")
    moved = p.withColumn("z", F.col("z") + 0.002)
    got = G.register_step(moved.select("point_id", *"xyz"), target, 0.05)
    return spark.createDataFrame([(got["n"], *(round(float(s), 6) for s in got["step"] or [0.0] * 6))], "n long, rx double, ry double, rz double, tx double, ty double, tz double")
