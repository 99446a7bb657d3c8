"""Queries on view plans, registration and motion."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanspark.functions import columns as C
from scanspark.functions.tables import register_tables
from scanspark.operators import motion, registration
from scanspark.operators import view_plans as V
from scanspark.operators.fins import Fin, segment_fin
from scanspark.operators.foreground import HINT, REGION, Foreground, select_foreground
from scanspark.operators.geometry import estimate_normals
from scanspark.operators.proxies import Proxy, bilateral_proxy
from scanspark.plans import adapters as A
from scanspark.plans.adapters import sql
from scanspark.plans.geometry_queries import rays
from scanspark.plans.pixel_queries import r6
from scanspark.sources.scratch import stored
from scanspark.streaming.settling import Settling, settled_table

Q: dict = {}
SQL: dict[str, str] = {}
CAMERA = V.Camera(320, 240, 300.0, 290.0, 160.0, 120.0)
LIMITS = V.ViewLimits(0.7, 0.4, 0.9, 0.25, margin_px=4, utilization=0.9, projection=0.85, visibility=0.8, occlusion_m=0.05, curvature_deg=40.0, splits=2)


def query(name: str, *parts: str):
    def add(f):
        Q[name] = f
        if parts:
            SQL[name] = sql(*parts)
        return f

    return add


def patched(spark, sf):
    """points with patch_id (a grid of 0.15 m), normals and section coordinates; patches that look along z, with the middle of their points as centre."""
    p = [F.col(a) for a in "xyz"]
    row, col = (F.floor(F.col(a) / 0.15).cast("int") for a in "yx")
    own = A.points(spark, sf).withColumn("patch_id", F.format_string("r%d_c%d", row, col))
    n = dict(zip(("nx", "ny", "nz"), C.normalised([p[0], p[1], F.abs(p[2]) + 0.3]), strict=True))
    own = own.withColumns({**n, "s": F.col("x"), "t": F.col("y")})
    axes = {f"{name}{a}": F.lit(v) for name, vector in (("m", (0.0, 0.0, 1.0)), ("g", (1.0, 0.0, 0.0)), ("h", (0.0, 1.0, 0.0))) for a, v in zip("xyz", vector, strict=True)}
    middle = [((F.min(a) + F.max(a)) / 2).alias(f"c{a}") for a in "xyz"]
    region = F.when(F.min("x") < -0.15, "root").otherwise("main").alias("region")
    patches = own.groupBy("view_id", "patch_id").agg(*middle, region).withColumns(axes)
    return own, patches


PATCHED = """own AS (SELECT *, format('r{}_c{}', CAST(floor(y / 0.15) AS INTEGER), CAST(floor(x / 0.15) AS INTEGER)) AS patch_id FROM points),
patches AS (SELECT view_id, patch_id, (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, (min(z) + max(z)) / 2 AS cz FROM own GROUP BY 1, 2)"""
TRIALS = """trials AS (SELECT *, cz + distance AS tz FROM patches, (SELECT unnest([0.4::DOUBLE, 0.65, 0.7, 0.9]) AS distance)),
met AS (SELECT t.view_id, t.patch_id, t.distance, p.patch_id = t.patch_id AS own, p.x - cx AS lx, -(p.y - cy) AS ly, -(p.z - tz) AS lz FROM trials t JOIN own p USING (view_id)),
px AS (SELECT *, 300 * (lx / lz) + 160 AS u, 290 * (ly / lz) + 120 AS v FROM met WHERE lz > 0),
front AS (SELECT view_id, patch_id, distance, floor(v) AS fv, floor(u) AS fu, min(lz) AS front FROM px WHERE u >= 0 AND u < 320 AND v >= 0 AND v < 240 GROUP BY ALL),
mine AS (SELECT m.view_id, m.patch_id, m.distance, coalesce(lz BETWEEN 0.4 AND 0.9 AND u BETWEEN 19.55 AND 299.45 AND v BETWEEN 15.55 AND 223.45, false) AS counts, lz, front
  FROM (SELECT *, CASE WHEN lz > 0 THEN 300 * (lx / lz) + 160 END AS u, CASE WHEN lz > 0 THEN 290 * (ly / lz) + 120 END AS v FROM met WHERE own) m
  LEFT JOIN front f ON m.view_id = f.view_id AND m.patch_id = f.patch_id AND m.distance = f.distance AND floor(m.v) = fv AND floor(m.u) = fu)"""


@query("fine_view_trials", A.POINTS, PATCHED, TRIALS, "SELECT view_id, patch_id, distance, count(*) AS n, round(avg(counts::INTEGER), 6) AS projection, round(avg((counts AND coalesce(lz <= front + 0.05, false))::INTEGER), 6) AS visibility FROM mine GROUP BY 1, 2, 3")
def _(spark, sf):
    own, patches = patched(spark, sf)
    shares = V.trial_shares(own, V.trial_cameras(patches, LIMITS.distances()), CAMERA, LIMITS, ["view_id"])
    return shares.select("view_id", "patch_id", "distance", "n", *r6("projection", "visibility"))


@query("fine_view_plan")
def _(spark, sf):
    own, patches = patched(spark, sf)
    plan = V.fine_view_plan(own, patches.drop("cx", "cy", "cz"), CAMERA, LIMITS, ["view_id"], (0.3, 0.2))
    return plan.select("view_id", "patch_id", "root_id", "level", "status", "policy", "n", "distance", *r6("best_projection", "best_visibility", "footprint_u", "tx", "ty", "tz"))


@query("register_views")
def _(spark, sf):
    """Each side's views against the side's cloud: a shifted copy finds its way back."""
    p = A.points(spark, sf)
    normals = estimate_normals(p, 8, 0.2, (0.0, 0.0, 1.0), "point_id", ["side"]).withColumnRenamed("point_id", "target_id")
    target = stored(p.withColumnRenamed("point_id", "target_id").join(normals, ["side", "target_id"]), "target")
    views = p.select("side", "view_id").distinct()
    target = views.join(target.drop("view_id"), "side")
    source = p.select("side", "view_id", "point_id", (F.col("x") + 0.004).alias("x"), (F.col("y") - 0.003).alias("y"), "z")
    got = registration.register(source, target, ["side", "view_id"], registration.Registration(0.05, passes=4, least=20, most_m=0.02))
    return got.select("side", "view_id", "pairs", *r6("before", "after", "translation_m", "rotation_deg"), "passes", "accepted", "reason")


@query("fuse_registered")
def _(spark, sf):
    p = A.points(spark, sf).withColumn("blade", F.col("view_id") % 3)
    cameras = p.groupBy("blade", "view_id").agg(F.avg("x").alias("tx"), F.avg("y").alias("ty"), F.when(F.col("view_id") % 2 == 0, 1.0).otherwise(-1.0).alias("tz")).withColumn("seq", F.col("view_id"))
    _, told = registration.fuse_registered(p.select("blade", "view_id", *"xyz"), cameras, 0.05, registration.Registration(0.1, passes=2, least=20, most_m=0.05), ["blade"], 8)
    return told.select("blade", "side", "view_id", "pairs", *r6("before", "after"), "accepted", "reason")


def robot_states(spark, sf):
    """A state for each event: joints and place follow its value, the tool turns about z."""
    s = A.samples(spark, sf)
    a = (F.col("id") % 11) * 0.01
    zero, one = F.lit(0.0), F.lit(1.0)
    r = [F.cos(a), -F.sin(a), zero, F.sin(a), F.cos(a), zero, zero, zero, one]
    q = F.array(*((F.col("value") / (1000 * (j + 1))).alias("q") for j in range(6)))
    return s.select("trace_id", F.col("id").alias("seq"), "us", (F.col("us") * 1000).alias("host_ns"), (F.col("ctrl_us") / 1e6).alias("ctrl_s"), "ctrl_us", q.alias("q"), *(c.alias(n) for c, n in zip(r, C.ROTATION, strict=True)), (F.col("value") / 1000).alias("tx"), ((F.col("id") % 7) * 0.001).alias("ty"), zero.alias("tz"), "value")


STATES = """st AS (SELECT trace_id, id AS seq, us, ctrl_us / 1e6 AS ctrl_s, value, value / 1000 AS tx, (id % 7) * 0.001::DOUBLE AS ty, (id % 11) * 0.01::DOUBLE AS a FROM samples),
steps AS (SELECT *, us * 1000 / 1e9 - lag(us * 1000 / 1e9) OVER w AS h, ctrl_s - lag(ctrl_s) OVER w AS c FROM st WINDOW w AS (PARTITION BY trace_id ORDER BY seq)),
froze AS (SELECT *, last_value(CASE WHEN coalesce(c > 0, true) THEN us END IGNORE NULLS) OVER (PARTITION BY trace_id ORDER BY seq ROWS UNBOUNDED PRECEDING) AS moved FROM steps),
told AS (SELECT trace_id, count(*) AS samples, max(greatest(h, c)) AS gap_s, max((us - moved) / 1e6) AS frozen_s, coalesce(min(least(h, c)) >= 0, true) AS forward, max(value / 1000) - min(value / 1000) AS joint FROM froze GROUP BY 1),
k AS (SELECT DISTINCT trace_id, tx, ty, a, value FROM st),
d AS (SELECT x.trace_id, max(sqrt(pow(x.tx - y.tx, 2) + pow(x.ty - y.ty, 2))) AS translation, max(abs(x.a - y.a)) AS rotation FROM k x JOIN k y USING (trace_id) GROUP BY 1),
n AS (SELECT trace_id, count(*) AS "distinct" FROM k GROUP BY 1)"""


@query("stationary_states", A.SAMPLES, STATES, """SELECT trace_id, samples, "distinct", round(coalesce(gap_s, 0), 6) AS gap_s, round(frozen_s, 6) AS frozen_s, round(joint, 6) AS joint, round(translation, 6) AS translation, round(rotation, 5) AS rotation,
concat_ws(',', CASE WHEN samples < 3 THEN 'too_few' END, CASE WHEN NOT forward THEN 'clock_back' END, CASE WHEN coalesce(gap_s, 0) > 40000 THEN 'gap' END, CASE WHEN frozen_s > 40000 THEN 'frozen' END, CASE WHEN joint > 0.0985 THEN 'joint' END, CASE WHEN translation > 0.0985 THEN 'translation' END, CASE WHEN rotation > 0.095 THEN 'rotation' END) AS reasons
FROM told JOIN d USING (trace_id) JOIN n USING (trace_id)""")
def _(spark, sf):
    got = motion.stationary_trace(robot_states(spark, sf), "trace_id", 0.0985, 0.0985, 0.095, 40_000.0)
    return got.select("trace_id", "samples", "distinct", *r6("gap_s", "frozen_s", "joint", "translation"), F.round("rotation", 5).alias("rotation"), "reasons")


@query("farthest_points", A.POINTS, "SELECT view_id, round(max(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2) + pow(a.z - b.z, 2))), 6) AS farthest FROM points a JOIN points b USING (view_id) GROUP BY 1")
def _(spark, sf):
    return motion.farthest(A.points(spark, sf), ["view_id"]).select("view_id", *r6("farthest"))


@query("settled_reports")
def _(spark, sf):
    rules = Settling(3 * 3_600_000_000, 10 * 24 * 3_600_000_000, 10 * 24 * 3_600_000_000, 0.06, 0.06, 0.2)
    s = robot_states(spark, sf).select("trace_id", "us", F.col("us").alias("host_us"), "ctrl_us", "q", F.lit(True).alias("stopped"), F.lit(None).cast("array<double>").alias("speeds"), *C.POSE)
    return settled_table(s, rules)


@query("voxels_of_rays")
def _(spark, sf):
    register_tables(spark)
    # A view of its own name for each call, as several may be open in a session.
    name = f"rays_{abs(hash(sf)) % 10**8}"
    rays(spark, sf).createOrReplaceTempView(name)
    return spark.sql(f"SELECT DISTINCT * FROM voxels_of_rays(TABLE(SELECT CAST(map_id AS LONG) AS map_id, CAST(seq AS LONG) AS seq, CAST(sx AS DOUBLE) AS sx, CAST(sy AS DOUBLE) AS sy, CAST(sz AS DOUBLE) AS sz, ex, ey, ez FROM {name}), 2.0D, 0.0D)")


@query("foreground_modes")
def _(spark, sf):
    """Depth images of 50 columns, a third of them with a hint and a third with a region."""
    t = A.table(spark, sf, "lineitem")
    f = t.groupBy(F.col("l_linenumber").alias("v"), F.floor(F.col("l_partkey") / 8).alias("at")).agg((1 + F.min("l_quantity") * 0.02).alias("depth_m"))
    f = f.select(F.floor(F.col("at") / 50).alias("view_id"), "v", (F.col("at") % 50).alias("u"), "depth_m", (F.col("depth_m") < 1.9).alias("valid"))
    mode = F.when(F.col("view_id") % 3 == 1, HINT).when(F.col("view_id") % 3 == 2, REGION)
    seeds = f.select("view_id", mode.alias("mode"), "v", "u").filter("mode IS NOT NULL AND v BETWEEN 3 AND 5 AND u BETWEEN 5 AND 30")
    _, report = select_foreground(f, seeds, Foreground(1.0, 1.9, 20, 1, 0.05, 0.03, ambiguity=0.95))
    return report.select("view_id", "mode", "pixels", "valid", "components", "at_border", "interior", "largest", "second", "seeds", "valid_seeds", "mask_seeds", "mask", *r6("depth_mid"), "reason", "passed")


@query("segment_fin")
def _(spark, sf):
    p = A.points(spark, sf)
    n = dict(zip(("nx", "ny", "nz"), C.normalised([F.col("x") * 0.3, F.col("y") * 0.3, F.col("z")]), strict=True))
    parts, _ = segment_fin(p.withColumns(n), ["side"], "point_id", Fin(0.12, 0.1, 0.06, 0.8, 0.7, 8, 0.9, least_main_seeds=10))
    return parts.select("side", "point_id", *r6("residual"), "part")


@query("bilateral_proxy")
def _(spark, sf):
    p = A.points(spark, sf)
    cameras = p.groupBy("view_id").agg(F.avg("x").alias("tx"), F.avg("y").alias("ty"), F.lit(1.0).alias("tz"))
    got = bilateral_proxy(p, cameras, Proxy(0.05, 0.03, least_cosine=0.2, planar=(0.6, 0.4), margin=0.01, hidden_margin=0.01), ["view_id"])
    return got.select("view_id", "n", "voxels", *r6("ex", "ey", "ez", "cosine", "tx", "ty", "tz"), "frame", "reason")
