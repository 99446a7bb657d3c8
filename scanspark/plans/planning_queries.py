"""Queries on view planning, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanspark.functions import columns as C
from scanspark.operators import joins as J
from scanspark.operators import planning as L
from scanspark.operators import reports as R
from scanspark.plans import adapters as A
from scanspark.plans.adapters import sql
from scanspark.plans.pixel_queries import r6

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, *parts: str):
    def add(f):
        Q[name] = f
        if parts:
            SQL[name] = sql(*parts).replace("WITH ", "WITH RECURSIVE ", 1)
        return f

    return add


VIEWED = """viewed AS (SELECT v.view_id, v.session_id, tx AS cx, ty AS cy, tz AS cz, r00 AS ax, r10 AS ay, -sign(tz) AS az, 0.05::DOUBLE AS tgx, -0.05::DOUBLE AS tgy, 0.0::DOUBLE AS tgz FROM views v)"""
SCORED = """scored AS (SELECT *, greatest(least((ax * (tgx - cx) + ay * (tgy - cy) + az * (tgz - cz)) / (sqrt(ax * ax + ay * ay + az * az) * sqrt(pow(tgx - cx, 2) + pow(tgy - cy, 2) + pow(tgz - cz, 2))), 1), -1) AS look,
greatest(least(cz * sign(cz) / sqrt(pow(tgx - cx, 2) + pow(tgy - cy, 2) + pow(tgz - cz, 2)), 1), -1) AS incidence, sqrt(pow(tgx - cx, 2) + pow(tgy - cy, 2) + pow(tgz - cz, 2)) AS range, least(1, (0.1 + view_id % 5 * 0.05) / 0.25) AS ratio,
sqrt(pow(greatest(-0.1 - cx, 0, cx - 0.1), 2) + pow(greatest(-0.1 - cy, 0, cy - 0.1), 2) + pow(greatest(-0.1 - cz, 0, cz - 0.1), 2)) AS clearance FROM viewed)"""


def scored(spark, sf):
    sign = F.signum("tz")
    v = A.views(spark, sf).select(
        "view_id", "session_id", F.col("tx").alias("cx"), F.col("ty").alias("cy"), F.col("tz").alias("cz"), F.col("r00").alias("ax"), F.col("r10").alias("ay"), (-sign).alias("az"),
        F.lit(0.05).alias("tx"), F.lit(-0.05).alias("ty"), F.lit(0.0).alias("tz"), F.lit(0.0).alias("nx"), F.lit(0.0).alias("ny"), sign.alias("nz"), (0.1 + F.col("view_id") % 5 * 0.05).alias("footprint"), F.lit(0.25).alias("extent"),
    )
    return L.candidate_metrics(v, 0.6, [-0.1] * 3, [0.1] * 3)


@query("candidate_metrics", A.VIEWS, VIEWED, SCORED, "SELECT view_id, round(look, 6) AS look, round(incidence, 6) AS incidence, round(range, 6) AS range, round(abs(range - 0.6), 6) AS standoff_error, round(clearance, 6) AS clearance, round(greatest(least(0.4 * look + 0.4 * incidence + 0.2 * ratio, 1), 0), 6) AS score FROM scored")
def _(spark, sf):
    return scored(spark, sf).select("view_id", *r6("look", "incidence", "range", "standoff_error", "clearance", "score"))


@query("candidate_filter", A.VIEWS, VIEWED, SCORED, """g AS (SELECT view_id, concat_ws(',', CASE WHEN look < 0.3 THEN 'look' END, CASE WHEN range < 0.4005 OR range > 0.7005 THEN 'range' END, CASE WHEN clearance < 0.3505 THEN 'clearance' END) AS reasons FROM scored)""",
"SELECT view_id, reasons, CASE WHEN reasons <> '' THEN 'rejected' WHEN view_id % 3 = 0 THEN 'geometry_only' WHEN view_id % 4 <> 1 THEN 'endpoint_feasible' ELSE 'rejected' END AS status FROM g")
def _(spark, sf):
    s = scored(spark, sf)
    feasible = s.filter("view_id % 3 <> 0").select("view_id", (F.col("view_id") % 4 != 1).alias("feasible"))
    got = L.candidate_filter(s, {"look": (0.3, None), "range": (0.4005, 0.7005), "clearance": (0.3505, None)}, feasible, "view_id")
    return got.select("view_id", "reasons", "status")


RANKED = "row_number() OVER (PARTITION BY plan_id ORDER BY round(gain, 9) DESC, {}) AS rank"


@query("coarse_rank", A.CANDIDATES, "g AS (SELECT plan_id, candidate_id, cbrt((0.5 + score / 2) * (1 - distance) * cos(radians(tilt))) * (0.5 * (row / 8.0::DOUBLE) + 0.3 * (col / 12.0::DOUBLE) + 0.2 * (candidate_id % 2)) AS gain, tilt FROM candidates)",
f"SELECT plan_id, candidate_id, round(gain, 6) AS gain, {RANKED.format('tilt, candidate_id')} FROM g WHERE gain >= 0.05")
def _(spark, sf):
    gain = L.coarse_gain(0.5 + F.col("score") / 2, 1 - F.col("distance"), F.cos(F.radians("tilt")), F.col("row") / 8, F.col("col") / 12, F.col("candidate_id") % 2, (0.5, 0.3, 0.2))
    g = A.candidates(spark, sf).withColumn("gain", gain).filter("gain >= 0.05")
    got = L.ranked(g, "plan_id", [F.desc(F.round("gain", 9)), F.col("tilt"), F.col("candidate_id")])
    return got.select("plan_id", "candidate_id", *r6("gain"), F.col("rank").cast("long"))


@query("fine_rank", A.CANDIDATES, """m AS (SELECT *, cbrt((0.5 + score / 2) * greatest(least(1 - distance, 1), 0) * cos(radians(tilt))) AS quality, greatest(col / 12.0::DOUBLE, least(tilt / 30.0::DOUBLE, 1)) AS deficit FROM candidates),
g AS (SELECT plan_id, candidate_id, distance, (1 + row % 3) * (0.7 * (1 - score) * quality + 0.3 * score * deficit * quality) + CASE WHEN side = 'back' THEN 0.1::DOUBLE ELSE 0 END * quality AS gain FROM m)""",
f"SELECT plan_id, candidate_id, round(gain, 6) AS gain, {RANKED.format('distance, candidate_id')} FROM g")
def _(spark, sf):
    gain = L.fine_gain(1 + F.col("row") % 3, F.col("score"), F.col("tilt").cast("double"), 30.0, 1 - F.col("col") / 12, 0.5 + F.col("score") / 2, 1 - F.col("distance"), F.cos(F.radians("tilt")), F.when(F.col("side") == "back", 0.1).otherwise(0.0))
    got = L.ranked(A.candidates(spark, sf).withColumn("gain", gain), "plan_id", [F.desc(F.round("gain", 9)), F.col("distance"), F.col("candidate_id")])
    return got.select("plan_id", "candidate_id", *r6("gain"), F.col("rank").cast("long"))


@query("attempt_rank", A.CANDIDATES, "SELECT plan_id, candidate_id, row_number() OVER (PARTITION BY plan_id ORDER BY round(sin(radians(tilt)) * cos(radians(tilt)), 9) DESC, distance, tilt, row, col, candidate_id) AS rank FROM candidates")
def _(spark, sf):
    t = F.radians("tilt")
    got = L.ranked(A.candidates(spark, sf), "plan_id", [F.desc(F.round(F.sin(t) * F.cos(t), 9)), *map(F.col, ("distance", "tilt", "row", "col", "candidate_id"))])
    return got.select("plan_id", "candidate_id", F.col("rank").cast("long"))


@query("serpentine_order", A.CANDIDATES, "SELECT plan_id, candidate_id, row_number() OVER (PARTITION BY plan_id ORDER BY side <> 'front', side, row, CASE WHEN row % 2 = 0 THEN col ELSE -col END, candidate_id) AS rank FROM candidates")
def _(spark, sf):
    return L.serpentine_order(A.candidates(spark, sf), "plan_id", "front", "candidate_id").select("plan_id", "candidate_id", F.col("rank").cast("long"))


@query("shell_order", A.CANDIDATES, "p AS (SELECT DISTINCT plan_id FROM candidates), s AS (SELECT a::INTEGER AS s0, b::INTEGER AS s1, c::INTEGER AS s2 FROM (SELECT unnest(range(0, 5)) AS a), (SELECT unnest(range(0, 5)) AS b), (SELECT unnest(range(0, 5)) AS c) ORDER BY a + b + c, greatest(a, b, c), a, b, c LIMIT 60)", "SELECT plan_id, s0, s1, s2 FROM p, s")
def _(spark, sf):
    plans = A.candidates(spark, sf).select("plan_id").distinct()
    shell = L.shell_order(spark, 3, 5, 60)
    # The shell has `limit` rows whatever the plans are.
    return plans.join(F.broadcast(shell.withColumn("__one", F.lit(1))), F.lit(1) == F.col("__one")).drop("__one")


@query("split_serial", A.CANDIDATES, "SELECT candidate_id, row_number() OVER (PARTITION BY plan_id, side, row, col ORDER BY candidate_id) - 1 AS serial, format('{:s}_r{:02d}_c{:02d}', side, row, col) AS patch_id FROM candidates")
def _(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("plan_id", "side", "row", "col").orderBy("candidate_id")
    return A.candidates(spark, sf).select("candidate_id", (F.row_number().over(w) - 1).cast("long").alias("serial"), C.patch_id(F.col("side"), F.col("row"), F.col("col")).alias("patch_id"))


@query("collection_gate", A.CANDIDATES, "g AS (SELECT plan_id, count(*) AS n, count(*) FILTER (WHERE side = 'front') AS front, count(*) FILTER (WHERE side = 'back') AS back, count(DISTINCT row) AS rows FROM candidates WHERE score > 0.47 GROUP BY 1)",
"SELECT plan_id, n, reasons = '' AS passed, reasons FROM (SELECT *, concat_ws(',', CASE WHEN n < 100 THEN 'n' END, CASE WHEN front < 95 THEN 'front' END, CASE WHEN back < 45 THEN 'back' END, CASE WHEN rows < 8 THEN 'rows' END) AS reasons FROM g)")
def _(spark, sf):
    from scanspark.operators.metrics import gate

    n = lambda s: F.sum((F.col("side") == s).cast("long"))
    g = A.candidates(spark, sf).filter("score > 0.47").groupBy("plan_id").agg(F.count(F.lit(1)).alias("n"), n("front").alias("front"), n("back").alias("back"), F.count_distinct("row").alias("rows"))
    return gate(g, {"n": (100, None), "front": (95, None), "back": (45, None), "rows": (8, None)}).select("plan_id", "n", "passed", "reasons")


PLAN = """v AS (SELECT plan_id, candidate_id AS view_id, format('{:s}_r{:02d}_c{:02d}', side, row, col) AS patch_id, side, CASE WHEN row = 0 THEN 'root' WHEN row = 7 THEN 'tip' WHEN col = 0 THEN 'leading_edge' WHEN col = 11 THEN 'trailing_edge' ELSE 'surface' END AS region,
  distance, score + 0.42 AS projection, 1 - tilt / 100.0::DOUBLE AS visibility, col * 0.1::DOUBLE + candidate_id % 5 * 0.02 AS tx, row * 0.1::DOUBLE AS ty, candidate_id % 5 * 0.02::DOUBLE AS dx FROM candidates),
twice AS (SELECT DISTINCT a.view_id FROM v a JOIN v b ON a.plan_id = b.plan_id AND a.side = b.side AND a.view_id <> b.view_id AND sqrt(pow(a.tx - b.tx, 2) + pow(a.ty - b.ty, 2) + pow(a.distance - b.distance, 2)) <= 0.015),
checked AS (SELECT v.*, concat_ws(',', CASE WHEN abs(sqrt(dx * dx + distance * distance) - distance) > 0.0052 THEN 'distance' END, CASE WHEN distance / sqrt(dx * dx + distance * distance) < 0.97 THEN 'look' END,
  CASE WHEN projection + 1e-12 < 0.9 THEN 'projection' END, CASE WHEN visibility + 1e-12 < 0.7 THEN 'visibility' END, CASE WHEN distance < 0.1 OR distance > 0.45 THEN 'bounds' END, CASE WHEN t.view_id IS NOT NULL THEN 'duplicate' END) AS reasons FROM v LEFT JOIN twice t USING (view_id))"""


def inspected(spark, sf):
    """Each candidate as a view of its patch; every fifth step looks past its patch's centre by up to 8 cm."""
    c = A.candidates(spark, sf)
    front = F.col("side") == "front"
    region = F.when(F.col("row") == 0, "root").when(F.col("row") == 7, "tip").when(F.col("col") == 0, "leading_edge").when(F.col("col") == 11, "trailing_edge").otherwise("surface")
    turn = [1.0, 0.0, 0.0, 0.0, F.when(front, -1.0).otherwise(1.0), 0.0, 0.0, 0.0, F.when(front, -1.0).otherwise(1.0)]
    own = c.select(
        "plan_id", F.col("candidate_id").alias("view_id"), C.patch_id(F.col("side"), F.col("row"), F.col("col")).alias("patch_id"), "side", region.alias("region"), "distance", (F.col("score") + 0.42).alias("projection"),
        (1 - F.col("tilt") / 100).alias("visibility"), F.col("distance").alias("footprint_u"), (F.col("distance") / 2).alias("footprint_v"), *(F.lit(x).alias(n) if isinstance(x, float) else x.alias(n) for x, n in zip(turn, C.ROTATION, strict=True)),
        (F.col("col") * 0.1 + F.col("candidate_id") % 5 * 0.02).alias("tx"), (F.col("row") * 0.1).alias("ty"), F.when(front, F.col("distance")).otherwise(-F.col("distance")).alias("tz"), (F.col("col") * 0.1).alias("cx"),
    )
    zero = F.lit(0.0)
    patches = own.select("plan_id", "patch_id", "side", "region", "cx", F.col("ty").alias("cy"), zero.alias("cz"), zero.alias("mx"), zero.alias("my"), F.when(F.col("side") == "front", 1.0).otherwise(-1.0).alias("mz")).distinct()
    limits = R.PlanLimits(0.3, 0.1, 0.45, 0.0052, 0.97, 0.9, 0.9, 0.7, 0.015, 1.0)
    return R.inspect_plan(own.drop("side", "region", "cx"), patches, limits)


@query("plan_inspection", A.CANDIDATES, PLAN, "SELECT plan_id, view_id, patch_id, side, region, reasons = '' AS accepted, reasons FROM checked")
def _(spark, sf):
    return inspected(spark, sf)[0].select("plan_id", "view_id", "patch_id", "side", "region", "accepted", "reasons")


@query("plan_regions", A.CANDIDATES, PLAN, "need AS (SELECT * FROM (SELECT DISTINCT plan_id FROM candidates), (VALUES ('front'), ('back')) s(side), (VALUES ('surface'), ('leading_edge'), ('trailing_edge'), ('root'), ('tip')) r(region)), got AS (SELECT plan_id, side, region, count(*) AS planned, count(*) FILTER (WHERE reasons = '') AS accepted FROM checked GROUP BY 1, 2, 3)",
"SELECT plan_id, side, region, coalesce(planned, 0) AS planned, coalesce(accepted, 0) AS accepted, CASE WHEN planned IS NULL THEN 'no_view' WHEN accepted = 0 THEN 'no_accepted' END AS missing FROM need LEFT JOIN got USING (plan_id, side, region)")
def _(spark, sf):
    return inspected(spark, sf)[1]


FINAL = """q AS (SELECT plan_id AS blade_id, format('{:s}_r{:02d}_c{:02d}', side, row, col) AS patch_id, any_value(side) AS side, CASE any_value(row) WHEN 0 THEN 'fin_root' WHEN 1 THEN 'fin_face' WHEN 2 THEN 'fin_free_edge' ELSE 'surface' END AS region, min(score) >= 0.4505 AS complete FROM candidates GROUP BY 1, 2),
p AS (SELECT blade_id, count(*) AS required, count(*) FILTER (WHERE complete) AS complete FROM q GROUP BY 1),
w AS (SELECT view_id % 10 AS blade_id, count(*) FILTER (WHERE tz > 0) AS views_front, count(*) FILTER (WHERE tz < 0) AS views_back FROM views GROUP BY 1),
tri AS (SELECT DISTINCT plan_id AS blade_id, CASE WHEN candidate_id % 40 < 20 THEN 'front' ELSE 'back' END AS side, candidate_id // 10 % 60 AS k FROM candidates WHERE candidate_id // 10 % 60 % 7 <> plan_id % 7),
tc AS (SELECT blade_id, count(*) FILTER (WHERE side = 'front') AS triangles_front, count(*) FILTER (WHERE side = 'back') AS triangles_back FROM tri GROUP BY 1),
ed AS (SELECT blade_id, p, q, count(*) AS n FROM (SELECT blade_id, k AS p, k + 1 AS q FROM tri UNION ALL SELECT blade_id, k + 1, k + 2 FROM tri UNION ALL SELECT blade_id, k, k + 2 FROM tri) GROUP BY ALL),
rim AS (SELECT blade_id, p, q FROM ed WHERE n = 1),
step AS (SELECT blade_id, p AS a, q AS b FROM rim UNION ALL SELECT blade_id, q, p FROM rim),
reach AS (SELECT DISTINCT blade_id, a AS node, a AS root FROM step UNION SELECT r.blade_id, s.b, r.root FROM reach r JOIN step s ON r.blade_id = s.blade_id AND r.node = s.a),
lp AS (SELECT blade_id, count(DISTINCT root) AS boundary_loops FROM (SELECT blade_id, node, min(root) AS root FROM reach GROUP BY 1, 2) GROUP BY 1),
ms AS (SELECT blade_id, count(*) FILTER (WHERE n = 1) AS boundary_edges, min(n) = 2 AND max(n) = 2 AS watertight FROM ed GROUP BY 1),
fin AS (SELECT DISTINCT plan_id AS blade_id, side, plan_id % 3 > 0 AS two_faces FROM candidates WHERE plan_id % 4 > 0 OR side = 'back'),
fc AS (SELECT blade_id, count(*) FILTER (WHERE side = 'front') AS fins_front, count(*) FILTER (WHERE side = 'back') AS fins_back, bool_or(NOT two_faces) AS single FROM fin GROUP BY 1),
rq AS (SELECT blade_id, side, region, count(*) AS n, bool_and(complete) AS ok FROM q WHERE region <> 'surface' GROUP BY 1, 2, 3),
need AS (SELECT * FROM (SELECT blade_id FROM p), (VALUES ('front', 0), ('back', 1)) s(side, so), (VALUES ('fin_face', 0), ('fin_root', 1), ('fin_free_edge', 2)) r(region, ro)),
rr AS (SELECT blade_id, string_agg(CASE WHEN n IS NULL THEN 'missing_' || side || '_' || region WHEN NOT ok THEN 'incomplete_' || side || '_' || region END, ',' ORDER BY so, ro) AS said FROM need LEFT JOIN rq USING (blade_id, side, region) GROUP BY 1),
j AS (SELECT p.*, coalesce(views_front, 0) AS views_front, coalesce(views_back, 0) AS views_back, coalesce(triangles_front, 0) AS triangles_front, coalesce(triangles_back, 0) AS triangles_back, coalesce(fins_front, 0) AS fins_front, coalesce(fins_back, 0) AS fins_back,
  coalesce(boundary_edges, 0) AS boundary_edges, coalesce(boundary_loops, 0) AS boundary_loops, coalesce(watertight, false) AS watertight, coalesce(single, false) AS single, said
  FROM p LEFT JOIN w USING (blade_id) LEFT JOIN tc USING (blade_id) LEFT JOIN lp USING (blade_id) LEFT JOIN ms USING (blade_id) LEFT JOIN fc USING (blade_id) LEFT JOIN rr USING (blade_id)),
s AS (SELECT * EXCLUDE (single, said), concat_ws(',', CASE WHEN complete < required THEN 'patches' END, CASE WHEN views_front < 5 THEN 'views_front' END, CASE WHEN views_back < 5 THEN 'views_back' END, CASE WHEN triangles_front < 14 THEN 'triangles_front' END, CASE WHEN triangles_back < 14 THEN 'triangles_back' END,
  CASE WHEN fins_front <> 1 THEN 'fins_front' WHEN single THEN 'faces_front' END, CASE WHEN fins_back <> 1 THEN 'fins_back' WHEN single THEN 'faces_back' END, said, CASE WHEN boundary_edges > 70 THEN 'boundary_edges' END, CASE WHEN boundary_loops > 6 THEN 'boundary_loops' END, CASE WHEN NOT watertight THEN 'watertight' END) AS violations FROM j)"""


@query("final_gate_report", A.CANDIDATES, A.VIEWS, FINAL, "SELECT *, violations = '' AS passed FROM s")
def _(spark, sf):
    """Plans as blades: patches are complete by score, strips of triangles have gaps, views look from both sides."""
    c = A.candidates(spark, sf).withColumn("blade_id", F.col("plan_id"))
    region = F.when(F.min("row") == 0, "fin_root").when(F.min("row") == 1, "fin_face").when(F.min("row") == 2, "fin_free_edge").otherwise("surface")
    quality = c.groupBy("blade_id", C.patch_id(F.col("side"), F.col("row"), F.col("col")).alias("patch_id")).agg(F.min("side").alias("side"), region.alias("region"), (F.min("score") >= 0.4505).alias("complete"))
    views = A.views(spark, sf).select((F.col("view_id") % 10).alias("blade_id"), F.when(F.col("tz") > 0, "front").otherwise("back").alias("side"))
    k = F.floor(F.col("candidate_id") / 10) % 60
    strip = c.select("blade_id", F.when(F.col("candidate_id") % 40 < 20, "front").otherwise("back").alias("side"), k.alias("a")).filter(F.col("a") % 7 != F.col("blade_id") % 7).distinct()
    fins = c.filter((F.col("blade_id") % 4 > 0) | (F.col("side") == "back")).select("blade_id", "side", (F.col("blade_id") % 3 > 0).alias("two_faces")).distinct()
    gates = R.FinalGates(5, 14, 70, 6, True, True, True)
    return R.final_gate_report(quality.select("blade_id", "patch_id"), quality, views, strip.withColumns({"b": F.col("a") + 1, "c": F.col("a") + 2}), fins, gates)


@query("candidate_progress", A.SAMPLES, "e AS (SELECT trace_id AS run_id, id % 11 AS candidate_id, us AS seq, kind AS status FROM samples)", "SELECT run_id, candidate_id, max_by(status, seq) AS status, max(seq) AS seq, any_value(f) AS first_seq, any_value(l) AS last_seq FROM e JOIN (SELECT run_id, min(seq) AS f, max(seq) AS l FROM e GROUP BY 1) USING (run_id) GROUP BY 1, 2")
def _(spark, sf):
    e = A.samples(spark, sf).select(F.col("trace_id").alias("run_id"), (F.col("id") % 11).alias("candidate_id"), F.col("us").alias("seq"), F.col("kind").alias("status"))
    return L.candidate_progress(e, "run_id", "seq")


@query("patch_grid", "b AS (SELECT s_suppkey AS box_id, s_nationkey * 0.01::DOUBLE AS x0, 1.0::DOUBLE AS x1, 0.0::DOUBLE AS y0, 0.5::DOUBLE AS y1, -0.1::DOUBLE AS z0, 0.1::DOUBLE AS z1 FROM supplier)",
"SELECT box_id, side, row::INTEGER AS row, col::INTEGER AS col, round(x0 + (col + 0.5) * (x1 - x0) / 4, 6) AS x, round(y0 + (row + 0.5) * (y1 - y0) / 3, 6) AS y, CASE WHEN side = 'front' THEN z1 ELSE z0 END AS z, format('{:s}_r{:02d}_c{:02d}', side, row, col) AS patch_id FROM b, (VALUES ('front'), ('back')) s(side), (SELECT unnest(range(0, 3)) AS row), (SELECT unnest(range(0, 4)) AS col)")
def _(spark, sf):
    b = A.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("box_id"), (F.col("s_nationkey") * 0.01).alias("x0"), F.lit(1.0).alias("x1"), F.lit(0.0).alias("y0"), F.lit(0.5).alias("y1"), F.lit(-0.1).alias("z0"), F.lit(0.1).alias("z1"))
    return L.patch_grid(b, 3, 4).select("box_id", "side", "row", "col", *r6("x", "y"), "z", "patch_id")


@query("orbit_poses", A.POINTS, "t AS (SELECT point_id, x, y, z, d, tilt, k FROM points, (SELECT unnest([0.3, 0.4])::DOUBLE AS d), (SELECT unnest([0.0, 15.0])::DOUBLE AS tilt), (SELECT unnest(range(0, 4)) AS k) WHERE tilt > 0 OR k = 0)",
"SELECT point_id, d AS distance, tilt, k::INTEGER AS k, round(x + d * sin(radians(tilt)) * cos(2 * pi() * k / 4), 6) + 0.0 AS cx, round(y + d * sin(radians(tilt)) * sin(2 * pi() * k / 4), 6) + 0.0 AS cy, round(z + d * cos(radians(tilt)), 6) + 0.0 AS cz FROM t")
def _(spark, sf):
    got = L.orbit_poses(A.points(spark, sf), [0.3, 0.4], [0.0, 15.0], 4)
    return got.select("point_id", "distance", "tilt", "k", *((F.round(c, 6) + 0.0).alias(c) for c in ("cx", "cy", "cz")))


NEAR2 = "near2 AS (SELECT a.point_id, b.x - a.x AS dx, b.y - a.y AS dy FROM points a JOIN points b ON a.point_id <> b.point_id AND pow(b.x - a.x, 2) + pow(b.y - a.y, 2) <= 0.0064)"


@query("angular_gap", A.POINTS, NEAR2, "s AS (SELECT point_id, atan2(dy, dx) AS a FROM near2), g AS (SELECT point_id, coalesce(lead(a) OVER (PARTITION BY point_id ORDER BY a), min(a) OVER (PARTITION BY point_id) + 2 * pi()) - a AS g FROM s)", "SELECT point_id, round(degrees(max(g)), 5) AS gap_deg, degrees(max(g)) > 120 AS boundary FROM g GROUP BY 1")
def _(spark, sf):
    return L.widest_gaps(A.points(spark, sf), 0.08, 120.0).select("point_id", F.round("gap_deg", 5).alias("gap_deg"), "boundary")


@query("outer_contour", A.POINTS, "m AS (SELECT view_id, avg(x) AS mx, avg(y) AS my FROM points GROUP BY 1), p AS (SELECT view_id, point_id, x, y, CAST(floor((atan2(y - my, x - mx) + pi()) / (2 * pi()) * 12) AS INTEGER) AS bin, sqrt(pow(x - mx, 2) + pow(y - my, 2)) AS r FROM points JOIN m USING (view_id))",
"SELECT view_id, bin, arg_max(point_id, r) AS point_id, round(max(r), 6) AS radius FROM p GROUP BY 1, 2")
def _(spark, sf):
    return L.outer_contour(A.points(spark, sf), "view_id", 12).select("view_id", "bin", "point_id", *r6("radius"))


CHORD = "d AS (SELECT view_id, point_id, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0) AS d FROM points WINDOW w AS (PARTITION BY view_id ORDER BY point_id))"


@query("chord_parameters", A.POINTS, CHORD, "SELECT view_id, point_id, round(sum(d) OVER (PARTITION BY view_id ORDER BY point_id) / sum(d) OVER (PARTITION BY view_id), 6) AS t FROM d")
def _(spark, sf):
    return L.chord_parameters(A.points(spark, sf), "view_id", "point_id").select("view_id", "point_id", *r6("t"))


@query("section_arclength", A.POINTS, "e AS (SELECT view_id, min(x) AS lo, max(x) AS hi FROM points GROUP BY 1), s AS (SELECT view_id, CAST(least(floor((x - lo) / (hi - lo) * 12), 11) AS INTEGER) AS slice, quantile_cont(x, 0.5) AS x, quantile_cont(y, 0.5) AS y, quantile_cont(z, 0.5) AS z FROM points JOIN e USING (view_id) GROUP BY 1, 2), d AS (SELECT view_id, slice, coalesce(sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2) + pow(z - lag(z) OVER w, 2)), 0) AS d FROM s WINDOW w AS (PARTITION BY view_id ORDER BY slice))",
"SELECT view_id, slice, round(sum(d) OVER (PARTITION BY view_id ORDER BY slice) / sum(d) OVER (PARTITION BY view_id), 6) AS t FROM d")
def _(spark, sf):
    return L.section_arclength(A.points(spark, sf), "view_id", "x", 12).select("view_id", "slice", *r6("t"))


@query("optics", A.VIEWS, "f AS (SELECT view_id, degrees(atan((600 + view_id % 50) / 640.0) + atan((1280 - 600 - view_id % 50) / 640.0)) AS fov, 0.3::DOUBLE + view_id % 7 * 0.05 AS d FROM views)",
"SELECT view_id, round(fov, 6) AS fov_deg, round(2 * d * tan(radians(fov) / 2), 6) AS footprint, greatest(1, CAST(ceil((3.0 - 2 * d * tan(radians(fov) / 2)) / (2 * d * tan(radians(fov) / 2) * 0.75) + 1) AS INTEGER)) AS views_needed FROM f")
def _(spark, sf):
    k = F.col("view_id")
    fov = C.field_of_view_deg(F.lit(1280), F.lit(640.0), 600 + k % 50)
    v = A.views(spark, sf).select("view_id", fov.alias("fov"), (0.3 + k % 7 * 0.05).alias("d")).withColumn("f", C.footprint(F.col("fov"), F.col("d")))
    return v.select("view_id", F.round("fov", 6).alias("fov_deg"), F.round("f", 6).alias("footprint"), C.grid_count(F.lit(3.0), F.col("f"), 0.25).alias("views_needed"))


@query("text_functions", A.CHAIN, "SELECT run_id, seq, 'c-' || substr(sha256('c'), 1, 8) || ':' || seq || ':' || run_id || ':x' AS observation_id, regexp_replace(substr(payload, 1, 40), '[^A-Za-z0-9_-]+', '_', 'g') AS safe FROM chain")
def _(spark, sf):
    c = A.chain(spark, sf)
    return c.select("run_id", "seq", C.observation_id(F.lit("c"), F.col("seq"), F.col("run_id"), F.lit("x")).alias("observation_id"), C.safe_name(F.substring("payload", 1, 40)).alias("safe"))


@query("time_and_json", A.SAMPLES, "SELECT id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') AS utc, '{\"id\":' || id || ',\"kind\":\"' || kind || '\"}' AS json FROM samples")
def _(spark, sf):
    s = A.samples(spark, sf)
    return s.select("id", C.utc_text(F.col("us")).alias("utc"), C.canonical_json(kind=F.col("kind"), id=F.col("id")).alias("json"))


@query("geometry_tests", A.POINTS, "SELECT point_id, x BETWEEN -0.19 AND 0.19 AND y BETWEEN -0.19 AND 0.19 AND z BETWEEN -0.19 AND 0.19 AS inside, round(sqrt(pow(greatest(-0.1 - x, 0, x - 0.1), 2) + pow(greatest(-0.1 - y, 0, y - 0.1), 2) + pow(greatest(-0.1 - z, 0, z - 0.1), 2)), 6) AS gap, round(sqrt(pow(x - greatest(least(x, 0.2), 0), 2) + y * y + z * z), 6) AS segment_gap FROM points")
def _(spark, sf):
    p = [F.col(a) for a in "xyz"]
    low, high = [F.lit(-0.1)] * 3, [F.lit(0.1)] * 3
    seg = C.segment_point_gap([F.lit(0.0)] * 3, [F.lit(0.2), F.lit(0.0), F.lit(0.0)], p)
    return A.points(spark, sf).select("point_id", C.in_box(p, [-0.2] * 3, [0.2] * 3, 0.01).alias("inside"), F.round(C.sphere_box_gap(p, low, high), 6).alias("gap"), F.round(seg, 6).alias("segment_gap"))


@query("vector_functions", A.POINTS, "SELECT point_id, round(x * 1 + y * 2 + z * 3, 6) AS dot, round(y * 3 - z * 2, 6) + 0.0 AS cross_x, round(sqrt(x * x + y * y + z * z), 6) AS norm, round(greatest(abs(x), abs(y), abs(z)), 6) AS max_abs, round(abs(x) + abs(y) + abs(z), 6) AS l1 FROM points")
def _(spark, sf):
    p, q = [F.col(a) for a in "xyz"], [F.lit(1.0), F.lit(2.0), F.lit(3.0)]
    return A.points(spark, sf).select("point_id", F.round(C.dot(p, q), 6).alias("dot"), (F.round(C.cross(p, q)[0], 6) + 0.0).alias("cross_x"), F.round(C.norm(p), 6).alias("norm"), F.round(C.max_abs(p), 6).alias("max_abs"), F.round(C.l1(p), 6).alias("l1"))


@query("duplicate_pose_suppress")
def _(spark, sf):
    v = A.views(spark, sf).withColumn("score", F.col("view_id") % 17 / 17)
    near = J.pose_pairs(v, "session_id", "view_id").filter("translation <= 0.3 AND rotation_deg <= 100")
    return L.duplicate_pose_suppress(v, near, "session_id", "view_id")
