"""Queries on voxel maps, coverage and surfaces, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from scanspark.operators import maps as M
from scanspark.operators import pixels as P
from scanspark.plans import adapters as A
from scanspark.plans.adapters import sql
from scanspark.plans.pixel_queries import r6

Q: dict = {}
SQL: dict[str, str] = {}
HIT = """hit AS (SELECT map_id, CAST(floor(x / 4) AS BIGINT) AS ix, CAST(floor(y / 4) AS BIGINT) AS iy, CAST(floor(z / 4) AS BIGINT) AS iz, seq FROM points_big),
occupied AS (SELECT map_id, ix, iy, iz, min(seq) AS first_seq FROM hit WHERE ix BETWEEN 0 AND 11 AND iy BETWEEN 0 AND 19 AND iz BETWEEN 0 AND 3 GROUP BY 1, 2, 3, 4),
crossed AS (SELECT map_id, ix - 1 AS ix, iy, iz, seq FROM hit)"""
VOTES = """votes AS (SELECT map_id, ix, iy, iz, count(*) AS free_votes FROM (SELECT DISTINCT * FROM crossed) h LEFT JOIN occupied o USING (map_id, ix, iy, iz) WHERE first_seq IS NULL OR h.seq < first_seq GROUP BY 1, 2, 3, 4)"""
STATE = """state AS (SELECT map_id, ix, iy, iz, coalesce(free_votes, 0) AS free_votes, CASE WHEN first_seq IS NOT NULL THEN 'OCCUPIED' WHEN free_votes >= 3 THEN 'FREE' ELSE 'UNKNOWN' END AS state
FROM votes FULL JOIN occupied USING (map_id, ix, iy, iz))"""


def query(name: str, *parts: str):
    def add(f):
        Q[name] = f
        if parts:
            SQL[name] = sql(*parts)
        return f

    return add


def occupied(spark, sf):
    return M.occupied_voxels(A.points_big(spark, sf), 4.0, (12, 20, 4))


def crossings(spark, sf):
    """The voxel before each point's own, along x."""
    return A.points_big(spark, sf).select("map_id", "seq", *((F.floor(F.col(a) / 4).cast("long") - int(a == "x")).alias(f"i{a}") for a in "xyz"))


def states(spark, sf):
    o = occupied(spark, sf)
    return M.occupancy_state(M.free_votes(crossings(spark, sf), o), o)


@query("occupied_voxels", A.POINTS_BIG, HIT, "SELECT * FROM occupied")
def _(spark, sf):
    return occupied(spark, sf)


@query("free_votes", A.POINTS_BIG, HIT, VOTES, "SELECT * FROM votes")
def _(spark, sf):
    return M.free_votes(crossings(spark, sf), occupied(spark, sf))


@query("occupancy_state", A.POINTS_BIG, HIT, VOTES, STATE, "SELECT * FROM state")
def _(spark, sf):
    return states(spark, sf)


@query("occupancy_stats", A.POINTS_BIG, HIT, VOTES, STATE, """n AS (SELECT map_id, count(DISTINCT seq) AS n FROM points_big WHERE map_id < 8 GROUP BY 1)""",
"""SELECT map_id, occupied, free, observed, n, 10000 - occupied - free AS unknown, CASE WHEN n >= 10 THEN 'MAP_READY' WHEN n > 0 THEN 'MAPPING' ELSE 'UNMAPPED' END AS lifecycle
FROM (SELECT map_id, count(*) FILTER (WHERE state = 'OCCUPIED') AS occupied, count(*) FILTER (WHERE state = 'FREE') AS free, count(*) AS observed FROM state GROUP BY 1) LEFT JOIN n USING (map_id)""")
def _(spark, sf):
    n = A.points_big(spark, sf).filter("map_id < 8").groupBy("map_id").agg(F.count_distinct("seq").alias("n"))
    return M.occupancy_stats(states(spark, sf), 10_000, n, 10)


@query("voxel_union", A.POINTS_BIG, HIT, "SELECT map_id, ix, iy, iz FROM occupied UNION SELECT map_id, ix, iy, iz FROM crossed WHERE seq = 1")
def _(spark, sf):
    return M.voxel_union(occupied(spark, sf), crossings(spark, sf).filter("seq = 1"))


@query("voxel_except", A.POINTS_BIG, HIT, "SELECT map_id, ix, iy, iz FROM crossed EXCEPT SELECT map_id, ix, iy, iz FROM occupied")
def _(spark, sf):
    return M.voxel_except(crossings(spark, sf), occupied(spark, sf))


@query("id_intersect", "SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 45 INTERSECT SELECT l_partkey FROM lineitem WHERE l_tax > 0.075")
def _(spark, sf):
    t = A.table(spark, sf, "lineitem")
    return t.filter("l_quantity > 45").select(F.col("l_partkey").alias("id")).intersect(t.filter("l_tax > 0.075").select("l_partkey"))


@query("id_set_equal", "a AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_quantity > 47), b AS (SELECT DISTINCT l_partkey AS id FROM lineitem WHERE l_tax > 0.075)", "SELECT id, 'a' AS only_in FROM a WHERE id NOT IN (FROM b) UNION ALL SELECT id, 'b' FROM b WHERE id NOT IN (FROM a)")
def _(spark, sf):
    t = A.table(spark, sf, "lineitem").withColumnRenamed("l_partkey", "id")
    return M.id_set_difference(t.filter("l_quantity > 47"), t.filter("l_tax > 0.075"), "id")


@query("disjoint_check", A.CANDIDATES, "a AS (SELECT plan_id, candidate_id FROM candidates WHERE score > 0.47), b AS (SELECT plan_id, candidate_id FROM candidates WHERE score < 0.48)", "SELECT plan_id, count(b.candidate_id) AS shared, count(b.candidate_id) = 0 AS passed FROM a LEFT JOIN b USING (plan_id, candidate_id) GROUP BY 1")
def _(spark, sf):
    c = A.candidates(spark, sf)
    b = c.filter("score < 0.48").select("plan_id", "candidate_id", F.lit(1).alias("one"))
    j = c.filter("score > 0.47").select("plan_id", "candidate_id").join(b, ["plan_id", "candidate_id"], "left")
    return j.groupBy("plan_id").agg(F.count("one").alias("shared"), (F.count("one") == 0).alias("passed"))


@query("tsdf_integrate", A.POINTS, """s AS (SELECT side, x, y, z, sqrt(x * x + y * y + (z - 1) * (z - 1)) AS len FROM points), r AS (SELECT *, k * 0.05 / 5 AS o FROM s, (SELECT unnest(range(-5, 6))::DOUBLE AS k) WHERE len > 0)""",
"""SELECT side, CAST(floor((x + x / len * o) / 0.03) AS BIGINT) AS ix, CAST(floor((y + y / len * o) / 0.03) AS BIGINT) AS iy, CAST(floor((z + (z - 1) / len * o) / 0.03) AS BIGINT) AS iz,
round(avg(greatest(least(-o / 0.05, 1), -1)), 6) + 0.0 AS d, count(*) AS w FROM r GROUP BY 1, 2, 3, 4""")
def _(spark, sf):
    p = A.points(spark, sf).withColumns({"cx": F.lit(0.0), "cy": F.lit(0.0), "cz": F.lit(1.0)})
    return M.tsdf_integrate(p, 0.03, 0.05, 5).withColumn("d", F.round("d", 6) + 0.0)


@query("mesh_edges", "t AS (SELECT l_suppkey AS mesh_id, l_partkey % 50 AS a, l_partkey % 50 + 1 + l_linenumber % 3 AS b, l_partkey % 50 + 5 + l_orderkey % 3 AS c FROM lineitem)",
"e AS (SELECT mesh_id, least(a, b) AS p, greatest(a, b) AS q FROM t UNION ALL SELECT mesh_id, least(b, c), greatest(b, c) FROM t UNION ALL SELECT mesh_id, least(c, a), greatest(c, a) FROM t)",
"SELECT mesh_id, p, q, count(*) AS n, count(*) = 1 AS boundary FROM e GROUP BY 1, 2, 3")
def _(spark, sf):
    k = F.col("l_partkey") % 50
    t = A.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("mesh_id"), k.alias("a"), (k + 1 + F.col("l_linenumber") % 3).alias("b"), (k + 5 + F.col("l_orderkey") % 3).alias("c"))
    return M.mesh_edges(t)


BINS = """cp AS (SELECT seq AS observation_id, CASE WHEN map_id % 2 = 0 THEN 1 ELSE -1 END AS side, x, y, z FROM points_big),
near AS (SELECT *, x / 50 AS s, y / 100 AS t FROM cp WHERE abs(z - CASE WHEN side = 1 THEN 8 ELSE 0 END) <= 2.5 AND x BETWEEN 0 AND 50 AND y BETWEEN 0 AND 100),
pt AS (SELECT *, CAST(least(greatest(floor(t * 4), 0), 3) AS INTEGER) AS row, CAST(least(greatest(floor(s * 5), 0), 4) AS INTEGER) AS col FROM near),
bins AS (SELECT observation_id, side, row, col, CAST(least(greatest(floor((t * 4 - row) * 8), 0), 7) AS INTEGER) AS by, CAST(least(greatest(floor((s * 5 - col) * 8), 0), 7) AS INTEGER) AS bx, count(*) AS n FROM pt GROUP BY ALL)"""


def bins(spark, sf):
    p = A.points_big(spark, sf).withColumnRenamed("seq", "observation_id").withColumn("side", F.when(F.col("map_id") % 2 == 0, 1).otherwise(-1))
    return M.coverage_bins(p, (0.0, 0.0, 0.0), (50.0, 100.0, 8.0), 4, 5, 8, 2.5)


LEDGER = 'ledger AS (SELECT side, row, col, "by", bx, CAST(sum(n) AS BIGINT) AS n FROM bins WHERE observation_id <> 3 GROUP BY ALL)'


def ledger(spark, sf):
    b = bins(spark, sf)
    first = b.filter("observation_id < 3").groupBy(*M.BIN).agg(F.sum("n").alias("n"))
    return M.coverage_update(first, b, b.filter("observation_id <= 3"))


@query("coverage_bins", A.POINTS_BIG, BINS, "SELECT * FROM bins")
def _(spark, sf):
    return bins(spark, sf)


@query("coverage_update", A.POINTS_BIG, BINS, LEDGER, "SELECT * FROM ledger")
def _(spark, sf):
    return ledger(spark, sf)


@query("patch_completion", A.POINTS_BIG, BINS, LEDGER, """grid AS (SELECT * FROM (SELECT unnest([-1, 1]) AS side), (SELECT unnest(range(0, 4))::INTEGER AS row), (SELECT unnest(range(0, 5))::INTEGER AS col)),
g AS (SELECT side, row, col, count(*) FILTER (WHERE n >= 8) AS good FROM ledger GROUP BY 1, 2, 3)""", "SELECT side, row, col, coalesce(good, 0) / 64.0::DOUBLE AS completion, coalesce(good, 0) / 64.0::DOUBLE >= 0.6 AS complete FROM grid LEFT JOIN g USING (side, row, col)")
def _(spark, sf):
    return M.patch_completion(ledger(spark, sf), 4, 5, 8, 8, 0.6)


EVIDENCE = """sm AS (SELECT point_id AS sample_id, side, view_id AS patch_id, x, y, z FROM points WHERE point_id % 2 = 0),
ob AS (SELECT point_id, side, point_id % 7 AS seq, 0.5 + (point_id % 50) / 100.0::DOUBLE AS cosine, x, y, z FROM points WHERE point_id % 2 = 1),
d AS (SELECT sample_id, sm.side, point_id, seq, cosine, (ob.x - sm.x) * (ob.x - sm.x) + (ob.y - sm.y) * (ob.y - sm.y) + (ob.z - sm.z) * (ob.z - sm.z) AS d2 FROM sm JOIN ob ON sm.side = ob.side),
b AS (SELECT sample_id, sqrt(min(d2)) AS distance, min_by(cosine, struct_pack(d2 := d2, s := seq, p := point_id)) AS cosine FROM d WHERE d2 <= 0.01 GROUP BY 1),
evidence AS (SELECT sample_id, patch_id, distance, cosine FROM sm LEFT JOIN b USING (sample_id))"""


def evidence(spark, sf):
    p = A.points(spark, sf)
    sm = p.filter("point_id % 2 = 0").select(F.col("point_id").alias("sample_id"), "side", F.col("view_id").alias("patch_id"), *"xyz")
    ob = p.filter("point_id % 2 = 1").select("point_id", "side", (F.col("point_id") % 7).alias("seq"), (0.5 + (F.col("point_id") % 50) / 100).alias("cosine"), *"xyz")
    return M.surface_evidence(sm, ob, 0.1)


QUALITY = """quality AS (SELECT patch_id, n_samples, n_seen, rmse, mean_cosine, n_seen / n_samples AS coverage, concat_ws(',', CASE WHEN n_seen >= least(10, n_samples) THEN NULL ELSE 'points' END, CASE WHEN n_seen / n_samples >= 0.6 THEN NULL ELSE 'coverage' END,
  CASE WHEN rmse <= 0.055 THEN NULL ELSE 'rmse' END, CASE WHEN mean_cosine >= 0.7 THEN NULL ELSE 'cosine' END) AS reasons
  FROM (SELECT patch_id, count(*) AS n_samples, count(*) FILTER (WHERE distance <= 0.08) AS n_seen, sqrt(avg(distance * distance) FILTER (WHERE distance <= 0.08)) AS rmse, avg(cosine) FILTER (WHERE distance <= 0.08) AS mean_cosine FROM evidence GROUP BY 1))"""


def quality(spark, sf):
    return M.surface_quality(evidence(spark, sf), 0.08, 0.6, 0.7, 10, 0.055)


@query("surface_evidence", A.POINTS, EVIDENCE, "SELECT sample_id, patch_id, round(distance, 6) AS distance, round(cosine, 6) AS cosine FROM evidence")
def _(spark, sf):
    return evidence(spark, sf).select("sample_id", "patch_id", *r6("distance", "cosine"))


@query("surface_quality", A.POINTS, EVIDENCE, QUALITY, "SELECT patch_id, n_samples, n_seen, round(coverage, 6) AS coverage, round(rmse, 6) AS rmse, round(mean_cosine, 6) AS mean_cosine, reasons = '' AS passed, reasons FROM quality")
def _(spark, sf):
    return quality(spark, sf).select("patch_id", "n_samples", F.col("n_seen").cast("long"), *r6("coverage", "rmse", "mean_cosine"), "passed", "reasons")


@query("region_completion", A.POINTS, EVIDENCE, QUALITY, "SELECT CASE WHEN grouping(patch_id % 3) = 1 THEN 'all' ELSE CAST(patch_id % 3 AS VARCHAR) END AS region, round(avg(CASE WHEN reasons = '' THEN 1.0::DOUBLE ELSE 0 END), 6) AS completion FROM quality GROUP BY ROLLUP (patch_id % 3)")
def _(spark, sf):
    q = quality(spark, sf).withColumn("r", (F.col("patch_id") % 3).cast("string"))
    return q.rollup("r").agg(F.round(F.avg(F.col("passed").cast("double")), 6).alias("completion")).select(F.coalesce("r", F.lit("all")).alias("region"), "completion")


@query("weighted_coverage", A.POINTS, EVIDENCE, QUALITY, "SELECT patch_id % 2 AS side, patch_id >= 6 AS fin, round(coalesce(sum(coverage * n_samples) / nullif(sum(n_samples), 0), 0), 6) AS coverage FROM quality GROUP BY CUBE (patch_id % 2, patch_id >= 6)")
def _(spark, sf):
    q = quality(spark, sf).select((F.col("patch_id") % 2).alias("side"), (F.col("patch_id") >= 6).alias("fin"), "coverage", "n_samples")
    share = F.coalesce(F.try_divide(F.sum(F.col("coverage") * F.col("n_samples")), F.sum("n_samples")), F.lit(0.0))
    return q.cube("side", "fin").agg(F.round(share, 6).alias("coverage"))


@query("region_labels", A.POINTS, "SELECT point_id, CASE WHEN s <= 0.1 THEN 'root' WHEN s >= 0.9 THEN 'tip' WHEN t <= 0.1 THEN 'leading' WHEN t >= 0.9 THEN 'trailing' ELSE 'main' END AS region FROM (SELECT point_id, x + 0.5 AS s, y + 0.5 AS t FROM points)")
def _(spark, sf):
    s, t = F.col("x") + 0.5, F.col("y") + 0.5
    label = F.when(s <= 0.1, "root").when(s >= 0.9, "tip").when(t <= 0.1, "leading").when(t >= 0.9, "trailing").otherwise("main")
    return A.points(spark, sf).select("point_id", label.alias("region"))


@query("camera_side", A.VIEWS, "SELECT view_id, CASE WHEN tz > 0 THEN 1 ELSE -1 END AS side, abs(tz) >= 0.5 AND tx <> 0 AS accepted FROM views")
def _(spark, sf):
    return A.views(spark, sf).select("view_id", F.when(F.col("tz") > 0, 1).otherwise(-1).alias("side"), ((F.abs("tz") >= 0.5) & (F.col("tx") != 0)).alias("accepted"))


@query("view_incidence", A.VIEWS, "SELECT view_id, round(degrees(acos(greatest(least(-(r02 * tx + r12 * ty + r22 * tz) / nullif(sqrt(tx * tx + ty * ty + tz * tz), 0), 1), -1))), 6) AS incidence_deg FROM views")
def _(spark, sf):
    from scanspark.functions import columns as C

    r, t = C.pose()
    axis = [row[2] for row in r]
    return A.views(spark, sf).select("view_id", F.round(C.angle_deg(-F.try_divide(C.dot(axis, t), C.norm(t))), 6).alias("incidence_deg"))


@query("side_thickness", A.POINTS, "SELECT view_id, round(abs(a - b), 6) AS thickness, abs(a - b) > 0.01 AS passed FROM (SELECT view_id // 2 AS view_id, quantile_cont(z, 0.5) FILTER (WHERE side = 0) AS a, quantile_cont(z, 0.5) FILTER (WHERE side = 1) AS b FROM points GROUP BY 1)")
def _(spark, sf):
    z = lambda s: F.percentile(F.when(F.col("side") == s, F.col("z")), 0.5)
    g = A.points(spark, sf).groupBy(F.floor(F.col("view_id") / 2).cast("int").alias("view_id")).agg(F.abs(z(0) - z(1)).alias("t"))
    return g.select("view_id", F.round("t", 6).alias("thickness"), (F.col("t") > 0.01).alias("passed"))


@query("dominant_normal", A.POINTS, """n AS (SELECT view_id, x / l AS a, y / l AS b, z / l AS c FROM (SELECT *, sqrt(x * x + y * y + z * z) AS l FROM points) WHERE l > 0),
k AS (SELECT *, CAST(floor(degrees(atan2(b, a)) / 30) AS BIGINT) AS az, CAST(floor(degrees(asin(greatest(least(c, 1), -1))) / 30) AS BIGINT) AS el FROM n),
g AS (SELECT view_id, az, el, count(*) AS n, avg(a) AS a, avg(b) AS b, avg(c) AS c FROM k GROUP BY 1, 2, 3)""",
"SELECT view_id, az, el, n, round(a, 6) AS nx, round(b, 6) AS ny, round(c, 6) AS nz FROM (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY n DESC, az, el) AS r FROM g) WHERE r = 1")
def _(spark, sf):
    from pyspark.sql import Window

    from scanspark.functions import columns as C

    a, b, c = C.normalised([F.col(x) for x in "xyz"])
    n = A.points(spark, sf).select("view_id", a.alias("a"), b.alias("b"), c.alias("c")).filter("a IS NOT NULL")
    az, el = F.floor(F.degrees(F.atan2("b", "a")) / 30), F.floor(F.degrees(F.asin(C.clip(F.col("c"), -1.0, 1.0))) / 30)
    g = n.groupBy("view_id", az.alias("az"), el.alias("el")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(x).alias(x) for x in "abc"))
    r = F.row_number().over(Window.partitionBy("view_id").orderBy(F.desc("n"), "az", "el"))
    return g.withColumn("r", r).filter("r = 1").select("view_id", "az", "el", "n", F.round("a", 6).alias("nx"), F.round("b", 6).alias("ny"), F.round("c", 6).alias("nz"))


@query("curvature_p90", A.POINTS, "SELECT view_id, round(quantile_cont(degrees(acos(greatest(least(z / sqrt(x * x + y * y + z * z), 1), -1))), 0.9), 6) AS curvature_deg FROM points GROUP BY 1")
def _(spark, sf):
    from scanspark.functions import columns as C

    p = [F.col(x) for x in "xyz"]
    return A.points(spark, sf).groupBy("view_id").agg(F.round(F.percentile(C.angle_deg(F.try_divide(p[2], C.norm(p))), 0.9), 6).alias("curvature_deg"))


@query("mask_precision_recall", A.MASKS, "SELECT tp, fp, fn, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM (SELECT count(*) FILTER (WHERE predicted AND truth) AS tp, count(*) FILTER (WHERE predicted AND NOT truth) AS fp, count(*) FILTER (WHERE NOT predicted AND truth) AS fn FROM masks)")
def _(spark, sf):
    m = A.masks(spark, sf)
    predicted, truth = m.filter("predicted").select("doc_id", F.lit(True).alias("p")), m.filter("truth").select("doc_id", F.lit(True).alias("t"))
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    j = predicted.join(truth, "doc_id", "full").agg(n(F.col("p") & F.col("t")).alias("tp"), n(F.col("p") & F.col("t").isNull()).alias("fp"), n(F.col("t") & F.col("p").isNull()).alias("fn"))
    return j.select("*", F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide(F.col("tp"), F.col("tp") + F.col("fn")), 6).alias("recall"))
