"""Queries on errors, telemetry, lineage and timing, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scanspark.operators import metrics as M
from scanspark.operators import pixels as P
from scanspark.plans import adapters as A
from scanspark.plans import map_queries
from scanspark.plans.adapters import sql
from scanspark.plans.map_queries import HIT, STATE, VOTES
from scanspark.plans.pixel_queries import NATIVE, STEREO, native, r6, stereo

Q: dict = {}
SQL: dict[str, str] = {}
ERRORS = """errors AS (SELECT view_id, CASE WHEN view_id % 2 = 0 THEN 'front' ELSE 'back' END AS side, view_id % 19 * 5.0::DOUBLE AS incidence_deg, v, u, CAST(n.depth_m AS DOUBLE) - s.depth_m AS err
FROM native n JOIN stereo s USING (view_id, v, u) WHERE n.depth_m IS NOT NULL)"""
EVENT_GAPS = """g AS (SELECT *, us - lag(us) OVER w AS h, ctrl_us - lag(ctrl_us) OVER w AS c, (us - first_value(us) OVER w) - (ctrl_us - first_value(ctrl_us) OVER w) AS lag FROM samples WINDOW w AS (PARTITION BY trace_id ORDER BY us, id))"""


def query(name: str, *parts: str):
    def add(f):
        Q[name] = f
        if parts:
            SQL[name] = sql(*parts)
        return f

    return add


def errors(spark, sf):
    n = native(spark, sf).filter("depth_m IS NOT NULL").select(*P.PIXEL, F.col("depth_m").cast("double").alias("n"))
    j = n.join(stereo(spark, sf), P.PIXEL)
    k = F.col("view_id")
    return j.select("view_id", F.when(k % 2 == 0, "front").otherwise("back").alias("side"), (k % 19 * 5.0).alias("incidence_deg"), "v", "u", (F.col("n") - F.col("depth_m")).alias("err"))


METRICS = "count(*) AS n, round(avg(err), 6) AS mean, round(quantile_cont(err, 0.5), 6) AS median, round(avg(abs(err)), 6) AS mae, round(sqrt(avg(err * err)), 6) AS rmse, round(quantile_cont(abs(err), 0.95), 6) AS p95"


@query("depth_metrics", A.PIXELS, NATIVE, STEREO, ERRORS, f"SELECT view_id, {METRICS}, round(avg(CASE WHEN abs(err) <= 0.0105 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_0, round(avg(CASE WHEN abs(err) <= 0.0205 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_1 FROM errors GROUP BY 1")
def _(spark, sf):
    return M.depth_metrics(errors(spark, sf), (0.0105, 0.0205), "view_id").select("view_id", "n", *r6("mean", "median", "mae", "rmse", "p95", "within_0", "within_1"))


@query("depth_strata", A.PIXELS, NATIVE, STEREO, ERRORS, """c AS (SELECT *, CASE WHEN incidence_deg < 15 THEN 'incidence:[0,15]deg' WHEN incidence_deg < 30 THEN 'incidence:[15,30]deg' WHEN incidence_deg <= 90 THEN 'incidence:[30,90]deg' END AS b FROM errors),
s AS (SELECT view_id, err, 'all' AS stratum FROM c UNION ALL SELECT view_id, err, 'side:' || side FROM c UNION ALL SELECT view_id, err, b FROM c WHERE b IS NOT NULL),
w AS (SELECT stratum, view_id, avg(abs(err)) AS m FROM s GROUP BY 1, 2), vm AS (SELECT stratum, count(*) AS views, avg(m) AS view_mae FROM w GROUP BY 1)""",
"SELECT stratum, any_value(views) AS views, count(*) AS pixels, round(avg(err), 6) AS mean, round(avg(abs(err)), 6) AS mae, round(sqrt(avg(err * err)), 6) AS rmse, round(any_value(view_mae), 6) AS view_mae FROM s JOIN vm USING (stratum) GROUP BY 1")
def _(spark, sf):
    return M.depth_strata(errors(spark, sf), (0, 15, 30, 90)).select("stratum", "views", "pixels", *r6("mean", "mae", "rmse", "view_mae"))


@query("agreement_curve", A.PIXELS, NATIVE, STEREO, ERRORS, "SELECT side, threshold, round(avg(CASE WHEN abs(err) <= threshold THEN 1.0::DOUBLE ELSE 0 END), 6) AS fraction FROM errors, (SELECT unnest([0.0055, 0.0105, 0.0205, 0.0505])::DOUBLE AS threshold) GROUP BY 1, 2")
def _(spark, sf):
    return M.agreement_curve(errors(spark, sf), (0.0055, 0.0105, 0.0205, 0.0505), "side").select("side", "threshold", *r6("fraction"))


@query("overlap_metrics", A.PIXELS, NATIVE, STEREO, ERRORS, f"""m AS (SELECT view_id % 10 AS pair_id, {METRICS}, round(avg(CASE WHEN abs(err) <= 0.0205 THEN 1.0::DOUBLE ELSE 0 END), 6) AS inlier_fraction FROM errors GROUP BY 1)""",
"SELECT pair_id, n, inlier_fraction, mean, median, mae, rmse, p95, reasons = '' AS passed, reasons FROM (SELECT *, concat_ws(',', CASE WHEN n < 3700 THEN 'n' END, CASE WHEN inlier_fraction < 0.6555 THEN 'inlier_fraction' END, CASE WHEN rmse > 0.0202 THEN 'rmse' END) AS reasons FROM m)")
def _(spark, sf):
    m = M.depth_metrics(errors(spark, sf).withColumn("pair_id", F.col("view_id") % 10), (0.0205,), "pair_id").withColumnRenamed("within_0", "inlier_fraction")
    m = m.select("pair_id", "n", *r6("inlier_fraction", "mean", "median", "mae", "rmse", "p95"))
    return M.gate(m, {"n": (3700, None), "inlier_fraction": (0.6555, None), "rmse": (None, 0.0202)})


@query("symmetric_overlap", A.PIXELS, NATIVE, STEREO, ERRORS, "SELECT view_id, 'forward' AS direction, count(*) AS n, round(sum(err), 5) AS total FROM errors GROUP BY 1 UNION ALL SELECT view_id, 'reverse', count(*), round(sum(-err), 5) FROM errors WHERE u % 2 = 0 GROUP BY 1")
def _(spark, sf):
    e = errors(spark, sf)
    both = e.withColumn("direction", F.lit("forward")).unionByName(e.filter("u % 2 = 0").withColumns({"err": -F.col("err"), "direction": F.lit("reverse")}))
    return both.groupBy("view_id", "direction").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("err"), 5).alias("total"))


@query("gate", A.CANDIDATES, "SELECT candidate_id, reasons = '' AS passed, reasons FROM (SELECT candidate_id, concat_ws(',', CASE WHEN score < 0.5 THEN 'score' END, CASE WHEN distance < 0.1 OR distance > 0.4 THEN 'distance' END, CASE WHEN tilt > 45 THEN 'tilt' END) AS reasons FROM candidates)")
def _(spark, sf):
    return M.gate(A.candidates(spark, sf), {"score": (0.5, None), "distance": (0.1, 0.4), "tilt": (None, 45)}).select("candidate_id", "passed", "reasons")


@query("settled_capture_gate", A.SAMPLES, "b AS (SELECT trace_id, id, us - lag(us) OVER w AS bracket_us, abs(value - lag(value) OVER w) AS delta FROM samples WINDOW w AS (PARTITION BY trace_id ORDER BY us, id))",
"SELECT id, concat_ws(',', CASE WHEN coalesce(bracket_us <= 7200000000, false) THEN NULL ELSE 'bracket_us' END, CASE WHEN coalesce(delta <= 10.0, false) THEN NULL ELSE 'delta' END) AS reasons FROM b")
def _(spark, sf):
    w = Window.partitionBy("trace_id").orderBy("us", "id")
    b = A.samples(spark, sf).select("id", (F.col("us") - F.lag("us").over(w)).alias("bracket_us"), F.abs(F.col("value") - F.lag("value").over(w)).alias("delta"))
    return M.gate(b, {"bracket_us": (None, 7_200_000_000), "delta": (None, 10.0)}).select("id", "reasons")


@query("sample_gaps", A.SAMPLES, EVENT_GAPS, "SELECT id, greatest(h, c) AS gap, lag AS lag_us, coalesce(greatest(h, c) > 36000000000, false) AS stale FROM g")
def _(spark, sf):
    return M.sample_gaps(A.samples(spark, sf), 36_000_000_000).select("id", "gap", "lag_us", "stale")


@query("frozen_runs", A.SAMPLES, EVENT_GAPS, "r AS (SELECT *, sum(CASE WHEN c = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY trace_id ORDER BY us, id) AS run FROM g)", "SELECT trace_id, CAST(run AS BIGINT) AS run, min(us) AS start_us, max(us) - min(us) AS length_us, count(*) AS n, max(us) - min(us) > 1800000000 AS frozen FROM r GROUP BY 1, 2")
def _(spark, sf):
    return M.frozen_runs(A.samples(spark, sf), 1_800_000_000)


@query("stream_gap_stats", A.SAMPLES, EVENT_GAPS, "SELECT trace_id, count(*) AS packets, max(h) AS host_gap, max(c) AS ctrl_gap, max(lag) AS most_lag, max_by(lag, us) AS last_lag FROM g GROUP BY 1")
def _(spark, sf):
    return M.stream_gap_stats(A.samples(spark, sf))


@query("tick_summary", A.SAMPLES, "r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY value) AS r, count(*) OVER (PARTITION BY trace_id) AS c FROM samples)",
"SELECT trace_id, count(*) AS n, round(avg(value), 9) AS mean, max(value) AS most, round(avg(greatest(0, value - 50)), 9) AS mean_overrun, round(max(greatest(0, value - 50)), 9) AS most_overrun, max(value) FILTER (WHERE r = ceil(c * 0.95)) AS p95 FROM r GROUP BY 1")
def _(spark, sf):
    return M.tick_summary(A.samples(spark, sf), 50.0, "trace_id").select("trace_id", "n", "most", "p95", *(F.round(c, 9).alias(c) for c in ("mean", "mean_overrun", "most_overrun")))


@query("tracking_deviation", A.SAMPLES, "j AS (SELECT trace_id, CAST(j AS INTEGER) AS joint, value * (j + 1) / 10 AS command, value * (j + 1) / 10 + id * (j + 3) % 7 * 0.01::DOUBLE - 0.03::DOUBLE AS actual FROM samples, (SELECT unnest(range(0, 6)) AS j))", "SELECT trace_id, joint, count(*) AS n, round(max(abs(command - actual)), 6) AS deviation FROM j GROUP BY 1, 2")
def _(spark, sf):
    from scanspark.operators.reports import tracking_deviation

    command = [F.col("value") * (j + 1) / 10 for j in range(6)]
    actual = [c + F.col("id") * (j + 3) % 7 * 0.01 - 0.03 for j, c in enumerate(command)]
    s = A.samples(spark, sf).select("trace_id", F.array(*command).alias("command"), F.array(*actual).alias("actual"))
    return tracking_deviation(s, "trace_id").select("trace_id", "joint", "n", *r6("deviation"))


@query("monotonic_check", A.CHAIN, "SELECT run_id, count(*) AS n, min(seq) = 0 AND max(seq) = count(*) - 1 AND count(DISTINCT seq) = count(*) AS contiguous FROM (SELECT * FROM chain WHERE NOT (run_id % 5 = 0 AND seq = 1)) GROUP BY 1")
def _(spark, sf):
    return M.monotonic_check(A.chain(spark, sf).filter("NOT (run_id % 5 = 0 AND seq = 1)"), "run_id", "seq").drop("ordered")


HASHES = "h AS (SELECT *, sha256(run_id || chr(10) || seq || chr(10) || payload) AS sha FROM chain), l AS (SELECT *, CASE WHEN run_id % 7 = 0 AND seq = 1 THEN 'x' ELSE lag(sha) OVER (PARTITION BY run_id ORDER BY seq) END AS prev_sha FROM h)"


@query("hash_chain_check", A.CHAIN, HASHES, "SELECT run_id, seq, sha, CASE WHEN row_number() OVER w = 1 THEN prev_sha IS NULL AND seq = 0 ELSE prev_sha IS NOT DISTINCT FROM lag(sha) OVER w END AS intact FROM l WINDOW w AS (PARTITION BY run_id ORDER BY seq)")
def _(spark, sf):
    h = M.chain_hashes(A.chain(spark, sf))
    prev = F.lag("sha").over(Window.partitionBy("run_id").orderBy("seq"))
    h = h.withColumn("prev_sha", F.when((F.col("run_id") % 7 == 0) & (F.col("seq") == 1), "x").otherwise(prev))
    return M.hash_chain_check(h).select("run_id", "seq", "sha", "intact")


@query("latest_generation", A.CHAIN, "SELECT run_id, max(seq) AS seq, max_by(sha256(payload), seq) AS sha FROM chain GROUP BY 1")
def _(spark, sf):
    return A.chain(spark, sf).groupBy("run_id").agg(F.max("seq").alias("seq"), F.max_by(F.sha2("payload", 256), "seq").alias("sha"))


@query("event_cursor", A.CHAIN, "SELECT run_id, seq, length(payload) AS n FROM chain WHERE seq >= 1")
def _(spark, sf):
    from scanspark.sources.logs import event_suffix

    return event_suffix(A.chain(spark, sf), 1).select("run_id", "seq", F.length("payload").cast("long").alias("n"))


@query("table_hash")
def _(spark, sf):
    return M.table_hash(A.chain(spark, sf), "run_id")


@query("rolling_source_window", A.SAMPLES, "g AS (SELECT *, sum(CASE WHEN us - l > 20000000000 THEN 1 ELSE 0 END) OVER (PARTITION BY trace_id ORDER BY us) AS i FROM (SELECT *, lag(us) OVER (PARTITION BY trace_id ORDER BY us) AS l FROM samples)), k AS (SELECT *, max(i) OVER (PARTITION BY trace_id) AS m FROM g)",
"SELECT trace_id, id FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY us DESC) AS b FROM k WHERE i = m) WHERE b <= 5")
def _(spark, sf):
    return M.rolling_source_window(A.samples(spark, sf), "trace_id", "us", "us", 20_000_000_000, 5).select("trace_id", "id")


@query("x_run_merge", A.POINTS_BIG, HIT, VOTES, STATE, "r AS (SELECT *, ix - row_number() OVER (PARTITION BY map_id, iy, iz, state ORDER BY ix) AS i FROM state WHERE state <> 'FREE')", "SELECT map_id, iy, iz, state, min(ix) AS x0, max(ix) AS x1 FROM r GROUP BY map_id, iy, iz, state, i")
def _(spark, sf):
    return M.x_runs(map_queries.states(spark, sf))


@query("even_subsample", A.SAMPLES, "r AS (SELECT trace_id, id, row_number() OVER (PARTITION BY trace_id ORDER BY us) - 1 AS r, count(*) OVER (PARTITION BY trace_id) AS n FROM samples), k AS (SELECT unnest(range(0, 20)) AS k)", "SELECT DISTINCT trace_id, id FROM r, k WHERE n <= 20 OR r = k * (n - 1) // 19")
def _(spark, sf):
    return M.even_subsample(A.samples(spark, sf), "trace_id", "us", 20).select("trace_id", "id")


@query("voxel_representative", A.POINTS, "c AS (SELECT *, CAST(floor(x / 0.1) AS BIGINT) AS ix, CAST(floor(y / 0.1) AS BIGINT) AS iy, CAST(floor(z / 0.1) AS BIGINT) AS iz FROM points)",
"SELECT view_id, ix, iy, iz, min_by(point_id, struct_pack(g := round(pow(x - (ix + 0.5) * 0.1, 2) + pow(y - (iy + 0.5) * 0.1, 2) + pow(z - (iz + 0.5) * 0.1, 2), 9), i := point_id)) AS point_id FROM c GROUP BY 1, 2, 3, 4")
def _(spark, sf):
    return M.voxel_representative(A.points(spark, sf), 0.1, ["view_id"], "point_id")


def spans(spark, sf):
    t = A.table(spark, sf, "lineitem")
    return t.select(F.concat(F.lit("span_"), (F.col("l_suppkey") % 12).cast("string")).alias("name"), F.col("l_orderkey").alias("span_id"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("wall"), F.round(F.col("l_quantity") * 100).cast("long").alias("cpu"))


SPANS = "spans AS (SELECT 'span_' || (l_suppkey % 12) AS name, l_orderkey AS span_id, CAST(round(l_extendedprice * 100) AS BIGINT) AS wall, CAST(round(l_quantity * 100) AS BIGINT) AS cpu FROM lineitem)"
SUMMARY = """long AS (SELECT name, 'wall' AS series, wall AS value FROM spans UNION ALL SELECT name, 'cpu', cpu FROM spans),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name, series ORDER BY value) AS r, count(*) OVER (PARTITION BY name, series) AS c FROM long),
summary AS (SELECT name, series, count(*) AS n, CAST(floor(quantile_cont(value, 0.5)) AS BIGINT) AS p50, max(value) FILTER (WHERE r = ceil(c * 0.95)) AS p95 FROM ranked GROUP BY 1, 2)"""


@query("trial_summary", SPANS, SUMMARY, "SELECT * FROM summary")
def _(spark, sf):
    return M.trial_summary(spans(spark, sf), ["name"], ["wall", "cpu"])


@query("hotspot_rank", SPANS, SUMMARY, "SELECT *, CAST(row_number() OVER (PARTITION BY series ORDER BY p50 DESC, name) AS INTEGER) AS rank FROM summary")
def _(spark, sf):
    return M.hotspot_rank(M.trial_summary(spans(spark, sf), ["name"], ["wall", "cpu"]), "name")


@query("span_rollup", SPANS, "c AS (SELECT span_id // 4 AS parent, sum(cpu) AS inner_cpu FROM spans GROUP BY 1), s AS (SELECT name, span_id, sum(wall) AS wall FROM spans GROUP BY 1, 2)",
"SELECT name, count(*) AS n, CAST(sum(wall) AS BIGINT) AS inclusive, CAST(sum(greatest(0, wall - coalesce(inner_cpu, 0))) AS BIGINT) AS exclusive, CAST(max(wall) AS BIGINT) AS most FROM s LEFT JOIN c ON parent = span_id GROUP BY 1")
def _(spark, sf):
    s = spans(spark, sf)
    inner = s.groupBy(F.floor(F.col("span_id") / 4).alias("span_id")).agg(F.sum("cpu").alias("inner"))
    own = s.groupBy("name", "span_id").agg(F.sum("wall").alias("wall")).join(inner, "span_id", "left")
    left = F.greatest(F.lit(0), F.col("wall") - F.coalesce("inner", F.lit(0)))
    return own.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("wall").alias("inclusive"), F.sum(left).alias("exclusive"), F.max("wall").alias("most"))


@query("resource_summary", SPANS, "t AS (SELECT name, span_id % 50 AS trial, max(wall) - min(wall) AS wall, max(cpu) - min(cpu) AS cpu FROM spans GROUP BY 1, 2), long AS (SELECT name, 'wall' AS series, wall AS value FROM t UNION ALL SELECT name, 'cpu', cpu FROM t), ranked AS (SELECT *, row_number() OVER (PARTITION BY name, series ORDER BY value) AS r, count(*) OVER (PARTITION BY name, series) AS c FROM long)",
"SELECT name, series, count(*) AS n, CAST(floor(quantile_cont(value, 0.5)) AS BIGINT) AS p50, max(value) FILTER (WHERE r = ceil(c * 0.95)) AS p95 FROM ranked GROUP BY 1, 2")
def _(spark, sf):
    t = spans(spark, sf).groupBy("name", (F.col("span_id") % 50).alias("trial")).agg(*((F.max(c) - F.min(c)).alias(c) for c in ("wall", "cpu")))
    return M.trial_summary(t, ["name"], ["wall", "cpu"])


@query("trial_pivot", "t AS (SELECT o_custkey AS trial, o_orderpriority AS role, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS d FROM orders GROUP BY 1, 2)",
"SELECT trial, CAST(max(d) FILTER (WHERE role = '1-URGENT') AS BIGINT) AS urgent, CAST(max(d) FILTER (WHERE role = '5-LOW') AS BIGINT) AS low, count(*) = 5 AS complete FROM t GROUP BY 1")
def _(spark, sf):
    t = A.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("trial"), F.col("o_orderpriority").alias("role")).agg(F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("d"))
    wide = t.groupBy("trial").pivot("role", ["1-URGENT", "5-LOW"]).agg(F.max("d")).withColumnsRenamed({"1-URGENT": "urgent", "5-LOW": "low"})
    return wide.join(t.groupBy("trial").agg((F.count(F.lit(1)) == 5).alias("complete")), "trial")


@query("acceptance_metrics", A.PIXELS, NATIVE, STEREO, ERRORS, "m AS (SELECT side, round(avg(abs(err)), 6) AS mae, round(sqrt(avg(err * err)), 6) AS rmse, round(quantile_cont(abs(err), 0.95), 6) AS p95 FROM errors GROUP BY 1)",
"SELECT side, metric, value, value <= CASE metric WHEN 'mae' THEN 0.0165 WHEN 'rmse' THEN 0.0202 ELSE 0.03 END AS passed FROM m UNPIVOT (value FOR metric IN (mae, rmse, p95))")
def _(spark, sf):
    m = M.depth_metrics(errors(spark, sf), (), "side").select("side", *r6("mae", "rmse", "p95")).unpivot("side", ["mae", "rmse", "p95"], "metric", "value")
    limit = F.when(F.col("metric") == "mae", 0.0165).when(F.col("metric") == "rmse", 0.0202).otherwise(0.03)
    return m.withColumn("passed", F.col("value") <= limit)


@query("stereo_validation", A.PIXELS, NATIVE, STEREO, ERRORS, "SELECT CASE WHEN grouping(view_id) = 1 THEN -1 ELSE view_id END AS pair_id, count(*) AS n, round(avg(err), 6) AS mean, round(sqrt(avg(err * err)), 6) AS rmse, round(max(abs(err)), 6) AS most, sqrt(avg(err * err)) <= 0.0202 AS passed FROM errors GROUP BY GROUPING SETS ((view_id), ())")
def _(spark, sf):
    e = errors(spark, sf)
    g = e.rollup("view_id").agg(F.count(F.lit(1)).alias("n"), F.avg("err").alias("mean"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.max(F.abs("err")).alias("most"))
    return g.select(F.coalesce("view_id", F.lit(-1)).cast("long").alias("pair_id"), "n", *r6("mean", "rmse", "most"), (F.col("rmse") <= 0.0202).alias("passed"))


@query("holdout_validation", A.PIXELS, NATIVE, STEREO, ERRORS, "SELECT CASE WHEN grouping(view_id % 10) = 1 THEN -1 ELSE view_id % 10 END AS sample_id, round(sqrt(avg(err * err)), 6) AS rmse, round(quantile_cont(abs(err), 0.95), 6) AS p95 FROM errors WHERE view_id % 3 = 0 GROUP BY GROUPING SETS ((view_id % 10), ())")
def _(spark, sf):
    e = errors(spark, sf).filter("view_id % 3 = 0").withColumn("k", F.col("view_id") % 10)
    g = e.rollup("k").agg(F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.percentile(F.abs("err"), 0.95).alias("p95"))
    return g.select(F.coalesce("k", F.lit(-1)).cast("long").alias("sample_id"), *r6("rmse", "p95"))


@query("registration_rmse", A.PIXELS, NATIVE, STEREO, ERRORS, "r AS (SELECT view_id, view_id % 10 AS blade, count(*) AS n, sqrt(avg(err * err)) AS rmse FROM errors GROUP BY 1)", "SELECT blade, round(sum(rmse * n) FILTER (WHERE rmse <= 0.0205) / nullif(sum(n) FILTER (WHERE rmse <= 0.0205), 0), 6) AS rmse FROM r GROUP BY 1")
def _(spark, sf):
    r = errors(spark, sf).groupBy("view_id").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"))
    ok = F.col("rmse") <= 0.0205
    share = F.try_divide(F.sum(F.when(ok, F.col("rmse") * F.col("n"))), F.sum(F.when(ok, F.col("n"))))
    return r.groupBy((F.col("view_id") % 10).alias("blade")).agg(F.round(share, 6).alias("rmse"))


@query("windowed_tick_stats", "SELECT epoch_us(time_bucket(INTERVAL '6 hours', ts, TIMESTAMP '1970-01-01')) AS start_us, event_type AS kind, count(*) AS n, round(avg(value), 6) AS mean, max(value) AS most FROM events GROUP BY 1, 2")
def _(spark, sf):
    from scanspark.streaming.telemetry import windowed_ticks

    e = A.table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")
    return windowed_ticks(e, "6 hours").select(F.unix_micros("start").alias("start_us"), "kind", "n", *r6("mean"), "most")


@query("pose_span", A.VIEWS, "SELECT session_id, round(max(sqrt(pow(b.tx - a.tx, 2) + pow(b.ty - a.ty, 2) + pow(b.tz - a.tz, 2))), 6) AS translation FROM views a JOIN views b USING (session_id) WHERE a.view_id < b.view_id GROUP BY 1")
def _(spark, sf):
    from scanspark.operators.joins import pose_pairs

    return pose_pairs(A.views(spark, sf), "session_id", "view_id").groupBy("session_id").agg(F.round(F.max("translation"), 6).alias("translation"))


@query("stationary_trace", A.SAMPLES, "SELECT trace_id, count(*) AS n, round(max(value) - min(value), 6) AS span, max(value) - min(value) <= 99.0 AND max(g) <= 80000000000 AS stationary FROM (SELECT *, us - lag(us) OVER (PARTITION BY trace_id ORDER BY us) AS g FROM samples) GROUP BY 1")
def _(spark, sf):
    w = Window.partitionBy("trace_id").orderBy("us")
    s = A.samples(spark, sf).withColumn("g", F.col("us") - F.lag("us").over(w))
    span = F.max("value") - F.min("value")
    return s.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.round(span, 6).alias("span"), ((span <= 99.0) & (F.max("g") <= 80_000_000_000)).alias("stationary"))


@query("stale_maps", A.SAMPLES, "SELECT trace_id, max(us) AS built_us, max(us) < 1704300000000000 - 3600000000 OR max(us) > 1704300000000000 AS stale FROM samples GROUP BY 1")
def _(spark, sf):
    now = 1_704_300_000_000_000
    built = F.max("us")
    return A.samples(spark, sf).groupBy("trace_id").agg(built.alias("built_us"), ((built < now - 3_600_000_000) | (built > now)).alias("stale"))
