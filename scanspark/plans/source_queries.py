"""Queries on sources, sinks and streams: driver tables are written to scratch storage in a source's form and read back through it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanspark.operators import maps as M
from scanspark.operators import pixels as P
from scanspark.operators.metrics import depth_metrics
from scanspark.plans import adapters as A
from scanspark.plans import map_queries as MQ
from scanspark.plans.adapters import sql
from scanspark.plans import metric_queries as MET
from scanspark.plans.pixel_queries import NATIVE, STEREO, native, r6
from scanspark.sources import logs, sessions
from scanspark.sources.scratch import scratch_path, stored
from scanspark.streaming import maps as stream_maps
from scanspark.streaming.occupancy import OccupancyLog

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, *parts: str):
    def add(f):
        Q[name] = f
        if parts:
            SQL[name] = sql(*parts)
        return f

    return add


def run_stream(source: DataFrame, each: Callable[[DataFrame, int], None]) -> None:
    """All there is of a stream, in batches."""
    spark = source.sparkSession
    q = source.writeStream.foreachBatch(each).option("checkpointLocation", scratch_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()


@query("append_views", A.VIEWS, "SELECT view_id, session_id, seq FROM views")
def _(spark, sf):
    v, path = A.views(spark, sf).select("view_id", "session_id", "seq"), scratch_path(spark, "views")
    sessions.append_new(v.filter("seq % 2 = 0"), path, ["session_id", "seq"], "session_id")
    sessions.append_new(v, path, ["session_id", "seq"], "session_id")
    return spark.read.parquet(path)


@query("verify_checksums", A.CHAIN, "SELECT run_id || '/' || seq AS path, run_id % 7 <> 0 AND seq <> 2 AS ok FROM chain")
def _(spark, sf):
    c = A.chain(spark, sf).select(F.concat_ws("/", F.col("run_id").cast("string"), F.col("seq").cast("string")).alias("path"), F.col("payload").cast("binary").alias("content"), "run_id", "seq")
    said = F.sha2(F.when(F.col("run_id") % 7 == 0, F.lit(b"other")).otherwise(F.col("content")), 256)
    return sessions.verify_checksums(c.filter("seq <> 2"), c.select("path", said.alias("sha256")))


@query("tree_hash", A.CHAIN, """f AS (SELECT strlen(payload) AS n, sha256(run_id || '/' || seq || ' ' || sha256(payload)) AS sha FROM chain),
p AS (SELECT left(sha, 3) AS bucket, count(*) AS k, sum(n) AS n, sha256(string_agg(sha, '' ORDER BY sha)) AS h FROM f GROUP BY 1)""",
"SELECT CAST(sum(k) AS BIGINT) AS files, CAST(sum(n) AS BIGINT) AS bytes, sha256(string_agg(bucket || h, '' ORDER BY bucket)) AS sha256 FROM p")
def _(spark, sf):
    c = A.chain(spark, sf).select(F.concat_ws("/", "run_id", "seq").alias("path"), F.col("payload").cast("binary").alias("content"))
    return sessions.tree_hash(c)


@query("flatten_view_metadata", A.VIEWS, "SELECT view_id, seq, tx, ty, tz, round(sqrt(pow(0.001 * (view_id % 3), 2) + pow(0.002, 2)), 9) AS moved_m, view_id % 9 * 1.5::DOUBLE AS bracket_ms FROM views")
def _(spark, sf):
    k = F.col("view_id")
    at = lambda dx, dy: F.struct((F.col("tx") + dx).alias("tx"), (F.col("ty") + dy).alias("ty"), "tz")
    robot = F.struct(at(0.0, 0.0).alias("before"), at(k % 3 * 0.001, 0.002).alias("after"), at(0.0, 0.0).alias("selected"))
    v = A.views(spark, sf).select(F.to_json(F.struct("view_id", "seq", robot.alias("robot"), F.struct((k % 9 * 1.5).alias("bracket_ms"), F.lit(0.0).alias("offset_ms")).alias("sync"))).alias("metadata"))
    return sessions.flatten_view_metadata(v).select("view_id", "seq", "tx", "ty", "tz", F.round("moved_m", 9).alias("moved_m"), "bracket_ms")


@query("snapshot_round_trip", A.POINTS_BIG, MQ.HIT, MQ.VOTES, MQ.STATE, "SELECT map_id, ix, iy, iz, free_votes, state FROM state")
def _(spark, sf):
    rows = stored(MQ.states(spark, sf).withColumnRenamed("map_id", "part"), "map")
    path = scratch_path(spark, "snapshots")
    digest = sessions.write_snapshot(rows, path, 3, 0)
    return sessions.read_snapshot(spark, path, 3, 0, rows.schema, digest).withColumnRenamed("part", "map_id")


@query("ledger_round_trip", A.POINTS_BIG, MQ.BINS, MQ.LEDGER, "SELECT * FROM ledger")
def _(spark, sf):
    path, rows = scratch_path(spark, "ledgers"), stored(MQ.ledger(spark, sf), "ledger")
    sessions.write_ledger(rows.filter("row = 0"), path, "main", 0)
    sessions.write_ledger(rows, path, "main", 1)
    return sessions.read_ledger(spark, path).select(*M.BIN, "n")


@query("clouds_round_trip", A.POINTS, "SELECT side AS session_id, point_id, x, y, z FROM points")
def _(spark, sf):
    path = scratch_path(spark, "clouds")
    sessions.write_clouds(A.points(spark, sf).withColumnRenamed("side", "session_id"), path)
    return sessions.read_clouds(spark, path).select("session_id", "point_id", *"xyz")


@query("export_overlay", A.PIXELS, NATIVE, "SELECT view_id, v, u, round(CAST(depth_m AS DOUBLE), 6) AS depth_m, 'native' AS label FROM native WHERE depth_m IS NOT NULL")
def _(spark, sf):
    path = scratch_path(spark, "overlay")
    n = native(spark, sf).filter("depth_m IS NOT NULL").select(*P.PIXEL, F.col("depth_m").cast("double").alias("depth_m"))
    sessions.export_overlay(n.select(*P.PIXEL, *r6("depth_m")), path, "native")
    return spark.read.schema("view_id long, v int, u long, depth_m double, label string").option("header", True).csv(path)


@query("write_depth_metrics", A.PIXELS, NATIVE, STEREO, MET.ERRORS, "SELECT view_id, count(*) AS n, round(avg(abs(err)), 6) AS mae, count(*) AS pixels, round(sum(err), 5) AS total FROM errors GROUP BY 1")
def _(spark, sf):
    e, path = stored(MET.errors(spark, sf).select("view_id", "v", "u", "err"), "errors"), scratch_path(spark, "depth-metrics")
    m = depth_metrics(e, (), "view_id").select("view_id", "n", *r6("mae"))
    for half in ("view_id % 2 = 0", "true"):
        sessions.write_depth_metrics(e.filter(half), m.filter(half), path)
    kept = spark.read.schema(e.schema).parquet(f"{path}/errors").groupBy("view_id").agg(F.count(F.lit(1)).alias("pixels"), F.round(F.sum("err"), 5).alias("total"))
    return spark.read.schema(m.schema).parquet(f"{path}/metrics").join(kept, "view_id")


@query("export_metrics", A.PIXELS, NATIVE, STEREO, MET.ERRORS, "SELECT view_id, count(*) AS n, round(round(avg(abs(err)), 6) * 1000, 3) AS mae_mm, round(avg(CASE WHEN abs(err) <= 0.0205 THEN 1.0::DOUBLE ELSE 0 END), 6) AS within_0 FROM errors GROUP BY 1")
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    m = depth_metrics(MET.errors(spark, sf), (0.0205,), "view_id").select("view_id", "n", *r6("mae", "within_0"))
    sessions.export_metrics(m, path, {"mae": "mae_mm"}, ["within_0"])
    back = spark.read.schema("view_id long, n long, mae_mm double, within_0 double").option("header", True).csv(path)
    return back.select("view_id", "n", F.round("mae_mm", 3).alias("mae_mm"), "within_0")


@query("map_expiry", A.SAMPLES, """m AS (SELECT trace_id AS map_id, id AS version, us, id % 5 = 0 AS stale FROM samples QUALIFY row_number() OVER (PARTITION BY trace_id ORDER BY id DESC) = 1)""",
"SELECT map_id, version + 1 AS version, 'STALE' AS state FROM m WHERE NOT stale AND (us > 1704300000000000 OR us < 1704300000000000 - 3600000000)")
def _(spark, sf):
    s = A.samples(spark, sf)
    maps = s.select(F.col("trace_id").alias("map_id"), F.col("id").alias("version"), F.when(F.col("id") % 5 == 0, "STALE").otherwise("READY").alias("state"), F.timestamp_micros("us").alias("built"))
    return stream_maps.expired_maps(maps, 3600.0, F.timestamp_micros(F.lit(1_704_300_000_000_000)))


def event_files(spark, sf) -> str:
    path = scratch_path(spark, "events")
    A.chain(spark, sf).select(F.col("run_id").cast("string"), "seq", F.lit("turn").alias("type"), "payload").write.json(path)
    return path


EVENTS = "SELECT CAST(run_id AS VARCHAR) AS run_id, seq, length(payload) AS n FROM chain WHERE seq >= 2"


@query("read_event_log", A.CHAIN, EVENTS)
def _(spark, sf):
    return logs.read_event_log(spark, event_files(spark, sf), 2).select("run_id", "seq", F.length("payload").cast("long").alias("n"))


@query("event_tail", A.CHAIN, EVENTS)
def _(spark, sf):
    out = scratch_path(spark, "tail")
    run_stream(logs.read_event_log(spark, event_files(spark, sf), 2, stream=True), lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    return spark.read.schema(logs.EVENT).parquet(out).select("run_id", "seq", F.length("payload").cast("long").alias("n"))


def as_stream(frame: DataFrame, what: str) -> DataFrame:
    path = scratch_path(frame.sparkSession, what)
    frame.write.parquet(path)
    return frame.sparkSession.readStream.schema(frame.schema).option("maxFilesPerTrigger", 4).parquet(path)


@query("stream_coverage", A.POINTS_BIG, MQ.BINS, 'SELECT side, row, col, "by", bx, CAST(sum(n) AS BIGINT) AS n FROM bins GROUP BY ALL')
def _(spark, sf):
    out = scratch_path(spark, "stream-bins")
    run_stream(as_stream(MQ.bins(spark, sf).repartition("observation_id"), "bins"), stream_maps.append_bins(out))
    return stream_maps.ledger(spark.read.parquet(out))


@query("stream_occupancy", A.POINTS_BIG, MQ.HIT, MQ.VOTES, "SELECT * FROM votes")
def _(spark, sf):
    out = scratch_path(spark, "stream-votes")
    run_stream(as_stream(MQ.crossings(spark, sf).repartition("seq"), "crossings"), stream_maps.append_votes(out))
    return M.free_votes(spark.read.parquet(out), MQ.occupied(spark, sf))


@query("stream_occupancy_window", A.POINTS_BIG, """r AS (SELECT *, dense_rank() OVER (PARTITION BY map_id ORDER BY seq DESC) <= 10 AS kept FROM points_big),
h AS (SELECT DISTINCT map_id, seq, CAST(floor(x / 4) AS BIGINT) AS ix, CAST(floor(y / 4) AS BIGINT) AS iy, CAST(floor(z / 4) AS BIGINT) AS iz FROM r WHERE kept),
f AS (SELECT map_id, seq, ix - 1 AS ix, iy, iz FROM h), o AS (SELECT map_id, ix, iy, iz, min(seq) AS first_seq FROM h GROUP BY ALL),
v AS (SELECT map_id, ix, iy, iz, count(*) FILTER (WHERE first_seq IS NULL OR f.seq < first_seq) AS n FROM f LEFT JOIN o USING (map_id, ix, iy, iz) GROUP BY ALL)""",
"SELECT map_id, ix, iy, iz, coalesce(n, 0) AS free_votes, first_seq FROM v FULL JOIN o USING (map_id, ix, iy, iz)")
def _(spark, sf):
    """A map keeps its last ten sources, and is built anew whenever one of them leaves; a voxel's last point decides before its neighbour's."""
    path = scratch_path(spark, "sources")
    hits = A.points_big(spark, sf).select("map_id", "seq", *(F.floor(F.col(a) / 4).cast("long").alias(f"i{a}") for a in "xyz"), F.lit(True).alias("hit"))
    rows = stored(hits.unionByName(hits.withColumns({"ix": F.col("ix") - 1, "hit": F.lit(False)})).distinct(), "hits")
    for low in (0, 4, 8, 12):  # sources arrive in order
        rows.filter(F.col("seq").between(low, low + 3)).coalesce(4).write.mode("append").parquet(f"{path}/{low:02d}")
    log = OccupancyLog(scratch_path(spark, "occupancy"), keep=10, every=3).begin(spark)
    for low in (0, 4, 8, 12):
        run_stream(spark.readStream.schema(rows.schema).parquet(f"{path}/{low:02d}"), lambda batch, _, n=low // 4: log.add(batch, n))
    return log.state(spark)
