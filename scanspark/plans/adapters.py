"""The driver's tables in this package's schemas, as DataFrames and as the SQL that begins each oracle query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Image size and intrinsics given to every view.
WIDTH, HEIGHT, FX, FY, CX, CY = 20_000, 8, 500.0, 400.0, 1000.0, 4.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view_id, v, u, raw_depth (0: no return), raw_stereo, valid, confidence: the smallest of each pixel's rows."""
    q, d, t = F.min("l_quantity"), F.min("l_discount"), F.min("l_tax")
    raw = F.when(q <= 2, 0).otherwise((1000 + 20 * q).cast("int"))
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_suppkey").alias("view_id"), F.col("l_linenumber").alias("v"), F.col("l_partkey").alias("u"))
        .agg(raw.alias("raw_depth"), (970 + 20 * q + 6 * F.rint(d * 100)).cast("int").alias("raw_stereo"), (t < 0.075).alias("valid"), (1 - t * 5).alias("confidence"))
    )


PIXELS = """pixels AS (
  SELECT l_suppkey AS view_id, l_linenumber AS v, l_partkey AS u,
         CASE WHEN min(l_quantity) <= 2 THEN 0 ELSE CAST(1000 + 20 * min(l_quantity) AS INTEGER) END AS raw_depth,
         CAST(970 + 20 * min(l_quantity) + 6 * round_even(min(l_discount) * 100, 0) AS INTEGER) AS raw_stereo,
         min(l_tax) < 0.075 AS valid, 1 - min(l_tax) * 5 AS confidence
  FROM lineitem GROUP BY 1, 2, 3)"""


def views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """view_id, session_id, seq and the pose base_T_camera: a quarter turn about z and a translation."""
    k = F.col("s_suppkey")
    turn = k % 4
    c, s = F.when(turn == 0, 1.0).when(turn == 2, -1.0).otherwise(0.0), F.when(turn == 1, 1.0).when(turn == 3, -1.0).otherwise(0.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    return table(spark, sf_dir, "supplier").select(
        k.alias("view_id"), F.col("s_nationkey").alias("session_id"), k.cast("int").alias("seq"),
        c.alias("r00"), (-s + 0.0).alias("r01"), zero.alias("r02"), s.alias("r10"), c.alias("r11"), zero.alias("r12"), zero.alias("r20"), zero.alias("r21"), one.alias("r22"),
        ((k % 7 - 3) * 0.125).alias("tx"), ((k % 5 - 2) * 0.25).alias("ty"), F.when(k % 2 == 0, 0.5).otherwise(-0.5).alias("tz"),
    )


VIEWS = """views AS (
  SELECT s_suppkey AS view_id, s_nationkey AS session_id, CAST(s_suppkey AS INTEGER) AS seq,
         c AS r00, -s + 0.0 AS r01, 0.0::DOUBLE AS r02, s AS r10, c AS r11, 0.0::DOUBLE AS r12, 0.0::DOUBLE AS r20, 0.0::DOUBLE AS r21, 1.0::DOUBLE AS r22,
         (s_suppkey % 7 - 3) * 0.125::DOUBLE AS tx, (s_suppkey % 5 - 2) * 0.25::DOUBLE AS ty, CASE WHEN s_suppkey % 2 = 0 THEN 0.5::DOUBLE ELSE -0.5::DOUBLE END AS tz
  FROM (SELECT *, CASE s_suppkey % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 2 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS c,
               CASE s_suppkey % 4 WHEN 1 THEN 1.0::DOUBLE WHEN 3 THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS s FROM supplier))"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """point_id, view_id, side, x, y, z."""
    e = table(spark, sf_dir, "embeddings")
    xyz = [F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]
    return e.select(F.col("vec_id").alias("point_id"), F.col("label").alias("view_id"), (F.col("label") % 2).alias("side"), *xyz)


POINTS = """points AS (
  SELECT vec_id AS point_id, label AS view_id, label % 2 AS side,
         CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings)"""


def points_big(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One point for each order line: map_id, seq, x, y, z."""
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 10).alias("map_id"), (F.col("l_orderkey") % 16).alias("seq"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_tax") * 100).alias("z")
    )


POINTS_BIG = """points_big AS (
  SELECT l_suppkey % 10 AS map_id, l_orderkey % 16 AS seq, l_quantity AS x, l_extendedprice / 1000 AS y, l_tax * 100 AS z FROM lineitem)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, id, us (microseconds), ctrl_us (a controller clock that stands still now and then), value, kind."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("trace_id"), F.col("event_id").alias("id"), us.alias("us"), (us - us % 3_600_000_000).alias("ctrl_us"), "value", F.col("event_type").alias("kind")
    )


SAMPLES = """samples AS (
  SELECT user_id AS trace_id, event_id AS id, epoch_us(ts) AS us, epoch_us(ts) - epoch_us(ts) % 3600000000 AS ctrl_us, value, event_type AS kind FROM events)"""


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """plan_id, candidate_id, side, row, col, score, distance, tilt, status inputs."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        (k % 10).alias("plan_id"), k.alias("candidate_id"), F.when(k % 3 == 0, "back").otherwise("front").alias("side"), (F.floor(k / 40) % 8).cast("int").alias("row"),
        (F.floor(k / 320) % 12).cast("int").alias("col"), (F.col("p_retailprice") / 2000).alias("score"), (F.col("p_size") / 100).alias("distance"), (F.col("p_size") % 13 * 5).alias("tilt"),
    )


CANDIDATES = """candidates AS (
  SELECT p_partkey % 10 AS plan_id, p_partkey AS candidate_id, CASE WHEN p_partkey % 3 = 0 THEN 'back' ELSE 'front' END AS side,
         CAST(p_partkey // 40 % 8 AS INTEGER) AS row, CAST(p_partkey // 320 % 12 AS INTEGER) AS col, p_retailprice / 2000 AS score,
         p_size / 100.0::DOUBLE AS distance, p_size % 13 * 5 AS tilt FROM part)"""


def chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, seq, payload."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).alias("payload"))


CHAIN = "chain AS (SELECT conv_id AS run_id, turn AS seq, coalesce(text, '') AS payload FROM conversations)"


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("predicted"), (F.col("toxic") == 1).alias("truth"))


MASKS = "masks AS (SELECT doc_id, quality = 1 AS predicted, toxic = 1 AS truth FROM labels)"


def sql(*parts: str) -> str:
    """A query from table expressions and, last, the SELECT."""
    return ("WITH " + ",\n".join(parts[:-1]) + "\n" if parts[1:] else "") + parts[-1]
