"""Voxel maps and coverage ledgers: additive tables, merged by aggregation, never replayed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanspark.functions import columns as C

VOXEL = ["map_id", "ix", "iy", "iz"]


def occupied_voxels(hits: DataFrame, size: float, shape: Sequence[int], origin: Sequence[float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Distinct voxels of the grid that any source's hit lies in, with the first sequence that hit each."""
    out = hits.select("map_id", "seq", *(C.voxel(F.col(a), size, o).alias(f"i{a}") for a, o in zip("xyz", origin, strict=True)))
    inside = [F.col(f"i{a}").between(0, n - 1) for a, n in zip("xyz", shape, strict=True)]
    return out.filter(inside[0] & inside[1] & inside[2]).groupBy(*VOXEL).agg(F.min("seq").alias("first_seq"))


def free_votes(crossings: DataFrame, occupied: DataFrame) -> DataFrame:
    """One vote for each (source, voxel) crossed before the voxel was first hit: votes cast stay when it is hit later."""
    votes = crossings.select(*VOXEL, "seq").distinct().join(occupied, VOXEL, "left")
    return votes.filter(F.col("first_seq").isNull() | (F.col("seq") < F.col("first_seq"))).groupBy(*VOXEL).agg(F.count(F.lit(1)).alias("free_votes"))


def occupancy_state(votes: DataFrame, occupied: DataFrame, least_votes: int = 3) -> DataFrame:
    """OCCUPIED if ever hit, FREE with enough votes, else UNKNOWN."""
    if least_votes < 2:
        raise ValueError("free space needs two votes at least")
    both = votes.join(occupied, VOXEL, "full")
    state = F.when(F.col("first_seq").isNotNull(), "OCCUPIED").when(F.col("free_votes") >= least_votes, "FREE").otherwise("UNKNOWN")
    return both.select(*VOXEL, F.coalesce("free_votes", F.lit(0)).alias("free_votes"), state.alias("state"))


def occupancy_stats(states: DataFrame, total: int, sources: DataFrame, least_sources: int) -> DataFrame:
    """By map: known (occupied or free), observed, unknown of total, and whether it is READY (sources: map_id, n)."""
    n = lambda s: F.sum((F.col("state") == s).cast("long"))
    out = states.groupBy("map_id").agg(n("OCCUPIED").alias("occupied"), n("FREE").alias("free"), F.count(F.lit(1)).alias("observed"))
    out = out.join(sources, "map_id", "left").withColumn("unknown", total - F.col("occupied") - F.col("free"))
    return out.withColumn("lifecycle", F.when(F.col("n") >= least_sources, "MAP_READY").when(F.col("n") > 0, "MAPPING").otherwise("UNMAPPED"))


def voxel_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*VOXEL).unionByName(b.select(*VOXEL)).distinct()


def voxel_except(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*VOXEL).distinct().join(b.select(*VOXEL), VOXEL, "left_anti")


def id_set_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The ids that only one side has, and which: empty if the sets are equal."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("only_in", F.lit("a")).unionByName(y.join(x, key, "left_anti").withColumn("only_in", F.lit("b")))


def tsdf_integrate(points: DataFrame, size: float, truncation: float, steps: int, camera: Sequence[str] = ("cx", "cy", "cz")) -> DataFrame:
    """Samples from -t to t along each ray about its point: mean of clip(-offset / t, -1, 1) and count by side and voxel."""
    ray = [F.col(a) - F.col(c) for a, c in zip("xyz", camera, strict=True)]
    length = C.norm(ray)
    offsets = F.transform(F.sequence(F.lit(-steps), F.lit(steps)), lambda k: k * (truncation / steps))
    out = points.withColumn("__len", length).filter("__len > 0").withColumn("__o", F.explode(offsets))
    at = [F.col(a) + (F.col(a) - F.col(c)) / F.col("__len") * F.col("__o") for a, c in zip("xyz", camera, strict=True)]
    keys = [C.voxel(x, size).alias(f"i{a}") for a, x in zip("xyz", at, strict=True)]
    value = C.clip(-F.col("__o") / truncation, -1.0, 1.0)
    return out.select("side", *keys, value.alias("value")).groupBy("side", "ix", "iy", "iz").agg(F.avg("value").alias("d"), F.count(F.lit(1)).alias("w"))


def mesh_edges(triangles: DataFrame) -> DataFrame:
    """Undirected edges of triangles (mesh_id, a, b, c) and how many triangles share each; those of one are boundary."""
    e = F.array(*(F.struct(F.least(p, q).alias("p"), F.greatest(p, q).alias("q")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))))
    out = triangles.select("mesh_id", F.explode(e).alias("e")).groupBy("mesh_id", F.col("e.p").alias("p"), F.col("e.q").alias("q")).agg(F.count(F.lit(1)).alias("n"))
    return out.withColumn("boundary", F.col("n") == 1)


def coverage_bins(points: DataFrame, low: Sequence[float], high: Sequence[float], rows: int, cols: int, bins: int, tolerance: float) -> DataFrame:
    """Counts by observation, patch (side, row, col) and bin of points near the face that their camera sees.

    The face is high[2] for side 1 and low[2] for side -1; patches and bins are clamped to the box.
    """
    face = F.when(F.col("side") == 1, F.lit(high[2])).otherwise(F.lit(low[2]))
    near = points.filter((F.abs(F.col("z") - face) <= tolerance) & C.in_box([F.col("x"), F.col("y")], low[:2], high[:2]))
    s, t = (F.col("x") - low[0]) / (high[0] - low[0]), (F.col("y") - low[1]) / (high[1] - low[1])
    clamp = lambda c, n: F.greatest(F.lit(0), F.least(F.floor(c), F.lit(n - 1))).cast("int")
    col, row = clamp(s * cols, cols), clamp(t * rows, rows)
    out = near.withColumns({"row": row, "col": col})
    out = out.withColumns({"bx": clamp((s * cols - F.col("col")) * bins, bins), "by": clamp((t * rows - F.col("row")) * bins, bins)})
    return out.groupBy("observation_id", "side", "row", "col", "by", "bx").agg(F.count(F.lit(1)).alias("n"))


BIN = ["side", "row", "col", "by", "bx"]


def coverage_update(ledger: DataFrame, bins: DataFrame, seen: DataFrame) -> DataFrame:
    """ledger plus the bins of observations that aren't in seen; every observation counts once."""
    new = bins.join(seen.select("observation_id").distinct(), "observation_id", "left_anti")
    return ledger.select(*BIN, "n").unionByName(new.select(*BIN, "n")).groupBy(*BIN).agg(F.sum("n").alias("n"))


def patch_completion(ledger: DataFrame, rows: int, cols: int, bins: int, least: int, threshold: float) -> DataFrame:
    """Share of all bins of each patch (empty ones count) with at least `least` points, and whether it reaches the threshold."""
    good = ledger.groupBy("side", "row", "col").agg(F.sum((F.col("n") >= least).cast("long")).alias("good"))
    grid = ledger.sparkSession.range(rows * cols).select(F.floor(F.col("id") / cols).cast("int").alias("row"), (F.col("id") % cols).cast("int").alias("col"))
    grid = grid.withColumn("side", F.explode(F.array(F.lit(-1), F.lit(1))))
    share = F.coalesce("good", F.lit(0)) / (bins * bins)
    return grid.join(good, ["side", "row", "col"], "left").select("side", "row", "col", share.alias("completion"), (share >= threshold).alias("complete"))


def surface_evidence(samples: DataFrame, observations: DataFrame, r: float) -> DataFrame:
    """For each patch sample the smallest distance to an observed point within r and that observation's cosine; the first wins among equals."""
    from scanspark.operators.joins import closest

    seen = observations.select("side", *"xyz", F.struct("seq", "point_id", "cosine").alias("__seen"))
    got = closest(samples, seen, r, "sample_id", "__seen", ["side"]).select("side", "sample_id", F.sqrt("d2").alias("distance"), F.col("__seen.cosine").alias("cosine")).hint("merge")
    return samples.select("side", "sample_id", "patch_id").join(got, ["side", "sample_id"], "left")


def surface_quality(evidence: DataFrame, limit: float, least_coverage: float, least_cosine: float, least_points: int, most_rmse: float) -> DataFrame:
    """By patch: coverage (samples within limit), RMSE and mean cosine of those, passed and the reasons why not."""
    seen = F.col("distance") <= limit
    n = F.sum(F.when(seen, 1).otherwise(0))
    out = evidence.groupBy("patch_id").agg(
        F.count(F.lit(1)).alias("n_samples"), n.alias("n_seen"), F.sqrt(F.avg(F.when(seen, F.col("distance") * F.col("distance")))).alias("rmse"), F.avg(F.when(seen, F.col("cosine"))).alias("mean_cosine")
    )
    out = out.withColumn("coverage", F.col("n_seen") / F.col("n_samples"))
    why = C.reasons(
        ("points", F.col("n_seen") >= F.least(F.lit(least_points), F.col("n_samples"))), ("coverage", F.col("coverage") >= least_coverage),
        ("rmse", F.col("rmse") <= most_rmse), ("cosine", F.col("mean_cosine") >= least_cosine),
    )
    return out.withColumns({"passed": F.size(why) == 0, "reasons": F.concat_ws(",", why)})
