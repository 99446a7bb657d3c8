"""Depth pixels: conversion, masks, projection. One row is a pixel (view_id, v, u); missing depth is null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanspark.functions import columns as C
from scanspark.operators.ranks import percentile
from scanspark.sources.scratch import stored

PIXEL = ["view_id", "v", "u"]


def depth_to_meters(pixels: DataFrame, scale: float, raw: str = "raw_depth", out: str = "depth_m") -> DataFrame:
    """raw times scale in 32-bit floats; no return (0) gives null."""
    if not scale > 0:
        raise ValueError("scale must be positive")
    return pixels.withColumn(out, F.when(F.col(raw) > 0, F.col(raw).cast("float") * F.lit(scale).cast("float")))


def disparity_to_depth(pixels: DataFrame, fx: Column, baseline: Column, disparity: str = "disparity", valid: str = "valid") -> DataFrame:
    """fx * baseline / disparity where that is positive and valid, else null."""
    d = F.col(disparity)
    return pixels.withColumn("depth_m", F.when((d > 0) & F.col(valid), fx * baseline / d))


def rectified_region_filter(pixels: DataFrame, left: Sequence[int], right: Sequence[int], disparity: str = "disparity") -> DataFrame:
    """Pixels in the left region whose match u - disparity is in the right one; regions are (u0, v0, u1, v1), ends excluded."""
    match = F.col("u") - F.col(disparity)
    inside = lambda u, r: (u >= r[0]) & (u < r[2]) & (F.col("v") >= r[1]) & (F.col("v") < r[3])
    return pixels.filter(inside(F.col("u"), left) & inside(match, right))


def lr_consistency(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """left with lr_error, comparable, consistent and lr_confidence against the right image's disparity at rint(u - disparity).

    A pixel without a positive right disparity there isn't comparable: confidence 0. right: view_id, v, u, disparity.
    """
    x = F.rint(F.col("u") - F.col("disparity")).cast("long")
    other = right.select("view_id", "v", F.col("u").alias("x"), F.col("disparity").alias("right_disparity")).filter("right_disparity > 0")
    out = left.withColumn("x", x).join(other, ["view_id", "v", "x"], "left")
    error = F.abs(F.col("disparity") - F.col("right_disparity"))
    out = out.withColumns({"lr_error": error, "comparable": error.isNotNull()})
    consistent = F.col("comparable") & (F.col("lr_error") <= threshold) & (F.col("u") - F.col("disparity") >= 0)
    return out.withColumns({"consistent": F.coalesce(consistent, F.lit(False)), "lr_confidence": F.when(F.col("comparable"), F.exp(-F.col("lr_error") / threshold)).otherwise(0.0)}).drop("x")


def confidence_filter(pixels: DataFrame, least: float) -> DataFrame:
    return pixels.filter(F.col("valid") & (F.col("confidence") >= least))


def confidence_report(pixels: DataFrame, least: float) -> DataFrame:
    """By view: share of valid pixels, share accepted, mean confidence of those accepted (null without any)."""
    taken = F.col("valid") & (F.col("confidence") >= least)
    return pixels.groupBy("view_id").agg(
        F.avg(F.col("valid").cast("double")).alias("valid_fraction"), F.avg(taken.cast("double")).alias("accepted_fraction"), F.avg(F.when(taken, F.col("confidence"))).alias("mean_confidence")
    )


def depth_range_sample(pixels: DataFrame, low: float, high: float, stride: int, least: int = 1, mask: str | None = None) -> DataFrame:
    """Pixels with low <= depth <= high (and mask), every stride-th row and column; passed tells whether the view keeps `least`."""
    kept = pixels.filter(F.col("depth_m").between(low, high) & (F.col("v") % stride == 0) & (F.col("u") % stride == 0))
    if mask:
        kept = kept.filter(mask)
    n = F.count(F.lit(1)).over(Window.partitionBy("view_id"))
    return kept.withColumn("passed", n >= least)


def back_project(pixels: DataFrame, fx: float, fy: float, cx: float, cy: float, depth: str = "depth_m") -> DataFrame:
    z = F.col(depth).cast("double")
    return pixels.withColumns({"x": (F.col("u") - cx) * z / fx, "y": (F.col("v") - cy) * z / fy, "z": z})


def project_points(points: DataFrame, fx: float, fy: float, cx: float, cy: float) -> DataFrame:
    """pu, pv of points in front of the camera, else null."""
    front = F.col("z") > 0
    return points.withColumns({"pu": F.when(front, fx * F.col("x") / F.col("z") + cx), "pv": F.when(front, fy * F.col("y") / F.col("z") + cy)})


def project_distorted(points: DataFrame, fx: float, fy: float, cx: float, cy: float, k: Sequence[float], p: Sequence[float]) -> DataFrame:
    """Brown-Conrady with k1..k6 and p1, p2; the radial denominator is 1e-12 at least."""
    front = F.col("z") > 0
    x, y = F.when(front, F.col("x") / F.col("z")), F.when(front, F.col("y") / F.col("z"))
    r2 = x * x + y * y
    k = [*k, *[0.0] * (6 - len(k))]
    below = 1 + r2 * (k[3] + r2 * (k[4] + r2 * k[5]))
    radial = (1 + r2 * (k[0] + r2 * (k[1] + r2 * k[2]))) / F.greatest(below, F.lit(1e-12))
    xd = x * radial + 2 * p[0] * x * y + p[1] * (r2 + 2 * x * x)
    yd = y * radial + p[0] * (r2 + 2 * y * y) + 2 * p[1] * x * y
    return points.withColumns({"pu": fx * xd + cx, "pv": fy * yd + cy})


def transform_points(points: DataFrame, poses: DataFrame, key: str = "view_id") -> DataFrame:
    """x, y, z moved by the pose of their view; points of views without a pose go."""
    joined = points.join(poses.select(key, *C.POSE), key)
    new = C.apply_pose(*C.pose(), [F.col(a) for a in "xyz"])
    return joined.withColumns(dict(zip("xyz", new, strict=True))).drop(*C.POSE)


def box_support_select(points: DataFrame, low: Sequence[float], high: Sequence[float], least: int, fraction: float) -> DataFrame:
    """By view: points in a closed box, share kept, their bounds, and whether both limits hold."""
    inside = C.in_box([F.col(a) for a in "xyz"], low, high)
    kept = F.sum(inside.cast("long"))
    edges = [f(F.when(inside, F.col(a))).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max))]
    out = points.groupBy("view_id").agg(F.count(F.lit(1)).alias("n_input"), kept.alias("n_kept"), *edges)
    return out.withColumn("passed", (F.col("n_kept") >= least) & (F.col("n_kept") / F.col("n_input") >= fraction))


def self_mask(pixels: DataFrame, predicted: DataFrame, front: float, back: float) -> DataFrame:
    """pixels with masked (a prediction, and measured no nearer than it less front) and matched (no farther than it plus back, too)."""
    out = pixels.join(predicted.select(*PIXEL, F.col("depth_m").alias("predicted_m")), PIXEL, "left")
    m, p = F.col("depth_m"), F.col("predicted_m")
    masked = F.coalesce((p > 0) & (m >= p - front), F.lit(False))
    return out.withColumns({"masked": masked, "matched": masked & (m <= p + back)})


def disc(radius: int) -> list[tuple[int, int]]:
    return [(dv, du) for dv in range(-radius, radius + 1) for du in range(-radius, radius + 1) if dv * dv + du * du <= radius * radius]


def square(radius: int) -> list[tuple[int, int]]:
    return [(dv, du) for dv in range(-radius, radius + 1) for du in range(-radius, radius + 1)]


def spread(pixels: DataFrame, offsets: Sequence[tuple[int, int]]) -> DataFrame:
    """One row for each pixel and offset, v and u moved."""
    steps = F.array(*(F.struct(F.lit(a).alias("dv"), F.lit(b).alias("du")) for a, b in offsets))
    out = pixels.withColumn("__o", F.explode(steps))
    return out.withColumns({"v": F.col("v") + F.col("__o.dv"), "u": F.col("u") + F.col("__o.du")}).drop("__o")


def dilate_mask(mask: DataFrame, offsets: Sequence[tuple[int, int]], width: int, height: int) -> DataFrame:
    """Pixels of the image reached from the mask's pixels by any offset."""
    out = spread(mask.select(*PIXEL), offsets).filter(F.col("v").between(0, height - 1) & F.col("u").between(0, width - 1))
    return out.distinct()


def z_buffer(points: DataFrame, offsets: Sequence[tuple[int, int]] = ((0, 0),), width: int = 1 << 30, height: int = 1 << 30) -> DataFrame:
    """Nearest z of projected points (pu, pv rounded half to even), each drawn at all offsets."""
    drawn = points.filter("z > 0").select("view_id", F.rint("pv").cast("long").alias("v"), F.rint("pu").cast("long").alias("u"), "z")
    drawn = spread(drawn, offsets).filter(F.col("v").between(0, height - 1) & F.col("u").between(0, width - 1))
    return drawn.groupBy(*PIXEL).agg(F.min("z").alias("z"))


def depth_band(points: DataFrame, offsets: Sequence[tuple[int, int]], width: int = 1 << 30, height: int = 1 << 30) -> DataFrame:
    """Nearest and farthest z of projected points around each pixel."""
    drawn = points.filter("z > 0").select("view_id", F.rint("pv").cast("long").alias("v"), F.rint("pu").cast("long").alias("u"), "z")
    drawn = spread(drawn, offsets).filter(F.col("v").between(0, height - 1) & F.col("u").between(0, width - 1))
    return drawn.groupBy(*PIXEL).agg(F.min("z").alias("z_min"), F.max("z").alias("z_max"))


def reference_depth_mask(pixels: DataFrame, zbuffer: DataFrame, front: float, back: float) -> DataFrame:
    """pixels with target: depth between the reference depth less front and plus back; false without a reference."""
    out = pixels.join(zbuffer.select(*PIXEL, F.col("z").alias("reference")), PIXEL, "left")
    d, r = F.col("depth_m"), F.col("reference")
    return out.withColumn("target", F.coalesce((d >= r - front) & (d <= r + back), F.lit(False)))


def projected_support_mask(pixels: DataFrame, bands: DataFrame, tolerance: float) -> DataFrame:
    """Pixels within the local depth band (widened by tolerance) of the projected reference."""
    out = pixels.join(bands, PIXEL)
    return out.filter((F.col("depth_m") >= F.col("z_min") - tolerance) & (F.col("depth_m") <= F.col("z_max") + tolerance)).select(*pixels.columns)


def polygon_roi(pixels: DataFrame, polygon: Sequence[tuple[float, float]]) -> DataFrame:
    """Pixels whose centre (u, v) is inside a polygon by the even-odd rule, or on its edge."""
    u, v = F.col("u").cast("double"), F.col("v").cast("double")
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x0, y0), (x1, y1) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
        turn = (x1 - x0) * (v - y0) - (y1 - y0) * (u - x0)
        on_edge = on_edge | (turn == 0) & u.between(min(x0, x1), max(x0, x1)) & v.between(min(y0, y1), max(y0, y1))
        if y0 != y1:
            spans = (v < F.lit(float(y0))) != (v < F.lit(float(y1)))
            crossings = crossings + (spans & (u < (x1 - x0) * (v - y0) / (y1 - y0) + x0)).cast("int")
    return pixels.filter(on_edge | (crossings % 2 == 1))


def valid_domain_boundary(pixels: DataFrame, margin: int) -> DataFrame:
    """Valid pixels within margin of their view's bounding box of valid pixels."""
    w = Window.partitionBy("view_id")
    out = pixels.filter("valid")
    near = lambda a: (F.col(a) <= F.min(a).over(w) + margin) | (F.col(a) >= F.max(a).over(w) - margin)
    return out.withColumn("__near", near("v") | near("u")).filter("__near").drop("__near")


def smooth_depth_filter(pixels: DataFrame, radius: int, limit: float) -> DataFrame:
    """Pixels whose whole (2 radius + 1) square has depth, with max - min within limit."""
    known = pixels.filter(F.col("depth_m").isNotNull())
    around = spread(known.select(*PIXEL, "depth_m"), square(radius)).groupBy(*PIXEL)
    good = around.agg(F.count(F.lit(1)).alias("n"), (F.max("depth_m") - F.min("depth_m")).alias("range")).filter((F.col("n") == (2 * radius + 1) ** 2) & (F.col("range") <= limit))
    return known.join(good.select(*PIXEL), PIXEL)


def robust_range_filter(points: DataFrame, value: str, factor: float, floor: float, fraction: float) -> DataFrame:
    """Rows with value <= median + max(factor * 1.4826 * MAD, floor), by view; all of a view's if fewer than fraction would stay."""
    # What is known of views is stored: a small table, so that a view's points are neither shuffled nor sorted.
    middle = stored(percentile(points, ["view_id"], value, 0.5, "__median"), "medians")
    off = points.select("view_id", F.col(value).alias("__v")).join(middle, "view_id").select("view_id", F.abs(F.col("__v") - F.col("__median")).alias("__off"))
    limits = middle.join(percentile(off, ["view_id"], "__off", 0.5, "__mad"), "view_id")
    limits = limits.select("view_id", (F.col("__median") + F.greatest(factor * 1.4826 * F.col("__mad"), F.lit(floor))).alias("__limit"))
    limits = stored(limits, "limits")
    inside = F.col(value) <= F.col("__limit")
    shares = points.join(limits, "view_id").groupBy("view_id", "__limit").agg(F.avg(inside.cast("double")).alias("__share"))
    return points.join(stored(shares, "shares"), "view_id").filter(inside | (F.col("__share") < fraction)).select(*points.columns)


def voxel_centroids(points: DataFrame, size: float, *keys: str) -> DataFrame:
    """Mean point and count by voxel (floor) and keys."""
    return points.groupBy(*keys, *(C.voxel(F.col(a), size).alias(f"i{a}") for a in "xyz")).agg(*(F.avg(a).alias(a) for a in "xyz"), F.count(F.lit(1)).alias("n"))
