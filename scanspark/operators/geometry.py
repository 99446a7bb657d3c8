"""Rays, moments, normals, registration and segments: sums in Spark, small algebra on what is already summed."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanspark.operators.graph import components
from scanspark.operators.joins import knn, nearest_neighbor
from scanspark.sources.scratch import stored

#: Two crossings of voxel faces are one if they are no further apart than this share of the ray's parameter.
TIE = 1e-12


def crossed_voxels(start: np.ndarray, end: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray]:
    """Ray numbers and voxels (n x 3) that rays from start to end pass through, their end voxels excluded.

    All rays take a step at a time, over the nearest face of their voxel, or over all that are met at that moment. Axes are held apart, so a step is
    a few passes over arrays of the rays that are still on their way.
    """
    first, last = np.floor(start / size).astype(np.int64), np.floor(end / size).astype(np.int64)
    ray = np.flatnonzero((first != last).any(1))
    at, left, sign, when, step = [], [], [], [], []
    for a in range(3):
        away = last[ray, a] - first[ray, a]
        at.append(first[ray, a].copy())
        left.append(np.abs(away))
        sign.append(np.sign(away))
        with np.errstate(divide="ignore", invalid="ignore"):
            length = end[ray, a] - start[ray, a]
            when.append(np.where(away != 0, ((at[a] + (away > 0)) * size - start[ray, a]) / length, np.inf))
            step.append(np.where(away != 0, size * sign[a] / length, 0.0))
    rays, voxels = [ray[:0]], [[c[:0] for c in at]]
    while len(ray):
        rays.append(ray)
        voxels.append([c.copy() for c in at])
        now = np.minimum(np.minimum(when[0], when[1]), when[2])
        now = now + TIE * np.maximum(1.0, now)
        over = np.ones(len(ray), bool)
        for a in range(3):
            crossed = when[a] <= now
            at[a] += sign[a] * crossed
            left[a] -= crossed
            when[a] += step[a] * crossed
            none = left[a] == 0
            when[a][none] = np.inf
            over &= none
        if over.any():
            ray, *rest = (c[~over] for c in (ray, *at, *left, *sign, *when, *step))
            at, left, sign, when, step = (rest[i : i + 3] for i in range(0, 15, 3))
    return np.concatenate(rays), np.stack([np.concatenate(c) for c in zip(*voxels, strict=True)], 1)


def free_voxels(start: np.ndarray, end: np.ndarray, size: float, margin: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Ray numbers and voxels that rays cross before their end less margin, the end's own voxel excluded."""
    if not margin:
        return crossed_voxels(start, end, size)
    hit = np.floor(end / size).astype(np.int64)
    length = np.linalg.norm(end - start, axis=1, keepdims=True)
    end = start + (end - start) * np.clip(1 - margin / np.maximum(length, 1e-300), 0, 1)
    ray, voxel = crossed_voxels(start, end, size)
    # The last voxel of a shortened ray is crossed, too, unless it holds the hit.
    ray = np.concatenate([ray, np.arange(len(end))])
    voxel = np.concatenate([voxel, np.floor(end / size).astype(np.int64)])
    free = (voxel != hit[ray]).any(1)
    return ray[free], voxel[free]


def distinct_rows(columns: list[np.ndarray]) -> list[np.ndarray]:
    """The distinct rows of columns of whole numbers, in order of appearance: as one number each, where their ranges allow it."""
    low = [int(c.min()) for c in columns]
    span = [int(c.max()) - b + 1 for c, b in zip(columns, low, strict=True)]
    if math.prod(span) >= 1 << 62:
        return list(pd.DataFrame(dict(enumerate(columns))).drop_duplicates().to_numpy().T)
    code = np.zeros(len(columns[0]), np.int64)
    for c, b, n in zip(columns, low, span, strict=True):
        code = code * n + (c - b)
    code, out = pd.unique(code), []
    for b, n in zip(reversed(low), reversed(span), strict=True):
        out.append(code % n + b)
        code = code // n
    return out[::-1]


RAY = [f"{p}{a}" for p in "se" for a in "xyz"]
VOXELS = "map_id long, seq long, ix long, iy long, iz long"
#: Voxels that a task holds before it drops repeated ones and passes them on.
HELD = 500_000
#: Rays whose voxels a task finds at once.
RAYS = 2048


def voxel_batches(frames: Iterable[pa.RecordBatch], size: float, margin: float) -> Iterator[pa.RecordBatch]:
    """VOXELS of batches of map_id, seq and RAY; rows repeat only across blocks of HELD."""
    held, n = [], 0

    def out() -> pa.RecordBatch:
        rows = distinct_rows([np.concatenate(c) for c in zip(*held, strict=True)])
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in rows], ["map_id", "seq", "ix", "iy", "iz"])

    for frame in (f.slice(k, RAYS) for f in frames for k in range(0, f.num_rows, RAYS)):
        map_id, seq, *ends = (c.to_numpy(zero_copy_only=False) for c in frame.columns)
        ray, voxel = free_voxels(np.stack(ends[:3], 1), np.stack(ends[3:], 1), size, margin)
        if len(ray):
            held.append([map_id[ray], seq[ray], *voxel.T])
            n += len(ray)
        if n >= HELD:
            yield out()
            held, n = [], 0
    if n:
        yield out()


def ray_voxels(rays: DataFrame, size: float, margin: float = 0.0) -> DataFrame:
    """map_id, seq, ix, iy, iz, each once, of voxels that the rays of a source (sx, sy, sz to ex, ey, ez) cross before their end less margin.

    Repeated voxels of a task go before the shuffle, so a source's rays cost about its voxels.
    """
    rows = rays.select(F.col("map_id").cast("long"), F.col("seq").cast("long"), *(F.col(n).cast("double") for n in RAY)).na.drop()
    return rows.mapInArrow(lambda frames: voxel_batches(frames, size, margin), VOXELS).distinct()


def moments(points: DataFrame, keys: Sequence[str], axes: Sequence[str] = "xyz") -> DataFrame:
    """Count, means and population covariances by key, from sums in one pass."""
    pairs = [(a, b) for i, a in enumerate(axes) for b in axes[i:]]
    return points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *(F.avg(a).alias(f"m{a}") for a in axes), *(F.covar_pop(a, b).alias(f"c{a}{b}") for a, b in pairs))


FRAME = "struct<e0: double, e1: double, e2: double, " + ", ".join(f"a{i}{a}: double" for i in range(3) for a in "xyz") + ">"


def principal_axes(cxx: Column, cxy: Column, cxz: Column, cyy: Column, cyz: Column, czz: Column) -> Column:
    """Eigenvalues in descending order and axes: the largest component of the first two is positive, the third makes them right-handed."""

    @F.pandas_udf(FRAME)
    def solve(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        c = np.stack([np.stack(r, -1) for r in ((xx, xy, xz), (xy, yy, yz), (xz, yz, zz))], -2).astype(float).reshape(-1, 3, 3)
        values, vectors = np.linalg.eigh(np.nan_to_num(c))
        values, axes = values[:, ::-1], np.swapaxes(vectors, 1, 2)[:, ::-1].copy()
        top = np.take_along_axis(axes, np.abs(axes).argmax(2)[..., None], 2)
        axes *= np.where(top < 0, -1.0, 1.0)
        axes[:, 2] = np.cross(axes[:, 0], axes[:, 1])
        out = pd.DataFrame(values, columns=["e0", "e1", "e2"])
        for i in range(3):
            for j, a in enumerate("xyz"):
                out[f"a{i}{a}"] = axes[:, i, j]
        return out

    return solve(cxx, cxy, cxz, cyy, cyz, czz)


def pca_frame(points: DataFrame, *keys: str) -> DataFrame:
    """keys, n, centroid m*, eigenvalues e* and axes a** of each key's points."""
    m = moments(points, keys)
    axes = principal_axes(*(F.col(f"c{p}") for p in ("xx", "xy", "xz", "yy", "yz", "zz")))
    return m.withColumn("f", axes).select(*keys, "n", "mx", "my", "mz", "f.*")


def oriented_box(points: DataFrame, *keys: str) -> DataFrame:
    """pca_frame with the extents l*, h* of the points along its axes."""
    frame = pca_frame(points, *keys)
    along = points.join(frame, list(keys))
    at = [sum((F.col(f"a{i}{a}") * (F.col(a) - F.col(f"m{a}")) for a in "yz"), F.col(f"a{i}x") * (F.col("x") - F.col("mx"))) for i in range(3)]
    edges = along.groupBy(*keys).agg(*(f(c).alias(f"{n}{i}") for i, c in enumerate(at) for n, f in (("l", F.min), ("h", F.max))))
    return frame.join(edges, list(keys))


def estimate_normals(points: DataFrame, k: int, r: float, hint: Sequence[float], point_id: str = "point_id", keys: Sequence[str] = ()) -> DataFrame:
    """point_id, nx, ny, nz: the axis of least spread of the k nearest neighbours (the point itself excluded), turned towards hint."""
    near = knn(points, k, r, point_id, keys)
    at = points.select(*keys, F.col(point_id).alias("neighbor_id"), *"xyz")
    own = pca_frame(near.join(at, [*keys, "neighbor_id"]), *keys, "point_id")
    facing = sum((F.col(f"a2{a}") * h for a, h in zip("yz", hint[1:], strict=True)), F.col("a2x") * hint[0])
    sign = F.when(facing < 0, -1.0).otherwise(1.0)
    return own.select(*keys, "point_id", *((F.col(f"a2{a}") * sign).alias(f"n{a}") for a in "xyz"))


def register_step(source: DataFrame, target: DataFrame, radius: float, prior: float = 0.0, least: int = 6) -> dict:
    """One robust point-to-plane step for source points (point_id, x, y, z) against target (target_id, x, y, z, nx, ny, nz).

    Residuals to the nearest target's plane within radius are weighted by 1 / sqrt(1 + (r / 2.5 s) ** 2), s the 1.4826-fold median of
    their size. The driver gets 28 sums and solves for (rotation vector, translation); fewer than `least` pairs give no step.
    """
    t = target.select("target_id", *(F.col(a).alias(f"t{a}") for a in "xyz"), "nx", "ny", "nz")
    near = nearest_neighbor(source, target, radius, "point_id", "target_id").filter("target_id IS NOT NULL")
    j = near.join(source.select("point_id", *"xyz"), "point_id").join(t, "target_id")
    r = sum((F.col(f"n{a}") * (F.col(a) - F.col(f"t{a}")) for a in "yz"), F.col("nx") * (F.col("x") - F.col("tx")))
    j = stored(j.withColumn("r", r), "pairs")
    n, s = j.agg(F.count(F.lit(1)), F.percentile(F.abs("r"), 0.5)).first()
    if n < least:
        return {"n": n, "step": None, "rmse": None}
    scale = max(1.4826 * s, 1e-9) * 2.5
    w = 1 / F.sqrt(1 + (F.col("r") / scale) ** 2)
    p, q = [F.col(a) for a in "xyz"], [F.col(f"n{a}") for a in "xyz"]
    row = [p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0], *q]
    sums = [F.sum(w * row[a] * row[b]) for a in range(6) for b in range(a, 6)] + [F.sum(w * row[a] * F.col("r")) for a in range(6)]
    got = list(j.agg(*(c.alias(f"s{i}") for i, c in enumerate(sums)), F.sqrt(F.avg(F.col("r") ** 2)).alias("rmse")).first())
    h = np.zeros((6, 6))
    h[np.triu_indices(6)] = got[:21]
    h = h + np.triu(h, 1).T + prior * np.eye(6)
    step = np.linalg.lstsq(h, -np.array(got[21:27]), rcond=None)[0]
    return {"n": n, "step": step.tolist(), "rmse": got[27]}


def pixel_components(pixels: DataFrame, jump: float, relative: float, diagonal: bool = False) -> DataFrame:
    """pixels (view_id, v, u, depth_m) with component: neighbours (4, or 8 with diagonal) are linked if their depths differ by max(jump, relative * nearer) at most."""
    ids = pixels.filter("depth_m IS NOT NULL").withColumn("pixel", F.xxhash64("view_id", "v", "u"))
    other = ids.select("view_id", F.col("v").alias("ov"), F.col("u").alias("ou"), F.col("depth_m").alias("od"), F.col("pixel").alias("b"))
    ways = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    steps = ids.withColumn("s", F.explode(F.array(*(F.struct(F.lit(dv).alias("dv"), F.lit(du).alias("du")) for dv, du in ways))))
    steps = steps.select("view_id", (F.col("v") + F.col("s.dv")).alias("ov"), (F.col("u") + F.col("s.du")).alias("ou"), "depth_m", F.col("pixel").alias("a"))
    close = F.abs(F.col("depth_m") - F.col("od")) <= F.greatest(F.lit(jump), relative * F.least("depth_m", "od"))
    roots = components(steps.join(other, ["view_id", "ov", "ou"]).filter(close).select("a", "b"))
    out = ids.join(roots.withColumnsRenamed({"node": "pixel"}), "pixel", "left").withColumn("root", F.coalesce("root", "pixel"))
    first = out.groupBy("root").agg(F.min(F.struct("v", "u")).alias("at"))
    return out.join(first, "root").select(*pixels.columns, F.col("at.v").alias("component_v"), F.col("at.u").alias("component_u"))


def split_two_faces(points: DataFrame, key: str, value: str, most_rounds: int = 12) -> DataFrame:
    """points with face 0 or 1 by one-dimensional two-means of value, from the quartiles; by key, until no mean moves."""
    means = points.groupBy(key).agg(F.percentile(value, 0.25).alias("m0"), F.percentile(value, 0.75).alias("m1"))
    for _ in range(most_rounds):
        means = stored(means, "two-means")
        nearer = F.abs(F.col(value) - F.col("m0")) <= F.abs(F.col(value) - F.col("m1"))
        j = points.join(means, key)
        new = j.groupBy(key, "m0", "m1").agg(F.avg(F.when(nearer, F.col(value))).alias("a"), F.avg(F.when(~nearer, F.col(value))).alias("b"))
        new = stored(new.select(key, F.coalesce("a", "m0").alias("m0"), F.coalesce("b", "m1").alias("m1"), (F.abs(F.coalesce("a", "m0") - F.col("m0")) + F.abs(F.coalesce("b", "m1") - F.col("m1"))).alias("move")), "two-means")
        means = new.drop("move")
        if not new.filter("move > 1e-12").limit(1).count():
            break
    j = points.join(means, key)
    return j.withColumn("face", (F.abs(F.col(value) - F.col("m0")) > F.abs(F.col(value) - F.col("m1"))).cast("int"))
