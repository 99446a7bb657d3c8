"""Surfaces: fused sides, height fits, protrusions, patches, meshes and pose sets. Keys are blades, sides or sets, any number at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import permutations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanspark.functions import columns as C
from scanspark.operators.geometry import oriented_box, pixel_components, principal_axes
from scanspark.operators.graph import radius_components
from scanspark.operators.joins import pose_pairs
from scanspark.operators.pixels import voxel_centroids
from scanspark.sources.scratch import stored


def fuse_views(points: DataFrame, size: float, *keys: str) -> DataFrame:
    """One point for each key, side and voxel: the mean of the views' own voxel means, so a dense view weighs no more than another."""
    by_view = voxel_centroids(points, size, *keys, "side", "view_id")
    return by_view.groupBy(*keys, "side", "ix", "iy", "iz").agg(*(F.avg(a).alias(a) for a in "xyz"), F.count(F.lit(1)).alias("views"), F.sum("n").alias("n"))


def build_proxy(points: DataFrame, size: float, margin: float, thickness: float, *keys: str) -> DataFrame:
    """An oriented box for each key from its voxel means: margins on all axes; the thinnest extent is at least thickness, extended away from the camera side (l2)."""
    box = oriented_box(voxel_centroids(points, size, *keys), *keys)
    out = box
    for i in range(3):
        out = out.withColumns({f"l{i}": F.col(f"l{i}") - margin, f"h{i}": F.col(f"h{i}") + margin})
    return out.withColumn("l2", F.least(F.col("l2"), F.col("h2") - thickness))


def _basis() -> list[Column]:
    x, y = F.col("x"), F.col("y")
    return [F.lit(1.0), x, y, x * x, x * y, y * y]


def _solve(frames: Iterable[pd.DataFrame], names: list[str], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Least squares for each row of normal-equation sums (21 of the matrix, 6 of the right side)."""
    for frame in frames:
        s = np.nan_to_num(frame[names].to_numpy(float))
        h = np.zeros((len(s), 6, 6))
        rows, cols = np.triu_indices(6)
        h[:, rows, cols] = h[:, cols, rows] = s[:, :21]
        c = np.einsum("nij,nj->ni", np.linalg.pinv(h), s[:, 21:])
        yield pd.concat([frame[keys].reset_index(drop=True), pd.DataFrame(c, columns=[f"c{i}" for i in range(6)])], axis=1)


def fit_height_surface(points: DataFrame, keys: Sequence[str], seed: Column | None = None, rounds: int = 4, factor: float = 1.345, floor: float = 1e-9, least: float = 0.0) -> DataFrame:
    """points with height and residual of a quadratic z(x, y) by key, fitted to the seed rows with Huber weights (factor times 1.4826 MAD, that floor at least; the limit is `least` at least)."""
    keys = list(keys)
    rows = points.withColumn("__seed", F.lit(True) if seed is None else seed)
    kinds = dict(points.dtypes)
    basis, names = _basis(), [f"s{i}" for i in range(27)]
    weight: Column = F.when(F.col("__seed"), 1.0).otherwise(0.0)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), *(f"c{i} double" for i in range(6))])
    work = rows
    for _ in range(rounds):
        sums = [F.sum(weight * basis[a] * basis[b]) for a in range(6) for b in range(a, 6)] + [F.sum(weight * b * F.col("z")) for b in basis]
        fit = work.groupBy(*keys).agg(*(s.alias(n) for s, n in zip(sums, names, strict=True)))
        fit = stored(fit.mapInPandas(lambda frames: _solve(frames, names, keys), schema), "height-fit")
        height = sum((F.col(f"c{i}") * b for i, b in enumerate(basis[1:], 1)), F.col("c0") * basis[0])
        work = rows.join(fit, keys).withColumn("height", height).withColumn("residual", F.col("z") - F.col("height")).drop(*(f"c{i}" for i in range(6)))
        mad = work.filter("__seed").groupBy(*keys).agg(F.percentile(F.abs("residual"), 0.5).alias("__mad"))
        work = work.join(mad, keys, "left")
        limit = F.greatest(F.lit(least), factor * F.greatest(1.4826 * F.col("__mad"), F.lit(floor)))
        weight = F.when(F.col("__seed"), F.least(F.lit(1.0), F.try_divide(limit, F.abs("residual")))).otherwise(0.0)
        weight = F.coalesce(weight, F.lit(1.0))
    return work.drop("__seed", "__mad")


def segment_protrusion(points: DataFrame, keys: Sequence[str], point_id: str, height: float, radius: float, least: int) -> DataFrame:
    """The largest radius-connected group of points that stand out from their key's height surface by `height`; passed if it has `least` points and twice the second's."""
    keys = list(keys)
    out = stored(fit_height_surface(points, keys).filter(F.abs("residual") >= height), "standing-out")
    roots = radius_components(out, radius, point_id, keys).hint("merge")
    rows = out.join(roots.withColumnRenamed("node", point_id), point_id, "left").withColumn("component", F.coalesce("root", point_id)).drop("root")
    sizes = rows.groupBy(*keys, "component").agg(F.count(F.lit(1)).alias("size"))
    w = Window.partitionBy(*keys).orderBy(F.desc("size"), "component")
    best = sizes.withColumns({"rank": F.row_number().over(w), "second": F.coalesce(F.lead("size").over(w), F.lit(0))}).filter("rank = 1")
    best = best.withColumn("passed", (F.col("size") >= least) & (F.col("size") >= 2 * F.col("second"))).drop("rank")
    return rows.join(best, [*keys, "component"])


def partition_surface(points: DataFrame, key: str, band: float, step_s: float, step_t: float, least: int) -> DataFrame:
    """points (s, t from 0 to 1) with region, row, col and patch_id; patches of fewer than `least` points go. Later region rules win: root and tip have the corners."""
    s, t = F.col("s"), F.col("t")
    region = F.when(s <= band, "root").when(s >= 1 - band, "tip").when(t <= band, "leading").when(t >= 1 - band, "trailing").otherwise("main")
    out = points.withColumns({"region": region, "row": F.floor(t / step_t).cast("int"), "col": F.floor(s / step_s).cast("int")})
    out = out.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(key, "region", "row", "col"))).filter(F.col("__n") >= least).drop("__n")
    return out.withColumn("patch_id", F.format_string("%s_r%02d_c%02d", "region", "row", "col"))


def adaptive_split(points: DataFrame, keys: Sequence[str], most_curvature: float, least: int, levels: int = 2) -> DataFrame:
    """points with leaf: patches whose p90 of curvature_deg is over the limit are cut at the median of their wider axis (s or t), at most `levels` times."""
    keys = list(keys)
    out = points.withColumn("leaf", F.lit(""))
    for _ in range(levels):
        g = out.groupBy(*keys, "leaf").agg(
            F.count(F.lit(1)).alias("__n"), F.percentile("curvature_deg", 0.9).alias("__c"), F.percentile("s", 0.5).alias("__ms"), F.percentile("t", 0.5).alias("__mt"),
            (F.max("s") - F.min("s") >= F.max("t") - F.min("t")).alias("__wide"),
        )
        out = out.join(g, [*keys, "leaf"])
        high = F.when(F.col("__wide"), F.col("s") > F.col("__ms")).otherwise(F.col("t") > F.col("__mt"))
        cut = (F.col("__c") > most_curvature) & (F.col("__n") >= 2 * least)
        out = stored(out.withColumn("leaf", F.when(cut, F.concat("leaf", F.when(high, "1").otherwise("0"))).otherwise(F.col("leaf"))).drop("__n", "__c", "__ms", "__mt", "__wide"), "split")
    return out


#: The six tetrahedra of a cube about its main diagonal: a path from corner 0 to corner 7 along the axes in each order.
TETRAHEDRA = np.array([(0, 1 << a, 1 << a | 1 << b, 7) for a, b, _ in permutations(range(3))])
CORNERS = np.array([[k & 1, k >> 1 & 1, k >> 2 & 1] for k in range(8)], float)


def tetrahedron_triangles(values: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cube numbers and triangles (n x 3 x 3) where the field changes sign in cubes of corner values (n x 8) at base (n x 3, in voxels)."""
    v = values[:, TETRAHEDRA].reshape(-1, 4)
    p = (base[:, None, None] + CORNERS[TETRAHEDRA][None]).reshape(-1, 4, 3)
    cube = np.repeat(np.arange(len(values)), 6)
    order = np.argsort(v >= 0, axis=1, kind="stable")  # corners inside (negative) first
    v, p = np.take_along_axis(v, order, 1), np.take_along_axis(p, order[..., None], 1)
    inside = (v < 0).sum(1)

    def edge(sel: np.ndarray, i: int, j: int) -> np.ndarray:
        a, b = v[sel, i], v[sel, j]
        return p[sel, i] + (p[sel, j] - p[sel, i]) * (a / (a - b))[:, None]

    made, owner, outward = [], [], []
    for count, faces in ((1, [((0, 1), (0, 2), (0, 3))]), (3, [((0, 3), (1, 3), (2, 3))]), (2, [((0, 2), (0, 3), (1, 3)), ((0, 2), (1, 3), (1, 2))])):
        sel = np.flatnonzero(inside == count)
        out = p[sel, count:].mean(1) - p[sel, :count].mean(1)
        for face in faces:
            made.append(np.stack([edge(sel, i, j) for i, j in face], 1))
            owner.append(cube[sel])
            outward.append(out)
    tri, owners, outs = np.concatenate(made), np.concatenate(owner), np.concatenate(outward)
    normal = np.cross(tri[:, 1] - tri[:, 0], tri[:, 2] - tri[:, 0])
    turn = (normal * outs).sum(1) < 0
    tri[turn] = tri[turn][:, [0, 2, 1]]
    area = np.linalg.norm(normal, axis=1) > 1e-12
    return owners[area], tri[area]


def extract_mesh(tsdf: DataFrame, size: float, least_weight: float) -> DataFrame:
    """side, a, b, c (vertex ids) and the corners ax .. cz of the zero surface of tsdf (side, ix, iy, iz, d, w).

    A cube needs eight corners of enough weight and a change of sign. A vertex id is the hash of its coordinates rounded to 1e-10, so
    triangles of different tasks share vertices.
    """
    known = tsdf.filter(F.col("w") >= least_weight)
    corners = F.array(*(F.struct(*(F.lit(int(v)).alias(f"d{a}") for a, v in zip("xyz", c, strict=True)), F.lit(k).alias("k")) for k, c in enumerate(CORNERS)))
    cubes = known.withColumn("c", F.explode(corners)).groupBy("side", *((F.col(f"i{a}") - F.col(f"c.d{a}")).alias(f"b{a}") for a in "xyz"))
    cubes = cubes.agg(F.count(F.lit(1)).alias("n"), F.min("d").alias("lo"), F.max("d").alias("hi"), *(F.max(F.when(F.col("c.k") == k, F.col("d"))).alias(f"d{k}") for k in range(8)))
    cubes = cubes.filter("n = 8 AND lo < 0 AND hi >= 0").select("side", "bx", "by", "bz", *(f"d{k}" for k in range(8)))
    names = [f"{p}{a}" for p in "abc" for a in "xyz"]

    def triangles(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            owner, tri = tetrahedron_triangles(frame[[f"d{k}" for k in range(8)]].to_numpy(float), frame[["bx", "by", "bz"]].to_numpy(float))
            out = pd.DataFrame((tri.reshape(-1, 9) + 0.5) * size, columns=names)
            out.insert(0, "side", frame["side"].to_numpy()[owner])
            yield out

    kind = dict(tsdf.dtypes)["side"]
    out = cubes.mapInPandas(triangles, f"side {kind}, " + ", ".join(f"{n} double" for n in names))
    vertex = lambda p: F.xxhash64("side", *(F.round(F.col(f"{p}{a}"), 10) + 0.0 for a in "xyz"))
    return out.select("side", *(vertex(p).alias(p) for p in "abc"), *names)


def foreground_select(pixels: DataFrame, jump: float, relative: float, least: int, most_ambiguity: float) -> DataFrame:
    """By view the largest component of depth pixels that doesn't touch the border of the view's pixels: its place and size, the ratio of the second's size, and whether both limits hold."""
    comp = pixel_components(pixels, jump, relative)
    w = Window.partitionBy("view_id")
    edge = (F.col("v") == F.min("v").over(w)) | (F.col("v") == F.max("v").over(w)) | (F.col("u") == F.min("u").over(w)) | (F.col("u") == F.max("u").over(w))
    sizes = comp.withColumn("__edge", edge).groupBy("view_id", "component_v", "component_u").agg(F.count(F.lit(1)).alias("size"), F.max("__edge").alias("border")).filter("NOT border")
    order = w.orderBy(F.desc("size"), "component_v", "component_u")
    best = sizes.withColumns({"rank": F.row_number().over(order), "ambiguity": F.coalesce(F.lead("size").over(order), F.lit(0)) / F.col("size")}).filter("rank = 1")
    return best.withColumn("passed", (F.col("size") >= least) & (F.col("ambiguity") <= most_ambiguity)).drop("rank", "border")


ROTATION = "struct<" + ", ".join(f"q{i}{j}: double" for i in range(3) for j in range(3)) + ">"


def nearest_rotation(rows: list[list[Column]]) -> Column:
    """The rotation nearest to a 3 x 3 sum of rotations."""

    @F.pandas_udf(ROTATION)
    def project(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series, e: pd.Series, f: pd.Series, g: pd.Series, h: pd.Series, i: pd.Series) -> pd.DataFrame:
        m = np.stack([a, b, c, d, e, f, g, h, i], -1).astype(float).reshape(-1, 3, 3)
        u, _, vt = np.linalg.svd(m)
        u[:, :, 2] *= np.sign(np.linalg.det(u @ vt))[:, None]
        return pd.DataFrame((u @ vt).reshape(-1, 9), columns=[f"q{i}{j}" for i in range(3) for j in range(3)])

    return project(*rows[0], *rows[1], *rows[2])


def pose_loop_metrics(poses: DataFrame, key: str) -> DataFrame:
    """By key: poses, RMSE of translation and rotation about the mean pose, largest rotation."""
    mean = poses.groupBy(key).agg(*(F.avg(c).alias("m_" + c) for c in C.POSE))
    q = nearest_rotation([[F.col(f"m_r{i}{j}") for j in range(3)] for i in range(3)])
    mean = mean.withColumn("q", q).select(key, *(F.col("m_" + t).alias("m_" + t) for t in C.TRANSLATION), "q.*")
    j = poses.join(mean, key)
    r, t = C.pose()
    trace = sum((C.dot(r[i], [F.col(f"q{i}{k}") for k in range(3)]) for i in (1, 2)), C.dot(r[0], [F.col(f"q0{k}") for k in range(3)]))
    angle = C.angle_deg((trace - 1) / 2)
    gap = [a - F.col(f"m_{n}") for a, n in zip(t, C.TRANSLATION, strict=True)]
    return j.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(C.dot(gap, gap))).alias("rmse_m"), F.sqrt(F.avg(angle * angle)).alias("rmse_deg"), F.max(angle).alias("most_deg"))


def pose_observability(poses: DataFrame, key: str, order: str) -> DataFrame:
    """By key: the largest rotation and translation between two poses, and axis diversity: the second over the first singular value of the axes of rotations over one degree."""
    same = F.row_number().over(Window.partitionBy(key).orderBy(*C.POSE))
    places = stored(poses.filter(F.col(order).isNotNull()).groupBy(key, *C.POSE).agg(F.count(F.lit(1)).alias("n")).withColumn("place", same), "poses")
    rest = pose_pairs(places, key, "place", ["n"]).withColumn("w", F.col("a_n") * F.col("b_n"))
    # Poses that are alike meet one another, too: their turn is none, but for matrices that are no rotations.
    r, shift = C.pose()
    trace = sum((C.dot(row, row) for row in r[1:]), C.dot(r[0], r[0]))
    again = places.filter("n > 1").select(key, F.col("place").alias("a"), F.col("place").alias("b"), C.norm([x - x for x in shift]).alias("translation"), C.angle_deg((trace - 1) / 2).alias("rotation_deg"), (F.col("n") * (F.col("n") - 1) / 2).cast("long").alias("w"))
    pairs = rest.select(*again.columns).unionByName(again)
    turns = lambda s: places.select(key, F.col("place").alias(s), *(F.col(c).alias(f"{s}_{c}") for c in C.ROTATION)).hint("merge")
    j = pairs.join(turns("a"), [key, "a"]).join(turns("b"), [key, "b"])
    ra, rb = ([[F.col(f"{p}r{i}{k}") for k in range(3)] for i in range(3)] for p in ("a_", "b_"))
    turn = [[C.dot(ra[i], rb[k]) for k in range(3)] for i in range(3)]
    axis = C.normalised([turn[2][1] - turn[1][2], turn[0][2] - turn[2][0], turn[1][0] - turn[0][1]])
    j = j.withColumns({f"x{a}": F.when(F.col("rotation_deg") > 1, c) for a, c in zip("xyz", axis, strict=True)})
    both = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    g = j.groupBy(key).agg(F.max("rotation_deg").alias("most_deg"), F.max("translation").alias("most_m"), *(F.coalesce(F.sum(F.col("w") * F.col(f"x{p}") * F.col(f"x{q}")), F.lit(0.0)).alias(f"g{p}{q}") for p, q in both))
    e = principal_axes(*(F.col(f"g{p}{q}") for p, q in both))
    g = g.withColumn("e", e)
    ratio = F.sqrt(F.coalesce(F.try_divide(F.greatest(F.col("e.e1"), F.lit(0.0)), F.col("e.e0")), F.lit(0.0)))
    return g.select(key, "most_deg", "most_m", ratio.alias("axis_diversity"))
