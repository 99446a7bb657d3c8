"""Fine view plans: each patch of a surface gets the nearest allowed camera distance from which enough of it is seen.

All patches and trial distances are rendered at once. A trial camera meets the points in the grid cells of the box that holds it and its
patch; only points in that box can stand between the two, so a patch costs what lies before it, not the whole surface. Patches that no
distance suits are cut in two and tried again, all of a level together.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanspark.functions import columns as C
from scanspark.operators.geometry import oriented_box
from scanspark.sources.scratch import stored

#: Regions whose patches are tried from near to far (fixed values).
DETAIL_REGIONS = ("leading_edge", "trailing_edge", "root", "tip", "fin_root", "fin_free_edge")
#: Names of the orders in which distances are tried (fixed values).
NEAR_FIRST, BASELINE_FIRST, FIXED = "adaptive_near_detail", "adaptive_nearest_baseline", "fixed_baseline"
#: Pixels by which a ray may leave the box of a camera and its patch, at most.
SLACK_PX = 4


@dataclass(frozen=True)
class Camera:
    """A pinhole camera, with Brown-Conrady coefficients k1..k6 and p1, p2."""

    width: int
    height: int
    fx: float
    fy: float
    cx: float
    cy: float
    radial: Sequence[float] = ()
    tangential: Sequence[float] = (0.0, 0.0)


@dataclass(frozen=True)
class ViewLimits:
    """low and high make the distance adaptive, in steps from low, and bound the depth of what counts; without them there is one distance, the baseline.

    margin_px and utilization cut the image down to the part that counts; projection and visibility are the shares of a patch's points that must fall
    into it, and be seen there (occlusion_m: by so much a point may lie behind the nearest of its pixel).
    """

    baseline: float
    low: float | None = None
    high: float | None = None
    step: float = 0.01
    margin_px: float = 0.0
    utilization: float = 1.0
    projection: float = 0.9
    visibility: float = 0.9
    occlusion_m: float = 0.002
    curvature_deg: float = 30.0
    splits: int = 2

    def distances(self) -> list[float]:
        """low, low + step .. up to high, and the baseline and high themselves; 10,000 steps at most."""
        if self.low is None or self.high is None:
            return [self.baseline]
        count = math.floor((self.high - self.low) / self.step) + 1
        if count > 10_000:
            raise ValueError("more than 10,000 trial distances")
        tried = [self.low + i * self.step for i in range(count)] + [self.low, self.baseline, self.high]
        return sorted({round(d, 12) for d in tried if self.low <= d <= self.high})

    def window(self, camera: Camera) -> tuple[float, float, float, float]:
        """The least and largest u, then v, of the part of the image that counts."""
        out = []
        for size in (camera.width - 1.0, camera.height - 1.0):
            usable = size - 2 * self.margin_px
            if usable <= 0:
                raise ValueError("the margin leaves nothing of the image")
            inset = (usable - usable * self.utilization) / 2
            out += [self.margin_px + inset, self.margin_px + usable - inset]
        return tuple(out)


def fine_camera(patches: DataFrame) -> DataFrame:
    """patches (m*: normal, g* and h*: the surface's first two axes) with the rotation r00 .. r22 of a camera that looks against the normal, its x along g as far as
    that is across the view (else along h)."""
    column = lambda p: [F.col(f"{p}{a}") for a in "xyz"]
    named = lambda p, v: {f"{p}{a}": c for a, c in zip("xyz", v, strict=True)}
    m, g, h = map(column, "mgh")
    out = patches.withColumns(named("__z", [-c for c in m]))
    z = column("__z")
    out = out.withColumns({"__g": C.dot(g, z), "__h": C.dot(h, z)})
    out = out.withColumns(named("__g", [a - c * F.col("__g") for a, c in zip(g, z, strict=True)]) | named("__h", [a - c * F.col("__h") for a, c in zip(h, z, strict=True)]))
    out = out.withColumn("__flat", C.norm(column("__g")) < 1e-8)
    out = out.withColumns(named("__v", [F.when(F.col("__flat"), o).otherwise(f) for f, o in zip(column("__g"), column("__h"), strict=True)]))
    out = out.withColumn("__n", C.norm(column("__v"))).withColumns(named("__x", [F.try_divide(c, F.col("__n")) for c in column("__v")]))
    out = out.withColumns(named("__y", C.cross(z, column("__x"))))
    out = out.withColumn("__n", C.norm(column("__y"))).withColumns(named("__y", [F.try_divide(c, F.col("__n")) for c in column("__y")]))
    out = out.withColumns(named("__x", C.cross(column("__y"), z)))
    rows = zip(column("__x"), column("__y"), z, strict=True)
    return out.withColumns({f"r{i}{j}": c for i, row in enumerate(rows) for j, c in enumerate(row)}).select(*patches.columns, *C.ROTATION)


def trial_cameras(patches: DataFrame, distances: Sequence[float]) -> DataFrame:
    """patches (c*: centre, and what fine_camera needs) with distance and the pose of the camera, for each distance."""
    out = stored(fine_camera(patches), "patch-cameras").withColumn("distance", F.explode(F.array(*map(F.lit, distances))))
    at = {t: F.col(f"c{a}") + F.col(f"m{a}") * F.col("distance") for t, a in zip(C.TRANSLATION, "xyz", strict=True)}
    return out.withColumns(at)


def projected(local: np.ndarray, camera: Camera) -> tuple[np.ndarray, np.ndarray]:
    """u and v of points in front of the camera (n x 3 in its frame, z > 0). The radial denominator is 1e-12 at least."""
    x, y = local[:, 0] / local[:, 2], local[:, 1] / local[:, 2]
    r2 = x * x + y * y
    k, p = [*camera.radial, *[0.0] * (6 - len(camera.radial))], camera.tangential
    radial = (1 + r2 * (k[0] + r2 * (k[1] + r2 * k[2]))) / np.maximum(1 + r2 * (k[3] + r2 * (k[4] + r2 * k[5])), 1e-12)
    u = x * radial + 2 * p[0] * x * y + p[1] * (r2 + 2 * x * x)
    v = y * radial + p[0] * (r2 + 2 * y * y) + 2 * p[1] * x * y
    return camera.fx * u + camera.cx, camera.fy * v + camera.cy


def seen(rows: DataFrame, trial: Sequence[str], camera: Camera, window: tuple[float, float, float, float] | None = None, depths: tuple[float, float] = (0.0, math.inf)) -> DataFrame:
    """trial, v, u (whole pixels), z and counts of the rows (trial, x, y, z and a pose): those on the image, or, with a window, all.

    counts: whether the row falls on the image and, with a window, into that and the depths. A row off the image has no pixel.
    """
    names = [*trial, "v", "u", "z", "counts"]

    def made(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in frames:
            n = len(trial)
            p, t = (np.stack([c.to_numpy(zero_copy_only=False) for c in frame.columns[i : i + 3]], 1).astype(float) for i in (n, n + 12))
            r = np.stack([c.to_numpy(zero_copy_only=False) for c in frame.columns[n + 3 : n + 12]], 1).astype(float).reshape(-1, 3, 3)
            local = np.einsum("ni,nij->nj", p - t, r)
            z = local[:, 2]
            u, v = projected(np.where((z > 0)[:, None], local, 1.0), camera)
            drawn = (z > 0) & (u >= 0) & (u < camera.width) & (v >= 0) & (v < camera.height)
            row, col = (np.floor(np.where(drawn, c, 0)).astype(np.int64) for c in (v, u))
            if window is None:
                keep, counts = np.flatnonzero(drawn), drawn
            else:
                u0, u1, v0, v1 = window
                keep, counts = np.arange(len(z)), drawn & (z >= depths[0]) & (z <= depths[1]) & (u >= u0) & (u <= u1) & (v >= v0) & (v <= v1)
            off = pa.array(~drawn[keep])
            at = pa.array(keep)
            pixels = [pa.array(c[keep], mask=off.to_numpy(zero_copy_only=False)) for c in (row, col)]
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in frame.columns[:n]), *pixels, pa.array(z[keep]), pa.array(counts[keep])], names)

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in trial), "v long, u long, z double, counts boolean"])
    return rows.select(*trial, *"xyz", *C.POSE).mapInArrow(made, schema)


def trial_shares(points: DataFrame, trials: DataFrame, camera: Camera, limits: ViewLimits, keys: Sequence[str], patch: str = "patch_id", surface: DataFrame | None = None, cell: float | None = None) -> DataFrame:
    """keys, patch, distance, n, projection, visibility of each trial (see trial_cameras): the shares of the patch's points that fall into the image's window, and are seen.

    points: keys, patch, x, y, z. The points of surface (keys, x, y, z; those of points by default) hide what is behind them. Trials go to the cells of a grid that their
    box touches (edge `cell`; half the largest distance), points of the surface to theirs, and they meet by equality. A patch without points has no row.
    """
    keys = list(keys)
    trial = [*keys, patch, "distance"]
    near, far = (limits.low, limits.high) if limits.low is not None and limits.high is not None else (0.0, math.inf)
    reach = max(limits.distances()[-1], limits.baseline)
    cell = cell or reach / 2
    slack = SLACK_PX / min(camera.fx, camera.fy) * 2 * reach

    bounds = points.groupBy(*keys, patch).agg(*(f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    boxes = trials.select(*trial, *C.POSE).join(bounds, [*keys, patch])
    for a in "xyz":
        low, high = F.least(f"lo{a}", f"t{a}") - slack, F.greatest(f"hi{a}", f"t{a}") + slack
        boxes = boxes.withColumn(f"__c{a}", F.explode(F.sequence(C.voxel(low, cell), C.voxel(high, cell))))
    own = (points if surface is None else surface).select(*keys, *"xyz", *(C.voxel(F.col(a), cell).alias(f"__c{a}") for a in "xyz"))
    met = own.join(boxes.select(*trial, *C.POSE, *(f"__c{a}" for a in "xyz")), [*keys, *(f"__c{a}" for a in "xyz")])
    front = seen(met, trial, camera).groupBy(*trial, "v", "u").agg(F.min("z").alias("front"))
    target = points.select(*keys, patch, *"xyz").join(trials.select(*trial, *C.POSE), [*keys, patch])
    target = seen(target, trial, camera, limits.window(camera), (near, far)).join(front, [*trial, "v", "u"], "left")
    visible = F.col("counts") & F.coalesce(F.col("z") <= F.col("front") + limits.occlusion_m, F.lit(False))
    share = lambda c: F.avg(c.cast("double"))
    return target.groupBy(*trial).agg(F.count(F.lit(1)).alias("n"), share(F.col("counts")).alias("projection"), share(visible).alias("visibility"))


def choose_distance(shares: DataFrame, patches: DataFrame, limits: ViewLimits, keys: Sequence[str], patch: str = "patch_id") -> DataFrame:
    """patches with policy, distance (null: none suits), its projection and visibility, and the best of each over all distances.

    patches: region and curvature_deg. Detail regions and curved patches take the nearest distance that suits, others the nearest to the baseline; of two as
    near the smaller. Shares may fall short by 1e-12.
    """
    on = [*keys, patch]
    detail = F.col("region").isin(*DETAIL_REGIONS) | (F.coalesce("curvature_deg", F.lit(0.0)) > limits.curvature_deg)
    adaptive = limits.low is not None and limits.high is not None
    policy = F.when(detail, NEAR_FIRST).otherwise(BASELINE_FIRST) if adaptive else F.lit(FIXED)
    own = patches.withColumns({"policy": policy, "__near": F.coalesce(detail, F.lit(False))})
    rows = shares.join(own.select(*on, "__near"), on)
    order = F.when(F.col("__near"), F.col("distance")).otherwise(F.abs(F.col("distance") - limits.baseline))
    good = (F.col("projection") + 1e-12 >= limits.projection) & (F.col("visibility") + 1e-12 >= limits.visibility)
    best = rows.groupBy(*on).agg(
        F.min(F.when(good, F.struct(order.alias("order"), "distance", "projection", "visibility"))).alias("of"),
        F.max("projection").alias("best_projection"),
        F.max("visibility").alias("best_visibility"),
        F.max("n").alias("n"),
    )
    return own.drop("__near").join(best.select(*on, "n", "of.distance", "of.projection", "of.visibility", "best_projection", "best_visibility"), on)


def patch_frames(points: DataFrame, patches: DataFrame, keys: Sequence[str], patch: str = "patch_id") -> DataFrame:
    """patches with c*, the centre of the oriented box of their points, and curvature_deg, the p90 of the angles between the points' normals and m*."""
    on = [*keys, patch]
    box = oriented_box(points.select(*on, *"xyz"), *on)
    middle = [(F.col(f"l{i}") + F.col(f"h{i}")) / 2 for i in range(3)]
    centre = [(F.col(f"m{a}") + sum((F.col(f"a{i}{a}") * middle[i] for i in (1, 2)), F.col(f"a0{a}") * middle[0])).alias(f"c{a}") for a in "xyz"]
    box = box.select(*on, *centre)
    own = points.select(*on, "nx", "ny", "nz").join(patches.select(*on, "mx", "my", "mz"), on)
    angle = C.angle_deg(C.dot([F.col(f"n{a}") for a in "xyz"], [F.col(f"m{a}") for a in "xyz"]))
    bent = own.groupBy(*on).agg(F.percentile(angle, 0.9).alias("curvature_deg"))
    return patches.drop("cx", "cy", "cz", "curvature_deg").join(box, on).join(bent, on)


def split_patches(points: DataFrame, failed: DataFrame, keys: Sequence[str], patch: str = "patch_id", least: int = 6) -> DataFrame:
    """points of failed patches with the patch cut at the median of its wider section coordinate (s or t; s of equals): `_v0` up to it, `_v1` beyond.

    A patch of fewer than twice `least` points, or with fewer than `least` on a side, is left out.
    """
    on = [*keys, patch]
    own = points.join(failed.select(*on), on)
    wide = F.max("s") - F.min("s") >= F.max("t") - F.min("t")
    cut = own.groupBy(*on).agg(F.count(F.lit(1)).alias("__n"), wide.alias("__wide"), F.percentile("s", 0.5).alias("__s"), F.percentile("t", 0.5).alias("__t"))
    own = own.join(cut, on).withColumn("__high", F.when(F.col("__wide"), F.col("s") > F.col("__s")).otherwise(F.col("t") > F.col("__t")))
    high = F.sum(F.col("__high").cast("long"))
    enough = own.groupBy(*on).agg(F.least(high, F.count(F.lit(1)) - high).alias("__side"), F.max("__n").alias("__all")).filter((F.col("__side") >= least) & (F.col("__all") >= 2 * least))
    own = own.join(enough.select(*on), on)
    child = F.concat(F.col(patch).cast("string"), F.when(F.col("__high"), "_v1").otherwise("_v0"))
    return own.withColumns({"parent": F.col(patch), patch: child}).select(*points.columns, "parent")


def fine_view_plan(points: DataFrame, patches: DataFrame, camera: Camera, limits: ViewLimits, keys: Sequence[str], footprint: tuple[float, float] = (0.0, 0.0), cell: float | None = None) -> DataFrame:
    """A row for each patch that is planned or has no view: keys, patch_id, root_id (the patch it was cut from), level, status (planned, infeasible), policy, n, distance,
    projection, visibility, best_projection, best_visibility, footprint_u, footprint_v (the footprint at the baseline, in proportion) and the camera's pose.

    points: keys, patch_id, x, y, z, nx, ny, nz, s, t (section coordinates). patches: keys, patch_id (a string), region, m* (main normal), g* and h* (the
    first two axes of the surface). A patch that no distance suits is cut in two, as often as limits.splits says; what cannot be cut is infeasible. Children keep
    region, normal and axes of their parent. Patches without points have no row. Every level is stored; there is no loop over patches.
    """
    keys = list(keys)
    on = [*keys, "patch_id"]
    surface = points.select(*keys, *"xyz")
    own, frames = points, patches.withColumn("root_id", F.col("patch_id"))
    found = None
    for level in range(limits.splits + 1):
        framed = stored(patch_frames(own, frames, keys), "patch-frames")
        trials = stored(trial_cameras(framed, limits.distances()), "trial-cameras")
        shares = trial_shares(own, trials, camera, limits, keys, surface=surface, cell=cell)
        chosen = stored(choose_distance(shares, framed, limits, keys).withColumn("level", F.lit(level)), "chosen-distances")
        failed = chosen.filter("distance IS NULL")
        if level == limits.splits or failed.isEmpty():
            found = chosen if found is None else found.unionByName(chosen)
            break
        cut = stored(split_patches(own, failed, keys), "split-patches")
        parents = cut.select(*keys, F.col("parent").alias("patch_id")).distinct()
        closed = chosen.join(parents, on, "left_anti")
        found = closed if found is None else found.unionByName(closed)
        children = cut.select(*keys, "parent", "patch_id").distinct().withColumnRenamed("patch_id", "__child")
        frames = failed.select(*keys, F.col("patch_id").alias("parent"), "root_id", "region", *(f"{p}{a}" for p in "mgh" for a in "xyz")).join(children, [*keys, "parent"])
        frames = frames.withColumnRenamed("__child", "patch_id").drop("parent")
        own = cut.drop("parent")
        if cut.isEmpty():
            break
    found = fine_camera(found)
    planned = F.col("distance").isNotNull()
    at = [F.when(planned, F.col(f"c{a}") + F.col(f"m{a}") * F.col("distance")).alias(t) for t, a in zip(C.TRANSLATION, "xyz", strict=True)]
    pose = [*(F.when(planned, F.col(c)).alias(c) for c in C.ROTATION), *at]
    scale = F.col("distance") / limits.baseline
    return found.select(
        *keys, "patch_id", "root_id", "level", F.when(planned, "planned").otherwise("infeasible").alias("status"), "policy", "region", "curvature_deg", "n", "distance", "projection", "visibility",
        "best_projection", "best_visibility", (scale * footprint[0]).alias("footprint_u"), (scale * footprint[1]).alias("footprint_v"), *pose,
    )
