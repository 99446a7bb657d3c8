"""Proxies: an oriented box around what one camera saw of a two-sided body, its hidden side included by the body's known thickness."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanspark.functions import columns as C
from scanspark.operators.geometry import pca_frame
from scanspark.operators.pixels import voxel_centroids
from scanspark.sources.scratch import stored

#: Reasons, in the order in which they are looked for.
REASONS = ("few_points", "line_like", "camera_on_surface", "grazing")


@dataclass(frozen=True)
class Proxy:
    """size: voxels whose means count. A view whose normal is turned from its camera by more than least_cosine says grazes; where the body's planar extents are known, points that lie
    mad_scale deviations (or least_voxels voxels) behind the median range are left out then, if support of the voxels stays. Margins widen the box."""

    size: float
    thickness: float
    least_cosine: float = 0.3
    least: int = 3
    planar: tuple[float, float] | None = None
    margin: float = 0.0
    visible_margin: float = 0.0
    hidden_margin: float = 0.0
    mad_scale: float = 3.0
    least_voxels: float = 2.0
    support: float = 0.75


def _frames(points: DataFrame, cameras: DataFrame, keys: list[str]) -> DataFrame:
    """pca_frame with cosine (between the third axis and the camera's direction) and away (its distance), the third axis turned to the camera."""
    frame = pca_frame(points, *keys).join(cameras.select(*keys, *C.TRANSLATION), keys)
    to = [F.col(t) - F.col(f"m{a}") for t, a in zip(C.TRANSLATION, "xyz", strict=True)]
    frame = frame.withColumn("__away", C.norm(to)).withColumn("__along", C.dot([F.col(f"a2{a}") for a in "xyz"], to))
    turn = F.when(F.col("__along") < 0, -1.0).otherwise(1.0)
    return frame.withColumns({"cosine": F.coalesce(F.try_divide(F.abs("__along"), F.col("__away")), F.lit(0.0)), "away": F.col("__away"), **{f"a2{a}": F.col(f"a2{a}") * turn for a in "xyz"}}).drop("__away", "__along", *C.TRANSLATION)


def bilateral_proxy(points: DataFrame, cameras: DataFrame, rules: Proxy, keys: Sequence[str]) -> DataFrame:
    """A row for each key: the box's centre and axes as a pose (x the longest axis, z to the camera), extents ex, ey, ez, n, voxels, cosine, frame (plain or robust) and reason (null: none).

    points: keys, x, y, z of one view; cameras: keys, tx, ty, tz. Rows with a null or NaN coordinate don't count. The seen surface lies at the box's +z side; from there it
    reaches thickness and hidden_margin back. Planar extents widen it about its middle, never narrow it. A key with a reason has a box only if that is measurable.
    """
    keys = list(keys)
    whole = points.filter(" AND ".join(f"{a} IS NOT NULL AND NOT isnan({a})" for a in "xyz"))
    counts = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    voxels = stored(voxel_centroids(whole.select(*keys, *"xyz"), rules.size, *keys), "proxy-voxels")
    plain = _frames(voxels, cameras, keys)
    flat = lambda f: f.filter(F.col("e1") > F.greatest(F.col("e0"), F.lit(2.3e-308)) * 1e-10)
    frames = plain.select(*keys, "n", "mx", "my", "mz", "e0", "e1", *(f"a{i}{a}" for i in range(3) for a in "xyz"), "cosine", "away", F.lit("plain").alias("frame"))
    kept = voxels.withColumn("frame", F.lit("plain"))
    if rules.planar:
        grazing = plain.filter(F.col("cosine") < rules.least_cosine).select(*keys)
        reach = lambda rows: rows.join(grazing, keys).join(cameras.select(*keys, *C.TRANSLATION), keys).withColumn("range", C.norm([F.col(a) - F.col(t) for a, t in zip("xyz", C.TRANSLATION, strict=True)]))
        ranges = stored(reach(whole.select(*keys, *"xyz")).select(*keys, "range"), "proxy-ranges")
        middle = ranges.groupBy(*keys).agg(F.percentile("range", 0.5).alias("mid"))
        spread = ranges.join(middle, keys).groupBy(*keys, "mid").agg(F.percentile(F.abs(F.col("range") - F.col("mid")), 0.5).alias("mad"))
        limit = F.col("mid") + F.greatest(rules.mad_scale * 1.4826 * F.col("mad"), F.lit(rules.least_voxels * rules.size))
        near = reach(voxels).join(spread.select(*keys, limit.alias("limit")), keys).filter("range <= limit").select(*keys, *"xyz")
        enough = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("left")).join(voxels.groupBy(*keys).agg(F.count(F.lit(1)).alias("all")), keys)
        near = stored(near.join(enough.filter((F.col("left") >= 3) & (F.col("left") >= F.ceil(rules.support * F.col("all")))).select(*keys), keys), "proxy-near")
        robust = flat(_frames(near, cameras, keys)).filter(F.col("cosine") >= rules.least_cosine)
        robust = stored(robust.select(*keys, "n", "mx", "my", "mz", "e0", "e1", *(f"a{i}{a}" for i in range(3) for a in "xyz"), "cosine", "away", F.lit("robust").alias("frame")), "robust-frames")
        frames = frames.join(robust.select(*keys), keys, "left_anti").unionByName(robust)
        kept = kept.join(robust.select(*keys), keys, "left_anti").select(*keys, *"xyz").unionByName(near.join(robust.select(*keys), keys, "left_semi"))
    frames = stored(frames.withColumnRenamed("n", "voxels"), "proxy-frames")
    major, normal = ([F.col(f"a{i}{a}") for a in "xyz"] for i in (0, 2))
    minor = C.cross(normal, major)
    local = kept.select(*keys, *"xyz").join(frames, keys)
    gap = [F.col(a) - F.col(f"m{a}") for a in "xyz"]
    at = {"p0": C.dot(major, gap), "p1": C.dot(minor, gap), "p2": C.dot(normal, gap)}
    edges = local.withColumns(at).groupBy(*keys).agg(*(f(f"p{i}").alias(f"{n}{i}") for i in range(3) for n, f in (("l", F.min), ("h", F.max))))
    out = frames.join(edges, keys).join(counts, keys)
    for i in (0, 1):
        out = out.withColumns({f"l{i}": F.col(f"l{i}") - rules.margin, f"h{i}": F.col(f"h{i}") + rules.margin})
        if rules.planar:
            half = F.greatest(F.col(f"h{i}") - F.col(f"l{i}"), F.lit(rules.planar[i] + 2 * rules.margin)) / 2
            middle = (F.col(f"l{i}") + F.col(f"h{i}")) / 2
            out = out.withColumns({f"__l{i}": middle - half, f"__h{i}": middle + half}).drop(f"l{i}", f"h{i}").withColumnsRenamed({f"__l{i}": f"l{i}", f"__h{i}": f"h{i}"})
    out = out.withColumns({"l2": F.col("l2") - rules.thickness - rules.hidden_margin, "h2": F.col("h2") + rules.visible_margin})
    out = out.withColumns({f"__y{a}": c for a, c in zip("xyz", minor, strict=True)})
    axes = [[F.col(f"a0{a}") for a in "xyz"], [F.col(f"__y{a}") for a in "xyz"], [F.col(f"a2{a}") for a in "xyz"]]
    middle = [(F.col(f"l{i}") + F.col(f"h{i}")) / 2 for i in range(3)]
    pose = [axes[j][i].alias(f"r{i}{j}") for i in range(3) for j in range(3)]
    pose += [(F.col(f"m{a}") + sum((axes[j][i] * middle[j] for j in (1, 2)), axes[0][i] * middle[0])).alias(t) for i, (a, t) in enumerate(zip("xyz", C.TRANSLATION, strict=True))]
    bad = [(F.col("n") < rules.least) | (F.col("voxels") < 3), F.col("e1") <= F.greatest(F.col("e0"), F.lit(2.3e-308)) * 1e-10, F.col("away") <= 1e-9, F.col("cosine") < rules.least_cosine]
    reason = F.coalesce(*(F.when(b, F.lit(r)) for r, b in zip(REASONS, bad, strict=True)))
    return out.select(*keys, *pose, *((F.col(f"h{i}") - F.col(f"l{i}")).alias(e) for i, e in enumerate(("ex", "ey", "ez"))), "n", "voxels", "cosine", "frame", reason.alias("reason"))
