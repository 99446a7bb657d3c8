"""Registration of clouds to surfaces: point-to-plane steps for all keys at once, with bounds on what is accepted, and fusion of views in order.

A pass moves the points of every open key, joins them to the nearest target points by grid cells, sums up 27 numbers for each key and solves for its step in
the tasks. The driver gets one number a pass: how many keys are still open.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanspark.functions import columns as C
from scanspark.operators.geometry import estimate_normals
from scanspark.operators.joins import nearest_neighbor, start_radius
from scanspark.operators.pixels import voxel_centroids
from scanspark.sources.scratch import stored

SUMS = [f"s{i}" for i in range(27)]
#: What becomes of a correction.
ACCEPTED, FEW, VANISHED, FAR, TURNED, WORSE, ANCHOR = "accepted", "too few pairs", "pairs vanished", "translation over bound", "rotation over bound", "fit not better", "anchor"


@dataclass(frozen=True)
class Registration:
    """radius: how far a pair's points may lie apart. prior pulls steps towards none. A step shorter than still ends a key's passes.

    A correction needs least pairs before and after, may not move or turn by more than the bounds, and may not raise the RMSE by more than a hundredth.
    """

    radius: float
    passes: int = 12
    least: int = 80
    prior: float = 0.0
    most_m: float = 0.02
    most_deg: float = 5.0
    still: float = 1e-8
    worse: float = 1.01


def paired(source: DataFrame, target: DataFrame, state: DataFrame, radius: float, keys: Sequence[str], start: float | None = None) -> DataFrame:
    """keys, point_id, p* (source points moved by their key's pose), n* and r (how far the nearest target's plane lies along its normal) of pairs within radius."""
    keys = list(keys)
    moved = source.select(*keys, "point_id", *"xyz").join(state.select(*keys, *C.POSE), keys)
    moved = moved.select(*keys, "point_id", *(c.alias(a) for a, c in zip("xyz", C.apply_pose(*C.pose(), [F.col(a) for a in "xyz"]), strict=True)))
    moved = stored(moved, "moved-points")
    near = nearest_neighbor(moved, target, radius, "point_id", "target_id", keys, start=start).filter("target_id IS NOT NULL").drop("distance")
    to = target.select(*keys, "target_id", *(F.col(a).alias(f"q{a}") for a in "xyz"), "nx", "ny", "nz")
    at = moved.select(*keys, "point_id", *(F.col(a).alias(f"p{a}") for a in "xyz"))
    out = near.join(at, [*keys, "point_id"]).join(to, [*keys, "target_id"])
    r = C.dot([F.col(f"n{a}") for a in "xyz"], [F.col(f"q{a}") - F.col(f"p{a}") for a in "xyz"])
    return out.withColumn("r", r).select(*keys, "point_id", "px", "py", "pz", "nx", "ny", "nz", "r")


def fit_of(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys, n, rmse and mid (the median size of r) of pairs."""
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(F.col("r") ** 2)).alias("rmse"), F.percentile(F.abs("r"), 0.5).alias("mid"))


def rotation_of(v: np.ndarray) -> np.ndarray:
    """Rotation matrices of rotation vectors (n x 3)."""
    angle = np.linalg.norm(v, axis=1)
    x, y, z = (v / np.maximum(angle, 1e-300)[:, None]).T
    o = np.zeros_like(x)
    k = np.stack([np.stack(row, -1) for row in ((o, -z, y), (z, o, -x), (-y, x, o))], 1)
    s, c = np.sin(angle)[:, None, None], np.cos(angle)[:, None, None]
    out = np.eye(3) + s * k + (1 - c) * (k @ k)
    out[angle < 1e-12] = np.eye(3)
    return out


def solved(frames: Iterable[pd.DataFrame], prior: float) -> Iterator[pd.DataFrame]:
    """Rows of SUMS and a pose with the pose after the step (rotation vector, translation) that they ask for, and its length."""
    for frame in frames:
        s, pose = frame[SUMS].to_numpy(float), frame[list(C.POSE)].to_numpy(float)
        h = np.zeros((len(s), 6, 6))
        i, j = np.triu_indices(6)
        h[:, i, j] = h[:, j, i] = s[:, :21]
        h += prior * np.eye(6)
        step = np.einsum("nij,nj->ni", np.linalg.pinv(h, hermitian=True), s[:, 21:])
        turn = rotation_of(step[:, :3])
        r = turn @ pose[:, :9].reshape(-1, 3, 3)
        t = np.einsum("nij,nj->ni", turn, pose[:, 9:]) + step[:, 3:]
        out = frame.drop(columns=[*SUMS, *C.POSE])
        yield pd.concat([out.reset_index(drop=True), pd.DataFrame(np.hstack([r.reshape(-1, 9), t]), columns=list(C.POSE)), pd.DataFrame({"step": np.linalg.norm(step, axis=1)})], axis=1)


def register(source: DataFrame, target: DataFrame, keys: Sequence[str], rules: Registration) -> DataFrame:
    """A row for each key of source: the pose that takes its points to target's planes, pairs, before and after (RMSE), passes, translation_m, rotation_deg, accepted, reason.

    source: keys, point_id, x, y, z. target: keys, target_id, x, y, z, nx, ny, nz. In a pass each point meets the nearest target within rules.radius; residuals r along its
    normal are weighted by 1 / (1 + (r / 2.5 s) ** 2), s the 1.4826-fold median of their size (1e-6 at least). A key whose pairs become too few, or whose step
    is shorter than rules.still, is done. The pose of a correction that is not accepted is returned, too; what was not measured is null. Every pass is stored.
    """
    keys = list(keys)
    kinds = dict(source.dtypes)
    same = [F.lit(1.0 if i == j else 0.0).alias(f"r{i}{j}") for i in range(3) for j in range(3)] + [F.lit(0.0).alias(t) for t in C.TRANSLATION]
    none = F.lit(None).cast("double")
    state = source.select(*keys).distinct().select(*keys, *same, none.alias("before"), F.lit(0).cast("long").alias("pairs"), F.lit(0).alias("passes"), F.lit(None).cast("string").alias("reason"), F.lit(True).alias("open"))
    state = stored(state, "registration")
    names = state.columns
    start = start_radius(target, rules.radius, keys)
    for _ in range(rules.passes):
        still_open = state.filter("open")
        pairs = stored(paired(source, target, still_open, rules.radius, keys, start), "pairs")
        fit = fit_of(pairs, keys)
        enough = F.coalesce("n", F.lit(0)) >= rules.least
        seen = still_open.join(fit, keys, "left").withColumns({"pairs": F.coalesce("n", F.lit(0)).cast("long"), "before": F.when(enough, F.coalesce("before", "rmse")).otherwise(F.col("before"))})
        seen = stored(seen.drop("n", "rmse"), "registration-fit")
        few = seen.filter(F.col("pairs") < rules.least).withColumns({"reason": F.lit(FEW), "open": F.lit(False)}).select(*names)
        scale = 2.5 * F.greatest(1.4826 * F.col("mid"), F.lit(1e-6))
        rows = pairs.join(seen.filter(F.col("pairs") >= rules.least).select(*keys, "mid"), keys)
        w = 1 / (1 + (F.col("r") / scale) ** 2)
        p, n = [F.col(f"p{a}") for a in "xyz"], [F.col(f"n{a}") for a in "xyz"]
        row = [*C.cross(p, n), *n]
        sums = [F.sum(w * row[a] * row[b]) for a in range(6) for b in range(a, 6)] + [F.sum(w * row[a] * F.col("r")) for a in range(6)]
        sums = rows.groupBy(*keys).agg(*(c.alias(s) for c, s in zip(sums, SUMS, strict=True)))
        rest = [*keys, "before", "pairs", "passes"]
        schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "before double, pairs long, passes int", *(f"{c} double" for c in C.POSE), "step double"])
        moved = seen.select(*rest, *C.POSE).join(sums, keys).select(*rest, *SUMS, *C.POSE).mapInPandas(lambda frames: solved(frames, rules.prior), schema)
        # A step as good as none is not made.
        moved = moved.join(seen.select(*keys, *(F.col(c).alias(f"__{c}") for c in C.POSE)), keys)
        go = F.col("step") >= rules.still
        moved = moved.select(*keys, *(F.when(go, F.col(c)).otherwise(F.col(f"__{c}")).alias(c) for c in C.POSE), "before", "pairs", (F.col("passes") + go.cast("int")).alias("passes"), F.lit(None).cast("string").alias("reason"), go.alias("open"))
        state = stored(state.filter("NOT open").unionByName(few).unionByName(moved), "registration")
        if state.filter("open").isEmpty():
            break
    tried = state.filter("reason IS NULL")
    after = fit_of(paired(source, target, tried, rules.radius, keys, start), keys).select(*keys, "n", F.col("rmse").alias("after"))
    out = state.join(after, keys, "left")
    r, t = C.pose()
    last = F.when(F.col("reason").isNull(), F.coalesce("n", F.lit(0))).otherwise(F.col("pairs"))
    out = out.withColumns({"pairs": last.cast("long"), "after": F.when(last >= rules.least, F.col("after")), "translation_m": C.norm(t), "rotation_deg": C.rotation_angle_deg(r)})
    reason = (
        F.when(F.col("reason").isNotNull(), F.col("reason"))
        .when(F.col("pairs") < rules.least, VANISHED)
        .when(F.col("translation_m") > rules.most_m, FAR)
        .when(F.col("rotation_deg") > rules.most_deg, TURNED)
        .when(F.col("after") > F.col("before") * rules.worse, WORSE)
        .otherwise(ACCEPTED)
    )
    out = out.withColumn("reason", reason).withColumn("accepted", F.col("reason") == ACCEPTED)
    return out.select(*keys, *C.POSE, "pairs", "before", "after", "passes", "translation_m", "rotation_deg", "accepted", "reason")


def camera_sides(points: DataFrame, views: DataFrame, keys: Sequence[str]) -> DataFrame:
    """views (keys, view_id, seq, tx, ty, tz) with side (1 or -1) and h*, the normal of the thinnest axis of the key's points, turned to the camera of its first view.

    A view is on side 1 if its camera lies on that side of the centroid. seq orders a key's views; of equals the smaller view_id comes first.
    """
    from scanspark.operators.geometry import pca_frame

    keys = list(keys)
    frame = pca_frame(points, *keys).select(*keys, "mx", "my", "mz", *(F.col(f"a2{a}").alias(f"h{a}") for a in "xyz"))
    rows = views.select(*keys, "view_id", "seq", *C.TRANSLATION).join(frame, keys)
    over = C.dot([F.col(f"t{a}") - F.col(f"m{a}") for a in "xyz"], [F.col(f"h{a}") for a in "xyz"])
    first = F.first("__over").over(Window.partitionBy(*keys).orderBy("seq", "view_id"))
    rows = rows.withColumn("__over", over).withColumn("__turn", F.when(first < 0, -1.0).otherwise(1.0))
    side = F.when(F.col("__over") * F.col("__turn") >= 0, 1).otherwise(-1)
    return rows.select(*keys, "view_id", "seq", side.alias("side"), *((F.col(f"h{a}") * F.col("__turn")).alias(f"h{a}") for a in "xyz"))


def fuse_registered(points: DataFrame, views: DataFrame, size: float, rules: Registration, keys: Sequence[str], neighbours: int = 12) -> tuple[DataFrame, DataFrame]:
    """(map, corrections): the fused points (keys, side, ix, iy, iz, x, y, z, n) and what became of each view (keys, side, view_id, the columns of register).

    points: keys, view_id, x, y, z, in one frame already. views: keys, view_id, seq and the camera's place tx, ty, tz. The first view of a side (see camera_sides) is its
    map; each later one, as voxel means, is registered to the map so far (normals of `neighbours` map points, turned to the side) and joins it, corrected if that is
    accepted. The k-th views of all sides and keys are done together, so there are as many rounds as a side has views at most.
    """
    keys = list(keys)
    on = [*keys, "side"]
    sided = camera_sides(points, views, keys)
    order = F.row_number().over(Window.partitionBy(*on).orderBy("seq", "view_id"))
    sided = stored(sided.withColumn("turn", order), "view-turns")
    own = voxel_centroids(points.select(*keys, "view_id", *"xyz"), size, *keys, "view_id").drop("n")
    own = stored(own.join(sided.select(*on, "view_id", "turn", "hx", "hy", "hz"), [*keys, "view_id"]), "view-voxels")
    fused = stored(own.filter("turn = 1").select(*on, *"xyz", "hx", "hy", "hz"), "side-map")
    same = [F.lit(1.0 if i == j else 0.0).alias(f"r{i}{j}") for i in range(3) for j in range(3)] + [F.lit(0.0).alias(t) for t in C.TRANSLATION]
    count = own.filter("turn = 1").groupBy(*on, "view_id").agg(F.count(F.lit(1)).alias("pairs"))
    zero = F.lit(0.0)
    told = count.select(*on, "view_id", *same, "pairs", zero.alias("before"), zero.alias("after"), F.lit(0).alias("passes"), zero.alias("translation_m"), zero.alias("rotation_deg"), F.lit(True).alias("accepted"), F.lit(ANCHOR).alias("reason"))
    turns = sided.agg(F.max("turn")).first()[0] or 0
    for turn in range(2, turns + 1):
        now = own.filter(F.col("turn") == turn)
        here = now.select(*on).distinct()
        target = stored(fused.join(here, on, "left_semi").withColumn("target_id", F.xxhash64(*on, *"xyz")), "side-target")
        facing = _facing(target, neighbours, on)
        source = now.withColumn("point_id", F.xxhash64(*on, "ix", "iy", "iz")).select(*on, "point_id", *"xyz")
        done = stored(register(source, facing, on, rules), "corrections")
        moved = now.select(*on, *"xyz", "hx", "hy", "hz").join(done.filter("accepted").select(*on, *C.POSE), on, "left")
        new = C.apply_pose(*C.pose(), [F.col(a) for a in "xyz"])
        moved = moved.select(*on, *(F.coalesce(c, F.col(a)).alias(a) for a, c in zip("xyz", new, strict=True)), "hx", "hy", "hz")
        both = fused.unionByName(moved)
        whole = both.join(here, on, "left_semi")
        hint = whole.groupBy(*on).agg(*(F.first(f"h{a}").alias(f"h{a}") for a in "xyz"))
        whole = voxel_centroids(whole.drop("hx", "hy", "hz"), size, *on).select(*on, *"xyz").join(hint, on)
        fused = stored(both.join(here, on, "left_anti").unionByName(whole), "side-map")
        told = told.unionByName(done.join(now.select(*on, "view_id").distinct(), on).select(*told.columns))
    out = voxel_centroids(fused.select(*on, *"xyz"), size, *on)
    return out, stored(told, "corrections-told")


def _facing(target: DataFrame, neighbours: int, on: list[str]) -> DataFrame:
    """target with normals of its nearest points, turned to h* on side 1 and against it on side -1. A map of one point has none."""
    normals = estimate_normals(target, neighbours, 1e-3, (0.0, 0.0, 1.0), "target_id", on).withColumnRenamed("point_id", "target_id")
    rows = target.join(normals, [*on, "target_id"])
    along: Column = C.dot([F.col(f"n{a}") for a in "xyz"], [F.col(f"h{a}") for a in "xyz"]) * F.col("side")
    sign = F.when(along < 0, -1.0).otherwise(1.0)
    return rows.select(*on, "target_id", *"xyz", *((F.col(f"n{a}") * sign).alias(f"n{a}") for a in "xyz"))
