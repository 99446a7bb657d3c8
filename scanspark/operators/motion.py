"""Motion of recorded traces: how far a robot's states lie apart, over all pairs, without making all pairs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanspark.functions import columns as C
from scanspark.sources.scratch import stored

#: Half of the directions to the faces, edges and corners of a cube.
DIRECTIONS = [d for d in product((-1, 0, 1), repeat=3) if d > (0, 0, 0)]
Metric = Callable[[Callable[[str], Column], Callable[[str], Column]], Column]


def straight(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """The distance of two rows' x, y, z."""
    gap = [a(c) - b(c) for c in "xyz"]
    return C.norm(gap)


def turned(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """The angle in radians between two rows' rotations r00 .. r22."""
    trace = sum((a(c) * b(c) for c in C.ROTATION[1:]), a(C.ROTATION[0]) * b(C.ROTATION[0]))
    return F.acos(C.clip((trace - 1) / 2, -1.0, 1.0))


def rotation_vector(r: list[list[Column]]) -> list[Column]:
    """Axis times angle. At half a turn the axis comes from the diagonal."""
    angle = F.acos(C.clip((r[0][0] + r[1][1] + r[2][2] - 1) / 2, -1.0, 1.0))
    sine = F.sin(angle)
    skew = [r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]]
    near = [F.when(F.abs(sine) < 1e-7, 0.5).otherwise(angle / (2 * sine)) * s for s in skew]
    size = [F.sqrt(F.greatest((r[i][i] + 1) / 2, F.lit(0.0))) for i in range(3)]
    largest = F.greatest(*size)
    sign = lambda i, j: F.when(r[i][j] + r[j][i] < 0, -1.0).otherwise(1.0)
    axes = [[size[j] * (F.lit(1.0) if i == j else sign(i, j)) for j in range(3)] for i in range(3)]
    half = [F.when(size[0] == largest, axes[0][j]).when(size[1] == largest, axes[1][j]).otherwise(axes[2][j]) * angle for j in range(3)]
    return [F.when((angle > 1) & (F.abs(sine) < 1e-7), h).otherwise(n) for h, n in zip(half, near, strict=True)]


def farthest(rows: DataFrame, keys: Sequence[str], metric: Metric = straight, carried: Sequence[str] = (), parts: int = 8) -> DataFrame:
    """keys, farthest: the largest metric between two rows of a key; 0 where it has one.

    rows: keys, x, y, z, and the columns carried that the metric reads. No two rows may have a metric above the distance of their x, y, z; the angle between
    two rotations is none above that of their rotation vectors.
    The outermost rows along 13 directions give a lower bound. Rows go to the cells of a grid whose edge is a share (1 / parts) of the
    largest extent, and only pairs of cells that could hold a larger metric are joined, so the work is that of the rows on opposite sides. A key has
    (parts + 1) ** 3 cells at most.
    """
    keys = list(keys)
    names = [*dict.fromkeys([*"xyz", *carried])]
    rows = stored(rows.select(*keys, *names).distinct(), "states")
    along = {str(i): F.col("x") * d[0] + F.col("y") * d[1] + F.col("z") * d[2] for i, d in enumerate(DIRECTIONS)}
    whole = F.struct(*names)
    ends = rows.groupBy(*keys).agg(F.array(*(f(whole, c) for c in along.values() for f in (F.min_by, F.max_by))).alias("ends"), *(F.min(a).alias(f"l{a}") for a in "xyz"), F.greatest(*(F.max(a) - F.min(a) for a in "xyz")).alias("extent"))
    ends = stored(ends, "outermost")
    side = lambda s: lambda c: F.col(s)[c]
    one = ends.select(*keys, F.explode("ends").alias("a"), "ends").select(*keys, "a", F.explode("ends").alias("b"))
    bound = one.groupBy(*keys).agg(F.max(metric(side("a"), side("b"))).alias("bound"))
    at = ends.select(*keys, "lx", "ly", "lz", "extent").join(bound, keys)
    cell = [F.when(F.col("extent") > 0, F.floor((F.col(a) - F.col(f"l{a}")) / (F.col("extent") / parts))).otherwise(0).cast("int").alias(f"c{a}") for a in "xyz"]
    placed = rows.join(at, keys).select(*keys, *names, "bound", *cell)
    place = ["cx", "cy", "cz"]
    cells = stored(placed.groupBy(*keys, *place).agg(F.max("bound").alias("bound"), *(f(a).alias(f"{n}{a}") for a in "xyz" for n, f in (("l", F.min), ("h", F.max)))), "cells")
    other = cells.drop("bound").withColumnsRenamed({c: f"o{c}" for c in cells.columns if c not in (*keys, "bound")})
    reach = [F.greatest(F.col(f"h{a}") - F.col(f"ol{a}"), F.col(f"oh{a}") - F.col(f"l{a}"), F.lit(0.0)) for a in "xyz"]
    order = F.struct(*place) <= F.struct(*(f"o{c}" for c in place))
    pairs = stored(cells.join(other, keys).filter(order & (C.norm(reach) > F.col("bound"))).select(*keys, *place, *(f"o{c}" for c in place)), "cell-pairs")
    left = pairs.join(placed.select(*keys, *place, whole.alias("a")), [*keys, *place])
    right = placed.select(*keys, *(F.col(c).alias(f"o{c}") for c in place), whole.alias("b"))
    met = left.join(right, [*keys, *(f"o{c}" for c in place)]).groupBy(*keys).agg(F.max(metric(side("a"), side("b"))).alias("met"))
    out = bound.join(met, keys, "left")
    return out.select(*keys, F.greatest("bound", "met").alias("farthest"))


def stationary_trace(states: DataFrame, key: str, most_joint: float, most_m: float, most_rad: float, most_gap_s: float, joints: int = 6) -> DataFrame:
    """A row for each trace of states (key, seq, host_ns, ctrl_s, q: an array of joint angles, r00 .. tz): whether it stood still.

    The state of the smallest seq is the reference. samples, distinct (states of different q or pose), duration_s, controller_s (last less first), gap_s (the longest
    step of either clock), frozen_s (the longest time in which the controller's clock stood), joint, translation, rotation: the largest difference of any two
    states, in a joint, in place and in radians. reasons, in order: too_few (under three states), clock_back (a clock goes back), gap, frozen (over most_gap_s), joint,
    translation, rotation (over their limit). passed: no reason. A joint's largest difference is its range; those of poses come from distinct states by `farthest`.
    Null poses or joints are no states. seq orders a trace and is unique in it.
    """
    states = states.filter(F.col("q").isNotNull() & F.col("tx").isNotNull())
    w = Window.partitionBy(key).orderBy("seq")
    host, ctrl = F.col("host_ns") / 1e9, F.col("ctrl_s")
    step_h, step_c = host - F.lag(host).over(w), ctrl - F.lag(ctrl).over(w)
    # The host time at which the controller's clock last moved.
    moved = F.last(F.when(F.coalesce(step_c > 0, F.lit(True)), host), ignorenulls=True).over(w)
    rows = states.select("*", step_h.alias("__h"), step_c.alias("__c"), (host - moved).alias("__f"))
    first = lambda c: F.min_by(c, "seq")
    last = lambda c: F.max_by(c, "seq")
    joint = [F.max(F.get("q", F.lit(i))) - F.min(F.get("q", F.lit(i))) for i in range(joints)]
    told = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("samples"),
        ((last("host_ns") - first("host_ns")) / 1e9).alias("duration_s"),
        (last("ctrl_s") - first("ctrl_s")).alias("controller_s"),
        F.coalesce(F.max(F.greatest("__h", "__c")), F.lit(0.0)).alias("gap_s"),
        F.max("__f").alias("frozen_s"),
        F.coalesce(F.min(F.least("__h", "__c")) >= 0, F.lit(True)).alias("forward"),
        F.greatest(*joint).alias("joint"),
    )
    kinds = stored(states.select(key, "q", *C.POSE).distinct(), "kinematic-states")
    distinct = kinds.groupBy(key).agg(F.count(F.lit(1)).alias("distinct"))
    places = kinds.select(key, *(F.col(t).alias(a) for t, a in zip(C.TRANSLATION, "xyz", strict=True)))
    anchor = states.groupBy(key).agg(*(first(c).alias(f"f{c}") for c in C.ROTATION))
    turns = kinds.select(key, *C.ROTATION).distinct().join(anchor, key)
    r, f = ([[F.col(f"{p}r{i}{j}") for j in range(3)] for i in range(3)] for p in ("", "f"))
    relative = [[C.dot([f[k][i] for k in range(3)], [r[k][j] for k in range(3)]) for j in range(3)] for i in range(3)]
    turns = turns.select(key, *C.ROTATION, *(c.alias(a) for c, a in zip(rotation_vector(relative), "xyz", strict=True)))
    out = told.join(distinct, key).join(farthest(places, [key]).withColumnRenamed("farthest", "translation"), key)
    out = out.join(farthest(turns, [key], turned, C.ROTATION).withColumnRenamed("farthest", "rotation"), key)
    checks = [
        ("too_few", F.col("samples") >= 3), ("clock_back", F.col("forward")), ("gap", F.col("gap_s") <= most_gap_s), ("frozen", F.col("frozen_s") <= most_gap_s),
        ("joint", F.col("joint") <= most_joint), ("translation", F.col("translation") <= most_m), ("rotation", F.col("rotation") <= most_rad),
    ]
    out = out.withColumn("reasons", F.concat_ws(",", C.reasons(*checks)))
    return out.select(key, "samples", "distinct", "duration_s", "controller_s", "gap_s", "frozen_s", "joint", "translation", "rotation", (F.col("reasons") == "").alias("passed"), "reasons")
