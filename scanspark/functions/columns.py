"""Column functions: vectors, rigid poses, optics, text and JSON. All stay expressions that Catalyst can see into."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = Sequence[Column]
ROTATION = [f"r{i}{j}" for i in range(3) for j in range(3)]
TRANSLATION = ["tx", "ty", "tz"]
POSE = [*ROTATION, *TRANSLATION]


def dot(a: Vector, b: Vector) -> Column:
    return sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])


def cross(a: Vector, b: Vector) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Vector) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Vector) -> list[Column]:
    """Null where the length is 0."""
    return [F.try_divide(x, norm(a)) for x in a]


def clip(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(c, F.lit(high)), F.lit(low))


def max_abs(a: Vector) -> Column:
    return F.greatest(*map(F.abs, a))


def l1(a: Vector) -> Column:
    return sum(map(F.abs, a[1:]), F.abs(a[0]))


def angle_deg(cosine: Column) -> Column:
    return F.degrees(F.acos(clip(cosine, -1.0, 1.0)))


def pose(prefix: str = "") -> tuple[list[list[Column]], list[Column]]:
    """Rotation rows and translation from twelve flat columns."""
    r = [[F.col(f"{prefix}r{i}{j}") for j in range(3)] for i in range(3)]
    return r, [F.col(f"{prefix}{t}") for t in TRANSLATION]


def apply_pose(r: list[list[Column]], t: Vector, p: Vector) -> list[Column]:
    return [dot(row, p) + x for row, x in zip(r, t, strict=True)]


def compose(a: tuple, b: tuple) -> tuple[list[list[Column]], list[Column]]:
    """parent_T_child and child_T_grandchild to parent_T_grandchild."""
    (ra, ta), (rb, tb) = a, b
    columns = list(zip(*rb, strict=True))
    return [[dot(row, c) for c in columns] for row in ra], apply_pose(ra, ta, tb)


def invert(a: tuple) -> tuple[list[list[Column]], list[Column]]:
    r, t = a
    back = [list(c) for c in zip(*r, strict=True)]
    return back, [-dot(row, t) + 0.0 for row in back]


def rotation_angle_deg(r: list[list[Column]]) -> Column:
    return angle_deg((r[0][0] + r[1][1] + r[2][2] - 1) / 2)


def flat(a: tuple, prefix: str = "") -> list[Column]:
    r, t = a
    return [c.alias(prefix + n) for c, n in zip([*r[0], *r[1], *r[2], *t], POSE, strict=True)]


def axis_angle_rotation(v: Vector) -> list[list[Column]]:
    """Rodrigues' formula for a rotation vector; near zero (1e-12) the identity."""
    angle = norm(v)
    small = angle < 1e-12
    x, y, z = (F.when(small, 0.0).otherwise(c / F.when(small, 1.0).otherwise(angle)) for c in v)
    s, c = F.sin(angle), F.cos(angle)
    k = 1 - c
    return [[c + x * x * k, x * y * k - z * s, x * z * k + y * s], [y * x * k + z * s, c + y * y * k, y * z * k - x * s], [z * x * k - y * s, z * y * k + x * s, c + z * z * k]]


def voxel(c: Column, size: float, origin: float = 0.0) -> Column:
    """Floor, negative coordinates too."""
    return F.floor((c - origin) / size).cast("long")


def field_of_view_deg(size: Column, focal: Column, centre: Column) -> Column:
    """Of a camera whose principal point may be off centre."""
    return F.degrees(F.atan(centre / focal) + F.atan((size - centre) / focal))


def footprint(fov_deg: Column, distance: Column) -> Column:
    return 2 * distance * F.tan(F.radians(fov_deg) / 2)


def grid_count(extent: Column, view: Column, overlap: float) -> Column:
    """Views needed side by side over an extent, at the given overlap; one at least."""
    return F.greatest(F.lit(1), F.ceil((extent - view) / (view * (1 - overlap)) + 1)).cast("int")


def sphere_box_gap(centre: Vector, low: Vector, high: Vector) -> Column:
    """Distance of a point to a box, 0 inside."""
    return norm([F.greatest(lo - c, F.lit(0.0), c - hi) for c, lo, hi in zip(centre, low, high, strict=True)])


def in_box(p: Vector, low: Sequence, high: Sequence, margin: float = 0.0) -> Column:
    out = F.lit(True)
    for c, lo, hi in zip(p, low, high, strict=True):
        out = out & (c >= lo + margin) & (c <= hi - margin)
    return out


def segment_point_gap(a: Vector, b: Vector, p: Vector) -> Column:
    """Distance of a point to a segment."""
    ab, ap = [y - x for x, y in zip(a, b, strict=True)], [y - x for x, y in zip(a, p, strict=True)]
    t = clip(F.coalesce(F.try_divide(dot(ab, ap), dot(ab, ab)), F.lit(0.0)), 0.0, 1.0)
    return norm([q - (x + t * d) for x, d, q in zip(a, ab, p, strict=True)])


def segment_gap(a: Vector, b: Vector, c: Vector, d: Vector) -> Column:
    """Distance of the segments ab and cd: that of the nearest points inside both lines if both segments hold them, else the least of an end to the other segment."""
    u, v, w = ([y - x for x, y in zip(p, q, strict=True)] for p, q in ((a, b), (c, d), (c, a)))
    uu, uv, vv, uw, vw = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    across = uu * vv - uv * uv
    s, t = (F.try_divide(x, across) for x in (uv * vw - vv * uw, uu * vw - uv * uw))
    inner = norm([z + s * x - t * y for x, y, z in zip(u, v, w, strict=True)])
    inner = F.when((across > 1e-12 * uu * vv) & s.between(0.0, 1.0) & t.between(0.0, 1.0), inner)
    return F.least(inner, segment_point_gap(a, b, c), segment_point_gap(a, b, d), segment_point_gap(c, d, a), segment_point_gap(c, d, b))


def observation_id(name: Column, seq: Column, frame: Column, view: Column) -> Column:
    return F.concat_ws(":", F.concat(name, F.lit("-"), F.substring(F.sha2(name, 256), 1, 8)), seq.cast("string"), frame.cast("string"), view.cast("string"))


def safe_name(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9_-]+", "_")


def patch_id(side: Column, row: Column, col: Column) -> Column:
    return F.format_string("%s_r%02d_c%02d", side, row, col)


def utc_text(c: Column) -> Column:
    """Microseconds since 1970 as canonical UTC text."""
    return F.date_format(F.timestamp_micros(c), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def ns_to_s(c: Column) -> Column:
    return c / 1e9


def canonical_json(**fields: Column) -> Column:
    """Keys sorted, no spaces; null fields are written out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})


def all_finite(values: Column) -> Column:
    return F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != math.inf))


def array_hash(values: Column) -> Column:
    return F.sha2(F.to_json(values), 256)


def reasons(*checks: tuple[str, Column]) -> Column:
    """The names of the checks that fail (null fails), in order."""
    return F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)) for name, ok in checks)))
