"""Registration and fusion against planted motions and a twin of one key."""

import math

import numpy as np
import pytest

from scanspark.operators.registration import ACCEPTED, ANCHOR, FAR, FEW, TURNED, VANISHED, WORSE, Registration, fuse_registered, register

SOURCE = "blade int, side int, point_id long, x double, y double, z double"
TARGET = "blade int, side int, target_id long, x double, y double, z double, nx double, ny double, nz double"


def bump(n, seed, size=0.2):
    """Points and normals of a surface that holds a cloud in all six ways."""
    rnd = np.random.default_rng(seed)
    x, y = rnd.uniform(-size, size, (2, n))
    k = 12.0
    z = 0.04 * np.sin(k * x) + 0.03 * np.cos(k * y) + 0.5 * x * y
    normal = np.stack([-0.04 * k * np.cos(k * x) - 0.5 * y, 0.03 * k * np.sin(k * y) - 0.5 * x, np.ones(n)], 1)
    return np.stack([x, y, z], 1), normal / np.linalg.norm(normal, axis=1, keepdims=True)


def rotation(v):
    v = np.asarray(v, float)
    a = np.linalg.norm(v)
    if not a:
        return np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / a
    return np.eye(3) + math.sin(a) * k + (1 - math.cos(a)) * k @ k


def twin(source, target, normals, rules):
    r, t, before, passes = np.eye(3), np.zeros(3), None, 0

    def pairs():
        moved = source @ r.T + t
        gap = ((moved[:, None] - target[None]) ** 2).sum(2)
        best = gap.argmin(1)
        ok = gap[np.arange(len(moved)), best] <= rules.radius**2
        return moved[ok], target[best[ok]], normals[best[ok]]

    for _ in range(rules.passes):
        p, q, n = pairs()
        if len(p) < rules.least:
            return r, t, before, passes
        res = ((q - p) * n).sum(1)
        before = np.sqrt((res**2).mean()) if before is None else before
        scale = max(1.4826 * np.median(np.abs(res)), 1e-6)
        w = 1 / np.sqrt(1 + (res / (2.5 * scale)) ** 2)
        a = np.hstack([np.cross(p, n), n]) * w[:, None]
        b = res * w
        if rules.prior:
            a, b = np.vstack([a, math.sqrt(rules.prior) * np.eye(6)]), np.concatenate([b, np.zeros(6)])
        step = np.linalg.lstsq(a, b, rcond=None)[0]
        if np.linalg.norm(step) < rules.still:
            break
        turn = rotation(step[:3])
        r, t, passes = turn @ r, turn @ t + step[3:], passes + 1
    return r, t, before, passes


def test_registration_finds_planted_motions_and_says_why_not(spark):
    rules = Registration(0.05, passes=8, least=60, prior=1e-6, most_m=0.02, most_deg=4.0)
    target, normals = bump(900, 1)
    planted = {
        (1, 1): ((0.02, -0.03, 0.01), (0.004, -0.006, 0.005)),
        (1, -1): ((0.0, 0.0, 0.0), (0.0, 0.0, 0.0)),
        (2, 1): ((0.0, 0.0, 0.0), (0.0, 0.0, 0.03)),  # further than allowed
        (2, -1): ((0.0, 0.0, 0.12), (0.0, 0.0, 0.0)),  # turned further than allowed
        (3, 1): ((0.0, 0.0, 0.0), (5.0, 0.0, 0.0)),  # nowhere near
    }
    sources, targets, clouds = [], [], {}
    for (blade, side), (v, t) in planted.items():
        own = target[::3]
        moved = (own - np.array(t)) @ rotation(v)  # the inverse of the motion
        clouds[blade, side] = moved
        sources += [(blade, side, i, *map(float, p)) for i, p in enumerate(moved)]
        targets += [(blade, side, i, *map(float, p), *map(float, n)) for i, (p, n) in enumerate(zip(target, normals, strict=True))]
    got = {(r.blade, r.side): r for r in register(spark.createDataFrame(sources, SOURCE), spark.createDataFrame(targets, TARGET), ["blade", "side"], rules).collect()}
    assert set(got) == set(planted)
    reasons = {k: r.reason for k, r in got.items()}
    assert reasons == {(1, 1): ACCEPTED, (1, -1): ACCEPTED, (2, 1): FAR, (2, -1): TURNED, (3, 1): FEW}
    for key in ((1, 1), (1, -1), (2, 1), (2, -1)):
        r, t, before, passes = twin(clouds[key], target, normals, rules)
        row = got[key]
        mine = np.array([[row[f"r{i}{j}"] for j in range(3)] for i in range(3)])
        assert np.abs(mine - r).max() < 1e-6 and np.abs(np.array([row.tx, row.ty, row.tz]) - t).max() < 1e-6
        assert row.passes == passes <= 8 and (row.before or 0.0) == pytest.approx(before, abs=1e-9)
    v, t = planted[1, 1]
    row = got[1, 1]
    assert np.abs(np.array([[row[f"r{i}{j}"] for j in range(3)] for i in range(3)]) - rotation(v)).max() < 2e-3
    assert np.abs(np.array([row.tx, row.ty, row.tz]) - t).max() < 1e-3 and row.after < row.before / 20
    assert got[3, 1].before is None and got[3, 1].pairs == 0 and got[3, 1].after is None


def test_registration_without_rows_and_bounds(spark):
    rules = Registration(0.05, passes=2, least=5)
    none = register(spark.createDataFrame([], SOURCE), spark.createDataFrame([], TARGET), ["blade"], rules)
    assert none.count() == 0 and {FEW, VANISHED, WORSE} <= {"too few pairs", "pairs vanished", "fit not better"}


def test_fusion_corrects_views_of_a_side(spark):
    """Three front views, two of them off by a little, a hopeless one, and two back views."""
    size = 0.02
    front, _ = bump(6000, 5)
    back = front - [0, 0, 0.05]
    shift = {1: (0, 0, 0), 2: (0.0, 0.0, 0.004), 3: (0.003, 0.0, -0.003), 4: (0, 0, 3.0), 5: (0, 0, 0), 6: (0.0, 0.002, 0.003)}
    rows, views = [], []
    for view, off in shift.items():
        cloud = (front if view <= 4 else back)[view::3] + off
        rows += [(1, view, *map(float, p)) for p in cloud]
        views.append((1, view, view, 0.0, 0.0, 1.0 if view <= 4 else -1.0))
    points = spark.createDataFrame(rows, "blade int, view_id int, x double, y double, z double")
    cameras = spark.createDataFrame(views, "blade int, view_id int, seq int, tx double, ty double, tz double")
    fused, told = fuse_registered(points, cameras, size, Registration(0.015, passes=5, least=40, most_m=0.02), ["blade"], 8)
    told = {r.view_id: r for r in told.collect()}
    assert {v: (r.side, r.reason) for v, r in told.items()} == {1: (1, ANCHOR), 2: (1, ACCEPTED), 3: (1, ACCEPTED), 4: (1, FEW), 5: (-1, ANCHOR), 6: (-1, ACCEPTED)}
    assert told[2].tz == pytest.approx(-0.004, abs=1.5e-3) and told[2].after < told[2].before / 2
    got = fused.filter("side = 1 AND z < 1").toPandas()
    height = lambda x, y: 0.04 * np.sin(12 * x) + 0.03 * np.cos(12 * y) + 0.5 * x * y
    off = np.abs(got["z"] - height(got["x"], got["y"]))
    assert np.median(off) < 1.5e-3 and fused.filter("side = -1").count() > 100
