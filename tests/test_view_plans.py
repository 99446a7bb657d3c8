"""Fine view plans against a twin that renders every trial with numpy."""

import math

import numpy as np
import pytest

from scanspark.operators.view_plans import BASELINE_FIRST, NEAR_FIRST, Camera, ViewLimits, fine_view_plan

CAMERA = Camera(64, 48, 60.0, 58.0, 31.5, 23.5, (0.02, -0.01), (0.001, -0.002))
LIMITS = ViewLimits(0.30, 0.20, 0.40, 0.05, margin_px=2, utilization=0.9, projection=0.9, visibility=0.85, occlusion_m=0.003, curvature_deg=25.0, splits=2)


def surface(seed=0):
    """Two blades: flat patches, one bent, one behind a shelf that hides half of it, one far too wide."""
    rnd = np.random.default_rng(seed)
    rows, patches = [], []
    for blade in (1, 2):
        for name, region, size, x0, bend in (("a", "main", 0.08, 0.0, 0.0), ("b", "root", 0.08, 0.3, 0.0), ("c", "main", 0.1, 0.6, 3.0), ("d", "main", 0.3, 1.0, 0.0), ("e", "main", 0.1, 1.6, 0.0), ("tiny", "tip", 0.5, 2.4, 0.0)):
            n = 10 if name == "tiny" else 150 + 20 * blade
            s, t = rnd.random(n), rnd.random(n) * 0.8
            x, y = x0 + size * s, size * t
            z = bend * (s - 0.5) ** 2 * size + rnd.uniform(-0.0007, 0.0007, n)
            nx = -2 * bend * (s - 0.5)
            normal = np.stack([nx, 0 * nx, np.ones(n)], 1) / np.sqrt(1 + nx * nx)[:, None]
            rows += [(blade, name, *map(float, (a, b, c, *m, p, q))) for a, b, c, m, p, q in zip(x, y, z, normal, s, t, strict=True)]
            patches.append((blade, name, region, 0.0, 0.0, 1.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0))
        shelf = rnd.random((3000, 2)) * [0.05, 0.1] + [1.6, 0.0]
        rows += [(blade, "shelf", float(a), float(b), 0.1, 0.0, 0.0, 1.0, 0.5, 0.5) for a, b in shelf]
    return rows, patches


def project(points, at, rotation):
    local = (points - at) @ rotation
    z = local[:, 2]
    safe = np.where(z > 0, z, 1.0)
    x, y = local[:, 0] / safe, local[:, 1] / safe
    r2 = x * x + y * y
    k, p = [*CAMERA.radial, 0.0], CAMERA.tangential
    radial = 1 + k[0] * r2 + k[1] * r2**2 + k[2] * r2**3
    u = (x * radial + 2 * p[0] * x * y + p[1] * (r2 + 2 * x * x)) * CAMERA.fx + CAMERA.cx
    v = (y * radial + p[0] * (r2 + 2 * y * y) + 2 * p[1] * x * y) * CAMERA.fy + CAMERA.cy
    return u, v, z


def box_centre(points):
    centre = points.mean(0)
    _, axes = np.linalg.eigh(np.cov(points - centre, rowvar=False, bias=True))
    local = (points - centre) @ axes
    return centre + axes @ ((local.min(0) + local.max(0)) / 2)


def twin(rows, patches):
    u0, u1, v0, v1 = LIMITS.window(CAMERA)
    out = {}
    for blade in (1, 2):
        own = [r for r in rows if r[0] == blade]
        everything = np.array([r[2:5] for r in own])

        def plan(name, root, region, points, normals, st, level, blade=blade, everything=everything):
            main = np.array([0.0, 0.0, 1.0])
            bent = np.percentile(np.degrees(np.arccos(np.clip(normals @ main, -1, 1))), 90)
            near = region in ("root", "tip") or bent > LIMITS.curvature_deg
            x = np.array([1.0, 0.0, 0.0])
            rotation = np.stack([x, np.cross(-main, x), -main], 1)
            best = [0.0, 0.0]
            for d in sorted(LIMITS.distances(), key=(lambda d: d) if near else (lambda d: (abs(d - LIMITS.baseline), d))):
                at = box_centre(points) + main * d
                u, v, z = project(points, at, rotation)
                good = (z >= LIMITS.low) & (z <= LIMITS.high) & (u >= u0) & (u <= u1) & (v >= v0) & (v <= v1)
                au, av, az = project(everything, at, rotation)
                front = {}
                for a, b, c in zip(au, av, az, strict=True):
                    if c > 0 and 0 <= a < CAMERA.width and 0 <= b < CAMERA.height:
                        pixel = (math.floor(b), math.floor(a))
                        front[pixel] = min(c, front.get(pixel, math.inf))
                seen = [bool(g) and c <= front[math.floor(b), math.floor(a)] + LIMITS.occlusion_m for g, a, b, c in zip(good, u, v, z, strict=True)]
                shares = good.mean(), np.mean(seen)
                best = [max(x) for x in zip(best, shares, strict=True)]
                if shares[0] + 1e-12 >= LIMITS.projection and shares[1] + 1e-12 >= LIMITS.visibility:
                    out[blade, name] = (root, level, "planned", NEAR_FIRST if near else BASELINE_FIRST, d, *shares)
                    return
            wide = 0 if np.ptp(st[:, 0]) >= np.ptp(st[:, 1]) else 1
            high = st[:, wide] > np.median(st[:, wide])
            if level < LIMITS.splits and len(points) >= 12 and min(high.sum(), (~high).sum()) >= 6:
                for k, mask in (("_v0", ~high), ("_v1", high)):
                    plan(name + k, root, region, points[mask], normals[mask], st[mask], level + 1)
            else:
                out[blade, name] = (root, level, "infeasible", NEAR_FIRST if near else BASELINE_FIRST, None, *best)

        for _, name, region, *_ in (p for p in patches if p[0] == blade):
            mine = np.array([r[2:] for r in own if r[1] == name])
            plan(name, name, region, mine[:, :3], mine[:, 3:6], mine[:, 6:], 0)
    return out


POINTS = "blade int, patch_id string, x double, y double, z double, nx double, ny double, nz double, s double, t double"
PATCHES = "blade int, patch_id string, region string, " + ", ".join(f"{p}{a} double" for p in "mgh" for a in "xyz")


def test_fine_view_plan_equals_its_twin(spark):
    rows, patches = surface()
    got = fine_view_plan(spark.createDataFrame(rows, POINTS), spark.createDataFrame(patches, PATCHES), CAMERA, LIMITS, ["blade"], (0.3, 0.2)).collect()
    want = twin(rows, patches)
    assert {(r.blade, r.patch_id) for r in got} == set(want)
    assert {w[2] for w in want.values()} == {"planned", "infeasible"} and {w[1] for w in want.values()} == {0, 1, 2}
    assert any(w[3] == NEAR_FIRST and w[2] == "planned" for w in want.values())
    for r in got:
        root, level, status, policy, distance, projection, visibility = want[r.blade, r.patch_id]
        assert (r.root_id, r.level, r.status, r.policy, r.distance) == (root, level, status, policy, distance), r
        shares = (r.projection, r.visibility) if status == "planned" else (r.best_projection, r.best_visibility)
        assert shares == pytest.approx((projection, visibility), abs=1e-9)
        if status == "planned":
            assert r.footprint_u == pytest.approx(0.3 * distance / 0.3) and (r.r00, r.r11, r.r22) == pytest.approx((1, -1, -1)) and r.tz > distance - 0.2
        else:
            assert r.tx is None and r.footprint_u is None


def test_distances_and_window():
    assert LIMITS.distances() == [0.2, 0.25, 0.3, 0.35, 0.4] and ViewLimits(0.3).distances() == [0.3]
    assert ViewLimits(0.33, 0.2, 0.4, 0.1).distances() == [0.2, 0.3, 0.33, 0.4]
    with pytest.raises(ValueError):
        ViewLimits(0.3, 0.1, 1.0, 1e-6).distances()
    assert ViewLimits(0.3, margin_px=3).window(CAMERA) == (3.0, 60.0, 3.0, 44.0)
    with pytest.raises(ValueError):
        ViewLimits(0.3, margin_px=30).window(CAMERA)


def test_nothing_to_plan(spark):
    empty = fine_view_plan(spark.createDataFrame([], POINTS), spark.createDataFrame([], PATCHES), CAMERA, LIMITS, ["blade"])
    assert empty.count() == 0
