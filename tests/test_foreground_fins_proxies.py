"""Foregrounds of planted images, fins on a bent plane, and proxies of views, each against a twin in plain Python."""

import collections
import random

import numpy as np
import pytest

from scanspark.operators.fins import Fin, segment_fin
from scanspark.operators.foreground import HINT, REGION, Foreground, select_foreground
from scanspark.operators.proxies import Proxy, bilateral_proxy

PIXELS = "view_id int, v int, u int, depth_m double, valid boolean"
SEEDS = "view_id int, mode string, v int, u int"
RULES = Foreground(0.2, 2.0, least_valid=30, margin=2, jump=0.02, relative=0.01, least_component=4, ambiguity=0.6, least_mask=6, most_mask_share=0.5, least_seeds=3, least_seed_share=0.5, least_hint_share=0.4)


def image(seed, blobs):
    """A ramp at 1.5 m with blobs (v0, u0, height, width, depth) before it, some pixels without depth."""
    rnd = random.Random(seed)
    depth = np.fromfunction(lambda v, u: 1.5 + 0.001 * u, (24, 30))
    valid = np.ones((24, 30), bool)
    for v, u, h, w, d in blobs:
        depth[v : v + h, u : u + w] = d + 0.005 * np.arange(w)
    for _ in range(20):
        valid[rnd.randrange(24), rnd.randrange(30)] = False
    return depth, valid


VIEWS = {
    1: (image(1, [(5, 6, 6, 7, 0.7), (14, 20, 3, 4, 0.9)]), None, []),
    2: (image(2, [(5, 6, 5, 6, 0.7), (14, 16, 5, 6, 0.9)]), None, []),  # ambiguous
    3: (image(3, []), None, []),  # nothing but the background
    4: (image(4, [(5, 6, 6, 7, 0.7), (14, 20, 4, 4, 0.9)]), HINT, [(v, u) for v in range(13, 19) for u in range(19, 24)]),
    5: (image(5, [(5, 6, 6, 7, 0.7), (14, 20, 4, 4, 0.9)]), HINT, [(v, u) for v in range(20, 23) for u in range(3, 8)]),  # hints at the background
    6: (image(6, [(5, 6, 6, 7, 0.7), (7, 20, 4, 4, 0.9)]), REGION, [(v, u) for v in range(4, 12) for u in range(5, 25)]),
    7: (image(7, [(5, 6, 6, 7, 0.7)]), REGION, [(v, u) for v in range(0, 12) for u in range(5, 25)]),  # reaches the border
    8: (image(8, [(5, 6, 6, 7, 0.7)]), HINT, [(5, 6)]),  # too few
    9: (image(9, [(4, 4, 4, 6, 0.7), (4, 14, 4, 6, 0.9)]), HINT, [(v, u) for v in range(4, 8) for u in range(5, 19)]),  # between two
    10: ((np.full((24, 30), 5.0), np.ones((24, 30), bool)), None, []),  # too far
}


def foreground_twin(depth, valid, mode, seeds, rules=RULES):
    seed = np.zeros(depth.shape, bool)
    for v, u in seeds:
        seed[v, u] = True
    good = valid & (depth >= rules.low) & (depth <= rules.high)
    if good.sum() < rules.least_valid:
        return "too_few_valid", None
    if mode and (seed & good).sum() < rules.least_seeds:
        return "too_few_seeds", None
    if mode and (seed & good).sum() / seed.sum() < rules.least_seed_share:
        return "seed_share", None
    v, u = np.nonzero(good)
    rows, cols = np.indices(depth.shape)
    m = rules.margin
    border = good & ((rows < v.min() + m) | (rows > v.max() - m) | (cols < u.min() + m) | (cols > u.max() - m))
    able = good & (seed if mode == REGION else True)
    label = np.full(depth.shape, -1)
    parts = []
    for start in zip(*np.nonzero(able), strict=True):
        if label[start] >= 0:
            continue
        stack, own = [start], []
        label[start] = len(parts)
        while stack:
            a = stack.pop()
            own.append(a)
            for dv, du in ((0, 1), (1, 0), (0, -1), (-1, 0)):
                b = (a[0] + dv, a[1] + du)
                if 0 <= b[0] < depth.shape[0] and 0 <= b[1] < depth.shape[1] and able[b] and label[b] < 0 and abs(depth[a] - depth[b]) <= max(rules.jump, rules.relative * min(depth[a], depth[b])):
                    label[b] = len(parts)
                    stack.append(b)
        parts.append(own)
    inner = [k for k, p in enumerate(parts) if not any(border[a] for a in p) and len(p) >= rules.least_component]
    size, hits = (lambda k: len(parts[k])), (lambda k: sum(seed[a] for a in parts[k]))
    if mode == REGION:
        if any(border[a] for p in parts for a in p):
            return "region_at_border", None
        chosen = range(len(parts))
    elif mode == HINT:
        ranked = sorted((k for k in inner if hits(k)), key=lambda k: (-hits(k), -size(k), k))
        if not ranked:
            return "no_component", None
        if hits(ranked[0]) / (seed & good).sum() < rules.least_hint_share:
            return "hint_share", None
        if len(ranked) > 1 and hits(ranked[1]) / hits(ranked[0]) > rules.ambiguity:
            return "ambiguous", None
        chosen = ranked[:1]
    else:
        ranked = sorted(inner, key=lambda k: (-size(k), k))
        if not ranked:
            return "no_component", None
        if len(ranked) > 1 and size(ranked[1]) / size(ranked[0]) > rules.ambiguity:
            return "ambiguous", None
        chosen = ranked[:1]
    mask = {(int(a[0]), int(a[1])) for k in chosen for a in parts[k]}
    if len(mask) < rules.least_mask:
        return "small_mask", None
    if not rules.least_mask_share <= len(mask) / depth.size <= rules.most_mask_share:
        return "mask_share", None
    return None, mask


def test_foregrounds_equal_their_twin(spark):
    rows = [(k, v, u, float(d[v, u]) if (v + u) % 97 else None, bool(ok[v, u]) and bool((v + u) % 97)) for k, ((d, ok), *_) in VIEWS.items() for v in range(24) for u in range(30)]
    seeds = [(k, mode, v, u) for k, (_, mode, own) in VIEWS.items() for v, u in own]
    mask, report = select_foreground(spark.createDataFrame(rows, PIXELS), spark.createDataFrame(seeds, SEEDS), RULES)
    got = collections.defaultdict(set)
    for r in mask.collect():
        got[r.view_id].add((r.v, r.u))
    told = {r.view_id: r for r in report.collect()}
    assert set(told) == set(VIEWS)
    reasons = {}
    for k, ((d, ok), mode, own) in VIEWS.items():
        holes = np.fromfunction(lambda v, u: (v + u) % 97 != 0, d.shape)
        reason, want = foreground_twin(d, ok & holes, mode, own)
        assert (told[k].reason, got.get(k)) == (reason, want), k
        assert told[k].passed == (reason is None) and told[k].pixels == 720 and told[k].seeds == len(own)
        reasons[k] = reason
    assert set(reasons.values()) >= {None, "ambiguous", "no_component", "region_at_border", "too_few_seeds", "too_few_valid"} and sum(r is None for r in reasons.values()) >= 3
    empty, none = select_foreground(spark.createDataFrame([], PIXELS), spark.createDataFrame([], SEEDS), RULES)
    assert empty.count() == none.count() == 0


FINS = "side int, point_id long, x double, y double, z double, nx double, ny double, nz double"
FIN = Fin(0.035, 0.03, 0.012, least=20, second=0.5, span=0.05, thickness=0.5, root_band=0.03, free_band=0.02, least_main=50, rounds=4)


def bladed(fins, seed):
    """A bent plane with upright fins: (x, y0, y1, height)."""
    rnd = np.random.default_rng(seed)
    x, y = rnd.uniform(-0.2, 0.2, (2, 700))
    rows = [(a, b, 0.2 * a * a, -0.4 * a, 0.0, 1.0) for a, b in zip(x, y, strict=True)]
    for fx, y0, y1, height in fins:
        n = int(4000 * (y1 - y0) * height * 10) + 30
        for b, c in zip(rnd.uniform(y0, y1, n), rnd.uniform(0.0, height, n), strict=True):
            rows.append((fx + rnd.uniform(-0.002, 0.002), b, 0.2 * fx * fx + c, 1.0, 0.0, 0.05))
    rows = np.array(rows)
    rows[:, 3:] /= np.linalg.norm(rows[:, 3:], axis=1, keepdims=True)
    return rows


def test_fins_are_grown_and_gated(spark):
    made = {1: bladed([(0.05, -0.15, 0.15, 0.12)], 1), 2: bladed([], 2), 3: bladed([(-0.1, -0.15, 0.15, 0.12), (0.1, -0.15, 0.15, 0.11)], 3), 4: bladed([(0.0, -0.01, 0.01, 0.15)], 4), 5: bladed([(0.05, -0.15, 0.15, 0.12), (-0.15, -0.05, 0.0, 0.06)], 5)}
    rows = [(side, side * 100_000 + i, *map(float, r)) for side, own in made.items() for i, r in enumerate(own)]
    parts, report = segment_fin(spark.createDataFrame(rows, FINS), ["side"], "point_id", FIN)
    told = {r.side: r for r in report.collect()}
    assert {s: r.reason for s, r in told.items()} == {1: None, 2: "no_fin", 3: "several_fins", 4: "narrow", 5: None}
    got = collections.defaultdict(dict)
    for r in parts.collect():
        got[r.side][r.point_id % 100_000] = r
    assert all(len(got[s]) == len(made[s]) for s in made)
    for side in (1, 5):
        own, fx = made[side], 0.05
        fin = {i for i, r in got[side].items() if r.part != "main"}
        # The twin grows the component from the operator's own residuals.
        out = {i: abs(r.residual) for i, r in got[side].items()}
        able = [i for i in range(len(own)) if out[i] >= FIN.grow_height or abs(own[i][5]) <= FIN.seed_cosine]
        seeds = {i for i in able if out[i] >= FIN.seed_height and abs(own[i][5]) <= FIN.seed_cosine}
        left, best = set(able), set()
        while seeds & left:
            stack, part = [next(iter(seeds & left))], set()
            left.discard(stack[0])
            while stack:
                a = stack.pop()
                part.add(a)
                near = [b for b in left if ((own[a][:3] - own[b][:3]) ** 2).sum() <= FIN.radius**2]
                left.difference_update(near)
                stack += near
            best = max(best, part, key=len)
        assert fin == best and told[side].size == len(best)
        planted = {i for i, r in enumerate(own) if abs(r[0] - fx) < 0.003 and r[5] < 0.5 and r[2] > 0.02}
        assert len(planted & fin) > 0.95 * len(planted)
        res = np.array([out[i] for i in sorted(best)])
        root, free = max(FIN.root_band, np.percentile(res, 15)), max(res.max() - FIN.free_band, np.percentile(res, 82))
        assert (told[side].root_limit, told[side].free_limit) == pytest.approx((root, free), abs=1e-9)
        for i in best:
            assert got[side][i].part == ("fin_root" if out[i] <= root else "fin_free" if out[i] >= free else "fin_body")
    assert all(r.part == "main" for s in (2, 3, 4) for r in got[s].values())


def proxy_twin(points, camera, rules):
    cells = collections.defaultdict(list)
    for p in points:
        cells[tuple(np.floor(p / rules.size).astype(int))].append(p)
    voxels = np.array([np.mean(c, 0) for c in cells.values()])

    def frame(rows):
        centre = rows.mean(0)
        values, vectors = np.linalg.eigh(np.cov(rows - centre, rowvar=False, bias=True))
        major, normal = vectors[:, 2], vectors[:, 0]
        major = major * (1 if major[np.abs(major).argmax()] >= 0 else -1)
        to = (camera - centre) / np.linalg.norm(camera - centre)
        return centre, major, normal * (1 if normal @ to >= 0 else -1), abs(normal @ to)

    kept, kind = voxels, "plain"
    centre, major, normal, cosine = frame(voxels)
    if cosine < rules.least_cosine and rules.planar:
        ranges = np.linalg.norm(points - camera, axis=1)
        mid = np.median(ranges)
        limit = mid + max(rules.mad_scale * 1.4826 * np.median(np.abs(ranges - mid)), rules.least_voxels * rules.size)
        near = voxels[np.linalg.norm(voxels - camera, axis=1) <= limit]
        if len(near) >= max(3, np.ceil(rules.support * len(voxels))) and frame(near)[3] >= rules.least_cosine:
            kept, kind = near, "robust"
            centre, major, normal, cosine = frame(near)
    axes = np.stack([major, np.cross(normal, major), normal], 1)
    local = (kept - centre) @ axes
    low, high = local.min(0), local.max(0)
    low[:2] -= rules.margin
    high[:2] += rules.margin
    for i in (0, 1) if rules.planar else ():
        need, middle = rules.planar[i] + 2 * rules.margin, (low[i] + high[i]) / 2
        if high[i] - low[i] < need:
            low[i], high[i] = middle - need / 2, middle + need / 2
    low[2] -= rules.thickness + rules.hidden_margin
    high[2] += rules.visible_margin
    return centre + axes @ ((low + high) / 2), axes, high - low, cosine, kind


def test_proxies_equal_their_twin(spark):
    rnd = np.random.default_rng(9)
    plate = np.stack([rnd.uniform(-0.2, 0.2, 1500), rnd.uniform(-0.08, 0.08, 1500), rnd.normal(0, 0.002, 1500)], 1)
    tail = np.stack([rnd.uniform(-0.01, 0.01, 40), rnd.uniform(-0.01, 0.01, 40), -rnd.uniform(0.5, 6.0, 40)], 1)
    line = np.stack([np.linspace(0, 1, 60), np.zeros(60), np.zeros(60)], 1)
    clouds = {1: (plate, (0.1, 0.05, 0.6)), 2: (np.vstack([plate, tail]), (0.0, 0.0, 0.6)), 3: (plate, (2.0, 0.0, 0.05)), 4: (line, (0.5, 0.2, 1.0)), 5: (plate[:2], (0.0, 0.0, 1.0)), 6: (plate @ np.linalg.qr(rnd.normal(size=(3, 3)))[0] + 0.3, (0.6, 0.9, 1.5))}
    rows = [(k, *map(float, p)) for k, (c, _) in clouds.items() for p in c] + [(1, float("nan"), 0.0, 0.0), (1, None, 1.0, 1.0)]
    cameras = spark.createDataFrame([(k, *map(float, at)) for k, (_, at) in clouds.items()], "k int, tx double, ty double, tz double")
    points = spark.createDataFrame(rows, "k int, x double, y double, z double")
    rules = Proxy(0.02, 0.03, least_cosine=0.3, least=50, planar=(0.5, 0.1), margin=0.01, visible_margin=0.005, hidden_margin=0.02)
    got = {r.k: r for r in bilateral_proxy(points, cameras, rules, ["k"]).collect()}
    reasons = {k: r.reason for k, r in got.items()}
    assert reasons == {1: None, 2: None, 3: "grazing", 4: "line_like", 5: "few_points", 6: None}
    assert got[2].frame == "robust" and got[1].frame == "plain"
    for k in (1, 2, 3, 6):
        centre, axes, extents, cosine, kind = proxy_twin(np.array(clouds[k][0]), np.array(clouds[k][1]), rules)
        r = got[k]
        assert np.array([r.tx, r.ty, r.tz]) == pytest.approx(centre, abs=1e-9) and (r.ex, r.ey, r.ez) == pytest.approx(tuple(extents), abs=1e-9)
        assert np.array([[r[f"r{i}{j}"] for j in range(3)] for i in range(3)]) == pytest.approx(axes, abs=1e-7)
        assert (r.frame, r.cosine) == (kind, pytest.approx(cosine, abs=1e-9))
    plain = {r.k: r for r in bilateral_proxy(points, cameras, Proxy(0.02, 0.03), ["k"]).collect()}
    assert plain[2].frame == "plain" and plain[2].reason == "grazing"
