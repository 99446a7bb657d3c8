"""Robots that come to rest: stationary traces by all pairs, settled windows from tables and streams."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scanspark.operators.motion import farthest, stationary_trace, turned
from scanspark.streaming.settling import CLOCK_BACK, REPORT, SETTLED, STALE, TIMEOUT, Settling, settled_stream, settled_table

POSE = [f"r{i}{j}" for i in range(3) for j in range(3)] + ["tx", "ty", "tz"]


def rotation(v):
    v = np.asarray(v, float)
    a = np.linalg.norm(v)
    if not a:
        return np.eye(3)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / a
    return np.eye(3) + math.sin(a) * k + (1 - math.cos(a)) * k @ k


def angle(a, b):
    return math.acos(min(1.0, max(-1.0, ((a * b).sum() - 1) / 2)))


def test_farthest_equals_all_pairs(spark):
    rnd = np.random.default_rng(3)
    clouds = {1: rnd.normal(size=(300, 3)), 2: rnd.normal(size=(200, 3)), 3: np.ones((4, 3)), 4: np.array([[0, 0, 0], [3, 4, 0.0]]), 5: rnd.random((50, 3)) * [1, 0, 0]}
    clouds[2] /= np.linalg.norm(clouds[2], axis=1, keepdims=True)
    rows = [(k, *map(float, p)) for k, c in clouds.items() for p in c]
    got = {r.k: r.farthest for r in farthest(spark.createDataFrame(rows, "k int, x double, y double, z double"), ["k"]).collect()}
    for k, c in clouds.items():
        assert got[k] == pytest.approx(np.sqrt(((c[:, None] - c[None]) ** 2).sum(2).max()), abs=1e-12), k


def test_farthest_rotations_equal_all_pairs(spark):
    rnd = np.random.default_rng(4)
    sets = {1: [rotation(v) for v in rnd.normal(size=(80, 3)) * 0.2], 2: [rotation(v) for v in rnd.normal(size=(80, 3)) * 2], 3: [np.eye(3), rotation((0, 0, math.pi)), rotation((math.pi, 0, 0)), rotation((0, 3.0, 0.5))]}
    rows = []
    for k, rs in sets.items():
        for r in rs:
            rel = sets[k][0].T @ r
            a = angle(np.eye(3), rel)
            skew = np.array([rel[2, 1] - rel[1, 2], rel[0, 2] - rel[2, 0], rel[1, 0] - rel[0, 1]])
            v = skew * (a / (2 * math.sin(a)) if math.sin(a) > 1e-7 else 0.5)
            if a > 3.14159:
                v = np.sqrt(np.maximum((np.diag(rel) + 1) / 2, 0)) * a
            rows.append((k, *map(float, v), *map(float, r.ravel())))
    frame = spark.createDataFrame(rows, "k int, x double, y double, z double, " + ", ".join(f"{c} double" for c in POSE[:9]))
    got = {r.k: r.farthest for r in farthest(frame, ["k"], turned, POSE[:9]).collect()}
    for k, rs in sets.items():
        assert got[k] == pytest.approx(max(angle(a, b) for a in rs for b in rs), abs=1e-7), k


def trace(rnd, n, joint=0.0, place=0.0, turn=0.0, gap=None, frozen=None, back=None):
    rows, host, ctrl, at = [], 10**9, 5.0, 0.0
    for i in range(n):
        q = [0.1 * j + joint * rnd.random() for j in range(6)]
        r = rotation(np.array([rnd.random(), rnd.random(), rnd.random()]) * turn) @ rotation((0.3, 1.0, -0.4))
        t = [place * rnd.random() for _ in range(3)]
        rows.append((i, host, ctrl, q, *map(float, r.ravel()), *t))
        step = 0.3 if i == gap else 0.01
        host += int(step * 1e9) * (-1 if i == back else 1)
        ctrl += 0.0 if frozen is not None and i >= frozen else step
    return rows


def stationary_twin(rows, limits, most_gap):
    n = len(rows)
    joint = max((max(abs(a - b) for a, b in zip(x[3], y[3], strict=True)) for x in rows for y in rows), default=0.0)
    poses = [np.array(x[4:16]) for x in rows]
    place = max(np.linalg.norm(a[9:] - b[9:]) for a in poses for b in poses)
    turn = max(angle(a[:9], b[:9]) for a in poses for b in poses)
    steps = [((b[1] - a[1]) / 1e9, b[2] - a[2]) for a, b in zip(rows, rows[1:], strict=False)]
    frozen, since = 0.0, rows[0][1]
    for a, b in zip(rows, rows[1:], strict=False):
        since = b[1] if b[2] > a[2] else since
        frozen = max(frozen, (b[1] - since) / 1e9)
    gap = max((max(s) for s in steps), default=0.0)
    bad = [("too_few", n < 3), ("clock_back", any(min(s) < 0 for s in steps)), ("gap", gap > most_gap), ("frozen", frozen > most_gap), ("joint", joint > limits[0]), ("translation", place > limits[1]), ("rotation", turn > limits[2])]
    return joint, place, turn, gap, ",".join(name for name, b in bad if b)


def test_stationary_traces_equal_all_pairs(spark):
    rnd = random.Random(6)
    made = [trace(rnd, 60, 1e-4, 1e-4, 1e-3), trace(rnd, 60, 0.5), trace(rnd, 80, 0.0, 0.2), trace(rnd, 80, 0.0, 0.0, 1.5), trace(rnd, 40, gap=7), trace(rnd, 40, frozen=2), trace(rnd, 2), trace(rnd, 1), trace(rnd, 90), trace(rnd, 20, back=5), trace(rnd, 30, 1e-4, 1e-4, 3.0)]
    rows = [(k, *r) for k, t in enumerate(made) for r in t]
    schema = "k int, seq long, host_ns long, ctrl_s double, q array<double>, " + ", ".join(f"{c} double" for c in POSE)
    frame = spark.createDataFrame(rows, schema)
    frame = frame.unionByName(frame.limit(1).withColumns({"k": F.lit(0), "seq": F.lit(999).cast("long"), "q": F.lit(None).cast("array<double>")}))
    got = {r.k: r for r in stationary_trace(frame, "k", 0.01, 0.01, 0.05, 0.1).collect()}
    assert set(got) == set(range(len(made)))
    for k, t in enumerate(made):
        joint, place, turn, gap, reasons = stationary_twin(t, (0.01, 0.01, 0.05), 0.1)
        r = got[k]
        assert (r.joint, r.translation, r.rotation, r.gap_s) == pytest.approx((joint, place, turn, gap), abs=2e-7) and r.reasons == reasons and r.passed == (not reasons), (k, r)
        assert r.samples == len(t) and r.distinct == len({(tuple(x[3]), x[4:16]) for x in t})


RULES = Settling(200_000, 3_000_000, 250_000, 0.01, 0.005, 0.02, goal=(0.0,) * 6, goal_tolerance=0.05, most_speeds=(0.1, 0.1))
STATES = "trace_id long, us long, host_us long, ctrl_us long, q array<double>, stopped boolean, speeds array<double>, " + ", ".join(f"{c} double" for c in POSE)


def robots(seed, n=14):
    """Traces that settle, drift, leave the goal, never stop, go stale or turn their clock back."""
    rnd = random.Random(seed)
    rows = []
    for trace_id in range(n):
        kind, us, ctrl, off, host_lag = trace_id % 7, 1_000_000 + trace_id * 1000, 0, 0.0, 0
        for i in range(rnd.randint(40, 120)):
            moving = i < 12 or (kind == 1 and i % 9 == 0) or kind == 2
            off = rnd.random() if moving else (off + 0.0012 if kind == 3 else 0.01)
            q = [off * 0.04] * 6 if kind != 4 or i > 30 else [0.2] * 6
            turn = rotation((0, 0, off * 0.1))
            rows.append((trace_id, us, us - host_lag, ctrl, q, kind != 2 or rnd.random() < 0.8, None if kind == 6 and i == 20 else [0.05, 0.2 if moving else 0.02], *map(float, turn.ravel()), off * 0.01, 0.0, 0.0))
            step = rnd.choice((8_000, 16_000, 24_000))
            us += 400_000 if kind == 5 and i == 15 else step
            ctrl += step if kind != 1 or i % 2 else 0
            host_lag += 30_000 if trace_id == 8 and i == 14 else 0
    return rows


def settled_twin(rows):
    """Every window's states against every other, anew for each sample."""
    out = {}
    for trace_id in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == trace_id), key=lambda r: r[1:4])
        window, last, moved, told = [], None, own[0][1], None
        for r in own:
            if r[1] > own[0][1] + RULES.timeout_us:
                break
            if last:
                steps = [b - a for a, b in zip(last[1:4], r[1:4], strict=True)]
                moved = r[1] if steps[2] > 0 else moved
                if min(steps) < 0:
                    told = (CLOCK_BACK, r[1])
                    break
                if max(steps) > RULES.most_gap_us or r[1] - moved > RULES.most_gap_us:
                    told = (STALE, r[1])
                    break
            last = r
            good = r[5] and r[6] is not None and all(a <= b for a, b in zip(r[6], RULES.most_speeds, strict=True)) and max(map(abs, r[4])) <= RULES.goal_tolerance
            if not good:
                window = []
                continue
            tried = [*window, r]
            far = lambda x, y: (max(abs(a - b) for a, b in zip(x[4], y[4], strict=True)), np.linalg.norm(np.array(x[16:]) - np.array(y[16:])), angle(np.array(x[7:16]), np.array(y[7:16])))
            most = [max(v) for v in zip(*(far(x, y) for x in tried for y in tried), strict=True)]
            window = tried if all(a <= b for a, b in zip(most, (RULES.most_joint, RULES.most_m, RULES.most_rad), strict=True)) else [r]
            if min(b - a for a, b in zip(window[0][1:4], r[1:4], strict=True)) >= RULES.settle_us:
                told = (SETTLED, r[1], len(window))
                break
        out[trace_id] = told or (TIMEOUT, own[0][1] + RULES.timeout_us)
    return out


def as_told(rows):
    return {r.trace_id: (r.outcome, r.us, r.samples) if r.outcome == SETTLED else (r.outcome, r.us) for r in rows}


def test_settled_table_equals_its_twin(spark):
    rows = robots(1)
    rows = rows + [rows[3][:1] + (rows[3][1],) + rows[3][2:]]  # a repeated sample
    got = settled_table(spark.createDataFrame(rows, STATES), RULES).collect()
    want = settled_twin(rows)
    assert as_told(got) == want and len(got) == len(want)
    assert {w[0] for w in want.values()} >= {SETTLED, TIMEOUT, STALE}
    assert all(r.joint <= RULES.most_joint and r.duration_us >= RULES.settle_us for r in got if r.outcome == SETTLED)
    backwards = [(1, 10, 10, 10, [0.0] * 6, True, [0.0, 0.0], *([0.0] * 12)), (1, 20, 5, 20, [0.0] * 6, True, [0.0, 0.0], *([0.0] * 12))]
    assert [r.outcome for r in settled_table(spark.createDataFrame(backwards, STATES), RULES).collect()] == [CLOCK_BACK]
    assert settled_table(spark.createDataFrame([], STATES), RULES).count() == 0


def test_a_long_trace_is_not_held(spark):
    """Its batches are folded one after another; a robot at rest adds one state to its window."""
    from scanspark.streaming.settling import Fold

    fold = Fold(Settling(10**12, 10**13, 10**6, 0.01, 0.01, 0.01))
    for i in range(5000):
        assert fold.add(i, i, i, [0.0] * 6, True, None, [1.0] * 12) is None
    assert fold.samples == 5000 and len(fold.states) == 1


def test_settled_stream_equals_the_table(spark, tmp_path):
    rows = robots(2, 10)
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame = spark.createDataFrame(rows, STATES).withColumn("ts", F.timestamp_micros("us"))
    rnd = random.Random(4)
    # Samples arrive in batches by time, up to 0.1 s out of order.
    ordered = sorted(rows, key=lambda r: r[1] + rnd.randint(0, 100_000))
    beat = [(None, 9_000_000 + k, 0, 0, None, None, None, *([None] * 12)) for k in range(2)]
    parts = [ordered[i : i + 200] for i in range(0, len(ordered), 200)] + [[b] for b in beat]
    for part in parts:
        spark.createDataFrame(part, STATES).withColumn("ts", F.timestamp_micros("us")).coalesce(1).write.mode("append").parquet(source)
        stream = settled_stream(spark.readStream.schema(frame.schema).parquet(source), RULES, "200 milliseconds")
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
    got = spark.read.schema(REPORT).parquet(out).collect()
    want = settled_table(frame, RULES).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and as_told(got) == settled_twin(rows)
