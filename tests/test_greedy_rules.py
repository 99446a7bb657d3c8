"""Greedy rules against folds in plain Python."""

import random

import pytest

from scanspark.operators.planning import duplicate_pose_suppress
from scanspark.streaming.telemetry import rate_limited_trace


def limited_twin(rows, period):
    out = set()
    for trace in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == trace and r[3] is not None), key=lambda r: (r[2], r[1]))
        kept = None
        for i, r in enumerate(own):
            if kept is None or r[3] - kept >= period or i == len(own) - 1:
                out.add(r[:3])
                kept = r[3]
    return out


@pytest.mark.parametrize("batch", [7, 10_000])
def test_rate_limits_equal_a_fold_over_batches(spark, batch):
    rnd = random.Random(batch)
    rows = []
    for trace in range(9):
        us = clock = 0
        for i in range(rnd.choice((1, 2, 60, 90))):
            us += rnd.randint(0, 3)
            clock += rnd.choice((0, 1, 5)) if trace % 3 else rnd.choice((-4, 1, 5))
            rows.append((trace, i, us, clock))
    rows.append((2, 1000, 5, None))
    frame = spark.createDataFrame(rows, "trace_id long, id long, us long, ctrl_us long").repartition(5)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [tuple(r) for r in rate_limited_trace(frame, 10).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == len(set(got)) and set(got) == limited_twin(rows, 10)


def suppressed_twin(rows, near):
    by = {}
    for k, a, b in near:
        by.setdefault((k, a), set()).add(b)
        by.setdefault((k, b), set()).add(a)
    kept, out = set(), {}
    for k, i, _ in sorted(rows, key=lambda r: (r[0], -r[2], r[1])):
        out[k, i] = not any((k, x) in kept for x in by.get((k, i), ()))
        if out[k, i]:
            kept.add((k, i))
    return out


def test_suppression_equals_a_fold(spark):
    rnd = random.Random(3)
    rows = [(k, i, rnd.choice((0.1, 0.2, 0.3, 0.4, 0.5))) for k in range(3) for i in range(60)]
    near = [(k, rnd.randrange(60), rnd.randrange(60)) for k in range(2) for _ in range(90)] + [(0, 5, 7), (0, 7, 5), (1, 4, 4)]
    got = {(r.k, r.i): r.kept for r in duplicate_pose_suppress(spark.createDataFrame(rows, "k int, i int, score double"), spark.createDataFrame(near, "k int, a int, b int"), "k", "i").collect()}
    want = suppressed_twin(rows, near)
    assert got == want and {False, True} == set(want.values())
    chain = [(0, i, float(-i)) for i in range(7)]
    links = [(0, i, i + 1) for i in range(6)]
    got = duplicate_pose_suppress(spark.createDataFrame(chain, "k int, i int, score double"), spark.createDataFrame(links, "k int, a int, b int"), "k", "i").collect()
    assert {r.i for r in got if r.kept} == {0, 2, 4, 6} and len(got) == 7
