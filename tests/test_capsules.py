"""Distances of segments that pass each other between their ends."""

import numpy as np

from scanspark.operators.joins import capsule_findings

SCHEMA = "sample_id long, n long, r double, x0 double, y0 double, z0 double, x1 double, y1 double, z1 double"


def found(spark, pairs, clearance):
    rows = [(k, n, 0.05, *map(float, ends)) for k, pair in enumerate(pairs) for n, ends in zip((0, 2), pair, strict=True)]
    return {r.sample_id: r.gap for r in capsule_findings(spark.createDataFrame(rows, SCHEMA), clearance).collect()}


def test_crossing_skew_parallel_and_point_segments(spark):
    x, y, up = (-1, 0, 0, 1, 0, 0), (0, -1, 0, 0, 1, 0), (0, -1, 0.08, 0, 1, 0.08)
    pairs = [(x, y), (x, up), (x, (-1, 0.1, 0, 1, 0.1, 0)), (x, (0, 0.2, 0, 0, 0.2, 0)), (x, (3, -1, 0, 3, 1, 0)), ((2, 2, 2, 2, 2, 2), (2, 2, 2, 2, 2, 2))]
    got = found(spark, pairs, 0.0)
    assert {k: round(g, 9) for k, g in got.items()} == {0: 0.0, 1: 0.08, 2: 0.1, 5: 0.0}


def test_segments_equal_dense_samples(spark):
    rnd = np.random.default_rng(4)
    pairs = rnd.uniform(-1, 1, (60, 2, 6))
    got, at = found(spark, pairs, 100.0), np.linspace(0, 1, 401)[:, None]
    for k, (a, b) in enumerate(pairs):
        p, q = (s[:3] + at * (s[3:] - s[:3]) for s in (a, b))
        least = np.sqrt(((p[:, None] - q[None]) ** 2).sum(-1)).min()
        assert least - 0.01 <= got[k] <= least + 1e-9
