"""Voxels of rays: table functions against the operator, and rows as numbers."""

import numpy as np
import pytest

from scanspark.functions.tables import register_tables
from scanspark.operators.geometry import crossed_voxels, distinct_rows, ray_voxels

SCHEMA = "map_id long, seq long, sx double, sy double, sz double, ex double, ey double, ez double"


@pytest.mark.parametrize("margin", [0.0, 0.4])
def test_table_functions_equal_the_operator(spark, margin):
    rng = np.random.default_rng(2)
    rows = [(i % 3, i % 5, *map(float, rng.uniform(-3, 3, 6))) for i in range(150)] + [(0, 0, *[0.25] * 6), (0, 1, 0.0, 0.0, 0.0, 2.0, 2.0, 2.0), (0, 1, 2.0, 2.0, 2.0, 0.0, 0.0, 0.0), (1, 1, None, 0.0, 0.0, 1.0, 1.0, 1.0)]
    rays = spark.createDataFrame(rows, SCHEMA)
    want = sorted(map(tuple, ray_voxels(rays, 0.5, margin).collect()))
    assert len(want) == len(set(want)) > 500
    register_tables(spark)
    rays.createOrReplaceTempView("some_rays")
    got = spark.sql(f"SELECT DISTINCT map_id, seq, ix, iy, iz FROM some_rays, LATERAL voxels_of_ray(sx, sy, sz, ex, ey, ez, 0.5D, {margin}D)")
    assert sorted(map(tuple, got.collect())) == want
    whole = spark.sql(f"SELECT DISTINCT * FROM voxels_of_rays(TABLE(SELECT * FROM some_rays WHERE sx IS NOT NULL), 0.5D, {margin}D)")
    assert sorted(map(tuple, whole.collect())) == want


def test_crossings_of_one_moment_are_one_step():
    ray, voxel = crossed_voxels(np.array([[0.25] * 3, [1.75] * 3, [0.1, 0.1, 0.1]]), np.array([[1.75] * 3, [0.0] * 3, [0.4, 0.2, 0.3]]), 0.5)
    assert [v for r, v in zip(ray.tolist(), voxel.tolist(), strict=True) if r == 0] == [[0] * 3, [1] * 3, [2] * 3]
    assert [v for r, v in zip(ray.tolist(), voxel.tolist(), strict=True) if r == 1] == [[3] * 3, [2] * 3, [1] * 3] and 2 not in ray


def test_distinct_rows():
    rng = np.random.default_rng(1)
    small = [rng.integers(-3, 3, 500) for _ in range(4)]
    for columns in (small, [c * (1 << 40) for c in small]):
        got = sorted(map(tuple, np.stack(distinct_rows(columns), 1).tolist()))
        assert got == sorted(set(map(tuple, np.stack(columns, 1).tolist())))
