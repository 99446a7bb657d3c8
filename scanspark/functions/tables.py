"""Table functions for SQL: what a row or a table of rays turns into."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from scanspark.operators.geometry import RAY, VOXELS, free_voxels, voxel_batches


@udtf(returnType="ix long, iy long, iz long", useArrow=True)
class VoxelsOfRay:
    """The voxels of one ray: `FROM rays, LATERAL voxels_of_ray(sx, sy, sz, ex, ey, ez, size, margin)`. A ray with a null has none."""

    def eval(self, sx: float, sy: float, sz: float, ex: float, ey: float, ez: float, size: float, margin: float) -> Iterator[tuple]:
        ends = (sx, sy, sz, ex, ey, ez)
        if any(c is None for c in ends):
            return
        _, voxels = free_voxels(np.array([ends[:3]], float), np.array([ends[3:]], float), size, margin)
        yield from map(tuple, voxels.tolist())


@arrow_udtf(returnType=VOXELS)
class VoxelsOfRays:
    """The voxels of a table of rays (map_id, seq and their ends, without nulls), in batches: `FROM voxels_of_rays(TABLE(SELECT map_id, seq, sx, sy, sz, ex, ey, ez FROM rays), size, margin)`.

    A voxel may come more than once for a source, from different batches.
    """

    def eval(self, batch: pa.RecordBatch, size: pa.Array, margin: pa.Array) -> Iterator[pa.RecordBatch]:
        rows = batch.select(["map_id", "seq", *RAY])
        if rows.num_rows:
            yield from (pa.Table.from_batches([b]) for b in voxel_batches([rows], float(size[0].as_py()), float(margin[0].as_py())))


def register_tables(spark: SparkSession) -> None:
    """Makes voxels_of_ray and voxels_of_rays known to the session's SQL."""
    spark.udtf.register("voxels_of_ray", VoxelsOfRay)
    spark.udtf.register("voxels_of_rays", VoxelsOfRays)
