"""The occupancy log against a fold over the sources that a map keeps."""

import random

import pytest

from scanspark.streaming.occupancy import OccupancyLog

ROWS = "map_id long, seq long, ix long, iy long, iz long, hit boolean"


def sources(seed, maps=3, n=14):
    """Sources in order; voxels are few, so they are crossed and hit again and again."""
    rnd = random.Random(seed)
    return [[(m, s, rnd.randint(0, 3), rnd.randint(0, 1), 0, rnd.random() < 0.15) for _ in range(rnd.randint(1, 8))] for s in range(n) for m in range(maps) if rnd.random() < 0.8 or not s]


def twin(rows, keep):
    """Sources one by one: what is hit stays hit, other voxels crossed get a vote."""
    out = {}
    for m in {r[0] for r in rows}:
        seqs = sorted({r[1] for r in rows if r[0] == m})
        for s in seqs[-keep:] if keep else seqs:
            own = [r for r in rows if r[:2] == (m, s)]
            hit = {r[2:5] for r in own if r[5]}
            for v in hit:
                votes, first = out.get((m, *v), (0, None))
                out[m, *v] = (votes, s if first is None else first)
            for v in {r[2:5] for r in own} - hit:
                votes, first = out.get((m, *v), (0, None))
                out[m, *v] = (votes + (first is None), first)
    return out


def held(log, spark):
    return {tuple(r)[:4]: tuple(r)[4:] for r in log.state(spark).collect()}


@pytest.mark.parametrize(("keep", "every"), [(None, 3), (4, 3), (2, 100)])
def test_log_equals_its_twin(spark, tmp_path, keep, every):
    made = sources(3)
    log = OccupancyLog(str(tmp_path / "log"), keep, every).begin(spark)
    assert held(log, spark) == {}
    seen = []
    for number, at in enumerate(range(0, len(made), 9)):
        rows = [r for s in made[at : at + 9] for r in s]
        frame = spark.createDataFrame(rows, ROWS)
        # Sources of a batch that are split over its end would be cut; here they come whole, and old ones come again.
        fresh = [r for r in rows if r[1] > max((x[1] for x in seen if x[0] == r[0]), default=-1)]
        log.add(frame.unionByName(spark.createDataFrame(seen[:20], ROWS)) if seen else frame, number)
        seen += fresh
        assert held(log, spark) == twin(seen, keep), number
        if number == 2:
            log.add(frame, number)  # the batch comes again
            assert held(log, spark) == twin(seen, keep)
    if keep:
        kept = {(r.map_id, r.seq) for r in log.sources(spark).collect()}
        assert kept == {(m, s) for m in {r[0] for r in seen} for s in sorted({r[1] for r in seen if r[0] == m})[-keep:]}
    else:
        assert log.sources(spark).count() == 0


def test_reading_costs_the_map_not_its_history(spark, tmp_path):
    log = OccupancyLog(str(tmp_path / "log"), every=4).begin(spark)
    for number in range(9):
        log.add(spark.createDataFrame([(0, number, i, 0, 0, False) for i in range(20)], ROWS), number)
    since = log.marks(spark).first()["base"]
    read = spark.read.parquet(f"{tmp_path}/log/voxels").filter(f"version >= {since}")
    assert since == 8 and read.count() == 20 and {v[0] for v in held(log, spark).values()} == {9}
