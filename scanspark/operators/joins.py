"""Joins by place and time: grids instead of nested loops, unions with windows instead of as-of loops."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanspark.functions import columns as C
from scanspark.sources.scratch import LEAST_TASKS, stored


def _cells(points: DataFrame, r: float, axes: Sequence[str], around: bool) -> DataFrame:
    cell = [F.floor(F.col(a) / r).cast("long") for a in axes]
    if not around:
        return points.withColumns({f"__c{i}": c for i, c in enumerate(cell)})
    for i, c in enumerate(cell):
        points = _step(points, i, c)
    return points


def _step(points: DataFrame, i: int, cell) -> DataFrame:
    return points.withColumn(f"__s{i}", F.explode(F.array(*map(F.lit, (-1, 0, 1))))).withColumn(f"__c{i}", cell + F.col(f"__s{i}")).drop(f"__s{i}")


def radius_join(a: DataFrame, b: DataFrame, r: float, a_id: str, b_id: str, keys: Sequence[str] = (), axes: Sequence[str] = "xyz", keep: Sequence[str] = ()) -> DataFrame:
    """a_id, b_id, d2 and keys for all pairs within r, with columns keep of both sides as a_* and b_*.

    Rows of a go to the 3**n grid cells around theirs and meet those of b by equality; both sides are sorted and never broadcast, as the size of a compressed file tells little of its rows.
    A table with itself (b is a, one id, nothing kept) meets by tiles: see radius_pairs.
    """
    if a is b and a_id == b_id and not keep:
        return radius_pairs(a, r, a_id, keys, axes)
    left = _cells(a.select(*keys, F.col(a_id).alias("__a"), *(F.col(x).alias(f"__a{x}") for x in axes), *axes, *(F.col(c).alias(f"a_{c}") for c in keep)), r, axes, around=True).drop(*axes)
    right = _cells(b.select(*keys, F.col(b_id).alias("__b"), *axes, *(F.col(c).alias(f"b_{c}") for c in keep)), r, axes, around=False)
    cells = [f"__c{i}" for i in range(len(axes))]
    joined = left.join(right.hint("merge"), [*keys, *cells])
    gap = [F.col(x) - F.col(f"__a{x}") for x in axes]
    joined = joined.withColumn("d2", C.dot(gap, gap)).filter(F.col("d2") <= r * r)
    same = a_id == b_id
    kept = [f"{s}_{c}" for s in "ab" for c in keep]
    return joined.select(*keys, F.col("__a").alias(f"{a_id}_a" if same else a_id), F.col("__b").alias(f"{b_id}_b" if same else b_id), "d2", *kept)


#: Places of a tile of radius_pairs, about; pairs in both directions that a task of it tests, about; those tested at once; pairs that are written in one direction before they follow
#: in the other (Snappy finds no repeats after longer runs of numbers, or after many powers of two); points of one place that are tested as one.
TILE, TESTS, AT_ONCE, RUN, COPIES = 1024, 16_000_000, 1 << 18, 96, 16


def radius_pairs(points: DataFrame, r: float, point_id: str, keys: Sequence[str] = (), axes: Sequence[str] = "xyz") -> DataFrame:
    """keys, point_id_a, point_id_b, d2 of all pairs within r in both directions, each point with itself among them.

    Up to COPIES points at one place are one row until the end, when their pairs follow each other: a distance is reckoned once and held about once. The places of a grid cell are dealt
    over tiles of TILE or so. Two tiles of cells that touch meet once, by equality, as rows of their own: a dense cell is many tasks' work, and a task holds two tiles. Rows out are as
    many as the pairs; they come in runs of one direction and then the other, so that files hold the distances of a run once.
    """
    keys, cell = list(keys), [f"__c{i}" for i in range(len(axes))]
    p = points.select(*keys, F.col(point_id).alias("__id"), *(F.col(x).cast("double").alias(f"__{x}") for x in axes), *axes)
    for x in axes:  # What is nowhere or infinitely far is near nothing.
        p = p.filter(F.abs(f"__{x}") < float("inf"))
    p = _cells(p, r, axes, around=False).drop(*axes)
    out = p.select(*keys, F.col("__id").alias(f"{point_id}_a"), F.col("__id").alias(f"{point_id}_b"), F.lit(0.0).alias("d2")).schema
    # As structs null ids are kept.
    p = p.groupBy(*keys, *cell, *(f"__{x}" for x in axes)).agg(F.transform(F.sort_array(F.collect_list(F.struct("__id"))), lambda x: x["__id"]).alias("__all"))
    first = F.sequence(F.lit(1), F.size("__all"), F.lit(COPIES))
    p = stored(p.withColumn("__first", F.explode(first)).withColumn("__ids", F.slice("__all", F.col("__first"), F.lit(COPIES))).drop("__all"), "tile-places")
    many = [F.count(F.lit(1)).alias("places"), F.sum(F.size("__ids")).alias("n")]
    counts = stored(p.groupBy(*keys, *cell).agg(*many).withColumns({"cell": F.monotonically_increasing_id(), "parts": F.ceil(F.col("places") / TILE)}).drop("places"), "tiles")
    around = counts.select(*keys, *cell, F.col("cell").alias("own"), F.col("n").alias("many"), F.col("parts").alias("own_parts"))
    for i, c in enumerate(cell):
        around = _step(around.withColumn(f"__o{i}", F.col(c)), i, F.col(c))
    met = around.join(counts.hint("merge"), [*keys, *cell]).groupBy(*keys, *(F.col(f"__o{i}").alias(c) for i, c in enumerate(cell)), "own", "own_parts")
    met = stored(met.agg(F.collect_list(F.struct("cell", "parts")).alias("met"), F.sum(F.col("many") * F.col("n").cast("double")).alias("tests")), "tiles-met")
    tests = met.agg(F.sum("tests")).first()[0] or 1.0
    tasks = max(min(LEAST_TASKS, math.ceil(tests / 1e6)), math.ceil(tests / TESTS))
    part = F.pmod(F.xxhash64("__first", *(f"__{x}" for x in axes)), F.col("own_parts"))
    rows = p.join(met.drop("tests").hint("merge"), [*keys, *cell]).withColumn("own", F.struct("own", part.alias("part"))).withColumn("met", F.explode("met"))
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("met.parts") - 1))).withColumn("met", F.struct(F.col("met.cell").alias("own"), "part"))
    pair = F.least("own", "met"), F.greatest("own", "met")
    pair = [c.getField(f).alias(f"__{f}{k}") for k, c in enumerate(pair) for f in ("own", "part")]
    rows = rows.select(*keys, "__ids", *(f"__{x}" for x in axes), *pair, (F.col("own") > F.col("met")).alias("__second"))
    tile = ["__own0", "__part0", "__own1", "__part1"]
    rows = rows.repartition(tasks, *tile).sortWithinPartitions(*tile, "__second")
    return rows.mapInArrow(lambda batches: pair_batches(batches, r, keys, [f"__{x}" for x in axes], out.names), out)


def pair_batches(batches: Iterator[pa.RecordBatch], r: float, keys: Sequence[str], axes: Sequence[str], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The pairs within r of rows sorted by two tiles and which of them a row is of. Held are two tiles and a batch, and AT_ONCE pairs under test."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        # Up to the last change of tiles, pairs of tiles are whole.
        last = max(np.flatnonzero(_changes(batch)), default=0)
        if last or held and _changes(pa.concat_batches([held[-1].slice(held[-1].num_rows - 1), batch.slice(0, 1)])).any():
            yield from _near(pa.concat_batches([*held, batch.slice(0, last)]), r, keys, axes, names)
            held = []
        held.append(batch.slice(last))
    if held:
        yield from _near(pa.concat_batches(held), r, keys, axes, names)


def _changes(rows: pa.RecordBatch) -> np.ndarray:
    """Whether each row is the first of its two tiles; never the first row."""
    out = np.zeros(rows.num_rows, bool)
    for c in ("__own0", "__part0", "__own1", "__part1"):
        v = rows[c].to_numpy()
        out[1:] |= v[1:] != v[:-1]
    return out


def _near(rows: pa.RecordBatch, r: float, keys: Sequence[str], axes: Sequence[str], names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    at = [rows[x].to_numpy() for x in axes]
    first, ids = rows["__ids"].offsets.to_numpy().astype(int), rows["__ids"].values
    copies, first = np.diff(first), first[:-1]
    second = rows["__second"].to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(_changes(rows))
    n = np.diff(starts, prepend=0, append=len(second))
    end = np.repeat(np.cumsum(n), n)
    # Each row of a first tile meets all of the second one; within one tile, those after it.
    same = (rows["__own0"].to_numpy() == rows["__own1"].to_numpy()) & (rows["__part0"].to_numpy() == rows["__part1"].to_numpy())
    tile = np.repeat(np.arange(len(n)), n)
    begin = np.where(same, np.arange(len(second)) + 1, end - np.bincount(tile, second, len(n)).astype(int)[tile])
    own = np.flatnonzero(~second)
    begin, many, alone = begin[own], (end - begin)[own], same[own]
    # Pairs of points, not of places, are those at once.
    before = np.concatenate([[0], np.cumsum(copies)])
    done = np.cumsum(copies[own] * (before[begin + many] - before[begin] + copies[own] * alone))
    k = 0
    while k < len(own):
        to = max(k + 1, int(np.searchsorted(done, (done[k - 1] if k else 0) + AT_ONCE, "right")))
        m = many[k:to]
        i = np.repeat(own[k:to], m)
        j = np.arange(len(i)) + np.repeat(begin[k:to] - np.cumsum(m) + m, m)
        d2 = sum((at_x[j] - at_x[i]) ** 2 for at_x in at)
        near = np.flatnonzero(d2 <= r * r)
        i, j, d2, itself = i[near], j[near], d2[near], own[k:to][alone[k:to]]
        k = to
        place, a, b = _points(i, j, first, copies)
        i, d2 = i[place], d2[place]
        alike, c, d = _points(itself, itself, first, copies)
        c, d, i, gap = np.concatenate([c, _runs(a, b)]), np.concatenate([d, _runs(b, a)]), np.concatenate([itself[alike], _runs(i, i)]), np.concatenate([np.zeros(len(c)), _runs(d2, d2)])
        if len(c):
            yield pa.RecordBatch.from_arrays([*(rows[x].take(pa.array(i)) for x in keys), ids.take(pa.array(c)), ids.take(pa.array(d)), pa.array(gap)], names=list(names))


def _points(i: np.ndarray, j: np.ndarray, first: np.ndarray, copies: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For all pairs of points of the places i and j, in order: which pair of places, and the two points."""
    n = copies[i] * copies[j]
    place = np.repeat(np.arange(len(i)), n)
    if len(place) == len(i):
        return place, first[i], first[j]
    nth, width = np.arange(len(place)) - np.repeat(np.cumsum(n) - n, n), copies[j][place]
    return place, first[i][place] + nth // width, first[j][place] + nth % width


def _runs(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """RUN values of one, then as many of the other at the same places, and so on."""
    whole = len(one) - len(one) % RUN
    return np.concatenate([np.stack([one[:whole].reshape(-1, RUN), other[:whole].reshape(-1, RUN)], axis=1).ravel(), one[whole:], other[whole:]])


def start_radius(points: DataFrame, r: float, keys: Sequence[str] = (), axes: Sequence[str] = "xyz", most: float = 8.0) -> float:
    """r, halved until the grid cell of a point holds `most` points or so. The driver gets a number for each try: two or three as a rule, 20 at most."""
    where = lambda size: [*keys, *(F.floor(F.col(a) / size).cast("long").alias(f"__c{i}") for i, a in enumerate(axes))]
    for _ in range(20):
        n = F.col("count").cast("double")
        met = points.groupBy(*where(r)).count().agg(F.sum(n * n) / F.sum(n)).first()[0] or 0.0
        if met <= most:
            break
        r /= 2 ** max(1, math.ceil(math.log(met / most, 2 ** len(axes))))
    return r


def closest(a: DataFrame, b: DataFrame, r: float, a_id: str, value: str, keys: Sequence[str] = (), axes: Sequence[str] = "xyz", start: float | None = None) -> DataFrame:
    """keys, a_id, d2 and value of the row of b nearest to each row of a within r, of equals the smallest value; rows of a without one are left out.

    Rows of b at one place are one. Rows of a look around themselves from start on (by default a radius that meets few rows), and those that found none look again
    twice as far, to r at last: a row's work follows the rows around its nearest one, not all within r. Each round is stored.
    """
    keys = list(keys)
    places = stored(b.groupBy(*keys, *axes).agg(F.min(value).alias("__v")), "places")
    radius = start_radius(places, r, keys, axes) if start is None else min(start, r)
    todo, out = a.select(*keys, a_id, *axes), None
    while True:
        near = radius_join(todo, places, radius, a_id, "__v", keys, axes)
        found = near.groupBy(*keys, a_id).agg(F.min(F.struct("d2", "__v")).alias("m")).select(*keys, a_id, "m.d2", F.col("m.__v").alias(value))
        if radius < r:
            found = stored(found, "nearest")
        out = found if out is None else out.unionByName(found)
        if radius >= r:
            return out
        todo = stored(todo.join(found.select(*keys, a_id).hint("merge"), [*keys, a_id], "left_anti"), "nearest-todo")
        if todo.isEmpty():
            return out
        radius = min(2 * radius, r)


def nearest_neighbor(a: DataFrame, b: DataFrame, r: float, a_id: str, b_id: str, keys: Sequence[str] = (), axes: Sequence[str] = "xyz", start: float | None = None) -> DataFrame:
    """For each row of a the nearest row of b within r, of equals the smallest id; null where there is none. start: see closest."""
    best = closest(a.withColumnRenamed(a_id, "__q"), b.withColumnRenamed(b_id, "__r"), r, "__q", "__r", keys, axes, start)
    best = best.select(*keys, F.col("__q").alias(a_id), F.col("__r").alias(b_id if b_id != a_id else f"{b_id}_b"), F.sqrt("d2").alias("distance"))
    return a.select(*keys, a_id).join(best.hint("merge"), [*keys, a_id], "left")


def knn(points: DataFrame, k: int, r: float, point_id: str, keys: Sequence[str] = (), axes: Sequence[str] = "xyz") -> DataFrame:
    """point_id, neighbor_id, d2, rank: the k nearest others of each point, or all where its key has no more; ties go to the smaller id.

    Points look around themselves from r on, or less where r meets many. Those that have not found theirs are tried again with twice the radius (they alone) until
    it spans all points. Of points at one place only the k + 1 of the smallest ids can be neighbours and are met. Each round is stored.
    """
    p = points.select(*keys, F.col(point_id).alias("point_id"), *axes)
    size = p.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("most"))
    edges = p.agg(*(F.max(a) - F.min(a) for a in axes)).first()
    extent = sum((e or 0.0) ** 2 for e in edges) ** 0.5
    todo = p.join(size, list(keys)) if keys else p.crossJoin(F.broadcast(size))
    first = Window.partitionBy(*keys, *axes).orderBy("point_id")
    met = stored(p.withColumn("__nth", F.row_number().over(first)).filter(F.col("__nth") <= k + 1).drop("__nth").withColumnRenamed("point_id", "neighbor_id"), "neighbours-met")
    r = start_radius(met, r, keys, axes, 2 * (k + 1))
    out = None
    while out is None or not todo.isEmpty():
        near = radius_join(todo, met, r, "point_id", "neighbor_id", keys, axes).filter("point_id <> neighbor_id")
        w = Window.partitionBy(*keys, "point_id")
        found = near.withColumn("rank", F.row_number().over(w.orderBy("d2", "neighbor_id"))).filter(F.col("rank") <= k)
        found = stored(found.withColumn("n", F.count(F.lit(1)).over(w)), "neighbours")
        whole = found.select(*keys, "point_id", "n").distinct().join(todo.select(*keys, "point_id", "most").hint("merge"), [*keys, "point_id"])
        whole = whole.filter(F.col("n") >= F.least(F.lit(k), F.col("most"))) if r < extent else whole
        got = found.join(whole.select(*keys, "point_id").hint("merge"), [*keys, "point_id"], "left_semi").drop("n")
        out = got if out is None else out.unionByName(got)
        if r >= extent:
            break
        todo = stored(todo.filter("most > 0").join(whole.select(*keys, "point_id").hint("merge"), [*keys, "point_id"], "left_anti"), "neighbours-todo")
        r *= 2
    return out


def visibility_join(targets: DataFrame, zbuffer: DataFrame, tolerance: float) -> DataFrame:
    """targets (pu, pv, z) with visible: no nearer surface at their pixel (floor), within tolerance."""
    at = targets.withColumns({"v": F.floor("pv").cast("long"), "u": F.floor("pu").cast("long")})
    out = at.join(zbuffer.select("view_id", "v", "u", F.col("z").alias("__front")), ["view_id", "v", "u"], "left")
    return out.withColumn("visible", F.coalesce(F.col("z") <= F.col("__front") + tolerance, F.lit(False))).drop("__front")


def bracket_join(frames: DataFrame, states: DataFrame, trace: str, time: str, state_id: str) -> DataFrame:
    """frames with the states before and after them in their trace (ids and times), the nearer one (the one before of equals) and the bracket's length.

    A frame outside the states has nulls. One union and one window for each trace: no pairs are formed.
    """
    s = states.select(F.col(trace), F.col(time).alias("__t"), F.col(state_id).alias("__s"), F.lit(None).cast("long").alias("__f"))
    f = frames.select(F.col(trace), F.col(time).alias("__t"), F.lit(None).cast(states.schema[state_id].dataType).alias("__s"), F.col("frame_id").cast("long").alias("__f"))
    both = s.unionByName(f)
    state = F.when(F.col("__f").isNull(), F.struct("__t", "__s"))
    up = Window.partitionBy(trace).orderBy("__t", F.col("__f").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(trace).orderBy("__t", F.col("__f").isNull()).rowsBetween(0, Window.unboundedFollowing)
    out = both.withColumns({"b": F.last(state, True).over(up), "a": F.first(state, True).over(down)}).filter("__f IS NOT NULL")
    whole = F.col("a").isNotNull() & F.col("b").isNotNull()
    before, after = F.col("__t") - F.col("b.__t"), F.col("a.__t") - F.col("__t")
    return out.select(
        trace, F.col("__f").alias("frame_id"), F.when(whole, F.col("b.__s")).alias("before_id"), F.when(whole, F.col("a.__s")).alias("after_id"),
        F.when(whole, F.when(before <= after, F.col("b.__s")).otherwise(F.col("a.__s"))).alias("selected_id"), F.when(whole, F.col("a.__t") - F.col("b.__t")).alias("bracket"),
    )


#: Into how many parts the pairs of a key are cut, so that a key's pairs are not one task's work.
PARTS = 64


def pose_pairs(poses: DataFrame, key: str, order: str, keep: Sequence[str] = ()) -> DataFrame:
    """key, a, b (a before b in order), translation, rotation_deg and columns keep of both (a_*, b_*) for all pairs of a key's poses.

    Poses as a are dealt over PARTS parts, and each part meets all of the key's poses as b; the pairs themselves are as many as they are.
    """
    one = poses.withColumn("__part", F.pmod(F.xxhash64(order), F.lit(PARTS)))
    every = poses.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(PARTS - 1).cast("long"))))
    a = one.select(key, "__part", F.col(order).alias("a"), *(F.col(c).alias("a_" + c) for c in (*C.POSE, *keep)))
    b = every.select(key, "__part", F.col(order).alias("b"), *(F.col(c).alias("b_" + c) for c in (*C.POSE, *keep)))
    j = a.join(b.hint("merge"), [key, "__part"]).filter("a < b")
    (ra, ta), (rb, tb) = C.pose("a_"), C.pose("b_")
    trace = sum((C.dot(x, y) for x, y in zip(ra[1:], rb[1:], strict=True)), C.dot(ra[0], rb[0]))
    gap = [y - x for x, y in zip(ta, tb, strict=True)]
    return j.select(key, "a", "b", C.norm(gap).alias("translation"), C.angle_deg((trace - 1) / 2).alias("rotation_deg"), *(f"{s}_{c}" for s in "ab" for c in keep))


def view_independence(views: DataFrame, accepted: DataFrame, key: str, order: str, least_m: float, least_deg: float) -> DataFrame:
    """views with independent: no accepted view of the key that is both nearer than least_m and turned by less than least_deg."""
    a = views.select(key, order, *(F.col(c).alias("a_" + c) for c in C.POSE))
    b = accepted.select(key, *(F.col(c).alias("b_" + c) for c in C.POSE))
    (ra, ta), (rb, tb) = C.pose("a_"), C.pose("b_")
    trace = sum((C.dot(x, y) for x, y in zip(ra[1:], rb[1:], strict=True)), C.dot(ra[0], rb[0]))
    gap = C.norm([y - x for x, y in zip(ta, tb, strict=True)])
    close = a.join(b, key).filter((gap < least_m) & (C.angle_deg((trace - 1) / 2) < least_deg)).select(key, order).distinct()
    return views.join(close.withColumn("__close", F.lit(True)), [key, order], "left").withColumn("independent", F.col("__close").isNull()).drop("__close")


def sphere_voxels(spheres: DataFrame, size: float) -> DataFrame:
    """sphere_id, ix, iy, iz of voxels whose cube meets the sphere (x, y, z, r)."""
    out = spheres
    for a in "xyz":
        out = out.withColumn(f"i{a}", F.explode(F.sequence(F.floor((F.col(a) - F.col("r")) / size), F.floor((F.col(a) + F.col("r")) / size))))
    gap = [F.greatest(F.col(f"i{a}") * size - F.col(a), F.lit(0.0), F.col(a) - (F.col(f"i{a}") + 1) * size) for a in "xyz"]
    return out.filter(C.dot(gap, gap) <= F.col("r") * F.col("r")).select("sphere_id", *(F.col(f"i{a}").cast("long").alias(f"i{a}") for a in "xyz"))


def box_cells(boxes: DataFrame, size: float) -> DataFrame:
    """box_id and each voxel whose centre lies in a closed box (x0, x1, y0, y1, z0, z1)."""
    out = boxes
    for a in "xyz":
        low, high = F.ceil(F.col(f"{a}0") / size - 0.5), F.floor(F.col(f"{a}1") / size - 0.5)
        out = out.withColumn(f"i{a}", F.explode(F.when(low <= high, F.sequence(low, high))))
    return out.select("box_id", *(F.col(f"i{a}").cast("long").alias(f"i{a}") for a in "xyz"))


def voxel_in_boxes(voxels: DataFrame, boxes: DataFrame, size: float, tolerance: float = 1e-12) -> DataFrame:
    """voxels (state, ix, iy, iz) where UNKNOWN ones that lie whole in a box become ACCEPTED_FREE; others stay."""
    out = boxes
    for a in "xyz":
        low, high = F.ceil(F.col(f"{a}0") / size - tolerance), F.floor(F.col(f"{a}1") / size + tolerance) - 1
        out = out.withColumn(f"i{a}", F.explode(F.when(low <= high, F.sequence(low, high))))
    inside = out.select(*(F.col(f"i{a}").cast("long").alias(f"i{a}") for a in "xyz")).distinct().withColumn("__in", F.lit(True))
    got = voxels.join(inside, ["ix", "iy", "iz"], "left")
    return got.withColumn("state", F.when((F.col("state") == "UNKNOWN") & F.col("__in"), "ACCEPTED_FREE").otherwise(F.col("state"))).drop("__in")


def capsule_findings(capsules: DataFrame, clearance: float) -> DataFrame:
    """sample_id, i, j of capsules (a chain of segments by number, radius r, from x0.. to x1..) that are no neighbours (j >= i + 2) and nearer than r + r + clearance.

    The distance is that of the segments, wherever on them the nearest points lie.
    """
    ends = [f"{a}{k}" for k in (0, 1) for a in "xyz"]
    a = capsules.select("sample_id", F.col("n").alias("i"), F.col("r").alias("ra"), *(F.col(c).alias("a" + c) for c in ends))
    b = capsules.select("sample_id", F.col("n").alias("j"), F.col("r").alias("rb"), *(F.col(c).alias("b" + c) for c in ends))
    j = a.join(b, "sample_id").filter("j >= i + 2")
    p = lambda s, k: [F.col(f"{s}{x}{k}") for x in "xyz"]
    gap = C.segment_gap(p("a", 0), p("a", 1), p("b", 0), p("b", 1))
    return j.withColumn("gap", gap).filter(F.col("gap") <= F.col("ra") + F.col("rb") + clearance).select("sample_id", "i", "j", "gap")


#: every_pair: rows of the one side that meet at once, ids of the other in a row, ids in a part, about; rows out of a task, about, and of a task of a small table, up to so many tasks.
MEET, IDS, PART_IDS, ROWS, FEW_ROWS, FEW_TASKS = 1024, 128, 65_536, 32_000_000, 4_000_000, 512


def every_pair(a: DataFrame, b: DataFrame, keys: Sequence[str], b_id: str) -> DataFrame:
    """The columns of a and b_id, for every pair of a row of a and one of b (keys and b_id) that agree in keys, none of them null.

    Both sides are cut by what a key holds: about MEET rows of a meet about PART_IDS ids, IDS of them at a time, and all pairs are PARTS cuts at least. So tasks are as many as the rows
    out ask for, and a task holds MEET times IDS rows whatever a key holds (Spark's code keeps all that a row of a join's first side makes). The ids of a row follow each other for row
    after row of a, and few rows of a are in a file, so that files stay small.
    """
    keys, more = list(keys), [c for c in a.columns if c not in keys]
    many = [df.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for df, n in ((a, "__rows"), (b, "__ids"))]
    sizes = stored(many[0].join(many[1], keys).withColumn("__key", F.monotonically_increasing_id()), "pairs-of-keys")
    total = sizes.agg(F.sum(F.col("__rows") * F.col("__ids").cast("double"))).first()[0] or 1.0
    tasks = max(LEAST_TASKS, min(FEW_TASKS, math.ceil(total / FEW_ROWS)), math.ceil(total / ROWS))
    share = F.ceil(F.col("__rows") * F.col("__ids").cast("double") * (PARTS / total))
    meets, blocks, parts = F.greatest(F.ceil(F.col("__rows") / MEET), F.least("__rows", share)), F.ceil(F.col("__ids") / IDS), F.ceil(F.col("__ids") / PART_IDS)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    left = a.join(sizes, keys).select("__key", *a.columns, F.pmod(F.xxhash64(*more), meets).alias("__meet"), each(parts).alias("__part"))
    # As structs null ids are kept.
    right = b.join(sizes, keys).groupBy("__key", F.pmod(F.xxhash64(b_id), blocks).alias("__block"), meets.alias("__meets"), parts.alias("__parts"))
    right = right.agg(F.transform(F.sort_array(F.collect_list(F.struct(b_id))), lambda x: x[b_id]).alias("__list"))
    right = right.select("__key", "__list", F.pmod("__block", "__parts").alias("__part"), each(F.col("__meets")).alias("__meet"))
    # A row of ids meets all rows of a before the next one does. Keys are numbers here: Spark doesn't join by a key that is constant, and would deal the rows anew, over few tasks.
    cut = ["__key", "__meet", "__part"]
    met = right.repartition(tasks, *cut).join(left.hint("merge"), cut)
    return met.select(*a.columns, F.explode("__list").alias(b_id))


def capsule_box_findings(capsules: DataFrame, boxes: DataFrame, clearance: float, cell: float) -> DataFrame:
    """sample_id, n, box_id of capsules (as in capsule_findings) whose segment meets a box (box_id, x0, x1, ..) expanded by r + clearance (slab test).

    Boxes at one place are tested once. Both sides go to the grid cells of length cell that their bounds reach and meet there by equality; a pair is tested in one cell only, the
    first that both reach, so nothing is made distinct. cell should be about as long as a box. A null coordinate or radius gives no finding.
    What a place finds meets the place's ids as in every_pair: tasks are as many as the rows out ask for.
    """
    e = F.col("r") + clearance
    ends = [f"{a}{k}" for k in (0, 1) for a in "xyz"]
    c = capsules.select("sample_id", "n", e.alias("__e"), *(F.col(x).alias("__c" + x) for x in ends))
    places = stored(boxes.na.drop(subset=ends).select(*ends).distinct().withColumn("__box", F.monotonically_increasing_id()), "box-places")
    b = places
    for a in "xyz":
        low, high = F.least(f"__c{a}0", f"__c{a}1") - F.col("__e"), F.greatest(f"__c{a}0", f"__c{a}1") + F.col("__e")
        c = c.withColumn(f"__l{a}", F.floor(low / cell)).withColumn(a, F.explode(F.sequence(f"__l{a}", F.floor(high / cell))))
        b = b.withColumn(f"__m{a}", F.floor(F.col(f"{a}0") / cell)).withColumn(a, F.explode(F.sequence(f"__m{a}", F.floor(F.col(f"{a}1") / cell))))
    j = c.join(b, list("xyz"))
    enter, leave = [F.lit(0.0)], [F.lit(1.0)]
    for a in "xyz":
        j = j.filter(F.col(a) == F.greatest(f"__l{a}", f"__m{a}"))
        start, way = F.col(f"__c{a}0"), F.col(f"__c{a}1") - F.col(f"__c{a}0")
        low, high = F.col(f"{a}0") - F.col("__e"), F.col(f"{a}1") + F.col("__e")
        still, at = F.abs(way) < 1e-12, [F.try_divide(side - start, way) for side in (low, high)]
        enter.append(F.when(still, F.when(start.between(low, high), 0.0).otherwise(2.0)).otherwise(F.least(*at)))
        leave.append(F.when(still, 1.0).otherwise(F.greatest(*at)))
    hits = stored(j.filter(F.greatest(*enter) <= F.least(*leave)).select("__box", "sample_id", "n"), "box-hits")
    return every_pair(hits, boxes.join(places, ends).select("__box", "box_id"), ["__box"], "box_id").drop("__box")


def stereo_match(left: DataFrame, right: DataFrame, least: int = 6) -> DataFrame:
    """Corners (pair_id, corner_id, u, v) seen in both images, of pairs that share at least `least`."""
    j = left.join(right.select("pair_id", "corner_id", F.col("u").alias("u_right"), F.col("v").alias("v_right")), ["pair_id", "corner_id"])
    return j.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("pair_id"))).filter(F.col("__n") >= least).drop("__n")


def opposing_pairs(candidates: DataFrame, keys: Sequence[str], offset: str, row_id: str) -> DataFrame:
    """keys, negative_id, positive_id: negative and positive views of one family, all pairs, by every_pair: a family is not one task's work, and files of them stay small."""
    n = candidates.filter(F.col(offset) < 0).select(*keys, F.col(row_id).alias("negative_id"))
    p = candidates.filter(F.col(offset) > 0).select(*keys, F.col(row_id).alias("positive_id"))
    return every_pair(n, p, keys, "positive_id")


def nearest_accepted(poses: DataFrame, accepted: DataFrame, key: str, row_id: str, least_m: float, least_deg: float) -> DataFrame:
    """For each pose the accepted one of its key nearest by translation / least_m + rotation / least_deg, and whether the pose is novel:
    no accepted one is below both minima. Poses of keys without accepted ones are novel."""
    a = poses.select(key, F.col(row_id), *(F.col(c).alias("a_" + c) for c in C.POSE))
    b = accepted.select(key, F.col(row_id).alias("nearest_id"), *(F.col(c).alias("b_" + c) for c in C.POSE))
    (ra, ta), (rb, tb) = C.pose("a_"), C.pose("b_")
    trace = sum((C.dot(x, y) for x, y in zip(ra[1:], rb[1:], strict=True)), C.dot(ra[0], rb[0]))
    j = a.join(b, key, "left").withColumns({"t": C.norm([y - x for x, y in zip(ta, tb, strict=True)]), "d": C.angle_deg((trace - 1) / 2)})
    best = F.min(F.struct((F.col("t") / least_m + F.col("d") / least_deg).alias("s"), F.col("nearest_id").alias("n"))).alias("m")
    near = F.max(((F.col("t") < least_m) & (F.col("d") < least_deg)).cast("int"))
    return j.groupBy(key, row_id).agg(best, F.coalesce(near, F.lit(0)).alias("near")).select(key, row_id, F.col("m.n").alias("nearest_id"), (F.col("near") == 0).alias("novel"))
