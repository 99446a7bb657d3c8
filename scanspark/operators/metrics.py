"""Error statistics, gates, telemetry and timing summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanspark.operators import ranks
from scanspark.sources.scratch import stored


def depth_metrics(pairs: DataFrame, thresholds: Sequence[float], *keys: str) -> DataFrame:
    """By key: pairs, signed mean and median, MAE, RMSE, exact p95 of the absolute error, and the share within each threshold. pairs: err."""
    e = F.abs("err")
    within = [F.avg((e <= t).cast("double")).alias(f"within_{i}") for i, t in enumerate(thresholds)]
    return pairs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.avg("err").alias("mean"), F.percentile("err", 0.5).alias("median"), F.avg(e).alias("mae"), F.sqrt(F.avg(F.col("err") * F.col("err"))).alias("rmse"), F.percentile(e, 0.95).alias("p95"), *within
    )


def incidence_bin(incidence: Column, edges: Sequence[float]) -> Column:
    """incidence:[a,b]deg; bins are half open, the last is closed; null outside."""
    out = F.lit(None).cast("string")
    for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        top = (incidence <= b) if i == len(edges) - 2 else (incidence < b)
        out = F.when((incidence >= a) & top, f"incidence:[{a:g},{b:g}]deg").otherwise(out)
    return out


def depth_strata(errors: DataFrame, edges: Sequence[float]) -> DataFrame:
    """Pooled over pixels, and the mean of the views' MAE, for all, each side and each incidence bin: one pass over grouping sets.

    errors: view_id, side, incidence_deg, err.
    """
    cut = errors.select("view_id", F.concat(F.lit("side:"), "side").alias("s"), incidence_bin(F.col("incidence_deg"), edges).alias("b"), "err")
    groups = F.array(F.lit("all"), F.col("s"), F.col("b"))
    by_view = cut.groupBy("view_id", "s", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs("err")).alias("a"), F.sum(F.col("err") * F.col("err")).alias("q"), F.sum("err").alias("e"))
    rows = by_view.select(F.explode(F.array_compact(groups)).alias("stratum"), "n", "a", "q", "e")
    n = F.sum("n")
    return rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("views"), n.alias("pixels"), (F.sum("e") / n).alias("mean"), (F.sum("a") / n).alias("mae"), F.sqrt(F.sum("q") / n).alias("rmse"), F.avg(F.col("a") / F.col("n")).alias("view_mae"))


def agreement_curve(errors: DataFrame, thresholds: Sequence[float], *keys: str) -> DataFrame:
    """key, threshold, fraction with an absolute error no larger."""
    t = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), (F.abs("err") <= t).cast("double").alias("in")) for t in thresholds))
    out = errors.select(*keys, F.explode(t).alias("t"))
    return out.groupBy(*keys, "t.threshold").agg(F.avg("t.in").alias("fraction"))


def gate(metrics: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """metrics with passed and reasons: names of the columns below their least or above their most (null fails), in the order given."""
    why = []
    for name, (low, high) in limits.items():
        ok = F.lit(True)
        if low is not None:
            ok = ok & (F.col(name) >= low)
        if high is not None:
            ok = ok & (F.col(name) <= high)
        why.append(F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name)))
    reasons = F.array_compact(F.array(*why))
    return metrics.withColumns({"passed": F.size(reasons) == 0, "reasons": F.concat_ws(",", reasons)})


def nearest_rank(frame: DataFrame, keys: Sequence[str], value: str, q: float) -> DataFrame:
    """By key the value of rank ceil(q * n)."""
    return ranks.nearest_rank(frame, keys, value, q, f"p{round(q * 100)}")


def trial_summary(frame: DataFrame, keys: Sequence[str], series: Sequence[str]) -> DataFrame:
    """By key and series: n, the median cut to a whole number, and the nearest-rank p95."""
    rows = frame.select(*keys, F.explode(F.array(*(F.struct(F.lit(s).alias("series"), F.col(s).cast("long").alias("value")) for s in series))).alias("s")).select(*keys, "s.*")
    k = [*keys, "series"]
    out = stored(rows.groupBy(*k).agg(F.count("value").alias("n")), "trials")
    middle = ranks.percentile(rows, k, "value", 0.5, "p50").withColumn("p50", F.floor("p50"))
    # A series without a value has no row, as it has no p95.
    return out.join(middle, k).join(nearest_rank(rows, k, "value", 0.95), k)


def hotspot_rank(summary: DataFrame, name: str, by: str = "p50") -> DataFrame:
    w = Window.partitionBy("series").orderBy(F.desc(by), name)
    return summary.withColumn("rank", F.row_number().over(w))


def sample_gaps(states: DataFrame, most_us: int) -> DataFrame:
    """states with gap (to the sample before, of either clock the larger), lag_us (controller behind host since the first sample) and stale."""
    w = Window.partitionBy("trace_id").orderBy("us", "id")
    host, ctrl = F.col("us") - F.lag("us").over(w), F.col("ctrl_us") - F.lag("ctrl_us").over(w)
    lag = (F.col("us") - F.first("us").over(w)) - (F.col("ctrl_us") - F.first("ctrl_us").over(w))
    return states.withColumns({"gap": F.greatest(host, ctrl), "lag_us": lag}).withColumn("stale", F.coalesce(F.col("gap") > most_us, F.lit(False)))


def frozen_runs(states: DataFrame, most_us: int) -> DataFrame:
    """Runs of samples with one controller time: trace, run, start, length, samples, and whether it lasts longer than most_us."""
    w = Window.partitionBy("trace_id").orderBy("us", "id")
    changed = F.coalesce((F.col("ctrl_us") != F.lag("ctrl_us").over(w)).cast("int"), F.lit(1))
    runs = states.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w))
    out = runs.groupBy("trace_id", "run").agg(F.min("us").alias("start_us"), (F.max("us") - F.min("us")).alias("length_us"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("frozen", F.col("length_us") > most_us)


def stream_gap_stats(states: DataFrame) -> DataFrame:
    """By trace: packets, largest host and controller gaps, largest and last lag against the first sample."""
    w = Window.partitionBy("trace_id").orderBy("us", "id")
    s = states.withColumns({"h": F.col("us") - F.lag("us").over(w), "c": F.col("ctrl_us") - F.lag("ctrl_us").over(w), "lag": (F.col("us") - F.first("us").over(w)) - (F.col("ctrl_us") - F.first("ctrl_us").over(w))})
    return s.groupBy("trace_id").agg(F.count(F.lit(1)).alias("packets"), F.max("h").alias("host_gap"), F.max("c").alias("ctrl_gap"), F.max("lag").alias("most_lag"), F.max_by("lag", F.struct("us", "id")).alias("last_lag"))


def tick_summary(ticks: DataFrame, period: float, *keys: str) -> DataFrame:
    """Mean and largest of value and of the overrun max(0, value - period), with the nearest-rank p95 of value."""
    over = F.greatest(F.lit(0.0), F.col("value") - period)
    out = ticks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most"), F.avg(over).alias("mean_overrun"), F.max(over).alias("most_overrun"))
    return out.join(nearest_rank(ticks, keys, "value", 0.95), list(keys))


def monotonic_check(events: DataFrame, key: str, seq: str, time: str | None = None) -> DataFrame:
    """By key: rows, whether sequences run from 0 without gaps or repeats, and whether time never falls."""
    w = Window.partitionBy(key).orderBy(seq)
    late = F.coalesce(F.col(time) < F.lag(time).over(w), F.lit(False)) if time else F.lit(False)
    rows = events.withColumns({"__off": (F.row_number().over(w) - 1 != F.col(seq)).cast("int"), "__late": late.cast("int")})
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), (F.sum("__off") == 0).alias("contiguous"), (F.sum("__late") == 0).alias("ordered"))


def chain_hashes(events: DataFrame, key: str = "run_id", seq: str = "seq", payload: str = "payload") -> DataFrame:
    """sha of each event's own content: the SHA-256 of key, sequence and payload."""
    return events.withColumn("sha", F.sha2(F.concat_ws("\n", F.col(key).cast("string"), F.col(seq).cast("string"), F.col(payload)), 256))


def hash_chain_check(events: DataFrame, key: str = "run_id", seq: str = "seq", payload: str = "payload") -> DataFrame:
    """events (sha, prev_sha) with intact: the hash recomputes, prev_sha is the sha before, and the first has none and sequence 0."""
    w = Window.partitionBy(key).orderBy(seq)
    own = F.sha2(F.concat_ws("\n", F.col(key).cast("string"), F.col(seq).cast("string"), F.col(payload)), 256)
    first = F.row_number().over(w) == 1
    link = F.when(first, F.col("prev_sha").isNull() & (F.col(seq) == 0)).otherwise(F.col("prev_sha").eqNullSafe(F.lag("sha").over(w)))
    return events.withColumn("intact", (F.col("sha") == own) & link)


def table_hash(frame: DataFrame, *keys: str, buckets: int = 256) -> DataFrame:
    """By key an order-free SHA-256 of the rows: row hashes are sorted and hashed in buckets, then the buckets' hashes."""
    rest = [c for c in sorted(frame.columns) if c not in keys]
    row = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    rows = frame.select(*keys, row.alias("h"), F.pmod(F.xxhash64(row), F.lit(buckets)).alias("b"))
    part = rows.groupBy(*keys, "b").agg(F.count(F.lit(1)).alias("n"), F.sha2(F.concat_ws("", F.sort_array(F.collect_list("h"))), 256).alias("h"))
    return part.groupBy(*keys).agg(F.sum("n").alias("n"), F.sha2(F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("b", "h"))), lambda s: s["h"])), 256).alias("sha256"))


def rolling_source_window(views: DataFrame, key: str, seq: str, time: str, most_gap: int, keep: int) -> DataFrame:
    """The last `keep` views of a key after its last gap longer than most_gap."""
    w = Window.partitionBy(key).orderBy(seq)
    gap = F.coalesce((F.col(time) - F.lag(time).over(w) > most_gap).cast("int"), F.lit(0))
    out = views.withColumn("__g", gap).withColumn("__i", F.sum("__g").over(w))
    out = out.withColumn("__last", F.max("__i").over(Window.partitionBy(key))).filter("__i = __last")
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(seq)))
    return out.withColumn("__back", back).filter(F.col("__back") <= keep).drop("__g", "__i", "__last", "__back")


def x_runs(voxels: DataFrame) -> DataFrame:
    """Runs along x of voxels of one state: map_id, iy, iz, state, x0, x1. FREE voxels are in no run."""
    w = Window.partitionBy("map_id", "iy", "iz", "state").orderBy("ix")
    out = voxels.filter("state <> 'FREE'").withColumn("__island", F.col("ix") - F.row_number().over(w))
    return out.groupBy("map_id", "iy", "iz", "state", "__island").agg(F.min("ix").alias("x0"), F.max("ix").alias("x1")).drop("__island")


def even_subsample(frame: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The rows at int(linspace(0, n - 1, most)) of a key's order; all of a key's rows if it has no more."""
    w = Window.partitionBy(key)
    ranked = frame.withColumns({"__r": F.row_number().over(w.orderBy(order)) - 1, "__n": F.count(F.lit(1)).over(w)})
    # Row r is at step k where floor(k * (n - 1) / (most - 1)) = r, for the smallest such k.
    k = F.ceil(F.col("__r") * (most - 1) / F.greatest(F.col("__n") - 1, F.lit(1)))
    taken = (F.col("__n") <= most) | (F.floor(k * (F.col("__n") - 1) / (most - 1)) == F.col("__r")) & (k <= most - 1)
    return ranked.filter(taken).drop("__r", "__n")


def voxel_representative(points: DataFrame, size: float, keys: Sequence[str], row_id: str) -> DataFrame:
    """Of each voxel the point nearest its centre (then of the smallest id)."""
    cell = {f"i{a}": F.floor(F.col(a) / size).cast("long") for a in "xyz"}
    out = points.withColumns(cell)
    gap = sum(((F.col(a) - (F.col(f"i{a}") + 0.5) * size) ** 2 for a in "yz"), (F.col("x") - (F.col("ix") + 0.5) * size) ** 2)
    return out.groupBy(*keys, "ix", "iy", "iz").agg(F.min(F.struct(F.round(gap, 9).alias("g"), F.col(row_id).alias("id"))).alias("m")).select(*keys, "ix", "iy", "iz", F.col("m.id").alias(row_id))
