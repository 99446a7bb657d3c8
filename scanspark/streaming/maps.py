"""Maps and ledgers from streams: each batch's additions are merged once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanspark.operators.maps import BIN, VOXEL


def append_votes(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: crossings (map_id, ix, iy, iz, seq) of new sources, written under the batch's number, so a repeated batch replaces itself."""

    def add(batch: DataFrame, number: int) -> None:
        batch.select(*VOXEL, "seq").distinct().write.mode("overwrite").parquet(f"{path}/batch={number}")

    return add


def append_bins(path: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: bins of new observations, under the batch's number."""

    def add(batch: DataFrame, number: int) -> None:
        batch.groupBy("observation_id", *BIN).agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return add


def ledger(bins: DataFrame) -> DataFrame:
    """The ledger of all bins appended; an observation counts once, as its first batch gave it."""
    first = bins.groupBy("observation_id").agg(F.min("batch").alias("batch"))
    return bins.join(first, ["observation_id", "batch"]).groupBy(*BIN).agg(F.sum("n").alias("n"))


EXPIRED = "map_id long, version long, state string"


def expired_maps(maps: DataFrame, most_age_s: float, now: Column) -> DataFrame:
    """map_id, version, state: the STALE version that follows the newest one of each map, where that is READY and its age is over most_age_s, below zero or unknown.

    maps: map_id, version, state, built (timestamp).
    """
    newest = maps.groupBy("map_id").agg(F.max(F.struct("version", "state", "built")).alias("m")).select("map_id", "m.*")
    age = (F.unix_micros(now) - F.unix_micros("built")) / 1e6
    old = F.coalesce((age < 0) | (age > most_age_s), F.lit(True))
    return newest.filter((F.col("state") == "READY") & old).select("map_id", (F.col("version") + 1).alias("version"), F.lit("STALE").alias("state"))


def map_expiry(maps: DataFrame, most_age_s: float, late: str = "0 seconds") -> DataFrame:
    """The same for a stream of map versions, once for each version that expires: the time is the stream's watermark, and a timer waits for each map.

    The state of a map is its newest version; rows without a map are heartbeats that only move the watermark on.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    most = int(most_age_s * 1000)

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, ready, built = state.get if state.exists else (-1, False, 0)
        if not state.hasTimedOut:
            for frame in frames:
                for v, s, b in zip(frame["version"], frame["state"], frame["ms"], strict=True):
                    if v > version:
                        version, ready, built = int(v), s == "READY", int(b)
        due = built + most + 1
        over = ready and (state.hasTimedOut or due <= state.getCurrentWatermarkMs())
        state.update((version, ready and not over, built))
        if ready and not over:
            state.setTimeoutTimestamp(due)
        if over and key[0] is not None and not pd.isna(key[0]):
            yield pd.DataFrame({"map_id": [key[0]], "version": [version + 1], "state": ["STALE"]})

    rows = maps.withWatermark("built", late).select("map_id", "version", "state", "built", F.unix_millis("built").alias("ms"))
    return rows.groupBy("map_id").applyInPandasWithState(fold, EXPIRED, "version long, ready boolean, built long", "append", GroupStateTimeout.EventTimeTimeout)
