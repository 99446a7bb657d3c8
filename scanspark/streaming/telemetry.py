"""Telemetry over time: functions that take a batch or a stream and give the same rows for the same finite input."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_ticks(ticks: DataFrame, length: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """start, kind, n, mean, most of value by window of ts; late is the watermark of a stream."""
    if late and ticks.isStreaming:
        ticks = ticks.withWatermark("ts", late)
    w = F.window("ts", length, slide)
    return ticks.groupBy(w.alias("w"), "kind").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select(F.col("w.start").alias("start"), "kind", "n", "mean", "most")


def session_ticks(ticks: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    """Sessions of a trace's samples that lie no further apart than gap."""
    if late and ticks.isStreaming:
        ticks = ticks.withWatermark("ts", late)
    w = F.session_window("ts", gap)
    return ticks.groupBy(w.alias("w"), "trace_id").agg(F.count(F.lit(1)).alias("n")).select("trace_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def rate_limited_trace(states: DataFrame, period_us: int) -> DataFrame:
    """trace_id, id, us of the samples kept: the first, then each whose controller clock is period_us or more past the last one kept, and the last.

    The rule depends on what was kept before. Traces are dealt out whole and sorted (by us, then id); a task takes the batches it gets one after another and remembers the clock of the
    last sample kept and the last sample seen, so it holds a batch, not a trace. Rows without a trace or a controller clock are left out.
    """

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trace, kept, tail = None, 0, None  # tail: the last sample of the trace so far, if it is not kept
        for frame in frames:
            out = []
            for key, part in frame.groupby("trace_id", sort=False):
                if key != trace:
                    out += [tail] if tail is not None else []
                    trace, kept = key, -math.inf
                clocks = part["ctrl_us"].to_numpy()
                rising = bool((np.diff(clocks) >= 0).all())
                at, keep = 0, []
                while at < len(clocks):
                    # The next one that is far enough; in a clock that never goes back it is found by halving.
                    due = clocks[at:] >= kept + period_us if not rising else None
                    at += int(np.searchsorted(clocks[at:], kept + period_us)) if rising else int(due.argmax()) if due.any() else len(due)
                    if at < len(clocks):
                        keep.append(at)
                        kept = int(clocks[at])
                        at += 1
                rows = part[["trace_id", "id", "us"]]
                out += [rows.iloc[keep]] if keep else []
                tail = None if keep and keep[-1] == len(clocks) - 1 else rows.iloc[[-1]]
            if out:
                yield pd.concat(out)
        if tail is not None:
            yield tail

    rows = states.select("trace_id", "id", "us", "ctrl_us").filter("trace_id IS NOT NULL AND ctrl_us IS NOT NULL")
    return rows.repartition("trace_id").sortWithinPartitions("trace_id", "us", "id").mapInPandas(folded, "trace_id long, id long, us long")


def rate_limited_stream(states: DataFrame, period_us: int) -> DataFrame:
    """The same for a stream, without the rule for the last sample; the state of a trace is the controller time of the last one kept."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values(["us", "id"])
        keep = []
        for at, us in enumerate(rows["ctrl_us"].tolist()):
            if last is None or us - last >= period_us:
                keep.append(at)
                last = us
        state.update((last,))
        yield rows.iloc[keep][["trace_id", "id", "us"]]

    return states.select("trace_id", "id", "us", "ctrl_us").groupBy("trace_id").applyInPandasWithState(fold, "trace_id long, id long, us long", "last long", "append", GroupStateTimeout.NoTimeout)


def settled_windows(states: DataFrame, most_span: float, settle_us: int) -> DataFrame:
    """trace_id, start_us, end_us, n of the first window of each run of samples whose values stay within most_span until settle_us have passed.

    A sample that breaks the span starts a new window at itself; after a window is given out the next sample starts another.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["us", "id"])
        out, start, low, high, n = [], None, 0.0, 0.0, 0
        for us, value in zip(rows["us"].tolist(), rows["value"].tolist(), strict=True):
            if start is None or max(high, value) - min(low, value) > most_span:
                start, low, high, n = us, value, value, 1
            else:
                low, high, n = min(low, value), max(high, value), n + 1
            if us - start >= settle_us:
                out.append((rows["trace_id"].iloc[0], start, us, n))
                start = None
        return pd.DataFrame(out, columns=["trace_id", "start_us", "end_us", "n"])

    return states.select("trace_id", "id", "us", "value").groupBy("trace_id").applyInPandas(fold, "trace_id long, start_us long, end_us long, n long")
