"""Settled windows: when a robot has come to rest at its goal, told once for each trace, from a stream or from a table.

A candidate window grows while the robot is at the goal, its stop gate and velocities hold, and no two of its states lie further apart than the limits. A state that
moved too far starts a window at itself; one that misses goal, gate or velocity leaves none. The window settles when the sample clock, the host clock and the
controller clock all span the settle time. The fold over a trace's samples is one function; a stream runs it in keyed state with event-time timers, a
table over sorted partitions.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanspark.functions import columns as C

COLUMNS = ["trace_id", "us", "host_us", "ctrl_us", "q", "stopped", "speeds", *C.POSE]
REPORT = (
    "trace_id long, outcome string, us long, samples long, duration_us long, controller_us long, gap_us long, joint double, translation double, rotation double, goal_error double"
)
SETTLED, TIMEOUT, CLOCK_BACK, STALE = "settled", "timeout", "clock_back", "stale"


@dataclass(frozen=True)
class Settling:
    """settle_us: what all three clocks must span. A trace that has not settled timeout_us after its first sample times out. most_gap_us: the longest step of a
    clock, and the longest time the controller's may stand. goal (joint angles; none: no gate) holds within goal_tolerance; speeds hold within most_speeds (none: no gate)."""

    settle_us: int
    timeout_us: int
    most_gap_us: int
    most_joint: float
    most_m: float
    most_rad: float
    goal: Sequence[float] | None = None
    goal_tolerance: float = 0.0
    most_speeds: Sequence[float] | None = None


class Fold:
    """What is known of one trace. Its window holds each state once, however often it was sampled, so a robot at rest costs one."""

    def __init__(self, rules: Settling, saved: dict | None = None):
        self.rules = rules
        self.__dict__.update(saved or {"began": None, "done": False, "last": None, "moved": None, "goal_error": 0.0, "samples": 0, "first": None, "gap": 0, "frozen": None, "deltas": [0.0, 0.0, 0.0], "states": []})

    def saved(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "rules"}

    def deadline(self) -> int | None:
        return None if self.began is None or self.done else self.began + self.rules.timeout_us

    def report(self, outcome: str, us: int) -> tuple:
        self.done = True
        at = self.last if self.samples else None
        first = self.first
        spans = (min(at[0] - first[0], at[1] - first[1]), at[2] - first[2]) if at and first else (0, 0)
        out = outcome, us, self.samples, *spans, self.gap, *self.deltas, self.goal_error
        self.states = []
        return out

    def timeout(self, us: int) -> tuple | None:
        """The report of a trace whose deadline is before us."""
        due = self.deadline()
        return self.report(TIMEOUT, due) if due is not None and us > due else None

    def _clear(self, clocks: tuple | None = None, state: list | None = None) -> None:
        self.samples, self.first, self.gap, self.deltas = (1 if state else 0), clocks, 0, [0.0, 0.0, 0.0]
        self.states = [state] if state else []

    def add(self, us: int, host: int, ctrl: int, q: list, stopped: bool, speeds: list | None, pose: list) -> tuple | None:
        """Takes the next sample; a report if it ends the trace."""
        rules = self.rules
        if self.done:
            return None
        out = self.timeout(us)
        if out:
            return out
        clocks = (us, host, ctrl)
        if self.began is None:
            self.began, self.moved = us, us
        else:
            steps = [b - a for a, b in zip(self.last, clocks, strict=True)]
            if min(steps) < 0:
                return self.report(CLOCK_BACK, us)
            self.moved = us if steps[2] > 0 else self.moved
            if max(steps) > rules.most_gap_us or us - self.moved > rules.most_gap_us:
                return self.report(STALE, us)
        step = max(b - a for a, b in zip(self.last, clocks, strict=True)) if self.last else 0
        self.last = clocks
        self.goal_error = max(abs(a - b) for a, b in zip(q, rules.goal, strict=True)) if rules.goal is not None else 0.0
        slow = rules.most_speeds is None or speeds is not None and all(a <= b for a, b in zip(speeds, rules.most_speeds, strict=True))
        state = [*q, *pose]
        if not (stopped and slow and self.goal_error <= rules.goal_tolerance):
            self._clear()
            return None
        if self.states:
            deltas = [max(a, b) for a, b in zip(self.deltas, self._apart(state, len(q)), strict=True)]
            if all(d <= m for d, m in zip(deltas, (rules.most_joint, rules.most_m, rules.most_rad), strict=True)):
                self.deltas, self.samples, self.gap = deltas, self.samples + 1, max(self.gap, step)
                if state not in self.states:
                    self.states.append(state)
            else:
                self._clear(clocks, state)
        else:
            self._clear(clocks, state)
        spans = [b - a for a, b in zip(self.first, clocks, strict=True)]
        return self.report(SETTLED, us) if min(spans) >= rules.settle_us else None

    def _apart(self, state: list, joints: int) -> tuple[float, float, float]:
        """The largest differences of a state from the window's: in a joint, in place, in rotation."""
        held, new = np.array(self.states), np.array(state)
        joint = np.abs(held[:, :joints] - new[:joints]).max()
        turn = np.clip((held[:, joints : joints + 9] @ new[joints : joints + 9] - 1) / 2, -1.0, 1.0).min()
        place = np.linalg.norm(held[:, joints + 9 :] - new[joints + 9 :], axis=1).max()
        return float(joint), float(place), math.acos(float(turn))


def _samples(frame: pd.DataFrame) -> Iterator[tuple]:
    pose = frame[list(C.POSE)].to_numpy(float).tolist()
    for us, host, ctrl, q, stopped, speeds, p in zip(frame["us"], frame["host_us"], frame["ctrl_us"], frame["q"], frame["stopped"], frame["speeds"], pose, strict=True):
        yield int(us), int(host), int(ctrl), [float(x) for x in q], bool(stopped), None if speeds is None else [float(x) for x in speeds], p


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in REPORT.split(", ")])


def settled_table(states: DataFrame, rules: Settling) -> DataFrame:
    """The reports of all traces of a table (COLUMNS), one for each: outcome (settled, timeout, clock_back, stale), us (when), samples, duration_us and controller_us (of the window), gap_us
    (its longest step), joint, translation and rotation (the largest differences in it), goal_error (of the last sample).

    Samples are taken in order of us, then of host_us and ctrl_us. Traces are dealt out whole and sorted, and a task folds the batches it gets one after another, so it
    holds one batch and one window, not a trace. A trace that ends before it settles times out.
    """

    def folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trace, fold = None, None
        for frame in frames:
            out = []
            for key, part in frame.groupby("trace_id", sort=False):
                if key != trace:
                    if fold is not None and (due := fold.deadline()) is not None:
                        out.append((trace, *fold.timeout(due + 1)))
                    trace, fold = int(key), Fold(rules)
                if not fold.done:
                    out += [(trace, *told) for sample in _samples(part) if (told := fold.add(*sample))]
            if out:
                yield _frame(out)
        if fold is not None and (due := fold.deadline()) is not None:
            yield _frame([(trace, *fold.timeout(due + 1))])

    rows = states.filter("trace_id IS NOT NULL").select(*COLUMNS).repartition("trace_id").sortWithinPartitions("trace_id", "us", "host_us", "ctrl_us")
    return rows.mapInPandas(folded, REPORT)


def settled_stream(states: DataFrame, rules: Settling, late: str = "1 second") -> DataFrame:
    """The same for a stream with an event time ts: samples that come out of order wait until the watermark has passed them.

    The state of a trace is its window, and its samples that are later than the watermark; both are bounded by time. A timer waits for its next waiting sample or its deadline.
    Rows without a trace are heartbeats that only move the watermark on. Samples later than the watermark allows are dropped by the engine. After its report a trace keeps a flag only.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        saved, waiting = json.loads(state.get[0]) if state.exists else (None, [])
        known = Fold(rules, saved)
        if not state.hasTimedOut and key[0] is not None and not pd.isna(key[0]) and not known.done:
            for frame in frames:
                waiting += map(list, _samples(frame))
        else:
            for _ in frames:
                pass
        mark = state.getCurrentWatermarkMs() * 1000
        waiting.sort(key=lambda s: s[:3])
        n = sum(s[0] < mark for s in waiting)
        told = None
        for sample in waiting[:n]:
            told = told or known.add(*sample)
        told = told or known.timeout(mark)
        waiting = [] if known.done else waiting[n:]
        state.update((json.dumps([known.saved(), waiting]),))
        due = [t for t in (known.deadline(), waiting[0][0] if waiting else None) if t is not None]
        if due:
            state.setTimeoutTimestamp(max(min(due) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if told:
            yield _frame([(int(key[0]), *told)])

    rows = states.withWatermark("ts", late).select("ts", *COLUMNS)
    return rows.groupBy("trace_id").applyInPandasWithState(fold, REPORT, "saved string", "append", GroupStateTimeout.EventTimeTimeout)
