"""Bit filters of 64-bit hashes that every task holds: what passes may be in the set, what doesn't is not. An exact join follows their use."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A filter has 2 ** FEWEST to 2 ** MOST bits (128 MB); beyond that it lets more through, and results stay the same.
FEWEST, MOST = 24, 30
#: Parts of a filter that are made apart, a power of two.
SLICES = 64
#: Tasks that make the slices; the driver gets those of one after those of another.
FETCHES = 8


def bits_for(n: int) -> int:
    """The power of two that gives n hashes 1024 bits or more each, within FEWEST and MOST."""
    return min(MOST, max(FEWEST, max(1, n).bit_length() + 10))


def passing(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether each hash (unsigned) passes the filter."""
    at = hashes >> np.uint64(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 == 1


def bit_filter(hashes: DataFrame, column: str):
    """A broadcast filter of a column of longs, sized by its rows. It is made in SLICES by the hashes' first bits, each in one of FETCHES tasks; the driver gets each slice once."""
    power = bits_for(hashes.count())
    size = (1 << (power - 3)) // SLICES

    def part(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            at = frame.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - power)
            byte, bit = (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8)
            for s in np.unique(byte // size).tolist():
                own = byte // size == s
                np.bitwise_or.at(held.setdefault(s, np.zeros(size, np.uint8)), byte[own] % size, bit[own])
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([b.tobytes() for b in held.values()], pa.binary())], ["slice", "bits"])

    bits = np.zeros(1 << (power - 3), np.uint8)
    dealt = hashes.select(column).repartition(SLICES, F.shiftrightunsigned(column, 64 - SLICES.bit_length() + 1)).coalesce(FETCHES)
    for row in dealt.mapInArrow(part, "slice long, bits binary").toLocalIterator():
        bits[row[0] * size : (row[0] + 1) * size] |= np.frombuffer(row[1], np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(bits)
