"""Counts of word types over a corpus, and the split of types into frequent ones (a bounded table) and the rest (joined)."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanspark.llm.shared import batches

#: Types held by a task before it passes its counts on.
FLUSH = 400_000


def count_types(docs: DataFrame, column: str, split: Callable[..., dict], kind: str) -> DataFrame:
    """(type, n) over docs; split gives a text's types with their counts; kind is the type's SQL type, string or binary.

    Tasks add up what they read and pass counts on when they hold FLUSH types, so memory is bounded and
    the shuffle carries each type once for each such block.
    """
    arrow = pa.string() if kind == "string" else pa.binary()

    def added(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(held.keys(), arrow), pa.array(held.values(), pa.int64())], ["type", "n"])
            held.clear()
            return b

        for frame in batches(frames):
            for text in frame.column(0).to_pylist():
                held.update(split(text))
                if len(held) >= FLUSH:
                    yield out()
        if held:
            yield out()

    rows = docs.select(column).mapInArrow(added, f"type {kind}, n long")
    return rows.groupBy("type").agg(F.sum("n").alias("n"))


def frequent(types: DataFrame, most: int) -> DataFrame:
    """The rows of types (n) of the largest n, at most `most` of them: types whose n reaches a bound read off a histogram.

    The histogram has a row for each quarter of a power of two, so the driver gets a few hundred numbers.
    """
    step = F.floor(F.log2("n") * 4).cast("int")
    steps = sorted(((r["step"], r["types"]) for r in types.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("types")).collect()), reverse=True)
    bound, total = math.inf, 0
    for at, found in steps:
        total += found
        if total > most:
            break
        bound = at
    return types.filter(step >= F.lit(1 << 20 if bound is math.inf else bound))
