"""What several operators need: scratch tables, and ways to hand documents to Python workers."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanspark.sources.scratch import scratch_path, sized, stored

__all__ = ["LOWER", "UPPER", "WHITE", "batches", "lower_ascii", "scratch_path", "sized", "stored", "texts"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: The characters [\x20\x09-\x0D].
WHITE = " \t\n\x0b\x0c\r"

def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) of docs, and the further columns named."""
    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def batches(frame: Iterable[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of the given batches of about most_bytes at most (one row at least), so that long texts don't meet in memory."""
    for b in frame:
        if not b.num_rows:
            continue
        step = max(1, int(b.num_rows * most_bytes / max(1, b.nbytes)))
        for start in range(0, b.num_rows, step):
            yield b.slice(start, step)
