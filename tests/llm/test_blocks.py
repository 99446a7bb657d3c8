"""What blocks of texts take of a task's memory."""

import tracemalloc

import numpy as np
import pyarrow as pa

from scanspark.llm import class_lm


def test_blocks_of_texts_hold_little_memory():
    rows, words = 10_000, 600
    ids = np.zeros((rows, words), np.int32)
    frame = pa.RecordBatch.from_arrays([pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([b""] * rows, pa.binary())], ["ids", "hashes"])
    tracemalloc.start()
    try:
        seen = sum(len(block) - 1 for block, _ in class_lm._blocks([frame], 5))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert seen == rows * words and peak < 20e6
