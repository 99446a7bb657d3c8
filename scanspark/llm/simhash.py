"""SimHash near-duplicates through deletion variants of fingerprint segments.

A 64-bit fingerprint is cut into max_bits // 2 + 1 segments, so of two fingerprints that differ in at most max_bits bits,
one segment differs in at most one. Each segment is indexed once for each of its bits, with that bit struck
out: two segments that differ in at most one bit have such a variant in common. An equality join on variants gives
candidates, and the join's condition verifies them. Only distinct fingerprints are joined; copies hang on their fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanspark.llm.shared import batches, stored
from scanspark.operators.graph import components

#: Shingles hashed before their bits are added up.
BLOCK = 1 << 16


def fingerprint(text: bytes, size: int = 3, seed: int = 42) -> int:
    """The SimHash of a UTF-8 text: bits set in over half the XXH64 of its word shingles, as an unsigned number; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    n = max(1, len(words) - size + 1)
    stops = ends[size - 1 :] if len(words) >= size else ends[-1:]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        cut = slice(at, min(n, at + BLOCK))
        hashes = np.array([digest(line[a:b], seed) for a, b in zip(starts[cut].tolist(), stops[cut].tolist(), strict=False)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, seed: int = 42, with_text: bool = True) -> DataFrame:
    """docs with column fp: the fingerprint's 64 bits as a signed long. A null text has no words. Every column of docs is kept, text only with_text."""
    docs = docs.drop("fp").withColumn("text", F.col("text").cast("string"))
    out = docs if with_text else docs.drop("text")
    schema = out.withColumn("fp", F.lit(0).cast("long")).schema

    def made(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            text = frame.column(frame.schema.get_field_index("text")).cast(pa.binary()).to_pylist()
            found = np.array([fingerprint(t or b"", size, seed) for t in text], "<u8").view("<i8")
            rest = frame if with_text else frame.select([n for n in frame.schema.names if n != "text"])
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(found)], [*rest.schema.names, "fp"])

    return docs.mapInArrow(made, schema)


def segments(max_bits: int) -> list[tuple[int, int]]:
    """First bit and width of each segment; two at least."""
    parts = max(2, max_bits // 2 + 1)
    bounds = [64 * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def variants(fp: Column, max_bits: int) -> Column:
    """An array of longs: for each segment and each of its bits, the segment without that bit, marked (from bit 48 on) with the bit's place."""
    made = []
    for low, width in segments(max_bits):
        segment = F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << width) - 1))
        made += [segment.bitwiseAND(F.lit(~(1 << k))).bitwiseOR(F.lit((low + k) << 48)) for k in range(width)]
    return F.array(*made)


def first_common(difference: Column, max_bits: int) -> Column:
    """The place that marks the first variant two fingerprints have in common, from the bits in which they differ."""
    place = F.lit(None).cast("int")
    for low, width in reversed(segments(max_bits)):
        part = F.shiftrightunsigned(difference, low).bitwiseAND(F.lit((1 << width) - 1))
        n = F.bit_count(part)
        place = F.when(n == 0, low).when(n == 1, low + F.bit_count(part - 1)).otherwise(place)
    return place


def links(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """a, b (a < b) for all pairs of the distinct longs in prints.fp that differ in 1 to max_bits bits: a pair counts at its first common variant only."""
    cut = prints.select("fp", F.explode(variants(F.col("fp"), max_bits)).alias("variant"))
    a, b = cut.select(F.col("fp").alias("a"), "variant"), cut.select(F.col("fp").alias("b"), "variant")
    difference = F.col("a").bitwiseXOR(F.col("b"))
    first = F.shiftrightunsigned("variant", 48).cast("int") == first_common(difference, max_bits)
    return a.join(b.hint("merge"), "variant").filter((F.col("a") < F.col("b")) & (F.bit_count(difference) <= max_bits) & first).select("a", "b")


def near_duplicates(docs: DataFrame, max_bits: int = 2, size: int = 3, seed: int = 42, with_text: bool = True) -> DataFrame:
    """docs (doc_id, text and others; text only with_text) with fp (see fingerprints) and component_id.

    Documents whose fingerprints differ in at most max_bits bits are linked; component_id is the smallest doc_id that links lead
    to, the document's own included (null only where no document of the component has an id). Documents without words
    have fingerprint 0 and are linked like any other. Repeated rows each get their row. Columns named fp or component_id are replaced.
    """
    docs = stored(fingerprints(docs.drop("component_id"), size, seed, with_text), "fingerprinted")
    prints = stored(docs.groupBy("fp").agg(F.min("doc_id").alias("first")), "fingerprints")
    found = components(links(prints, max_bits)).select(F.col("node").alias("fp"), "root")
    prints = prints.join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = prints.groupBy("root").agg(F.min("first").alias("component_id"))
    return docs.join(prints.join(least, "root").select("fp", "component_id"), "fp").select(*docs.columns, "component_id")
