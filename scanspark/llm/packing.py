"""Packing of token sequences: dominance reduction over lengths, then best fit for what is left.

Packing needs only how many pieces have each length, and there are at most `capacity` lengths. The plan is made on that table: a
list of patterns (lengths side by side in one sequence) with how many sequences have the pattern. Pieces of one
length are interchangeable, so each takes the place that its rank among its length has in the plan, by a join.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanspark.llm.shared import batches, stored
from scanspark.llm.token_counts import tokenizer

#: Distinct words whose ids a worker keeps from task to task, and the longest word it keeps.
CACHE, LONGEST = 1_000_000, 200


def plain(text: str) -> bool:
    """Latin-1 only: there, Python and the tokenizer agree on letters and their lower case."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class WordIds(dict):
    """Ids (little-endian unsigned 32-bit) by word, worked out when a word is first asked for. Each word is lower-case already or left as it is."""

    def __init__(self, path: str):
        super().__init__()
        self.tok = tokenizer(path)
        self.special = [t.content.lower() for t in self.tok.get_added_tokens_decoder().values()]

    def __missing__(self, word: str) -> bytes:
        if word[-1:] in (".", ",") and word[:-1].isalpha() and plain(word):
            ids = self[word[:-1]] + self[word[-1]]  # a run of letters and what follows are encoded each by itself
        else:
            ids = np.array(self.tok.encode_batch_fast([word], add_special_tokens=False)[0].ids, "<u4").tobytes()
        if len(word) <= LONGEST:
            self[word] = ids
        return ids

    def of(self, text: str) -> bytes:
        if len(self) > CACHE:
            self.clear()
        text = text.replace("\n", " ")
        if plain(text):
            low = text.lower()  # fewer words to keep; the tokenizer does so only after it has looked for special tokens
            if not any(t in low for t in self.special):
                text = low
        return b"".join(map(self.__getitem__, text.split(" ")))


def tokenize_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids (binary, little-endian unsigned 32-bit) of the pieces of each row of docs (doc_id, text).

    A document is the ids that the tokenizer file at path gives for its text (null: empty) without added special
    tokens, then end_id. Documents longer than capacity are cut into pieces of capacity ids, the last may be shorter.
    The tokenizer must lower-case and drop white space (each word's ids then stand alone), as word-end BPE does: a worker encodes a word
    once and keeps its ids, but for words of over LONGEST characters. Special tokens written out in a text count as the library's
    default has it, in their own case only. A null doc_id stays null; repeated rows give their pieces each; columns other than doc_id and text are not read.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary())])

    # Each worker fills its own copy of the value, which outlives a task.
    held = docs.sparkSession.sparkContext.broadcast({})

    def cut(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in held.value:
            held.value[path] = WordIds(path)
        ids_of = held.value[path]
        end = np.array([end_id], "<u4").tobytes()
        for frame in batches(frames):
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                ids = ids_of.of(text) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    for values, v in zip(out, (doc, piece, at // 4, len(part) // 4, part), strict=True):
                        values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(F.col("doc_id").cast("long"), text).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids binary")


class _Lengths:
    """How many pieces of each length are left; the lengths left in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.n = dict(counts)
        self.order = sorted(k for k, v in counts.items() if v > 0)

    def take(self, length: int, n: int) -> None:
        self.n[length] -= n
        if not self.n[length]:
            del self.order[bisect_right(self.order, length) - 1]

    def at_most(self, room: int) -> int | None:
        i = bisect_right(self.order, room)
        return self.order[i - 1] if i else None

    def smallest(self, k: int, beside: int) -> list[int]:
        """The k smallest pieces left, with one of length `beside` set apart."""
        found: list[int] = []
        for x in self.order:
            found += [x] * min(k - len(found), self.n[x] - (x == beside))
            if len(found) == k:
                break
        return found


def reduce_by_dominance(left: _Lengths, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Fixes sequences that some optimal packing holds; returns (pattern, how many) and leaves the rest in left.

    A piece x is fixed alone if nothing fits beside it, and with y, the longest that fits, if the two fill the sequence, if
    no two pieces fit beside x, or if two at most fit and no such two are longer than y together. In each case whatever
    another packing holds beside x can change places with y.
    """
    fixed = []
    for x in reversed(list(left.order)):
        room = capacity - x
        while left.n[x]:
            low = left.smallest(3, x)
            if not low or low[0] > room:
                fixed.append(((x,), left.n[x]))
                left.take(x, left.n[x])
                break
            y = left.at_most(room)
            if y == x and left.n[x] == 1:
                y = left.order[bisect_right(left.order, x) - 2]
            if not (x + y == capacity or len(low) < 2 or low[0] + low[1] > room or (len(low) < 3 or sum(low) > room) and _best_pair(left, x, room) <= y):
                break
            pairs = left.n[x] // 2 if x == y else min(left.n[x], left.n[y])
            fixed.append(((x, y), pairs))
            left.take(x, pairs)
            left.take(y, pairs)
    return fixed


def _best_pair(left: _Lengths, x: int, room: int) -> int:
    """The largest sum within room of two pieces left, one of length x set apart."""
    there = [y for y in left.order[: bisect_right(left.order, room)] if left.n[y] > (y == x)]
    best, i, j = 0, 0, len(there) - 1
    while i <= j:
        if there[i] + there[j] > room:
            j -= 1
            continue
        if i < j or left.n[there[i]] - (there[i] == x) > 1:
            best = max(best, there[i] + there[j])
        i += 1
    return best


def best_fit(left: _Lengths, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit in decreasing order: each piece goes where the least room is left that holds it, else it opens a sequence.

    Equal pieces and equal sequences are dealt with at once. A sequence that takes a piece has the least room of all afterwards, so
    it takes equal pieces until the next no longer fits; then the next sequence of its kind does the same. Of sequences with equal room the
    one whose pattern came first takes the piece.
    """
    rooms: list[int] = []  # ascending
    kinds: dict[int, list[list]] = {}  # by room: [pattern as (length, how many) pairs, number of sequences]

    def put(pattern: tuple[tuple[int, int], ...], n: int, room: int) -> None:
        if room not in kinds:
            insort(rooms, room)
            kinds[room] = []
        kinds[room].append([pattern, n])

    for x in reversed(list(left.order)):
        n = left.n[x]
        left.take(x, n)
        while n:
            i = bisect_left(rooms, x)
            room = rooms[i] if i < len(rooms) else capacity
            pattern, there = kinds[room][0] if i < len(rooms) else ((), n)
            k = min(room // x, n)
            times = min(there, n // k)
            if i < len(rooms):
                kinds[room][0][1] -= times
                if not kinds[room][0][1]:
                    del kinds[room][0]
                    if not kinds[room]:
                        del kinds[room], rooms[i]
            put((*pattern, (x, k)), times, room - k * x)
            n -= k * times
    return [(tuple(x for x, k in pattern for _ in range(k)), n) for room in rooms for pattern, n in kinds[room]]


def plan(counts: dict[int, int], capacity: int = 4096) -> list[tuple[tuple[int, ...], int]]:
    """(pattern, how many sequences) for counts of pieces by length. Its size follows capacity, not the number of pieces."""
    if any(not 0 < k <= capacity for k, v in counts.items() if v):
        raise ValueError(f"lengths must be from 1 to {capacity}")
    left = _Lengths({int(k): int(v) for k, v in counts.items() if v})
    return reduce_by_dominance(left, capacity) + best_fit(left, capacity)


def _places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, list[dict]]:
    """For each length, which ranks go where: k pieces in each of `times` sequences from `sequence` on, from `base` on."""
    found: dict[int, list[dict]] = {}
    taken: dict[int, int] = {}
    sequence = 0
    for pattern, times in patterns:
        base = 0
        for x in dict.fromkeys(pattern):
            k = pattern.count(x)
            found.setdefault(x, []).append({"first": taken.get(x, 0), "k": k, "times": times, "sequence": sequence, "base": base})
            taken[x] = taken.get(x, 0) + k * times
            base += k * x
        sequence += times
    return found


def pack(pieces: DataFrame, capacity: int = 4096, per_bucket: int | None = None) -> DataFrame:
    """pieces (length and any other columns) with sequence_id and offset.

    Pieces in one sequence lie side by side from offset 0 on, capacity at most. Rows are ranked within their length
    in two steps (buckets of about per_bucket rows, then rows within a bucket and length), so a very common
    length is no single group; by default there are as many buckets as rows in one. Repeated rows are packed each. Columns of pieces named sequence_id or offset are replaced.
    The table of places has a row for each length, capacity at most, and is held by every task.
    """
    spark = pieces.sparkSession
    pieces = pieces.drop("sequence_id", "offset")
    held = stored(pieces.withColumn("__at", F.monotonically_increasing_id()), "pieces")
    counts = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    run = "struct<first long, k long, times long, sequence long, base long>"
    places = spark.createDataFrame(list(_places(plan(counts, capacity)).items()), f"length long, __runs array<{run}>")

    total = sum(counts.values())
    buckets = max(1, total // per_bucket if per_bucket else math.isqrt(total))
    held = held.withColumn("__bucket", F.pmod(F.xxhash64("__at"), F.lit(buckets)).cast("int"))
    before = Window.partitionBy("length").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = held.groupBy("length", "__bucket").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.select("length", "__bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("__at")) - 1
    out = held.withColumn("__rank", rank).join(sizes, ["length", "__bucket"]).withColumn("__rank", F.col("__rank") + F.col("__before"))
    out = out.join(F.broadcast(places), "length")
    at = F.col("__rank")
    run = F.filter("__runs", lambda r: (r["first"] <= at) & (at < r["first"] + r["k"] * r["times"]))[0]
    out = out.withColumn("__run", run)
    r, nth = F.col("__run"), at - F.col("__run.first")
    out = out.withColumn("sequence_id", r["sequence"] + F.floor(nth / r["k"]).cast("long"))
    out = out.withColumn("offset", r["base"] + nth % r["k"] * F.col("length"))
    return out.select(*pieces.columns, "sequence_id", "offset")
