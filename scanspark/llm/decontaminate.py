"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

Words are lower-cased and lose punctuation at their ends. Every test item's n-grams are counted over the whole corpus; of those
that occur there, an item's seeds are its rarest, so many that every alignment that scores enough holds one (see surviving).
Documents that hold a seed give up the passages around their seeds, the passages are joined to the items by seed, and each pair
that has enough n-grams in common is aligned word by word.
Tasks hold a bit filter of the seeds' hashes, so only hits leave them; the join on hashes then is exact.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanspark.llm.bit_filter import bit_filter, passing
from scanspark.llm.shared import batches, stored

ENDS = ".,;:!?\"'()[]{}*#$%&|<>-_/\\"
CACHE = 400_000
FLUSH = 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Texts to arrays of word hashes; remembers the words it has seen, CACHE at most."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, text: bytes) -> np.ndarray:
        words = text.split()
        known = self.known
        try:
            out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(known) > CACHE:
                known.clear()
            for w in words:
                if w not in known:
                    form = w.decode("utf-8", "replace").lower().strip(ENDS)
                    known[w] = (xxhash.xxh64_intdigest(form) | 1) if form else 0
            out = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        return out if out.all() else out[out != 0]


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of an array of word hashes (of the whole, if it has fewer than n words)."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        out = out * _STEP + words[k : len(words) - n + 1 + k]
    out ^= out >> np.uint64(29)
    return out * _STEP


def align(passage: np.ndarray, item: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over words, 1 for a match, -1 for a mismatch or a gap: score, matches, first and last word in the passage.

    Of equal alignments that which ends first in the item, then in the passage, counts. Only one row of the matrix is held, with
    where each cell's alignment begins and its matches, so memory follows the passage.
    """
    n = len(passage)
    steps = np.arange(n + 1)
    score, begin, matches = (np.zeros(n + 1, np.int64) for _ in range(3))
    best = (0, 0, -1, -1)
    for w in item:
        same = passage == w
        diagonal, up = score[:-1] + np.where(same, 1, -1), score[1:] - 1
        aslant = diagonal >= up
        new = np.zeros((3, n + 1), np.int64)
        new[0, 1:] = np.maximum(np.maximum(diagonal, up), 0)
        new[1, 1:] = np.where(aslant, np.where(score[:-1] > 0, begin[:-1], steps[:-1]), begin[1:])
        new[2, 1:] = np.where(aslant, np.where(score[:-1] > 0, matches[:-1], 0) + same, matches[1:])
        reach = new[0] + steps
        most = np.maximum.accumulate(reach)
        source = np.maximum.accumulate(np.where(reach == most, steps, 0))  # itself, or the cell on the left that a gap comes from
        score, begin, matches = most - steps, new[1][source], new[2][source]
        j = int(score.argmax())
        if score[j] > best[0]:
            best = (int(score[j]), int(matches[j]), int(begin[j]), int(source[j]) - 1)
    return best


def surviving(n_words: int, n: int, least_score: float, least_words: int) -> tuple[int, int]:
    """The seed length for an item (n at most), and how many of its n-grams of that length every alignment of least_score of its words keeps.

    Of m matches and e errors (m - e >= score, m <= n_words) the matches lie in e + 1 runs at most, so m - (size - 1) * (e + 1) n-grams are
    whole; that is least where all words match and the errors are added words.
    """
    score = max(1, math.ceil(least_score * n_words))
    for size in range(min(n, n_words), 1, -1):
        left = n_words - (size - 1) * (n_words - score + 1)
        if left > 0:
            return size, left
    return 1, max(score, min(least_words, n_words))


def item_grams(items: DataFrame, n: int, least_score: float, least_words: int) -> DataFrame:
    """item, n_words, size, left (see surviving), gram, times (one row for each distinct n-gram) of items (item, text); items without words give no row."""
    schema = pa.schema([("item", pa.int64()), ("n_words", pa.int32()), ("size", pa.int32()), ("left", pa.int32()), ("gram", pa.int64()), ("times", pa.int32())])

    def cut(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for frame in frames:
            rows = []
            for i, t in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                w = words(t or b"")
                size, left = surviving(len(w), n, least_score, least_words)
                g, times = np.unique(grams(w, size), return_counts=True)
                rows += [(i, len(w), size, left, *one) for one in zip(g.view(np.int64).tolist(), times.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema, strict=True)], schema=schema)

    ddl = "item long, n_words int, size int, left int, gram long, times int"
    return items.select("item", F.col("text").cast("string").cast("binary")).mapInArrow(cut, ddl)


def gram_counts(docs: DataFrame, seeds: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """gram, found: how often the whole corpus has each n-gram (of the given lengths) in seeds (those it has at all; a few others may be among them)."""
    held = bit_filter(seeds, "gram")

    def counted(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts = Words(), Counter()

        def out() -> pa.RecordBatch:
            b = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.int64()), pa.array(counts.values(), pa.int64())], ["gram", "found"])
            counts.clear()
            return b

        for frame in frames:
            for text in frame.column(0).to_pylist():
                w = words(text or b"")
                for size in sizes if len(w) else ():
                    g = grams(w, size)
                    counts.update(g[passing(g, held.value)].view(np.int64).tolist())
                if len(counts) > FLUSH:
                    yield out()
        yield out()

    return docs.select(F.col("text").cast("string").cast("binary")).mapInArrow(counted, "gram long, found long").groupBy("gram").agg(F.sum("found").alias("found"))


def rare_seeds(docs: DataFrame, items: DataFrame, n: int, least_score: float, least_words: int) -> tuple[DataFrame, list[int]]:
    """item, n_words, gram: of each item's n-grams that docs have, the rarest, ties included, so that fewer places of others are left than survive; and the lengths of n-grams."""
    seeds = stored(item_grams(items, n, least_score, least_words), "item-grams")
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())
    found = seeds.join(gram_counts(docs, seeds, sizes), "gram").filter("found > 0")
    # Places of n-grams as frequent or more so; a window is as long as an item.
    others = F.sum("times").over(Window.partitionBy("item").orderBy(F.desc("found")))
    return stored(found.withColumn("others", others).filter(F.col("others") >= F.col("left")).select("item", "n_words", "gram"), "seeds"), sizes


def passages(docs: DataFrame, seeds: DataFrame, sizes: Sequence[int], span: int) -> DataFrame:
    """doc_id, of, first, words (binary: word hashes), grams: stretches of documents within span words of n-grams that may be seeds.

    Stretches that overlap are one; first is the number of the stretch's first word in its document. of is a column of docs.
    """
    held = bit_filter(seeds, "gram")
    schema = pa.schema([("doc_id", pa.int64()), ("of", pa.int64()), ("first", pa.int64()), ("words", pa.binary()), ("grams", pa.list_(pa.int64()))])

    def found(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for frame in batches(frames):
            out: list[list] = [[], [], [], [], []]
            for doc, of, text in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                w = words(text or b"")
                if not len(w):
                    continue
                g = [grams(w, size) for size in sizes]
                at = [np.flatnonzero(passing(x, held.value)) for x in g]
                g, at = np.concatenate([x[k] for x, k in zip(g, at, strict=True)]), np.concatenate(at)
                order = np.argsort(at, kind="stable")
                g, at = g[order], at[order]
                for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > 2 * span) + 1) if len(at) else []:
                    a, b = max(0, int(at[part[0]]) - span), int(at[part[-1]]) + sizes[-1] + span
                    for values, v in zip(out, (doc, of, a, w[a:b].tobytes(), np.unique(g[part]).view(np.int64).tolist()), strict=True):
                        values.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long"), "of", F.col("text").cast("string").cast("binary"))
    return rows.mapInArrow(found, "doc_id long, of long, first long, words binary, grams array<long>")


def find_leaks(docs: DataFrame, items: DataFrame, n: int = 3, least_score: float = 0.5, least_words: int = 8) -> DataFrame:
    """doc_id, of, item_id, score, n_matched, n_item_words, first_word, last_word: documents that hold a test item or an edited copy.

    docs: doc_id, text; items: item_id, text. An item is found where its best local alignment reaches least_score of its
    words (1 for each word in place, -1 for each that differs, is missing or is added) and matches least_words words, or all of a shorter item.
    Of several places in a document the best counts (then the first). of tells rows of one doc_id with different texts apart: xxhash64 of both.
    Null and empty texts hold nothing and empty items are in nothing. Every text of an id, and every text without
    an id, is an item of its own and has its own rows; a text given twice under one id counts once. Long texts and
    items are taken whole; an alignment holds a few rows as long as the passage. Of equally rare n-grams all are seeds. Other columns are not read.
    """
    docs = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("of"))
    items = stored(items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).distinct().withColumn("item", F.xxhash64("item_id", "text")), "items")
    seeds, sizes = rare_seeds(docs, items, n, least_score, least_words)
    longest = seeds.agg(F.max("n_words")).first()[0] or 0
    # No alignment that scores enough is longer: it has n_words matches and (1 - least_score) * n_words errors at most.
    span = math.ceil((2 - least_score) * longest)
    held = stored(passages(docs, seeds, sizes or [n], span).withColumn("passage", F.md5("words")), "passages")
    pairs = held.select("passage", F.explode("grams").alias("gram")).join(seeds, "gram").select("passage", "item").distinct()
    held_once = held.groupBy("passage").agg(F.first("words").alias("words"))
    pairs = pairs.join(held_once, "passage").join(items.select("item", "item_id", F.col("text").cast("binary").alias("text")), "item")
    schema = pa.schema([("passage", pa.string()), ("item", pa.int64()), ("item_id", pa.int64()), ("points", pa.int32()), ("n_matched", pa.int32()), ("n_item_words", pa.int32()), ("a", pa.int32()), ("b", pa.int32())])

    def scored(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for frame in batches(frames):
            rows = []
            for passage, item, name, w, text in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                own, there = words(text or b""), np.frombuffer(w, np.uint64)
                size, left = surviving(len(own), n, least_score, least_words)
                if np.isin(grams(there, size), grams(own, size)).sum() < left:
                    continue
                points, matches, a, b = align(there, own)
                rows.append((passage, item, name, points, matches, len(own), a, b))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows, strict=True)) or [[]] * len(schema), schema, strict=True)], schema=schema)

    ddl = "passage string, item long, item_id long, points int, n_matched int, n_item_words int, a int, b int"
    scores = pairs.select("passage", "item", "item_id", "words", "text").mapInArrow(scored, ddl)
    size = F.col("n_item_words")
    scores = scores.filter((F.col("points") >= least_score * size) & (F.col("n_matched") >= F.least(F.lit(least_words), size)))
    found = held.select("doc_id", "of", "first", "passage").join(scores, "passage")
    best = F.max(F.struct((F.col("points") / size).alias("score"), (-(F.col("first") + F.col("a"))).alias("at"), "n_matched", "n_item_words", (F.col("first") + F.col("b")).alias("last"))).alias("m")
    return found.groupBy("doc_id", "of", "item", "item_id").agg(best).select("doc_id", "of", "item_id", "m.score", "m.n_matched", "m.n_item_words", (-F.col("m.at")).alias("first_word"), F.col("m.last").alias("last_word"))


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the rows that find_leaks reports, with all their columns."""
    leaks = find_leaks(docs, items, **options).select(F.col("of").alias("__of"), F.col("doc_id").alias("__doc_id")).distinct()
    same = (F.xxhash64("doc_id", "text") == F.col("__of")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__doc_id"))
    return docs.join(leaks, same, "left_anti")
