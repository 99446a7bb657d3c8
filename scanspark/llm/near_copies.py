"""Near copies: texts whose sets of word shingles have a Jaccard similarity of at least a bound, all of them.

SimHash deletion variants (see simhash) group most copies; each is verified against the first of its group. Fingerprints alone can't reach a bound on shingle sets without losing pairs, so
prefixes finish the work: with all shingles in one fixed order, two sets as similar as asked share one among the first n - ceil(least * n) + 1
of each. A text is indexed by those, a fifth of its shingles at a bound of 0.8, however large the corpus is. Shingles that many texts share come last in the order, by how common they
are, so they seldom are in a prefix. Texts that share a prefix shingle, and whose lengths, places and prefixes allow the bound, are compared by their whole sets.

In a bucket of a shingle the texts meet its first ones; what is left meets the next ones, four times as many, as long as it has texts of two groups. So a family of copies costs its
members, not its pairs, and no pair of different groups is left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scanspark.llm import simhash
from scanspark.llm.bit_filter import bit_filter, passing
from scanspark.llm.shared import batches, sized, stored
from scanspark.llm.vocabulary import frequent
from scanspark.operators.graph import components

#: Words whose hashes a worker keeps; keys of texts it knows to have seen; shingles counted at once.
MOST_WORDS, MOST_KEYS, BLOCK = 1_000_000, 1_000_000, 2_000_000
#: Pairs with one text that meet in one group.
MOST_PAIRS = 1000
#: Pairs of sketches, and of whole sets, that a task compares.
SKETCH_PAIRS, SET_PAIRS = 20_000, 5_000
#: A shingle is common if tasks that saw it twice or more saw it so often; so many of the most common are known to every task.
COMMON, MOST_COMMON = 16, 1 << 20
#: First texts of a bucket that the others meet, in the first round, and how many times as many in each further one.
HEADS, GROWTH = 2, 4


class WordHashes(dict):
    """64-bit hashes of words, up to MOST_WORDS at a time."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word)
        return found


#: Odd factors for a word's place in a shingle, and those that mix the sum: the golden ratio's multiples and the finalizer of MurmurHash3 (fixed values).
PLACE = 0x9E3779B97F4A7C15
MIX = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def shingle_set(text: bytes, size: int, hashes: WordHashes) -> np.ndarray:
    """The sorted set of 64-bit hashes of a text's shingles of size words, A-Z lower-cased; of a text of fewer words the whole is one."""
    words = text.lower().split()
    ids = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    width = size if len(words) >= size else len(words)
    out = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        out += ids[i : i + len(out)] * np.uint64((2 * i + 1) * PLACE & (1 << 64) - 1 | 1)
    for factor in MIX:
        out ^= out >> np.uint64(33)
        out *= factor
    return np.unique(out ^ out >> np.uint64(33))


def fresh(frames: Iterable[pa.RecordBatch]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Keys and texts of batches (key, text), most copies of one key in a task left out."""
    seen: set[int] = set()
    for frame in frames:
        for part in batches([frame]):
            keys, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
            if len(seen) > MOST_KEYS:
                seen.clear()
            yield [keys[i] for i in new], [texts[i] for i in new]


def common_shingles(docs: DataFrame, size: int) -> DataFrame:
    """type (a shingle's hash), n: those that tasks saw in two texts or more of a block, added up, if that makes COMMON."""

    def counted(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, n = WordHashes(), [], 0

        def out() -> pa.RecordBatch:
            own, times = np.unique(np.concatenate(held), return_counts=True)
            own, times = own[times > 1], times[times > 1]
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(times)], ["type", "n"])

        for _, texts in fresh(frames):
            for text in texts:
                held.append(shingle_set(text, size, hashes))
                n += len(held[-1])
                if n >= BLOCK:
                    yield out()
                    held, n = [], 0
        if held:
            yield out()

    rows = docs.select("key", F.col("text").cast("binary")).mapInArrow(counted, "type long, n long")
    return rows.groupBy("type").agg(F.sum("n").alias("n")).filter(F.col("n") >= COMMON)


class Order:
    """The order of shingles: by how common they are (in powers of two; 0: not known as common), then by their hash."""

    def __init__(self, common: pa.Table):
        types = common["type"].to_numpy().view(np.uint64)
        by = np.argsort(types)
        self.common, self.levels = types[by], np.log2(common["n"].to_numpy()[by]).astype(np.uint8)

    def prefix(self, own: np.ndarray, least: float) -> np.ndarray:
        """The first shingles of a sorted set: one of them at least is among those of any set as similar as that."""
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, own), len(self.common) - 1)
            level = np.where(self.common[at] == own, self.levels[at], 0)
            own = own[np.lexsort((own, level))] if level.any() else own
        return own[: prefix_size(len(own), least)]


def prefix_size(n: int, least: float) -> int:
    return n - math.ceil(least * n - 1e-9) + 1


def prefixes(docs: DataFrame, least: float, size: int, order: Broadcast) -> DataFrame:
    """h, key, of (n << 32 | cap) of docs (key, text): the prefix shingles of each text, how many shingles it has, and how many of them do not come before h."""

    def made(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for keys, texts in fresh(frames):
            found, owner, ofs = [], [], []
            for key, text in zip(keys, texts, strict=True):
                own = shingle_set(text, size, hashes)
                found.append(order.value.prefix(own, least))
                owner.append(np.full(len(found[-1]), key))
                ofs.append((len(own) << 32) + len(own) - np.arange(len(found[-1])))
            if found:
                h, key, of = (np.concatenate(x) for x in (found, owner, ofs))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(key, pa.int64()), pa.array(of, pa.int64())], ["h", "key", "of"])

    return docs.select("key", F.col("text").cast("binary")).mapInArrow(made, "h long, key long, of long")


def strong(least: float) -> Column:
    """Whether a text could be as similar as asked to one of its own size, from this shingle on. Of two texts that are, one at least is strong."""
    return F.col("cap") * (1 + least) + 1e-6 >= 2 * least * F.col("n")


def met(rows: DataFrame, heads: int, least: float) -> DataFrame:
    """Of the rows of buckets (h, key, n, cap): a, b (a pair with one of the first strong texts of a bucket, where lengths and places allow the bound), or h, a, n, cap of
    what is left: the rows after those, while a strong one is among them."""
    whole = Window.partitionBy("h")
    order = whole.orderBy(F.desc("strong"), "key")
    rows = rows.withColumn("strong", strong(least)).withColumn("at", F.row_number().over(order))
    first = F.collect_list(F.when(F.col("at") <= heads, F.struct("key", "n", "cap", "strong", "at")))
    rows = rows.select("*", first.over(whole).alias("heads"), F.count(F.lit(1)).over(whole).alias("all"), F.sum(F.col("strong").cast("int")).over(whole).alias("fit"))
    rows = rows.filter((F.col("all") > 1) & (F.col("fit") > 0))

    def near(x: Column) -> Column:
        n, cap = F.col("n"), F.col("cap")
        lengths = F.least(n, x["n"]) + 1e-6 >= least * F.greatest(n, x["n"])
        places = F.least(cap, x["cap"]) * (1 + least) + 1e-6 >= least * (n + x["n"])
        return (x["at"] < F.col("at")) & x["strong"] & (x["key"] != F.col("key")) & lengths & places

    empty = F.lit(None)
    to = lambda h, n, cap, b: F.struct(h.cast("long").alias("h"), n.cast("int").alias("n"), cap.cast("int").alias("cap"), b.cast("long").alias("b"))
    pairs = F.transform(F.filter("heads", near), lambda x: to(empty, empty, empty, x["key"]))
    left = (F.col("at") > heads) & (F.col("fit") > heads) & (F.col("all") > heads + 1)
    out = F.concat(pairs, F.when(left, F.array(to(F.col("h"), F.col("n"), F.col("cap"), empty))).otherwise(F.array()))
    return rows.select(F.col("key").alias("a"), F.explode(out).alias("to")).select("a", "to.*")


def chosen(docs: DataFrame, rows: DataFrame, made: Callable[[bytes, WordHashes], bytes], name: str) -> DataFrame:
    """key, name (what made gives for its text) of the rows of docs (key, row, text) whose row is among rows.row; texts stay where they are read. A few other rows may come, too."""
    held = bit_filter(rows, "row")

    def worked(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for frame in frames:
            frame = frame.filter(pa.array(passing(frame.column(1).to_numpy().view(np.uint64), held.value))).select([0, 2])
            for keys, texts in fresh([frame]):
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([made(t, hashes) for t in texts], pa.binary())], ["key", name])

    return docs.select("key", "row", F.col("text").cast("binary")).mapInArrow(worked, f"key long, {name} binary")


def sketches(docs: DataFrame, rows: DataFrame, least: float, size: int, order: Broadcast) -> DataFrame:
    """key, sketch: the number of a text's shingles (4 bytes), then 16 bits of each of its prefix (see chosen)."""

    def made(text: bytes, hashes: WordHashes) -> bytes:
        own = shingle_set(text, size, hashes)
        return len(own).to_bytes(4, "little") + order.value.prefix(own, least).astype(np.uint16).tobytes()

    return chosen(docs, rows, made, "sketch")


def beside(pairs: DataFrame, texts: DataFrame, name: str, each: int) -> DataFrame:
    """a, b, x, y: pairs (stored) with what texts (key, name) have for both, in a task for each `each` of them. What a b in many pairs has is dealt out with them."""
    rows = pairs.count()
    fit = lambda df: sized(df, rows, each)
    parts = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / MOST_PAIRS).alias("parts"))
    right = fit(texts.select(F.col("key").alias("b"), F.col(name).alias("y")).join(parts, "b")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    left = fit(fit(pairs.join(parts, "b")).join(texts.select(F.col("key").alias("a"), F.col(name).alias("x")), "a")).withColumn("part", F.pmod(F.xxhash64("a"), F.col("parts"))).drop("parts")
    return fit(left.join(right.drop("parts"), ["b", "part"])).select("a", "b", "x", "y")


def possible(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sketches allow the similarity: what their prefixes share, and all the rest of one, would be enough. 16 bits can only make prefixes more alike, so no pair is lost."""

    def compared(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            good = []
            for x, y in zip(frame.column(2).to_pylist(), frame.column(3).to_pylist(), strict=True):
                n, m = int.from_bytes(x[:4], "little"), int.from_bytes(y[:4], "little")
                p, q = np.frombuffer(x, np.uint16, offset=4), np.frombuffer(y, np.uint16, offset=4)
                shared = int(max(np.isin(p, q).sum(), np.isin(q, p).sum()))
                rest = max(n - prefix_size(n, least), m - prefix_size(m, least))
                good.append((shared + rest) * (1 + least) + 1e-6 >= least * (n + m))
            yield frame.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return beside(pairs, texts, "sketch", SKETCH_PAIRS).mapInArrow(compared, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets (key, shingles: 64-bit hashes in order) have a Jaccard similarity of least or more."""

    def compared(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            good = []
            for x, y in zip(frame.column(2).to_pylist(), frame.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common + 1e-9 >= least * (len(x) + len(y) - common))
            yield frame.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return beside(pairs, sets, "shingles", SET_PAIRS).mapInArrow(compared, "a long, b long").distinct()


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (stored) whose texts are not in one group yet."""
    rows = pairs.count()
    group = lambda c: groups.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    both = sized(sized(pairs.join(group("a"), "a", "left"), rows).join(group("b"), "b", "left"), rows)
    return both.filter(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select(*pairs.columns)


def near_links(docs: DataFrame, least: float = 0.8, size: int = 5) -> DataFrame:
    """node, root: the groups of near copies among the texts of docs (key: 64-bit hash of the text, row: one of the row, text), but for texts alone in theirs.

    Texts of one key are one. A group is what links of pairs of at least the similarity connect; all such pairs are found. Empty docs give no rows.
    """
    first = stored(docs.groupBy("key").agg(F.min("row").alias("row")), "near-first-rows")
    rows_of = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(first, "key")
    sets_of = lambda pairs: stored(chosen(docs, stored(rows_of(pairs), "near-keys"), lambda t, hashes: shingle_set(t, size, hashes).tobytes(), "shingles"), "shingle-sets")
    prints = simhash.near_duplicates(docs.select(F.col("key").alias("doc_id"), "text"), with_text=False).select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    prints = stored(prints.filter("a <> b").distinct(), "fingerprint-pairs")
    common = frequent(stored(common_shingles(docs, size), "common-shingles"), MOST_COMMON)
    order = docs.sparkSession.sparkContext.broadcast(Order(common.toArrow()))
    rows = prefixes(docs, least, size, order).repartition("h").groupBy("h", "key").agg(F.max("of").alias("of"))
    rest = rows.select("h", "key", F.shiftright("of", 32).cast("int").alias("n"), F.col("of").bitwiseAND(F.lit((1 << 32) - 1)).cast("int").alias("cap"))
    heads, groups, drawn = HEADS, None, None
    while True:
        table = stored(met(rest, heads, least), "near-met")
        pairs = stored(table.filter("b IS NOT NULL").select("a", "b").distinct(), "near-candidates")
        rest = table.filter("h IS NOT NULL").select("h", F.col("a").alias("key"), "n", "cap")
        if groups is None:
            keys = pairs.select(F.explode(F.array("a", "b")).alias("key")).unionByName(rest.select("key")).distinct()
            drawn = stored(sketches(docs, stored(keys.join(first, "key"), "near-keys"), least, size, order), "near-sketches")
        else:
            pairs = stored(apart(pairs, groups), "near-apart")
        pairs = stored(possible(pairs, drawn, least), "near-possible")
        pairs = pairs if groups is not None else stored(pairs.unionByName(prints).distinct(), "near-pairs")
        links = stored(verified(pairs, sets_of(pairs), least), "near-links")
        links = links if groups is None else groups.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links)
        groups = stored(components(links), "near-groups")
        named = sized(rest.join(groups.withColumnRenamed("node", "key"), "key", "left"), rest.count()).withColumn("root", F.coalesce("root", "key"))
        bucket = Window.partitionBy("h")
        open_ = named.withColumns({"__low": F.min("root").over(bucket), "__high": F.max("root").over(bucket)}).filter("__low <> __high")
        rest = stored(open_.select("h", "key", "n", "cap"), "near-rest")
        if rest.isEmpty():
            return groups
        heads *= GROWTH


def keep_one(docs: DataFrame, least: float = 0.8, size: int = 5) -> DataFrame:
    """One document of each group of near copies of docs (doc_id, text, others): that of the smallest doc_id (of repeated rows of it, one).

    Texts of a Jaccard similarity of least or more on A-Z-lower-cased shingles of size words (of fewer words: the whole) are linked; groups are what links
    connect. No such pair is missed, and no pair below it is linked. A null text is empty; empty texts are one group. A null doc_id is the smallest. Columns pass
    through; docs may have any names but __row, __of, __doc_id and __n. Very long texts are taken whole. An empty table stays empty.
    The texts are shuffled once, to meet the list of those that stay.
    """
    of, text = F.xxhash64("doc_id", "text"), F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", of.alias("of"), F.xxhash64(text).alias("key"), text.alias("text"))
    groups = near_links(keyed.select("key", F.col("of").alias("row"), "text"), least, size).select(F.col("node").alias("key"), "root")
    rows = stored(keyed.groupBy("key", "doc_id", "of").agg(F.count(F.lit(1)).alias("n")), "near-rows")
    firsts = rows.groupBy("key").agg(F.min(F.struct("doc_id", "of", "n")).alias("m")).join(groups, "key", "left")
    stay = firsts.groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("m").alias("m"))
    stay = stored(stay.select(F.col("m.doc_id").alias("__doc_id"), F.col("m.of").alias("__of"), F.col("m.n").alias("__n")), "stay")
    kept = docs.withColumn("__row", of).join(stay.hint("shuffle_hash"), (F.col("__row") == F.col("__of")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")))
    once = kept.filter("__n = 1").select(*docs.columns)
    return once.unionByName(kept.filter("__n > 1").dropDuplicates(["__row", "__doc_id"]).select(*docs.columns))
