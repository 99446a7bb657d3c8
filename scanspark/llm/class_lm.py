"""Brown class bigrams: words get classes by exchange clustering; a text's probability is that of its classes and of its words within them.

All counts are over all training documents, and every word seen twice or more is placed by exchange. The most frequent words
(`core`) are moved one after another on the driver, on a matrix of fixed size, with the other words in classes by powers of two of their counts. Then
sweeps over the corpus count, for each other word, the classes on its left and right, and put it where these make the
likelihood of the class bigrams highest (to first order in the word's counts, small beside its class's): first the words of the frequent
table, whose size is bounded by a parameter and which every task holds, then all rarer ones, which are known by their 64-bit hash
and stay in a Spark table. Words seen once, and unseen ones, have a class of their own. Texts are tokenized once, to word numbers.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanspark.llm.shared import batches, stored
from scanspark.llm.vocabulary import count_types, frequent

#: Tokens whose neighbours a task looks at at once, and neighbours that it holds before it adds them up.
BLOCK = 500_000
#: Words that a task places at once.
PLACED = 5_000
#: A neighbour that is not in the frequent table.
OPEN = 255


def tokens(text: bytes) -> list[bytes]:
    """A-Z lower-cased; words between characters of [\\x20\\x09-\\x0D]."""
    return text.lower().split()


def exchange(bigrams: np.ndarray, fixed: np.ndarray, classes: int, least_gain: float = 1e-3) -> np.ndarray:
    """The class of each symbol of the bigram count matrix. fixed: a symbol's class, or -1 for those to be clustered into 0 .. classes-1.

    Starts from classes by frequency rank; each sweep moves each word to the class that raises the likelihood most, until
    none moves or a sweep gains less than least_gain of what the first one did.
    """
    size = len(bigrams)
    n = bigrams.sum(0) + bigrams.sum(1)
    free = np.flatnonzero(fixed < 0)
    free = free[np.argsort(-n[free], kind="stable")]
    of = fixed.copy()
    of[free] = np.arange(len(free)) % classes
    groups = int(of.max(initial=0)) + 1
    groups = max(groups, classes)
    one = np.zeros((size, groups), np.int64)
    one[np.arange(size), of] = 1
    after = bigrams @ one  # of each symbol: by class of the next
    before = bigrams.T @ one
    table = one.T @ after
    f = lambda x: x * np.log(np.maximum(x, 1))
    span = np.arange(classes)
    first = None
    while len(free):
        moved = 0.0
        for w in free:
            a, twice = of[w], bigrams[w, w]
            r, c = after[w].copy(), before[w].copy()
            table[a] -= r
            table[:, a] -= c
            table[a, a] += twice
            r[a] -= twice
            c[a] -= twice
            rows, cols = table[:classes], table[:, :classes].T
            gain = (f(rows + r) - f(rows)).sum(1) + (f(cols + c) - f(cols)).sum(1)
            own = table[span, span]
            gain -= f(own + r[:classes]) + f(own + c[:classes]) - 2 * f(own)
            gain += f(own + r[:classes] + c[:classes] + twice) - f(own)
            total_r, total_c = rows.sum(1) + c[:classes], cols.sum(1) + r[:classes]
            gain -= f(total_r + r.sum() + twice) - f(total_r) + f(total_c + c.sum() + twice) - f(total_c)
            k = int(gain.argmax())
            if gain[k] <= gain[a] + 1e-9:
                k = int(a)
            table[k] += r
            table[:, k] += c
            table[k, k] += twice
            if k != a:
                moved += gain[k] - gain[a]
                of[w] = k
                after[:, a] -= bigrams[:, w]
                after[:, k] += bigrams[:, w]
                before[:, a] -= bigrams[w]
                before[:, k] += bigrams[w]
        first = moved if first is None else first
        if moved <= least_gain * first:
            break
    return of


@dataclass
class Vocabulary:
    """The frequent table (word to number, by falling count) and the corpus totals. Other words have number len(words), the end of a text the next."""

    number: dict[bytes, int]
    counts: np.ndarray
    texts: int
    total: int
    distinct: int
    singles: int

    @property
    def other(self) -> int:
        return len(self.counts)


@dataclass
class ClassModel:
    """cls: class by word number; others: hash, n, cls of all words that are not in the frequent table; pairs: counts of class bigrams."""

    vocabulary: Vocabulary
    classes: int
    cls: np.ndarray
    others: DataFrame
    pairs: np.ndarray
    transition: np.ndarray = field(init=False)
    totals: np.ndarray = field(init=False)
    unseen: int = field(init=False)

    def __post_init__(self) -> None:
        """Witten-Bell smoothed transitions, and each class's tokens; unseen words share the class of words seen once, as often as these (Good-Turing)."""
        pairs = self.pairs.astype(float)
        single = pairs.sum(0) + 1
        single /= single.sum()
        weight = np.maximum((pairs > 0).sum(1, keepdims=True), 1.0)
        self.transition = np.log10((pairs + weight * single) / (pairs.sum(1, keepdims=True) + weight))
        self.unseen = max(1, self.vocabulary.singles)
        self.totals = pairs.sum(0)
        self.totals[self.rare] += self.unseen

    @property
    def rare(self) -> int:
        return self.classes

    @property
    def end(self) -> int:
        return self.classes + 1


def vocabulary(train: DataFrame, most_frequent: int = 200_000) -> Vocabulary:
    """The words of the column text of train (null: empty)."""
    text = train.select(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    types = stored(count_types(text, "text", lambda t: Counter(tokens(t)), "binary"), "word-types")
    sums = types.agg(F.sum("n"), F.count(F.lit(1)), F.sum((F.col("n") == 1).cast("long"))).first()
    texts = train.count()
    table = frequent(types.filter("n > 1"), most_frequent).orderBy(F.desc("n"), "type").toArrow()
    words, counts = table["type"].to_pylist(), table["n"].to_numpy().astype(np.int64)
    return Vocabulary({w: i for i, w in enumerate(words)}, counts, texts, (sums[0] or 0) + texts, sums[1] + (texts > 0), sums[2] or 0)


def encode(docs: DataFrame, words: Vocabulary, *keep: str) -> DataFrame:
    """row, kept (a struct of the columns keep), ids (binary: 32-bit word numbers, the end last), hashes (binary: 64-bit, of the words not in the table); stored."""
    held = docs.sparkSession.sparkContext.broadcast(words.number)
    other = words.other
    kept = F.struct(*keep) if keep else F.struct(F.lit(None).cast("boolean").alias("none"))
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text")
    own = docs.select(F.monotonically_increasing_id().alias("row"), kept.alias("kept"), text)

    def made(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get, digest = held.value.get, xxhash.xxh64_intdigest
        for frame in batches(frames):
            ids, hashes = [], []
            for t in frame.column(2).to_pylist():
                said = tokens(t)
                found = np.array([*(get(w, other) for w in said), other + 1], np.int32)
                ids.append(found.tobytes())
                hashes.append(np.array([digest(said[i]) for i in np.flatnonzero(found == other).tolist()], np.uint64).tobytes())
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(ids, pa.binary()), pa.array(hashes, pa.binary())], ["row", "kept", "ids", "hashes"])

    kind = own.schema["kept"].dataType.simpleString()
    return stored(own.mapInArrow(made, f"row long, kept {kind}, ids binary, hashes binary"), "encoded")


def _blocks(frames: Iterable[pa.RecordBatch], other: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers of whole texts, an end before the first, and the hashes of the other words among them; about BLOCK tokens at once."""
    ids, hashes, waiting = [], [], 0
    start = np.array([other + 1], np.int32)
    for frame in batches(frames):
        for i, h in zip(*(c.to_pylist() for c in frame.columns), strict=True):
            ids.append(np.frombuffer(i, np.int32))
            hashes.append(np.frombuffer(h, np.int64))
            waiting += len(ids[-1])
            if waiting >= BLOCK:
                yield np.concatenate([start, *ids]), np.concatenate(hashes)
                ids, hashes, waiting = [], [], 0
    if ids:
        yield np.concatenate([start, *ids]), np.concatenate(hashes)


def _core_bigrams(encoded: DataFrame, symbol: np.ndarray, size: int) -> np.ndarray:
    """The matrix of bigram counts of symbols (by word number)."""
    held = encoded.sparkSession.sparkContext.broadcast(symbol)
    other = len(symbol) - 2

    def counted(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(size * size, np.int64)
        for ids, _ in _blocks(frames, other):
            s = held.value[ids]
            cells += np.bincount(s[:-1] * size + s[1:], minlength=size * size)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(cells[at])], ["cell", "n"])

    found = encoded.select("ids", "hashes").mapInArrow(counted, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * size, np.int64)
    out[found["cell"].to_numpy()] = found["n"].to_numpy()
    return out.reshape(size, size)


def _neighbours(encoded: DataFrame, ctx: np.ndarray, groups: int, low: int, parts: int) -> DataFrame:
    """part, words, left, right (binary arrays: words to place and the groups beside them), cell, a, b, n; stored.

    ctx: the group of each word number. Words to place are those numbered low or more in the frequent table, or for low None all
    that are not in it (by hash; groups beside them that are not known are OPEN). Rows without words hold counts n: of bigrams of known groups
    (cell), or of two adjacent words by hash (a, b).
    """
    held = encoded.sparkSession.sparkContext.broadcast(ctx)
    other = len(ctx) - 2
    schema = pa.schema([("part", pa.int32()), ("words", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("cell", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def found(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros(groups * groups, np.int64)

        def batch(**columns) -> pa.RecordBatch:
            size = len(next(iter(columns.values())))
            return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in schema], schema=schema)

        for ids, hashes in _blocks(frames, other):
            g = held.value[ids]
            if low is None:
                at, open_ = np.flatnonzero(ids == other), ids == other
                words = hashes
                both = ~open_[:-1] & ~open_[1:]
                cells += np.bincount(g[:-1][both].astype(np.int64) * groups + g[1:][both], minlength=groups * groups)
                place = np.cumsum(open_) - 1
                two = np.flatnonzero(open_[:-1] & open_[1:])
                if len(two):
                    pairs, n = np.unique(np.stack([hashes[place[two]], hashes[place[two + 1]]], 1), axis=0, return_counts=True)
                    yield batch(a=pairs[:, 0], b=pairs[:, 1], n=n)
                g = np.where(open_, OPEN, g)
            else:
                at = np.flatnonzero((ids >= low) & (ids < other))
                words = ids[at].astype(np.int64)
                cells += np.bincount(g[:-1].astype(np.int64) * groups + g[1:], minlength=groups * groups)
            part = (words.view(np.uint64) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            there = np.flatnonzero(np.diff(ends))
            columns = [x[order] for x in (words, g[at - 1].astype(np.uint8), g[at + 1].astype(np.uint8))]
            cut = [[x[ends[k] : ends[k + 1]].tobytes() for k in there] for x in columns]
            if len(there):
                yield batch(part=there.astype(np.int32), words=cut[0], left=cut[1], right=cut[2])
        at = np.flatnonzero(cells)
        if len(at):
            yield batch(cell=at.astype(np.int32), n=cells[at])

    ddl = "part int, words binary, left binary, right binary, cell int, a long, b long, n long"
    return stored(encoded.select("ids", "hashes").mapInArrow(found, ddl), "neighbours")


def _added_up(h: np.ndarray, c: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of n by (h, c), in order."""
    order = np.lexsort((c, h))
    h, c, n = h[order], c[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (c[1:] != c[:-1])])) if len(h) else np.zeros(0, np.int64)
    return h[first], c[first], np.add.reduceat(n, first) if len(h) else n


def _placed(found: DataFrame, pairs: np.ndarray, classes: int, parts: int, singles_to: int | None) -> DataFrame:
    """word, n, cls of the words in found, and rows cell, n of the bigrams they make with known groups; stored.

    A word goes to the class k that maximises the sum of log p(group on the left | k) and log p(group on the right | k); words
    seen once go to class singles_to, if given. pairs: bigram counts of groups, the classes first.
    """
    groups = len(pairs)
    smooth = pairs + 0.5
    # Logarithms of the share of each group on the left and on the right of each class.
    before = np.log(smooth / smooth.sum(0))[:, :classes]
    after = np.log(smooth / smooth.sum(1, keepdims=True))[:classes].T
    schema = pa.schema([("word", pa.int64()), ("n", pa.int64()), ("cls", pa.int32()), ("cell", pa.int32())])

    def placed(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int16), np.zeros(0, np.int64))]
        waiting = 0

        def fold() -> None:
            held[:] = [_added_up(*(np.concatenate(x) for x in zip(*held, strict=True)))]

        for frame in batches(frames):
            for w, a, b in zip(*(frame.column(i).to_pylist() for i in range(3)), strict=True):
                w, one = np.frombuffer(w, np.int64), np.ones(len(w) // 8, np.int64)
                held.append((w, np.frombuffer(a, np.uint8).astype(np.int16), one))
                held.append((w, np.frombuffer(b, np.uint8).astype(np.int16) + 256, one))
                waiting += 2 * len(w)
                if waiting > BLOCK + len(held[0][0]):
                    fold()
                    waiting = 0
        fold()
        h, c, n = held[0]
        if not len(h):
            return
        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        cells = np.zeros(groups * groups, np.int64)
        for at in range(0, len(starts), PLACED):
            some = starts[at : at + PLACED]
            end = starts[at + PLACED] if at + PLACED < len(starts) else len(h)
            index = np.searchsorted(some, np.arange(some[0], end), side="right") - 1
            beside = np.zeros((2, len(some), groups))
            side, group, times = c[some[0] : end] // 256, c[some[0] : end] % 256, n[some[0] : end]
            known = group != OPEN
            beside[side[known], index[known], group[known]] = times[known]
            cls = (beside[0] @ before + beside[1] @ after).argmax(1)
            seen = np.bincount(index, times * (side == 0), len(some)).astype(np.int64)
            if singles_to is not None:
                cls[seen == 1] = singles_to
                np.add.at(cells, (group * groups + cls[index])[known & (side == 0)], times[known & (side == 0)])
                np.add.at(cells, (cls[index] * groups + group)[known & (side == 1)], times[known & (side == 1)])
            yield pa.RecordBatch.from_arrays([pa.array(h[some]), pa.array(seen), pa.array(cls, pa.int32()), pa.nulls(len(some), pa.int32())], schema=schema)
        at = np.flatnonzero(cells)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(at), pa.int64()), pa.array(cells[at]), pa.nulls(len(at), pa.int32()), pa.array(at, pa.int32())], schema=schema)

    rows = found.filter("words IS NOT NULL").repartition(parts, "part").select("words", "left", "right")
    return stored(rows.mapInArrow(placed, "word long, n long, cls int, cell int"), "placed-words")


def _cells(counts: DataFrame, groups: int) -> np.ndarray:
    """counts: cell, n."""
    got = counts.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(groups * groups, np.int64)
    out[got["cell"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(groups, groups)


def _parts(spark: SparkSession, words: int) -> int:
    """Enough parts that none has much over 20,000 words."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), words // 20_000)


def core_classes(encoded: DataFrame, words: Vocabulary, classes: int, core: int) -> tuple[np.ndarray, np.ndarray]:
    """The group of each word number after the exchange of the core, and the bigram counts of the groups: the classes, one for each power of two, others, end."""
    top, counts = min(core, words.other), words.counts
    power = np.floor(np.log2(counts[top:])).astype(np.int64)
    powers = np.unique(power)
    symbol = np.concatenate([np.arange(top), top + np.searchsorted(powers, power), [top + len(powers), top + len(powers) + 1]]).astype(np.int64)
    size = top + len(powers) + 2
    bigrams = _core_bigrams(encoded, symbol, size)
    fixed = np.full(size, -1, np.int64)
    fixed[top:] = classes + np.arange(size - top)
    of = exchange(bigrams, fixed, classes)
    one = np.zeros((size, classes + size - top), np.int64)
    one[np.arange(size), of] = 1
    return of[symbol], one.T @ bigrams @ one


def fit_encoded(encoded: DataFrame, words: Vocabulary, classes: int = 64, core: int = 1000, sweeps: int = 2) -> ClassModel:
    """The model of encoded texts."""
    spark = encoded.sparkSession
    ctx, pairs = core_classes(encoded, words, classes, core)
    top, groups, parts = min(core, words.other), classes + 2, _parts(spark, words.other)
    cls = np.concatenate([ctx[:top], np.full(words.other - top, classes), [classes, classes + 1]]).astype(np.int64)
    for sweep in range(sweeps if words.other > top else 0):
        found = _neighbours(encoded, ctx, len(pairs), top, parts)
        if sweep:
            pairs = _cells(found.filter("cell IS NOT NULL"), groups)
        placed = _placed(found, pairs, classes, parts, None).filter("word IS NOT NULL").select("word", "cls").toArrow()
        cls[placed["word"].to_numpy()] = placed["cls"].to_numpy()
        ctx, pairs = cls, np.zeros((groups, groups))

    parts = _parts(spark, words.distinct - words.other)
    found = _neighbours(encoded, cls, groups, None, parts)
    pairs = _cells(found.filter("cell IS NOT NULL"), groups)
    placed = _placed(found, pairs, classes, parts, classes)
    others = placed.filter("word IS NOT NULL").select(F.col("word").alias("hash"), "n", "cls")
    two = found.filter("a IS NOT NULL").groupBy("a", "b").agg(F.sum("n").alias("n"))
    two = two.join(others.select(F.col("hash").alias("a"), F.col("cls").alias("ca")), "a").join(others.select(F.col("hash").alias("b"), F.col("cls").alias("cb")), "b")
    pairs = pairs + _cells(placed.filter("cell IS NOT NULL").select("cell", "n"), groups) + _cells(two.select((F.col("ca") * groups + F.col("cb")).alias("cell"), "n"), groups)
    return ClassModel(words, classes, cls, others, pairs)


def fit(train: DataFrame, classes: int = 64, core: int = 1000, most_frequent: int = 200_000, sweeps: int = 2) -> ClassModel:
    """A model of the column text of train (null: empty).

    Each text ends with one end token. Repeated rows count each; words of equal counts are numbered by their bytes, and of equally good
    classes the first is taken, so a model does not depend on how rows are dealt. Texts are read whole. A table without rows
    gives a model of nothing. Columns other than text are not read.
    """
    words = vocabulary(train, most_frequent)
    return fit_encoded(encode(train, words), words, classes, core, sweeps)


def score(docs: DataFrame, model: ClassModel, *keep: str) -> DataFrame:
    """doc_id, the columns keep, n_tokens, n_known, train_tokens, base_score, score, perplexity for each row of docs (null text: empty).

    base_score is the add-one unigram log10 probability, score that of the class model. A word not in training counts as
    one unknown word in both. Repeated rows and ids give a row each, a null doc_id stays. Columns in keep with the name of a result give way to it.
    """
    new = ("n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity")
    return score_encoded(encode(docs, model.vocabulary, "doc_id", *(k for k in keep if k not in new)), model)


def score_encoded(encoded: DataFrame, model: ClassModel) -> DataFrame:
    """The columns of kept, and the results of score, for each row of encode(docs)."""
    spark = encoded.sparkSession
    words = model.vocabulary
    known = model.cls < model.rare
    emission = np.zeros(words.other + 2)
    emission[: words.other] = np.log10(words.counts / model.totals[model.cls[: words.other]])
    base = np.concatenate([np.log10(words.counts + 1.0), [0.0, np.log10(words.texts + 1.0)]])
    assert known[: words.other].all()
    held = spark.sparkContext.broadcast((model.cls, emission, base, model.transition))
    other, texts = words.other, words.texts
    schema = pa.schema([("row", pa.int64()), ("n_tokens", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("own", pa.float64()), ("hash", pa.int64()), ("before", pa.int64()), ("left", pa.int32()), ("right", pa.int32())])

    def scored(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, emission, base, transition = held.value
        for frame in batches(frames, 2 << 20):
            whole: list[list] = [[], [], [], [], []]
            parts = []
            for row, ids, hashes in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                s = np.concatenate([[other + 1], np.frombuffer(ids, np.int32)])
                h = np.frombuffer(hashes, np.int64)
                c, open_ = cls[s], s == other
                both = ~open_[:-1] & ~open_[1:]
                own = transition[c[:-1][both], c[1:][both]].sum() + emission[s[1:]].sum()
                for values, v in zip(whole, (row, len(s) - 1, len(s) - 1 - len(h) - (not texts), float(base[s[1:]].sum()), float(own)), strict=True):
                    values.append(v)
                if len(h):
                    at = np.flatnonzero(open_)
                    follows = open_[at - 1]
                    parts.append((np.full(len(h), row), h, np.where(follows, np.concatenate([[0], h[:-1]]), 0), np.where(follows, -1, c[at - 1]), np.where(open_[at + 1], -1, c[at + 1])))
            yield pa.RecordBatch.from_arrays([*(pa.array(x, f.type) for x, f in zip(whole, schema, strict=False)), *(pa.nulls(len(whole[0]), f.type) for f in list(schema)[5:])], schema=schema)
            if parts:
                row, h, before, left, right = (np.concatenate(x) for x in zip(*parts, strict=True))
                none = [pa.nulls(len(h), f.type) for f in list(schema)[1:5]]
                columns = [pa.array(row, pa.int64()), *none, pa.array(h), pa.array(before, pa.int64(), mask=left >= 0), pa.array(left, pa.int32(), mask=left < 0), pa.array(right, pa.int32(), mask=right < 0)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "row long, n_tokens long, known long, base double, own double, hash long, before long, left int, right int"
    rows = encoded.select("row", "ids", "hashes").mapInArrow(scored, ddl)
    rows = rows.withColumn("spread", F.when(F.col("hash").isNull(), F.col("row")).otherwise(0))
    others = model.others.select("hash", F.col("n").alias("found"), F.col("cls").cast("int").alias("c"), F.lit(0).cast("long").alias("spread"))
    rows = rows.join(others, ["hash", "spread"], "left").withColumn("c", F.when(F.col("hash").isNotNull(), F.coalesce("c", F.lit(model.rare))))
    # A word whose neighbour on the left is none of the frequent ones either: that one's class is looked up, too.
    single = rows.filter("before IS NULL")
    twice = rows.filter("before IS NOT NULL").join(model.others.select(F.col("hash").alias("before"), F.col("cls").cast("int").alias("cb")), "before", "left")
    twice = twice.withColumn("left", F.coalesce("cb", F.lit(model.rare))).select(*single.columns)
    rows = single.unionByName(twice)
    steps = spark.createDataFrame([(i, j, float(v)) for i, line in enumerate(model.transition) for j, v in enumerate(line)], "p int, q int, step double")
    totals = spark.createDataFrame([(i, float(v)) for i, v in enumerate(model.totals)], "c int, tokens double")
    rows = rows.join(F.broadcast(steps.select(F.col("p").alias("left"), F.col("q").alias("c"), F.col("step").alias("into"))), ["left", "c"], "left")
    rows = rows.join(F.broadcast(steps.select(F.col("p").alias("c"), F.col("q").alias("right"), F.col("step").alias("out"))), ["c", "right"], "left")
    rows = rows.join(F.broadcast(totals), "c", "left")
    found, zero = F.coalesce("found", F.lit(0)), F.lit(0.0)
    lone = F.log10(F.when(found > 0, found).otherwise(model.unseen) / F.col("tokens")) + F.coalesce("into", zero) + F.coalesce("out", zero)
    whole = rows.groupBy("row").agg(
        F.max("n_tokens").alias("n_tokens"),
        F.sum(F.coalesce("known", (found > 0).cast("long"))).alias("n_known"),
        F.sum(F.coalesce("base", F.log10(found + F.lit(1.0)))).alias("base_score"),
        F.sum(F.coalesce("own", lone)).alias("score"),
    )
    unit = F.log10(F.lit(float(words.total + words.distinct + 1)))
    out = encoded.select("row", "kept").join(whole, "row")
    base_score, total = (F.col("base_score") - F.col("n_tokens") * unit).alias("base_score"), F.lit(words.total).cast("long").alias("train_tokens")
    return out.select("kept.*", "n_tokens", "n_known", total, base_score, "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def held_out(folds: int = 7, fold: int = 2):
    """Whether the CRC-32 of a row's doc_id as text falls into the held-out fold; a null doc_id does not."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == fold, F.lit(False))
