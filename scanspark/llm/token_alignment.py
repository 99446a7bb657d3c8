r"""Alignment of two tokenizers over a corpus: which ids of one stand where which ids of the other do.

Exact-text deduplication: texts are shuffled whole, each distinct one is tokenized and aligned once, its pairs of ids count with its multiplicity, and
its measures are joined to the documents that have it.

Both tokenizers' pieces are laid over the bytes of " " + text; places where a token of each ends cut the bytes into groups, and
every id of one side in a group is linked to every id of the other. Where no piece of either
vocabulary reaches from a character that is no white space over a following space, tab or line end, a text's tokens and groups are those of its segments, cut there. A worker keeps what it found for a segment, up to a bound.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanspark.llm.shared import batches, stored
from scanspark.llm.token_counts import tokenizer
from scanspark.llm.vocabulary import frequent

#: Segments (and their bytes) that a worker remembers.
MOST_SEGMENTS, MOST_BYTES = 400_000, 32 << 20
#: Pairs held by a task before it passes their counts on.
FLUSH = 4_000_000
#: A text is hot if one in HOT documents is a copy of it.
HOT = 10_000
MEASURES = ("n_a", "n_b", "n_groups", "n_links")


def byte_of() -> dict[str, int]:
    """The byte for each character of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes in order for the characters from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteLevel:
    """A byte-level BPE of a tokenizers file."""

    cuts = " \n\t\r"

    def __init__(self, path: str):
        self.model, table = tokenizer(path), byte_of()
        self.model.encode_special_tokens = True
        special = self.model.get_added_tokens_decoder()
        self.bytes = [b""] * (max(self.model.get_vocab().values()) + 1)
        for piece, i in self.model.get_vocab().items():
            self.bytes[i] = piece.encode() if i in special else bytes(table[c] for c in piece)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model that writes a space as U+2581 and puts one before the text: texts to encode begin with that space."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        written = [n.replace("▁", " ") for i, n in enumerate(names) if not self.model.is_byte(i)]
        self.bytes = [bytes([int(n[3:-1], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
        # Where no piece goes on over such a character.
        self.cuts = "".join(c for c in " \n\t\r" if not any(re.search(rf"\S{c}", n) for n in written))

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode([t[1:] for t in texts], num_threads=1)


class Aligner:
    """Measures, pairs and groups of segments, by number. A segment begins with white space; only the last of a text ends with it."""

    #: Stands before segments that are encoded together.
    HEAD = " x"

    def __init__(self, path_a: str, path_b: str):
        self.sides = ByteLevel(path_a), Pieces(path_b)
        self.lengths = [np.array([len(x) for x in side.bytes], np.int64) for side in self.sides]
        self.names = [len(side.bytes) for side in self.sides]
        self.cuts = "".join(c for c in self.sides[0].cuts if c in self.sides[1].cuts)
        self.cut = re.compile(rf"(?<=\S)(?=[{self.cuts}])") if self.cuts else re.compile("(?!)")
        #: What is written for an id of either side before "", a comma, a bar, a semicolon.
        ids = [*range(self.names[0]), *range(self.names[1])]
        self.said = [f"{i}{mark}" for mark in ("", ",", "|", ";") for i in ids]
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.size = 0
        self.groups: list[str] = []
        #: By segment: whether both sides give its bytes, and MEASURES. By pair of a segment: its code, how many links it is.
        self.good, self.measures = np.zeros(0, bool), np.zeros((0, len(MEASURES)), np.int64)
        self.first, self.codes, self.links = np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def segments(self, text: str) -> list[str]:
        """The segments of " " + text, or none if it is empty."""
        if not text:
            return []
        if "\0" not in text:
            marked = " " + text
            for c in self.cuts:
                marked = marked.replace(c, f"\0{c}")
            found = marked.split("\0")[1:]
            if found and not any(map(str.isspace, [s[-1:] or " " for s in found[:-1]])):
                return found
        return self.cut.split(" " + text)

    def encoded(self, segments: list[str]) -> tuple[list[np.ndarray], np.ndarray] | None:
        """Both sides' ids for segments laid end to end, and the segments' lengths in bytes; None if a side gives other bytes.

        Segments are encoded many in a text, those that end with white space in one of their own.
        """
        open_, alone = [s for s in segments if not s[-1].isspace()], [s for s in segments if s[-1].isspace()]
        runs = [open_[i : i + 2000] for i in range(0, len(open_), 2000)] + [[s] for s in alone]
        texts = [self.HEAD + "".join(run) for run in runs]
        raw = [t.encode() for t in texts]
        out = []
        for side, lengths in zip(self.sides, self.lengths, strict=True):
            flat = []
            for ids, want in zip(side.encode(texts), raw, strict=True):
                if b"".join(map(side.bytes.__getitem__, ids)) != want:
                    return None
                flat += ids[int(np.searchsorted(lengths[ids[: len(self.HEAD)]].cumsum(), len(self.HEAD))) + 1 :]
            out.append(np.array(flat, np.int64))
        segments[:] = open_ + alone
        return out, np.array([len(s) if s.isascii() else len(s.encode()) for s in segments], np.int64)

    def learn(self, segments: list[str]) -> None:
        """Tokenizes and aligns segments that are not known yet, all at once: laid end to end, they are one sequence of bytes for both sides."""
        if not segments:
            return
        bad: list[str] = []
        found = self.encoded(segments)
        if found is None:
            bad = [s for s in segments if self.encoded([s]) is None]
            segments = list(set(segments).difference(bad))
            found = self.encoded(segments)
        (a, b), sizes = found
        end_a, end_b, end = self.lengths[0][a].cumsum(), self.lengths[1][b].cumsum(), sizes.cumsum()
        cuts = np.intersect1d(end_a, end_b, assume_unique=True)
        of_a, of_b, owner = np.searchsorted(cuts, end_a), np.searchsorted(cuts, end_b), np.searchsorted(end, cuts)
        in_a, in_b = np.bincount(of_a, minlength=len(cuts)), np.bincount(of_b, minlength=len(cuts))
        n = len(segments)
        sums = [np.bincount(owner, w, n).astype(np.int64) for w in (in_a, in_b, np.ones(len(cuts)), in_a * in_b)]
        codes, links, of = self._pairs(a, b, in_a, in_b, owner)
        self.groups += self._groups(a, b, of_a, of_b, owner, n) + [""] * len(bad)
        none = np.zeros(len(bad), np.int64)
        self.first = np.concatenate([self.first, self.first[-1] + np.concatenate([np.bincount(of, minlength=n), none]).cumsum()])
        self.codes, self.links = np.concatenate([self.codes, codes]), np.concatenate([self.links, links])
        self.good = np.concatenate([self.good, np.ones(n, bool), none.astype(bool)])
        self.measures = np.concatenate([self.measures, np.stack(sums, 1), np.zeros((len(bad), len(MEASURES)), np.int64)])
        for s in segments + bad:
            self.number[s] = len(self.number)
            self.size += len(s)

    def _groups(self, a: np.ndarray, b: np.ndarray, of_a: np.ndarray, of_b: np.ndarray, owner: np.ndarray, n: int) -> list[str]:
        """The groups of each segment, as text: every id with the mark that follows it."""
        place = np.concatenate([2 * of_a, 2 * of_b + 1])
        by = np.argsort(place, kind="stable")
        place, ids = place[by], np.concatenate([a, b + self.names[0]])[by]
        segment = owner[place >> 1]
        step, same = np.diff(place, append=-1), segment == np.concatenate([segment[1:], [-1]])
        mark = np.where(step == 0, 1, np.where(place & 1 == 0, 2, np.where(same, 3, 0)))
        said = list(map(self.said.__getitem__, (ids + mark * sum(self.names)).tolist()))
        stops = np.bincount(segment, minlength=n).cumsum().tolist()
        return ["".join(said[i:j]) for i, j in zip([0, *stops], stops, strict=False)]

    def _pairs(self, a: np.ndarray, b: np.ndarray, in_a: np.ndarray, in_b: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes, links and segment of each group's pairs. Groups of many tokens are paired by their distinct ids."""
        large = in_a * in_b > 1 << 12
        first_a, first_b = in_a.cumsum() - in_a, in_b.cumsum() - in_b
        group = np.repeat(np.arange(len(in_a)), in_a)
        left = np.flatnonzero(~large[group])
        q = in_b[group[left]]
        at = np.repeat(first_b[group[left]] - (q.cumsum() - q), q) + np.arange(q.sum())
        parts = [(np.repeat(a[left], q) * self.names[1] + b[at], np.ones(len(at), np.int64), np.repeat(owner[group[left]], q))]
        for g in np.flatnonzero(large):
            x, n = np.unique(a[first_a[g] : first_a[g] + in_a[g]], return_counts=True)
            y, m = np.unique(b[first_b[g] : first_b[g] + in_b[g]], return_counts=True)
            codes = (x[:, None] * self.names[1] + y).ravel()
            parts.append((codes, (n[:, None] * m).ravel(), np.full(len(codes), owner[g])))
        codes, links, of = (np.concatenate(x) for x in zip(*parts, strict=True))
        by = np.argsort(of, kind="stable")
        return codes[by], links[by], of[by]

    def numbers(self, segments: list[str]) -> np.ndarray:
        if len(self.number) > MOST_SEGMENTS or self.size > MOST_BYTES:
            self.forget()
        found = list(map(self.number.get, segments))
        missing = [i for i, n in enumerate(found) if n is None]
        self.learn(list(dict.fromkeys([segments[i] for i in missing])))
        for i in missing:
            found[i] = self.number[segments[i]]
        return np.array(found, np.int64)

    def align(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, str]]:
        """MEASURES, distinct codes in order, links of each, and groups of each text; nothing of any for an empty text, or where a side's bytes differ."""
        cut = [self.segments(t) for t in texts]
        sizes = np.array([len(x) for x in cut], np.int64)
        numbers = self.numbers([s for x in cut for s in x])
        text = np.repeat(np.arange(len(cut)), sizes)
        good = np.bincount(text[~self.good[numbers]], minlength=len(cut)) == 0
        own, times = np.unique(text[good[text]] << 32 | numbers[good[text]], return_counts=True)
        text, segment = own >> 32, own & 0xFFFFFFFF
        measures = np.zeros((len(cut), len(MEASURES)), np.int64)
        np.add.at(measures, text, self.measures[segment] * times[:, None])
        n = self.first[segment + 1] - self.first[segment]
        at = np.repeat(self.first[segment] - (n.cumsum() - n), n) + np.arange(n.sum())
        of, codes, links = np.repeat(text, n), self.codes[at], self.links[at] * np.repeat(times, n)
        by = np.lexsort((codes, of))
        of, codes, links = of[by], codes[by], links[by]
        heads = np.flatnonzero(np.concatenate([[True], (np.diff(of) != 0) | (np.diff(codes) != 0)])) if len(of) else np.zeros(0, np.int64)
        links = np.add.reduceat(links, heads) if len(heads) else links
        codes, stops = codes[heads], np.bincount(of[heads], minlength=len(cut)).cumsum()
        said = list(map(self.groups.__getitem__, numbers.tolist()))
        ends = sizes.cumsum()
        for i, (size, end, stop) in enumerate(zip(sizes.tolist(), ends.tolist(), stops.tolist(), strict=True)):
            start = stops[i - 1] if i else 0
            yield measures[i], codes[start:stop], links[start:stop], ";".join(said[end - size : end]) if good[i] else ""


@functools.lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def packed(values: np.ndarray) -> bytes:
    """Unsigned numbers as the planes of their bytes (the high ones are mostly alike), after a byte for the width."""
    most = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 4, 8) if most >> 8 * w == 0)
    return bytes([width]) + np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(len(values), width).T.tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1).T).view(f"<u{raw[0]}").ravel().astype(np.int64)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """text, n: the distinct texts of docs that are not empty, shuffled whole; copies are counted before."""
    return docs.select(F.col("text").cast("string").alias("text")).filter("text <> ''").groupBy("text").agg(F.count(F.lit(1)).alias("n"))


def aligned(types: DataFrame, path_a: str, path_b: str, digest: bool) -> DataFrame:
    """key (SHA-256), n, MEASURES and groups (or their SHA-256) for each row of types (text, n), and the text's pairs: steps between their codes, and links."""
    names = ["key", "n", *MEASURES, "groups", "steps", "links"]

    def made(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = aligner(path_a, path_b)
        for frame in batches(frames, 2 << 20):
            measures, steps, links, groups = [], [], [], []
            for m, codes, n, said in both.align(frame.column(2).to_pylist()):
                measures.append(m)
                steps.append(packed(np.diff(codes, prepend=0)))
                links.append(packed(n))
                groups.append((hashlib.sha256(said.encode()).hexdigest() if said else "") if digest else said)
            columns = [pa.array(c) for c in np.ascontiguousarray(np.array(measures, np.int64).reshape(-1, len(MEASURES)).T)]
            yield pa.RecordBatch.from_arrays([*frame.columns[:2], *columns, pa.array(groups, pa.string()), pa.array(steps, pa.binary()), pa.array(links, pa.binary())], names)

    rows = types.select(F.unhex(F.sha2("text", 256)).alias("key"), "n", "text")
    return rows.mapInArrow(made, f"key binary, n long, {', '.join(f'{m} long' for m in MEASURES)}, groups string, steps binary, links binary")


def pair_counts(table: DataFrame, names_b: int) -> DataFrame:
    """code, n, best for all pairs of the rows of aligned: a pair's code is a * names_b + b; n is how many documents hold it, best whether no pair of its a has a larger n.

    Tasks add up the pairs of FLUSH or so and pass them on, so the shuffle carries a pair once for each such block.
    """

    def added(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, counts, held = [], [], 0

        def out() -> pa.RecordBatch:
            own, at = np.unique(np.concatenate(codes), return_inverse=True)
            n = np.zeros(len(own), np.int64)
            np.add.at(n, at, np.concatenate(counts))
            return pa.RecordBatch.from_arrays([pa.array(own), pa.array(n)], ["code", "n"])

        for frame in frames:
            for n, steps in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                codes.append(unpacked(steps).cumsum())
                counts.append(np.full(len(codes[-1]), n))
                held += len(codes[-1])
                if held >= FLUSH:
                    yield out()
                    codes, counts, held = [], [], 0
        if held:
            yield out()

    pairs = table.select("n", "steps").mapInArrow(added, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))
    pairs = stored(pairs.withColumn("a", F.floor(F.col("code") / names_b)), "id-pairs")
    most = pairs.groupBy("a").agg(F.max("n").alias("most"))
    # A row for each id of one vocabulary.
    return pairs.join(F.broadcast(most), "a").select("code", "n", (F.col("n") == F.col("most")).alias("best"))


def weighed(table: DataFrame, pairs: DataFrame, most_frequent: int) -> DataFrame:
    """The rows of aligned, with n_best and count_sum in place of their pairs. The most frequent pairs (most_frequent at most) are known to every task, the rows of all others are joined."""
    often = frequent(pairs, most_frequent).toArrow()
    code, n, best = (often[c].to_numpy() for c in ("code", "n", "best"))
    by = np.argsort(code)
    known = table.sparkSession.sparkContext.broadcast((code[by], n[by], best[by]))
    names = ["key", "n", *MEASURES, "groups", "n_best", "count_sum", "code", "times"]
    own = len(names) - 4

    def made(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has, counts, bests = known.value
        for frame in batches(frames):
            sums, tops, owner, codes, times = [], [], [], [], []
            for i, (steps, links) in enumerate(zip(frame.column(own).to_pylist(), frame.column(own + 1).to_pylist(), strict=True)):
                c, k = unpacked(steps).cumsum(), unpacked(links)
                at = np.minimum(np.searchsorted(has, c), max(0, len(has) - 1))
                hit = has[at] == c if len(has) else np.zeros(len(c), bool)
                sums.append(int((counts[at[hit]] * k[hit]).sum()))
                tops.append(int(k[hit][bests[at[hit]]].sum()))
                owner.append(np.full((~hit).sum(), i))
                codes.append(c[~hit])
                times.append(k[~hit])
            rest = frame.take(pa.array(np.concatenate(owner)))
            void = pa.nulls(frame.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*frame.columns[:own], pa.array(tops, pa.int64()), pa.array(sums, pa.int64()), void, void], names)
            void = pa.nulls(rest.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([rest.column(0), *(pa.nulls(rest.num_rows, frame.schema.types[i]) for i in range(1, own)), void, void, pa.array(np.concatenate(codes)), pa.array(np.concatenate(times))], names)

    rows = table.mapInArrow(made, f"key binary, n long, {', '.join(f'{m} long' for m in MEASURES)}, groups string, n_best long, count_sum long, code long, times long")
    # Rows without a code are spread by their own key.
    rows = rows.withColumn("spread", F.when(F.col("code").isNull(), F.xxhash64("key")).otherwise(0))
    rows = rows.join(pairs.select("code", F.col("n").alias("docs"), "best", F.lit(0).cast("long").alias("spread")), ["code", "spread"], "left")
    best = F.sum(F.coalesce("n_best", F.when(F.col("best"), F.col("times")).otherwise(0)))
    return rows.groupBy("key").agg(*(F.max(c).alias(c) for c in ("n", *MEASURES, "groups")), best.alias("n_best"), F.sum(F.coalesce("count_sum", F.col("times") * F.col("docs"))).alias("count_sum"))


def align_documents(docs: DataFrame, path_a: str, path_b: str, digest: bool = False, most_frequent: int = 1 << 20) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups for each row of docs (doc_id, text).

    a is the tokenizers file at path_a (byte-level BPE) on " " + text, b the sentencepiece model at path_b on the text; special strings inside
    texts are plain text. groups has the ids of each group (`a1,a2|b1;a3|b2,b3`), or, with digest, their SHA-256 in hexadecimal. A link is a token of a and one of b
    in one group; a pair of ids counts in how many documents (rows of docs) it is linked; n_best is how many links have the largest count of their a's
    pairs (ties: all), count_sum adds up the counts of the links. Null and empty texts, and those whose tokens do not give the bytes of " " + text,
    have zeros and empty groups, with digest, too. Repeated rows get a row each, a null doc_id stays. Very long texts are taken whole. Other columns are not read. No
    rows: none.

    Texts that a ten-thousandth of all rows hold (so 10,000 at most) are joined to their documents by a table that every task holds, all others by a shuffle.
    """
    import sentencepiece

    names_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    table = stored(aligned(distinct_texts(docs), path_a, path_b, digest), "aligned-texts", compression="zstd")
    pairs = stored(pair_counts(table, names_b), "id-pair-counts")
    texts = stored(weighed(table, pairs, most_frequent), "text-measures")
    key = F.when(F.col("text") != "", F.unhex(F.sha2(F.col("text").cast("string"), 256)))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key")), "text-keys")
    total = rows.count()
    hot = F.col("n") * HOT >= total
    often = F.broadcast(texts.filter(hot))
    measures = [*MEASURES, "n_best", "count_sum", "groups"]
    rest = rows.filter("key IS NOT NULL").join(often.select("key"), "key", "left_anti").join(texts.filter(~hot), "key")
    zeros = rows.filter("key IS NULL").select("doc_id", *(F.lit(0).cast("long").alias(m) for m in measures[:-1]), F.lit("").alias("groups"))
    return rows.join(often, "key").unionByName(rest).select("doc_id", *measures).unionByName(zeros)
