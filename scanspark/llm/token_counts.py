"""Token counts without ids: pieces are counted once for each distinct pre-token and joined to the documents' pre-token frequencies."""

from __future__ import annotations

import os
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanspark.llm.shared import batches, stored
from scanspark.llm.vocabulary import count_types, frequent

_CUT = re.compile(r"(?<=\S)(?=[ \n\t\r])")
_MORE = re.compile(r"[\n\t\r]")


def pre_tokens(text: str) -> dict[str, int]:
    """The pre-tokens of a text with their counts: it is cut where a space, tab or line end follows a character that is no white space.

    A byte-level BPE's own pieces never reach over such a place, as only white space may follow white space in
    them, so the pieces of the text are those of its pre-tokens.
    """
    parts = text.split(" ")
    counts = Counter(parts)
    if "" in counts or any(p[-1].isspace() for p in counts):
        return Counter(_CUT.split(text)) if text else {}
    counts[parts[0]] -= 1
    out: dict[str, int] = {}
    for part, n in [*((f" {p}", n) for p, n in counts.items() if n), (parts[0], 1)]:
        for piece in _CUT.split(part) if _MORE.search(part) else (part,):
            out[piece] = out.get(piece, 0) + n
    return out


def tokenizer(path: str):
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def count_pieces(types: DataFrame, path: str) -> DataFrame:
    """types (type, n) with pieces: how many ids the tokenizer at path gives for the type."""

    def counted(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for frame in frames:
            found = tok.encode_batch_fast(frame.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(map(len, found), pa.int64())], ["type", "n", "pieces"])

    return types.select("type", "n").mapInArrow(counted, "type string, n long, pieces long")


def count_tokens(docs: DataFrame, path: str, limit: int = 512, most_frequent: int = 200_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text).

    n_tokens is the number of ids of the tokenizer file at path for the whole text, without added special tokens
    (those written out in a text count as the library's default has it). A null text is empty: 0 bytes, 0 tokens.
    Repeated rows and ids give a row each, a null doc_id stays. Other columns are not read.

    Pre-tokens among the most_frequent (at most) of the corpus are joined by a table that every task holds; the rows of all
    others go through a shuffled join, so every pre-token's count comes from the one table of distinct pre-tokens.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    pieces = stored(count_pieces(count_types(docs.select(text), "text", pre_tokens, "string"), path), "pre-token-pieces")
    table = frequent(pieces, most_frequent).select("type", "pieces").toArrow()
    known = docs.sparkSession.sparkContext.broadcast(dict(zip(table["type"].to_pylist(), table["pieces"].to_pylist(), strict=True)))
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("part", pa.int64()), ("type", pa.string()), ("freq", pa.int64())])

    def frequencies(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = known.value
        for frame in batches(frames):
            rows, ids, sizes, parts, types, freqs = [], [], [], [], [], []
            for row, doc, size, text in zip(*(c.to_pylist() for c in frame.columns), strict=True):
                part = 0
                for piece, n in pre_tokens(text).items():
                    got = has.get(piece)
                    if got is None:
                        rows.append(row), ids.append(None), sizes.append(None), parts.append(None), types.append(piece), freqs.append(n)
                    else:
                        part += got * n
                rows.append(row), ids.append(doc), sizes.append(size), parts.append(part), types.append(None), freqs.append(None)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((rows, ids, sizes, parts, types, freqs), schema, strict=True)], schema=schema)

    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long"), F.octet_length(text).cast("long").alias("n_bytes"), text)
    rows = own.mapInArrow(frequencies, "row long, doc_id long, n_bytes long, part long, type string, freq long")
    # Rows without a type are spread by their own number.
    rows = rows.withColumn("spread", F.when(F.col("type").isNull(), F.col("row")).otherwise(0))
    rows = rows.join(pieces.select("type", "pieces", F.lit(0).cast("long").alias("spread")), ["type", "spread"], "left")
    tokens = F.sum(F.coalesce("part", F.col("freq") * F.col("pieces")))
    out = rows.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), tokens.alias("n_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
