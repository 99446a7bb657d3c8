r"""Filter interaction audit: what each filter of a chain removes, in every order of the chain.

Documents are counted by the set of filters they fail, so everything after that works on a small table: for each part, a count for
each mask (a set of filters). Masks form a matrix with 0 where a filter fails and infinity elsewhere; orders form a matrix of
the filters' positions (the inverse permutations). Their product in the (min, plus) algebra is the step that removes a mask under an order. The
steps drive weighted scatter counts; what fails a filter but left before is redundant there.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scanspark.llm.shared import UPPER, batches

#: The filters of flagged, in the order of their bits.
FILTERS = "ABCDE"
SYMBOLS = b"#$%&*|"
#: What a report counts, and the columns of its rows.
WEIGHTS = ("n", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
REPORT = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)


def failing(text: bytes, least_words: int = 100, least_distinct: int = 80, most_upper: int = 10) -> int:
    """The mask of A (fewer words), B (a smaller percentage of distinct words), C (a larger percentage of A-Z) and D (holds one of SYMBOLS) that a UTF-8 text fails."""
    words = text.split()
    chars = len(text) if text.isascii() else len(text.decode())
    upper = len(text) - len(text.translate(None, UPPER.encode()))
    marked = len(text.translate(None, SYMBOLS)) < len(text)
    fails = (len(words) < least_words, 100 * len(set(words)) < least_distinct * len(words), 100 * upper > most_upper * chars, marked)
    return sum(1 << i for i, f in enumerate(fails) if f)


def text_masks(docs: DataFrame, **limits: int) -> DataFrame:
    """doc_id, part, mask (of failing, with the limits given) and digest (SHA-256 of the text) for each row of docs (doc_id, text, lang)."""

    def made(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in batches(frames):
            found = frame.column(2).to_pylist()
            masks = pa.array([failing(t, **limits) for t in found], pa.int32())
            digests = pa.array([hashlib.sha256(t).digest() for t in found], pa.binary())
            yield pa.RecordBatch.from_arrays([*frame.columns[:2], masks, digests], ["doc_id", "part", "mask", "digest"])

    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), empty("lang").alias("part"), empty("text").cast("binary").alias("text"))
    return own.mapInArrow(made, "doc_id long, part string, mask int, digest binary")


def flagged(docs: DataFrame, labels: DataFrame, **limits: int) -> DataFrame:
    """part, mask, n, good, toxic: how many rows of docs (doc_id, text, lang) in a part (lang; null: empty) fail just the filters of the mask, and how many of them labels call good (quality 1) or toxic (1).

    A to D are those of failing. E fails where a smaller doc_id has the same text. A null text is empty. Repeated rows count each, and none of
    them is a copy of another; a null doc_id is no copy, has no copies and no label. An id with several labels is good or toxic if one of them says so. Very long
    texts are read whole. Other columns are not read. No rows: none.

    Rows meet their labels by id (those without one are spread by their text), then copies are added up before they are shuffled by their text,
    so a text that many documents share costs a row for each task and part.
    """
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id"), F.lit(0).cast("long").alias("spread"))
    known = known.agg(F.max(F.col("quality").eqNullSafe(1)).alias("good"), F.max(F.col("toxic").eqNullSafe(1)).alias("toxic"))
    rows = text_masks(docs, **limits).withColumn("spread", F.when(F.col("doc_id").isNull(), F.xxhash64("digest")).otherwise(0))
    rows = rows.join(known, ["doc_id", "spread"], "left").na.fill(False, ["good", "toxic"])
    cell = ["digest", "mask", "part", "good", "toxic"]
    rows = rows.groupBy("doc_id", "spread", *cell).agg(F.count(F.lit(1)).alias("n"))
    has_id = F.col("doc_id").isNotNull()
    cells = rows.groupBy(*cell).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(has_id, F.col("n")).otherwise(0)).alias("n_id"),
        F.min(F.when(has_id, F.struct("doc_id", "n"))).alias("first"),
    )
    least = F.min("first.doc_id").over(Window.partitionBy("digest"))
    original = F.when(F.col("first.doc_id") == least, F.col("first.n")).otherwise(0)
    cells = cells.withColumn("copies", F.col("n_id") - original)
    copies = F.col("copies")
    split = F.explode(F.array(F.struct(F.col("mask").alias("mask"), (F.col("n") - copies).alias("n")), F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), copies.alias("n"))))
    split = cells.select("part", "good", "toxic", split.alias("of")).select("part", "good", "toxic", "of.mask", "of.n")
    weight = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), weight("good"), weight("toxic"))


def orders(filters: str) -> list[str]:
    return ["".join(p) for p in itertools.permutations(filters)]


def removal_steps(filters: str) -> np.ndarray:
    """[mask, order]: the step, from 1, at which what fails the filters of the mask goes; len(filters) + 1: it stays."""
    k = len(filters)
    masks = np.where(np.arange(1 << k)[:, None] >> np.arange(k) & 1, 0.0, np.inf)
    positions = np.array([[order.index(f) + 1 for f in filters] for order in orders(filters)], float)
    steps = (masks[:, None, :] + positions[None, :, :]).min(2)
    return np.where(np.isinf(steps), k + 1, steps).astype(np.int64)


def counted(weights: np.ndarray, filters: str, steps: np.ndarray) -> np.ndarray:
    """[order, step, COUNTS] of a part from its weights [mask, WEIGHTS]."""
    k, named = len(filters), orders(filters)
    at = np.array([[filters.index(f) for f in order] for order in named])  # [order, step]: the filter
    which = np.arange(len(named))
    lost = np.zeros((len(named), k + 1, len(WEIGHTS)), np.int64)
    failed = np.zeros((len(named), k), np.int64)
    for mask, weight in enumerate(weights):
        if weight.any():
            np.add.at(lost, (which, steps[mask] - 1), weight)
            failed += (mask >> at & 1) * weight[0]
    removed = lost[:, :k, 0]
    kept = weights[:, 0].sum() - removed.cumsum(1)
    alone = weights[1 << np.arange(k), 0]
    shapley = np.bincount(at.ravel(), removed.ravel().astype(float), k).astype(np.int64)
    return np.stack([kept, removed, failed - removed, alone[at], lost[:, :k, 1], lost[:, :k, 2], shapley[at]], 2)


def audit(masks: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part of masks (part, mask, n, good, toxic: see flagged), order of the filters (bit i: the i-th letter; applied from left to right) and step.

    kept (after the step), removed (by it), redundant (failing its filter, but removed earlier), unique_fails (failing its filter only), good_lost and
    toxic_lost (of the removed), shapley (removed by its filter, added up over all orders). Rows of one part and mask are added up; a part without rows has none.
    A part is a row of at most 2 ** len(filters) counts, dealt out by part. Orders are counted out, so len(filters) is 7 or less.
    """
    if not 1 <= len(filters) <= 7 or len(set(filters)) < len(filters):
        raise ValueError("one to seven different letters")
    names, k = orders(filters), len(filters)

    def reported(frames: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = removal_steps(filters)
        for frame in frames:
            for part, held in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), strict=True):
                weights = np.zeros((1 << k, len(WEIGHTS)), np.int64)
                for cell in held:
                    weights[cell["mask"]] += [cell[w] for w in WEIGHTS]
                found = counted(weights, filters, steps).reshape(-1, len(COUNTS))
                columns = [pa.array([part] * len(found), pa.string()), pa.array(np.repeat(names, k)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(names)))]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(np.ascontiguousarray(c)) for c in found.T)], ["part", "filter_order", "step", *COUNTS])

    cells = masks.groupBy("part", "mask").agg(*(F.sum(w).cast("long").alias(w) for w in WEIGHTS))
    return cells.groupBy("part").agg(F.collect_list(F.struct("mask", *WEIGHTS)).alias("cells")).mapInArrow(reported, REPORT)


OP11_SQL = r"""
WITH first_ids AS (
  SELECT coalesce(text, '') AS text, min(doc_id) AS least FROM documents GROUP BY 1),
d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
m AS (
  SELECT d.doc_id, part, CAST([
    len(words) < 100,
    100 * len(list_distinct(words)) < 80 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(d.doc_id > least, false)] AS BOOLEAN[]) AS fails
  FROM d JOIN first_ids USING (text)),
g AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
c AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM m LEFT JOIN g USING (doc_id) GROUP BY part, fails),
f AS (SELECT unnest(range(1, 6)) AS i),
o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS perm
  FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
r AS (
  SELECT part, perm, n, good, toxic, fails, list_position(list_transform(perm, lambda x: fails[x]), true) AS gone FROM c, o),
s AS (
  SELECT part, perm, step, perm[step] AS filter,
    CAST(sum(n) FILTER (WHERE gone IS NULL OR gone > step) AS BIGINT) AS kept,
    CAST(sum(n) FILTER (WHERE gone = step) AS BIGINT) AS removed,
    CAST(sum(n) FILTER (WHERE fails[perm[step]] AND gone < step) AS BIGINT) AS redundant,
    CAST(sum(n) FILTER (WHERE fails[perm[step]] AND len(list_filter(fails, lambda x: x)) = 1) AS BIGINT) AS unique_fails,
    CAST(sum(good) FILTER (WHERE gone = step) AS BIGINT) AS good_lost,
    CAST(sum(toxic) FILTER (WHERE gone = step) AS BIGINT) AS toxic_lost
  FROM r, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, perm, step)
SELECT part, array_to_string(list_transform(perm, lambda x: substr('ABCDE', x, 1)), '') AS filter_order, CAST(step AS INTEGER) AS step,
  coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
  coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost,
  CAST(coalesce(sum(removed) OVER (PARTITION BY part, filter), 0) AS BIGINT) AS shapley
FROM s
"""
