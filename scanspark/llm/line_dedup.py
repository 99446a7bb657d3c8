"""Line dedup over levelled sorted runs of line hashes. DataFrame functions only.

A run is a table bucketed and sorted by line key: key, n_docs (documents of its batch that hold the line) and last_doc (the
largest doc_id among them). A batch is aggregated by key and merge-anti-joined with the runs there are (all have the same buckets, so no
run is shuffled): the keys that are in none are its own run, of level 0, so a key is in one run only; of the others, lines
seen again, the batch keeps its counts beside. When a level has `fanout` runs, they are merged into one run of the next
level, so a batch meets O(fanout * log(batches)) runs. In the end the counts of lines seen again, few beside all lines, are added up and merge-joined with the runs.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scanspark.llm.shared import WHITE, lower_ascii, scratch_path, stored

NEW = ("n_lines", "n_dropped")
#: A line is hot where so many lines like it would make up all rows.
HOT = 10_000


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column, min_chars: int) -> Column:
    r"""For each \n-separated line, the MD5 of its stripped, A-Z-lower-cased form, or null where that has under min_chars."""
    plain = F.transform(lines_of(text), lambda line: F.trim(line, F.lit(WHITE)))
    plain = F.transform(plain, lambda line: F.when(F.length(line) >= min_chars, lower_ascii(line)))
    return F.transform(plain, lambda line: F.md5(line))


class LineRuns:
    """The runs of one corpus. add() takes a batch of (key, doc_id) rows, one for each document and distinct line."""

    def __init__(self, spark: SparkSession, fanout: int = 2, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self.batches: list[str] = []
        self.paths: dict[str, str] = {}

    def _write(self, df: DataFrame) -> str:
        name, path = f"line_run_{uuid.uuid4().hex}", scratch_path(self.spark, "line-run")
        self.paths[name] = path
        df.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").option("path", path).saveAsTable(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name).filter("fresh").drop("fresh") for level in self.levels for name in level]

    def fresh(self, keys: DataFrame) -> DataFrame:
        """The rows of keys (column key) whose line is in no run."""
        for run in self.runs():
            keys = keys.join(run.select("key"), "key", "left_anti")
        return keys

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds a batch: its lines that no earlier batch had become a run, the others are kept as seen again. Returns both; column fresh tells them apart."""
        own = batch.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))
        for i, run in enumerate(self.runs()):
            own = own.join(run.select("key", F.lit(True).alias(f"in_{i}")).hint("merge"), "key", "left")
        seen = [F.col(c).isNotNull() for c in own.columns if c.startswith("in_")]
        fresh = ~reduce(lambda a, b: a | b, seen) if seen else F.lit(True)
        name = self._write(own.select("key", "n_docs", "last_doc", fresh.alias("fresh")))
        self.batches.append(name)
        self.levels[0].append(name)
        for i in range(len(self.levels)):
            if len(self.levels[i]) >= self.fanout:
                self._compact(i)
        return self.spark.table(name)

    def _compact(self, level: int) -> None:
        """Merges the runs of a level, which have no key in common."""
        merged, *rest = [self.spark.table(n).filter("fresh").drop("fresh") for n in self.levels[level]]
        for run in rest:  # equal buckets: a merge join without a shuffle
            both = merged.join(run.select("key", F.col("n_docs").alias("n"), F.col("last_doc").alias("last")).hint("merge"), "key", "full")
            merged = both.select("key", F.coalesce("n_docs", "n").alias("n_docs"), F.coalesce("last_doc", "last").alias("last_doc"))
        if level + 1 == len(self.levels):
            self.levels.append([])
        self.levels[level + 1].append(self._write(merged.withColumn("fresh", F.lit(True))))
        self.levels[level] = []

    def _batches(self) -> DataFrame:
        # Files, not tables: a union of bucketed tables would count as dealt by key.
        return self.spark.read.schema("key string, n_docs long, last_doc long, fresh boolean").parquet(*(self.paths[n] for n in self.batches))

    def total(self) -> int:
        """The sum of n_docs over all keys."""
        return (self._batches().agg(F.sum("n_docs")).first()[0] or 0) if self.batches else 0

    def totals(self, least: int = 1) -> DataFrame:
        """key, n_docs, last_doc over all batches, of keys that at least `least` documents hold."""
        again = self._batches().filter("NOT fresh").groupBy("key").agg(F.sum("n_docs").alias("n"), F.max("last_doc").alias("last"))
        again = self.spark.table(self._write(again))
        out = []
        for run in self.runs():
            both = run.join(again.hint("merge"), "key", "left")
            both = both.select("key", (F.col("n_docs") + F.coalesce("n", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "last").alias("last_doc"))
            out.append(both.filter(F.col("n_docs") >= least))
        return reduce(DataFrame.unionAll, out)

    def forget(self) -> None:
        """Drops the names of all tables written (their files stay in the scratch folder)."""
        for name in self.paths:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels, self.batches, self.paths = [[]], [], {}


def common_lines(keyed: DataFrame, min_docs: int, batch_lines: int, least_batches: int, fanout: int) -> tuple[DataFrame, int]:
    """key, n_docs, last_doc of the keys that min_docs documents hold (keyed: doc_id, row, keys), and how many (document, key) rows there are."""
    spark = keyed.sparkSession
    lines = keyed.agg(F.sum(F.size("keys"))).first()[0] or 0
    n = max(least_batches, -(-lines // batch_lines))
    path = scratch_path(spark, "line-batches")
    parts = keyed.select("doc_id", F.array_compact(F.array_distinct("keys")).alias("keys"), F.pmod(F.xxhash64("row"), F.lit(n)).cast("int").alias("batch"))
    parts.write.partitionBy("batch").parquet(path)
    parts = spark.read.schema(parts.schema).parquet(path)
    runs = LineRuns(spark, fanout)
    try:
        for i in range(n):
            runs.add(parts.filter(F.col("batch") == i).select("doc_id", F.explode("keys").alias("key")))
        return stored(runs.totals(min_docs), "line-common"), runs.total()
    finally:
        runs.forget()


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batch_lines: int = 100_000_000, least_batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs with lines dropped from text that at least min_docs documents share, and with n_lines and n_dropped.

    A line's key is the line without white space at its ends, A-Z lower-cased; keys of under min_chars code points never
    count. A shared line stays in the document of the largest doc_id that holds it, in all its places there.
    A null text counts as one empty line and comes back as an empty text. Each row is a document: repeated rows count
    each, and rows that share the largest doc_id all keep the line. A null doc_id is smaller than any other; if no
    holder has an id, all keep the line. Columns of docs named n_lines or n_dropped are replaced. Documents come in batches of about
    batch_lines lines, least_batches at least. Lines that a ten-thousandth of all (document, line) rows hold, 10,000 at most, are
    known to every task; so no line's rows meet in one.
    """
    docs = docs.drop(*NEW)
    row = F.xxhash64("doc_id", "text")
    keyed = docs.select("doc_id", row.alias("row"), line_keys(F.col("text"), min_chars).alias("keys"))
    keyed = stored(keyed.filter(F.exists("keys", lambda k: k.isNotNull())), "line-keys")
    common, total = common_lines(keyed, min_docs, batch_lines, least_batches, fanout)

    held = keyed.select("doc_id", "row", F.posexplode("keys").alias("at", "key")).filter(F.col("key").isNotNull())
    hot = F.col("n_docs") * HOT >= total
    often = F.broadcast(common.filter(hot).select("key", "last_doc"))
    rest = held.join(often.select("key"), "key", "left_anti").join(common.filter(~hot).select("key", "last_doc"), "key")
    lost = held.join(often, "key").unionByName(rest).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")) & F.col("last_doc").isNotNull())
    lost = lost.groupBy("row", "doc_id").agg(F.collect_set("at").alias("__lost")).select(F.col("row").alias("__row"), F.col("doc_id").alias("__doc_id"), "__lost")
    out = docs.withColumn("__of", row)
    out = out.join(lost.hint("shuffle_hash"), (F.col("__of") == F.col("__row")) & F.col("doc_id").eqNullSafe(F.col("__doc_id")), "left")
    lines, kept = F.col("__lines"), F.col("__kept")
    out = out.withColumn("__lines", lines_of(F.col("text")))
    out = out.withColumn("n_lines", F.size(lines).cast("long"))
    out = out.withColumn("n_dropped", F.coalesce(F.size("__lost"), F.lit(0)).cast("long"))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__lost"))
    out = out.withColumn("__kept", F.when(F.col("n_dropped") > 0, left))
    text = F.when(F.col("n_dropped") == 0, F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    return out.withColumn("text", text).select(*docs.columns, *NEW)


OP1_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l),
c AS (
  SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (
  SELECT k.doc_id, pos, line, c.key IS NOT NULL AND k.doc_id <> c.last_doc AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
