"""Occupancy maps from a stream of sources: a versioned log of what changed, compacted now and then, and rebuilt when sources leave a map's window.

A batch's new sources change the voxels they touch; the log gets those voxels' new states under the batch's number. A map that loses sources is written anew from the
sources it keeps. Reading takes the newest state of each voxel since a map's last rebuild or compaction, so it costs what the map holds, not its history.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scanspark.operators.maps import VOXEL, free_votes

STATE = "map_id long, ix long, iy long, iz long, free_votes long, first_seq long, version long"
SOURCE = "map_id long, seq long, ix long, iy long, iz long, hit boolean, version long"
MARK = "map_id long, base long, sources_base long, seqs array<long>, last_seq long, version long"


@dataclass(frozen=True)
class OccupancyLog:
    """The log in a folder. keep: how many sources a map keeps (the newest; none: all, for good). every: batches between compactions.

    A batch has rows map_id, seq (of the source), ix, iy, iz and hit (whether a ray of the source ended in the voxel, or crossed it). Sources come in order of seq: one that is not above all
    of its map's earlier ones is integrated already and is left out. Batch numbers grow; a batch that comes again finds the log as it was and replaces what it wrote. Old versions
    are not deleted: give the folder a lifetime, or copy it by `state` and `sources`.
    """

    path: str
    keep: int | None = None
    every: int = 10

    def begin(self, spark: SparkSession) -> OccupancyLog:
        """Lays out the folder, if it is not there: to be called before the first batch or reader."""
        for what, schema in (("marks", MARK), ("voxels", STATE), ("sources", SOURCE)):
            spark.createDataFrame([], schema).drop("version").write.mode("ignore").parquet(f"{self.path}/{what}/version=-1")
        return self

    def _read(self, spark: SparkSession, what: str, schema: str, before: int | None = None, since: int | None = None) -> DataFrame:
        """The rows of a part of the log, of versions from since on and before the one given."""
        rows = spark.read.schema(schema).parquet(f"{self.path}/{what}")
        rows = rows if before is None else rows.filter(F.col("version") < before)
        return rows if since is None else rows.filter(F.col("version") >= since)

    def marks(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """The newest mark of each map: the version its state begins with, and the sources it holds."""
        rows = self._read(spark, "marks", MARK, before)
        return rows.groupBy("map_id").agg(F.max_by(F.struct(*(c.split(" ")[0] for c in MARK.split(", ")[1:])), "version").alias("m")).select("map_id", "m.*")

    def state(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """map_id, ix, iy, iz, free_votes, first_seq (of the first source that hit the voxel, or null) of all maps."""
        marks = self.marks(spark, before).select("map_id", "base")
        since = marks.agg(F.min("base")).first()[0]
        rows = self._read(spark, "voxels", STATE, before, since).join(marks, "map_id").filter("version >= base")
        newest = F.max_by(F.struct("free_votes", "first_seq"), "version").alias("s")
        return rows.groupBy(*VOXEL).agg(newest).select(*VOXEL, "s.*")

    def sources(self, spark: SparkSession, before: int | None = None) -> DataFrame:
        """map_id, seq, ix, iy, iz, hit of the sources that maps keep; with keep only."""
        marks = self.marks(spark, before).select("map_id", "sources_base", F.explode("seqs").alias("seq"))
        since = marks.agg(F.min("sources_base")).first()[0]
        rows = self._read(spark, "sources", SOURCE, before, since).join(marks, ["map_id", "seq"]).filter("version >= sources_base")
        return rows.select("map_id", "seq", "ix", "iy", "iz", "hit").distinct()

    def add(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch: folds a batch's sources into the log."""
        spark = batch.sparkSession
        marks = self.marks(spark, number).select("map_id", F.col("base").alias("old_base"), F.col("sources_base").alias("old_sources"), F.col("seqs").alias("old_seqs"), F.col("last_seq").alias("old_last"))
        marks = self._put(marks, f"work/marks-{number}")
        rows = batch.groupBy(*VOXEL, "seq").agg(F.max("hit").alias("hit"), F.min("hit").alias("__all"))
        rows = rows.join(marks.select("map_id", "old_last"), "map_id", "left").filter(F.col("old_last").isNull() | (F.col("seq") > F.col("old_last")))
        new = self._put(rows.select("map_id", "seq", "ix", "iy", "iz", "hit"), f"work/new-{number}")
        seen = new.groupBy("map_id").agg(F.collect_set("seq").alias("new_seqs"), F.max("seq").alias("new_last"))
        both = marks.join(seen, "map_id", "full").withColumn("all", F.array_sort(F.concat(*(F.coalesce(c, F.array().cast("array<long>")) for c in ("old_seqs", "new_seqs")))))
        kept = F.col("all") if self.keep is None else F.slice("all", F.greatest(F.size("all") - self.keep + 1, F.lit(1)), self.keep)
        both = both.select("map_id", "old_base", "old_sources", "all", kept.alias("seqs"), F.greatest("old_last", "new_last").alias("last_seq"), F.col("new_seqs").isNotNull().alias("touched"))
        # A map whose old sources go must be built anew; new sources that never stay only count as seen.
        both = self._put(both.withColumn("cut", F.size("seqs") < F.size("all")), f"work/cuts-{number}")
        whole = number % self.every == 0
        changed = self._merged(spark, new.join(both.filter("NOT cut").select("map_id"), "map_id"), number)
        if self.keep is not None:
            held = self.sources(spark, number).unionByName(new.select("map_id", "seq", "ix", "iy", "iz", "hit"))
            held = held.join(both.select("map_id", F.explode("seqs").alias("seq"), "cut"), ["map_id", "seq"])
            rebuilt = self._built(held.filter("cut"))
            changed = changed.unionByName(rebuilt)
            self._put(held.select("map_id", "seq", "ix", "iy", "iz", "hit") if whole else new, f"sources/version={number}")
        if whole:
            old = self.state(spark, number).join(both.filter("NOT cut").select("map_id"), "map_id")
            changed = self._put(changed, f"work/changed-{number}")
            changed = old.join(changed.select(*VOXEL), VOXEL, "left_anti").unionByName(changed)
        self._put(changed, f"voxels/version={number}")
        now = F.lit(number).cast("long")
        base = now if whole else F.when(F.col("cut"), now).otherwise(F.coalesce("old_base", now))
        sources_base = now if whole else F.coalesce("old_sources", now)
        seqs = F.array().cast("array<long>") if self.keep is None else F.col("seqs")
        self._put(both.select("map_id", base.alias("base"), sources_base.alias("sources_base"), seqs.alias("seqs"), "last_seq"), f"marks/version={number}")

    def _merged(self, spark: SparkSession, new: DataFrame, number: int) -> DataFrame:
        """The new states of the voxels that new rows touch: votes end with the first hit, and what was hit stays hit."""
        touched = new.select(*VOXEL).distinct()
        old = self.state(spark, number).join(touched, VOXEL)
        hits = new.filter("hit").groupBy(*VOXEL).agg(F.min("seq").alias("hit_seq"))
        first = touched.join(old, VOXEL, "left").join(hits, VOXEL, "left").select(*VOXEL, "free_votes", F.coalesce("first_seq", "hit_seq").alias("first_seq"))
        votes = free_votes(new.filter("NOT hit"), first.filter("first_seq IS NOT NULL").select(*VOXEL, "first_seq")).withColumnRenamed("free_votes", "more")
        total = F.coalesce("free_votes", F.lit(0)) + F.coalesce("more", F.lit(0))
        return first.join(votes, VOXEL, "left").select(*VOXEL, total.cast("long").alias("free_votes"), "first_seq")

    def _built(self, rows: DataFrame) -> DataFrame:
        """The states of maps from all rows of their sources."""
        hits = rows.filter("hit").groupBy(*VOXEL).agg(F.min("seq").alias("first_seq"))
        votes = free_votes(rows.filter("NOT hit"), hits)
        return votes.join(hits, VOXEL, "full").select(*VOXEL, F.coalesce("free_votes", F.lit(0)).cast("long").alias("free_votes"), "first_seq")

    def _put(self, rows: DataFrame, where: str) -> DataFrame:
        rows.write.mode("overwrite").parquet(f"{self.path}/{where}")
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{self.path}/{where}")
