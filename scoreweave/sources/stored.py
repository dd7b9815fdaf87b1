"""Tables stored by partition, changed by copy-on-write: only the partitions that a change touches are written again.

A table is a folder of Parquet partitions by the column part, which the caller's rule gives each row (a
range of batch ids, say), so that rows that change together lie together and files stay large. A change
marks the rows to drop; the touched partitions are read, and written again by dynamic partition overwrite,
with the number of dropped rows observed by that same job. A partition that is left without rows is
deleted after that. A change that breaks off in between can simply be made again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from scoreweave.operators import maintain as M
from scoreweave.sources.work import work_folder

PART = "part"


def by_range(key: str, size: int) -> Column:
    """The rule of a table whose partitions hold so many ids each."""
    return F.floor(F.col(key) / size).cast("long")


class StoredTable:
    """One table in a folder; part: the rule of its partitions."""

    def __init__(self, spark: SparkSession, path: str, part: Column):
        self.spark, self.path, self._part = spark, path, part

    def create(self, rows: DataFrame) -> StoredTable:
        self._write(rows.withColumn(PART, self._part), "static")
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop(PART)

    def parts_of(self, rows: DataFrame) -> list[int]:
        """The partitions that hold rows with these keys; there are never more than the table has."""
        return sorted(r[0] for r in rows.select(self._part.alias(PART)).distinct().collect() if r[0] is not None)

    def rewrite(self, parts: list[int], change: Callable[[DataFrame], DataFrame]) -> int:
        """Puts change(rows) in place of the rows of these partitions; how many rows it hit.

        change keeps a row's partition and adds _hit (true, false or null): those that it hit go where
        _drop is true as well, the others stay. Other partitions' files are not touched.
        """
        before = {p: names for p, names in self._files().items() if p in parts}
        if not before:
            return 0
        seen, hit = Observation(), F.coalesce("_hit", F.lit(False))
        changed = change(self.spark.read.parquet(self.path).where(F.col(PART).isin(list(before))))
        rows = changed.observe(seen, F.count_if(hit).alias("n"))
        drop = hit & F.coalesce("_drop", F.lit(False)) if "_drop" in rows.columns else F.lit(False)
        self._write(rows.where(~drop).drop("_hit", "_drop"), "dynamic")
        after = self._files()
        emptied = [folder for p, (folder, names) in before.items() if after[p][1] == names]  # written without a row: the old files are still there
        # A write of no row at all may have been planned away, and the observation with it; then all old files are there to count.
        n = changed.where(hit).count() if len(emptied) == len(before) else int(seen.get["n"])
        for folder in emptied:
            self._fs().delete(self.spark._jvm.org.apache.hadoop.fs.Path(folder), True)
        return n

    def drop(self, parts: list[int], keys: DataFrame) -> int:
        """Drops the rows of these partitions that have one of the keys (all columns of keys); how many."""
        marked = keys.distinct().withColumns({"_hit": F.lit(True), "_drop": F.lit(True)})
        return self.rewrite(parts, lambda rows: rows.join(marked, keys.columns, "left").select(*rows.columns, "_hit", "_drop"))

    def _write(self, rows: DataFrame, mode: str) -> None:
        rows.repartition(PART).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(PART).parquet(self.path)

    def _fs(self):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _files(self) -> dict[int, tuple[str, frozenset[str]]]:
        """The folder of each partition and the names of its files."""
        files, paths = self._fs(), self.spark._jvm.org.apache.hadoop.fs.Path
        folders = [s.getPath() for s in files.listStatus(paths(self.path)) if s.isDirectory()]
        own = [p for p in folders if p.getName().removeprefix(f"{PART}=").removeprefix("-").isdigit()]
        return {int(p.getName().partition("=")[2]): (p.toString(), frozenset(s.getPath().getName() for s in files.listStatus(p))) for p in own}


class GradingStore:
    """batches, results and scores (with batch_id) in stored tables of the same batch ranges, under one folder."""

    def __init__(self, spark: SparkSession, folder: str, batches_per_part: int = 1000):
        rule = by_range("batch_id", batches_per_part)
        self.batches, self.results, self.scores = (StoredTable(spark, f"{folder}/{n}", rule) for n in ("batches", "results", "scores"))

    def create(self, batches: DataFrame, results: DataFrame, scores: DataFrame) -> GradingStore:
        """scores without batch_id get that of their result."""
        own = scores if "batch_id" in scores.columns else scores.join(results.select("result_id", "batch_id"), "result_id")
        for stored, rows in ((self.batches, batches), (self.results, results), (self.scores, own)):
            stored.create(rows)
        return self

    def clear_batches(self, batches: DataFrame) -> dict[str, int]:
        """Scores and results of the given batches (batch_id) go; how many of each went. Again, it does nothing."""
        ids = batches.select("batch_id").where("batch_id is not null").distinct()
        parts = self.results.parts_of(ids)
        return {"scores": self.scores.drop(parts, ids), "results": self.results.drop(parts, ids)}  # scores first, so that a run again finds the rest

    def delete_exams(self, exams: DataFrame) -> dict[str, int]:
        """Batches of the given exams (exam_id) go with their results and scores; how many of each went."""
        ids = exams.select("exam_id").where("exam_id is not null").distinct()
        batches = _settled(self.batches.read().join(ids, "exam_id", "left_semi").select("batch_id"), "exam-batches")
        return self.clear_batches(batches) | {"batches": self.batches.drop(self.batches.parts_of(batches), ids)}

    def unlink_students(self, students: DataFrame) -> int:
        """Results lose the given students (student_id); in how many results. Only partitions with such results are written."""
        ids = students.select("student_id").where("student_id is not null").distinct()
        parts = self.results.parts_of(self.results.read().join(ids, "student_id", "left_semi"))
        marked = ids.withColumn("_hit", F.lit(True))

        def change(rows: DataFrame) -> DataFrame:
            out = rows.join(marked, "student_id", "left").withColumn("student_id", F.when(F.col("_hit").isNull(), F.col("student_id")))
            return out.select(*rows.columns, "_hit")

        return self.results.rewrite(parts, change)

    def reprocess(self, requests: DataFrame, transitions: dict[str, str] = M.REPROCESS) -> DataFrame:
        """Requests (batch_id, exam_id) with their outcome; batches that are reset are PENDING without pages, results and scores.

        A batch that was asked for twice, with the right and another exam, is reset once and refused once.
        """
        held = self.batches.read().select("batch_id", "status", F.col("exam_id").alias("_exam"))
        outcome = M.reprocess_outcome(F.col("status"), transitions, F.col("_exam"), F.col("exam_id"))
        answered = _settled(requests.select("batch_id", "exam_id").distinct().join(held, "batch_id").withColumn("outcome", outcome).drop("status", "_exam"), "reprocess")
        reset = answered.where("outcome = 'reset'").select("batch_id").distinct()
        self.clear_batches(reset)
        marked = reset.withColumn("_hit", F.lit(True))

        def change(rows: DataFrame) -> DataFrame:
            out = rows.join(marked, "batch_id", "left")
            now = {"status": F.when(F.col("_hit"), "PENDING").otherwise(F.col("status")), "total_pages": F.when(F.col("_hit"), 0).otherwise(F.col("total_pages"))}
            return out.withColumns({c: v.cast(rows.schema[c].dataType) for c, v in now.items()}).select(*rows.columns, "_hit")

        self.batches.rewrite(self.batches.parts_of(reset), change)
        return answered


def _settled(rows: DataFrame, name: str) -> DataFrame:
    """rows written down, so that later changes of the tables they come from leave them as they are."""
    path = work_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
