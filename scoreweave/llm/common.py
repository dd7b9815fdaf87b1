"""What the operators share: intermediate tables and word scanning."""

from __future__ import annotations

import contextlib
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writes, _before = threading.Lock(), 0, None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder stands in, which only a local master may use.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/scoreweave/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _files_cleaned(conf):
    """Shuffle files go with their query meanwhile; the session's setting comes back with the last of several writes at once."""
    global _writes, _before
    with _lock:
        _writes += 1
        if _writes == 1:
            _before = conf.get(_CLEANUP, None)
            conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _lock:
            _writes -= 1
            if not _writes:
                conf.unset(_CLEANUP) if _before is None else conf.set(_CLEANUP, _before)


_BATCHES = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")


@contextlib.contextmanager
def few_rows_at_once(spark: SparkSession, rows: int = 4):
    """Tables with rows of megabytes are read and sent to Python by few rows meanwhile, whatever a file or partition holds.

    Only what runs inside is bounded, so a result that is read later must be written here.
    """
    before = {key: spark.conf.get(key, None) for key in _BATCHES}
    try:
        for key in _BATCHES:
            spark.conf.set(key, str(rows))
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives lost executors.

    The write's shuffle files go when it ends, so that a chain of such tables never holds two steps' files.
    """
    path = new_path(df.sparkSession, name)
    with _files_cleaned(df.sparkSession.conf):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Remove the table behind a result of written(), once nothing reads it any more."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        path = spark._jvm.org.apache.hadoop.fs.Path(file.rsplit("/", 1)[0])
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns that matter, under fixed names, so that other columns never clash. Null text: empty."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def crc32_mod(id_col, n: int):
    """crc32 of the id as decimal text, modulo n: the stated split into folds. A null id: fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % n, F.lit(0))
