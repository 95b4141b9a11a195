"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side is broadcast; a larger side is shuffled instead.
BROADCAST_ROWS = 200_000

#: Characters that end a word: space, and tab to carriage return.
WORD_RE = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder that goes with the process; on a cluster
    that would be a folder of one machine, so there it is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quarry-checkpoint-")
        atexit.register(shutil.rmtree, folder, True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the shared folder.

    Spark drops the files with the last reference if spark.cleaner.referenceTracking.cleanCheckpoints is
    set; otherwise they stay until the folder is emptied. So only small or final tables are checkpointed.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet tables in the shared folder for steps that are consumed before an operator returns.

    As a context, drops them all at its end, also if a step fails.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
        self.paths: dict[DataFrame, str] = {}
        self.n = 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop()

    def table(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self.paths[table] = path
        return table

    def release(self) -> None:
        """Lets Spark delete shuffle files of steps that are done now, not when the driver next collects its garbage."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, table: DataFrame | None = None) -> None:
        """Deletes a table that nothing reads any more, or all of them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.paths.pop(table) if table is not None else self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint if df, which must be cheap to count, has at most so many narrow rows; else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Bounds the rows of an Arrow batch, for steps whose rows hold whole texts, while the context lasts."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def fold(column: str, modulus: int) -> Column:
    """crc32 of an id written as text, modulo a number: the remainder that decides on held-out rows."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus
