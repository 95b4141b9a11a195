"""Folders that a cluster shares, and full-text indexes of tables, built once an application."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

from quarry.operators import postings

_BUILT: dict[tuple, str] = {}
_LOCAL: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir.

    Where that is unset, a local master gets a temporary folder that goes with the process; on a cluster
    that would be a folder of one machine, so there it is an error.
    """
    if folder := spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir():
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="quarry-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


def path_of(spark: SparkSession, path: str):
    """A path, and the file system that has it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _state(spark: SparkSession, path: str) -> tuple[int, int]:
    p, fs = path_of(spark, path)
    return fs.getFileStatus(p).getModificationTime(), fs.getContentSummary(p).getLength()


def indexed(spark: SparkSession, name: str, files: list[str], items: DataFrame, **how) -> str:
    """Where the postings of items are; built when this application first asks, or files have changed since.

    Failed builds leave nothing that a later call would read: a path is remembered once it is whole.
    """
    key = (spark.sparkContext.applicationId, name, *[(f, *_state(spark, f)) for f in files])
    if key not in _BUILT:
        path = f"{shared_dir(spark)}/quarry-index-{spark.sparkContext.applicationId}/{name}-{len(_BUILT)}"
        postings.write(items, path, **how)
        _BUILT[key] = path
    return _BUILT[key]
