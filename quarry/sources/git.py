"""Version control as DataFrames: commits and tracked files, through the git command."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COMMITS = "sha string, short_hash string, author_name string, time string, message_title string, message_body string"
FILES = "file_path string, content string, mtime long, error string"
#: Extensions, and names without one, of documents.
DOCUMENTS, NAMED = ("md", "markdown", "txt", "text", "rst", "adoc"), ("readme", "license")


class GitError(RuntimeError):
    """There is no repository, or no commit."""


def _git(repo: str, *args: str) -> str:
    run = subprocess.run(["git", "-C", repo, *args], capture_output=True)
    if run.returncode:
        raise GitError(run.stderr.decode(errors="replace").strip())
    return run.stdout.decode(errors="replace")


def root(repo: str) -> str:
    return _git(repo, "rev-parse", "--show-toplevel").strip()


def commits(spark: SparkSession, repo: str, all_branches: bool = False) -> DataFrame:
    """Each commit that HEAD, or any local branch, leads to, newest first; without branches, of HEAD."""
    tips = ["--branches"] if all_branches and _git(repo, "for-each-ref", "refs/heads").strip() else ["HEAD"]
    out = _git(repo, "log", "--date-order", "--date=format:%a %b %d %Y %H:%M:%S %z", "--format=%H%x1f%h%x1f%an%x1f%ad%x1f%B%x1e", *tips)
    rows = [x.lstrip("\n").split("\x1f", 4) for x in out.split("\x1e") if x.strip()]
    return spark.createDataFrame([(*r[:4], *_message(r[4])) for r in rows], COMMITS)


def _message(text: str) -> tuple[str, str]:
    """A message's first line, and what follows the blank lines after it."""
    title, _, body = text.partition("\n")
    return title.removesuffix("\r"), body.lstrip("\r\n").rstrip("\n")


def tracked(spark: SparkSession, repo: str, kind: str, known: dict[str, int] | None = None) -> DataFrame:
    """file_path, content, mtime, error of HEAD's files of a kind ("code" or "document"), as the work tree has them.

    Files that are gone there are left out. One that can't be read, or isn't UTF-8, has an error and no
    content. A file whose time is the known one isn't opened: it has neither.
    """
    rows = []
    top = root(repo)
    for path in _git(top, "ls-tree", "-r", "-z", "--name-only", "HEAD").split("\0"):
        name = os.path.basename(path)
        stem, dot, ext = name.rpartition(".")
        wanted = path.endswith(".rs") if kind == "code" else (ext.lower() in DOCUMENTS if dot else name.lower() in NAMED)
        at = os.path.join(top, path)
        if not path or not wanted or not os.path.lexists(at):
            continue
        mtime = None
        try:
            mtime = int(os.stat(at).st_mtime)
            if known and known.get(path) == mtime:
                rows.append((path, None, mtime, None))
                continue
            with open(at, encoding="utf-8", newline="") as f:
                rows.append((path, f.read(), mtime, None))
        except (OSError, UnicodeDecodeError) as e:
            rows.append((path, None, mtime, str(e)))
    return spark.createDataFrame(rows, FILES)


def listed(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """The same columns from any folder that Spark reads, in parallel: for trees too large for the driver."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    good = raw.where(F.is_valid_utf8(F.col("content").cast("string")))
    return good.select(F.col("path").alias("file_path"), F.col("content").cast("string").alias("content"), F.unix_timestamp("modificationTime").alias("mtime"))
