"""A folder of documents as a stream: files that arrive become rows of the items relation, upserted by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.functions import text as T
from quarry.operators import chunking, sync

ITEMS = "batch long, mtime long, item_id long, source_type string, identifier string, text string, file_path string"


def files(spark: SparkSession, path: str, pattern: str = "*", per_batch: int = 1000) -> DataFrame:
    """file_path, content, mtime of files as they arrive; those that aren't UTF-8 are left out."""
    raw = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", per_batch)
        .load(path)
    )
    good = raw.where(F.is_valid_utf8(F.col("content").cast("string")))
    return good.select(F.col("path").alias("file_path"), F.col("content").cast("string").alias("content"), F.unix_timestamp("modificationTime").alias("mtime"))


def document_items(current: DataFrame) -> DataFrame:
    """mtime, item_id, source_type, identifier, text, file_path: a row for each chunk of each file."""
    chunks = chunking.chunks(current.select("file_path", F.col("content").alias("source"), T.extension(F.col("file_path")).alias("extension")))
    per_file = chunks.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    name = F.when(F.col("n") == 1, F.col("file_path")).otherwise(F.concat_ws("::", "file_path", F.col("ordinal").cast("string")))
    rows = chunks.join(per_file, "file_path").join(current.select("file_path", "mtime"), "file_path")
    rows = rows.select("mtime", F.lit("document").alias("source_type"), name.alias("identifier"), "text", "file_path")
    return rows.select("mtime", sync.item_id("source_type", "identifier").alias("item_id"), "source_type", "identifier", "text", "file_path")


def watch(spark: SparkSession, path: str, table: str, checkpoint: str, pattern: str = "*") -> StreamingQuery:
    """Takes what has arrived in a folder into the Parquet table at `table`, and ends; run again, it goes on from there.

    A batch that is repeated after a failure replaces its own part of the table, so nothing is there twice.
    """

    def take(batch: DataFrame, number: int) -> None:
        document_items(batch).write.mode("overwrite").parquet(f"{table}/batch={number}")

    return files(spark, path, pattern).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def items(spark: SparkSession, table: str) -> DataFrame:
    """The table's items: of each file, the chunks of its last batch."""
    rows = spark.read.schema(ITEMS).parquet(table)
    last = rows.groupBy(F.col("file_path").alias("__path")).agg(F.max("batch").alias("__last"))
    return rows.join(last, (F.col("file_path") == F.col("__path")) & (F.col("batch") == F.col("__last"))).drop("__path", "__last", "batch")
