"""A folder of BibTeX files as a stream: each file is checked once, when it appears."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from refsift.operators.reporting import result_json, running_counts
from refsift.shared import scratch, stored
from refsift.sources.bibtex import entries_of

FILES_DDL = "value string"


def arriving_entries(spark: SparkSession, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """A streaming frame of texts (file, text) of the .bib files in a folder."""
    reader = spark.readStream.schema(FILES_DDL).option("wholetext", True).option("pathGlobFilter", "*.bib")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.text(folder).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def events(results: DataFrame) -> DataFrame:
    """position and json: a start, every result in key order, and a summary with the count of each status."""
    total = results.agg(F.count("*").alias("total"))
    start = total.select(F.lit(0).cast("long").alias("position"), F.to_json(F.struct(F.lit("start").alias("event"), "total")).alias("json"))
    order = running_counts(results).select("key", F.col("index").cast("long").alias("position"))
    each = result_json(results).join(order, "key").select("position", F.concat(F.lit('{"event":"result","index":'), F.col("position").cast("string"), F.lit(',"result":'), "json", F.lit("}")).alias("json"))
    counts = results.groupBy("status").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "n")))).alias("counts"))
    end = counts.join(total).select((F.col("total") + 1).alias("position"), F.to_json(F.struct(F.lit("summary").alias("event"), "counts", "total")).alias("json"))
    return start.unionByName(each).unionByName(end)


def watch(spark: SparkSession, folder: str, check: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str, files_per_batch: int | None = None) -> StreamingQuery:
    """Run check(entries) on each batch of new files and hand its results to sink(results, batch).

    The batch number goes along, so that a sink can tell a batch that runs again after a failure. Keys of different
    files are kept apart by the file's name before them.
    """

    def batch(texts: DataFrame, number: int) -> None:
        with scratch(spark):  # what a batch leaves in the shared folder goes with it
            entries = stored(entries_of(texts).select(F.concat_ws("#", "file", "key").alias("key"), "entry_type", "fields"))
            sink(check(entries), number)

    return arriving_entries(spark, folder, files_per_batch).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def second_pass(results: DataFrame, entries: DataFrame) -> DataFrame:
    """The entries that are still unconfirmed, to be checked against more sources."""
    return entries.join(results.filter(F.col("status") == "unconfirmed").select("key"), "key", "left_semi")


def replaced(results: DataFrame, second: DataFrame) -> DataFrame:
    """Results with those of a second pass in the place of the first ones; an entry that it gave no result keeps its own."""
    return results.join(second.select("key").distinct(), "key", "left_anti").unionByName(second)
