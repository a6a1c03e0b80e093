"""Streaming ingest: files that land in a folder become documents, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators.store import Store
from quillon.sources.files import checked

SCHEMA = "path string, modificationTime timestamp, length long, content binary"
#: How late a copy of a file may land and still be known in the stream's state; older copies meet the stored table.
LATE = "1 hour"


def stream(spark: SparkSession, folder: str, late: str = LATE) -> DataFrame:
    """Sound files with their ids; copies within the watermark are dropped here, and state older than it is let go."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).option("pathGlobFilter", "*.{pdf,PDF}").load(folder)
    rows = checked(files).filter("status = 'ok'").withColumnRenamed("length", "n_bytes").withColumnRenamed("modification_time", "landed_at")
    return rows.withWatermark("landed_at", late).dropDuplicatesWithinWatermark(["document_id"])


def start(spark: SparkSession, folder: str, checkpoint: str, use: Callable[[DataFrame, int], None], late: str = LATE, once: bool = True):
    """use(batch, number) for each micro-batch; once: what is there now, then stop."""
    writer = stream(spark, folder, late).writeStream.foreachBatch(use).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def into(store: Store) -> Callable[[DataFrame, int], None]:
    """Upserts a batch's documents; a batch that runs again changes nothing, and known contents stay as they are."""

    def use(batch: DataFrame, number: int) -> None:
        rows = batch.select("document_id", "filename", "path", "n_bytes", F.col("landed_at").alias("created_at"))
        known = store.table("documents")
        if known is not None:
            rows = rows.join(known.select("document_id"), "document_id", "left_anti")
        rows = rows.dropDuplicates(["document_id"]).persist()
        if not rows.isEmpty():
            none = batch.sparkSession.createDataFrame([], "element_id string, document_id string, kind string, text string, summary string, image_path string, caption string")
            store.add(rows, none)
        rows.unpersist()

    return use


def run_once(spark: SparkSession, folder: str, store: Store, checkpoint: str) -> None:
    """Take in what is there, then stop; a later call takes in only what is new."""
    start(spark, folder, checkpoint, into(store)).awaitTermination()
