"""Structured Streaming twins of the edit and upload operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import patches
from ..sources.keyed import write_keyed
from .progress import ROCKSDB, fill_progress_stream


def debounce_stream(edits: DataFrame, gap: str = "300 milliseconds", late: str = "1 minute") -> DataFrame:
    """Bursts of edits, emitted once the watermark has passed them; edits later than ``late`` are dropped."""
    return patches.debounce_edits(patches.echo_filter(edits.withWatermark("ts", late)), gap)


def field_state_stream(edits: DataFrame) -> DataFrame:
    """Current value of each node; run it in update mode."""
    return patches.field_state(patches.echo_filter(edits))


def conversion_status(uploads: DataFrame, converted: DataFrame, within: str = "120 seconds", late: str = "1 minute") -> DataFrame:
    """An upload and its conversion within ``within``: ready, else timed out once the watermark has passed."""
    u = uploads.withWatermark("ts", late).select(F.col("key").alias("_key"), F.col("ts").alias("uploaded"))
    c = converted.withWatermark("ts", late).select(F.col("key").alias("_done"), F.col("ts").alias("converted"))
    near = (F.col("_key") == F.col("_done")) & F.expr(f"converted BETWEEN uploaded AND uploaded + INTERVAL {within}")
    return u.join(c, near, "left").select(F.col("_key").alias("key"), "uploaded", "converted", F.when(F.col("converted").isNull(), "timed out").otherwise("ready").alias("status"))


def stream_uploads(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame], DataFrame], out: str):
    """Each new object once: ``handle`` gets the batch of files.

    Where its result has a key and content, each row is stored at ``out``/key, so that a repeat, even one without the
    checkpoint, leaves each output once; other results are written by batch number.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(folder)

    def batch(rows: DataFrame, number: int) -> None:
        made = handle(rows)
        if {"key", "content"} <= set(made.columns):
            write_keyed(made, out)
        else:
            made.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_drafts(drafts: DataFrame) -> DataFrame:
    """title, html, ts and draft_id of the newest draft of each title, as keyed state of a stream in update mode (or of a table)."""
    newest = F.max_by(F.struct("html", "ts", "draft_id"), F.struct("ts", "draft_id"))
    return drafts.groupBy("title").agg(newest.alias("_r")).select("title", "_r.*")


def draft_key(title: Column) -> Column:
    """The key that a title's draft is stored at."""
    return F.concat(F.sha2(F.coalesce(title, F.lit("")), 256), F.lit(".html"))


def latest_draft_stream(drafts: DataFrame, checkpoint: str, out: str):
    """Keeps the newest draft of each title at its own key in ``out``; the stream's state holds one draft a title, and a batch writes those that changed."""
    drafts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)

    def batch(rows: DataFrame, number: int) -> None:
        write_keyed(rows.select(draft_key(F.col("title")).alias("key"), F.col("html").alias("content")), out)

    return latest_drafts(drafts).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_fill_progress(edits: DataFrame, fields: DataFrame, checkpoint: str, out: str):
    """Filled and all fields of the documents that a batch of edits touches, written by batch number.

    The last edit of each node is kept as keyed state (``progress``), so fills of earlier batches count; echoes of programmatic
    syncs do not.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return fill_progress_stream(edits, fields).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
