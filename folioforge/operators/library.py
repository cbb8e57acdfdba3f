"""The object library: listing with status, what is still to be extracted, drafts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K


def uploads(objects: DataFrame) -> DataFrame:
    return objects.filter(F.col("key").startswith("uploads/") & F.lower("key").rlike(r"\.(docx|pdf)$"))


def library_listing(objects: DataFrame) -> DataFrame:
    """Uploads with their file name and whether their HTML exists."""
    ready = objects.filter(F.col("key").startswith("converted/")).select(F.col("key").alias("_key")).distinct().withColumn("_ready", F.lit(True))
    named = uploads(objects).select("key", "last_modified", K.file_name(F.col("key")).alias("name"), K.converted_html_key(F.col("key")).alias("_key"))
    return named.join(ready, "_key", "left").select("key", "name", "last_modified", F.when(F.col("_ready"), "ready").otherwise("pending").alias("status"))


def newest(listing: DataFrame, n: int | None = None) -> DataFrame:
    ordered = listing.orderBy(F.col("last_modified").desc_nulls_last(), "key")
    return ordered if n is None else ordered.limit(n)


def pending_extractions(objects: DataFrame, force: bool = False) -> DataFrame:
    """Uploads without a stored result (all with ``force``)."""
    key = F.when(F.lower("key").endswith(".pdf"), K.pdf_model_key(F.col("key"))).otherwise(K.extracted_fields_key(F.col("key")))
    wanted = uploads(objects).select("key", key.alias("result_key"))
    return wanted if force else wanted.join(objects.select(F.col("key").alias("result_key")), "result_key", "left_anti").select("key", "result_key")


def latest_draft(drafts: DataFrame) -> DataFrame:
    """The last saved draft of each title."""
    return drafts.groupBy("title").agg(F.max_by("html", F.struct("ts", "draft_id")).alias("html"), F.max("ts").alias("ts"))
