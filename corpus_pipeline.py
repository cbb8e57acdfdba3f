"""A training corpus in five stages: toxicity, near-duplicates, repeated strings, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``.

1.  toxicity: documents judged toxic go.
2.  near_dedup: of each group of near-duplicates the document with the least id stays.  Rows equal in id and text are
    one document.  Rows without an id, or with one that other texts have, too, are judged each by its own text, behind
    those with an id of their own.
3.  suffix_dedup: bytes of repeated 400-byte strings and of repeated passages of over 50 words are cut out of the
    texts; no row goes, n_chars is counted anew.
4.  decontamination: documents that hold a benchmark item go.
5.  packing: what is left is encoded and packed into sequences; a row for each piece.

Null texts are never toxic, alike or contaminated and are packed as the end id alone.  An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.llm.common import broadcast_if_small, scratch, stored, table
from folioforge.llm.decontamination import decontaminate
from folioforge.llm.near_dup import near_duplicates
from folioforge.llm.packing import pack_documents
from folioforge.llm.suffix_dedup import without_repeats
from folioforge.llm.toxicity import without_toxic


#: Words of a passage that may not repeat.
PASSAGE_WORDS = 51
#: Keys from here on are those of rows that no id names.
OWN = 1 << 62


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("_n"), (F.min(F.xxhash64("text")) != F.max(F.xxhash64("text"))).alias("_several"))
    repeated = stored(ids.filter("_n > 1 and doc_id is not null").select("doc_id", F.coalesce("_several", F.lit(True)).alias("_several")), "repeated-ids")
    # Rows without an id, and those whose id other texts have, too, are nodes of their own, behind all ids.
    own = F.lit(OWN) + F.pmod(F.xxhash64("doc_id", "text"), F.lit(OWN))
    keyed = docs.join(broadcast_if_small(repeated), "doc_id", "left").withColumn("_node", F.when(F.col("doc_id").isNull() | F.coalesce("_several", F.lit(False)), own).otherwise(F.col("doc_id").cast("long")))
    gone = stored(near_duplicates(keyed.select(F.col("_node").alias("doc_id"), "text")).filter(~F.col("kept")).select(F.col("doc_id").alias("_node")).distinct(), "gone")
    kept = keyed.join(broadcast_if_small(gone), "_node", "left_anti")
    again = F.col("doc_id").isNull() | F.col("_several").isNotNull()  # rows that may be repeated
    return kept.filter(~again).unionByName(kept.filter(again).dropDuplicates(["_node"])).select(*docs.columns)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    left = without_repeats(docs, words=PASSAGE_WORDS)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("suffix_dedup", suffix_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Hash orders, tokenizers and a trained model are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as made:
            docs = stored(stage(spark, docs, sf_dir), name)
            made.pop()  # a stage's own tables go once its output is stored
    return docs
