"""Token ids in ORC files: stripes with integer run-length encoding, row indexes and Bloom filters on document ids.

Documents are range partitioned and sorted by doc_id, encoded where they are, and written as one row each
(doc_id, part, local_start, n_tokens, ids).  ORC stores the ids run-length encoded, an index entry for each stride of rows
and a Bloom filter on doc_id, so that a reader splits files by stripes and skips stripes and strides that lack an id.
A document's place in the whole stream is its place in its part plus the ids of all parts before.

Ranges are cut by doc_id, checksum and size of the text, so that many rows of one id or without id are several ranges.

Null text: only the end id.  Null doc_id: first.  Rows with equal doc_id: neighbours, in order of their text's
checksum and size; rows equal in all three are interchangeable.  A very long text is one row of ids.  No rows: no
result.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_batches, scratch_path, table
from .tokens import encoder, slices

END = 0
FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"
#: Options of the ORC writer.
ORC = {"compression": "zstd", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "1000", "orc.stripe.size": str(16 << 20)}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end: int = END) -> None:
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    order = ["doc_id", F.crc32("text"), F.octet_length("text")]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, part, at = encoder(tokenizer), np.array([end], "<u4").tobytes(), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            for i, j in slices(pa.compute.binary_length(column).to_pylist(), 1_000_000):
                coded = known.encode(column.slice(i, j - i).to_pylist())
                sizes = np.array([len(x) // 4 + 1 for x in coded], np.int64)
                ends = np.cumsum(sizes)
                values = np.frombuffer(last.join([*coded, b""]), "<i4")
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(values))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i), pa.array(np.full(j - i, part, np.int32)), pa.array(at + ends - sizes), pa.array(sizes), lists], schema=schema)
                at += int(ends[-1])

    map_batches(ordered, encode, FILE_SCHEMA).write.options(**ORC).orc(path)


def read_token_files(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """All rows of the files, or those of some documents; the filter reaches ORC's statistics and Bloom filters."""
    rows = spark.read.schema(FILE_SCHEMA).orc(path)
    return rows if ids is None else rows.filter(F.col("doc_id").isin(ids))


def document_digests(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document in the files."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(4)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False).astype("<i4", copy=False)
            crcs = [zlib.crc32(values[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]  # of the ids read, not of what was encoded
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(crcs, pa.int64())], names=["doc_id", "part", "local_start", "n_tokens", "ids_crc32"])

    digests = map_batches(rows.select("doc_id", "part", "local_start", "n_tokens", "ids"), digest, "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long")
    parts = rows.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.select("part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row per partition
    return digests.join(F.broadcast(offsets), "part").select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_files(table(spark, sf_dir, "documents"), path, default_path())
    return document_digests(read_token_files(spark, path))
