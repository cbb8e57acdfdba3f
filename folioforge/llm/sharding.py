"""Sharding by a Feistel permutation of global row numbers with cycle walking.

Rows get dense numbers in ascending order of doc_id (nulls first; ties by checksum and size, so that only rows
equal in all three are interchangeable).  A keyed Feistel network over the smallest even power of two that holds
the row count permutes them; values outside are walked on until they fall inside.  The place of a row then follows
from its number alone: ``shard = p mod shards`` and ``slot = p div shards``, and ``row_number_at`` computes the way back.

Null text: size 1, checksum of no bytes.  No rows: no result rows.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored, table

SHARDS = 8
SEED = 20_240_601
ROUNDS = 6


def _keys(seed: int) -> list[np.uint64]:
    return [np.uint64((seed * 0x9E3779B97F4A7C15 + (i + 1) * 0xD1B54A32D192ED03) % 2**64) for i in range(ROUNDS)]


def _round(half: np.ndarray, key: np.uint64, mask: np.uint64) -> np.ndarray:
    x = half + key
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) & mask


def _pass(x: np.ndarray, bits: int, keys: list[np.uint64], back: bool) -> np.ndarray:
    mask, width = np.uint64((1 << bits) - 1), np.uint64(bits)
    left, right = x >> width, x & mask
    if back:
        for key in reversed(keys):
            left, right = right ^ _round(left, key, mask), left
    else:
        for key in keys:
            left, right = right, left ^ _round(right, key, mask)
    return (left << width) | right


def permute(numbers: np.ndarray, n: int, seed: int = SEED, back: bool = False) -> np.ndarray:
    """The image of each number in 0..n-1 (its preimage with ``back``)."""
    bits = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    keys, x = _keys(seed), _pass(numbers.astype(np.uint64), bits, _keys(seed), back)
    while (out := x >= np.uint64(n)).any():
        x[out] = _pass(x[out], bits, keys, back)
    return x.astype(np.int64)


def row_number_at(shard: int, slot: int, n: int, shards: int = SHARDS, seed: int = SEED) -> int:
    """The global row number that sits in ``slot`` of ``shard``."""
    return int(permute(np.array([slot * shards + shard]), n, seed, back=True)[0])


def row_numbers(rows: DataFrame, by: list[str], name: str = "row_number") -> DataFrame:
    """Dense numbers from 0 in the order of ``by``, without one task seeing all rows.

    Rows are range partitioned and sorted; a partition's number and the place in it give the number once the
    partitions' sizes (one row each) are summed up.
    """
    mark = F.monotonically_increasing_id()
    ranged = stored(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_mark", mark), "ranged")
    part = F.shiftright("_mark", 33)
    sizes = ranged.groupBy(part.alias("_part")).count()
    before = F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))  # a row per partition
    number = F.col("_before") + F.col("_mark").bitwiseAND((1 << 33) - 1)
    return ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, number).drop("_part", "_mark", "_before")


def shard_rows(numbered: DataFrame, shards: int = SHARDS, seed: int = SEED, number: str = "row_number") -> DataFrame:
    """Adds shard and slot to rows that have dense numbers."""
    n = numbered.count()

    @F.pandas_udf("long")
    def place(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(permute(x.to_numpy(), n, seed))

    placed = numbered.withColumn("_place", place(number))
    return placed.withColumn("shard", (F.col("_place") % shards).cast("int")).withColumn("slot", F.expr(f"_place div {shards}")).drop("_place")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row_number, shard and slot of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    return shard_rows(row_numbers(stored(rows, "sizes"), ["doc_id", "text_crc32", "size"]), shards, seed)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
