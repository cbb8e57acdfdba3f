"""Best-two-fit packing of documents into sequences of a fixed length.

Texts are encoded where they are; only rows of numbers move.  Documents longer than a sequence are cut.  Pieces are
dealt at random to groups of bounded expected size, and each group is packed by itself: fill a sequence greedily with
the longest piece that fits; while a gap is left, take out its smallest piece and put in two unpacked ones that fill
the expanded gap more tightly.  The group count follows the piece count, so a group's memory is bounded, and what
grouping loses is at most a partly filled sequence or so for each group.

A piece's group comes from its place in the stored table too, so that many equal rows are spread over all groups.

Null text: only the end id, one piece of length 1.  Null or repeated doc_id: rows like any others, each packed.  Very
long texts: as many pieces as they need.  Pieces of one length are interchangeable.  Empty table: no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stored, table
from .tokens import encoder, slices

LENGTH = 2048
END = 0
#: Pieces that a group has on average.
GROUP = 40_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_pieces(docs: DataFrame, tokenizer: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """doc_id, piece, start, length and ids_crc32 of every document's pieces."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last = encoder(tokenizer), np.array([end], "<u4").tobytes()
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1)
            for i, j in slices(pa.compute.binary_length(column).to_pylist(), 1_000_000):
                rows = []
                for doc_id, coded in zip(ids[i:j], known.encode(column.slice(i, j - i).to_pylist()), strict=True):
                    coded += last
                    for piece, at in enumerate(range(0, len(coded), 4 * length)):
                        some = coded[at : at + 4 * length]
                        rows.append((doc_id, piece, at // 4, len(some) // 4, zlib.crc32(some)))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return map_batches(keyed, cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_two_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of every piece; pieces of one length are interchangeable."""
    left = np.bincount(lengths, minlength=size + 1).tolist()
    have = sum(1 << x for x, n in enumerate(left) if n)  # bit x: an unpacked piece of length x

    def take(x: int) -> None:
        nonlocal have
        left[x] -= 1
        if not left[x]:
            have &= ~(1 << x)

    def give(x: int) -> None:
        nonlocal have
        left[x] += 1
        have |= 1 << x

    def longest(most: int) -> int:
        return (have & ((2 << most) - 1)).bit_length() - 1 if most > 0 else -1

    def two(gap: int, least: int) -> tuple[int, int] | None:
        """Two unpacked pieces of ``least`` to ``gap`` together, as much as can be had."""
        best, found, a = least - 1, None, longest(gap - 1)
        while a > 0 and 2 * a > best:
            b = longest(min(a, gap - a))
            if b == a and left[a] < 2:
                b = longest(a - 1)
            if b > 0 and a + b > best:
                best, found = a + b, (a, b)
                if best == gap:
                    break
            a = longest(a - 1)
        return found

    bins: list[list[int]] = []
    while have:
        own, gap = [], size
        while (x := longest(gap)) > 0:
            take(x)
            own.append(x)
            gap -= x
        while gap and len(own) > 1 and (pair := two(gap + own[-1], own[-1] + 1)):
            give(own[-1])
            gap += own.pop() - sum(pair)
            for x in pair:
                take(x)
            own = sorted([*own, *pair], reverse=True)
        bins.append(own)
    flat = np.array([x for own in bins for x in own], np.int64)
    number = np.repeat(np.arange(len(bins)), [len(own) for own in bins])
    start = np.cumsum(flat) - flat
    offset = start - np.repeat(start[np.cumsum([0, *map(len, bins)])[:-1]], [len(own) for own in bins]) if len(bins) else start
    sequence, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rows, slots = np.argsort(lengths, kind="stable"), np.argsort(flat, kind="stable")
    sequence[rows], place[rows] = number[slots], offset[slots]
    return sequence, place


def pack(pieces: DataFrame, size: int = LENGTH, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to a stored table of pieces."""
    n = max(1, round(pieces.count() / group))
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "_row"), F.lit(n))).drop("_row")

    def packed(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], kind="stable").reset_index(drop=True)
        sequence, offset = best_two_fit(rows["length"].to_numpy(), size)
        return rows.drop(columns="_group").assign(sequence_id=sequence + (int(rows["_group"].iloc[0]) << 40), offset=offset)

    return dealt.groupBy("_group").applyInPandas(packed, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, size: int = LENGTH) -> DataFrame:
    pieces = token_pieces(docs, tokenizer or default_path(), size).withColumn("_row", F.monotonically_increasing_id())
    return pack(stored(pieces, "pieces"), size)


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
