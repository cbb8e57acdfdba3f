"""Cross-tokenizer alignment by a dictionary of token groups.

Both tokenizers encode each text; where a token of A and one of B end at the same byte, a group of tokens ends.  A text is
its groups in order, and the same few groups make up most texts, so links between tokens are found once for a group:

1.  A task reads its documents in blocks of about BLOCK characters.  Texts are cut into chunks that both tokenizers encode
    by themselves, each distinct chunk of a block is encoded once, and its groups get a number in the block's dictionary.
    Out come, for each document, its counts and its groups with their frequencies; the block's dictionary; and in how many
    of the block's documents each id pair is linked.
2.  Pair counts are summed over all blocks; the highest count of each A id is found.
3.  Each distinct group of the corpus is expanded into its links once; their counts, summed, are the group's figures.
4.  The figures go back to the blocks by group key, and meet the documents of their block, where they are multiplied by
    frequencies.  A group meets a block once, however often its documents have it.

Chunks.  No piece of B has a space after anything else, and A starts tokens at a space that follows no white space, so both
have token ends there.  Each chunk's tokens must spell it; where they do not, the text is encoded whole, and has no tokens
if that does not spell it either.

Null, empty or invalid text: zeros and ''.  Null doc_id: a row as any other.  Rows with equal doc_id or equal text: a row
each.  A very long text is one block.  No rows: no result.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_batches, stored, table, worker_cache
from .tokens import _BYTES, WHITE_SPACE

#: Characters of a block, about; and chunks that are encoded at a time.
BLOCK = 8_000_000
AT_ONCE = 4000
_CHUNK = re.compile(f" +(?:[^ ]*[{WHITE_SPACE.replace(' ', '')}] +)*[^ ]*")
_DOC, _GROUP, _PAIR = 0, 1, 2
_SCHEMA = pa.schema(
    [("kind", pa.int32()), ("block", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("sha", pa.string())]
    + [("numbers", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())), ("number", pa.int32()), ("key", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]
)
_DDL = "kind int, block long, doc_id long, n_a long, n_b long, n_groups long, n_links long, sha string, numbers array<int>, times array<int>, number int, key string, a int, b int, n long"
_COUNTS = ["n_a", "n_b", "n_groups", "n_links"]


class Pair:
    """The two tokenizers and the bytes of their ids."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        byte = {c: i for i, c in enumerate(_BYTES)}
        self.a_bytes = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        self.cuts = all(re.fullmatch("▁*[^▁]*", p) for p in pieces)

    def chunks(self, text: str) -> list[str]:
        return _CHUNK.findall(" " + text) if self.cuts else [" " + text]

    def encode(self, chunks: list[str]) -> Iterator[tuple[list[int], list[int]] | None]:
        """Ids of A and B of each chunk; None where they do not spell it."""
        for at in range(0, len(chunks), AT_ONCE):
            some = chunks[at : at + AT_ONCE]
            a = [e.ids for e in self.a.encode_batch(some, add_special_tokens=False)]
            b = self.b.encode([c[1:] for c in some], num_threads=1)  # it adds the space
            for chunk, x, y in zip(some, a, b, strict=True):
                raw = chunk.encode()
                spelt = b"".join([self.a_bytes[i] for i in x]) == raw == b"".join([self.b_bytes[i] for i in y])
                yield (x, y) if spelt else None

    def links(self, key: str) -> list[tuple[int, int]]:
        """The id pairs of a group whose byte ranges overlap, one for each overlap."""
        a, b = ([int(i) for i in side.split(",")] for side in key.split("|"))
        if len(a) == 1 or len(b) == 1:
            return [(x, y) for x in a for y in b]
        out, i, j, left_a, left_b = [], 0, 0, len(self.a_bytes[a[0]]), len(self.b_bytes[b[0]])
        while True:
            out.append((a[i], b[j]))
            step = min(left_a, left_b)
            left_a, left_b = left_a - step, left_b - step
            if not left_a:
                i += 1
                if i == len(a):
                    return out
                left_a = len(self.a_bytes[a[i]])
            if not left_b:
                j += 1
                left_b = len(self.b_bytes[b[j]])


def pair_of(a: str, b: str) -> Pair:
    """One for each Python worker."""
    return worker_cache(f"pair {a} {b}", lambda: Pair(a, b))


def _flat(lists: Iterable[list[int]], sizes: np.ndarray) -> np.ndarray:
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum()))


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _rows(kind: int, block: int, size: int, **columns: pa.Array) -> pa.RecordBatch:
    own = {"kind": pa.array(np.full(size, kind, np.int32)), "block": pa.array(np.full(size, block, np.int64))} | columns
    return pa.RecordBatch.from_arrays([own[f.name] if f.name in own else pa.nulls(size, f.type) for f in _SCHEMA], schema=_SCHEMA)


def _block(pair: Pair, block: int, ids: list[int | None], texts: list[str | None]) -> Iterator[pa.RecordBatch]:
    """The documents, the dictionary and the pair counts of a block."""
    parts = [pair.chunks(t) if t else [] for t in texts]
    distinct = list(dict.fromkeys(chain.from_iterable(parts)))
    coded = dict(zip(distinct, pair.encode(distinct), strict=True))
    if None in coded.values():
        lost = [i for i, p in enumerate(parts) if any(coded[c] is None for c in p)]
        whole = list({" " + texts[i] for i in lost})
        coded.update(zip(whole, pair.encode(whole), strict=True))
        for i in lost:
            parts[i] = [" " + texts[i]] if coded[" " + texts[i]] is not None else []
        distinct = list(dict.fromkeys(chain.from_iterable(parts)))
    number = {c: i for i, c in enumerate(distinct)}
    m = len(distinct)

    # Groups of all distinct chunks: A's and B's ends over the chunks put one after the other, where both end.
    found = [coded[c] for c in distinct]
    a_n, b_n = (np.fromiter((len(f[side]) for f in found), np.int64, m) for side in (0, 1))
    a, b = (_flat((f[side] for f in found), n) for side, n in ((0, a_n), (1, b_n)))
    del coded, found
    a_end, b_end = np.cumsum(pair.a_size[a]), np.cumsum(pair.b_size[b])
    _, a_last, b_last = np.intersect1d(a_end, b_end, assume_unique=True, return_indices=True)
    own_n = np.searchsorted(a_last, np.cumsum(a_n) - 1, side="right")
    group_n = np.diff(own_n, prepend=0)  # groups of each chunk
    keys: dict[str, int] = {}
    spelt, group = [], np.empty(len(a_last), np.int64)
    a_text, b_text = [str(x) for x in a.tolist()], [str(x) for x in b.tolist()]
    i = j = 0
    for g, (p, q) in enumerate(zip((a_last + 1).tolist(), (b_last + 1).tolist(), strict=True)):
        key = f"{a_text[i]}|{b_text[j]}" if p == i + 1 and q == j + 1 else f"{','.join(a_text[i:p])}|{','.join(b_text[j:q])}"
        group[g] = keys.setdefault(key, len(keys))
        spelt.append(key)
        i, j = p, q
    first = (own_n - group_n).tolist()
    chunk_text = [";".join(spelt[i:j]) for i, j in zip(first, own_n.tolist(), strict=True)]
    del a_text, b_text, spelt

    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    at = np.fromiter((number[c] for c in chain.from_iterable(parts)), np.int64, int(sizes.sum()))
    doc = np.repeat(np.arange(len(parts)), sizes)
    per_doc = lambda n: np.bincount(doc, n[at], len(parts)).astype(np.int64)
    n_a, n_b, n_groups = per_doc(a_n), per_doc(b_n), per_doc(group_n)
    ends = np.cumsum(sizes).tolist()
    order = at.tolist()
    shas = [hashlib.sha256(";".join([chunk_text[c] for c in order[i:j]]).encode()).hexdigest() if j > i else "" for i, j in zip([0, *ends[:-1]], ends, strict=True)]
    del order, chunk_text

    # Each document's distinct groups with frequencies, by way of its distinct chunks.
    chunk, times = np.unique(doc * max(m, 1) + at, return_counts=True)
    doc, at = np.divmod(chunk, max(m, 1))
    own = group[_spread(np.array(first, np.int64)[at], group_n[at])]
    held, back = np.unique(np.repeat(doc, group_n[at]) * max(len(keys), 1) + own, return_inverse=True)
    times = np.bincount(back, np.repeat(times, group_n[at]), len(held)).astype(np.int64)
    doc, own = np.divmod(held, max(len(keys), 1))
    numbers = _lists(own, np.bincount(doc, minlength=len(parts)))
    links = n_a + n_b - n_groups  # a group of x and y tokens without a common end inside has x + y - 1
    yield _rows(_DOC, block, len(parts), doc_id=pa.array(ids, pa.int64()), n_a=pa.array(n_a), n_b=pa.array(n_b), n_groups=pa.array(n_groups), n_links=pa.array(links), sha=pa.array(shas, pa.string()), numbers=numbers, times=_lists(times, np.bincount(doc, minlength=len(parts))))
    yield _rows(_GROUP, block, len(keys), number=pa.array(np.arange(len(keys), dtype=np.int32)), key=pa.array(list(keys), pa.string()))

    # In how many documents each pair is linked: the pairs of a group are found once.
    linked = [{x * len(pair.b_bytes) + y for x, y in pair.links(k)} for k in keys]
    link_n = np.fromiter(map(len, linked), np.int64, len(keys))
    codes, link = np.unique(_flat(linked, link_n), return_inverse=True)
    per = link[_spread((np.cumsum(link_n) - link_n)[own], link_n[own])]
    once = np.unique(np.repeat(doc, link_n[own]) * max(len(codes), 1) + per) % max(len(codes), 1)
    counts = np.bincount(once, minlength=len(codes))
    x, y = np.divmod(codes, len(pair.b_bytes))
    yield _rows(_PAIR, block, len(codes), a=pa.array(x.astype(np.int32)), b=pa.array(y.astype(np.int32)), n=pa.array(counts.astype(np.int64)))


def _valid(text: bytes | None) -> str | None:
    try:
        return text.decode() if text else None
    except UnicodeDecodeError:
        return None


def group_blocks(docs: DataFrame, a: str, b: str, characters: int = BLOCK) -> DataFrame:
    """Documents, dictionaries and pair counts of all blocks, told apart by kind (step 1)."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, block, size = pair_of(a, b), TaskContext.get().partitionId() << 32, 0
        ids: list[int | None] = []
        texts: list[str | None] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids.append(doc_id)
                texts.append(_valid(text))
                size += len(text or b"")
                if size >= characters:
                    yield from _block(pair, block, ids, texts)
                    block, size = block + 1, 0
                    ids, texts = [], []
        if ids:
            yield from _block(pair, block, ids, texts)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")), align, _DDL)


def pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, n (documents that hold the pair linked) and best (n is the highest of its A id); at most a row for each pair of ids."""
    pairs = blocks.filter(F.col("kind") == _PAIR).groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = stored(pairs, "pairs")
    most = pairs.groupBy("a").agg(F.max("n").alias("_most"))
    return pairs.join(most, "a").select("a", "b", "n", (F.col("n") == F.col("_most")).cast("long").alias("best"))


def group_figures(blocks: DataFrame, pairs: DataFrame, a: str, b: str) -> DataFrame:
    """key, count_sum and n_best of each distinct group: it is expanded into its links once (step 3)."""

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a, b)
        for batch in batches:
            links = [pair.links(k) for k in batch.column(0).to_pylist()]
            which = np.repeat(np.arange(len(links)), [len(x) for x in links])
            both = np.array(list(chain.from_iterable(links)), np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which)), pa.array(both[:, 0]), pa.array(both[:, 1])], names=["key", "a", "b"])

    keys = blocks.filter(F.col("kind") == _GROUP).select("key").distinct()
    links = map_batches(keys, expand, "key string, a int, b int")
    return links.join(broadcast_if_small(stored(pairs, "pair-counts")), ["a", "b"]).groupBy("key").agg(F.sum("n").alias("count_sum"), F.sum("best").alias("n_best"))


def _multiplied(documents: pa.Table, figures: pa.Table) -> pa.Table:
    """The documents of a block with the figures of its groups, times how often they have them."""
    numbers = figures.column("number").to_numpy()
    sums, best = (np.zeros(int(numbers.max(initial=-1)) + 1, np.int64) for _ in range(2))
    sums[numbers], best[numbers] = figures.column("count_sum").to_numpy(), figures.column("n_best").to_numpy()
    own, times = (documents.column(c).combine_chunks() for c in ("numbers", "times"))
    last = np.cumsum(own.value_lengths().to_numpy())
    own, times = own.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)

    def total(of: np.ndarray) -> pa.Array:
        return pa.array(np.diff(np.concatenate([[0], np.cumsum(of[own] * times)])[last], prepend=0))

    return pa.table([documents.column("doc_id"), *(documents.column(c) for c in _COUNTS), total(best), total(sums), documents.column("sha")], names=["doc_id", *_COUNTS, "n_best", "count_sum", "groups_sha256"])


def align_tokenizers(docs: DataFrame, a: str, b: str, characters: int = BLOCK) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""
    blocks = stored(group_blocks(docs, a, b, characters), "aligned")
    figures = group_figures(blocks, pair_counts(blocks), a, b)
    places = blocks.filter(F.col("kind") == _GROUP).select("block", "number", "key").join(figures, "key").select(F.col("block").alias("of"), "number", "count_sum", "n_best")
    documents = blocks.filter(F.col("kind") == _DOC).select("block", "doc_id", *_COUNTS, "sha", "numbers", "times")
    schema = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return documents.groupBy("block").cogroup(places.groupBy("of")).applyInArrow(_multiplied, schema)


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"), *default_paths())
