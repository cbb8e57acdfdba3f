"""Removal of every byte that lies in a repeated string of 400 bytes.

The method asked for (build the collection's Burrows-Wheeler transform and common prefixes column by column, one
symbol of every document a round) needs as many passes over the collection as its longest document has bytes, each
a distributed job that rewrites all external files; the README has figures.  This module gets the same repeated
strings, exactly, in a fixed number of passes:

1.  Every 400-byte string (window) is given an anchor, the leftmost k-gram of least hash inside it.  Equal windows
    have equal anchors at equal places.  Windows that follow each other and share an anchor form a run, about one for
    137 bytes; only runs (hash of the anchor's k-gram, hash of the whole run) are shuffled.
2.  A k-gram that occurs once rules its run out.  If all runs of a k-gram are equal, all their windows repeat.
3.  The others (``contexts``: a copy begins, ends or was edited there) are cut into blocks of 16 windows by their
    distance from the anchor.  What all 16 windows share (the core) decides in the same way: seen once, no window
    repeats; all blocks of a core equal, all repeat; else the 16 windows are compared one by one.

Hot groups are only ever aggregated: equal contexts are reduced to one before they are looked into, so a passage that
a third of all documents share costs a few rows for each of them.

Passages of so many words (``words``) are found in the same way: each word is replaced by a code of WORD_BYTES bytes, and
windows, grams and places count codes (``unit``) instead of bytes, whatever the words' lengths and the white space between.

Whether a text shares such a passage with another document (``across``) is found in the same way, but documents are
counted instead of places.  A string that only one document repeats then stands for that document once.

Null text: no bytes.  Texts under 400 bytes: unchanged.  Rows with equal doc_id are judged each by its own text.
Empty table: no rows.  Extra columns are passed through by ``without_repeats`` and ignored by ``repeat_digests``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_batches, stored, table
from .tokens import slices

LENGTH = 400
#: Bytes of the k-grams that are anchors.
GRAM = 128
#: Windows of a block.
BLOCK = 16
#: Words of a passage that ``repeat_digests`` looks for in other documents: the least count over 50.
PASSAGE_WORDS = 51
#: Bytes of a word's code, words of the k-grams that are anchors, and words whose codes a worker keeps.
WORD_BYTES = 5
WORD_GRAM = 16
CACHE = 200_000
#: Bytes (or codes) looked at together; positions in them fit in POSITION bits.
POSITION = 18
CHUNK = (1 << POSITION) - 4096
#: Spans, of all documents together, up to which they are broadcast rather than texts shuffled: some 30 MB.
SPAN_ROWS = 500_000
#: Blocks that a Python worker hands on together.
ROWS = 5_000

_LOW = np.uint64((1 << POSITION) - 1)
_NO_ID = -(1 << 63)
_tables: dict[str, np.ndarray] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _constants() -> dict[str, np.ndarray]:
    """For two polynomial hashes modulo 2^64: a random word for each byte, powers of an odd base and of its inverse."""
    if not _tables:
        draw = np.random.default_rng(400)
        for k in "ab":
            base = int(draw.integers(1 << 62)) * 2 + 1
            _tables["word" + k] = draw.integers(0, 2**64 - 1, 256, np.uint64)
            _tables["salt" + k] = draw.integers(0, 2**64 - 1, 1, np.uint64)
            for name, x in (("up", base), ("down", pow(base, -1, 1 << 64))):
                powers = np.full((1 << POSITION) + 1, x, np.uint64)
                powers[0] = 1
                _tables[name + k] = np.multiply.accumulate(powers)
    return _tables


def _least(values: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours."""
    n = len(values) - w + 1
    rows = -(-len(values) // w)
    padded = np.full(rows * w, ~np.uint64(0))
    padded[: len(values)] = values
    blocks = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def runs_of(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Document number, first and last window, anchor (places in ``data``), hash of the anchor, hash of the run.

    ``data`` holds texts one after the other, text i from bounds[i] to bounds[i + 1], as bytes or as numbers of words.
    """
    if len(data) < length:
        return tuple(np.zeros(0, np.int64) for _ in range(4)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    c = _constants()
    value = lambda k: c["word" + k][data] if data.dtype == np.uint8 else _mix(data + c["salt" + k])
    sums = {k: np.concatenate([np.zeros(1, np.uint64), np.cumsum(value(k) * c["up" + k][: len(data)], dtype=np.uint64)]) for k in "ab"}
    grams = _mix((sums["a"][gram:] - sums["a"][:-gram]) * c["downa"][: len(data) - gram + 1])
    anchors = (_least((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), length - gram + 1) & _LOW).astype(np.int64)
    places = np.arange(len(anchors))
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(anchors)]
    inside = places + length <= bounds[owner + 1]
    places, anchors, owner = places[inside], anchors[inside], owner[inside]
    if not len(places):
        return runs_of(data[:0], bounds, length, gram)
    new = np.concatenate([[True], (np.diff(anchors) != 0) | (np.diff(owner) != 0)])
    first = np.flatnonzero(new)
    lo, hi, at = places[first], places[np.concatenate([first[1:], [len(places)]]) - 1], anchors[first]
    whole = [(sums[k][hi + length] - sums[k][lo]) * c["down" + k][lo] for k in "ab"]
    shape = ((at - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64)
    return owner[first], lo, hi, at, grams[at], _mix(_mix(_mix(whole[0]) + whole[1]) + shape)


def _keyed(docs: DataFrame) -> list:
    """Columns that name a row: the id and, for ids that occur twice, a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("_id"), F.xxhash64("text").alias("_text_key")]


def keyed_texts(docs: DataFrame) -> DataFrame:
    """_id, _text_key and the bytes of the text."""
    return docs.filter("text is not null").select(*_keyed(docs), F.col("text").cast("binary").alias("text"))


class _Codes(dict):
    def __missing__(self, word: bytes) -> bytes:
        value = self[word] = xxhash.xxh3_64_digest(word)[:WORD_BYTES]
        return value


def _numbers(codes: bytes) -> np.ndarray:
    """The codes as numbers."""
    wide = np.zeros((len(codes) // WORD_BYTES, 8), np.uint8)
    wide[:, :WORD_BYTES] = np.frombuffer(codes, np.uint8).reshape(-1, WORD_BYTES)
    return wide.view("<u8").ravel()


def word_codes(texts: DataFrame) -> DataFrame:
    """``texts`` with the codes of the words in place of their bytes."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Codes()
        for batch in batches:
            coded = []
            for text in batch.column(2).to_pylist():
                coded.append(b"".join(map(known.__getitem__, text.split())))
                if len(known) > CACHE:
                    known.clear()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(coded, pa.binary())], names=["_id", "_text_key", "text"])

    return map_batches(texts, code, "_id long, _text_key long, text binary")


def word_places(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans of words as spans of the text, from the first byte of a word to the last of another."""
    at = [m.span() for m in re.finditer(rb"\S+", text)] if spans else []
    return [(at[b][0], at[e - 1][1]) for b, e in spans]


def text_runs(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: int = 1) -> DataFrame:
    """The runs of every text: gram, whole, _id, _text_key, lo, hi, anchor; places count units of so many bytes."""
    width = gram
    names = ["gram", "whole", "_id", "_text_key", "lo", "hi", "anchor"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (np.asarray(batch.column(i)) for i in (0, 1))
            texts = batch.column(2).cast(pa.binary())
            sizes = np.asarray(pa.compute.binary_length(texts), np.int64) // unit
            for i, j in slices(sizes.tolist(), CHUNK // 2):
                held = texts.slice(i, j - i).to_pylist()
                # A text longer than a chunk is seen in chunks that overlap by all but one byte of a window.
                parts = [(i + n, at, t[at * unit : (at + CHUNK) * unit]) for n, t in enumerate(held) for at in range(0, max(1, len(t) // unit - length + 1), CHUNK - length + 1)]
                for some in _packed([len(p[2]) // unit for p in parts]):
                    own = parts[some]
                    joined = b"".join(p[2] for p in own)
                    data = np.frombuffer(joined, np.uint8) if unit == 1 else _numbers(joined)
                    bounds = np.cumsum([0, *(len(p[2]) // unit for p in own)])
                    n, lo, hi, anchor, gram, whole = runs_of(data, bounds, length, width)
                    row, shift = np.array([p[0] for p in own], np.int64)[n], np.array([p[1] for p in own], np.int64)[n] - bounds[:-1][n]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (gram.view(np.int64), whole.view(np.int64), ids[row], keys[row], lo + shift, hi + shift, anchor + shift)], names=names)

    return map_batches(texts.filter(F.octet_length("text") >= length * unit), find, ", ".join(f"{x} long" for x in names))


def _packed(sizes: list[int]) -> list[slice]:
    """Ranges of parts that fit into one chunk together."""
    out, begin, total = [], 0, 0
    for i, x in enumerate(sizes):
        if total + x > CHUNK:
            out.append(slice(begin, i))
            begin, total = i, 0
        total += x
    return [*out, slice(begin, len(sizes))]


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)


def _hash(gram: int, at: int, text: bytes) -> int:
    """A signed 64-bit hash of ``text`` at a place of its anchor."""
    x = xxhash.xxh3_64_intdigest(text, (gram * 0x9E3779B97F4A7C15 + at) & 0xFFFFFFFFFFFFFFFF)
    return x - (1 << 64) if x >> 63 else x


def _several(across: bool) -> Column:
    """Whether a group has two places or more or, with ``across``, two documents or more."""
    document = F.xxhash64("_id", "_text_key")
    return F.min(document) != F.max(document) if across else F.count("*") > 1


def _repeated(rows: DataFrame, core: str, whole: str, across: bool) -> DataFrame:
    """The cores that occur twice or more, and whether all their wholes are equal; stored, so that a join with them can split a hot core."""
    found = rows.groupBy(core).agg(_several(across).alias("_several"), F.min(whole).alias("_least"), F.max(whole).alias("_most")).filter("_several").select(core, (F.col("_least") != F.col("_most")).alias("open"))
    return broadcast_if_small(stored(found, "repeated"))


def _distinct(rows: DataFrame, core: str, whole: str, kept: list[str], across: bool) -> DataFrame:
    """One row for each whole of the open cores, and whether it has copies."""
    return rows.groupBy(core, whole).agg(_several(across).alias("copied"), F.min(F.struct(*kept)).alias("_one")).select(core, whole, "copied", "_one.*")


def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, unit: int = 1, across: bool = False) -> DataFrame:
    """_id, _text_key, begin and end of spans whose union is what ``texts(_id, _text_key, text)`` have of repeated windows.

    With ``across`` the documents of the spans are those that share a window with another one; of windows that a
    document holds twice not every place need be there.
    """
    name = ["_id", "_text_key"]
    runs = stored(text_runs(texts, length, gram, unit), "runs")
    hits = stored(runs.join(_repeated(runs, "gram", "whole", across), "gram"), "hits")
    span = [*name, F.col("lo").alias("begin"), (F.col("hi") + length).alias("end")]
    open_runs = hits.filter("open")
    one = stored(_distinct(open_runs, "gram", "whole", [*name, "lo", "hi", "anchor"], across), "contexts")
    copied = broadcast_if_small(one.filter("copied").select("gram", "whole"))
    spans = hits.filter("not open").select(*span).unionByName(open_runs.join(copied, ["gram", "whole"], "left_semi").select(*span))

    wanted = stored(one.groupBy(*name).agg(F.collect_list(F.struct("gram", "lo", "hi", "anchor")).alias("wanted")), "wanted")
    texts = texts.join(_small(wanted, "wanted"), name)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Core, whole, gram, first and last window, distance of the first from the anchor, and the bytes that the windows cover."""
        for batch in batches:
            rows = []
            for doc_id, key, text, wanted in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_id", "_text_key", "text", "wanted")), strict=True):
                for x in wanted:
                    gram, first, last, anchor = x["gram"], x["lo"], x["hi"], x["anchor"]
                    for q in range((first - anchor) // BLOCK, (last - anchor) // BLOCK + 1):
                        at = anchor + q * BLOCK
                        lo, hi = max(at, first), min(at + BLOCK - 1, last)
                        covered = text[lo * unit : (hi + length) * unit]
                        shape = (lo - at) * BLOCK + hi - at
                        rows.append((_hash(gram, q, text[(at + BLOCK - 1) * unit : (at + length) * unit]), _hash(gram, q * BLOCK * BLOCK + shape, covered), gram, doc_id, key, lo, hi, lo - anchor, covered))
                if len(rows) > ROWS:
                    yield _rows(rows, schema)
                    rows = []
            yield _rows(rows, schema)

    longs = ["core", "whole", "gram", *name, "lo", "hi", "distance"]
    schema = pa.schema([*((x, pa.int64()) for x in longs), ("covered", pa.binary())])
    cut = stored(map_batches(texts, blocks, ", ".join(f"{x} long" for x in longs) + ", covered binary"), "blocks")
    seen = cut.join(_repeated(cut, "core", "whole", across), "core")
    spans = spans.unionByName(seen.filter("not open").select(*span))
    open_blocks = seen.filter("open")
    pairs = stored(cut.groupBy("core", "whole").agg(_several(across).alias("_several")).filter("_several").select("core", "whole"), "repeated-blocks")
    spans = spans.unionByName(open_blocks.join(broadcast_if_small(pairs), ["core", "whole"], "left_semi").select(*span))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(n, pa.int64()) for n in ("window", *name, "begin")])
        for batch in batches:
            rows = []
            for gram, doc_id, key, lo, hi, distance, covered in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                rows += [(_hash(gram, distance + i, covered[i * unit : (i + length) * unit]), doc_id, key, lo + i) for i in range(hi - lo + 1)]
            yield _rows(rows, kind)

    distinct = _distinct(open_blocks, "core", "whole", ["gram", *name, "lo", "hi", "distance", "covered"], across).select("gram", *name, "lo", "hi", "distance", "covered")
    single = map_batches(distinct, windows, "window long, _id long, _text_key long, begin long")
    single = stored(single, "windows")
    twice = stored(single.groupBy("window").agg(_several(across).alias("_several")).filter("_several").select("window"), "repeated-windows")
    return spans.unionByName(single.join(broadcast_if_small(twice), "window", "left_semi").select(*name, "begin", (F.col("begin") + length).alias("end")))


def _small(rows: DataFrame, spans: str) -> DataFrame:
    """A stored table of documents with their spans: broadcast if there are few spans, else hashed beside shuffled texts."""
    few = (rows.agg(F.sum(F.size(spans))).first()[0] or 0) <= SPAN_ROWS
    return F.broadcast(rows) if few else rows.hint("shuffle_hash")


def _merged_spans(texts: DataFrame, length: int, gram: int, name: str, unit: int = 1) -> DataFrame:
    """_id, _text_key and, as ``name``, the maximal runs of repeated windows in order."""
    pair = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [[{"begin": b, "end": e} for b, e in merged(found)] for found in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, pa.list_(pair))], names=["_id", "_text_key", name])

    spans = repeated_spans(texts, length, gram, unit).groupBy("_id", "_text_key").agg(F.collect_set(F.struct("begin", "end")).alias("_spans"))
    return stored(map_batches(spans, merge, f"_id long, _text_key long, {name} array<struct<begin: long, end: long>>"), "spans")


def with_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """``docs`` with _spans, the maximal runs to remove in order (null if none), and those of repeated passages of ``words`` words as _word_spans, in words."""
    texts = keyed_texts(docs)
    marked = docs.select("*", *_keyed(docs)).join(_small(_merged_spans(texts, length, gram, "_spans"), "_spans"), ["_id", "_text_key"], "left")
    if words:
        passages = _merged_spans(stored(word_codes(texts), "codes"), words, min(WORD_GRAM, words), "_word_spans", WORD_BYTES)
        marked = marked.join(_small(passages, "_word_spans"), ["_id", "_text_key"], "left")
    return marked.drop("_id", "_text_key")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs: spans that overlap or touch are one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted((x["begin"], x["end"]) for x in spans or ()):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def kept_bytes(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *(e for _, e in spans)]
    return b"".join(text[b:e] for b, e in zip(ends, [*(b for b, _ in spans), len(text)], strict=True))


def passage_documents(docs: DataFrame, words: int = PASSAGE_WORDS) -> DataFrame:
    """_id and _text_key of the documents that share a passage of ``words`` words with another document; stored."""
    codes = stored(word_codes(keyed_texts(docs)), "codes")
    return stored(repeated_spans(codes, words, min(WORD_GRAM, words), WORD_BYTES, across=True).select("_id", "_text_key").distinct(), "passages")


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and shares_passage of every document.

    shares_passage: it has PASSAGE_WORDS words in a row that another document has, too.  Such a passage can be shorter
    than LENGTH bytes; it is reported, and what is removed follows from the bytes alone.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found, shares in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                text = text or b""
                spans = merged(found)
                kept = kept_bytes(text, spans)
                rows.append((doc_id, len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), shares))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema=schema)

    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("shares_passage", pa.bool_())])
    sharing = broadcast_if_small(passage_documents(docs).withColumn("_shares", F.lit(True)))
    marked = with_spans(docs.select("doc_id", "text")).select("*", *_keyed(docs)).join(sharing, ["_id", "_text_key"], "left")
    marked = marked.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "_spans", F.coalesce("_shares", F.lit(False)).alias("_shares"))
    return map_batches(marked, digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, shares_passage boolean")


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, words: int | None = None) -> DataFrame:
    """``docs`` with what is left of each text; parts of a character that a cut leaves are dropped.

    Strings of ``length`` bytes that repeat go and, if ``words`` is given, passages of so many words that do.
    """

    at, extra = docs.columns.index("text"), 2 if words else 1

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for i, found in enumerate(zip(*(x.to_pylist() for x in batch.columns[-extra:]), strict=True)):
                if any(found):
                    text = texts[i].encode()
                    spans = merged(found[0])
                    if words:
                        spans = merged([{"begin": b, "end": e} for b, e in spans + word_places(text, merged(found[1]))])
                    texts[i] = kept_bytes(text, spans).decode("utf-8", "ignore")
            columns = batch.columns[:-extra]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-extra])

    marks = ["_spans", "_word_spans"][:extra]
    return map_batches(with_spans(docs, length, gram, words).select(*docs.columns, *marks), cut, docs.schema)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"))
