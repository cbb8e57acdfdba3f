"""Very long texts, rows without an id and repeated ids, in operators whose other tests have none."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from folioforge.llm.decontamination import contaminations, decontaminate
from folioforge.llm.quality import judge_quality
from folioforge.llm.sharding import shard_documents
from folioforge.llm.token_files import document_digests, read_token_files, write_token_files
from folioforge.llm.toxicity import toxicity

SCHEMA = "doc_id long, text string, _row long, _node string, _target int, _score double, _spans string"


def frame(spark, rows):
    """``rows`` with columns of names that operators use inside."""
    return spark.createDataFrame([(i, t, 1, "n", 2, 0.5, "s") for i, t in rows], SCHEMA).repartition(3)


def prose(draw, n):
    return " ".join(f"w{draw.randint(0, 3000)}" for _ in range(n))


def quality_counts(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = list(zip(found, found[1:], found[2:]))
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), len(found) < 50 or 100 * len(covered) > 50 * len(found)


def test_quality_of_long_texts_and_rows_without_id(spark):
    draw = random.Random(4)
    rows = [(i, prose(draw, 120)) for i in range(40)] + [(None, prose(draw, 90)), (None, "a b c " * 40), (90, prose(draw, 60_000)), (91, "same line\n" * 20_000), (7, prose(draw, 70))]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int")
    got = judge_quality(frame(spark, rows), labels).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((repr(r["doc_id"]), *(r[n] for n in names)) for r in got) == sorted((repr(i), *quality_counts(t)) for i, t in rows)


def test_items_at_the_end_of_long_documents(spark):
    draw = random.Random(5)
    item = prose(draw, 30)
    rows = [(1, f"{prose(draw, 40_000)} {item}"), (2, prose(draw, 40_000)), (None, f"{item} {prose(draw, 100)}"), (3, "short")]
    bench = spark.createDataFrame([(1, item), (2, prose(draw, 8))], "item_id long, text string")
    docs = frame(spark, rows)
    assert [tuple(r)[:2] for r in contaminations(docs, bench).collect()] == [(1, 1)]
    left = decontaminate(docs, bench)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == [2, 3]


def test_shards_of_long_texts(spark):
    long = "é" * 500_000
    got = {r["doc_id"]: r for r in shard_documents(frame(spark, [(1, long), (2, "x"), (None, None)])).collect()}
    assert (got[1]["size"], got[1]["text_crc32"], got[None]["size"]) == (1_000_001, zlib.crc32(long.encode()), 1)


def test_token_files_of_several_rows_without_id(spark, tmp_path):
    draw = random.Random(6)
    texts = [prose(draw, n) for n in (3, 40, 9000)] + [None, "x"]
    write_token_files(frame(spark, [(None, t) for t in texts] + [(4, "y"), (4, "z")]), str(tmp_path / "t"), public_tokenizers.path("byte_bpe_50k.json"))
    got = document_digests(read_token_files(spark, str(tmp_path / "t"))).orderBy("start").collect()
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = [np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for t in [*texts, "y", "z"]]
    assert sorted((r["n_tokens"], r["ids_crc32"]) for r in got) == sorted((len(x), zlib.crc32(x.tobytes())) for x in ids)
    assert [r["doc_id"] for r in got] == [None] * 5 + [4, 4] and [r["start"] for r in got] == np.cumsum([0] + [r["n_tokens"] for r in got[:-1]]).tolist()


def test_toxicity_of_a_long_text(spark):
    draw = random.Random(7)
    rows = [(i, f"{prose(draw, 60)} {'idiot moron scum' if i % 4 == 0 else ''}") for i in range(200)] + [(900, f"{prose(draw, 50_000)} idiot moron scum"), (901, prose(draw, 50_000))]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["score"] for r in toxicity(frame(spark, rows), labels).collect()}
    assert got[900] > 0.7 > got[901]
