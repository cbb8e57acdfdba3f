import random
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from folioforge.llm.packing import best_two_fit, pack_documents
from folioforge.llm.sharding import permute, row_number_at, shard_documents
from folioforge.llm.token_files import document_digests, read_token_files, write_token_files
from folioforge.llm.tokens import encoder

FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]
TEXTS = [
    "", " ", "  ", "\n", "a", " a", "a  b", "a \n b", "don't stop\t\tnow  ", "x\x85y\xa0z w　v", "\x1cq\x1d \x1fr",
    "Ünïcödé ΣΑΣ ς İstanbul", "12 345,67%% ---\r\n\r\n end", "a <|endoftext|> b  <|endoftext|>", "é ́x", "long " * 3000,
]


@pytest.mark.parametrize("name", FILES)
def test_chunked_ids_are_those_of_the_whole_text(name):
    draw = random.Random(5)
    texts = TEXTS + ["".join(draw.choice("ab 'tsé\n\t \x85\xa0 ́ΣI1.,<|>%\x1c") for _ in range(draw.randint(0, 60))) for _ in range(2000)]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    got = encoder(public_tokenizers.path(name)).encode(texts)
    for text, ids in zip(texts, got, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, repr(text)


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", 0, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, part int, ids string").repartition(3)


def test_token_files_round_trip(spark, tmp_path):
    texts = [*TEXTS, None, "same", "same"]
    docs = docs_of(spark, texts)
    write_token_files(docs, str(tmp_path / "t"), public_tokenizers.path(FILES[0]))
    rows = read_token_files(spark, str(tmp_path / "t"))
    got = document_digests(rows).toPandas().sort_values("doc_id").to_numpy().tolist()
    whole, start = Tokenizer.from_file(public_tokenizers.path(FILES[0])), 0
    for i, text in enumerate(texts):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 0]
        assert got[i] == [i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())]
        start += len(ids)
    assert len(got) == len(texts)
    assert read_token_files(spark, str(tmp_path / "t"), [3]).select("doc_id").collect()[0][0] == 3


def test_token_files_null_and_repeated_ids_and_empty_table(spark, tmp_path):
    docs = docs_of(spark, ["b", "a", "c"], [None, 1, 1])
    write_token_files(docs, str(tmp_path / "t"), public_tokenizers.path(FILES[0]))
    got = document_digests(read_token_files(spark, str(tmp_path / "t"))).orderBy("start").toPandas()
    assert got["n_tokens"].tolist() == [2, 2, 2] and got["start"].tolist() == [0, 2, 4] and pd.isna(got["doc_id"][0])
    write_token_files(docs.limit(0), str(tmp_path / "e"), public_tokenizers.path(FILES[0]))
    assert document_digests(read_token_files(spark, str(tmp_path / "e"))).count() == 0


def test_best_two_fit_takes_two_for_the_smallest():
    lengths = np.array([6, 3, 2, 2])
    sequence, offset = best_two_fit(lengths, 10)
    assert sequence.tolist() == [0, 1, 0, 0] and sorted(offset[[0, 2, 3]].tolist()) == [0, 6, 8] and offset[1] == 0


def test_packing_places_every_piece_once(spark):
    draw = random.Random(3)
    texts = [" ".join("word" for _ in range(draw.choice([0, 1, draw.randint(2, 900), draw.randint(2, 900), 5000]))) for _ in range(200)] + [None, "x" * 9000]
    got = pack_documents(docs_of(spark, texts)).toPandas()
    assert got.groupby("doc_id").size().sum() == len(got) and got["doc_id"].nunique() == len(texts)
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["offset"].tolist() == (own["length"].cumsum() - own["length"]).tolist() and own["length"].sum() <= 2048
    assert got["sequence_id"].nunique() <= -(-got["length"].sum() // 2048) + 1
    whole = Tokenizer.from_file(public_tokenizers.path(FILES[1]))
    one = got[got["doc_id"] == 201].sort_values("piece")
    ids = np.array([*whole.encode(texts[201], add_special_tokens=False).ids, 0], "<u4")
    assert one["ids_crc32"].tolist() == [zlib.crc32(ids[a : a + 2048].tobytes()) for a in range(0, len(ids), 2048)]
    assert pack_documents(docs_of(spark, texts).limit(0)).count() == 0


def test_permutation_is_one_and_invertible():
    for n in (1, 2, 3, 7, 64, 1000, 4097):
        image = permute(np.arange(n), n)
        assert sorted(image.tolist()) == list(range(n))
        assert permute(image, n, back=True).tolist() == list(range(n))


def test_shards_are_even_and_computable(spark):
    texts = [None, "", "é", "same", "same"] + [f"t{i}" for i in range(96)]
    ids = [None, 0, 1, 7, 7, *range(100, 196)]
    got = shard_documents(docs_of(spark, texts, ids)).toPandas()
    counts = got.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and len(got) == len(texts)
    for _, own in got.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))
    for row in got.itertuples():
        assert row_number_at(row.shard, row.slot, len(texts)) == row.row_number
    by_number = got.sort_values("row_number")
    assert by_number["doc_id"].iloc[1:].is_monotonic_increasing and pd.isna(by_number["doc_id"].iloc[0])
    assert got[got["doc_id"] == 1][["size", "text_crc32"]].to_numpy().tolist() == [[3, zlib.crc32("é".encode())]]
    assert shard_documents(docs_of(spark, texts).limit(0)).count() == 0
