"""Cross-tokenizer alignment against a plain version over whole texts."""

import hashlib
import random
from collections import Counter

import pytest

from folioforge.llm import alignment
from folioforge.llm.alignment import align_tokenizers, default_paths

SCHEMA = "doc_id long, text string"
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = default_paths()
    left, right = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
    left.encode_special_tokens = True
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte, extra = {}, 256
    for i in range(256):
        byte[chr(i) if i in visible else chr(extra)] = i
        extra += i not in visible

    def piece(i):
        p = right.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if p.startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode()

    texts, counts = [], Counter()
    for _, text in rows:
        x = left.encode(" " + text, add_special_tokens=False) if text else None
        y = right.encode(text) if text else []
        spans, groups = [], []
        if text:
            as_bytes, bs_bytes = [bytes(byte[c] for c in t) for t in x.tokens], [piece(i) for i in y]
            if b"".join(as_bytes) == b"".join(bs_bytes) == (" " + text).encode():
                for ids, pieces in ((x.ids, as_bytes), (y, bs_bytes)):
                    at, own = 0, []
                    for i, p in zip(ids, pieces, strict=True):
                        own.append((at, at + len(p), i))
                        at += len(p)
                    spans.append(own)
        if not spans:
            texts.append(None)
            continue
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        links = []
        rest = [iter(own) for own in spans]
        for cut in cuts:
            inside = [[], []]
            for side, own in zip(inside, rest, strict=True):
                while not side or side[-1][1] < cut:
                    side.append(next(own))
            groups.append("|".join(",".join(str(i) for _, _, i in side) for side in inside))
            links += [(p[2], q[2]) for p in inside[0] for q in inside[1] if p[0] < q[1] and q[0] < p[1]]
        counts.update(set(links))
        texts.append((len(spans[0]), len(spans[1]), groups, links))
    top = {}
    for (p, _), n in counts.items():
        top[p] = max(top.get(p, 0), n)
    out = []
    for (doc_id, _), t in zip(rows, texts, strict=True):
        if t is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
        else:
            n_a, n_b, groups, links = t
            out.append((doc_id, n_a, n_b, len(groups), len(links), sum(counts[x] == top[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


def result(frame):
    return sorted((tuple(r[c] for c in COLUMNS) for r in frame.collect()), key=repr)


EDGES = [
    (1, "plain words, and more words."), (2, None), (3, ""), (4, " "), (5, "   leading and trailing   "), (6, "two  spaces\n\n  and lines\n with \t tabs \r\n here"),
    (7, "<|endoftext|> and <s> </s> are text"), (8, "a mark ▁ of pieces"), (9, "ﬁne Ångström é   x y"), (10, "日本語と漢字 🙂🙂 emoji"), (11, "nul \x00 byte"), (12, "plain words, and more words."),
    (None, "no id"), (None, "no id"), (12, "another text of a repeated id"), (13, "x" * 3000), (14, "don't we'll 12,345.67 it's THE"), (15, "\n"), (16, "tail \n"), (17, "　wide 　 space"),
]


def test_edges_equal_whole_texts(spark):
    rows = EDGES + [(99, "long " + " ".join(f"word{i % 700} stuffs" for i in range(20000)))]
    got = align_tokenizers(spark.createDataFrame(rows, SCHEMA).repartition(3), *default_paths())
    assert result(got) == sorted(brute(rows), key=repr)


def test_random_texts_and_small_blocks(spark):
    rng = random.Random(7)
    marks = [" ", "  ", "\n", "\n ", " \n", "\t", " ", "a", "the", " the", "'s", "é", "ß", "!!", "***", "12", "▁", "漢", "🙂", "Abc", "  ", "�"]
    rows = [(i, "".join(rng.choice(marks) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    expected = sorted(brute(rows), key=repr)
    assert result(align_tokenizers(spark.createDataFrame(rows, SCHEMA).repartition(5), *default_paths(), characters=500)) == expected


def test_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr("folioforge.llm.common.BROADCAST_ROWS", -1)
    assert result(align_tokenizers(spark.createDataFrame(EDGES, SCHEMA), *default_paths())) == sorted(brute(EDGES), key=repr)


def test_empty_tables_and_clashing_columns(spark):
    extra = spark.createDataFrame([(1, "some text", 5, "k")], "doc_id long, text string, block int, key string")
    assert result(align_tokenizers(extra, *default_paths())) == brute([(1, "some text")])
    assert align_tokenizers(spark.createDataFrame([], SCHEMA), *default_paths()).count() == 0
    assert result(align_tokenizers(spark.createDataFrame([(1, None)], SCHEMA), *default_paths())) == brute([(1, None)])


def test_whole_table(spark):
    from folioforge.llm.registry import QUERIES

    name = next(q for q in QUERIES if q.startswith("op11_"))
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(QUERIES[name](spark, sf_dir)) == sorted(brute(rows), key=repr)


@pytest.mark.parametrize("key, links", [("1|2", 1), ("1,2|3", 2)])
def test_links_of_simple_groups(key, links):
    assert len(alignment.Pair(*default_paths()).links(key)) == links
