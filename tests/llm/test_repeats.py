import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from folioforge.llm import suffix_dedup
from folioforge.llm.suffix_dedup import LENGTH, repeat_digests, without_repeats

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, gram string, _n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "clash", 1) for i, t in rows], COLUMNS).repartition(3)


def brute(rows):
    count = Counter()
    for _, text in rows:
        data = (text or "").encode()
        count.update(data[i : i + LENGTH] for i in range(len(data) - LENGTH + 1))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - LENGTH + 1):
            if count[data[i : i + LENGTH]] > 1:
                gone[i : i + LENGTH] = b"\1" * LENGTH
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((doc_id, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_sharing(rows, words=51):
    """Whether each row shares ``words`` words in a row with another document (another id or text)."""
    held = [{tuple(w[i : i + words]) for i in range(len(w) - words + 1)} for w in ((t or "").encode().split() for _, t in rows)]
    return [any(a & b and x != y for y, b in zip(rows, held, strict=True)) for x, a in zip(rows, held, strict=True)]


def corpus(seed):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdeéß") for _ in range(draw.randint(1, 7))) for _ in range(400)]
    prose = lambda n: " ".join(draw.choice(words) for _ in range(n))
    shared = [prose(n) for n in (60, 75, 90, 130, 300, 700)]
    exact = prose(200)
    texts = [None, "", "short", "a" * 1500, "ab" * 300, "x" * 399, "y" * 400, "y" * 400, shared[0] * 6, exact, exact, exact, " " + exact]
    for i in range(90):
        parts = [prose(draw.randint(0, 150))]
        for _ in range(draw.randint(0, 2)):
            own = draw.choice(shared).split()
            if draw.random() < 0.4:
                own[draw.randrange(len(own))] = "EDIT"
            a = draw.randint(0, 5)
            parts += [" ".join(own[a : len(own) - draw.randint(0, 5)]), prose(draw.randint(0, 80))]
        texts.append(draw.choice(["", " ", "\n"]).join(parts))
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_bytes_are_those_of_brute_force(spark, seed):
    rows = corpus(seed)
    got = sorted(tuple(r) for r in repeat_digests(frame(spark, rows)).collect())
    assert [r[:5] for r in got] == brute(rows)
    shares = brute_sharing(rows)
    assert [r[5] for r in got] == shares and 20 < sum(shares) < len(rows) - 20


def test_documents_that_share_a_passage_and_those_that_repeat_their_own(spark):
    draw = random.Random(16)
    prose = lambda n: [f"{draw.choice('abcdefgh')}{draw.randrange(1000)}" for _ in range(n)]
    short, long, own, edited = prose(50), prose(51), prose(60), prose(130)
    other = [*edited[:55], "EDIT", *edited[56:]]
    texts = [[*prose(9), *short, *prose(9)], [*prose(9), *short], [*prose(30), *long], [*long, *prose(4)], [*own, *prose(5), *own], edited, other, [*edited[57:], *prose(3), *edited[57:]], prose(200), ["x"] * 400, ["y"] * 200, ["y"] * 51]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(None, " ".join(long)), (4, " ".join([*own, *prose(7), *own])), (20, None), (21, "")] + [(8, " ".join(texts[8]))]
    got = Counter((r["doc_id"], r["n_bytes"], r["shares_passage"]) for r in repeat_digests(frame(spark, rows)).collect())
    want = brute_sharing(rows)
    assert got == Counter((i, len((t or "").encode()), w) for (i, t), w in zip(rows, want, strict=True))
    assert want == [False, False, True, True, True, True, True, True, False, False, True, True, True, True, False, False, False]


def test_long_texts_are_seen_in_chunks(spark, monkeypatch):
    draw = random.Random(9)
    prose = lambda n: "".join(draw.choice("abcdef gh") for _ in range(n))
    part = prose(30_000)
    texts = [prose(50_000) + part + prose(41_000), part[5_000:29_000] + prose(2_000) + part[100:900]]
    data = [t.encode() for t in texts]
    monkeypatch.setattr(suffix_dedup, "CHUNK", 8_192)
    rows = list(enumerate(texts))
    docs = frame(spark, rows)
    got = sorted(tuple(r)[:5] for r in repeat_digests(docs).collect())
    assert got == brute(rows) and sum(map(len, data)) > 10 * suffix_dedup.CHUNK


def test_null_and_equal_ids_and_the_empty_table(spark):
    long = "".join(random.Random(4).choice("abcdefgh ") for _ in range(900))
    rows = [(None, long), (5, long[:450]), (5, "q" + long[500:]), (5, "other")]
    docs = frame(spark, rows)
    got = Counter(tuple(r)[:5] for r in repeat_digests(docs).collect())
    assert got == Counter(brute(rows))
    assert repeat_digests(docs.limit(0)).count() == 0
    left = without_repeats(docs)
    assert left.columns == docs.columns and left.filter("text = 'other'").count() == 1 and left.count() == 4


def test_cut_characters_are_dropped(spark):
    tail = "z" * 399
    rows = [(1, "aé" + "".join(random.Random(1).choice("qwerty ") for _ in range(450)) + tail), (2, None)]
    rows.append((3, "bĩ" + rows[0][1][2:]))  # é and ĩ end in the same byte
    got = {r["doc_id"]: r["text"] for r in without_repeats(frame(spark, rows)).collect()}
    assert got == {1: "a", 2: None, 3: "b"}


def test_passages_of_51_words_go_and_those_of_50_stay(spark):
    draw = random.Random(6)
    prose = lambda n: [f"{draw.choice('abcdefgh')}{draw.randrange(1000)}" for _ in range(n)]
    short, long, edited = prose(50), prose(51), prose(120)
    other = [*edited[:55], "EDIT", *edited[56:]]
    texts = [" ".join([*prose(30), *part, *prose(40)]) for part in (short, short, long, long, edited, other, prose(200))]
    texts += ["\n".join([*prose(5), *long]), " ".join(["x"] * 51), " ".join(["y"] * 52), None, ""]
    assert all(len(" ".join(x)) < LENGTH for x in (short, long))
    count = Counter(tuple(w[i : i + 51]) for w in ((t or "").split() for t in texts) for i in range(len(w) - 50))
    want = []
    for text in texts:
        words = (text or "").split()
        gone = {j for i in range(len(words) - 50) if count[tuple(words[i : i + 51])] > 1 for j in range(i, i + 51)}
        want.append([w for j, w in enumerate(words) if j not in gone])
    docs = frame(spark, list(enumerate(texts)))
    got = {r["doc_id"]: r["text"] for r in without_repeats(docs, words=51).collect()}
    assert [(got[i] or "").split() for i in range(len(texts))] == want and got[10] is None
    assert [len(x) for x in want] == [120, 120, 70, 70, 71, 71, 270, 5, 51, 0, 0, 0]
    staged = {r["doc_id"]: r["text"] for r in corpus_pipeline.suffix_dedup(spark, docs, "").collect()}
    assert staged == got
