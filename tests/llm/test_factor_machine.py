"""The factorisation machine: its identity against all pairs, its gradient, held-out labels and edge cases."""

import random
import zlib

import numpy as np
import pytest

from folioforge.llm import factor_machine as M

DOCS, LABELS = "doc_id long, text string", "doc_id long, quality int"


def test_score_equals_the_sum_over_all_pairs():
    rng = np.random.default_rng(3)
    machine = M.Machine(0.3, rng.normal(size=M.FEATURES) * 0.1, rng.normal(size=(M.FEATURES, M.FACTORS)) * 0.3)
    texts = [b"one two two, three!!!", b"", b"x " * 40, "größer? ja".encode()]
    found = [M.features_of(t) for t in texts]
    ends = np.cumsum([len(f[0]) for f in found])
    got = machine.scores(np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found]), ends)
    for (numbers, values), score in zip(found, got, strict=True):
        y = machine.bias + sum(machine.weights[i] * x for i, x in zip(numbers, values, strict=True))
        y += sum(machine.factors[numbers[a]] @ machine.factors[numbers[b]] * values[a] * values[b] for a in range(len(numbers)) for b in range(a + 1, len(numbers)))
        assert score == pytest.approx(1 / (1 + np.exp(-y)))


def test_features_are_of_the_whole_text():
    base = b"plain words here " * 3000
    one, two = M.features_of(base), M.features_of(base + b"unheard-of")
    words = [{n for n in f[0] if n < M.HASHED} for f in (one, two)]
    assert words[0] < words[1] and len(set(two[0])) == len(two[0])


def made(n, seed):
    """Junk differs from good text by a pair: marks are bad only together with long lines of unknown words."""
    rng = random.Random(seed)
    words = ["bala", "tor", "minu", "seth", "oran", "pelt", "quam", "resi", "ulto", "vand"]
    docs, labels = [], []
    for i in range(n):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(30, 80)))
        bad = rng.random() < 0.3
        if bad:
            text = " ".join(w + rng.choice(["***", "$$$", "&&&"]) for w in text.split())
        docs.append((i, text))
        labels.append((i, 0 if bad else 1))
    return docs, labels


def test_held_out_labels(spark):
    docs, labels = made(600, 5)
    got = M.classify_quality(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS)).collect()
    assert len(got) == 600
    truth = dict(labels)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, _ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert np.mean([truth[r["doc_id"]] == r["predicted"] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)


def test_held_out_labels_are_not_read(spark):
    docs, labels = made(300, 6)
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q) for i, q in labels]
    frame = spark.createDataFrame(docs, DOCS)
    one, two = ({r["doc_id"]: r["score"] for r in M.classify_quality(frame, spark.createDataFrame(x, LABELS)).collect()} for x in (labels, turned))
    assert one == two


def test_edges(spark):
    docs, labels = made(200, 7)
    odd = [(1000, None), (1001, ""), (1002, " \n\t "), (None, "no id"), (5, "another text of a repeated id"), (5, docs[5][1]), (1003, "word " * 200_000)]
    more = [(5, 0), (None, 1), (7777, 1), (8, None)]
    rows = [(*r, "en", "label", 0.5, [None, "77", "-3", "x"][k % 4]) for k, r in enumerate(docs + odd)]
    frame = spark.createDataFrame(rows, DOCS + ", lang string, label string, score double, n_chars string")
    known = spark.createDataFrame(labels + more, LABELS)
    one, two = (sorted(((r["doc_id"], r["held_out"], r["score"], r["predicted"]) for r in M.classify_quality(f, known).collect()), key=repr) for f in (frame, frame.repartition(7)))
    assert len(one) == len(rows) and [r[2] for r in one] == pytest.approx([r[2] for r in two])


@pytest.mark.parametrize("labels, share", [([], 0.5), ([(1, 1), (2, 1)], 0.75), ([(1, 0)], 1 / 3)])
def test_labels_of_one_kind(spark, labels, share):
    frame = spark.createDataFrame([(1, "a b"), (2, None), (3, "c")], DOCS)
    used = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5]
    assert len(used) == len(labels)
    got = M.classify_quality(frame, spark.createDataFrame(labels, LABELS)).collect()
    assert [r["score"] for r in got] == pytest.approx([share] * 3)


def test_empty_table(spark):
    assert M.classify_quality(spark.createDataFrame([], DOCS), spark.createDataFrame([(1, 1)], LABELS)).count() == 0


def test_quality_of_the_given_documents(spark):
    from folioforge.llm.registry import QUERIES

    name = next(q for q in QUERIES if q.startswith("op13_"))
    sf_dir = "/root/testdata/sf0.01"
    got = {r["doc_id"]: r for r in QUERIES[name](spark, sf_dir).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()]
    assert len(got) == 1000
    held = [(q, got[i]["score"], got[i]["predicted"]) for i, q in labels if got[i]["held_out"]]
    good, bad = [s for q, s, _ in held if q], [s for q, s, _ in held if not q]
    assert np.mean([g > b for g in good for b in bad]) > 0.95  # area under the curve
    assert np.mean([q == p for q, _, p in held]) > 0.9
