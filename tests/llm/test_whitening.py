"""Embedding whitening against whole-number sums and numpy over all rows."""

import math
import random

import numpy as np
import pytest

from folioforge.llm import whitening
from folioforge.llm.whitening import whiten_embeddings

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, components=4):
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in v]) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[float(n * a - s) / n for a, s in zip(x, sums, strict=True)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    trace = (centred**2).sum() / n
    out = []
    for i, x in kept:
        c = [n * a - s for a, s in zip(x, sums, strict=True)]
        w = (np.array(c, float) / n) @ vectors / np.sqrt(values)
        out += [(i, k + 1, n, sum(v * v for v in c), w[k], values[k] / trace) for k in range(components)]
    return out


def check(frame, rows, components=4):
    got = [tuple(r) for r in frame.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error").collect()]
    expected = brute(rows, components)
    order = lambda r: (r[0] is None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, expected = sorted(got, key=order), sorted(expected, key=order)
    assert [g[:4] for g in got] == [e[:4] for e in expected]
    for k in range(1, components + 1):
        g, e = (np.array([r[4] for r in side if r[1] == k]) for side in (got, expected))
        assert min(np.abs(g - e).max(), np.abs(g + e).max()) < 1e-7  # either sign, the same for all rows
        assert np.allclose([r[5] for r in got if r[1] == k], [r[5] for r in expected if r[1] == k], rtol=1e-9)
    assert len({g[6] for g in got}) == 1 and got[0][6] < 1e-6


def vectors(n, d, seed, scale=1.0):
    rng = np.random.default_rng(seed)
    return [(i, [float(v) for v in rng.normal(size=d) * scale * np.linspace(2, 0.3, d)]) for i in range(n)]


def test_equals_numpy_with_bad_and_repeated_rows(spark):
    rows = vectors(500, 12, 1)
    rows += [(None, rows[3][1]), (3, rows[4][1]), *[(900 + i, rows[7][1]) for i in range(200)]]
    bad = [(1000, None), (1001, [None] * 12), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11), (1004, [1.0] * 11 + [None])]
    random.Random(2).shuffle(rows)
    check(whiten_embeddings(spark.createDataFrame(rows + bad, SCHEMA).repartition(5)), rows)


def test_offsets_far_larger_than_the_spread(spark):
    rows = [(i, [c + 30000.0 for c in v]) for i, v in vectors(300, 6, 3)]
    check(whiten_embeddings(spark.createDataFrame(rows, SCHEMA)), rows)


def test_scatter_is_exact_with_many_primes(spark):
    rng = random.Random(5)
    x = [[rng.randint(-(2**51), 2**51) for _ in range(4)] for _ in range(700)]
    got = whitening.exact_scatter(spark.createDataFrame([(v,) for v in x], "x array<long>").repartition(3))
    full = [[1, *v] for v in x]
    assert got == [[sum(r[i] * r[j] for r in full) for j in range(5)] for i in range(5)]
    assert len(whitening.primes_for(2**120)) > 5


def test_ones_of_other_lengths_and_huge_entries_are_dropped(spark):
    rows = vectors(100, 5, 6)
    odd = [(500, [1.0] * 4), (501, []), (502, [3e38] * 5)]
    check(whiten_embeddings(spark.createDataFrame(rows + odd, SCHEMA)), rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]])
def test_nothing_to_whiten(spark, rows):
    assert whiten_embeddings(spark.createDataFrame(rows, SCHEMA)).count() == 0


def test_fewer_dimensions_than_components(spark):
    rows = vectors(60, 2, 8)
    frame = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA + ", component int, x string")
    check(whiten_embeddings(frame), rows, 2)


def test_deviation_beyond_a_long_is_null():
    c = np.array([[2**40, 1], [3, 4]], object)
    assert whitening._deviation(c) == [None, 25]


def test_whole_table(spark):
    from folioforge.llm.registry import QUERIES

    name = next(q for q in QUERIES if q.startswith("op12_"))
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check(QUERIES[name](spark, sf_dir), rows)
