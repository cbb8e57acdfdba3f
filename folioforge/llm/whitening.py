"""Embedding whitening from an exact scatter matrix.

The scatter of the whole-number vectors x of the fit list is computed in residues: each partition multiplies its rows
modulo several primes, the residues are summed over all partitions modulo their primes, and Chinese remaindering gives the
whole numbers.  A column of ones is part of each row, so that the row count n and the sums S come the same way.  As many
primes are used as twice the largest possible entry needs, so nothing is rounded before the covariance
(n * sum(x x') - S S') / n^2, which is what centring each row before multiplying gives.  Its double ``eigh`` gives the
components.

Only matrices of the dimension's size come to the driver, whatever the number of rows.

Dropped: null vectors, vectors with null or non-finite entries, with entries whose x is not within 2^52, without entries, and those whose
length is not the most frequent one of what is left (the greatest of several).  Equal vectors count once in the fit, but
every row is returned, with null and repeated ids, too.  Components whose eigenvalue is nothing but rounding are not
returned, so equal rows alone, a single row or an empty table give no rows.  deviation is null where it exceeds a long.
With equal eigenvalues any basis of their space is right.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import isqrt, prod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stored, table

COMPONENTS = 4
SCALE = 256
#: Primes are below 2^BITS; ROWS products of residues within half of that are exact as a sum of doubles.
BITS, ROWS = 21, 8192
_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def primes_for(most: int) -> list[int]:
    """The largest primes below 2^BITS whose product is above ``most``; two at least."""
    found: list[int] = []
    for p in range(2**BITS - 1, 2, -2):
        if len(found) >= 2 and prod(found) > most:
            break
        if all(p % q for q in range(3, isqrt(p) + 1, 2)):
            found.append(p)
    return found


def chinese_remainder(residues: list[int], primes: list[int]) -> int:
    """The whole number of least size with these residues."""
    whole = prod(primes)
    x = sum(r * (whole // p) * pow(whole // p, -1, p) for r, p in zip(residues, primes, strict=True)) % whole
    return x - whole if x > whole // 2 else x


def whole_vectors(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id and x of the rows that are kept: floor(256 * c) of each entry c."""
    c = F.col(vector)
    usable = c.isNotNull() & F.coalesce(F.forall(c, lambda v: F.coalesce(v.cast("double").between(-(2.0**44), 2.0**44), F.lit(False))), F.lit(False)) & (F.size(c) > 0)
    x = F.transform(c, lambda v: F.floor(v.cast("double") * SCALE).cast("long"))
    found = rows.filter(usable).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    sizes = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return found.filter(F.size("x") == (sizes["d"] if sizes else 0))


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0), np.int64)


def exact_scatter(fit: DataFrame) -> list[list[int]]:
    """The scatter matrix of (1, x) over ``fit`` in whole numbers: n at (0, 0), S in row 0, sum(x x') below."""
    largest, n = fit.agg(F.max(F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))), F.count("*")).first()
    if not n:
        return [[0]]
    primes = primes_for(2 * n * max(1, largest) ** 2)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: list[np.ndarray] | None = None
        for batch in batches:
            x = _matrix(batch.column(0))
            for at in range(0, len(x), ROWS):
                rows = x[at : at + ROWS]
                for k, p in enumerate(primes):
                    half = p // 2
                    residues = np.empty((len(rows), rows.shape[1] + 1))
                    residues[:, 0] = 1
                    residues[:, 1:] = (rows + half) % p - half
                    product = (residues.T @ residues).astype(np.int64) % p
                    if sums is None:
                        sums = [np.zeros(product.shape, np.int64) for _ in primes]
                    sums[k] = (sums[k] + product) % p
        if sums is not None:
            i, j = np.triu_indices(len(sums[0]))
            for k, total in enumerate(sums):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["prime", "i", "j", "r"])

    products = map_batches(fit.select("x"), multiply, "prime int, i int, j int, r long").groupBy("i", "j", "prime").agg(F.sum("r").alias("r"))
    by_place: dict[tuple[int, int], list[int]] = {}
    for i, j, prime, r in products.collect():  # an entry of a matrix of the dimension's size for each prime
        by_place.setdefault((i, j), [0] * len(primes))[prime] = r % primes[prime]
    size = 1 + max(i for i, _ in by_place)
    out = [[0] * size for _ in range(size)]
    for (i, j), residues in by_place.items():
        out[i][j] = out[j][i] = chinese_remainder(residues, primes)
    return out


@dataclass
class Whitening:
    """n, S, the components as columns with their eigenvalues by falling size, and the trace of the covariance."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float


def fit_whitening(scatter: list[list[int]], components: int = COMPONENTS) -> Whitening:
    """From the exact scatter of (1, x); all components that have an eigenvalue with ``components`` of the dimension."""
    n, sums = scatter[0][0], scatter[0][1:]
    d = len(sums)
    if not n:
        return Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0)
    centred = [[n * scatter[i + 1][j + 1] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    covariance = np.array([[v / (n * n) for v in row] for row in centred])  # each quotient of whole numbers is rounded once
    trace = sum(centred[i][i] for i in range(d)) / (n * n)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    kept = values > 8 * d * np.finfo(float).eps * max(trace, 0.0)
    return Whitening(n, sums, vectors[:, kept], values[kept], trace)


def _centred(x: np.ndarray, model: Whitening) -> np.ndarray:
    """n * x - S, in long integers where they fit."""
    if model.n * 2**53 + max(map(abs, model.sums), default=0) < 2**63 or model.n * int(np.abs(x).max(initial=0)) + max(map(abs, model.sums)) < 2**62:
        return x * np.int64(model.n) - np.array(model.sums, np.int64)
    return x.astype(object) * model.n - np.array(model.sums, object)


def _deviation(c: np.ndarray) -> list[int | None]:
    """Sums of squares, exact; None beyond a long."""
    most = max((abs(int(v)) for v in (c.max(initial=0), c.min(initial=0))), default=0)
    if most * most * c.shape[1] < 2**63:
        return (c * c).sum(axis=1).tolist()
    return [s if s < 2**63 else None for s in (sum(int(v) ** 2 for v in row) for row in c)]


def _projected(c: np.ndarray, model: Whitening) -> np.ndarray:
    return (c.astype(float) / model.n) @ model.vectors / np.sqrt(model.values)


def identity_error(fit: DataFrame, model: Whitening) -> float:
    """The largest absolute entry of the covariance of the whitened fit list minus the identity."""
    k = len(model.values)
    if not k:
        return 0.0

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k + 1))
        for batch in batches:
            w = _projected(_centred(_matrix(batch.column(0)), model), model)  # their mean is 0
            w = np.hstack([np.ones((len(w), 1)), w])
            total += w.T @ w
        i, j = np.triu_indices(k + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], names=["i", "j", "s"])

    sums = np.zeros((k + 1, k + 1))
    for i, j, s in map_batches(fit.select("x"), products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect():
        sums[i, j] = sums[j, i] = s
    mean = sums[0, 1:] / model.n
    return float(np.abs(sums[1:, 1:] / model.n - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, component, n, deviation, whitened and explained of each row of ``vectors`` (vec_id, x) and component."""
    k = len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = _centred(_matrix(batch.column(1)), model)
            n = len(c)
            whitened = _projected(c, model)
            repeated = pa.array(np.repeat(np.arange(n), k))
            columns = [batch.column(0).take(repeated), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)), pa.array(np.full(n * k, model.n, np.int64)), pa.array(_deviation(c), pa.int64()).take(repeated), pa.array(whitened.ravel()), pa.array(np.tile(model.values / model.trace, n))]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained"])

    rows = map_batches(vectors, project, _OUT)
    return rows if k else rows.limit(0)


def whiten_embeddings(rows: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """The whitened components of every row that is kept, with the figures of the fit."""
    vectors = whole_vectors(rows)
    fit = stored(vectors.select("x").distinct(), "fit-list")
    model = fit_whitening(exact_scatter(fit), components)
    return whiten(vectors, model).withColumn("identity_error", F.lit(identity_error(fit, model)))


def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten_embeddings(table(spark, sf_dir, "embeddings"))
