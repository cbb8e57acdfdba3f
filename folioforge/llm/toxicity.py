"""Toxicity by weak supervision.

1.  Voters: words of a short lexicon, and words and word beginnings that the labelled sample shows far more often in
    toxic texts.  A voter votes where its word or pattern occurs and abstains elsewhere.
2.  Label model: how often each voter and each pair of voters votes is counted over all documents (no labels).  Under
    two classes and independent errors the covariance of two voters is the product of their accuracies, so triples
    give each accuracy in closed form; what a pair's covariance exceeds that product by is its correlation, and the
    weights of correlated voters are shared.  A text's posterior follows from the votes it has.
3.  A linear classifier on words and beginnings is fitted to the posteriors of the sample and scores every text.

Only the sample (SAMPLE labelled documents at most, by a hash of the id) comes to the driver, as lists of feature
numbers; counts of voters and pairs have a fixed size.  Labels are read only where crc32 of the id in decimal modulo 3
is not 1.  labels, lang, source and doc_id are no inputs of a score.

Null or wordless texts: scored by what no word says.  Of several texts of an id the one of least checksum is in the sample.  Labels of unknown documents and repeated labels are harmless;
without labels the lexicon alone votes.  Empty table: no rows.  Extra columns are passed by ``without_toxic``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import map_batches, stored, table
from .licenses import words

#: Labelled documents that the classifier is fitted on, at most.
SAMPLE = 10_000
#: Voters and features (the lexicon included), at most.
VOTERS = 48
FEATURES = 400
#: Words that a task remembers, and terms that it counts before it hands them on.
CACHE = 100_000
COUNTED = 100_000
#: Sampled documents that a term needs.
SUPPORT = 5
THRESHOLD = 0.7
#: Common insults.
LEXICON = ["idiot", "moron", "stupid", "loser", "trash", "scum", "pathetic", "worthless", "disgusting", "clown"]
#: Lengths of word beginnings, in bytes; the mark that follows them; and the one for two different words or more that have them.
BEGINNINGS = (4, 5, 6, 7, 8)
MARK = b"*"
TWICE = b"+"


def held_out() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 == 1


def terms_of(word: bytes) -> list[bytes]:
    return [word, *(word[:n] + MARK for n in BEGINNINGS if len(word) > n)]


class TermNumbers(dict):
    """The numbers of the known terms of a word, remembered for CACHE words."""

    def __init__(self, terms: list[bytes]):
        super().__init__()
        self.number = {t: i for i, t in enumerate(terms)}
        self.once = {t.removesuffix(TWICE) for t in terms}

    def __missing__(self, word: bytes) -> list[bytes]:
        if len(self) > CACHE:
            self.clear()
        found = self[word] = [t for t in terms_of(word) if t in self.once]
        return found

    def of(self, text: bytes | None) -> list[int]:
        count: dict[bytes, int] = {}
        for word in set(words(text or b"")):
            for t in self[word]:
                count[t] = count.get(t, 0) + 1
        return sorted(n for t, k in count.items() for n in (self.number.get(t), self.number.get(t + TWICE) if k > 1 else None) if n is not None)


@dataclass
class Model:
    terms: list[bytes]
    weights: np.ndarray
    bias: float
    voters: list[bytes]
    accuracy: np.ndarray
    correlated: np.ndarray


def labelled_sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """text and toxic of a bounded sample of labelled documents that are not held out."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size), "sample-ids")
    own = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")
    least = F.min(F.struct(F.xxhash64("text").alias("check"), "text", "toxic")).alias("r")
    return stored(own.groupBy("doc_id").agg(least).select("doc_id", "r.text", "r.toxic"), "sample")


def telling_terms(sample: DataFrame, most: int) -> list[bytes]:
    """Terms of toxic texts, most telling first; of words and beginnings that say the same the shortest is kept."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[bytes, list[int]] = {}

        def counted() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(list(rows), pa.binary()), pa.array([n[0] for n in rows.values()], pa.int64()), pa.array([n[1] for n in rows.values()], pa.int64())], names=["term", "n", "bad"])
            rows.clear()
            return found

        for batch in batches:
            for text, toxic in zip(batch.column(0).cast(pa.binary()).to_pylist(), batch.column(1).to_pylist(), strict=True):
                here: dict[bytes, int] = {}
                for word in set(words(text or b"")):
                    for t in terms_of(word):
                        here[t] = here.get(t, 0) + 1
                for term in [*here, *(t + TWICE for t, k in here.items() if k > 1)]:
                    n = rows.setdefault(term, [0, 0])
                    n[0] += 1
                    n[1] += toxic
                if len(rows) > COUNTED:
                    yield counted()
        yield counted()

    all_, bad = sample.agg(F.count("*"), F.sum("toxic")).first()
    if not bad or bad == all_:
        return []
    counts = map_batches(sample.select("text", "toxic"), count, "term binary, n long, bad long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    ratio = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("n") - F.col("bad") + 0.5) / (all_ - bad + 1))
    best = counts.filter(F.col("bad") >= SUPPORT).select("term", (ratio * F.sqrt("bad")).alias("score"), ratio.alias("ratio")).filter("ratio > 2")
    out: list[bytes] = []
    for row in best.orderBy(F.desc("score"), "term").limit(20 * most).collect():
        term = bytes(row["term"])
        if len(out) < most and not any(_alike(term, o) for o in out):
            out.append(term)
    return out


def _alike(a: bytes, b: bytes) -> bool:
    """Of the same kind, and one begins with the other."""
    a, b = sorted((a, b), key=len)
    return a.endswith(TWICE) == b.endswith(TWICE) and (a == b or MARK in a and b.startswith(a.partition(MARK)[0]))


def vote_counts(docs: DataFrame, voters: list[bytes]) -> tuple[int, np.ndarray]:
    """Documents, and the documents in which each pair of voters votes (on the diagonal: each voter), over the whole table."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, pairs, total = TermNumbers(voters), np.zeros((len(voters), len(voters)), np.int64), 0
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                votes = numbers.of(text)
                total += 1
                if votes:
                    pairs[np.ix_(votes, votes)] += 1
        i, j = np.nonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array([-1, *i], pa.int32()), pa.array([-1, *j], pa.int32()), pa.array([total, *pairs[i, j]], pa.int64())], names=["i", "j", "n"])

    sums = map_batches(docs.select("text"), count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    total, out = 0, np.zeros((len(voters), len(voters)), np.int64)
    for i, j, n in sums.collect():  # a row for each pair of voters at most
        if i < 0:
            total = n
        else:
            out[i, j] = n
    return total, out


def label_model(total: int, pairs: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """P(vote | toxic), P(vote | not), the correlated pairs, and the weight of having no vote at all."""
    m = len(pairs)
    rate = np.diag(pairs) / max(1, total)
    cov = pairs / max(1, total) - np.outer(rate, rate)
    np.fill_diagonal(cov, 0)
    squares = np.zeros(m)
    for i in range(m):
        others = [j for j in range(m) if j != i and cov[i, j] > 1e-9]
        got = [cov[i, j] * cov[i, k] / cov[j, k] for x, j in enumerate(others) for k in others[x + 1 :] if cov[j, k] > 1e-9]
        squares[i] = np.median(got) if got else rate[i] * (1 - rate[i]) / 2
    spread = np.sqrt(np.clip(squares, 0, None) / max(prior * (1 - prior), 1e-6))  # P(vote | toxic) - P(vote | not)
    bad = np.clip(rate + (1 - prior) * spread, 1e-6, 0.999)
    good = np.clip(rate - prior * spread, 1e-6, 0.999)
    bad = np.maximum(bad, good)
    variance = np.sqrt(np.clip(np.outer(rate * (1 - rate), rate * (1 - rate)), 1e-18, None))
    correlated = (cov - np.outer(spread, spread) * prior * (1 - prior)) / variance > 0.3
    none = float(np.clip(np.log1p(-bad).sum() - np.log1p(-good).sum(), -6, 0))
    return bad, good, correlated, none


def posterior(votes: list[int], bad: np.ndarray, good: np.ndarray, correlated: np.ndarray, none: float, prior: float) -> float:
    x = np.log(prior / (1 - prior))
    if votes:
        share = 1 + correlated[np.ix_(votes, votes)].sum(axis=1)  # correlated voters share one weight
        x += float((np.log(bad[votes] / good[votes]) / share).sum())
    else:
        x += none
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(rows: list[list[int]], targets: np.ndarray, features: int, penalty: float = 1.0) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by Newton steps."""
    x = np.zeros((len(rows), features + 1))
    x[:, -1] = 1
    for i, own in enumerate(rows):
        x[i, own] = 1
    w = np.zeros(features + 1)
    keep = np.full(features + 1, penalty)
    keep[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (targets - p) - keep * w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> Model:
    sample = labelled_sample(docs, labels)
    found = telling_terms(sample, FEATURES)
    lexicon = [w.encode() for w in LEXICON]
    terms = [*lexicon, *(t for t in found if t not in lexicon)][:FEATURES]
    voters = terms[:VOTERS]
    share = sample.agg(F.avg("toxic")).first()[0]
    prior = float(np.clip(0.1 if share is None else share, 0.01, 0.5))
    total, pairs = vote_counts(docs, voters)
    bad, good, correlated, none = label_model(total, pairs, prior)
    known, numbers = TermNumbers(terms), []

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([known.of(t) for t in batch.column(0).cast(pa.binary()).to_pylist()], pa.list_(pa.int32()))], names=["numbers"])

    numbers = [r[0] for r in map_batches(sample.orderBy("doc_id").select("text"), number, "numbers array<int>").collect()]  # SAMPLE rows at most
    if not numbers:
        numbers = [[i] for i in range(len(voters))] + [[]] * max(1, 9 * len(voters))
    soft = np.array([posterior([n for n in own if n < len(voters)], bad, good, correlated, none, prior) for own in numbers])
    weights, bias = fit_linear(numbers, soft, len(terms))
    return Model(terms, weights, bias, voters, bad - good, correlated)


def score_toxicity(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with _score."""
    at, terms, weights, bias = docs.columns.index("text"), model.terms, model.weights, model.bias

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = TermNumbers(terms)
        for batch in batches:
            sums = np.array([bias + weights[numbers.of(t)].sum() for t in batch.column(at).cast(pa.binary()).to_pylist()], np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(sums, -30, 30))))], names=[*batch.schema.names, "_score"])

    return map_batches(docs, score, StructType([*docs.schema.fields, StructField("_score", DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_toxicity(docs.select(F.col("doc_id"), F.col("text")), fit_toxicity(docs, labels))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` that are not judged toxic."""
    return score_toxicity(docs, fit_toxicity(docs, labels)).filter(F.col("_score") < THRESHOLD).drop("_score")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
