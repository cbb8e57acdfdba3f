"""Quality classifier: a factorisation machine.

Features of a text: hashed words, hashed marks of words (what is left of a word without letters and digits), and structure
statistics as bins of fixed bounds (lengths, shares of marks, capitals, digits, repeated words, repeated lines, neighbours
that are equal, long words, line lengths), and whole-number columns of metadata (METADATA, those that the table has) as bins
by size.  Words and marks have a norm of 1 together, and so have bins.

    y(x) = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j,    the last term being sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2) / 2

so a text of m features is scored in m * FACTORS steps.  The score is 1 / (1 + exp(-y)), the probability of label 1.

Training: at most SAMPLE labelled documents, chosen by a hash of the id, are turned into features where they are and dealt to
parts of about PART_ROWS.  In each of ROUNDS jobs every part makes a pass of AdaGrad steps from the common model and the
models are averaged (iterative parameter mixing), so no task holds more than a part and the driver holds one model
((FACTORS + 1) * FEATURES numbers).  The steps are the same in each run.  Labels are read only where crc32 of the id in decimal modulo 5 is not 0; labels, lang,
source and doc_id are no inputs of a score.

Null or wordless texts: scored by their bins.  Metadata that are null, negative or no numbers: no bin.  A repeated id: each row is scored; for training the text of least checksum
counts.  Repeated labels: the least.  Labels that are null or of unknown documents are ignored.  Without labels, or with
labels of one kind, the score is the share of label 1 with an added 1 and 2 (0.5 without labels).  Empty table: no rows.
Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_batches, stored, table

#: Labelled documents that the machine is trained on, at most.
SAMPLE = 20_000
#: Numbers of hashed features and of bins; sizes of the model.
HASHED, BINS, FACTORS = 1 << 15, 16, 8
#: Rows of a part of the sample, about; passes over it; AdaGrad's step, shrinking and rows of a step.
PART_ROWS, ROUNDS, STEP, PENALTY, BATCH_ROWS = 4000, 12, 0.1, 1e-5, 16
THRESHOLD = 0.3
#: Seed of the first factors.
SEED = 13
_CAPITALS, _DIGITS = bytes(range(65, 91)), bytes(range(48, 58))
_PLAIN = bytes([*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])
_MARKS = bytes(b for b in range(33, 127) if b not in _PLAIN)
_STATISTICS = 12
#: Columns of metadata: the length that the source states.
METADATA = ("n_chars",)
FEATURES = HASHED + (_STATISTICS + len(METADATA)) * BINS


def held_out() -> Column:
    return F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 5 == 0, F.lit(False))


def statistics(text: bytes, words: list[bytes], distinct: int) -> list[int]:
    """The bin of each structure statistic and of the text's size."""
    n, size = len(words), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    share = lambda part, whole: min(BINS - 1, int((BINS - 1) * (part / max(1, whole)) ** 0.5 + 0.999))
    level = lambda x: min(BINS - 1, int(log2(1 + x)))
    without = lambda some: len(text) - len(text.translate(None, some))
    longest = max(map(len, lines), default=0)
    return [
        level(n), level(len(text) / 4), share(without(_MARKS), size), share(without(_CAPITALS), size), share(without(_DIGITS), size), share(n - distinct, n), share(len(lines) - len(set(lines)), len(lines)),
        share(sum(map(eq, words, words[1:])), n), level(n / max(1, len(lines))), level(longest / 4), share(sum(len(w) > 15 for w in words), n), min(BINS - 1, int(2 * sum(map(len, words)) / max(1, n))),
    ]


def features_of(text: bytes | None, metadata: tuple[int | None, ...] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers and values of the features of a whole text and its metadata."""
    text = text or b""
    words = text.split()  # at the bytes that are white space in ASCII
    count = Counter(words)
    hashed = [crc32(w.lower()) % HASHED for w in count]
    times = list(count.values())
    for w, n in count.items():
        if marks := w.translate(None, _PLAIN):
            hashed.append(crc32(marks, 1) % HASHED)
            times.append(n)
    numbers, back = np.unique(np.array(hashed, np.int64), return_inverse=True)
    values = np.sqrt(np.bincount(back, times, len(numbers)))
    norm = np.sqrt((values**2).sum())
    levels = statistics(text, words, len(count)) + [None if m is None or m < 0 else min(BINS - 1, int(log2(4 + m)) - 2) for m in metadata]
    bins = np.array([HASHED + k * BINS + b for k, b in enumerate(levels) if b is not None])
    return np.concatenate([numbers, bins]), np.concatenate([values / norm if norm else values, np.full(len(bins), len(bins) ** -0.5)])


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def scores(self, numbers: np.ndarray, values: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 of texts whose features stand one after the other up to ``ends``; each has some."""
        v = self.factors[numbers] * values[:, None]
        starts = np.concatenate([[0], ends[:-1]])
        sums = np.add.reduceat(v, starts)
        squares = np.add.reduceat((v * v).sum(axis=1), starts)
        y = self.bias + np.add.reduceat(self.weights[numbers] * values, starts) + ((sums * sums).sum(axis=1) - squares) / 2
        return 1 / (1 + np.exp(-np.clip(y, -30, 30)))


def first_machine(bias: float = 0.0) -> Machine:
    return Machine(bias, np.zeros(FEATURES), np.random.default_rng(SEED).normal(0, 0.1, (FEATURES, FACTORS)))


def trained_on(machine: Machine, rows: list[tuple[np.ndarray, np.ndarray, float]]) -> Machine:
    """A pass of AdaGrad steps on the log loss over rows of numbers, values and label, BATCH_ROWS at a time."""
    bias, w, v = machine.bias, machine.weights.copy(), machine.factors.copy()
    g_bias, g_w, g_v = 1e-2, np.full(w.shape, 1e-2), np.full(v.shape, 1e-2)
    for at in range(0, len(rows), BATCH_ROWS):
        some = rows[at : at + BATCH_ROWS]
        numbers, values = (np.concatenate([r[k] for r in some]) for k in (0, 1))
        sizes = np.array([len(r[0]) for r in some])
        starts = np.cumsum(sizes) - sizes
        xv = v[numbers] * values[:, None]
        sums = np.add.reduceat(xv, starts)
        y = bias + np.add.reduceat(w[numbers] * values, starts) + ((sums * sums).sum(axis=1) - np.add.reduceat((xv * xv).sum(axis=1), starts)) / 2
        error = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - np.array([r[2] for r in some])) / len(some)
        own = np.repeat(error, sizes) * values
        seen, back = np.unique(numbers, return_inverse=True)
        d_w = np.bincount(back, own, len(seen)) + PENALTY * w[seen]
        slope = own[:, None] * (np.repeat(sums, sizes, axis=0) - xv)
        d_v = np.stack([np.bincount(back, slope[:, f], len(seen)) for f in range(FACTORS)], axis=1) + PENALTY * v[seen]
        g_bias += error.sum() ** 2
        g_w[seen] += d_w**2
        g_v[seen] += d_v**2
        bias -= STEP * error.sum() / g_bias**0.5
        w[seen] -= STEP * d_w / np.sqrt(g_w[seen])
        v[seen] -= STEP * d_v / np.sqrt(g_v[seen])
    return Machine(bias, w, v)


def _inputs(docs: DataFrame) -> list[Column]:
    """The text and the metadata, null where the table has none."""
    return [F.col("text").cast("binary").alias("text"), *[(F.col(m).try_cast("long") if m in docs.columns else F.lit(None).cast("long")).alias(m) for m in METADATA]]


def _features(batch: pa.RecordBatch, text: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each row: ``text`` is the place of its text, which metadata follow."""
    metadata = zip(*(batch.column(text + 1 + k).to_pylist() for k in range(len(METADATA))), strict=True)
    return [features_of(t, m) for t, m in zip(batch.column(text).to_pylist(), metadata, strict=True)]


def labelled_features(docs: DataFrame, labels: DataFrame, size: int = SAMPLE) -> DataFrame:
    """part, place, numbers, values and label of a bounded sample of labelled documents that are not held out."""
    known = labels.filter("doc_id is not null and quality is not null").filter(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("_label"))
    some = stored(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(size), "quality-ids")

    parts = max(1, -(-some.count() // PART_ROWS))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _features(batch, 2)
            checks = [crc32(t or b"") for t in batch.column(2).to_pylist()]
            lists = [pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(checks, pa.int64()), *lists], names=["doc_id", "label", "_check", "numbers", "values"])

    own = docs.select("doc_id", *_inputs(docs)).join(F.broadcast(some), "doc_id").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("_label").cast("double").alias("label"), "text", *METADATA)
    rows = map_batches(own, extract, "doc_id long, label double, _check long, numbers array<int>, values array<double>")
    one = rows.groupBy("doc_id").agg(F.min(F.struct("_check", "label", "numbers", "values")).alias("_r"))
    place = F.xxhash64("doc_id", F.lit(SEED))
    return stored(one.select(F.pmod(place, F.lit(parts)).cast("int").alias("part"), place.alias("place"), "doc_id", "_r.label", "_r.numbers", "_r.values"), "quality-sample")


def fit_machine(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, rounds: int = ROUNDS) -> Machine:
    sample = labelled_features(docs, labels, size)
    n, good = sample.agg(F.count("*"), F.coalesce(F.sum(F.col("label")), F.lit(0.0))).first()
    prior = (good + 1) / (n + 2)
    if good in (0, n):
        return Machine(float(np.log(prior / (1 - prior))), np.zeros(FEATURES), np.zeros((FEATURES, FACTORS)))
    machine = first_machine(float(np.log(prior / (1 - prior))))
    for _ in range(rounds):
        machine = _mixed(sample, machine)
    return machine


def _mixed(sample: DataFrame, machine: Machine) -> Machine:
    """The mean of what the parts make of ``machine``, weighted by their rows."""

    def learn(part: pa.Table) -> pa.Table:
        part = part.sort_by([("place", "ascending"), ("doc_id", "ascending")])
        rows = list(zip(*(map(np.array, part.column(c).to_pylist()) for c in ("numbers", "values")), part.column("label").to_pylist(), strict=True))
        out = trained_on(machine, rows)
        whole = np.concatenate([[out.bias], out.weights, out.factors.ravel()])
        return pa.table({"part": [part.column("part")[0].as_py()], "n": [len(rows)], "model": [whole.tobytes()]})

    found = sorted(sample.groupBy("part").applyInArrow(learn, "part long, n long, model binary").collect())  # a model for each part of the bounded sample
    models = np.average([np.frombuffer(r["model"]) for r in found], axis=0, weights=[r["n"] for r in found])
    return Machine(float(models[0]), models[1 : FEATURES + 1], models[FEATURES + 1 :].reshape(FEATURES, FACTORS))


def score_quality(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of every row of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            found = _features(batch, 1)
            if found:
                numbers, values = (np.concatenate([f[k] for f in found]) for k in (0, 1))
                ends = np.cumsum([len(f[0]) for f in found])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.scores(numbers, values, ends))], names=["doc_id", "score"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_inputs(docs)), score, "doc_id long, score double")


def classify_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score_quality(docs, fit_machine(docs, labels))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
