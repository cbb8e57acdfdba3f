"""Quality rules: hashed n-gram log-likelihood ratio between trusted and raw text, with fixed base rules.

Words and pairs of neighbouring words are hashed into BUCKETS buckets.  Two add-one-smoothed multinomials are counted,
one over all documents (raw) and one over the documents labelled as trusted (target).  A document's score is the mean
over its n-grams of log(target / raw), in whole millionths, so that all sums are exact and every run gives the same
verdicts.  One trusted document in CALIBRATION, by a hash of its id, is not counted as target: such documents score as
unseen ones do, and the threshold is a fixed number of standard deviations below their mean score.
Documents without words have no score; the base rules fail them.

Everything is built from SQL functions: texts are split and hashed inside one projection, the counts of a bucket are
combined before they are shuffled (BUCKETS rows for each task), and the model, one number for each bucket, has a
fixed size whatever the input.

Null text: no words, base_failed.  Ties: equal texts have equal scores, and a score at the threshold is kept.  Very long
texts: their words are held by one row.  Labels of unknown documents, repeated labels and extra columns change nothing;
without any trusted document nothing but the base rules decides.  Empty table: no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

BUCKETS = 10_000
#: Standard deviations below the trusted mean at which a document is dropped.
DEVIATIONS = 4.0
#: Share of the trusted documents that set the threshold, one in so many.
CALIBRATION = 4
#: Trusted documents that the target is counted on and the threshold set on, about so many at most, by a hash of the id: a
#: bound on labelled rows, so that their ids are broadcast and no text is shuffled at any size.  All documents are raw.
TRUSTED = 1_000_000
SCALE = 1_000_000
SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _hashed(docs: DataFrame) -> DataFrame:
    """Adds w (words), h (their hashes) and grams (buckets of words and of pairs of neighbours); null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = F.split(F.btrim("text", F.lit(SPACE)), r"[\x20\x09-\x0D]+")
    none = F.array().cast("array<string>")
    split = docs.withColumn("text", text).withColumn("w", F.when(F.btrim("text", F.lit(SPACE)) == "", none).otherwise(parts))
    hashed = split.withColumn("h", F.expr("transform(w, x -> xxhash64(x))"))
    single = f"transform(h, x -> CAST(pmod(x, {BUCKETS}) AS int))"
    pairs = f"CASE WHEN size(h) > 1 THEN transform(sequence(1, size(h) - 1), i -> CAST(pmod(xxhash64(h[i - 1], h[i]), {BUCKETS}) AS int)) ELSE CAST(array() AS array<int>) END"
    return hashed.withColumn("grams", F.expr(f"concat({single}, {pairs})"))


def trusted_ids(labels: DataFrame, most: int = TRUSTED) -> DataFrame:
    """doc_id of the trusted documents, stored; of more than ``most`` those in a share of the hash values."""
    found = stored(labels.filter("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "trusted")
    n = found.count()
    return found if n <= most else found.filter(F.pmod(F.xxhash64("doc_id", F.lit("trusted")), F.lit(1 << 32)) < (most << 32) // n)


def gram_ratios(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """Millionths of log(target / raw) by bucket: a model of fixed size, counted over all documents; all 0 without ``trusted``."""
    marked = docs.select("doc_id", "text").join(F.broadcast(trusted.withColumn("_target", F.lit(1))), "doc_id", "left")  # TRUSTED rows
    # Not explode(): the filter that it infers would be pushed below the arrays and build them anew for each element.
    rows = _hashed(marked).select(F.coalesce("_target", F.lit(0)).alias("_target"), F.explode_outer("grams").alias("bucket")).filter("bucket is not null")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("_target").alias("target"))
    raw, target = [0] * BUCKETS, [0] * BUCKETS
    for r in counts.collect():  # BUCKETS rows at most
        raw[r["bucket"]], target[r["bucket"]] = r["raw"], r["target"]
    if not sum(target):
        return [0] * BUCKETS
    shift = math.log((sum(raw) + BUCKETS) / (sum(target) + BUCKETS))
    return [round(SCALE * (math.log((t + 1) / (r + 1)) + shift)) for t, r in zip(target, raw, strict=True)]


def score_documents(docs: DataFrame, ratios: list[int]) -> DataFrame:
    """doc_id, the base counts and score (mean millionths; null without words) of every document."""
    model = F.split(F.lit(" ".join(map(str, ratios))), " ").cast("array<bigint>")  # folded to one constant
    windows = "CASE WHEN size(h) > 2 THEN sort_array(transform(sequence(0, size(h) - 3), i -> struct(xxhash64(h[i], h[i + 1], h[i + 2]) AS x, i AS i))) ELSE CAST(array() AS array<struct<x: bigint, i: int>>) END"
    again = "transform(filter(windows, (s, j) -> coalesce(s.x = get(windows, j - 1).x, false) OR coalesce(s.x = get(windows, j + 1).x, false)), s -> s.i)"
    has_word = lambda x: F.btrim(x, F.lit(SPACE)) != ""
    read = _hashed(docs.select("doc_id", "text")).withColumn("windows", F.expr(windows)).withColumn("lines", F.filter(F.split("text", "\n"), has_word))
    read = read.withColumn("again", F.sort_array(F.expr(again)))
    covered = "aggregate(transform(again, (v, j) -> least(3, coalesce(get(again, j + 1) - v, 3))), 0L, (a, b) -> a + b)"
    return read.select(
        "doc_id",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.translate("text", SPACE, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr(covered).alias("n_repeat_words"),
        F.when(F.size("grams") > 0, F.floor(F.aggregate("grams", F.lit(0).cast("long"), lambda a, g: a + F.get(model, g)) / F.size("grams"))).alias("score"),
    )


def threshold(scored: DataFrame, trusted: DataFrame) -> float | None:
    """DEVIATIONS below the mean score of the trusted documents, from exact sums."""
    of = scored.filter("score is not null").join(F.broadcast(trusted), "doc_id", "left_semi")
    wide = F.col("score").cast("decimal(20,0)")
    n, one, two = of.agg(F.count("*"), F.sum(wide), F.sum((wide * wide).cast("decimal(38,0)"))).first()
    if not n:
        return None
    mean = float(one) / n
    return mean - DEVIATIONS * math.sqrt(max(0.0, float(two) / n - mean * mean))


def judge_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and score."""
    trusted = trusted_ids(labels).withColumn("_part", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION)))
    scored = stored(score_documents(docs, gram_ratios(docs, trusted.filter("_part > 0").select("doc_id"))), "scored")
    least = threshold(scored, trusted.filter("_part = 0").select("doc_id"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    judged = scored.withColumn("base_failed", failed)
    passed = F.lit(True) if least is None else F.coalesce(F.col("score") >= least, F.lit(False))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return judged.select(*columns, (~F.col("base_failed") & passed).alias("kept"), (F.col("score") / SCALE).alias("score"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
