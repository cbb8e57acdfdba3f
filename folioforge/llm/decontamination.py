"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

A document is contaminated by an item if it holds at least 75 percent of the item's distinct 5-word shingles.
Words are runs of letters and digits (non-ASCII characters included) with A-Z lower-cased.

Items are partitioned by the number n of their shingles (powers of two; an item under five words is its own single
shingle, in partitions by word count).  A partition's sketch width follows from its upper bound u, so that no pair can
be missed: an item keeps its bottom-k MinHash values with k = floor(u / 4) + 1 (all if it has fewer), and since at
most floor(n / 4) of its shingles may be absent, a document that reaches the threshold has ``k - floor(n / 4)`` of
them or more.  Documents whose shingles hit a sketch that often are candidates; these alone are looked at again, and a
shared shingle counts only if its words are equal, not just its hash.

The sketch and the items' shingles are broadcast if the item table is small (checked), else joined by shuffle.
Null or wordless items match nothing, null texts hold nothing, repeated items and documents give a row each pair of
ids once, an empty table gives no rows.  ``contaminations`` leaves documents without an id out, ``decontaminate`` does
not.  Ties: a document at exactly 75 percent is contaminated.  Very long texts: all of their shingles.  Extra columns are ignored by ``contaminations``, passed by ``decontaminate``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, lower_ascii, stored, table

WORDS = 5
PERCENT = 75
#: What stands between words: every ASCII character but digits and small letters (capitals are lowered before).
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bound on rows (shingles of items) of a broadcast side.
ITEM_SHINGLES = 1_000_000


def words(text: Column) -> Column:
    """The words of a text; null gives none."""
    spaced = F.btrim(F.regexp_replace(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN, " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def shingle_hashes(words: str, size: int) -> Column:
    """64-bit hashes of the shingles of ``size`` words in order of place; none if there are too few words."""
    parts = ", ".join(f"_w[i + {k}]" if k else "_w[i]" for k in range(size)).replace("_w", words)
    return F.expr(f"CASE WHEN size({words}) >= {size} THEN transform(sequence(0, size({words}) - {size}), i -> xxhash64({parts})) ELSE CAST(array() AS array<bigint>) END")


def item_shingles(items: DataFrame) -> DataFrame:
    """item_id, width (words of a shingle), n_item_shingles, hash, shingle: a row for each distinct shingle."""
    whole = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("w")).filter("item_id is not null and size(w) > 0")
    width = F.least(F.lit(WORDS), F.size("w"))
    cut = whole.withColumn("width", width).withColumn("i", F.explode(F.expr("sequence(0, size(w) - width)")))
    rows = cut.select("item_id", "width", F.expr("array_join(slice(w, i + 1, width), ' ')").alias("shingle"))
    rows = rows.distinct().withColumn("hash", F.expr("xxhash64(" + ", ".join(f"get(split(shingle, ' '), {k})" for k in range(WORDS)) + ")"))
    sizes = rows.groupBy("item_id").agg(F.countDistinct("shingle").alias("n_item_shingles"))
    return rows.join(sizes, "item_id")


def sketches(shingles: DataFrame) -> DataFrame:
    """The rows of ``shingles`` that are in their item's bottom-k sketch, with ``needed``, the hits a candidate has."""
    upper = F.pow(F.lit(2), F.ceil(F.log2("n_item_shingles"))).cast("long")  # of the size partition
    width = F.least("n_item_shingles", F.floor(upper * (100 - PERCENT) / 100).cast("long") + 1)
    absent = F.floor(F.col("n_item_shingles") * (100 - PERCENT) / 100).cast("long")
    bottom = shingles.groupBy("item_id").agg(F.sort_array(F.collect_set("hash")).alias("all"))  # an item is short by definition
    kept = shingles.join(bottom, "item_id").filter(F.col("hash") <= F.element_at("all", F.least(width, F.size("all")).cast("int")))
    return kept.withColumn("needed", F.greatest(F.lit(1), F.least(width, F.size("all")) - absent)).drop("all")


def _hits(docs: DataFrame, items: DataFrame, widths: list[int]) -> DataFrame:
    """doc_id, item columns and place of every shingle of a document that has the hash of one of ``items``."""
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text")).alias("w"))
    found = []
    for width in widths:
        # Not posexplode(): the filter that it infers would be pushed below the arrays and build them anew for each element.
        placed = whole.select("doc_id", "w", F.posexplode_outer(shingle_hashes("w", width)).alias("place", "hash"))
        # xxhash64 skips nulls, so the hash of fewer words is that of the item's side above.
        found.append(placed.join(items.filter(F.col("width") == width), "hash"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def contaminations(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, n_item_shingles, n_shared and containment of every pair that reaches the threshold."""
    shingles = stored(item_shingles(items), "item-shingles")
    widths = sorted(r[0] for r in shingles.select("width").distinct().collect()) or [WORDS]  # five at most
    sketch = broadcast_if_small(stored(sketches(shingles).select("item_id", "width", "hash", "needed").distinct(), "sketches"), ITEM_SHINGLES)
    known = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")

    near = _hits(known, sketch, widths).groupBy("doc_id", "item_id", "needed").agg(F.count_distinct("hash").alias("hits")).filter("hits >= needed")
    near = stored(near.select("doc_id", "item_id"), "candidates")
    ids = broadcast_if_small(stored(near.select("doc_id").distinct(), "candidate-ids"))

    again = known.join(ids, "doc_id", "left_semi")
    equal = _hits(again, broadcast_if_small(shingles, ITEM_SHINGLES), widths).filter("shingle = array_join(slice(w, place + 1, width), ' ')")
    shared = equal.groupBy("doc_id", "item_id", "n_item_shingles").agg(F.count_distinct("shingle").alias("n_shared"))
    pairs = shared.join(near, ["doc_id", "item_id"], "left_semi").filter(100 * F.col("n_shared") >= PERCENT * F.col("n_item_shingles"))
    return pairs.select("doc_id", "item_id", "n_item_shingles", "n_shared", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the rows that any item contaminates; each row by its own text, whether or not it has an id or shares it."""
    key = F.xxhash64("doc_id", "text")
    bad = stored(contaminations(docs.select(key.alias("doc_id"), "text"), items).select(F.col("doc_id").alias("_row")).distinct(), "contaminated")
    return docs.withColumn("_row", key).join(broadcast_if_small(bad), "_row", "left_anti").select(*docs.columns)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP10_SQL = r"""
WITH words AS (
  SELECT 0 AS side, doc_id AS id, string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ') AS w
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
  UNION ALL
  SELECT 1, item_id, string_split(trim(regexp_replace(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ')
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
item AS (
  SELECT DISTINCT id AS item_id, least(5, len(w)) AS width, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS shingle
  FROM (SELECT *, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM words WHERE side = 1 AND w <> [''])),
n AS (SELECT item_id, count(DISTINCT shingle) AS n_item_shingles FROM item GROUP BY 1),
widths AS (SELECT DISTINCT width FROM item),
doc AS (
  SELECT DISTINCT id AS doc_id, width, array_to_string(w[i : i + width - 1], ' ') AS shingle
  FROM (SELECT id, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM words, widths WHERE side = 0))
SELECT doc_id, item_id, n_item_shingles, count(DISTINCT shingle) AS n_shared, count(DISTINCT shingle) / n_item_shingles AS containment
FROM doc JOIN item USING (width, shingle) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item_shingles HAVING 100 * count(DISTINCT shingle) >= 75 * n_item_shingles
"""
