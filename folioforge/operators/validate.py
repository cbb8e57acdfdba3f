"""Checks that nothing was lost: element counts, equal renderings, page image differences."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

METRICS = ("paragraphs", "tables", "images")
CHANGED = 5


def html_structure_counts(html: DataFrame) -> DataFrame:
    """Paragraphs and headings, tables and images that a page's HTML opens."""
    count = lambda tags: F.regexp_count("html", F.lit(rf"(?i)<(?:{tags})\b"))
    return html.select("doc_id", count("p|h[1-6]").alias("paragraphs"), count("table").alias("tables"), count("img").alias("images"))


def validate_structure(counts: DataFrame, html_counts: DataFrame) -> DataFrame:
    """Valid if no metric differs; mismatches as metric=left/right, joined by semicolons.  A document that one side lacks differs in all."""
    a, b = counts.alias("a"), html_counts.alias("b")
    both = a.join(b, F.col("a.doc_id") == F.col("b.doc_id"), "full")
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    parts = [F.when(~F.col(f"a.{m}").eqNullSafe(F.col(f"b.{m}")), F.concat(F.lit(f"{m}="), shown(f"a.{m}"), F.lit("/"), shown(f"b.{m}"))) for m in METRICS]
    mismatch = F.concat_ws(";", *parts)
    return both.select(F.coalesce("a.doc_id", "b.doc_id").alias("doc_id"), (mismatch == "").alias("valid"), mismatch.alias("mismatches"))


def render_stability(first: DataFrame, second: DataFrame) -> DataFrame:
    """Whether two renderings of a document are equal byte by byte."""
    digest = F.sha2(F.encode("html", "utf-8"), 256)
    return first.select("doc_id", digest.alias("a")).join(second.select("doc_id", digest.alias("b")), "doc_id").select("doc_id", (F.col("a") == F.col("b")).alias("stable"), F.col("a").alias("sha256"))


@F.pandas_udf(StructType([StructField("mean_diff", DoubleType()), StructField("max_diff", IntegerType()), StructField("changed_pct", DoubleType())]))
def _compare(a: pd.Series, b: pd.Series, same_size: pd.Series, pixels: pd.Series) -> pd.DataFrame:
    rows = []
    for x, y, same, n in zip(a, b, same_size, pixels, strict=True):
        if x is None or y is None or not same or len(x) != len(y) or not len(x) or not n or len(x) % int(n):
            rows.append((1.0, 255, 100.0))
            continue
        d = np.abs(np.frombuffer(x, np.uint8).astype(np.int16) - np.frombuffer(y, np.uint8).astype(np.int16)).reshape(int(n), -1)
        rows.append((round(float(d.mean()), 4), int(d.max()), round(float((d > CHANGED).any(axis=1).mean() * 100), 2)))
    return pd.DataFrame(rows, columns=["mean_diff", "max_diff", "changed_pct"])


def page_diff(candidate: DataFrame, reference: DataFrame) -> DataFrame:
    """Mean and largest channel difference and share of changed pixels of each page (doc_id, page, width, height, data).

    A page without a partner, of another size, or whose bytes are no whole number of channels for each pixel is wholly
    changed (mean 1, largest 255, 100 percent).  in_candidate and in_reference say which side has the page.
    """
    side = lambda d, n: d.select("doc_id", "page", F.col("data").alias(f"_{n}"), F.struct("width", "height").alias(f"_size_{n}"), (F.col("width") * F.col("height")).cast("double").alias(f"_px_{n}"))
    both = side(candidate, "a").join(side(reference, "b"), ["doc_id", "page"], "full")
    here = lambda n: F.col(f"_size_{n}").isNotNull()
    d = _compare("_a", "_b", (here("a") & here("b") & F.coalesce(F.col("_size_a") == F.col("_size_b"), F.lit(False))), F.coalesce("_px_a", F.lit(0.0)))
    return both.select("doc_id", "page", d.alias("d"), here("a").alias("in_candidate"), here("b").alias("in_reference")).select("doc_id", "page", "d.*", "in_candidate", "in_reference")


def diff_summary(diffs: DataFrame, limit: float = 15.0) -> DataFrame:
    """Pages of each side, compared and changed ones, the mean of the pages' means, and whether a document is identical or passes."""
    mean, both = F.bround(F.avg("mean_diff"), 4), F.col("in_candidate") & F.col("in_reference")
    return diffs.groupBy("doc_id").agg(
        F.count_if("in_candidate").alias("candidate_pages"), F.count_if("in_reference").alias("reference_pages"), F.count_if(both).alias("compared"), F.count_if(F.col("changed_pct") > 0).alias("changed"),
        mean.alias("mean_diff"), (F.bool_and(both) & (F.max("max_diff") == 0)).alias("identical"), (mean < limit).alias("passed"),
    )


def corpus_report(blocks: DataFrame, *parts: DataFrame) -> DataFrame:
    """Blocks by kind of each document, with any further table of one row a document."""
    out = blocks.groupBy("doc_id").agg(F.count("*").alias("blocks"), F.count_if(F.col("block_type") == "table").alias("table_blocks"), F.count_if(F.col("num_id").isNotNull()).alias("list_items"))
    for part in parts:
        out = out.join(part, "doc_id", "left")
    return out
