"""Fill regions of page layouts: widgets of form documents, labels of flat ones, and what is stamped on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

KINDS = ("text", "checkbox", "combobox")


def pdf_route(pages: DataFrame, widgets: DataFrame) -> DataFrame:
    """acroform if any page of the document has any widget, else flat."""
    form = widgets.select("doc_id").distinct().withColumn("_form", F.lit(True))
    return pages.select("doc_id").distinct().join(form, "doc_id", "left").select("doc_id", F.when(F.col("_form"), "acroform").otherwise("flat").alias("route"))


def acroform_regions(widgets: DataFrame) -> DataFrame:
    """Text, checkbox and combobox widgets, numbered on their page."""
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("widget_ord")) - 1
    kind = F.when(F.col("field_type") == "checkbox", "checkbox").otherwise("text")
    kept = widgets.filter(F.col("field_type").isin(*KINDS))
    return kept.select("doc_id", "page", F.format_string("p%d_w%d", F.col("page"), n).alias("id"), kind.alias("type"), "x", "y", "w", "h", F.lit("").alias("value"), F.col("field_name").alias("acro_field_name"))


def flat_regions(pages: DataFrame, spans: DataFrame) -> DataFrame:
    """Space right of a line that ends with a colon, if it has 15 percent of the page's width."""
    items = F.sort_array(F.collect_list(F.struct("span_ord", "text")))
    lines = spans.groupBy("doc_id", "page", "block", "line").agg(F.array_join(items["text"], "").alias("_text"), F.max_by("x1", "span_ord").alias("_right"), F.min("y0").alias("_top"), F.max("y1").alias("_bottom"))
    width = F.col("width_pt") - F.col("_right") - 10
    found = lines.filter(T.py_strip(F.col("_text")).endswith(":")).join(pages, ["doc_id", "page"]).withColumn("w", width).filter("w >= width_pt * 0.15")
    n = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("block", "line")) - 1
    return found.select("doc_id", "page", F.format_string("p%d_r%d", F.col("page"), n).alias("id"), F.lit("text").alias("type"), (F.col("_right") + 4).alias("x"), F.col("_top").alias("y"), "w", F.greatest(F.col("_bottom") - F.col("_top"), F.lit(12.0)).alias("h"), F.lit("").alias("value"), F.lit(None).cast("string").alias("acro_field_name"))


def pdf_regions(pages: DataFrame, spans: DataFrame, widgets: DataFrame) -> DataFrame:
    """Widgets of form documents, label spaces of the others."""
    route = pdf_route(pages, widgets)
    of = lambda kind: route.filter(F.col("route") == kind).select("doc_id")
    return acroform_regions(widgets).join(of("acroform"), "doc_id", "left_semi").unionByName(flat_regions(pages, spans).join(of("flat"), "doc_id", "left_semi"))


def fill_regions(regions: DataFrame, values: DataFrame) -> DataFrame:
    new = values.select("doc_id", "page", "id", F.col("value").alias("_new"))
    return regions.join(new, ["doc_id", "page", "id"], "left").withColumn("value", F.coalesce("_new", "value")).drop("_new")


def fit_fontsize(unit_width: Column, w: Column, h: Column) -> Column:
    """From 0.7 of the height, 11 at most, down by halves while a text of ``unit_width`` (at size 1) is wider than the box; 4 at least."""
    largest = F.least(h * 0.7, F.lit(11.0))
    sizes = F.transform(F.sequence(F.lit(0), F.lit(14)), lambda n: largest - n * 0.5)
    fits = F.filter(sizes, lambda s: (s <= 4.0) | (s * unit_width <= w))
    return F.greatest(F.element_at(fits, 1), F.lit(4.0))


def stamp_plan(regions: DataFrame, pages: DataFrame, glyphs: DataFrame, missing: float = 0.5) -> DataFrame:
    """What is stamped where: a widget's value, or free text with a font size that fits its box and its alignment.

    ``glyphs(char, width)`` are the widths of a font's characters at size 1; characters that it lacks count as ``missing``.
    """
    key = ["doc_id", "page", "id"]
    stamped = regions.withColumn("stamp", T.stamp_value(F.col("type"), F.col("value"))).filter("stamp is not null").join(pages.select("doc_id", "page").distinct(), ["doc_id", "page"], "left_semi")
    free = F.coalesce("acro_field_name", F.lit("")) == ""
    chars = stamped.filter(free).select(*key, F.explode(F.split("stamp", "")).alias("char")).groupBy(*key, "char").agg(F.count("*").alias("_n"))
    widths = chars.join(glyphs.groupBy("char").agg(F.max("width").alias("width")), "char", "left").groupBy(*key).agg(F.sum(F.col("_n") * F.coalesce("width", F.lit(missing))).alias("_units"))
    out = stamped.join(widths, key, "left")
    return out.select(*key, "stamp", F.when(free, "free_text").otherwise("widget").alias("way"), F.when(free, fit_fontsize(F.col("_units"), F.col("w"), F.col("h"))).alias("font_size"), F.when(free, F.when(F.col("type") == "checkbox", "center").otherwise("left")).alias("align"))


def region_percent_box(x: Column, y: Column, w: Column, h: Column, page_width: Column, page_height: Column) -> Column:
    """A region's box in percent of its page, for overlays."""
    share = lambda part, whole: part / whole * 100
    return F.struct(share(x, page_width).alias("left"), share(y, page_height).alias("top"), share(w, page_width).alias("width"), share(h, page_height).alias("height"))


def filled_regions(regions: DataFrame) -> DataFrame:
    return regions.groupBy("doc_id").agg(F.count_if(F.coalesce("value", F.lit("")) != "").alias("filled"), F.count("*").alias("total"))
