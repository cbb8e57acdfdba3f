"""Fillable fields: rules on paragraphs and table rows, parsed suggestions, merging and measures.

Tables are keyed by doc_key and position.  Field rows have doc_key, field_ord (place in the document), label, type,
value, confidence, block, para, node_ids, raw_label, raw_value and origin.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

FIELD_TYPES = ("text", "date", "checkbox", "choice", "number", "multiline")


def _text(name: str) -> Column:
    return F.lit(None).cast("string").alias(name)


def paragraph_texts(tokens: DataFrame) -> DataFrame:
    """text, checkbox_count, has_tab and node_ids of each paragraph of the body."""
    piece = T.token_piece(F.col("kind"), F.col("text"))
    items = F.sort_array(F.collect_list(F.struct("run_ix", piece.alias("piece"), "node_id")))
    grouped = tokens.groupBy("doc_key", "block_ix").agg(items.alias("_items"), F.min("para_node_id").alias("_para"), F.count_if(F.col("kind") == "checkbox").alias("checkbox_count"), F.bool_or(F.col("kind") == "tab").alias("has_tab"))
    ids = F.filter(F.array_distinct(F.concat(F.array("_para"), F.col("_items.node_id"))), lambda x: x.isNotNull())
    return grouped.select("doc_key", "block_ix", F.array_join(F.col("_items.piece"), "").alias("text"), "checkbox_count", "has_tab", ids.alias("node_ids"))


def fields_from_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """Checkbox, colon and underscore rules; the colon rule stops, the checkbox rule does not."""
    p = paragraphs.withColumn("t", T.py_strip(F.col("text"))).filter("t <> ''")
    ticked = T.py_strip(T.strip_checkbox_glyphs(F.col("text")))
    left, right = F.substring_index("t", ":", 1), F.expr("substring(t, instr(t, ':') + 1)")
    p = p.withColumns({"_ticked": ticked, "_left": T.py_strip(left), "_right": right, "_value": T.py_strip(right), "_at": F.regexp_instr("t", F.lit(T.PLACEHOLDER))})
    p = p.withColumn("_before", F.when(F.col("_at") > 0, T.py_strip(F.expr("substring(t, 1, _at - 1)"))))
    none = F.lit(None).cast("string")

    def made(rule: int, label: Column, kind: Column, value: Column, confidence: Column, raw_label: Column, raw_value: Column) -> Column:
        return F.struct(F.lit(rule).alias("rule"), label.alias("label"), kind.alias("type"), value.alias("value"), confidence.alias("confidence"), raw_label.alias("raw_label"), raw_value.alias("raw_value"))

    boxed = (F.col("checkbox_count") > 0) & (F.col("_ticked") != "")
    colon = F.col("t").contains(":") & (F.col("_left") != "")
    blank = ~colon & (F.col("_at") > 0) & (F.col("_before") != "")
    marked = T.has_placeholder(F.col("_right")) | F.col("has_tab")
    rules = F.array(
        F.when(boxed, made(1, F.col("_ticked"), F.when(F.col("checkbox_count") > 1, "choice").otherwise("checkbox"), none, F.lit(0.9), F.col("t"), none)),
        F.when(colon, made(2, F.col("_left"), T.guess_type(F.col("_left"), F.col("_value")), T.normalize_value(F.col("_value")), F.when(marked, 0.85).otherwise(0.6), F.concat(left, F.lit(":")), F.col("_value"))),
        F.when(blank, made(3, F.col("_before"), T.guess_type(F.col("_before"), F.lit("")), none, F.lit(0.8), F.col("_before"), T.py_strip(F.expr("substring(t, _at)")))),
    )
    found = p.select("doc_key", F.col("block_ix").alias("block"), F.lit(0).alias("row"), F.lit(0).alias("para"), "node_ids", F.explode_outer(F.filter(rules, lambda r: r.isNotNull())).alias("r"))
    return found.filter("r is not null").select("doc_key", "block", "row", "para", "r.*", "node_ids")


def fields_from_tables(cells: DataFrame) -> DataFrame:
    """A field for each row of two cells or more whose first is a label and that is no heading row.

    The field's nodes are those of the label and the value, if the cells have node_ids.
    """
    of = lambda ix, c: F.max(F.when(F.col("cell_ix") == ix, F.col(c)))
    none = F.array().cast("array<string>")
    ids = [F.array_distinct(F.concat(F.coalesce(of(0, "node_ids"), none), F.coalesce(of(1, "node_ids"), none)))] if "node_ids" in cells.columns else [F.first(none)]
    rows = cells.groupBy("doc_key", "block_ix", "row_ix").agg(F.count("*").alias("_n"), T.py_strip(of(0, "text")).alias("label"), T.py_strip(F.coalesce(of(1, "text"), F.lit(""))).alias("_value"), of(1, "checkbox_count").alias("_boxes"), ids[0].alias("node_ids"))
    placed = T.has_placeholder(F.col("_value"))
    label, value = F.col("label"), F.col("_value")
    rows = rows.filter((F.col("_n") >= 2) & (label != "") & (label.contains(":") | label.contains("?") | (F.col("_boxes") > 0) | placed))
    boxed = F.col("_boxes") > 0
    kind = F.when(F.col("_boxes") > 1, "choice").when(boxed, "checkbox").otherwise(T.guess_type(label, value))
    confidence = F.when(boxed, 0.85).when((value == "") | placed, 0.8).otherwise(0.6)
    return rows.select(
        "doc_key", F.col("block_ix").alias("block"), F.col("row_ix").alias("row"), F.lit(0).alias("para"), F.lit(0).alias("rule"), "label", kind.alias("type"), F.when(~boxed, T.normalize_value(value)).alias("value"),
        confidence.alias("confidence"), label.alias("raw_label"), value.alias("raw_value"), "node_ids",
    )


def extract_fields(tokens: DataFrame, cells: DataFrame, dealt: bool = False) -> DataFrame:
    """All rule fields of a document in order of block, row and rule, numbered from 1.

    Both tables are dealt by document once, or not at all if they are ``dealt`` in parts of one number already; groups by
    paragraph and row and the numbering need no further shuffle.
    """
    if not dealt:
        tokens, cells = tokens.repartition("doc_key"), cells.repartition("doc_key")
    every = fields_from_paragraphs(paragraph_texts(tokens)).unionByName(fields_from_tables(cells))
    order = Window.partitionBy("doc_key").orderBy("block", "row", "rule")
    return every.withColumn("field_ord", F.row_number().over(order)).withColumn("id", T.field_id(F.col("field_ord"))).withColumn("origin", F.lit("rule"))


def parse_field_suggestions(responses: DataFrame) -> DataFrame:
    """Fields that a model suggested; what is malformed is dropped or set to its default."""
    listed = responses.select("doc_key", F.from_json(T.extract_json(F.col("raw")), "fields ARRAY<STRING>").alias("j"))
    items = listed.select("doc_key", F.posexplode_outer("j.fields").alias("ord", "item")).filter("item is not null and item like '{%'")
    item = items.select("doc_key", "ord", F.from_json("item", "label STRING, type STRING, block INT, para INT, confidence STRING, labelText STRING, valueText STRING").alias("i"))
    label, kind = T.py_strip(F.coalesce(F.col("i.label"), F.lit(""))), T.py_strip(F.coalesce(F.col("i.type"), F.lit("text")))
    score = F.coalesce(F.nanvl(F.col("i.confidence").try_cast("double"), F.lit(0.45)), F.lit(0.45))
    return item.filter(label != "").select(
        "doc_key", "ord", label.alias("label"), F.when(kind.isin(*FIELD_TYPES), kind).otherwise("text").alias("type"), F.coalesce("i.block", F.lit(-1)).alias("block"), F.coalesce("i.para", F.lit(0)).alias("para"),
        F.round(F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)), 3).alias("confidence"), F.col("i.labelText").alias("raw_label"), F.col("i.valueText").alias("raw_value"),
    )


def merge_fields(rules: DataFrame, suggested: DataFrame, dealt: bool = False) -> DataFrame:
    """All rule fields, then suggestions whose merge key is new, numbered anew.

    Rules and suggestions are one table from the start, so that the rules are made once; a suggestion is new if it is the
    first row of its merge key, rules before suggestions.  Rows are dealt by document unless both tables are ``dealt`` already.
    """
    one = rules.select("doc_key", F.lit(0).alias("_kind"), F.col("field_ord").alias("_ord"), "label", "type", "value", "confidence", "block", "para", F.lit("rule").alias("origin"))
    two = suggested.select("doc_key", F.lit(1).alias("_kind"), F.col("ord").alias("_ord"), "label", "type", _text("value"), "confidence", "block", "para", F.lit("ai").alias("origin"))
    every = one.unionByName(two)
    every = (every if dealt else every.repartition("doc_key")).withColumn("merge_key", T.merge_key(F.col("label"), F.col("block"), F.col("para")))
    place = F.row_number().over(Window.partitionBy("doc_key", "merge_key").orderBy("_kind", "_ord"))
    kept = every.withColumn("_n", place).filter("_kind = 0 or _n = 1")
    numbered = kept.withColumn("field_ord", F.row_number().over(Window.partitionBy("doc_key").orderBy("_kind", "_ord")))
    return numbered.withColumn("id", T.field_id(F.col("field_ord"))).drop("_kind", "_ord", "_n")


def extraction_gain(fields: DataFrame) -> DataFrame:
    return fields.groupBy("doc_key").agg(F.count_if(F.col("origin") == "rule").alias("rule_fields"), F.count("*").alias("all_fields"))


def fill_progress(fields: DataFrame) -> DataFrame:
    """Filled and all fields of a document; a checkbox counts as filled once it has a value."""
    filled = F.coalesce(T.py_strip(F.col("value")) != "", F.lit(False)) | ((F.col("type") == "checkbox") & F.col("value").isNotNull())
    return fields.groupBy("doc_key").agg(F.count_if(filled).alias("filled"), F.count("*").alias("total"))


def field_errors(fields: DataFrame) -> DataFrame:
    return fields.groupBy("doc_key").agg(F.bool_or(T.validate_field(F.col("type"), F.col("value")).isNotNull()).alias("has_errors"), F.count_if(T.validate_field(F.col("type"), F.col("value")).isNotNull()).alias("errors"))


def field_prompt(paragraphs: DataFrame, cells: DataFrame) -> DataFrame:
    """The blocks of a document as a prompt has them: texts cut at 240 characters, tables at 6 rows, 4 cells, 80 characters."""
    text = paragraphs.filter(T.py_strip(F.col("text")) != "").select("doc_key", F.col("block_ix").alias("block"), F.to_json(F.struct("block_ix", F.left(T.py_strip(F.col("text")), F.lit(240)).alias("text"), (F.col("checkbox_count") > 0).alias("has_checkbox"))).alias("json"))
    some = cells.filter("row_ix < 6 and cell_ix < 4")
    rows = some.groupBy("doc_key", "block_ix", "row_ix").agg(F.sort_array(F.collect_list(F.struct("cell_ix", F.left(T.py_strip(F.col("text")), F.lit(80)).alias("text")))).alias("c"))
    tables = rows.groupBy("doc_key", "block_ix").agg(F.sort_array(F.collect_list(F.struct("row_ix", F.col("c.text").alias("cells")))).alias("r"))
    tables = tables.select("doc_key", F.col("block_ix").alias("block"), F.to_json(F.struct("block_ix", F.col("r.cells").alias("rows"))).alias("json"))
    blocks = text.unionByName(tables).groupBy("doc_key").agg(F.sort_array(F.collect_list(F.struct("block", "json"))).alias("b"))
    return blocks.select("doc_key", F.size("b").alias("blocks"), F.concat(F.lit("["), F.array_join("b.json", ","), F.lit("]")).alias("prompt"))
