"""Readers and writers of the JSON, HTML, image and answer files around the flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T

VERSION = "1.0"
_RUN = "STRUCT<type: STRING, node_id: STRING, children: ARRAY<STRUCT<type: STRING, text: STRING, break_type: STRING, checked: BOOLEAN>>>"
_STYLE = "STRUCT<style_name: STRING, alignment: STRING, num_id: STRING>"
_PARAGRAPH = f"STRUCT<type: STRING, node_id: STRING, style: {_STYLE}, children: ARRAY<{_RUN}>>"
_CELL = f"STRUCT<colspan: INT, rowspan: INT, vmerge: STRING, width_twips: INT, children: ARRAY<{_PARAGRAPH}>>"
_BLOCK = f"STRUCT<type: STRING, node_id: STRING, style: {_STYLE}, children: ARRAY<{_RUN}>, rows: ARRAY<STRUCT<height_twips: INT, cells: ARRAY<{_CELL}>>>>"
TREE = f"version STRING, sections ARRAY<STRUCT<kind: STRING, blocks: ARRAY<{_BLOCK}>>>"


def read_ast_json(spark: SparkSession, path: str) -> DataFrame:
    """doc_key and sections of stored trees; trees of another version are left out."""
    trees = spark.read.schema(TREE).json(path, multiLine=True).withColumn("doc_key", F.input_file_name())
    return trees.filter(F.col("version") == VERSION).select("doc_key", "sections")


def blocks_of(trees: DataFrame) -> DataFrame:
    """doc_key, section_ix, section_kind, block_ix, block_type, node_id, style and runs; headers, body, footers in this order."""
    sections = trees.select("doc_key", F.posexplode("sections").alias("section_ix", "s"))
    blocks = sections.select("doc_key", "section_ix", F.col("s.kind").alias("section_kind"), F.posexplode("s.blocks").alias("block_ix", "b"))
    return blocks.select("doc_key", "section_ix", "section_kind", "block_ix", F.col("b.type").alias("block_type"), "b.node_id", "b.style", F.col("b.children").alias("runs"), F.col("b.rows").alias("rows"))


def cells_of_blocks(blocks: DataFrame) -> DataFrame:
    """The cells of tables: places, text of the cell's own paragraphs, checkbox_count, colspan, rowspan, vmerge, width_twips and node_ids."""
    rows = blocks.filter("block_type = 'table'").select("doc_key", "section_ix", "section_kind", "block_ix", F.posexplode("rows").alias("row_ix", "r"))
    cells = rows.select("doc_key", "section_ix", "section_kind", "block_ix", "row_ix", F.posexplode("r.cells").alias("cell_ix", "c"))
    own = F.filter("c.children", lambda p: p["type"] == "paragraph")
    items = lambda p: F.flatten(F.transform(p["children"], lambda r: r["children"]))
    kind = lambda i: F.when(i["type"] != "break", i["type"]).when(i["break_type"] == "tab", "tab").otherwise("line")
    text = lambda p: T.py_strip(F.array_join(F.transform(items(p), lambda i: T.token_piece(kind(i), i["text"])), ""))
    texts = F.filter(F.transform(own, text), lambda t: t != "")
    boxes = F.size(F.filter(F.flatten(F.transform(own, items)), lambda i: i["type"] == "checkbox"))
    ids = F.flatten(F.transform(own, lambda p: F.concat(F.array(p["node_id"]), F.transform(p["children"], lambda r: r["node_id"]))))
    return cells.select("doc_key", "section_ix", "section_kind", "block_ix", "row_ix", "cell_ix", F.array_join(texts, " ").alias("text"), boxes.alias("checkbox_count"), "c.colspan", "c.rowspan", "c.vmerge", "c.width_twips", F.array_distinct(F.filter(ids, lambda x: x.isNotNull())).alias("node_ids"))


def tokens_of_blocks(blocks: DataFrame) -> DataFrame:
    """Inline tokens of paragraphs: text, tab, line, page or checkbox."""
    runs = blocks.filter("block_type = 'paragraph'").select("doc_key", "section_ix", "block_ix", F.col("node_id").alias("para_node_id"), F.posexplode("runs").alias("run_no", "r"))
    items = runs.select("doc_key", "section_ix", "block_ix", "para_node_id", "run_no", F.col("r.node_id").alias("node_id"), F.posexplode("r.children").alias("item_ix", "i"))
    kind = F.when(F.col("i.type") != "break", F.col("i.type")).when(F.col("i.break_type").isin("tab", "page"), F.col("i.break_type")).otherwise("line")
    return items.select("doc_key", "section_ix", "block_ix", "para_node_id", "node_id", "run_no", "item_ix", kind.alias("kind"), "i.text", "i.checked")


def write_html(documents: DataFrame, path: str) -> None:
    """One row for each document under its key; a table of pages scales better than files of whole documents."""
    documents.write.mode("overwrite").parquet(path)


def pdf_models(routes: DataFrame, pages: DataFrame, regions: DataFrame) -> DataFrame:
    """doc_id and the page model as JSON: route and pages with their regions, without image bytes."""
    region = F.struct("id", "page", "type", F.struct("x", "y", "w", "h").alias("box"), "value", F.col("acro_field_name").alias("acroFieldName"))
    own = regions.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(region)).alias("regions"))
    page = F.struct(F.col("page").alias("index"), "width_pt", "height_pt", "regions")
    listed = pages.join(own, ["doc_id", "page"], "left").groupBy("doc_id").agg(F.sort_array(F.collect_list(page)).alias("pages"))
    return routes.join(listed, "doc_id").select("doc_id", F.to_json(F.struct("route", "pages")).alias("model"))


def write_pdf_model(routes: DataFrame, pages: DataFrame, regions: DataFrame, path: str) -> None:
    pdf_models(routes, pages, regions).write.mode("overwrite").parquet(path)


def read_page_images(spark: SparkSession, path: str, side: str) -> DataFrame:
    """Page rasters as Spark's image source decodes them; the page number ends the file name."""
    images = spark.read.format("image").option("recursiveFileLookup", "true").load(path).select("image.*")
    return images.select(F.regexp_extract("origin", r"^(.*)/[^/]*$", 1).alias("doc_key"), F.regexp_extract("origin", r"-(\d+)\.png$", 1).try_cast("int").alias("page"), F.lit(side).alias("side"), "width", "height", "data")


def llm_request_batch(prompts: DataFrame, task: str, path: str) -> None:
    """A JSON line for each document that has blocks, for an external batch."""
    asked = prompts.filter("blocks > 0").select(F.to_json(F.struct(F.col("doc_key").alias("custom_id"), F.lit(task).alias("task"), F.col("prompt"))).alias("value"))
    asked.write.mode("overwrite").text(path)


def llm_response_source(spark: SparkSession, path: str, documents: DataFrame) -> DataFrame:
    """doc_key and raw answer of every document; null where there is none.  Answer files are named by document."""
    answers = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("doc_key"), F.col("value").alias("raw"))
    return documents.select("doc_key").distinct().join(answers, "doc_key", "left")
