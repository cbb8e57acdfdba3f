"""Archives to HTML: everything that ``render`` reads, from the nodes of the archives.

Rows of all inputs carry the document, their section (part) and their place, so the renderer puts them together without a
join.  Explicit page breaks cut the body's own paragraphs, and blocks behind them are numbered anew; those in tables, headers and footers
are line breaks.  Images are joined as data URIs, by path, last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import render, structure, styles
from ..sources import docx_io, properties
from ..sources.scratch import kept

_OLD = ["doc_key", "old_block_ix"]


def _linked(tokens: DataFrame, nodes: DataFrame, images: DataFrame | None) -> DataFrame:
    """``tokens`` with href of links and src of images, from the relationships of their parts."""
    rels = docx_io.rels_of(nodes)
    named = tokens.withColumnRenamed("doc_key", "doc_id")
    linked = styles.resolve_hyperlinks(named.withColumnsRenamed({"rel_id": "_rel", "link_id": "rel_id"}), rels).drop("rel_id").withColumnRenamed("_rel", "rel_id")
    if images is not None:
        some = named.filter("kind = 'image' and rel_id is not null").select("doc_id", "part_name", "rel_id", F.struct("part_ord", "seq").alias("token_id"))
        paths = styles.resolve_images(some, rels, images.select(F.col("doc_key").alias("doc_id"), "media_path"))
        uris = paths.join(images.select(F.col("doc_key").alias("doc_id"), "media_path", F.col("uri").alias("src")), ["doc_id", "media_path"]).select("doc_id", "token_id.part_ord", "token_id.seq", "src")
        linked = linked.join(uris, ["doc_id", "part_ord", "seq"], "left")
    return linked.withColumnRenamed("doc_id", "doc_key")


def body_breaks(nodes: DataFrame, tokens: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """The body's blocks as they are after explicit page breaks: doc_key, old_block_ix, seg, block_ix, block_type, page_break_before and break_row."""
    blocks = structure.build_blocks(nodes).filter("section_kind = 'body'").select("doc_key", "block_ix", "block_type")
    body = tokens.filter("section_kind = 'body' and place is not null")
    own = body.filter("size(place) = 1")
    split = structure.split_blocks(blocks, own.filter("kind not in ('empty', 'rendered')"))
    named = own.groupBy("doc_key", F.col("block_ix").alias("old_block_ix")).agg(F.min("para_node_id").alias("para_node_id"))
    cuts = own.filter("kind = 'page' and not linked").select("doc_key", F.col("block_ix").alias("old_block_ix")).distinct().withColumn("_cut", F.lit(True))
    asked = paragraphs.filter("section_kind = 'body' and size(place) = 1 and page_break_before").select("doc_key", F.get("place", F.lit(0)).alias("old_block_ix"), F.lit(True).alias("_asked"))
    hints = structure.rendered_break_hints(body.filter("not nested and not linked")).select("doc_key", F.col("block_ix").alias("old_block_ix"), "row_ix", "at_start")
    joined = split.join(cuts, _OLD, "left").join(asked, _OLD, "left").join(hints, _OLD, "left").join(named, _OLD, "left")
    hinted = F.col("_cut").isNull() & F.col("at_start").isNotNull()
    before = F.col("break_before") | (F.col("_asked").isNotNull() & F.col("_cut").isNull())
    inside = hinted & ~before & ~F.col("at_start")
    return joined.select(*_OLD, "seg", "block_ix", "block_type", (before | (hinted & F.col("at_start"))).alias("page_break_before"), F.when(inside, F.coalesce("row_ix", F.lit(0))).alias("break_row"), "para_node_id")


def _renumbered(rows: DataFrame, breaks: DataFrame, *more: str) -> DataFrame:
    """``rows`` whose place in the body begins with the number that their block has now."""
    now = breaks.select("doc_key", F.col("old_block_ix").alias("_old"), *more, F.col("block_ix").alias("_now"))
    old = F.when(F.col("section_kind") == "body", F.get("place", F.lit(0)))
    joined = rows.withColumn("_old", old).join(now, ["doc_key", "_old", *more], "left").filter("section_kind <> 'body' or _now is not null")
    moved = F.when(F.col("_now").isNotNull(), F.concat(F.array("_now"), F.slice("place", 2, F.size("place")))).otherwise(F.col("place"))
    return joined.withColumn("place", moved).drop("_old", "_now", *more)


def document_parts(nodes: DataFrame, images: DataFrame | None = None) -> dict[str, DataFrame]:
    """tokens, cells, paragraphs, breaks, columns and setup for ``render``; images(doc_key, media_path, uri).

    What several of them read is written to the shared folder once, so it is neither computed twice nor lost with an executor.
    """
    found = kept(properties.properties_of(nodes), "properties")
    tokens = kept(docx_io.tokens_of(nodes), "tokens")
    paragraphs = kept(properties.paragraph_properties(found, docx_io.styles_of(nodes), docx_io.numbering_of(nodes)), "paragraphs")
    breaks = kept(body_breaks(nodes, tokens, paragraphs), "breaks")
    shown = _linked(tokens.filter("place is not null and kind <> 'rendered'"), nodes, images)
    runs = properties.run_properties(found).withColumnRenamed("seq", "run_seq")
    shown = shown.join(runs, ["doc_key", "part_ord", "run_seq"], "left").join(properties.image_properties(nodes), ["doc_key", "part_ord", "seq"], "left")
    # Tokens by part of their paragraph, whose runs are counted anew; breaks that cut go.
    own = (F.col("section_kind") == "body") & (F.size("place") == 1)
    cut = own & (F.col("kind") == "page") & ~F.col("linked")
    whole = Window.partitionBy("doc_key", "part_ord", "place")
    shown = shown.withColumn("_split", F.bool_or(cut).over(whole)).withColumn("seg", F.when(F.col("section_kind") == "body", F.sum(cut.cast("int")).over(whole.orderBy("run_ix")).cast("int"))).filter(~(cut | ((F.col("kind") == "empty") & F.col("_split"))))
    runs_in_order = F.dense_rank().over(Window.partitionBy("doc_key", "part_ord", "place", "seg").orderBy("run_no")) - 1
    shown = shown.withColumn("run_no", F.when(F.col("run_no") < 0, F.col("run_no")).otherwise(runs_in_order)).withColumn("section_ix", F.col("part_ord"))
    shown = _renumbered(shown, breaks, "seg").drop("block_ix", "row_ix", "cell_ix", "para_ix", "_split")
    first = breaks.filter("seg = 0 or block_type = 'table'")
    return {
        "tokens": shown, "cells": _renumbered(properties.styled_cells(nodes, found), first), "paragraphs": _renumbered(paragraphs, breaks), "breaks": breaks,
        "columns": _renumbered(properties.grid_columns(found), first), "setup": properties.page_properties(nodes, found),
    }


def convert(blobs: DataFrame) -> DataFrame:
    """doc_key and html (a whole page of the web) of each document in blobs(doc_key, content); broken archives have none.  Archives are shredded once."""
    return _converted(docx_io.shred_docx(blobs, docx_io.NODE_COLUMNS), docx_io.media_of(blobs))


def convert_files(files: DataFrame) -> DataFrame:
    """``convert`` of files(doc_key) that tasks open themselves, members of one kind at a time (``read_documents`` without the contents)."""
    return _converted(docx_io.shred_files(files, docx_io.NODE_COLUMNS), docx_io.media_files(files))


def _converted(shredded: DataFrame, media: DataFrame) -> DataFrame:
    nodes = kept(shredded, "nodes")
    parts = document_parts(nodes, docx_io.media_data_uris(media))
    return render.wrap_html(render.render_html(**parts), render.page_css(parts["setup"]))
