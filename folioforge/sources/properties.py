"""Properties of archives as tables: one pass over the nodes gives each property element its owner.

A property element stands in a group (``pPr``, ``tcBorders`` and so on) under the paragraph, run, cell, row, table, page or
style that it belongs to.  A node's path names them, so the pass is a projection; the tables below are groups over it,
keyed by document and part and by the owner's place (positions from the section down, as ``operators.render`` has them).
The first element of a kind counts, and an empty value is none.  Ancestors' paragraphs, runs and cells never count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import structure, styles
from . import docx_io
from .docx_io import path_to, place

#: The owner and the group of property elements, and groups inside of groups.
GROUPS = ("p/pPr", "r/rPr", "tc/tcPr", "tr/trPr", "tbl/tblPr", "tbl/tblGrid", "body/sectPr", "style/pPr", "style/rPr", "style/tblPr")
NESTED = ("numPr", "tcBorders", "tblBorders", "tblCellMar")
DEFAULTS = ("rPrDefault", "pPrDefault")
EDGES = ("top", "left", "bottom", "right", "insideH", "insideV")
BORDER = "struct<style:string,width_pt:double,color:string>"


def _at(back: int, part: str = "tag") -> Column:
    return F.try_element_at("path", F.lit(-back))[part]


def properties_of(nodes: DataFrame) -> DataFrame:
    """doc_id, part_ord, section_kind, owner (its tag), owner_seq, place, group, tag, attrs, text and seq of every property element.

    The groups themselves are rows, too (tag and group are the same).  docDefaults own what their defaults hold.
    """
    plain = F.concat_ws("/", _at(3), _at(2)).isin(*GROUPS)
    inner = _at(2).isin(*NESTED) & F.concat_ws("/", _at(4), _at(3)).isin(*GROUPS)
    itself = F.concat_ws("/", _at(2), _at(1)).isin(*GROUPS)
    default = _at(3).isin(*DEFAULTS) & (_at(4) == "docDefaults")
    back = F.when(itself, 1).when(plain, 2).when(inner | default, 3)
    found = nodes.filter("error is null").withColumn("_back", back).filter("_back is not null")
    owner = F.try_element_at("path", -(F.col("_back") + 1))
    return found.select(
        F.col("doc_key").alias("doc_id"), "part_ord", "section_kind", owner["tag"].alias("owner"), owner["seq"].alias("owner_seq"), place(path_to(F.col("_back"))).alias("place"),
        F.when(itself, F.col("tag")).otherwise(_at(2)).alias("group"), "tag", "attrs", "text", "seq",
    )


def first(tag: str, key: str = "val", group: str | None = None) -> Column:
    """An attribute of the first element of this tag (in this group); empty is none."""
    own = (F.col("tag") == tag) & (F.col("group") != F.col("tag")) if group is None else (F.col("tag") == tag) & (F.col("group") == group)
    return F.nullif(F.min_by(F.struct(F.col("attrs")[key].alias("v")), F.when(own, F.col("seq")))["v"], F.lit(""))


def border_map(group: str, edges: tuple[str, ...] = EDGES) -> Column:
    """Style, width and colour by edge; an edge without a style, or with none or nil, is not in it."""
    entries = []
    for edge in edges:
        style, size, color = (first(edge, key, group) for key in ("val", "sz", "color"))
        line = F.struct(F.when(style == "double", "double").otherwise("solid").alias("style"), F.coalesce(F.bround(size.try_cast("int") / 8, 2), F.lit(0.5)).alias("width_pt"), F.coalesce(F.nullif(F.upper(color), F.lit("AUTO")), F.lit("000000")).alias("color"))
        entries.append(F.when(style.isNotNull() & ~style.isin("none", "nil"), F.struct(F.lit(edge), line.cast(BORDER))))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e.isNotNull()))


def margin_map() -> Column:
    """Cell margins in twips by edge."""
    entries = [F.struct(F.lit(edge), first(edge, "w", "tblCellMar").try_cast("int").alias("w")) for edge in EDGES[:4]]
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["w"].isNotNull()))


_KEY = ["doc_id", "section_kind", "part_ord", "place"]


def paragraph_properties(properties: DataFrame, names: DataFrame, numbering: DataFrame) -> DataFrame:
    """Style, css and list of each paragraph that has properties: doc_key, section_kind, section_ix, place and what ``render`` reads."""
    own = properties.filter("owner = 'p' and place is not null").withColumn("para", F.col("place"))
    flat = styles.paragraph_styles(own, names.filter("style_type = 'paragraph' and name is not null"), ["doc_id", "section_kind", "part_ord", "para"])
    listed = styles.resolve_lists(flat, numbering)
    css = styles.paragraph_css({n: F.col(n) for n in ("alignment", "space_before", "space_after", "space_line", "indent_left", "indent_right", "indent_first", "indent_hanging")})
    return listed.select(F.col("doc_id").alias("doc_key"), "section_kind", F.col("part_ord").alias("section_ix"), F.col("para").alias("place"), "style_name", css.alias("css"), "num_id", "list_ordered", "list_marker", "page_break_before")


def run_properties(properties: DataFrame) -> DataFrame:
    """doc_key, part_ord, seq and style of each run that has properties."""
    own = properties.filter("owner = 'r' and group = 'rPr'").withColumn("run", F.col("owner_seq"))
    return styles.run_styles(own, ["doc_id", "part_ord", "run"]).withColumnsRenamed({"doc_id": "doc_key", "run": "seq"})


def raw_cells(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """Every cell (continued ones, too) in every table: place, table (its place), row_ix, cell_ix, colspan, vmerge, width, height and own style.

    A cell without ``tcPr`` has no style; one without an alignment has that of its first paragraph.
    """
    cells = nodes.filter("tag = 'tc'").select(F.col("doc_key").alias("doc_id"), "section_kind", "part_ord", place(F.col("path")).alias("place"), F.lit("tc").alias("owner"), F.lit("tc").alias("group"), "tag", "attrs", "seq")
    paras = nodes.filter("tag = 'p'").filter(_at(2) == "tc").select(F.col("doc_key").alias("doc_id"), "section_kind", "part_ord", place(path_to(1)).alias("place"), F.lit("first").alias("owner"), F.lit("tc").alias("group"), "tag", "attrs", "seq")
    aligned = properties.filter("owner = 'p' and tag = 'jc' and size(place) > 1").withColumns({"seq": F.col("owner_seq"), "place": F.slice("place", 1, F.greatest(F.size("place") - 1, F.lit(0))), "owner": F.lit("paragraph")})
    own = properties.filter("owner = 'tc'")
    every = cells.unionByName(paras).unionByName(own.select(*cells.columns)).unionByName(aligned.select(*cells.columns)).filter("place is not null")
    of = lambda tag, key="val", group="tcPr": first(tag, key, group)
    has = lambda tag: F.coalesce(F.bool_or((F.col("tag") == tag) & (F.col("owner") == "tc")), F.lit(False))
    top = F.min(F.when(F.col("owner") == "first", F.col("seq")))
    jc = F.min_by(F.struct(F.col("attrs")["val"].alias("v"), "seq"), F.when(F.col("owner") == "paragraph", F.col("seq")))
    fill = F.nullif(F.upper(of("shd", "fill")), F.lit("AUTO"))
    flat = every.groupBy(*_KEY).agg(
        F.greatest(F.coalesce(of("gridSpan").try_cast("int"), F.lit(1)), F.lit(1)).alias("colspan"), F.when(has("vMerge"), F.when(of("vMerge") == "restart", "restart").otherwise("continue")).otherwise("").alias("vmerge"), of("tcW", "w").try_cast("int").alias("width_twips"),
        of("vAlign").alias("v_align"), F.when(has("tcPr"), F.coalesce(of("jc"), F.when(jc["seq"] == top, F.nullif(jc["v"], F.lit(""))))).alias("alignment"), fill.alias("fill"), border_map("tcBorders", EDGES[:4]).alias("cell_borders"),
        F.bool_or(F.col("tag") == "tc").alias("_there"),
    ).filter("_there")
    rows = properties.filter("owner = 'tr' and place is not null").groupBy(*_KEY[:3], F.col("place").alias("_row")).agg(first("trHeight", group="trPr").try_cast("int").alias("height_twips"))
    n = F.size("place")
    flat = flat.select(*_KEY, F.slice("place", 1, n - 2).alias("table"), F.get("place", n - 2).alias("row_ix"), F.get("place", n - 1).alias("cell_ix"), F.slice("place", 1, n - 1).alias("_row"), *flat.columns[4:-1])
    return flat.join(rows, [*_KEY[:3], "_row"], "left").drop("_row")


def table_style_sheet(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """doc_id, style_id, based_on, borders and cell_margins of the table styles."""
    names = docx_io.styles_of(nodes).filter("style_type = 'table'").select("doc_id", "style_id", "based_on")
    starts = nodes.filter("section_kind = 'styles' and tag = 'style'").select(F.col("doc_key").alias("doc_id"), F.col("seq").alias("owner_seq"), F.col("attrs")["styleId"].alias("style_id"))
    own = properties.filter("owner = 'style'").groupBy("doc_id", "owner_seq").agg(border_map("tblBorders").alias("borders"), margin_map().alias("cell_margins"))
    return names.join(starts.join(own, ["doc_id", "owner_seq"], "left").drop("owner_seq"), ["doc_id", "style_id"], "left")


def table_properties(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """tbl_borders and cell_margins of every table by place: those of its style's chain under its own."""
    own = properties.filter("owner = 'tbl' and place is not null").groupBy(*_KEY).agg(first("tblStyle", group="tblPr").alias("style_id"), border_map("tblBorders").alias("_borders"), margin_map().alias("_margins"))
    chains = structure.resolve_table_styles(table_style_sheet(nodes, properties), ["borders", "cell_margins"])
    joined = own.join(chains, ["doc_id", "style_id"], "left")
    return joined.select(*_KEY, structure.overlaid(F.col("_borders"), F.col("borders")).alias("tbl_borders"), structure.overlaid(F.col("_margins"), F.col("cell_margins")).alias("cell_margins"))


def grid_columns(properties: DataFrame) -> DataFrame:
    """doc_key, section_kind, section_ix, place of the table, col_ix and width of every grid column."""
    own = properties.filter("owner = 'tbl' and group = 'tblGrid' and tag = 'gridCol' and place is not null")
    order = Window.partitionBy(*_KEY).orderBy("seq")
    return own.select(F.col("doc_id").alias("doc_key"), "section_kind", F.col("part_ord").alias("section_ix"), "place", (F.row_number().over(order) - 1).alias("col_ix"), F.col("attrs")["w"].try_cast("int").alias("width"))


def styled_cells(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """All cells as ``render`` reads them: place, colspan, rowspan, hidden (continued), css and height."""
    key = [*_KEY[:3], "table"]
    raw = raw_cells(nodes, properties)
    row = Window.partitionBy(*key, "row_ix")
    grid = raw.withColumn("grid_col", F.coalesce(F.sum("colspan").over(row.orderBy("cell_ix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    column = Window.partitionBy(*key, "grid_col", "colspan")
    breaks = (F.col("vmerge") != "continue") | (F.col("row_ix") != F.lag("row_ix", 1, -2).over(column.orderBy("row_ix")) + 1)
    grid = grid.withColumn("_island", F.sum(F.coalesce(breaks, F.lit(True)).cast("int")).over(column.orderBy("row_ix")))
    grid = grid.withColumn("rowspan", F.when(F.col("vmerge") == "restart", F.count("*").over(Window.partitionBy(*key, "grid_col", "colspan", "_island"))).otherwise(1))
    tables = table_properties(nodes, properties).withColumnRenamed("place", "table")
    css = styles.cell_css({n: F.col(n) for n in ("v_align", "alignment", "fill", "cell_margins", "cell_borders", "tbl_borders")})
    return grid.join(tables, key, "left").select(F.col("doc_id").alias("doc_key"), "section_kind", F.col("part_ord").alias("section_ix"), "place", "colspan", "rowspan", (F.col("vmerge") == "continue").alias("hidden"), css.alias("css"), "height_twips")


def image_properties(nodes: DataFrame) -> DataFrame:
    """doc_key, part_ord, seq (of the drawing), width_px, height_px, anchored, right_anchored and floating of every drawing."""
    inside = nodes.filter("array_contains(path.tag, 'drawing')")
    drawing = F.try_element_at(F.filter("path", lambda x: x["tag"] == "drawing"), F.lit(1))["seq"]
    size = F.struct(F.nullif(F.col("attrs")["cx"], F.lit("")).alias("cx"), F.nullif(F.col("attrs")["cy"], F.lit("")).alias("cy"))
    extent = F.min_by(size, F.when(F.col("tag").isin("extent", "ext"), F.col("seq")))
    side = F.min_by(F.struct(F.col("attrs")["relativeFrom"].alias("from")), F.when((F.col("tag") == "positionH") & (_at(2) == "anchor"), F.col("seq")))["from"]
    offset = F.min_by(F.struct(F.col("text").try_cast("bigint").alias("v")), F.when((F.col("tag") == "posOffset") & (_at(2) == "positionH") & (_at(3) == "anchor"), F.col("seq")))["v"]
    flat = inside.groupBy("doc_key", "part_ord", drawing.alias("seq")).agg(extent.alias("_e"), F.bool_or(F.col("tag") == "anchor").alias("anchored"), side.alias("_from"), offset.alias("_offset"))
    cx, cy = (F.col(f"_e.{n}").try_cast("bigint") for n in ("cx", "cy"))
    both = cx.isNotNull() & cy.isNotNull()
    geometry = styles.image_geometry(F.when(both, cx), F.when(both, cy), F.when(F.col("anchored"), "anchor").otherwise("inline"), F.col("_offset"))
    floating = F.col("_offset").isNotNull() & F.coalesce(F.col("_from").isin("margin", "page", "column"), F.lit(False))
    return flat.withColumn("_g", geometry).select("doc_key", "part_ord", "seq", "_g.width_px", "_g.height_px", "anchored", "_g.right_anchored", floating.alias("floating"))


def page_properties(nodes: DataFrame, properties: DataFrame) -> DataFrame:
    """Page setup of every document from its body's first section, document defaults, the style Normal and the theme's font."""
    every = nodes.filter("section_kind = 'body' and tag = 'body'").select(F.col("doc_key").alias("doc_id"), "tag", F.lit("document").alias("owner"), "attrs", "seq")
    first_section = properties.filter("owner = 'body' and tag = 'sectPr'").groupBy("doc_id").agg(F.min("seq").alias("_first"))
    sections = nodes.filter(F.col("tag").isin("pgSz", "pgMar") & (_at(2) == "sectPr") & (_at(3) == "body")).select(F.col("doc_key").alias("doc_id"), F.col("parent_seq").alias("_first"), "tag", F.lit("body").alias("owner"), "attrs", "seq")
    body = sections.join(first_section, ["doc_id", "_first"], "left_semi").drop("_first")
    defaults = properties.filter("owner = 'docDefaults' and (group = 'rPr' and tag = 'sz' or group = 'pPr' and tag = 'spacing')").select("doc_id", "tag", F.lit("docDefaults").alias("owner"), "attrs", "seq")
    named = nodes.filter("section_kind = 'styles' and tag = 'name' and attrs['val'] = 'Normal'").groupBy(F.col("doc_key").alias("doc_id")).agg(F.min("parent_seq").alias("owner_seq"))
    normal = properties.filter("owner = 'style' and group = 'pPr' and tag = 'spacing'").join(named, ["doc_id", "owner_seq"], "left_semi").select("doc_id", "tag", F.lit("Normal").alias("owner"), "attrs", "seq")
    theme = nodes.filter("section_kind = 'theme' and tag = 'latin'").filter(_at(2) == "minorFont").select(F.col("doc_key").alias("doc_id"), "tag", F.lit("theme").alias("owner"), "attrs", "seq")
    return structure.page_setup(every.unionByName(body).unionByName(defaults).unionByName(normal).unionByName(theme))
