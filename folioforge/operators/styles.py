"""Styles, lists, links, images and annotations of blocks, as joins and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T

#: Fixed values of the format: number formats that order a list, their CSS markers, markers of bullet characters.
ORDERED = ("decimal", "upperRoman", "lowerRoman", "upperLetter", "lowerLetter", "decimalZero", "ordinal", "cardinalText", "ordinalText", "hex", "decimalEnclosedCircle", "decimalFullWidth", "decimalHalfWidth", "decimalFullWidth2")
CSS_FORMATS = {"decimal": "decimal", "upperRoman": "upper-roman", "lowerRoman": "lower-roman", "upperLetter": "upper-alpha", "lowerLetter": "lower-alpha", "decimalZero": "decimal-leading-zero"}
BULLETS = {"•": "disc", "‣": "disc", "◦": "circle", "○": "circle", "▪": "square", "■": "square", "●": "disc"}
#: What annotations may say.
SPACINGS = {"none": 0, "small": 8, "medium": 16, "large": 32}
EMPHASIS = ("low", "medium", "high")
DISPLAYS = ("inline", "block", "float-right", "full-width")
ROLES = ("header", "label", "value", "separator", "footer")
DOC_TYPES = ("invoice", "letter", "report", "contract", "form", "other")
EMU_PER_INCH, RIGHT_ANCHOR = 914_400, 3_200_000


def lookup(values: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]


def resolve_lists(paragraphs: DataFrame, numbering: DataFrame) -> DataFrame:
    """list_ordered and list_marker of paragraphs with a num_id; a missing level is a bullet."""
    level = numbering.select("doc_id", "num_id", "ilvl", "num_fmt", "lvl_text")
    joined = paragraphs.withColumn("ilvl", F.coalesce("ilvl", F.lit(0))).join(level, ["doc_id", "num_id", "ilvl"], "left")
    ordered = F.coalesce(F.col("num_fmt").isin(*ORDERED), F.lit(False))
    marker = F.when(ordered, F.coalesce(lookup(CSS_FORMATS, F.col("num_fmt")), F.lit("decimal"))).otherwise(F.coalesce(lookup(BULLETS, F.coalesce("lvl_text", F.lit(""))), F.lit("square")))
    listed = F.col("num_id").isNotNull()
    return joined.withColumn("list_ordered", F.when(listed, ordered)).withColumn("list_marker", F.when(listed, marker)).drop("num_fmt", "lvl_text")


def resolve_hyperlinks(tokens: DataFrame, rels: DataFrame) -> DataFrame:
    """href of tokens with a rel_id, from the relationships of their own part."""
    return tokens.join(rels.select("doc_id", "part_name", "rel_id", F.col("target").alias("href")), ["doc_id", "part_name", "rel_id"], "left")


def resolve_images(tokens: DataFrame, rels: DataFrame, media: DataFrame) -> DataFrame:
    """media_path of image tokens: the first candidate path that exists, else a file name that only one member has."""
    target = F.col("target")
    normal = F.regexp_replace(F.regexp_replace(target, r"^\./", ""), r"^(?!word/|/)", "word/")
    paths = F.array(normal, target, F.regexp_replace(target, "^word/", ""), F.ltrim(target, F.lit("/")))
    linked = tokens.join(rels.select("doc_id", "part_name", "rel_id", "target"), ["doc_id", "part_name", "rel_id"])
    tried = linked.select("doc_id", "token_id", F.posexplode_outer(paths).alias("pos", "media_path"))
    exact = tried.join(media.select("doc_id", "media_path"), ["doc_id", "media_path"]).groupBy("doc_id", "token_id").agg(F.min_by("media_path", "pos").alias("_exact"))
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    named = media.groupBy("doc_id", base(F.col("media_path")).alias("_base")).agg(F.min("media_path").alias("_named"), F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    out = linked.withColumn("_base", base(target)).join(exact, ["doc_id", "token_id"], "left").join(named, ["doc_id", "_base"], "left")
    return out.withColumn("media_path", F.coalesce("_exact", "_named")).filter("media_path is not null").drop("_exact", "_named", "_base", "target")


def image_geometry(width_emu: Column, height_emu: Column, kind: Column, offset_h: Column) -> Column:
    px = lambda c: F.when(c.isNotNull(), F.greatest(F.lit(1), F.bround(c / EMU_PER_INCH * 96).cast("int")))
    return F.struct(px(width_emu).alias("width_px"), px(height_emu).alias("height_px"), ((kind == "anchor") & (F.coalesce(offset_h, F.lit(0)) >= RIGHT_ANCHOR)).alias("right_anchored"))


def _of_group(df: DataFrame) -> tuple:
    """Column makers for groups of property elements: an attribute of the first element of a tag (by seq, if there is one; empty is none), and whether there is any."""

    def of(tag: str, key: str = "val") -> Column:
        value, own = F.col("attrs")[key], F.col("tag") == tag
        return F.nullif(F.min_by(F.struct(value.alias("v")), F.when(own, F.col("seq")))["v"] if "seq" in df.columns else F.max(F.when(own, value)), F.lit(""))

    return of, lambda tag: F.bool_or(F.col("tag") == tag)


def paragraph_styles(nodes: DataFrame, styles: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row for each paragraph (``key``) from its property elements (doc_id, para, tag, attrs, seq); the style's name falls back to its id."""
    of, has = _of_group(nodes)
    flat = nodes.groupBy(*(key or ["doc_id", "para"])).agg(
        of("pStyle").alias("style_id"), of("jc").alias("alignment"), of("spacing", "before").alias("space_before"), of("spacing", "after").alias("space_after"), of("spacing", "line").alias("space_line"),
        of("ind", "left").alias("indent_left"), of("ind", "right").alias("indent_right"), of("ind", "firstLine").alias("indent_first"), of("ind", "hanging").alias("indent_hanging"),
        has("pageBreakBefore").alias("page_break_before"), of("numId").alias("num_id"), of("ilvl").try_cast("int").alias("ilvl"),
    )
    # Names are rows beside the paragraphs of their style, so tables that are by document already are not dealt again.
    names = styles.filter("doc_id is not null and style_id is not null").select("doc_id", "style_id", F.struct("name").alias("_name"))
    beside = flat.withColumn("_own", F.lit(True)).unionByName(names, allowMissingColumns=True)
    met = beside.withColumn("_name", F.collect_list("_name").over(Window.partitionBy("doc_id", "style_id"))).filter("_own").withColumn("_name", F.explode_outer("_name"))
    return met.withColumn("style_name", F.coalesce("_name.name", "style_id")).drop("_name", "_own")


def run_styles(nodes: DataFrame, key: list[str] | None = None) -> DataFrame:
    """One row for each run (``key``): half-points as points, the first font given, and flags by presence of their element."""
    of, has = _of_group(nodes)
    return nodes.groupBy(*(key or ["doc_id", "run"])).agg(
        (of("sz").try_cast("int") / 2).alias("font_size_pt"), F.coalesce(of("rFonts", "ascii"), of("rFonts", "hAnsi"), of("rFonts", "cs")).alias("font_family"), F.nullif(of("color"), F.lit("auto")).alias("color"),
        has("b").alias("bold"), has("i").alias("italic"), has("u").alias("underline"), has("strike").alias("strike"), of("vertAlign").alias("vertical_align"),
    )


#: A table's inner border of a cell's edge.
INSIDE = {"top": "insideH", "bottom": "insideH", "left": "insideV", "right": "insideV"}


def effective_borders(cells: DataFrame) -> Column:
    """A cell's edge: its own border, else the table's inner one of that direction, else the table's edge (maps cell_borders, tbl_borders, column edge)."""
    return F.coalesce(F.col("cell_borders")[F.col("edge")], F.col("tbl_borders")[lookup(INSIDE, F.col("edge"))], F.col("tbl_borders")[F.col("edge")])


def parse_annotations(responses: DataFrame) -> DataFrame:
    """Allowed hints by position from a model's answer; hints of nothing but unknown values go.

    Values count as they are spelt in JSON: a heading weight is a whole number, suppress is true and a group a string.
    """
    answer = responses.select("doc_id", F.from_json(T.extract_json(F.col("raw")), "document_type STRING, annotations STRING").alias("a"))
    rows = answer.select("doc_id", F.when(F.col("a.document_type").isin(*DOC_TYPES), F.col("a.document_type")).alias("document_type"), F.explode_outer(F.from_json("a.annotations", "MAP<STRING, STRING>")).alias("key", "h"))
    # The parsed hint is made by a generator, below which no filter goes, so that it is made once.
    typed = rows.select("doc_id", "document_type", "key", F.explode(F.array(F.try_parse_json("h"))).alias("v"))
    get = lambda name, kind: F.try_variant_get("v", f"$.{name}", kind)
    spelt = lambda name: F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant"))
    text = lambda name: F.when(spelt(name) == "STRING", get(name, "string"))
    allowed = lambda name, values: F.when(text(name).isin(*values), text(name)).alias(name)
    weight = F.when((spelt("heading_weight") == "BIGINT") & get("heading_weight", "int").between(1, 6), get("heading_weight", "int")).alias("heading_weight")
    names = ["heading_weight", "spacing_before", "spacing_after", "emphasis", "image_display", "suppress", "group", "group_role"]
    part = lambda n: F.regexp_extract("key", r"^s(\d+):b(\d+)$", n).try_cast("int")
    clean = typed.select(
        "doc_id", "document_type", part(1).alias("section_ix"), part(2).alias("block_ix"), weight, allowed("spacing_before", SPACINGS), allowed("spacing_after", SPACINGS), allowed("emphasis", EMPHASIS),
        allowed("image_display", DISPLAYS), F.when((spelt("suppress") == "BOOLEAN") & get("suppress", "boolean"), True).alias("suppress"), text("group").alias("group"), allowed("group_role", ROLES),
    )
    return clean.filter(F.col("section_ix").isNotNull() & F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names]).isNotNull())


def annotate_blocks(page_blocks: DataFrame, annotations: DataFrame) -> DataFrame:
    """Hints joined by section and position; the position of body blocks is that in the page-split sequence."""
    order = Window.partitionBy("doc_id", "section_ix").orderBy("block_ix", "part")
    placed = page_blocks.withColumn("_pos", F.row_number().over(order) - 1)
    return placed.join(annotations.withColumnRenamed("block_ix", "_pos"), ["doc_id", "section_ix", "_pos"], "left").drop("_pos")


def block_summaries(blocks: DataFrame, tokens: DataFrame, cells: DataFrame) -> DataFrame:
    """What a layout prompt says of each block.

    Paragraphs: 300 characters of text, style, alignment, list level, whether there is an image, and size, weight and
    colour of the first run.  Tables: rows, the most cells of a row, and 40 characters of each cell of the first row.
    blocks: doc_id, block_ix, block_type, style_name, alignment, num_id, ilvl; tokens: doc_id, block_ix, run_ix, kind, text,
    font_size_pt, bold, color; cells: doc_id, block_ix, row_ix, cell_ix, text.
    """
    key = ["doc_id", "block_ix"]
    rows = cells.groupBy(*key, "row_ix").agg(F.count("*").alias("_cells"), F.sort_array(F.collect_list(F.struct("cell_ix", F.left("text", F.lit(40)).alias("t"))))["t"].alias("_sample"))
    # Blocks, runs and rows of tables meet in one group for each block, so what is by document already is not dealt again.
    own = F.struct("block_type", "style_name", "alignment", "num_id", "ilvl").alias("_block")
    placed = "doc_id is not null and block_ix is not null"
    every = blocks.select(*key, own).unionByName(tokens.filter(placed).select(*key, F.struct("run_ix", "kind", "text", F.struct("font_size_pt", "bold", "color").alias("style")).alias("_run")), allowMissingColumns=True)
    every = every.unionByName(rows.filter(placed).select(*key, F.struct("row_ix", "_cells", "_sample").alias("_row")), allowMissingColumns=True)
    items = F.sort_array(F.collect_list(F.when(F.col("_run.kind") == "text", F.struct("_run.run_ix", "_run.text"))))
    texts = [F.array_join(items["text"], "").alias("_text"), F.bool_or(F.col("_run.kind") == "image").alias("has_image"), F.min_by("_run.style", "_run.run_ix").alias("run")]
    tables = [F.nullif(F.count("_row"), F.lit(0)).alias("rows"), F.max("_row._cells").alias("cols"), F.min_by("_row._sample", "_row.row_ix").alias("header_sample")]
    met = every.groupBy(*key).agg(F.collect_list("_block").alias("_blocks"), *texts, *tables)
    joined = met.select("*", F.explode("_blocks").alias("_block")).select("*", "_block.*")
    listed = F.col("num_id").isNotNull()
    para = F.col("block_type") == "paragraph"
    return joined.select(
        *key, "block_type", F.when(para, F.coalesce(F.left("_text", F.lit(300)), F.lit(""))).alias("text"), "style_name", "alignment", F.when(para, listed).alias("is_list"), F.when(para & listed, F.coalesce("ilvl", F.lit(0))).alias("list_level"),
        F.when(para, F.coalesce("has_image", F.lit(False))).alias("has_image"), "run.font_size_pt", "run.bold", "run.color", "rows", "cols", "header_sample",
    )


#: CSS of emphasis and image hints.
EMPHASIS_CSS = {"high": "border-left: 3px solid #3b82f6; padding-left: 8px; background: #eff6ff", "medium": "border-left: 2px solid #9ca3af; padding-left: 6px", "low": "opacity: 0.75"}
DISPLAY_CSS = {"full-width": "width: 100%; display: block", "float-right": "float: right; margin-left: 16px"}


def _rule(name: str, value: Column, unit: str = "px") -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(unit))


def _aligned(alignment: Column) -> Column:
    return F.when(alignment.isin("both", "start"), "left").when(alignment == "end", "right").otherwise(alignment)


def paragraph_css(c: dict[str, Column]) -> Column:
    """alignment, space_before, space_after, space_line, indent_left, indent_right, indent_first and indent_hanging (twips as strings) as CSS; any may be left out."""
    none = F.lit(None).cast("string")
    of = lambda name: c.get(name, none)
    px = lambda name: T.twips_to_px(of(name))
    line = F.round(of("space_line").try_cast("int") / 240, 2)
    hanging = of("indent_first").isNull() & px("indent_hanging").isNotNull()
    return F.concat_ws(
        "; ", _rule("text-align", _aligned(of("alignment")), ""), _rule("margin-top", px("space_before")), _rule("margin-bottom", px("space_after")), F.when(line > 0, _rule("line-height", line, "")),
        _rule("padding-left", px("indent_left")), _rule("padding-right", px("indent_right")), _rule("text-indent", px("indent_first")),
        F.when(hanging, _rule("text-indent", F.concat(F.lit("-"), px("indent_hanging").cast("string")))), F.when(hanging & of("indent_left").isNull(), _rule("padding-left", px("indent_hanging"))),
    )


def annotation_css(c: dict[str, Column]) -> Column:
    """spacing_before, spacing_after, emphasis, suppress and image_display of an annotation as CSS."""
    space = lambda name, side: _rule(f"margin-{side}", lookup({k: f"{v}px" if v else "0" for k, v in SPACINGS.items()}, c[name]), "")
    shown = lookup(DISPLAY_CSS, c["image_display"]) if "image_display" in c else F.lit(None).cast("string")
    return F.concat_ws("; ", space("spacing_before", "top"), space("spacing_after", "bottom"), lookup(EMPHASIS_CSS, c["emphasis"]), F.when(c["suppress"], "opacity: 0.4"), shown)


def run_css(c: dict[str, Column]) -> Column:
    """font_size_pt, font_family, color and strike as CSS; weight and slant are tags."""
    color = F.when(c["color"].startswith("#"), c["color"]).otherwise(F.concat(F.lit("#"), c["color"]))
    return F.concat_ws("; ", F.concat(F.lit("font-size: "), F.regexp_replace(c["font_size_pt"].cast("string"), r"\.0$", ""), F.lit("pt")), F.concat(F.lit("font-family: '"), F.nullif(c["font_family"], F.lit("")), F.lit("'")), F.concat(F.lit("color: "), F.when(c["color"] != "", color)), F.when(c["strike"], "text-decoration: line-through"))


def cell_css(c: dict[str, Column]) -> Column:
    """Padding (map cell_margins of edges in twips), v_align, alignment, fill and borders (maps cell_borders and tbl_borders of edges to width_pt, style and color) as CSS."""
    none = F.lit(None)
    margins = c.get("cell_margins", none.cast("map<string,int>"))
    px = lambda edge: F.concat(F.coalesce(T.twips_to_px(margins[edge].cast("string")), F.lit(0)).cast("string"), F.lit("px"))
    padding = F.when(F.size(margins) > 0, F.concat_ws(" ", *map(px, ("top", "right", "bottom", "left")))).otherwise("0px 7px")
    kind = "map<string,struct<style:string,width_pt:double,color:string>>"
    own, table = c.get("cell_borders", none.cast(kind)), c.get("tbl_borders", none.cast(kind))
    edges = []
    for edge in ("top", "left", "bottom", "right"):
        b = F.coalesce(own[edge], table[INSIDE[edge]], table[edge])
        edges.append(F.concat(F.lit(f"border-{edge}: "), b["width_pt"].cast("string"), F.lit("pt "), b["style"], F.lit(" #"), b["color"]))
    middle = F.when(c["v_align"] == "center", "middle").otherwise(F.coalesce(F.nullif(c["v_align"], F.lit("")), F.lit("top")))
    return F.concat_ws("; ", _rule("padding", padding, ""), _rule("vertical-align", middle, ""), F.lit("overflow-wrap: break-word"), _rule("text-align", _aligned(F.nullif(c["alignment"], F.lit(""))), ""), F.concat(F.lit("background-color: #"), F.nullif(c["fill"], F.lit(""))), *edges)
