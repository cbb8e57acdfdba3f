"""Edits and write-back: patches from fields and edits, their order, and their effect on tokens."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import text as T


def effective_patches(patches: DataFrame, nodes: DataFrame) -> DataFrame:
    """The last patch of each document, node and operation; patches of unknown nodes go."""
    typed = patches.withColumn("op", T.infer_patch_op(F.col("operation"), F.col("checked"), F.col("text"))).filter("op is not null")
    known = typed.join(nodes.select("doc_id", "node_id").distinct(), ["doc_id", "node_id"], "left_semi")
    last = known.groupBy("doc_id", "node_id", "op").agg(F.max_by(F.struct("text", "checked"), "patch_ord").alias("p"), F.max("patch_ord").alias("patch_ord"))
    return last.select("doc_id", "node_id", "op", "patch_ord", "p.text", "p.checked")


def apply_text_patches(tokens: DataFrame, patches: DataFrame, dealt: bool = False) -> DataFrame:
    """The first text leaf under a patched run or paragraph gets the text, the others become empty.

    Of patches of a paragraph and of its runs the last one (patch_ord, if there is one) holds for each leaf.  Where a node
    has no leaf, one is added behind its tokens.  tokens: doc_key, block_ix, run_ix, kind, text, node_id and para_node_id
    (if paragraphs may be patched), with a row of kind ``empty`` for runs and paragraphs without tokens.

    Patches are rows beside the tokens, of which each node is a window, so both are dealt by document once, or not at all
    if they are ``dealt`` already, in parts of one number.
    """
    order = F.col("patch_ord") if "patch_ord" in patches.columns else F.lit(0)
    levels = [c for c in ("node_id", "para_node_id") if c in tokens.columns]
    texts = patches.filter("op = 'replace_text' and doc_key is not null and node_id is not null")
    told = texts.select("doc_key", *[F.col("node_id").alias(x) for x in levels], F.lit(True).alias("_patch"), F.col("text").alias("_text"), order.alias("_ord"))
    out = tokens.withColumn("_patch", F.lit(False)).unionByName(told, allowMissingColumns=True)
    out = out if dealt else out.repartition("doc_key")
    for level in levels:
        w = Window.partitionBy("doc_key", level)
        leaves = F.count_if(F.col("kind") == "text").over(w)
        place = F.count_if(F.col("kind") == "text").over(w.orderBy("_patch", "block_ix", "run_ix").rowsBetween(Window.unboundedPreceding, 0))
        last = F.lead("_patch", 1, True).over(w.orderBy("_patch", "block_ix", "run_ix"))
        out = out.withColumns({f"_new_{level}": F.max_by("_text", "_ord").over(w), f"_ord_{level}": F.max("_ord").over(w), f"_n_{level}": leaves, f"_leaf_{level}": place, f"_last_{level}": last})
    out = out.filter("not _patch")
    hit = {x: F.col(f"_new_{x}").isNotNull() for x in levels}
    value = {x: F.when(F.col(f"_leaf_{x}") == 1, F.col(f"_new_{x}")).otherwise("") for x in levels}
    best = F.array_max(F.array(*[F.when(hit[x], F.struct(F.col(f"_ord_{x}").alias("o"), value[x].alias("v"))) for x in reversed(levels)]))["v"]
    text = F.when(F.col("kind") == "text", F.coalesce(best, F.col("text"))).otherwise(F.col("text"))
    bare = F.lit(False)
    added = F.lit(None).cast("string")
    for x in levels:
        here = hit[x] & (F.col(f"_n_{x}") == 0) & F.col(f"_last_{x}")
        bare, added = bare | here, F.coalesce(F.when(here, F.col(f"_new_{x}")), added)
    new = {"text": added, "kind": F.lit("text"), "run_ix": (F.col("run_ix") + F.when(F.col("kind") == "empty", 0).otherwise(1)).cast(tokens.schema["run_ix"].dataType)}
    row = lambda given: F.struct(*[given.get(c, F.col(c)).alias(c) for c in tokens.columns])
    return out.select(F.explode(F.filter(F.array(row({"text": text}), F.when(bare, row(new))), lambda r: r.isNotNull())).alias("r")).select("r.*")


def apply_checkbox_patches(tokens: DataFrame, patches: DataFrame) -> DataFrame:
    """The state of patched checkboxes, the last patch of each; other nodes are left alone."""
    order = F.col("patch_ord") if "patch_ord" in patches.columns else F.lit(0)
    ticks = patches.filter("op = 'toggle_checkbox'").groupBy("doc_key", "node_id").agg(F.max_by("checked", order).alias("_new"))
    joined = tokens.join(ticks, ["doc_key", "node_id"], "left")
    ticked = (F.col("kind") == "checkbox") & F.col("_new").isNotNull()
    out = joined.withColumn("text", F.when(ticked, F.when(F.col("_new"), "☒").otherwise("☐")).otherwise(F.col("text")))
    return (out.withColumn("checked", F.when(ticked, F.col("_new")).otherwise(F.col("checked"))) if "checked" in tokens.columns else out).select(*tokens.columns)


def echo_filter(edits: DataFrame) -> DataFrame:
    """Edits of a person, without those that a programmatic sync caused."""
    return edits.filter("origin <> 'sync'")


def sync_field_values(fields: DataFrame, edits: DataFrame, dealt: bool = False) -> DataFrame:
    """Field values after node edits, the last of each node by ts and edit_id if there are such columns.

    A checkbox field takes the state of any of its boxes, the last edited one; other fields the text of their value target.
    Edits are rows beside the fields, one for each target, so both are dealt by document once, or not at all if they are
    ``dealt`` already, in parts of one number.
    """
    order = F.struct(*[c for c in ("ts", "edit_id") if c in edits.columns] or [F.lit(0)])
    box = F.col("type") == "checkbox"
    key = [c for c in ("doc_key", "block", "row", "rule", "field_ord", "id", "label") if c in fields.columns]
    targets = F.when(box, F.filter("node_ids", lambda x: x.startswith("sdt_"))).otherwise(F.array(T.value_target(F.col("node_ids"))))
    asked = fields.select("*", F.posexplode_outer(targets).alias("_n", "_target"))
    made = edits.filter("doc_key is not null and node_id is not null").select("doc_key", F.lit(-1).alias("_n"), F.col("node_id").alias("_target"), F.col("text").alias("_text"), order.alias("_at"))
    every = asked.unionByName(made, allowMissingColumns=True)
    node = Window.partitionBy("doc_key", "_target")
    told = (every if dealt else every.repartition("doc_key")).withColumns({"_text": F.max_by("_text", "_at").over(node), "_at": F.max("_at").over(node)}).filter("_n is null or _n >= 0")
    new = told.withColumn("_new", F.max_by("_text", "_at").over(Window.partitionBy(*key))).filter("_n is null or _n = 0")
    value = F.when(F.col("_new").isNull(), F.col("value")).when(box, F.when(F.col("_new") == "☒", "true").otherwise("false")).otherwise(F.col("_new"))
    return new.select(*[value.alias("value") if c == "value" else F.col(c) for c in fields.columns])


def fields_to_patches(fields: DataFrame) -> DataFrame:
    """A patch for each field that has a value and a target."""
    box = F.col("type") == "checkbox"
    node = F.when(box, T.checkbox_target(F.col("node_ids"))).otherwise(T.value_target(F.col("node_ids")))
    made = fields.filter("value is not null").select("doc_key", node.alias("node_id"), F.when(box, "toggle_checkbox").otherwise("replace_text").alias("op"), F.when(~box, F.col("value")).alias("text"), F.when(box, F.col("value") == "true").alias("checked"))
    return made.filter("node_id is not null")


def field_state(edits: DataFrame) -> DataFrame:
    """The last edit of each node by time, ties by edit id."""
    return edits.groupBy("session_id", "node_id").agg(F.max_by("text", F.struct("ts", "edit_id")).alias("text"), F.max("ts").alias("ts"))


def debounce_edits(edits: DataFrame, gap: str = "300 milliseconds") -> DataFrame:
    """The last edit of each burst of a session; a burst ends after ``gap`` without an edit.  Batch twin of the stream."""
    return edits.groupBy("session_id", F.session_window("ts", gap).alias("w")).agg(F.max_by(F.struct("node_id", "text"), F.struct("ts", "edit_id")).alias("e"), F.max("ts").alias("ts"), F.count("*").alias("edits")).select("session_id", "ts", "edits", "e.node_id", "e.text")


#: Tags that ``render`` writes, with attributes as it writes them, and the text between them; other markup is left to the parser.
_PLAIN = re.compile(r'<(/?)(p|span|strong|em|u|a|br|img|h[1-6]|li|ul|ol|table|colgroup|col|tr|td|div|sup|sub)((?: [a-z][a-z-]*="[^"<>]*")*+)>|([^<]++)')
_DATA = re.compile(r' (data-[a-z-]+)="([^"]*)"')


class _Nodes(HTMLParser):
    """Texts of elements that have a node id, whether they hold a checkbox, and which paragraphs hold runs."""

    VOID = frozenset(("br", "img", "hr", "input", "meta", "link", "col"))

    def __init__(self) -> None:
        super().__init__()
        self.open: list[dict | None] = []
        self.found: list[dict] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        a = dict(attrs)
        own = {"id": a["data-node-id"], "kind": a.get("data-node-kind", ""), "text": [], "box": False, "runs": False} if a.get("data-node-id") else None
        for node in filter(None, self.open):
            node["box"] |= a.get("data-type") == "checkbox"
            node["runs"] |= own is not None and own["kind"] == "run"
        if own:
            self.found.append(own)
        if tag not in self.VOID:
            self.open.append(own)

    def handle_endtag(self, tag: str) -> None:
        if tag not in self.VOID and self.open:
            self.open.pop()

    def handle_data(self, data: str) -> None:
        for node in filter(None, self.open):
            node["text"].append(data)

    def plain(self, page: str) -> bool:
        """Reads a page of nothing but _PLAIN, as ``feed`` does; false, if there is anything else."""
        end = 0
        for found in _PLAIN.finditer(page):
            if found.start() != end:
                return False
            end = found.end()
            closing, tag, attrs, text = found.groups()
            if text is not None:
                self.handle_data(unescape(text) if "&" in text else text)
            elif not closing:
                given = _DATA.findall(attrs) if "data-" in attrs else []
                if any("&" in v for _, v in given):
                    return False
                self.handle_starttag(tag, given)
            elif attrs:
                return False
            else:
                self.handle_endtag(tag)
        return end == len(page) and page.endswith(">")

    def patches(self) -> list[tuple]:
        out = []
        for node in self.found:
            text = "".join(node["text"])
            if node["kind"] == "run":
                out.append((node["id"], "toggle_checkbox", None, "☒" in text) if node["box"] else (node["id"], "replace_text", text, None))
            elif node["kind"] == "paragraph" and not node["runs"]:
                out.append((node["id"], "replace_text", text, None))
        return out


@F.pandas_udf(ArrayType(StructType([StructField("node_id", StringType()), StructField("op", StringType()), StructField("text", StringType()), StructField("checked", BooleanType())])))
def _html_patches(pages: pd.Series) -> pd.Series:
    def read(page: str | None) -> list[tuple]:
        nodes = _Nodes()
        if not nodes.plain(page or ""):
            nodes = _Nodes()
            nodes.feed(page or "")
        return [dict(zip(("node_id", "op", "text", "checked"), p, strict=True)) for p in nodes.patches()]

    return pages.map(read)


def patches_from_html(html: DataFrame) -> DataFrame:
    """doc_key, patch_ord, node_id, op, text and checked of edited pages: a patch for each run, and for paragraphs without runs."""
    made = html.select("doc_key", F.posexplode(_html_patches("html")).alias("patch_ord", "p"))
    return made.select("doc_key", "patch_ord", "p.*")


def resolve_positional_patches(patches: DataFrame, tokens: DataFrame) -> DataFrame:
    """Patches that name a block (and, in a table, row and cell), a paragraph and a run, with the node that is there.

    Missing paragraph and run are 0; positions out of range go.  A block that is a table needs row and cell.  tokens without
    row_ix are those of plain paragraphs; a run's place is run_no, else run_ix.
    """
    null = F.lit(None).cast("int")
    at = lambda name, other: F.col(name) if name in tokens.columns else other
    places = tokens.select("doc_key", F.col("block_ix").alias("block"), at("row_ix", null).alias("row"), at("cell_ix", null).alias("cell"), at("para_ix", F.lit(0)).alias("para"), at("run_no", F.col("run_ix")).alias("run"), "node_id")
    named = patches
    for column, default in (("row", null), ("cell", null), ("para", F.lit(0)), ("run", F.lit(0))):
        named = named.withColumn(column, F.coalesce(F.col(column), default) if column in patches.columns else default)
    # A patch asks at its block's plain runs and, if it names one, in its cell; a group is what is at one place.
    key = ["doc_key", "block", "row", "cell", "para", "run"]
    there = places.filter("node_id is not null and (row is null or cell is not null)").withColumn("cell", F.when(F.col("row").isNotNull(), F.col("cell")))
    plain, inner = F.struct(null.alias("row"), null.alias("cell")), F.when(F.col("row").isNotNull() & F.col("cell").isNotNull(), F.struct("row", "cell"))
    asked = named.select(F.struct(*named.columns).alias("_p"), F.explode(F.filter(F.array(plain, inner), lambda x: x.isNotNull())).alias("_at"))
    asked = asked.select(*[F.col(f"_at.{c}" if c in ("row", "cell") else f"_p.{c}").alias(c) for c in key], "_p")
    every = there.unionByName(asked, allowMissingColumns=True).filter("doc_key is not null and block is not null and run is not null and para is not null")
    met = every.groupBy(*key).agg(F.collect_set("node_id").alias("_nodes"), F.collect_list("_p").alias("_patches"))
    return met.select("_nodes", F.explode("_patches").alias("_p")).select("_p.*", F.explode("_nodes").alias("node_id"))


