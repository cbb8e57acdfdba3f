"""Readers, writers and style rows on small hand-made inputs."""

import io
import json
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.operators import fields, patches, pdf, structure, styles
from folioforge.sources import docx_io, tables


def test_trees_become_tokens(spark, tmp_path):
    run = {"type": "run", "node_id": "r_0", "children": [{"type": "text", "text": "Name:"}, {"type": "break", "break_type": "tab"}, {"type": "break", "break_type": "line"}, {"type": "checkbox", "checked": True}]}
    cell_ = {"colspan": 1, "rowspan": 1, "vmerge": "", "width_twips": 900, "children": [{"type": "paragraph", "node_id": "p_1", "children": [run]}, {"type": "table"}, {"type": "paragraph", "node_id": "p_2", "children": []}]}
    tree = {"version": "1.0", "sections": [{"kind": "body", "blocks": [{"type": "paragraph", "node_id": "p_0", "style": {"alignment": "end"}, "children": [run]}, {"type": "table", "rows": [{"cells": [cell_, {"colspan": 2, "vmerge": "restart", "children": []}]}]}]}]}
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(json.dumps(tree))
    (tmp_path / "in/b.json").write_text(json.dumps(tree | {"version": "9"}))
    blocks = tables.blocks_of(tables.read_ast_json(spark, str(tmp_path / "in")))
    assert [r["block_type"] for r in blocks.orderBy("block_ix").collect()] == ["paragraph", "table"]
    assert [r["kind"] for r in tables.tokens_of_blocks(blocks).orderBy("item_ix").collect()] == ["text", "tab", "line", "checkbox"]
    cells = tables.cells_of_blocks(blocks).orderBy("cell_ix").collect()
    assert [(r["text"], r["checkbox_count"], r["colspan"], r["vmerge"], r["width_twips"], r["node_ids"]) for r in cells] == [("Name:", 1, 1, "", 900, ["p_1", "r_0", "p_2"]), ("", 0, 2, "restart", None, [])]


def test_page_images(spark, tmp_path):
    def png(width, height, color):
        piece = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        lines = b"".join(b"\0" + bytes(color) * width for _ in range(height))
        return b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + piece(b"IDAT", zlib.compress(lines)) + piece(b"IEND", b"")

    (tmp_path / "d").mkdir()
    for page in (0, 12):
        (tmp_path / f"d/page-{page}.png").write_bytes(png(3, 2, (1, 2, page)))
    got = {r["page"]: r for r in tables.read_page_images(spark, str(tmp_path), "candidate").collect()}
    assert set(got) == {0, 12} and (got[12]["width"], got[12]["height"], got[12]["side"]) == (3, 2, "candidate") and bytes(got[12]["data"]) == bytes((12, 2, 1)) * 6
    assert got[0]["doc_key"].endswith("/d")


def test_tables_of_results(spark, tmp_path):
    made = spark.createDataFrame([("k", 2, "i2", "b"), ("k", 1, "i1", "a"), ("l", 1, "i1", None)], "doc_key string, field_ord int, id string, value string")
    fields_ = made.withColumns({n: F.lit(None).cast("string") for n in ("label", "type", "block", "para", "raw_label", "raw_value")}).withColumn("confidence", F.lit(0.5))
    docx_io.write_fields_json(fields_, str(tmp_path / "fields"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "fields")).collect()]
    assert {x["documentId"]: [f.get("value") for f in x["fields"]] for x in lines} == {"k": ["a", "b"], "l": [None]}
    for _ in range(2):
        tables.write_html(spark.createDataFrame([("k", "<p>")], "doc_key string, html string"), str(tmp_path / "html"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "html")).collect()] == [("k", "<p>")]


def test_targets_and_sizes(spark):
    row = spark.range(1).select(text.checkbox_target(F.array(*map(F.lit, ("p_1", "sdt_2", "sdt_3")))).alias("box"), text.checkbox_target(F.array(F.lit("p_1"))).alias("none"), *[pdf.fit_fontsize(F.lit(u), F.lit(w), F.lit(h)).alias(f"s{i}") for i, (u, w, h) in enumerate([(1.0, 100.0, 30.0), (10.0, 55.0, 10.0), (50.0, 10.0, 30.0)])]).first()
    assert (row["box"], row["none"], row["s0"], row["s1"], row["s2"]) == ("sdt_2", None, 11.0, 5.5, 4.0)


def test_requests_and_answers(spark, tmp_path):
    prompts = spark.createDataFrame([("a", 2, "[1]"), ("b", 0, "[]")], "doc_key string, blocks int, prompt string")
    tables.llm_request_batch(prompts, "fields", str(tmp_path / "out"))
    lines = [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert lines == [{"custom_id": "a", "task": "fields", "prompt": "[1]"}]
    (tmp_path / "answers").mkdir()
    (tmp_path / "answers/a.txt").write_text('{"fields":\n[]}')
    got = {r["doc_key"]: r["raw"] for r in tables.llm_response_source(spark, str(tmp_path / "answers"), prompts).collect()}
    assert got == {"a": '{"fields":\n[]}', "b": None}


def test_blocks_of_sections_in_order(spark):
    rows = [("d", 0, "body", 0, -1, "document"), ("d", 0, "body", 1, 0, "body"), ("d", 0, "body", 2, 1, "p"), ("d", 0, "body", 3, 1, "sdt"), ("d", 0, "body", 4, 3, "p"), ("d", 0, "body", 5, 1, "tbl"), ("d", 1, "header", 0, -1, "hdr"), ("d", 1, "header", 1, 0, "p")]
    nodes = spark.createDataFrame([(*r, None) for r in rows], "doc_key string, part_ord int, section_kind string, seq long, parent_seq long, tag string, error string")
    got = structure.build_blocks(nodes).orderBy("section_ix", "block_ix").select("section_ix", "section_kind", "block_ix", "block_type").collect()
    assert [tuple(r) for r in got] == [(0, "header", 0, "paragraph"), (1, "body", 0, "paragraph"), (1, "body", 1, "table")]


def test_style_rows(spark):
    kind = "doc_id int, para int, run int, cell int, seq int, tag string, owner string, attrs map<string,string>"
    rows = [
        (1, 0, 0, 0, 0, "pStyle", "Normal", {"val": "H1"}), (1, 0, 0, 0, 1, "jc", "paragraph", {"val": "both"}), (1, 0, 0, 0, 2, "spacing", "docDefaults", {"before": "x", "line": "276", "lineRule": "auto"}),
        (1, 0, 0, 0, 3, "b", "run", {"val": "0"}), (1, 0, 0, 0, 4, "sz", "docDefaults", {"val": "22"}), (1, 0, 0, 0, 5, "pgSz", "body", {"w": "12240", "h": "bad"}), (1, 0, 0, 0, 6, "shd", "cell", {"fill": "auto"}),
    ]
    nodes = spark.createDataFrame(rows, kind)
    para = styles.paragraph_styles(nodes, spark.createDataFrame([(1, "H1", "heading 1")], "doc_id int, style_id string, name string")).first()
    assert (para["style_name"], para["alignment"], para["num_id"]) == ("heading 1", "both", None)
    run = styles.run_styles(nodes).first()
    assert (run["font_size_pt"], run["bold"], run["italic"]) == (11.0, True, False)
    cell = structure.cell_styles(nodes).first()
    assert (cell["alignment"], cell["fill"]) == ("both", None)
    page = structure.page_setup(nodes).first()
    assert (page["width_in"], page["height_in"], page["default_font_size_pt"], round(page["default_line_height"], 4)) == (8.5, None, 11.0, 1.495)
    css = styles.paragraph_css({"alignment": F.lit("both"), "space_before": F.lit("x"), "space_after": F.lit("30"), "indent_left": F.lit(None).cast("string"), "indent_hanging": F.lit("150")})
    assert spark.range(1).select(css.alias("c")).first()[0] == "text-align: left; margin-bottom: 2px; text-indent: -10px; padding-left: 10px"


# Archives ---------------------------------------------------------------------------------------------------------------
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" xmlns:w15="urn:w15" mc:Ignorable="w14 w15"'


def box(on):
    return f'<w:sdt><w:sdtPr><w14:checkbox><w14:checked w14:val="{int(on)}"/></w14:checkbox></w:sdtPr><w:sdtContent><w:r><w:t>{"☒" if on else "☐"}</w:t></w:r></w:sdtContent></w:sdt>'


def cell(inner, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{inner}</w:tc>"


def para(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def form_archive():
    nested = f"<w:tbl><w:tr>{cell(para('deep'))}</w:tr></w:tbl>"
    table = f"""<w:tbl><w:tr>{cell(para("Amount:"), '<w:tcW w:w="2000"/>')}{cell("<w:p><w:pPr/></w:p>")}</w:tr>
      <w:tr>{cell(para("Agree?"), '<w:vMerge w:val="restart"/>')}{cell(f"<w:p>{box(False)}<w:r><w:t>yes</w:t></w:r></w:p>", '<w:gridSpan w:val="2"/>')}</w:tr>
      <w:tr>{cell(para("in") + nested + para("out"), "<w:vMerge/>")}{cell(para(" x ") + para(" ") + para("y"))}</w:tr></w:tbl>"""
    body = f"""<w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Name:</w:t><w:tab/></w:r><w:r><w:rPr><w:b/></w:rPr></w:r></w:p>
      <w:p>{box(True)}<w:r><w:t xml:space="preserve"> Express</w:t></w:r></w:p><w:sdt><w:sdtContent>{para("skipped")}</w:sdtContent></w:sdt><w:p/>{table}
      <w:p><w:hyperlink r:id="rId7"><w:r><w:t>See</w:t></w:r></w:hyperlink><w:r><w:br w:type="page"/><w:drawing><a:blip r:embed="rId8"/></w:drawing></w:r><w:ins><w:r><w:t>no</w:t></w:r></w:ins></w:p>"""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {W}><w:body>{body}</w:body></w:document>')
        z.writestr("word/styles.xml", f'<w:styles {W}><w:style w:type="paragraph" w:styleId="H1"><w:name w:val="heading 1"/><w:basedOn w:val="N"/></w:style></w:styles>')
        z.writestr("word/numbering.xml", f'<w:numbering {W}><w:abstractNum w:abstractNumId="4"><w:lvl w:ilvl="0"><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum><w:num w:numId="2"><w:abstractNumId w:val="4"/></w:num></w:numbering>')
        z.writestr("word/header1.xml", f"<w:hdr {W}>{para('Top')}</w:hdr>")
        rel = '<Relationship Id="{}" Type="http://x/{}" Target="{}"/>'
        z.writestr("word/_rels/document.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rel.format("rId1", "header", "header1.xml")}{rel.format("rId7", "hyperlink", "http://e.org")}{rel.format("rId8", "image", "media/a.png")}</Relationships>')
        z.writestr("word/media/a.png", b"\x89PNG" * 4)
    return out.getvalue()


def shredded(spark, *contents):
    blobs = spark.createDataFrame([(f"uploads/{i}.docx", bytearray(c)) for i, c in enumerate(contents)], "doc_key string, content binary")
    return blobs, docx_io.shred_docx(blobs).persist()


def test_parts_of_an_archive(spark):
    blobs, nodes = shredded(spark, form_archive())
    assert [tuple(r)[1:] for r in docx_io.styles_of(nodes).collect()] == [("H1", "paragraph", "heading 1", "N")]
    assert [tuple(r)[1:] for r in docx_io.numbering_of(nodes).collect()] == [("2", 0, "decimal", "%1.")]
    assert sorted(tuple(r)[1:] for r in docx_io.rels_of(nodes).collect()) == [("word/document.xml", "rId1", "header", "header1.xml"), ("word/document.xml", "rId7", "hyperlink", "http://e.org"), ("word/document.xml", "rId8", "image", "media/a.png")]
    media = docx_io.media_data_uris(docx_io.media_of(blobs)).collect()
    assert [(r["media_path"], r["uri"][:22]) for r in media] == [("word/media/a.png", "data:image/png;base64,")]
    blocks = structure.build_blocks(nodes).orderBy("section_ix", "block_ix").collect()
    assert [(r["section_kind"], r["block_type"]) for r in blocks] == [("header", "paragraph"), *[("body", x) for x in ("paragraph", "paragraph", "paragraph", "table", "paragraph")]]


def test_tokens_and_cells_of_an_archive(spark):
    _, nodes = shredded(spark, form_archive())
    tokens = docx_io.tokens_of(nodes)
    shown = tokens.filter("section_kind = 'body' and row_ix is null").orderBy("block_ix", "run_ix").select("block_ix", "run_no", "kind", "text", "checked", "rel_id", "node_id", "para_node_id").collect()
    assert [tuple(r) for r in shown] == [
        (0, 0, "text", "Name:", None, None, "r_0", "p_0"), (0, 0, "tab", "", None, None, "r_0", "p_0"), (0, 1, "empty", "", None, None, "r_1", "p_0"),
        (1, 0, "checkbox", "", True, None, "sdt_0", "p_1"), (1, 1, "text", " Express", None, None, "r_3", "p_1"),
        (2, -1, "empty", "", None, None, None, "p_3"),
        (4, 0, "text", "See", None, "rId7", "r_15", "p_14"), (4, 1, "page", "", None, None, "r_16", "p_14"), (4, 1, "image", "", None, "rId8", "r_16", "p_14"),
    ]
    assert [r["text"] for r in tokens.filter("section_kind = 'header'").collect()] == ["Top"]
    cells = docx_io.cells_of(nodes, tokens).orderBy("row_ix", "cell_ix").select("block_ix", "row_ix", "cell_ix", "text", "checkbox_count", "colspan", "vmerge", "width_twips", "node_ids").collect()
    assert [tuple(r)[:-1] for r in cells] == [(3, 0, 0, "Amount:", 0, 1, "", 2000), (3, 0, 1, "", 0, 1, "", None), (3, 1, 0, "Agree?", 0, 1, "restart", None), (3, 1, 1, "yes", 1, 2, "", None), (3, 2, 0, "in out", 0, 1, "continue", None), (3, 2, 1, "x y", 0, 1, "", None)]
    assert cells[0]["node_ids"] == ["p_4", "r_5"] and cells[1]["node_ids"] == ["p_5"] and cells[3]["node_ids"] == ["p_7", "sdt_2", "r_8"]


def test_archive_to_fields_to_archive(spark):
    blobs, nodes = shredded(spark, form_archive())
    tokens = docx_io.tokens_of(nodes)
    found = fields.extract_fields(docx_io.body_tokens(tokens), docx_io.cells_of(nodes, tokens)).orderBy("field_ord")
    assert [(r["block"], r["label"], r["type"], r["value"]) for r in found.collect()] == [(0, "Name", "text", None), (1, "Express", "checkbox", None), (3, "Amount:", "number", None), (3, "Agree?", "checkbox", None)]
    values = {"Name": "Ann", "Express": "false", "Amount:": "12", "Agree?": "true"}
    filled = found.withColumn("value", F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.col("label")])
    made = patches.fields_to_patches(filled).select("doc_key", F.lit(1).alias("patch_ord"), "node_id", F.col("op").alias("operation"), "text", "checked")
    assert {(r["node_id"], r["text"], r["checked"]) for r in made.collect()} == {("r_1", "Ann", None), ("sdt_0", None, False), ("p_5", "12", None), ("sdt_2", None, True)}
    more = spark.createDataFrame([("uploads/0.docx", 2, "p_14", None, "all", None), ("uploads/0.docx", 3, "r_15", None, "link", None), ("uploads/0.docx", 4, "r_999", None, "x", None), ("uploads/0.docx", 0, "p_5", None, "old", None)], "doc_key string, patch_ord int, node_id string, operation string, text string, checked boolean")
    written = docx_io.write_docx(blobs, docx_io.patch_edits(nodes, made.unionByName(more))).collect()[0]
    assert written["out_key"] == "exported/0-exported.docx"
    with zipfile.ZipFile(io.BytesIO(written["content"])) as z:
        xml = z.read("word/document.xml").decode()
        assert "data-node-id" not in xml and 'xmlns:w15="urn:w15"' in xml and z.read("word/media/a.png") == b"\x89PNG" * 4
    _, again = shredded(spark, written["content"])
    left = docx_io.tokens_of(again)
    texts = {r["block_ix"]: r["text"] for r in fields.paragraph_texts(docx_io.body_tokens(left)).collect()}
    assert texts[0] == "Name:\tAnn" and texts[1] == "  Express" and texts[4].startswith("link")
    cells = {(r["row_ix"], r["cell_ix"]): r["text"] for r in docx_io.cells_of(again, left).collect()}
    assert cells[0, 1] == "12" and cells[1, 1] == "yes"
    assert [r["checked"] for r in left.filter("kind = 'checkbox'").orderBy("seq").collect()] == [False, True]
    assert "☒" in xml and xml.count("☐") == 1


def test_patched_tokens_and_their_nodes(spark):
    _, nodes = shredded(spark, form_archive())
    tokens = docx_io.body_tokens(docx_io.tokens_of(nodes))
    rows = [("uploads/0.docx", 1, "p_3", "in the empty one"), ("uploads/0.docx", 2, "r_1", "Ann"), ("uploads/0.docx", 3, "p_1", "Slow"), ("uploads/0.docx", 1, "r_15", "run"), ("uploads/0.docx", 2, "p_14", "whole")]
    made = spark.createDataFrame([(*r, "replace_text") for r in rows], "doc_key string, patch_ord int, node_id string, text string, op string")
    texts = {r["block_ix"]: r["text"] for r in fields.paragraph_texts(patches.apply_text_patches(tokens, made)).collect()}
    assert texts == {0: "Name:\tAnn", 1: " Slow", 2: "in the empty one", 4: "whole\n"}


def test_positions_in_tables(spark):
    _, nodes = shredded(spark, form_archive())
    rows = [(1, 0, None, None, None, None), (2, 4, None, None, None, 1), (3, 3, 1, 1, None, 0), (4, 3, 1, 1, None, 1), (5, 3, None, None, None, None), (6, 3, 2, 1, 2, None), (7, 3, 9, 9, None, None), (8, 9, None, None, None, None)]
    asked = spark.createDataFrame([("uploads/0.docx", *r) for r in rows], "doc_key string, n int, block int, row int, cell int, para int, run int")
    tokens = docx_io.tokens_of(nodes).filter("section_kind = 'body' and not nested")
    got = {r["n"]: r["node_id"] for r in patches.resolve_positional_patches(asked, tokens).collect()}
    assert got == {1: "r_0", 2: "r_16", 3: "sdt_2", 4: "r_8", 6: "r_14"}
