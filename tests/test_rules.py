"""Hand-made rows for the branches of the rules."""

import io
import zipfile

from pyspark.sql import functions as F

from folioforge.functions import keys as K
from folioforge.functions import text as T
from folioforge.operators import fields, patches, pdf, structure, validate
from folioforge.sources import docx_io


def paragraphs(spark, rows):
    return spark.createDataFrame([("d", i, t, n, tab, ["p_1"]) for i, (t, n, tab) in enumerate(rows)], "doc_key string, block_ix int, text string, checkbox_count int, has_tab boolean, node_ids array<string>")


def test_paragraph_rules(spark):
    rows = [("  \xa0", 1, False), (": ____", 0, False), ("A: b: c", 0, False), ("  Yes: no", 1, False), ("No. 5: x", 0, False), ("Name:\t", 0, True), ("Date: 1/2/2024", 0, False), ("Sign here ____ now", 2, False), ("plain", 0, False)]
    got = sorted((r["block"], r["rule"], r["label"], r["type"], r["value"], r["confidence"], r["raw_value"]) for r in fields.fields_from_paragraphs(paragraphs(spark, rows)).collect())
    assert got == [
        (1, 3, ":", "text", None, 0.8, "____"),
        (2, 2, "A", "text", "b: c", 0.6, "b: c"),
        (3, 1, "Yes: no", "checkbox", None, 0.9, None),
        (3, 2, "Yes", "text", "no", 0.6, "no"),
        (4, 2, "No. 5", "text", "x", 0.6, "x"),
        (5, 2, "Name", "text", None, 0.85, ""),
        (6, 2, "Date", "date", "1/2/2024", 0.6, "1/2/2024"),
        (7, 1, "Sign here ____ now", "choice", None, 0.9, None),
        (7, 3, "Sign here", "text", None, 0.8, "____ now"),
    ]


def test_table_rules(spark):
    rows = [(0, 0, "only:", 0), (1, 0, " ", 0), (1, 1, "x", 0), (2, 0, "Head", 0), (2, 1, "Value", 0), (3, 0, "Sure?", 0), (3, 1, "__", 0), (4, 0, "Pick", 0), (4, 1, "", 2), (5, 0, "Total", 0), (5, 1, "____", 0)]
    cells = spark.createDataFrame([("d", 0, *r) for r in rows], "doc_key string, block_ix int, row_ix int, cell_ix int, text string, checkbox_count int")
    got = sorted((r["row"], r["label"], r["type"], r["value"], r["confidence"]) for r in fields.fields_from_tables(cells).collect())
    assert got == [(3, "Sure?", "text", "__", 0.6), (4, "Pick", "choice", None, 0.85), (5, "Total", "number", None, 0.8)]


def test_node_ids_follow_a_sequential_counter(spark):
    import random

    draw, rows, want = random.Random(2), [], {}
    for doc in range(40):
        counter = 0
        for seq in range(draw.randint(1, 30)):
            existing = f"p_{draw.randint(0, 40)}" if draw.random() < 0.3 else None
            if existing:
                counter = max(counter, int(existing[2:]) + 1)
                want[doc, seq] = existing
            else:
                want[doc, seq] = f"p_{counter}"
                counter += 1
            rows.append((doc, 0, seq, "p", existing))
    got = structure.assign_node_ids(spark.createDataFrame(rows, "doc_id int, part_ord int, seq int, prefix string, existing string"))
    assert {(r["doc_id"], r["seq"]): r["node_id"] for r in got.collect()} == want


def test_merged_cells(spark):
    rows = [(0, 0, "restart"), (1, 0, "continue"), (2, 0, "continue"), (3, 0, ""), (4, 0, "continue"), (5, 0, "restart")]
    cells = spark.createDataFrame([("d", 0, r, c, 1, v) for r, c, v in rows], "doc_key string, block_ix int, row_ix int, cell_ix int, colspan int, vmerge string")
    got = structure.resolve_vmerge(structure.table_grid(cells)).select("row_ix", "rowspan").collect()
    assert sorted(map(tuple, got)) == [(0, 3), (3, 1), (5, 1)]


def test_pages(spark):
    rows = [(0, "paragraph", True, None), (1, "table", False, 2), (2, "table", False, 0), (3, "paragraph", False, 1), (4, "paragraph", True, None)]
    blocks = spark.createDataFrame([(1, *r) for r in rows], "doc_id int, block_ix int, block_type string, page_break_before boolean, break_row int")
    got = structure.paginate(blocks).orderBy("block_ix", "part").select("block_ix", "part", "row_from", "row_to", "page_no").collect()
    assert [tuple(r) for r in got] == [(0, 0, 0, None, 0), (1, 0, 0, 2, 0), (1, 1, 2, None, 1), (2, 0, 0, None, 2), (3, 0, 0, None, 2), (3, 1, 0, None, 3), (4, 0, 0, None, 4)]


def test_values_and_keys(spark):
    one = spark.range(1)
    cell = lambda c: one.select(c.alias("x")).first()[0]
    error = lambda kind, v: cell(T.validate_field(F.lit(kind), F.lit(v)))
    assert error("number", "0x10") is None and error("number", " 1e3 ") is None and error("number", "1d") and error("number", "NaN")
    assert error("date", "2024-1-2") is None and error("date", "1.2.24") is None and error("date", "May 1") and error("checkbox", "?") is None
    assert cell(T.field_id(F.lit(1234))) == "field_1234" and cell(T.field_id(F.lit(7))) == "field_007"
    assert cell(K.converted_html_key(F.lit("uploads/a.b/c.docx"))) == "converted/a.b/c.html" and cell(K.converted_html_key(F.lit("x/.hidden"))) == "converted/x/.hidden.html"
    assert cell(K.export_key(F.lit("a/uploads/b/uploads/c.docx"))) == "a/exported/b/uploads/c-exported.docx" and cell(K.export_key(F.lit("f.PDF"))) == "f-filled.pdf"
    assert cell(T.extract_json(F.lit('x {"a": 1} y'))) == '{"a": 1}' and cell(T.extract_json(F.lit('```json\n{"a": 2}\n```'))) == '{"a": 2}' and cell(T.extract_json(F.lit("none"))) is None
    assert cell(T.nbsp_spaces(F.lit("a b   c"), F.lit(False))) == "a b\xa0\xa0\xa0c"
    assert cell(T.value_target(F.array(F.lit("p_1"), F.lit("r_2"), F.lit("sdt_3")))) == "r_2" and cell(T.value_target(F.array().cast("array<string>"))) is None


def test_patches_and_pages(spark):
    tokens = spark.createDataFrame([("d", 0, 0, "text", "a", "r_1"), ("d", 0, 1, "text", "b", "r_1"), ("d", 0, 2, "checkbox", "☐", "sdt_1")], "doc_key string, block_ix int, run_ix int, kind string, text string, node_id string")
    made = spark.createDataFrame([("d", "r_1", "replace_text", "new", None), ("d", "sdt_1", "toggle_checkbox", None, True)], "doc_key string, node_id string, op string, text string, checked boolean")
    got = patches.apply_checkbox_patches(patches.apply_text_patches(tokens, made), made).orderBy("run_ix")
    assert [r["text"] for r in got.collect()] == ["new", "", "☒"]
    image = lambda rows: spark.createDataFrame([("d", p, w, 1, data) for p, w, data in rows], "doc_id string, page int, width int, height int, data binary")
    diffs = validate.page_diff(image([(0, 2, bytearray(b"\0" * 6)), (1, 2, bytearray(b"\1" * 6)), (2, 2, bytearray(b"\1" * 7)), (3, 2, bytearray(b"\1" * 6)), (4, 2, bytearray(b"\1" * 8))]), image([(0, 2, bytearray(b"\0\0\0\0\0\x09")), (2, 2, bytearray(b"\1" * 7)), (3, 3, bytearray(b"\1" * 6)), (4, 2, bytearray(b"\1" * 8)), (5, 1, bytearray(b"\1"))]))
    assert sorted(tuple(r)[1:] for r in diffs.collect()) == [(0, 1.5, 9, 50.0, True, True), (1, 1.0, 255, 100.0, True, False), (2, 1.0, 255, 100.0, True, True), (3, 1.0, 255, 100.0, True, True), (4, 0.0, 0, 0.0, True, True), (5, 1.0, 255, 100.0, False, True)]
    total = validate.diff_summary(diffs).first()
    assert (total["candidate_pages"], total["reference_pages"], total["compared"], total["changed"], total["identical"], total["passed"]) == (5, 5, 4, 5, False, True)
    region = spark.createDataFrame([(1, 0, f"p0_r{i}", "text", 0.0, 0.0, w, 20.0, v, None) for i, (w, v) in enumerate([(30.0, "x" * 20), (30.0, "iii"), (50.0, "mmmmm"), (30.0, "")])], "doc_id int, page int, id string, type string, x double, y double, w double, h double, value string, acro_field_name string")
    glyphs = spark.createDataFrame([("i", 0.2), ("m", 1.1)], "char string, width double")
    plan = {r["id"]: r["font_size"] for r in pdf.stamp_plan(region, region.select("doc_id", "page"), glyphs).collect()}
    assert plan == {"p0_r0": 4.0, "p0_r1": 11.0, "p0_r2": 9.0}


def test_chains_of_styles_by_document(spark):
    chain = [(1, f"s{i}", f"s{i - 1}" if i else None, 5 if i == 0 else None) for i in range(150)] + [(2, "s1", "s0", None), (2, "s0", "s1", 9), (3, "s1", "gone", None)]
    styles = spark.createDataFrame(chain, "doc_id int, style_id string, based_on string, m int")
    got = {(r["doc_id"], r["style_id"]): r["m"] for r in structure.resolve_table_styles(styles, ["m"]).collect()}
    assert all(got[1, f"s{i}"] == 5 for i in range(150)) and got[2, "s1"] == got[2, "s0"] == 9 and got[3, "s1"] is None and len(got) == 153


def test_documents_that_one_side_lacks(spark):
    counts = lambda rows: spark.createDataFrame([(d, n, 0, 0) for d, n in rows], "doc_id string, paragraphs long, tables long, images long")
    got = {r["doc_id"]: (r["valid"], r["mismatches"]) for r in validate.validate_structure(counts([("a", 1), ("b", 2), ("c", 3)]), counts([("a", 1), ("b", 3), ("d", 4)])).collect()}
    assert got == {"a": (True, ""), "b": (False, "paragraphs=2/3"), "c": (False, "paragraphs=3/none;tables=0/none;images=0/none"), "d": (False, "paragraphs=none/4;tables=none/0;images=none/0")}


def test_rendered_breaks_in_tables(spark):
    rows = [(0, 0, 0, 0, "text", "a"), (0, 0, 1, 0, "rendered", ""), (0, 1, 0, 0, "rendered", ""), (1, 0, 0, 0, "rendered", "")]
    tokens = spark.createDataFrame([("d", 3, r, c, p, i, k, t) for r, c, p, i, k, t in rows] + [("d", 4, None, None, 0, 0, "text", ""), ("d", 4, None, None, 0, 1, "rendered", "")], "doc_key string, block_ix int, row_ix int, cell_ix int, para_ix int, run_ix int, kind string, text string")
    got = sorted(tuple(r) for r in structure.rendered_break_hints(tokens).select("block_ix", "row_ix", "cell_ix", "para_ix", "at_start").collect())
    assert got == [(3, 0, 0, 1, False), (4, None, None, 0, True)]


def archive(text="Name: ____"):
    space = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document {space}><w:body><w:p><w:r><w:t>{text}</w:t></w:r></w:p><w:p><w:r><w:t>Total:</w:t><w:tab/></w:r></w:p></w:body></w:document>')
        z.writestr("word/styles.xml", f"<w:styles {space}/>")
        z.writestr("word/media/a.png", b"\x89PNG" * 40)
    return out.getvalue()


def test_archives_are_shredded_patched_and_written(spark):
    blobs = spark.createDataFrame([("uploads/a.docx", bytearray(archive())), ("uploads/b.docx", bytearray(b"no archive"))], "doc_key string, content binary")
    nodes = docx_io.shred_docx(blobs)
    assert nodes.filter("error is not null").select("doc_key").collect()[0][0] == "uploads/b.docx"
    tokens = docx_io.tokens_of(nodes)
    assert [tuple(r) for r in tokens.orderBy("block_ix", "run_ix").select("block_ix", "kind", "text").collect()] == [(0, "text", "Name: ____"), (1, "text", "Total:"), (1, "tab", "")]
    found = fields.fields_from_paragraphs(fields.paragraph_texts(tokens))
    assert sorted((r["label"], r["type"]) for r in found.collect()) == [("Name", "text"), ("Total", "number")]
    edit = tokens.filter("block_ix = 0").select("doc_key", F.lit(docx_io.BODY).alias("part_name"), "seq", F.lit("text").alias("action"), F.lit("Name: Ann").alias("value"))
    written = docx_io.write_docx(blobs, edit).collect()
    assert written[0]["out_key"] == "exported/a-exported.docx"
    again = docx_io.tokens_of(docx_io.shred_docx(spark.createDataFrame([("x", written[0]["content"])], "doc_key string, content binary")))
    assert again.orderBy("block_ix").first()["text"] == "Name: Ann"
    with zipfile.ZipFile(io.BytesIO(written[0]["content"])) as z:
        assert z.read("word/media/a.png") == b"\x89PNG" * 40
