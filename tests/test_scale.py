"""How often rows are dealt, and that tasks make no more than is asked for."""

import pytest
from pyspark.sql import functions as F

from folioforge.jobs import catalog, report
from folioforge.operators import patches, structure
from folioforge.sources import docx_io, fixtures, scratch

from .test_sources import form_archive, shredded

DATA = "/root/testdata/sf0.001"


def exchanges(df):
    return sum("Exchange" in line for line in df._jdf.queryExecution().executedPlan().toString().splitlines())


def test_named_columns_of_nodes(spark):
    blobs, nodes = shredded(spark, form_archive(), b"no archive", form_archive())
    names = ("doc_key", "seq", "tag", "error")
    got = docx_io.shred_docx(blobs, names)
    assert tuple(got.columns) == names
    order = lambda df: sorted(map(str, df.collect()))
    assert order(got) == order(nodes.select(*names)) and got.filter("error is not null").count() == 1
    # Places by brute force: a node's number among the children of its parent that are counted with it.
    body = nodes.filter("doc_key = 'uploads/2.docx' and section_kind = 'body'").orderBy("seq").collect()
    kind = lambda r: docx_io.COUNTED.get(r["tag"], r["tag"])
    for r in body[1:]:
        earlier = [x for x in body if x["parent_seq"] == r["parent_seq"] and x["seq"] < r["seq"]]
        in_cell = body[r["parent_seq"]]["tag"] == "tc"
        want = (r["tag"], r["seq"], sum(x["tag"] == r["tag"] if in_cell else kind(x) == kind(r) for x in earlier), sum(kind(x) == kind(r) for x in earlier))
        assert tuple(r["path"][-1]) == want and [tuple(x) for x in r["path"][:-1]] == [tuple(x) for x in body[r["parent_seq"]]["path"]]


def test_archives_are_one_group_of_documents(spark):
    tokens, cells = (fixtures.view(spark, DATA, n) for n in ("fx_tokens", "fx_cells"))
    assert exchanges(cells) == 1 and exchanges(fixtures.archives(tokens, cells)) == 2


def test_blocks_are_dealt_once(spark):
    _, nodes = shredded(spark, form_archive())
    assert exchanges(structure.build_blocks(nodes)) == 1


def test_tokens_are_dealt_once(spark):
    _, nodes = shredded(spark, form_archive())
    assert exchanges(docx_io.tokens_of(nodes)) == 1


def test_reports_read_nodes_once(spark):
    blobs, _ = shredded(spark, form_archive())
    plan = report.document_reports(docx_io.shred_docx(blobs))._jdf.queryExecution().executedPlan().toString()
    assert sum("MapInArrow" in line for line in plan.splitlines() if "(" in line and ":" in line or "+-" in line) == 1


def test_spans_need_one_deal_whose_parts_do_not_grow(spark, monkeypatch):
    cells = fixtures.view(spark, DATA, "fx_cells")
    assert exchanges(structure.resolve_vmerge(structure.table_grid(cells))) == 1
    tokens = fixtures.view(spark, DATA, "fx_tokens").withColumn("kind", F.lit("rendered"))
    few = scratch.parts_of(tokens)
    monkeypatch.setattr(scratch, "PART_BYTES", 1000)
    assert scratch.parts_of(tokens) > few == 4
    assert structure.rendered_break_hints(tokens)._jdf.queryExecution().executedPlan().toString().count("hashpartitioning(doc_key") == 1


def plan_of(spark, name):
    return catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["extract_fields", "fill_progress", "merge_fields", "extraction_gain", "field_prompt", "sync_field_values", "apply_text_patches", "resolve_positional_patches", "patches_from_html", "paragraph_html", "render_html", "render_documents", "block_summaries", "cell_styles", "cell_css"])
def test_rows_of_tables_are_dealt_and_nothing_that_is_made_of_them(spark, name):
    plan = plan_of(spark, name)
    assert "REPARTITION_BY_NUM" in plan and "ENSURE_REQUIREMENTS" not in plan and "REPARTITION_BY_COL" not in plan


def test_hints_are_parsed_once(spark):
    # A filter that went below the projection would parse a hint once for each of its names.
    plan = plan_of(spark, "parse_annotations").split("Generate", 1)[0]
    assert "variant" in plan.lower() and "parse_json" not in plan.lower()


def test_patches_that_meet_in_one_place(spark):
    tokens = spark.createDataFrame([("d", 0, 0, "text", "a", "r0", "p0"), ("d", 0, 0, "text", "b", "r0", "p0"), ("d", 1, 0, "tab", "", "r1", "p1"), ("d", 2, 0, "text", "c", None, "p2")], "doc_key string, block_ix int, run_ix int, kind string, text string, node_id string, para_node_id string")
    patch = spark.createDataFrame([("d", 1, "r0", "replace_text", "old"), ("d", 2, "r0", "replace_text", "new"), ("d", 1, "r1", "replace_text", "more"), ("d", 1, None, "replace_text", "none"), ("e", 1, "r0", "replace_text", "far")], "doc_key string, patch_ord int, node_id string, op string, text string")
    got = patches.apply_text_patches(tokens, patch)
    # Of two leaves at one place one gets the text and the other becomes empty; nothing is patched by a null node or from another document.
    assert got.columns == tokens.columns
    assert sorted((r.block_ix, r.run_ix, r.kind, r.text) for r in got.collect()) == [(0, 0, "text", ""), (0, 0, "text", "new"), (1, 0, "tab", ""), (1, 1, "text", "more"), (2, 0, "text", "c")]
    fields = spark.createDataFrame([("d", 0, "text", "x", ["r_0"]), ("d", 0, "text", "x", ["r_0"]), ("d", 1, "checkbox", None, ["sdt_0", "sdt_1"]), ("d", 2, "text", "y", [])], "doc_key string, block int, type string, value string, node_ids array<string>")
    edits = spark.createDataFrame([("d", "r_0", 1, "one"), ("d", "r_0", 2, "two"), ("d", "sdt_0", 5, "☒"), ("d", "sdt_1", 4, "☐"), ("d", None, 9, "none")], "doc_key string, node_id string, ts int, text string")
    assert sorted((r.block, r.value) for r in patches.sync_field_values(fields, edits).collect()) == [(0, "two"), (0, "two"), (1, "true"), (2, "y")]
    asked = spark.createDataFrame([("d", 0, None, None, 0), ("d", 0, None, None, 0), ("d", 6, 1, 1, 0), ("d", 6, None, None, 0), ("d", 0, 1, 1, 0), ("d", 9, None, None, 0)], "doc_key string, block int, row int, cell int, run int")
    places = spark.createDataFrame([("d", 0, None, None, 0, "r0"), ("d", 0, None, None, 0, "r0"), ("d", 6, 1, 1, 0, "c11"), ("d", 6, 0, 1, 0, "c01")], "doc_key string, block_ix int, row_ix int, cell_ix int, run_ix int, node_id string")
    assert sorted((r.block, r.row or 0, r.node_id) for r in patches.resolve_positional_patches(asked, places).collect()) == [(0, 0, "r0"), (0, 0, "r0"), (0, 1, "r0"), (6, 1, "c11")]
