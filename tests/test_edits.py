"""Rows of named elements, and edits of patches by one deal of each input."""

from pyspark.sql import functions as F

from folioforge.operators import structure, styles
from folioforge.sources import docx_io, fixtures, scratch

from .test_scale import DATA, plan_of
from .test_sources import form_archive, shredded


def test_parts_follow_rows_however_tight_their_files_are(spark, monkeypatch):
    parts = lambda: fixtures.view(spark, DATA, "fx_blocks").rdd.getNumPartitions()
    assert parts() == 4
    monkeypatch.setattr(scratch, "PART_ROWS", 500)
    assert parts() == -(-sum(spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("orders", "lineitem")) // 500)


def test_names_of_styles_are_rows_beside_paragraphs(spark):
    for name in ("paragraph_css", "paragraph_styles"):
        plan = plan_of(spark, name)
        assert "Join" not in plan and "ENSURE_REQUIREMENTS" not in plan and "REPARTITION_BY_NUM" in plan
    rows = [("d", 0, "pStyle", {"val": "A"}), ("d", 1, "pStyle", {"val": "B"}), ("d", 2, "jc", {"val": "end"}), ("e", 0, "pStyle", {"val": "A"})]
    nodes = spark.createDataFrame(rows, "doc_id string, para int, tag string, attrs map<string,string>")
    names = spark.createDataFrame([("d", "A", "one"), ("d", "A", "two"), ("d", None, "none"), ("d", "B", None)], "doc_id string, style_id string, name string")
    got = styles.paragraph_styles(nodes, names).collect()
    assert sorted((r.doc_id, r.para, r.style_id or "", r.style_name or "") for r in got) == [("d", 0, "A", "one"), ("d", 0, "A", "two"), ("d", 1, "B", "B"), ("d", 2, "", ""), ("e", 0, "A", "A")]


def test_maps_of_attributes_are_not_sorted(spark):
    for name in ("cell_styles", "cell_css"):
        sorts = [line for line in plan_of(spark, name).split("SortAggregate") if "Sort [" in line]
        assert sorts and "attrs" not in plan_of(spark, name).split("Sort [")[0]
    rows = [("d", 0, 1, "jc", "paragraph", {"val": "b"}), ("d", 0, 0, "jc", "paragraph", {"val": "a"}), ("d", 0, 2, "jc", "run", {"val": "z"}), ("d", 1, 0, "jc", "paragraph", {"val": "a"}), ("d", 1, 1, "jc", "cell", {"val": "c"}), ("d", 1, 2, "shd", "cell", {"fill": "auto"}), ("d", 2, 0, "vAlign", "cell", {"val": "top"})]
    got = structure.cell_styles(spark.createDataFrame(rows, "doc_id string, cell int, seq int, tag string, owner string, attrs map<string,string>")).collect()
    assert sorted(map(tuple, got)) == [("d", 0, None, "a", None), ("d", 1, None, "c", None), ("d", 2, "top", None, None)]


def order(df):
    return sorted(map(str, df.collect()))


def test_rows_of_named_elements(spark):
    blobs, nodes = shredded(spark, form_archive(), b"no archive", form_archive())
    names = ("doc_key", "section_kind", "seq", "parent_seq", "depth", "tag", "attrs", "text", "existing", "path", "error")
    got = docx_io.shred_docx(blobs, names, ("t", "sdt", "none"), ("body",))
    want = nodes.filter("error is not null or (section_kind = 'body' and tag in ('t', 'sdt'))").select(*names)
    assert order(got) == order(want) and got.count() > 10


def test_flat_columns_follow_the_path(spark):
    blobs, nodes = shredded(spark, form_archive(), form_archive())
    flat = docx_io.shred_docx(blobs, ("doc_key", "part_ord", "seq", *docx_io._FLAT))
    tags = lambda f: F.filter("path", f)["seq"]
    box = tags(lambda x, i: (x["tag"] == "sdt") | ((x["tag"] == "r") & (F.get("path", i + 1)["tag"] == "sdt")))
    want = nodes.select("doc_key", "part_ord", "seq", F.try_element_at("path", F.lit(-2))["tag"].alias("parent_tag"), tags(lambda x: x["tag"].isin("p", "r", "sdt")).alias("above"), box.alias("boxes"), F.exists("path", lambda x: x["tag"] == "sdtContent").alias("in_content"))
    assert order(flat) == order(want)


def patched(spark):
    rows = [(1, "p_0", "Ann", None), (2, "r_0", "Bob", None), (3, "r_0", "last", None), (1, "sdt_0", None, True), (2, "p_3", "new", None), (1, "r_999", "lost", None), (9, None, "none", None)]
    return spark.createDataFrame([("uploads/0.docx", *r) for r in rows], "doc_key string, patch_ord int, node_id string, text string, checked boolean").withColumn("operation", F.lit(None).cast("string"))


def test_edits_by_path_and_by_flat_columns(spark):
    blobs, nodes = shredded(spark, form_archive(), form_archive())
    flat = docx_io.shred_docx(blobs, ("doc_key", "part_ord", "part_name", "section_kind", "seq", "tag", "existing", *docx_io._FLAT), ("p", "r", "sdt", "t", "checked"), docx_io.SECTIONS)
    got = docx_io.patch_edits(flat, patched(spark))
    assert order(got) == order(docx_io.patch_edits(nodes, patched(spark)))
    found = {(r["action"], r["value"]) for r in got.collect()}
    # The later patch of a run holds against the earlier one of its paragraph; a paragraph without a run gets one; the box is ticked in both places.
    assert found == {("text", "last"), ("checked", "1"), ("text", "☒"), ("add_to_p", "new")}


def test_edits_need_no_joins(spark):
    _, nodes = shredded(spark, form_archive())
    plan = docx_io.patch_edits(nodes, patched(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 4
