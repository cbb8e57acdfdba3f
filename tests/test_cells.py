"""Borders, fill and first paragraph of cells."""

from folioforge.jobs import catalog
from folioforge.operators import structure


def test_borders_of_cells(spark):
    rows = [
        ("d", 0, 0, 1, "top", "cell", "tcBorders", {"val": "double", "sz": "12", "color": "aabbcc"}), ("d", 0, 0, 2, "left", "cell", "tcBorders", {"val": "dashed", "color": "auto"}), ("d", 0, 0, 3, "bottom", "cell", "tcBorders", {"val": "nil", "sz": "8"}),
        ("d", 0, 0, 4, "right", "cell", "tcMar", {"w": "30"}), ("d", 0, 0, 5, "shd", "cell", "tcPr", {"fill": "ffee00"}), ("d", 1, 0, 0, "shd", "cell", "tcPr", {"fill": "Auto"}), ("d", 1, 0, 1, "top", "cell", "tcBorders", {"val": "", "sz": "8"}),
        # The second paragraph is aligned, the first is not; in the next cell the first one is.
        ("d", 2, 0, 0, "p", "paragraph", None, {}), ("d", 2, 1, 1, "jc", "paragraph", "pPr", {"val": "end"}), ("d", 3, 0, 0, "jc", "paragraph", "pPr", {"val": "both"}), ("d", 3, 1, 1, "jc", "paragraph", "pPr", {"val": "end"}),
    ]
    nodes = spark.createDataFrame(rows, "doc_id string, cell int, para int, seq int, tag string, owner string, `group` string, attrs map<string,string>")
    got = {r.cell: r for r in structure.cell_styles(nodes).collect()}
    assert {e: tuple(b) for e, b in got[0].borders.items()} == {"top": ("double", 1.5, "AABBCC"), "left": ("solid", 0.5, "000000")}
    assert got[0].fill == "FFEE00" and got[1].fill is None and got[1].borders == {}
    assert (got[2].alignment, got[3].alignment) == (None, "both")


def test_the_query_has_borders(spark):
    got = catalog.QUERIES["cell_styles"](spark, "/root/testdata/sf0.001")
    assert "borders" in got.columns and got.filter("borders like 'top double % AABBCC%'").count() > 0
