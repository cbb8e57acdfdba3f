"""Pages as the renderer writes them are read without the general parser, and to the same patches; what the plain renderer leaves out."""

import pytest
from pyspark.sql import functions as F

from folioforge.functions import text
from folioforge.operators import render
from folioforge.operators.patches import _Nodes

BOX = '<span data-type="checkbox" style="font-family:serif">☒</span>'
PLAIN = [
    f'<p data-node-id="p_1" data-node-kind="paragraph" data-block="1"><span data-run="0" data-node-id="r_1" data-node-kind="run" style="color: #FF0000"><strong>a &amp; b&emsp;&lt;c&gt;\xa0&copy x</strong></span><a data-run="1" href="http://e.org/?a=1&amp;b=2"><span data-node-id="r_2" data-node-kind="run">{BOX}<br>x</span></a></p>',
    '<p class="docx-empty-paragraph" data-node-id="p_2" data-node-kind="paragraph"></p>', '<p data-node-id="p_1" data-node-kind="paragraph">one <img src="x" alt=""> &notit; two</p></p><td>', '<div>\n<p data-node-id="p_1" data-node-id="p_9" data-node-kind="paragraph">open<span data-node-id="" data-node-kind="run">none</span>',
]
OTHER = [
    '<p data-node-id="p&amp;1" data-node-kind="paragraph">x</p>', '<P DATA-NODE-ID="p_1" data-node-kind="paragraph">x</P>', '<p data-node-id="p_1" data-node-kind=paragraph>x</p>', '<p data-node-id="p_1" data-node-kind="paragraph">a < b <!-- <p> --> c<br/></p>',
    '<p data-node-id="p_1" data-node-kind="paragraph"><script><p data-node-id="p_2" data-node-kind="paragraph">no</p></script></p>', '<p data-node-id="p_1" data-node-kind="paragraph">rest', "<p data-node-id='p_1' data-node-kind='paragraph'>x</p >", "text", "",
]


@pytest.mark.parametrize("page", PLAIN + OTHER)
def test_plain_pages_give_the_same_patches(page):
    want, got = _Nodes(), _Nodes()
    want.feed(page)
    plain = got.plain(page)
    assert not plain if page in OTHER else plain == page.endswith(">")
    assert not plain or got.patches() == want.patches()


def test_spaces_that_stand_alone_are_left(spark):
    rows = spark.createDataFrame([("a b",), ("a  b",), (" a   ",), ("",), (None,)], "t string")
    assert [r[0] for r in rows.select(text.nbsp_spaces(F.col("t"), F.lit(False))).collect()] == ["a b", "a\xa0\xa0b", " a\xa0\xa0\xa0", "", None]


def test_no_windows_for_what_tables_cannot_have(spark):
    tokens = spark.createDataFrame([("d", 0, 0, "text", "a", "r", "p")], "doc_key string, block_ix int, run_ix int, kind string, text string, node_id string, para_node_id string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(render.paragraph_html(tokens)) and "Window" not in plan(render.render_html(tokens, None))
    cells = spark.createDataFrame([("d", 1, 0, 0, "t")], "doc_key string, block_ix int, row_ix int, cell_ix int, text string")
    assert plan(render.render_html(tokens, cells)).count("Window [") < plan(render.render_html(tokens, cells.withColumn("hidden", F.lit(False)))).count("Window [")
