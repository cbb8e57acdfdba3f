"""Archives to HTML: hand-made archives against the page that they must give."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from folioforge.jobs import convert
from folioforge.operators import render, structure, styles
from folioforge.sources import docx_io, properties
from folioforge.sources.scratch import kept

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:wp="http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing"'
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TABLE = '<table{} style="width: 100%; border-collapse: collapse; table-layout: fixed;">'
CELL = "padding: 0px 7px; vertical-align: top; overflow-wrap: break-word"


def p(text="", ppr="", rpr=""):
    run = f"<w:r>{f'<w:rPr>{rpr}</w:rPr>' if rpr else ''}<w:t>{text}</w:t></w:r>" if text else ""
    return f"<w:p>{f'<w:pPr>{ppr}</w:pPr>' if ppr else ''}{run}</w:p>"


def tbl(*rows, pr="", grid=""):
    return f"<w:tbl><w:tblPr>{pr}</w:tblPr>{grid}" + "".join(f"<w:tr>{''.join(r)}</w:tr>" for r in rows) + "</w:tbl>"


def tc(inner, pr=None):
    return f"<w:tc>{'' if pr is None else f'<w:tcPr>{pr}</w:tcPr>'}{inner}</w:tc>"


def archive(body, parts=(), styles_xml="", numbering="", theme="", rels=(), media=()):
    file = io.BytesIO()
    kinds = [(f"rId{i}", name.rstrip("0123456789"), f"{name}.xml") for i, (name, _) in enumerate(parts)] + list(rels)
    with zipfile.ZipFile(file, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f"<w:styles {W}>{styles_xml}</w:styles>")
        z.writestr("word/_rels/document.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="{i}" Type="{OFFICE}/{k}" Target="{t}"/>' for i, k, t in kinds) + "</Relationships>")
        for name, xml in parts:
            root = "hdr" if name.startswith("header") else "ftr"
            z.writestr(f"word/{name}.xml", f"<w:{root} {W}>{xml}</w:{root}>")
        if numbering:
            z.writestr("word/numbering.xml", f"<w:numbering {W}>{numbering}</w:numbering>")
        if theme:
            z.writestr("word/theme/theme1.xml", theme)
        for name, data in media:
            z.writestr(name, data)
    return file.getvalue()


CASES = {}


def case(f):
    """An archive and the pages that it must give; all of them are converted together."""
    CASES[f.__name__.removeprefix("case_")] = f()
    return f


@pytest.fixture(scope="module")
def pages(spark):
    blobs = spark.createDataFrame([*((n, bytearray(a)) for n, (a, _) in CASES.items()), ("broken", bytearray(b"no archive"))], "doc_key string, content binary")
    return {r["doc_key"]: r["html"] for r in convert.convert(blobs).collect()}


def page(content, top=48, bottom=48, header="", footer=""):
    around = [f'<div class="docx-page-{k}">{x}</div>' if x else "" for k, x in (("header", header), ("footer", footer))]
    padding = f' style="padding-top:{top}px;padding-bottom:{bottom}px"' if top or bottom else ""
    return f'<div class="docx-page">{around[0]}<div class="docx-page-content"{padding}>{content}</div>{around[1]}</div>'


def document(*pages):
    return '<div class="document">\n' + "\n".join(pages) + "\n</div>"


def run(text, no, node, css=""):
    return f'<span{"" if no is None else f" data-run={chr(34)}{no}{chr(34)}"} data-node-id="r_{node}" data-node-kind="run"{f" style={chr(34)}{css}{chr(34)}" if css else ""}>{text}</span>'


def para(inner, node, place="", css="", tag="p"):
    empty = "" if inner else ' class="docx-empty-paragraph"'
    at = "" if place == "" else ' data-block="{}" data-para="{}"'.format(*place)
    return f'<{tag}{empty} data-node-id="p_{node}" data-node-kind="paragraph"{at}{f" style={chr(34)}{css}{chr(34)}" if css else ""}>{inner}</{tag}>'


@case
def case_styles_lists_and_the_last_header():
    names = '<w:style w:type="paragraph" w:styleId="T1"><w:name w:val="heading 2"/></w:style><w:style w:type="character" w:styleId="T2"><w:name w:val="heading 3"/></w:style>'
    numbers = '<w:abstractNum w:abstractNumId="9"><w:lvl w:ilvl="0"><w:numFmt w:val="lowerRoman"/></w:lvl></w:abstractNum><w:num w:numId="4"><w:abstractNumId w:val="9"/></w:num>'
    item = '<w:numPr><w:ilvl w:val="0"/><w:numId w:val="4"/></w:numPr>'
    body = p("Title", '<w:pStyle w:val="T1"/><w:jc w:val="both"/><w:spacing w:before="150" w:after="x" w:line="360"/><w:ind w:left="300" w:hanging="75"/><w:rPr><w:b/></w:rPr>', '<w:sz w:val="25"/><w:rFonts w:hAnsi="Arial"/><w:color w:val="00FF00"/><w:i w:val="0"/><w:strike/><w:vertAlign w:val="superscript"/>')
    body += p("one", item) + p("two", item) + p("between", '<w:pStyle w:val="T2"/>') + p("three", item) + p()
    made = archive(body, [("header1", p("FIRST")), ("header2", p("SECOND")), ("footer1", p("low")), ("footer2", p("lower"))], names, numbers)
    head = para('<span data-run="0" data-node-id="r_0" data-node-kind="run" style="font-size: 12.5pt; font-family: \'Arial\'; color: #00FF00; text-decoration: line-through"><em><sup>Title</sup></em></span>', 0, (0, 0), "text-align: left; margin-top: 10px; line-height: 1.5; padding-left: 20px; text-indent: -5px", "h2")
    li = lambda text, n: f'<li data-node-id="p_{n}" data-node-kind="paragraph">{run(text, None, n)}</li>'
    ol = '<ol style="list-style-type: lower-roman">{}</ol>'
    content = head + ol.format(li("one", 1) + li("two", 2)) + para(run("between", 0, 3), 3, (3, 0)) + ol.format(li("three", 4)) + para("", 5, (5, 0))
    return made, document(page(content, 0, 0, para(run("SECOND", 0, 6), 7), para(run("lower", 0, 8), 9)))


@case
def case_tables_in_cells_three_levels_deep():
    inner = tbl([tc(p("c"))])
    middle = tbl([tc(p("b") + inner + p(), '<w:jc w:val="end"/>'), tc(p())])
    made = archive(p("a") + tbl([tc(p("x") + middle + p("y", '<w:jc w:val="center"/>'))], grid="<w:tblGrid><w:gridCol w:w='100'/><w:gridCol/><w:gridCol w:w='200'/></w:tblGrid>"))
    low = TABLE.format("") + f'<tr data-row="0"><td data-cell="0" style="{CELL}">' + para(run("c", 0, 3), 3) + "</td></tr></table>"
    mid = TABLE.format("") + f'<tr data-row="0"><td data-cell="0" style="{CELL}; text-align: right">' + para(run("b", 0, 2), 2) + low + para("", 4) + f'</td><td data-cell="1" style="{CELL}">' + para("", 5) + "</td></tr></table>"
    cols = '<colgroup><col style="width: 33.33%;"><col><col style="width: 66.67%;"></colgroup>'
    high = TABLE.format(' data-block="1"') + cols + f'<tr data-row="0"><td data-cell="0" style="{CELL}">' + para(run("x", 0, 1), 1, (1, 0)) + mid + para(run("y", 0, 4), 6, (1, 2), "text-align: center") + "</td></tr></table>"
    return made, document(page(para(run("a", 0, 0), 0, (0, 0)) + high))


@case
def case_merged_cells_styles_of_tables_and_rows():
    sheet = (
        '<w:style w:type="table" w:styleId="Base"><w:tblPr><w:tblBorders><w:top w:val="single" w:sz="4" w:color="auto"/><w:insideV w:val="double" w:sz="12" w:color="aabbcc"/></w:tblBorders><w:tblCellMar><w:left w:w="150"/><w:top w:w="x"/></w:tblCellMar></w:tblPr></w:style>'
        '<w:style w:type="table" w:styleId="Grid"><w:basedOn w:val="Base"/><w:tblPr><w:tblBorders><w:top w:val="nil"/><w:bottom w:val="single"/></w:tblBorders><w:tblCellMar><w:right w:w="30"/></w:tblCellMar></w:tblPr></w:style>'
    )
    rows = ["<w:trPr><w:trHeight w:val='450'/></w:trPr>" + tc(p("a"), '<w:vMerge w:val="restart"/><w:shd w:fill="ffee00"/>') + tc(p("b", '<w:jc w:val="center"/>'), '<w:gridSpan w:val="2"/><w:vAlign w:val="center"/><w:tcBorders><w:left w:val="single" w:sz="8" w:color="FF0000"/></w:tcBorders>'), tc(p("gone"), "<w:vMerge/>") + tc(p("c"), '<w:shd w:fill="auto"/>') + tc(p("d", '<w:jc w:val="right"/>'))]
    made = archive(tbl(*rows, pr='<w:tblStyle w:val="Grid"/><w:tblBorders><w:bottom w:val="double"/></w:tblBorders>'), styles_xml=sheet)
    pad = "padding: 0px 2px 0px 10px; vertical-align: {}; overflow-wrap: break-word{}"
    edges = "border-top: 0.5pt solid #000000; border-left: 1.5pt double #AABBCC; border-bottom: 0.5pt double #000000; border-right: 1.5pt double #AABBCC"
    cell = lambda n, inner, more="", va="top", css="": f'<td data-cell="{n}"{more} style="{pad.format(va, css)}; {edges if "center" not in css else edges.replace("border-left: 1.5pt double #AABBCC", "border-left: 1.0pt solid #FF0000")}">{inner}</td>'
    content = TABLE.format(' data-block="0"') + '<tr data-row="0" style="height: 30px">' + cell(0, para(run("a", 0, 0), 0, (0, 0)), ' rowspan="2"', css="; background-color: #FFEE00") + cell(1, para(run("b", 0, 1), 1, (0, 0), "text-align: center"), ' colspan="2"', "middle", "; text-align: center") + "</tr>"
    content += '<tr data-row="1">' + cell(0, para(run("c", 0, 3), 3, (0, 0))) + cell(1, para(run("d", 0, 4), 4, (0, 0), "text-align: right")) + "</tr></table>"
    return made, document(page(content))


@case
def case_pages():
    broken = '<w:p><w:r><w:t>one</w:t><w:br w:type="page"/><w:t>two</w:t></w:r><w:r><w:t>three</w:t></w:r></w:p>'
    rendered = "<w:p><w:r><w:t>mid</w:t></w:r><w:r><w:lastRenderedPageBreak/><w:t>dle</w:t></w:r></w:p>"
    start = "<w:p><w:r><w:lastRenderedPageBreak/><w:t>start</w:t></w:r></w:p>"
    table = tbl([tc(p("t0"))], [tc("<w:p><w:r><w:t>t</w:t></w:r><w:r><w:lastRenderedPageBreak/><w:t>1</w:t></w:r></w:p>")])
    link = '<w:p><w:hyperlink r:id="none"><w:r><w:t>a</w:t><w:br w:type="page"/><w:t>b</w:t></w:r></w:hyperlink></w:p>'
    setup = '<w:sectPr><w:pgSz w:w="12240" w:h="15840"/><w:pgMar w:top="1440" w:bottom="0"/></w:sectPr>'
    made = archive(broken + rendered + start + table + p("asked", "<w:pageBreakBefore/>") + link + setup)
    pages = [
        para(run("one", 0, 0), 0, (0, 0)),
        para(run("two", 0, 0) + run("three", 1, 1), 0, (1, 0)) + para(run("mid", 0, 2) + run("dle", 1, 3), 1, (2, 0)),
        para(run("mid", 0, 2) + run("dle", 1, 3), 1, (2, 0)),
        para(run("start", 0, 4), 2, (3, 0)) + TABLE.format(' data-block="4"') + f'<tr data-row="0"><td data-cell="0" style="{CELL}">' + para(run("t0", 0, 5), 3, (4, 0)) + "</td></tr></table>",
        TABLE.format(' data-block="4"') + f'<tr data-row="0"><td data-cell="0" style="{CELL}">' + para(run("t", 0, 6) + run("1", 1, 7), 4, (4, 0)) + "</td></tr></table>",
        para(run("asked", 0, 8), 5, (5, 0)) + para(f'<span data-run="0">{run("a<br>b", None, 9)}</span>', 6, (6, 0)),
    ]
    return made, document(*[page(x, 96, 48) for x in pages])


@case
def case_links_and_images():
    def drawing(rel, inner):
        return f'<w:r><w:drawing>{inner}<a:graphic><a:graphicData><a:blip r:embed="{rel}"/></a:graphicData></a:graphic></w:drawing></w:r>'

    size = '<wp:extent cx="914400" cy="457200"/>'
    anchor = lambda offset, side="page": f'<wp:anchor>{size}<wp:positionH relativeFrom="{side}"><wp:posOffset>{offset}</wp:posOffset></wp:positionH></wp:anchor>'
    body = '<w:p><w:hyperlink r:id="rL"><w:r><w:t>go &amp; see</w:t></w:r></w:hyperlink><w:r><w:t>.</w:t></w:r></w:p>'
    body += f"<w:p>{drawing('rI', f'<wp:inline>{size}</wp:inline>')}</w:p><w:p>{drawing('rI', anchor(100))}</w:p><w:p>{drawing('rI', anchor(4000000))}<w:r><w:t>text</w:t></w:r></w:p><w:p>{drawing('rI', anchor(100, 'character'))}</w:p><w:p>{drawing('rGone', '')}</w:p>"
    made = archive(body, rels=[("rL", "hyperlink", "http://e.org/?a=1&amp;b"), ("rI", "image", "media/i.png")], media=[("word/media/i.png", b"png")])
    image = lambda css: f'<img src="data:image/png;base64,cG5n" alt="" class="docx-image" style="max-width: 100%; height: auto{css}" width="96" height="48">'
    flex = "display: flex; align-items: center; justify-content: flex-end"
    content = para(f'<a data-run="0" href="http://e.org/?a=1&amp;b">{run("go &amp; see", None, 0)}</a>{run(".", 1, 1)}', 0, (0, 0))
    content += para(run(image(""), 0, 2), 1, (1, 0)) + para(run(image("; display: block; float: left; margin-right: 8px"), 0, 3), 2, (2, 0))
    content += para(run(image("; display: block; flex-shrink: 0; order: 2; margin-left: 8px"), 0, 4) + run("text", 1, 5), 3, (3, 0), flex)
    content += para(run(image("; display: block"), 0, 6), 4, (4, 0)) + para(run("", 0, 7), 5, (5, 0))
    return made, document(page(content))


@pytest.mark.parametrize("name", CASES)
def test_archives_to_pages(pages, name):
    assert pages[name].partition("<body>\n")[2] == f"{CASES[name][1]}\n</body>\n</html>\n"


def test_whole_pages_and_broken_archives(pages):
    assert set(pages) == set(CASES)
    assert all(x.startswith('<!DOCTYPE html>\n<html lang="en">') and "<style>\n.document{" in x for x in pages.values())


def test_members_are_read_where_they_are(spark, tmp_path):
    made = archive(p("hello"), rels=[("rI", "image", "media/i.png")], media=[("word/media/i.png", bytes(2_000_000))])
    (tmp_path / "a.docx").write_bytes(made)
    (tmp_path / "b.docx").write_bytes(b"no archive")
    files = docx_io.read_documents(spark, str(tmp_path)).select("doc_key")
    blobs = docx_io.read_documents(spark, str(tmp_path))
    order = lambda df: sorted(map(repr, df.collect()))
    assert order(docx_io.shred_files(files)) == order(docx_io.shred_docx(blobs)) and order(docx_io.media_files(files)) == order(docx_io.media_of(blobs))
    assert "content" not in files._jdf.queryExecution().executedPlan().toString().partition("ReadSchema")[2]

    class Counted(io.FileIO):
        read_bytes = 0

        def read(self, size=-1):
            data = super().read(size)
            Counted.read_bytes += len(data)
            return data

    with Counted(str(tmp_path / "a.docx")) as file, zipfile.ZipFile(file) as opened:
        for name, _ in docx_io._parts(opened):
            opened.read(name)
    assert len(made) > 2_000_000 and Counted.read_bytes < 100_000  # stored members that are not asked for are not read


def test_page_setup_of_each_rung(spark):
    theme = '<a:theme xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"><a:majorFont><a:latin typeface="Verdana"/></a:majorFont><a:minorFont><a:latin typeface="Arial"/></a:minorFont></a:theme>'
    rung = lambda rule, line: f'<w:docDefaults><w:rPrDefault><w:rPr><w:sz w:val="23"/></w:rPr></w:rPrDefault><w:pPrDefault><w:pPr><w:spacing w:line="{line}" w:lineRule="{rule}" w:after="160"/></w:pPr></w:pPrDefault></w:docDefaults>'
    normal = lambda rule: f'<w:style w:type="paragraph" w:styleId="N"><w:name w:val="Normal"/><w:pPr><w:spacing w:line="240"{rule}/></w:pPr></w:style>'
    first = '<w:p><w:pPr><w:sectPr><w:pgSz w:w="1" w:h="1"/></w:sectPr></w:pPr></w:p><w:sectPr><w:pgSz w:w="11906" w:h="16838"/><w:pgMar w:top="720" w:left="x"/></w:sectPr>'
    made = [
        archive(first, styles_xml=rung("auto", 276) + normal(""), theme=theme), archive(first, styles_xml=rung("exact", 276) + normal("")), archive(p("x"), styles_xml=normal(' w:lineRule="exact"'), theme=theme), archive("<w:sectPr><w:pgSz w:w='1440'/></w:sectPr>"),
    ]
    blobs = spark.createDataFrame([(f"d{i}", bytearray(a)) for i, a in enumerate(made)], "doc_key string, content binary")
    nodes = kept(docx_io.shred_docx(blobs), "nodes")
    got = {r["doc_id"]: r for r in properties.page_properties(nodes, properties.properties_of(nodes)).collect()}
    assert (got["d0"]["width_in"], got["d0"]["height_in"], got["d0"]["margins_in"]["top"], got["d0"]["margins_in"]["left"]) == (8.2681, 11.6931, 0.5, None)
    assert (got["d0"]["default_font_size_pt"], got["d0"]["default_line_height"], got["d0"]["default_win_ratio"], got["d0"]["para_after_twips"]) == (11.5, 1.4662, 1.275, 160)
    assert (got["d1"]["default_line_height"], got["d1"]["default_win_ratio"]) == (1.3, 1.3)
    assert got["d2"]["default_line_height"] is None and got["d3"]["width_in"] is None
    css = {r["doc_id"]: r["css"] for r in render.page_css(properties.page_properties(nodes, properties.properties_of(nodes))).collect()}
    assert ".docx-page-content{flex:1;padding:0 48px 0 48px;font-size:11.5pt;line-height:1.4662;font-family:Calibri" in css["d0"] and "p{margin-top:0;margin-bottom:0;line-height:1.275}" in css["d0"]
    assert "{margin-top:0px;margin-bottom:11px}" in css["d0"] and "font-size:11pt;line-height:1.08" in css["d3"] and ".docx-page{width:816px;background:white" in css["d3"]


def test_maps_of_styles_merge_edge_by_edge(spark):
    rows = [(1, "a", "b", {"top": 1}), (1, "b", "c", {"top": 2, "left": 2}), (1, "c", "a", {"bottom": 3, "left": 3}), (1, "d", "gone", None), (1, "e", "d", {"top": 5}), (2, "a", None, None)]
    frame = spark.createDataFrame(rows, "doc_id int, style_id string, based_on string, m map<string,int>")
    got = {(r["doc_id"], r["style_id"]): r["m"] for r in structure.resolve_table_styles(frame, ["m"]).collect()}
    assert got == {(1, "a"): {"top": 1, "left": 2, "bottom": 3}, (1, "b"): {"top": 2, "left": 2, "bottom": 3}, (1, "c"): {"bottom": 3, "left": 3, "top": 1}, (1, "d"): None, (1, "e"): {"top": 5}, (2, "a"): None}


@pytest.mark.parametrize("edge, want", [("top", "H"), ("bottom", "own"), ("left", "V"), ("right", "V")])
def test_inner_borders_by_direction(spark, edge, want):
    row = spark.range(1).select(F.lit(edge).alias("edge"), F.create_map(F.lit("bottom"), F.lit("own")).alias("cell_borders"), F.create_map(*map(F.lit, ("insideH", "H", "insideV", "V", "left", "edge"))).alias("tbl_borders"))
    assert row.select(styles.effective_borders(row)).first()[0] == want


def test_one_exchange(spark):
    tokens = spark.createDataFrame([("d", 0, 0, "text", "a", "p_0")], "doc_key string, block_ix int, run_ix int, kind string, text string, para_node_id string")
    cells = spark.createDataFrame([("d", 1, 0, 0, "t")], "doc_key string, block_ix int, row_ix int, cell_ix int, text string")
    breaks = spark.createDataFrame([("d", 0, "paragraph", True, None), ("d", 1, "table", True, None), ("d", 2, "table", False, None)], "doc_key string, block_ix int, block_type string, page_break_before boolean, break_row int")
    found = render.render_html(tokens, cells, breaks=breaks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan
    empty = TABLE.format(' data-block="2"') + "</table>"
    assert found.first()["html"] == document(page('<p data-node-id="p_0" data-node-kind="paragraph" data-block="0" data-para="0"><span data-run="0">a</span></p>'), page(TABLE.format(' data-block="1"') + '<tr data-row="0"><td data-cell="0"><p>t</p></td></tr></table>' + empty))
