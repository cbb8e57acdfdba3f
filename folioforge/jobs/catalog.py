"""Every registered query of the form jobs with its SQL twin.

Queries return scalar columns only (arrays joined to strings), so that both sides can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import keys as K
from ..functions import text as T
from ..operators import fields, library, patches, pdf, render, structure, styles, validate
from ..sources import docx_io, tables
from ..sources.fixtures import archives, styled_archives, view, with_views
from ..sources.scratch import kept, parts_of
from ..streaming import jobs as streams
from .convert import document_parts
from .report import document_reports

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None, *views: str, dealt: bool = False):
    """Registers a function of the named views, which are ``dealt`` by document."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: f(*(view(spark, sf_dir, v, dealt) if v.startswith("fx_") else spark.read.parquet(f"{sf_dir}/{v}.parquet") for v in views))
        if sql:
            shared = [v for v in views if v.startswith("fx_")]
            ORACLE[name] = with_views(sql, *shared) if shared else sql
        return f

    return add


def scalar(name: str, table: str, keys: str, made: Callable[[], Column], sql: str, distinct: bool = False) -> None:
    """Registers one column function over a table as column ``out``."""
    names = [k.strip() for k in keys.split(",")]

    def run(df: DataFrame) -> DataFrame:
        out = df.select(*names, made().alias("out"))
        return out.distinct() if distinct else out

    query(name, f"SELECT {'DISTINCT ' if distinct else ''}{keys}, {sql} AS out FROM {table}", table)(run)


_BASE = r"regexp_extract({0}, '^((?:.*/)?\.*[^/]*?)(\.[^./]*)?$', 1)"
_MOVED = "'{1}' || CASE WHEN starts_with(" + _BASE + ", 'uploads/') THEN substr(" + _BASE + ", 9) ELSE " + _BASE + " END || {2}"
_SLASHED = "regexp_extract({0}, '^((?:.*/)?)[^/]*$', 1)"
C = F.col

# Keys -----------------------------------------------------------------------------------------------------------------
scalar("converted_html_key", "fx_objects", "key", lambda: K.converted_html_key(C("key")), _MOVED.format("key", "converted/", "'.html'"))
scalar("pdf_model_key", "fx_objects", "key", lambda: K.pdf_model_key(C("key")), _MOVED.format("key", "pdf-extracted/", "'/model.json'"))
scalar("pdf_page_image_key", "fx_objects", "key", lambda: K.pdf_page_image_key(C("key"), F.length("key") % 7), _MOVED.format("key", "pdf-extracted/", "'/page-' || CAST(length(key) % 7 AS VARCHAR) || '.png'"))
scalar("extracted_fields_key", "fx_objects", "key", lambda: K.extracted_fields_key(C("key")), _MOVED.format("key", "extracted/", "'.json'"))
scalar("export_key", "fx_objects", "key", lambda: K.export_key(C("key")), f"regexp_replace({_SLASHED.format('key')}, '^(.*?)uploads/', '\\1exported/') || {_BASE.format(chr(34) + 'key' + chr(34)).replace(chr(34) + 'key' + chr(34), 'regexp_extract(key, ' + chr(39) + '[^/]*$' + chr(39) + ', 0)')} || CASE WHEN lower(key) LIKE '%.pdf' THEN '-filled.pdf' ELSE '-exported.docx' END")
scalar("file_name", "pages", "page_id", lambda: K.file_name(C("url")), "regexp_extract(url, '[^/]*$', 0)")
scalar("doc_title", "fx_objects", "key", lambda: K.doc_title(C("key")), "regexp_replace(regexp_extract(key, '[^/]*$', 0), '\\.[^.]+$', '')")
scalar("split_ext", "pages", "page_id", lambda: F.concat_ws("|", *K.split_ext(C("url"))), _BASE.format("url") + " || '|' || " + _BASE.format("url").replace(", 1)", ", 2)"))
scalar("classify_storage_error", "fx_edits", "edit_id", lambda: K.classify_storage_error(F.element_at(F.array(*map(F.lit, ("404", "403", "NoSuchKey", "AccessDenied", "500"))), (C("edit_id") % 5 + 1).cast("int"))), "CASE edit_id % 5 WHEN 0 THEN 'not found' WHEN 2 THEN 'not found' WHEN 4 THEN 'storage error: 500' ELSE 'access denied' END")

# Text -----------------------------------------------------------------------------------------------------------------
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"
_STRIP = f"trim({{0}}, {_WS})"
_DATE = r"regexp_matches({0}, '(?i)\bdate\b') OR regexp_matches({1}, '\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b')"
_NUMBER = r"regexp_matches({0}, '(?i)\b(amount|qty|quantity|total|number|no\.)\b')"


def _guess(label: str, value: str) -> str:
    both = f"({label} || ' ' || {value})"
    return f"CASE WHEN {_DATE.format(both, value)} THEN 'date' WHEN {_NUMBER.format(both)} THEN 'number' ELSE 'text' END"


_NORMAL_LABEL = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
scalar("py_strip", "fx_tokens", "doc_key, block_ix, run_ix", lambda: T.py_strip(F.concat(F.lit("\t\xa0"), C("text"), F.lit(" \n"))), f"trim(chr(9) || chr(160) || text || ' ' || chr(10), {_WS})")
scalar("tokens_to_text", "fx_tokens", "doc_key, block_ix, run_ix", lambda: T.token_piece(C("kind"), C("text")), "CASE kind WHEN 'text' THEN text WHEN 'tab' THEN chr(9) WHEN 'checkbox' THEN ' ' ELSE '' END")
scalar("has_placeholder", "fx_cells", "doc_key, row_ix, cell_ix", lambda: T.has_placeholder(C("text")), "regexp_matches(text, '_{3,}')")
scalar("guess_type", "fx_cells", "doc_key, row_ix, cell_ix", lambda: T.guess_type(C("text"), C("text")), _guess("text", "text"))
scalar("normalize_value", "fx_cells", "doc_key, row_ix, cell_ix", lambda: T.normalize_value(C("text")), "CASE WHEN text <> '' AND NOT regexp_matches(text, '_{3,}') THEN text END")
scalar("normalize_label", "fx_cells", "doc_key, row_ix, cell_ix", lambda: T.normalize_label(C("text")), _NORMAL_LABEL.format("text"))
scalar("strip_checkbox_glyphs", "documents", "doc_id", lambda: F.length(T.strip_checkbox_glyphs(F.concat(F.lit("☐ ☑"), F.coalesce("text", F.lit("")), F.lit("☒")))), "length(translate('☐ ☑' || coalesce(text, '') || '☒', '☐☑☒', '   '))")
scalar("field_id", "fx_edits", "edit_id", lambda: T.field_id(C("edit_id") % 2000), "'field_' || CASE WHEN edit_id % 2000 < 1000 THEN lpad(CAST(edit_id % 2000 AS VARCHAR), 3, '0') ELSE CAST(edit_id % 2000 AS VARCHAR) END")
scalar("merge_key", "fx_cells", "doc_key, row_ix, cell_ix", lambda: T.merge_key(C("text"), C("block_ix"), C("row_ix")), _NORMAL_LABEL.format("text") + " || '|' || block_ix || '|' || row_ix")
scalar("heading_level", "fx_blocks", "doc_id, block_ix", lambda: T.heading_level(C("style_name")), "TRY_CAST(nullif(regexp_extract(lower(style_name), 'heading\\s*([1-6])', 1), '') AS INTEGER)")
scalar("html_escape", "pages", "page_id", lambda: F.md5(F.encode(T.html_escape(C("html"), True), "utf-8")), "md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;'))")
scalar("nbsp_spaces", "documents", "doc_id", lambda: F.md5(F.encode(T.nbsp_spaces(C("text"), C("doc_id") % 2 == 0), "utf-8")), "md5(CASE WHEN doc_id % 2 = 0 THEN replace(text, ' ', chr(160)) ELSE regexp_replace(replace(text, '  ', chr(160) || chr(160)), chr(160) || ' ', chr(160) || chr(160), 'g') END)")
scalar("twips_to_px", "fx_blocks", "doc_id, block_ix", lambda: T.twips_to_px((C("n_rows") * 7 - 20).cast("string")), "CAST(greatest(1, round((n_rows * 7 - 20) / 15.0)) AS INTEGER)")
scalar("validate_field", "fx_cells", "doc_key, row_ix, cell_ix", lambda: T.validate_field(F.when(C("cell_ix") == 1, "number").otherwise("date"), C("text")), "CASE WHEN text = '' THEN NULL WHEN cell_ix = 1 AND NOT regexp_full_match(text, '[+-]?(\\d+\\.?\\d*)') THEN 'invalid number' WHEN cell_ix <> 1 THEN 'invalid date' END")
scalar("provenance", "fx_edits", "edit_id", lambda: F.concat_ws(" ", T.provenance(C("edit_id") % 101 / 100), T.percent(C("edit_id") % 101 / 100).cast("string")), "CASE WHEN (edit_id % 101) / 100.0 <= 0.5 THEN 'AI' ELSE 'rule' END || ' ' || (edit_id % 101)")
scalar("extract_json", "fx_responses", "doc_key", lambda: F.get_json_object(T.extract_json(C("raw")), "$.fields[0].label"), "CASE WHEN instr(raw, '{') > 0 THEN json_extract_string(regexp_extract(raw, '(?s)\\{.*\\}', 0), '$.fields[0].label') END")
scalar("infer_patch_op", "fx_patches", "doc_id, patch_ord", lambda: T.infer_patch_op(C("operation"), C("checked"), C("text")), "CASE WHEN operation IS NOT NULL THEN operation WHEN checked IS NOT NULL THEN 'toggle_checkbox' WHEN text IS NOT NULL THEN 'replace_text' END")
scalar("stamp_value", "fx_pdf_widgets", "doc_id, page, widget_ord", lambda: T.stamp_value(C("field_type"), F.when(C("x") % 3 != 0, C("field_name")).otherwise("")), "CASE WHEN x % 3 = 0 THEN NULL WHEN field_type = 'checkbox' THEN '☑' ELSE field_name END")
scalar("region_percent_box", "fx_pdf_widgets", "doc_id, page, widget_ord", lambda: F.concat_ws(" ", *[F.format_string("%.4f", pdf.region_percent_box(C("x"), C("y"), C("w"), C("h"), F.lit(595.0), F.lit(842.0))[part]) for part in ("left", "top", "width", "height")]), "printf('%.4f %.4f %.4f %.4f', 100 * x / 595, 100 * y / 842, 100 * w / 595, 100 * h / 842)")

# Fields ---------------------------------------------------------------------------------------------------------------
_PARAGRAPHS = f"""
piece AS (
  SELECT *, CASE kind WHEN 'text' THEN text WHEN 'tab' THEN chr(9) WHEN 'checkbox' THEN ' ' ELSE '' END AS piece FROM fx_tokens),
para AS (
  SELECT doc_key, block_ix, string_agg(piece, '' ORDER BY run_ix) AS text, count(*) FILTER (kind = 'checkbox') AS checkbox_count,
         bool_or(kind = 'tab') AS has_tab, min(para_node_id) || '|' || string_agg(node_id, '|' ORDER BY run_ix) AS node_ids
  FROM piece GROUP BY 1, 2),
parts AS (
  SELECT *, {_STRIP.format("translate(text, '☐☑☒', '   ')")} AS ticked, {_STRIP.format("text")} AS t FROM para),
cut AS (
  SELECT *, {_STRIP.format("split_part(t, ':', 1)")} AS l, split_part(t, ':', 1) AS rawl, CASE WHEN instr(t, ':') > 0 THEN substr(t, instr(t, ':') + 1) ELSE '' END AS r,
         {_STRIP.format("regexp_extract(t, '(?s)^(.*?)_{3,}', 1)")} AS before, regexp_matches(t, '_{{3,}}') AS under FROM parts WHERE t <> ''),
val AS (SELECT *, {_STRIP.format("r")} AS v, instr(t, ':') > 0 AND l <> '' AS colon FROM cut),
pf AS (
  SELECT doc_key, block_ix AS block, 0 AS row, 1 AS rule, ticked AS label, CASE WHEN checkbox_count > 1 THEN 'choice' ELSE 'checkbox' END AS type, NULL AS value, 0.9 AS confidence, t AS raw_label, NULL AS raw_value
  FROM val WHERE checkbox_count > 0 AND ticked <> ''
  UNION ALL
  SELECT doc_key, block_ix, 0, 2, l, {_guess("l", "v")}, CASE WHEN v <> '' AND NOT regexp_matches(v, '_{{3,}}') THEN v END, CASE WHEN regexp_matches(r, '_{{3,}}') OR has_tab THEN 0.85 ELSE 0.6 END, rawl || ':', v
  FROM val WHERE colon
  UNION ALL
  SELECT doc_key, block_ix, 0, 3, before, {_guess("before", "''")}, NULL, 0.8, before, {_STRIP.format("substr(t, length(regexp_extract(t, '(?s)^(.*?)_{3,}', 1)) + 1)")}
  FROM val WHERE NOT colon AND under AND before <> '')""".replace("{3,}}", "{3,}").replace("_{{3,}", "_{3,}")
_TABLES = f"""
pair AS (
  SELECT doc_key, block_ix, row_ix, count(*) AS n, {_STRIP.format("max(text) FILTER (cell_ix = 0)")} AS label, {_STRIP.format("coalesce(max(text) FILTER (cell_ix = 1), '')")} AS v, max(checkbox_count) FILTER (cell_ix = 1) AS boxes
  FROM fx_cells GROUP BY 1, 2, 3),
tf AS (
  SELECT doc_key, block_ix AS block, row_ix AS row, 0 AS rule, label, CASE WHEN boxes > 1 THEN 'choice' WHEN boxes > 0 THEN 'checkbox' ELSE {_guess("label", "v")} END AS type,
         CASE WHEN boxes = 0 AND v <> '' AND NOT regexp_matches(v, '_{{3,}}') THEN v END AS value, CASE WHEN boxes > 0 THEN 0.85 WHEN v = '' OR regexp_matches(v, '_{{3,}}') THEN 0.8 ELSE 0.6 END AS confidence, label AS raw_label, v AS raw_value
  FROM pair WHERE n >= 2 AND label <> '' AND (contains(label, ':') OR contains(label, '?') OR boxes > 0 OR regexp_matches(v, '_{{3,}}')))"""
_SHOWN = "doc_key, block, row, rule, label, type, value, confidence::DOUBLE AS confidence, raw_label, raw_value"
_COLUMNS = ["doc_key", "block", "row", "rule", "label", "type", "value", "confidence", "raw_label", "raw_value"]
_EVERY = f"""{_PARAGRAPHS}, {_TABLES},
every AS (SELECT * FROM pf UNION ALL SELECT * FROM tf),
ef AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY block, row, rule) AS field_ord FROM every)"""

query("paragraph_texts", f"WITH {_PARAGRAPHS} SELECT doc_key, block_ix, text, checkbox_count, has_tab, node_ids FROM para", "fx_tokens")(lambda t: fields.paragraph_texts(t).withColumn("node_ids", F.array_join("node_ids", "|")))
query("collect_node_ids", f"WITH {_PARAGRAPHS} SELECT doc_key, block_ix, node_ids FROM para", "fx_tokens")(lambda t: fields.paragraph_texts(t).select("doc_key", "block_ix", F.array_join("node_ids", "|").alias("node_ids")))
query("fields_from_paragraphs", f"WITH {_PARAGRAPHS} SELECT {_SHOWN} FROM pf", "fx_tokens")(lambda t: fields.fields_from_paragraphs(fields.paragraph_texts(t)).select(*_COLUMNS))
query("fields_from_tables", f"WITH {_TABLES} SELECT {_SHOWN} FROM tf", "fx_cells")(lambda c: fields.fields_from_tables(c).select(*_COLUMNS))
query("extract_fields", f"WITH {_EVERY} SELECT {_SHOWN}, field_ord FROM ef", "fx_tokens", "fx_cells", dealt=True)(lambda t, c: fields.extract_fields(t, c, dealt=True).select(*_COLUMNS, "field_ord"))
query("fill_progress", f"WITH {_EVERY} SELECT doc_key, count(*) FILTER (coalesce(value, '') <> '') AS filled, count(*) AS total FROM ef GROUP BY 1", "fx_tokens", "fx_cells", dealt=True)(lambda t, c: fields.fill_progress(fields.extract_fields(t, c, dealt=True)))
_INVALID = "(CASE WHEN type = 'checkbox' OR trim(coalesce(value, '')) = '' THEN false WHEN type = 'date' THEN NOT (regexp_full_match(trim(value), '\\d{1,2}[/.-]\\d{1,2}[/.-]\\d{2,4}') OR regexp_full_match(trim(value), '\\d{4}[/.-]\\d{1,2}[/.-]\\d{1,2}')) WHEN type = 'number' THEN TRY_CAST(trim(value) AS DOUBLE) IS NULL ELSE false END)"
query("field_errors", f"WITH {_EVERY} SELECT doc_key, bool_or({_INVALID}) AS has_errors, count(*) FILTER ({_INVALID}) AS errors FROM (SELECT doc_key, type, CASE WHEN length(label) % 3 = 0 THEN 'x' || coalesce(value, '') ELSE value END AS value FROM ef) GROUP BY 1", "fx_tokens", "fx_cells", dealt=True)(
    lambda t, c: fields.field_errors(fields.extract_fields(t, c, dealt=True).withColumn("value", F.when(F.length("label") % 3 == 0, F.concat(F.lit("x"), F.coalesce("value", F.lit("")))).otherwise(C("value"))))
)
query(
    "field_prompt",
    f"""WITH {_PARAGRAPHS},
    pj AS (SELECT doc_key, block_ix, to_json({{'block_ix': block_ix, 'text': t[:240], 'has_checkbox': checkbox_count > 0}}) AS j FROM parts WHERE t <> ''),
    rj AS (SELECT doc_key, block_ix, row_ix, list({_STRIP.format("text")}[:80] ORDER BY cell_ix) AS r FROM fx_cells WHERE row_ix < 6 AND cell_ix < 4 GROUP BY 1, 2, 3),
    tj AS (SELECT doc_key, block_ix, to_json({{'block_ix': block_ix, 'rows': list(r ORDER BY row_ix)}}) AS j FROM rj GROUP BY 1, 2)
    SELECT doc_key, CAST(count(*) AS INTEGER) AS blocks, '[' || string_agg(j, ',' ORDER BY block_ix) || ']' AS prompt FROM (FROM pj UNION ALL FROM tj) GROUP BY 1""",
    "fx_tokens", "fx_cells", dealt=True,
)(lambda t, c: fields.field_prompt(fields.paragraph_texts(t), c))
_AI = """
js AS (SELECT doc_key, CASE WHEN instr(raw, '{') > 0 THEN regexp_extract(raw, '(?s)\\{.*\\}', 0) END AS j FROM fx_responses),
it AS (SELECT doc_key, i - 1 AS ord, json_extract(j, '$.fields[' || (i - 1) || ']') AS x FROM js, range(1, 20) r(i) WHERE i <= coalesce(json_array_length(j, '$.fields'), 0)),
ai AS (
  SELECT doc_key, ord, trim(coalesce(x->>'$.label', '')) AS label, CASE WHEN x->>'$.type' IN ('text', 'date', 'checkbox', 'choice', 'number', 'multiline') THEN x->>'$.type' ELSE 'text' END AS type,
         CASE WHEN json_type(x, '$.block') IN ('UBIGINT', 'BIGINT') THEN CAST(x->>'$.block' AS INTEGER) ELSE -1 END AS block, CASE WHEN json_type(x, '$.para') IN ('UBIGINT', 'BIGINT') THEN CAST(x->>'$.para' AS INTEGER) ELSE 0 END AS para,
         round(least(greatest(coalesce(TRY_CAST(x->>'$.confidence' AS DOUBLE), 0.45), 0.0), 1.0), 3) AS confidence
  FROM it WHERE trim(coalesce(x->>'$.label', '')) <> '')"""
_MERGED = f"""{_EVERY}, {_AI},
keyed AS (SELECT *, {_NORMAL_LABEL.format("label")} || '|' || block || '|' || para AS merge_key FROM ai),
fresh AS (SELECT * FROM keyed k WHERE NOT EXISTS (SELECT 1 FROM ef WHERE ef.doc_key = k.doc_key AND {_NORMAL_LABEL.format("ef.label")} || '|' || ef.block || '|0' = k.merge_key)),
one AS (SELECT * FROM fresh QUALIFY row_number() OVER (PARTITION BY doc_key, merge_key ORDER BY ord) = 1),
merged AS (
  SELECT doc_key, 0 AS kind, field_ord AS ord, label, type, value, confidence::DOUBLE AS confidence, block, 0 AS para, 'rule' AS origin FROM ef
  UNION ALL SELECT doc_key, 1, ord, label, type, NULL, confidence, block, para, 'ai' FROM one),
mf AS (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY kind, ord) AS field_ord FROM merged)"""
query("parse_field_suggestions", f"WITH {_AI} SELECT doc_key, ord, label, type, block, para, confidence FROM ai", "fx_responses")(lambda r: fields.parse_field_suggestions(r).drop("raw_label", "raw_value"))
query("merge_fields", f"WITH {_MERGED} SELECT doc_key, field_ord, label, type, value, confidence, block, para, origin FROM mf", "fx_tokens", "fx_cells", "fx_responses", dealt=True)(
    lambda t, c, r: fields.merge_fields(fields.extract_fields(t, c, dealt=True), fields.parse_field_suggestions(r), dealt=True).select("doc_key", "field_ord", "label", "type", "value", "confidence", "block", "para", "origin")
)
query("extraction_gain", f"WITH {_MERGED} SELECT doc_key, count(*) FILTER (origin = 'rule') AS rule_fields, count(*) AS all_fields FROM mf GROUP BY 1", "fx_tokens", "fx_cells", "fx_responses", dealt=True)(
    lambda t, c, r: fields.extraction_gain(fields.merge_fields(fields.extract_fields(t, c, dealt=True), fields.parse_field_suggestions(r), dealt=True))
)
query("value_target", "WITH " + _PARAGRAPHS + " SELECT doc_key, block_ix, CASE WHEN regexp_extract(node_ids, '[^|]*$', 0) LIKE 'p\\_%' ESCAPE '\\' THEN regexp_extract(node_ids, '[^|]*$', 0) ELSE nullif(regexp_extract(node_ids, '.*\\b(r_\\d+)', 1), '') END AS value_target, nullif(regexp_extract(node_ids, '\\bsdt_\\d+', 0), '') AS checkbox_target FROM para", "fx_tokens")(
    lambda t: fields.paragraph_texts(t).select("doc_key", "block_ix", T.value_target(C("node_ids")).alias("value_target"), T.checkbox_target(C("node_ids")).alias("checkbox_target"))
)

# Library --------------------------------------------------------------------------------------------------------------
query("library_listing", f"SELECT u.key, 'order.' || split_part(u.key, '.', 2) AS name, u.last_modified, CASE WHEN c.key IS NULL THEN 'pending' ELSE 'ready' END AS status FROM fx_objects u LEFT JOIN (SELECT DISTINCT key FROM fx_objects) c ON c.key = {_MOVED.format('u.key', 'converted/', chr(39) + '.html' + chr(39))} WHERE u.key LIKE 'uploads/%'", "fx_objects")(library.library_listing)
query("pending_extractions", f"SELECT u.key, CASE WHEN u.key LIKE '%.pdf' THEN {_MOVED.format('u.key', 'pdf-extracted/', chr(39) + '/model.json' + chr(39))} ELSE {_MOVED.format('u.key', 'extracted/', chr(39) + '.json' + chr(39))} END AS result_key FROM fx_objects u WHERE u.key LIKE 'uploads/%' AND result_key NOT IN (SELECT key FROM fx_objects)", "fx_objects")(library.pending_extractions)
query("latest_draft", "SELECT session_id AS title, arg_max(text, (ts, edit_id)) AS html, max(ts) AS ts FROM fx_edits GROUP BY 1", "fx_edits")(lambda e: library.latest_draft(e.select(C("session_id").alias("title"), C("text").alias("html"), "ts", C("edit_id").alias("draft_id"))))

# Structure ------------------------------------------------------------------------------------------------------------
_GRID = "grid AS (SELECT *, coalesce(sum(greatest(colspan, 1)) OVER (PARTITION BY doc_key, block_ix, row_ix ORDER BY cell_ix ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grid_col FROM fx_cells)"
query("table_grid", f"WITH {_GRID} SELECT doc_key, block_ix, row_ix, cell_ix, grid_col FROM grid", "fx_cells")(lambda c: structure.table_grid(c).select("doc_key", "block_ix", "row_ix", "cell_ix", "grid_col"))
query(
    "resolve_vmerge",
    f"""WITH {_GRID},
    marked AS (SELECT *, CASE WHEN vmerge <> 'continue' OR row_ix <> coalesce(lag(row_ix) OVER w, -2) + 1 THEN 1 ELSE 0 END AS b FROM grid WINDOW w AS (PARTITION BY doc_key, block_ix, grid_col, colspan ORDER BY row_ix)),
    island AS (SELECT *, sum(b) OVER (PARTITION BY doc_key, block_ix, grid_col, colspan ORDER BY row_ix) AS i FROM marked),
    spans AS (SELECT *, CASE WHEN vmerge = 'restart' THEN count(*) OVER (PARTITION BY doc_key, block_ix, grid_col, colspan, i) ELSE 1 END AS rowspan FROM island)
    SELECT doc_key, block_ix, row_ix, cell_ix, rowspan FROM spans WHERE vmerge <> 'continue'""",
    "fx_cells",
)(lambda c: structure.resolve_vmerge(structure.table_grid(c)).select("doc_key", "block_ix", "row_ix", "cell_ix", "rowspan"))
query(
    "paginate",
    """WITH RECURSIVE b AS (
      SELECT doc_id, block_ix, block_type, coalesce(page_break_before, false) AS brk, break_row, row_number() OVER (PARTITION BY doc_id ORDER BY block_ix) AS n FROM fx_blocks),
    kinds AS (
      SELECT *, CASE WHEN n = 1 THEN 'stay' WHEN brk THEN 'open' WHEN break_row IS NULL THEN 'stay' WHEN block_type = 'table' AND break_row = 0 THEN 'open' ELSE 'split' END AS act FROM b),
    walk AS (
      SELECT *, 0 AS first_page, 0 AS last_page FROM kinds WHERE n = 1
      UNION ALL
      SELECT k.*, w.last_page + CASE WHEN k.act = 'open' THEN 1 ELSE 0 END, w.last_page + CASE WHEN k.act = 'stay' THEN 0 ELSE 1 END FROM walk w JOIN kinds k ON k.doc_id = w.doc_id AND k.n = w.n + 1)
    SELECT doc_id, block_ix, 0 AS part, 0 AS row_from, CASE WHEN act = 'split' AND block_type = 'table' THEN break_row END AS row_to, first_page AS page_no FROM walk
    UNION ALL
    SELECT doc_id, block_ix, 1, CASE WHEN block_type = 'table' THEN break_row ELSE 0 END, NULL, last_page FROM walk WHERE act = 'split'""",
    "fx_blocks",
)(lambda b: structure.paginate(b).select("doc_id", "block_ix", "part", "row_from", "row_to", "page_no"))
query(
    "list_groups",
    """WITH m AS (SELECT *, CASE WHEN num_id IS NOT NULL AND num_id IS DISTINCT FROM lag(num_id) OVER (PARTITION BY doc_id ORDER BY block_ix) THEN 1 ELSE 0 END AS s FROM fx_blocks),
    g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY block_ix) AS list_no FROM m)
    SELECT doc_id, block_ix, num_id, list_no, row_number() OVER (PARTITION BY doc_id, list_no ORDER BY block_ix) AS item_no FROM g WHERE num_id IS NOT NULL""",
    "fx_blocks",
)(lambda b: structure.list_groups(b).select("doc_id", "block_ix", "num_id", "list_no", "item_no"))
query(
    "column_widths_pct",
    """WITH c AS (SELECT doc_id, block_ix, k AS col_ix, CASE WHEN (n_rows + k) % 7 <> 0 THEN n_rows * (k + 1) END AS width FROM fx_blocks, range(3) r(k))
    SELECT doc_id, block_ix, col_ix, round_even(width * 100.0::DOUBLE / (SELECT nullif(sum(width), 0) FROM c t WHERE t.doc_id = c.doc_id AND t.block_ix = c.block_ix), 2) AS width_pct FROM c""",
    "fx_blocks",
)(lambda b: structure.column_widths_pct(b.select("doc_id", "block_ix", "n_rows", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("col_ix")).withColumn("width", F.when((C("n_rows") + C("col_ix")) % 7 != 0, C("n_rows") * (C("col_ix") + 1)))).select("doc_id", "block_ix", "col_ix", "width_pct"))
query(
    "resolve_table_styles",
    """WITH RECURSIVE chain AS (
      SELECT doc_id, style_id, based_on, 0 AS depth, [style_id] AS seen, margin_left, margin_top FROM fx_styles
      UNION ALL
      SELECT c.doc_id, c.style_id, s.based_on, c.depth + 1, list_append(c.seen, s.style_id), s.margin_left, s.margin_top
      FROM chain c JOIN fx_styles s ON s.doc_id = c.doc_id AND s.style_id = c.based_on WHERE NOT list_contains(c.seen, s.style_id))
    SELECT doc_id, style_id, arg_min(margin_left, depth) FILTER (margin_left IS NOT NULL) AS margin_left, arg_min(margin_top, depth) FILTER (margin_top IS NOT NULL) AS margin_top FROM chain GROUP BY 1, 2""",
    "fx_styles",
)(lambda s: structure.resolve_table_styles(s, ["margin_left", "margin_top"]))


def _tree_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.select(C("doc_key").alias("doc_id"), F.when(C("kind") == "checkbox", "image").otherwise(C("kind")).alias("kind"))


query(
    "structure_counts",
    """WITH every AS (SELECT doc_key, 'p' AS k FROM (SELECT DISTINCT doc_key, block_ix FROM fx_tokens) UNION ALL SELECT doc_key, 'p' FROM fx_cells UNION ALL SELECT DISTINCT doc_key, 't' FROM fx_cells UNION ALL SELECT doc_key, 'i' FROM fx_tokens WHERE kind = 'checkbox')
    SELECT doc_key AS doc_id, count(*) FILTER (k = 'p') AS paragraphs, count(*) FILTER (k = 't') AS tables, count(*) FILTER (k = 'i') AS images FROM every GROUP BY 1""",
    "fx_tokens", "fx_cells",
)(lambda t, c: structure.structure_counts(t.select(C("doc_key").alias("doc_id"), "block_ix").distinct().select("doc_id", F.lit("paragraph").alias("block_type")).unionByName(c.select(C("doc_key").alias("doc_id"), F.lit("paragraph").alias("block_type"))).unionByName(c.select(C("doc_key").alias("doc_id")).distinct().withColumn("block_type", F.lit("table"))), _tree_tokens(t)))
query(
    "assign_node_ids",
    """WITH RECURSIVE n AS (
      SELECT doc_id, block_ix AS seq, CASE WHEN block_type = 'table' THEN 'sdt' ELSE 'p' END AS prefix, CASE WHEN n_rows % 7 = 0 THEN n_rows END AS given,
             row_number() OVER (PARTITION BY doc_id, block_type ORDER BY block_ix) AS i FROM fx_blocks),
    walk AS (
      SELECT doc_id, seq, prefix, i, coalesce(given, 0) AS id, coalesce(given, 0) + 1 AS counter FROM n WHERE i = 1
      UNION ALL
      SELECT n.doc_id, n.seq, n.prefix, n.i, coalesce(n.given, w.counter), greatest(w.counter, coalesce(n.given, w.counter) + 1) FROM walk w JOIN n ON n.doc_id = w.doc_id AND n.prefix = w.prefix AND n.i = w.i + 1)
    SELECT doc_id, seq, prefix || '_' || id AS node_id FROM walk""",
    "fx_blocks",
)(
    lambda b: structure.assign_node_ids(b.select("doc_id", F.lit(0).alias("part_ord"), C("block_ix").alias("seq"), F.when(C("block_type") == "table", "sdt").otherwise("p").alias("prefix"), F.when(C("n_rows") % 7 == 0, F.concat(F.when(C("block_type") == "table", "sdt_").otherwise("p_"), C("n_rows").cast("string"))).alias("existing"))).select("doc_id", "seq", "node_id")
)

# Patches and edits ------------------------------------------------------------------------------------------------------
query(
    "effective_patches",
    """WITH t AS (SELECT *, CASE WHEN operation IS NOT NULL THEN operation WHEN checked IS NOT NULL THEN 'toggle_checkbox' WHEN text IS NOT NULL THEN 'replace_text' END AS op FROM fx_patches)
    SELECT doc_id, node_id, op, patch_ord, text, checked FROM t WHERE op IS NOT NULL AND node_id <> 'r_999' QUALIFY row_number() OVER (PARTITION BY doc_id, node_id, op ORDER BY patch_ord DESC) = 1""",
    "fx_patches",
)(lambda p: patches.effective_patches(p, p.filter("node_id <> 'r_999'")))
query("echo_filter", "SELECT edit_id, session_id, node_id FROM fx_edits WHERE origin <> 'sync'", "fx_edits")(lambda e: patches.echo_filter(e).select("edit_id", "session_id", "node_id"))
query("field_state", "SELECT session_id, node_id, arg_max(text, (ts, edit_id)) AS text, max(ts) AS ts FROM fx_edits WHERE origin <> 'sync' GROUP BY 1, 2", "fx_edits")(lambda e: patches.field_state(patches.echo_filter(e)))
query(
    "debounce_edits",
    """WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session_id ORDER BY ts, edit_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM fx_edits WHERE origin <> 'sync'),
    g AS (SELECT *, sum(s) OVER (PARTITION BY session_id ORDER BY ts, edit_id) AS i FROM b)
    SELECT session_id, max(ts) AS ts, count(*) AS edits, arg_max(node_id, (ts, edit_id)) AS node_id, arg_max(text, (ts, edit_id)) AS text FROM g GROUP BY session_id, i""",
    "fx_edits",
)(lambda e: patches.debounce_edits(patches.echo_filter(e), "30 minutes"))

# Page layouts -----------------------------------------------------------------------------------------------------------
query("pdf_route", "SELECT DISTINCT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM fx_pdf_widgets) THEN 'acroform' ELSE 'flat' END AS route FROM fx_pdf_pages", "fx_pdf_pages", "fx_pdf_widgets")(pdf.pdf_route)
_ACRO = "SELECT doc_id, page, 'p' || page || '_w' || (row_number() OVER (PARTITION BY doc_id, page ORDER BY widget_ord) - 1) AS id, CASE WHEN field_type = 'checkbox' THEN 'checkbox' ELSE 'text' END AS type, x, y, w, h, '' AS value, field_name AS acro_field_name FROM fx_pdf_widgets WHERE field_type <> 'signature'"
_FLAT = """SELECT doc_id, page, 'p' || page || '_r' || (row_number() OVER (PARTITION BY doc_id, page ORDER BY block, line) - 1) AS id, 'text' AS type, r + 4 AS x, top AS y, width_pt - r - 10 AS w, greatest(bottom - top, 12.0) AS h, '' AS value, NULL::VARCHAR AS acro_field_name
    FROM (SELECT doc_id, page, block, line, string_agg(text, '' ORDER BY span_ord) AS t, arg_max(x1, span_ord) AS r, min(y0) AS top, max(y1) AS bottom FROM fx_pdf_spans GROUP BY 1, 2, 3, 4) l JOIN fx_pdf_pages USING (doc_id, page)
    WHERE trim(t) LIKE '%:' AND width_pt - r - 10 >= width_pt * 0.15"""
query("acroform_regions", _ACRO, "fx_pdf_widgets")(pdf.acroform_regions)
query("flat_regions", _FLAT, "fx_pdf_pages", "fx_pdf_spans")(pdf.flat_regions)
_REGIONS = f"a AS ({_ACRO}), f AS ({_FLAT}), regions AS (SELECT * FROM a UNION ALL SELECT * FROM f WHERE doc_id NOT IN (SELECT doc_id FROM fx_pdf_widgets))"
query("pdf_regions", f"WITH {_REGIONS} FROM regions", "fx_pdf_pages", "fx_pdf_spans", "fx_pdf_widgets")(pdf.pdf_regions)


def _filled(pages: DataFrame, spans: DataFrame, widgets: DataFrame) -> DataFrame:
    regions = pdf.pdf_regions(pages, spans, widgets)
    return pdf.fill_regions(regions, regions.filter("doc_id % 3 <> 0").select("doc_id", "page", "id", F.concat(F.lit("value "), "id").alias("value")))


_VALUE = "CASE WHEN doc_id % 3 <> 0 THEN 'value ' || id ELSE '' END"
query("fill_regions", f"WITH {_REGIONS} SELECT doc_id, page, id, {_VALUE} AS value FROM regions", "fx_pdf_pages", "fx_pdf_spans", "fx_pdf_widgets")(lambda *v: _filled(*v).select("doc_id", "page", "id", "value"))
query("filled_regions", f"WITH {_REGIONS} SELECT doc_id, count(*) FILTER ({_VALUE} <> '') AS filled, count(*) AS total FROM regions GROUP BY 1", "fx_pdf_pages", "fx_pdf_spans", "fx_pdf_widgets")(lambda *v: pdf.filled_regions(_filled(*v)))
query(
    "stamp_plan",
    f"""WITH {_REGIONS},
    s AS (SELECT *, CASE WHEN type = 'checkbox' THEN '☑' ELSE {_VALUE} END AS stamp FROM regions WHERE {_VALUE} <> ''),
    units AS (
      SELECT doc_id, page, id, sum(coalesce(g.width, 0.5)) AS u FROM (SELECT doc_id, page, id, unnest(string_split(stamp, '')) AS char FROM s) c LEFT JOIN fx_glyphs g USING (char) GROUP BY 1, 2, 3),
    sized AS (SELECT s.*, u, least(0.7 * h, 11.0) AS top FROM s JOIN units USING (doc_id, page, id))
    SELECT doc_id, page, id, stamp, CASE WHEN acro_field_name IS NULL THEN 'free_text' ELSE 'widget' END AS way,
           CASE WHEN acro_field_name IS NULL THEN greatest(4.0, list_filter(list_transform(range(0, 15), lambda n: top - n / 2), lambda z: z <= 4 OR z * u <= w)[1])::DOUBLE END AS font_size,
           CASE WHEN acro_field_name IS NULL THEN 'left' END AS align FROM sized""",
    "fx_pdf_pages", "fx_pdf_spans", "fx_pdf_widgets", "fx_glyphs",
)(lambda p, s, w, g: pdf.stamp_plan(_filled(p, s, w), p, g))

# Checks -----------------------------------------------------------------------------------------------------------------
_COUNTS = "len(regexp_extract_all(html, '(?i)<(?:{0})\\b'))"
query("html_structure_counts", f"SELECT page_id AS doc_id, {_COUNTS.format('p|h[1-6]')} AS paragraphs, {_COUNTS.format('table')} AS tables, {_COUNTS.format('img')} AS images FROM pages", "pages")(lambda p: validate.html_structure_counts(p.withColumnRenamed("page_id", "doc_id")))


def _structures(pages: DataFrame) -> DataFrame:
    html = pages.select(C("page_id").alias("doc_id"), "html")
    less = html.filter("doc_id % 11 <> 5").withColumn("html", F.when(C("doc_id") % 3 == 0, F.regexp_replace("html", "(?i)<h1[^>]*>", "")).otherwise(C("html")))
    return validate.validate_structure(validate.html_structure_counts(html), validate.html_structure_counts(less))


_LESS = _COUNTS.format("p|h[1-6]").replace("html", "CASE WHEN page_id % 3 = 0 THEN regexp_replace(html, '(?i)<h1[^>]*>', '', 'g') ELSE html END", 1)
query(
    "validate_structure",
    f"""WITH c AS (SELECT page_id AS doc_id, {_COUNTS.format('p|h[1-6]')} AS p, {_LESS} AS q, {_COUNTS.format('table')} AS t, {_COUNTS.format('img')} AS i FROM pages),
    m AS (SELECT doc_id, CASE WHEN doc_id % 11 = 5 THEN 'paragraphs=' || p || '/none;tables=' || t || '/none;images=' || i || '/none' WHEN p <> q THEN 'paragraphs=' || p || '/' || q ELSE '' END AS mismatches FROM c)
    SELECT doc_id, mismatches = '' AS valid, mismatches FROM m""",
    "pages",
)(_structures)
query("render_stability", "SELECT page_id AS doc_id, page_id % 5 <> 0 AS stable, sha256(html) AS sha256 FROM pages", "pages")(
    lambda p: validate.render_stability(p.select(C("page_id").alias("doc_id"), "html"), p.select(C("page_id").alias("doc_id"), F.when(C("page_id") % 5 == 0, F.concat("html", F.lit(" "))).otherwise(C("html")).alias("html")))
)


def _rasters(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidate and reference pages, several for a document: the values of a vector as four channels of 16 pixels.

    Some pages lack a partner, some have another size and some half a pixel too much.
    """
    byte = F.transform("embedding", lambda v: F.lpad(F.hex(F.least(F.greatest(F.floor((v.cast("double") + 1) * 127), F.lit(0)), F.lit(255)).cast("long")), 2, "0"))
    n = F.floor(C("vec_id") / 2)
    odd = F.when(n % 13 == 4, "0000").otherwise("")
    pages = vectors.select("vec_id", F.floor(n / 3).alias("doc_id"), (n % 3).alias("page"), F.lit(4).alias("width"), F.when((n % 17 == 2) & (C("vec_id") % 2 == 1), 8).otherwise(4).alias("height"), F.unhex(F.concat(F.array_join(byte, ""), odd)).alias("data"))
    return pages.filter("vec_id % 2 = 0 and vec_id % 14 <> 6"), pages.filter("vec_id % 2 = 1")


_DIFFS = """
bytes AS (SELECT vec_id, vec_id // 2 AS n, vec_id % 2 AS side, list_transform(embedding, lambda v: CAST(least(greatest(floor((v::DOUBLE + 1) * 127), 0), 255) AS INTEGER)) AS b FROM embeddings WHERE vec_id % 14 <> 6 OR vec_id % 2 = 1),
paired AS (SELECT coalesce(x.n, y.n) AS n, x.b AS b, y.b AS c FROM (FROM bytes WHERE side = 0) x FULL JOIN (FROM bytes WHERE side = 1) y ON x.n = y.n),
apart AS (SELECT *, b IS NULL OR c IS NULL OR n % 17 = 2 OR n % 13 = 4 AS bad, list_transform(list_zip(b, c), lambda z: abs(z[1] - z[2])) AS d FROM paired),
diffs AS (
  SELECT n // 3 AS doc_id, n % 3 AS page, CASE WHEN bad THEN 1.0 ELSE round_even(list_avg(d), 4) END::DOUBLE AS mean_diff, CASE WHEN bad THEN 255 ELSE list_max(d) END AS max_diff,
         CASE WHEN bad THEN 100.0 ELSE round_even(len(list_filter(range(16), lambda p: list_max(d[4 * p + 1 : 4 * p + 4]) > 5)) * 100 / 16.0, 2) END::DOUBLE AS changed_pct, b IS NOT NULL AS in_candidate, c IS NOT NULL AS in_reference FROM apart)"""
query("page_diff", f"WITH {_DIFFS} FROM diffs", "embeddings")(lambda v: validate.page_diff(*_rasters(v)))
query(
    "diff_summary",
    f"""WITH {_DIFFS} SELECT doc_id, count(*) FILTER (in_candidate) AS candidate_pages, count(*) FILTER (in_reference) AS reference_pages, count(*) FILTER (in_candidate AND in_reference) AS compared, count(*) FILTER (changed_pct > 0) AS changed,
    round_even(avg(mean_diff), 4) AS mean_diff, bool_and(in_candidate AND in_reference) AND max(max_diff) = 0 AS identical, round_even(avg(mean_diff), 4) < 15 AS passed FROM diffs GROUP BY 1""",
    "embeddings",
)(lambda v: validate.diff_summary(validate.page_diff(*_rasters(v))))

# Rendering and styles -----------------------------------------------------------------------------------------------------
_NBSP = "regexp_replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '  ', chr(160) || chr(160)), chr(160) || ' ', chr(160) || chr(160), 'g')"
_BOX = render.BOX + "☐</span>"
_RENDERED = f"""
tok AS (
  SELECT *, '<span data-run="' || run_ix || '" data-node-id="' || node_id || '" data-node-kind="run">' || CASE kind WHEN 'text' THEN {_NBSP.format("text")} WHEN 'tab' THEN '&emsp;' WHEN 'checkbox' THEN '{_BOX}' ELSE '' END || '</span>' AS html FROM fx_tokens),
ph AS (
  SELECT doc_key, block_ix, '<p data-node-id="' || min(para_node_id) || '" data-node-kind="paragraph" data-block="' || block_ix || '" data-para="0">' || string_agg(html, '' ORDER BY run_ix) || '</p>' AS html FROM tok GROUP BY 1, 2),
rh AS (
  SELECT doc_key, block_ix, row_ix, '<tr data-row="' || row_ix || '">' || string_agg('<td data-cell="' || cell_ix || '"' || CASE WHEN colspan > 1 THEN ' colspan="' || colspan || '"' ELSE '' END || '><p>' || {_NBSP.format("text")} || '</p></td>', '' ORDER BY cell_ix) || '</tr>' AS html FROM fx_cells GROUP BY 1, 2, 3),
th AS (
  SELECT doc_key, block_ix, '<table data-block="' || block_ix || '" style="width: 100%; border-collapse: collapse; table-layout: fixed;">' || string_agg(html, '' ORDER BY row_ix) || '</table>' AS html FROM rh GROUP BY 1, 2),
bh AS (FROM ph UNION ALL FROM th)"""
_WRAPPED = "'<div class=\"document\">' || chr(10) || '<div class=\"docx-page\"><div class=\"docx-page-content\" style=\"padding-top:48px;padding-bottom:48px\">' || string_agg(html, '' ORDER BY block_ix) || '</div></div>' || chr(10) || '</div>'"
query("paragraph_html", f"WITH {_RENDERED} SELECT * FROM ph", "fx_tokens", "fx_cells", dealt=True)(lambda t, c: render.paragraph_html(t, dealt=True))
query("render_html", f"WITH {_RENDERED} SELECT doc_key, md5({_WRAPPED}) AS html_md5 FROM bh GROUP BY 1", "fx_tokens", "fx_cells", dealt=True)(lambda t, c: render.render_html(t, c.withColumn("rowspan", F.lit(1)), dealt=True).select("doc_key", F.md5(F.encode("html", "utf-8")).alias("html_md5")))


def _rich(blocks: DataFrame) -> DataFrame:
    """Documents with headings, lists, links, styles, tables, page breaks and, in some, a header and a footer."""
    n = C("n_rows")
    body = blocks.select(C("doc_id").alias("doc_key"), "block_ix", "block_type", "style_name", "num_id", "page_break_before", "break_row", n)
    para = body.filter("block_type = 'paragraph'")
    run = lambda when, section, no, text, **more: F.when(when, F.struct(F.lit(section).alias("section_kind"), "block_ix", F.lit(None).cast("int").alias("row_ix"), F.lit(None).cast("int").alias("cell_ix"), F.lit(0).alias("para_ix"), F.lit(no).alias("run_no"), F.lit(no).alias("run_ix"), F.lit("text").alias("kind"), text.alias("text"), F.concat(F.lit(f"r_{no}_"), "block_ix").alias("node_id"), F.concat(F.lit("p_"), "block_ix").alias("para_node_id"), *[more.get(x, F.lit(None)).cast(t).alias(x) for x, t in (("bold", "boolean"), ("italic", "boolean"), ("vertical_align", "string"), ("color", "string"), ("href", "string"))]))
    own = C("block_type") == "paragraph"
    one = run(own, "body", 0, F.concat(F.lit("a & b  "), n.cast("string")), bold=n % 2 == 0, italic=n % 3 == 0, vertical_align=F.when(n % 7 == 0, "superscript"), color=F.when(n % 5 == 0, "FF0000"))
    two = run(own & (n % 4 == 1), "body", 1, F.lit("link"), href=F.lit("http://e.org/?a=1&b=2"))
    top, foot = (run((C("block_ix") == 0) & (C("doc_key") % 3 == k), kind, 0, F.lit(kind)) for k, kind in ((0, "header"), (1, "footer")))
    tokens = body.select("doc_key", F.explode(F.filter(F.array(one, two, top, foot), lambda t: t.isNotNull())).alias("t")).select("doc_key", "t.*")
    cells = body.filter("block_type = 'table'").select("doc_key", "block_ix", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("_i")).select("doc_key", "block_ix", F.floor(C("_i") / 2).cast("int").alias("row_ix"), (C("_i") % 2).cast("int").alias("cell_ix"), F.concat(F.lit("c"), C("_i").cast("string")).alias("text"))
    paragraphs = para.select("doc_key", "block_ix", "style_name", F.when(n % 6 == 0, styles.paragraph_css({"alignment": F.lit("both"), "space_before": n.cast("string")})).alias("css"), "num_id", (C("num_id") == "1").alias("list_ordered"), F.when(C("num_id") == "1", "decimal").otherwise("square").alias("list_marker"))
    columns = body.filter("block_type = 'table'").select("doc_key", "block_ix", F.explode(F.array(F.lit(0), F.lit(1))).alias("col_ix")).withColumn("width", F.when(C("col_ix") == 0, 1000).otherwise(2000))
    return render.render_html(tokens, cells, paragraphs=paragraphs, breaks=body, columns=columns, dealt=True).select("doc_key", F.md5(F.encode("html", "utf-8")).alias("html_md5"))


query(
    "render_documents",
    """WITH RECURSIVE b AS (
      SELECT doc_id, block_ix, block_type, style_name, num_id, n_rows AS n, coalesce(page_break_before, false) AS brk, break_row, row_number() OVER (PARTITION BY doc_id ORDER BY block_ix) AS i FROM fx_blocks),
    kinds AS (SELECT *, CASE WHEN i = 1 THEN 'stay' WHEN brk THEN 'open' WHEN break_row IS NULL THEN 'stay' WHEN block_type = 'table' AND break_row = 0 THEN 'open' ELSE 'split' END AS act FROM b),
    walk AS (
      SELECT *, 0 AS p, 0 AS q FROM kinds WHERE i = 1
      UNION ALL SELECT k.*, w.q + CASE WHEN k.act = 'open' THEN 1 ELSE 0 END, w.q + CASE WHEN k.act = 'stay' THEN 0 ELSE 1 END FROM walk w JOIN kinds k ON k.doc_id = w.doc_id AND k.i = w.i + 1),
    parts AS (
      SELECT *, p AS page, 0 AS part, 0 AS r0, CASE WHEN act = 'split' AND block_type = 'table' THEN break_row ELSE 3 END AS r1 FROM walk
      UNION ALL SELECT *, q, 1, CASE WHEN block_type = 'table' THEN break_row ELSE 0 END, 3 FROM walk WHERE act = 'split'),
    inner_ AS (
      SELECT *, '<span data-run="0" data-node-id="r_0_' || block_ix || '" data-node-kind="run"' || CASE WHEN n % 5 = 0 THEN ' style="color: #FF0000"' ELSE '' END || '>'
        || CASE WHEN n % 2 = 0 THEN '<strong>' ELSE '' END || CASE WHEN n % 3 = 0 THEN '<em>' ELSE '' END || CASE WHEN n % 7 = 0 THEN '<sup>' ELSE '' END || 'a &amp; b' || chr(160) || chr(160) || n
        || CASE WHEN n % 7 = 0 THEN '</sup>' ELSE '' END || CASE WHEN n % 3 = 0 THEN '</em>' ELSE '' END || CASE WHEN n % 2 = 0 THEN '</strong>' ELSE '' END || '</span>'
        || CASE WHEN n % 4 = 1 THEN '<a data-run="1" href="http://e.org/?a=1&amp;b=2"><span data-node-id="r_1_' || block_ix || '" data-node-kind="run">link</span></a>' ELSE '' END AS inner_html,
        CASE WHEN style_name = 'Normal' OR substr(style_name, 9) IN ('0', '7') THEN 'p' ELSE 'h' || substr(style_name, 9) END AS tag, ' data-node-id="p_' || block_ix || '" data-node-kind="paragraph"' AS nid FROM parts),
    cell AS (SELECT unnest(range(0, 3)) AS r),
    html AS (
      SELECT doc_id, page, block_ix, part, CASE WHEN block_type = 'paragraph' THEN num_id END AS num_id, '<li' || nid || '>' || regexp_replace(inner_html, ' data-run="[01]"', '', 'g') || '</li>' AS li,
        CASE WHEN block_type = 'paragraph' THEN '<' || tag || nid || ' data-block="' || block_ix || '" data-para="0"' || CASE WHEN n % 6 = 0 THEN ' style="text-align: left; margin-top: ' || greatest(1, CAST(round(n / 15.0) AS INTEGER)) || 'px"' ELSE '' END || '>' || inner_html || '</' || tag || '>'
        ELSE '<table data-block="' || block_ix || '" style="width: 100%; border-collapse: collapse; table-layout: fixed;"><colgroup><col style="width: 33.33%;"><col style="width: 66.67%;"></colgroup>'
          || (SELECT string_agg('<tr data-row="' || (r - r0) || '"><td data-cell="0"><p>c' || (2 * r) || '</p></td><td data-cell="1"><p>c' || (2 * r + 1) || '</p></td></tr>', '' ORDER BY r) FROM cell WHERE r >= r0 AND r < r1) || '</table>' END AS block_html FROM inner_),
    marked AS (SELECT *, CASE WHEN num_id IS NOT NULL AND num_id IS NOT DISTINCT FROM lag(num_id) OVER w THEN 0 ELSE 1 END AS s FROM html WINDOW w AS (PARTITION BY doc_id, page ORDER BY block_ix, part)),
    isle AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY block_ix, part) AS k FROM marked),
    joined AS (
      SELECT doc_id, page, k, CASE WHEN min(num_id) IS NULL THEN min(block_html) WHEN min(num_id) = '1' THEN '<ol style="list-style-type: decimal">' || string_agg(li, '' ORDER BY block_ix, part) || '</ol>' ELSE '<ul style="list-style-type: square">' || string_agg(li, '' ORDER BY block_ix, part) || '</ul>' END AS h FROM isle GROUP BY 1, 2, 3),
    pages AS (SELECT doc_id, page, string_agg(h, '' ORDER BY k) AS h FROM joined GROUP BY 1, 2),
    extra AS (SELECT doc_id, '<p data-node-id="p_0" data-node-kind="paragraph"><span data-run="0" data-node-id="r_0_0" data-node-kind="run">' AS a, '</span></p></div>' AS z FROM (SELECT DISTINCT doc_id FROM pages))
    SELECT doc_id AS doc_key, md5('<div class="document">' || chr(10) || string_agg('<div class="docx-page">' || CASE WHEN doc_id % 3 = 0 THEN '<div class="docx-page-header">' || a || 'header' || z ELSE '' END
      || '<div class="docx-page-content" style="padding-top:' || CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 48 END || 'px;padding-bottom:' || CASE WHEN doc_id % 3 = 1 THEN 0 ELSE 48 END || 'px">' || h || '</div>'
      || CASE WHEN doc_id % 3 = 1 THEN '<div class="docx-page-footer">' || a || 'footer' || z ELSE '' END || '</div>', chr(10) ORDER BY page) || chr(10) || '</div>') AS html_md5
    FROM pages JOIN extra USING (doc_id) GROUP BY 1""",
    "fx_blocks",
)(_rich)
query(
    "resolve_lists",
    """SELECT doc_id, block_ix, CASE WHEN num_id = '1' THEN doc_id % 3 = 0 ELSE false END AS list_ordered, CASE WHEN num_id = '1' AND doc_id % 3 = 0 THEN 'upper-roman' WHEN num_id = '1' THEN 'disc' ELSE 'square' END AS list_marker
    FROM fx_blocks WHERE num_id IS NOT NULL""",
    "fx_blocks",
)(lambda b: styles.resolve_lists(b.filter("num_id is not null").withColumn("ilvl", F.lit(None).cast("int")), b.select("doc_id").distinct().select("doc_id", F.lit("1").alias("num_id"), F.lit(0).alias("ilvl"), F.when(C("doc_id") % 3 == 0, "upperRoman").otherwise("bullet").alias("num_fmt"), F.lit("•").alias("lvl_text"))).select("doc_id", "block_ix", "list_ordered", "list_marker"))
query("image_geometry", "SELECT doc_id, block_ix, greatest(1, CAST(round_even(n_rows * 100000 / 914400.0::DOUBLE * 96, 0) AS INTEGER)) AS width_px, block_type = 'table' AND n_rows * 100000 >= 3200000 AS right_anchored FROM fx_blocks", "fx_blocks")(
    lambda b: b.select("doc_id", "block_ix", styles.image_geometry(C("n_rows") * 100000, C("n_rows") * 100000, F.when(C("block_type") == "table", "anchor").otherwise("inline"), C("n_rows") * 100000).alias("g")).select("doc_id", "block_ix", "g.width_px", "g.right_anchored")
)
def _summaries(blocks: DataFrame, tokens: DataFrame, cells: DataFrame) -> DataFrame:
    """The orders' paragraphs and tables with styles from their numbers."""
    key = F.concat(F.lit("uploads/"), C("doc_id").cast("string"), F.lit("/order.docx"))
    styled = blocks.filter("block_ix < 7").select(key.alias("doc_id"), "block_ix", F.when(C("block_ix") == 6, "table").otherwise("paragraph").alias("block_type"), "style_name", F.when(C("n_rows") % 2 == 0, "center").alias("alignment"), "num_id", F.when(C("n_rows") % 3 == 0, 1).alias("ilvl"))
    runs = tokens.select(C("doc_key").alias("doc_id"), "block_ix", "run_ix", F.when(C("kind") == "checkbox", "image").otherwise(C("kind")).alias("kind"), "text", (10.0 + C("run_ix")).alias("font_size_pt"), (C("block_ix") % 2 == 0).alias("bold"), F.lit("FF0000").alias("color"))
    # The orders' numbers become the documents' keys, so blocks are dealt again, as the views are.
    styled = styled.repartition(parts_of(tokens, cells), "doc_id")
    return styles.block_summaries(styled, runs, cells.withColumnRenamed("doc_key", "doc_id")).withColumn("header_sample", F.array_join("header_sample", "|"))


query(
    "block_summaries",
    """WITH b AS (SELECT 'uploads/' || doc_id || '/order.docx' AS doc_id, block_ix, CASE WHEN block_ix = 6 THEN 'table' ELSE 'paragraph' END AS block_type, style_name, CASE WHEN n_rows % 2 = 0 THEN 'center' END AS alignment, num_id, CASE WHEN n_rows % 3 = 0 THEN 1 END AS ilvl FROM fx_blocks WHERE block_ix < 7),
    t AS (SELECT doc_key AS doc_id, block_ix, coalesce(string_agg(CASE WHEN kind = 'text' THEN text END, '' ORDER BY run_ix), '') AS text, bool_or(kind = 'checkbox') AS has_image, min(run_ix) AS first FROM fx_tokens GROUP BY 1, 2),
    r AS (SELECT doc_key AS doc_id, block_ix, row_ix, count(*) AS n, string_agg(text[:40], '|' ORDER BY cell_ix) AS sample FROM fx_cells GROUP BY 1, 2, 3),
    c AS (SELECT doc_id, block_ix, count(*) AS rows, max(n) AS cols, arg_min(sample, row_ix) AS header_sample FROM r GROUP BY 1, 2)
    SELECT doc_id, block_ix, block_type, CASE WHEN block_type = 'paragraph' THEN coalesce(text, '')[:300] END AS text, style_name, alignment, CASE WHEN block_type = 'paragraph' THEN num_id IS NOT NULL END AS is_list,
           CASE WHEN block_type = 'paragraph' AND num_id IS NOT NULL THEN coalesce(ilvl, 0) END AS list_level, CASE WHEN block_type = 'paragraph' THEN coalesce(has_image, false) END AS has_image,
           (10.0 + first)::DOUBLE AS font_size_pt, CASE WHEN first IS NOT NULL THEN block_ix % 2 = 0 END AS bold, CASE WHEN first IS NOT NULL THEN 'FF0000' END AS color, rows, cols, header_sample
    FROM b LEFT JOIN t USING (doc_id, block_ix) LEFT JOIN c USING (doc_id, block_ix)""",
    "fx_blocks", "fx_tokens", "fx_cells", dealt=True,
)(_summaries)


def _answers(objects: DataFrame) -> DataFrame:
    """Answers with good, bad and wrongly typed hints, some in a fence and some broken off."""
    n = F.length("key")
    weight = F.when(n % 3 == 0, F.concat(F.lit('"'), (n % 9).cast("string"), F.lit('"'))).otherwise((n % 9).cast("string"))
    text = F.concat(F.lit('{"document_type": "'), F.when(n % 2 == 0, "form").otherwise("poem"), F.lit('", "annotations": {"s0:b1": {"heading_weight": '), weight, F.lit(', "emphasis": "low", "suppress": '), F.when(n % 5 == 0, '"true"').otherwise("true"), F.lit('}, "s0:b2": {"emphasis": "wild", "heading_weight": 2.5}, "bad": {"group": "g"}, "s1:b0": {"group": 7, "spacing_after": "large"}, "s1:b3": "text"}}'))
    fenced = F.concat(F.lit("```json\n"), text, F.lit("\n```"))
    return objects.select(C("key").alias("doc_id"), F.when(n % 7 == 0, fenced).when(n % 7 == 1, F.substring(text, 1, 60)).otherwise(text).alias("raw"))


query(
    "parse_annotations",
    """WITH k AS (SELECT key, length(key) AS n FROM fx_objects WHERE length(key) % 7 <> 1), base AS (SELECT key AS doc_id, n, CASE WHEN n % 2 = 0 THEN 'form' END AS document_type FROM k)
    SELECT doc_id, document_type, 0 AS section_ix, 1 AS block_ix, CASE WHEN n % 3 <> 0 AND n % 9 BETWEEN 1 AND 6 THEN CAST(n % 9 AS INTEGER) END AS heading_weight, NULL AS spacing_after, 'low' AS emphasis, CASE WHEN n % 5 <> 0 THEN true END AS suppress, NULL AS "group" FROM base
    UNION ALL SELECT doc_id, document_type, 1, 0, NULL, 'large', NULL, NULL, NULL FROM base""",
    "fx_objects",
)(lambda o: styles.parse_annotations(_answers(o)).select("doc_id", "document_type", "section_ix", "block_ix", "heading_weight", "spacing_after", "emphasis", "suppress", "group"))


# Write-back ----------------------------------------------------------------------------------------------------------------
def _node_patches(tokens: DataFrame) -> DataFrame:
    """A patch for every third text run and every box; the second paragraph is patched as a whole, before or after its runs."""
    box = C("kind") == "checkbox"
    some = tokens.filter(box | ((C("kind") == "text") & (C("run_ix") % 2 == 0)))
    runs = some.select("doc_key", F.lit(2).alias("patch_ord"), "node_id", F.when(box, "toggle_checkbox").otherwise("replace_text").alias("op"), F.when(~box, F.lit("new")).alias("text"), F.when(box, C("run_ix") % 2 == 0).alias("checked"))
    whole = tokens.filter("block_ix in (1, 4)").select("doc_key", F.when(C("block_ix") == 1, 1).otherwise(3).alias("patch_ord"), C("para_node_id").alias("node_id"), F.lit("replace_text").alias("op"), F.lit("whole").alias("text"), F.lit(None).cast("boolean").alias("checked")).distinct()
    bare = tokens.filter("kind = 'tab'").select("doc_key", F.lit(4).alias("patch_ord"), "node_id", F.lit("replace_text").alias("op"), F.lit("behind").alias("text"), F.lit(None).cast("boolean").alias("checked"))
    return runs.unionByName(whole).unionByName(bare)


query(
    "apply_text_patches",
    """SELECT doc_key, block_ix, run_ix, kind, CASE WHEN kind <> 'text' THEN text WHEN block_ix = 4 THEN 'whole' WHEN block_ix = 1 AND run_ix = 1 THEN '' WHEN run_ix % 2 = 0 THEN 'new' ELSE text END AS text FROM fx_tokens
    UNION ALL SELECT doc_key, block_ix, run_ix + 1, 'text', 'behind' FROM fx_tokens WHERE kind = 'tab'""",
    "fx_tokens", dealt=True,
)(lambda t: patches.apply_text_patches(t, _node_patches(t), dealt=True).select("doc_key", "block_ix", "run_ix", "kind", "text"))
query("apply_checkbox_patches", "SELECT doc_key, block_ix, run_ix, CASE WHEN kind = 'checkbox' THEN CASE WHEN run_ix % 2 = 0 THEN '☒' ELSE '☐' END ELSE text END AS text FROM fx_tokens", "fx_tokens")(lambda t: patches.apply_checkbox_patches(t, _node_patches(t)).select("doc_key", "block_ix", "run_ix", "text"))
def _positions(tokens: DataFrame, cells: DataFrame) -> DataFrame:
    """Patches of runs 0 and 2 of each paragraph and of each cell, and of places that do not exist."""
    asked = tokens.select("doc_key", C("block_ix").alias("block")).distinct().withColumn("run", F.explode(F.array(F.lit(None).cast("int"), F.lit(2), F.lit(9))))
    inner = cells.select("doc_key", C("block_ix").alias("block"), C("row_ix").alias("row"), C("cell_ix").alias("cell"), F.lit(0).alias("run"))
    none = F.lit(None).cast("int")
    every = asked.select("doc_key", "block", none.alias("row"), none.alias("cell"), "run").unionByName(inner).unionByName(inner.filter("cell = 1").select("doc_key", "block", none.alias("row"), none.alias("cell"), "run"))
    places = tokens.select("doc_key", "block_ix", none.alias("row_ix"), none.alias("cell_ix"), "run_ix", "node_id").unionByName(cells.select("doc_key", "block_ix", "row_ix", "cell_ix", F.lit(0).alias("run_ix"), F.concat_ws("_", F.lit("c"), "row_ix", "cell_ix").alias("node_id")))
    return patches.resolve_positional_patches(every, places).select("doc_key", "block", "row", "cell", "run", "node_id")


query(
    "resolve_positional_patches",
    "SELECT doc_key, block_ix AS block, NULL::INTEGER AS row, NULL::INTEGER AS cell, run_ix AS run, node_id FROM fx_tokens WHERE run_ix IN (0, 2) UNION ALL SELECT doc_key, block_ix, row_ix, cell_ix, 0, 'c_' || row_ix || '_' || cell_ix FROM fx_cells",
    "fx_tokens", "fx_cells", dealt=True,
)(_positions)
query("patches_from_html", "SELECT doc_key, node_id, CASE WHEN kind = 'checkbox' THEN 'toggle_checkbox' ELSE 'replace_text' END AS op, CASE kind WHEN 'text' THEN text WHEN 'tab' THEN chr(8195) END AS text FROM fx_tokens WHERE NOT regexp_matches(text, '  ')", "fx_tokens", dealt=True)(
    lambda t: patches.patches_from_html(render.paragraph_html(t.filter("text not like '%  %'"), dealt=True).select("doc_key", "html")).select("doc_key", "node_id", "op", "text")
)
_TARGET = "CASE WHEN type = 'checkbox' THEN nullif(regexp_extract(node_ids, '\\bsdt_\\d+', 0), '') WHEN regexp_extract(node_ids, '[^|]*$', 0) LIKE 'p\\_%' ESCAPE '\\' THEN regexp_extract(node_ids, '[^|]*$', 0) ELSE nullif(regexp_extract(node_ids, '.*\\b(r_\\d+)', 1), '') END"
_TARGETED = f"{_PARAGRAPHS}, tg AS MATERIALIZED (SELECT pf.doc_key, pf.block, pf.rule, pf.type, pf.value, {_TARGET} AS node_id FROM pf JOIN para ON para.doc_key = pf.doc_key AND para.block_ix = pf.block)".replace("para AS (", "para AS MATERIALIZED (").replace("pf AS (", "pf AS MATERIALIZED (")
query("fields_to_patches", f"WITH {_TARGETED} SELECT doc_key, node_id, CASE WHEN type = 'checkbox' THEN 'toggle_checkbox' ELSE 'replace_text' END AS op, CASE WHEN type <> 'checkbox' THEN value END AS text FROM tg WHERE value IS NOT NULL AND node_id IS NOT NULL", "fx_tokens")(
    lambda t: patches.fields_to_patches(fields.fields_from_paragraphs(fields.paragraph_texts(t))).drop("checked")
)
query("sync_field_values", f"WITH {_TARGETED} SELECT doc_key, block, rule, CASE WHEN node_id LIKE '%0' THEN CASE WHEN type = 'checkbox' THEN 'true' ELSE '☒' END ELSE value END AS value FROM tg", "fx_tokens", dealt=True)(
    lambda t: patches.sync_field_values(fields.fields_from_paragraphs(fields.paragraph_texts(t)), t.filter("node_id like '%0'").select("doc_key", "node_id", F.lit("☒").alias("text")).distinct(), dealt=True).select("doc_key", "block", "rule", "value")
)
query(
    "conversion_status",
    """WITH u AS (SELECT event_id, ts FROM events), c AS (SELECT event_id, ts + to_seconds(event_id % 200) AS done FROM events WHERE event_id % 3 <> 0)
    SELECT CAST(u.event_id AS VARCHAR) AS key, CASE WHEN c.done BETWEEN u.ts AND u.ts + INTERVAL 120 SECOND THEN 'ready' ELSE 'timed out' END AS status FROM u LEFT JOIN c USING (event_id)""",
    "events",
)(lambda e: streams.conversion_status(e.select(C("event_id").cast("string").alias("key"), "ts"), e.filter("event_id % 3 <> 0").select(C("event_id").cast("string").alias("key"), (C("ts") + F.make_interval(secs=C("event_id") % 200)).alias("ts"))).select("key", "status"))
query(
    "media_data_uris",
    """SELECT page_id AS doc_key, md5('data:' || CASE page_id % 4 WHEN 0 THEN 'application/octet-stream' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/jpeg' ELSE 'image/svg+xml' END || ';base64,' || base64(encode(html))) AS uri FROM pages""",
    "pages",
)(
    lambda p: docx_io.media_data_uris(p.select(C("page_id").alias("doc_key"), F.concat(F.lit("word/media/a."), F.element_at(F.array(*map(F.lit, ("unknown", "PNG", "jpg", "svg"))), (C("page_id") % 4 + 1).cast("int"))).alias("media_path"), F.encode("html", "utf-8").alias("content"))).select("doc_key", F.md5(F.encode("uri", "utf-8")).alias("uri"))
)
query("resolve_hyperlinks", "SELECT doc_key, block_ix, run_ix, CASE WHEN run_ix < 2 THEN 'http://x/' || run_ix END AS href FROM fx_tokens", "fx_tokens")(
    lambda t: styles.resolve_hyperlinks(t.select(C("doc_key").alias("doc_id"), "block_ix", "run_ix", F.lit("word/document.xml").alias("part_name"), C("run_ix").alias("rel_id")), t.select("doc_key", "run_ix").distinct().filter("run_ix < 2").select(C("doc_key").alias("doc_id"), F.lit("word/document.xml").alias("part_name"), C("run_ix").alias("rel_id"), F.concat(F.lit("http://x/"), C("run_ix").cast("string")).alias("target"))).select(C("doc_id").alias("doc_key"), "block_ix", "run_ix", "href")
)
query(
    "resolve_images",
    """SELECT o_orderkey AS doc_id, CASE o_orderkey % 3 WHEN 0 THEN 'word/media/a.png' ELSE 'word/other/b.png' END AS media_path FROM orders WHERE o_orderkey % 3 <> 2""",
    "orders",
)(lambda o: styles.resolve_images(
    o.select(C("o_orderkey").alias("doc_id"), F.lit(0).alias("token_id"), F.lit("d").alias("part_name"), F.lit("r").alias("rel_id")),
    o.select(C("o_orderkey").alias("doc_id"), F.lit("d").alias("part_name"), F.lit("r").alias("rel_id"), F.element_at(F.array(F.lit("media/a.png"), F.lit("gone/b.png"), F.lit("gone/c.png")), (C("o_orderkey") % 3 + 1).cast("int")).alias("target")),
    o.select(C("o_orderkey").alias("doc_id"), F.explode(F.array(*map(F.lit, ("word/media/a.png", "word/other/b.png", "word/x/c.png", "word/y/c.png")))).alias("media_path")),
).select("doc_id", "media_path"))
def _broken(tokens: DataFrame) -> DataFrame:
    """Some runs as page breaks: at a start, in the middle and at an end; those in links cut nothing."""
    return tokens.withColumn("linked", C("block_ix") == 3).withColumn("kind", F.when(C("linked"), "page").when((C("run_ix") == 1) & C("block_ix").isin(1, 4) | (C("block_ix") == 5) | ((C("block_ix") == 2) & (C("run_ix") == 0)), "page").otherwise(C("kind")))


_BROKEN = "SELECT *, (run_ix = 1 AND block_ix IN (1, 4)) OR block_ix = 5 OR (block_ix = 2 AND run_ix = 0) AS page FROM fx_tokens"
query(
    "split_page_breaks",
    f"WITH t AS ({_BROKEN}), s AS (SELECT doc_key, block_ix, run_ix, (SELECT count(*) FROM t b WHERE b.page AND b.doc_key = t.doc_key AND b.block_ix = t.block_ix AND b.run_ix < t.run_ix) AS seg FROM t WHERE NOT page) SELECT *, seg > 0 AS break_before FROM s",
    "fx_tokens",
)(lambda t: structure.split_page_breaks(_broken(t)).select("doc_key", "block_ix", "run_ix", "seg", "break_before"))
query(
    "split_blocks",
    f"""WITH t AS ({_BROKEN}), n AS (SELECT doc_key, block_ix, count(*) FILTER (page) AS cuts FROM t GROUP BY 1, 2),
    s AS (SELECT doc_key, block_ix, cuts, unnest(range(0, cuts + 1)) AS seg FROM n),
    held AS (SELECT doc_key, block_ix, run_ix, (SELECT count(*) FROM t b WHERE b.page AND b.doc_key = t.doc_key AND b.block_ix = t.block_ix AND b.run_ix < t.run_ix) AS seg FROM t WHERE NOT page),
    kept AS (SELECT * FROM s WHERE cuts = 0 OR seg BETWEEN 1 AND cuts - 1 OR EXISTS (SELECT 1 FROM held h WHERE h.doc_key = s.doc_key AND h.block_ix = s.block_ix AND h.seg = s.seg))
    SELECT doc_key, block_ix AS old_block_ix, CAST(seg AS INTEGER) AS seg, seg > 0 AS break_before, CAST(row_number() OVER (PARTITION BY doc_key ORDER BY block_ix, seg) - 1 AS INTEGER) AS block_ix FROM kept""",
    "fx_tokens",
)(lambda t: structure.split_blocks(t.select("doc_key", "block_ix").distinct(), _broken(t)).select("doc_key", "old_block_ix", "seg", "break_before", "block_ix"))
query("corpus_report", "SELECT doc_id, count(*) AS blocks, count(*) FILTER (block_type = 'table') AS table_blocks, count(num_id) AS list_items FROM fx_blocks GROUP BY 1", "fx_blocks")(validate.corpus_report)
query(
    "write_pdf_model",
    f"""WITH {_REGIONS},
    own AS (SELECT doc_id, page, list({{'id': id, 'page': page, 'type': type, 'box': {{'x': x, 'y': y, 'w': w, 'h': h}}, 'value': value, 'acroFieldName': acro_field_name}} ORDER BY id) AS r FROM regions GROUP BY 1, 2),
    pg AS (SELECT p.doc_id, list({{'index': page, 'width_pt': width_pt, 'height_pt': height_pt, 'regions': coalesce(r, [])}} ORDER BY page) AS pages FROM fx_pdf_pages p LEFT JOIN own USING (doc_id, page) GROUP BY 1)
    SELECT doc_id, page['index'] AS page, region['id'] AS id, region['box']['x'] AS x, region['box']['h'] AS h, region['acroFieldName'] AS name, route
    FROM (SELECT doc_id, route, page, unnest(page['regions']) AS region FROM (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM fx_pdf_widgets) THEN 'acroform' ELSE 'flat' END AS route, unnest(pages) AS page FROM pg))""",
    "fx_pdf_pages", "fx_pdf_spans", "fx_pdf_widgets",
)(
    lambda p, s, w: tables.pdf_models(pdf.pdf_route(p, w), p, pdf.pdf_regions(p, s, w)).select("doc_id", F.from_json("model", "route STRING, pages ARRAY<STRUCT<`index`: INT, regions: ARRAY<STRUCT<id: STRING, box: STRUCT<x: DOUBLE, h: DOUBLE>, acroFieldName: STRING>>>>").alias("m")).select("doc_id", "m.route", F.explode("m.pages").alias("p")).select("doc_id", "route", C("p.index").alias("page"), F.explode("p.regions").alias("r")).select("doc_id", "page", "r.id", "r.box.x", "r.box.h", C("r.acroFieldName").alias("name"), "route")
)
query("run_css", "SELECT doc_id, block_ix, 'font-size: ' || n_rows || 'pt' || CASE WHEN n_rows % 2 = 0 THEN '; color: #FF0000' ELSE '' END || CASE WHEN n_rows % 3 = 0 THEN '; text-decoration: line-through' ELSE '' END AS out FROM fx_blocks", "fx_blocks")(
    lambda b: b.select("doc_id", "block_ix", styles.run_css({"font_size_pt": C("n_rows"), "font_family": F.lit(""), "color": F.when(C("n_rows") % 2 == 0, "FF0000"), "strike": C("n_rows") % 3 == 0}).alias("out"))
)
query("rendered_break_hints", "WITH t AS (SELECT *, row_number() OVER w = 1 AS first, count(*) FILTER (run_ix = 1) OVER (PARTITION BY doc_key, block_ix) AS n FROM fx_tokens WHERE kind <> 'checkbox' WINDOW w AS (PARTITION BY doc_key, block_ix ORDER BY run_ix)) SELECT doc_key, block_ix, 1 AS run_ix, length(CASE WHEN kind = 'text' AND run_ix = 0 THEN text ELSE '' END) = 0 AS at_start FROM t WHERE first AND n > 0", "fx_tokens")(
    lambda t: structure.rendered_break_hints(t.filter("kind <> 'checkbox'").withColumn("kind", F.when(C("run_ix") == 1, "rendered").otherwise(C("kind")))).select("doc_key", "block_ix", "run_ix", "at_start")
)

# Archives ------------------------------------------------------------------------------------------------------------------
#: What patches are resolved by.
_EDIT_COLUMNS = ("doc_key", "part_ord", "part_name", "section_kind", "seq", "tag", "existing", "parent_tag", "above", "boxes", "in_content")
_EDIT_TAGS = ("p", "r", "sdt", "t", "checked")


query(
    "shred_docx",
    """WITH t AS (SELECT doc_key, count(*) FILTER (kind <> 'checkbox') AS runs, count(*) FILTER (kind = 'checkbox') AS boxes, count(DISTINCT block_ix) AS paras FROM fx_tokens GROUP BY 1),
    c AS (SELECT doc_key, count(*) AS cells, count(DISTINCT row_ix) AS rows, sum(checkbox_count) AS boxes, count(*) FILTER (text <> '') AS runs FROM fx_cells GROUP BY 1)
    SELECT doc_key, CAST(paras + coalesce(cells, 0) AS BIGINT) AS paragraphs, CAST(t.runs + coalesce(c.runs, 0) + t.boxes + coalesce(c.boxes, 0) AS BIGINT) AS runs, CAST(t.boxes + coalesce(c.boxes, 0) AS BIGINT) AS boxes, coalesce(rows, 0) AS table_rows FROM t LEFT JOIN c USING (doc_key)""",
    "fx_tokens", "fx_cells", dealt=True,
)(lambda t, c: docx_io.shred_docx(archives(t, c), ("doc_key", "section_kind", "tag"), ("body", "p", "r", "checkbox", "tr"), ("body",)).filter("section_kind = 'body'").groupBy("doc_key").agg(F.count_if(C("tag") == "p").alias("paragraphs"), F.count_if(C("tag") == "r").alias("runs"), F.count_if(C("tag") == "checkbox").alias("boxes"), F.count_if(C("tag") == "tr").alias("table_rows")))
query(
    "build_blocks",
    "SELECT DISTINCT doc_key, block_ix, 'paragraph' AS block_type, 'body' AS section_kind FROM fx_tokens UNION ALL SELECT DISTINCT doc_key, block_ix, 'table', 'body' FROM fx_cells",
    "fx_tokens", "fx_cells", dealt=True,
)(lambda t, c: structure.build_blocks(docx_io.shred_docx(archives(t, c), ("doc_key", "part_ord", "section_kind", "seq", "parent_seq", "tag", "parent_tag", "error"), ("document", "body", "hdr", "ftr", "p", "tbl"), docx_io.SECTIONS)).select("doc_key", "block_ix", "block_type", "section_kind"))
query(
    "build_tokens",
    "SELECT doc_key, block_ix, CAST(row_number() OVER (PARTITION BY doc_key, block_ix ORDER BY run_ix) - 1 AS INTEGER) AS run_ix, kind, text, para_node_id FROM fx_tokens",
    "fx_tokens", "fx_cells", dealt=True,
)(lambda t, c: docx_io.body_tokens(docx_io.tokens_of(docx_io.shred_docx(archives(t, c), docx_io.TOKEN_COLUMNS, docx_io.TOKEN_TAGS, docx_io.SECTIONS))).select("doc_key", "block_ix", "run_ix", "kind", "text", "para_node_id"))


def _cells(tokens: DataFrame, cells: DataFrame) -> DataFrame:
    nodes = kept(docx_io.shred_docx(archives(tokens, cells), docx_io.TOKEN_COLUMNS, (*docx_io.TOKEN_TAGS, *docx_io.CELL_TAGS), docx_io.SECTIONS), "nodes")
    return docx_io.cells_of(nodes, docx_io.tokens_of(nodes)).select("doc_key", "block_ix", "row_ix", "cell_ix", "text", "checkbox_count", "colspan", "vmerge")


query("build_cells", f"SELECT doc_key, block_ix, row_ix, cell_ix, {_STRIP.format('text')} AS text, checkbox_count, colspan, vmerge FROM fx_cells", "fx_tokens", "fx_cells", dealt=True)(_cells)


def _rewritten(tokens: DataFrame, cells: DataFrame) -> DataFrame:
    """Archives with a text in the last paragraph, an older and a newer one in the second, and ticks in the first box, written and read again."""
    blobs = kept(archives(tokens, cells), "archives")
    nodes = kept(docx_io.shred_docx(blobs, _EDIT_COLUMNS, _EDIT_TAGS, docx_io.SECTIONS), "nodes")
    docs = blobs.select("doc_key")
    made = [(1, "p_5", "filled", None), (1, "p_1", "older", None), (2, "p_1", "newer", None), (1, "sdt_0", None, True), (1, "r_none", "lost", None)]
    made = F.array(*[F.struct(F.lit(n).alias("patch_ord"), F.lit(node).alias("node_id"), F.lit(text).cast("string").alias("text"), F.lit(on).cast("boolean").alias("checked")) for n, node, text, on in made])
    every = docs.select("doc_key", F.explode(made).alias("m")).select("doc_key", "m.*", F.lit(None).cast("string").alias("operation"))
    written = docx_io.write_docx(blobs, docx_io.patch_edits(nodes, every))
    again = docx_io.body_tokens(docx_io.tokens_of(docx_io.shred_docx(written.select(C("out_key").alias("doc_key"), "content"), docx_io.TOKEN_COLUMNS, docx_io.TOKEN_TAGS, docx_io.SECTIONS)))
    again = kept(again, "tokens")  # two groups read them
    boxes = again.groupBy("doc_key", "block_ix").agg(F.count_if(C("checked")).alias("ticked"))
    return fields.paragraph_texts(again).join(boxes, ["doc_key", "block_ix"]).select("doc_key", "block_ix", "text", "ticked")


query(
    "write_docx",
    f"""WITH {_PARAGRAPHS} SELECT 'exported/' || split_part(doc_key, '/', 2) || '/order-exported.docx' AS doc_key, block_ix, CASE block_ix WHEN 5 THEN 'filled' WHEN 1 THEN 'newer' ELSE text END AS text, CASE WHEN checkbox_count > 0 THEN 1 ELSE 0 END AS ticked FROM para""",
    "fx_tokens", "fx_cells", dealt=True,
)(_rewritten)


# Property elements -----------------------------------------------------------------------------------------------------------
def _properties(blocks: DataFrame, *more: Column) -> DataFrame:
    """Property elements of a paragraph, run and cell for each block, and ``more``: doc_id, para, run, cell, seq, tag, owner and attrs."""
    n, text = C("n_rows"), lambda c: c.cast("string")
    value = lambda tag, v, key="val", owner="paragraph", when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(tag).alias("tag"), F.lit(owner).alias("owner"), F.create_map(F.lit(key), v).alias("attrs")))
    rows = F.array(
        value("pStyle", F.concat(F.lit("H"), text(n % 4))), value("jc", F.lit("both"), when=n % 2 == 0), value("spacing", text(n * 10), "before"), value("ind", text(n * 5), "left", when=n % 3 == 0), value("numId", C("num_id"), when=C("num_id").isNotNull()),
        value("pageBreakBefore", F.lit("1"), when=n % 5 == 0), value("sz", text(n), owner="run"), value("rFonts", F.lit("Arial"), "hAnsi", "run", n % 5 == 0), value("color", F.when(n % 4 == 0, "auto").otherwise("FF0000"), owner="run"), value("b", F.lit("0"), owner="run", when=n % 2 == 1),
        value("vAlign", F.lit("center"), owner="cell", when=n % 3 == 1), value("jc", F.lit("right"), owner="cell", when=n % 7 == 0), value("shd", F.when(n % 2 == 0, "auto").otherwise("EEEEEE"), "fill", "cell"), *more,
    )
    return blocks.select("doc_id", C("block_ix").alias("para"), C("block_ix").alias("run"), C("block_ix").alias("cell"), F.posexplode(F.filter(rows, lambda x: x.isNotNull())).alias("seq", "x")).select("doc_id", "para", "run", "cell", "seq", "x.*")


query(
    "paragraph_styles",
    """SELECT doc_id, block_ix AS para, CASE n_rows % 4 WHEN 0 THEN 'H0' ELSE 'Name ' || (n_rows % 4) END AS style_name, CASE WHEN n_rows % 2 = 0 THEN 'both' END AS alignment, CAST(n_rows * 10 AS VARCHAR) AS space_before,
    CASE WHEN n_rows % 3 = 0 THEN CAST(n_rows * 5 AS VARCHAR) END AS indent_left, num_id, n_rows % 5 = 0 AS page_break_before FROM fx_blocks""",
    "fx_blocks",
)(
    lambda b: styles.paragraph_styles(_properties(b).filter("owner = 'paragraph'"), b.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("k")).select("doc_id", F.concat(F.lit("H"), C("k").cast("string")).alias("style_id"), F.concat(F.lit("Name "), C("k").cast("string")).alias("name"))).select("doc_id", "para", "style_name", "alignment", "space_before", "indent_left", "num_id", "page_break_before")
)
query(
    "run_styles",
    "SELECT doc_id, block_ix AS run, n_rows / 2.0::DOUBLE AS font_size_pt, CASE WHEN n_rows % 5 = 0 THEN 'Arial' END AS font_family, CASE WHEN n_rows % 4 <> 0 THEN 'FF0000' END AS color, n_rows % 2 = 1 AS bold, false AS italic FROM fx_blocks",
    "fx_blocks",
)(lambda b: styles.run_styles(_properties(b).filter("owner = 'run'")).select("doc_id", "run", "font_size_pt", "font_family", "color", "bold", "italic"))
def _cell_styles(blocks: DataFrame) -> DataFrame:
    """Styles of cells with a border of each kind: of a known width and colour, of none, without a style, and by default."""
    n = C("n_rows")
    edge = lambda name, when, **attrs: F.when(when, F.struct(F.lit(name).alias("tag"), F.lit("cell").alias("owner"), F.create_map(*[x for k, v in attrs.items() for x in (F.lit(k), v)]).alias("attrs")))
    size = n.cast("string")
    borders = edge("top", n % 2 == 0, val=F.lit("double"), sz=size, color=F.lit("aabbcc")), edge("left", n % 3 == 0, val=F.lit("single"), color=F.lit("auto")), edge("bottom", n % 5 == 0, val=F.lit("nil"), sz=size), edge("right", n % 7 < 3, val=F.when(n % 7 == 0, "").otherwise("dashed"), sz=size)
    found = structure.cell_styles(_properties(blocks, *borders).withColumn("group", F.when(C("tag").isin(*structure.CELL_EDGES), "tcBorders").otherwise("tcPr")))
    line = lambda e: F.concat_ws(" ", F.lit(e), *[C("borders")[e][k].cast("string") for k in ("style", "width_pt", "color")])
    return found.withColumn("borders", F.concat_ws("; ", *[F.when(C("borders")[e].isNotNull(), line(e)) for e in structure.CELL_EDGES]))


query(
    "cell_styles",
    """SELECT doc_id, block_ix AS cell, CASE WHEN n_rows % 3 = 1 THEN 'center' END AS v_align, CASE WHEN n_rows % 7 = 0 THEN 'right' WHEN n_rows % 2 = 0 THEN 'both' END AS alignment, CASE WHEN n_rows % 2 = 1 THEN 'EEEEEE' END AS fill,
    concat_ws('; ', CASE WHEN n_rows % 2 = 0 THEN 'top double ' || round_even(n_rows / 8.0::DOUBLE, 2) || ' AABBCC' END, CASE WHEN n_rows % 3 = 0 THEN 'left solid 0.5 000000' END, CASE WHEN n_rows % 7 IN (1, 2) THEN 'right solid ' || round_even(n_rows / 8.0::DOUBLE, 2) || ' 000000' END) AS borders FROM fx_blocks""",
    "fx_blocks",
)(_cell_styles)
query(
    "cell_css",
    """SELECT doc_id, block_ix, 'padding: 0px 7px; vertical-align: ' || CASE WHEN n_rows % 3 = 1 THEN 'middle' ELSE 'top' END || '; overflow-wrap: break-word' || CASE WHEN n_rows % 7 = 0 THEN '; text-align: right' WHEN n_rows % 2 = 0 THEN '; text-align: left' ELSE '' END
    || CASE WHEN n_rows % 2 = 1 THEN '; background-color: #EEEEEE' ELSE '' END AS css FROM fx_blocks""",
    "fx_blocks",
)(lambda b: structure.cell_styles(_properties(b)).select("doc_id", C("cell").alias("block_ix"), styles.cell_css({x: C(x) for x in ("v_align", "alignment", "fill")}).alias("css")))
query(
    "paragraph_css",
    """SELECT doc_id, block_ix, concat_ws('; ', CASE WHEN n_rows % 2 = 0 THEN 'text-align: left' END, 'margin-top: ' || greatest(1, CAST(round(n_rows * 10 / 15.0) AS INTEGER)) || 'px', CASE WHEN n_rows % 3 = 0 THEN 'padding-left: ' || greatest(1, CAST(round(n_rows * 5 / 15.0) AS INTEGER)) || 'px' END) AS css FROM fx_blocks""",
    "fx_blocks",
)(lambda b: styles.paragraph_styles(_properties(b).filter("owner = 'paragraph'"), b.select("doc_id", F.lit("none").alias("style_id"), F.lit("none").alias("name")).distinct()).select("doc_id", C("para").alias("block_ix"), styles.paragraph_css({x: C(x) for x in ("alignment", "space_before", "indent_left")}).alias("css")))
query(
    "annotation_css",
    """SELECT doc_id, block_ix, concat_ws('; ', CASE n_rows % 3 WHEN 0 THEN 'margin-top: 0' WHEN 1 THEN 'margin-top: 16px' END, CASE n_rows % 4 WHEN 0 THEN 'opacity: 0.75' WHEN 1 THEN 'border-left: 2px solid #9ca3af; padding-left: 6px' END, CASE WHEN n_rows % 5 = 0 THEN 'opacity: 0.4' END) AS css FROM fx_blocks""",
    "fx_blocks",
)(lambda b: b.select("doc_id", "block_ix", styles.annotation_css({"spacing_before": F.element_at(F.array(F.lit("none"), F.lit("medium"), F.lit(None)), C("n_rows") % 3 + 1), "spacing_after": F.lit(None).cast("string"), "emphasis": F.element_at(F.array(F.lit("low"), F.lit("medium"), F.lit(None), F.lit("wild")), C("n_rows") % 4 + 1), "suppress": F.when(C("n_rows") % 5 == 0, True)}).alias("css")))
query(
    "annotate_blocks",
    """WITH p AS (SELECT doc_id, block_ix, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_ix) - 1 AS INTEGER) AS pos FROM fx_blocks WHERE n_rows % 3 <> 0)
    SELECT doc_id, block_ix, CASE WHEN pos % 2 = 1 THEN pos % 6 + 1 END AS heading_weight FROM p""",
    "fx_blocks",
)(
    lambda b: styles.annotate_blocks(b.filter("n_rows % 3 <> 0").select("doc_id", F.lit(1).alias("section_ix"), "block_ix", F.lit(0).alias("part")), b.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit(1).alias("section_ix"), F.explode(F.sequence(F.lit(1), (C("n") + 1).cast("int"), F.lit(2))).alias("block_ix")).withColumn("heading_weight", C("block_ix") % 6 + 1)).select("doc_id", "block_ix", "heading_weight")
)
def _setup(orders: DataFrame) -> DataFrame:
    """Elements of page size, margins, defaults, the style Normal and the theme of each order, by rungs: which of them there are depends on the key."""
    k = C("o_orderkey")
    made = lambda tag, owner, seq, when, **attrs: F.when(when, F.struct(F.lit(tag).alias("tag"), F.lit(owner).alias("owner"), F.map_filter(F.create_map(*[x for n, v in attrs.items() for x in (F.lit(n), v.cast("string"))]), lambda _, v: v.isNotNull()).alias("attrs"), F.lit(seq).alias("seq")))
    rows = F.array(
        made("pgSz", "body", 1, F.lit(True), w=12000 + k % 500, h=F.when(k % 7 != 0, F.lit(15840))), made("pgSz", "body", 2, F.lit(True), w=F.lit(1), h=F.lit(1)), made("pgMar", "body", 3, F.lit(True), top=F.when(k % 2 == 0, "1440").otherwise("wide")),
        made("sz", "docDefaults", 4, k % 3 == 0, val=F.lit(24)), made("sz", "Normal", 5, F.lit(True), val=F.lit(22)), made("spacing", "docDefaults", 6, k % 4 != 0, line=F.lit(276), lineRule=F.when(k % 4 == 1, "auto").when(k % 4 == 2, "exact"), after=k % 200),
        made("spacing", "Normal", 7, k % 5 != 0, line=F.lit(240), lineRule=F.when(k % 5 == 1, "exact")), made("latin", "theme", 8, k % 6 != 0, typeface=F.when(k % 6 == 1, "Arial").when(k % 6 == 2, "SEGOE UI").otherwise("Unknown")),
    )
    return orders.select(k.alias("doc_id"), F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("x")).select("doc_id", "x.*")


query(
    "page_setup",
    """WITH s AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 4 = 1 THEN 276 WHEN o_orderkey % 5 NOT IN (0, 1) THEN 240 END AS line, CASE o_orderkey % 6 WHEN 1 THEN 1.275 WHEN 2 THEN 1.329 ELSE 1.3 END::DOUBLE AS ratio FROM orders)
    SELECT k AS doc_id, CASE WHEN k % 7 <> 0 THEN round_even((12000 + k % 500) / 1440.0::DOUBLE, 4) END AS width_in, CASE WHEN k % 7 <> 0 THEN 11.0 END::DOUBLE AS height_in, CASE WHEN k % 2 = 0 THEN 1.0 END::DOUBLE AS top_in, CASE WHEN k % 3 = 0 THEN 12.0 END::DOUBLE AS default_font_size_pt,
    round_even(line / 240.0::DOUBLE * ratio, 4) AS default_line_height, CASE WHEN line IS NOT NULL THEN ratio END AS default_win_ratio, CASE WHEN k % 4 <> 0 THEN CAST(k % 200 AS INTEGER) END AS para_after_twips FROM s""",
    "orders",
)(lambda o: structure.page_setup(_setup(o)).select("doc_id", "width_in", "height_in", C("margins_in.top").alias("top_in"), "default_font_size_pt", "default_line_height", "default_win_ratio", "para_after_twips"))
_ZONED = {names: ", ".join(f".docx-page-{z} {n}" for z in ("header", "content", "footer") for n in names.split("|")) for names in ("p|h1|h2|h3|h4|h5|h6", "ul|ol", "td p|th p", "td li|th li", "td ul|td ol|th ul|th ol")}
query(
    "page_css",
    f"""WITH s AS (SELECT doc_id, n_rows * 0.5 AS w, CASE WHEN n_rows % 2 = 0 THEN '11' ELSE '10.0' END AS f, CASE WHEN n_rows % 3 = 0 THEN CAST(round_even(n_rows * 10 / 15.0::DOUBLE, 0) AS INTEGER) ELSE 0 END AS below FROM fx_blocks WHERE block_ix = 0),
    t AS (SELECT *, 'font-size:' || f || 'pt;line-height:1.08;font-family:Calibri,''Segoe UI'',Arial,sans-serif}}' AS font, 'margin-top:0px;margin-bottom:' || below || 'px' AS around FROM s)
    SELECT doc_id, '.document{{background:#e0e0e0;padding:24px;display:flex;flex-direction:column;align-items:center;gap:24px}}.docx-page{{width:' || CAST(round_even(w * 96, 0) AS INTEGER) || 'px;background:white;box-shadow:0 2px 8px rgba(0,0,0,.25);box-sizing:border-box;display:flex;flex-direction:column}}.docx-page-header{{padding:48px 48px 0 48px;' || font
    || '.docx-page-content{{flex:1;padding:0 48px 0 48px;' || font || '.docx-page-footer{{padding:0 48px 48px 48px;' || font || '{_ZONED["p|h1|h2|h3|h4|h5|h6"]}{{' || around || '}}{_ZONED["ul|ol"]}{{' || around || ';padding-left:2em}}{_ZONED["td p|th p"]}{{margin-top:0;margin-bottom:0;line-height:1.3}}'
    || '{_ZONED["td li|th li"]}{{margin-top:0;margin-bottom:0}}{_ZONED["td ul|td ol|th ul|th ol"]}{{margin-top:0;margin-bottom:0}}' AS css FROM t""",
    "fx_blocks",
)(lambda b: render.page_css(b.filter("block_ix = 0").select("doc_id", (C("n_rows") * 0.5).alias("width_in"), F.lit(None).cast("double").alias("height_in"), F.when(C("n_rows") % 2 == 0, 0.0).otherwise(10.0).alias("default_font_size_pt"), F.lit(None).cast("double").alias("default_line_height"), F.when(C("n_rows") % 3 == 0, C("n_rows") * 10).alias("para_after_twips"))))
query(
    "effective_borders",
    """SELECT doc_id, block_ix, edge, CASE WHEN n_rows % 2 = 0 AND edge IN ('top', 'left') THEN 'own' WHEN n_rows % 3 = 0 AND edge IN ('top', 'bottom') THEN 'across' WHEN n_rows % 7 < 3 AND edge IN ('left', 'right') THEN 'down' WHEN n_rows % 5 = 0 AND edge <> 'left' THEN 'edge' END AS border
    FROM fx_blocks, (SELECT unnest(['top', 'left', 'bottom', 'right']) AS edge)""",
    "fx_blocks",
)(
    lambda b: (lambda d: d.select("doc_id", "block_ix", "edge", styles.effective_borders(d).alias("border")))(b.withColumn("edge", F.explode(F.array(*map(F.lit, styles.INSIDE)))).withColumns({"cell_borders": F.when(C("n_rows") % 2 == 0, F.create_map(*map(F.lit, ("top", "own", "left", "own")))), "tbl_borders": F.map_filter(F.create_map(F.lit("insideH"), F.when(C("n_rows") % 3 == 0, "across"), F.lit("insideV"), F.when(C("n_rows") % 7 < 3, "down"), *[x for e in ("top", "bottom", "right") for x in (F.lit(e), F.when(C("n_rows") % 5 == 0, "edge"))]), lambda k, v: v.isNotNull())}))
)

# Archives to HTML --------------------------------------------------------------------------------------------------------
_TD = "padding: 0px 2px 0px 10px; vertical-align: top; overflow-wrap: break-word{}; border-top: 0.5pt solid #000000; border-left: 1.5pt double #AABBCC; border-right: 1.5pt double #AABBCC"
_PLAIN_TABLE = f'style="{render.TABLE_STYLE}"'
query(
    "render_archives",
    f"""WITH b AS (
      SELECT doc_id, block_ix, block_type, num_id, n_rows AS n, block_type = 'paragraph' AS par, block_ix > 0 AND block_type = 'paragraph' AND n_rows % 5 = 0 AS opens, CASE WHEN block_type = 'paragraph' THEN 1 ELSE 3 END AS ps, CASE WHEN block_type = 'paragraph' THEN 1 ELSE 2 END AS rs FROM fx_blocks),
    c AS (SELECT *, sum(opens::INT) OVER w AS page, sum(ps) OVER w - ps AS p0, sum(rs) OVER w - rs AS r0 FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY block_ix)),
    d AS (SELECT *, ' data-node-id="p_' || p0 || '" data-node-kind="paragraph"' AS pid, ' data-node-id="r_' || r0 || '" data-node-kind="run" style="font-size: ' || (n // 2) || CASE WHEN n % 2 = 1 THEN '.5' ELSE '' END || 'pt">' || CASE WHEN n % 2 = 1 THEN '<strong>t ' || n || '</strong>' ELSE 't ' || n END || '</span>' AS run, CASE WHEN n % 4 = 0 THEN 'p' ELSE 'h' || (n % 4) END AS tag FROM c),
    e AS (SELECT *, CASE WHEN par THEN '<' || tag || pid || ' data-block="' || block_ix || '" data-para="0" style="' || CASE WHEN n % 2 = 0 THEN 'text-align: left; ' ELSE '' END || 'margin-top: ' || greatest(1, CAST(round(n * 10 / 15.0) AS INTEGER)) || 'px"><span data-run="0"' || run || '</' || tag || '>'
      ELSE '<table data-block="' || block_ix || '" {_PLAIN_TABLE}><colgroup><col style="width: 33.33%;"><col style="width: 66.67%;"></colgroup><tr data-row="0"><td data-cell="0" style="{_TD.format("; background-color: #EEEEEE")}"><p' || pid || ' data-block="' || block_ix || '" data-para="0"><span data-run="0" data-node-id="r_' || r0 || '" data-node-kind="run">a ' || n || '</span></p></td><td data-cell="1" style="{_TD.format("")}">'
        || '<table {_PLAIN_TABLE}><tr data-row="0"><td data-cell="0" style="padding: 0px 7px; vertical-align: top; overflow-wrap: break-word"><p data-node-id="p_' || (p0 + 1) || '" data-node-kind="paragraph"><span data-run="0" data-node-id="r_' || (r0 + 1) || '" data-node-kind="run">c ' || n || '</span></p></td></tr></table>'
        || '<p class="docx-empty-paragraph" data-node-id="p_' || (p0 + 2) || '" data-node-kind="paragraph" data-block="' || block_ix || '" data-para="1"></p></td></tr></table>' END AS shown, '<li' || pid || '><span' || run || '</li>' AS li FROM d),
    m AS (SELECT *, CASE WHEN num_id IS NOT NULL AND num_id IS NOT DISTINCT FROM lag(num_id) OVER w THEN 0 ELSE 1 END AS s FROM e WINDOW w AS (PARTITION BY doc_id, page ORDER BY block_ix)),
    g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, page ORDER BY block_ix) AS k FROM m),
    l AS (SELECT doc_id, page, k, CASE WHEN min(num_id) IS NULL THEN min(shown) WHEN min(num_id) = '1' THEN '<ol style="list-style-type: decimal">' || string_agg(li, '' ORDER BY block_ix) || '</ol>' ELSE '<ul style="list-style-type: disc">' || string_agg(li, '' ORDER BY block_ix) || '</ul>' END AS h FROM g GROUP BY 1, 2, 3),
    q AS (SELECT doc_id, page, string_agg(h, '' ORDER BY k) AS h FROM l GROUP BY 1, 2),
    t AS (SELECT doc_id, '<div class="docx-page"><div class="docx-page-header"><p data-node-id="p_' || (sum(ps) + 1) || '" data-node-kind="paragraph"><span data-run="0" data-node-id="r_' || (sum(rs) + 1) || '" data-node-kind="run">second ' || doc_id || '</span></p></div><div class="docx-page-content" style="padding-top:0px;padding-bottom:48px">' AS a FROM b GROUP BY 1)
    SELECT CAST(doc_id AS VARCHAR) AS doc_key, md5('<div class="document">' || chr(10) || string_agg(a || h || '</div></div>', chr(10) ORDER BY page) || chr(10) || '</div>') AS html_md5 FROM q JOIN t USING (doc_id) GROUP BY 1""",
    "fx_blocks",
)(lambda b: render.render_html(**document_parts(kept(docx_io.shred_docx(styled_archives(b), docx_io.NODE_COLUMNS), "nodes"))).select("doc_key", F.md5(F.encode("html", "utf-8")).alias("html_md5")))


def _reports(blocks: DataFrame) -> DataFrame:
    """Reports of the styled archives, with annotations of some and a check that documents of over five blocks fail."""
    nodes = docx_io.shred_docx(styled_archives(blocks), ("doc_key", "part_ord", "part_name", "section_kind", "tag", "parent_tag", "error"), ("body", "hdr", "ftr", "p", "tbl", "Relationship"), (*docx_io.SECTIONS, "rels"))
    some = blocks.groupBy(C("doc_id").cast("string").alias("doc_id")).agg(F.count("*").alias("n"))
    answer = F.concat(F.lit('{"document_type": "'), F.when(C("n") % 2 == 0, "form").otherwise("odd"), F.lit('", "annotations": {"s2:b0": {"emphasis": "high"}, "s2:b1": {"emphasis": "wild"}, "s2:b2": {"suppress": true}}}'))
    said = styles.parse_annotations(some.filter("n <> 3").select("doc_id", answer.alias("raw")))
    media = some.filter("n > 2").select(C("doc_id").alias("doc_key"))
    checks = {"length": some.select("doc_id", (C("n") <= 5).alias("passed")), "other": some.select("doc_id", F.when(C("n") == 1, True).alias("passed"))}
    return document_reports(nodes, media, said, checks)


query(
    "document_reports",
    """SELECT CAST(doc_id AS VARCHAR) AS doc_id, 'header,header,body' AS sections, n AS body_blocks, CAST(2 AS BIGINT) AS relationships, CAST(n > 2 AS BIGINT) AS media_files, CAST(CASE WHEN n = 3 THEN 0 ELSE 2 END AS BIGINT) AS annotation_count, CASE WHEN n % 2 = 0 THEN 'form' END AS document_type,
    CASE WHEN n = 1 THEN 'length,other' WHEN n <= 5 THEN 'length' ELSE '' END AS passed, CASE WHEN n > 5 THEN 'length' ELSE '' END AS failed, CASE WHEN n > 5 THEN 'FAIL' ELSE 'PASS' END AS result FROM (SELECT doc_id, count(*) AS n FROM fx_blocks GROUP BY 1)""",
    "fx_blocks",
)(_reports)
