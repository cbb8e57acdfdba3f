"""Column functions on field text, keys and values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What str.strip() removes: fixed values, Unicode white space and the four separators.
WHITE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Patterns of the field rules.
PLACEHOLDER = "_{3,}"
DATE_HINT = r"(?i)\bdate\b"
DATE_VALUE = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
NUMBER_HINT = r"(?i)\b(amount|qty|quantity|total|number|no\.)\b"
GLYPHS = "☐☑☒"


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def token_piece(kind: Column, text: Column) -> Column:
    """What a token adds to its paragraph's text."""
    return F.when(kind == "text", F.coalesce(text, F.lit(""))).when(kind == "tab", "\t").when(kind.isin("line", "page", "break"), "\n").when(kind == "checkbox", " ").otherwise("")


def has_placeholder(value: Column) -> Column:
    return F.coalesce(F.regexp_like(value, F.lit(PLACEHOLDER)), F.lit(False))


def guess_type(label: Column, value: Column) -> Column:
    both = F.concat_ws(" ", label, value)
    dated = F.regexp_like(both, F.lit(DATE_HINT)) | F.regexp_like(value, F.lit(DATE_VALUE))
    return F.when(dated, "date").when(F.regexp_like(both, F.lit(NUMBER_HINT)), "number").otherwise("text")


def normalize_value(value: Column) -> Column:
    return F.when((value != "") & ~has_placeholder(value), value)


def normalize_label(label: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(label, F.lit(""))), "[^a-z0-9]+", " "))


def strip_checkbox_glyphs(text: Column) -> Column:
    return F.translate(text, GLYPHS, "   ")


def field_id(number: Column) -> Column:
    return F.format_string("field_%03d", number.cast("int"))


def merge_key(label: Column, block: Column, para: Column) -> Column:
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("None"))
    return F.concat_ws("|", normalize_label(label), shown(block), shown(para))


def heading_level(style_name: Column, weight: Column | None = None) -> Column:
    """The heading weight of an annotation, else the number in the style's name; null for plain paragraphs."""
    named = F.nullif(F.regexp_extract(style_name, r"(?i)heading\s*([1-6])", 1), F.lit("")).cast("int")
    return named if weight is None else F.coalesce(weight.cast("int"), named)


def html_escape(text: Column, quotes: bool = False) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"), ("'", "&#x27;")) if quotes else ())):
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def nbsp_spaces(text: Column, preserve: Column) -> Column:
    """Every space if preserved, else only those in runs of two or more."""
    return F.when(preserve, F.replace(text, F.lit(" "), F.lit("\xa0"))).otherwise(F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " (?= )|(?<= ) ", "\xa0")).otherwise(text))


def twips_to_px(twips: Column) -> Column:
    """At least 1; null for what is no number."""
    px = F.round(twips.try_cast("int") / 15).cast("int")
    return F.when(px.isNotNull(), F.greatest(F.lit(1), px))


def validate_field(type_: Column, value: Column) -> Column:
    """An error message, or null for a valid value."""
    text = py_strip(F.coalesce(value, F.lit("")))
    dates = r"^(\d{1,2}[/\-.]\d{1,2}[/\-.]\d{2,4}|\d{4}[/\-.]\d{1,2}[/\-.]\d{1,2})$"
    numbers = r"^([+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)|0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+)$"
    wrong = lambda pattern: ~F.regexp_like(text, F.lit(pattern))
    return F.when((type_ == "checkbox") | (text == ""), F.lit(None)).when((type_ == "date") & wrong(dates), "invalid date").when((type_ == "number") & wrong(numbers), "invalid number")


def provenance(confidence: Column) -> Column:
    return F.when(F.coalesce(confidence, F.lit(1.0)) <= 0.5, "AI").otherwise("rule")


def percent(confidence: Column) -> Column:
    return F.floor(confidence * 100 + 0.5).cast("int")


def value_target(ids: Column) -> Column:
    """The last id if it is a paragraph's, else the last run's."""
    last = F.try_element_at(ids, F.lit(-1))
    return F.when(last.startswith("p_"), last).otherwise(F.try_element_at(F.filter(ids, lambda x: x.startswith("r_")), F.lit(-1)))


def checkbox_target(ids: Column) -> Column:
    return F.try_element_at(F.filter(ids, lambda x: x.startswith("sdt_")), F.lit(1))


def extract_json(raw: Column) -> Column:
    """The JSON text of a model's answer: without a Markdown fence, else from the first brace to the last; null if none parses."""
    text = py_strip(raw)
    inner = F.regexp_replace(text, r"^```[^\n]*\n?", "")
    text = F.when(text.startswith("```"), F.regexp_replace(inner, r"\n[ \t]*```[ \t]*$|^[ \t]*```[ \t]*$", "")).otherwise(text)
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    valid = lambda c: F.get_json_object(c, "$").isNotNull()
    return F.when(valid(text), text).when(valid(braced), braced)


def infer_patch_op(operation: Column, checked: Column, text: Column) -> Column:
    return F.coalesce(operation, F.when(checked.isNotNull(), "toggle_checkbox"), F.when(text.isNotNull(), "replace_text"))


def stamp_value(type_: Column, value: Column) -> Column:
    """What is stamped on a region: a ticked box, the text, or nothing."""
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(None)).when(type_ == "checkbox", "☑").otherwise(value)
