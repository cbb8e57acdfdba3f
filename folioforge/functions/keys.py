"""Column functions on object keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EXTENSION = r"^((?:.*/)?\.*[^/]*?)(\.[^./]*)?$"


def split_ext(key: Column) -> tuple[Column, Column]:
    """Base and extension; leading dots of the name are no extension."""
    return F.regexp_extract(key, EXTENSION, 1), F.regexp_extract(key, EXTENSION, 2)


def _moved(key: Column, prefix: str, tail: Column) -> Column:
    base, _ = split_ext(key)
    return F.concat(F.lit(prefix), F.when(base.startswith("uploads/"), F.substring(base, len("uploads/") + 1, 1 << 30)).otherwise(base), tail)


def converted_html_key(key: Column) -> Column:
    return _moved(key, "converted/", F.lit(".html"))


def extracted_fields_key(key: Column) -> Column:
    return _moved(key, "extracted/", F.lit(".json"))


def pdf_model_key(key: Column) -> Column:
    return _moved(key, "pdf-extracted/", F.lit("/model.json"))


def pdf_page_image_key(key: Column, page: Column) -> Column:
    return _moved(key, "pdf-extracted/", F.concat(F.lit("/page-"), page.cast("string"), F.lit(".png")))


def export_key(key: Column) -> Column:
    folder, name = F.regexp_extract(key, r"^((?:.*/)?)[^/]*$", 1), F.element_at(F.split(key, "/"), -1)
    base, ext = split_ext(name)
    kind = F.when(F.lower(ext) == ".pdf", "-filled.pdf").otherwise("-exported.docx")
    return F.concat(F.regexp_replace(folder, r"^(.*?)uploads/", r"$1exported/"), base, kind)


def file_name(key: Column) -> Column:
    return F.element_at(F.split(key, "/"), -1)


def doc_title(key: Column) -> Column:
    return F.regexp_replace(file_name(key), r"\.[^.]+$", "")


def classify_storage_error(code: Column) -> Column:
    return F.when(code.isin("404", "NoSuchKey", "NotFound"), "not found").when(code.isin("403", "AccessDenied"), "access denied").otherwise(F.concat(F.lit("storage error: "), code))
