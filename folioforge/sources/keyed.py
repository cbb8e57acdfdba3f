"""One object for each key: what a job makes for a document is stored under the document's own derived key.

The rows are written to the shared folder first, by Spark's own commit protocol, so nothing of failed or repeated tasks is in
them and their contents no longer change.  Then every task publishes its rows: an object is written beside its place and
renamed onto it.  A task that is repeated publishes the same bytes again, so each key has one object, never half of one,
and no list of keys comes to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import kept


def _opened(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system and the path of a folder, given as a path or a URI."""
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


def _safe(key: str) -> str:
    """A key as a relative path: no empty, ``.`` or ``..`` parts."""
    return "/".join(p for p in key.split("/") if p not in ("", ".", ".."))


def write_keyed(rows: DataFrame, root: str, order: Column | None = None) -> None:
    """Stores rows(key, content) as ``root``/key, over what is there; content is a string or binary.

    Rows without a key or content are left out.  Of rows with one key the greatest by ``order`` counts (then by content).
    """
    content = F.col("content").cast("binary")
    ranked = F.struct(*([order.alias("o")] if order is not None else []), content.alias("c"))
    one = rows.filter("key is not null and content is not null").groupBy("key").agg(F.max(ranked)["c"].alias("content"))
    fixed = kept(one, "keyed")

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _opened(root)
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                place = f"{base}/{_safe(key)}"
                folder, _, name = place.rpartition("/")
                files.create_dir(folder, recursive=True)
                beside = f"{folder}/.{name}.{uuid.uuid4().hex}"
                with files.open_output_stream(beside) as out:
                    out.write(data.as_py())
                files.move(beside, place)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    fixed.mapInArrow(publish, "n long").agg(F.sum("n")).collect()


def write_documents_html(documents: DataFrame, root: str) -> None:
    """documents(doc_key, html) as files at their converted keys."""
    from ..functions import keys as K

    write_keyed(documents.select(K.converted_html_key(F.col("doc_key")).alias("key"), F.col("html").alias("content")), root)


def write_documents_fields(fields: DataFrame, root: str) -> None:
    """The fields of each document as {documentId, fields} at its extracted key."""
    from ..functions import keys as K
    from .docx_io import fields_json

    write_keyed(fields_json(fields).select(K.extracted_fields_key(F.col("documentId")).alias("key"), F.to_json(F.struct("documentId", "fields")).alias("content")), root)


def write_documents_docx(written: DataFrame, root: str) -> None:
    """Archives of ``write_docx`` at their export keys."""
    write_keyed(written.select(F.col("out_key").alias("key"), "content"), root)
