"""Streams give what their batch twins give."""

import hashlib
import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from folioforge.operators import patches
from folioforge.sources import keyed
from folioforge.streaming import jobs

START = datetime(2024, 1, 1)
EDITS = "edit_id long, session_id string, ts timestamp, node_id string, text string, origin string"


def edits(spark):
    steps = [(1, "a", 0, "n1", "x", "user"), (2, "a", 200, "n2", "y", "user"), (3, "a", 900, "n1", "z", "user"), (4, "b", 0, "n1", "q", "sync"), (5, "b", 100, "n1", "w", "user"), (6, "b", 400, "n1", "v", "user"), (9, "z", 900_000, "n", "end", "user")]
    return spark.createDataFrame([(i, s, START + timedelta(milliseconds=ms), n, t, o) for i, s, ms, n, t, o in steps], EDITS)


def streamed(spark, tmp_path, df, made, mode, name):
    df.write.parquet(str(tmp_path / name))
    query = made(spark.readStream.schema(df.schema).parquet(str(tmp_path / name))).writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return spark.table(name)


def test_bursts(spark, tmp_path):
    want = patches.debounce_edits(patches.echo_filter(edits(spark))).filter("session_id <> 'z'")
    assert sorted((r["session_id"], r["text"], r["edits"]) for r in want.collect()) == [("a", "y", 2), ("a", "z", 1), ("b", "v", 2)]
    got = streamed(spark, tmp_path, edits(spark), jobs.debounce_stream, "append", "bursts")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_state(spark, tmp_path):
    want = patches.field_state(patches.echo_filter(edits(spark)))
    got = streamed(spark, tmp_path, edits(spark), jobs.field_state_stream, "complete", "state")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_conversions_in_time_and_not(spark):
    rows = lambda x: spark.createDataFrame([(k, START + timedelta(seconds=s)) for k, s in x], "key string, ts timestamp")
    got = jobs.conversion_status(rows([("a", 0), ("b", 0), ("c", 0)]), rows([("a", 50), ("b", 121), ("c", 120)]))
    assert {r["key"]: r["status"] for r in got.collect()} == {"a": "ready", "b": "timed out", "c": "ready"}


def test_uploads_once(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.docx").write_bytes(b"1")
    handle = lambda rows: rows.select("path", "length")
    for _ in range(2):
        jobs.stream_uploads(spark, str(folder), str(tmp_path / "ck"), handle, str(tmp_path / "out")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1


def run_twice(spark, tmp_path, schema, rows, start):
    """Feeds each list of rows as files of its own, and starts the job anew for each."""
    folder = tmp_path / "fed"
    for part in rows:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
        start(spark.readStream.schema(schema).parquet(str(folder))).awaitTermination()


def test_progress_counts_fills_of_earlier_batches(spark, tmp_path):
    schema = "edit_id long, doc_key string, ts timestamp, node_id string, text string, origin string"
    at = lambda s: START + timedelta(seconds=s)
    rows = [[(1, "d", at(1), "r_1", "x", "user"), (2, "d", at(2), "r_2", "y", "sync"), (3, "e", at(2), "r_1", "q", "user")], [(4, "d", at(3), "r_3", "z", "user")], [(5, "d", at(4), "r_1", " ", "user"), (6, "d", at(0), "r_3", " ", "user")]]
    fields = spark.createDataFrame([(d, i, "text", None, [f"r_{i}"]) for d in "de" for i in (1, 2, 3)], "doc_key string, field_ord int, type string, value string, node_ids array<string>")
    run_twice(spark, tmp_path, schema, rows, lambda s: jobs.live_fill_progress(s, fields, str(tmp_path / "ck"), str(tmp_path / "out")))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted((r["batch"], r["doc_key"], r["filled"], r["total"]) for r in got) == [(0, "d", 1, 3), (0, "e", 1, 3), (1, "d", 2, 3), (2, "d", 1, 3)]


def test_newest_drafts_over_all_batches(spark, tmp_path):
    schema = "title string, html string, ts timestamp, draft_id long"
    at = lambda s: START + timedelta(seconds=s)
    rows = [[("a", "one", at(5), 1), ("b", "b1", at(1), 2)], [("a", "old", at(4), 3), ("b", "b2", at(1), 4)], [("c", "c", at(1), 5)]]
    run_twice(spark, tmp_path, schema, rows, lambda s: jobs.latest_draft_stream(s, str(tmp_path / "ck"), str(tmp_path / "drafts")))
    files = {p.name: p.read_text() for p in (tmp_path / "drafts").iterdir() if not p.name.startswith(".")}
    assert files == {f"{hashlib.sha256(t.encode()).hexdigest()}.html": h for t, h in (("a", "one"), ("b", "b2"), ("c", "c"))}


def test_state_does_not_grow_with_batches(spark, tmp_path):
    schema = "edit_id long, doc_key string, ts timestamp, node_id string, text string, origin string"
    rows = [[(i, "d", START + timedelta(seconds=i), "r_1", "x", "user")] for i in range(5)]
    fields = spark.createDataFrame([("d", 1, "text", None, ["r_1"]), ("d", 2, "checkbox", None, ["sdt_1"])], "doc_key string, field_ord int, type string, value string, node_ids array<string>")
    seen = []

    def start(stream):
        seen.append(jobs.live_fill_progress(stream, fields, str(tmp_path / "ck"), str(tmp_path / "out")))
        return seen[-1]

    run_twice(spark, tmp_path, schema, rows, start)
    totals = [q.recentProgress[0].stateOperators[0].numRowsTotal for q in seen]
    assert len(set(totals[1:])) == 1 and totals[-1] < 20
    assert [r["filled"] for r in spark.read.parquet(str(tmp_path / "out")).orderBy("batch").collect()] == [1] * 5


def test_fields_that_come_later(spark, tmp_path):
    edit, field = "edit_id long, doc_key string, ts timestamp, node_id string, text string, origin string", "doc_key string, field_ord int, type string, value string, node_ids array<string>"
    made = {"fields": [spark.createDataFrame([("d", 1, "text", None, ["r_1"])], field), spark.createDataFrame([("e", 1, "checkbox", None, ["sdt_1"]), ("e", 2, "text", "v", ["r_2"])], field)], "edits": [spark.createDataFrame([(1, "d", START, "r_1", "x", "user")], edit), spark.createDataFrame([(2, "e", START, "sdt_1", "☐", "user"), (3, "e", START, "r_2", " ", "user")], edit)]}
    for part in (0, 1):
        for name, frames in made.items():
            frames[part].coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        streams = [spark.readStream.schema(s).parquet(str(tmp_path / n)) for n, s in (("edits", edit), ("fields", field))]
        jobs.live_fill_progress(*streams, str(tmp_path / "ck"), str(tmp_path / "out")).awaitTermination()
    assert sorted((r["doc_key"], r["filled"], r["total"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("d", 1, 1), ("e", 1, 2)]


def test_outputs_at_their_own_keys(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for name in "ab":
        (folder / f"{name}.docx").write_bytes(name.encode())
    handle = lambda rows: rows.select(F.concat(F.lit("converted/"), F.regexp_extract("path", "([^/]+)[.]docx$", 1), F.lit(".html")).alias("key"), "content")
    for checkpoint in ("one", "two"):  # a lost checkpoint doubles nothing
        jobs.stream_uploads(spark, str(folder), str(tmp_path / checkpoint), handle, str(tmp_path / "out")).awaitTermination()
    assert {str(p.relative_to(tmp_path / "out")): p.read_bytes() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.startswith(".")} == {"converted/a.html": b"a", "converted/b.html": b"b"}


def test_keyed_files(spark, tmp_path):
    root = str(tmp_path / "out")
    rows = spark.createDataFrame([("a/x", "one", 1), ("a/x", "two", 2), ("../up", "safe", 1), (None, "lost", 1), ("null", None, 1)], "key string, content string, at int")
    keyed.write_keyed(rows.repartition(3), root, F.col("at"))
    read = lambda: {str(p.relative_to(root)): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file() and not p.name.endswith(".crc")}
    assert read() == {"a/x": "two", "up": "safe"}
    bad = rows.select("key", F.when(F.col("key") == "a/x", F.raise_error(F.lit("stop"))).otherwise("new").alias("content"))
    with pytest.raises(Exception, match="stop"):
        keyed.write_keyed(bad, root)
    assert read() == {"a/x": "two", "up": "safe"}  # nothing of a job that failed
    documents = spark.createDataFrame([("uploads/k/f.docx", "<p>")], "doc_key string, html string")
    keyed.write_documents_html(documents, root)
    fields = spark.createDataFrame([("uploads/k/f.docx", 1, "i", "l", "text", "v", 0.5, 0, 0, "r", "w")], "doc_key string, field_ord int, id string, label string, type string, value string, confidence double, block int, para int, raw_label string, raw_value string")
    keyed.write_documents_fields(fields, f"file://{root}")
    assert read()["converted/k/f.html"] == "<p>" and json.loads(read()["extracted/k/f.json"])["fields"][0]["label"] == "l"
