"""The pipeline on a corpus with planted cases."""

import random

import corpus_pipeline
from folioforge.llm.common import stored


def test_planted_cases_go_and_clean_documents_stay(spark, tmp_path):
    draw = random.Random(8)
    vocabulary = ["".join(draw.choice("abcdefghijklm") for _ in range(draw.randint(2, 8))) for _ in range(4000)]
    prose = lambda n: " ".join(draw.choice(vocabulary) for _ in range(n))
    passage, item = prose(90), prose(40)
    rows = [(i, prose(150)) for i in range(200)]
    labels = [(i, 1, 0) for i in range(200)]
    for i in range(200, 300):
        rows.append((i, f"{prose(60)} idiot {prose(10)} moron {prose(20)} scum"))
        labels.append((i, 1, 1))
    near = rows[7][1].split()
    near[20] = "changed"
    rows += [(300, rows[5][1]), (301, " ".join(near)), (302, f"{prose(80)} {passage} {prose(80)}"), (303, f"{prose(70)} {passage} {prose(90)}"), (304, f"{prose(100)} {item} {prose(60)}"), (305, None), (306, ""), (5, rows[5][1]), (None, prose(30))]
    lone, other = prose(60), prose(70)
    rows += [(None, lone), (None, lone), (None, rows[9][1]), (None, f"{prose(50)} {item} {prose(9)}"), (11, other), (None, other)]  # no id, or that of another text
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    seen, current = {}, spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES:
        current = stored(stage(spark, current, str(tmp_path)), name)
        seen[name] = current
        if name != "packing":
            assert current.columns == docs.columns
    ids = lambda name: sorted(r[0] for r in seen[name].select("doc_id").collect() if r[0] is not None)
    clean = list(range(200))
    bare = lambda name: sorted(r[0] for r in seen[name].filter("doc_id is null").select("text").collect())
    assert ids("toxicity") == sorted([*clean, *range(300, 307), 5, 11])
    left = sorted((r[0] or -1, r[1] or "") for r in seen["near_dedup"].select("doc_id", "text").collect())
    both = [t for i, t in left if t == other]
    assert len(both) == 1 and len(left) == 200 + 5 + 4 and len(bare("near_dedup")) + len([x for x in left if x[0] == 11]) == 5
    assert bare("near_dedup").count(lone) == 1 and rows[9][1] not in bare("near_dedup")
    assert set(ids("near_dedup")) == {*clean, 302, 303, 304, 305, 306}
    texts = {r["doc_id"]: r["text"] for r in seen["suffix_dedup"].collect()}
    assert passage[5:-5] not in texts[302] and passage[5:-5] not in texts[303] and texts[305] is None and texts[3] == rows[3][1]
    assert set(ids("decontamination")) == {*clean, 302, 303, 305, 306} and not any(item in (r[0] or "") for r in seen["decontamination"].select("text").collect())
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r[0] for r in packed.select("doc_id").distinct().collect() if r[0] is not None) == sorted(set(ids("decontamination")))
    assert packed.filter("doc_id is null").count() == len(bare("decontamination")) >= 2
    assert packed.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_empty_tables(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
