"""Quality, toxicity, licenses, URLs and decontamination against brute force and planted cases."""

import random
import re
import zlib

import pytest

from folioforge.llm import toxicity as tox
from folioforge.llm.decontamination import contaminations, decontaminate
from folioforge.llm.licenses import CONTAINED, TEMPLATES, TemplateIndex, scan_licenses, words
from folioforge.llm.quality import judge_quality
from folioforge.llm.url_filter import judge_urls

DOC = "doc_id long, text string, lang string, source string, n_chars long, w string, hash long, label string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 1, "x") for i, t in rows], DOC).repartition(3)


def prose(draw, n, vocabulary=None):
    vocabulary = vocabulary or [f"w{i}" for i in range(2000)]
    return " ".join(draw.choice(vocabulary) for _ in range(n))


# Quality ----------------------------------------------------------------------------------------------------------------
def base_counts(text):
    text = text or ""
    found = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(found[i : i + 3]) for i in range(len(found) - 2)]
    twice = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dup = len(lines) - len(set(lines))
    failed = len(found) < 50 or 100 * len(covered) > 50 * len(found)
    return len(found), sum(map(len, found)), sum(c in "#*$%&|<>" for c in text), dup, len(covered), failed


def quality_rows():
    draw = random.Random(1)
    good = [(i, prose(draw, 120)) for i in range(60)]
    junk = [(100 + i, " ".join(f"w{draw.randint(0, 2000)}%%%" for _ in range(120))) for i in range(30)]
    odd = [None, "", " \n\x0b ", "one", "a b c a b c a b c", "x\ny\nx\n\n \nx", "same line here\n" * 30, "\x0c".join("abcde" * 12), "#*$%&|<> é " * 30, "p q r " * 20 + prose(draw, 61)]
    return good + junk + [(200 + i, t) for i, t in enumerate(odd)] + [(1, good[1][1])]


def test_quality_base_counts_and_verdicts(spark):
    rows = quality_rows()
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(5, 1, 0), (9999, 1, 0), (None, 1, 0)] + [(100 + i, 0, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    got = judge_quality(frame(spark, rows), labels).collect()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((r["doc_id"], *(r[n] for n in names)) for r in got) == sorted((i, *base_counts(t)) for i, t in rows)
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert kept >= set(range(60)) and not kept & set(range(100, 130)) and not any(r["kept"] and r["base_failed"] for r in got)


def test_quality_without_labels_and_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = judge_quality(frame(spark, quality_rows()), none).collect()
    assert all(r["kept"] != r["base_failed"] for r in got)
    assert judge_quality(frame(spark, quality_rows()).limit(0), none).count() == 0


# Toxicity ---------------------------------------------------------------------------------------------------------------
def toxic_rows(spark):
    draw = random.Random(3)
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 0
        text = prose(draw, 80).split()
        if bad:
            bank = ["idiot", "moron", "trash", "scum"] if i % 2 else ["grobux" + draw.choice("abc"), "grobuxen", "zarnly" + draw.choice("de")]
            for w in draw.sample(bank, 2):
                text[draw.randrange(80)] = w
        rows.append((i, " ".join(text)))
        labels.append((i, 1, int(bad)))
    return rows, spark.createDataFrame([*labels, (3, 1, 0), (77777, 1, 1), (None, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark):
    rows, labels = toxic_rows(spark)
    docs = frame(spark, [*rows, (1000, None), (1001, ""), (None, "stupid idiot moron"), (0, rows[0][1])])
    got = tox.toxicity(docs, labels).collect()
    assert len(got) == len(rows) + 4 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    judged = [(r["doc_id"] % 5 == 0, r["predicted"] == 1) for r in got if r["held_out"] and r["doc_id"] < 600]
    assert sum(a and b for a, b in judged) >= 0.9 * sum(a for a, _ in judged)
    assert sum(b and not a for a, b in judged) <= 0.02 * len(judged)
    left = tox.without_toxic(docs, labels)
    assert left.columns == docs.columns and left.filter("doc_id = 1000").count() == 1


def test_toxicity_labels_of_held_out_rows_are_not_read(spark):
    rows, labels = toxic_rows(spark)
    docs = frame(spark, rows)
    flipped = labels.withColumn("toxic", tox.F.when(tox.held_out(), 1 - tox.F.col("toxic")).otherwise(tox.F.col("toxic")))
    a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in tox.toxicity(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_toxicity_without_labels_and_rows(spark):
    rows, labels = toxic_rows(spark)
    got = tox.toxicity(frame(spark, [(1, "you idiot and moron"), (2, "fine day")]), labels.limit(0)).collect()
    assert len(got) == 2
    assert tox.toxicity(frame(spark, rows).limit(0), labels).count() == 0


# Licenses ---------------------------------------------------------------------------------------------------------------
def blocks_by_brute_force(found):
    out = {}
    for t, (_, text) in enumerate(TEMPLATES):
        own = words(text.encode())
        best = max(((len(set(own) & set(found[i : i + len(own)])), -i) for i in range(len(found))), default=(0, 0))
        if best[0] >= CONTAINED * len(set(own)) - 1e-9:
            out[t] = (best[0] / len(set(own)), best[0])
    return out


def test_template_index_is_exact():
    draw = random.Random(5)
    frequency = {w: draw.randint(0, 50) for _, t in TEMPLATES for w in words(t.encode())}
    index = TemplateIndex(TEMPLATES, frequency, CONTAINED)
    vocabulary = [*frequency, *(b"x%d" % i for i in range(40))]
    seen = set()
    for _ in range(600):
        own = words(draw.choice(TEMPLATES)[1].encode())
        block = [w for w in own if draw.random() < 0.93]
        for _ in range(draw.randint(0, 4)):
            block.insert(draw.randrange(len(block) + 1), draw.choice(vocabulary))
        found = [draw.choice(vocabulary) for _ in range(draw.randint(0, 60))] + block + [draw.choice(vocabulary) for _ in range(draw.randint(0, 60))]
        want = blocks_by_brute_force(found)
        got = {t: c for t, _, c in index.matches(found)}
        assert got == {t: c for t, (c, _) in want.items()}
        seen |= got.keys()
        for t, i, c in index.matches(found):
            own = set(words(TEMPLATES[t][1].encode()))
            assert len(own & set(found[i : i + index.lengths[t]])) == round(c * len(own))
    assert seen == set(range(len(TEMPLATES)))


def test_license_blocks_of_wrapped_notices_and_long_lines(spark):
    mit = next(t for _, t in TEMPLATES if t.startswith("permission is hereby granted") and len(t) > 500)
    wrapped = "\n * ".join(" ".join(mit.split()[i : i + 9]) for i in range(0, len(mit.split()), 9))
    far = " and then ".join("licensed under cc by nc 4 0".split()) + " filler" * 30
    scattered = " ".join(f"{w} " + "filler " * 40 for w in "licensed under the gnu general public license version 3 this work is".split())
    long = "lorem ipsum " * 30000 + "This work is licensed under the\nGNU General Public License, version 3"
    rows = [(1, wrapped), (2, scattered), (3, long), (3, long), (4, far), (None, wrapped)]
    got = [(r["doc_id"], sorted({m["label"] for m in r["matches"]}), max((m["word"] for m in r["matches"]), default=None)) for r in scan_licenses(frame(spark, rows)).collect()]
    assert sorted(got, key=str) == sorted([(1, ["mit"], 0), (2, [], None), (3, ["gpl-3"], 60000), (3, ["gpl-3"], 60000), (4, [], None), (None, ["mit"], 0)], key=str)


def test_license_phrases_and_blocks(spark):
    texts = [None, "", "Released UNDER the MIT-License; cc by nc cc by nc", "x\nThis work is licensed under the GNU General Public License, version 3.\ny", "under the mit licenses", "Licensed under the Apache License, Version 2.0."]
    got = {r["doc_id"]: r for r in scan_licenses(frame(spark, list(enumerate(texts)))).collect()}
    assert (got[0]["n_words"], got[0]["n_base"], got[0]["first_word"]) == (0, 0, None)
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (3, 1, 8, ["cc-by-nc", "mit"])
    assert [(m["word"], m["label"]) for m in got[3]["matches"]] == [(1, "gpl-3")] and got[4]["n_base"] == 0
    assert got[5]["base_labels"] == ["apache-2"] and got[5]["first_word"] == 3
    assert scan_licenses(frame(spark, [(1, "x")]).limit(0)).count() == 0


# URLs -------------------------------------------------------------------------------------------------------------------
def test_url_rules_and_trees(spark):
    urls = [None, "", "no scheme", "http://A.Example.NET/en/1?q=/x", "https://b.net", "https://b.net/", "http://example.com/de/?a", "http://notexample.com/de/", "ftp://x.ORG/fr/#y", "http://example.net/en/../", "http://h?x://y/net/", "http://" + "a" * 5000 + ".com/" + "b/" * 3000]
    draw = random.Random(4)
    more = [f"http://h{i}.{draw.choice(['net', 'org'])}/{draw.choice(['fr', 'en'])}/{i}?id={i}" for i in range(200)]
    pages = spark.createDataFrame([(i, u, "<p>", "clash") for i, u in enumerate([*urls, *more, urls[3]])], "page_id long, url string, html string, label string")
    got = {r["page_id"]: r for r in judge_urls(pages).collect()}
    shown = [(r["host"], r["path"], r["rule"]) for r in (got[i] for i in range(11))]
    assert shown == [
        ("", "", None), ("", "", None), ("", "", None), ("a.example.net", "/en/1", "example.net/en/"), ("b.net", "", None), ("b.net", "/", "net/"),
        ("example.com", "/de/", "example.com/de/"), ("notexample.com", "/de/", None), ("x.org", "/fr/", "org/fr/"), ("example.net", "/en/../", "example.net/en/"), ("h", "", None),
    ]
    assert len(got) == len(urls) + 201 and got[5]["verdict"] == "block" and got[8]["verdict"] == "allow" and {r["verdict"] for r in got.values()} == {"allow", "block"}
    assert judge_urls(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in judge_urls(pages.filter("page_id < 3")).collect()} == {"allow"}


def test_trees_on_held_out_urls(spark):
    """Labels from how the URLs look, one in 25 of them wrong; no feature is a copy of the label."""
    draw = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(draw.choice(letters) for _ in range(n))
    rows = []
    for i in range(1500):
        spam = draw.random() < 0.4
        if spam:  # many digits or hyphens, some parameters
            host = "-".join([word(4), word(3), str(draw.randint(100, 9_999_999))]) if draw.random() < 0.7 else word(9) + str(draw.randint(10_000, 99_999_999))
            path = "/".join(word(draw.randint(2, 5)) for _ in range(draw.randint(0, 3))) + "?" + "&".join(f"{word(2)}={draw.randint(0, 99_999)}" for _ in range(draw.randint(0, 4)))
        else:
            host, path = word(draw.randint(5, 14)), "/".join(word(draw.randint(3, 9)) for _ in range(draw.randint(0, 4))) + ("?id=1" if draw.random() < 0.2 else "")
        rows.append((i, f"http{'s' if draw.random() < 0.5 else ''}://{host}.{draw.choice(['com', 'org', 'info'])}/{path}", spam))
    pages = spark.createDataFrame([(i, u) for i, u, _ in rows], "page_id long, url string")
    known = spark.createDataFrame([(i, u, int(spam != (draw.random() < 0.04))) for i, u, spam in rows if zlib.crc32(u.encode()) % 3], "page_id long, url string, label int")
    got = {r["page_id"]: r["verdict"] for r in judge_urls(pages, rules=[], labelled=known).collect()}
    held = [(got[i] == "block") == spam for i, u, spam in rows if not zlib.crc32(u.encode()) % 3]
    assert len(held) > 400 and sum(held) >= 0.93 * len(held)


# Decontamination --------------------------------------------------------------------------------------------------------
def sets(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return found, {tuple(found[i : i + min(5, len(found))]) for i in range(len(found) - min(5, len(found)) + 1)} if found else set()


@pytest.mark.parametrize("seed", [1, 2])
def test_contaminations_are_those_of_brute_force(spark, seed):
    draw = random.Random(seed)
    items = [(i, prose(draw, draw.choice([1, 3, 5, 6, 9, 16, 17, 40, 70]), [f"w{k}" for k in range(60)])) for i in range(25)] + [(50, None), (51, " ,. "), (None, "w1 w2 w3 w4 w5 w6"), (3, None)]
    docs = [(0, None), (1, ""), (2, "w1"), (None, items[0][1])]
    for i in range(3, 120):
        own = draw.choice(items[:25])[1].split()
        for _ in range(draw.randint(0, 3)):
            own[draw.randrange(len(own))] = "OTHER"
        docs.append((i, f"{prose(draw, draw.randint(0, 300))} {draw.choice([' ', ', ']).join(own).upper()}! {prose(draw, draw.randint(0, 50))}"))
    docs.append((5, docs[8][1]))
    want, bad = set(), set()
    for item, text in items:
        found, own = sets(text)
        for doc, body in docs:
            if item is None or not own:
                continue
            theirs, width = sets(body)[0], min(5, len(found))
            have = {tuple(theirs[i : i + width]) for i in range(len(theirs) - width + 1)}
            if 100 * len(own & have) >= 75 * len(own):
                bad.add((doc, body))
                if doc is not None:
                    want.add((doc, item, len(own), len(own & have)))
    bench = spark.createDataFrame([(i, t, "clash", 1) for i, t in items], "item_id long, text string, doc_id string, width int").repartition(2)
    frame_ = frame(spark, docs)
    got = sorted(tuple(r)[:4] for r in contaminations(frame_, bench).collect())
    assert got == sorted(want) and want
    left = decontaminate(frame_, bench)
    assert left.columns == frame_.columns and sorted(map(str, (tuple(r) for r in left.select("doc_id", "text").collect()))) == sorted(str(d) for d in docs if d not in bad)
    assert contaminations(frame_.limit(0), bench).count() == 0 and contaminations(frame_, bench.limit(0)).count() == 0


def test_toxicity_of_repeated_ids_is_the_same_in_each_run(spark):
    rows, labels = toxic_rows(spark)
    twice = rows + [(i, f"other words for this row {i}") for i, _ in rows[:80]]
    one, two = (sorted((r["doc_id"], r["score"]) for r in tox.toxicity(frame(spark, order).repartition(n), labels).collect()) for order, n in ((twice, 2), (twice[::-1], 5)))
    assert [r[1] for r in one] == pytest.approx([r[1] for r in two])
