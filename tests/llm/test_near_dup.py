import random

import pandas as pd

from folioforge.llm import near_dup
from folioforge.llm.components import components
from folioforge.llm.near_dup import near_duplicates
from folioforge.llm.shingles import MinHash, shingle_set


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 0, "clash", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, bucket int").repartition(3)


def brute(rows):
    sets = []
    for _, text in rows:
        words = [w.lower() if w.isascii() else w for w in (text or "").replace("\n", " ").split(" ") if w]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = top(i), top(j)
                root[max(a, b)] = min(a, b)
    return [(rows[i][0], len(sets[i]), rows[top(i)][0], top(i) == i) for i in range(len(rows))]


def corpus(seed, copies=120):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: [draw.choice(words) for _ in range(n)]
    texts = [None, "", " \n ", "one two", "ONE  two", "one two three four five", "one two three four five"]
    hot, passage = prose(220), prose(60)
    for _ in range(copies):  # one crowded group of near copies
        own = list(hot)
        for _ in range(draw.randint(0, 4)):
            own[draw.randrange(len(own))] = draw.choice(words)
        texts.append(" ".join(own))
    for _ in range(60):
        own = prose(draw.randint(20, 400))
        texts.append(" ".join(own))
        for _ in range(draw.randint(0, 3)):
            near = list(own)
            for _ in range(draw.randint(0, 1 + len(own) // 60)):
                near[draw.randrange(len(near))] = draw.choice(words)
            texts.append(" ".join(near).upper())
    texts += [" ".join(prose(100) + passage + prose(80)) for _ in range(40)]
    return [(i, t) for i, t in enumerate(texts)]


def test_components_are_those_of_brute_force(spark):
    rows = corpus(1)
    got = sorted(tuple(r) for r in near_duplicates(frame(spark, rows)).collect())
    assert got == brute(rows)


def test_null_and_equal_ids_and_the_empty_table(spark):
    long, other = " ".join(f"w{i}" for i in range(60)), " ".join(f"v{i}" for i in range(60))
    docs = frame(spark, [(None, long), (None, None), (9, long), (9, other), (4, other), (7, other + " x"), (3, long), (3, long), (2, "alone")])
    got = near_duplicates(docs).toPandas()
    assert len(got) == 9 and got[got["doc_id"].isna()]["component_id"].isna().all()
    assert set(got.dropna()["component_id"]) == {2, 3} and got[got["doc_id"].isna()]["kept"].all()
    assert near_duplicates(docs.limit(0)).count() == 0


def test_the_number_of_trees_finds_pairs_at_the_threshold():
    assert (1 - 0.75**near_dup.DEPTH) ** near_dup.TREES < 1e-5
    a = shingle_set(b" ".join(b"w%d" % i for i in range(500)))
    b = shingle_set(b" ".join(b"w%d" % i for i in range(100, 600)))
    sketch = MinHash(2000)
    assert abs((sketch(a) == sketch(b)).mean() - 396 / 596) < 0.05


def test_components_of_chains_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, x) for x in range(101, 180)] + [(200 + i, 200 + (i + 1) % 9) for i in range(9)] + [(5, 5), (None, 3)]
    got = dict(components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 1 for i in range(1, 61)} | {i: 100 for i in range(100, 180)} | {200 + i: 200 for i in range(9)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert isinstance(pd.Series(got), pd.Series)


def test_crowded_regions_are_compared_in_full(spark, monkeypatch):
    draw = random.Random(3)
    prose = lambda n: [f"w{draw.randrange(10**6)}" for _ in range(n)]

    def changed(own, n):
        out = list(own)
        for i in draw.sample(range(len(own) // 10), n):
            out[10 * i + 5] = f"e{draw.randrange(10**9)}"
        return " ".join(out)

    # Copies that are like their original, which has not the least id, and unlike each other.
    original = prose(400)
    rows = [(i, changed(original, 8)) for i in range(150)] + [(150, " ".join(original))] + [(151 + i, changed(original, 8)) for i in range(150)]
    # Pairs of copies in a crowd of texts that share most, but too little, with all others.
    hot = prose(400)
    for i in range(150):
        own = changed(hot, 12)
        rows += [(400 + i, own), (1000 - i, own + " end")]
    want = brute(rows)
    assert sum(r[2] == 0 for r in want) == 301 and len({r[2] for r in want}) == 151
    monkeypatch.setattr(near_dup, "BLOCK", 64)
    assert sorted(tuple(r) for r in near_duplicates(frame(spark, rows)).collect()) == sorted(want)


def boilerplate(pairs, crowd, seed=11):
    """One template of 204 words: ``pairs`` texts with a partner over 0.75, and ``crowd`` more that are just under it with all."""
    draw = random.Random(seed)
    template = [f"t{i}" for i in range(204)]

    def own(changes):
        out = list(template)
        for i in draw.sample(range(20), changes):
            out[10 * i + 4] = f"u{draw.randrange(10**9)}"
        return out

    rows = []
    for i in range(pairs):
        first = own(7)
        second = list(first)
        for j in draw.sample(range(204), 3):
            second[j] = f"v{draw.randrange(10**9)}"
        rows += [(2 * i, " ".join(first)), (10**6 - i, " ".join(second))]
    return rows + [(10**5 + i, " ".join(own(8))) for i in range(crowd)]


def test_links_on_boilerplate_are_those_of_brute_force(spark, monkeypatch):
    rows = boilerplate(150, 150)
    want = sorted(brute(rows))
    assert sum(r[3] for r in want) > 100
    for pairs in (near_dup.PAIRS, 1):  # with 1 most shingles go by blocks
        monkeypatch.setattr(near_dup, "PAIRS", pairs)
        assert sorted(tuple(r) for r in near_duplicates(frame(spark, rows)).collect()) == want


def test_partitions_do_not_change_results(spark):
    rows = boilerplate(60, 60) + [(5 * 10**5, "long " * 40000 + "text"), (5 * 10**5 + 1, "long " * 40000 + "text text")]
    want, before = sorted(brute(rows)), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("2", "53"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert sorted(tuple(r) for r in near_duplicates(frame(spark, rows)).collect()) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
