"""Near-duplicate documents by an LSH forest over MinHash signatures.

A document's set holds its distinct 5-word shingles.  Equal sets are one class, found by a hash of the set; only the
class's least doc_id goes on.  The forest has TREES orders of the signature.  A tree files a class under its first
DEPTH values and sorts it by FURTHER more of them:

*   Where few share the first values (a region of up to BUCKET classes), all pairs are candidates.
*   Where many do, the tree goes deeper: each class is a candidate with the NEAR ones before it in the sorted order,
    which have the longest common prefixes, and with the region's least class.  This finds the large components early.
    What a crowded region still has of different components after that is found exactly by ``crowded_pairs`` and
    ``block_links``, so that neither crowding nor the number of partitions changes a result.

At a similarity of 0.75 a pair shares no region in any tree with a probability of 2 in a million; that is the only loss.
Candidates are confirmed on full sets and components come from the confirmed links.

``crowded_pairs`` is a set-similarity join of the classes of crowded regions with different components.  Shingles are
ordered by how often they occur (counted in SKETCH counters), rarest first.  Of two sets with 0.75, the smaller has one
of its first shingles (a seventh of all, and one) among the first quarter (and one) of the larger, and behind a first
shared shingle enough must be left on both sides.  So what many documents have in common names no pair unless there is
little else in them.  A shingle with more pairs than PAIRS for each of its rows goes to ``block_links``, which compares
blocks of classes, each two blocks a group of their own, without a row for each pair.

Null doc_id: linked with nothing, component null, kept.  Null or wordless text: empty set, linked with nothing.
Rows with equal doc_id are one node.  Ties: of equal texts the least doc_id stays.  Very long texts: their whole set, in
one row.  Empty table: no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, map_batches, stored, table
from .components import components
from .shingles import MinHash, mix, shingle_set

TREES = 24
DEPTH = 3
FURTHER = 4
BUCKET = 16
NEAR = 4
PERCENT = 75
#: Counters of shingles, by the upper bits of their hash.
SKETCH_BITS = 20
#: Pairs that a shingle may name for each of its rows.
PAIRS = 64
#: Classes and shingles of a block, and shingles that a block's table holds at a time.
BLOCK = 256
BLOCK_SHINGLES = 500_000
COLUMNS = 4096

_POOLED = -(1 << 63)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (a 128-bit hash; null for an empty set) and signature of every document."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary())])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = MinHash(TREES * DEPTH)
        for batch in batches:
            rows: list[list] = [[], [], []]
            for text in batch.column(1).cast(pa.binary()):
                found = shingle_set(text.as_py() or b"")
                some = len(found) > 0
                rows[0].append(len(found))
                rows[1].append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if some else None)
                rows[2].append(sketch(found).tobytes() if some else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t.type) for x, t in zip(rows, list(schema)[1:], strict=True))], schema=schema)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), sign, "doc_id long, n_shingles long, set_key binary, signature binary")


def forest(signed: DataFrame) -> DataFrame:
    """bucket (tree and first values), further (16 bits of each next value), node and n_shingles for each tree and class."""

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(batch.num_rows, -1).astype(np.uint64)
            nodes, sizes = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            for tree in range(TREES):
                order = [(tree * DEPTH + i) % (TREES * DEPTH) for i in range(DEPTH + FURTHER)]
                bucket = np.full(batch.num_rows, tree, np.uint64)
                for i in order[:DEPTH]:
                    bucket = mix(bucket * np.uint64(0x9E3779B97F4A7C15) + values[:, i])
                further = np.zeros(batch.num_rows, np.uint64)
                for i in order[DEPTH:]:
                    further = further << np.uint64(16) | values[:, i] >> np.uint64(16)
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), pa.array(further.view(np.int64)), pa.array(nodes), pa.array(sizes)], names=["bucket", "further", "node", "n_shingles"])

    return map_batches(signed.select("doc_id", "n_shingles", "signature"), file, "bucket long, further long, node long, n_shingles long")


def buckets(filed: DataFrame) -> DataFrame:
    """The rows of buckets that have several, and how many (many)."""
    shared = filed.groupBy("bucket").agg(F.count("*").alias("many")).filter("many > 1")
    return stored(filed.join(shared, "bucket"), "buckets")


def candidates(rows: DataFrame) -> DataFrame:
    """Pairs a < b, trees that named them, and whether one heads a crowded region; sizes that rule 0.75 out are left out."""
    item = F.struct("node", "n_shingles")

    few = rows.filter(F.col("many") <= BUCKET).groupBy("bucket").agg(F.sort_array(F.collect_list(item)).alias("items"))
    few = few.select("items", F.posexplode("items").alias("i", "x")).select("x", F.explode(F.expr(f"slice(items, i + 2, {BUCKET})")).alias("y"), F.lit(False).alias("head"))

    crowded = rows.filter(F.col("many") > BUCKET)
    heads = crowded.groupBy("bucket").agg(F.min(item).alias("x"))
    star = crowded.join(heads, "bucket").select("x", item.alias("y"), F.lit(True).alias("head"))

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list[tuple] = []
        for batch in batches:
            pairs = []
            for bucket, node, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                pairs += [(*x[1:], node, size) for x in last if x[0] == bucket]
                last = [*last[-NEAR + 1 :], (bucket, node, size)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*pairs, strict=True) if pairs else [[]] * 4)], names=["a", "na", "b", "nb"])

    ordered = crowded.select("bucket", "further", "node", "n_shingles").repartitionByRange("bucket", "further", "node").sortWithinPartitions("bucket", "further", "node")
    chain = map_batches(ordered, near, "a long, na long, b long, nb long").select(F.struct(F.col("a").alias("node"), F.col("na").alias("n_shingles")).alias("x"), F.struct(F.col("b").alias("node"), F.col("nb").alias("n_shingles")).alias("y"), F.lit(False).alias("head"))

    every = few.unionByName(star).unionByName(chain)
    fit = (F.col("x.node") != F.col("y.node")) & (100 * F.least("x.n_shingles", "y.n_shingles") >= PERCENT * F.greatest("x.n_shingles", "y.n_shingles"))
    pairs = every.filter(fit).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b"), "head")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("trees"), F.max("head").alias("head"))


def full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node and held, the whole set in bytes, of the documents of ``nodes``; a row for each set that an id has."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t).tobytes() for t in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["node", "held"])

    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("node"), "text").join(nodes, "node", "left_semi")
    return map_batches(texts, sets, "node long, held binary").filter(F.octet_length("held") > 0).distinct()


def confirmed(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = []
            for a, b, s, t in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s, t = np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64)
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= PERCENT * (len(s) + len(t) - common):
                    links.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    one, two = (held.select(F.col("node").alias(a), F.col("held").alias(s)) for a, s in (("a", "s"), ("b", "t")))
    return map_batches(pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "s", "t"), check, "a long, b long")


def linked(members: list[tuple[int, int, bytes]]) -> list[tuple[int, int]]:
    """A link for each two components of members (node, component, shingle set) that have one."""
    components = np.array([m[1] for m in members], np.int64)
    if not len(components) or (components == components[0]).all():
        return []
    sets = [np.frombuffer(m[2], np.uint64) for m in members]
    sizes = np.array([len(x) for x in sets])
    _, column, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = often[column] > 1
    row = np.repeat(np.arange(len(sets)), sizes)[kept]
    column = np.cumsum(often > 1)[column[kept]] - 1
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.int64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        i, j = np.searchsorted(column, [at, at + COLUMNS])
        held = np.zeros((len(sets), COLUMNS), np.float32)
        held[row[i:j], column[i:j] - at] = 1
        common += (held @ held.T).astype(np.int64)
    alike = 100 * common >= PERCENT * (sizes[:, None] + sizes[None, :] - common)
    x, y = np.nonzero(alike & (components[:, None] < components[None, :]))
    _, first = np.unique(np.stack([components[x], components[y]]), axis=1, return_index=True)
    return [(members[x[i]][0], members[y[i]][0]) for i in first]


def open_classes(rows: DataFrame, found: DataFrame) -> DataFrame:
    """node and component of the classes in crowded regions that have several components."""
    own = rows.filter(F.col("many") > BUCKET).select("bucket", "node").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = stored(own, "regions")
    several = own.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo <> _hi").select("bucket")
    return own.join(broadcast_if_small(stored(several, "several")), "bucket", "left_semi").select("node", "component").distinct()


def shingle_counts(members: DataFrame) -> np.ndarray:
    """How often shingles occur in ``members(held)``, in a fixed number of counters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            for held in batch.column(0).to_pylist():
                np.add.at(total, (np.frombuffer(held, np.uint64) >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["counter", "n"])

    sums = map_batches(members.select("held"), count, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()  # a row for each counter at most
    out = np.zeros(1 << SKETCH_BITS, np.uint32)
    out[np.asarray(sums["counter"])] = np.minimum(np.asarray(sums["n"]), (1 << 32) - 1)
    return out


def leading_shingles(members: DataFrame, counts: np.ndarray) -> DataFrame:
    """shingle, place, short, node, component and n_shingles of the first quarter (and one) of each set; short: of the first seventh (and one)."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            for node, component, held in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                values = np.frombuffer(held, np.uint64)
                n = len(values)
                often = counts[(values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                first = values[np.argsort(often, kind="stable")][: n - -(-PERCENT * n // 100) + 1]
                short = n - -(-2 * PERCENT * n // (100 + PERCENT)) + 1
                place = np.arange(len(first))
                for column, x in zip(columns, (first.view(np.int64), place, place < short, np.full(len(first), node), np.full(len(first), component), np.full(len(first), n)), strict=True):
                    column.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=["shingle", "place", "short", "node", "component", "n_shingles"])

    return map_batches(members.select("node", "component", "held"), lead, "shingle long, place long, short boolean, node long, component long, n_shingles long")


def crowded_pairs(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs a < b of ``members(node, component, held)`` of different components that a leading shingle names; rows of the shingles that name too many."""
    leading = leading_shingles(members, shingle_counts(members))
    parts = leading.groupBy("shingle", "component").agg(F.count("*").alias("n"), F.count_if("short").alias("shorts"))
    sums = parts.groupBy("shingle").agg(F.count("*").alias("components"), F.sum("n").alias("n"), F.sum("shorts").alias("shorts"), F.sum(F.col("n") * F.col("n")).alias("squares"), F.max_by("component", "n").alias("largest"))
    meeting = sums.filter("components > 1 and shorts > 0").select("shingle", "largest", ((F.col("n") * F.col("n") - F.col("squares")) > 2 * PAIRS * F.col("n")).alias("heavy"))
    met = stored(leading.join(broadcast_if_small(stored(meeting, "meeting")), "shingle"), "leading")

    light = met.filter("not heavy")
    x, y = light.filter("component <> largest").alias("x"), light.alias("y")
    c = lambda name: (F.col(f"x.{name}"), F.col(f"y.{name}"))
    (size, other), (node, mate), (place, there), (short, brief) = map(c, ("n_shingles", "node", "place", "short"))
    smaller = (size < other) | ((size == other) & (node < mate))
    fit = 100 * F.least(size, other) >= PERCENT * F.greatest(size, other)
    left = (100 + PERCENT) * (1 + F.least(size - place - 1, other - there - 1)) >= PERCENT * (size + other)
    pairs = x.join(y, (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.component") != F.col("y.component")) & fit & left & F.when(smaller, short).otherwise(brief))
    return pairs.select(F.least(node, mate).alias("a"), F.greatest(node, mate).alias("b")).distinct(), met.filter("heavy").select(F.col("shingle").alias("bucket"), "node", "n_shingles")


def block_links(rows: DataFrame, found: DataFrame, held: DataFrame) -> DataFrame:
    """Links between the components ``found`` that meet in a group ``rows(bucket, node, n_shingles)``, from all pairs there.

    Blocks have about BLOCK classes of like size (sizes that rule 0.75 out need no comparison), and those of a large
    component are apart (they need none with each other).  n classes that hang together in no way cost n^2 comparisons.
    """
    band = F.floor(F.log(F.col("n_shingles").cast("double")) / F.log(F.lit(100 / PERCENT))).alias("band")
    own = rows.select("bucket", "node", "n_shingles", band).join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    own = stored(own, "regions")
    several = stored(own.groupBy("bucket").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo <> _hi").select("bucket"), "several")
    own = stored(own.join(broadcast_if_small(several), "bucket", "left_semi"), "regions")

    large = own.groupBy("bucket", "band", "component").count().filter(F.col("count") >= BLOCK).select("bucket", "band", "component", F.col("component").alias("pool"))
    own = own.join(broadcast_if_small(stored(large, "large")), ["bucket", "band", "component"], "left").withColumn("pool", F.coalesce("pool", F.lit(_POOLED)))
    own = stored(own, "regions")
    parts = own.groupBy("bucket", "band", "pool").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).alias("parts"))
    own = own.join(broadcast_if_small(stored(parts, "parts")), ["bucket", "band", "pool"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")))
    own = stored(own.select("node", "component", F.struct("bucket", "pool", "band", "part").alias("block")), "regions")

    blocks = stored(own.select("block").distinct(), "blocks")
    side = lambda x: blocks.select(F.col("block.bucket").alias("bucket"), F.col("block").alias(x))
    meet = (F.abs(F.col("x.band") - F.col("y.band")) <= 1) & ((F.col("x.pool") != F.col("y.pool")) | (F.col("x.pool") == _POOLED)) & (F.col("x") <= F.col("y"))
    pairs = side("x").join(side("y"), "bucket").filter(meet).select(F.xxhash64("x", "y").alias("pair"), F.explode(F.array_distinct(F.array("x", "y"))).alias("block"))
    pairs = stored(pairs, "block-pairs")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, members = None, []
        for batch in batches:
            links = []
            for pair, *member in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if pair != last:
                    links += linked(members)
                    last, members = pair, []
                members.append(member)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in linked(members)], pa.int64()) for i in (0, 1)], names=["a", "b"])

    members = own.join(pairs, "block").join(held, "node").select("pair", "node", "component", "held")
    return map_batches(members.repartition("pair").sortWithinPartitions("pair"), judge, "a long, b long").distinct()


def _own_links(signed: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between an id and its classes where rows of one id have several sets."""
    key = F.xxhash64("set_key")
    several = signed.filter("set_key is not null").groupBy("doc_id").agg(F.min(key).alias("_lo"), F.max(key).alias("_hi")).filter("_lo <> _hi").select("doc_id")
    rows = signed.join(several, "doc_id", "left_semi").select("set_key", F.col("doc_id").alias("a"))
    return rows.join(classes, "set_key").select("a", F.col("doc_id").alias("b")).filter("a <> b")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    signed = stored(shingle_sets(docs), "signed")
    classes = stored(signed.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id")), "classes")
    heads = signed.join(classes, ["set_key", "doc_id"], "left_semi").dropDuplicates(["set_key", "doc_id"])
    filed = buckets(forest(heads))
    pairs = stored(candidates(filed), "candidates")
    nodes = stored(filed.select("node").distinct(), "nodes")
    held = stored(full_sets(docs, broadcast_if_small(nodes)), "sets")

    ways = pairs.select(F.col("a").alias("node"), "a", "b", "trees").union(pairs.select("b", "a", "b", "trees"))
    nearest = ways.groupBy("node").agg(F.max_by(F.struct("a", "b"), F.struct("trees", -F.col("a"), -F.col("b"))).alias("p")).select("p.a", "p.b")
    first = stored(nearest.union(pairs.filter("head").select("a", "b")).distinct(), "first")
    links = stored(confirmed(first, held).union(_own_links(signed, classes)), "links")
    found = stored(components(links), "components")

    side = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"_{x}"))
    rest = pairs.select("a", "b").join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = rest.filter("coalesce(_a, a) <> coalesce(_b, b)").select("a", "b")
    crowded = stored(open_classes(filed, found), "crowded")
    if not crowded.isEmpty():
        light, heavy = crowded_pairs(stored(crowded.join(held, "node"), "crowded-sets"))
        rest = rest.union(light).distinct()
    links = stored(confirmed(stored(rest, "rest"), held), "links")
    if not links.isEmpty():
        found = stored(components(links.union(found)), "components")
    if not crowded.isEmpty() and not heavy.isEmpty():
        links = stored(block_links(heavy, found, held), "links")
        if not links.isEmpty():
            found = stored(components(links.union(found)), "components")

    grouped = classes.join(found, classes["doc_id"] == found["node"], "left").select("set_key", F.coalesce("component", "doc_id").alias("_component"))
    rows = signed.select("doc_id", "n_shingles", "set_key")
    some = rows.filter("set_key is not null").join(broadcast_if_small(stored(grouped, "grouped")), "set_key", "left").drop("set_key")
    none = rows.filter("set_key is null").select("doc_id", "n_shingles", F.lit(None).cast("long").alias("_component"))  # apart: as keys, nulls would be one task
    component = F.coalesce("_component", "doc_id").alias("component_id")
    every = some.unionByName(none).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return every.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
