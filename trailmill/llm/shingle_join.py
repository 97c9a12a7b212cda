"""N-gram Jaccard join over count vectors.

A document is the set of its five-word shingles.  Equal sets are one class from
the start; only one member of a class is compared.

What can link is brought together by a prefix filter in two steps.  Sets of n
shingles that link have, in any common order, some k(n) (of the smaller; a few,
and n / 24) in common among their first n - ceil(0.75 n) + k(n) shingles.  In order of
hash, these are counted; those that no other set has there are dropped, and a
set with too few left links with nothing.  The rest are ordered once more, by
how many sets have them, from rare to frequent: all but the last k - 1 of these
still hold a common one.  Sets that share such, directly or by others, form a block.

In a block the shingles are hashed into groups and a set is the point of its
group counts.  The points are packed into an R-tree whose nodes know the
largest count of each group; the sum of the coordinates' minima bounds the
overlap from above, so a branch that cannot reach 3/7 of both sizes is left.
Pairs that survive are compared exactly.  Pairs that are connected already need
no look: the result is components, and a group of thousands of near copies
costs about one comparison a member.

Blocks above MOST shingles are split by their shared shingles, and a shingle
shared by more than that by pairs of chunks, so every pair still meets and no
task holds an unbounded group.  Only sets of texts that are asked for are shuffled.

Defined results: a null text, or one without words, has the empty set and is
linked with nothing; fewer than five words are one shingle, their whole
sequence; repeated rows are one class; a null doc_id is never the smallest; an
empty table gives an empty result; a very long text is one set, made by the task
that reads it; shingles of equal rarity are ordered by hash; other columns are
not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.llm._bitmap import bitmap
from trailmill.llm._rows import anti, semi
from trailmill.llm._scratch import written
from trailmill.llm._tokens import SPACED, U64, chunks, hex_free, mix, words_of
from trailmill.llm.components import components

SHINGLE = 5
#: Bits of the map that says which texts are asked for; more texts make it denser, not larger.
BITS = 1 << 24
#: Bits of the map that says which keys of prefixes occur more than once.
KEY_BITS = 1 << 26
#: Shingles, copies included, of a block that one task compares.
MOST = 8_000_000
FANOUT = 16
EMITTED = 1_000_000


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words_of(texts, SPACED, lower=True)
    at, h = w.grams(SHINGLE, salt=SHINGLE)
    counts = w.counts
    upto = np.cumsum(counts)
    bounds = np.searchsorted(w.doc[at], np.arange(len(texts) + 1))
    sets = []
    for i, n in enumerate(counts.tolist()):
        if n >= SHINGLE:
            sets.append(np.unique(h[bounds[i] : bounds[i + 1]]))
        elif n:
            sets.append(mix(w.combined(np.array([upto[i] - n]), n) + U64(n)))
        else:
            sets.append(np.zeros(0, U64))
    return sets


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that do not depend on the order of the shingles; they are the set's name."""
    sums = [(int(mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64)), int(mix(s + U64(0x14057B7EF767814F)).sum(dtype=U64))) for s in sets]
    pairs = np.array(sums, U64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in chunks(batch):
            sets = shingle_sets(texts)
            a, b = fingerprints(sets)
            part, sizes = batch.slice(first, len(texts)), pa.array([len(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), sizes, pa.array(hex_free(a)), pa.array(hex_free(b))], names=["doc_id", "text_hash", "n", "set_a", "set_b"]
            )


def demanded(n: int) -> int:
    """Shingles that a set of n must have in common with another in their prefixes; grows with n."""
    return max(1, n // 24 + min(n // 3, 16))


def prefix_size(n: int) -> int:
    """Shingles in order of hash that hold demanded(n) in common with any set of at least this size that links."""
    return min(n, n - (3 * n + 3) // 4 + demanded(n))


def least_common(n: Column) -> Column:
    """What a set of n shingles has in common, among the prefixes, with any that it links with: these have 3n/4 or more, so demanded(ceil(3n/4))."""
    least = F.ceil(n * 3 / 4)
    return F.greatest(F.lit(1), F.floor(least / 24) + F.least(F.floor(least / 3), F.lit(16))).cast("long")


class Tree:
    """An R-tree over count vectors, packed bottom up in the order given."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, label: np.ndarray):
        self.levels = [(points, sizes, label)]
        while len(points) > FANOUT:
            first = np.arange(0, len(points), FANOUT)
            low, high = np.minimum.reduceat(label, first), np.maximum.reduceat(label, first)
            points, sizes, label = np.maximum.reduceat(points, first, axis=0), np.minimum.reduceat(sizes, first), np.where(low == high, low, -1)
            self.levels.append((points, sizes, label))

    def search(self, point: np.ndarray, size: int, label: int) -> np.ndarray:
        """Entries under other labels whose overlap may reach 3/7 of both sizes."""
        nodes = np.arange(len(self.levels[-1][0]))
        for depth in range(len(self.levels) - 1, -1, -1):
            points, sizes, labels = self.levels[depth]
            nodes = nodes[labels[nodes] != label]
            bound = np.minimum(points[nodes], point).sum(axis=1, dtype=np.int64)
            nodes = nodes[7 * bound >= 3 * (size + np.maximum(sizes[nodes], -(-3 * size // 4)))]
            if not len(nodes):
                return nodes
            if depth:
                nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                nodes = nodes[nodes < len(self.levels[depth - 1][0])]
        return nodes


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    if 4 * len(small) < 3 * len(large):
        return False
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= 75 * (len(a) + len(b) - both)


def linked(sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """Links that connect all sets of a block that links connect; every pair is bounded, compared or connected already."""
    m = len(sets)
    sizes = np.fromiter(map(len, sets), np.int64, m)
    groups = 1 << int(np.clip(np.median(sizes) // 2, 8, 512)).bit_length()
    points = np.zeros((m, groups), np.int32)
    for i, s in enumerate(sets):
        points[i] = np.bincount((s >> U64(40)).astype(np.int64) & (groups - 1), minlength=groups)
    # A few stars first: what is one component needs no comparison among itself.
    star = np.full(m, -1)
    for _ in range(min(m, 2 * FANOUT)):
        free = np.flatnonzero(star < 0)
        if not len(free):
            break
        hub = int(free[0])
        star[hub] = hub
        rest = free[1:]
        bound = np.minimum(points[rest], points[hub]).sum(axis=1)
        for i in rest[7 * bound >= 3 * (sizes[rest] + sizes[hub])].tolist():
            if similar(sets[hub], sets[i]):
                star[i] = hub
                yield hub, i
    star = np.where(star < 0, np.arange(m), star)
    if (star == star[0]).all():
        return
    order = np.lexsort((sizes, star))
    tree = Tree(points[order], sizes[order], star[order])
    parent = {int(x): int(x) for x in np.unique(star)}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for place, i in enumerate(order.tolist()):
        for other in tree.search(points[i], int(sizes[i]), int(star[i])).tolist():
            if other > place:
                j = int(order[other])
                a, b = root(int(star[i])), root(int(star[j]))
                if a != b and similar(sets[i], sets[j]):
                    parent[max(a, b)] = min(a, b)
                    yield i, j


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, set_a, set_b, shingles) in order of block and id, an id perhaps repeated, to links (a, b) between set ids."""

    def done(ids: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
        pairs = list(linked(sets)) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([ids[p[k]] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    block, ids, sets = None, [], []
    for batch in batches:
        for b, x, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if b != block:
                if len(ids) > 1:
                    yield done(ids, sets)
                block, ids, sets = b, [], []
            if not ids or ids[-1] != x:
                ids.append(x)
                sets.append(np.frombuffer(raw, U64))
    yield done(ids, sets)


def in_bitmap(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each signed hash is set in the packed bitmap."""
    spot = hashes & (len(packed) * 8 - 1)
    return (packed[spot >> 3] >> (7 - (spot & 7)).astype(np.uint8) & 1).astype(bool)


def asked_sets(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """(doc_id, text_hash, shingles) of the texts whose bit is set, so that only these are shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = sent.value
        for batch in batches:
            batch = batch.filter(pa.array(in_bitmap(packed, batch.column(1).to_numpy())))
            for first, texts in chunks(batch):
                part, sets = batch.slice(first, len(texts)), shingle_sets(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([s.tobytes() for s in sets], pa.binary())], names=["doc_id", "text_hash", "shingles"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return rows.mapInArrow(sets_of, f"doc_id {kind}, text_hash long, shingles binary")


def _emitted(batches: Iterator[pa.RecordBatch], packed: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """Texts to (key, set_a, n), of keys that the bitmap lets through; a task emits equal sets once as far as it remembers."""
    seen: set[int] = set()
    for batch in batches:
        for _, part in chunks(batch):
            sets = [s for s in shingle_sets(part) if len(s)]
            names = fingerprints(sets)[0].tolist()
            fresh = {n: s for n, s in zip(names, sets, strict=True) if n not in seen}
            if len(seen) > EMITTED:
                seen.clear()
            seen.update(fresh)
            prefixes = [s[: prefix_size(len(s))] for s in fresh.values()]
            lengths = [len(p) for p in prefixes]
            ids = np.repeat(np.array(list(fresh), U64), lengths)
            sizes = np.repeat(np.array([len(s) for s in fresh.values()], np.int64), lengths)
            keys = np.concatenate(prefixes) if prefixes else np.zeros(0, U64)
            if packed is not None:
                asked = in_bitmap(packed, hex_free(keys))
                keys, ids, sizes = keys[asked], ids[asked], sizes[asked]
            yield pa.RecordBatch.from_arrays([pa.array(hex_free(keys)), pa.array(hex_free(ids)), pa.array(sizes)], names=["key", "set_a", "n"])


def prefix_keys(texts: DataFrame, bits: np.ndarray | None = None) -> DataFrame:
    """(key, set_a, n); with bits, of keys of which the bit is set only."""
    schema = "key long, set_a long, n long"
    if bits is None:
        return texts.select("text").mapInArrow(_emitted, schema)
    sent = texts.sparkSession.sparkContext.broadcast(np.packbits(bits))
    return texts.select("text").mapInArrow(lambda batches: _emitted(batches, sent.value), schema)


def shared_keys(docs: DataFrame) -> DataFrame:
    """(key, set_a, hub): keys by which sets can link, one key for equal groups of sets, stored.

    Keys are counted first; a bitmap of fixed size then keeps nearly all that occur
    once from being shuffled with their sets.  Counting combines before its shuffle,
    and the joins by key are split where a key is hot.  A set's own keys are bounded by its size.  Equal groups of sets
    are found by count and hash sums of their members.
    """
    counted = prefix_keys(docs).groupBy(F.col("key").alias("k")).agg(F.count("*").alias("df"))
    several = written(counted.filter("df > 1"), "join-several")
    keys = prefix_keys(docs, bitmap(several.select(F.col("k").alias("hash")), KEY_BITS))
    found = keys.join(several, F.col("key") == F.col("k")).select("set_a", "key", "n", "df")
    own = found.repartition(F.col("set_a")).groupBy("set_a", "key").agg(F.max("n").alias("n"), F.max("df").alias("df"))
    of_set = Window.partitionBy("set_a")
    ranked = own.select(
        "set_a", "key", "n", F.row_number().over(of_set.orderBy("df", "key")).alias("rank"), F.count("*").over(of_set).alias("kept")
    )
    second = written(ranked.filter(F.col("rank") <= F.col("kept") - least_common(F.col("n")) + 1).select("key", "set_a"), "join-prefixes")
    groups = second.groupBy("key").agg(
        F.count("*").alias("n"), F.min("set_a").alias("hub"), F.expr("bit_xor(xxhash64(set_a))").alias("x"), F.expr("bit_xor(xxhash64(set_a, 1))").alias("y")
    )
    chosen = groups.filter("n > 1").groupBy("n", "x", "y").agg(F.min(F.struct("key", "hub")).alias("c")).select(F.col("c.key").alias("k"), F.col("c.hub").alias("hub"))
    return written(second.join(chosen, F.col("key") == F.col("k")).drop("k"), "join-keys")


def blocks(shared: DataFrame, sizes: DataFrame, most: int = MOST) -> DataFrame:
    """(block, set_a): groups of sets in which all links between different sets lie, each within ``most`` shingles, or a pair of chunks."""
    roots = components(shared.select(F.col("hub").alias("a"), F.col("set_a").alias("b"))).select(F.col("node"), "root")
    rows = shared.join(roots, F.col("set_a") == F.col("node"), "left").select("key", "set_a", F.coalesce("root", "set_a").alias("root"))
    rows = written(rows.join(sizes, F.col("set_a") == F.col("size_of")).drop("size_of"), "join-rows")
    # Stored, so that the joins do not take over the partitioning of these groupings, in which a root is one task.
    whole = written(rows.dropDuplicates(["root", "set_a"]).groupBy(F.col("root").alias("r")).agg(F.sum("n").alias("root_n")), "join-whole")
    per_key = written(rows.groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("key_n")), "join-per-key")
    sized = rows.join(whole, F.col("root") == F.col("r")).join(per_key, F.col("key") == F.col("k"))
    small = sized.filter(F.col("root_n") <= most).select(F.col("root").alias("block"), "set_a").distinct()
    large = sized.filter(F.col("root_n") > most).withColumn("parts", F.ceil(F.col("key_n") * 2 / most).cast("int"))
    large = large.withColumn("parts", F.when(F.col("key_n") <= most, 1).otherwise(F.col("parts"))).withColumn("own", F.pmod(F.xxhash64("set_a", F.lit(3)), F.col("parts")).cast("int"))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    name = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    return written(small.unionByName(large.select(name.alias("block"), "set_a")), "join-blocks")


def described(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(rows.mapInArrow(_described, f"doc_id {kind}, text_hash long, n long, set_a long, set_b long"), "join-documents")


def set_links(docs: DataFrame, known: DataFrame, most: int = MOST) -> DataFrame:
    """Links (a, b) between set ids that connect all documents whose sets link.

    An id stands for (set_a, set_b); ``known`` is what described() gives.
    """
    shared = shared_keys(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first")
    firsts = known.filter("n > 0").groupBy("set_a", "set_b").agg(F.max("n").alias("n"), least)
    firsts = written(firsts.withColumn("id", F.xxhash64("set_a", "set_b")), "join-sets")
    sizes = firsts.groupBy(F.col("set_a").alias("size_of")).agg(F.sum("n").alias("n"))
    placed = blocks(shared, sizes, most).withColumnRenamed("set_a", "placed_a")
    wanted = firsts.join(placed, F.col("set_a") == F.col("placed_a")).select(
        F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "block", "id"
    )
    asked = wanted.groupBy(F.col("doc_id").alias("r_doc_id"), F.col("text_hash").alias("r_text_hash")).agg(F.collect_set(F.struct("block", "id")).alias("wanted"))
    asked = written(asked, "join-asked")
    sets = asked_sets(docs, bitmap(asked.select(F.col("r_text_hash").alias("hash")), BITS))
    found = sets.join(asked, sets["doc_id"].eqNullSafe(asked["r_doc_id"]) & (sets["text_hash"] == asked["r_text_hash"]))
    rows = found.select(F.explode("wanted").alias("w"), "shingles").select("w.block", "w.id", "shingles")
    rows = rows.repartition(F.col("block")).sortWithinPartitions("block", "id")
    return written(rows.mapInArrow(_links, "a long, b long"), "join-links")


def joined(docs: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, root) of every document; root names the component, null without words.

    A component's id is its smallest doc_id; it joins back by set, and a set
    that a third of the documents have is split by the adaptive skew join.
    """
    known = described(docs)
    roots = components(set_links(docs, known, most))
    rows = known.withColumn("id", F.xxhash64("set_a", "set_b"))
    full = rows.filter("n > 0")
    per_set = full.groupBy("id").agg(F.min("doc_id").alias("least"))
    rooted = written(
        per_set.join(roots, F.col("id") == F.col("node"), "left").select("id", "least", F.coalesce("root", "id").alias("root")), "join-roots"
    )
    names = written(rooted.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component_id")), "join-names")
    named = rooted.join(names, F.col("root") == F.col("r")).select(F.col("id").alias("named_id"), "component_id", "root")
    with_words = full.join(named, F.col("id") == F.col("named_id")).select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "component_id", "root")
    without = rows.filter("n = 0").select(
        "doc_id", "text_hash", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root")
    )
    return with_words.unionByName(without)


def one_of_each(docs: DataFrame, most: int = MOST) -> DataFrame:
    """The documents, with one of each component: the smallest doc_id (then text hash); of its rows the least by the other columns, in their order."""
    found = written(joined(docs, most).select("doc_id", "text_hash", "root"), "join-components")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("f")
    linked_ones = found.filter("root IS NOT NULL").groupBy("root").agg(first).select("f.doc_id", "f.text_hash")
    stay = linked_ones.unionByName(found.filter("root IS NULL").select("doc_id", "text_hash").distinct())
    kept = semi(docs, written(stay, "join-kept"))
    times = found.filter("root IS NOT NULL").groupBy("doc_id", "text_hash").agg(F.count("*").alias("times")).filter("times > 1")
    times = written(times.drop("times"), "join-equal")
    if times.isEmpty():
        return kept
    again, others = semi(kept, times), [c for c in docs.columns if c not in ("doc_id", "text")]
    if not others:
        return anti(kept, times).unionByName(again.dropDuplicates())
    least = again.groupBy("doc_id", "text").agg(F.min(F.struct(*others)).alias("least_row"))
    return anti(kept, times).unionByName(least.select("doc_id", "text", *[F.col("least_row")[c].alias(c) for c in others]))


def op4_shingle_join(spark, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash", "root")
