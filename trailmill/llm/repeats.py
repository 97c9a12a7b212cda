"""Byte-exact removal of repeated passages over a sparse enhanced suffix array.

Every string of LENGTH bytes that occurs twice has, in both places, the same
anchor: the k-gram of least hash in it (leftmost on ties).  So only suffixes at
anchors are indexed, about one in (LENGTH - K) / 2 bytes.  Anchors whose k-gram
occurs once are dropped.  Anchors with equal surroundings (all bytes that a
window over the anchor can reach) are one entry with a count.  The entries of a
k-gram, sorted by what follows, are its part of the suffix array; a stack scan
over the common-prefix lengths gives the interval tree.  Inside each interval the
entries are sorted by their reversed left contexts, and each takes the longer of
what it shares with its two neighbours there.  What comes out is one reach per
entry: the most bytes before and after the anchor over all intervals where both
together are LENGTH at least.  Repeats of an entry all hold its anchor, so they
cover just that stretch.  Groups of occurrences and left diversity are not
formed; ``maximal_repeats`` does so and is only called by a test.

No task holds a hot group: equal surroundings are counted by aggregation with
map-side combining, and a k-gram with more than MOST different surroundings is
not sorted in one task but has its windows counted one by one, exactly as well.
Texts are shuffled once, by document.

Defined results: a null text is empty; texts under LENGTH bytes lose nothing;
repeated rows are repeats of each other; null doc_ids are allowed; an empty
table gives an empty result; bytes are judged on the input; a very long text is
read whole by one task and its spans are put together in one row; equal strings
are all removed, so no ties arise; other columns are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.llm._scratch import written
from trailmill.llm._tokens import BASE_INVERSE, U64, chunks, hex_free, mix, powers, prefix_hash, range_hash

LENGTH = 200
K = 32
#: Surroundings of one k-gram that one task sorts.
MOST = 20_000


def anchors_of(texts: list[bytes], length: int = LENGTH, k: int = K):
    """Anchors of each text: (text, place in it, k-gram hash, surroundings hash)."""
    a = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    w = length - k + 1  # k-grams in a window
    n = len(a) - length + 1  # window starts
    if n <= 0 or not (sizes >= length).any():
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, U64),) * 2
    s = prefix_hash(a)
    grams = len(a) - k + 1
    h = (s[k:] - s[:grams]) * powers(BASE_INVERSE, grams) * U64(0x9FB21C651E98DF25)
    h >>= U64(32)
    h <<= U64(32)
    h |= np.arange(grams, dtype=U64)
    blocks = -(-grams // w)
    padded = np.full(blocks * w, U64(0xFFFFFFFFFFFFFFFF))
    padded[:grams] = h
    padded = padded.reshape(blocks, w)
    upto = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(after[:n], upto[w - 1 : w - 1 + n])
    inside = np.zeros(len(a) + 1, np.int8)
    long = sizes >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    at = (least[np.cumsum(inside[:n]).astype(bool)] & U64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    text = np.searchsorted(ends, at, side="right")
    left = np.maximum(at - (w - 1), starts[text])
    right = np.minimum(at + length, ends[text])
    shape = mix(((at - left) * (length + 1) + right - at).astype(U64))
    return text, at - starts[text], range_hash(s, at, at + k), range_hash(s, left, right) ^ shape


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, texts in chunks(batch):
            text, at, gram, near = anchors_of(texts)
            rows = pa.array(text + first)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(at.astype(np.int32)), pa.array(hex_free(gram)), pa.array(hex_free(near))],
                names=["doc_id", "text_hash", "at", "gram", "near"],
            )


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """The interval tree of common-prefix lengths (lcp[i] between entries i - 1 and i, lcp[0] unused), by a stack scan: (first, last, length)."""
    stack: list[tuple[int, int]] = []  # (length, first)
    for i in range(1, len(lcp) + 1):
        now = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][0] > now:
            length, first = stack.pop()
            yield first, i - 1, length
        if now >= least and (not stack or stack[-1][0] < now):
            stack.append((now, first))


def maximal_repeats(rights: list[bytes], lefts: list[bytes], length: int = LENGTH) -> Iterator[tuple[list[int], int, int]]:
    """Of the entries of one k-gram, sorted by ``rights``; ``lefts`` are reversed: (entries, bytes before, bytes after) of each maximal repeat of ``length`` bytes at least."""
    lcp = [0] + [common(a, b) for a, b in zip(rights, rights[1:])]
    reach = max((len(x) for x in lefts), default=0)
    for first, last, right in intervals(lcp, max(1, length - reach)):
        members = sorted(range(first, last + 1), key=lefts.__getitem__)
        before = [0] + [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        for i, j, left in intervals(before, max(0, length - right)):
            group = members[i : j + 1]
            # Diverse to the right too: else a deeper interval has the same occurrences.
            low, high = min(group), max(group)
            if min(lcp[low + 1 : high + 1]) == right:
                yield group, left, right


def reaches(rights: list[bytes], lefts: list[bytes], length: int = LENGTH) -> list[tuple[int, int]]:
    """Bytes before and after the anchor that maximal repeats cover, for each entry; (0, 0) if none.

    The innermost repeat of an entry in a right interval is the one it shares
    with a neighbour in the order of left contexts.  All repeats of an entry hold its anchor, so what they
    cover is one stretch, from the largest reach before to the largest after.
    """
    m = len(rights)
    if m == 2:
        left, right = common(lefts[0], lefts[1]), common(rights[0], rights[1])
        return [(left, right) if left + right >= length else (0, 0)] * 2
    found = [(0, 0)] * m
    lcp = [0] + [common(a, b) for a, b in zip(rights, rights[1:])]
    reach = max(map(len, lefts))
    for first, last, right in intervals(lcp, max(1, length - reach)):
        members = sorted(range(first, last + 1), key=lefts.__getitem__)
        before = [common(lefts[a], lefts[b]) for a, b in zip(members, members[1:])]
        for x, left in zip(members, map(max, [0, *before], [*before, 0])):
            if left + right >= length:
                a, b = found[x]
                found[x] = (max(a, left), max(b, right))
    return found


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, near, lefts, rights, n) in order of (gram, rights) to (gram, near, before, after) of each single entry that repeats."""
    out: list[tuple] = []

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True)) if rows else [()] * 4
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["gram", "near", "before", "after"])

    def finish(group: list[tuple]) -> None:
        if len(group) > 1:
            found = reaches([g[3] for g in group], [g[2] for g in group])
            out.extend((g[0], g[1], *r) for g, r in zip(group, found, strict=True) if r[1] and g[4] == 1)

    group: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group and row[0] != group[0][0]:
                finish(group)
                group = []
                if len(out) > 50_000:
                    yield batch_of(out)
                    out.clear()
            group.append(row)
    finish(group)
    yield batch_of(out)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (gram, near, lefts, rights, n) to (gram, near, n, before, window): each window over the anchor by hash."""
    names = ["gram", "near", "n", "before", "window"]
    for batch in batches:
        parts: list[list[np.ndarray]] = [[], [], [], [], []]
        for gram, near, left, right, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s = prefix_hash(np.frombuffer(left[::-1] + right, np.uint8))
            start = np.arange(max(0, min(len(left), len(left) + len(right) - LENGTH) + 1))
            row = (np.full(len(start), gram), np.full(len(start), near), np.full(len(start), n), (len(left) - start).astype(np.int32))
            for column, values in zip(parts, (*row, hex_free(range_hash(s, start, start + LENGTH))), strict=True):
                column.append(values)
        if parts[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in parts], names=names)


def _surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text, wanted entries) to (gram, near, lefts, rights, n)."""
    for batch in batches:
        rows = []
        for text, wanted in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for e in wanted or ():
                at = e["at"]
                rows.append((e["gram"], e["near"], text[max(0, at - (LENGTH - K)) : at][::-1], text[at : at + LENGTH], e["n"]))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 5
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["gram", "near", "lefts", "rights", "n"])


def same_row(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["r_doc_id"]) & (a["text_hash"] == b["r_text_hash"])


def per_document(rows: DataFrame, *what: str) -> DataFrame:
    """The rows of each document as a list that its length bounds."""
    listed = rows.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct(*what)).alias("listed"))
    return listed.select(F.col("doc_id").alias("r_doc_id"), F.col("text_hash").alias("r_text_hash"), "listed")


def surroundings(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(gram, near, lefts, rights, n): the bytes around the first occurrence of each wanted entry."""
    asked = per_document(wanted, "at", "gram", "near", "n")
    found = texts.join(asked, same_row(texts, asked), "left").select("text", "listed")  # left: one shuffle of the texts serves both joins
    return found.mapInArrow(_surroundings, "gram long, near long, lefts binary, rights binary, n long")


def counted_windows(near: DataFrame) -> DataFrame:
    """(gram, near, before, after): what windows that occur twice cover, of each single entry."""
    windows = near.mapInArrow(_windows, "gram long, near long, n long, before int, window long")
    several = windows.groupBy("gram", "before", "window").agg(F.sum("n").alias("n_all")).filter("n_all > 1")
    several = several.select(F.col("gram").alias("g"), F.col("before").alias("b"), F.col("window").alias("x"))
    found = windows.filter("n = 1").join(several, (F.col("gram") == F.col("g")) & (F.col("before") == F.col("b")) & (F.col("window") == F.col("x")))
    return found.groupBy("gram", "near").agg(F.max("before").alias("before"), (F.lit(LENGTH) - F.min("before")).alias("after"))


def repeated_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end): bytes of each text that repeats cover, overlapping."""
    rows = texts.select("doc_id", "text_hash", "text")
    kind = texts.schema["doc_id"].dataType.simpleString()
    anchors = written(rows.mapInArrow(_anchors, f"doc_id {kind}, text_hash long, at int, gram long, near long"), "repeat-anchors")
    # Stored, so that the join reads both sides from plain shuffles, which Spark can split where a gram is hot.
    twice = written(anchors.groupBy("gram").agg(F.count("*").alias("n_all")).filter("n_all > 1").select(F.col("gram").alias("g")), "repeat-twice")
    again = written(anchors.join(twice, F.col("gram") == F.col("g")).drop("g"), "repeat-again")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "at")).alias("first")
    entries = written(again.groupBy("gram", "near").agg(F.count("*").alias("n"), least), "repeat-entries")
    # Entries that occur twice are covered whole; they are read only as partners of those that occur once.
    sizes = entries.groupBy(F.col("gram").alias("g")).agg(F.count("*").alias("n_near"), F.count_if(F.col("n") == 1).alias("single"))
    sizes = written(sizes.filter("n_near > 1 AND single > 0"), "repeat-sizes")
    wanted = entries.join(sizes, F.col("gram") == F.col("g")).select("first.doc_id", "first.text_hash", "first.at", "gram", "near", "n", "n_near")
    sorted_ = surroundings(texts, wanted.filter(F.col("n_near") <= MOST)).select("gram", "near", "lefts", "rights", "n")
    sorted_ = sorted_.repartition(F.col("gram")).sortWithinPartitions("gram", "rights")
    reach = sorted_.mapInArrow(_trees, "gram long, near long, before int, after int")
    if not sizes.filter(F.col("n_near") > MOST).isEmpty():
        reach = reach.unionByName(counted_windows(written(surroundings(texts, wanted.filter(F.col("n_near") > MOST)), "repeat-hot")))
    equal = entries.filter("n > 1").select("gram", "near", F.lit(LENGTH - K).alias("before"), F.lit(LENGTH).alias("after"))
    reach = reach.unionByName(equal).select(F.col("gram").alias("g"), F.col("near").alias("e"), "before", "after")
    return again.join(reach, (F.col("gram") == F.col("g")) & (F.col("near") == F.col("e"))).select(
        "doc_id", "text_hash", F.greatest(F.col("at") - F.col("before"), F.lit(0)).alias("start"), (F.col("at") + F.col("after")).alias("end")
    )


def keyed_texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), text.alias("text"))


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Spans in order, clipped to the text, touching ones joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted((max(0, s["start"]), min(size, s["end"])) for s in spans):
        if end - start <= 0:
            continue
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], end))
        else:
            out.append((start, end))
    return out


def _removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, removed, runs, digests, kept_texts = [], [], [], [], []
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            gone = merged(spans or [], len(text))
            kept, at = [], 0
            for start, end in gone:
                kept.append(text[at:start])
                at = end
            kept.append(text[at:])
            kept_texts.append(b"".join(kept))
            sizes.append(len(text))
            removed.append(sum(e - s for s, e in gone))
            runs.append(len(gone))
            digests.append(hashlib.sha256(kept_texts[-1]).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(digests, pa.string()), pa.array(kept_texts, pa.binary())],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
        )


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every document."""
    texts = keyed_texts(docs)
    spans = per_document(repeated_spans(texts), "start", "end")
    kind = docs.schema["doc_id"].dataType.simpleString()
    joined = texts.join(spans, same_row(texts, spans), "left").select("doc_id", "text", "listed")
    return joined.mapInArrow(_removed, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def op2_repeats(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return without_repeats(docs).drop("kept")
