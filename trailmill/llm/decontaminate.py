"""Benchmark decontamination by a prefix-filtered set join.

An item is cut into windows of 13 consecutive words (one window if it has
fewer).  A window is the ordered set of its three-word shingles.  All of them
must occur for the window to occur, so one of them is a sufficient prefix: the
one that is rarest in the documents.  Consecutive windows mostly share it, and
only it is joined.  Each occurrence of a prefix shingle in a document proposes
the windows that have it; the position inside the window fixes where the window
would start, the length bound drops starts outside the document, and what is
left is compared word by word.

Bitmaps of fixed size (BITS) say which shingles are worth sending; they are the
only thing broadcast, and a larger benchmark makes them denser, not larger.

Defined results: null texts have no words; a null item_id is the empty string;
rows with equal item_id are one item; repeated documents are judged alike; with
an empty benchmark no document is hit; an empty table gives an empty result;
very long texts are searched whole, their hits in one row; shingles of equal
rarity are ordered by hash; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm._bitmap import bitmap
from trailmill.llm._rows import anti
from trailmill.llm._scratch import written
from trailmill.llm._tokens import ALNUM, U64, Words, chunks, hex_free, words_of

WINDOW = 13
SHINGLE = 3
BITS = 1 << 22


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of k words; lengths never collide."""
    return w.grams(k, salt=k)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(0)
        for first, texts in chunks(batch):
            w = words_of(texts, ALNUM, lower=True)
            raw = w.data.tobytes()
            words = [raw[s:e] for s, e in zip(w.start.tolist(), w.end.tolist(), strict=True)]
            bounds = np.searchsorted(w.doc, np.arange(len(texts) + 1)).tolist()
            hashes = {k: dict(zip(*(x.tolist() for x in (at, hex_free(h))), strict=True)) for k in range(1, SHINGLE + 1) for at, h in [shingles(w, k)]}
            items, windows, grams = [], [], []
            for i in range(len(texts)):
                a, b = bounds[i], bounds[i + 1]
                size = min(WINDOW, b - a)
                k = min(SHINGLE, size)
                for start in range(a, b - size + 1) if size else ():
                    items.append(ids[first + i].as_py())
                    windows.append(b" ".join(words[start : start + size]).decode("utf-8"))
                    grams.append([hashes[k][p] for p in range(start, start + size - k + 1)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(items, pa.string()), pa.array(windows, pa.string()), pa.array(grams, pa.list_(pa.int64()))], names=["item_id", "words", "grams"]
            )


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, words, grams): the windows of each item and their shingles in order, stored."""
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    return written(rows.mapInArrow(_windows, "item_id string, words string, grams array<bigint>").distinct(), "bench-windows")


def _hits(w: Words, bits: np.ndarray, lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the shingles whose bit is set."""
    found = [(at[on], h[on]) for k in lengths for at, h in [shingles(w, k)] for on in [bits[(h & U64(BITS - 1)).astype(np.int64)]]]
    return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])


def shingle_counts(docs: DataFrame, bits, lengths: list[int]) -> DataFrame:
    """(hash, n): how often each shingle with a set bit occurs in the documents."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(np.frombuffer(bits.value, np.uint8)).view(bool)
        for batch in batches:
            for _, texts in chunks(batch):
                _, h = _hits(words_of(texts, ALNUM, lower=True), on, lengths)
                h, n = np.unique(h, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hex_free(h)), pa.array(n.astype(np.int64))], names=["hash", "n"])

    return docs.select("text").mapInArrow(counted, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(hash, at, words): each distinct window with its rarest shingle and that shingle's place, stored."""
    places = windows.select("words", F.posexplode("grams").alias("at", "hash")).distinct()
    rarest = F.min(F.struct(F.coalesce(F.col("n"), F.lit(0)).alias("n"), "hash", "at"))
    chosen = places.join(counts, "hash", "left").groupBy("words").agg(rarest.alias("least"))
    return written(chosen.select("least.hash", "least.at", "words"), "bench-prefixes")


def occurrences(docs: DataFrame, bits, lengths: list[int]) -> DataFrame:
    """(row, doc_id, text_hash, n_words, found): per document the prefix shingles it has, each with the words around it, stored."""
    before, after = WINDOW - 1, WINDOW
    kind = docs.schema["doc_id"].dataType.simpleString()
    struct = pa.struct([("hash", pa.int64()), ("at", pa.int64()), ("lead", pa.int32()), ("near", pa.list_(pa.string()))])

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(np.frombuffer(bits.value, np.uint8)).view(bool)
        for batch in batches:
            for first, texts in chunks(batch):
                w = words_of(texts, ALNUM, lower=True)
                at, h = _hits(w, on, lengths)
                bounds = np.searchsorted(w.doc, np.arange(len(texts) + 1))
                found: list[list[dict]] = [[] for _ in texts]
                for p, x in zip(at.tolist(), hex_free(h).tolist(), strict=True):
                    i = int(w.doc[p])
                    a, b = max(bounds[i], p - before), min(bounds[i + 1], p + after)
                    near = [w.data[s:e].tobytes().decode("utf-8") for s, e in zip(w.start[a:b].tolist(), w.end[a:b].tolist(), strict=True)]
                    found[i].append({"hash": x, "at": p - int(bounds[i]), "lead": int(p - a), "near": near})
                part = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(w.counts.astype(np.int64)), pa.array(found, pa.list_(struct))],
                    names=["row", "doc_id", "text_hash", "n_words", "found"],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), "text")
    schema = f"row long, doc_id {kind}, text_hash long, n_words long, found array<struct<hash:long,at:long,lead:int,near:array<string>>>"
    return written(rows.mapInArrow(searched, schema), "bench-found")


def matches(found: DataFrame, index: DataFrame) -> DataFrame:
    """(row, start, size, words): the windows that occur, compared word by word.

    No hint: the index is stored, so Spark broadcasts it only below its
    threshold; else a very frequent shingle is split by the adaptive skew join.
    """
    spots = found.select("row", F.explode("found").alias("o")).select("row", "o.*")
    inside = spots.join(index.withColumnRenamed("at", "offset"), "hash").withColumn("size", F.size(F.split("words", " ")))
    inside = inside.withColumn("from", F.col("lead") - F.col("offset")).filter("from >= 0 AND from + size <= size(near)")
    same = F.array_join(F.slice("near", F.col("from") + 1, F.col("size")), " ") == F.col("words")
    return inside.filter(same).select("row", (F.col("at") - F.col("offset")).alias("start"), "size", "words")


def covered(spans: str) -> F.Column:
    """Words that a set of (start, size) covers, from the spans in order."""
    zero = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("n"))
    step = lambda acc, x: F.struct(
        F.greatest(acc["upto"], x["start"] + x["size"]).alias("upto"),
        (acc["n"] + F.greatest(F.lit(0), x["start"] + x["size"] - F.greatest(acc["upto"], x["start"]))).alias("n"),
    )
    return F.aggregate(F.array_sort(spans), zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, item_ids, contaminated) of every document."""
    spark = docs.sparkSession
    windows = item_windows(benchmark)
    grams = windows.select(F.explode("grams").alias("hash")).distinct()
    sizes = windows.select(F.least(F.size(F.split("words", " ")), F.lit(SHINGLE)).alias("k")).distinct().collect()  # SHINGLE rows at most
    lengths = sorted(r["k"] for r in sizes) or [SHINGLE]
    sent = lambda bits: spark.sparkContext.broadcast(np.packbits(bits).tobytes())  # noqa: E731  BITS / 8 bytes
    index = prefixes(windows, shingle_counts(docs, sent(bitmap(grams, BITS)), lengths))
    found = occurrences(docs, sent(bitmap(index.select("hash"), BITS)), lengths)
    hit = written(matches(found, index).distinct(), "bench-matches")
    spans = hit.groupBy("row").agg(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), F.col("size").cast("long").alias("size"))).alias("spans"))
    owners = windows.select("words", "item_id")
    named = hit.select("row", "words").distinct().join(owners, "words").groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    per_row = spans.join(named, "row").select(F.col("row").alias("hit_row"), covered("spans").alias("n_hit"), "item_ids")
    rows = found.drop("found").join(per_row, F.col("row") == F.col("hit_row"), "left")
    n_hit = F.coalesce(F.col("n_hit"), F.lit(0)).cast("long")
    return rows.select(
        "doc_id",
        "text_hash",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("item_ids"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, all columns."""
    hit = contamination(docs, benchmark).filter("contaminated").select("doc_id", "text_hash").distinct()
    return anti(docs, written(hit, "bench-contaminated"))


def op9_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated"
    )


_WORDS = r"regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')"

OP9_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id, {_WORDS} AS ws FROM benchmark),
w AS (
  SELECT DISTINCT item_id, n, array_to_string(ws[s:s + n - 1], ' ') AS g
  FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS s FROM b WHERE len(ws) > 0)
), g AS (
  SELECT rid, s, n, array_to_string(ws[s:s + n - 1], ' ') AS g
  FROM (SELECT rid, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM w) WHERE len(ws) >= n)
), m AS (SELECT rid, s, g.n, item_id FROM g JOIN w ON g.g = w.g AND g.n = w.n),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT rid, s, n FROM m)) GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY encode(item_id)) AS ids FROM (SELECT DISTINCT rid, item_id FROM m) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN items USING (rid)
"""
