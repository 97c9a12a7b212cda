"""Quality rules with adaptive thresholds.

Per document: counts of words, characters in words, symbols, repeated lines and
repeated three-word windows.  Ratios of these are integers in thousandths.  Per
(language, source) a histogram sketch of each ratio (values kept to eight
significant bits, so a relative error below 1/128; merged by adding counts)
gives quartiles; a document passes while each ratio lies within three
interquartile ranges of them.  A group's quartiles are drawn towards those of its
language, and these towards those of all documents, as if PRIOR documents more had
had them: small groups lean on the larger one, and no size makes a jump.  Sketches
merge exactly, so no text is read again.  Only documents that pass the base rule
feed the sketches.

Defined results: a null or empty text has no words and fails the base rule; null
languages and sources are groups of their own; repeated rows are judged alike;
an empty table gives an empty result; very long texts are counted whole where
they lie; a value at a fence is kept; other columns are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.llm._frequent import coarse
from trailmill.llm._scratch import written
from trailmill.llm._tokens import SPACED, U64, bytes_hash, chunks, mix, prefix_hash, words_of

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
PRIOR = 200
RANGES = 3
#: Least interquartile range of a ratio, in thousandths: below it differences are noise.
LEAST_RANGE = {"mean_length": 500, "symbols": 50, "dup_lines": 100, "repeats": 100}
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def text_counts(texts: list[bytes]) -> dict[str, np.ndarray]:
    """COUNTS of each text.  n_lines: lines with a word."""
    w = words_of(texts, SPACED, lower=False)
    a, n = w.data, len(texts)
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, n))

    def per_text(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate([[0], np.cumsum(mask)[ends - 1]]))

    line_end = np.flatnonzero(a == 10)
    line_start = np.concatenate([[0], line_end[:-1] + 1])
    has_word = np.diff(np.searchsorted(w.start, np.concatenate([[0], line_end]))) > 0
    line_start, line_end = line_start[has_word], line_end[has_word]
    line_text = np.searchsorted(ends, line_start, side="right")
    line_key = bytes_hash(a, prefix_hash(a), line_start, line_end) ^ mix(line_text.astype(U64))
    _, first = np.unique(line_key, return_index=True)
    at, gram = w.grams(3)
    gram = gram ^ mix(w.doc[at].astype(U64))
    order = np.argsort(gram)
    same = gram[order][1:] == gram[order][:-1]
    twice = at[order[np.concatenate([same, [False]]) | np.concatenate([[False], same])]] if len(at) else at
    repeated = np.zeros(len(w.start), bool)
    for k in range(3):
        repeated[twice + k] = True
    lines = np.bincount(line_text, minlength=n)
    return {
        "n_words": w.counts,
        "word_chars": per_text(((a & 0xC0) != 0x80) & SPACED[a]),
        "n_symbols": per_text(SYMBOLS[a]),
        "n_dup_lines": lines - np.bincount(line_text[first], minlength=n),
        "n_repeat_words": np.bincount(w.doc[repeated], minlength=n),
        "n_lines": lines,
    }


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [c for c in batch.schema.names if c != "text"]
        for first, texts in chunks(batch):
            counts = text_counts(texts)
            part = batch.slice(first, len(texts))
            yield pa.RecordBatch.from_arrays(
                [part.column(part.schema.get_field_index(c)) for c in kept] + [pa.array(counts[c].astype(np.int64)) for c in COUNTS],
                names=[*kept, *COUNTS],
            )


def _counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole rows (doc) with the COUNTS of their texts."""
    for batch in batches:
        rows = batch.column(0)
        for first, texts in chunks(pa.RecordBatch.from_arrays([rows.field("text")], names=["text"])):
            counts = text_counts(texts)
            yield pa.RecordBatch.from_arrays([rows.slice(first, len(texts)), *(pa.array(counts[c].astype(np.int64)) for c in COUNTS)], names=["doc", *COUNTS])


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, text_hash) with the COUNTS of each text, stored."""
    rows = docs.select("doc_id", "lang", "source", F.xxhash64("text").alias("text_hash"), "text")
    schema = rows.drop("text").schema.simpleString()[7:-1] + "".join(f",{c}:bigint" for c in COUNTS)
    found = rows.mapInArrow(_counted, schema)
    return written(found.withColumn("base_failed", base_failed()), "quality-counts")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)


def ratios() -> dict[str, Column]:
    def thousandths(a: str, b: str) -> Column:
        return F.when(F.col(b) > 0, F.floor(F.col(a) * 1000 / F.col(b))).otherwise(0).cast("long")

    return {
        "mean_length": thousandths("word_chars", "n_words"),
        "symbols": thousandths("n_symbols", "n_words"),
        "dup_lines": thousandths("n_dup_lines", "n_lines"),
        "repeats": thousandths("n_repeat_words", "n_words"),
    }


def sketches(counts: DataFrame) -> DataFrame:
    """(lang, source, ratio, value, n): one histogram per group and ratio."""
    return (
        counts.filter(~F.col("base_failed"))
        .select("lang", "source", F.explode(F.create_map(*[x for k, v in ratios().items() for x in (F.lit(k), v)])).alias("ratio", "value"))
        .groupBy("lang", "source", "ratio", coarse(F.col("value")).alias("value"))
        .agg(F.count("*").alias("n"))
    )


def quartiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """Merges sketches to the group and reads rank ceil(n/4) and ceil(3n/4); a window holds one sketch."""
    merged = sketch.groupBy(*group, "ratio", "value").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*group, "ratio")
    ranked = merged.select(
        "*", F.sum("n").over(whole.orderBy("value")).alias("upto"), F.sum("n").over(whole).alias("all_n")
    )
    quantile = lambda k: F.min(F.when(F.col("upto") * 4 >= F.col("all_n") * k, F.col("value")))
    return ranked.groupBy(*group, "ratio").agg(F.max("all_n").alias("docs"), quantile(1).alias("q1"), quantile(3).alias("q3"))


def thresholds(sketch: DataFrame) -> DataFrame:
    """(lang, source) with a struct of low and high per ratio, of the group, its language and all."""
    own = quartiles(sketch, ["lang", "source"])
    language = quartiles(sketch, ["lang"]).select(F.col("lang").alias("l_lang"), F.col("ratio").alias("l_ratio"), F.struct("docs", "q1", "q3").alias("l"))
    total = quartiles(sketch, []).select(F.col("ratio").alias("t_ratio"), F.struct("docs", "q1", "q3").alias("t"))
    joined = own.join(language, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("ratio") == F.col("l_ratio"))).join(
        F.broadcast(total), F.col("ratio") == F.col("t_ratio")  # one row per ratio
    )
    drawn = lambda docs, own, to: f"({docs} * {own} + {PRIOR} * {to}) div ({docs} + {PRIOR})"
    pick = lambda c: F.expr(drawn("docs", c, "(" + drawn("l.docs", f"l.{c}", f"t.{c}") + ")"))
    least = F.create_map(*[F.lit(x) for kv in LEAST_RANGE.items() for x in kv])
    spread = F.greatest(F.col("p3") - F.col("p1"), least[F.col("ratio")]) * RANGES
    fences = joined.select("lang", "source", "ratio", pick("q1").alias("p1"), pick("q3").alias("p3")).select(
        "lang", "source", "ratio", F.struct((F.col("p1") - spread).alias("low"), (F.col("p3") + spread).alias("high")).alias("fence")
    )
    return fences.groupBy(F.col("lang").alias("t_lang"), F.col("source").alias("t_source")).agg(
        *[F.max(F.when(F.col("ratio") == k, F.col("fence"))).alias(f"t_{k}") for k in LEAST_RANGE]
    )


def judged(counts: DataFrame) -> DataFrame:
    """The counts with ``kept``.

    Thresholds are stored first, so that the join knows their size: Spark
    broadcasts them below its threshold and shuffles else, splitting hot groups.
    """
    return fenced(counts, written(thresholds(sketches(counts)), "quality-fences"))


def fenced(counts: DataFrame, fences: DataFrame) -> DataFrame:
    inside = F.lit(True)
    for k, value in ratios().items():
        upper = value <= F.col(f"t_{k}.high")
        inside = inside & F.coalesce(upper & (value >= F.col(f"t_{k}.low")) if k == "mean_length" else upper, F.lit(True))
    return counts.join(
        fences, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left"
    ).select(*counts.columns, (~F.col("base_failed") & inside).alias("kept"))


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, all columns.

    Texts are counted once more beside their rows, which costs less than a
    shuffle of all texts: rows meet only the table of thresholds.
    """
    fences = written(thresholds(sketches(counted(docs))), "quality-fences")
    row = F.struct(*[docs[c] for c in docs.columns]).alias("doc")
    schema = docs.select(row).schema
    for c in COUNTS:
        schema = schema.add(c, "long")
    rows = docs.select(row).mapInArrow(_counted_rows, schema).select("doc", "doc.lang", "doc.source", *COUNTS, base_failed().alias("base_failed"))
    return fenced(rows, fences).filter("kept").select("doc.*")


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judged(counted(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


_RATIO_SQL = """
  SELECT *, CAST(CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS BIGINT) AS mean_length,
    CAST(CASE WHEN n_words > 0 THEN n_symbols * 1000 // n_words ELSE 0 END AS BIGINT) AS symbols,
    CAST(CASE WHEN n_lines > 0 THEN n_dup_lines * 1000 // n_lines ELSE 0 END AS BIGINT) AS dup_lines,
    CAST(CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END AS BIGINT) AS repeats
"""


def _quartile_sql(name: str, group: str) -> str:
    g = group + ", " if group else ""
    return f"""{name} AS (
  SELECT {g}ratio, CAST(max(all_n) AS BIGINT) AS docs, min(value) FILTER (upto * 4 >= all_n) AS q1, min(value) FILTER (upto * 4 >= all_n * 3) AS q3
  FROM (SELECT {g}ratio, value, sum(n) OVER (PARTITION BY {g}ratio ORDER BY value) AS upto, sum(n) OVER (PARTITION BY {g}ratio) AS all_n
        FROM (SELECT {g}ratio, value, sum(n) AS n FROM sketch GROUP BY {g}ratio, value))
  GROUP BY {g}ratio)"""


OP10_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), words AS (
  SELECT rid, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM d
), windows AS (
  SELECT rid, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM words WINDOW o AS (PARTITION BY rid ORDER BY i)
), twice AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS c FROM windows WHERE g IS NOT NULL) WHERE c >= 2
), repeats AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid
), counts AS (
  SELECT d.rid, doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM d LEFT JOIN repeats USING (rid) LEFT JOIN lines USING (rid)
), based AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM ({_RATIO_SQL} FROM counts)
), sketch AS (
  SELECT lang, source, ratio, (value >> greatest(length(bin(value)) - 8, 0)::INT) << greatest(length(bin(value)) - 8, 0)::INT AS value, count(*) AS n
  FROM (SELECT lang, source, unnest(['mean_length', 'symbols', 'dup_lines', 'repeats']) AS ratio,
               unnest([mean_length, symbols, dup_lines, repeats]) AS value FROM based WHERE NOT base_failed) GROUP BY ALL
), {_quartile_sql("own", "lang, source")}, {_quartile_sql("language", "lang")}, {_quartile_sql("total", "")},
picked AS (
  SELECT o.lang, o.source, o.ratio,
    (o.docs * o.q1 + 200 * ((l.docs * l.q1 + 200 * t.q1) // (l.docs + 200))) // (o.docs + 200) AS p1,
    (o.docs * o.q3 + 200 * ((l.docs * l.q3 + 200 * t.q3) // (l.docs + 200))) // (o.docs + 200) AS p3,
    CASE o.ratio WHEN 'mean_length' THEN 500 WHEN 'symbols' THEN 50 ELSE 100 END AS least
  FROM own o JOIN language l ON o.lang IS NOT DISTINCT FROM l.lang AND o.ratio = l.ratio JOIN total t ON o.ratio = t.ratio
), fences AS (
  SELECT lang, source, ratio, p1 - 3 * greatest(p3 - p1, least) AS low, p3 + 3 * greatest(p3 - p1, least) AS high FROM picked
), outside AS (
  SELECT DISTINCT rid FROM based b JOIN fences f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
  WHERE (ratio = 'mean_length' AND (mean_length > high OR mean_length < low)) OR (ratio = 'symbols' AND symbols > high)
     OR (ratio = 'dup_lines' AND dup_lines > high) OR (ratio = 'repeats' AND repeats > high)
)
SELECT doc_id, n_words, word_chars, n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       base_failed, NOT base_failed AND rid NOT IN (SELECT rid FROM outside) AS kept FROM based
"""
