"""Importance resampling towards a target distribution, in DataFrame operations only.

Runs of one to two words are features, their crc32 modulo a fixed number the
bucket.  Bucket counts of all documents and of the target texts give each
bucket a gain; the gains, one row a bucket and so bounded by a parameter, are
broadcast to the exploded features of each document, whose sum is reduced
where the document lies and sent as one row.  Gumbel noise from a hash of the
id turns "the highest scores" into a draw without replacement.  The ranks come
from a range sort: a row's place in its partition, which the row id carries,
plus the rows of the partitions before it.

The words of a text are cut twice, once for the counts and once for the sums:
storing the buckets of all features would take about half of the texts' bytes.

Defined results: a null or empty text has no features and weight 0; a null
doc_id is hashed as an empty string and comes last among ties; equal scores
and ids go by fewer features first, what is still equal gives equal rows in any
order; very long texts are exploded row by row; without target texts all
target counts are 0; an empty table gives an empty result; other columns are
not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.llm._rows import semi
from trailmill.llm._scratch import written

BUCKETS = 10_000
SHARE = 25
LEAST_WORDS = 20
SEED = 7
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What stands between words, in either case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words in the text's own case; splitting costs a fifth of extracting, and words are lowered one by one."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lowered(word: Column) -> Column:
    """A-Z only; Spark's own lower() does that to texts without other letters."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def exploded(rows: DataFrame, buckets: int) -> DataFrame:
    """One row per feature of the array ``words``, with its ``bucket``: each word and it with the one after; null where there is none."""
    names = [c for c in rows.columns if c != "words"]
    after = F.slice("words", F.lit(2), F.size("words"))
    pairs = rows.select(*names, F.inline_outer(F.arrays_zip("words", after)).alias("word", "next"))
    low = pairs.select(*names, lowered(F.col("word")).alias("word"), lowered(F.col("next")).alias("next"))
    both = F.array(F.crc32("word"), F.crc32(F.concat("word", F.lit(" "), "next")))
    return low.select(*names, F.explode(both).alias("crc")).select(*names, (F.col("crc") % buckets).alias("bucket"))


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the features of all texts, summed in each task before they are sent."""
    one = exploded(texts.select(words(F.col("text")).alias("words")), buckets)
    return one.filter("bucket IS NOT NULL").groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket that the documents fill: at most ``buckets`` rows, stored."""
    counts = bucket_counts(docs, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    wanted = bucket_counts(target, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    both = written(counts.unionByName(wanted).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "resample-counts")
    whole = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    number = lambda x: F.lit(x).cast("double")
    s, t = F.col("s").cast("double"), F.col("t").cast("double")
    ratio = (t + 1) * number(whole["s"] + buckets) / ((s + 1) * number(whole["t"] + buckets))
    return both.filter("s > 0").select(F.col("bucket").alias("gain_bucket"), F.floor(F.lit(1000.0) * F.log(ratio)).alias("gain"))


def weighed(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight) of every document."""
    # The row is named by its place, so that repeated rows stay apart; the sum is whole in the task that cuts the text.
    cut = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("words")
    )
    one = exploded(cut.withColumn("n_words", F.size("words").cast("long")), buckets)
    # BUCKETS rows at most, whatever the data.
    met = one.join(F.broadcast(gains(docs, target, buckets)), F.col("bucket") == F.col("gain_bucket"), "left")
    summed = met.groupBy("row", "doc_id", "text_hash", "n_words").agg(
        F.count("bucket").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("total")
    )
    mean = F.expr("(total - pmod(total, greatest(n_features, 1L))) div greatest(n_features, 1L)")
    return summed.select("doc_id", "text_hash", "n_words", "n_features", mean.alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, a pure function of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, order: list[Column]) -> DataFrame:
    """Adds ``place`` (0, 1, 2...) in ``order``.

    The sorted rows are written once with the id that counts rows in each
    partition of the range sort, since its bounds are sampled per run; the row
    id of the input comes last in the order, so that equal rows spread.
    """
    names = scored.columns
    salted = scored.withColumn("salt", F.monotonically_increasing_id())
    ordered = salted.repartitionByRange(*order, F.col("salt")).sortWithinPartitions(*order, F.col("salt"))
    local = written(ordered.select(*names, F.monotonically_increasing_id().alias("at")), "resample-order")
    part = F.call_function("shiftright", F.col("at"), F.lit(33))
    sizes = local.groupBy(part.alias("part")).agg(F.count("*").alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition of the sort: a number the session sets, whatever the data.
    offsets = sizes.select("part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("before"))
    placed = local.withColumn("at_part", part).join(F.broadcast(offsets), F.col("at_part") == F.col("part"))
    return placed.select(*names, (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place"))


def resampled(
    docs: DataFrame, target: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED, buckets: int = BUCKETS
) -> DataFrame:
    """(doc_id, text_hash, n_words, n_features, weight, score, rank) of every document; rank is null where it is not drawn.

    ``share`` hundredths of the documents of ``least_words`` words and more are drawn.
    """
    scored = weighed(docs, target, buckets).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    scored = written(scored, "resample-scores")
    long_enough = F.col("n_words") >= least_words
    quota = share * scored.filter(long_enough).count() // 100
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features").asc()]
    placed = ranked(scored.filter(long_enough), order)
    drawn = placed.withColumn("rank", F.when(F.col("place") < quota, F.col("place") + 1)).drop("place")
    return drawn.unionByName(scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("long")))


def drawn_documents(docs: DataFrame, target: DataFrame, **rule) -> DataFrame:
    """The drawn documents with all their columns; rows equal in id and text are drawn together."""
    rows = resampled(docs, target, **rule).filter("rank IS NOT NULL").select("doc_id", "text_hash").distinct()
    return semi(docs, written(rows, "resample-drawn"))


def op13_resampling(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return resampled(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), '[^ ]+')"

#: DuckDB has no crc32: its table is 256 numbers of eight shifts each, and a text's value folds over its bytes.
OP13_SQL = rf"""
WITH crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)
), d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT {_WORDS} AS ws FROM benchmark),
f AS (
  SELECT rid, unnest(ws) AS f FROM d
  UNION ALL SELECT rid, ws[i] || ' ' || ws[i + 1] FROM (SELECT rid, ws, unnest(range(1, len(ws))) AS i FROM d)
), w AS (
  SELECT unnest(ws) AS f FROM b
  UNION ALL SELECT ws[i] || ' ' || ws[i + 1] FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM b)
), named AS (
  SELECT f, xor(4294967295::BIGINT, list_reduce(
           list_transform(range(1, strlen(f) * 2, 2), lambda i: ('0x' || substr(hex(encode(f)), i, 2))::BIGINT),
           lambda c, x: xor(t[1 + (xor(c, x) & 255)], c >> 8), 4294967295::BIGINT)) % 10000 AS bucket
  FROM (SELECT f FROM f UNION SELECT f FROM w), crc
), s AS (SELECT bucket, count(*) AS s FROM f JOIN named USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM w JOIN named USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000.0::DOUBLE * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM f) + 10000)::DOUBLE
         / ((s + 1)::DOUBLE * ((SELECT count(*) FROM w) + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM s LEFT JOIN t USING (bucket)
), sums AS (
  SELECT rid, count(*) AS n, CAST(sum(gain) AS BIGINT) AS total FROM f JOIN named USING (f) JOIN gains USING (bucket) GROUP BY rid
), scored AS (
  SELECT rid, doc_id, len(ws) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
         CAST(coalesce((total - ((total % n) + n) % n) // n, 0) AS BIGINT) AS weight,
         ('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT::DOUBLE AS h
  FROM d LEFT JOIN sums USING (rid)
), valued AS (
  SELECT *, CAST(weight + floor(-1000.0::DOUBLE * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored
), placed AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id ASC NULLS LAST, n_features) AS place FROM valued WHERE n_words >= 20
)
SELECT doc_id, n_features, weight, score,
       CAST(CASE WHEN place <= 25 * (SELECT count(*) FROM placed) // 100 THEN place END AS BIGINT) AS rank
FROM valued LEFT JOIN placed USING (rid)
"""
