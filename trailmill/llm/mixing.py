"""Mixing sources to target weights, in DataFrame operations only.

Words are summed per source, targets are filled up by weight under a cap, and
a source's repetition rate is target / size.  A document is taken floor(rate)
times, plus once more when a hash of its id and the seed, read as a number in
[0, 1), falls below the rate's fraction.  The decision is a pure function of
(seed, doc_id), so reruns and recomputed partitions agree.

Defined results: a null text has size 0; a null source is a source of its own,
last in order; a null doc_id hashes as the empty string; repeated rows are
decided alike; an empty table gives an empty result; an empty source has target 0;
very long texts are counted where they lie; no ties arise, as each id is decided
for itself; other columns are not touched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.llm._scratch import written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    The target is min(cap * size, level * weight) with the one level at which
    the targets add up to share * total: what repeated resharing of the excess
    ends in.  Sources sorted by cap * size / weight are capped up to some
    place; running sums give the level for every place.  From the first that fits on
    levels only fall, so the largest that fits is it.  Windows run over one row per source.
    """
    n = len(weights)
    ordered = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    weighed = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(ordered) - 1) % n + 1).cast("long")
    )
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = weighed.select(
        "*",
        (
            (F.lit(share) * F.sum("source_size").over(everything) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
            / F.sum("weight").over(after)
        ).alias("level_here"),
    )
    fits = F.when(F.col("level_here") * F.col("weight") <= F.lit(cap) * F.col("source_size"), F.col("level_here"))
    return levels.withColumn("level", F.max(fits).over(everything)).select(
        "source",
        "source_size",
        F.coalesce(F.least(F.lit(cap) * F.col("source_size"), F.col("level") * F.col("weight")), F.lit(cap) * F.col("source_size")).alias("target"),
    )


def copies(rate: Column, doc_id: Column, seed: str = SEED) -> Column:
    """floor(rate), plus one with probability equal to the fraction."""
    number = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("long")
    return F.floor(rate) + F.when(number < (rate - F.floor(rate)) * F.lit(4294967296.0), 1).otherwise(0)


def mix(sized: DataFrame, seed: str = SEED, **rule) -> DataFrame:
    """(doc_id, source, size) to those with source_size, target, n_copies.

    ``sized`` is read twice: pass a stored table.  The join with the sources
    carries no hint: their number has no bound, so Spark measures that side
    and broadcasts it only below its threshold; else hot sources are split by
    the adaptive skew join.
    """
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(per_source, **rule).withColumnRenamed("source", "goal_source")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return (
        sized.join(goal, F.col("source").eqNullSafe(F.col("goal_source")))
        .drop("goal_source")
        .withColumn("n_copies", copies(rate, F.col("doc_id"), seed).cast("int"))
    )


def sized_documents(docs: DataFrame) -> DataFrame:
    """Ids, sources and word counts, stored: texts are read and counted once."""
    return written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "mix-sizes")


def mixed_documents(docs: DataFrame, seed: str = SEED, **rule) -> DataFrame:
    """Each document as often as the mix takes it, all columns kept.

    Texts are not shuffled by source: the per-source rates join to the rows
    where they lie when they are few.
    """
    names = docs.columns
    counted = docs.withColumn("_mix_size", word_count(F.col("text")))
    sizes = written(counted.groupBy("source").agg(F.sum("_mix_size").alias("source_size")), "mix-sources")
    goal = targets(sizes, **rule).select(
        F.col("source").alias("_mix_source"),
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("_mix_rate"),
    )
    return (
        docs.join(goal, docs["source"].eqNullSafe(F.col("_mix_source")))
        .withColumn("_mix_copies", copies(F.col("_mix_rate"), docs["doc_id"], seed).cast("int"))
        .filter("_mix_copies > 0")
        .withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_copies"))))
        .select(*[docs[c] for c in names])
    )


def op1_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    mixed = mix(sized_documents(docs))
    return mixed.select("doc_id", "source", "size", "source_size", "target", "n_copies", (F.col("size") * F.col("n_copies")).alias("taken"))


OP1_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, [3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS INT)] AS weight FROM sources
), levels AS (
  SELECT *, (1.5 * sum(source_size) OVER () - 2.0 * coalesce(sum(source_size) OVER (
             ORDER BY source_size / weight, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
           / sum(weight) OVER (ORDER BY source_size / weight, source IS NULL, encode(source)
                               ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level_here
  FROM weighed
), levelled AS (
  SELECT *, max(CASE WHEN level_here * weight <= 2.0::DOUBLE * source_size THEN level_here END) OVER () AS level FROM levels
), goal AS (
  SELECT source, source_size,
         CAST(coalesce(least(2.0::DOUBLE * source_size, level * weight), 2.0::DOUBLE * source_size) AS DOUBLE) AS target FROM levelled
), rated AS (
  SELECT s.doc_id, s.source, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0.0::DOUBLE END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(CAST(s.doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS number
  FROM sized s JOIN goal g ON s.source IS NOT DISTINCT FROM g.source
), counted AS (
  SELECT *, CAST(floor(rate) + CASE WHEN number < (rate - floor(rate)) * 4294967296.0::DOUBLE THEN 1 ELSE 0 END AS INTEGER) AS n_copies FROM rated
)
SELECT doc_id, source, size, source_size, target, n_copies, CAST(size * n_copies AS BIGINT) AS taken FROM counted
"""
