"""Duplicates across sources, and what of an archive counts.

Recordings are (user_id, rec_id, at, elapsed_s, distance_m, has_sets).  Two are
of one activity when their starts and lengths differ by five minutes at most,
and their distances, if both are known, by 100 m or 3 % of the larger.  Starts
fall into half-hour buckets; a recording near a bucket's edge also gets the
bucket beyond it, so every pair shares a (user, bucket).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_S = 1800
START_S = 300
ELAPSED_S = 300
DISTANCE_M, DISTANCE_SHARE = 100.0, 0.03
#: Most pairs that a search for duplicates compares at once, and that a sweep does: these fit a core's cache.
PAIRS, SWEPT = 1_000_000, 200_000


def seconds(at: Column) -> Column:
    return F.unix_seconds(at.cast("timestamp"))


def buckets(at_s: Column) -> Column:
    """The bucket of a start, and the one before or after if it lies within the tolerance of that edge."""
    own, offset = F.floor(at_s / BUCKET_S).cast("long"), F.pmod(at_s, F.lit(BUCKET_S))
    beyond = F.when(offset < START_S, own - 1).when(offset >= BUCKET_S - START_S, own + 1)
    return F.array_compact(F.array(own, beyond))


def bucket_keys(recordings: DataFrame) -> DataFrame:
    """(rec_id, key): hashed bucket keys, for lookups that other systems make."""
    rows = recordings.select("rec_id", "user_id", F.explode(buckets(seconds(F.col("at")))).alias("bucket"))
    return rows.select("rec_id", F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.col("bucket").cast("string")), 256).alias("key"))


def far_apart(distance: np.ndarray, known: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the distances at a and b are both known and differ by more than the tolerance; NaN is above all and its own equal."""
    with np.errstate(invalid="ignore"):
        tolerance = np.maximum(DISTANCE_M, np.maximum(distance[a], distance[b]) * DISTANCE_SHARE)
        return known[a] & known[b] & ~((np.abs(distance[a] - distance[b]) <= tolerance) | np.isnan(tolerance))


def met_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(user_id, a, b) of rows (user_id, bucket, offset, own, rec_id, elapsed_s, distance_m) in order of the first three.

    Each own row meets those of its bucket that are up to the tolerance before
    it, SWEPT of them at once; of a batch only these wait for the next.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        old = sum(x.num_rows for x in held)
        (rows,) = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()
        user, ids = rows.column("user_id"), rows.column("rec_id")
        bucket, offset, own, elapsed, number = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "offset", "own", "elapsed_s", "rec_id"))
        distance, known = rows.column("distance_m").fill_null(0.0).to_numpy(), rows.column("distance_m").is_valid().to_numpy(zero_copy_only=False)
        new = np.ones(len(bucket), bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | pc.not_equal(user[1:], user[:-1]).to_numpy(zero_copy_only=False)
        line = np.cumsum(new) * (2 * BUCKET_S) + offset  # buckets in a row, too far from each other to meet
        low, at = np.searchsorted(line, line - START_S), np.arange(len(line))
        size = np.where(own & (at >= old), at - low, 0)
        ends = np.cumsum(size)
        first = old
        while first < len(line):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + SWEPT, side="right")))
            many = size[first:last]
            b = np.repeat(at[first:last], many)
            a = np.arange(len(b)) + np.repeat(low[first:last] - (np.cumsum(many) - many), many)
            first = last
            near = (np.abs(elapsed[a] - elapsed[b]) <= ELAPSED_S) & (number[a] != number[b])
            a, b = a[near], b[near]
            near = ~far_apart(distance, known, a, b)
            a, b = a[near], b[near]
            turned = number[a] > number[b]
            less, more = np.where(turned, b, a), np.where(turned, a, b)
            if len(a):
                yield pa.RecordBatch.from_arrays([user.take(pa.array(less)), ids.take(pa.array(less)), ids.take(pa.array(more))], names=["user_id", "a", "b"])
        held = [rows.slice(low[-1])]


def near_pairs(recordings: DataFrame, tasks: int = 0) -> DataFrame:
    """(user_id, a, b) with a < b; pairs only, no closure.

    A pair is met in the bucket of its later start, which the earlier one also
    gets if it lies within the tolerance before it; so no distinct is needed,
    and a user with most of the recordings spreads over their buckets.  Only
    recordings that start near each other are compared.  ``tasks``: over how many
    tasks buckets are dealt at least.
    """
    user, rec = (recordings.schema[c].dataType.simpleString() for c in ("user_id", "rec_id"))
    rows = recordings.filter("user_id IS NOT NULL AND rec_id IS NOT NULL AND at IS NOT NULL AND elapsed_s IS NOT NULL").withColumn("at_s", seconds(F.col("at")))
    bucket = lambda at_s: F.floor(at_s / BUCKET_S).cast("long")
    in_both = F.explode(F.array_distinct(F.array(bucket(F.col("at_s")), bucket(F.col("at_s") + START_S))))
    keyed = rows.withColumn("bucket", in_both).withColumn("offset", F.col("at_s") - F.col("bucket") * BUCKET_S)
    # The work is far more than the bytes: the number of tasks is given, lest small partitions be put together.
    n = max(tasks, int(recordings.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = keyed.select("user_id", "bucket", "offset", (F.col("offset") >= 0).alias("own"), "rec_id", "elapsed_s", F.col("distance_m").cast("double").alias("distance_m")).repartition(n, "user_id", "bucket")
    return dealt.sortWithinPartitions("user_id", "bucket", "offset").mapInArrow(met_pairs, f"user_id {user}, a {rec}, b {rec}")


def first_matches(at: np.ndarray, elapsed: np.ndarray, distance: np.ndarray, known: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each recording of one bucket, sorted by id, the place of the first with a smaller id that it matches, or -1.

    Recordings that are still without a match meet the next few in order of id,
    so a crowded bucket costs about as many comparisons as it takes to find one.
    """
    found = np.full(len(ids), -1)
    waiting, start, width = np.arange(len(ids)), 0, 16
    while len(waiting) and start < len(ids):
        a, end = np.arange(start, min(len(ids), start + width)), start + width
        for part in np.array_split(waiting, -(-len(waiting) * len(a) // PAIRS)):
            b = part[:, None]
            near = (ids[a] < ids[b]) & (np.abs(at[a] - at[b]) <= START_S) & (np.abs(elapsed[a] - elapsed[b]) <= ELAPSED_S)
            near &= ~far_apart(distance, known, a, b)
            found[part] = np.where(near.any(axis=1), start + near.argmax(axis=1), -1)
        waiting = waiting[(found[waiting] < 0) & (ids[waiting] > ids[a[-1]])]
        start, width = end, width * 2
    return found


def duplicate_of(recordings: DataFrame) -> DataFrame:
    """(rec_id, duplicate_of): the first earlier-numbered match; recordings with sets are never duplicates nor matched.

    Two that match share a bucket, so the first of a recording's one or two
    buckets is the first of all; pairs beyond it are not made.
    """
    kind = recordings.schema["rec_id"].dataType.simpleString()
    rows = recordings.filter("NOT has_sets AND user_id IS NOT NULL AND rec_id IS NOT NULL AND elapsed_s IS NOT NULL").withColumn("at_s", seconds(F.col("at")))
    keyed = rows.select("user_id", F.explode(buckets(F.col("at_s"))).alias("bucket"), "rec_id", "at_s", "elapsed_s", F.col("distance_m").cast("double").alias("distance_m"))

    def one(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("rec_id")
        distance, ids = bucket.column("distance_m"), bucket.column("rec_id").to_numpy()
        known = distance.is_valid().to_numpy()
        at = first_matches(bucket.column("at_s").to_numpy(), bucket.column("elapsed_s").to_numpy(), distance.fill_null(0.0).to_numpy(), known, ids)
        return pa.table({"rec_id": ids[at >= 0], "duplicate_of": ids[at[at >= 0]]})

    found = keyed.groupBy("user_id", "bucket").applyInArrow(one, f"rec_id {kind}, duplicate_of {kind}")
    return found.groupBy("rec_id").agg(F.min("duplicate_of").alias("duplicate_of"))


def absent(rows: DataFrame, archive: DataFrame, key: str) -> DataFrame:
    """Put if absent: the rows whose key the archive lacks; of equal keys the first by time."""
    new = rows.join(archive.select(key), key, "left_anti")
    return new.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("at"))).filter("place = 1").drop("place")


def newest_for_replay(objects: DataFrame) -> DataFrame:
    """(activity, key): the newest object, ties to the smaller key."""
    return objects.groupBy("activity").agg(F.min(F.struct((-F.unix_micros(F.col("modified").cast("timestamp"))).alias("m"), "key")).alias("x")).select("activity", F.col("x.key").alias("key"))


def newest_for_rebuild(objects: DataFrame) -> DataFrame:
    """(activity, key): the newest object, ties to the larger key, the other way than a replay."""
    return objects.groupBy("activity").agg(F.max(F.struct("modified", "key")).alias("x")).select("activity", F.col("x.key").alias("key"))


def listing_class(path: Column) -> Column:
    """What an archive path holds: payload, override, duplicate, retraction, or nothing known."""
    head = "^raw/[^/]+/[^/]+/"
    return (
        F.when(path.rlike(head + r"[^/]+\.duplicate-of\.json$"), "duplicate")
        .when(path.rlike(head + r"[^/]+\.retracted\.json$"), "retraction")
        .when(path.rlike(head + r"[^/]+\.kind-override/[^/]+\.json$"), "override")
        .when(path.rlike(head + r"[^/]+/[0-9a-f]{64}\.[a-z]+$"), "payload")
        .otherwise("unrecognised")
    )


def with_overrides(activities: DataFrame, overrides: DataFrame) -> DataFrame:
    """Activities with the newest override of their kind (by id); the kind they came with stays as derived_kind."""
    newest = overrides.groupBy(F.col("activity_id").alias("o_activity")).agg(F.max_by("kind", "override_id").alias("o_kind"))
    joined = activities.join(newest, F.col("activity_id") == F.col("o_activity"), "left")
    return joined.withColumn("derived_kind", F.col("kind")).withColumn("kind", F.coalesce("o_kind", "kind")).drop("o_activity", "o_kind")
