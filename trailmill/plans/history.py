"""Queries of deduplication, archive and chronicle operators, with their SQL."""

from pyspark.sql import functions as F

from trailmill.operators import chronicle as c
from trailmill.operators import dedupe as d
from trailmill.operators import discovery
from trailmill.plans.discovery import CLASSIFIED_SQL, classified
from trailmill.sources.tables import STARTED_SQL, ACTIVITIES_SQL, RECORDINGS_SQL, activities, recordings, tasks

#: Each is paired with all near it, so tasks go by fewer than they would sort.
RECORDINGS_A_TASK = 100_000

#: A small sentence table of this engine's own; tables are data and any can be given.
SENTENCES = [
    {"id": "plain", "rank": 0, "when": {}, "text": "Run {activity_id}."},
    {"id": "ground", "rank": 1, "when": {"new_cells": {"gte": 2}}, "text": "{new_cells:Words} new cells."},
    {"id": "ground-2", "rank": 1, "when": {"new_cells": {"gte": 2}}, "text": "New cells: {new_cells}."},
    {"id": "road", "rank": 2, "when": {"road_count": {"in": [10, 25, 50, 100, 250, 500]}}, "text": "The {road_count:ordinal} road."},
    {"id": "year", "rank": 3, "when": {"longest_in_year": {"eq": 1}}, "text": "The longest road in a year."},
    {"id": "ever", "rank": 4, "when": {"longest_ever": {"eq": 1}, "leagues": {"gt": 0}}, "text": "The longest road yet."},
]


def bucket_keys(spark, sf_dir):
    return d.bucket_keys(recordings(spark, sf_dir))


def band_dedupe(spark, sf_dir):
    return d.near_pairs(recordings(spark, sf_dir), tasks(spark, sf_dir, "events", RECORDINGS_A_TASK))


def duplicate_lookup(spark, sf_dir):
    return d.duplicate_of(recordings(spark, sf_dir))


def put_if_absent(spark, sf_dir):
    rows = recordings(spark, sf_dir).withColumn("key", F.col("rec_id") % 700)
    return d.absent(rows, rows.filter("key % 3 = 0").select("key").distinct(), "key").select("key", "at")


def _objects(spark, sf_dir):
    return activities(spark, sf_dir).select((F.col("activity_id") % 500).alias("activity"), F.col("activity_id").cast("string").alias("key"), F.trunc("started_at", "month").cast("timestamp_ntz").alias("modified"))


def newest_for_replay(spark, sf_dir):
    return d.newest_for_replay(_objects(spark, sf_dir))


def newest_payload(spark, sf_dir):
    return d.newest_for_rebuild(_objects(spark, sf_dir))


def archive_listing(spark, sf_dir):
    """Objects by class and user."""
    i, u = F.col("activity_id"), F.col("user_id")
    tail = (
        F.when(i % 7 == 0, F.concat(i.cast("string"), F.lit(".duplicate-of.json")))
        .when(i % 7 == 1, F.concat(i.cast("string"), F.lit(".retracted.json")))
        .when(i % 7 == 2, F.concat(i.cast("string"), F.lit(".kind-override/9.json")))
        .when(i % 7 == 3, F.concat(i.cast("string"), F.lit(".txt")))
        .otherwise(F.concat(i.cast("string"), F.lit("/"), F.sha2(i.cast("string"), 256), F.lit(".json")))
    )
    path = F.concat(F.lit("raw/u"), u.cast("string"), F.lit("/watch/"), tail)
    return activities(spark, sf_dir).select("user_id", d.listing_class(path).alias("kind")).groupBy("user_id", "kind").agg(F.count("*").alias("n"))


def kind_overrides(spark, sf_dir):
    rows = activities(spark, sf_dir)
    overrides = rows.filter("activity_id % 10 < 2").select(
        F.floor(F.col("activity_id") / 20).alias("o"), (F.floor(F.col("activity_id") / 20) * 20).alias("activity_id"), F.col("activity_id").alias("override_id"), F.col("kind")
    ).drop("o")
    return d.with_overrides(rows, overrides).filter("kind <> derived_kind").select("activity_id", "kind", "derived_kind")


def _runs(spark, sf_dir):
    new = discovery.awards(classified(spark, sf_dir), "activity_id").select(F.col("activity_id").alias("a"), F.col("new_cells"))
    rows = activities(spark, sf_dir).withColumn("distance_m", F.when(F.col("activity_id") % 6 > 0, F.col("distance_m")))
    return rows.join(new, F.col("activity_id") == F.col("a"), "left").select("user_id", "activity_id", "started_at", F.coalesce("new_cells", F.lit(0)).alias("new_cells"), "distance_m")


def chronicle_facts(spark, sf_dir):
    return c.facts(_runs(spark, sf_dir)).withColumn("leagues", F.round("leagues", 4))


def chronicle_pick(spark, sf_dir):
    names = ("activity_id", "new_cells", "road_count")
    return c.pick(c.facts(_runs(spark, sf_dir)), SENTENCES, names).select("activity_id", "row_id", F.col("sentence"))


QUERIES = {
    f.__name__: f
    for f in (bucket_keys, band_dedupe, duplicate_lookup, put_if_absent, newest_for_replay, newest_payload, archive_listing, kind_overrides, chronicle_facts, chronicle_pick)
}

_REC = f"r AS (SELECT *, epoch_us(at_) // 1000000 AS s FROM ({RECORDINGS_SQL}))"
_SAME = """abs(a.s - b.s) <= 300 AND abs(a.elapsed_s - b.elapsed_s) <= 300 AND (a.distance_m IS NULL OR b.distance_m IS NULL
  OR abs(a.distance_m - b.distance_m) <= greatest(100, 0.03::DOUBLE * greatest(a.distance_m, b.distance_m)))"""
_OBJECTS = f"o AS (SELECT o_orderkey % 500 AS activity, CAST(o_orderkey AS VARCHAR) AS key, date_trunc('month', {STARTED_SQL}) AS modified FROM orders)"
_FACTS = f"""WITH {CLASSIFIED_SQL}, n AS (SELECT activity_id, count(*) FILTER (class = 'new') AS new_cells FROM classified GROUP BY 1), a AS ({ACTIVITIES_SQL}),
  runs AS (SELECT a.user_id, a.activity_id, a.started_at, epoch_us(a.started_at) AS t, coalesce(new_cells, 0) AS new_cells,
    CASE WHEN a.activity_id % 6 > 0 AND distance_m > 0 THEN distance_m END AS road FROM a LEFT JOIN n ON a.activity_id = n.activity_id),
  k AS (SELECT *, CAST(coalesce(sum(new_cells) OVER b, 0) AS BIGINT) AS cells_before, count(road) OVER b AS roads_before, coalesce(sum(road) OVER b, 0) AS metres_before, max(road) OVER b AS longest,
      count(road) OVER y + count(road) OVER i AS n_year, greatest(max(road) OVER y, max(road) OVER i) AS longest_year FROM runs
    WINDOW b AS (PARTITION BY user_id ORDER BY started_at, activity_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
      y AS (PARTITION BY user_id ORDER BY t RANGE BETWEEN {c.YEAR_US} PRECEDING AND 1 PRECEDING),
      i AS (PARTITION BY user_id, t ORDER BY activity_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  facts AS (SELECT user_id, activity_id, started_at, new_cells, cells_before, CASE WHEN road IS NOT NULL THEN roads_before + 1 END AS road_count,
    CASE WHEN road IS NOT NULL THEN (metres_before + road) / {c.LEAGUE_M}::DOUBLE END AS leagues,
    CASE WHEN road IS NOT NULL AND n_year >= 8 AND longest_year < road THEN 1 ELSE 0 END AS longest_in_year,
    CASE WHEN road IS NOT NULL AND roads_before >= 20 AND longest < road THEN 1 ELSE 0 END AS longest_ever FROM k)"""

ORACLE_SQL = {
    "bucket_keys": f"""WITH {_REC}, k AS (SELECT rec_id, user_id, s // 1800 AS b FROM r UNION ALL SELECT rec_id, user_id, s // 1800 - 1 FROM r WHERE s % 1800 < 300
      UNION ALL SELECT rec_id, user_id, s // 1800 + 1 FROM r WHERE s % 1800 >= 1500) SELECT rec_id, sha256(user_id || ':' || b) AS key FROM k""",
    "band_dedupe": f"WITH {_REC} SELECT a.user_id, a.rec_id AS a, b.rec_id AS b FROM r a JOIN r b ON a.user_id = b.user_id AND a.rec_id < b.rec_id AND {_SAME}",
    "duplicate_lookup": f"""WITH {_REC} SELECT b.rec_id, min(a.rec_id) AS duplicate_of FROM r a JOIN r b ON a.user_id = b.user_id AND a.rec_id < b.rec_id
      AND NOT a.has_sets AND NOT b.has_sets AND {_SAME} GROUP BY 1""",
    "put_if_absent": f"WITH {_REC} SELECT rec_id % 700 AS key, min(at_) AS \"at\" FROM r WHERE rec_id % 700 % 3 <> 0 GROUP BY 1",
    "newest_for_replay": f"WITH {_OBJECTS} SELECT activity, min_by(key, (-epoch_us(modified), key)) AS key FROM o GROUP BY 1",
    "newest_payload": f"WITH {_OBJECTS} SELECT activity, max_by(key, (epoch_us(modified), key)) AS key FROM o GROUP BY 1",
    "archive_listing": """SELECT o_custkey % 20 AS user_id, CASE o_orderkey % 7 WHEN 0 THEN 'duplicate' WHEN 1 THEN 'retraction' WHEN 2 THEN 'override' WHEN 3 THEN 'unrecognised' ELSE 'payload' END AS kind,
      count(*) AS n FROM orders GROUP BY 1, 2""",
    "kind_overrides": f"""WITH a AS ({ACTIVITIES_SQL}), o AS (SELECT activity_id // 20 * 20 AS id, max_by(kind, activity_id) AS kind FROM a WHERE activity_id % 10 < 2 GROUP BY 1)
      SELECT a.activity_id, o.kind, a.kind AS derived_kind FROM a JOIN o ON a.activity_id = o.id WHERE o.kind <> a.kind""",
    "chronicle_facts": f"{_FACTS} SELECT * REPLACE (round(leagues, 4) AS leagues) FROM facts",
}
