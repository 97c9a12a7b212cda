"""Queries of the recounting operators, with their SQL."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from trailmill.functions import geo
from trailmill.operators import discovery as d
from trailmill.operators import grid
from trailmill.operators import recount as r
from trailmill.plans import scoring
from trailmill.plans.discovery import CLASSIFIED_SQL
from trailmill.sources.tables import ACTIVITIES_SQL, POINTS_SQL, LEDGER_SQL, activities, ledger_entries, points, table, visits

#: Lowest zooms of the resolutions shown.
ZOOMS = ((0.0, 5), (9.0, 7), (11.5, 8), (13.0, 9), (14.5, 10), (16.0, 11))


def scored_history(spark, sf_dir):
    return d.awards(r.score_history(visits(spark, sf_dir), activities(spark, sf_dir)), "user_id")


def retraction(spark, sf_dir):
    a = activities(spark, sf_dir)
    gone = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("activity_id"))
    return r.retracted(a, gone).groupBy("user_id", "status").agg(F.count("*").alias("n"))


def class_audit(spark, sf_dir):
    """Stored counts off by one for some activities, and one more without any visit."""
    c = d.classify_history(visits(spark, sf_dir))
    stored = c.groupBy("activity_id").agg(
        (F.count_if(F.col("class") == "new") + (F.col("activity_id") % 97 == 0).cast("int")).alias("new_cells"), (F.count_if(F.col("class") == "rearmed") + (F.col("activity_id") % 89 == 0).cast("int")).alias("rearmed_cells")
    )
    return r.class_audit(stored, c)


def failed_receipts(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 9).alias("user_id"), F.col("event_id").alias("receipt_id"), F.col("ts").alias("at"), F.when(F.col("event_type") == "error", "FAILED").otherwise(F.when(F.col("event_id") % 3 == 0, "FAILED").otherwise("DONE")).alias("status")
    )
    return r.failed_receipts(rows).select("user_id", "receipt_id", F.col("place").cast("long").alias("place"))


def workout_lines(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("pos"), F.concat(F.lit("set "), F.col("l_returnflag")).alias("label"), F.when(k == 1, (F.col("l_quantity") * 100).cast("int")).alias("reps"),
        F.when(k == 2, (F.col("l_quantity") * 137).cast("int")).alias("duration_s"), F.when(k == 3, F.col("l_quantity") * 250).alias("distance_m")
    )
    return r.workout_summary(rows, "l_orderkey")


def _steps(spark, sf_dir):
    s = r.segments(points(spark, sf_dir), "user_id")
    s = s.withColumn("m", geo.metres(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng")))
    return s.withColumn("so_far", F.sum("m").over(Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))


def credited_counts(spark, sf_dir):
    return r.credited_counts(scoring.ledger(spark, sf_dir))


def rules_versions(spark, sf_dir):
    """Ledger lines of a user and skill as its states; manual activities leave none, so some users have none."""
    states = ledger_entries(spark, sf_dir).groupBy("user_id", "skill").agg(F.max(F.when(F.col("line") < 4, F.col("rules_version"))).alias("rules_version"))
    return r.rules_version(states.filter("user_id % 4 > 0").unionByName(states.filter("user_id % 4 = 0").withColumn("rules_version", F.lit(None).cast("int"))), 6)


def zoom_resolutions(spark, sf_dir):
    """Events' values as zooms; rungs are met exactly by some."""
    zoom = F.floor(F.col("value")) / 4
    return table(spark, sf_dir, "events").select("event_id", zoom.alias("zoom"), grid.zoom_resolution(zoom, ZOOMS).alias("res"))


def beside_walks(spark, sf_dir):
    p = points(spark, sf_dir)
    middle = p.groupBy("user_id").agg(((F.min("lat") + F.max("lat")) / 2 + 0.003).alias("lat"), ((F.min("lng") + F.max("lng")) / 2).alias("lng"))
    return r.beside_walks(middle, r.segments(p, "user_id"), "user_id").select("user_id", F.round("m", 2).alias("m"))


def walk_shares(spark, sf_dir):
    return r.at_shares(_steps(spark, sf_dir), (0.25, 0.5, 0.8), "user_id").select("user_id", "share", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"))


QUERIES = {f.__name__: f for f in (scored_history, retraction, class_audit, failed_receipts, workout_lines, credited_counts, rules_versions, zoom_resolutions, beside_walks, walk_shares)}

_COUNTS = "count(*) FILTER (class = 'new') AS new_cells, count(*) FILTER (class = 'cooled') AS cooled_cells, count(*) FILTER (class = 'rearmed') AS rearmed_cells"
_SEGMENTS = f"p AS ({POINTS_SQL}), s AS (SELECT * FROM (SELECT user_id, seq, lat, lng, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY seq)) WHERE lat0 IS NOT NULL)"

ORACLE_SQL = {
    "scored_history": f"WITH {CLASSIFIED_SQL}, a AS ({ACTIVITIES_SQL}) SELECT user_id, {_COUNTS} FROM classified WHERE activity_id IN (SELECT activity_id FROM a WHERE status <> 'TOMBSTONED') GROUP BY 1",
    "retraction": f"""WITH a AS ({ACTIVITIES_SQL}), g AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
      SELECT user_id, CASE WHEN l_orderkey IS NOT NULL THEN 'TOMBSTONED' ELSE status END AS status, count(*) AS n FROM a LEFT JOIN g ON activity_id = l_orderkey GROUP BY 1, 2""",
    "class_audit": f"""WITH {CLASSIFIED_SQL}, c AS (SELECT activity_id, count(*) FILTER (class = 'new') AS n, count(*) FILTER (class = 'rearmed') AS r FROM classified GROUP BY 1)
      SELECT activity_id, n + CAST(activity_id % 97 = 0 AS INT) AS new_cells, r + CAST(activity_id % 89 = 0 AS INT) AS rearmed_cells, n AS found_new, r AS found_rearmed FROM c WHERE activity_id % 97 = 0 OR activity_id % 89 = 0""",
    "failed_receipts": """SELECT * FROM (SELECT user_id % 9 AS user_id, event_id AS receipt_id, row_number() OVER (PARTITION BY user_id % 9 ORDER BY ts DESC, event_id) AS place
      FROM events WHERE event_type = 'error' OR event_id % 3 = 0) WHERE place <= 25""",
    "workout_lines": """WITH t AS (SELECT *, CAST(l_quantity * 137 AS BIGINT) AS d FROM lineitem), s AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 3 THEN printf('%.2f', l_quantity * 250 / 1000) || ' km '
        WHEN 1 THEN format('{:,}', CAST(l_quantity * 100 AS BIGINT)) || ' ' WHEN 2 THEN CASE WHEN d >= 3600 THEN printf('%d:%02d:%02d', d // 3600, d // 60 % 60, d % 60) ELSE printf('%d:%02d', d // 60, d % 60) END || ' ' ELSE '' END || 'set ' || l_returnflag AS s FROM t)
      SELECT l_orderkey, string_agg(s, ', ' ORDER BY l_linenumber, s) AS summary FROM s GROUP BY 1""",
    "credited_counts": f"""WITH {scoring.LEDGER_SQL} SELECT activity_id, CAST(coalesce(max(units) FILTER (reason = 'cells_new'), 0) AS BIGINT) AS credited_new, CAST(coalesce(max(units) FILTER (reason = 'cells_rearmed'), 0) AS BIGINT) AS credited_rearmed FROM ledger GROUP BY 1""",
    "rules_versions": f"SELECT user_id, CASE WHEN user_id % 4 > 0 THEN coalesce(max(rules_version) FILTER (line < 4), 6) ELSE 6 END AS version FROM ({LEDGER_SQL}) GROUP BY 1",
    "zoom_resolutions": f"SELECT event_id, floor(value) / 4 AS zoom, CASE {' '.join(f'WHEN floor(value) / 4 >= {b} THEN {n}' for b, n in reversed(ZOOMS))} ELSE {ZOOMS[0][1]} END AS res FROM events",
    "beside_walks": f"""WITH {_SEGMENTS}, c AS (SELECT user_id, (min(lat) + max(lat)) / 2 + 0.003::DOUBLE AS la, (min(lng) + max(lng)) / 2 AS ln FROM p GROUP BY 1),
      x AS (SELECT s.user_id, radians(lng0 - ln) * cos(radians(la)) * 6371008.8 AS ax, radians(lat0 - la) * 6371008.8 AS ay, radians(lng - ln) * cos(radians(la)) * 6371008.8 AS bx, radians(lat - la) * 6371008.8 AS byy FROM s JOIN c ON s.user_id = c.user_id),
      f AS (SELECT *, (bx - ax) ** 2 + (byy - ay) ** 2 AS l, greatest(0, least(1, -(ax * (bx - ax) + ay * (byy - ay)) / nullif((bx - ax) ** 2 + (byy - ay) ** 2, 0))) AS t FROM x)
      SELECT user_id, round(min(sqrt((ax + coalesce(t, 0) * (bx - ax)) ** 2 + (ay + coalesce(t, 0) * (byy - ay)) ** 2)), 2) AS m FROM f GROUP BY 1""",
    "walk_shares": f"""WITH {_SEGMENTS}, m AS (SELECT *, 2 * 6371008.8 * asin(least(1, sqrt(sin(radians(lat - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat)) * sin(radians(lng - lng0) / 2) ** 2))) AS m FROM s),
      t AS (SELECT *, sum(m) OVER (PARTITION BY user_id ORDER BY seq) AS so_far, sum(m) OVER (PARTITION BY user_id) AS total, unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.8::DOUBLE]) AS share FROM m)
      SELECT user_id, share, round(lat0 + (lat - lat0) * ((share * total - (so_far - m)) / m), 5) AS lat, round(lng0 + (lng - lng0) * ((share * total - (so_far - m)) / m), 5) AS lng
      FROM t WHERE m > 0 AND so_far - m < share * total AND share * total <= so_far""",
}
