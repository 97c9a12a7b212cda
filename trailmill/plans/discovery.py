"""Queries of the discovery operators, with their SQL."""

import functools

from pyspark.sql import functions as F

from trailmill.operators import discovery as d
from trailmill.operators import grid
from trailmill.operators.rearm import first_to_rearm
from trailmill.sources.tables import VISITS_SQL, spread, tasks, visits

#: Stand-in parents: cells of a parent at resolutions 8, 7 and 6.
LEVELS = {8: 7, 7: 49, 6: 343}

CLASSIFIED_SQL = f"""visits AS ({VISITS_SQL}), classified AS (
  SELECT *, CASE WHEN previous_at IS NULL THEN 'new' WHEN started_at - previous_at < INTERVAL 183 DAY THEN 'cooled' ELSE 'rearmed' END AS class
  FROM (SELECT *, lag(started_at) OVER (PARTITION BY user_id, cell ORDER BY started_at, activity_id) AS previous_at FROM visits))"""

STATE_SQL = f"""{CLASSIFIED_SQL}, state AS (
  SELECT user_id, cell, min(started_at) AS first_run_at, min_by(activity_id, (started_at, activity_id)) AS first_run_id,
    max(started_at) AS last_run_at, min_by(activity_id, (-epoch_us(started_at), activity_id)) AS last_run_id,
    count(*) AS visit_count, count(*) FILTER (class <> 'cooled') AS discovery_count
  FROM classified GROUP BY user_id, cell)"""


def classified(spark, sf_dir):
    return d.classify_history(spread(visits(spark, sf_dir), tasks(spark, sf_dir, "lineitem"), "user_id", "cell"))


def discovery_fold(spark, sf_dir):
    return d.awards(classified(spark, sf_dir), "user_id", "activity_id")


def visit_classes(spark, sf_dir):
    return classified(spark, sf_dir).select("user_id", "activity_id", "cell", "class", d.days_between(F.col("previous_at"), F.col("started_at")).alias("days_since"))


def award_totals(spark, sf_dir):
    return d.awards(classified(spark, sf_dir), "user_id")


def cell_state(spark, sf_dir):
    return d.cell_state(classified(spark, sf_dir))


def parent_rollup(spark, sf_dir):
    return d.parent_rollup(visits(spark, sf_dir).select("user_id", "cell").distinct(), LEVELS)


def touched_parents(spark, sf_dir):
    return d.touched_parents(visits(spark, sf_dir), LEVELS)


def parent_updates(spark, sf_dir):
    return d.parent_updates(classified(spark, sf_dir), 7)


def batch_against_state(spark, sf_dir):
    """Odd activities classified against the state that even ones left; earlier ones are deferred."""
    v = visits(spark, sf_dir)
    state = d.cell_state(d.classify_history(v.filter("activity_id % 2 = 0")))
    return d.classify_against(v.filter("activity_id % 2 = 1"), state).groupBy("user_id", "class").agg(F.count("*").alias("n"))


def state_merge(spark, sf_dir):
    v = visits(spark, sf_dir)
    stored = d.cell_state(d.classify_history(v.filter("activity_id % 3 <> 0")))
    return d.merge_state(stored, d.cell_state(d.classify_history(v)))


def cell_merge(spark, sf_dir):
    v = visits(spark, sf_dir)
    base = v.filter("activity_id % 4 <> 0").groupBy("user_id", "cell").agg(F.max(d.day_number(F.col("started_at"))).alias("last_day"))
    return d.merge_cells(base, v.filter("activity_id % 4 = 0"), F.lit(500))


def added_cells(spark, sf_dir):
    """After EXCEPT before."""
    v = visits(spark, sf_dir)
    after = v.select("user_id", "cell").distinct()
    return after.join(v.filter("activity_id % 4 <> 0").select("user_id", "cell").distinct(), ["user_id", "cell"], "left_anti")


def set_divergence(spark, sf_dir):
    """Symmetric difference over union of the cells of two halves, per user."""
    v = visits(spark, sf_dir)
    sides = v.groupBy("user_id", "cell").agg(F.max((F.col("activity_id") % 2 == 0).cast("int")).alias("a"), F.max((F.col("activity_id") % 2 == 1).cast("int")).alias("b"))
    return sides.groupBy("user_id").agg(
        F.sum(F.when(F.col("a") != F.col("b"), 1).otherwise(0)).alias("differing"), F.count("*").alias("all_cells"),
        F.round(F.sum(F.when(F.col("a") != F.col("b"), 1).otherwise(0)) / F.count("*"), 6).alias("divergence"),
    )


def delta_expiry(spark, sf_dir):
    """Generations per user, one a run, and which of their deltas have expired: all but the last 20."""
    runs = visits(spark, sf_dir).groupBy("user_id").agg(F.count_distinct("activity_id").alias("generation"))
    gone = F.sequence(F.lit(1).cast("long"), F.col("generation") - 20)
    return runs.filter("generation > 20").select("user_id", F.explode(gone).alias("expired"))


def run_classes(spark, sf_dir):
    return d.run_classes(classified(spark, sf_dir))


def rearm_soon(spark, sf_dir):
    return first_to_rearm(visits(spark, sf_dir), functools.partial(grid.discs_of, k=d.NEAR_RINGS))


def frontier_cells(spark, sf_dir):
    """Of the ground of each run, which stands in for a user's."""
    cells = visits(spark, sf_dir).select(F.col("activity_id").alias("user_id"), "cell")
    return grid.edge_cells(cells).groupBy("user_id").agg(F.count("*").alias("edge_cells"))


def bridge_pairs(spark, sf_dir):
    cells = visits(spark, sf_dir).select(F.col("activity_id").alias("user_id"), "cell")
    return grid.bridges(cells).select("user_id", F.col("cell").alias("a"), F.col("other").alias("b"))


NEIGHBOURS_SQL = """offsets AS (SELECT * FROM (VALUES (1, 0), (-1, 0), (0, 1), (0, -1), (1, -1), (-1, 1)) t(dq, dr))"""

QUERIES = {
    f.__name__: f
    for f in (
        discovery_fold, visit_classes, award_totals, cell_state, parent_rollup, touched_parents, parent_updates, batch_against_state, state_merge,
        cell_merge, added_cells, set_divergence, delta_expiry, run_classes, rearm_soon, frontier_cells, bridge_pairs,
    )
}

_COUNTS = "count(*) FILTER (class = 'new') AS new_cells, count(*) FILTER (class = 'cooled') AS cooled_cells, count(*) FILTER (class = 'rearmed') AS rearmed_cells"


def _state_of(where: str, name: str) -> str:
    return f"""{name} AS (SELECT user_id, cell, min(started_at) AS first_run_at, min_by(activity_id, (started_at, activity_id)) AS first_run_id,
      max(started_at) AS last_run_at, min_by(activity_id, (-epoch_us(started_at), activity_id)) AS last_run_id, count(*) AS visit_count,
      count(*) FILTER (class <> 'cooled') AS discovery_count
    FROM (SELECT *, CASE WHEN p IS NULL THEN 'new' WHEN started_at - p < INTERVAL 183 DAY THEN 'cooled' ELSE 'rearmed' END AS class
      FROM (SELECT *, lag(started_at) OVER (PARTITION BY user_id, cell ORDER BY started_at, activity_id) AS p FROM visits WHERE {where}))
    GROUP BY user_id, cell)"""


ORACLE_SQL = {
    "discovery_fold": f"WITH {CLASSIFIED_SQL} SELECT user_id, activity_id, {_COUNTS} FROM classified GROUP BY user_id, activity_id",
    "visit_classes": f"WITH {CLASSIFIED_SQL} SELECT user_id, activity_id, cell, class, (epoch_ms(started_at) - epoch_ms(previous_at)) // 86400000 AS days_since FROM classified",
    "award_totals": f"WITH {CLASSIFIED_SQL} SELECT user_id, {_COUNTS} FROM classified GROUP BY user_id",
    "cell_state": f"WITH {STATE_SQL} SELECT * FROM state",
    "parent_rollup": f"""WITH c AS (SELECT DISTINCT user_id, cell FROM ({VISITS_SQL}))
      SELECT user_id, res, parent, n, round(n / size, 6) AS fraction FROM (
        SELECT user_id, CAST(res AS INT) AS res, size, cell // size AS parent, count(*) AS n
        FROM c, (VALUES (8, 7), (7, 49), (6, 343)) t(res, size) GROUP BY ALL)""",
    "touched_parents": f"""SELECT DISTINCT user_id, CAST(res AS INT) AS res, cell // size AS parent
      FROM ({VISITS_SQL}), (VALUES (8, 7), (7, 49), (6, 343)) t(res, size)""",
    "parent_updates": f"""WITH {CLASSIFIED_SQL} SELECT user_id, cell // 7 AS parent, count(*) FILTER (class = 'new') AS added,
      CAST(max(greatest(0, least(65535, date_diff('day', DATE '2020-01-01', started_at)))) AS INT) AS last_day FROM classified GROUP BY 1, 2""",
    "batch_against_state": f"""WITH visits AS ({VISITS_SQL}), s AS (SELECT user_id, cell, max(started_at) AS last_run_at FROM visits WHERE activity_id % 2 = 0 GROUP BY 1, 2)
      SELECT user_id, class, count(*) AS n FROM (SELECT v.user_id, CASE WHEN started_at < last_run_at THEN 'deferred' WHEN last_run_at IS NULL THEN 'new'
        WHEN started_at - last_run_at < INTERVAL 183 DAY THEN 'cooled' ELSE 'rearmed' END AS class
        FROM visits v LEFT JOIN s ON v.user_id = s.user_id AND v.cell = s.cell WHERE activity_id % 2 = 1) GROUP BY 1, 2""",
    "state_merge": f"""WITH visits AS ({VISITS_SQL}), {_state_of("activity_id % 3 <> 0", "s")}, {_state_of("true", "f")}
      SELECT * FROM (SELECT f.user_id, f.cell,
        CASE WHEN s.first_run_at <= f.first_run_at THEN s.first_run_at ELSE f.first_run_at END AS first_run_at,
        CASE WHEN s.first_run_at <= f.first_run_at THEN s.first_run_id ELSE f.first_run_id END AS first_run_id,
        CASE WHEN s.last_run_at >= f.last_run_at THEN s.last_run_at ELSE f.last_run_at END AS last_run_at,
        CASE WHEN s.last_run_at >= f.last_run_at THEN s.last_run_id ELSE f.last_run_id END AS last_run_id,
        greatest(coalesce(s.visit_count, 0), f.visit_count) AS visit_count, greatest(coalesce(s.discovery_count, 0), f.discovery_count) AS discovery_count
        FROM f LEFT JOIN s ON f.user_id = s.user_id AND f.cell = s.cell) m
      WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.user_id = m.user_id AND s.cell = m.cell AND s.first_run_at = m.first_run_at AND s.last_run_at = m.last_run_at
        AND s.visit_count = m.visit_count AND s.discovery_count = m.discovery_count)""",
    "cell_merge": f"""WITH visits AS ({VISITS_SQL}), b AS (SELECT user_id, cell, CAST(max(greatest(0, least(65535, date_diff('day', DATE '2020-01-01', started_at)))) AS INT) AS last_day
        FROM visits WHERE activity_id % 4 <> 0 GROUP BY 1, 2), t AS (SELECT DISTINCT user_id, cell FROM visits WHERE activity_id % 4 = 0)
      SELECT coalesce(b.user_id, t.user_id) AS user_id, coalesce(b.cell, t.cell) AS cell, b.user_id IS NULL AS added,
        CASE WHEN t.user_id IS NULL THEN b.last_day ELSE greatest(coalesce(b.last_day, 0), 500) END AS last_day
      FROM b FULL JOIN t ON b.user_id = t.user_id AND b.cell = t.cell""",
    "added_cells": f"""WITH visits AS ({VISITS_SQL}) SELECT user_id, cell FROM visits EXCEPT SELECT user_id, cell FROM visits WHERE activity_id % 4 <> 0""",
    "set_divergence": f"""SELECT user_id, CAST(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) AS BIGINT) AS differing, count(*) AS all_cells, round(sum(CASE WHEN a <> b THEN 1 ELSE 0 END) / count(*), 6) AS divergence
      FROM (SELECT user_id, cell, max(CASE WHEN activity_id % 2 = 0 THEN 1 ELSE 0 END) AS a, max(CASE WHEN activity_id % 2 = 1 THEN 1 ELSE 0 END) AS b
        FROM ({VISITS_SQL}) GROUP BY 1, 2) GROUP BY 1""",
    "delta_expiry": f"""SELECT user_id, unnest(range(1, g - 19)) AS expired FROM (SELECT user_id, count(DISTINCT activity_id) AS g FROM ({VISITS_SQL}) GROUP BY 1) WHERE g > 20""",
    "run_classes": f"""WITH {CLASSIFIED_SQL} SELECT user_id, activity_id,
      coalesce(string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) FILTER (class = 'new'), '') AS "new",
      coalesce(string_agg(CAST(cell AS VARCHAR), ',' ORDER BY cell) FILTER (class = 'rearmed'), '') AS rearmed,
      coalesce(string_agg(strftime(previous_at, '%Y-%m-%d'), ',' ORDER BY cell) FILTER (class = 'rearmed'), '') AS rearmed_since
      FROM classified GROUP BY 1, 2""",
    "rearm_soon": f"""WITH visits AS ({VISITS_SQL}), offsets AS (SELECT dq, dr FROM range(-4, 5) a(dq), range(-4, 5) b(dr) WHERE abs(dq + dr) <= 4), n AS (
        SELECT DISTINCT user_id, activity_id, started_at, (cell // 20 + dr) * 20 + cell % 20 + dq AS cell FROM visits, offsets
        WHERE cell % 20 + dq BETWEEN 0 AND 19 AND cell // 20 + dr BETWEEN 0 AND 14),
      near AS (SELECT n.* FROM n ANTI JOIN visits v ON n.activity_id = v.activity_id AND n.cell = v.cell AND n.user_id = v.user_id),
      latest AS (SELECT near.user_id, near.activity_id, near.started_at, near.cell, v.started_at AS last_run_at
        FROM near ASOF JOIN (SELECT DISTINCT user_id, cell, started_at FROM visits) v ON near.user_id = v.user_id AND near.cell = v.cell AND near.started_at >= v.started_at)
      SELECT user_id, activity_id, min_by(cell, (last_run_at, cell)) AS cell, min(last_run_at) + INTERVAL 183 DAY AS rearms_at
      FROM latest WHERE last_run_at + INTERVAL 183 DAY >= started_at + INTERVAL 1 DAY GROUP BY 1, 2""",
    "frontier_cells": f"""WITH c AS (SELECT activity_id AS user_id, cell FROM ({VISITS_SQL})), {NEIGHBOURS_SQL}
      SELECT user_id, count(*) AS edge_cells FROM (
        SELECT DISTINCT c.user_id, c.cell FROM c, offsets
        WHERE cell % 20 + dq BETWEEN 0 AND 19 AND cell // 20 + dr BETWEEN 0 AND 14
          AND NOT EXISTS (SELECT 1 FROM c o WHERE o.user_id = c.user_id AND o.cell = (c.cell // 20 + dr) * 20 + c.cell % 20 + dq)) GROUP BY 1""",
    "bridge_pairs": f"""WITH c AS (SELECT activity_id AS user_id, cell FROM ({VISITS_SQL})), {NEIGHBOURS_SQL}
      SELECT c.user_id, c.cell AS a, o.cell AS b FROM c JOIN offsets ON true JOIN c o ON o.user_id = c.user_id AND o.cell = (c.cell // 20 + dr) * 20 + c.cell % 20 + dq
      WHERE c.cell % 20 + dq BETWEEN 0 AND 19 AND c.cell // 20 + dr BETWEEN 0 AND 14 AND o.cell > c.cell""",
}
