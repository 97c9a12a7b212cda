"""Queries along and beside real walks, with their SQL."""

from pyspark.sql import functions as F

from trailmill.operators import cells as c
from trailmill.operators import reveal as r
from trailmill.plans.ground import _GROUND, TRAIL, WALK, _short, parts, parts_sql
from trailmill.plans.places import _metres
from trailmill.sources.tables import TRAILS_SQL, table, tasks

STEP_M = 30.0
NEAR_M = 150.0
#: A point of a walk meets some seventy pairs of a cell and a sample.
POINTS_A_TASK = 20_000


def corridor_samples(spark, sf_dir):
    rows = r.carried_samples(parts(spark, sf_dir), STEP_M, *WALK)
    return rows.groupBy(*WALK, "part").agg(F.count("*").alias("n"), F.round(F.max("at_m"), 3).alias("end_m"), F.round(F.sum("at_m"), 2).alias("sum_m"), F.round(F.sum("arc"), 5).alias("arcs"), F.round(F.avg("lat"), 7).alias("lat"), F.round(F.avg("lng"), 7).alias("lng"))


def cell_reveals(spark, sf_dir):
    """When each cell of a walk appears; cells are known by their centres here."""
    walked = parts(spark, sf_dir)
    shown = c.corridor(walked, *WALK).filter("cell IS NOT NULL").withColumn("at", c.centre(F.col("cell"))).select(*WALK, "cell", "at.lat", "at.lng")
    order = r.reveal_order(walked, shown, *WALK, tasks=tasks(spark, sf_dir, "events", POINTS_A_TASK)).withColumn("at", c.centre(F.col("cell")))
    return order.select(*WALK, F.round("at.lat", 6).alias("lat"), F.round("at.lng", 6).alias("lng"), F.round("arc", 6).alias("arc"))


def places(spark, sf_dir):
    """Customers strewn over the grounds of the walks."""
    k = F.col("c_custkey")
    user = k % 150
    return table(spark, sf_dir, "customer").select("c_custkey", ((user % 140 - 70) + (k % 23) * 0.0001).cast("double").alias("lat"), ((user * 7 % 360 - 180) + (k % 31) * 0.0001).cast("double").alias("lng"))


def nearby_walks(spark, sf_dir):
    edges = r.edges_of(parts(spark, sf_dir), *WALK)
    near = r.walks_near(places(spark, sf_dir), edges, NEAR_M, ["c_custkey"], *WALK, tasks=tasks(spark, sf_dir, "events", POINTS_A_TASK))
    return near.withColumn("m", F.round("m", 3))


QUERIES = {f.__name__: f for f in (corridor_samples, cell_reveals, nearby_walks)}

_PATHS = f"""WITH RECURSIVE {parts_sql(TRAILS_SQL, **TRAIL)},
  v AS (SELECT user_id, segment, part, seq, lat, lng, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0 FROM cut WINDOW w AS (PARTITION BY user_id, segment, part ORDER BY seq))"""

ORACLE_SQL = {
    "corridor_samples": f"""{_PATHS}, ss AS (SELECT *, coalesce({_metres('lat', 'lng', 'lat2', 'lng2')} * CASE WHEN lat2 IS NULL THEN NULL ELSE 1 END, 0) AS span FROM v WHERE lat2 IS NOT NULL OR lat0 IS NOT NULL),
      gg AS (SELECT *, sum(span) OVER (PARTITION BY user_id, segment, part ORDER BY seq) - span AS start, sum(span) OVER (PARTITION BY user_id, segment ORDER BY part, seq) - span AS walked, sum(span) OVER (PARTITION BY user_id, segment) AS total FROM ss),
      x AS (SELECT *, walked AS at_m, lat AS y, lng AS x FROM gg WHERE lat0 IS NULL OR lat2 IS NULL
        UNION ALL SELECT * EXCLUDE m, walked + m * {STEP_M} - start, lat + (lat2 - lat) * (m * {STEP_M} - start) / span, lng + (lng2 - lng) * (m * {STEP_M} - start) / span
          FROM (SELECT *, unnest(range(CAST(floor(start / {STEP_M}) AS BIGINT) + 1, CAST(ceil((start + span) / {STEP_M}) AS BIGINT))) AS m FROM gg WHERE span > 0))
      SELECT user_id, segment, part, count(*) AS n, round(max(at_m), 3) AS end_m, round(sum(at_m), 2) AS sum_m, round(sum(CASE WHEN total > 0 THEN at_m / total ELSE 0 END), 5) AS arcs, round(avg(y), 7) AS lat, round(avg(x), 7) AS lng FROM x GROUP BY 1, 2, 3""",
    "cell_reveals": f"""WITH RECURSIVE {_GROUND}, q AS (SELECT user_id, segment, part, seq, lat, lng, count(*) OVER (PARTITION BY user_id, segment, part) AS size FROM cut),
      o AS (SELECT *, cos(radians(first_value(lat) OVER (PARTITION BY user_id, segment ORDER BY part, seq))) * {r.EAST_M} AS scale FROM q WHERE size > 1),
      b AS (SELECT *, lng * scale AS x, lat * {r.NORTH_M} AS y, lag(lng) OVER w * scale AS px, lag(lat) OVER w * {r.NORTH_M} AS py FROM o WINDOW w AS (PARTITION BY user_id, segment, part ORDER BY seq)),
      m AS (SELECT *, coalesce(sqrt((x - px) ** 2 + (y - py) ** 2), 0) AS span FROM b),
      n AS (SELECT *, sum(span) OVER (PARTITION BY user_id, segment ORDER BY part, seq) AS fin, sum(span) OVER (PARTITION BY user_id, segment) AS walked, CASE WHEN px IS NULL THEN 1 ELSE CAST(greatest(1, ceil(span / {r.SAMPLE_M})) AS INT) END AS steps FROM m),
      e AS (SELECT *, unnest(range(1, steps + 1)) AS k FROM n),
      i AS (SELECT user_id, segment, row_number() OVER (PARTITION BY user_id, segment ORDER BY part, seq, k) AS i, scale, coalesce(px + (x - px) * k / steps, x) AS x, coalesce(py + (y - py) * k / steps, y) AS y,
        CASE WHEN walked > 0 THEN (fin - span * (1 - CASE WHEN px IS NULL THEN 1 ELSE k / steps::DOUBLE END)) / walked ELSE 0 END AS arc FROM e),
      d AS (SELECT i.user_id, i.segment, clat, clng, i, arc, round((x - clng * scale) ** 2 + (y - clat * {r.NORTH_M}) ** 2, 4) AS d FROM shown JOIN i ON i.user_id = shown.user_id AND i.segment = shown.segment),
      h AS (SELECT *, i - row_number() OVER (PARTITION BY user_id, segment, clat, clng ORDER BY i) AS island FROM d WHERE d <= {r.REVEAL_M ** 2}),
      f AS (SELECT user_id, segment, clat, clng, min_by(arc, (d, i)) AS arc FROM (SELECT *, min(island) OVER (PARTITION BY user_id, segment, clat, clng) AS lead_island FROM h) WHERE island = lead_island GROUP BY 1, 2, 3, 4),
      z AS (SELECT * FROM f UNION ALL SELECT user_id, segment, clat, clng, min_by(arc, (d, i)) FROM d WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.user_id = d.user_id AND f.segment = d.segment AND f.clat = d.clat AND f.clng = d.clng) GROUP BY 1, 2, 3, 4)
      SELECT user_id, segment, round(clat, 6) AS lat, round(clng, 6) AS lng, round(arc, 6) AS arc FROM z""",
    "nearby_walks": f"""{_PATHS}, p AS (SELECT user_id, segment, lat AS lat1, lng AS lng1, coalesce(lat2, lat) AS lat2, coalesce(lng2, lng) AS lng2 FROM v WHERE lat2 IS NOT NULL OR lat0 IS NULL),
      a AS (SELECT c_custkey, CAST((c_custkey % 150 % 140 - 70) + (c_custkey % 23) * 0.0001::DOUBLE AS DOUBLE) AS lat, CAST((c_custkey % 150 * 7 % 360 - 180) + (c_custkey % 31) * 0.0001::DOUBLE AS DOUBLE) AS lng FROM customer),
      m AS (SELECT c_custkey, user_id, segment, {_short('lng1 - lng')} * cos(radians(lat)) * {r.METRES_PER_DEGREE}::DOUBLE AS ax, (lat1 - lat) * {r.METRES_PER_DEGREE}::DOUBLE AS ay,
        {_short('lng2 - lng1')} * cos(radians(lat)) * {r.METRES_PER_DEGREE}::DOUBLE AS dx, (lat2 - lat1) * {r.METRES_PER_DEGREE}::DOUBLE AS dy FROM a JOIN p ON abs(lat1 - lat) < 0.05),
      t AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS t FROM m)
      SELECT c_custkey, user_id, segment, round(min(sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2)), 3) AS m FROM t WHERE sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2) <= {NEAR_M} GROUP BY 1, 2, 3""",
}
