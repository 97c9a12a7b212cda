"""The web of the walks' traces, with its SQL."""

from pyspark.sql import functions as F

from trailmill.operators import web as w
from trailmill.plans.ground import TRAIL, parts, parts_sql
from trailmill.sources.tables import TRAILS_SQL, tasks

POINTS_A_TASK = 20_000


def trace_web(spark, sf_dir):
    """Walks of a user in order; a line is named by its samples."""
    walked = parts(spark, sf_dir).select("user_id", F.col("segment").alias("run_id"), F.col("segment").alias("started_at"), "part", "seq", "lat", "lng")
    # Sampling makes far more rows than were shuffled: tasks go by points, lest small partitions be put together.
    n = max(spark.sparkContext.defaultParallelism, tasks(spark, sf_dir, "events", POINTS_A_TASK))
    lines = w.pieces(walked.repartition(n, *w.RUN))
    return lines.select("user_id", "run_id", "wear", "first_i", "last_i", F.size("points").alias("n"))


QUERIES = {"trace_web": trace_web}

_UNIT = f"{6_371_008.8 * 3.141592653589793 / 180 / w.GRID_M}::DOUBLE"
_RUN = "PARTITION BY user_id, segment ORDER BY i"

ORACLE_SQL = {
    "trace_web": f"""WITH RECURSIVE {parts_sql(TRAILS_SQL, **TRAIL)},
      q AS (SELECT * EXCLUDE size FROM (SELECT user_id, segment, part, seq, lat, lng, count(*) OVER (PARTITION BY user_id, segment, part) AS size FROM cut) WHERE size > 1),
      f AS (SELECT user_id, min_by(lat, (segment, part, seq)) AS first_lat FROM q GROUP BY 1),
      b AS (SELECT *, lag(lat) OVER v AS lat0, lag(lng) OVER v AS lng0 FROM q WINDOW v AS (PARTITION BY user_id, segment, part ORDER BY seq)),
      m AS (SELECT *, coalesce(sqrt((radians(lng - lng0) * cos(radians((lat + lat0) / 2))) ** 2 + radians(lat - lat0) ** 2) * 6371008.8::DOUBLE, 0) AS m FROM b),
      n AS (SELECT *, sum(m) OVER (PARTITION BY user_id, segment ORDER BY part, seq) AS end_m, CAST(greatest(1, ceil(m / {w.SAMPLE_M})) AS INT) AS n FROM m),
      e AS (SELECT *, unnest(range(1, n + 1)) AS k FROM n),
      s AS (SELECT user_id, segment, row_number() OVER (PARTITION BY user_id, segment ORDER BY part, seq, k) AS i, lat0 IS NULL AS head, end_m - m * (1 - k / n::DOUBLE) AS at_m,
        CASE WHEN k = n THEN lat ELSE lat0 + (lat - lat0) * (k / n::DOUBLE) END AS lat, CASE WHEN k = n THEN lng ELSE lng0 + (lng - lng0) * (k / n::DOUBLE) END AS lng FROM e),
      r AS (SELECT s.*, CAST(floor(lng * (cos(radians(first_lat)) * {_UNIT})) AS BIGINT) AS x, CAST(floor(lat * {_UNIT}) AS BIGINT) AS y FROM s JOIN f USING (user_id)),
      wide AS (SELECT DISTINCT user_id, segment, at_m, x + dx AS x, y + dy AS y FROM r, (VALUES (-1), (0), (1)) a(dx), (VALUES (-1), (0), (1)) o(dy)),
      p AS (SELECT user_id, x, y, count(DISTINCT segment) AS passes, min(segment) AS first_run, min_by(at_m, (segment, at_m)) AS first_m FROM wide GROUP BY 1, 2, 3),
      d AS (SELECT user_id, segment, i, head, first_run < segment OR first_m < at_m - {w.SELF_LAG_M} AS drawn, CAST(CASE WHEN passes <= 1 THEN 0 ELSE least(4, ceil(round(log2(passes), 9))) END AS INT) AS raw FROM r JOIN p USING (user_id, x, y)),
      c AS (SELECT *, sum(CASE WHEN raw = before THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, segment ORDER BY i) AS land FROM (SELECT *, lag(raw) OVER (PARTITION BY user_id, segment ORDER BY i) AS before FROM d)),
      z AS (SELECT *, count(*) OVER (PARTITION BY user_id, segment, land) AS size, max(raw) FILTER (land = 2) OVER (PARTITION BY user_id, segment) AS second FROM c),
      st AS (SELECT user_id, segment, i, head, drawn, coalesce(last_value(CASE WHEN size >= {w.LEAST_SAMPLES} THEN raw END IGNORE NULLS) OVER ({_RUN}), second, raw) AS step FROM z),
      nb AS (SELECT *, lag(drawn) OVER v AS was_drawn, lag(step) OVER v AS was_step, lag(i) OVER v AS was, lead(head) OVER v AS next_head FROM st WINDOW v AS ({_RUN})),
      bg AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER ({_RUN}) AS piece FROM (SELECT *, NOT drawn AND (head OR was IS NULL OR was_drawn OR was_step <> step) AS begins FROM nb)),
      ln AS (SELECT user_id, segment, piece, any_value(step) AS step, min(CASE WHEN begins AND NOT head AND was_drawn THEN i - 1 ELSE i END) AS first_i, max(CASE WHEN NOT coalesce(next_head, true) THEN i + 1 ELSE i END) AS last_i FROM bg WHERE NOT drawn GROUP BY 1, 2, 3)
      SELECT user_id, segment AS run_id, [{', '.join(map(str, w.WEAR))}][step + 1]::DOUBLE AS wear, first_i, last_i, CAST(last_i - first_i + 1 AS INT) AS n FROM ln WHERE last_i > first_i""",
}
