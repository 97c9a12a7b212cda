"""Batch forms of what the streams keep, with their SQL."""

from pyspark.sql import functions as F

from trailmill.operators import claims, late
from trailmill.sources.tables import VISITS_SQL, table, visits


def arrived():
    """Visits come in three deliveries, the earliest not always first."""
    return F.col("activity_id") % 3


def late_backfill(spark, sf_dir):
    return late.arrived_state(late.arrivals(visits(spark, sf_dir), arrived()))


def deferred_visits(spark, sf_dir):
    """Users whose history needs a replay, and from when."""
    rows = late.arrivals(visits(spark, sf_dir), arrived()).filter(F.col("class") == "deferred")
    return rows.groupBy("user_id").agg(F.count("*").alias("deferred"), F.min("started_at").alias("replay_from"))


def rate_windows(spark, sf_dir):
    found = late.budget_windows(table(spark, sf_dir, "events"), "ts", 6, 300)
    return found.withColumn("quarter", F.col("quarter").cast("timestamp_ntz"))


COMMANDS = ("put", "claim", "done", "fail", "replay", "duplicate", "claim", "close", "lost")


def claim_requests(spark, sf_dir):
    """Events as requests on receipts, a few of which share a millisecond; each user's first ones come at steps of minutes."""
    e = F.col("event_id")
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), (e % 9 + 1).cast("int"))
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("r"), (F.col("user_id") * 7 % 400).cast("string")).alias("key"), (e % 700 * 240_000).alias("at_ms"), e.alias("seq"), F.when(e % 700 < 20, "put").otherwise(command).alias("command")
    )


def claim_answers(spark, sf_dir):
    return claims.answers(claim_requests(spark, sf_dir))


QUERIES = {f.__name__: f for f in (late_backfill, deferred_visits, rate_windows, claim_answers)}

_ARRIVED = f"""WITH v AS (SELECT *, max(started_at) OVER (PARTITION BY user_id, cell ORDER BY activity_id % 3, started_at, activity_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM ({VISITS_SQL})),
  c AS (SELECT *, CASE WHEN seen IS NULL THEN 'new' WHEN started_at < seen THEN 'deferred' WHEN started_at - seen < INTERVAL 183 DAY THEN 'cooled' ELSE 'rearmed' END AS class FROM v)"""

_FREE = f"(g.status IN ('QUEUED', 'FAILED') OR g.status = 'PROCESSING' AND g.claimed < r.at_ms - {claims.STALE_MS})"
_ACCEPTED = f"""coalesce(CASE r.command WHEN 'put' THEN g.status IS NULL WHEN 'claim' THEN {_FREE} WHEN 'duplicate' THEN {_FREE} WHEN 'replay' THEN g.status = 'DONE' OR {_FREE}
  WHEN 'done' THEN g.status = 'PROCESSING' WHEN 'fail' THEN g.status <> 'DONE' WHEN 'close' THEN g.status IS NOT NULL ELSE false END, false)"""

ORACLE_SQL = {
    "claim_answers": f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY at_ms, seq) AS k FROM (SELECT 'r' || (user_id * 7 % 400) AS key, event_id % 700 * 240000 AS at_ms, event_id AS seq,
        CASE WHEN event_id % 700 < 20 THEN 'put' ELSE {list(COMMANDS)}[event_id % 9 + 1] END AS command FROM events)),
      g AS (SELECT DISTINCT key, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::BOOLEAN AS accepted, NULL::VARCHAR AS status, NULL::BIGINT AS claimed FROM r
        UNION ALL SELECT key, k, seq, ok, CASE WHEN ok THEN CASE command WHEN 'put' THEN 'QUEUED' WHEN 'fail' THEN 'FAILED' WHEN 'claim' THEN 'PROCESSING' WHEN 'replay' THEN 'PROCESSING' ELSE 'DONE' END ELSE status END,
          CASE WHEN ok AND command IN ('claim', 'replay') THEN at_ms WHEN NOT ok THEN claimed END
        FROM (SELECT r.key, r.k, r.seq, r.command, r.at_ms, g.status, g.claimed, {_ACCEPTED} AS ok FROM g JOIN r ON r.key = g.key AND r.k = g.k + 1))
      SELECT key, seq, accepted, status FROM g WHERE k > 0""",
    "late_backfill": f"""{_ARRIVED} SELECT user_id, cell, min(started_at) AS first_run_at, max(started_at) AS last_run_at, count(*) AS visits,
      count(*) FILTER (class IN ('new', 'rearmed')) AS credits, count(*) FILTER (class = 'deferred') AS deferred FROM c GROUP BY 1, 2""",
    "deferred_visits": f"{_ARRIVED} SELECT user_id, count(*) AS deferred, min(started_at) AS replay_from FROM c WHERE class = 'deferred' GROUP BY 1",
    "rate_windows": """WITH q AS (SELECT time_bucket(INTERVAL 15 MINUTE, ts) AS quarter, count(*) AS used FROM events GROUP BY 1),
      d AS (SELECT *, CAST(sum(used) OVER (PARTITION BY CAST(quarter AS DATE) ORDER BY quarter) AS BIGINT) AS used_today FROM q)
      SELECT quarter, used, used_today, CASE WHEN used_today >= 300 THEN 'sleep until midnight' WHEN used >= 6 THEN 'sleep until the next quarter'
        WHEN used_today >= 270 THEN 'interactive only until midnight' WHEN used >= 5.4 THEN 'interactive only until the next quarter' ELSE 'proceed' END AS decision FROM d""",
}
