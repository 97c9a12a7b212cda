"""The replay as a query: old ledger to published states, with SQL."""

import uuid

from pyspark.sql import functions as F

from trailmill.operators import replay as r
from trailmill.plans import scoring
from trailmill.plans.scoring import LEDGER_SQL as FRESH_SQL
from trailmill.plans.scoring import LEVEL_SQL
from trailmill.sources.tables import ACTIVITIES_SQL, LEDGER_SQL, activities, ledger_entries, visits
from trailmill.sources.versions import Versions, shared_dir


def shown_ledger(spark, sf_dir):
    """What users were shown under older rules."""
    rows = ledger_entries(spark, sf_dir).withColumn("is_floor", F.col("reason") == "floor")
    return rows.select("user_id", "activity_id", "started_at", "skill", F.col("xp").cast("long").alias("xp"), "is_floor")


def new_ledger(spark, sf_dir):
    return scoring.ledger(spark, sf_dir).select("user_id", "activity_id", "started_at", "skill", F.col("xp").cast("long").alias("xp"), F.lit(False).alias("is_floor"))


def active(spark, sf_dir):
    return activities(spark, sf_dir).filter("status = 'ACTIVE'").select("activity_id")


def published(spark, sf_dir, store, run, **more):
    each = lambda f: lambda: f(spark, sf_dir)
    return r.replay(store, run, each(shown_ledger), each(new_ledger), each(visits), each(active), **more)


def replayed_states(spark, sf_dir):
    store = Versions(spark, f"{shared_dir(spark)}/replay-{uuid.uuid4().hex}")
    version = published(spark, sf_dir, store, "replay-1")
    return store.table("states", version).select("user_id", "skill", "xp", "level", "first_at", "last_at").withColumn("generation", F.lit(version.generation))


QUERIES = {"replayed_states": replayed_states}

ORACLE_SQL = {
    "replayed_states": f"""WITH {FRESH_SQL}, live AS (SELECT activity_id FROM ({ACTIVITIES_SQL}) WHERE status = 'ACTIVE'),
      old AS (SELECT user_id, activity_id, started_at, skill, xp, reason = 'floor' AS is_floor FROM ({LEDGER_SQL})),
      kept AS (SELECT * FROM old WHERE is_floor OR activity_id NOT IN (SELECT activity_id FROM live)),
      fresh AS (SELECT l.user_id, l.activity_id, a.started_at, l.skill, l.xp FROM ledger l JOIN ({ACTIVITIES_SQL}) a ON a.activity_id = l.activity_id WHERE a.status = 'ACTIVE'),
      shown AS (SELECT user_id, skill, CAST(sum(xp) AS BIGINT) AS xp FROM old GROUP BY 1, 2),
      made AS (SELECT user_id, skill, CAST(sum(xp) AS BIGINT) AS xp, min(started_at) AS first_at, max(started_at) AS last_at
        FROM (SELECT user_id, skill, xp, started_at FROM fresh UNION ALL SELECT user_id, skill, xp, started_at FROM kept) GROUP BY 1, 2),
      done AS (SELECT user_id, skill, greatest(coalesce(shown.xp, 0), coalesce(made.xp, 0)) AS xp, coalesce(shown.xp, 0) AS before, first_at, last_at FROM shown FULL JOIN made USING (user_id, skill))
      SELECT user_id, skill, CAST(xp AS BIGINT) AS xp, greatest({LEVEL_SQL.format(xp='done.xp')}, CASE WHEN before <> 0 THEN {LEVEL_SQL.format(xp='done.before')} ELSE 1 END) AS level, first_at, last_at, 1 AS generation FROM done""",
}
