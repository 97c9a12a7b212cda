"""Readers for the driver tables, and the shapes that stand in for the domain's.

The tables hold no traces, so orders are activities, their order lines visits
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows that one task sorts and groups.
TASK_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tasks(spark: SparkSession, sf_dir: str, name: str, rows: int = TASK_ROWS) -> int:
    """As many tasks as give each about ``rows`` of a table, counted from the files' footers."""
    return -(-table(spark, sf_dir, name).count() // rows)


def spread(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """The rows dealt by keys over n tasks, so that a task's memory does not grow with the table.

    What the session's cores take at once stays as it is and is dealt by the session's own rules.
    """
    return df.repartition(n, *keys) if n > df.sparkSession.sparkContext.defaultParallelism else df


#: Orders bear dates only; as starts of activities they are moved 25 years on and get hours and minutes.
STARTED_SQL = "o_orderdate + to_days(9131) + to_hours(CAST(o_orderkey % 24 AS INT)) + to_minutes(CAST(o_orderkey % 60 AS INT))"


def started_at():
    return F.expr("o_orderdate + make_dt_interval(9131, CAST(o_orderkey % 24 AS INT), CAST(o_orderkey % 60 AS INT), 0)")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, activity_id, started_at, kind, has_trace, source, distance_m, status)"""
    kind = F.element_at(
        F.create_map(*[F.lit(x) for pair in (("1-URGENT", "run"), ("2-HIGH", "ride"), ("3-MEDIUM", "strength"), ("4-NOT SPECIFIED", "walk"), ("5-LOW", "other")) for x in pair]),
        F.col("o_orderpriority"),
    )
    return table(spark, sf_dir, "orders").select(
        (F.col("o_custkey") % 20).alias("user_id"),
        F.col("o_orderkey").alias("activity_id"),
        started_at().alias("started_at"),
        kind.alias("kind"),
        (F.col("o_orderstatus") == "F").alias("has_trace"),
        F.when(F.col("o_orderkey") % 3 == 0, "manual").otherwise("watch").alias("source"),
        F.col("o_totalprice").alias("distance_m"),
        F.when(F.col("o_orderkey") % 11 == 0, "TOMBSTONED").otherwise("ACTIVE").alias("status"),
    )


#: The same in SQL, for the oracle queries.
ACTIVITIES_SQL = f"""
  SELECT o_custkey % 20 AS user_id, o_orderkey AS activity_id, {STARTED_SQL} AS started_at,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'run' WHEN '2-HIGH' THEN 'ride' WHEN '3-MEDIUM' THEN 'strength'
      WHEN '4-NOT SPECIFIED' THEN 'walk' WHEN '5-LOW' THEN 'other' END AS kind,
    o_orderstatus = 'F' AS has_trace, CASE WHEN o_orderkey % 3 = 0 THEN 'manual' ELSE 'watch' END AS source,
    o_totalprice AS distance_m, CASE WHEN o_orderkey % 11 = 0 THEN 'TOMBSTONED' ELSE 'ACTIVE' END AS status
  FROM orders"""


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, activity_id, started_at, cell), one row per cell of an activity.

    The join is on the activity and the distinct needs the activity too, so one
    shuffle serves both.
    """
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 300).alias("cell"))
    runs = activities(spark, sf_dir).select("user_id", "activity_id", "started_at")
    n = tasks(spark, sf_dir, "lineitem")
    both = spread(runs, n, "activity_id").join(spread(lines, n, "l_orderkey"), F.col("activity_id") == F.col("l_orderkey"))
    return both.select("user_id", "activity_id", "started_at", "cell").distinct()


VISITS_SQL = f"""
  SELECT DISTINCT o_custkey % 20 AS user_id, o_orderkey AS activity_id, {STARTED_SQL} AS started_at, l_partkey % 300 AS cell
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""


def sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(activity_id, pos, exercise, reps, duration_s): manual sets of an activity."""
    names = ["pushup", "situp", "plank", "yoga", "strength-upper", "strength-lower", "strength-core"]
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("activity_id"),
        F.col("l_linenumber").alias("pos"),
        F.element_at(F.array(*map(F.lit, names)), (F.col("l_partkey") % 7 + 1).cast("int")).alias("exercise"),
        F.col("l_quantity").cast("int").alias("reps"),
        (F.col("l_quantity") * 60).cast("int").alias("duration_s"),
    )


SETS_SQL = """
  SELECT l_orderkey AS activity_id, l_linenumber AS pos,
    ['pushup', 'situp', 'plank', 'yoga', 'strength-upper', 'strength-lower', 'strength-core'][l_partkey % 7 + 1] AS exercise,
    CAST(l_quantity AS INT) AS reps, CAST(l_quantity * 60 AS INT) AS duration_s
  FROM lineitem"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, seq, t_ms, lat, lng, accuracy): events of a user as points of one walk, in order of time."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        "user_id",
        F.row_number().over(order).alias("seq"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("t_ms"),
        ((F.col("user_id") % 140 - 70) + (F.col("event_id") % 13) * 0.01).cast("double").alias("lat"),
        ((F.col("user_id") * 7 % 360 - 180) + (F.col("event_id") % 17) * 0.01).cast("double").alias("lng"),
        F.when(F.col("event_id") % 5 == 0, None).otherwise(F.col("value")).alias("accuracy"),
    )


POINTS_SQL = """
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, epoch_us(ts) // 1000 AS t_ms,
    CAST((user_id % 140 - 70) + (event_id % 13) * 0.01::DOUBLE AS DOUBLE) AS lat,
    CAST((user_id * 7 % 360 - 180) + (event_id % 17) * 0.01::DOUBLE AS DOUBLE) AS lng,
    CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS accuracy
  FROM events"""


def trails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, seq, t_ms, lat, lng, accuracy): the same points walked in seconds and metres, so that ground is crossed and crossed again."""
    base = lambda of: (F.col("user_id") * of % 360 - 180).cast("double")
    p = points(spark, sf_dir)
    lat0, lng0 = (F.col("user_id") % 140 - 70).cast("double"), base(7)
    return p.select(
        "user_id", "seq", F.floor(F.col("t_ms") / 2000).alias("t_ms"),
        (lat0 + (F.col("lat") - lat0) * 0.02).alias("lat"), (lng0 + (F.col("lng") - lng0) * 0.02).alias("lng"), (F.col("accuracy") / 4).alias("accuracy"),
    )


TRAILS_SQL = f"""
  SELECT user_id, seq, t_ms // 2000 AS t_ms, lat0 + (lat - lat0) * 0.02::DOUBLE AS lat, lng0 + (lng - lng0) * 0.02::DOUBLE AS lng, accuracy / 4 AS accuracy
  FROM (SELECT *, CAST(user_id % 140 - 70 AS DOUBLE) AS lat0, CAST(user_id * 7 % 360 - 180 AS DOUBLE) AS lng0 FROM ({POINTS_SQL}))"""


def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, activity_id, started_at, line, skill, reason, xp, rules_version): order lines as rows of a ledger, the seventh of an order a floor."""
    skill = F.element_at(F.array(*map(F.lit, LEDGER_SKILLS)), (F.col("l_suppkey") % 5 + 1).cast("int"))
    reason = F.when(F.col("l_linenumber") == 7, "floor").when(F.col("l_returnflag") == "A", "new_ground").when(F.col("l_returnflag") == "N", "distance").otherwise("duration")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.col("l_linenumber").alias("line"),
        skill.alias("skill"),
        reason.alias("reason"),
        (F.floor(F.col("l_quantity") * 7) - 30).cast("long").alias("xp"),
        F.when(F.col("l_linenumber") % 3 == 0, 4).otherwise(5).alias("rules_version"),
    )
    runs = activities(spark, sf_dir).select("user_id", "activity_id", "started_at")
    n = tasks(spark, sf_dir, "lineitem")
    return spread(runs, n, "activity_id").join(spread(lines, n, "l_orderkey"), F.col("activity_id") == F.col("l_orderkey")).drop("l_orderkey")


LEDGER_SKILLS = ("wayfaring", "might", "cartography", "constitution", "roving")

LEDGER_SQL = f"""
  SELECT o_custkey % 20 AS user_id, o_orderkey AS activity_id, {STARTED_SQL} AS started_at, l_linenumber AS line,
    ['wayfaring', 'might', 'cartography', 'constitution', 'roving'][l_suppkey % 5 + 1] AS skill,
    CASE WHEN l_linenumber = 7 THEN 'floor' WHEN l_returnflag = 'A' THEN 'new_ground' WHEN l_returnflag = 'N' THEN 'distance' ELSE 'duration' END AS reason,
    CAST(floor(l_quantity * 7) AS BIGINT) - 30 AS xp, CASE WHEN l_linenumber % 3 = 0 THEN 4 ELSE 5 END AS rules_version
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, rec_id, at, elapsed_s, distance_m, has_sets): events as recordings that several sources may have made of one activity."""
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("user_id"),
        F.col("event_id").alias("rec_id"),
        F.col("ts").alias("at"),
        (F.col("value") * 6).cast("long").alias("elapsed_s"),
        F.when(F.col("event_id") % 4 > 0, F.round(F.col("value") * 40, 2)).alias("distance_m"),
        (F.col("event_id") % 9 == 0).alias("has_sets"),
    )


RECORDINGS_SQL = """
  SELECT user_id % 5 AS user_id, event_id AS rec_id, ts AS at_, CAST(trunc(value * 6) AS BIGINT) AS elapsed_s,
    CASE WHEN event_id % 4 > 0 THEN round(value * 40, 2) END AS distance_m, event_id % 9 = 0 AS has_sets
  FROM events"""
