"""Queries of the ledger and activity reads, with their SQL."""

from pyspark.sql import functions as F

from trailmill.operators import reads as r
from trailmill.operators.rules import MILESTONES, exercises, exercises_sql, rules, rules_sql
from trailmill.operators.scoring import level_for_xp
from trailmill.sources.tables import ACTIVITIES_SQL, LEDGER_SQL, activities, ledger_entries

SPLIT_AT = "2023-01-01"


def _states(ledger, where="true"):
    return ledger.filter(where).groupBy("user_id", "skill").agg(F.sum("xp").alias("xp")).filter("xp > 0")


def run_ledger(spark, sf_dir):
    return r.run_ledger(ledger_entries(spark, sf_dir))


def tally(spark, sf_dir):
    return r.breakdown(ledger_entries(spark, sf_dir))


def xp_before_run(spark, sf_dir):
    return r.standings(ledger_entries(spark, sf_dir)).drop("started_at")


def landmark_walk(spark, sf_dir):
    return r.landmarks(r.standings(ledger_entries(spark, sf_dir))).withColumn("arc", F.round("arc", 6))


def places_crossed(spark, sf_dir):
    """The two levels that are shown as places; few of the driver's users get there."""
    return landmark_walk(spark, sf_dir).filter("level IN (50, 99)")


def recent_sessions(spark, sf_dir):
    return r.recent_sessions(ledger_entries(spark, sf_dir), 5)


def next_level(spark, sf_dir):
    ledger = ledger_entries(spark, sf_dir)
    return r.next_level(_states(ledger), r.recent_sessions(ledger, 5), rules(spark).select("skill", "display_order"))


def level_cards(spark, sf_dir):
    ledger = ledger_entries(spark, sf_dir)
    return r.level_cards(_states(ledger, f"started_at < '{SPLIT_AT}'"), _states(ledger))


def milestones_crossed(spark, sf_dir):
    sums = ledger_entries(spark, sf_dir).groupBy("user_id", "skill").agg(
        F.sum("xp").alias("after"), F.sum(F.when(F.col("started_at") < F.lit(SPLIT_AT).cast("timestamp_ntz"), F.col("xp")).otherwise(0)).alias("before")
    )
    totals = sums.groupBy("user_id").agg(F.sum(level_for_xp(F.col("before"))).alias("low"), F.sum(level_for_xp(F.col("after"))).alias("high"))
    return r.milestones(totals, MILESTONES)


def skills_panel(spark, sf_dir):
    return r.panel(rules(spark), _states(ledger_entries(spark, sf_dir)))


def latest_traced_run(spark, sf_dir):
    return r.latest_traced(activities(spark, sf_dir))


def first_traced_run(spark, sf_dir):
    first = F.min(F.struct("started_at", "activity_id")).alias("f")
    return activities(spark, sf_dir).filter("has_trace AND status <> 'TOMBSTONED'").groupBy("user_id").agg(first).select("user_id", "f.started_at", "f.activity_id")


def keyset_page(spark, sf_dir):
    at = F.lit("2023-06-01").cast("timestamp_ntz")
    return r.keyset_page(activities(spark, sf_dir), 3, at, 7000).select("started_at", "activity_id", "kind", "has_trace")


def history_upto(spark, sf_dir):
    """Active runs up to an instant: how many, how far, which kinds."""
    rows = activities(spark, sf_dir).filter(f"started_at <= timestamp_ntz'{SPLIT_AT} 00:00:00' AND status <> 'TOMBSTONED'")
    return rows.groupBy("user_id", "kind").agg(F.count("*").alias("runs"), F.round(F.sum("distance_m") / 1000, 2).alias("km"))


def cursor_codec(spark, sf_dir):
    rows = activities(spark, sf_dir).select("activity_id", r.cursor(F.col("started_at"), F.col("activity_id")).alias("cursor"))
    return rows.withColumn("back", r.from_cursor(F.col("cursor"))["i"].cast("long"))


def activity_ledger(spark, sf_dir):
    """Rows of a few runs of one user, in order."""
    return ledger_entries(spark, sf_dir).select("user_id", "activity_id", "line", "skill", "reason", "xp")


def skill_snapshot(spark, sf_dir):
    """Each user's skills as one sorted text."""
    text = F.concat_ws("=", "skill", F.col("xp").cast("string"))
    return _states(ledger_entries(spark, sf_dir)).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(text)), ";").alias("skills"), F.sum("xp").alias("total"))


def ledger_audit(spark, sf_dir):
    """Stored sums (some of them off by one) against the ledger, field by field."""
    found = ledger_entries(spark, sf_dir).groupBy("activity_id").agg(F.sum("xp").alias("xp"), F.count("*").alias("n_rows"))
    off = lambda n: (F.col("activity_id") % n == 0).cast("int")
    stored = found.select("activity_id", (F.col("xp") + off(97)).alias("xp"), (F.col("n_rows") - off(89)).alias("n_rows"))
    return r.mismatches(stored, found, "activity_id", ("xp", "n_rows"))


def sweep_metrics(spark, sf_dir):
    """Outcomes of a sweep over listed runs: enqueued, present, or withdrawn."""
    outcome = F.when(F.col("status") == "TOMBSTONED", "withdrawn").when(F.col("has_trace"), "present").otherwise("enqueued")
    return activities(spark, sf_dir).groupBy("source", outcome.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


QUERIES = {
    f.__name__: f
    for f in (
        run_ledger, tally, xp_before_run, landmark_walk, places_crossed, recent_sessions, next_level, level_cards, milestones_crossed, skills_panel, 
        latest_traced_run, first_traced_run, keyset_page, history_upto, cursor_codec, activity_ledger, skill_snapshot, ledger_audit, sweep_metrics,
    )
}

_LEDGER = f"ledger AS ({LEDGER_SQL})"
_NEWEST = f"{_LEDGER}, newest AS (SELECT * FROM (SELECT *, max(rules_version) OVER (PARTITION BY activity_id) AS v FROM ledger WHERE reason <> 'floor') WHERE rules_version = v)"
_LEVELS = "levels AS (SELECT l AS level, 4 * (l - 1) * l * (2 * l - 1) // 6 AS need FROM (SELECT unnest(range(1, 101)) AS l))"
_STANDING = f"""{_LEDGER}, runs AS (SELECT user_id, skill, activity_id, started_at, sum(CASE WHEN reason <> 'floor' THEN xp ELSE 0 END) AS gained,
    sum(CASE WHEN reason = 'floor' THEN xp ELSE 0 END) AS floors FROM ledger WHERE xp > 0 GROUP BY ALL),
  standing AS (SELECT user_id, skill, activity_id, started_at, CAST(gained AS BIGINT) AS gained, CAST(coalesce(sum(gained) OVER (PARTITION BY user_id, skill ORDER BY started_at, activity_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + sum(floors) OVER (PARTITION BY user_id, skill) AS BIGINT) AS before FROM runs QUALIFY gained > 0)"""
_WALK = f"""WITH {_STANDING}, {_LEVELS} SELECT user_id, skill, CAST(level AS INT) AS level, activity_id, round((need - before) / gained, 6) AS arc
  FROM standing JOIN levels ON need > before AND need <= before + gained WHERE level BETWEEN 2 AND 99"""
_STATE = "state AS (SELECT user_id, skill, CAST(sum(xp) AS BIGINT) AS xp FROM ledger GROUP BY 1, 2 HAVING sum(xp) > 0)"
_RECENT = """recent AS (SELECT user_id, skill, activity_id, xp, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, skill ORDER BY started_at DESC, activity_id DESC) AS place
    FROM (SELECT user_id, skill, activity_id, started_at, CAST(sum(xp) AS BIGINT) AS xp FROM ledger WHERE rules_version = 5 AND reason <> 'floor' AND xp > 0 GROUP BY 1, 2, 3, 4)) WHERE place <= 10)"""
_LEVEL = "(SELECT max(level) FROM levels WHERE need <= {} AND level <= 99)"
_ACTIVE = f"a AS ({ACTIVITIES_SQL})"

ORACLE_SQL = {
    "run_ledger": f"""WITH {_NEWEST} SELECT *, CAST(row_number() OVER (PARTITION BY activity_id ORDER BY xp DESC, skill) AS INT) AS place FROM
      (SELECT activity_id, skill, CAST(sum(xp) AS BIGINT) AS xp FROM newest GROUP BY 1, 2 HAVING sum(xp) > 0)""",
    "tally": f"""WITH {_NEWEST}, p AS (SELECT activity_id, skill, reason, sum(xp) AS xp FROM newest GROUP BY 1, 2, 3 HAVING sum(xp) > 0)
      SELECT activity_id, skill, CAST(sum(xp) AS BIGINT) AS xp, string_agg(reason || ' ' || xp, ', ' ORDER BY reason || ' ' || xp) AS parts FROM p GROUP BY 1, 2""",
    "xp_before_run": f"WITH {_STANDING} SELECT user_id, skill, activity_id, gained, before FROM standing",
    "landmark_walk": _WALK,
    "places_crossed": f"SELECT * FROM ({_WALK}) WHERE level IN (50, 99)",
    "recent_sessions": f"WITH {_LEDGER}, {_RECENT} SELECT user_id, skill, activity_id, xp, CAST(place AS INT) AS place FROM recent",
    "next_level": f"""WITH {_LEDGER}, {_STATE}, {_RECENT}, {_LEVELS}, {rules_sql()}, m AS (SELECT user_id, skill, median(xp) AS m FROM recent GROUP BY 1, 2),
      n AS (SELECT s.*, need - s.xp AS left_ FROM state s JOIN levels ON level = 1 + (SELECT max(level) FROM levels WHERE need <= s.xp AND level <= 99) WHERE level <= 99),
      c AS (SELECT n.user_id, n.skill, CAST(ceil(left_ / m) AS BIGINT) AS runs, display_order FROM n JOIN m ON n.user_id = m.user_id AND n.skill = m.skill JOIN rules r ON r.skill = n.skill)
      SELECT user_id, skill, runs FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY runs, display_order) = 1""",
    "level_cards": f"""WITH {_LEDGER}, {_STATE}, {_LEVELS}, b AS (SELECT user_id, skill, sum(xp) AS xp FROM ledger WHERE started_at < '{SPLIT_AT}' GROUP BY 1, 2 HAVING sum(xp) > 0)
      SELECT s.user_id, s.skill, CAST(level AS INT) AS level FROM state s LEFT JOIN b ON s.user_id = b.user_id AND s.skill = b.skill
      JOIN levels ON need > coalesce(b.xp, 0) AND need <= s.xp AND level BETWEEN 2 AND 99""",
    "milestones_crossed": f"""WITH {_LEDGER}, {_LEVELS}, s AS (SELECT user_id, skill, sum(xp) AS after_, sum(CASE WHEN started_at < '{SPLIT_AT}' THEN xp ELSE 0 END) AS before FROM ledger GROUP BY 1, 2),
      t AS (SELECT user_id, sum(greatest(1, coalesce({_LEVEL.format('before')}, 1))) AS low, sum(greatest(1, coalesce({_LEVEL.format('after_')}, 1))) AS high FROM s GROUP BY 1)
      SELECT user_id, CAST(m AS INT) AS milestone FROM t, (SELECT unnest({list(MILESTONES)}) AS m) WHERE m > low AND m <= high""",
    "skills_panel": f"""WITH {_LEDGER}, {_STATE}, {rules_sql()}, x AS (SELECT u.user_id, r.skill, display_order, coalesce(s.xp, 0) AS xp,
        CASE WHEN coalesce(s.xp, 0) <= 0 THEN 'untrained' ELSE 'trained_' || skill_kind END AS part
        FROM (SELECT DISTINCT user_id FROM state) u CROSS JOIN (SELECT * FROM rules WHERE enabled) r LEFT JOIN state s ON s.user_id = u.user_id AND s.skill = r.skill)
      SELECT user_id, part, CAST(row_number() OVER (PARTITION BY user_id, part ORDER BY display_order, skill) AS INT) AS place, skill, xp FROM x""",
    "latest_traced_run": f"""WITH {_ACTIVE}, p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY started_at DESC, activity_id DESC) AS place FROM a)
      SELECT user_id, min_by(activity_id, place) AS activity_id FROM p WHERE place <= 20 AND has_trace AND status <> 'TOMBSTONED' GROUP BY 1""",
    "first_traced_run": f"WITH {_ACTIVE} SELECT user_id, min(started_at) AS started_at, min_by(activity_id, (started_at, activity_id)) AS activity_id FROM a WHERE has_trace AND status <> 'TOMBSTONED' GROUP BY 1",
    "keyset_page": f"""WITH {_ACTIVE} SELECT started_at, activity_id, kind, has_trace FROM a
      WHERE user_id = 3 AND (started_at < '2023-06-01' OR (started_at = '2023-06-01' AND activity_id < 7000)) ORDER BY started_at DESC, activity_id DESC LIMIT 50""",
    "history_upto": f"""WITH {_ACTIVE} SELECT user_id, kind, count(*) AS runs, round(sum(distance_m) / 1000, 2) AS km FROM a
      WHERE started_at <= '{SPLIT_AT}' AND status <> 'TOMBSTONED' GROUP BY 1, 2""",
    "cursor_codec": f"""WITH {_ACTIVE} SELECT activity_id, rtrim(replace(replace(base64(encode('{{"s":"' || strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') || '","i":"' || activity_id || '"}}')), '+', '-'), '/', '_'), '=') AS cursor,
      activity_id AS back FROM a""",
    "activity_ledger": f"WITH {_LEDGER} SELECT user_id, activity_id, line, skill, reason, xp FROM ledger",
    "skill_snapshot": f"WITH {_LEDGER}, {_STATE} SELECT user_id, string_agg(skill || '=' || xp, ';' ORDER BY skill || '=' || xp) AS skills, CAST(sum(xp) AS BIGINT) AS total FROM state GROUP BY 1",
    "ledger_audit": f"""WITH {_LEDGER}, f AS (SELECT activity_id, CAST(sum(xp) AS BIGINT) AS xp, count(*) AS n FROM ledger GROUP BY 1)
      SELECT activity_id, 'xp' AS field, xp + 1 AS stored, xp AS found FROM f WHERE activity_id % 97 = 0
      UNION ALL SELECT activity_id, 'n_rows', n - 1, n FROM f WHERE activity_id % 89 = 0""",
    "sweep_metrics": f"""WITH {_ACTIVE} SELECT source, CASE WHEN status = 'TOMBSTONED' THEN 'withdrawn' WHEN has_trace THEN 'present' ELSE 'enqueued' END AS outcome,
      count(*) AS n, count(DISTINCT user_id) AS users FROM a GROUP BY 1, 2""",
}
