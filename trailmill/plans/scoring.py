"""Queries of the rule and scoring operators, with their SQL."""

from pyspark.sql import functions as F

from trailmill.operators import rules as r
from trailmill.operators import scoring as s
from trailmill.plans.discovery import CLASSIFIED_SQL, _COUNTS, classified
from trailmill.operators import discovery as d
from trailmill.sources.tables import ACTIVITIES_SQL, SETS_SQL, activities, sets, table


def selected(spark, sf_dir):
    return r.select_skills(activities(spark, sf_dir), r.rules(spark))


def scored(spark, sf_dir):
    return s.score_units(selected(spark, sf_dir), sets(spark, sf_dir), r.exercises(spark))


def awards(spark, sf_dir):
    return d.awards(classified(spark, sf_dir), "activity_id")


def grounded(spark, sf_dir):
    split = awards(spark, sf_dir).select("activity_id", *[F.col(f"{a}_cells").cast("double").alias(f"m_{b}") for a, b in (("new", "new"), ("rearmed", "rearmed"), ("cooled", "recent"))])
    return s.rate_ground(scored(spark, sf_dir), split)


def ledger(spark, sf_dir):
    return s.ledger_rows(grounded(spark, sf_dir), awards(spark, sf_dir), r.rules(spark))


def rule_select(spark, sf_dir):
    return selected(spark, sf_dir).select("activity_id", "measure", "skill")


def rule_candidates(spark, sf_dir):
    return r.candidates(activities(spark, sf_dir), r.rules(spark)).groupBy("kind", "has_trace", "measure").agg(F.count("*").alias("n"), F.count_distinct("skill").alias("skills"))


def rule_sets(spark, sf_dir):
    """Parts as rules of many tables, a dozen a table, with faults of every kind."""
    k, size = F.col("p_partkey"), F.col("p_size")
    name = lambda n: F.concat(F.lit("s"), n.cast("string"))
    meta = size % 3 == 0
    kind = lambda n: F.element_at(F.array(*map(F.lit, ("run", "walk,hike", "ride", "strength,other", "run,ride"))), (n % 5 + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.floor(k / 12).alias("set_id"), name(F.when(k % 37 == 0, 0).otherwise(k % 12)).alias("skill"), F.when(meta, "meta").otherwise("activity").alias("skill_kind"), (k % 9 > 0).alias("enabled"),
        (size % 7).alias("introduced_in"), (k % 12 * 10).cast("int").alias("display_order"), F.when(k % 4 > 0, kind(k)).alias("kinds"), F.when(k % 3 > 0, k % 2 == 0).alias("requires_trace"),
        F.when((k % 11 > 0) & (~meta | (k % 5 == 0)), F.when(k % 2 == 0, "distanceKm").otherwise("seconds:yoga")).alias("measure"), F.when(k % 6 > 0, size % 2).alias("priority"),
        (F.col("p_retailprice") / 100 - F.when(k % 17 == 0, 1000).otherwise(0)).alias("xp_per_unit"), F.when(k % 5 > 0, (size - 2).cast("double")).alias("soft_cap"), F.when(k % 13 > 0, k % 2 == 0).alias("reveals"),
        F.when(k % 8 == 0, "").otherwise(F.concat_ws(",", name(k * 7 % 14), F.when(k % 10 == 0, name(k % 12)))).alias("feeds"),
    )


def known_kinds(spark, sf_dir):
    return r.known_kinds(rule_sets(spark, sf_dir), "set_id")


def rule_violations(spark, sf_dir):
    return r.violations(rule_sets(spark, sf_dir), "set_id")


def feed_cycles(spark, sf_dir):
    return r.feed_cycles(rule_sets(spark, sf_dir), "set_id")


def rule_ambiguities(spark, sf_dir):
    return r.ambiguities(rule_sets(spark, sf_dir), "set_id")


def log_rows(spark, sf_dir):
    """Parts as exercises of the tables' skills."""
    k = F.col("p_partkey")
    entry = F.element_at(F.array(*map(F.lit, ("count", "minutes", "seconds", "distance"))), (F.col("p_size") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select(F.floor(k / 12).alias("set_id"), F.concat(F.lit("s"), (k % 5).cast("string")).alias("skill"), F.col("p_name").alias("exercise"), entry.alias("entry"), F.when(k % 2 == 0, F.col("p_size").cast("double")).alias("scale"))
    return r.log_rows(rule_sets(spark, sf_dir), rows, "set_id")


def score_units(spark, sf_dir):
    return scored(spark, sf_dir).select("activity_id", "skill", F.round("units", 6).alias("units"))


def reveal_gate(spark, sf_dir):
    return s.reveals_ground(scored(spark, sf_dir))


def soft_cap(spark, sf_dir):
    rows = scored(spark, sf_dir).filter("soft_cap IS NOT NULL")
    return rows.select("activity_id", "skill", F.round(s.soft_cap(F.col("units"), F.col("soft_cap")), 4).alias("capped"))


def ground_rate(spark, sf_dir):
    return grounded(spark, sf_dir).select("activity_id", "skill", "reason", F.round("units", 9).alias("units"), F.round("units_effective", 9).alias("units_effective"))


def discovery_rows(spark, sf_dir):
    return s.discovery_rows(awards(spark, sf_dir), r.rules(spark)).select("activity_id", "skill", "reason", "units", F.round("units_effective", 4).alias("units_effective"))


def ledger_rows(spark, sf_dir):
    return ledger(spark, sf_dir).select("id", "user_id", "skill", "reason", F.round("units", 9).alias("units"), F.round("units_effective", 9).alias("units_effective"), "xp", "seq")


def xp_by_skill(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("user_id", "skill").agg(F.sum("xp").alias("xp"), F.count("*").alias("n_rows"))


def level_for_xp(spark, sf_dir):
    """Every threshold and its neighbours, from the order keys."""
    xp = F.col("o_orderkey") * 97
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(xp.alias("xp"), s.level_for_xp(xp).cast("int").alias("level"))


def level_table(spark, sf_dir):
    """Of every level that an order's number names: its XP, what is missing to the next, and the levels at it and just below."""
    level = F.col("level")
    return table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 98 + 1).alias("level")).distinct().select(
        "level", s.cumulative_xp(level).alias("xp"), (level * level * s.STEP).alias("to_advance"),
        s.level_for_xp(s.cumulative_xp(level)).cast("int").alias("at"), s.level_for_xp(s.cumulative_xp(level) - 1).cast("int").alias("below"),
    )


def skill_state(spark, sf_dir):
    return ledger(spark, sf_dir).groupBy("user_id", "skill").agg(F.sum("xp").alias("xp"), F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"))


def level_progress(spark, sf_dir):
    parts = s.level_progress(F.col("xp"), F.lit(20))
    return skill_state(spark, sf_dir).select("user_id", "skill", "xp", parts["level"].alias("level"), parts["xp_to_next"].alias("xp_to_next"), F.round(parts["fraction"], 6).alias("fraction"))


def total_level(spark, sf_dir):
    """Over enabled skills, those without a row at level 1."""
    skills = r.rules(spark).filter("enabled").select("skill")
    users = activities(spark, sf_dir).select("user_id").distinct()
    state = skill_state(spark, sf_dir)
    rows = users.join(F.broadcast(skills)).join(state, ["user_id", "skill"], "left")
    return rows.groupBy("user_id").agg(F.sum(s.level_for_xp(F.coalesce("xp", F.lit(0))).cast("long")).alias("total_level"), F.sum(F.coalesce("xp", F.lit(0))).alias("total_xp"), (F.count("*") * 99).alias("ceiling"))


def award_clamp(spark, sf_dir):
    a = awards(spark, sf_dir)
    cells = F.col("new_cells") + F.col("cooled_cells") + F.col("rearmed_cells")
    return s.clamp_award(a.select("activity_id", cells.alias("cells"), (F.col("activity_id") % 4).alias("credited_new"), (F.col("activity_id") % 3).alias("credited_rearmed"), F.col("cooled_cells").alias("cooled")))


def reconcile_floors(spark, sf_dir):
    """A replay without the manual activities: floors for what users were shown before."""
    rows = ledger(spark, sf_dir)
    total = lambda df: df.groupBy("user_id", "skill").agg(F.sum("xp").alias("xp"))
    kept = rows.filter("activity_id % 3 <> 0")
    return s.floors(total(rows), total(kept), total(rows.filter("activity_id % 9 = 0")))


def rescore_diff(spark, sf_dir):
    """Runs corrected to walks above a distance, rides to runs: how the ledger changes."""
    a = activities(spark, sf_dir)
    fixed = a.withColumn("kind", F.when(F.col("kind") == "ride", "run").otherwise(F.col("kind"))).withColumn("distance_m", F.when(F.col("activity_id") % 20 == 0, F.col("distance_m") * 2).otherwise(F.col("distance_m")))

    def rated(rows):
        g = s.rate_ground(s.score_units(r.select_skills(rows, r.rules(spark)), sets(spark, sf_dir), r.exercises(spark)), awards(spark, sf_dir).select("activity_id", F.lit(None).cast("double").alias("m_new"), F.lit(None).cast("double").alias("m_rearmed"), F.lit(None).cast("double").alias("m_recent")))
        g = g.withColumn("xp", s.xp(F.col("units_effective"), F.col("xp_per_unit"))).filter("xp > 0")
        return g.withColumn("id", F.concat_ws("#", F.col("activity_id").cast("string"), "skill", "reason", F.lit("v5")))

    return s.rescore_diff(rated(a), rated(fixed))


QUERIES = {
    f.__name__: f
    for f in (
        rule_select, rule_candidates, known_kinds, log_rows, rule_violations, feed_cycles, rule_ambiguities, score_units, reveal_gate, soft_cap, ground_rate,
        discovery_rows, ledger_rows, xp_by_skill, level_for_xp, level_table, level_progress, total_level, award_clamp, reconcile_floors, rescore_diff,
    )
}

_MATCH = "skill_kind = 'activity' AND enabled AND measure IS NOT NULL AND list_contains(string_split(kinds, ','), kind) AND (requires_trace IS NULL OR requires_trace = has_trace)"


def scored_sql(source: str = "SELECT * FROM activities", prefix: str = "") -> str:
    """CTEs from activities to units; ``prefix`` tells two runs apart."""
    return f"""{prefix}selected AS (
  SELECT * EXCLUDE (k) FROM (SELECT a.*, ru.*, row_number() OVER (PARTITION BY activity_id, measure ORDER BY coalesce(priority, 0) DESC, skill) AS k
    FROM ({source}) a JOIN rules ru ON {_MATCH}) WHERE k = 1
), {prefix}set_units AS (
  SELECT s.activity_id, s.skill, sum(CASE WHEN x.scale IS NOT NULL THEN (CASE WHEN x.entry = 'count' THEN t.reps ELSE t.duration_s END) * x.scale
      WHEN t.exercise = string_split(measure, ':')[2] THEN CAST(t.duration_s AS DOUBLE) END) AS set_units
  FROM {prefix}selected s JOIN sets t ON s.activity_id = t.activity_id LEFT JOIN exercises x ON x.skill = s.skill AND x.exercise = t.exercise AND x.scale IS NOT NULL
  WHERE measure LIKE '%:%' GROUP BY 1, 2
), {prefix}scored AS (
  SELECT * FROM (SELECT s.*, CASE WHEN measure = 'distanceKm' THEN distance_m / 1000 ELSE coalesce(set_units, 0) END AS units
    FROM {prefix}selected s LEFT JOIN {prefix}set_units USING (activity_id, skill)) WHERE units > 0)"""


_CAP = "CASE WHEN soft_cap IS NULL THEN units ELSE least(units, soft_cap) + greatest(0, least(units - soft_cap, soft_cap)) * 0.5::DOUBLE + greatest(0, least(units - soft_cap * 2, soft_cap * 4)) * 0.25::DOUBLE END"
_BASE = f"{CLASSIFIED_SQL}, {r.rules_sql()}, {r.exercises_sql()}, activities AS ({ACTIVITIES_SQL}), sets AS ({SETS_SQL}), awards AS (SELECT activity_id, {_COUNTS} FROM classified GROUP BY 1), {scored_sql()}"


def grounded_sql(prefix: str = "", split: bool = True) -> str:
    part = lambda c: f"coalesce(CAST({c} AS DOUBLE), 0)" if split else "0::DOUBLE"
    return f"""{prefix}shared AS (
  SELECT *, CASE WHEN total > 0 THEN n / total ELSE 0 END AS sn, CASE WHEN total > 0 THEN a / total ELSE 0 END AS sa, CASE WHEN total > 0 THEN c / total ELSE 1 END AS sc
  FROM (SELECT *, n + a + c AS total FROM (SELECT s.*, {part('new_cells')} AS n, {part('rearmed_cells')} AS a, {part('cooled_cells')} AS c, {_CAP} AS capped
    FROM {prefix}scored s LEFT JOIN awards USING (activity_id)))
), {prefix}grounded AS (
  SELECT user_id, activity_id, started_at, skill, measure, xp_per_unit, feeds, 0 AS pos,
    CASE string_split(measure, ':')[1] WHEN 'distanceKm' THEN 'distance' WHEN 'reps' THEN 'reps' ELSE 'duration' END AS reason, units, capped AS units_effective FROM {prefix}shared WHERE ground_new IS NULL
  UNION ALL SELECT user_id, activity_id, started_at, skill, measure, xp_per_unit, feeds, pos, reason, b, b * (capped / units) * mult FROM (
    SELECT *, 0 AS pos, 'new_ground' AS reason, ground_new AS mult, CASE WHEN sa = 0 AND sc = 0 THEN units ELSE units * sn END AS b FROM {prefix}shared WHERE ground_new IS NOT NULL AND sn > 0
    UNION ALL SELECT *, 1, 'rearmed_ground', ground_rearmed, CASE WHEN sc = 0 THEN units - units * sn ELSE units * sa END FROM {prefix}shared WHERE ground_new IS NOT NULL AND sa > 0
    UNION ALL SELECT *, 2, 'recent_ground', ground_recent, units - (units * sn + units * sa) FROM {prefix}shared WHERE ground_new IS NOT NULL AND sc > 0))"""


LEDGER_SQL = f"""{_BASE}, {grounded_sql()}, rated AS (
  SELECT * FROM (SELECT *, CAST(floor(units_effective * xp_per_unit + 0.5::DOUBLE) AS BIGINT) AS xp FROM grounded) WHERE xp > 0
), found AS (
  SELECT * FROM (SELECT a.activity_id, skill, display_order, k AS pos, 'cells_' || c AS reason, CAST(CASE WHEN k = 0 THEN new_cells ELSE rearmed_cells END AS DOUBLE) AS units,
      CASE WHEN k = 0 THEN new_cells * cells_new ELSE rearmed_cells * cells_rearmed END AS units_effective, CASE WHEN k = 0 THEN cells_new ELSE cells_rearmed END AS mult, xp_per_unit
    FROM awards a, rules, (VALUES (0, 'new'), (1, 'rearmed')) t(k, c) WHERE enabled AND cells_new IS NOT NULL) WHERE units > 0 AND mult > 0
), fed AS (
  SELECT activity_id, target AS skill, CAST(sum(xp) AS DOUBLE) AS units, sum(xp * {r.FEED_RATE}::DOUBLE) AS units_effective
  FROM (SELECT activity_id, xp, unnest(string_split(feeds, ',')) AS target FROM rated) JOIN (SELECT skill AS t FROM rules WHERE enabled) ON target = t GROUP BY 1, 2
), all_rows AS (
  SELECT activity_id, skill, reason, units, units_effective, xp, 0 AS part, measure AS major, pos FROM rated
  UNION ALL SELECT activity_id, skill, reason, units, units_effective, CAST(floor(units_effective * xp_per_unit + 0.5::DOUBLE) AS BIGINT), 1, lpad(CAST(display_order AS VARCHAR), 5, '0'), pos FROM found
  UNION ALL SELECT activity_id, skill, 'constitution_share', units, units_effective, CAST(floor(units_effective + 0.5::DOUBLE) AS BIGINT), 2, skill, 0 FROM fed
), ledger AS (
  SELECT activity_id || '#' || skill || '#' || reason || '#v5' AS id, user_id, activity_id, started_at, skill, reason, units, units_effective, xp,
    strftime(started_at, '%Y-%m-%dT%H:%M:%SZ') || '#' || activity_id || '#' || lpad(CAST(row_number() OVER (PARTITION BY activity_id ORDER BY part, major, pos) - 1 AS VARCHAR), 2, '0') AS seq
  FROM all_rows JOIN (SELECT DISTINCT activity_id, user_id, started_at FROM grounded) USING (activity_id) WHERE xp > 0)"""

LEVEL_SQL = "CAST((SELECT greatest(1, count(*)) FROM (SELECT 4 * (l - 1) * l * (2 * l - 1) // 6 AS c FROM range(1, 100) t(l)) WHERE c <= {xp}) AS INT)"

_RULE_SETS = """t AS (SELECT p_partkey // 12 AS set_id, 's' || (CASE WHEN p_partkey % 37 = 0 THEN 0 ELSE p_partkey % 12 END) AS skill, CASE WHEN p_size % 3 = 0 THEN 'meta' ELSE 'activity' END AS skill_kind, p_partkey % 9 > 0 AS enabled,
  p_size % 7 AS introduced_in, CAST(p_partkey % 12 * 10 AS INT) AS display_order, CASE WHEN p_partkey % 4 > 0 THEN ['run', 'walk,hike', 'ride', 'strength,other', 'run,ride'][p_partkey % 5 + 1] END AS kinds,
  CASE WHEN p_partkey % 3 > 0 THEN p_partkey % 2 = 0 END AS requires_trace, CASE WHEN p_partkey % 11 > 0 AND (p_size % 3 > 0 OR p_partkey % 5 = 0) THEN CASE WHEN p_partkey % 2 = 0 THEN 'distanceKm' ELSE 'seconds:yoga' END END AS measure,
  CASE WHEN p_partkey % 6 > 0 THEN p_size % 2 END AS priority, p_retailprice / 100 - CASE WHEN p_partkey % 17 = 0 THEN 1000 ELSE 0 END AS xp_per_unit, CASE WHEN p_partkey % 5 > 0 THEN CAST(p_size - 2 AS DOUBLE) END AS soft_cap,
  CASE WHEN p_partkey % 13 > 0 THEN p_partkey % 2 = 0 END AS reveals, CASE WHEN p_partkey % 8 = 0 THEN '' ELSE 's' || (p_partkey * 7 % 14) || CASE WHEN p_partkey % 10 = 0 THEN ',s' || (p_partkey % 12) ELSE '' END END AS feeds FROM part)"""

ORACLE_SQL = {
    "rule_select": f"WITH {_BASE} SELECT activity_id, measure, skill FROM selected",
    "rule_candidates": f"WITH {_BASE} SELECT kind, has_trace, measure, count(*) AS n, count(DISTINCT skill) AS skills FROM activities JOIN rules ON {_MATCH} GROUP BY 1, 2, 3",
    "known_kinds": f"WITH {_RULE_SETS} SELECT DISTINCT set_id, unnest(string_split(kinds, ',')) AS kind FROM t WHERE kinds IS NOT NULL",
    "rule_violations": f"""WITH {_RULE_SETS}, f AS (SELECT set_id, skill, unnest(string_split(feeds, ',')) AS target FROM t)
      SELECT set_id, 'skills.' || skill AS path, unnest(list_filter([CASE WHEN skill_kind = 'activity' AND measure IS NULL THEN 'needs a match' END, CASE WHEN skill_kind = 'activity' AND reveals IS NULL THEN 'needs reveals' END,
        CASE WHEN skill_kind = 'meta' AND measure IS NOT NULL THEN 'meta must not match' END, CASE WHEN xp_per_unit < 0 THEN 'negative rate' END, CASE WHEN soft_cap <= 0 THEN 'soft cap must be positive' END,
        CASE WHEN introduced_in > 5 THEN 'introduced after this version' END], lambda x: x IS NOT NULL)) AS message FROM t
      UNION ALL SELECT set_id, 'skills.' || skill, 'duplicate id' FROM t GROUP BY set_id, skill HAVING count(*) > 1
      UNION ALL SELECT set_id, 'skills.' || skill || '.feeds', 'unknown skill ' || target FROM f WHERE target <> '' AND NOT EXISTS (SELECT 1 FROM t WHERE t.set_id = f.set_id AND t.skill = f.target)""",
    "feed_cycles": f"""WITH RECURSIVE {_RULE_SETS}, e AS (SELECT DISTINCT set_id, skill AS a, unnest(string_split(feeds, ',')) AS b FROM t),
      p AS (SELECT set_id, a, b FROM e WHERE b <> '' UNION SELECT p.set_id, p.a, e.b FROM p JOIN e ON p.set_id = e.set_id AND p.b = e.a AND e.b <> '') SELECT set_id, a AS skill FROM p WHERE a = b""",
    "rule_ambiguities": f"""WITH {_RULE_SETS}, c AS (SELECT * FROM (VALUES ('run'), ('walk'), ('hike'), ('ride'), ('strength'), ('other')) k(kind), (VALUES (true), (false)) h(has_trace))
      SELECT set_id, kind, has_trace, measure, count(*) AS n, string_agg(skill, ',' ORDER BY skill) AS skills FROM (SELECT *, rank() OVER (PARTITION BY set_id, kind, has_trace, measure ORDER BY coalesce(priority, 0) DESC) AS k
      FROM c JOIN t ON skill_kind = 'activity' AND enabled AND measure IS NOT NULL AND (kinds IS NULL OR list_contains(string_split(kinds, ','), kind)) AND (requires_trace IS NULL OR requires_trace = has_trace)) WHERE k = 1 GROUP BY 1, 2, 3, 4 HAVING count(*) > 1""",
    "log_rows": f"""WITH {_RULE_SETS} SELECT t.set_id, display_order, t.skill, p_name AS exercise, ['count', 'minutes', 'seconds', 'distance'][p_size % 4 + 1] AS entry, CASE WHEN p_partkey % 2 = 0 THEN CAST(p_size AS DOUBLE) END AS scale
      FROM part JOIN t ON t.set_id = p_partkey // 12 AND t.skill = 's' || (p_partkey % 5) WHERE enabled AND skill_kind = 'activity'""",
    "score_units": f"WITH {_BASE} SELECT activity_id, skill, round(units, 6) AS units FROM scored",
    "reveal_gate": f"WITH {_BASE} SELECT activity_id, bool_or(reveals AND units >= min_units) AS reveals FROM scored GROUP BY 1",
    "soft_cap": f"WITH {_BASE} SELECT activity_id, skill, round({_CAP}, 4) AS capped FROM scored WHERE soft_cap IS NOT NULL",
    "ground_rate": f"WITH {_BASE}, {grounded_sql()} SELECT activity_id, skill, reason, round(units, 9) AS units, round(units_effective, 9) AS units_effective FROM grounded",
    "discovery_rows": f"WITH {LEDGER_SQL} SELECT activity_id, skill, reason, units, round(units_effective, 4) AS units_effective FROM found",
    "ledger_rows": f"WITH {LEDGER_SQL} SELECT id, user_id, skill, reason, round(units, 9) AS units, round(units_effective, 9) AS units_effective, xp, seq FROM ledger",
    "xp_by_skill": f"WITH {LEDGER_SQL} SELECT user_id, skill, CAST(sum(xp) AS BIGINT) AS xp, count(*) AS n_rows FROM ledger GROUP BY 1, 2",
    "level_for_xp": f"SELECT o_orderkey * 97 AS xp, {LEVEL_SQL.format(xp='o_orderkey * 97')} AS level FROM orders",
    "level_table": f"""SELECT level, xp, 4 * level * level AS to_advance, {LEVEL_SQL.format(xp='xp')} AS "at", {LEVEL_SQL.format(xp='xp - 1')} AS below
      FROM (SELECT l AS level, 4 * (l - 1) * l * (2 * l - 1) // 6 AS xp FROM (SELECT DISTINCT o_orderkey % 98 + 1 AS l FROM orders))""",
    "level_progress": f"""WITH {LEDGER_SQL}, st AS (SELECT user_id, skill, CAST(sum(xp) AS BIGINT) AS xp FROM ledger GROUP BY 1, 2), lv AS (SELECT *, least(99, greatest({LEVEL_SQL.format(xp='st.xp')}, 20)) AS level FROM st)
      SELECT user_id, skill, xp, level, CAST(CASE WHEN level >= 99 THEN 0 ELSE greatest(nx - greatest(xp, fl), 0) END AS BIGINT) AS xp_to_next,
        round(CASE WHEN level >= 99 THEN 1.0::DOUBLE ELSE least(greatest(xp - fl, 0), nx - fl) / (nx - fl) END, 6) AS fraction
      FROM (SELECT *, 4 * (level - 1) * level * (2 * level - 1) // 6 AS fl, 4 * level * (level + 1) * (2 * level + 1) // 6 AS nx FROM (SELECT user_id, skill, xp, CAST(level AS BIGINT) AS level FROM lv))""",
    "total_level": f"""WITH {LEDGER_SQL}, st AS (SELECT user_id, skill, CAST(sum(xp) AS BIGINT) AS xp FROM ledger GROUP BY 1, 2),
      g AS (SELECT u.user_id, e.skill, coalesce(xp, 0) AS xp FROM (SELECT DISTINCT user_id FROM activities) u CROSS JOIN (SELECT skill FROM rules WHERE enabled) e LEFT JOIN st USING (user_id, skill))
      SELECT user_id, CAST(sum({LEVEL_SQL.format(xp='g.xp')}) AS BIGINT) AS total_level, CAST(sum(xp) AS BIGINT) AS total_xp, count(*) * 99 AS ceiling FROM g GROUP BY 1""",
    "award_clamp": f"""WITH {_BASE}, f AS (SELECT activity_id, new_cells + cooled_cells + rearmed_cells AS cells, activity_id % 4 AS cn, activity_id % 3 AS cr, cooled_cells AS cooled FROM awards)
      SELECT activity_id, least(cn, cells) AS new_cells, least(cr, cells - least(cn, cells)) AS rearmed_cells,
        least(cooled, cells - least(cn, cells) - least(cr, cells - least(cn, cells))) AS cooled_cells,
        cells - least(cn, cells) - least(cr, cells - least(cn, cells)) - least(cooled, cells - least(cn, cells) - least(cr, cells - least(cn, cells))) AS deferred_cells FROM f""",
    "reconcile_floors": f"""WITH {LEDGER_SQL}, w AS (SELECT user_id, skill, sum(xp) AS xp, coalesce(sum(xp) FILTER (activity_id % 3 <> 0), 0) + coalesce(sum(xp) FILTER (activity_id % 9 = 0), 0) AS have FROM ledger GROUP BY 1, 2)
      SELECT user_id, skill, CAST(xp - have AS BIGINT) AS gap FROM w WHERE xp > have""",
    "rescore_diff": f"""WITH {_BASE}, a10 AS (SELECT * FROM activities),
      fixed AS (SELECT * REPLACE (CASE WHEN kind = 'ride' THEN 'run' ELSE kind END AS kind, CASE WHEN activity_id % 20 = 0 THEN distance_m * 2 ELSE distance_m END AS distance_m) FROM a10),
      {scored_sql('SELECT * FROM a10', 'o_')}, {grounded_sql('o_', False)}, {scored_sql('SELECT * FROM fixed', 'f_')}, {grounded_sql('f_', False)},
      o AS (SELECT * FROM (SELECT activity_id || '#' || skill || '#' || reason || '#v5' AS id, units, units_effective, CAST(floor(units_effective * xp_per_unit + 0.5::DOUBLE) AS BIGINT) AS xp FROM o_grounded) WHERE xp > 0),
      f AS (SELECT * FROM (SELECT activity_id || '#' || skill || '#' || reason || '#v5' AS id, units, units_effective, CAST(floor(units_effective * xp_per_unit + 0.5::DOUBLE) AS BIGINT) AS xp FROM f_grounded) WHERE xp > 0)
      SELECT coalesce(o.id, f.id) AS id, CASE WHEN f.id IS NULL THEN 'delete' WHEN o.id IS NULL THEN 'put' ELSE 'replace' END AS op, o.xp AS o_xp, f.xp AS f_xp
      FROM o FULL JOIN f ON o.id = f.id WHERE f.id IS NULL OR o.id IS NULL OR o.xp <> f.xp OR o.units <> f.units OR o.units_effective <> f.units_effective""",
}
