"""Rule tables as data: skills, what they match, what they pay.

A rule table is a handful of rows, fixed by its version; checks take many tables
at once, told apart by keys.  An activity gets one skill for each measure: the matching rule of
highest priority, ties to the smaller id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The current rule table (version 5) and its curve.
VERSION = 5
STEP = 4
MAX_LEVEL = 99
MILESTONES = (100, 150, 200, 250, 300, 400, 500)
SKILLS = (
    # id, kind, enabled, introduced_in, display_order, unit, kinds, requires_trace, measure, priority, xp_per_unit, soft_cap, min_units, ground, cells, reveals, feeds
    ("wayfaring", "activity", True, 1, 10, "km", "run,walk,hike", True, "distanceKm", 100, 100.0, None, 0.25, (1.0, 0.5, 0.5), None, True, "constitution"),
    ("vigil", "activity", True, 1, 15, "km", "run,walk,hike", False, "distanceKm", 100, 100.0, None, 0.25, None, None, False, "constitution"),
    ("roving", "activity", True, 1, 20, "km", "ride", True, "distanceKm", 100, 60.0, None, 0.5, None, None, False, "constitution"),
    ("cadence", "activity", True, 1, 25, "km", "ride", False, "distanceKm", 100, 60.0, None, 0.5, None, None, False, "constitution"),
    ("might", "activity", True, 1, 30, "second", "strength,other", None, "seconds:might", 100, 0.5, 3600.0, 8.0, None, None, False, "constitution,endurance"),
    ("footing", "activity", True, 5, 35, "second", "strength,other", None, "seconds:footing", 100, 0.5, 3600.0, 60.0, None, None, False, "constitution,endurance"),
    ("fortitude", "activity", True, 1, 40, "second", "strength,other", None, "seconds:fortitude", 100, 0.5, 3600.0, 6.0, None, None, False, "constitution,endurance"),
    ("poise", "activity", True, 4, 55, "second", "strength,other", None, "seconds:yoga", 100, 0.5, 3600.0, 60.0, None, None, False, "constitution"),
    ("cartography", "meta", True, 1, 60, "cell", None, None, None, None, 2.15, None, 0.0, None, (1.0, 0.5, 0.0), None, ""),
    ("constitution", "meta", True, 1, 70, "share", None, None, None, None, 1.0, None, 0.0, None, None, None, ""),
    ("endurance", "meta", True, 1, 75, "share", None, None, None, None, 1.0, None, 0.0, None, None, None, ""),
    ("slayer", "meta", False, 1, 80, "share", None, None, None, None, 1.0, None, 0.0, None, None, None, ""),
)
FEED_RATE = 0.3333
EXERCISES = (
    # skill, exercise, entry, scale
    ("vigil", "treadmill", "distance", None),
    ("might", "strength-upper", "minutes", 1.0),
    ("might", "pushup", "count", 8.0),
    ("footing", "strength-lower", "minutes", 1.0),
    ("fortitude", "strength-core", "minutes", 1.0),
    ("fortitude", "situp", "count", 6.0),
    ("fortitude", "plank", "seconds", 3.0),
    ("poise", "yoga", "minutes", None),
)
SCHEMA = (
    "skill string, skill_kind string, enabled boolean, introduced_in int, display_order int, unit string, kinds string, requires_trace boolean, measure string,"
    " priority int, xp_per_unit double, soft_cap double, min_units double, ground_new double, ground_rearmed double, ground_recent double,"
    " cells_new double, cells_rearmed double, cells_recent double, reveals boolean, feeds string"
)


def _flat() -> list[tuple]:
    none = (None, None, None)
    return [(*s[:13], *(s[13] or none), *(s[14] or none), *s[15:]) for s in SKILLS]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_flat(), SCHEMA)


def exercises(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXERCISES), "skill string, exercise string, entry string, scale double")


def _values(rows) -> str:
    text = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v).upper() if isinstance(v, bool) else str(v)
    return ", ".join("(" + ", ".join(map(text, r)) + ")" for r in rows)


def rules_sql() -> str:
    """The table in SQL, for the oracle queries."""
    typed = SCHEMA.replace(" string", " VARCHAR").replace(" boolean", " BOOLEAN").replace(" double", " DOUBLE").replace(" int", " INT")
    casts = ", ".join(f"CAST({c.split()[0]} AS {c.split()[1]}) AS {c.split()[0]}" for c in typed.split(","))
    names = ", ".join(c.split()[0] for c in typed.split(","))
    return f"rules AS (SELECT {casts} FROM (VALUES {_values(_flat())}) t({names}))"


def exercises_sql() -> str:
    return f"exercises AS (SELECT skill, exercise, entry, CAST(scale AS DOUBLE) AS scale FROM (VALUES {_values(EXERCISES)}) t(skill, exercise, entry, scale))"


def matches(sources: bool = False) -> Column:
    """Whether a rule matches an activity: empty kinds match any, a null requires_trace too; with ``sources``, so do empty lists of these."""
    listed = lambda c, v: F.col(c).isNull() | (F.col(c) == "") | F.array_contains(F.split(c, ","), F.col(v))
    trace = F.col("requires_trace").isNull() | (F.col("requires_trace") == F.col("has_trace"))
    found = (F.col("skill_kind") == "activity") & F.col("enabled") & F.col("measure").isNotNull() & listed("kinds", "kind") & trace
    return found & listed("sources", "source") if sources else found


def candidates(activities: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Every matching (activity, rule); the rule table is a few rows, so Spark sends it to the activities.  Rules may list sources."""
    return activities.join(rule_rows, matches("sources" in rule_rows.columns))


def select_skills(activities: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """One rule for each measure of each activity."""
    best = Window.partitionBy("activity_id", "measure").orderBy(F.desc(F.coalesce("priority", F.lit(0))), "skill")
    return candidates(activities, rule_rows).withColumn("place", F.row_number().over(best)).filter("place = 1").drop("place")


def violations(rule_rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, path, message): one row for each broken rule of each table."""
    checks = {
        "needs a match": (F.col("skill_kind") == "activity") & F.col("measure").isNull(),
        "needs reveals": (F.col("skill_kind") == "activity") & F.col("reveals").isNull(),
        "meta must not match": (F.col("skill_kind") == "meta") & F.col("measure").isNotNull(),
        "negative rate": F.col("xp_per_unit") < 0,
        "soft cap must be positive": F.col("soft_cap") <= 0,
        "introduced after this version": F.col("introduced_in") > VERSION,
    }
    path = F.concat(F.lit("skills."), "skill")
    found = F.array_compact(F.array(*[F.when(bad, F.lit(text)) for text, bad in checks.items()]))
    own = rule_rows.select(*keys, path.alias("path"), F.explode(found).alias("message"))
    twice = rule_rows.groupBy(*keys, "skill").agg(F.count("*").alias("n")).filter("n > 1").select(*keys, path.alias("path"), F.lit("duplicate id").alias("message"))
    ids = rule_rows.select(*keys, F.col("skill").alias("target"))
    dangling = _feeds(rule_rows, *keys).join(ids, [*keys, "target"], "left_anti").select(
        *keys, F.concat(path, F.lit(".feeds")).alias("path"), F.concat(F.lit("unknown skill "), "target").alias("message")
    )
    return own.unionByName(twice).unionByName(dangling)


def _feeds(rule_rows: DataFrame, *keys: str) -> DataFrame:
    return rule_rows.select(*keys, "skill", F.explode(F.split("feeds", ",")).alias("target")).filter("target <> ''")


def feed_cycles(rule_rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, skill): skills that feed themselves over others.  Paths double in length until no table has room for longer ones; a table's size bounds its pairs."""
    edges = _feeds(rule_rows, *keys).select(*keys, F.col("skill").alias("a"), F.col("target").alias("b")).distinct()
    sizes = rule_rows.groupBy(*keys).agg(F.count("*").alias("n")) if keys else rule_rows.agg(F.count("*").alias("n"))
    largest = sizes.agg(F.max("n")).first()[0] or 0
    reach = edges
    for _ in range(largest.bit_length()):
        onward = reach.select(*keys, F.col("b").alias("c"), F.col("a").alias("b"))
        longer = reach.join(onward, [*keys, "b"]).select(*keys, "a", F.col("c").alias("b"))
        reach = reach.unionByName(longer).distinct()
    return reach.filter("a = b").select(*keys, F.col("a").alias("skill"))


def known_kinds(rule_rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, kind): the kinds of activity that a table speaks of."""
    return rule_rows.filter("kinds IS NOT NULL").select(*keys, F.explode(F.split("kinds", ",")).alias("kind")).distinct()


def ambiguities(rule_rows: DataFrame, *keys: str, kinds: tuple[str, ...] = ("run", "walk", "hike", "ride", "strength", "other")) -> DataFrame:
    """(keys, kind, has_trace, measure, n, skills) where rules of equal top priority compete for a measure."""
    cases = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(t).alias("has_trace")) for k in kinds for t in (True, False)]))
    met = rule_rows.withColumn("case", cases).select("*", "case.*").filter(matches())
    top = Window.partitionBy(*keys, "kind", "has_trace", "measure").orderBy(F.desc(F.coalesce("priority", F.lit(0))))
    ranked = met.withColumn("rank", F.rank().over(top)).filter("rank = 1")
    return ranked.groupBy(*keys, "kind", "has_trace", "measure").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("skill")), ",").alias("skills")).filter("n > 1")


def log_rows(rule_rows: DataFrame, exercise_rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, display_order, skill, exercise, entry, scale): exercises of enabled activity skills, flattened in the order shown."""
    shown = rule_rows.filter("enabled AND skill_kind = 'activity'").select(*keys, "skill", "display_order")
    return exercise_rows.join(shown, [*keys, "skill"]).select(*keys, "display_order", "skill", "exercise", "entry", "scale")
