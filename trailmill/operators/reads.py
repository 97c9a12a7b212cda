"""Reads of the ledger and of activities: tallies, standings, crossings, pages.

A ledger row is (user_id, activity_id, started_at, line, skill, reason, xp,
rules_version); floors are rows of reason ``floor``.  The order of a skill's
history is (started_at, activity_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.operators.scoring import cumulative_xp, level_for_xp, level_progress

RECENT = 10
#: Rows that a search for a traced run looks at, newest first.
SCANNED = 20
PAGE = 50


def newest_version(ledger: DataFrame) -> DataFrame:
    """The rows of each activity's newest rule version, floors left out."""
    newest = F.max("rules_version").over(Window.partitionBy("activity_id"))
    return ledger.filter("reason <> 'floor'").withColumn("newest", newest).filter("rules_version = newest").drop("newest")


def run_ledger(ledger: DataFrame) -> DataFrame:
    """(activity_id, skill, xp, place): what a run paid by its newest rules, largest first."""
    sums = newest_version(ledger).groupBy("activity_id", "skill").agg(F.sum("xp").alias("xp")).filter("xp > 0")
    return sums.withColumn("place", F.row_number().over(Window.partitionBy("activity_id").orderBy(F.desc("xp"), "skill")))


def breakdown(ledger: DataFrame) -> DataFrame:
    """(activity_id, skill, xp, parts): the reasons of a run's XP as text, in order of reason."""
    parts = newest_version(ledger).groupBy("activity_id", "skill", "reason").agg(F.sum("xp").alias("xp")).filter("xp > 0")
    text = F.concat_ws(" ", "reason", F.col("xp").cast("string"))
    return parts.groupBy("activity_id", "skill").agg(F.sum("xp").alias("xp"), F.array_join(F.array_sort(F.collect_list(text)), ", ").alias("parts"))


def standings(ledger: DataFrame) -> DataFrame:
    """(user_id, skill, activity_id, started_at, gained, before): XP of each skill before a run and from it.

    Only positive rows count, and every floor does from the start, whenever it was written.
    """
    paid = ledger.filter("xp > 0")
    keys = ("user_id", "skill")
    is_floor = F.col("reason") == "floor"
    gained = F.sum(F.when(~is_floor, F.col("xp")).otherwise(0))
    runs = paid.groupBy(*keys, "activity_id", "started_at").agg(gained.alias("gained"), F.sum(F.when(is_floor, F.col("xp")).otherwise(0)).alias("floors"))
    history = Window.partitionBy(*keys)
    earlier = history.orderBy("started_at", "activity_id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("gained").over(earlier), F.lit(0)) + F.sum("floors").over(history)
    return runs.withColumn("before", before).filter("gained > 0").drop("floors")


def landmarks(standing: DataFrame) -> DataFrame:
    """(user_id, skill, level, activity_id, arc): the levels that each run crossed, and how far along it.

    Levels are a closed form of XP, so crossings are a sequence between two
    levels and no range join with the thresholds.
    """
    low, high = level_for_xp(F.col("before")), level_for_xp(F.col("before") + F.col("gained"))
    crossed = standing.withColumns({"low": low, "high": high}).filter("high > low").withColumn("level", F.explode(F.sequence(F.col("low") + 1, F.col("high"))))
    arc = (cumulative_xp(F.col("level").cast("long")) - F.col("before")) / F.col("gained")
    return crossed.select("user_id", "skill", "level", "activity_id", F.greatest(F.lit(0.0), F.least(F.lit(1.0), arc)).alias("arc"))


def recent_sessions(ledger: DataFrame, version: int, most: int = RECENT) -> DataFrame:
    """(user_id, skill, activity_id, xp, place): the last sessions that paid, by the current rules."""
    rows = ledger.filter((F.col("rules_version") == version) & (F.col("reason") != "floor") & (F.col("xp") > 0))
    sums = rows.groupBy("user_id", "skill", "activity_id", "started_at").agg(F.sum("xp").alias("xp"))
    latest = Window.partitionBy("user_id", "skill").orderBy(F.desc("started_at"), F.desc("activity_id"))
    return sums.withColumn("place", F.row_number().over(latest)).filter(F.col("place") <= most).drop("started_at")


def next_level(states: DataFrame, sessions: DataFrame, order: DataFrame) -> DataFrame:
    """(user_id, skill, runs): the skill with the fewest median sessions to its next level; ties to the first shown.

    ``states``: (user_id, skill, xp); ``order``: (skill, display_order), a fixed table.
    """
    medians = sessions.groupBy("user_id", "skill").agg(F.median("xp").alias("median_xp"))
    to_next = level_progress(F.col("xp"), F.lit(1))["xp_to_next"]
    left = states.withColumn("xp_to_next", to_next).filter("xp_to_next > 0").join(medians, ["user_id", "skill"]).join(order, "skill")
    runs = F.ceil(F.col("xp_to_next") / F.col("median_xp")).cast("long")
    best = left.groupBy("user_id").agg(F.min(F.struct(runs.alias("runs"), "display_order", "skill")).alias("b"))
    return best.select("user_id", "b.skill", "b.runs")


def level_cards(before: DataFrame, after: DataFrame) -> DataFrame:
    """(user_id, skill, level): one card for each level between two states, in order."""
    b = before.select("user_id", "skill", level_for_xp(F.col("xp")).alias("low"))
    joined = after.select("user_id", "skill", level_for_xp(F.col("xp")).alias("high")).join(b, ["user_id", "skill"], "left").withColumn("low", F.coalesce("low", F.lit(1)))
    return joined.filter("high > low").select("user_id", "skill", F.explode(F.sequence(F.col("low") + 1, F.col("high"))).alias("level"))


def milestones(totals: DataFrame, ladder: tuple[int, ...]) -> DataFrame:
    """(user_id, milestone): rungs of the ladder above ``low`` and not above ``high``."""
    rungs = F.filter(F.array(*map(F.lit, ladder)), lambda m: (m > F.col("low")) & (m <= F.col("high")))
    return totals.select("user_id", F.explode(rungs).alias("milestone"))


def latest_traced(activities: DataFrame, scanned: int = SCANNED) -> DataFrame:
    """(user_id, activity_id): the newest run with a trace that is not withdrawn, among a user's last ``scanned``."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("started_at"), F.desc("activity_id"))
    rows = activities.withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= scanned)
    good = rows.filter("has_trace AND coalesce(status, 'ACTIVE') <> 'TOMBSTONED'")
    return good.groupBy("user_id").agg(F.min_by("activity_id", "place").alias("activity_id"))


def keyset_page(activities: DataFrame, user_id: int, started_at: Column, activity_id: int, size: int = PAGE) -> DataFrame:
    """One page of a user's runs after a cursor, newest first: a filter and a bounded top, no offset."""
    before = (F.col("started_at") < started_at) | ((F.col("started_at") == started_at) & (F.col("activity_id") < activity_id))
    return activities.filter((F.col("user_id") == user_id) & before).orderBy(F.desc("started_at"), F.desc("activity_id")).limit(size)


def cursor(started_at: Column, activity_id: Column) -> Column:
    """A page's cursor: its JSON in the URL alphabet of base64, without padding."""
    text = F.concat(F.lit('{"s":"'), F.date_format(started_at, "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit('","i":"'), activity_id.cast("string"), F.lit('"}'))
    return F.rtrim(F.translate(F.base64(text.cast("binary")), "+/", "-_"), F.lit("="))


def from_cursor(text: Column) -> Column:
    """(s, i) of a cursor, null if it is none."""
    plain = F.translate(text, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    body = F.when(text.rlike("^[A-Za-z0-9_-]+$") & (F.length(text) % 4 != 1), F.unbase64(padded).cast("string"))
    found = F.from_json(body, "s string, i string")
    return F.when(found["s"].isNotNull() & found["i"].isNotNull(), found)


def panel(rules: DataFrame, states: DataFrame) -> DataFrame:
    """(user_id, part, place, skill, xp): enabled skills in the order shown, trained ones by kind before untrained.

    ``states``: (user_id, skill, xp); every user gets every skill of the fixed table.
    """
    users = states.select("user_id").distinct()
    own = rules.filter("enabled").select("skill", "skill_kind", "display_order")
    rows = users.join(own).join(states, ["user_id", "skill"], "left").withColumn("xp", F.coalesce("xp", F.lit(0)))
    part = F.when(F.col("xp") <= 0, "untrained").otherwise(F.concat(F.lit("trained_"), "skill_kind"))
    place = F.row_number().over(Window.partitionBy("user_id", "part").orderBy("display_order", "skill"))
    return rows.withColumn("part", part).withColumn("place", place).select("user_id", "part", "place", "skill", "xp")


def mismatches(stored: DataFrame, found: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, stored, found): fields that differ between a stored table and what its source gives now."""
    f = found.select(F.col(key).alias("f_key"), *[F.col(c).alias(f"f_{c}") for c in fields])
    both = stored.join(f, F.col(key) == F.col("f_key"), "left")
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("long").alias("stored"), F.col(f"f_{c}").cast("long").alias("found")) for c in fields])
    return both.select(key, F.explode(each).alias("x")).select(key, "x.*").filter(~F.col("stored").eqNullSafe(F.col("found")))
