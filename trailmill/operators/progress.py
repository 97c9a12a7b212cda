"""Frontiers, explored sets and their generations, and what progress is worth showing.

All by user or by (user, cell); only small tables of rules and ladders are
joined without a key, and these are arguments of a handful of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions import geo
from trailmill.operators.discovery import REARM
from trailmill.operators.scoring import level_for_xp

#: A cluster worth a line: so much of it is new, and so far away.
MIN_NOVELTY, MIN_DISTANCE_M = 0.5, 250.0
KEPT_GENERATIONS = 20
DAYS_A_MONTH = 30.44


def novelty(last_run_at: Column, known: Column, now: Column, weights: dict[str, float]) -> Column:
    """A cell's weight: new if never visited, rearmed or recent by its last visit; without one recent."""
    rearmed = (now - last_run_at) >= F.expr(REARM)
    return F.when(~known, weights["new"]).when(F.coalesce(rearmed, F.lit(False)), weights["rearmed"]).otherwise(weights["recent"])


def frontier(disc: DataFrame, state: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Clusters of (user_id, now, lat, lng, cell, parent, parent_lat, parent_lng) by parent: mean novelty, distance, bearing and score."""
    s = state.select(F.col("user_id").alias("s_user"), F.col("cell").alias("s_cell"), "last_run_at")
    seen = disc.join(s, (F.col("user_id") == F.col("s_user")) & (F.col("cell") == F.col("s_cell")), "left")
    worth = seen.withColumn("w", novelty(F.col("last_run_at"), F.col("s_cell").isNotNull(), F.col("now"), weights))
    found = worth.groupBy("user_id", "parent", "lat", "lng", "parent_lat", "parent_lng").agg(F.avg("w").alias("novelty"))
    ends = [F.col(c) for c in ("lat", "lng", "parent_lat", "parent_lng")]
    metres = geo.metres(*ends)
    return found.select("user_id", "parent", "novelty", metres.alias("distance_m"), geo.bearing(*ends).alias("bearing"), (F.col("novelty") / F.greatest(F.lit(1.0), metres / 1000)).alias("score"))


def frontier_pick(clusters: DataFrame, name: Column | None = None) -> DataFrame:
    """Each user's best cluster that is new enough and far enough away, with its line."""
    best = Window.partitionBy("user_id").orderBy(F.desc("score"), "parent")
    fit = clusters.filter((F.col("novelty") >= MIN_NOVELTY) & (F.col("distance_m") >= MIN_DISTANCE_M))
    line = F.concat(F.format_string("Unclaimed ground %.1f km ", F.round(F.col("distance_m") / 1000, 1)), geo.compass(F.col("bearing")))
    line = line if name is None else F.concat(line, F.coalesce(F.concat(F.lit(" — "), name), F.lit("")))
    return fit.withColumn("k", F.row_number().over(best)).filter("k = 1").withColumn("line", line).drop("k")


def before_run(explored: DataFrame, run: DataFrame) -> DataFrame:
    """(user_id, cell) of the set without those of a run."""
    return explored.select("user_id", "cell").join(run.select("user_id", "cell"), ["user_id", "cell"], "left_anti")


def after_run(explored: DataFrame, run: DataFrame) -> DataFrame:
    return explored.select("user_id", "cell").unionByName(run.select("user_id", "cell")).distinct()


def apply_deltas(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """Sets (user_id, generation, cell) brought forward by deltas (user_id, from_gen, to_gen, cell).

    Deltas must follow each other from the set's own generation; behind a gap
    nothing is applied, and ``complete`` says whether the newest was reached.
    """
    steps = deltas.select("user_id", "from_gen", "to_gen").distinct()
    start = base.groupBy("user_id").agg(F.max("generation").alias("generation"))
    order = Window.partitionBy("user_id").orderBy("from_gen")
    ahead = steps.join(start, "user_id").filter("from_gen >= generation")
    fits = F.col("from_gen") == F.coalesce(F.lag("to_gen").over(order), F.col("generation"))
    chained = ahead.withColumn("gaps", F.sum((~fits).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    good = chained.filter("gaps = 0").select("user_id", "from_gen")
    reached = chained.groupBy("user_id").agg(F.max(F.when(F.col("gaps") == 0, F.col("to_gen"))).alias("reached"), (F.max("gaps") == 0).alias("complete"))
    cells = base.select("user_id", "cell").unionByName(deltas.join(good, ["user_id", "from_gen"], "left_semi").select("user_id", "cell")).distinct()
    ends = start.join(reached, "user_id", "left").select("user_id", F.coalesce("reached", "generation").alias("generation"), F.coalesce("complete", F.lit(True)).alias("complete"))
    return cells.join(ends, "user_id")


def batch_reveal(before: DataFrame, after: DataFrame) -> DataFrame:
    """What an import revealed: per user the cells added, of how many, in order of distance from their centre as shares of the way."""
    added = before_run(after, before)
    all_of = Window.partitionBy("user_id")
    return added.withColumn("n", F.count("*").over(all_of))


def reveal_order(cells: DataFrame) -> DataFrame:
    """(user_id, cell, x, y) to each cell's place by distance from the centroid (ties by cell) and its share of the way."""
    of = Window.partitionBy("user_id")
    cx, cy = F.avg("x").over(of), F.avg("y").over(of)
    away = cells.withColumn("away", F.round((F.col("x") - cx) * (F.col("x") - cx) + (F.col("y") - cy) * (F.col("y") - cy), 9))
    ranked = away.withColumn("rank", F.row_number().over(of.orderBy("away", "cell"))).withColumn("n", F.count("*").over(of))
    return ranked.select("user_id", "cell", "rank", F.when(F.col("n") > 1, (F.col("rank") - 1) / (F.col("n") - 1)).otherwise(0.0).alias("arc"))


def is_minted(introduced_in: Column, version: Column, counted: Column) -> Column:
    """Whether a skill came after the baseline: by rules newer than its version, or not counted in it."""
    return (introduced_in > version) | ~counted


def level_ups(states: DataFrame) -> DataFrame:
    """Of (user_id, skill, introduced_in, version, counted, xp_before, xp_after): skills whose level rose and that are not minted."""
    rows = states.withColumns({"from_level": level_for_xp(F.col("xp_before")), "to_level": level_for_xp(F.col("xp_after"))})
    return rows.filter(~is_minted(F.col("introduced_in"), F.col("version"), F.col("counted")) & (F.col("to_level") > F.col("from_level")))


def earned_totals(states: DataFrame) -> DataFrame:
    """Total levels before and after, minted skills taken out as one level each."""
    minted = F.count_if(is_minted(F.col("introduced_in"), F.col("version"), F.col("counted")))
    return states.groupBy("user_id").agg(
        (F.sum(level_for_xp(F.col("xp_before"))) - minted).alias("before"), (F.sum(level_for_xp(F.col("xp_after"))) - minted).alias("after")
    )


def milestones_crossed(totals: DataFrame, ladder: tuple[int, ...]) -> DataFrame:
    """One row per ladder value above ``before`` and up to ``after``."""
    rungs = F.explode(F.array(*[F.lit(m) for m in sorted(set(ladder))])).alias("milestone")
    return totals.select("user_id", "before", "after", rungs).filter("milestone > before AND milestone <= after").select("user_id", F.col("milestone").cast("long").alias("milestone"))


def rung(total: Column, ceiling: int, ladder: tuple[int, ...]) -> Column:
    """(from, to, fraction) between the ladder's rungs around a total; at the ceiling both are it."""
    rungs = F.array(*[F.lit(x).cast("long") for x in sorted({*(m for m in ladder if m < ceiling), ceiling})])
    low = F.coalesce(F.array_max(F.filter(rungs, lambda m: m <= total)), F.lit(0).cast("long"))
    high = F.array_min(F.filter(rungs, lambda m: m > total))
    top = F.lit(ceiling).cast("long")
    return F.struct(
        F.when(high.isNull(), top).otherwise(low).alias("from"), F.coalesce(high, top).alias("to"), F.when(high.isNull(), 1.0).otherwise((total - low) / (high - low)).alias("fraction")
    )


def waterline(states: DataFrame) -> DataFrame:
    """What was shown before a replay: xp, and the higher of its level and the high water."""
    return states.select("user_id", "skill", F.col("xp").alias("shown_xp"), F.greatest(level_for_xp(F.col("xp")), F.coalesce("high_water", F.lit(1))).alias("shown_level"))


def thawed(line: DataFrame, ledger: DataFrame) -> DataFrame:
    """Skill states after a replay: xp of the new ledger, levels never below the waterline; xp below it is marked as fallen."""
    fresh = ledger.groupBy(F.col("user_id").alias("f_user"), F.col("skill").alias("f_skill")).agg(F.sum("xp").alias("xp"))
    both = line.join(fresh, (F.col("user_id") == F.col("f_user")) & (F.col("skill") == F.col("f_skill")), "full")
    xp = F.coalesce("xp", F.lit(0)).cast("long")
    return both.select(
        F.coalesce("user_id", "f_user").alias("user_id"), F.coalesce("skill", "f_skill").alias("skill"), xp.alias("xp"),
        F.greatest(F.coalesce("shown_level", F.lit(1)), level_for_xp(xp)).alias("level"), (xp < F.coalesce("shown_xp", F.lit(0))).alias("fallen")
    )


def profile_totals(states: DataFrame, skills: DataFrame) -> DataFrame:
    """Per user the sum over all enabled skills of the higher of level and high water; a missing skill counts 1."""
    best = states.groupBy("user_id", "skill").agg(F.max(F.greatest("level", F.coalesce("high_water", F.lit(1)))).alias("level"), F.max("xp").alias("xp"))
    known = best.join(skills.filter("enabled").select("skill"), "skill", "left_semi").groupBy("user_id").agg(F.sum("level").alias("levels"), F.count("*").alias("n"), F.sum("xp").alias("total_xp"))
    all_skills = skills.filter("enabled").agg(F.count("*").alias("enabled"))
    # One row.
    return known.crossJoin(F.broadcast(all_skills)).select("user_id", (F.col("levels") + F.col("enabled") - F.col("n")).cast("long").alias("total_level"), F.col("total_xp").cast("long").alias("total_xp"))


def step_factor(formula: Column) -> Column:
    """k of "k * L^2"; null for any other formula."""
    return F.nullif(F.regexp_extract(formula, r"^\s*(\d+)\s*\*\s*L\s*\^\s*2\s*$", 1), F.lit("")).cast("long")


def low_precision(days: Column) -> Column:
    """About how long, in months to a year and a half and then in years."""
    months = days / DAYS_A_MONTH
    n = F.when(months < 18, F.floor(months + 0.5)).otherwise(F.floor(months / 12 + 0.5)).cast("long")
    unit = F.when(months < 18, " month").otherwise(" year")
    return F.when(months < 1, "under a month").otherwise(F.concat(F.lit("~"), n.cast("string"), unit, F.when(n == 1, "").otherwise("s")))
