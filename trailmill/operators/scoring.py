"""From activities to ledger rows: units, soft cap, ground, discovery, feeds.

Every step is a projection or a grouping by activity; the rule table is a few rows.  XP is rounded once, half up, when a row is written; feeds take
the rounded XP of their feeders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.operators.rules import FEED_RATE, MAX_LEVEL, STEP, VERSION

FIELDS = {"count": "reps", "minutes": "duration_s", "seconds": "duration_s", "distance": "distance_m"}


def set_units(selected: DataFrame, sets: DataFrame, exercises: DataFrame) -> DataFrame:
    """(activity_id, skill, set_units): sets summed for each ``seconds:`` or ``reps:`` measure.

    A scaled exercise of the skill adds its field times the scale, whatever the
    measure; otherwise a set counts if its exercise is the measure's own.
    """
    scaled = exercises.filter("scale IS NOT NULL").select(F.col("skill").alias("x_skill"), F.col("exercise").alias("x_exercise"), "entry", "scale")
    wanted = selected.filter(F.col("measure").contains(":")).select("activity_id", "skill", F.split("measure", ":").alias("m"))
    rows = wanted.join(sets, "activity_id").join(scaled, (F.col("skill") == F.col("x_skill")) & (F.col("exercise") == F.col("x_exercise")), "left")
    field = F.when(F.col("entry") == "count", F.col("reps")).otherwise(F.col("duration_s"))
    own = F.when(F.col("m")[0] == "reps", F.col("reps")).otherwise(F.col("duration_s"))
    value = F.when(F.col("scale").isNotNull(), F.coalesce(field, F.lit(0)) * F.col("scale")).when(F.col("exercise") == F.col("m")[1], F.coalesce(own, F.lit(0)).cast("double"))
    return rows.groupBy("activity_id", "skill").agg(F.sum(value).alias("set_units"))


def score_units(selected: DataFrame, sets: DataFrame, exercises: DataFrame) -> DataFrame:
    """Adds ``units`` to the selected (activity, rule), those with none dropped."""
    summed = set_units(selected, sets, exercises)
    joined = selected.join(summed, ["activity_id", "skill"], "left")
    units = F.when(F.col("measure") == "distanceKm", F.col("distance_m") / 1000).otherwise(F.coalesce("set_units", F.lit(0.0)))
    return joined.withColumn("units", units).drop("set_units").filter("units > 0")


def reveals_ground(scored: DataFrame) -> DataFrame:
    """(activity_id, reveals): whether a matched skill opens the map and its threshold is met."""
    return scored.groupBy("activity_id").agg(F.bool_or(F.col("reveals") & (F.col("units") >= F.col("min_units"))).alias("reveals"))


def soft_cap(units: Column, cap: Column) -> Column:
    """All of the first cap, half of the second, a quarter of the next four; a null cap takes all."""
    upto = lambda low, width: F.greatest(F.lit(0.0), F.least(units - low, width))
    return F.when(cap.isNull(), units).otherwise(F.least(units, cap) + upto(cap, cap) * 0.5 + upto(cap * 2, cap * 4) * 0.25)


def ungrounded_reason(measure: Column) -> Column:
    kernel = F.split(measure, ":")[0]
    return F.when(kernel == "distanceKm", "distance").when(kernel == "reps", "reps").when(kernel == "seconds", "duration")


def rate_ground(scored: DataFrame, split: DataFrame) -> DataFrame:
    """(activity_id, skill, reason, units, units_effective, pos).

    ``split``: (activity_id, m_new, m_rearmed, m_recent).  The last class that
    is present takes the remainder, so the units add up exactly; no ground at
    all counts as recent.
    """
    joined = scored.join(split, "activity_id", "left")
    parts = [F.coalesce(F.col(f"m_{g}"), F.lit(0.0)) for g in ("new", "rearmed", "recent")]
    total = parts[0] + parts[1] + parts[2]
    shared = joined.withColumn("total", total).withColumns({
        "share_new": F.when(F.col("total") > 0, parts[0] / F.col("total")).otherwise(0.0),
        "share_rearmed": F.when(F.col("total") > 0, parts[1] / F.col("total")).otherwise(0.0),
        "share_recent": F.when(F.col("total") > 0, parts[2] / F.col("total")).otherwise(1.0),
        "capped": soft_cap(F.col("units"), F.col("soft_cap")),
    })
    u, sn, sr, sc = (F.col(c) for c in ("units", "share_new", "share_rearmed", "share_recent"))
    b_new = F.when((sr == 0) & (sc == 0), u).otherwise(u * sn)
    b_rearmed = F.when(sc == 0, u - F.when(sn > 0, u * sn).otherwise(0.0)).otherwise(u * sr)
    b_recent = u - (F.when(sn > 0, u * sn).otherwise(0.0) + F.when(sr > 0, u * sr).otherwise(0.0))
    paid = F.col("capped") / u
    row = lambda pos, share, reason, bucket, mult: F.when(share > 0, F.struct(F.lit(pos).alias("pos"), F.lit(reason).alias("reason"), bucket.alias("units"), (bucket * paid * F.col(mult)).alias("units_effective")))
    grounded = F.array_compact(F.array(
        row(0, sn, "new_ground", b_new, "ground_new"), row(1, sr, "rearmed_ground", b_rearmed, "ground_rearmed"), row(2, sc, "recent_ground", b_recent, "ground_recent"),
    ))
    plain = F.array(F.struct(F.lit(0).alias("pos"), ungrounded_reason(F.col("measure")).alias("reason"), u.alias("units"), F.col("capped").alias("units_effective")))
    rows = shared.withColumn("r", F.explode(F.when(F.col("ground_new").isNull(), plain).otherwise(grounded)))
    return rows.select("user_id", "activity_id", "started_at", "skill", "measure", "xp_per_unit", "feeds", "r.pos", "r.reason", "r.units", "r.units_effective")


def discovery_rows(awards: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Rows for cells found: counts times the skill's multipliers, classes that pay nothing left out."""
    skills = rule_rows.filter("enabled AND cells_new IS NOT NULL").select("skill", "display_order", "xp_per_unit", "cells_new", "cells_rearmed")
    rows = awards.join(skills)  # a few rows of the rule table
    kinds = F.array(*[
        F.struct(F.lit(i).alias("pos"), F.lit(f"cells_{c}").alias("reason"), F.col(f"{c}_cells").cast("double").alias("units"), (F.col(f"{c}_cells") * F.col(f"cells_{c}")).alias("units_effective"), F.col(f"cells_{c}").alias("mult"))
        for i, c in enumerate(("new", "rearmed"))
    ])
    rows = rows.withColumn("r", F.explode(kinds)).filter("r.units > 0 AND r.mult > 0")
    return rows.select("activity_id", "skill", "display_order", "xp_per_unit", "r.pos", "r.reason", "r.units", "r.units_effective")


def xp(units_effective: Column, per_unit: Column) -> Column:
    """Rounded half up; the only rounding of a row."""
    return F.floor(units_effective * per_unit + 0.5).cast("long")


def ledger_rows(grounded: DataFrame, awards: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """The ledger of every activity: own rows, discovery, feeds; rows of no XP vanish before they are numbered.

    An activity's rows are one array, which the rule table bounds; awards are
    joined to it once, the rules as one row, and it is exploded in order.
    """
    row = lambda **c: F.struct(*[v.alias(k) for k, v in c.items()])
    rated = grounded.withColumn("xp", xp(F.col("units_effective"), F.col("xp_per_unit")))
    own = F.when(F.col("xp") > 0, F.struct("skill", "reason", "units", "units_effective", "xp", "measure", "pos", "feeds"))
    per = rated.groupBy("activity_id", "user_id", "started_at").agg(F.collect_list(own).alias("own"))
    found = awards.select(F.col("activity_id").alias("a_id"), F.col("new_cells").alias("new"), F.col("rearmed_cells").alias("rearmed"))
    enabled = rule_rows.filter("enabled").agg(F.collect_list(F.struct("skill", "display_order", "xp_per_unit", "cells_new", "cells_rearmed")).alias("rules"))
    both = per.join(found, F.col("activity_id") == F.col("a_id"), "left").join(F.broadcast(enabled))  # one row

    mine = F.transform("own", lambda o: row(part=F.lit(0), major=o["measure"], pos=o["pos"], skill=o["skill"], reason=o["reason"], units=o["units"], units_effective=o["units_effective"], xp=o["xp"]))

    def discovered(rule: Column, pos: int, kind: str) -> Column:
        units = F.coalesce(F.col(kind), F.lit(0)).cast("double")
        paid = units * rule[f"cells_{kind}"]
        return row(
            part=F.lit(1), major=F.lpad(rule["display_order"].cast("string"), 5, "0"), pos=F.lit(pos), skill=rule["skill"], reason=F.lit(f"cells_{kind}"),
            units=F.when(rule[f"cells_{kind}"] > 0, units), units_effective=paid, xp=xp(paid, rule["xp_per_unit"]),
        )

    paying = F.filter("rules", lambda r: r["cells_new"].isNotNull())
    cells = F.flatten(F.transform(paying, lambda r: F.array(discovered(r, 0, "new"), discovered(r, 1, "rearmed"))))

    def fed(rule: Column) -> Column:
        givers = F.filter("own", lambda o: F.array_contains(F.split(o["feeds"], ","), rule["skill"]))
        # The XP are added as whole numbers and multiplied once: a sum of products would depend on the order of the rows.
        units = F.aggregate(givers, F.lit(0).cast("long"), lambda a, o: a + o["xp"]).cast("double")
        paid = units * FEED_RATE
        return row(part=F.lit(2), major=rule["skill"], pos=F.lit(0), skill=rule["skill"], reason=F.lit("constitution_share"), units=units, units_effective=paid, xp=xp(paid, F.lit(1.0)))

    kept = F.array_sort(F.filter(F.concat(mine, cells, F.transform("rules", fed)), lambda r: (r["units"] > 0) & (r["xp"] > 0)))
    rows = both.select("activity_id", "user_id", "started_at", F.posexplode(kept).alias("number", "r")).select("activity_id", "user_id", "started_at", "number", "r.*")
    at = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return rows.select(
        F.concat_ws("#", F.col("activity_id").cast("string"), "skill", "reason", F.lit(f"v{VERSION}")).alias("id"),
        "user_id", "activity_id", "started_at", "skill", "reason", "units", "units_effective", "xp",
        F.concat_ws("#", at, F.col("activity_id").cast("string"), F.lpad(F.col("number").cast("string"), 2, "0")).alias("seq"),
    )


def cumulative_xp(level: Column, step: int = STEP) -> Column:
    """XP to be at a level: step times the squares below it."""
    return F.floor((level - 1) * level * (level * 2 - 1) * step / 6).cast("long")


def level_for_xp(amount: Column, step: int = STEP, top: int = MAX_LEVEL) -> Column:
    """The highest level whose XP is reached.

    The thresholds are a literal array of ``top`` numbers, so no seed or
    correction is needed and the expression stays native.
    """
    steps = [step * (n - 1) * n * (2 * n - 1) // 6 for n in range(1, top + 1)]
    return F.greatest(F.lit(1), F.size(F.filter(F.array(*map(F.lit, steps)), lambda t: t <= amount)))


def level_progress(amount: Column, high_water: Column, step: int = STEP, top: int = MAX_LEVEL) -> dict[str, Column]:
    """The level shown, XP to the next, and the share of the way."""
    level = F.least(F.greatest(level_for_xp(amount, step, top), high_water), F.lit(top))
    floor, following = cumulative_xp(level, step), cumulative_xp(level + 1, step)
    done = level >= top
    return {
        "level": level.cast("int"),
        "xp_to_next": F.when(done, 0).otherwise(F.greatest(following - F.greatest(amount, floor), F.lit(0))).cast("long"),
        "fraction": F.when(done, 1.0).otherwise(F.least(F.greatest(amount - floor, F.lit(0)), following - floor) / (following - floor)),
    }


def clamp_award(fresh: DataFrame) -> DataFrame:
    """Stored credit wins over a fresh count, within the run's cells: (cells, credited_new, credited_rearmed, cooled)."""
    new = F.least("credited_new", "cells")
    rearmed = F.least(F.col("credited_rearmed"), F.col("cells") - new)
    rest = F.col("cells") - new - rearmed
    cooled = F.least(F.col("cooled"), rest)
    return fresh.select("activity_id", new.alias("new_cells"), rearmed.alias("rearmed_cells"), cooled.alias("cooled_cells"), (rest - cooled).alias("deferred_cells"))


def floors(waterline: DataFrame, recomputed: DataFrame, existing: DataFrame) -> DataFrame:
    """One floor row for each (user, skill) whose XP fell: what is missing to what was shown."""
    keys = ["user_id", "skill"]
    joined = waterline.join(recomputed.withColumnRenamed("xp", "new_xp"), keys, "left").join(existing.withColumnRenamed("xp", "floor_xp"), keys, "left")
    gap = F.col("xp") - (F.coalesce("new_xp", F.lit(0)) + F.coalesce("floor_xp", F.lit(0)))
    return joined.select(*keys, gap.cast("long").alias("gap")).filter("gap > 0")


def rescore_diff(old: DataFrame, fresh: DataFrame) -> DataFrame:
    """(id, op): how the ledger of an activity changes, by row id."""
    o = old.select("id", F.col("xp").alias("o_xp"), F.col("units").alias("o_units"), F.col("units_effective").alias("o_eff"))
    f = fresh.select("id", F.col("xp").alias("f_xp"), F.col("units").alias("f_units"), F.col("units_effective").alias("f_eff"))
    both = o.join(f, "id", "full")
    differs = (F.col("o_xp") != F.col("f_xp")) | (F.col("o_units") != F.col("f_units")) | (F.col("o_eff") != F.col("f_eff"))
    op = F.when(F.col("f_xp").isNull(), "delete").when(F.col("o_xp").isNull(), "put").when(differs, "replace")
    return both.withColumn("op", op).filter("op IS NOT NULL").select("id", "op", "o_xp", "f_xp")
