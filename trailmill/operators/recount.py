"""Recounting history: what a replay scores, what is audited and shown of it, and places along and beside walks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions.geo import EARTH_M
from trailmill.functions.text import clock
from trailmill.operators.discovery import classify_history

FAILED_SHOWN = 25


def score_history(visits: DataFrame, activities: DataFrame) -> DataFrame:
    """Classified visits of active activities: retracted ones fold into the cells' history all the same, and only then go."""
    active = activities.filter(F.coalesce("status", F.lit("ACTIVE")) != "TOMBSTONED").select("activity_id")
    return classify_history(visits).join(active, "activity_id", "left_semi")


def retracted(activities: DataFrame, gone: DataFrame) -> DataFrame:
    """Activities with those confirmed as gone (activity_id) marked as tombstones; nothing is removed."""
    marks = gone.select(F.col("activity_id").alias("gone_id")).distinct()
    status = F.when(F.col("gone_id").isNotNull(), "TOMBSTONED").otherwise(F.coalesce("status", F.lit("ACTIVE")))
    return activities.join(marks, F.col("activity_id") == F.col("gone_id"), "left").withColumn("status", status).drop("gone_id")


def credited_counts(ledger: DataFrame) -> DataFrame:
    """(activity_id, credited_new, credited_rearmed): the most cells that a row credits as new and as rearmed."""
    most = lambda c: F.coalesce(F.max(F.when(F.col("reason") == f"cells_{c}", F.col("units"))), F.lit(0.0)).cast("long").alias(f"credited_{c}")
    return ledger.groupBy("activity_id").agg(most("new"), most("rearmed"))


def class_audit(stored: DataFrame, classified: DataFrame) -> DataFrame:
    """Activities whose stored counts (new_cells, rearmed_cells) are not those of their classified visits."""
    found = classified.groupBy(F.col("activity_id").alias("f_id")).agg(F.count_if(F.col("class") == "new").alias("found_new"), F.count_if(F.col("class") == "rearmed").alias("found_rearmed"))
    both = stored.join(found, F.col("activity_id") == F.col("f_id"), "left").fillna(0, ["found_new", "found_rearmed"])
    return both.filter("new_cells <> found_new OR rearmed_cells <> found_rearmed").drop("f_id")


def failed_receipts(receipts: DataFrame, most: int = FAILED_SHOWN) -> DataFrame:
    """Each user's latest failed receipts, newest first (then by id)."""
    newest = Window.partitionBy("user_id").orderBy(F.desc("at"), "receipt_id")
    return receipts.filter("status = 'FAILED'").withColumn("place", F.row_number().over(newest)).filter(F.col("place") <= most)


def rules_version(states: DataFrame, newest: int) -> DataFrame:
    """The rules each user's states were last scored by; the newest for users without any."""
    return states.groupBy("user_id").agg(F.coalesce(F.max("rules_version"), F.lit(newest)).alias("version"))


def workout_summary(sets: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, label, reps, duration_s, distance_m) to one line: distances before counts before times, a bare label without any."""
    shown = (
        F.when(F.col("distance_m").isNotNull(), F.concat(F.format_string("%.2f km ", F.col("distance_m") / 1000), "label"))
        .when(F.col("reps").isNotNull(), F.concat(F.format_number("reps", 0), F.lit(" "), "label"))
        .when(F.col("duration_s").isNotNull(), F.concat(clock(F.col("duration_s")), F.lit(" "), "label"))
        .otherwise(F.col("label"))
    )
    parts = F.array_sort(F.collect_list(F.struct("pos", shown.alias("s"))))
    return sets.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["s"]), ", ").alias("summary"))


def segments(points: DataFrame, *keys: str) -> DataFrame:
    """Steps from each point's predecessor, (lat0, lng0) to (lat, lng)."""
    order = Window.partitionBy(*keys).orderBy("seq")
    return points.withColumns({"lat0": F.lag("lat").over(order), "lng0": F.lag("lng").over(order)}).filter("lat0 IS NOT NULL")


def metres_beside(lat: Column, lng: Column, lat0: Column, lng0: Column, lat1: Column, lng1: Column) -> Column:
    """Metres from a place to a segment on the plane around the place; across the antimeridian the short way."""
    wrapped = lambda d: F.pmod(d + 540, F.lit(360.0)) - 180
    x = lambda g: F.radians(wrapped(g - lng)) * F.cos(F.radians(lat)) * EARTH_M
    y = lambda a: F.radians(a - lat) * EARTH_M
    ax, ay, dx, dy = x(lng0), y(lat0), x(lng1) - x(lng0), y(lat1) - y(lat0)
    long = dx * dx + dy * dy
    share = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / long))).otherwise(0.0)
    fx, fy = ax + share * dx, ay + share * dy
    return F.sqrt(fx * fx + fy * fy)


def beside_walks(places: DataFrame, walks: DataFrame, key: str) -> DataFrame:
    """Metres from each place to the nearest segment of its own walk."""
    s = walks.select(F.col(key).alias("s_key"), "lat0", "lng0", F.col("lat").alias("lat1"), F.col("lng").alias("lng1"))
    each = metres_beside(*[F.col(c) for c in ("lat", "lng", "lat0", "lng0", "lat1", "lng1")])
    return places.join(s, F.col(key) == F.col("s_key")).groupBy(key, "lat", "lng").agg(F.min(each).alias("m"))


def at_shares(steps: DataFrame, shares: tuple[float, ...], key: str) -> DataFrame:
    """(key, share, lat, lng): where each walk is after a share of its metres; ``steps`` have lat0, lng0, m and so_far, the metres at their end."""
    total = F.max("so_far").over(Window.partitionBy(key))
    asked = steps.withColumn("total", total).select("*", F.explode(F.array(*map(F.lit, shares))).alias("share"))
    goal = F.col("share") * F.col("total")
    there = asked.filter((F.col("m") > 0) & (F.col("so_far") - F.col("m") < goal) & (goal <= F.col("so_far")))
    along = (goal - (F.col("so_far") - F.col("m"))) / F.col("m")
    return there.select(key, "share", (F.col("lat0") + (F.col("lat") - F.col("lat0")) * along).alias("lat"), (F.col("lng0") + (F.col("lng") - F.col("lng0")) * along).alias("lng"))
