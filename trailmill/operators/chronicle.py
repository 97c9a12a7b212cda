"""Facts about a run against its user's history, and the sentence that fits it best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions.text import fnv1a, sentence

YEAR_US = 365 * 86_400_000_000
IN_YEAR_PRIOR, EVER_PRIOR = 8, 20
LEAGUE_M = 4828.032


def facts(runs: DataFrame) -> DataFrame:
    """(user_id, activity_id, started_at, new_cells, distance_m) with what its strictly earlier runs add up to.

    Earlier is by (started_at, activity_id).  Time is cut into blocks of a year,
    so the trailing year of a run is what is earlier in its own block and the
    block before it from the instant a year ago on; both are running sums, and
    no run goes through the runs of its year.
    """
    at = F.unix_micros(F.col("started_at").cast("timestamp"))
    road = F.when(F.col("distance_m") > 0, F.col("distance_m"))
    rows = runs.withColumns({"at_us": at, "road": road})
    rows = rows.withColumn("block", F.floor((F.col("at_us") - F.pmod(F.col("at_us"), F.lit(YEAR_US))) / YEAR_US).cast("long"))
    before = Window.partitionBy("user_id").orderBy("started_at", "activity_id").rowsBetween(Window.unboundedPreceding, -1)
    here = Window.partitionBy("user_id", "block").orderBy("started_at", "activity_id").rowsBetween(Window.unboundedPreceding, -1)
    none = lambda c: F.coalesce(c, F.lit(0))
    summed = rows.select(
        "user_id", "activity_id", "started_at", "new_cells", "road", "at_us", "block",
        none(F.sum("new_cells").over(before)).alias("cells_before"),
        none(F.count("road").over(before)).alias("roads_before"),
        F.coalesce(F.sum("road").over(before), F.lit(0.0)).alias("metres_before"),
        F.max("road").over(before).alias("longest_before"),
        F.count("road").over(here).alias("roads_here"),
        F.max("road").over(here).alias("longest_here"),
    )
    # Each run is in its block, and asks in the block before, a year ago; rows of one instant are peers of the frame.
    asks = F.explode(F.array(F.lit(True), F.lit(False))).alias("asks")
    sides = summed.select("*", asks).filter("asks OR road IS NOT NULL").withColumns({
        "block": F.when(F.col("asks"), F.col("block") - 1).otherwise(F.col("block")),
        "at_us": F.when(F.col("asks"), F.col("at_us") - YEAR_US).otherwise(F.col("at_us")),
        "past": F.when(~F.col("asks"), F.col("road")),
    })
    since = Window.partitionBy("user_id", "block").orderBy(F.desc("at_us"))
    known = sides.withColumns({
        "roads_in_year": F.col("roads_here") + F.count("past").over(since),
        "longest_in_year_before": F.greatest("longest_here", F.max("past").over(since)),
    }).filter("asks")
    beats = lambda least, n, longest: (F.col("road").isNotNull() & (n >= least) & (longest < F.col("road"))).cast("int")
    return known.select(
        "user_id", "activity_id", "started_at", "new_cells",
        "cells_before",
        F.when(F.col("road").isNotNull(), F.col("roads_before") + 1).alias("road_count"),
        F.when(F.col("road").isNotNull(), (F.col("metres_before") + F.col("road")) / LEAGUE_M).alias("leagues"),
        F.coalesce(beats(IN_YEAR_PRIOR, F.col("roads_in_year"), F.col("longest_in_year_before")), F.lit(0)).alias("longest_in_year"),
        F.coalesce(beats(EVER_PRIOR, F.col("roads_before"), F.col("longest_before")), F.lit(0)).alias("longest_ever"),
    )


TESTS = {"eq": lambda f, v: f == v, "gt": lambda f, v: f > v, "gte": lambda f, v: f >= v, "lt": lambda f, v: f < v, "lte": lambda f, v: f <= v, "in": lambda f, v: f.isin(*v)}


def holds(when: dict[str, dict]) -> Column:
    """All conditions of a row; a fact that is missing fails."""
    out = F.lit(True)
    for fact, tests in when.items():
        for test, value in tests.items():
            out = out & F.coalesce(TESTS[test](F.col(fact), value), F.lit(False))
    return out


def pick(runs: DataFrame, table: list[dict], names: tuple[str, ...]) -> DataFrame:
    """(activity_id, row_id, sentence): the fitting row of highest rank whose facts are all known; ties by a hash seeded with the run."""
    seed = F.col("activity_id").cast("string")
    each = []
    for row in table:
        text = sentence(row["text"], {n: F.col(n) for n in names})
        order = F.struct((-F.lit(row["rank"])).alias("minus_rank"), fnv1a(F.concat(seed, F.lit("\0" + row["id"]))).alias("h"), F.lit(row["id"]).alias("row_id"), text.alias("sentence"))
        each.append(F.when(holds(row["when"]) & text.isNotNull(), order))
    best = F.array_min(F.array_compact(F.array(*each)))
    return runs.select("activity_id", best.alias("b")).filter("b IS NOT NULL").select("activity_id", "b.row_id", "b.sentence")
