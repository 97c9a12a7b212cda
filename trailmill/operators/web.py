"""The web of a user's traces: every stretch of ground drawn once, by who was there first, and as worn as the runs that pass.

Runs are (user_id, run_id, started_at, part, seq, lat, lng).  They are sampled
every few metres and laid on a raster of ten metres; a sample's ground is its
raster cell and the eight around it.  How many runs pass and which sample came
first are groupings by (user, cell), so no user's runs are folded in one task:
a sample is drawn already if an earlier run, or its own more than SELF_LAG_M
metres back, had been on its ground, and the first sample there tells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions.geo import EARTH_M

GRID_M = 10.0
SAMPLE_M = 4.0
SELF_LAG_M = 40.0
LEAST_SAMPLES = 5
#: How worn a line is drawn, by step.
WEAR = (0.28, 0.36, 0.44, 0.52, 0.6)
RUN = ("user_id", "run_id")


def wear_step(runs: Column) -> Column:
    """0 for one run, then one more each time the runs double."""
    return F.when(runs <= 1, 0).otherwise(F.least(F.lit(len(WEAR) - 1), F.ceil(F.round(F.log2(runs), 9)))).cast("int")


def samples(runs: DataFrame) -> DataFrame:
    """(user_id, run_id, i, head, at_m, lat, lng, x, y): vertices and places at most SAMPLE_M apart between, with the metres so far and the raster cell.

    The raster's width is that at a user's first point; parts of one point are left out.
    """
    w = Window.partitionBy(*RUN, "part").orderBy("seq")
    whole = Window.partitionBy(*RUN).orderBy("part", "seq")
    long_enough = F.count("*").over(Window.partitionBy(*RUN, "part")) > 1
    kept = runs.withColumn("kept", long_enough).filter("kept").drop("kept")
    first = kept.groupBy(F.col("user_id").alias("f_user")).agg(F.min_by("lat", F.struct("started_at", "run_id", "part", "seq")).alias("first_lat"))
    edges = kept.withColumns({"lat0": F.lag("lat").over(w), "lng0": F.lag("lng").over(w)})
    dx = F.radians(F.col("lng") - F.col("lng0")) * F.cos(F.radians((F.col("lat") + F.col("lat0")) / 2))
    dy = F.radians(F.col("lat") - F.col("lat0"))
    m = F.coalesce(F.sqrt(dx * dx + dy * dy) * EARTH_M, F.lit(0.0))
    run = edges.withColumn("m", m).withColumn("end_m", F.sum("m").over(whole)).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("m") / SAMPLE_M)).cast("int"))
    rows = run.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    t = F.col("k") / F.col("n")
    between = lambda a, b: F.when(F.col("k") == F.col("n"), F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * t)
    placed = rows.select(
        *RUN, "started_at", F.row_number().over(Window.partitionBy(*RUN).orderBy("part", "seq", "k")).alias("i"), F.col("lat0").isNull().alias("head"),
        (F.col("end_m") - F.col("m") * (1 - t)).alias("at_m"), between("lat0", "lat").alias("lat"), between("lng0", "lng").alias("lng"),
    )
    unit = EARTH_M * 3.141592653589793 / 180 / GRID_M
    x = F.floor(F.col("lng") * (F.cos(F.radians("first_lat")) * unit))
    return placed.join(first, F.col("user_id") == F.col("f_user")).withColumns({"x": x, "y": F.floor(F.col("lat") * unit)}).drop("f_user", "first_lat")


def ground(sampled: DataFrame) -> DataFrame:
    """(user_id, x, y, passes, first): under each raster cell and the eight around it, how many runs pass, and the first sample as (started_at, run_id, at_m).

    A run's cells are made distinct, each with its first metres, before they are widened.
    """
    own = sampled.groupBy(*RUN, "started_at", "x", "y").agg(F.min("at_m").alias("at_m"))
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    wide = own.withColumn("o", around).withColumns({"x": F.col("x") + F.col("o.dx"), "y": F.col("y") + F.col("o.dy")})
    runs = wide.groupBy(*RUN, "x", "y").agg(F.min(F.struct("started_at", "run_id", "at_m")).alias("first"))
    return runs.groupBy("user_id", "x", "y").agg(F.count("*").alias("passes"), F.min("first").alias("first"))


def smoothed(steps: DataFrame, step: str = "step") -> DataFrame:
    """Short stretches of equal steps, of fewer than LEAST_SAMPLES samples, take the step of the stretch before; the first ones that of the second stretch."""
    w = Window.partitionBy(*RUN).orderBy("i")
    change = F.coalesce(F.col(step) != F.lag(step).over(w), F.lit(True)).cast("int")
    islands = steps.withColumn("_c", change).withColumn("island", F.sum("_c").over(w)).drop("_c")
    size = F.count("*").over(Window.partitionBy(*RUN, "island"))
    long = islands.withColumn("size", size).withColumn("long", F.when(F.col("size") >= LEAST_SAMPLES, F.col(step)))
    second = F.max(F.when(F.col("island") == 2, F.col(step))).over(Window.partitionBy(*RUN))
    carried = F.last("long", ignorenulls=True).over(w)
    return long.withColumn(step, F.coalesce(carried, second, F.col(step))).drop("island", "size", "long")


def pieces(runs: DataFrame) -> DataFrame:
    """(user_id, run_id, piece, wear, first_i, last_i, points): the lines to draw, each an array of (i, lat, lng).

    A line begins a sample before its first new ground and ends a sample after
    its last, unless a part begins or ends there; lines of different wear share
    the sample between them.
    """
    sampled = samples(runs)
    known = ground(sampled)
    met = sampled.join(known, ["user_id", "x", "y"])
    same = (F.col("first.started_at") == F.col("started_at")) & (F.col("first.run_id") == F.col("run_id"))
    drawn = ~same | (F.col("first.at_m") < F.col("at_m") - SELF_LAG_M)
    marked = smoothed(met.withColumn("step", wear_step(F.col("passes"))).withColumn("drawn", drawn).select(*RUN, "i", "head", "lat", "lng", "step", "drawn"))
    w = Window.partitionBy(*RUN).orderBy("i")
    before = F.lag(F.struct("drawn", "step", "lat", "lng")).over(w)
    after = F.lead(F.struct("head", "lat", "lng")).over(w)
    sides = marked.withColumns({"before": before, "after": after})
    begins = F.col("head") | F.col("before").isNull() | F.col("before.drawn") | (F.col("before.step") != F.col("step"))
    own = sides.withColumn("begins", begins & ~F.col("drawn")).withColumn("piece", F.sum(F.col("begins").cast("int")).over(w)).filter("NOT drawn")
    spot = lambda i, of: F.struct(i.alias("i"), F.col(f"{of}lat").alias("lat"), F.col(f"{of}lng").alias("lng"))
    lead_in = F.when(F.col("begins") & ~F.col("head") & F.col("before.drawn"), spot(F.col("i") - 1, "before."))
    lead_out = F.when(F.col("after").isNotNull() & ~F.col("after.head"), spot(F.col("i") + 1, "after."))
    points = F.array_compact(F.array(lead_in, spot(F.col("i"), ""), lead_out))
    lines = own.groupBy(*RUN, "piece").agg(F.first("step").alias("step"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(points)))).alias("points")).filter(F.size("points") >= 2)
    wear = F.element_at(F.array(*map(F.lit, WEAR)), F.col("step") + 1)
    return lines.select(*RUN, "piece", wear.alias("wear"), F.col("points")[0]["i"].alias("first_i"), F.element_at("points", -1)["i"].alias("last_i"), "points")


def with_run(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored runs of the web with those given anew in their place: the latest of each (user, run)."""
    rest = stored.join(fresh.select(*RUN).distinct(), list(RUN), "left_anti").select(stored.columns)
    return rest.unionByName(fresh.select(stored.columns))
