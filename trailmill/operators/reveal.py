"""Along a walk: samples at even steps that carry over vertices, the order in which cells appear, and walks near places.

Walks are (keys, part, seq, lat, lng).  Everything is windows, explodes and
equi-joins; what is near is found through tiles, so that no place meets all
edges and no cell all samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions.geo import EARTH_M, metres
from trailmill.sources.tables import spread

REVEAL_M = 65.0
SAMPLE_M = 5.0
#: Metres of a degree on the plane of a walk: along a meridian, and along the equator.
NORTH_M, EAST_M = 110_540.0, 111_320.0
#: Tiles of the finest level are 360 / 2^FINEST degrees wide, about 150 m.
FINEST = 18
METRES_PER_DEGREE = EARTH_M * 3.141592653589793 / 180


def short_way(degrees: Column) -> Column:
    """A difference of longitudes, the short way round; most need no remainder, which is slow."""
    turned = degrees + 180
    return F.when((turned >= 0) & (turned < 360), turned).otherwise(F.pmod(turned, F.lit(360.0))) - 180


def carried_samples(walks: DataFrame, step_m: float, *keys: str) -> DataFrame:
    """(keys, part, seq, k, at_m, arc, lat, lng): the ends of each part and a place every ``step_m`` between, counted on over its vertices.

    ``seq`` is that of the vertex behind, k numbers the places after it, 0 being
    a part's first vertex; the last has k = -1.  Metres run on over parts, the
    way between parts left out.  Parts of one point are left out.
    """
    w = Window.partitionBy(*keys, "part").orderBy("seq")
    whole = Window.partitionBy(*keys).orderBy("part", "seq")
    edges = walks.withColumns({"lat2": F.lead("lat").over(w), "lng2": F.lead("lng").over(w), "lat0": F.lag("lat").over(w)})
    edges = edges.filter("lat2 IS NOT NULL OR lat0 IS NOT NULL")
    span = F.coalesce(metres(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")), F.lit(0.0))
    spans = edges.withColumn("span", span)
    before = lambda over: F.coalesce(F.sum("span").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    run = spans.withColumns({"start": before(w), "walked": before(whole), "total": F.sum("span").over(Window.partitionBy(*keys))})
    first, last = F.floor(F.col("start") / step_m) + 1, F.ceil((F.col("start") + F.col("span")) / step_m) - 1
    inside = F.when((F.col("span") > 0) & (last >= first), F.transform(F.sequence(first, F.greatest(last, first)), lambda m: F.struct((m - first + 1).alias("k"), (m * step_m - F.col("start")).alias("m"))))
    none = F.array().cast("array<struct<k:bigint,m:double>>")
    mark = lambda k: F.array(F.struct(F.lit(k).cast("long").alias("k"), F.lit(0.0).alias("m")))
    spots = F.concat(F.when(F.col("lat0").isNull(), mark(0)).otherwise(none), F.coalesce(inside, none), F.when(F.col("lat2").isNull(), mark(-1)).otherwise(none))
    rows = run.select(*keys, "part", "seq", "lat", "lng", "lat2", "lng2", "span", "walked", "total", F.explode(spots).alias("s"))
    t = F.when(F.col("span") > 0, F.col("s.m") / F.col("span")).otherwise(0.0)
    between = lambda a, b: F.col(a) + F.coalesce(F.col(b) - F.col(a), F.lit(0.0)) * t
    at = F.col("walked") + F.col("s.m")
    return rows.select(*keys, "part", "seq", "s.k", at.alias("at_m"), F.when(F.col("total") > 0, at / F.col("total")).otherwise(0.0).alias("arc"), between("lat", "lat2").alias("lat"), between("lng", "lng2").alias("lng"))


def plane_samples(walks: DataFrame, step_m: float, *keys: str) -> DataFrame:
    """(keys, i, x, y, along, walked): samples at most ``step_m`` apart on the plane around a walk's first point, in order, with the metres so far.

    Vertices are samples; parts of one point are left out, and so is the way between parts.
    """
    w = Window.partitionBy(*keys, "part").orderBy("seq")
    whole = Window.partitionBy(*keys).orderBy("part", "seq")
    long_enough = F.count("*").over(Window.partitionBy(*keys, "part")) > 1
    kept = walks.withColumn("kept", long_enough).filter("kept")
    lat0 = F.first("lat").over(whole.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    placed = kept.withColumn("scale", F.cos(F.radians(lat0)) * EAST_M).withColumns({"x": F.col("lng") * F.col("scale"), "y": F.col("lat") * NORTH_M})
    back = placed.withColumns({"px": F.lag("x").over(w), "py": F.lag("y").over(w)})
    span = F.coalesce(F.sqrt((F.col("x") - F.col("px")) * (F.col("x") - F.col("px")) + (F.col("y") - F.col("py")) * (F.col("y") - F.col("py"))), F.lit(0.0))
    run = back.withColumn("span", span).withColumn("end", F.sum("span").over(whole.rowsBetween(Window.unboundedPreceding, 0)))
    run = run.withColumn("walked", F.sum("span").over(Window.partitionBy(*keys)))
    steps = F.greatest(F.lit(1), F.ceil(F.col("span") / step_m)).cast("int")
    rows = run.withColumn("n", F.when(F.col("px").isNull(), 1).otherwise(steps)).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    t = F.when(F.col("px").isNull(), 1.0).otherwise(F.col("k") / F.col("n"))
    between = lambda a, b: F.coalesce(F.col(a) + (F.col(b) - F.col(a)) * t, F.col(b))
    order = Window.partitionBy(*keys).orderBy("part", "seq", "k")
    return rows.select(
        *keys, F.row_number().over(order).alias("i"), between("px", "x").alias("x"), between("py", "y").alias("y"), (F.col("end") - F.col("span") * (1 - t)).alias("along"), "walked", "scale"
    )


def reveal_order(walks: DataFrame, cells: DataFrame, *keys: str, step_m: float = SAMPLE_M, radius_m: float = REVEAL_M, tasks: int = 0) -> DataFrame:
    """(keys, cell, arc): the share of the walk at which each cell appears.

    That is the nearest sample within the first pass, the first unbroken run of
    samples within the radius; without one, the nearest of all; the earlier of
    equal ones, squares of distances being rounded to four decimals.  ``cells``: (keys, cell, lat, lng).  Cells and samples meet in
    tiles as wide as the radius, those without a pass then alone.  All joins are
    sorted: Spark goes by the size of the points, not of the cells and samples
    made of them, and would send either through the driver.  ``tasks``: over how
    many tasks they are dealt, if more than the session's cores.
    """
    samples = plane_samples(walks, step_m, *keys)
    # A pass of one row a walk: the scale of its samples, which they need not be made for.
    paths = walks.withColumn("size", F.count("*").over(Window.partitionBy(*keys, "part"))).filter("size > 1")
    scale = paths.groupBy(*keys).agg((F.cos(F.radians(F.min_by("lat", F.struct("part", "seq")))) * EAST_M).alias("cell_scale"))
    placed = cells.join(scale.hint("merge"), list(keys)).select(*keys, "cell", (F.col("lng") * F.col("cell_scale")).alias("cx"), (F.col("lat") * NORTH_M).alias("cy"))
    tile = lambda c: F.floor(F.col(c) / radius_m)
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    wide = placed.withColumn("o", around).select(*keys, "cell", "cx", "cy", (tile("cx") + F.col("o.dx")).alias("tx"), (tile("cy") + F.col("o.dy")).alias("ty"))
    tiled = [*keys, "tx", "ty"]
    met = spread(samples.withColumns({"tx": tile("x"), "ty": tile("y")}), tasks, *tiled).join(spread(wide, tasks, *tiled).hint("merge"), tiled)
    off = (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))
    d = F.round(off, 4)
    share = F.when(F.col("walked") > 0, F.col("along") / F.col("walked")).otherwise(0.0)
    # Rounding goes by decimals and is slow: most pairs are too far by more than it moves.
    close = met.filter((off <= radius_m * radius_m + 0.001) & (d <= radius_m * radius_m))
    inside = close.withColumns({"d": d, "arc": share}).select(*keys, "cell", "i", "d", "arc")
    by_i = Window.partitionBy(*keys, "cell").orderBy("i")
    # Samples of the first pass follow its first one without a gap; the order that shows it serves the grouping too.
    counted = spread(inside, tasks, *keys, "cell").withColumns({"n": F.row_number().over(by_i), "from": F.first("i").over(by_i)})
    first = counted.filter("i = from + n - 1").groupBy(*keys, "cell").agg(F.min(F.struct("d", "i", "arc")).alias("b"))
    passed = first.select(*keys, "cell", "b.arc")
    left = placed.join(passed.select(*keys, "cell").hint("merge"), [*keys, "cell"], "left_anti")
    alone = samples.join(left.hint("merge"), list(keys)).withColumns({"d": d, "arc": share})
    nearest = alone.groupBy(*keys, "cell").agg(F.min(F.struct("d", "i", "arc")).alias("b")).select(*keys, "cell", "b.arc")
    return passed.unionByName(nearest)


def edges_of(walks: DataFrame, *keys: str) -> DataFrame:
    """(keys, lat1, lng1, lat2, lng2): the edges of each part; a part of one point is an edge of that point."""
    w = Window.partitionBy(*keys, "part").orderBy("seq")
    rows = walks.select(*keys, "lat", "lng", F.lead("lat").over(w).alias("lat2"), F.lead("lng").over(w).alias("lng2"), F.lag("lat").over(w).isNull().alias("alone"))
    return rows.filter("lat2 IS NOT NULL OR alone").select(*keys, F.col("lat").alias("lat1"), F.col("lng").alias("lng1"), F.coalesce("lat2", "lat").alias("lat2"), F.coalesce("lng2", "lng").alias("lng2"))


def _index(value: Column, level: Column) -> Column:
    """Tile of degrees from -180 on, at a level below FINEST."""
    return F.floor((value + 180) / 360 * F.pow(F.lit(2.0), FINEST - level)).cast("long")


def covered(edges: DataFrame, radius_m: float) -> DataFrame:
    """Edges under each tile (level, tx, ty) that a place within the radius may lie in: four tiles at most, of a level by the edge's own size.

    Tiles go round the globe, so an edge over the antimeridian is one edge; near
    a pole, where the radius spans all longitudes, the level is the coarsest.
    """
    high = F.least(F.lit(90.0), F.greatest(F.abs("lat1"), F.abs("lat2")) + radius_m / METRES_PER_DEGREE)
    up = F.lit(radius_m / METRES_PER_DEGREE * 1.000001)
    side = F.least(F.lit(180.0), up / F.greatest(F.cos(F.radians(high)), F.lit(1e-9)))
    far = F.col("lng1") + short_way(F.col("lng2") - F.col("lng1"))
    box = edges.withColumns({
        "w": F.least(F.col("lng1"), far) - side, "e": F.greatest(F.col("lng1"), far) + side,
        "s": F.least("lat1", "lat2") - up, "n": F.greatest("lat1", "lat2") + up,
    })
    size = F.greatest(F.col("e") - F.col("w"), F.col("n") - F.col("s"))
    level = F.greatest(F.lit(0), F.least(F.lit(FINEST), F.ceil(F.log2(size / 360) + FINEST))).cast("int")
    tiles = box.withColumn("level", level)
    span = lambda a, b: F.sequence(_index(F.col(a), F.col("level")), _index(F.col(b), F.col("level")))
    round_ = lambda t: F.pmod(t, F.pow(F.lit(2.0), FINEST - F.col("level")).cast("long"))
    rows = tiles.withColumn("tx", F.explode(F.array_distinct(F.transform(span("w", "e"), round_)))).withColumn("ty", F.explode(span("s", "n")))
    return rows.drop("w", "e", "s", "n")


def with_metres(met: DataFrame) -> DataFrame:
    """With m, metres from a place (p_lat, p_lng) to the edge that goes from (lat1, lng1) by (north, east) degrees, on the plane around the place.

    ``flat``: metres of a degree along the place's parallel.  Each step is a
    column of its own: as one expression, which Spark writes out at every
    mention, it is more code than the JVM compiles.
    """
    square = lambda c: F.col(c) * F.col(c)
    sides = met.withColumns({
        "ax": short_way(F.col("lng1") - F.col("p_lng")) * F.col("flat"), "ay": (F.col("lat1") - F.col("p_lat")) * METRES_PER_DEGREE,
        "dx": F.col("east") * F.col("flat"), "dy": F.col("north") * METRES_PER_DEGREE,
    })
    long = sides.withColumn("length", square("dx") + square("dy"))
    along = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(F.col("ax") * F.col("dx") + F.col("ay") * F.col("dy")) / F.nullif(F.col("length"), F.lit(0.0))))
    foot = long.withColumn("t", F.when(F.col("length") == 0, 0.0).otherwise(along))
    ends = foot.withColumns({"fx": F.col("ax") + F.col("t") * F.col("dx"), "fy": F.col("ay") + F.col("t") * F.col("dy")})
    return ends.withColumn("m", F.sqrt(square("fx") + square("fy")))


def walks_near(asked: DataFrame, edges: DataFrame, radius_m: float, by: list[str], *keys: str, tasks: int = 0) -> DataFrame:
    """(by, keys, m): walks with an edge within the radius of each place (by, lat, lng), with the distance of the nearest.

    Each spot is looked up once a level, whatever places are at it; a walk that is met under several tiles or by several edges is one row.
    A place that is given more than once is at one spot.  Joins are sorted: Spark knows the size of the places and not that they are exploded,
    and would send them all through the driver.  ``tasks``: over how many tasks tiles and spots are dealt, if more than the session's cores.
    """
    places = asked.select(*by, F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng")).distinct()
    levels = F.explode(F.sequence(F.lit(0), F.lit(FINEST))).alias("level")
    at = places.select("p_lat", "p_lng").distinct().select("p_lat", "p_lng", (F.cos(F.radians("p_lat")) * METRES_PER_DEGREE).alias("flat"), levels)
    tile = F.pow(F.lit(2.0), FINEST - F.col("level")).cast("long")
    at = at.withColumns({"tx": F.pmod(_index(F.col("p_lng"), F.col("level")), tile), "ty": _index(F.col("p_lat"), F.col("level"))})
    under = covered(edges, radius_m).select(*keys, "level", "tx", "ty", "lat1", "lng1", short_way(F.col("lng2") - F.col("lng1")).alias("east"), (F.col("lat2") - F.col("lat1")).alias("north"))
    tiled, spot = ["level", "tx", "ty"], ["p_lat", "p_lng"]
    met = with_metres(spread(under, tasks, *tiled).join(spread(at, tasks, *tiled).hint("merge"), tiled))
    # The least is judged, not each: a condition of the join would be the whole of the above in one expression.
    near = met.groupBy(*spot, *keys).agg(F.min("m").alias("m")).filter(F.col("m") <= radius_m)
    return spread(near, tasks, *spot).join(spread(places, tasks, *spot).hint("merge"), spot).select(*by, *keys, "m")
