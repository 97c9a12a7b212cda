"""Named places and ground: nearest and most prominent names, regions, streets returned to, metres by class of ground.

Spatial joins are equi-joins on buckets with the exact test behind them: map
tiles for radii, squares of degrees for boxes, cubes of space for links.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.functions.geo import EARTH_M, mercator, metres

#: Metres in a degree of latitude, as name searches count them.
DEGREE_M = 111_320.0
LINK_M = 50_000.0
#: A town goes before a neighbourhood, and these before all else.
PROMINENCE = ("locality", "neighbourhood")


def tile(lat: Column, lng: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional place in the tiles of a zoom."""
    x, y = mercator(F.greatest(F.lit(-85.0511), F.least(F.lit(85.0511), lat)), lng)
    return x * 2**zoom, y * 2**zoom


def near_tiles(lat: Column, lng: Column, zoom: int) -> Column:
    """The own tile and those on the sides it is nearer to, around the antimeridian: all within half a tile lies in these."""
    n = 2**zoom
    x, y = tile(lat, lng, zoom)
    sides = lambda v: (F.floor(v), F.floor(v) + F.when(v - F.floor(v) < 0.5, -1).otherwise(1))
    pairs = [F.struct(F.pmod(tx, F.lit(n)).alias("x"), ty.alias("y")) for tx in sides(x) for ty in sides(y)]
    return F.filter(F.array(*pairs), lambda t: t["y"].between(0, n - 1))


def nearest_named(asked: DataFrame, places: DataFrame, most_m: float, zoom: int, *keys: str) -> DataFrame:
    """(keys, name, m): the nearest of (name, lat, lng) within ``most_m``, less than half a tile; equal to the millimetre, the first by name.

    Places meet what is asked in one tile each; the minimum combines before its shuffle.  Of places at one spot only the first by name can be it.
    """
    places = places.groupBy("lat", "lng").agg(F.min("name").alias("name"))
    px, py = tile(F.col("lat"), F.col("lng"), zoom)
    known = places.select("name", F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"), F.struct(F.pmod(F.floor(px), F.lit(2**zoom)).alias("x"), F.floor(py).alias("y")).alias("p_tile"))
    rows = asked.select(*keys, "lat", "lng", F.explode(near_tiles(F.col("lat"), F.col("lng"), zoom)).alias("tile"))
    east = F.col("p_lng") - F.col("lng")
    east = F.when(east > 180, east - 360).when(east < -180, east + 360).otherwise(east)
    dx, dy = east * F.cos(F.radians("lat")), F.col("p_lat") - F.col("lat")
    both = rows.join(known, F.col("tile") == F.col("p_tile")).withColumn("m", F.sqrt(dx * dx + dy * dy) * DEGREE_M).filter(F.col("m") <= most_m)
    best = both.groupBy(*keys).agg(F.min(F.struct(F.round("m", 3).alias("m"), "name")).alias("best"))
    return best.select(*keys, "best.name", "best.m")


def padded(boxes: DataFrame, by_m: float) -> DataFrame:
    """Boxes (west, south, east, north) widened on every side."""
    tall = F.lit(by_m / DEGREE_M)
    wide = F.lit(by_m) / (F.greatest(F.lit(0.01), F.cos(F.radians((F.col("south") + F.col("north")) / 2))) * DEGREE_M)
    return boxes.withColumns({"west": F.col("west") - wide, "south": F.col("south") - tall, "east": F.col("east") + wide, "north": F.col("north") + tall})


def prominent_named(boxes: DataFrame, places: DataFrame, *keys: str) -> DataFrame:
    """(keys, name): of (name, kind, population, lat, lng) in a box the most prominent: by kind, then the larger, then by name.

    A box asks in each square degree that it touches, a place lies in one.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, PROMINENCE)), F.col("kind")), F.lit(0))
    rank = F.when(rank == 0, len(PROMINENCE) + 1).otherwise(rank)
    known = places.select(
        F.struct(rank.alias("rank"), (-F.coalesce("population", F.lit(0))).alias("fewer"), "name").alias("p"), F.col("lat").alias("p_lat"), F.col("lng").alias("p_lng"),
        F.floor("lng").alias("px"), F.floor("lat").alias("py"),
    )
    asked = boxes.withColumn("px", F.explode(F.sequence(F.floor("west"), F.floor("east")))).withColumn("py", F.explode(F.sequence(F.floor("south"), F.floor("north"))))
    inside = F.col("p_lng").between(F.col("west"), F.col("east")) & F.col("p_lat").between(F.col("south"), F.col("north"))
    return asked.join(known, ["px", "py"]).filter(inside).groupBy(*keys).agg(F.min("p").alias("p")).select(*keys, "p.name")


def _cube(lat: Column, lng: Column, side: float) -> tuple[Column, ...]:
    """The cube of space that a place on the globe lies in; no seam at the poles or the antimeridian."""
    a, o = F.radians(lat), F.radians(lng)
    return tuple(F.floor(v * EARTH_M / side) for v in (F.cos(a) * F.cos(o), F.cos(a) * F.sin(o), F.sin(a)))


def regions(starts: DataFrame, link_m: float = LINK_M) -> DataFrame:
    """(user_id, region, n, west, south, east, north, latest_at) of runs (user_id, activity_id, started_at, lat, lng).

    Runs whose starts lie within ``link_m`` are of one region, directly or by
    others; it is named by its smallest run.  Starts in one cube of half that
    side are linked already, so nodes are cubes: a user has at most as many as
    the globe has (about two million at 25 km), however many runs there are, and
    joining cubes to regions is one bounded task a user.
    """
    side = link_m / 2
    places = starts.groupBy("user_id", "lat", "lng").agg(
        F.min("activity_id").alias("least"), F.max("started_at").alias("latest_at"), F.count("*").alias("n")
    )
    spots = places.withColumn("cube", F.struct(*[c.alias(k) for c, k in zip(_cube(F.col("lat"), F.col("lng"), side), "xyz", strict=True)]))
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    table = F.array(*[F.struct(*[F.lit(v).alias(a) for a, v in zip("xyz", s, strict=True)]) for s in steps])
    around = F.transform(table, lambda s: F.struct(*[(F.col("cube")[a] + s[a]).alias(a) for a in "xyz"]))
    left = spots.select("user_id", F.col("cube").alias("from"), "lat", "lng", F.explode(around).alias("to"))
    right = spots.select(F.col("user_id").alias("o_user"), F.col("cube").alias("o_cube"), F.col("lat").alias("o_lat"), F.col("lng").alias("o_lng"))
    near = metres(F.col("lat"), F.col("lng"), F.col("o_lat"), F.col("o_lng")) <= link_m
    edges = left.join(right, (F.col("user_id") == F.col("o_user")) & (F.col("to") == F.col("o_cube")) & near).select("user_id", "from", "to").distinct()
    cubes = spots.select("user_id", F.col("cube").alias("from"), F.col("cube").alias("to")).distinct().unionByName(edges)
    kind = starts.schema["user_id"].dataType.simpleString()
    named = cubes.groupBy("user_id").applyInArrow(_joined, f"user_id {kind}, cube struct<x:bigint,y:bigint,z:bigint>, root long")
    rows = spots.join(named, ["user_id", "cube"]).groupBy("user_id", "root").agg(
        F.min("least").alias("region"), F.sum("n").alias("n"), F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north"),
        F.max("latest_at").alias("latest_at"),
    )
    return rows.drop("root")


def _joined(edges: pa.Table) -> pa.Table:
    """A user's cubes with the number of their component."""
    parent: dict[tuple, tuple] = {}

    def top(c: tuple) -> tuple:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    ends = [[tuple(s.values()) for s in edges.column(name).to_pylist()] for name in ("from", "to")]
    for a, b in zip(*ends, strict=True):
        parent.setdefault(a, a)
        parent.setdefault(b, b)
        parent[top(a)] = top(b)
    number = {c: i for i, c in enumerate(c for c in parent if parent[c] == c)}
    cubes = list(parent)
    user = pa.repeat(edges.column("user_id")[0], len(cubes))
    return pa.table({
        "user_id": user,
        "cube": pa.array([dict(zip("xyz", c, strict=True)) for c in cubes], pa.struct([(a, pa.int64()) for a in "xyz"])),
        "root": pa.array([number[top(c)] for c in cubes], pa.int64()),
    })


def tenths(x: Column) -> Column:
    """A number that is not negative to one decimal, by its exact binary value: 12.45 lies below the half and goes down.

    The product with ten is split into its rounded value and what that left out.
    """
    ten, high = x * 10, x * 134217729.0 - (x * 134217729.0 - x)
    half = (ten - F.floor(ten) - 0.5) + ((high * 10 - ten) + (x - high) * 10)
    n = F.floor(ten) + (half >= 0).cast("long")
    return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))


def coordinate_label(west: Column, south: Column, east: Column, north: Column) -> Column:
    """A region without a name: its middle to a tenth of a degree."""
    lng, lat = (west + east) / 2, (south + north) / 2
    part = lambda v, minus, plus: F.concat(tenths(F.abs(v)), F.lit("°"), F.when(v < 0, minus).otherwise(plus))
    return F.concat(part(lat, "S", "N"), F.lit(" "), part(lng, "W", "E"))


def returned_to(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, street, gap_days): of rearmed cells (since, started_at, street) the street with most, the first by name of equal ones, and its shortest gap."""
    days = F.floor((F.unix_millis(F.col("started_at").cast("timestamp")) - F.unix_millis(F.col("since").cast("timestamp"))) / 86_400_000)
    streets = cells.filter("street <> ''").groupBy(*keys, "street").agg(F.count("*").alias("c"), F.min(days).alias("gap_days"))
    best = streets.groupBy(*keys).agg(F.min(F.struct((-F.col("c")).alias("fewer"), "street", "gap_days")).alias("b"))
    return best.select(*keys, "b.street", "b.gap_days")


def ground_split(steps: DataFrame, ground: DataFrame, *keys: str) -> DataFrame:
    """(keys, new_m, rearmed_m, recent_m): metres ``m`` of steps by the class of their middle's ``cell``; a cell without class is an error."""
    known = ground.select(*[F.col(k).alias(f"g_{k}") for k in keys], F.col("cell").alias("g_cell"), "class")
    same = F.col("cell") == F.col("g_cell")
    for k in keys:
        same = same & (F.col(k) == F.col(f"g_{k}"))
    unknown = F.raise_error(F.concat(F.lit("no class of ground for cell "), F.col("cell").cast("string"))).cast("string")
    rows = steps.filter("m > 0").join(known, same, "left").withColumn("class", F.when(F.col("class").isNull(), unknown).otherwise(F.col("class")))
    part = lambda c: F.coalesce(F.sum(F.when(F.col("class") == c, F.col("m"))), F.lit(0.0)).alias(f"{c}_m")
    return rows.groupBy(*keys).agg(part("new"), part("rearmed"), part("recent"))
