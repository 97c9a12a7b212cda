"""Routes: dwells as single points, the chain from points to parts, lines for the map, simpler lines, samples, track files.

Points are (user_id, seq, t_ms, lat, lng, ...).  Where a step works within
parts, the part goes into the key, so that the windows of ``trace`` serve.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions.geo import EARTH_M, metres, speed
from trailmill.operators import trace
from trailmill.sources.tables import spread

ROUNDS = 32
TOLERANCE_M = 2.0
SAMPLE_M = 4.0
GPX = "trk STRUCT<trkseg: ARRAY<STRUCT<trkpt: ARRAY<STRUCT<_lat: DOUBLE, _lon: DOUBLE, ele: DOUBLE, time: STRING>>>>>"


def median_place(spots: Column) -> Column:
    """(x, y): the place with the least sum of distances to an array of (x, y), by Weiszfeld's rounds; it stops where it meets one of them."""
    n = F.size(spots).cast("double")
    total = lambda f: F.aggregate(spots, F.lit(0.0), lambda a, s: a + f(s))
    start = F.struct((total(lambda s: s["x"]) / n).alias("x"), (total(lambda s: s["y"]) / n).alias("y"))

    def weighed(at: Column) -> Column:
        away = lambda s: F.sqrt((s["x"] - at["x"]) * (s["x"] - at["x"]) + (s["y"] - at["y"]) * (s["y"] - at["y"]))
        zero = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("w"), F.lit(False).alias("met"))
        more = lambda a, s, d: F.struct(
            (a["x"] + F.try_divide(s["x"], d)).alias("x"), (a["y"] + F.try_divide(s["y"], d)).alias("y"), (a["w"] + F.try_divide(F.lit(1.0), d)).alias("w"), (a["met"] | (d == 0)).alias("met")
        )
        return F.aggregate(spots, zero, lambda a, s: more(a, s, away(s)))

    def moved(at: Column, sums: Column) -> Column:
        return F.when(sums["met"], at).otherwise(F.struct((sums["x"] / sums["w"]).alias("x"), (sums["y"] / sums["w"]).alias("y")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda at, _: F.transform(F.array(weighed(at)), lambda sums: moved(at, sums))[0])


def collapse_dwells(points: DataFrame, slow: float = trace.DWELL_SPEED, least_s: float = trace.DWELL_S) -> DataFrame:
    """(user_id, seq, t_ms, lat, lng): each dwell as one point, the median of its places at the middle of its time; others as they are."""
    fast = F.coalesce(speed(F.col("m"), F.col("s")) >= slow, F.lit(True)).cast("int")
    marked = trace.steps(points).withColumn("island", F.sum(fast).over(trace.by_walk()))
    # Rows come in order out of the window, so the sort costs nothing; an island is a run of them.
    rows = marked.select("user_id", "island", "seq", "t_ms", "lat", "lng").sortWithinPartitions("user_id", "seq")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.drop("island").schema)
    return rows.mapInArrow(lambda batches: _held_whole(batches, lambda table: _settled(table, least_s), "user_id", "island"), schema)


def median_places(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``median_place`` of many groups, whose places follow each other from ``starts``."""
    n = np.diff(np.append(starts, len(x)))
    ax, ay = (np.add.reduceat(v, starts) / n for v in (x, y))
    met, left = np.zeros(len(n), bool), np.arange(len(n))
    for _ in range(ROUNDS):
        of = np.repeat(np.arange(len(left)), n[left])
        d = np.sqrt((x - ax[left][of]) ** 2 + (y - ay[left][of]) ** 2)
        at = np.cumsum(n[left]) - n[left]
        met = np.minimum.reduceat(d, at) == 0
        if met.any():  # these stay where they are
            stay = ~met[of]
            x, y, d, left = x[stay], y[stay], d[stay], left[~met]
            if not len(left):
                break
            at = np.cumsum(n[left]) - n[left]
        w = np.add.reduceat(1 / d, at)
        ax[left], ay[left] = np.add.reduceat(x / d, at) / w, np.add.reduceat(y / d, at) / w
    return ax, ay


def _settled(islands: pa.Table, least_s: float) -> pa.Table:
    """Each island of sorted points that is a dwell as one point, the points of the others as they are."""
    starts = _starts(islands, "user_id", "island")
    n = np.diff(np.append(starts, islands.num_rows))
    t = islands.column("t_ms").to_numpy()
    first, last = (f.reduceat(t, starts) for f in (np.minimum, np.maximum))
    dwell = (n > 1) & ((last - first) / 1000 >= least_s)
    rows = islands.drop_columns("island")
    if not dwell.any():
        return rows
    inside = np.repeat(dwell, n)
    lat, lng = (islands.column(c).to_numpy()[inside] for c in ("lat", "lng"))
    n = n[dwell]
    begin = np.cumsum(n) - n
    flat = np.cos(np.radians(np.add.reduceat(lat, begin) / n))
    x, y = median_places(lng * np.repeat(flat, n), lat, begin)
    middle = np.floor((first[dwell] + last[dwell]) / 2 + 0.5).astype(np.int64)
    placed = rows.select(["user_id", "seq"]).take(pa.array(starts[dwell])).append_column("t_ms", pa.array(middle)).append_column("lat", pa.array(y)).append_column("lng", pa.array(x / flat))
    return pa.concat_tables([rows.filter(pa.array(~inside)), placed.cast(rows.schema)]).combine_chunks()


def parts(points: DataFrame, gap_ms: int, slow: float, least_s: float, teleport: float, jump_m: float, jump_s: float, tasks: int = 0) -> DataFrame:
    """(user_id, segment, part, seq, t_ms, lat, lng): split at gaps, then within each segment cleaned, dwells collapsed, split at implausible jumps.

    ``tasks``: over how many tasks the points are dealt, if more than the session's cores.
    """
    points = spread(points, tasks, "user_id")
    split = trace.split_gaps(points, gap_ms).withColumn("user_id", F.struct("user_id", "segment")).drop("segment")
    split = spread(split.repartition("user_id"), tasks, "user_id")  # serves the cleaning, which would deal by rejects too, and the dwells
    still = collapse_dwells(trace.clean(split).filter("reject IS NULL").drop("reject"), slow, least_s)
    jumps = trace.split_implausible(spread(still, tasks, "user_id"), teleport, jump_m, jump_s).withColumnRenamed("segment", "part")
    return jumps.select("user_id.user_id", "user_id.segment", "part", "seq", "t_ms", "lat", "lng")


def lines(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, line): each part of two points or more as a line of [lng, lat] to six decimals; a part bounds the array."""
    spot = F.format_string("[%.6f,%.6f]", F.col("lng"), F.col("lat"))
    rows = points.groupBy(*keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("seq", spot.alias("s")))).alias("spots")).filter("n >= 2")
    return rows.select(*keys, "n", F.concat(F.lit("["), F.array_join("spots.s", ","), F.lit("]")).alias("line"))


def samples(points: DataFrame, step_m: float = SAMPLE_M) -> DataFrame:
    """(user_id, seq, k, at_m, lat, lng): points at most ``step_m`` apart, straight between those given, with the metres so far; k = 0 is the point itself."""
    w = trace.by_walk()
    back = points.withColumns({"lat0": F.lag("lat").over(w), "lng0": F.lag("lng").over(w)})
    m = F.coalesce(metres(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng")), F.lit(0.0))
    so_far = back.withColumn("m", m).withColumn("end_m", F.sum("m").over(w)).withColumn("n", F.greatest(F.lit(1), F.ceil(F.col("m") / step_m)).cast("int"))
    rows = so_far.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    part = F.when(F.col("k") == 0, 1.0).otherwise(F.col("k") / F.col("n"))
    between = lambda a, b: F.when(F.col("k") == 0, F.col(b)).otherwise(F.col(a) + (F.col(b) - F.col(a)) * part)
    return rows.select("user_id", "seq", "k", (F.col("end_m") - F.col("m") * (1 - part)).alias("at_m"), between("lat0", "lat").alias("lat"), between("lng0", "lng").alias("lng"))


def kept_of(x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which vertices of a line stay: between two that do, the farthest beyond the tolerance."""
    keep = np.zeros(len(x), bool)
    keep[[0, -1]] = True
    open_spans = [(0, len(x) - 1)]
    while open_spans:
        first, last = open_spans.pop()
        if last - first < 2:
            continue
        across, along = x[last] - x[first], y[last] - y[first]
        px, py = x[first + 1 : last] - x[first], y[first + 1 : last] - y[first]
        length = across * across + along * along
        share = np.clip((px * across + py * along) / length, 0, 1) if length else np.zeros(len(px))
        off = np.hypot(px - share * across, py - share * along)
        far = int(off.argmax())
        if off[far] > tolerance:
            keep[first + 1 + far] = True
            open_spans += [(first, first + 1 + far), (first + 1 + far, last)]
    return keep


def simplified(points: DataFrame, tolerance_m: float = TOLERANCE_M) -> DataFrame:
    """(user_id, segment, seq, lat, lng): the vertices of each part without those within the tolerance of the simpler line.

    One part is one group: its length is that of one recording without a gap.
    Parts come sorted, many to a batch, and one that a batch cuts waits for the
    next; parts of two points or less are passed as they are.
    """
    scale = EARTH_M * np.pi / 180

    def whole(table: pa.Table) -> pa.Table:
        lat, lng = (table.column(c).to_numpy() for c in ("lat", "lng"))
        starts = _starts(table, "user_id", "segment")
        ends = np.append(starts[1:], table.num_rows)
        keep = np.ones(table.num_rows, bool)
        for k in np.flatnonzero(ends - starts > 2):
            a, b = starts[k], ends[k]
            keep[a:b] = kept_of(lng[a:b] * scale * np.cos(np.radians(lat[a])), lat[a:b] * scale, tolerance_m)
        return table.filter(pa.array(keep))

    # Its work is far more than its bytes: the number of tasks is given, lest small partitions be put together.
    n = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = points.select("user_id", "segment", "seq", "lat", "lng").repartition(n, "user_id", "segment").sortWithinPartitions("user_id", "segment", "seq")
    return rows.mapInArrow(lambda batches: _held_whole(batches, whole, "user_id", "segment"), rows.schema)


def _held_whole(batches: Iterator[pa.RecordBatch], done: Callable[[pa.Table], pa.Table], *keys: str) -> Iterator[pa.RecordBatch]:
    """``done`` of sorted rows, many groups of the keys at once and none cut: the last of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        start = int(_starts(batch, *keys)[-1])
        if not start and held and _same(held[-1], batch, *keys):
            held.append(batch)  # the whole batch goes on with the group
            continue
        if start:
            held.append(batch.slice(0, start))
        if held:
            yield from done(pa.Table.from_batches(held).combine_chunks()).to_batches()
        held = [batch.slice(start)]
    if held:
        yield from done(pa.Table.from_batches(held).combine_chunks()).to_batches()


def _starts(rows: pa.RecordBatch | pa.Table, *keys: str) -> np.ndarray:
    """Where groups begin in rows that are sorted by keys, structs of keys among them."""
    new = np.zeros(rows.num_rows, bool)
    new[0] = True
    columns = [_whole(rows.column(c)) for c in keys]
    while columns:
        column = columns.pop()
        if pa.types.is_struct(column.type):
            columns += [column.is_null(), *column.flatten()]
            continue
        code = column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def _whole(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _same(before: pa.RecordBatch, after: pa.RecordBatch, *keys: str) -> bool:
    return all(before.column(c)[-1].as_py() == after.column(c)[0].as_py() for c in keys)


def read_tracks(raw: DataFrame, *keys: str) -> DataFrame:
    """(keys, segment, seq, t_ms, lat, lng, altitude) of track files in a column ``xml``; a point without a place is left out."""
    read = raw.select(*keys, F.from_xml("xml", GPX).alias("g"))
    segments = read.select(*keys, F.posexplode("g.trk.trkseg").alias("segment", "s"))
    spots = segments.select(*keys, "segment", F.posexplode("s.trkpt").alias("seq", "p")).filter("p._lat IS NOT NULL AND p._lon IS NOT NULL")
    at = F.unix_millis(F.to_timestamp("p.time"))
    return spots.select(*keys, "segment", "seq", at.alias("t_ms"), F.col("p._lat").alias("lat"), F.col("p._lon").alias("lng"), F.col("p.ele").alias("altitude"))


def last_ends(points: DataFrame) -> DataFrame:
    """(user_id, lat, lng): where each walk ends."""
    return points.groupBy("user_id").agg(F.max_by(F.struct("lat", "lng"), "seq").alias("p")).select("user_id", "p.lat", "p.lng")
