"""Point sequences: gaps, cleaning, dwells, implausible jumps, densifying.

Points are (user_id, seq, t_ms, lat, lng, ...), in order of seq.  Everything
that looks only at neighbours is a window with running sums; the gate that
compares with the last point it accepted is a fold over a walk's sorted points.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions.geo import EARTH_M, interpolate, metres, speed

GAP_MS = 30_000
ACCURACY_M = 50.0
DWELL_SPEED, DWELL_S = 0.5, 60.0
TELEPORT, JUMP_M, JUMP_S = 12.5, 250.0, 120.0
STEP_M = 12.0


def by_walk():
    return Window.partitionBy("user_id").orderBy("seq")


def steps(points: DataFrame) -> DataFrame:
    """Adds metres and seconds from the point before."""
    w = by_walk()
    m = metres(F.lag("lat").over(w), F.lag("lng").over(w), F.col("lat"), F.col("lng"))
    return points.withColumns({"m": m, "s": (F.col("t_ms") - F.lag("t_ms").over(w)) / 1000})


def split_gaps(points: DataFrame, gap_ms: int = GAP_MS) -> DataFrame:
    """Adds ``segment``, from 0: a new one after each gap in time."""
    w = by_walk()
    cut = (F.col("t_ms") - F.lag("t_ms").over(w) > gap_ms).cast("int")
    return points.withColumn("cut", F.coalesce(cut, F.lit(0))).withColumn("segment", F.sum("cut").over(w)).drop("cut")


def clean(points: DataFrame) -> DataFrame:
    """Adds ``reject``: inaccurate, not finite, or a repeat of the last kept point; null if kept.

    An unknown accuracy is kept.  Equality is transitive, so the last kept
    point equals the last one that passed the first two tests.
    """
    finite = ~F.isnan("lat") & ~F.isnan("lng") & (F.abs("lat") < float("inf")) & (F.abs("lng") < float("inf"))
    first = F.when(F.col("accuracy") > ACCURACY_M, "accuracy").when(~finite, "non_finite")
    passed = points.withColumn("reject", first)
    w = Window.partitionBy("user_id", F.col("reject").isNull()).orderBy("seq")
    same = F.col("reject").isNull() & (F.lag("lat").over(w) == F.col("lat")) & (F.lag("lng").over(w) == F.col("lng"))
    return passed.withColumn("reject", F.when(same, "duplicate").otherwise(F.col("reject")))


def split_implausible(points: DataFrame, teleport: float = TELEPORT, jump_m: float = JUMP_M, jump_s: float = JUMP_S) -> DataFrame:
    """Adds ``segment``: a new one where a step is too fast, or far and long at once; all strict."""
    moved = steps(points)
    cut = (speed(F.col("m"), F.col("s")) > teleport) | ((F.col("m") > jump_m) & (F.col("s") > jump_s))
    return moved.withColumn("segment", F.sum(F.coalesce(cut, F.lit(False)).cast("int")).over(by_walk())).drop("m", "s")


def dwell_islands(points: DataFrame, slow: float = DWELL_SPEED, least_s: float = DWELL_S) -> DataFrame:
    """(user_id, island, first_seq, n, seconds, dwell): maximal runs of slow steps; those long enough are dwells.

    Time must not run backwards.
    """
    moved = steps(points)
    fast = F.coalesce(speed(F.col("m"), F.col("s")) >= slow, F.lit(True)).cast("int")
    grouped = moved.withColumn("island", F.sum(fast).over(by_walk())).groupBy("user_id", "island")
    runs = grouped.agg(F.min("seq").alias("first_seq"), F.count("*").alias("n"), ((F.max("t_ms") - F.min("t_ms")) / 1000).alias("seconds"))
    return runs.withColumn("dwell", (F.col("n") > 1) & (F.col("seconds") >= least_s))


def _metres(lat1: float | None, lng1: float | None, lat2: float | None, lng2: float | None) -> float | None:
    """``geo.metres`` of two points, with Spark's results for nulls and numbers that are not finite."""
    if None in (lat1, lng1, lat2, lng2):
        return None
    h = 1.0
    if all(map(math.isfinite, (lat1, lng1, lat2, lng2))):
        dlat, dlng = math.sin(math.radians(lat2 - lat1) / 2), math.sin(math.radians(lng2 - lng1) / 2)
        h = dlat * dlat + math.cos(math.radians(lat1)) * math.cos(math.radians(lat2)) * dlng * dlng
    return 2 * EARTH_M * math.asin(1.0 if h > 1 else math.sqrt(h))


def _too_fast(last: tuple, point: tuple, gate: float) -> bool:
    m = _metres(*last[1:], *point[1:])
    if m is None:
        return False
    s = None if last[0] is None or point[0] is None else (point[0] - last[0]) / 1000
    return (m / s if s is not None and s > 0 else math.inf if m > 0 else 0.0) > gate


def gate_speed(points: DataFrame, gate: float) -> DataFrame:
    """(user_id, kept, rejected) by comparing each point with the last accepted one.

    A fold over the points of a walk as they come out of Spark's sort, which
    spills: kept are the last accepted point and two counters, whatever the walk's length.
    """
    kind = points.schema["user_id"].dataType.simpleString()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, last, kept, rejected = None, None, 0, 0
        for batch in batches:
            done = []
            for who, *point in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                if last is not None and who != user:
                    done.append((user, kept, rejected))
                    last, kept, rejected = None, 0, 0
                user = who
                if last is not None and _too_fast(last, point, gate):
                    rejected += 1
                else:
                    last, kept = point, kept + 1
            yield _counts(done, batch.schema.field(0).type)
        if last is not None:
            yield _counts([(user, kept, rejected)], batch.schema.field(0).type)

    walks = points.select("user_id", "seq", "t_ms", "lat", "lng").repartition(F.col("user_id")).sortWithinPartitions("user_id", "seq", "t_ms", "lat", "lng")
    return walks.select("user_id", "t_ms", "lat", "lng").mapInArrow(fold, f"user_id {kind}, kept long, rejected long")


def _counts(done: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    users, kept, rejected = zip(*done, strict=True) if done else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(users, kind), pa.array(kept, pa.int64()), pa.array(rejected, pa.int64())], names=["user_id", "kept", "rejected"])


def densify(points: DataFrame, step_m: float = STEP_M) -> DataFrame:
    """(user_id, seq, k, lat, lng): ceil(metres / step) points an edge, from its start, and the last point."""
    w = by_walk()
    edges = points.withColumns({"lat2": F.lead("lat").over(w), "lng2": F.lead("lng").over(w)})
    m = metres(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2"))
    n = F.when(F.col("lat2").isNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(m / step_m))).cast("int")
    rows = edges.withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    lat, lng = interpolate(F.col("lat"), F.col("lng"), F.coalesce("lat2", "lat"), F.coalesce("lng2", "lng"), F.col("k") / F.col("n"))
    return rows.select("user_id", "seq", "k", lat.alias("lat"), lng.alias("lng"))


def fidelity(points: DataFrame, floor_ms: int, span_s: int) -> DataFrame:
    """(user_id, median_ms, span_s, violates): the median interval is too long over a long enough span."""
    gaps = points.withColumn("gap", F.col("t_ms") - F.lag("t_ms").over(by_walk()))
    rows = gaps.groupBy("user_id").agg(F.median("gap").alias("median_ms"), ((F.max("t_ms") - F.min("t_ms")) / 1000).alias("span_s"))
    return rows.withColumn("violates", F.coalesce((F.col("median_ms") > floor_ms) & (F.col("span_s") >= span_s), F.lit(False)))


def arc_positions(points: DataFrame) -> DataFrame:
    """Adds metres so far and the share of the walk's length; gaps between parts do not count."""
    w = by_walk()
    whole = Window.partitionBy("user_id")
    moved = steps(points).withColumn("so_far", F.sum(F.coalesce("m", F.lit(0.0))).over(w))
    total = F.max("so_far").over(whole)
    return moved.withColumn("arc", F.when(total > 0, F.col("so_far") / total).otherwise(0.0)).drop("m", "s")


def boxes(points: DataFrame) -> DataFrame:
    return points.groupBy("user_id").agg(F.min("lng").alias("west"), F.min("lat").alias("south"), F.max("lng").alias("east"), F.max("lat").alias("north"))
