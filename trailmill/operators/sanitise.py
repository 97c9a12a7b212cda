"""From archived envelopes to sanitised traces: refusals per activity, accepted points, breaks, gaps, the fidelity floor.

A bad activity never ends the job: what is wrong with it is a reason in its
row, and the others go on.  The chain is refusal, zip, anchor and gate, gaps,
floor, box; each step adds columns to points that stay in order of (walk, seq).

The gate compares with the last accepted point, so it is a fold.  A walk is one
recording of one activity, and an envelope holds it whole, so envelopes are
judged where they are read, many to a batch, without a shuffle of their points:
``activities`` and ``flagged_points``.  Points that come as a table go through
``accepted`` and ``shapes``: out of Spark's sort, which spills, the fold holds
one batch and the last accepted point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions.geo import EARTH_M, speed_gate
from trailmill.operators import intake

GAP_MS = 30_000
#: Longest median interval, three points in ten seconds, and the span from which on it counts.
FLOOR_MS, MEASURABLE_MS = 1000 / 0.3, 60_000


def aligned(streams: Column) -> Column:
    """Whether all streams that are there have as many values, and each has its values."""
    sizes = F.array_compact(F.array(*[F.when(streams[s].isNotNull(), F.coalesce(F.size(streams[s]["data"]), F.lit(-1))) for s in ("latlng", "time", "altitude", "distance")]))
    return streams.isNull() | (F.size(F.array_distinct(sizes)) <= 1) & ~F.array_contains(sizes, -1)


def refusals(read: DataFrame) -> DataFrame:
    """Adds ``bad``: why an envelope is refused before its points are looked at, the first reason; null if it is not."""
    d, s = F.col("envelope.detail"), F.col("envelope.streams")
    clock = F.try_to_timestamp(F.regexp_replace(d["start_date_local"], "Z$", "")).isNull() | ~d["start_date_local"].rlike(intake.CLOCK)
    zone = intake.bare_zone(d["timezone"])
    place = F.exists(s["latlng"]["data"], lambda p: (F.size(p) < 2) | F.get(p, F.lit(0)).isNull() | F.get(p, F.lit(1)).isNull() | p.isNull())
    late = F.exists(s["time"]["data"], lambda t: t.isNull())
    bad = (
        F.when(F.col("envelope").isNull(), "no envelope")
        .when(d["id"].isNull(), "no id")
        .when(F.try_to_timestamp(d["start_date"]).isNull(), "no start")
        .when(d["start_date_local"].isNotNull() & clock, "no local time")
        .when(zone.isNotNull() & ~intake.known_zone(zone), "unknown zone")
        .when(~aligned(s), "streams of unequal length")
        .when(F.coalesce(place, F.lit(False)), "no place")
        .when(F.coalesce(late, F.lit(False)), "no time of a point")
    )
    return read.withColumn("bad", bad)


def _leap(lat: np.ndarray, lng: np.ndarray, t: np.ndarray, i, j) -> np.ndarray:
    """Implied speed from points i to j: without time infinite for any distance."""
    a, b, o = np.radians(lat[i]), np.radians(lat[j]), np.radians(lng[j] - lng[i])
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(o / 2) ** 2
    m, s = 2 * EARTH_M * np.arcsin(np.minimum(1, np.sqrt(h))), (t[j] - t[i]) / 1000
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(s > 0, m / s, np.where(m > 0, np.inf, 0.0))


def gated(lat: np.ndarray, lng: np.ndarray, t: np.ndarray, gate: float, last: bool) -> np.ndarray:
    """Which points are accepted.  ``last``: point 0 was accepted in an earlier batch; else the first two steps choose the anchor."""
    n = len(t)
    kept = np.zeros(n, bool)
    step = _leap(lat, lng, t, np.arange(n - 1), np.arange(1, n))
    at = 0
    if not last and n > 2 and step[0] > gate and step[1] <= gate:
        at = 1
    while True:
        ahead = np.flatnonzero(step[at:] > gate)
        end = at + int(ahead[0]) if len(ahead) else n - 1
        kept[at : end + 1] = True
        j, width = end + 1, 16
        while j < n:  # the next point that the last accepted one can reach
            rows = np.arange(j, min(n, j + width))
            near = np.flatnonzero(_leap(lat, lng, t, np.full(len(rows), end), rows) <= gate)
            if len(near):
                j = int(rows[near[0]])
                break
            j, width = int(rows[-1]) + 1, width * 2
        if j >= n:
            return kept
        at = j


def accepted(points: DataFrame, *keys: str) -> DataFrame:
    """Adds ``kept`` and ``broke`` to points (keys, kind, seq, t_ms, lat, lng, ...): accepted or not, and whether points were dropped just before an accepted one.

    A first point that nothing corroborates, though the second is, is dropped
    without a break: there is nothing before it.
    """
    names = points.columns
    rows = points.withColumn("_gate", speed_gate(F.col("kind"))).repartition(*keys).sortWithinPartitions(*keys, "seq")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema) + ", kept boolean, broke boolean"

    def flags(lat: np.ndarray, lng: np.ndarray, t: np.ndarray, gate: float, carried: tuple | None) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Of a run of one walk; carried: (lat, lng, t, whether points were dropped after it) of its last accepted point in an earlier batch."""
        lead = 0
        if carried:
            lat, lng, t, lead = np.insert(lat, 0, carried[0]), np.insert(lng, 0, carried[1]), np.insert(t, 0, carried[2]), 1
        kept = gated(lat, lng, t, gate, bool(carried))
        at = np.flatnonzero(kept)
        broke = np.zeros(len(kept), bool)
        broke[at[1:]] = np.diff(at) > 1
        if carried and carried[3] and len(at) > 1:
            broke[at[1]] = True
        end = at[-1]
        dropped = end < len(kept) - 1 or bool(carried and carried[3] and len(at) == 1)
        return kept[lead:], broke[lead:], (lat[end], lng[end], t[end], dropped)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        walk, carried = None, None
        for batch in _and_end(batches):
            table = pa.Table.from_batches([batch]) if batch is not None else None
            if waiting is not None:
                table = pa.concat_tables([waiting, table]) if table is not None else waiting
                waiting = None
            if table is None or not table.num_rows:
                continue
            ids = list(zip(*(table.column(k).to_pylist() for k in keys), strict=True))
            cuts = [0, *(i for i in range(1, len(ids)) if ids[i] != ids[i - 1]), len(ids)]
            if batch is not None and len(ids) - cuts[-2] < 3 and ids[cuts[-2]] != walk:  # its anchor may need a point of the next batch
                waiting = table.slice(cuts.pop(-2) if len(cuts) > 2 else 0)
                table = table.slice(0, table.num_rows - waiting.num_rows)
                cuts = [c for c in cuts if c <= table.num_rows]
                if cuts[-1] != table.num_rows:
                    cuts.append(table.num_rows)
            n = table.num_rows
            kept, broke = np.ones(n, bool), np.zeros(n, bool)
            lat, lng, t, gate = (table.column(c).to_numpy().astype(float) for c in ("lat", "lng", "t_ms", "_gate"))
            fast = np.concatenate([[False], _leap(lat, lng, t, np.arange(n - 1), np.arange(1, n)) > gate[1:]]) if n else kept
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if ids[a] != walk:
                    walk, carried = ids[a], None
                if carried or fast[a + 1 : b].any():
                    kept[a:b], broke[a:b], carried = flags(lat[a:b], lng[a:b], t[a:b], float(gate[a]), carried)
                else:
                    carried = (lat[b - 1], lng[b - 1], t[b - 1], False)
            done = table.drop_columns("_gate").append_column("kept", pa.array(kept)).append_column("broke", pa.array(broke))
            yield from done.combine_chunks().to_batches()

    return rows.mapInArrow(fold, schema).select(*names, "kept", "broke")


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def shapes(points: DataFrame, *keys: str, gap_ms: int = GAP_MS) -> DataFrame:
    """Per walk of flagged points with ``timed``: points kept and rejected, breaks, segments, box, and ``violation`` of the floor.

    The floor: no times at all, or too few points a second over a measurable
    span; a walk of one point cannot be measured.  A new segment begins after a
    gap in time and where points were dropped.
    """
    w = Window.partitionBy(*keys, "kept").orderBy("seq")
    kept = lambda c: F.when(F.col("kept"), F.col(c))
    gaps = points.withColumn("gap", F.when(F.col("kept"), F.col("t_ms") - F.lag("t_ms").over(w)))
    cut = F.coalesce(F.col("gap") > gap_ms, F.lit(False)) | F.col("broke")
    rows = gaps.groupBy(*keys).agg(
        F.count_if("kept").alias("n_points"), F.count_if(~F.col("kept")).alias("rejected"), F.count_if("broke").alias("breaks"), (F.count_if(cut) + 1).alias("segments"),
        F.min(kept("lng")).alias("west"), F.min(kept("lat")).alias("south"), F.max(kept("lng")).alias("east"), F.max(kept("lat")).alias("north"),
        F.bool_and("timed").alias("timed"), F.median("gap").alias("median"), (F.max_by(kept("t_ms"), kept("seq")) - F.min_by(kept("t_ms"), kept("seq"))).alias("span"),
    )
    slow = (F.col("span") >= MEASURABLE_MS) & (F.col("median") > FLOOR_MS)
    violation = F.when(F.col("n_points") < 2, None).when(~F.col("timed"), "no time stream").when(slow, "too few points")
    return rows.withColumn("violation", violation).drop("timed", "median", "span")


def split_gaps(points: DataFrame, *keys: str, gap_ms: int = GAP_MS) -> DataFrame:
    """Adds ``segment`` to accepted points, from 0: a new one after a gap in time and where points were dropped."""
    w = Window.partitionBy(*keys).orderBy("seq")
    cut = F.coalesce(F.col("t_ms") - F.lag("t_ms").over(w) > gap_ms, F.lit(False)) | F.col("broke")
    return points.withColumn("cut", cut.cast("int")).withColumn("segment", F.sum("cut").over(w)).drop("cut")


KEYS = ("user_id", "external_id")
#: Walks of up to so many points are gated side by side, longer ones each alone.
ABREAST = 256
SHAPE = "n_points long, rejected long, breaks long, segments long, west double, south double, east double, north double"


def gated_abreast(lat: np.ndarray, lng: np.ndarray, t: np.ndarray, gate: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``gated`` for many walks at once, a point of each at a time: walks begin at ``start``, have n > 1 points and their own gate."""
    order = np.argsort(-n, kind="stable")
    start, n, gate = start[order], n[order], gate[order]
    kept = np.zeros(len(lat), bool)
    third = np.minimum(start + 2, start + n - 1)
    late = (n > 2) & (_leap(lat, lng, t, start, start + 1) > gate) & (_leap(lat, lng, t, start + 1, third) <= gate)
    last = start + late
    kept[last] = True
    for k in range(1, int(n[0])):
        open_ = np.searchsorted(-n, -k)  # walks that have a point k
        at, before, most = start[:open_] + k, last[:open_], gate[:open_]
        v = _leap(lat, lng, t, before, at)
        ok = np.where(before == at - 1, ~(v > most), v <= most) & (before < at)
        kept[at[ok]] = True
        last[:open_] = np.where(ok, at, before)
    return kept


class _Traces:
    """The points of a batch of envelopes: flat arrays, ``w`` the row of each point, and what the chain finds of them."""

    def __init__(self, batch: pa.RecordBatch):
        size = lambda c: pc.fill_null(pc.list_value_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.rows, self.n = batch.num_rows, size("places")
        self.w = np.repeat(np.arange(self.rows), self.n)
        first = np.cumsum(self.n) - self.n
        self.seq = np.arange(len(self.w)) - first[self.w]
        spots = batch.column("places").flatten()
        flat, at = spots.values.to_numpy(zero_copy_only=False), spots.offsets.to_numpy()[:-1]
        self.lat, self.lng = (flat[at + k] if len(at) else np.zeros(0) for k in (0, 1))
        times = pc.fill_null(batch.column("times").flatten(), 0).to_numpy(zero_copy_only=False)
        self.t_ms = self.column(batch, "start_ms").astype(np.int64)[self.w] + self._of(times, size("times"), self.seq) * 1000
        self.timed = self.column(batch, "timed").astype(bool)
        self._gate(first, self.column(batch, "gate").astype(float))

    @staticmethod
    def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
        return pc.fill_null(batch.column(name), 0 if name != "timed" else False).to_numpy(zero_copy_only=False)

    def _of(self, values: np.ndarray, n: np.ndarray, default: np.ndarray) -> np.ndarray:
        """The value of a stream at each point."""
        has, at = self.seq < n[self.w], self.index_in(n)
        return np.where(has, values[np.minimum(at, len(values) - 1)], default) if len(values) else default

    def index_in(self, n: np.ndarray) -> np.ndarray:
        """The place of each point in a flat stream of n values a row."""
        return (np.cumsum(n) - n)[self.w] + self.seq

    def _gate(self, first: np.ndarray, gate: np.ndarray) -> None:
        lat, lng, t, w = self.lat, self.lng, self.t_ms.astype(float), self.w
        self.kept, self.broke = np.ones(len(w), bool), np.zeros(len(w), bool)
        at = np.arange(1, len(w))
        leaps = (w[1:] == w[:-1]) & (_leap(lat, lng, t, at - 1, at) > gate[w[1:]])
        fast = np.zeros(self.rows, bool)
        fast[w[1:][leaps]] = True
        few = np.flatnonzero(fast & (self.n <= ABREAST))
        if len(few):
            points = fast[w] & (self.n <= ABREAST)[w]
            self.kept[points] = gated_abreast(lat, lng, t, gate[few], first[few], self.n[few])[points]
        for k in np.flatnonzero(fast & (self.n > ABREAST)):
            of = slice(first[k], first[k] + self.n[k])
            self.kept[of] = gated(lat[of], lng[of], t[of], float(gate[k]), False)
        # Of accepted points: the time from the one before in the walk, whether points were dropped between, and the segment.
        self.at = np.flatnonzero(self.kept)
        self.of = w[self.at]
        new = np.ones(len(self.at), bool)
        new[1:] = self.of[1:] != self.of[:-1]
        self.starts = np.flatnonzero(new)
        self.gap = np.diff(self.t_ms[self.at], prepend=0)
        self.inner = ~new
        self.broke[self.at] = self.inner & (np.diff(self.at, prepend=0) > 1)
        self.cut = (self.inner & (self.gap > GAP_MS)) | self.broke[self.at]
        run = np.cumsum(self.cut)
        self.segment = np.zeros(len(w), np.int64)
        self.segment[self.at] = run - np.repeat(run[self.starts], np.diff(np.append(self.starts, len(run))))

    def count(self, rows: np.ndarray) -> np.ndarray:
        return np.bincount(rows, minlength=self.rows)

    def violation(self) -> np.ndarray:
        """Per row what the floor says, null where it lets the walk through."""
        n, gaps, of = self.count(self.of), self.gap[self.inner], self.of[self.inner]
        found = np.full(self.rows, None, object)
        if not len(self.at):
            return found
        gaps = gaps[np.lexsort((gaps, of))]
        m = n[n > 1] - 1
        begin = np.cumsum(m) - m
        ends = np.append(self.starts[1:], len(self.at)) - 1
        span = (self.t_ms[self.at[ends]] - self.t_ms[self.at[self.starts]])[n[self.of[self.starts]] > 1]
        slow = (span >= MEASURABLE_MS) & ((gaps[begin + (m - 1) // 2] + gaps[begin + m // 2]) / 2 > FLOOR_MS)
        found[np.flatnonzero(n > 1)[slow]] = "too few points"
        found[(n > 1) & ~self.timed] = "no time stream"
        return found

    def shapes(self) -> list[pa.Array]:
        """The columns of SHAPE, null for rows without points."""
        none = self.n == 0
        n = self.count(self.of)
        counts = (n, self.n - n, self.count(self.w[self.broke]), self.count(self.of[self.cut]) + 1)
        out = [pa.array(c.astype(np.int64), mask=none) for c in counts]
        for values, ends in ((self.lng, np.fmin), (self.lat, np.fmin), (self.lng, np.maximum), (self.lat, np.maximum)):
            box = np.zeros(self.rows)
            if len(self.at):
                box[self.of[self.starts]] = ends.reduceat(values[self.at], self.starts)
            out.append(pa.array(box, mask=none))
        return out


def _traces(judged: DataFrame, *more: Column) -> DataFrame:
    """An envelope a row, with its streams as far as it is not refused."""
    d, s = F.col("envelope.detail"), F.col("envelope.streams")
    good = lambda c: F.when(F.col("bad").isNull(), c)
    kind = intake.sport_kind(d["sport_type"])
    return judged.select(
        "user_id", d["id"].alias("external_id"), kind.alias("kind"), "bad", speed_gate(kind).cast("double").alias("gate"), s["time"].isNotNull().alias("timed"),
        good(F.unix_millis(F.try_to_timestamp(d["start_date"]))).alias("start_ms"), good(s["latlng"]["data"]).alias("places"), good(s["time"]["data"]).alias("times"), *more
    )


def activities(judged: DataFrame) -> DataFrame:
    """(user_id, external_id, kind, bad, n_points, rejected, breaks, segments, west, south, east, north) of every envelope, each judged by its own points.

    A refused activity and one without a trace have no points; a trace below the floor refuses its activity.
    """
    rows = _traces(judged)
    heads = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("user_id", "external_id", "kind", "bad")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            traces = _Traces(batch)
            bad = pc.coalesce(batch.column("bad"), pa.array(traces.violation(), pa.string()))
            names = ["user_id", "external_id", "kind", "bad", *(c.split()[0] for c in SHAPE.split(", "))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:3]), bad, *traces.shapes()], names=names)

    return rows.mapInArrow(judge, ", ".join([*heads, SHAPE]))


def flagged_points(judged: DataFrame) -> DataFrame:
    """Points of the envelopes that are not refused, with kind, timed, kept and broke, and the segment of those kept; ``violation`` is the floor's of their walk."""
    s = F.col("envelope.streams")
    rows = _traces(judged, F.when(F.col("bad").isNull(), s["altitude"]["data"]).alias("heights"))
    keys = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in ("kind", "timed", *KEYS))
    schema = f"{keys}, seq int, t_ms long, lat double, lng double, altitude double, kept boolean, broke boolean, segment long, violation string"

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _Traces(batch)
            heights = batch.column("heights")
            n = pc.fill_null(pc.list_value_length(heights), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            altitude = heights.flatten().take(pa.array(p.index_in(n), mask=p.seq >= n[p.w]))
            w = pa.array(p.w)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(w) for c in ("kind", "timed", *KEYS)), pa.array(p.seq, pa.int32()), pa.array(p.t_ms), pa.array(p.lat), pa.array(p.lng), altitude,
                 pa.array(p.kept), pa.array(p.broke), pa.array(p.segment, mask=~p.kept), pa.array(p.violation(), pa.string()).take(w)],
                names=["kind", "timed", *KEYS, "seq", "t_ms", "lat", "lng", "altitude", "kept", "broke", "segment", "violation"],
            )

    return rows.mapInArrow(judge, schema)


def sanitised_activities(judged: DataFrame, points: DataFrame) -> DataFrame:
    """``activities`` of envelopes and a table of their flagged points, by one join."""
    d = F.col("envelope.detail")
    heads = judged.select("user_id", d["id"].alias("external_id"), intake.sport_kind(d["sport_type"]).alias("kind"), "bad")
    traces = shapes(points, *KEYS).withColumnsRenamed({k: f"t_{k}" for k in KEYS})
    joined = heads.join(traces, F.col("user_id").eqNullSafe(F.col("t_user_id")) & (F.col("external_id") == F.col("t_external_id")), "left")
    return joined.withColumn("bad", F.coalesce("bad", "violation")).drop("t_user_id", "t_external_id", "violation")


def sanitised_points(points: DataFrame) -> DataFrame:
    """(user_id, external_id, segment, seq, t_ms, lat, lng, altitude): accepted points of the traces that the floor lets through."""
    return points.filter("kept AND violation IS NULL").select(*KEYS, "segment", "seq", "t_ms", "lat", "lng", "altitude")
