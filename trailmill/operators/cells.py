"""Hexagon cells of real points: ids, centres, discs, areas, and the ground that a walk reveals.

The grid itself is ``functions.hexgrid`` over Arrow batches.  Ids stay longs
throughout; a null or non-finite place has no cell, and what is asked of a null
cell is null.  Ids of several resolutions may be mixed in a column.

``corridor`` makes candidates per edge of a walk and measures each against that
edge alone: a cell within the radius of an edge lies in the disc around a place
on this very edge, so the union over edges is the set for the whole walk, no
edge meets another's candidates, and nothing is shuffled but revealed cells,
which every task has already made distinct.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmill.functions import hexgrid
from trailmill.functions.geo import EARTH_M
from trailmill.operators import trace

RES = 11
REVEAL_M = 65.0
#: Dense points of a batch of edges that are worked on at once.
DENSE = 20_000


def _resolutions(ids: np.ndarray) -> np.ndarray:
    return (ids >> 52) & 15


def _by_resolution(column: pa.Array, work: Callable[[np.ndarray, int], list]) -> list:
    """Results of ``work`` (ids of one resolution) in the order of the column; None for null."""
    out = np.full(len(column), None, object)
    valid = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    ids = column.drop_null().to_numpy().astype(np.int64)
    found = _resolutions(ids)
    for res in np.unique(found):
        rows = np.flatnonzero(found == res)
        for at, x in zip(valid[rows], work(ids[rows], int(res)), strict=True):
            out[at] = x
    return out.tolist()


def cell_at(lat: Column, lng: Column, res: int = RES) -> Column:
    """The cell of a place in degrees."""

    @F.arrow_udf("bigint")
    def cell(lat: pa.Array, lng: pa.Array) -> pa.Array:
        number = lambda c: c.cast(pa.float64()).to_numpy(zero_copy_only=False)  # noqa: E731  null is NaN
        ids = hexgrid.cells_of(number(lat), number(lng), res)
        return pa.array(ids, pa.int64(), mask=ids == 0)

    return cell(lat, lng)


def centre(cell: Column) -> Column:
    """(lat, lng) of a cell's centre in degrees."""

    @F.arrow_udf("struct<lat:double,lng:double>")
    def place(cell: pa.Array) -> pa.Array:
        kind = pa.struct([("lat", pa.float64()), ("lng", pa.float64())])
        return pa.array(_by_resolution(cell, lambda ids, res: [{"lat": a, "lng": b} for a, b in zip(*(x.tolist() for x in hexgrid.centres_of(ids, res)), strict=True)]), kind)

    return place(cell)


def area_km2(cell: Column) -> Column:
    @F.arrow_udf("double")
    def area(cell: pa.Array) -> pa.Array:
        return pa.array(_by_resolution(cell, lambda ids, res: hexgrid.areas_of(ids, res).tolist()), pa.float64())

    return area(cell)


def _disc_lists(ids: np.ndarray, k: int, res: int) -> list[np.ndarray]:
    owner, cell = hexgrid.discs_of(ids, k, res)
    order = np.argsort(owner, kind="stable")
    return np.split(cell[order], np.cumsum(np.bincount(owner, minlength=len(ids)))[:-1])


def discs_of(cells: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(place of the cell asked, cell within k steps) of cells of any resolutions."""
    res = _resolutions(cells)
    found = [(rows[owner], near) for r in np.unique(res) for rows in [np.flatnonzero(res == r)] for owner, near in [hexgrid.discs_of(cells[rows], k, int(r))]]
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def disc(cell: Column, k: int) -> Column:
    """Array of the cells within k steps, the cell itself included."""

    @F.arrow_udf("array<bigint>")
    def around(cell: pa.Array) -> pa.Array:
        return pa.array(_by_resolution(cell, lambda ids, res: _disc_lists(ids, k, res)), pa.list_(pa.int64()))

    return around(cell)


def neighbours(cell: Column) -> Column:
    """Array of the cells next to a cell: six, of a pentagon five."""
    return F.array_remove(disc(cell, 1), cell)


def reach(radius_m: float, res: int, step_m: float) -> int:
    """Steps within which every cell lies whose centre is ``radius_m`` from a point at most half a step off the disc's first cell.

    On a face lengths shrink by at most 1 + tan^2 of its corners' angle; k
    steps of a hexagon grid go at least k times the spacing times cos 30.
    """
    widest = hexgrid.UNIT * EARTH_M * 7 ** (-res / 2)
    least = widest / (1 + (2 * hexgrid.UNIT) ** 2)
    return int((radius_m + step_m / 2 + widest / np.sqrt(3)) / (least * np.cos(np.pi / 6)))


def _from_segment(lat: np.ndarray, lng: np.ndarray, lat1, lng1, lat2, lng2) -> np.ndarray:
    """Metres from places to edges, on the plane around the place; longitudes the short way round."""
    scale = EARTH_M * np.pi / 180
    east = lambda x: ((x - lng + 180) % 360 - 180) * np.cos(np.radians(lat)) * scale
    ax, ay, bx, by = east(lng1), (lat1 - lat) * scale, east(lng2), (lat2 - lat) * scale
    dx, dy = bx - ax, by - ay
    length = dx * dx + dy * dy
    t = np.clip(-(ax * dx + ay * dy) / np.where(length == 0, 1, length), 0, 1) * (length > 0)
    return np.hypot(ax + t * dx, ay + t * dy)


def _revealed(edges: np.ndarray, radius_m: float, res: int, step_m: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the edge, cell) for edges (lat1, lng1, lat2, lng2), some at a time."""
    a, b = (hexgrid.sphere(np.radians(edges[:, i]), np.radians(edges[:, i + 1])) for i in (0, 2))
    angle = 2 * np.arcsin(np.clip(np.linalg.norm(a - b, axis=1) / 2, 0, 1))
    n = np.maximum(1, np.ceil(angle * EARTH_M / step_m)).astype(np.int64)
    k = reach(radius_m, res, step_m)
    ends = np.cumsum(n + 1)
    first = 0
    while first < len(edges):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + DENSE, side="right")))
        rows = np.arange(first, last)
        first = last
        edge = np.repeat(rows, n[rows] + 1)
        at = np.arange(len(edge)) - np.repeat(np.concatenate([[0], np.cumsum(n[rows] + 1)[:-1]]), n[rows] + 1)
        f, d = at / n[edge], angle[edge]
        sin = np.where(d == 0, 1, np.sin(d))
        s1, s2 = np.where(d == 0, 1 - f, np.sin((1 - f) * d) / sin), np.where(d == 0, f, np.sin(f * d) / sin)
        v = s1[:, None] * a[edge] + s2[:, None] * b[edge]
        cells, which = np.unique(hexgrid.cells_of(*hexgrid.degrees(v / np.linalg.norm(v, axis=1, keepdims=True)), res), return_inverse=True)
        # Pairs are sorted as one whole number; rows of two sort several times slower.
        met = np.stack(np.divmod(np.unique(edge * len(cells) + which.ravel()), len(cells)), 1)
        owner, around = hexgrid.discs_of(cells, k, res)
        order = np.argsort(owner, kind="stable")
        around, size = around[order], np.bincount(owner, minlength=len(cells))
        start = np.concatenate([[0], np.cumsum(size)[:-1]])
        many = size[met[:, 1]]
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(start[met[:, 1]], many)
        asked, spot = np.unique(around, return_inverse=True)
        lat, lng = hexgrid.centres_of(asked, res)
        e, c = np.divmod(np.unique(np.repeat(met[:, 0], many) * len(asked) + spot.ravel()[at]), len(asked))
        near = _from_segment(lat[c], lng[c], *edges[e].T) <= radius_m
        yield e[near], asked[c[near]]


def corridor(parts: DataFrame, *keys: str, part: str = "part", radius_m: float = REVEAL_M, res: int = RES, step_m: float = trace.STEP_M) -> DataFrame:
    """(keys, cell): cells whose centre is within the radius of the path of a walk's parts (keys, part, seq, lat, lng).

    Between parts there is no path.  A part of one point is a path of that
    point; a point without a finite place is left out.
    """
    w = Window.partitionBy(*keys, part).orderBy("seq")
    finite = lambda c: F.coalesce(F.abs(c) < float("inf"), F.lit(False)) & ~F.isnan(c)
    placed = parts.filter(finite("lat") & finite("lng")).select(*keys, part, "seq", "lat", "lng")
    edges = placed.select(*keys, "lat", "lng", F.lead("lat").over(w).alias("lat2"), F.lead("lng").over(w).alias("lng2"), F.lag("lat").over(w).isNull().alias("alone"))
    paths = edges.filter("lat2 IS NOT NULL OR alone").select(*keys, "lat", "lng", F.coalesce("lat2", "lat").alias("lat2"), F.coalesce("lng2", "lng").alias("lng2"))

    def reveal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ends = np.stack([batch.column(len(keys) + i).to_numpy() for i in range(4)], 1)
            for edge, cell in _revealed(ends, radius_m, res, step_m):
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(edge)) for i in range(len(keys))), pa.array(cell)], names=[*keys, "cell"])

    kinds = ", ".join(f"`{k}` {parts.schema[k].dataType.simpleString()}" for k in keys)
    return paths.mapInArrow(reveal, f"{kinds}, cell long").distinct()


def rejects(points: DataFrame, gap_ms: int, *keys: str) -> DataFrame:
    """(keys, accuracy, duplicate, non_finite): points of a walk that cleaning leaves out, each segment between gaps for itself."""
    split = trace.split_gaps(points, gap_ms).withColumn("user_id", F.struct("user_id", "segment")).drop("segment")
    cleaned = trace.clean(split).select("user_id.user_id", "user_id.segment", "reject")
    count = lambda c: F.count_if(F.col("reject") == c).alias(c)
    return cleaned.groupBy(*keys).agg(*map(count, ("accuracy", "duplicate", "non_finite")))


def middles(parts: DataFrame, *keys: str, part: str = "part", res: int = RES) -> DataFrame:
    """(keys, m, cell): the steps within parts, their metres and the cell under their middle."""
    from trailmill.functions.geo import interpolate, metres

    w = Window.partitionBy(*keys, part).orderBy("seq")
    before = parts.select(*keys, F.lag("lat").over(w).alias("lat1"), F.lag("lng").over(w).alias("lng1"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2")).filter("lat1 IS NOT NULL")
    ends = [F.col(c) for c in ("lat1", "lng1", "lat2", "lng2")]
    lat, lng = interpolate(*ends, F.lit(0.5))
    return before.select(*keys, metres(*ends).alias("m"), lat.alias("lat"), lng.alias("lng")).select(*keys, "m", cell_at(F.col("lat"), F.col("lng"), res).alias("cell"))


def territory(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_cells, area_km2, edge_cells): of sets of cells, those with a neighbour outside counted as edge.

    Neighbours are looked up by one anti join on (keys, cell); sums are made in each task before they are sent.
    """
    known = cells.select(*keys, "cell").distinct()
    around = known.select(*keys, "cell", F.explode(neighbours(F.col("cell"))).alias("other"))
    edge = around.join(known.withColumnRenamed("cell", "other"), [*keys, "other"], "left_anti").select(*keys, "cell").distinct()
    rows = known.select(*keys, F.lit(1).alias("n"), area_km2(F.col("cell")).alias("km2"), F.lit(0).alias("edge"))
    rows = rows.unionByName(edge.select(*keys, F.lit(0).alias("n"), F.lit(0.0).alias("km2"), F.lit(1).alias("edge")))
    return rows.groupBy(*keys).agg(F.sum("n").alias("n_cells"), F.sum("km2").alias("area_km2"), F.sum("edge").alias("edge_cells"))


def bridged(cells: DataFrame, *keys: str) -> DataFrame:
    """(keys, a, b): neighbouring pairs of a set of cells, each once, the smaller first."""
    known = cells.select(*keys, "cell").distinct()
    around = known.select(*keys, F.col("cell").alias("a"), F.explode(neighbours(F.col("cell"))).alias("b")).filter("b > a")
    return around.join(known.withColumnRenamed("cell", "b"), [*keys, "b"], "left_semi").select(*keys, "a", "b")


def near_of_runs(cells: DataFrame, k: int, *keys: str) -> DataFrame:
    """(keys, cell): cells within k steps of a run's and not among them.  Only the run's own cells are shuffled, one set a run."""

    @F.arrow_udf("array<bigint>")
    def around(own: pa.Array) -> pa.Array:
        flat, sizes = own.flatten().to_numpy().astype(np.int64), own.value_lengths().to_numpy()
        run, res = np.repeat(np.arange(len(own)), sizes), _resolutions(flat)
        out = [[np.zeros(0, np.int64)] for _ in range(len(own))]
        for r in np.unique(res):
            rows = np.flatnonzero(res == r)
            asked, which = np.unique(flat[rows], return_inverse=True)
            discs = _disc_lists(asked, k, int(r))
            for at, c in zip(run[rows].tolist(), which.ravel().tolist(), strict=True):
                out[at].append(discs[c])
        mine = np.split(flat, np.cumsum(sizes)[:-1])
        return pa.array([np.setdiff1d(np.concatenate(x), own) for x, own in zip(out, mine, strict=True)], pa.list_(pa.int64()))

    runs = cells.groupBy(*keys).agg(F.collect_set("cell").alias("own"))
    return runs.select(*keys, F.explode(around("own")).alias("cell"))
