"""Hexagon cells against known ids, searches step by step, and plain geometry: pentagons, edges of faces, the antimeridian, poles."""

import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.functions import hexgrid as h
from trailmill.operators import cells as c
from trailmill.operators import grid

#: Public ids: (lat, lng, resolution, id).
KNOWN = ((37.7752702151959, -122.418307270836, 9, 0x8928308280FFFFF), (40.689167, -74.044444, 10, 0x8A2A1072B59FFFF), (-48.876, -123.393, 11, 0x8BD36070D0A5FFF))
PENTAGONS = [4, 14, 24, 38, 49, 58, 63, 72, 83, 97, 107, 117]


def spread(n, seed=1):
    v = np.random.default_rng(seed).normal(size=(n, 3))
    return h.degrees(v / np.linalg.norm(v, axis=1, keepdims=True))


@pytest.fixture(scope="module")
def hard():
    """Places at pentagons, on edges of faces, at the poles and the antimeridian."""
    centre, first, second = h.faces()
    corner = h.on_sphere(np.array([2 + 0j] * 20), np.arange(20))
    edge = h.on_sphere(np.array([0.5 + 0.866j] * 20), np.arange(20))
    lat, lng = h.degrees(np.concatenate([corner, edge, centre]))
    more = [(90, 0), (-90, 0), (0, 180), (0, -180), (52.1, 179.9999), (-16.5, -179.9999), (0, 0)]
    return np.concatenate([lat, [p[0] for p in more]]), np.concatenate([lng, [p[1] for p in more]])


def test_known_ids():
    for lat, lng, res, cell in KNOWN:
        assert h.cells_of(np.array([lat]), np.array([lng]), res)[0] == cell


def test_base_cells():
    home, place, pentagon, *_ = h.base_cells()
    assert len(home) == 122 and np.flatnonzero(pentagon).tolist() == PENTAGONS


@pytest.mark.parametrize("res", [0, 1, 2, 3, 6, 9, 11, 15])
def test_a_point_lies_in_the_cell_with_the_nearest_centre(res, hard):
    lat, lng = (np.concatenate([a, b]) for a, b in zip(spread(20_000), hard, strict=True))
    cells = h.cells_of(lat, lng, res)
    clat, clng = h.centres_of(cells, res)
    assert (h.cells_of(clat, clng, res) == cells).all()
    radius = h.UNIT * 7 ** (-res / 2)
    v, w = (h.sphere(np.radians(a), np.radians(b)) for a, b in ((lat, lng), (clat, clng)))
    assert (np.linalg.norm(v - w, axis=1) < 0.62 * radius + 1e-12).all()
    if res:
        parents = np.unique(h.cells_of(clat, clng, res) & ~np.int64(7 << 3 * (15 - res)) | np.int64(7 << 3 * (15 - res)))
        assert len(parents) <= len(np.unique(cells))


def all_cells(res):
    cells = np.unique(h.cells_of(*spread(400_000, 5), res))
    assert len(cells) == 2 + 120 * 7**res
    return cells


@pytest.mark.parametrize("res", [0, 1, 2])
def test_the_whole_globe(res):
    cells = all_cells(res)
    near, there = h.neighbours_of(cells, res)
    around = {x: {y for y, k in zip(r, t, strict=True) if k} for x, r, t in zip(cells.tolist(), near.tolist(), there.tolist(), strict=True)}
    assert sorted(len(x) for x in around.values()) == [5] * 12 + [6] * (len(cells) - 12)
    assert all(a in around[b] for a in around for b in around[a]) and not any(a in around[a] for a in around)
    assert math.isclose(h.areas_of(cells, res).sum(), 4 * math.pi * h.EARTH_KM**2, rel_tol=1e-9)
    for k in (1, 2, 3):
        found = defaultdict(list)
        for o, x in zip(*(y.tolist() for y in h.discs_of(cells, k, res)), strict=True):
            found[int(cells[o])].append(x)
        for x in cells.tolist():
            reached = {x}
            for _ in range(k):
                reached |= {z for y in reached for z in around[y]}
            assert sorted(found[x]) == sorted(reached)


@pytest.mark.parametrize("res", [5, 8, 11])
def test_discs_of_hard_places_grow_by_steps(res, hard):
    cells = np.unique(h.cells_of(*hard, res))
    owner, disc = h.discs_of(cells, 4, res)
    for o, cell in enumerate(cells.tolist()):
        reached = np.array([cell])
        for _ in range(4):
            near, there = h.neighbours_of(reached, res)
            reached = np.unique(np.concatenate([reached, near[there]]))
        assert sorted(disc[owner == o].tolist()) == reached.tolist()


def test_columns(spark, hard):
    rows = [(k, float(a), float(b)) for k, (a, b) in enumerate(zip(*hard, strict=True))] + [(900, None, 1.0), (901, float("nan"), 1.0), (902, 1.0, float("inf"))]
    df = spark.createDataFrame(rows, "k int, lat double, lng double").repartition(3)
    mixed = df.withColumn("cell", F.when(F.col("k") % 2 == 0, c.cell_at(F.col("lat"), F.col("lng"), 11)).otherwise(c.cell_at(F.col("lat"), F.col("lng"), 4)))
    out = mixed.select("k", "cell", c.centre(F.col("cell")).alias("at"), c.area_km2(F.col("cell")).alias("km2"), c.neighbours(F.col("cell")).alias("near")).collect()
    for r in out:
        if r["k"] >= 900:
            assert r["cell"] is None and r["at"] is None and r["km2"] is None and r["near"] is None
            continue
        res, want = (11, 4)[r["k"] % 2], rows[r["k"]]
        assert r["cell"] == h.cells_of(np.array([want[1]]), np.array([want[2]]), res)[0] and len(r["near"]) in (5, 6)
        assert h.cells_of(np.array([r["at"]["lat"]]), np.array([r["at"]["lng"]]), res)[0] == r["cell"]
        assert 0.5e-3 < r["km2"] < 3e-3 if res == 11 else 800 < r["km2"] < 2600


def test_parents(spark):
    lat, lng = spread(500, 7)
    fine = h.cells_of(lat, lng, 11)
    df = spark.createDataFrame([(int(x),) for x in fine], "cell long")
    found = [r["p"] for r in df.select(grid.parent(F.col("cell"), 7).alias("p")).collect()]
    # Cutting digits off a cell's id is the cell of that resolution around the centre child's centre.
    centre_child = np.array(found) & ~np.int64((15 << 52) | ((1 << 24) - 1)) | np.int64(11 << 52) | np.int64((1 << 12) - 1)
    assert h.cells_of(*h.centres_of(centre_child, 11), 7).tolist() == found


def walked(spark, walks):
    rows = [(w, p, s, float(a), float(b)) for w, parts in walks.items() for p, line in enumerate(parts) for s, (a, b) in enumerate(line)]
    return spark.createDataFrame(rows, "user_id int, part int, seq int, lat double, lng double")


def revealed_by_brute(parts, res=11, radius=65.0):
    """Every cell of a fine raster around each edge, measured against all edges."""
    edges = [(*a, *b) for line in parts for a, b in zip(line, line[1:] or line, strict=False)]
    found = set()
    for e in edges:
        lats, lngs = np.linspace(0, 1, 60), np.linspace(-0.0015, 0.0015, 25)
        flat = max(0.001, math.cos(math.radians(e[0])))
        east = (e[3] - e[1] + 180) % 360 - 180
        lat = (e[0] + (e[2] - e[0]) * lats)[:, None, None] + lngs[None, :, None] + 0 * lngs
        lng = (e[1] + east * lats)[:, None, None] + lngs[None, None, :] / flat + 0 * lngs[None, :, None]
        cells = np.unique(h.cells_of(np.clip(lat.ravel(), -90, 90), lng.ravel(), res))
        clat, clng = h.centres_of(cells, res)
        for other in edges:
            found |= set(cells[c._from_segment(clat, clng, *other) <= radius].tolist())
    return found


def test_corridor(spark):
    corner = h.degrees(h.on_sphere(np.array([2 + 0j]), np.array([4])))
    at = (float(corner[0][0]), float(corner[1][0]))
    walks = {
        1: [[(48.0, 11.0), (48.001, 11.002), (48.004, 11.002)], [(48.01, 11.01)]],
        2: [[(at[0] - 0.002, at[1] - 0.001), (at[0] + 0.001, at[1] + 0.003), (at[0], at[1])]],  # around a pentagon
        3: [[(52.0, 179.999), (52.0005, -179.999), (52.001, 179.9985)]],  # over the antimeridian
        4: [[(48.0, 11.0), (48.0, 11.0), (48.0, 11.0005)]],  # a repeated place
        5: [[(0.0, 0.0), (0.0, 0.01)]],  # a long gap between two samples
    }
    found = defaultdict(set)
    for r in c.corridor(walked(spark, walks).repartition(3), "user_id").collect():
        assert r["cell"] not in found[r["user_id"]]
        found[r["user_id"]].add(r["cell"])
    for w, parts in walks.items():
        assert found[w] == revealed_by_brute(parts), w


def test_corridor_of_one_point_and_of_none(spark):
    empty = spark.createDataFrame([(1, 0, 0, float("nan"), 1.0), (1, 0, 1, None, 1.0)], "user_id int, part int, seq int, lat double, lng double")
    assert c.corridor(empty, "user_id").count() == 0
    one = {r["cell"] for r in c.corridor(walked(spark, {1: [[(-48.876, -123.393)]]}), "user_id").collect()}
    assert KNOWN[2][3] in one and one == revealed_by_brute([[(-48.876, -123.393)]]) and 5 <= len(one) <= 9


def test_long_edges_are_worked_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(c, "DENSE", 50)
    edges = np.array([[10.0, 10.0, 10.0, 10.02], [10.0, 10.0, 10.001, 10.0], [10.0, 10.02, 10.0, 10.0]])
    by_edge = defaultdict(set)
    for e, x in c._revealed(edges, 65.0, 11, 12.0):
        for k, v in zip(e.tolist(), x.tolist(), strict=True):
            by_edge[k].add(v)
    assert by_edge[0] == by_edge[2] == revealed_by_brute([[(10.0, 10.0), (10.0, 10.02)]])


def test_territory_bridges_and_near(spark):
    lat, lng = np.array([48.0, 48.0, -16.5]), np.array([11.0, 11.05, 180.0])
    middle = h.cells_of(lat, lng, 11)
    sets = {1: {int(x) for x in h.discs_of(middle[:1], 2, 11)[1]} | {int(middle[1])}, 2: {int(x) for x in h.discs_of(middle[2:], 1, 11)[1]}}
    df = spark.createDataFrame([(u, x) for u, s in sets.items() for x in [*s, *s]], "user_id int, cell long").repartition(3)
    around = lambda x: set(h.neighbours_of(np.array([x]), 11)[0][0].tolist())
    found = {r["user_id"]: r for r in c.territory(df, "user_id").collect()}
    for u, s in sets.items():
        assert found[u]["n_cells"] == len(s) and found[u]["edge_cells"] == sum(not around(x) <= s for x in s)
        assert math.isclose(found[u]["area_km2"], h.areas_of(np.array(sorted(s)), 11).sum())
    pairs = {(r["user_id"], r["a"], r["b"]) for r in c.bridged(df, "user_id").collect()}
    assert pairs == {(u, x, y) for u, s in sets.items() for x in s for y in around(x) if y in s and x < y}
    near = defaultdict(set)
    for r in c.near_of_runs(df, 3, "user_id").collect():
        near[r["user_id"]].add(r["cell"])
    assert near == {u: {int(x) for x in h.discs_of(np.array(sorted(s)), 3, 11)[1]} - s for u, s in sets.items()}
    assert c.territory(df.limit(0), "user_id").count() == 0
