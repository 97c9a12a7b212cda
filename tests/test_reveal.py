"""Samples, reveal order and nearby walks against plain Python: figures of eight, long edges, the antimeridian, poles."""

import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from trailmill.functions.geo import EARTH_M
from trailmill.operators import reveal as r


def frame(spark, walks):
    rows = [(w, p, s, float(a), float(b)) for w, parts in walks.items() for p, line in enumerate(parts) for s, (a, b) in enumerate(line)]
    return spark.createDataFrame(rows, "user_id int, part int, seq int, lat double, lng double").repartition(3)


def haversine(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * EARTH_M * math.asin(min(1, math.sqrt(h)))


EIGHT = [(48.0 + 0.002 * math.sin(2 * t / 40 * math.pi), 11.0 + 0.004 * math.sin(t / 40 * math.pi)) for t in range(81)]
WALKS = {
    1: [EIGHT],
    2: [[(48.0, 11.0), (48.0, 11.0004), (48.0003, 11.0004)], [(48.01, 11.0)], [(48.02, 11.0), (48.0201, 11.0)]],
    3: [[(48.0, 11.0), (48.0, 11.01), (48.0, 11.0), (48.0, 11.01)]],  # there and back again
    4: [[(48.0, 11.0), (48.0, 11.0)]],  # no way at all
}


def carried(parts, step):
    """[(part, metres, lat, lng)]: a counter that runs on over vertices."""
    out, walked = [], 0.0
    for p, line in enumerate(parts):
        if len(line) < 2:
            continue
        out.append((p, walked, *line[0]))
        carry = 0.0
        for a, b in zip(line, line[1:], strict=False):
            span = haversine(a, b)
            along = step - carry
            while span > 0 and along < span:
                out.append((p, walked + along, *(x + (y - x) * along / span for x, y in zip(a, b, strict=True))))
                along += step
            carry = (carry + span) % step
            walked += span
        out.append((p, walked, *line[-1]))
    return out, walked


@pytest.mark.parametrize("step", [7.0, 30.0, 5000.0])
def test_samples_carry_over_vertices(spark, step):
    found = defaultdict(list)
    for x in r.carried_samples(frame(spark, WALKS), step, "user_id").collect():
        found[x["user_id"]].append((x["part"], x["at_m"], x["lat"], x["lng"], x["arc"]))
    for w, parts in WALKS.items():
        want, total = carried(parts, step)
        got = sorted(found[w])
        assert len(got) == len(want)
        for g, x in zip(got, sorted(want), strict=True):
            assert g[0] == x[0] and all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6) for a, b in zip(g[1:4], x[1:], strict=True))
            assert math.isclose(g[4], x[1] / total if total else 0, abs_tol=1e-9)


def revealed(parts, cells, step=5.0, radius=65.0):
    lines = [line for line in parts if len(line) > 1]
    kx = 111_320 * math.cos(math.radians(lines[0][0][0]))
    samples, walked = [], 0.0
    for line in lines:
        flat = [(b * kx, a * 110_540) for a, b in line]
        samples.append((*flat[0], walked))
        for (px, py), (x, y) in zip(flat, flat[1:], strict=False):
            span = math.hypot(x - px, y - py)
            n = max(1, math.ceil(span / step))
            samples += [(px + (x - px) * k / n, py + (y - py) * k / n, walked + span * k / n) for k in range(1, n + 1)]
            walked += span
    out = {}
    for cell, lat, lng in cells:
        d = [round((x - lng * kx) ** 2 + (y - lat * 110_540) ** 2, 4) for x, y, _ in samples]
        near = [k for k, v in enumerate(d) if v <= radius * radius]
        if near:
            end = next((k for k in range(near[0], len(d)) if d[k] > radius * radius), len(d))
            at = min(range(near[0], end), key=lambda k: (d[k], k))
        else:
            at = min(range(len(d)), key=lambda k: (d[k], k))
        out[cell] = samples[at][2] / walked if walked else 0.0
    return out


def test_reveal_order_takes_the_first_pass(spark):
    grid = [(10 * i + j, 47.997 + 0.0006 * i, 10.994 + 0.0013 * j) for i in range(10) for j in range(10)]
    cells = [(w, *c) for w in WALKS for c in grid]
    df = spark.createDataFrame(cells, "user_id int, cell long, lat double, lng double").repartition(2)
    found = defaultdict(dict)
    for x in r.reveal_order(frame(spark, WALKS), df, "user_id").collect():
        assert x["cell"] not in found[x["user_id"]]
        found[x["user_id"]][x["cell"]] = x["arc"]
    for w, parts in WALKS.items():
        want = revealed(parts, grid)
        assert found[w].keys() == want.keys() and all(math.isclose(found[w][k], v, abs_tol=1e-9) for k, v in want.items()), w
    # The crossing of the eight is met at its start, not on the way back.
    assert found[1][min(grid, key=lambda g: math.hypot(g[1] - 48.0, g[2] - 11.0))[0]] < 0.1


def distance(place, a, b):
    scale, k = EARTH_M * math.pi / 180, math.cos(math.radians(place[0]))
    east = lambda d: ((d + 180) % 360 - 180) * k * scale
    ax, ay, dx, dy = east(a[1] - place[1]), (a[0] - place[0]) * scale, east(b[1] - a[1]), (b[0] - a[0]) * scale
    length = dx * dx + dy * dy
    t = 0 if length == 0 else max(0, min(1, -(ax * dx + ay * dy) / length))
    return math.hypot(ax + t * dx, ay + t * dy)


def test_walks_near_places(spark):
    walks = {
        1: [EIGHT], 2: [[(48.0, 11.0), (48.0, 14.0)]], 3: [[(-17.0, 179.9), (-17.0, -179.9)]], 4: [[(10.0, 10.0)]],
        5: [[(60.0, -170.0), (60.0, 20.0)]], 6: [[(89.9995, 0.0), (89.9995, 90.0)]], 7: [[(0.0, 179.9999), (0.001, 180.0)]],
    }
    places = [
        (48.0, 11.0), (48.0005, 12.5), (48.01, 12.5), (-17.0, 180.0), (-17.0005, -179.95), (-17.0005, 179.95), (-17.0, 179.8), (10.0005, 10.0005), (10.01, 10.0), (60.0003, 0.0), (60.0, 100.0),
        (89.9995, 45.0), (89.9996, -135.0), (0.0005, -179.9999), (0.0, 0.0), (-90.0, 0.0), (90.0, 0.0),
    ]
    edges = r.edges_of(frame(spark, walks), "user_id")
    asked = spark.createDataFrame([(k, *map(float, p)) for k, p in enumerate(places)], "k int, lat double, lng double").repartition(2)
    out = r.walks_near(asked, edges, 120.0, ["k"], "user_id")
    found = {(x["k"], x["user_id"]): x["m"] for x in out.collect()}
    want = {}
    for k, p in enumerate(places):
        for w, parts in walks.items():
            m = min(distance(p, a, b) for line in parts for a, b in (list(zip(line, line[1:], strict=False)) or [(line[0], line[0])]))
            if m <= 120:
                want[k, w] = m
    assert {x: round(m, 6) for x, m in found.items()} == {x: round(m, 6) for x, m in want.items()}
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_an_edge_lies_under_few_tiles(spark):
    walks = {1: [EIGHT], 2: [[(48.0, 11.0), (48.0, 14.0)]], 3: [[(-17.0, 179.9), (-17.0, -179.9)]], 5: [[(60.0, -170.0), (60.0, 20.0)]]}
    most = r.covered(r.edges_of(frame(spark, walks), "user_id"), 120.0).groupBy("lat1", "lng1", "lat2", "lng2").agg(F.count("*").alias("n")).agg(F.max("n").alias("n")).first()["n"]
    assert most <= 4


def test_no_walks(spark):
    none = frame(spark, WALKS).limit(0)
    cells = spark.createDataFrame([(1, 5, 48.0, 11.0)], "user_id int, cell long, lat double, lng double")
    assert r.carried_samples(none, 5.0, "user_id").count() == r.reveal_order(none, cells, "user_id").count() == 0
    assert r.walks_near(cells.withColumnRenamed("cell", "k"), r.edges_of(none, "user_id").withColumnRenamed("user_id", "walk"), 9.0, ["k"], "walk").count() == 0
