"""Places, routes and views against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmill.operators import places, routes, views
from trailmill.plans import places as plans

SMALL = "/root/testdata/sf0.001"


def off_line(p, a, b):
    (px, py), (ax, ay), (bx, by) = p, a, b
    dx, dy = bx - ax, by - ay
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((px - ax) * dx + (py - ay) * dy) / n)) if n else 0.0
    return math.hypot(px - ax - t * dx, py - ay - t * dy)


def simpler(spots, tolerance):
    if len(spots) < 3:
        return list(spots)
    far, i = max((off_line(p, spots[0], spots[-1]), -i) for i, p in enumerate(spots[1:-1], 1))
    return [spots[0], spots[-1]] if far <= tolerance else simpler(spots[: 1 - i], tolerance)[:-1] + simpler(spots[-i:], tolerance)


def test_simplified_lines_like_recursion(spark):
    from trailmill.operators import trace
    from trailmill.sources.tables import points

    rows = trace.split_gaps(points(spark, SMALL), 30 * plans.HOUR_MS).select("user_id", "segment", "seq", "lat", "lng").collect()
    parts = {}
    for r in sorted(rows, key=lambda r: r["seq"]):
        parts.setdefault((r["user_id"], r["segment"]), []).append(r)
    scale, expected = 6_371_008.8 * math.pi / 180, set()
    for key, part in parts.items():
        at = {(r["lng"] * scale * math.cos(math.radians(part[0]["lat"])), r["lat"] * scale, r["seq"]): r["seq"] for r in part}
        line = [(x, y) for x, y, _ in at]
        stays = simpler([(x, y) for x, y in line], 2_000.0)
        k = 0
        for (x, y), seq in zip(line, at.values(), strict=True):
            if k < len(stays) and stays[k] == (x, y):
                expected.add((*key, seq))
                k += 1
    found = {(r["user_id"], r["segment"], r["seq"]) for r in plans.walk_simplified(spark, SMALL).collect()}
    assert found and len(found) < len(rows) and abs(len(found) - len(expected)) <= 0.01 * len(rows)
    assert len(found & expected) >= 0.97 * len(expected)  # vertices at one place or equally far: either may stay


def test_simplified_corner():
    x, y = np.array([0.0, 1, 2, 2, 2, 9]), np.array([0.0, 0, 0, 5, 9, 9])
    assert routes.kept_of(x, y, 0.5).tolist() == [True, False, True, False, True, True]
    assert routes.kept_of(x[:1], y[:1], 1).tolist() == [True] and routes.kept_of(np.zeros(4), np.zeros(4), 1).tolist() == [True, False, False, True]


def test_median_place(spark):
    """A wild spot does not pull it as it pulls the mean; equal spots are their own median."""
    rng = random.Random(3)
    spots = [(rng.gauss(0, 1e-4), rng.gauss(0, 1e-4)) for _ in range(20)] + [(5.0, 5.0)]
    rows = [(0, [{"x": x, "y": y} for x, y in spots]), (1, [{"x": 2.0, "y": 3.0}] * 4)]
    out = {r["k"]: (r["m"]["x"], r["m"]["y"]) for r in spark.createDataFrame(rows, "k int, s array<struct<x:double,y:double>>").select("k", routes.median_place(F.col("s")).alias("m")).collect()}
    assert max(map(abs, out[0])) < 1e-3 and out[1] == (2.0, 3.0)


def test_regions_over_the_antimeridian_and_the_pole(spark):
    rows = [(1, 10, 0.0, 179.9), (1, 11, 0.0, -179.9), (1, 12, 0.3, -179.6), (1, 13, 89.9, 0.0), (1, 14, 89.9, 180.0), (1, 15, 10.0, 10.0), (2, 9, 0.0, 179.9), (1, 16, 10.0, 10.0)]
    starts = spark.createDataFrame(rows, "user_id long, activity_id long, lat double, lng double").withColumn("started_at", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))
    assert {(r["user_id"], r["region"], r["n"]) for r in places.regions(starts).collect()} == {(1, 10, 3), (1, 13, 2), (1, 15, 2), (2, 9, 1)}
    assert places.regions(starts.limit(0)).count() == 0


def test_nearest_name_over_the_antimeridian_and_at_equal_distance(spark):
    asked = spark.createDataFrame([(1, 0.0, 179.999), (2, 50.0, 8.0), (3, 20.0, 20.0)], "k int, lat double, lng double")
    known = spark.createDataFrame([("b", 50.01, 8.0), ("a", 49.99, 8.0), ("far", 50.2, 8.0), ("over", 0.0, 180.0)], "name string, lat double, lng double")
    assert {r["k"]: r["name"] for r in places.nearest_named(asked, known, 2500.0, 9, "k").collect()} == {1: "over", 2: "a"}


def test_ground_without_class_is_an_error(spark):
    steps = spark.createDataFrame([(1, 5.0, 7), (1, 0.0, 9)], "user_id long, m double, cell long")
    ground = spark.createDataFrame([(1, 7, "new")], "user_id long, cell long, class string")
    assert places.ground_split(steps, ground, "user_id").first().asDict() == {"user_id": 1, "new_m": 5.0, "rearmed_m": 0.0, "recent_m": 0.0}
    with pytest.raises(Exception, match="no class of ground for cell 7"):
        places.ground_split(steps, ground.filter("cell = 8"), "user_id").collect()


def test_numbers_and_keys(spark):
    given = {35.0: "35", 0.05: "0.05", -12.345678: "-12.345678", 0.00001: "0.00001", 100.0: "100", -0.0: "0"}
    df = spark.createDataFrame([(x,) for x in given], "x double")
    assert [r["s"] for r in df.select(views.canonical_number(F.col("x")).alias("s")).collect()] == list(given.values())
    tenths = {12.45: "12.4", 12.35: "12.3", 12.25: "12.3", 0.05: "0.1", 7.96: "8.0", 0.0: "0.0", 99.951: "100.0"}
    df = spark.createDataFrame([(x,) for x in tenths], "x double")
    assert [r["s"] for r in df.select(places.tenths(F.col("x")).alias("s")).collect()] == list(tenths.values())
    keys = spark.createDataFrame([("a#1#x#v3", "a#1#y#v3", "a#12#x#v3")], "a string, b string, c string")
    assert tuple(keys.select(views.same_activity(F.col("a"), F.col("b")), views.same_activity(F.col("a"), F.col("c"))).first()) == (True, False)


def test_track_file_with_gaps(spark):
    xml = '<gpx><trk><trkseg><trkpt lat="1.5" lon="2"><ele>7</ele><time>2024-01-01T00:00:01Z</time></trkpt><trkpt lat="3"/></trkseg><trkseg/><trkseg><trkpt lat="4" lon="5"/></trkseg></trk></gpx>'
    rows = routes.read_tracks(spark.createDataFrame([(1, xml), (2, None), (3, "<gpx/>")], "k int, xml string"), "k").collect()
    assert [(r["k"], r["seq"], r["t_ms"], r["lat"], r["lng"], r["altitude"]) for r in rows] == [(1, 0, 1704067201000, 1.5, 2.0, 7.0), (1, 0, None, 4.0, 5.0, None)]
