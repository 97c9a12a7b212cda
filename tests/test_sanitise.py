"""The gate against a plain fold, in batches of any size, and refusals one by one."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from trailmill.functions.geo import EARTH_M
from trailmill.operators import intake, sanitise


def speed(a, b):
    h = math.sin(math.radians(b[0] - a[0]) / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    m, s = 2 * EARTH_M * math.asin(min(1, math.sqrt(h))), (b[2] - a[2]) / 1000
    return m / s if s > 0 else math.inf if m > 0 else 0.0


def folded(points, gate):
    """[(kept, broke)] point by point."""
    first = 1 if len(points) > 2 and speed(points[0], points[1]) > gate >= speed(points[1], points[2]) else 0
    out, last, open_ = [(False, False)] * first, None, False
    for p in points[first:]:
        ok = last is None or speed(last, p) <= gate
        out.append((ok, ok and open_))
        last, open_ = (p, False) if ok else (last, True)
    return out


def walks():
    rng, out = random.Random(4), {}
    for w in range(60):
        n, at, t = rng.choice((1, 2, 3, 4, 7, 40, 200)), [40.0, 10.0], 0
        points = []
        for _ in range(n):
            t += rng.choice((0, 1000, 1000, 5000, 60_000))
            at = [at[0] + rng.uniform(-2e-5, 2e-5), at[1] + rng.uniform(-2e-5, 2e-5)]
            leap = rng.random() < (0.05, 0.4, 0.9)[w % 3]
            points.append((at[0] + (rng.uniform(-0.05, 0.05) if leap else 0), at[1], t))
        out[w] = points
    return out


@pytest.mark.parametrize("batch", [1, 2, 3, 7, 10_000])
def test_gate_in_batches_of_any_size(spark, batch):
    given = walks()
    rows = [(w, f"id{w}", "run" if w % 2 else "ride", k, p[2], p[0], p[1]) for w, points in given.items() for k, p in enumerate(points)]
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(batch))
    try:
        df = spark.createDataFrame(rows, "user_id int, external_id string, kind string, seq int, t_ms long, lat double, lng double").repartition(3)
        found = {(r["user_id"], r["seq"]): (r["kept"], r["broke"]) for r in sanitise.accepted(df, "user_id", "external_id").collect()}
    finally:
        spark.conf.set(key, before)
    assert found == {(w, k): x for w, points in given.items() for k, x in enumerate(folded(points, 12.5 if w % 2 else 30.0))}


def envelope(**changes):
    detail = {"id": 5, "sport_type": "Run", "start_date": "2024-01-01T00:00:00Z", "start_date_local": "2024-01-01T01:00:00Z", "timezone": "(GMT+01:00) Europe/Paris"}
    streams = {"latlng": {"data": [[1.0, 2.0], [1.00001, 2.0], [1.00002, 2.0]]}, "time": {"data": [0, 2, 4]}, "altitude": {"data": [1.0, None, 3.0]}}
    for k, v in changes.items():
        (streams if k in ("latlng", "time", "altitude", "distance") else detail)[k] = v
    return json.dumps({"schemaVersion": 1, "source": "watch", "detail": detail, "streams": changes.get("streams", streams)})


REFUSED = {
    None: [envelope(), envelope(streams=None), envelope(streams={}), envelope(timezone=None), envelope(start_date_local=None), envelope(latlng={"data": []}, time={"data": []}, altitude={"data": []})],
    "no envelope": ["", "{", "[]", '{"schemaVersion": 2}', None],
    "no id": [envelope(id=None)],
    "no start": [envelope(start_date="soon"), envelope(start_date=None)],
    "no local time": [envelope(start_date_local="2024-01-01T01:00"), envelope(start_date_local="2024-13-01T01:00:00Z")],
    "unknown zone": [envelope(timezone="(GMT+01:00) Europe/Nowhere")],
    "streams of unequal length": [envelope(time={"data": [0, 2]}), envelope(distance={"data": [1.0]}), envelope(altitude={})],
    "no place": [envelope(latlng={"data": [[1.0, 2.0], [1.0], [1.0, 2.0]]}), envelope(latlng={"data": [[1.0, 2.0], None, [1.0, 2.0]]})],
    "no time of a point": [envelope(time={"data": [0, None, 4]})],
    "no time stream": [envelope(time=None)],
    "too few points": [envelope(time={"data": [0, 40, 80]})],
}


def test_refusals_name_the_first_fault_and_end_no_job(spark):
    rows = [(k, reason, raw) for k, (reason, raw) in enumerate((r, x) for r, raws in REFUSED.items() for x in raws)]
    df = spark.createDataFrame([(k, raw) for k, _, raw in rows], "user_id int, raw string").repartition(3)
    judged = sanitise.refusals(intake.read_envelopes(df))
    points = sanitise.flagged_points(judged).cache()
    found = {r["user_id"]: r for r in sanitise.sanitised_activities(judged, points).collect()}
    assert {k: found[k]["bad"] for k, *_ in rows} == {k: reason for k, reason, _ in rows}
    assert found[0]["n_points"] == 3 and found[0]["rejected"] == 0 and found[1]["n_points"] is None
    traced = {r["user_id"] for r in sanitise.sanitised_points(points).select("user_id").distinct().collect()}
    assert traced == {k for k, reason, raw in rows if reason is None and found[k]["n_points"]}
    read = {r["user_id"]: r["started_local"] for r in intake.normalise(intake.read_envelopes(df)).collect()}
    assert read[0].hour == 1 and None in read.values()


def test_a_manual_entry_of_an_unknown_zone_is_refused(spark):
    entry = json.dumps({"idempotencyKey": "a", "exerciseId": "x", "occurredAt": "2024-01-01T00:00:00Z", "timezone": "Mars/Base", "sets": [{"reps": 1}]})
    (r,) = intake.read_entries(spark.createDataFrame([(1, entry)], "user_id int, raw string")).collect()
    assert r["bad"] == "unknown zone" and r["started_local"] is None


def test_no_envelopes(spark):
    judged = sanitise.refusals(intake.read_envelopes(spark.createDataFrame([], "user_id int, raw string")))
    assert sanitise.sanitised_activities(judged, sanitise.flagged_points(judged)).select(F.col("bad")).count() == 0


def test_envelopes_are_judged_whole_and_read_once(spark):
    """Walks of 1 to 700 points, with and without times, gated side by side and alone, as by the plain fold; no shuffle of points, texts read once."""
    rng, given = random.Random(7), walks() | {90: [], 91: [(40.0 + k * 1e-6, 10.0, k * 1000) for k in range(700)]}
    given |= {100 + k: [(40 + rng.uniform(-0.05, 0.05) * (rng.random() < 0.3), 10.0, s * 1000) for s in range(n)] for k, n in enumerate((2, 3, 256, 257, 700))}
    given = {w: [(*p[:2], p[2] - points[0][2]) for p in points] for w, points in given.items()}
    rows, expected, flags = [], {}, {}
    for w, points in given.items():
        timed, sport = w % 5 > 0, ("Run", "Ride")[w % 2]
        points = [(*p[:2], p[2] if timed else k * 1000) for k, p in enumerate(points)]
        streams = {"latlng": {"data": [p[:2] for p in points]}} | ({"time": {"data": [p[2] // 1000 for p in points]}} if timed else {})
        streams["altitude"] = {"data": [None if k % 3 else float(k) for k in range(len(points))]}
        rows.append((w, envelope(id=w, sport_type=sport, streams=streams)))
        done = folded(points, (12.5, 30.0)[w % 2])
        flags |= {(w, k): (*f, None if k % 3 else float(k)) for k, f in enumerate(done)}
        at = [p for p, (kept, _) in zip(points, done, strict=True) if kept]
        cuts = [b or g > 30_000 for b, g in zip([b for kept, b in done if kept][1:], (y[2] - x[2] for x, y in zip(at, at[1:], strict=False)), strict=False)]
        expected[w] = (len(at), len(points) - len(at), sum(b for _, b in done), sum(cuts) + 1, min(p[1] for p in at), max(p[0] for p in at)) if at else (None,) * 6
    rows.append((200, envelope(start_date="soon")))
    judged = sanitise.refusals(intake.read_envelopes(spark.createDataFrame(rows, "user_id int, raw string").repartition(2)))
    out, points = sanitise.activities(judged), sanitise.flagged_points(judged)
    found = {r["user_id"]: r for r in out.collect()}
    assert found.pop(200)["bad"] == "no start" and found.keys() == expected.keys()
    assert {w: tuple(r[c] for c in ("n_points", "rejected", "breaks", "segments", "west", "north")) for w, r in found.items()} == expected
    assert {(r["user_id"], r["seq"]): (r["kept"], r["broke"], r["altitude"]) for r in points.collect()} == flags
    assert sorted(map(repr, out.collect())) == sorted(map(repr, sanitise.sanitised_activities(judged, points).collect()))
    kept = {(r["user_id"], r["seq"]): r["segment"] for r in points.filter("kept").collect()}
    split = sanitise.split_gaps(points.filter("kept").drop("segment"), *sanitise.KEYS)
    assert kept == {(r["user_id"], r["seq"]): r["segment"] for r in split.collect()}
    for df in (out, sanitise.sanitised_points(points)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "Join" not in plan and "Window" not in plan


def test_envelopes_are_dealt_by_their_number(spark, monkeypatch):
    from trailmill.plans import sanitised

    monkeypatch.setattr(sanitised, "TASK_ENVELOPES", 100)
    for query in (sanitised.sanitised_activities, sanitised.sanitised_parts):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "RepartitionByExpression [o_orderkey" in plan and ", 15" in plan and plan.count("from_json") <= 2 * plan.count("MapInArrow")


def test_points_of_many_walks_are_dealt_by_their_number(spark, monkeypatch):
    from trailmill.plans import sanitised

    small = "/root/testdata/sf0.001"
    before = sorted(map(repr, sanitised.sanitised_parts(spark, small).collect()))
    monkeypatch.setattr(sanitised, "TASK_WALKS", 100)
    out = sanitised.sanitised_parts(spark, small)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression [user_id") == 3
    assert sorted(map(repr, out.collect())) == before
