"""What only larger tables or awkward orders of rows bring out."""

import datetime as dt
import itertools
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmill.functions import text
from trailmill.operators import chronicle, dedupe, grid, places, rearm, reveal, routes, scoring, trace
from trailmill.plans.registry import QUERIES
from trailmill.sources import tables


def test_feeds_do_not_depend_on_the_order_of_rows(spark):
    """5000 XP at 0.3333 are 1666.5, which goes up, however the four feeders are dealt."""
    at = dt.datetime(2024, 1, 1)
    orders = list(itertools.permutations((150, 1320, 2900, 630)))
    rows = [(i, 1, at, f"s{xp}", "distance", float(xp), float(xp), 1.0, "distanceKm", 0, "c") for i, xps in enumerate(orders) for xp in xps]
    kind = "activity_id long, user_id long, started_at timestamp_ntz, skill string, reason string, units double, units_effective double, xp_per_unit double, measure string, pos int, feeds string"
    rules = spark.createDataFrame([("c", 1, True, 1.0, None, None)], "skill string, display_order int, enabled boolean, xp_per_unit double, cells_new double, cells_rearmed double")
    awards = spark.createDataFrame([(i, 0, 0) for i in range(len(orders))], "activity_id long, new_cells long, rearmed_cells long")
    out = scoring.ledger_rows(spark.createDataFrame(rows, kind).coalesce(1), awards, rules).filter("reason = 'constitution_share'")
    assert [(r["units"], r["units_effective"], r["xp"]) for r in out.collect()] == [(5000.0, 1666.5, 1667)] * len(orders)


def test_clock_of_a_thousand_hours(spark):
    n = [0, 59, 3599, 3600, 3_599_999, 3_600_000, 9_000_000, 10**12]
    df = spark.createDataFrame([(x,) for x in n], "n long").select("n", text.seconds_of(text.clock(F.col("n"))).alias("s"))
    assert {r["n"]: r["s"] for r in df.collect()} == {x: x for x in n}


def test_facts_of_the_trailing_year(spark):
    """Edges of the year, shared instants, years before 1970 and runs without a distance; and no frame that slides over a year."""
    rnd, year = random.Random(3), dt.timedelta(days=365)
    start = dt.datetime(1968, 5, 1)
    at = [start + dt.timedelta(days=rnd.randrange(1500)) for _ in range(150)]
    at += [t + year for t in at[:40]] + [t + year + dt.timedelta(microseconds=1) for t in at[40:60]] + at[60:80]
    rows = [(i % 2, i, t, rnd.randrange(3), rnd.choice([None, 0.0, float(rnd.randrange(1, 40))])) for i, t in enumerate(at)]
    df = chronicle.facts(spark.createDataFrame(rows, "user_id long, activity_id long, started_at timestamp_ntz, new_cells long, distance_m double"))
    for r in df.collect():
        own = next(x for x in rows if x[1] == r["activity_id"])
        earlier = [x for x in rows if x[0] == own[0] and (x[2], x[1]) < (own[2], own[1])]
        roads = [x for x in earlier if x[4]]
        recent = [x[4] for x in roads if x[2] >= own[2] - year]
        road = own[4] or None
        best = lambda least, m: int(road is not None and len(m) >= least and max(m) < road)
        assert r["cells_before"] == sum(x[3] for x in earlier)
        assert r["road_count"] == (len(roads) + 1 if road else None)
        assert r["longest_in_year"] == best(8, recent) and r["longest_ever"] == best(20, [x[4] for x in roads])
    assert df.count() == len(rows)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, -" not in plan and "RangeFrame" in plan


def test_rearm_needs_no_row_for_a_near_cell(spark, monkeypatch):
    """Against a plain search, with shared instants, a year's gap and batches of three rows; no plan may explode the near cells."""
    monkeypatch.setattr(rearm, "CELLS", 4)
    rnd, day = random.Random(5), dt.timedelta(days=1)
    start = dt.datetime(1969, 6, 1)
    runs = [(i % 2, i, start + rnd.randrange(400) * day, rnd.sample(range(300), rnd.randrange(1, 4))) for i in range(120)]
    runs += [(0, 200 + i, start + (365 + (i // 3) * 60) * day, rnd.sample(range(300), 2)) for i in range(12)]
    discs = lambda cells: grid.discs_of(cells, 4)
    expected = set()
    for user, run, at, own in runs:
        near = set(discs(np.array(own))[1].tolist()) - set(own)
        seen = {c: max((t for u, _, t, cells in runs if u == user and c in cells and t <= at), default=None) for c in near}
        waiting = [(t, c) for c, t in seen.items() if t is not None and t + 183 * day >= at + day]
        if waiting:
            expected.add((user, run, min(waiting)[1], min(waiting)[0] + 183 * day))
    visits = spark.createDataFrame([(u, i, t, c) for u, i, t, own in runs for c in own], "user_id long, activity_id long, started_at timestamp_ntz, cell long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        df = rearm.first_to_rearm(visits, discs)
        assert {tuple(r) for r in df.collect()} == expected and len(expected) > 60
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "array_except" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_exploded_places_are_not_broadcast(spark):
    places = spark.createDataFrame([(1, 50.0, 8.0)], "c_custkey long, lat double, lng double")
    edges = spark.createDataFrame([(7, 0, 50.0, 8.0, 50.0, 8.0001)], "user_id long, segment long, lat1 double, lng1 double, lat2 double, lng2 double")
    df = reveal.walks_near(places, edges, 150.0, ["c_custkey"], "user_id", "segment")
    assert [(r["c_custkey"], r["user_id"], r["m"]) for r in df.collect()] == [(1, 7, 0.0)]
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()


def test_first_duplicates_without_all_pairs(spark, monkeypatch):
    """Against all pairs, with edges of buckets, unknown distances, NaN and equal ids; a thousand alike recordings meet only the first ones."""
    rnd, start = random.Random(7), dt.datetime(1969, 12, 31, 22)
    rows = [(rnd.choice([1, 2, None]), i // 2 if i % 50 == 1 else i, start + dt.timedelta(seconds=rnd.choice([0, 1, 300, 1500, 1499]) * rnd.randrange(9)), rnd.choice([0, 300, 301, 600, None]), rnd.choice([None, 50.0, 150.0, 5000.0, 5150.0, float("nan")]), i % 9 == 0) for i in range(400)]
    kind = "user_id long, rec_id long, at timestamp_ntz, elapsed_s long, distance_m double, has_sets boolean"
    df = spark.createDataFrame(rows, kind)
    pairs = dedupe.near_pairs(df.filter("NOT has_sets")).groupBy("b").agg(F.min("a").alias("a"))
    expected = sorted(map(tuple, pairs.collect()))
    monkeypatch.setattr(dedupe, "PAIRS", 100)
    out = dedupe.duplicate_of(df)
    assert sorted(map(tuple, out.collect())) == expected and len(expected) > 100
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_places_at_one_spot_meet_what_is_asked_once(spark):
    named = spark.createDataFrame([(f"n{k:03d}", 50.0, 8.0) for k in range(300)] + [("m", 50.0, 8.01)], "name string, lat double, lng double")
    asked = spark.createDataFrame([(1, 50.0, 8.001), (2, 50.0, 8.005), (3, 50.0, 8.009)], "id long, lat double, lng double")
    out = places.nearest_named(asked, named, 2500.0, 9, "id")
    assert {r["id"]: r["name"] for r in out.collect()} == {1: "n000", 2: "m", 3: "m"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "min(name" in plan.split("Join")[1]


def test_parts_are_simplified_many_to_a_batch(spark):
    """In batches of three rows, with parts of one point, of two, over many batches, and of no user; no group goes through Python alone."""
    rnd = random.Random(9)
    lengths = [1, 2, 3, 40, 2, 1, 7, 3, 3, 25]
    given = {(u, s): [(40 + rnd.random() * 0.01, 8 + rnd.random() * 0.01) for _ in range(n)] for u in (1, 2, None) for s, n in enumerate(lengths)}
    rows = [(u, s, k, *p) for (u, s), spots in given.items() for k, p in enumerate(spots)]
    rnd.shuffle(rows)
    expected = set()
    for (u, s), spots in given.items():
        lat, lng = (np.array(x) for x in zip(*spots, strict=True))
        scale = routes.EARTH_M * np.pi / 180
        kept = routes.kept_of(lng * scale * np.cos(np.radians(lat[0])), lat * scale, 300.0)
        expected |= {(u, s, int(k)) for k in np.flatnonzero(kept)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = routes.simplified(spark.createDataFrame(rows, "user_id long, segment long, seq int, lat double, lng double"), 300.0)
        assert {(r["user_id"], r["segment"], r["seq"]) for r in out.collect()} == expected and len(expected) < len(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("name", ["home_map", "post_run_set", "tally", "ledger_audit", "touched_parents", "award_clamp", "award_totals", "bridge_pairs"])
def test_tasks_grow_with_the_table(spark, monkeypatch, name):
    """6000 order lines at 500 a task are joined, and classified, in 13 tasks or so, whatever the session's count; the rows stay."""
    small = "/root/testdata/sf0.001"
    before = sorted(map(repr, QUERIES[name](spark, small).collect()))
    monkeypatch.setattr(tables.tasks, "__defaults__", (500,))
    out = QUERIES[name](spark, small)
    n = tables.tasks(spark, small, "lineitem")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert n > 10 and f", {n}), REPARTITION_BY_NUM" in plan
    assert sorted(map(repr, out.collect())) == before


def test_dwells_are_settled_many_to_a_batch(spark):
    """Dwells over many batches, side by side and of equal points, as by the median of each; no group's points are collected in one row."""
    rnd, rows = random.Random(5), []
    for u in range(6):
        seq, t = 0, 0
        for n, slow in ((3, False), (40, True), (1, False), (5, True), (2, True), (9, False)):
            at = (40 + rnd.random(), 8 + rnd.random())
            for _ in range(n):
                wide = 0 if u == 5 else 1e-6 if slow else 0.01
                rows.append(({"w": u, "x": f"id{u}"}, seq, t, at[0] + rnd.random() * wide, at[1] + rnd.random() * wide))
                seq, t = seq + 1, t + 20_000
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "user_id struct<w:int,x:string>, seq int, t_ms long, lat double, lng double")
    moved = trace.steps(df).withColumn("island", F.sum((F.coalesce(F.col("m") / F.col("s") >= 0.5, F.lit(True))).cast("int")).over(trace.by_walk()))
    expected = {}
    for r in moved.groupBy("user_id", "island").agg(F.array_sort(F.collect_list(F.struct("seq", "t_ms", "lat", "lng"))).alias("p")).collect():
        p = r["p"]
        if len(p) > 1 and p[-1]["t_ms"] - p[0]["t_ms"] >= 60_000:
            flat = np.cos(np.radians(sum(q["lat"] for q in p) / len(p)))
            spots = [[{"x": q["lng"] * float(flat), "y": q["lat"]} for q in p]]
            (m,) = spark.createDataFrame([spots], "s array<struct<x:double,y:double>>").select(routes.median_place(F.col("s")).alias("m")).collect()
            expected[r["user_id"]["w"], p[0]["seq"]] = ((p[0]["t_ms"] + p[-1]["t_ms"] + 1) // 2, m["m"]["y"], m["m"]["x"] / flat)
        else:
            expected |= {(r["user_id"]["w"], q["seq"]): (q["t_ms"], q["lat"], q["lng"]) for q in p}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = routes.collapse_dwells(df)
        found = {(r["user_id"]["w"], r["seq"]): (r["t_ms"], r["lat"], r["lng"]) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found.keys() == expected.keys() and len(found) < len(rows)
    assert all(found[k][0] == v[0] and np.allclose(found[k][1:], v[1:], rtol=0, atol=1e-9) for k, v in expected.items())
    assert "collect_list" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_samples_of_a_web_are_dealt_by_points(spark, monkeypatch):
    from trailmill.plans import web

    monkeypatch.setattr(web, "POINTS_A_TASK", 50)
    plan = web.trace_web(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [user_id" in plan and ", 20" in plan


def test_cells_and_samples_of_walks_are_not_broadcast(spark):
    """A walk that comes back: cells appear at their first pass; what points are made into is dealt, and never sent through the driver."""
    walk = [(1, 0, 0, k, 50.0, 8.0 + 0.002 * x) for k, x in enumerate((0, 1, 2, 1, 0))] + [(1, 1, 0, 0, 50.0, 8.0)]
    walks = spark.createDataFrame(walk, "user_id long, segment long, part int, seq int, lat double, lng double")
    cells = spark.createDataFrame([(1, 0, c, 50.0001, 8.0 + 0.002 * x) for c, x in ((5, 1.5), (6, 0.5), (7, 2.0))] + [(1, 0, 8, 50.01, 8.002), (1, 1, 5, 50.0, 8.0)], "user_id long, segment long, cell long, lat double, lng double")
    for tasks in (0, 13):
        df = reveal.reveal_order(walks, cells, "user_id", "segment", tasks=tasks)
        assert {(r["segment"], r["cell"]): r["arc"] for r in df.collect()} == pytest.approx({(0, 5): 0.375, (0, 6): 0.125, (0, 7): 0.5, (0, 8): 0.25}, abs=0.005)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Broadcast" not in plan and (", 13), REPARTITION_BY_NUM" in plan) == (tasks == 13)


def test_spots_meet_walks_once_and_by_code_that_is_compiled(spark):
    """Three hundred places at two spots, one given twice; edges over the antimeridian, of one point and just too far."""
    asked = [(k, 50.0, 8.0) for k in range(299)] + [(299, -17.0, 179.9995), (299, -17.0, 179.9995), (300, None, 8.0)]
    edges = [(1, 50.0, 7.999, 50.0, 8.001), (1, 50.0005, 8.0, 50.001, 8.0), (2, 50.001, 8.0, 50.001, 8.0), (3, 50.0014, 7.0, 50.0014, 9.0), (4, -17.001, 179.0, -17.001, -179.0)]
    places = spark.createDataFrame(asked, "k int, lat double, lng double")
    df = reveal.walks_near(places, spark.createDataFrame(edges, "walk int, lat1 double, lng1 double, lat2 double, lng2 double"), 150.0, ["k"], "walk", tasks=13)
    rows = sorted((r["k"], r["walk"], round(r["m"], 3)) for r in df.collect())
    assert rows == sorted([(k, w, m) for k in range(299) for w, m in ((1, 0.0), (2, 111.195))] + [(299, 4, 111.195)])
    joins = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert len(joins) == 2 and not any("SQRT" in line for line in joins)


def test_pairs_are_swept_in_order_of_start(spark):
    """Against all pairs, in batches of three rows, with edges of buckets, unknown distances, NaN, equal ids and starts before 1970; no join makes rows to be dropped."""
    rnd, start = random.Random(11), dt.datetime(1969, 12, 31, 22)
    rows = [(rnd.choice([1, 2, None]), i // 2 if i % 50 == 1 else i, start + dt.timedelta(seconds=rnd.choice([0, 1, 300, 1500, 1499]) * rnd.randrange(9)), rnd.choice([0, 300, 301, 600, None]), rnd.choice([None, 50.0, 150.0, 5000.0, 5150.0, float("nan")]), False) for i in range(300)]
    rnd.shuffle(rows)

    def same(a, b):
        if a[0] is None or a[0] != b[0] or None in (a[3], b[3]) or abs((a[2] - b[2]).total_seconds()) > 300 or abs(a[3] - b[3]) > 300:
            return False
        if None in (a[4], b[4]) or a[4] != a[4] or b[4] != b[4]:
            return True
        return abs(a[4] - b[4]) <= max(100, 0.03 * max(a[4], b[4]))

    expected = sorted((a[0], a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and same(a, b))
    df = spark.createDataFrame(rows, "user_id long, rec_id long, at timestamp_ntz, elapsed_s long, distance_m double, has_sets boolean")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for tasks in (0, 13):
            out = dedupe.near_pairs(df, tasks)
            assert sorted(map(tuple, out.collect())) == expected and len(expected) > 1000
            assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_a_crowded_start_is_swept_some_pairs_at_a_time(monkeypatch):
    n = 200
    kinds = {"user_id": ["u"] * n, "bucket": [0] * n, "offset": [k // 50 for k in range(n)], "own": [True] * n, "rec_id": list(range(n)), "elapsed_s": [0] * n, "distance_m": [None, 1.0] * (n // 2)}
    monkeypatch.setattr(dedupe, "SWEPT", 500)
    out = list(dedupe.met_pairs(iter(pa.table(kinds).cast(pa.schema([("user_id", pa.string()), ("bucket", pa.int64()), ("offset", pa.int64()), ("own", pa.bool_()), ("rec_id", pa.int64()), ("elapsed_s", pa.int64()), ("distance_m", pa.float64())])).to_batches(70))))
    assert max(b.num_rows for b in out) <= 500 + n
    assert sorted((r["a"], r["b"]) for b in out for r in b.to_pylist()) == list(itertools.combinations(range(n), 2))
