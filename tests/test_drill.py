"""A folder of objects, one of them damaged, goes to ledger and map."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from trailmill.operators import drill

USER = "u1"


def envelope(external_id, day, points, sport="Run", **more):
    detail = {"id": external_id, "sport_type": sport, "start_date": f"{day}T08:00:00Z", "start_date_local": f"{day}T08:00:00Z", "timezone": "(GMT+00:00) UTC", "elapsed_time": 600, "distance": 2000.0, **more}
    streams = {"latlng": {"data": points}, "time": {"data": [2 * k for k in range(len(points))]}} if points else None
    return json.dumps({"schemaVersion": 1, "source": "watch", "detail": detail, "streams": streams}).encode()


def path(north=0.0):
    return [[48.0 + north + 0.0001 * k, 11.0] for k in range(60)]


@pytest.fixture
def folder(tmp_path):
    def put(source, external_id, content, digest=None, ext="json"):
        place = tmp_path / "raw" / USER / source / external_id
        place.mkdir(parents=True, exist_ok=True)
        (place / f"{digest or hashlib.sha256(content).hexdigest()}.{ext}").write_bytes(content)

    put("watch", "w1", envelope("w1", "2024-01-01", path()))
    put("watch", "w2", envelope("w2", "2024-02-01", path(0.003)))  # half of it on known ground
    put("watch", "w3", envelope("w3", "2024-09-01", path()))  # the same ground, more than half a year later
    put("watch", "w4", envelope("w4", "2024-03-01", None))  # a treadmill
    put("watch", "w5", envelope("w5", "2024-04-01", path(0.5)), digest="0" * 64)  # damaged
    put("watch", "w6", envelope("w6", "2024-05-01", path(0.7), sport="Ride"))  # a run taken for a ride
    put("watch", "w7", envelope("w7", "2024-06-01", path(0.9)))  # retracted
    put("watch", "w8", envelope("w8", "2024-01-01", path()))  # a duplicate of w1
    put("watch", "w9", envelope("w9", "2024-07-01", path(), timezone="Mars/Base"))  # refused
    put("manual", "m1", json.dumps({"idempotencyKey": "m1", "exerciseId": "pushup", "occurredAt": "2024-01-05T10:00:00Z", "sets": [{"reps": 20}, {"reps": 15}]}).encode())
    base = tmp_path / "raw" / USER / "watch"
    (base / "w8.duplicate-of.json").write_text(json.dumps({"duplicateOf": "w1"}))
    (base / "w7.retracted.json").write_text("{}")
    (base / "w6.kind-override").mkdir()
    (base / "w6.kind-override" / "01.json").write_text(json.dumps({"kind": "walk"}))
    (base / "w6.kind-override" / "02.json").write_text(json.dumps({"kind": "run"}))
    (base / "notes.txt").write_text("?")
    return str(tmp_path)


def test_a_folder_is_rebuilt(spark, folder):
    listed = drill.enumerated(drill.read_objects(spark, folder)).cache()
    classes = {r["class"]: r["n"] for r in listed.groupBy("class").agg(F.count("*").alias("n")).collect()}
    assert classes == {"payload": 10, "duplicate": 1, "retraction": 1, "override": 2, "unrecognised": 1}
    assert all(r["ok"] for r in drill.preconditions(listed, 15).collect())
    refused = {r["precondition"] for r in drill.preconditions(listed.withColumn("source", F.when(F.col("external_id") == "w1", "phone").otherwise(F.col("source"))), 16).filter("NOT ok").collect()}
    assert refused == {"as many objects as expected", "every source has an adapter"}

    world = drill.scored({name: table.cache() for name, table in drill.rebuilt(listed).items()})
    named = {drill_id(x): x for x in ("w1", "w2", "w3", "w4", "w6", "w7")} | {drill_id("m1", "manual"): "m1"}
    activities = {named[r["activity_id"]]: r for r in world["activities"].collect()}
    assert set(activities) == {"w1", "w2", "w3", "w4", "w6", "w7", "m1"}
    assert activities["w6"]["kind"] == "run" and activities["w6"]["derived_kind"] == "ride" and activities["w7"]["status"] == "TOMBSTONED"
    failures = {(r["key"].split("/")[3], r["failure"]) for r in world["failures"].collect()}
    assert failures == {("w5", "digest"), ("w9", "unknown zone")}

    cells = world["cells"].cache()
    by = {(named[r["activity_id"]], r["class"]): r["n"] for r in cells.groupBy("activity_id", "class").agg(F.count("*").alias("n")).collect()}
    assert by["w1", "new"] == by["w3", "rearmed"] and ("w3", "new") not in by  # half a year later all of it counts again
    assert 0 < by["w2", "new"] < by["w1", "new"] and by["w2", "cooled"] > 0 and ("w4", "new") not in by and by["w7", "new"] > 0
    ledger = world["ledger"].cache()
    skills = {r["skill"]: r["xp"] for r in ledger.groupBy("skill").agg(F.sum("xp").alias("xp")).collect()}
    assert {named[r["activity_id"]] for r in ledger.collect()} == {"w1", "w2", "w3", "w4", "w6", "m1"}
    assert skills["vigil"] == 200 and skills["might"] == 35 * 8 * 0.5 and {"wayfaring", "cartography", "constitution", "endurance"} <= set(skills)

    world = {**world, "cells": cells, "ledger": ledger}
    total, rows, seen = sum(skills.values()), ledger.count(), cells.select("user_id", "cell").distinct().count()
    expected = {"objects": 15, "payloads": 10, "failures": 2, "activities": 7, "cells": seen, "ledger_rows": rows, "ledger_xp": total, **{f"xp:{k}": v for k, v in skills.items()}}
    checks = drill.verified(listed, world, spark.createDataFrame(list(expected.items()), "check string, value long"))
    assert checks.count() == len(expected) and checks.filter("NOT ok").count() == 0
    wrong = drill.verified(listed, world, spark.createDataFrame([("failures", 0), ("xp:slayer", 1)], "check string, value long"))
    assert {(r["check"], r["found"], r["ok"]) for r in wrong.collect()} == {("failures", 2, False), ("xp:slayer", 0, False)}


def drill_id(external_id, source="watch"):
    return hashlib.sha256(f"{USER}:{source}:{external_id}".encode()).hexdigest()


def test_of_two_payloads_the_newest_counts(spark):
    old, new = envelope("w1", "2024-01-01", path()), envelope("w1", "2024-01-02", path())
    rows = [(f"raw/{USER}/watch/w1/{hashlib.sha256(c).hexdigest()}.json", f"2024-0{k}-01", bytearray(c)) for k, c in ((1, old), (2, new))]
    objects = spark.createDataFrame(rows, "key string, modified string, content binary").withColumn("modified", F.col("modified").cast("timestamp"))
    (r,) = drill.rebuilt(drill.enumerated(objects))["activities"].collect()
    assert str(r["started_at"])[:10] == "2024-01-02"
