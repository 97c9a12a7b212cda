"""Rule tables with lists of sources, broken tables one fault at a time, and hashes beyond the basic plane."""

import pytest
from pyspark.sql import functions as F

from trailmill.functions import text
from trailmill.operators import rules as r


def changed(spark, skill, **values):
    rows = r.rules(spark)
    for c, v in values.items():
        kind = rows.schema[c].dataType
        rows = rows.withColumn(c, F.when(F.col("skill") == skill, F.lit(v).cast(kind)).otherwise(F.col(c)))
    return rows


def test_rules_may_list_sources(spark):
    runs = spark.createDataFrame([(1, "run", True, "watch"), (2, "run", True, "phone")], "activity_id int, kind string, has_trace boolean, source string")
    rows = r.rules(spark).withColumn("sources", F.when(F.col("skill") == "wayfaring", "watch,band"))
    assert {(x["activity_id"], x["skill"]) for x in r.candidates(runs, rows).collect()} == {(1, "wayfaring")}
    assert r.candidates(runs, r.rules(spark)).count() == 2


FAULTS = {
    "needs a match": {"measure": None}, "needs reveals": {"reveals": None}, "negative rate": {"xp_per_unit": -1.0}, "soft cap must be positive": {"soft_cap": 0.0},
    "introduced after this version": {"introduced_in": 6}, "unknown skill nothing": {"feeds": "nothing"},
}


@pytest.mark.parametrize("message", sorted(FAULTS))
def test_each_fault_is_named(spark, message):
    assert r.violations(r.rules(spark)).count() == 0
    (x,) = r.violations(changed(spark, "poise", **FAULTS[message])).collect()
    assert x["message"] == message and x["path"].startswith("skills.poise")


def test_duplicates_and_meta_rules(spark):
    assert {x["message"] for x in r.violations(r.rules(spark).unionByName(r.rules(spark).filter("skill = 'vigil'"))).collect()} == {"duplicate id"}
    assert {x["message"] for x in r.violations(changed(spark, "slayer", measure="distanceKm")).collect()} == {"meta must not match"}


def test_cycles(spark):
    assert r.feed_cycles(r.rules(spark)).count() == 0
    ring = changed(spark, "constitution", feeds="endurance")
    for skill, feeds in (("endurance", "slayer"), ("slayer", "poise"), ("poise", "constitution")):
        ring = ring.withColumn("feeds", F.when(F.col("skill") == skill, feeds).otherwise(F.col("feeds")))
    assert {x["skill"] for x in r.feed_cycles(ring).collect()} == {"constitution", "endurance", "slayer", "poise"}


def test_ambiguities(spark):
    assert r.ambiguities(r.rules(spark)).count() == 0
    found = {(x["kind"], x["has_trace"], x["skills"]) for x in r.ambiguities(changed(spark, "roving", kinds="run,ride")).collect()}
    assert found == {("run", True, "roving,wayfaring")}


def test_hash_of_units_beyond_the_basic_plane(spark):
    def fnv(s):
        h, data = 2166136261, s.encode("utf-16-be")
        for k in range(0, len(data), 2):
            h = ((h ^ int.from_bytes(data[k : k + 2], "big")) * 16777619) % 2**32
        return h

    given = ["", "a", "run\x00id", "é☃", "🙂𝒳 mixed", None]
    found = [x["h"] for x in spark.createDataFrame([(s,) for s in given], "s string").select(text.fnv1a(F.col("s")).alias("h")).collect()]
    assert found == [None if s is None else fnv(s) for s in given]
