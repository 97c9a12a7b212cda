"""The rebuild drill: from a folder of archived objects, and nothing else, to ledger and map, with its checks as rows.

Objects are (key, modified, content).  A damaged object costs itself and is a
counted failure; everything else goes on.  Keys name what an object is and, for
payloads, the digest of its content.  All steps are joins and groupings by
activity.  Activities are folded in order of (start, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.operators import cells, dedupe, discovery, intake, places, routes, rules, sanitise, scoring

SOURCES = ("watch", "manual")
SETS = "array<struct<exercise:string,reps:int,durationS:int,distanceM:double>>"
WALK = {"gap_ms": 30_000, "slow": 0.5, "least_s": 60.0, "teleport": 12.5, "jump_m": 250.0, "jump_s": 120.0}


def read_objects(spark: SparkSession, folder: str) -> DataFrame:
    """(key, modified, content) of all files below ``folder``/raw, read by the executors; a key begins with raw/."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder.rstrip('/')}/raw")
    return files.select(F.concat(F.lit("raw/"), F.element_at(F.split("path", "/raw/"), -1)).alias("key"), F.col("modificationTime").alias("modified"), "content")


def activity_id(user: Column, source: Column, external_id: Column) -> Column:
    return F.sha2(F.concat_ws(":", user, source, external_id), 256)


def enumerated(objects: DataFrame) -> DataFrame:
    """Adds class, user_id, source, external_id, digest and activity to each object; null where the key is not recognised."""
    kind, part = dedupe.listing_class(F.col("key")), F.split("key", "/")
    known = kind != "unrecognised"
    name = F.regexp_replace(part[3], r"\.(duplicate-of\.json|retracted\.json|kind-override)$", "")
    rows = objects.withColumns({"class": kind, "user_id": F.when(known, part[1]), "source": F.when(known, part[2]), "external_id": F.when(known, name)})
    return rows.withColumns({"digest": F.when(kind == "payload", F.regexp_extract(part[4], "^[0-9a-f]{64}", 0)), "activity": F.when(known, activity_id(F.col("user_id"), F.col("source"), F.col("external_id")))})


def preconditions(listed: DataFrame, expect: int | None, sources: tuple[str, ...] = SOURCES) -> DataFrame:
    """(precondition, ok, detail): what must hold before anything is rebuilt."""
    counts = listed.agg(
        F.count("*").alias("n"), F.count_if(F.col("class") == "payload").alias("payloads"), F.collect_set(F.when(~F.col("source").isin(*sources), F.col("source"))).alias("strange"),
        F.count_distinct("user_id").alias("users"),
    )
    number = lambda c: F.col(c).cast("string")
    rows = [
        ("objects were found", F.col("n") > 0, number("n")), ("as many objects as expected", (F.lit(expect) == F.col("n")) if expect is not None else F.lit(True), number("n")),
        ("there is a payload", F.col("payloads") > 0, number("payloads")), ("every source has an adapter", F.size("strange") == 0, F.array_join(F.array_sort("strange"), ",")),
        ("one user", F.col("users") <= 1, number("users")),
    ]
    return counts.select(F.inline(F.array(*[F.struct(F.lit(p).alias("precondition"), ok.alias("ok"), detail.alias("detail")) for p, ok, detail in rows])))


def opened(listed: DataFrame) -> DataFrame:
    """(user_id, source, activity, key, raw, failure): the newest payload of each activity that is no duplicate; its text, or why there is none."""
    pointers = listed.filter("class = 'duplicate'").select("activity").distinct()
    payloads = listed.filter("class = 'payload'").join(pointers, "activity", "left_anti")
    newest = dedupe.newest_for_rebuild(payloads).select("key")
    rows = payloads.join(newest, "key")
    damaged = F.sha2("content", 256) != F.col("digest")
    text = F.decode("content", "UTF-8")
    failure = F.when(~F.col("source").isin(*SOURCES), "no adapter").when(damaged, "digest")
    return rows.select("user_id", "source", "activity", "key", F.when(failure.isNull(), text).alias("raw"), failure.alias("failure"))


def overrides(listed: DataFrame) -> DataFrame:
    """(activity_id, override_id, kind) of the override objects; ids in their names grow with time."""
    body = F.from_json(F.decode("content", "UTF-8"), "kind string")
    return listed.filter("class = 'override'").select(F.col("activity").alias("activity_id"), F.col("key").alias("override_id"), body["kind"].alias("kind")).filter("kind IS NOT NULL")


def rebuilt(listed: DataFrame) -> dict[str, DataFrame]:
    """activities, points, sets and failures of an archive, kinds corrected, retracted activities marked."""
    raw = opened(listed)
    watch = intake.read_envelopes(raw.filter("source = 'watch' AND failure IS NULL"))
    judged = sanitise.refusals(watch).withColumn("user_id", F.struct("user_id", "activity", "key"))
    flagged = sanitise.flagged_points(judged)
    traced = sanitise.activities(judged).select("user_id.activity", "user_id.key", "bad", (F.coalesce("n_points", F.lit(0)) > 0).alias("has_trace"))
    shown = intake.normalise(watch.withColumn("user_id", F.struct("user_id", "activity"))).select("user_id.user_id", "user_id.activity", "kind", "started_at", "distance_m", "elapsed_s")
    runs = shown.join(traced.filter("bad IS NULL").select("activity", "has_trace"), "activity")
    entry = F.from_json("raw", intake.ENTRY.replace("timezone string", "timezone string, kind string"))
    entries = raw.filter("source = 'manual' AND failure IS NULL").withColumn("e", entry)
    read = intake.read_entries(entries.withColumn("user_id", F.struct("user_id", "activity", "key", F.coalesce("e.kind", F.lit("strength")).alias("kind"))).select("user_id", "raw"))
    done = read.filter("bad IS NULL").select("user_id.user_id", "user_id.activity", "user_id.kind", "started_at", "distance_m", "elapsed_s", F.lit(False).alias("has_trace"))
    activities = runs.unionByName(done).withColumnRenamed("activity", "activity_id")
    gone = listed.filter("class = 'retraction'").select(F.col("activity").alias("activity_id")).distinct().withColumn("gone", F.lit(True))
    marked = dedupe.with_overrides(activities, overrides(listed)).join(gone, "activity_id", "left")
    sets = entries.select(F.col("activity").alias("activity_id"), "e.exerciseId", F.posexplode("e.sets").alias("pos", "s")).select(
        "activity_id", "pos", F.coalesce("s.exercise", "exerciseId").alias("exercise"), F.col("s.reps").alias("reps"), F.col("s.durationS").alias("duration_s")
    )
    points = sanitise.sanitised_points(flagged).select(F.col("user_id.user_id").alias("user_id"), F.col("user_id.activity").alias("activity_id"), "segment", "seq", "t_ms", "lat", "lng")
    failures = raw.filter("failure IS NOT NULL").select("key", "failure").unionByName(traced.filter("bad IS NOT NULL").select("key", F.col("bad").alias("failure")))
    failures = failures.unionByName(read.filter("bad IS NOT NULL").select("user_id.key", F.col("bad").alias("failure")))
    return {"activities": marked.withColumn("status", F.when(F.col("gone"), "TOMBSTONED").otherwise("ACTIVE")).drop("gone"), "points": points, "sets": sets, "failures": failures}


def scored(world: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Adds cells (user_id, activity_id, started_at, cell, class) and ledger: corridor, discovery in order, metres by the ground's class, rules.

    Retracted activities fold into the history of cells and are then not scored.
    """
    spark = world["activities"].sparkSession
    walked = world["points"].select(F.struct("user_id", "activity_id", "segment").alias("user_id"), "seq", "t_ms", "lat", "lng", F.lit(None).cast("double").alias("accuracy"))
    pieces = routes.parts(walked, **WALK).select("user_id.user_id", "user_id.activity_id", F.struct(F.col("user_id.segment").alias("s"), F.col("part").alias("p")).alias("part"), "seq", "lat", "lng")
    shown = cells.corridor(pieces, "user_id", "activity_id").join(world["activities"].select("activity_id", "started_at"), "activity_id")
    classed = discovery.classify_history(shown)
    active = world["activities"].filter("status = 'ACTIVE'")
    mine = classed.join(active.select("activity_id"), "activity_id", "left_semi")
    ground = mine.withColumn("class", F.when(F.col("class") == "cooled", "recent").otherwise(F.col("class")))
    middles = cells.middles(pieces.join(active.select("activity_id"), "activity_id", "left_semi"), "activity_id")
    split = places.ground_split(middles, ground.select("activity_id", "cell", "class"), "activity_id").withColumnsRenamed({"new_m": "m_new", "rearmed_m": "m_rearmed", "recent_m": "m_recent"})
    table = rules.rules(spark)
    units = scoring.score_units(rules.select_skills(active, table), world["sets"], rules.exercises(spark))
    ledger = scoring.ledger_rows(scoring.rate_ground(units, split), discovery.awards(mine, "activity_id"), table)
    return {**world, "cells": classed, "ledger": ledger}


def verified(listed: DataFrame, world: dict[str, DataFrame], expected: DataFrame) -> DataFrame:
    """(check, expected, found, ok) of each expected (check, value): counts of objects, payloads, failures and activities, cells of the map, rows and XP of the ledger, XP by skill as xp:<skill>."""
    one = lambda df, **c: df.agg(*[v.cast("long").alias(k) for k, v in c.items()]).select(F.inline(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(F.col(k), F.lit(0)).alias("found")) for k in c])))
    found = one(listed, objects=F.count("*"), payloads=F.count_if(F.col("class") == "payload"))
    found = found.unionByName(one(world["failures"], failures=F.count("*"))).unionByName(one(world["activities"], activities=F.count("*")))
    found = found.unionByName(one(world["cells"].select("user_id", "cell").distinct(), cells=F.count("*")))
    found = found.unionByName(one(world["ledger"], ledger_rows=F.count("*"), ledger_xp=F.sum("xp")))
    by_skill = world["ledger"].groupBy("skill").agg(F.sum("xp").cast("long").alias("found"))
    found = found.unionByName(by_skill.select(F.concat(F.lit("xp:"), "skill").alias("check"), "found"))
    both = expected.join(found, "check", "left")
    return both.select("check", F.col("value").alias("expected"), F.coalesce("found", F.lit(0)).alias("found"), (F.col("value") == F.coalesce("found", F.lit(0))).alias("ok"))
