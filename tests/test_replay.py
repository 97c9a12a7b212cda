"""Replays that are killed, raced and repeated end in one version; streams publish a batch once."""

import pytest
from pyspark.sql import functions as F

from trailmill.operators import discovery, replay
from trailmill.sources.versions import Conflict, Versions

LEDGER = "user_id int, activity_id int, started_at timestamp_ntz, skill string, xp long, is_floor boolean"


class Killed(Exception):
    pass


def at(spark, rows, schema):
    days = schema.replace("timestamp_ntz", "string")
    return spark.createDataFrame(rows, days).select(*[F.col(c).cast("timestamp_ntz").alias(c) if c == "started_at" else c for c in [x.split()[0] for x in schema.split(", ")]])


def world(spark, calls=None):
    """User 1 falls in one skill, has an old floor and a retracted run; user 2 rises; user 3 has a new skill only."""
    def counted(name, make):
        def f():
            if calls is not None:
                calls.append(name)
            return make()
        return f

    old = [
        (1, 10, "2024-01-01", "walk", 900, False), (1, 11, "2024-01-02", "walk", 500, False), (1, None, None, "walk", 40, True),
        (1, 12, "2024-01-03", "lift", 70, False), (2, 20, "2024-01-04", "walk", 10, False),
    ]
    new = [(1, 10, "2024-01-01", "walk", 300, False), (1, 11, "2024-01-02", "walk", 1000, False), (1, 12, "2024-01-03", "lift", 5, False), (2, 20, "2024-01-04", "walk", 400, False), (3, 30, "2024-01-05", "row", 7, False)]
    seen = [(1, 10, "2024-01-01", 5), (1, 11, "2024-08-01", 5), (2, 20, "2024-01-04", 5)]
    return (
        counted("old", lambda: at(spark, old, LEDGER)), counted("new", lambda: at(spark, new, LEDGER)),
        counted("visits", lambda: at(spark, seen, "user_id int, activity_id int, started_at timestamp_ntz, cell long")),
        counted("active", lambda: spark.createDataFrame([(10,), (12,), (20,), (30,)], "activity_id int")),
    )


def states(store):
    return sorted((r["user_id"], r["skill"], r["xp"], str(r["first_at"])[:10], str(r["last_at"])[:10]) for r in store.table("states").collect())


# walk of user 1: 300 fresh, 500 of the retracted run and 40 of the old floor survive; 600 more are missing to the 1440 shown.
WANTED = [(1, "lift", 70, "2024-01-03", "2024-01-03"), (1, "walk", 1440, "2024-01-01", "2024-01-02"), (2, "walk", 400, "2024-01-04", "2024-01-04"), (3, "row", 7, "2024-01-05", "2024-01-05")]
STAGES = ("waterline", "survivors", "fresh", "cells", "floors", "ledger", "states", "published")


def test_a_replay_that_is_killed_after_every_stage_goes_on_to_the_same_version(spark, tmp_path):
    store, calls = Versions(spark, f"file://{tmp_path}/v"), []
    for stage in STAGES:
        def kill(name, stage=stage):
            if name == stage:
                raise Killed(name)

        assert store.current() is None
        with pytest.raises(Killed):
            replay.replay(store, "run-1", *world(spark, calls), after=kill)
    done = replay.replay(store, "run-1", *world(spark, calls))
    assert done.generation == 1 and done == store.current() and states(store) == WANTED
    assert calls.count("new") == calls.count("visits") == 1  # a stage that was written is read again
    assert len(store.versions()) == 1 and replay.replay(store, "run-1", *world(spark)) == done
    floors = store.table("ledger").filter("is_floor").groupBy("skill").agg(F.sum("xp").alias("xp")).collect()
    assert {r["skill"]: r["xp"] for r in floors} == {"walk": 640, "lift": 65}


def test_a_write_that_broke_off_is_made_again(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/v")
    (tmp_path / "v/runs/run-1/fresh").mkdir(parents=True)
    (tmp_path / "v/runs/run-1/fresh/part-00000.parquet").write_bytes(b"half")
    replay.replay(store, "run-1", *world(spark))
    assert states(store) == WANTED


def test_a_second_replay_never_falls_below_the_first(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/v")
    replay.replay(store, "run-1", *world(spark))
    old, new, visits, active = world(spark)
    replay.replay(store, "run-2", old, lambda: new().withColumn("xp", F.lit(1).cast("long")), visits, active)
    assert store.current().generation == 2
    assert [x[:3] for x in states(store)] == [x[:3] for x in WANTED]
    assert store.table("states", store.versions()[0]).count() == 4  # the old version is still there


def test_of_two_replays_that_began_together_one_publishes(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/v")

    def other(name):
        if name == "states":
            replay.replay(store, "run-b", *world(spark))

    with pytest.raises(Conflict):
        replay.replay(store, "run-a", *world(spark), after=other)
    assert [v.run for v in store.versions()] == ["run-b"] and states(store) == WANTED
    with pytest.raises(Conflict):
        replay.replay(store, "run-a", *world(spark))


def test_a_manifest_is_never_replaced(spark, tmp_path):
    store = Versions(spark, f"file://{tmp_path}/v")
    store.stage("a", "t", lambda: spark.range(3))
    store.stage("b", "t", lambda: spark.range(5))
    store.publish("a", ["t"], 0)
    late = Versions(spark, f"file://{tmp_path}/v")
    late.current = lambda: None  # a run that looked before the other published
    with pytest.raises(Conflict):
        late.publish("b", ["t"], 0)
    assert store.table("t").count() == 3 and [p.name for p in (tmp_path / "v/manifests").iterdir() if p.suffix == ".json"] == ["0000000001.json"]


def test_a_fall_is_an_error_and_publishes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(replay, "floor_rows", lambda shown, fresh, kept, columns: columns.limit(0))
    store = Versions(spark, f"file://{tmp_path}/v")
    with pytest.raises(replay.Fallen):
        replay.replay(store, "run-1", *world(spark))
    assert store.current() is None


def test_a_stream_publishes_each_batch_once(spark, tmp_path):
    schema = "user_id long, activity_id long, started_at string, cell long"
    visits = [(1, 10, "2020-01-01", 5), (1, 11, "2020-09-01", 5), (1, 12, "2020-03-01", 6), (2, 13, "2020-01-01", 5)]
    (tmp_path / "in").mkdir()
    store = Versions(spark, f"file://{tmp_path}/v")
    typed = lambda df: df.withColumn("started_at", F.col("started_at").cast("timestamp_ntz"))

    def run():
        stream = typed(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in")))
        query = replay.merged_batches(store, stream, str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()

    for k, v in enumerate(visits[:3]):
        spark.createDataFrame([v], schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        if k == 1:
            run()
    run()
    generations = [v.generation for v in store.versions()]
    last = sorted(tmp_path.glob("c/commits/[0-9]*"), key=lambda p: int(p.name))[-1]
    last.unlink()  # as if the driver had died after publishing and before the commit
    (last.parent / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert [v.generation for v in store.versions()] == generations == [1, 2, 3]
    found = {(r["user_id"], r["cell"]): (r["visit_count"], r["discovery_count"]) for r in store.table("cells").collect()}
    assert found == {(1, 5): (2, 2), (1, 6): (1, 1)}


def test_batches_in_order_end_in_the_state_of_the_whole(spark):
    rows = [(u, 100 * u + k, f"2020-{1 + k % 12:02d}-{1 + (k * 7 + u) % 28:02d}", (k * 5 + u) % 7) for u in range(3) for k in range(60)]
    visits = at(spark, sorted(rows, key=lambda r: r[2]), "user_id int, activity_id int, started_at timestamp_ntz, cell long").cache()
    whole = discovery.cell_state(discovery.classify_history(visits))
    cut = "TIMESTAMP_NTZ'2020-05-15 00:00:00'"
    first = discovery.cell_state(discovery.classify_history(visits.filter(f"started_at < {cut}")))
    both = replay.with_batch(first, visits.filter(f"started_at >= {cut}"))
    assert sorted(map(tuple, both.select(whole.columns).collect())) == sorted(map(tuple, whole.collect()))
    late = replay.with_batch(whole, at(spark, [(0, 999, "2019-01-01", 0)], "user_id int, activity_id int, started_at timestamp_ntz, cell long"))
    (r,), (w,) = (x.filter("user_id = 0 AND cell = 0").collect() for x in (late, whole))
    assert r["visit_count"] == w["visit_count"] + 1 and r["discovery_count"] == w["discovery_count"] and r["first_run_id"] == 999
