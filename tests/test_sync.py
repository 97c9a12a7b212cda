"""Adapters, their listings and stream, and a round of synchronisation over them."""

import json
import sys
from datetime import datetime

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from trailmill.operators import sync
from trailmill.sources.adapters import FolderAdapter, Registry, UnknownSource, accepted, listings, stream_source


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not import the tests


class Flaky(FolderAdapter):
    """User 3's listing breaks off after its first activity; payload "b2" cannot be fetched."""

    def list_since(self, user_id, since):
        for k, x in enumerate(super().list_since(user_id, since)):
            if user_id == 3 and k:
                raise TimeoutError("listing")
            yield x

    def fetch(self, user_id, external_id):
        if external_id == "b2":
            raise ValueError("payload")
        return super().fetch(user_id, external_id)


def write(folder, user, *rows):
    with (folder / f"{user}.jsonl").open("a") as f:
        for external_id, at in rows:
            f.write(json.dumps({"id": external_id, "started_at": f"{at}+00:00", "payload": f"raw {external_id}"}) + "\n")


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "source"
    path.mkdir()
    write(path, 1, ("a1", "2024-01-01T00:00:00"), ("a2", "2024-01-02T00:00:00"), ("a0", "2023-01-01T00:00:00"))
    write(path, 2, ("b1", "2024-01-01T00:00:00"), ("b2", "2024-01-03T00:00:00"), ("b3", "2024-01-04T00:00:00"))
    write(path, 3, ("c1", "2024-01-01T00:00:00"), ("c2", "2024-01-02T00:00:00"))
    (path / "4.jsonl").write_text('{"reauth": true}\n')
    return path


def accounts(spark):
    rows = [(1, "watch", "ACTIVE", "2023-12-31"), (2, "watch", "ACTIVE", None), (3, "watch", "ACTIVE", "2023-12-31"), (4, "watch", "ACTIVE", "2023-12-31"), (5, "watch", "ACTIVE", "2023-12-31"), (6, "watch", "DISCONNECTED", None), (7, "watch", "EXPIRED", None)]
    return spark.createDataFrame(rows, "user_id long, source string, status string, watermark string").withColumn("watermark", F.col("watermark").cast("timestamp"))


NOW = "TIMESTAMP'2024-01-10 00:00:00'"


def test_an_unknown_source_is_an_error(spark, folder):
    registry = Registry(FolderAdapter("watch", str(folder)))
    assert registry.ids() == ["watch"]
    with pytest.raises(UnknownSource):
        registry.of("phone")
    with pytest.raises(UnknownSource):
        listings(spark.createDataFrame([(1, "phone", datetime(2024, 1, 1))], "user_id long, source string, list_from timestamp"), registry)
    with pytest.raises(ValueError):
        Registry(FolderAdapter("a", "x"), FolderAdapter("a", "y"))


@pytest.mark.parametrize("hold", [False, True])
def test_a_round_over_adapters(spark, folder, hold):
    windows = sync.windows(accounts(spark), F.expr(NOW))
    rows = listings(windows.filter("status = 'ACTIVE'"), Registry(Flaky("watch", str(folder)))).cache()
    keys = {r["external_id"]: r["k"] for r in rows.select("external_id", sync.ingest_key(F.col("source"), F.col("user_id"), F.col("external_id")).alias("k")).collect()}
    receipts = spark.createDataFrame([(keys["a1"], "DONE", 1), (keys["b3"], "QUEUED", 0)], "ingest_key string, status string, attempts int")
    found = sync.judged(rows, receipts)
    assert {(r["external_id"], r["raw"]) for r in found.filter("enqueue AND error IS NULL").collect()} == {("a2", "raw a2"), ("b1", "raw b1"), ("b3", "raw b3"), ("c1", "raw c1")}
    out = {r["user_id"]: tuple(r)[2:] for r in sync.outcomes(windows, rows, found, hold).collect()}
    at = lambda text: datetime.fromisoformat(text)
    assert out == {
        1: ("queued", 1, 1, None, at("2023-12-31")), 2: ("failed", 2, 0, "ValueError", at("2024-01-01")), 3: ("failed", 1, 0, "TimeoutError", at("2023-12-31") if hold else at("2023-12-30")),
        4: ("reconnect", 0, 0, None, at("2023-12-31")), 5: ("nothing-new", 0, 0, None, at("2023-12-31")), 7: ("reconnect", 0, 0, None, None),
    }
    (total,) = sync.sweep_totals(sync.outcomes(windows, rows, found, hold)).collect()
    assert total.asDict() == {"seen": 5, "enqueued": 4, "already_present": 1, "failed": 2, "reconnect": 2}


def test_nightly_windows_look_back_two_weeks_at_least(spark):
    rows = {r["user_id"]: r["list_from"] for r in sync.windows(accounts(spark).withColumn("watermark", F.expr("TIMESTAMP'2024-01-09 00:00:00'")), F.expr(NOW), nightly=True).collect()}
    assert set(rows.values()) == {datetime(2023, 12, 27)} and 6 not in rows
    first = {r["list_from"] for r in sync.windows(accounts(spark).filter("watermark IS NULL"), F.expr(NOW)).collect()}
    assert first == {datetime(2023, 12, 11)}


def test_a_stopped_stream_goes_on_and_reads_each_activity_once(spark, folder, tmp_path):
    spark.dataSource.register(stream_source(Registry(Flaky("watch", str(folder)))))

    def run():
        stream = spark.readStream.format("activities").options(source="watch", users="1,2,3,4", overlap_s=str(3 * 365 * 86_400)).load()
        query = accepted(stream).select("external_id", "raw").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = run()
    assert first == [(x, f"raw {x}") for x in ("a0", "a1", "a2", "b1", "b3", "c1")]
    assert run() == first  # nothing new
    write(folder, 1, ("a3", "2024-02-01T00:00:00"), ("late", "2023-12-15T00:00:00"))
    assert run() == sorted([*first, ("a3", "raw a3"), ("late", "raw late")])
    with pytest.raises(Exception, match="UnknownSource|no source"):
        spark.readStream.format("activities").options(source="phone", users="1").load().writeStream.format("noop").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start().awaitTermination()
