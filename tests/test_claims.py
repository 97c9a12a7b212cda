"""Receipts: the stream answers like the batch, and reports claims that nobody finishes."""

import os
import time

import pytest

from test_engine import delivered, in_order
from trailmill.operators.claims import STALE_MS, Receipt, answered, answers
from trailmill.streaming.claims import receipts

REQUESTS = [
    ("a", 1, 1, "claim"), ("a", 2, 2, "put"), ("a", 3, 3, "put"), ("a", 4, 4, "claim"), ("a", 5, 5, "claim"), ("b", 5, 6, "put"), ("a", 4 + STALE_MS, 7, "claim"),
    ("a", 5 + STALE_MS, 8, "claim"), ("a", 6 + STALE_MS, 9, "done"), ("a", 7 + STALE_MS, 10, "fail"), ("a", 8 + STALE_MS, 11, "duplicate"), ("a", 9 + STALE_MS, 12, "replay"),
    ("b", 9, 13, "fail"), ("b", 10, 14, "duplicate"), ("b", 11, 15, "nonsense"), ("c", 1, 16, "close"),
]
SCHEMA = "key string, at_ms long, seq long, command string"
ACCEPTED = {2, 4, 6, 8, 9, 12, 13, 14}


def test_batch(spark):
    rows = spark.createDataFrame(REQUESTS + [(None, 1, 99, "put")], SCHEMA).repartition(3)
    out = answers(rows).collect()
    assert {r["seq"] for r in out if r["accepted"]} == ACCEPTED and len(out) == len(REQUESTS)
    assert {r["seq"]: r["status"] for r in out if r["seq"] in (1, 7, 10, 12, 14)} == {1: None, 7: "PROCESSING", 10: "DONE", 12: "PROCESSING", 14: "DONE"}
    assert answers(rows.limit(0)).count() == 0


def test_a_claim_is_stale_only_after_its_time():
    held = Receipt("PROCESSING", 100)
    assert answered(held, "claim", 100 + STALE_MS) == (held, False)
    assert answered(held, "claim", 101 + STALE_MS) == (Receipt("PROCESSING", 101 + STALE_MS), True)


def test_stream_like_batch_with_timers(spark, tmp_path):
    """Two batches of requests; with timers there are more batches without any, so the test waits for all its rows and stops."""
    pytest.importorskip("google.protobuf")
    settings = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": "1"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    path = str(tmp_path / "in")
    os.makedirs(path)
    delivered(spark, path, REQUESTS, SCHEMA)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 8).json(path)
    query = receipts(stream).writeStream.outputMode("update").format("memory").queryName("receipts").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        found = []
        until = time.time() + 60
        while time.time() < until and query.isActive and not (len(found) > len(REQUESTS) and "STALE" in [r["status"] for r in found] and max(r["seq"] or 0 for r in found) == len(REQUESTS)):
            time.sleep(1)
            found = spark.table("receipts").collect()
    finally:
        query.stop()
        for k, v in before.items():
            spark.conf.set(k, v)
    batch = answers(spark.createDataFrame(REQUESTS, SCHEMA)).collect()
    assert in_order(tuple(r) for r in found if r["status"] != "STALE") == in_order(map(tuple, batch))
    assert {r["key"] for r in found if r["status"] == "STALE"} == {"a"}
