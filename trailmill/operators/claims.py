"""Receipts and who may work on them: put, claim, done, fail, duplicate, close.

A receipt is queued once.  It is claimed when queued or failed, or when its
claim is older than STALE_MS; a replay may claim a done one too.  Only a claimed
receipt gets done, a done one never fails.  Every request is answered, accepted
or refused, with the status after it; requests of one receipt are taken by (at_ms, seq).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STALE_MS = 15 * 60_000
ANSWER = "key string, seq long, accepted boolean, status string"


class Receipt(NamedTuple):
    """``status`` is None where there is no receipt."""

    status: str | None = None
    claimed_ms: int | None = None


def free(receipt: Receipt, at_ms: int) -> bool:
    """Whether nobody works on it."""
    return receipt.status in ("QUEUED", "FAILED") or (receipt.status == "PROCESSING" and receipt.claimed_ms < at_ms - STALE_MS)


def answered(receipt: Receipt, command: str, at_ms: int) -> tuple[Receipt, bool]:
    """The receipt after a request, and whether that was accepted; an unknown command is refused."""
    exists = receipt.status is not None
    ok, after = {
        "put": (not exists, Receipt("QUEUED")),
        "claim": (exists and free(receipt, at_ms), Receipt("PROCESSING", at_ms)),
        "replay": (exists and (receipt.status == "DONE" or free(receipt, at_ms)), Receipt("PROCESSING", at_ms)),
        "done": (receipt.status == "PROCESSING", Receipt("DONE")),
        "fail": (exists and receipt.status != "DONE", Receipt("FAILED")),
        "duplicate": (exists and free(receipt, at_ms), Receipt("DONE")),
        "close": (exists, Receipt("DONE")),
    }.get(command, (False, receipt))
    return (after, True) if ok else (receipt, False)


def answers(requests: DataFrame) -> DataFrame:
    """(key, seq, accepted, status) for each of (key, at_ms, seq, command): a fold over Spark's sort that holds one receipt."""
    schema = pa.schema([("key", pa.string()), ("seq", pa.int64()), ("accepted", pa.bool_()), ("status", pa.string())])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, receipt = None, Receipt()
        for batch in batches:
            rows = []
            for key, at_ms, seq, command in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if key != last:
                    last, receipt = key, Receipt()
                receipt, ok = answered(receipt, command, at_ms)
                rows.append((key, seq, ok, receipt.status))
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    rows = requests.filter("key IS NOT NULL").select("key", "at_ms", F.col("seq").cast("long").alias("seq"), "command")
    return rows.repartition(F.col("key")).sortWithinPartitions("key", "at_ms", "seq").mapInArrow(fold, ANSWER)
