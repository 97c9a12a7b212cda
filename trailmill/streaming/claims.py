"""Receipts as keyed state: the same answers as the batch fold, and a timer for every claim that nobody finishes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from trailmill.operators.claims import ANSWER, STALE_MS, Receipt, answered

COLUMNS = ["key", "seq", "accepted", "status"]


class Receipts(StatefulProcessor):
    """One value a receipt.  Accepted claims set a timer; if the claim is still held when it fires, a row without seq says so."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.receipt = handle.getValueState("receipt", "status string, claimed_ms long")

    def _now(self) -> Receipt:
        return Receipt(*self.receipt.get()) if self.receipt.exists() else Receipt()

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        receipt, out = self._now(), []
        asked = pd.concat(list(rows)).sort_values(["at_ms", "seq"])
        for at_ms, seq, command in zip(asked["at_ms"].tolist(), asked["seq"].tolist(), asked["command"].tolist(), strict=True):
            receipt, ok = answered(receipt, command, at_ms)
            out.append((key[0], seq, ok, receipt.status))
            if ok and receipt.status == "PROCESSING":
                self.handle.registerTimer(at_ms + STALE_MS + 1)
        if receipt.status is not None:
            self.receipt.update(tuple(receipt))
        yield pd.DataFrame(out, columns=COLUMNS)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        receipt = self._now()
        if receipt.status == "PROCESSING" and receipt.claimed_ms + STALE_MS < expiredTimerInfo.getExpiryTimeInMs():
            yield pd.DataFrame([(key[0], None, False, "STALE")], columns=COLUMNS).astype({"seq": "Int64"})

    def close(self) -> None:
        pass


def receipts(requests: DataFrame) -> DataFrame:
    """Answers to (key, at_ms, seq, command) as they arrive; needs the RocksDB state store."""
    return requests.groupBy("key").transformWithStateInPandas(Receipts(), ANSWER, "update", "ProcessingTime")
