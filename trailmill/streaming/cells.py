"""The discovery views on Structured Streaming.

Keyed state has one writer for each (user, cell), so no conditional writes and
retries are needed; the batch fold stays the truth that a replay restores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.operators.late import STATE, fold_cell


def accepted_once(events: DataFrame, key: str, at: str, keep: str = "90 days") -> DataFrame:
    """Events whose key was not accepted within ``keep``."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, keep).dropDuplicatesWithinWatermark([key])


def cell_states(visits: DataFrame) -> DataFrame:
    """The state of each (user_id, cell) after every batch that touched it, from (user_id, activity_id, started_at, cell)."""
    rows = visits.select("user_id", "cell", "activity_id", F.unix_micros(F.col("started_at").cast("timestamp")).alias("at_us"))
    out = f"user_id long, cell long, {STATE}"
    return rows.groupBy("user_id", "cell").applyInPandasWithState(fold_cell, out, STATE, "update", "NoTimeout")


def request_counts(requests: DataFrame, at: str, late: str = "10 minutes") -> DataFrame:
    """Requests of each quarter hour."""
    rows = requests.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, "15 minutes")).agg(F.count("*").alias("used")).select(F.col("window.start").alias("quarter"), "used")
