"""Visits that arrive late, and budgets of requests: what a stream keeps, as batch and as stream.

A cell's state takes visits in order of arrival.  A visit after the last one
moves the cell forward and is credited by its class; one before it is deferred:
it counts as a visit, may lower the first run, and earns nothing until a replay
folds the whole history again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REARM_US = 183 * 86_400_000_000
PAUSE_SHARE = 0.9


def arrivals(visits: DataFrame, arrived: Column) -> DataFrame:
    """Classes of visits as they arrive: against the latest start that arrived before them.

    Visits of one cell that arrive together are taken by start, then activity.
    """
    by_arrival = Window.partitionBy("user_id", "cell").orderBy("arrived", "started_at", "activity_id")
    seen = F.max("started_at").over(by_arrival.rowsBetween(Window.unboundedPreceding, -1))
    rows = visits.withColumn("arrived", arrived).withColumn("seen", seen)
    kind = (
        F.when(F.col("seen").isNull(), "new")
        .when(F.col("started_at") < F.col("seen"), "deferred")
        .when(F.col("started_at") - F.col("seen") < F.expr("INTERVAL '183' DAY"), "cooled")
        .otherwise("rearmed")
    )
    return rows.withColumn("class", kind).drop("seen")


def arrived_state(arrived: DataFrame) -> DataFrame:
    """(user_id, cell, first_run_at, last_run_at, visits, credits, deferred): the state that arrivals leave."""
    return arrived.groupBy("user_id", "cell").agg(
        F.min("started_at").alias("first_run_at"),
        F.max("started_at").alias("last_run_at"),
        F.count("*").alias("visits"),
        F.count_if(F.col("class").isin("new", "rearmed")).alias("credits"),
        F.count_if(F.col("class") == "deferred").alias("deferred"),
    )


def budget_windows(requests: DataFrame, at: str, quarter_limit: int, daily_limit: int) -> DataFrame:
    """(quarter, used, used_today, decision) for each quarter hour with requests.

    A budget that is used up stops all; at PAUSE_SHARE of it only interactive
    requests go on.  The day's use is counted up to and with the quarter.
    """
    quarter = F.window(F.col(at).cast("timestamp"), "15 minutes")["start"]
    used = requests.groupBy(quarter.alias("quarter")).agg(F.count("*").alias("used"))
    day = Window.partitionBy(F.to_date("quarter")).orderBy("quarter").rowsBetween(Window.unboundedPreceding, 0)
    rows = used.withColumn("used_today", F.sum("used").over(day))
    decision = (
        F.when(F.col("used_today") >= daily_limit, "sleep until midnight")
        .when(F.col("used") >= quarter_limit, "sleep until the next quarter")
        .when(F.col("used_today") >= daily_limit * PAUSE_SHARE, "interactive only until midnight")
        .when(F.col("used") >= quarter_limit * PAUSE_SHARE, "interactive only until the next quarter")
        .otherwise("proceed")
    )
    return rows.withColumn("decision", decision)


STATE = "first_us long, last_us long, visits long, credits long, deferred long"


def fold_cell(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """State of one cell, one arrival after another; the output is the state after the batch."""
    first, last, visits, credits, deferred = state.get if state.exists else (None, None, 0, 0, 0)
    rows = pd.concat(list(batches)).sort_values(["at_us", "activity_id"])
    for at in rows["at_us"].tolist():
        visits += 1
        if last is not None and at < last:
            deferred += 1
        else:
            credits += last is None or at - last >= REARM_US
            last = at
        first = at if first is None else min(first, at)
    state.update((first, last, visits, int(credits), deferred))
    yield pd.DataFrame([[*key, first, last, visits, int(credits), deferred]], columns=["user_id", "cell", "first_us", "last_us", "visits", "credits", "deferred"])
