"""One round of synchronisation over all accounts: windows, what to enqueue, outcomes, next watermarks.

Accounts are (user_id, source, status, watermark); listings come from adapters
or any other table of (user_id, source, external_id, started_at, error), where
a row without an id says that a listing broke off.  All of it is joins and
groupings by account; rows of one account are pre-aggregated before they meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FIRST_LOOKBACK_DAYS = 30
OVERLAP_S = 48 * 3600
NIGHTLY_S = 14 * 24 * 3600
ACCOUNT = ["user_id", "source"]


def _seconds(n: int) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


def windows(accounts: DataFrame, now: Column, nightly: bool = False) -> DataFrame:
    """Adds ``previous`` and ``list_from`` to the accounts that are connected: a first round looks back 30 days, a nightly one 14 at least."""
    previous = F.coalesce("watermark", now - _seconds(FIRST_LOOKBACK_DAYS * 86_400))
    start = F.least(previous, now - _seconds(NIGHTLY_S)) if nightly else previous
    return accounts.filter("status IS NOT NULL AND status <> 'DISCONNECTED'").withColumn("previous", previous).withColumn("list_from", start)


def ingest_key(source: Column, user: Column, external_id: Column) -> Column:
    return F.sha2(F.concat_ws(":", source, user.cast("string"), external_id), 256)


def judged(listed: DataFrame, receipts: DataFrame) -> DataFrame:
    """Adds ``ingest_key`` and ``enqueue`` to listed activities: without a receipt, or with one that was queued and never tried.

    ``receipts``: (ingest_key, status, attempts), unique keys.
    """
    known = receipts.select(F.col("ingest_key").alias("r_key"), F.col("status").alias("r_status"), F.coalesce("attempts", F.lit(0)).alias("r_attempts"))
    keyed = listed.filter("external_id IS NOT NULL").withColumn("ingest_key", ingest_key(F.col("source"), F.col("user_id"), F.col("external_id")))
    again = F.col("r_key").isNull() | ((F.col("r_status") == "QUEUED") & (F.col("r_attempts") == 0))
    return keyed.join(known, F.col("ingest_key") == F.col("r_key"), "left").withColumn("enqueue", F.coalesce(again, F.lit(False))).drop("r_key", "r_status", "r_attempts")


def outcomes(accounts: DataFrame, listed: DataFrame, found: DataFrame, hold: bool = False) -> DataFrame:
    """(user_id, source, kind, queued, already_known, detail, watermark) of every connected account.

    ``accounts`` as ``windows`` gives them.  The watermark is the oldest
    unconfirmed activity, else the newest confirmed, less the overlap; it stays
    where nothing was listed, where the account must be connected again, and,
    with ``hold``, where a listing broke off.
    """
    ok = F.col("error").isNull()
    per = found.groupBy(*ACCOUNT).agg(
        F.count_if(ok & F.col("enqueue")).alias("queued"), F.count_if(ok & ~F.col("enqueue")).alias("already_known"),
        F.min(F.when(~ok, F.col("started_at"))).alias("gap"), F.max(F.when(ok, F.col("started_at"))).alias("last"), F.min(F.when(~ok, F.struct("started_at", "external_id", "error"))).alias("first_bad"),
    )
    broken = listed.filter("external_id IS NULL").groupBy(*ACCOUNT).agg(F.min("error").alias("broke"), F.bool_or(F.col("error") == "reauth").alias("reauth"))
    rows = accounts.join(per, ACCOUNT, "left").join(broken, ACCOUNT, "left")
    again = (F.col("status") != "ACTIVE") | F.coalesce("reauth", F.lit(False))
    nothing = F.col("gap").isNull() & F.col("last").isNull()
    detail = F.coalesce("first_bad.error", "broke")
    kind = F.when(again, "reconnect").when(detail.isNotNull(), "failed").when(nothing, "nothing-new").otherwise("queued")
    stays = again | nothing | (F.lit(hold) & F.col("broke").isNotNull())
    following = F.coalesce("gap", "last") - _seconds(OVERLAP_S)
    count = lambda c: F.when(again, 0).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return rows.select(*ACCOUNT, kind.alias("kind"), count("queued"), count("already_known"), F.when(~again, detail).alias("detail"), F.when(stays, F.col("watermark")).otherwise(following).alias("watermark"))


def sweep_totals(done: DataFrame) -> DataFrame:
    """One row: what a sweep saw, enqueued, knew, and how many accounts failed or must be connected again."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias
    return done.agg(
        total(F.col("queued") + F.col("already_known"))("seen"), total("queued")("enqueued"), total("already_known")("already_present"),
        F.count_if(F.col("kind") == "failed").alias("failed"), F.count_if(F.col("kind") == "reconnect").alias("reconnect"),
    )
