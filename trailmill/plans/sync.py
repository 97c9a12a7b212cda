"""Synchronisation over customers as accounts and orders as what their sources list, with SQL."""

from pyspark.sql import functions as F

from trailmill.operators import sync as s
from trailmill.sources.tables import table

NOW = "TIMESTAMP_NTZ'2000-01-01 00:00:00'"


def accounts(spark, sf_dir):
    k = F.col("c_custkey")
    status = F.when(k % 13 == 0, "EXPIRED").when(k % 17 == 0, "DISCONNECTED").when(k % 19 > 0, "ACTIVE")
    mark = F.when(k % 3 > 0, F.expr(f"{NOW} - make_dt_interval(CAST(c_custkey % 2000 AS INT))"))
    return table(spark, sf_dir, "customer").select(k.alias("user_id"), F.lit("watch").alias("source"), status.alias("status"), mark.alias("watermark"))


def listed(spark, sf_dir, windows):
    """Orders since the account's window; some cannot be fetched, some listings break off."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    rows = o.select(
        F.col("o_custkey").alias("user_id"), F.lit("watch").alias("source"), F.when(k % 101 > 0, k.cast("string")).alias("external_id"), F.when(k % 101 > 0, F.col("o_orderdate")).alias("started_at"),
        F.when(k % 101 == 0, F.when(k % 2 == 0, "reauth").otherwise("TimeoutError")).when(k % 23 == 0, "ValueError").alias("error"), F.col("o_orderdate").alias("at"),
    )
    since = windows.filter("status = 'ACTIVE'").select("user_id", "source", "list_from")
    return rows.join(since, s.ACCOUNT).filter(F.col("at") > F.col("list_from")).drop("at", "list_from")


def receipts(spark, sf_dir):
    k = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("QUEUED", "DONE", "FAILED", "PROCESSING"))), (k % 4 + 1).cast("int"))
    key = s.ingest_key(F.lit("watch"), F.col("o_custkey"), k.cast("string"))
    return table(spark, sf_dir, "orders").filter("o_orderkey % 3 = 0").select(key.alias("ingest_key"), status.alias("status"), F.when(k % 5 > 0, k % 2).alias("attempts"))


def _outcomes(spark, sf_dir, nightly, hold):
    windows = s.windows(accounts(spark, sf_dir), F.expr(NOW), nightly)
    rows = listed(spark, sf_dir, windows)
    return s.outcomes(windows, rows, s.judged(rows, receipts(spark, sf_dir)), hold)


def sync_outcomes(spark, sf_dir):
    return _outcomes(spark, sf_dir, False, False)


def sync_jobs(spark, sf_dir):
    """What a round enqueues."""
    windows = s.windows(accounts(spark, sf_dir), F.expr(NOW))
    found = s.judged(listed(spark, sf_dir, windows), receipts(spark, sf_dir))
    return found.filter("enqueue AND error IS NULL").select("user_id", "source", "external_id", "started_at", "ingest_key")


def nightly_sweep(spark, sf_dir):
    return s.sweep_totals(_outcomes(spark, sf_dir, True, True))


def sweep_watermarks(spark, sf_dir):
    return _outcomes(spark, sf_dir, True, True).select("user_id", "kind", "watermark")


QUERIES = {f.__name__: f for f in (sync_outcomes, sync_jobs, nightly_sweep, sweep_watermarks)}


def _sql(nightly: bool, hold: bool) -> str:
    start = "least(previous, TIMESTAMP '1999-12-18')" if nightly else "previous"
    return f"""WITH a AS (SELECT c_custkey AS user_id, CASE WHEN c_custkey % 13 = 0 THEN 'EXPIRED' WHEN c_custkey % 17 = 0 THEN 'DISCONNECTED' WHEN c_custkey % 19 > 0 THEN 'ACTIVE' END AS status,
        CASE WHEN c_custkey % 3 > 0 THEN TIMESTAMP '2000-01-01' - to_days(CAST(c_custkey % 2000 AS INT)) END AS mark FROM customer),
      w AS (SELECT *, {start} AS list_from FROM (SELECT *, coalesce(mark, TIMESTAMP '1999-12-02') AS previous FROM a WHERE status IS NOT NULL AND status <> 'DISCONNECTED')),
      l AS (SELECT user_id, o_orderkey AS k, o_orderdate AS at_, o_orderkey % 101 = 0 AS cut, o_orderkey % 101 > 0 AND o_orderkey % 23 = 0 AS bad,
          o_orderkey % 3 > 0 OR (o_orderkey % 4 = 0 AND coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 2 END, 0) = 0) AS again
        FROM orders JOIN w ON user_id = o_custkey WHERE status = 'ACTIVE' AND o_orderdate > list_from),
      p AS (SELECT user_id, count(*) FILTER (NOT cut AND NOT bad AND again) AS q, count(*) FILTER (NOT cut AND NOT bad AND NOT again) AS known, min(at_) FILTER (bad) AS gap, max(at_) FILTER (NOT cut AND NOT bad) AS last,
          min(CASE WHEN k % 2 = 0 THEN 'reauth' ELSE 'TimeoutError' END) FILTER (cut) AS broke, coalesce(bool_or(k % 2 = 0) FILTER (cut), false) AS reauth FROM l GROUP BY 1),
      r AS (SELECT w.user_id, mark, q, known, gap, last, broke, status <> 'ACTIVE' OR coalesce(reauth, false) AS conn, CASE WHEN gap IS NOT NULL THEN 'ValueError' ELSE broke END AS detail FROM w LEFT JOIN p USING (user_id)),
      o AS (SELECT user_id, 'watch' AS source, CASE WHEN conn THEN 'reconnect' WHEN detail IS NOT NULL THEN 'failed' WHEN gap IS NULL AND last IS NULL THEN 'nothing-new' ELSE 'queued' END AS kind,
        CAST(CASE WHEN conn THEN 0 ELSE coalesce(q, 0) END AS BIGINT) AS queued, CAST(CASE WHEN conn THEN 0 ELSE coalesce(known, 0) END AS BIGINT) AS already_known, CASE WHEN NOT conn THEN detail END AS detail,
        CASE WHEN conn OR (gap IS NULL AND last IS NULL) {"OR broke IS NOT NULL" if hold else ""} THEN mark ELSE coalesce(gap, last) - INTERVAL 48 HOUR END AS watermark FROM r)"""


ORACLE_SQL = {
    "sync_outcomes": f"{_sql(False, False)} SELECT * FROM o",
    "sync_jobs": f"{_sql(False, False)} SELECT user_id, 'watch' AS source, CAST(k AS VARCHAR) AS external_id, at_ AS started_at, sha256('watch:' || user_id || ':' || k) AS ingest_key FROM l WHERE again AND NOT bad AND NOT cut",
    "nightly_sweep": f"""{_sql(True, True)} SELECT CAST(sum(queued + already_known) AS BIGINT) AS seen, CAST(sum(queued) AS BIGINT) AS enqueued, CAST(sum(already_known) AS BIGINT) AS already_present,
      count(*) FILTER (kind = 'failed') AS failed, count(*) FILTER (kind = 'reconnect') AS reconnect FROM o""",
    "sweep_watermarks": f"{_sql(True, True)} SELECT user_id, kind, watermark FROM o",
}
