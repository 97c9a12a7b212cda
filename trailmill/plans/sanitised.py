"""Queries of the sanitising chain over envelopes with faults of every kind, with their SQL."""

from pyspark.sql import functions as F

from trailmill.operators import intake as i
from trailmill.operators import routes
from trailmill.operators import sanitise as s
from trailmill.plans.intake import _KIND, _SPORT, SPORTS, _pick
from trailmill.plans.places import _SPEED, _metres
from trailmill.sources.tables import table, tasks

#: Orders whose envelopes one task writes and reads: their work is far more than the orders' bytes.
TASK_ENVELOPES = 10_000
#: And orders whose points, about a million, one task sorts.
TASK_WALKS = 50_000


def faulty_envelopes(spark, sf_dir):
    """Orders as envelopes of up to 40 points: leaps, bad first points, pauses, slow sampling, and eight faults that refuse an activity."""
    k = F.col("o_orderkey")
    n = F.when(k % 29 == 0, 0).otherwise(k % 39 + 2).cast("int")
    at = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    joined = lambda f, over=at: F.concat(F.lit("["), F.array_join(F.transform(over, f), ","), F.lit("]"))
    off = lambda x: F.when((k + x * 7) % 17 == 0, 50).when((k % 5 == 0) & (x == 1), 70).otherwise(0)
    tens = lambda v: F.concat(F.floor(v / 10_000).cast("string"), F.lit("."), F.lpad((v % 10_000).cast("string"), 4, "0"))
    places = joined(lambda x: F.when((k % 53 == 0) & (x == 2), "[1.5]").otherwise(F.concat(F.lit("["), tens(k % 80 * 10_000 + x + off(x)), F.lit(","), tens(k % 170 * 10_000 + x), F.lit("]"))))
    step = F.when(k % 13 == 0, 20).otherwise(3)
    time = lambda x: x * step + F.when((x > 5) & (k % 4 == 0), 100).otherwise(0)
    shorter = F.slice(at, F.lit(1), F.when(k % 31 == 0, F.greatest(F.size(at) - 1, F.lit(0))).otherwise(F.size(at)))
    times = F.when(k % 7 > 0, F.concat(F.lit(',"time":{"data":'), joined(lambda x: F.when((k % 59 == 0) & (x == 2), "null").otherwise(time(x).cast("string")), shorter), F.lit("}"))).otherwise("")
    streams = F.when(n == 0, "null").otherwise(F.concat(F.lit('{"latlng":{"data":'), places, F.lit("}"), times, F.lit("}")))
    stamp = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    start = F.date_format("o_orderdate", stamp)
    raw = F.concat(
        F.lit('{"schemaVersion":'), F.when(k % 50 == 0, "2").otherwise("1"), F.lit(',"source":"watch","detail":{"id":'), F.when(k % 61 == 0, "null").otherwise(k.cast("string")),
        F.lit(',"sport_type":"'), _pick(SPORTS, k), F.lit('","start_date":"'), F.when(k % 47 == 0, "soon").otherwise(start), F.lit('","start_date_local":"'),
        F.when(k % 37 == 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm")).otherwise(start), F.lit('","timezone":"'), F.when(k % 41 == 0, "(GMT+01:00) Europe/Nowhere").otherwise("(GMT+01:00) Europe/Paris"),
        F.lit('"},"streams":'), streams, F.lit("}"),
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    orders = orders.repartition(tasks(spark, sf_dir, "orders", TASK_ENVELOPES), "o_orderkey")
    return orders.select((F.col("o_custkey") % 20).alias("user_id"), raw.alias("raw"))


def sanitised_activities(spark, sf_dir):
    done = s.activities(s.refusals(i.read_envelopes(faulty_envelopes(spark, sf_dir))))
    return done.select("user_id", F.coalesce("external_id", F.lit("")).alias("external_id"), "kind", "bad", *(c for c in done.columns if c not in ("user_id", "external_id", "kind", "bad")))


def sanitised_parts(spark, sf_dir):
    """What is left of the traces, on through cleaning, dwells and jumps, per activity."""
    points = s.flagged_points(s.refusals(i.read_envelopes(faulty_envelopes(spark, sf_dir))))
    walks = s.sanitised_points(points).select(F.struct("user_id", "external_id", "segment").alias("user_id"), "seq", "t_ms", "lat", "lng", F.lit(None).cast("double").alias("accuracy"))
    parts = routes.parts(walks, 30_000, 0.5, 60.0, 12.5, 250.0, 120.0, tasks(spark, sf_dir, "orders", TASK_WALKS))
    return parts.groupBy("user_id.user_id", "user_id.external_id").agg(
        F.count("*").alias("n"), F.count_distinct(F.col("user_id.segment"), "part").alias("parts"), F.round(F.sum("lat"), 5).alias("lat_sum"), F.sum("t_ms").alias("t_sum")
    )


QUERIES = {f.__name__: f for f in (sanitised_activities, sanitised_parts)}

_SIZE = "CASE WHEN k % 29 = 0 THEN 0 ELSE k % 39 + 2 END"
_BAD = """CASE WHEN k % 50 = 0 THEN 'no envelope' WHEN k % 61 = 0 THEN 'no id' WHEN k % 47 = 0 THEN 'no start' WHEN k % 37 = 0 THEN 'no local time' WHEN k % 41 = 0 THEN 'unknown zone'
  WHEN n > 0 AND k % 31 = 0 AND k % 7 > 0 THEN 'streams of unequal length' WHEN n > 1 AND k % 53 = 0 THEN 'no place' WHEN n > 1 AND k % 7 > 0 AND k % 59 = 0 THEN 'no time of a point' END"""
_CHAIN = f"""WITH RECURSIVE o AS (SELECT *, {_BAD} AS refused FROM (SELECT o_custkey % 20 AS user_id, o_orderkey AS k, {_SIZE} AS n, {_SPORT} AS sport, epoch_ms(o_orderdate) AS start_ms FROM orders)),
  a AS (SELECT *, {_KIND} AS kind FROM o),
  p AS (SELECT k, x AS seq, CASE WHEN kind IN ('run', 'walk', 'hike', 'strength') THEN 12.5 ELSE 30.0 END AS gate,
      CAST((k % 80) || '.' || lpad(CAST(x + CASE WHEN (k + x * 7) % 17 = 0 THEN 50 WHEN k % 5 = 0 AND x = 1 THEN 70 ELSE 0 END AS VARCHAR), 4, '0') AS DOUBLE) AS lat, CAST((k % 170) || '.' || lpad(CAST(x AS VARCHAR), 4, '0') AS DOUBLE) AS lng,
      start_ms + CASE WHEN k % 7 > 0 THEN x * CASE WHEN k % 13 = 0 THEN 20 ELSE 3 END + CASE WHEN x > 5 AND k % 4 = 0 THEN 100 ELSE 0 END ELSE x - 1 END * 1000 AS t_ms
    FROM (SELECT *, unnest(range(1, n + 1)) AS x FROM a WHERE refused IS NULL AND n > 0)),
  steps AS (SELECT k, seq, gate, {_SPEED} AS v FROM (SELECT k, seq, gate, {_metres('lat0', 'lng0', 'lat', 'lng')} AS m, (t_ms - t0) / 1000.0::DOUBLE AS sec FROM (SELECT *, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0, lag(t_ms) OVER w AS t0 FROM p WINDOW w AS (PARTITION BY k ORDER BY seq)))),
  anchor AS (SELECT k, CASE WHEN max(v) FILTER (seq = 2) > any_value(gate) AND max(v) FILTER (seq = 3) <= any_value(gate) THEN 2 ELSE 1 END AS first FROM steps GROUP BY 1),
  g AS (SELECT k, seq, seq AS at_, lat, lng, t_ms, true AS kept, false AS open_, false AS broke FROM p JOIN anchor USING (k) WHERE seq = first
    UNION ALL SELECT k, seq, CASE WHEN ok THEN seq ELSE at_ END, CASE WHEN ok THEN lat2 ELSE lat END, CASE WHEN ok THEN lng2 ELSE lng END, CASE WHEN ok THEN t2 ELSE t_ms END, ok, NOT ok, ok AND open_
      FROM (SELECT *, NOT {_SPEED} > gate AS ok FROM (SELECT p.k, p.seq, g.at_, g.lat, g.lng, g.t_ms, g.open_, p.gate, p.lat AS lat2, p.lng AS lng2, p.t_ms AS t2, {_metres('g.lat', 'g.lng', 'p.lat', 'p.lng')} AS m, (p.t_ms - g.t_ms) / 1000.0::DOUBLE AS sec
        FROM g JOIN p ON p.k = g.k AND p.seq = g.seq + 1))),
  kept AS (SELECT k, seq, lat, lng, t_ms, broke, t_ms - lag(t_ms) OVER (PARTITION BY k ORDER BY seq) AS gap FROM g WHERE kept),
  cut AS (SELECT *, CAST(sum(CASE WHEN coalesce(gap > 30000, false) OR broke THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY seq) AS BIGINT) AS segment FROM kept),
  shape AS (SELECT k, count(*) AS n_points, count(*) FILTER (broke) AS breaks, max(segment) + 1 AS segments, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north, median(gap) AS mid, max(t_ms) - min(t_ms) AS span FROM cut GROUP BY 1),
  traced AS (SELECT shape.*, n - n_points AS rejected, CASE WHEN n_points < 2 THEN NULL WHEN k % 7 = 0 THEN 'no time stream' WHEN span >= 60000 AND mid > 1000 / 0.3::DOUBLE THEN 'too few points' END AS violation FROM shape JOIN a USING (k))"""

ORACLE_SQL = {
    "sanitised_activities": f"""{_CHAIN} SELECT user_id, CASE WHEN k % 50 = 0 OR k % 61 = 0 THEN '' ELSE CAST(k AS VARCHAR) END AS external_id, CASE WHEN k % 50 = 0 THEN 'other' ELSE kind END AS kind,
      coalesce(refused, violation) AS bad, n_points, breaks, segments, west, south, east, north, rejected FROM a LEFT JOIN traced USING (k)""",
}
