"""Queries of the intake operators over texts made of the driver tables, with their SQL."""

from pyspark.sql import functions as F

from trailmill.operators import intake as i
from trailmill.sources.tables import POINTS_SQL, points, table

SPORTS = ("Run", "TrailRun", "Walk", "Hike", "GravelRide", "WeightTraining", "Kitesurf", "EBikeRide", "VirtualRun", "Crossfit", "Workout")


def _pick(names, at):
    return F.element_at(F.array(*map(F.lit, names)), (at % len(names) + 1).cast("int"))


def envelopes(spark, sf_dir):
    """Orders as archived envelopes: ids beyond 2**53 as numbers, false Z, zones with offsets, odd distances, streams or none."""
    k = F.col("o_orderkey")
    local = F.expr("o_orderdate + make_dt_interval(0, CAST(o_orderkey % 5 AS INT), CAST(o_orderkey % 60 AS INT), 0)")
    n = (k % 7).cast("int")
    at = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda x: x)
    joined = lambda f: F.concat(F.lit("["), F.array_join(F.transform(at, f), ","), F.lit("]"))
    places = joined(lambda x: F.concat(F.lit("["), (k % 90).cast("string"), F.lit("."), x.cast("string"), F.lit(","), (k % 170).cast("string"), F.lit("]")))
    times = F.when(k % 4 > 0, F.concat(F.lit(',"time":{"data":'), joined(lambda x: (x * 3).cast("string")), F.lit("}"))).otherwise("")
    size, resolution = (n + (k % 3 == 0).cast("int")).cast("string"), F.when(k % 5 == 0, "low").otherwise("high")
    streams = F.when(n == 0, "null").otherwise(F.concat(F.lit('{"latlng":{"data":'), places, F.lit(',"original_size":'), size, F.lit(',"resolution":"'), resolution, F.lit('"}'), times, F.lit("}")))
    distance = F.when(k % 9 == 0, '"NaN"').when(k % 9 == 1, "null").otherwise(F.format_string("%.2f", "o_totalprice"))
    zone = F.when(k % 6 == 0, "null").when(k % 6 == 1, '"(GMT+00:00) "').otherwise(F.concat(F.lit('"(GMT+0'), (k % 5).cast("string"), F.lit(':00) Europe/Paris"')))
    stamp = "yyyy-MM-dd'T'HH:mm:ss'Z'"
    raw = F.concat(
        F.lit('{"schemaVersion":'), F.when(k % 50 == 0, "2").otherwise("1"), F.lit(',"source":"watch","detail":{"id":90071992547409930'), k.cast("string"),
        F.lit(',"distance":'), distance, F.lit(',"elapsed_time":'), (k % 5000).cast("string"), F.lit(',"sport_type":"'), _pick(SPORTS, k), F.lit('","start_date":"'),
        F.date_format("o_orderdate", stamp), F.lit('","start_date_local":"'), F.date_format(local, stamp), F.lit('","timezone":'), zone, F.lit('},"streams":'), streams, F.lit("}"),
    )
    return table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("user_id"), raw.alias("raw"))


def normalised_activities(spark, sf_dir):
    return i.normalise(i.read_envelopes(envelopes(spark, sf_dir)))


def zipped_points(spark, sf_dir):
    return i.trace_points(i.read_envelopes(envelopes(spark, sf_dir)).filter("envelope IS NOT NULL")).drop("altitude")


def walk_anchors(spark, sf_dir):
    return i.anchors(points(spark, sf_dir), 0.5, "user_id").withColumn("anchor", F.col("anchor").cast("long"))


def manual_entries(spark, sf_dir):
    """Order lines as sets of an entry an order."""
    s = F.struct(
        F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity").cast("int")).alias("reps"),
        F.when(F.col("l_linenumber") % 3 == 1, (F.col("l_quantity") * 10).cast("int")).alias("durationS"),
        F.when(F.col("l_linenumber") % 3 == 2, F.col("l_quantity") * 100).alias("distanceM"),
    )
    sets = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", s.alias("s")))).alias("sets"))
    k = F.col("o_orderkey")
    raw = F.to_json(
        F.struct(
            k.cast("string").alias("idempotencyKey"), F.when(k % 40 > 0, _pick(("pushup", "plank", "treadmill"), k)).alias("exerciseId"),
            F.when(k % 30 > 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("soon").alias("occurredAt"),
            F.when(k % 2 == 0, "(GMT+09:00) Asia/Tokyo").alias("timezone"), F.transform("sets", lambda x: x["s"]).alias("sets"),
        )
    )
    orders = table(spark, sf_dir, "orders").join(sets, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return i.read_entries(orders.select((F.col("o_custkey") % 20).alias("user_id"), raw.alias("raw")))


def typed_values(spark, sf_dir):
    q, k = F.col("l_quantity").cast("int"), F.col("l_orderkey")
    text = F.element_at(
        F.array(
            F.concat(q.cast("string"), F.lit(",5 km")), F.concat(F.lit(" "), q.cast("string"), F.lit(" min")), F.format_string("%d:%02d", q, (k % 60).cast("int")), q.cast("string"), F.lit("a lot")
        ),
        (k % 5 + 1).cast("int"),
    )
    entry = _pick(("distance", "minutes", "seconds", "count"), F.col("l_linenumber"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", entry.alias("entry"), i.parse_value(entry, text).alias("value"))
    least = F.when(F.col("entry") == "distance", 0.1).otherwise(5.0)
    decimals = F.when(F.col("entry") == "distance", 1).otherwise(0)
    up = i.clamp(F.col("value") * 1.07 - 3, least, decimals)
    return rows.withColumn("stepped", up)


def apportioned(spark, sf_dir):
    k = F.col("o_orderkey")
    a, b = (k % 10) * 5, (F.floor(k / 10) % 11) * 5
    shares = F.array(*[F.struct(F.lit(p).alias("pos"), c.cast("long").alias("percent")) for p, c in enumerate((a, b, F.lit(100) - a - b))])
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 997 + 1).alias("duration_s"), F.explode(shares).alias("s"))
    return i.apportion(rows.select("o_orderkey", "duration_s", "s.pos", "s.percent"), "o_orderkey").withColumn("pos", F.col("pos").cast("long"))


def event_decisions(spark, sf_dir):
    """Events as notifications, every kind of fault among them."""
    e, u = F.col("event_id"), F.col("user_id")
    aspect = _pick(("create", "update", "delete", "update", "archive"), e)
    kind = F.when(e % 13 == 0, "athlete").otherwise("activity")
    raw = F.concat(
        F.lit('{"aspect_type":"'), aspect, F.lit('","object_type":"'), kind, F.lit('","owner_id":'), u.cast("string"), F.lit(',"object_id":'), F.when(e % 17 == 0, '"x"').otherwise(e.cast("string")),
        F.lit(',"subscription_id":'), F.when(e % 11 == 0, "8").otherwise("7"), F.when(e % 4 > 0, F.concat(F.lit(',"event_time":'), (e * 10).cast("string"))).otherwise(""),
        F.when(e % 19 == 0, ',"token":1').otherwise(""), F.when(e % 23 == 0, "").otherwise("}"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", F.when(u % 7 > 0, u).alias("user_id"), F.lit("watch").alias("source"), raw.alias("raw"))
    return i.decisions(rows, "7")


def watermarks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(
        "user_id", F.lit("2020-01-01 00:00:00").cast("timestamp_ntz").alias("previous"), F.col("ts").alias("at"), (F.col("value") < 120 - F.col("user_id") % 3 * 60).alias("confirmed")
    )
    return i.next_watermark(rows, 48 * 3600)


QUERIES = {f.__name__: f for f in (normalised_activities, zipped_points, walk_anchors, manual_entries, typed_values, apportioned, event_decisions, watermarks)}

_SPORT = "[" + ", ".join(f"'{s}'" for s in SPORTS) + f"][o_orderkey % {len(SPORTS)} + 1]"
_KIND = "CASE " + " ".join(f"WHEN sport IN ({', '.join(repr(s) for s in sports)}) THEN '{kind}'" for kind, sports in i.KINDS.items()) + " ELSE 'other' END"
_METRES = "2 * 6371008.8 * asin(least(1, sqrt(sin(radians(lat - lat0) / 2) ** 2 + cos(radians(lat0)) * cos(radians(lat)) * sin(radians(lng - lng0) / 2) ** 2)))"

ORACLE_SQL = {
    "normalised_activities": f"""WITH e AS (SELECT o_custkey % 20 AS user_id, '90071992547409930' || o_orderkey AS external_id, {_SPORT} AS sport, o_orderkey % 7 AS n, o_orderkey AS k,
        o_orderdate AS started_at, o_orderdate + to_hours(CAST(o_orderkey % 5 AS INT)) + to_minutes(CAST(o_orderkey % 60 AS INT)) AS started_local, o_totalprice FROM orders WHERE o_orderkey % 50 <> 0)
      SELECT user_id, 'watch' AS source, external_id, sha256(user_id || ':watch:' || external_id) AS activity_id, {_KIND} AS kind, sport AS source_type_raw, started_at, started_local,
        CASE WHEN k % 6 > 1 THEN 'Europe/Paris' END AS zone, user_id || '#' || strftime(started_local, '%Y-%m-%d') AS day_key, k % 5000 AS elapsed_s,
        CASE WHEN k % 9 > 1 THEN CAST(printf('%.2f', o_totalprice) AS DOUBLE) END AS distance_m, n > 0 AS has_trace, n > 0 AND (k % 3 = 0 OR k % 5 = 0) AS decimated FROM e""",
    "zipped_points": """WITH e AS (SELECT o_custkey % 20 AS user_id, o_orderkey AS k, epoch_ms(o_orderdate) AS start_ms, unnest(range(o_orderkey % 7)) AS s FROM orders WHERE o_orderkey % 50 <> 0)
      SELECT user_id, '90071992547409930' || k AS external_id, CAST(s AS INT) AS seq, CAST(start_ms + CASE WHEN k % 4 > 0 THEN (s + 1) * 3 ELSE s END * 1000 AS BIGINT) AS t_ms,
        CAST((k % 90) || '.' || (s + 1) AS DOUBLE) AS lat, CAST(k % 170 AS DOUBLE) AS lng FROM e""",
    "walk_anchors": f"""WITH p AS (SELECT *, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0, lag(t_ms) OVER w AS t0 FROM ({POINTS_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY seq)),
      v AS (SELECT user_id, seq, CASE WHEN t_ms > t0 THEN {_METRES} / ((t_ms - t0) / 1000.0::DOUBLE) WHEN {_METRES} > 0 THEN 'Infinity'::DOUBLE ELSE 0 END AS step FROM p WHERE seq <= 3)
      SELECT user_id, CAST(CASE WHEN max(step) FILTER (seq = 2) > 0.5 AND max(step) FILTER (seq = 3) <= 0.5 THEN 1 ELSE 0 END AS BIGINT) AS anchor FROM v GROUP BY 1""",
    "manual_entries": """WITH s AS (SELECT l_orderkey, CAST(coalesce(sum(CAST(l_quantity * 10 AS INT)) FILTER (l_linenumber % 3 = 1), 0) AS BIGINT) AS elapsed_s,
        sum(l_quantity * 100) FILTER (l_linenumber % 3 = 2) AS distance_m FROM lineitem GROUP BY 1),
      e AS (SELECT o_custkey % 20 AS user_id, o_orderkey AS k, CASE WHEN o_orderkey % 30 > 0 THEN o_orderdate END AS at_, s.* FROM orders LEFT JOIN s ON o_orderkey = l_orderkey)
      SELECT user_id, sha256('manual:' || user_id || ':' || k) AS ingest_key, CASE WHEN k % 40 > 0 THEN ['pushup', 'plank', 'treadmill'][k % 3 + 1] END AS exercise, at_ AS started_at,
        CASE WHEN k % 2 = 0 THEN at_ + INTERVAL 9 HOUR ELSE at_ END AS started_local, distance_m, elapsed_s,
        CASE WHEN k % 40 = 0 THEN 'no exercise' WHEN at_ IS NULL THEN 'no time' WHEN l_orderkey IS NULL THEN 'no sets' END AS bad FROM e""",
    "typed_values": """WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_quantity AS INT) AS q, l_orderkey % 5 AS form, l_orderkey % 60 AS s,
        ['distance', 'minutes', 'seconds', 'count'][l_linenumber % 4 + 1] AS entry FROM lineitem),
      v AS (SELECT *, CAST(CASE WHEN form = 3 THEN q WHEN entry = 'distance' AND form = 0 THEN q + 0.5 WHEN entry = 'minutes' AND form = 1 THEN q WHEN entry = 'seconds' AND form = 2 THEN q * 60 + s END AS DOUBLE) AS value FROM t)
      SELECT l_orderkey, l_linenumber, entry, value, CASE WHEN entry = 'distance' THEN coalesce(greatest(0.1::DOUBLE, floor((value * 1.07::DOUBLE - 3) * 10 + 0.5::DOUBLE) / 10), 0.1)
        ELSE coalesce(greatest(5.0::DOUBLE, floor(value * 1.07::DOUBLE - 3 + 0.5::DOUBLE)), 5.0) END AS stepped FROM v""",
    "apportioned": """WITH o AS (SELECT o_orderkey, o_custkey % 997 + 1 AS d, (o_orderkey % 10) * 5 AS a, (o_orderkey // 10 % 11) * 5 AS b FROM orders),
      s AS (SELECT o_orderkey, d, unnest([0, 1, 2]) AS pos, unnest([a, b, 100 - a - b]) AS percent FROM o), f AS (SELECT *, d * percent // 100 AS part FROM s WHERE percent > 0)
      SELECT o_orderkey, CAST(pos AS BIGINT) AS pos, CAST(percent AS BIGINT) AS percent, CAST(part + CASE WHEN row_number() OVER (PARTITION BY o_orderkey ORDER BY percent DESC, pos) = 1
        THEN d - sum(part) OVER (PARTITION BY o_orderkey) ELSE 0 END AS BIGINT) AS seconds FROM f""",
    "event_decisions": """WITH e AS (SELECT event_id AS e, user_id AS u, ['create', 'update', 'delete', 'update', 'archive'][event_id % 5 + 1] AS aspect FROM events),
      d AS (SELECT *, CASE WHEN e % 23 = 0 THEN 'unparseable' WHEN e % 19 = 0 THEN 'unknown-fields' WHEN e % 11 = 0 THEN 'wrong-subscription' WHEN e % 13 = 0 THEN 'ignored-object-type'
        WHEN aspect = 'archive' THEN 'ignored-aspect' WHEN e % 17 = 0 THEN 'malformed-ids' WHEN aspect = 'update' AND (e % 4 = 0 OR e = 0) THEN 'missing-event-time' WHEN u % 7 = 0 THEN 'unknown-owner'
        WHEN aspect = 'delete' THEN 'retract' WHEN aspect = 'update' THEN 'reingest' ELSE 'enqueue' END AS decision FROM e)
      SELECT e AS event_id, CASE WHEN u % 7 > 0 THEN u END AS user_id, decision, CASE decision WHEN 'retract' THEN sha256('watch:' || u || ':' || e || ':delete') WHEN 'enqueue' THEN sha256('watch:' || u || ':' || e)
        WHEN 'reingest' THEN sha256('watch:' || u || ':' || e || ':update:' || e * 10) END AS ingest_key FROM d""",
    "watermarks": """WITH l AS (SELECT user_id, ts, value < 120 - user_id % 3 * 60 AS ok FROM events)
      SELECT user_id, coalesce(min(ts) FILTER (NOT ok), max(ts) FILTER (ok)) - INTERVAL 48 HOUR AS watermark FROM l GROUP BY 1""",
}
