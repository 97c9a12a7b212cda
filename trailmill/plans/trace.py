"""Queries of the trace and text operators, with their SQL."""

from pyspark.sql import functions as F

from trailmill.functions import geo, text
from trailmill.operators import trace as t
from trailmill.sources.tables import POINTS_SQL, points

#: The driver's events lie hours apart, so times are scaled to hours and speeds with them.
HOUR_MS = 3_600_000


def gap_split(spark, sf_dir):
    return t.split_gaps(points(spark, sf_dir), 6 * HOUR_MS).groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def point_clean(spark, sf_dir):
    return t.clean(points(spark, sf_dir)).groupBy("user_id", F.coalesce("reject", F.lit("kept")).alias("reject")).agg(F.count("*").alias("n"))


def speed_split(spark, sf_dir):
    return t.split_implausible(points(spark, sf_dir), 0.9, 12_000.0, 12 * 3600.0).groupBy("user_id", "segment").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def dwell_islands(spark, sf_dir):
    return t.dwell_islands(points(spark, sf_dir), 0.1, 3600.0)


def speed_gate(spark, sf_dir):
    return t.gate_speed(points(spark, sf_dir), 0.5).select("user_id", F.col("kept").cast("long").alias("kept"), F.col("rejected").cast("long").alias("rejected"))


def densify(spark, sf_dir):
    return t.densify(points(spark, sf_dir), 2_000.0).groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("lat"), 3).alias("lat_sum"))


def haversine(spark, sf_dir):
    return t.steps(points(spark, sf_dir)).select("user_id", "seq", F.round("m", 3).alias("m"), F.round("s", 3).alias("s"), F.round(geo.speed(F.col("m"), F.col("s")), 6).alias("speed"))


def bearings(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("seq")
    p = points(spark, sf_dir).withColumns({"lat0": F.lag("lat").over(w), "lng0": F.lag("lng").over(w)}).filter("lat0 IS NOT NULL AND (lat0 <> lat OR lng0 <> lng)")
    b = geo.bearing(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng"))
    return p.select("user_id", "seq", F.round(b, 3).alias("bearing"), geo.compass(F.round(b, 3)).alias("word"))


def fidelity_floor(spark, sf_dir):
    return t.fidelity(points(spark, sf_dir), 6 * HOUR_MS, 86_400).select("user_id", F.round("median_ms", 3).alias("median_ms"), F.round("span_s", 3).alias("span_s"), "violates")


def arc_positions(spark, sf_dir):
    return t.arc_positions(points(spark, sf_dir)).select("user_id", "seq", F.round("so_far", 2).alias("so_far"), F.round("arc", 6).alias("arc"))


def trace_boxes(spark, sf_dir):
    return t.boxes(points(spark, sf_dir))


def mercator(spark, sf_dir):
    x, y = geo.mercator(F.col("lat"), F.col("lng"))
    return points(spark, sf_dir).select("user_id", "seq", F.round(x, 8).alias("x"), F.round(y, 8).alias("y"))


def fnv1a(spark, sf_dir):
    name = F.concat(F.col("o_orderkey").cast("string"), F.lit("\x00"), F.col("o_orderpriority"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.fnv1a(name).alias("hash"))


def clock_text(spark, sf_dir):
    c = text.clock(F.col("o_orderkey"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", c.alias("clock"), text.seconds_of(c).alias("seconds"))


def number_words(spark, sf_dir):
    """No SQL: checked against a plain version in the tests."""
    n = F.col("o_orderkey") * 37
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select(n.alias("n"), text.number_words(n).alias("words"), text.ordinal_words(n).alias("ordinal"))


QUERIES = {
    f.__name__: f
    for f in (
        gap_split, point_clean, speed_split, dwell_islands, speed_gate, densify, haversine, bearings, fidelity_floor, arc_positions, trace_boxes, mercator,
        fnv1a, clock_text, number_words,
    )
}


def _metres(a: str, b: str, c: str, d: str) -> str:
    return f"""2 * 6371008.8::DOUBLE * asin(sqrt(0::DOUBLE + sin(radians({c} - {a}) / 2) * sin(radians({c} - {a}) / 2)
      + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) * sin(radians({d} - {b}) / 2)))"""


_STEPS = f"""p AS ({POINTS_SQL}), steps AS (SELECT *, {_metres('lat0', 'lng0', 'lat', 'lng')} AS m, (t_ms - t0) / 1000 AS s FROM (
  SELECT *, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0, lag(t_ms) OVER w AS t0 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY seq)))"""
_SPEED = "CASE WHEN s > 0 THEN m / s WHEN m > 0 THEN 'infinity'::DOUBLE WHEN m IS NOT NULL THEN 0 END"

ORACLE_SQL = {
    "gap_split": f"""WITH {_STEPS} SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(seq) AS first_seq FROM (
      SELECT *, sum(CASE WHEN t_ms - t0 > {6 * HOUR_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS segment FROM steps) GROUP BY 1, 2""",
    "point_clean": f"""WITH p AS ({POINTS_SQL}), f AS (SELECT *, accuracy > 50 AS bad FROM p), g AS (SELECT *, coalesce(bad, false) AS b FROM f),
      h AS (SELECT *, lag(lat) OVER w = lat AND lag(lng) OVER w = lng AS same FROM g WINDOW w AS (PARTITION BY user_id, b ORDER BY seq))
      SELECT user_id, CASE WHEN b THEN 'accuracy' WHEN same THEN 'duplicate' ELSE 'kept' END AS reject, count(*) AS n FROM h GROUP BY 1, 2""",
    "speed_split": f"""WITH {_STEPS} SELECT user_id, CAST(segment AS BIGINT) AS segment, count(*) AS n, min(seq) AS first_seq FROM (
      SELECT *, sum(CASE WHEN s IS NOT NULL AND ({_SPEED} > 0.9 OR (m > 12000 AND s > 43200)) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS segment FROM steps) GROUP BY 1, 2""",
    "dwell_islands": f"""WITH {_STEPS} SELECT user_id, CAST(island AS BIGINT) AS island, min(seq) AS first_seq, count(*) AS n, (max(t_ms) - min(t_ms)) / 1000 AS seconds,
      count(*) > 1 AND (max(t_ms) - min(t_ms)) / 1000 >= 3600 AS dwell FROM (
      SELECT *, sum(CASE WHEN s IS NULL OR {_SPEED} >= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM steps) GROUP BY 1, 2""",
    "densify": f"""WITH p AS ({POINTS_SQL}), e AS (SELECT *, {_metres('lat', 'lng', 'lat2', 'lng2')} AS m FROM (SELECT *, lead(lat) OVER w AS lat2, lead(lng) OVER w AS lng2 FROM p WINDOW w AS (PARTITION BY user_id ORDER BY seq))),
      n AS (SELECT *, CAST(CASE WHEN lat2 IS NULL THEN 1 ELSE greatest(1, ceil(m / 2000)) END AS INT) AS n, CASE WHEN lat2 IS NULL THEN 0 ELSE m / 6371008.8::DOUBLE END AS d FROM e),
      k AS (SELECT *, k / n::DOUBLE AS f FROM (SELECT *, unnest(range(n)) AS k FROM n)),
      s AS (SELECT *, CASE WHEN sin(d) = 0 THEN 0 ELSE sin((1 - f) * d) / sin(d) END AS s1, CASE WHEN sin(d) = 0 THEN 0 ELSE sin(f * d) / sin(d) END AS s2 FROM k),
      v AS (SELECT *, s1 * cos(radians(lat)) * cos(radians(lng)) + s2 * cos(radians(coalesce(lat2, lat))) * cos(radians(coalesce(lng2, lng))) AS x,
        s1 * cos(radians(lat)) * sin(radians(lng)) + s2 * cos(radians(coalesce(lat2, lat))) * sin(radians(coalesce(lng2, lng))) AS y, s1 * sin(radians(lat)) + s2 * sin(radians(coalesce(lat2, lat))) AS z FROM s)
      SELECT user_id, count(*) AS n, round(sum(CASE WHEN sin(d) = 0 THEN lat ELSE degrees(atan2(z, sqrt(x * x + y * y))) END), 3) AS lat_sum FROM v GROUP BY 1""",
    "speed_gate": f"""WITH RECURSIVE p AS ({POINTS_SQL}), g AS (
      SELECT user_id, seq, t_ms, lat, lng, 1 AS kept, 0 AS rejected FROM p WHERE seq = 1
      UNION ALL SELECT user_id, seq, CASE WHEN ok THEN t2 ELSE t_ms END, CASE WHEN ok THEN lat2 ELSE lat END, CASE WHEN ok THEN lng2 ELSE lng END,
        kept + CASE WHEN ok THEN 1 ELSE 0 END, rejected + CASE WHEN ok THEN 0 ELSE 1 END
      FROM (SELECT *, NOT ({_SPEED} > 0.5) AS ok FROM (SELECT g.user_id, p.seq, g.t_ms, g.lat, g.lng, g.kept, g.rejected, p.t_ms AS t2, p.lat AS lat2, p.lng AS lng2,
        {_metres('g.lat', 'g.lng', 'p.lat', 'p.lng')} AS m, (p.t_ms - g.t_ms) / 1000 AS s FROM g JOIN p ON p.user_id = g.user_id AND p.seq = g.seq + 1)))
      SELECT user_id, CAST(max(kept) AS BIGINT) AS kept, CAST(max(rejected) AS BIGINT) AS rejected FROM g GROUP BY 1""",
    "haversine": f"WITH {_STEPS} SELECT user_id, seq, round(m, 3) AS m, round(s, 3) AS s, round({_SPEED}, 6) AS speed FROM (SELECT * FROM steps)",
    "bearings": f"""WITH {_STEPS}, b AS (SELECT user_id, seq, round(fmod(degrees(atan2(sin(radians(lng - lng0)) * cos(radians(lat)),
        cos(radians(lat0)) * sin(radians(lat)) - sin(radians(lat0)) * cos(radians(lat)) * cos(radians(lng - lng0)))) + 360, 360), 3) AS bearing
      FROM steps WHERE lat0 IS NOT NULL AND (lat0 <> lat OR lng0 <> lng))
      SELECT user_id, seq, bearing, ['north', 'north-east', 'east', 'south-east', 'south', 'south-west', 'west', 'north-west'][CAST(floor(bearing / 45 + 0.5) AS INT) % 8 + 1] AS word FROM b""",
    "fidelity_floor": f"""WITH {_STEPS} SELECT user_id, round(median(t_ms - t0), 3) AS median_ms, round((max(t_ms) - min(t_ms)) / 1000, 3) AS span_s,
      coalesce(median(t_ms - t0) > {6 * HOUR_MS} AND (max(t_ms) - min(t_ms)) / 1000 >= 86400, false) AS violates FROM steps GROUP BY 1""",
    "arc_positions": f"""WITH {_STEPS}, a AS (SELECT *, sum(coalesce(m, 0)) OVER (PARTITION BY user_id ORDER BY seq) AS so_far FROM steps)
      SELECT user_id, seq, round(so_far, 2) AS so_far, round(CASE WHEN total > 0 THEN so_far / total ELSE 0 END, 6) AS arc FROM (SELECT *, max(so_far) OVER (PARTITION BY user_id) AS total FROM a)""",
    "trace_boxes": f"WITH p AS ({POINTS_SQL}) SELECT user_id, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north FROM p GROUP BY 1",
    "mercator": f"WITH p AS ({POINTS_SQL}) SELECT user_id, seq, round((lng + 180) / 360, 8) AS x, round(0.5 - ln(tan(pi() / 4 + radians(lat) / 2)) / (2 * pi()), 8) AS y FROM p",
    "fnv1a": """SELECT o_orderkey, list_reduce(list_prepend(2166136261::BIGINT, list_transform(string_split(o_orderkey || chr(0) || o_orderpriority, ''), lambda c: unicode(c)::BIGINT)),
      lambda h, c: (xor(h, c) * 16777619) & 4294967295) AS hash FROM orders""",
    "clock_text": """SELECT o_orderkey, CASE WHEN o_orderkey >= 3600 THEN printf('%d:%02d:%02d', o_orderkey // 3600, o_orderkey // 60 % 60, o_orderkey % 60)
      ELSE printf('%d:%02d', o_orderkey // 60 % 60, o_orderkey % 60) END AS clock, o_orderkey AS seconds FROM orders""",
}
