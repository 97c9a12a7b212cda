"""Queries of the places, routes and views operators, with their SQL."""

from pyspark.sql import functions as F

from trailmill.functions import geo
from trailmill.operators import discovery as d
from trailmill.operators import places as p
from trailmill.operators import recount, routes, trace
from trailmill.operators import views as v
from trailmill.plans.discovery import CLASSIFIED_SQL
from trailmill.sources.tables import ACTIVITIES_SQL, POINTS_SQL, SETS_SQL, VISITS_SQL, activities, points, sets, table, visits

HOUR_MS = 3_600_000
#: Splits of the stand-in walks, hours and kilometres in place of seconds and metres.
WALK = {"gap_ms": 30 * HOUR_MS, "slow": 0.1, "least_s": 3600.0, "teleport": 0.9, "jump_m": 12_000.0, "jump_s": 12 * 3600.0}


def named_places(spark, sf_dir):
    """(name, kind, population, lat, lng): customers strewn over the grounds of the walks."""
    k = F.col("c_custkey")
    user = k % 150
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("place "), (k % 1200).cast("string")).alias("name"),
        F.element_at(F.array(*map(F.lit, ("locality", "neighbourhood", "peak"))), (k % 3 + 1).cast("int")).alias("kind"),
        F.when(k % 4 > 0, k % 9 * 100).alias("population"),
        ((user % 140 - 70) + (k % 11) * 0.012).cast("double").alias("lat"),
        ((user * 7 % 360 - 180) + (k % 7) * 0.023).cast("double").alias("lng"),
    )


def nearest_places(spark, sf_dir):
    asked = points(spark, sf_dir).select("user_id", "seq", "lat", "lng")
    return p.nearest_named(asked, named_places(spark, sf_dir), 2500.0, 9, "user_id", "seq").select("user_id", "seq", "name", F.round("m", 1).alias("m"))


def prominent_places(spark, sf_dir):
    return p.prominent_named(p.padded(trace.boxes(points(spark, sf_dir)), 500.0), named_places(spark, sf_dir), "user_id")


def run_starts(spark, sf_dir):
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 5).alias("user_id"), e.alias("activity_id"), F.col("ts").alias("started_at"), ((e % 97) * 0.37 - 18).cast("double").alias("lat"), ((e % 89) * 0.41 - 18).cast("double").alias("lng")
    )


def run_regions(spark, sf_dir):
    box = ("west", "south", "east", "north")
    r = p.regions(run_starts(spark, sf_dir)).withColumn("label", p.coordinate_label(*map(F.col, box)))
    return r.select("user_id", "region", "n", *[F.round(c, 6).alias(c) for c in box], "latest_at", "label")


def streets_returned(spark, sf_dir):
    cells = d.classify_history(visits(spark, sf_dir)).filter("class = 'rearmed'")
    street = F.when(F.col("cell") % 7 > 0, F.concat(F.lit("street "), (F.col("cell") % 40).cast("string")))
    return p.returned_to(cells.select("user_id", "activity_id", F.col("previous_at").alias("since"), "started_at", street.alias("street")), "user_id", "activity_id")


def _middles(spark, sf_dir):
    s = recount.segments(points(spark, sf_dir), "user_id")
    lat, lng = (F.col("lat0") + F.col("lat")) / 2, (F.col("lng0") + F.col("lng")) / 2
    m = geo.metres(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng"))
    return s.select("user_id", "seq", m.alias("m"), F.pmod(F.floor(lat * 100) * 31 + F.floor(lng * 100), F.lit(300)).alias("cell"))


def ground_metres(spark, sf_dir):
    """Metres of the walks by class of the ground under their steps' middles."""
    steps = _middles(spark, sf_dir)
    name = F.element_at(F.array(*map(F.lit, ("new", "rearmed", "recent"))), ((F.col("cell") + F.col("user_id")) % 3 + 1).cast("int"))
    ground = steps.select("user_id", "cell").distinct().withColumn("class", name)
    return p.ground_split(steps, ground, "user_id").select("user_id", *[F.round(c, 2).alias(c) for c in ("new_m", "rearmed_m", "recent_m")])


def walk_parts(spark, sf_dir):
    rows = routes.parts(points(spark, sf_dir), **WALK)
    return rows.groupBy("user_id", "segment", "part").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"), F.round(F.sum("lat"), 4).alias("lat_sum"), F.round(F.sum("lng"), 4).alias("lng_sum"), F.sum("t_ms").alias("t_sum"))


def walk_lines(spark, sf_dir):
    return routes.lines(trace.split_gaps(points(spark, sf_dir), 30 * HOUR_MS), "user_id", "segment")


def walk_samples(spark, sf_dir):
    s = routes.samples(points(spark, sf_dir), 500.0)
    return s.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.max("at_m"), 2).alias("length_m"), F.round(F.avg("at_m"), 2).alias("mean_m"), F.round(F.sum("lat"), 3).alias("lat_sum"))


def walk_simplified(spark, sf_dir):
    """No SQL: the splitting of a line goes by its farthest vertex again and again; held against plain Python."""
    return routes.simplified(trace.split_gaps(points(spark, sf_dir), 30 * HOUR_MS), 2_000.0)


def track_files(spark, sf_dir):
    """The walks as track files, read again."""
    at = F.date_format(F.timestamp_millis("t_ms"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    spot = F.concat(F.lit('<trkpt lat="'), F.col("lat").cast("string"), F.lit('" lon="'), F.col("lng").cast("string"), F.lit('"><time>'), at, F.lit("</time></trkpt>"))
    rows = trace.split_gaps(points(spark, sf_dir), 30 * HOUR_MS).groupBy("user_id", "segment").agg(F.array_sort(F.collect_list(F.struct("seq", spot.alias("s")))).alias("spots"))
    segment = F.concat(F.lit("<trkseg>"), F.array_join("spots.s", ""), F.lit("</trkseg>"))
    files = rows.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("segment", segment.alias("s")))).alias("segments"))
    raw = files.select("user_id", F.concat(F.lit('<gpx version="1.1"><trk>'), F.array_join("segments.s", ""), F.lit("</trk></gpx>")).alias("xml"))
    return routes.read_tracks(raw, "user_id").select("user_id", F.col("segment").cast("long").alias("segment"), F.col("seq").cast("long").alias("seq"), "t_ms", "lat", "lng")


def walk_ends(spark, sf_dir):
    return routes.last_ends(points(spark, sf_dir))


def score_keys(spark, sf_dir):
    walks = points(spark, sf_dir).withColumn("started_at", F.lit("2020-01-01T00:00:00Z"))
    return v.trace_digest(walks, "user_id").select("user_id", v.score_key(F.lit("watch"), F.col("user_id"), F.col("digest"), 3).alias("score_key"))


def home_map(spark, sf_dir):
    """Cells explored but for those of a user's first run."""
    seen = visits(spark, sf_dir)
    first = activities(spark, sf_dir).groupBy("user_id").agg(F.min_by("activity_id", F.struct("started_at", "activity_id")).alias("activity_id"))
    held = seen.join(first.select("activity_id"), "activity_id", "left_semi")
    return v.without_held(seen.select("user_id", "cell").distinct(), held)


def reads_by_id(spark, sf_dir):
    k = F.col("o_orderkey")
    asked = table(spark, sf_dir, "orders").select(F.when(k % 5 == 0, (F.col("o_custkey") + 1) % 20).otherwise(F.col("o_custkey") % 20).alias("user_id"), F.when(k % 7 == 0, -k).otherwise(k).alias("activity_id"))
    return v.read_by_id(asked, activities(spark, sf_dir))


def row_windows(spark, sf_dir):
    k = F.col("o_orderkey")
    first, end = v.row_window(k % 5000 - 100, F.when(k % 3 > 0, k % 900).otherwise(0), k % 120, 44)
    return table(spark, sf_dir, "orders").select("o_orderkey", first.alias("first_row"), end.alias("end_row"))


def logged_shares(spark, sf_dir):
    return v.logged_shares(sets(spark, sf_dir)).select("activity_id", "pos", "share")


def backfill_cursors(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    previous = F.when(F.col("user_id") % 2 == 0, "2000-01-01 00:00:00").otherwise("2030-01-01 00:00:00").cast("timestamp_ntz")
    return v.backfill_cursor(e.select("user_id", previous.alias("previous"), F.when(F.col("event_id") % 3 > 0, F.col("ts")).alias("at")))


def new_shares(spark, sf_dir):
    a = v.new_share(d.awards(d.classify_history(visits(spark, sf_dir)), "activity_id"))
    return a.select("activity_id", F.round("new_share", 6).alias("new_share"))


def update_plans(spark, sf_dir):
    k = F.col("o_orderkey")
    generation = F.when(k % 13 > 0, k % 40 + 1)
    plan = v.update_plan(k % 43, generation, F.greatest(F.lit(0), generation - 20))
    return table(spark, sf_dir, "orders").select("o_orderkey", plan.alias("plan"))


def merged_holds(spark, sf_dir):
    k = F.col("o_orderkey")

    def hold(n, pending):
        cells = F.when(n == 1, F.array().cast("array<bigint>")).when(n > 1, F.array(n, n + k % 3 + 1, n + 9))
        return F.struct((k % pending == 0).alias("pending"), cells.alias("cells"))

    rows = table(spark, sf_dir, "orders").withColumn("held", v.merged_holds(hold(k % 5, 17), hold(F.floor(k / 5) % 6, 19)))
    return rows.select("o_orderkey", "held.pending", F.array_join(F.sort_array("held.cells"), ",").alias("cells"))


def rate_status(spark, sf_dir):
    e, at = F.col("event_id"), F.unix_millis(F.col("ts").cast("timestamp"))
    header = F.when(e % 7 == 0, "100").when(e % 11 == 0, None).otherwise(F.concat((e % 100).cast("string"), F.lit(" , "), (e % 1000).cast("string")))
    rows = table(spark, sf_dir, "events").select("event_id", v.rate_pair(header).alias("p"), v.next_boundary(at, 900_000).alias("next_quarter"), v.next_boundary(at, 86_400_000).alias("next_midnight"))
    return rows.select("event_id", F.col("p.quarter").alias("used_quarter"), F.col("p.day").alias("used_day"), "next_quarter", "next_midnight")


QUERIES = {
    f.__name__: f
    for f in (
        nearest_places, prominent_places, run_regions, streets_returned, ground_metres, walk_parts, walk_lines, walk_samples, walk_simplified, track_files, walk_ends,
        score_keys, home_map, reads_by_id, row_windows, logged_shares, backfill_cursors, new_shares, update_plans, merged_holds, rate_status,
    )
}

_PLACES = """places AS (SELECT 'place ' || (c_custkey % 1200) AS name, ['locality', 'neighbourhood', 'peak'][c_custkey % 3 + 1] AS kind, CASE WHEN c_custkey % 4 > 0 THEN c_custkey % 9 * 100 END AS population,
  CAST((c_custkey % 150 % 140 - 70) + (c_custkey % 11) * 0.012::DOUBLE AS DOUBLE) AS plat, CAST((c_custkey % 150 * 7 % 360 - 180) + (c_custkey % 7) * 0.023::DOUBLE AS DOUBLE) AS plng FROM customer)"""


def _metres(a: str, b: str, c: str, d: str) -> str:
    return f"2 * 6371008.8::DOUBLE * asin(least(1, sqrt(sin(radians({c} - {a}) / 2) ** 2 + cos(radians({a})) * cos(radians({c})) * sin(radians({d} - {b}) / 2) ** 2)))"


_SEGMENTS = f"s AS (SELECT *, {_metres('lat0', 'lng0', 'lat', 'lng')} AS m FROM (SELECT *, lag(lat) OVER w AS lat0, lag(lng) OVER w AS lng0, lag(t_ms) OVER w AS t0 FROM ({POINTS_SQL}) WINDOW w AS (PARTITION BY user_id ORDER BY seq)))"
_SPLIT = f"split AS (SELECT *, CAST(sum(CASE WHEN t_ms - t0 > {30 * HOUR_MS} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS segment FROM s)"
_AWAY = "sqrt((k.x - g.x) * (k.x - g.x) + (k.y - g.y) * (k.y - g.y))"
_LABEL = "printf('%.1f', abs((south + north) / 2)) || '°' || CASE WHEN (south + north) / 2 < 0 THEN 'S' ELSE 'N' END || ' ' || printf('%.1f', abs((west + east) / 2)) || '°' || CASE WHEN (west + east) / 2 < 0 THEN 'W' ELSE 'E' END"


def _stepped(source: str, *keys: str) -> str:
    by = ", ".join(keys)
    return f"""(SELECT *, {_metres('la', 'lo', 'lat', 'lng')} AS m, (t_ms - t) / 1000.0::DOUBLE AS sec FROM (SELECT *, lag(lat) OVER w AS la, lag(lng) OVER w AS lo, lag(t_ms) OVER w AS t
      FROM {source} WINDOW w AS (PARTITION BY {by} ORDER BY seq)))"""


_SPEED = "CASE WHEN sec > 0 THEN m / sec WHEN m > 0 THEN 'infinity'::DOUBLE WHEN m IS NOT NULL THEN 0 END"

ORACLE_SQL = {
    "update_plans": """WITH g AS (SELECT o_orderkey, o_orderkey % 43 AS since, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 40 + 1 END AS gen FROM orders)
      SELECT o_orderkey, CASE WHEN gen IS NULL THEN 'empty' WHEN since = gen THEN 'up-to-date' WHEN since > 0 AND since >= gen - 20 AND since < gen THEN 'delta' ELSE 'full' END AS plan FROM g""",
    "merged_holds": """WITH n AS (SELECT o_orderkey AS k, o_orderkey % 5 AS x, o_orderkey // 5 % 6 AS y FROM orders),
      h AS (SELECT k, k % 17 = 0 OR k % 19 = 0 AS pending, CASE WHEN x = 1 THEN [] WHEN x > 1 THEN [x, x + k % 3 + 1, x + 9] END AS a, CASE WHEN y = 1 THEN [] WHEN y > 1 THEN [y, y + k % 3 + 1, y + 9] END AS b FROM n)
      SELECT k AS o_orderkey, pending, CASE WHEN NOT pending AND (a IS NOT NULL OR b IS NOT NULL) THEN array_to_string(list_sort(list_distinct(coalesce(a, []) || coalesce(b, []))), ',') END AS cells FROM h""",
    "rate_status": """SELECT event_id, CASE WHEN event_id % 7 > 0 AND event_id % 11 > 0 THEN event_id % 100 END AS used_quarter, CASE WHEN event_id % 7 > 0 AND event_id % 11 > 0 THEN event_id % 1000 END AS used_day,
      (epoch_ms(ts) // 900000 + 1) * 900000 AS next_quarter, (epoch_ms(ts) // 86400000 + 1) * 86400000 AS next_midnight FROM events""",
    "nearest_places": f"""WITH {_PLACES}, p AS ({POINTS_SQL}), n AS (SELECT user_id, seq, name, round(sqrt(((plng - lng) * cos(radians(lat))) ** 2 + (plat - lat) ** 2) * 111320, 3) AS m
        FROM p JOIN places ON plat BETWEEN lat - 0.03 AND lat + 0.03)
      SELECT user_id, seq, min_by(name, (m, name)) AS name, round(min(m), 1) AS m FROM n WHERE m <= 2500 GROUP BY 1, 2""",
    "prominent_places": f"""WITH {_PLACES}, b AS (SELECT user_id, min(lng) AS w, min(lat) AS s, max(lng) AS e, max(lat) AS n FROM ({POINTS_SQL}) GROUP BY 1),
      q AS (SELECT *, 500 / 111320.0::DOUBLE AS dy, 500::DOUBLE / (greatest(0.01, cos(radians((s + n) / 2))) * 111320) AS dx FROM b)
      SELECT user_id, min_by(name, (CASE kind WHEN 'locality' THEN 1 WHEN 'neighbourhood' THEN 2 ELSE 3 END, -coalesce(population, 0), name)) AS name
      FROM q JOIN places ON plng BETWEEN w - dx AND e + dx AND plat BETWEEN s - dy AND n + dy GROUP BY 1""",
    "run_regions": f"""WITH RECURSIVE r AS (SELECT user_id % 5 AS u, event_id AS a, ts, CAST((event_id % 97) * 0.37::DOUBLE - 18 AS DOUBLE) AS lat, CAST((event_id % 89) * 0.41::DOUBLE - 18 AS DOUBLE) AS lng FROM events),
      e AS (SELECT x.u, x.a AS a, y.a AS b FROM r x JOIN r y ON x.u = y.u AND y.lat BETWEEN x.lat - 0.46 AND x.lat + 0.46 WHERE {_metres('x.lat', 'x.lng', 'y.lat', 'y.lng')} <= 50000),
      reach AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a), c AS (SELECT a, min(b) AS region FROM reach GROUP BY 1),
      g AS (SELECT u AS user_id, region, count(*) AS n, min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north, max(ts) AS latest_at FROM r JOIN c USING (a) GROUP BY 1, 2)
      SELECT user_id, region, n, round(west, 6) AS west, round(south, 6) AS south, round(east, 6) AS east, round(north, 6) AS north, latest_at, {_LABEL} AS label FROM g""",
    "streets_returned": f"""WITH {CLASSIFIED_SQL}, s AS (SELECT user_id, activity_id, 'street ' || (cell % 40) AS street, count(*) AS c, min((epoch_ms(started_at) - epoch_ms(previous_at)) // 86400000) AS gap
        FROM classified WHERE class = 'rearmed' AND cell % 7 > 0 GROUP BY 1, 2, 3)
      SELECT user_id, activity_id, min_by(street, (-c, street)) AS street, min_by(gap, (-c, street)) AS gap_days FROM s GROUP BY 1, 2""",
    "ground_metres": f"""WITH {_SEGMENTS}, g AS (SELECT user_id, m, ((CAST(floor((lat0 + lat) / 2 * 100) AS BIGINT) * 31 + CAST(floor((lng0 + lng) / 2 * 100) AS BIGINT)) % 300 + 300) % 300 AS cell FROM s WHERE m > 0)
      SELECT user_id, {', '.join(f"round(coalesce(sum(m) FILTER ((cell + user_id) % 3 = {i}), 0), 2) AS {c}_m" for i, c in enumerate(('new', 'rearmed', 'recent')))} FROM g GROUP BY 1""",
    "walk_parts": f"""WITH RECURSIVE {_SEGMENTS}, {_SPLIT}, good AS (SELECT * FROM (SELECT user_id, segment, seq, t_ms, lat, lng, lag(lat) OVER w = lat AND lag(lng) OVER w = lng AS same
        FROM split WHERE NOT coalesce(accuracy > 50, false) WINDOW w AS (PARTITION BY user_id, segment ORDER BY seq)) WHERE NOT coalesce(same, false)),
      isl AS (SELECT *, sum(CASE WHEN sec IS NULL OR {_SPEED} >= 0.1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, segment ORDER BY seq) AS island FROM {_stepped('good', 'user_id', 'segment')}),
      marked AS (SELECT user_id, segment, seq, t_ms, lat, lng, island, count(*) OVER w > 1 AND (max(t_ms) OVER w - min(t_ms) OVER w) / 1000 >= 3600 AS dwell FROM isl WINDOW w AS (PARTITION BY user_id, segment, island)),
      k AS (SELECT *, lng * f AS x, lat AS y FROM (SELECT *, cos(radians(avg(lat) OVER (PARTITION BY user_id, segment, island))) AS f FROM marked WHERE dwell)),
      g AS (SELECT user_id, segment, island, 0 AS i, avg(x) AS x, avg(y) AS y FROM k GROUP BY 1, 2, 3
        UNION ALL SELECT g.user_id, g.segment, g.island, g.i + 1, CASE WHEN bool_or({_AWAY} = 0) THEN g.x ELSE sum(k.x / {_AWAY}) / sum(1 / {_AWAY}) END,
          CASE WHEN bool_or({_AWAY} = 0) THEN g.y ELSE sum(k.y / {_AWAY}) / sum(1 / {_AWAY}) END
        FROM g JOIN k ON g.user_id = k.user_id AND g.segment = k.segment AND g.island = k.island WHERE g.i < 32 GROUP BY g.user_id, g.segment, g.island, g.i, g.x, g.y),
      still AS (SELECT user_id, segment, seq, t_ms, lat, lng FROM marked WHERE NOT dwell
        UNION ALL SELECT o.user_id, o.segment, o.seq, o.t_ms, g.y, g.x / o.f FROM g JOIN (SELECT user_id, segment, island, min(seq) AS seq, CAST(floor((min(t_ms) + max(t_ms)) / 2 + 0.5) AS BIGINT) AS t_ms, min(f) AS f FROM k GROUP BY 1, 2, 3) o
          ON g.user_id = o.user_id AND g.segment = o.segment AND g.island = o.island WHERE g.i = 32),
      cut AS (SELECT *, CAST(sum(CASE WHEN sec IS NOT NULL AND ({_SPEED} > 0.9 OR (m > 12000 AND sec > 43200)) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, segment ORDER BY seq) AS BIGINT) AS part FROM {_stepped('still', 'user_id', 'segment')})
      SELECT user_id, segment, part, count(*) AS n, min(seq) AS first_seq, round(sum(lat), 4) AS lat_sum, round(sum(lng), 4) AS lng_sum, CAST(sum(t_ms) AS BIGINT) AS t_sum FROM cut GROUP BY 1, 2, 3""",
    "walk_lines": f"""WITH {_SEGMENTS}, {_SPLIT} SELECT user_id, segment, count(*) AS n, '[' || string_agg(printf('[%.6f,%.6f]', lng, lat), ',' ORDER BY seq) || ']' AS line FROM split GROUP BY 1, 2 HAVING count(*) >= 2""",
    "walk_samples": f"""WITH {_SEGMENTS}, t AS (SELECT *, sum(d) OVER (PARTITION BY user_id ORDER BY seq) AS upto, CAST(greatest(1, ceil(d / 500)) AS INT) AS n FROM (SELECT *, CASE WHEN lat0 IS NULL THEN 0 ELSE m END AS d FROM s)),
      x AS (SELECT *, unnest(range(n)) AS k FROM t), y AS (SELECT *, CASE WHEN k = 0 THEN 1 ELSE k / n::DOUBLE END AS part FROM x)
      SELECT user_id, count(*) AS n, round(max(upto - d * (1 - part)), 2) AS length_m, round(avg(upto - d * (1 - part)), 2) AS mean_m, round(sum(CASE WHEN k = 0 THEN lat ELSE lat0 + (lat - lat0) * part END), 3) AS lat_sum FROM y GROUP BY 1""",
    "track_files": f"WITH {_SEGMENTS}, {_SPLIT} SELECT user_id, segment, row_number() OVER (PARTITION BY user_id, segment ORDER BY seq) - 1 AS seq, t_ms, lat, lng FROM split",
    "walk_ends": f"SELECT user_id, max_by(lat, seq) AS lat, max_by(lng, seq) AS lng FROM ({POINTS_SQL}) GROUP BY 1",
    "score_keys": f"""WITH p AS ({POINTS_SQL}), t AS (SELECT user_id, string_agg('{{"lat":' || regexp_replace(CAST(lat AS VARCHAR), '\\.0$', '') || ',"lng":' || regexp_replace(CAST(lng AS VARCHAR), '\\.0$', '')
        || ',"t":' || t_ms || '}}', ',' ORDER BY seq) AS s FROM p GROUP BY 1)
      SELECT user_id, 'watch#' || user_id || '#' || substr(sha256('{{"points":[' || s || '],"startedAt":"2020-01-01T00:00:00Z"}}'), 1, 16) || '#v3' AS score_key FROM t""",
    "home_map": f"""WITH v AS ({VISITS_SQL}), f AS (SELECT user_id, min_by(activity_id, (started_at, activity_id)) AS a FROM ({ACTIVITIES_SQL}) GROUP BY 1)
      SELECT DISTINCT user_id, cell FROM v WHERE NOT EXISTS (SELECT 1 FROM v h JOIN f ON h.activity_id = f.a WHERE h.user_id = v.user_id AND h.cell = v.cell)""",
    "reads_by_id": f"""WITH a AS ({ACTIVITIES_SQL}), q AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN (o_custkey + 1) % 20 ELSE o_custkey % 20 END AS user_id, CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey ELSE o_orderkey END AS activity_id FROM orders)
      SELECT q.user_id, q.activity_id, CASE WHEN a.activity_id IS NULL THEN 'missing' ELSE 'found' END AS result, a.started_at FROM q LEFT JOIN a ON a.activity_id = q.activity_id AND a.user_id = q.user_id AND status <> 'TOMBSTONED'""",
    "row_windows": """WITH w AS (SELECT o_orderkey, greatest(0, o_orderkey % 5000 - 100) AS top, CASE WHEN o_orderkey % 3 > 0 AND o_orderkey % 900 > 0 THEN o_orderkey % 900 ELSE 1000 END AS h, o_orderkey % 120 AS n FROM orders)
      SELECT o_orderkey, CAST(CASE WHEN n = 0 THEN 0 ELSE greatest(0, least(n - 1, top // 44) - 8) END AS BIGINT) AS first_row, CAST(CASE WHEN n = 0 THEN 0 ELSE least(n, ceil((top + h) / 44.0) + 8) END AS BIGINT) AS end_row FROM w""",
    "logged_shares": f"""SELECT activity_id, pos, CASE WHEN count(*) OVER w > 1 AND min(duration_s) OVER w > 0 AND min(exercise) OVER w <> max(exercise) OVER w
        THEN CAST(floor(duration_s / (sum(duration_s) OVER w)::DOUBLE * 100 + 0.5) AS BIGINT) || '%' END AS share FROM ({SETS_SQL}) WINDOW w AS (PARTITION BY activity_id)""",
    "backfill_cursors": """WITH c AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN TIMESTAMP '2000-01-01' ELSE TIMESTAMP '2030-01-01' END AS previous, max(ts) FILTER (event_id % 3 > 0) AS newest FROM events GROUP BY 1, 2)
      SELECT user_id, greatest(previous, coalesce(date_trunc('second', newest) - INTERVAL 1 SECOND, previous)) AS cursor FROM c""",
    "new_shares": f"WITH {CLASSIFIED_SQL} SELECT activity_id, round(count(*) FILTER (class = 'new') / count(*)::DOUBLE, 6) AS new_share FROM classified GROUP BY 1",
}
