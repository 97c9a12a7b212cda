"""Queries of real ground: hexagon cells of walks, what they reveal, metres by its class, territory; with their SQL."""

import functools

import numpy as np
from pyspark.sql import functions as F

from trailmill.functions import hexgrid
from trailmill.operators import cells as c
from trailmill.operators import discovery as d
from trailmill.operators import places as p
from trailmill.operators import routes
from trailmill.operators.rearm import first_to_rearm
from trailmill.plans.places import _AWAY, _SPEED, _metres, _stepped
from trailmill.sources.tables import TRAILS_SQL, trails

#: Splits of a walk in seconds and metres.
TRAIL = {"gap_ms": 30_000, "slow": 0.5, "least_s": 60.0, "teleport": 12.5, "jump_m": 250.0, "jump_s": 120.0}
WALK = ("user_id", "segment")


def parts(spark, sf_dir):
    return routes.parts(trails(spark, sf_dir), **TRAIL)


def run_cells(spark, sf_dir):
    """The ground of each walk between two gaps; walks of a user start 40 days apart."""
    started = F.expr("TIMESTAMP_NTZ'2020-01-01 00:00:00' + make_dt_interval(CAST(40 * segment AS INT))")
    return c.corridor(parts(spark, sf_dir), *WALK).withColumns({"activity_id": F.col("segment"), "started_at": started})


def point_cells(spark, sf_dir):
    """Every point, and the centre of its cell."""
    at = trails(spark, sf_dir).select("user_id", "seq", c.centre(c.cell_at(F.col("lat"), F.col("lng"))).alias("at"))
    return at.select("user_id", "seq", F.round("at.lat", 7).alias("lat"), F.round("at.lng", 7).alias("lng"))


def trail_reveals(spark, sf_dir):
    """Of each walk: cells revealed and where they lie, points left out, and parts."""
    walked = parts(spark, sf_dir)
    shown = c.corridor(walked, *WALK).withColumn("at", c.centre(F.col("cell"))).groupBy(*WALK).agg(
        F.count("*").alias("n_cells"), F.round(F.avg("at.lat"), 6).alias("lat"), F.round(F.avg("at.lng"), 6).alias("lng")
    )
    pieces = walked.groupBy(*WALK).agg(F.count_distinct("part").alias("parts"))
    return shown.join(pieces, [*WALK]).join(c.rejects(trails(spark, sf_dir), TRAIL["gap_ms"], *WALK), [*WALK])


def ground_runs(spark, sf_dir):
    """Metres of each walk by the class that its ground had: corridor, discovery, then the cell under the middle of each step."""
    classified = d.classify_history(run_cells(spark, sf_dir))
    name = F.when(F.col("class") == "cooled", "recent").otherwise(F.col("class"))
    metres = p.ground_split(c.middles(parts(spark, sf_dir), *WALK), classified.withColumn("class", name), *WALK)
    counts = d.awards(classified, *WALK)
    rounded = [F.round(F.coalesce(x, F.lit(0.0)), 3).alias(x) for x in ("new_m", "rearmed_m", "recent_m")]
    return counts.join(metres, [*WALK], "left").select(*WALK, "new_cells", "rearmed_cells", "cooled_cells", *rounded)


def cell_discs(spark, sf_dir):
    """No SQL: discs around the cells of each user's points, resolutions 3, 7 and 11; held against plain Python."""
    at = trails(spark, sf_dir).select("user_id", F.explode(F.array(*[c.cell_at(F.col("lat"), F.col("lng"), r) for r in (3, 7, 11)])).alias("cell")).distinct()
    return at.select("user_id", "cell", F.array_sort(c.disc(F.col("cell"), 2)).alias("disc"))


def territories(spark, sf_dir):
    """No SQL: area and border of each user's ground; held against plain Python."""
    ground = c.territory(run_cells(spark, sf_dir), "user_id")
    return ground.withColumn("area_km2", F.round("area_km2", 9))


def ground_bridges(spark, sf_dir):
    """No SQL: neighbouring cells of a user's ground."""
    return c.bridged(run_cells(spark, sf_dir), "user_id")


def rearm_near_runs(spark, sf_dir):
    """No SQL: the cell around each walk, and not in it, that rearms first."""
    return first_to_rearm(run_cells(spark, sf_dir), functools.partial(c.discs_of, k=d.NEAR_RINGS))


QUERIES = {f.__name__: f for f in (point_cells, trail_reveals, ground_runs, cell_discs, territories, ground_bridges, rearm_near_runs)}

# SQL has no ids: a cell is its face and place there, and a walk's cells are all places around its edges, tried one by one.
_SCALE = complex(hexgrid.plane(hexgrid.scale(c.RES)))
_FACES = ", ".join("(" + ", ".join(map(repr, [f, *(float(x) for axis in hexgrid.faces() for x in axis[f])])) + ")" for f in range(20))
_FACE_TABLE = f"faces(f, cx, cy, cz, ix, iy, iz, jx, jy, jz) AS (VALUES {_FACES})"
_ROOT = "0.8660254037844386::DOUBLE"


def _vector(lat: str, lng: str) -> str:
    return f"cos(radians({lat})) * cos(radians({lng})) AS vx, cos(radians({lat})) * sin(radians({lng})) AS vy, sin(radians({lat})) AS vz"


def _vector_of(lat: str, lng: str) -> str:
    """The same as the fields of a struct."""
    return ", ".join(f"'{name}': {value}" for value, name in (x.split(" AS ") for x in _vector(lat, lng).split(", ")))


def _dot(v: str, axis: str) -> str:
    return f"({v}x * {axis}x + {v}y * {axis}y + {v}z * {axis}z)"


def _place(v: str) -> str:
    """Lattice coordinates a + b w of a vector on the joined face."""
    re, im = f"{_dot(v, 'i')} / {_dot(v, 'c')} / {hexgrid.UNIT}::DOUBLE", f"{_dot(v, 'j')} / {_dot(v, 'c')} / {hexgrid.UNIT}::DOUBLE"
    x, y = f"({re} * {_SCALE.real}::DOUBLE - {im} * {_SCALE.imag}::DOUBLE)", f"({re} * {_SCALE.imag}::DOUBLE + {im} * {_SCALE.real}::DOUBLE)"
    return f"{x} - {y} / (2 * {_ROOT}) AS a, {y} / {_ROOT} AS b"


def _centre(a: str, b: str) -> str:
    """Degrees of the centre of a place on the joined face."""
    x, y, n = f"({a} + {b} / 2.0::DOUBLE)", f"({b} * {_ROOT})", abs(_SCALE) ** 2
    u = f"(({x} * {_SCALE.real}::DOUBLE + {y} * {_SCALE.imag}::DOUBLE) / {n}::DOUBLE * {hexgrid.UNIT}::DOUBLE)"
    v = f"(({y} * {_SCALE.real}::DOUBLE - {x} * {_SCALE.imag}::DOUBLE) / {n}::DOUBLE * {hexgrid.UNIT}::DOUBLE)"
    at = [f"(c{k} + {u} * i{k} + {v} * j{k})" for k in "xyz"]
    return f"degrees(atan2({at[2]}, sqrt({at[0]} ** 2 + {at[1]} ** 2))) AS clat, degrees(atan2({at[1]}, {at[0]})) AS clng"


_CUBE = """CASE WHEN abs(round(a) - a) > abs(round(b) - b) AND abs(round(a) - a) > abs(round(-a - b) + a + b) THEN -round(b) - round(-a - b) ELSE round(a) END AS a,
      CASE WHEN abs(round(b) - b) >= abs(round(a) - a) AND abs(round(b) - b) > abs(round(-a - b) + a + b) THEN -round(a) - round(-a - b) ELSE round(b) END AS b"""


def parts_sql(points: str, gap_ms: int, slow: float, least_s: float, teleport: float, jump_m: float, jump_s: float) -> str:
    """Common tables up to ``cut`` (user_id, segment, part, seq, lat, lng) and ``split`` with the accuracy of every point."""
    return f"""split AS (SELECT *, CAST(sum(CASE WHEN t_ms - t0 > {gap_ms} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS segment
        FROM (SELECT *, lag(t_ms) OVER (PARTITION BY user_id ORDER BY seq) AS t0 FROM ({points}))),
      judged AS (SELECT user_id, segment, seq, t_ms, lat, lng, coalesce(lag(lat) OVER w = lat AND lag(lng) OVER w = lng, false) AS same
        FROM split WHERE NOT coalesce(accuracy > 50, false) WINDOW w AS (PARTITION BY user_id, segment ORDER BY seq)),
      good AS (SELECT * FROM judged WHERE NOT same),
      isl AS (SELECT *, sum(CASE WHEN sec IS NULL OR {_SPEED} >= {slow} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, segment ORDER BY seq) AS island FROM {_stepped('good', 'user_id', 'segment')}),
      marked AS (SELECT user_id, segment, seq, t_ms, lat, lng, island, count(*) OVER w > 1 AND (max(t_ms) OVER w - min(t_ms) OVER w) / 1000 >= {least_s} AS dwell FROM isl WINDOW w AS (PARTITION BY user_id, segment, island)),
      k AS (SELECT *, lng * f AS x, lat AS y FROM (SELECT *, cos(radians(avg(lat) OVER (PARTITION BY user_id, segment, island))) AS f FROM marked WHERE dwell)),
      g AS (SELECT user_id, segment, island, 0 AS i, avg(x) AS x, avg(y) AS y FROM k GROUP BY 1, 2, 3
        UNION ALL SELECT g.user_id, g.segment, g.island, g.i + 1, CASE WHEN bool_or({_AWAY} = 0) THEN g.x ELSE sum(k.x / {_AWAY}) / sum(1 / {_AWAY}) END,
          CASE WHEN bool_or({_AWAY} = 0) THEN g.y ELSE sum(k.y / {_AWAY}) / sum(1 / {_AWAY}) END
        FROM g JOIN k ON g.user_id = k.user_id AND g.segment = k.segment AND g.island = k.island WHERE g.i < 32 GROUP BY g.user_id, g.segment, g.island, g.i, g.x, g.y),
      still AS (SELECT user_id, segment, seq, t_ms, lat, lng FROM marked WHERE NOT dwell
        UNION ALL SELECT o.user_id, o.segment, o.seq, o.t_ms, g.y, g.x / o.f FROM g JOIN (SELECT user_id, segment, island, min(seq) AS seq, CAST(floor((min(t_ms) + max(t_ms)) / 2 + 0.5) AS BIGINT) AS t_ms, min(f) AS f FROM k GROUP BY 1, 2, 3) o
          ON g.user_id = o.user_id AND g.segment = o.segment AND g.island = o.island WHERE g.i = 32),
      cut AS (SELECT *, CAST(sum(CASE WHEN sec IS NOT NULL AND ({_SPEED} > {teleport} OR (m > {jump_m} AND sec > {jump_s})) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, segment ORDER BY seq) AS BIGINT) AS part FROM {_stepped('still', 'user_id', 'segment')})"""


def _short(degrees: str) -> str:
    """A difference of longitudes, the short way round."""
    return f"(({degrees} + 540) % 360 - 180)"


_METRE = f"{6_371_008.8 * np.pi / 180}::DOUBLE"
_GROUND = f"""{_FACE_TABLE}, {parts_sql(TRAILS_SQL, **TRAIL)},
      paths AS (SELECT row_number() OVER () AS e, user_id, segment, lat AS lat1, lng AS lng1, coalesce(after_lat, lat) AS lat2, coalesce(after_lng, lng) AS lng2
        FROM (SELECT *, lead(lat) OVER w AS after_lat, lead(lng) OVER w AS after_lng, lag(lat) OVER w AS before FROM cut WINDOW w AS (PARTITION BY user_id, segment, part ORDER BY seq)) WHERE after_lat IS NOT NULL OR before IS NULL),
      faced AS (SELECT * FROM (SELECT paths.*, faces.*, row_number() OVER (PARTITION BY e ORDER BY {_dot('v', 'c')} DESC) AS nth
        FROM (SELECT *, {_vector('(lat1 + lat2) / 2', '(lng1 + ' + _short('lng2 - lng1') + ' / 2)')} FROM paths) AS paths, faces) WHERE nth <= 2),
      ends AS (SELECT e, f, {_place('v')} FROM (SELECT *, {_vector('lat1', 'lng1')} FROM (SELECT * EXCLUDE (vx, vy, vz) FROM faced)) UNION ALL SELECT e, f, {_place('v')} FROM (SELECT *, {_vector('lat2', 'lng2')} FROM (SELECT * EXCLUDE (vx, vy, vz) FROM faced))),
      boxes AS (SELECT e, f, CAST(floor(min(a)) - 4 AS BIGINT) AS a0, CAST(ceil(max(a)) + 4 AS BIGINT) AS a1, CAST(floor(min(b)) - 4 AS BIGINT) AS b0, CAST(ceil(max(b)) + 4 AS BIGINT) AS b1 FROM ends GROUP BY 1, 2),
      tried AS (SELECT e, f, a, unnest(range(b0, b1 + 1)) AS b FROM (SELECT *, unnest(range(a0, a1 + 1)) AS a FROM boxes)),
      spots AS (SELECT tried.e, user_id, segment, f, a, b, lat1, lng1, lat2, lng2, {_centre('a', 'b')} FROM tried JOIN faced USING (e, f)),
      measured AS (SELECT *, CASE WHEN dx = 0 AND dy = 0 THEN 0 ELSE greatest(0, least(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy))) END AS t FROM (SELECT *,
        {_short('lng1 - clng')} * cos(radians(clat)) * {_METRE} AS ax, (lat1 - clat) * {_METRE} AS ay, {_short('lng2 - lng1')} * cos(radians(clat)) * {_METRE} AS dx, (lat2 - lat1) * {_METRE} AS dy FROM spots)),
      near AS (SELECT DISTINCT user_id, segment, f, a, b, clat, clng FROM measured WHERE sqrt((ax + t * dx) ** 2 + (ay + t * dy) ** 2) <= {c.REVEAL_M}),
      shown AS (SELECT user_id, segment, n.f, a, b, clat, clng FROM (SELECT *, {_vector('clat', 'clng')} FROM near) n, faces GROUP BY ALL HAVING arg_max(faces.f, {_dot('v', 'c')}) = n.f)"""

_RUNS = """runs AS (SELECT *, 'f' || f || ':' || a || ':' || b AS cell, TIMESTAMP '2020-01-01' + to_days(CAST(40 * segment AS INT)) AS started_at FROM shown),
      classed AS (SELECT *, CASE WHEN previous IS NULL THEN 'new' WHEN started_at - previous < INTERVAL 183 DAY THEN 'cooled' ELSE 'rearmed' END AS class
        FROM (SELECT *, lag(started_at) OVER (PARTITION BY user_id, cell ORDER BY started_at) AS previous FROM runs))"""

ORACLE_SQL = {
    "point_cells": f"""WITH {_FACE_TABLE}, t AS (SELECT user_id, seq, {_vector('lat', 'lng')} FROM ({TRAILS_SQL})),
      f AS (SELECT * FROM (SELECT t.*, faces.*, row_number() OVER (PARTITION BY user_id, seq ORDER BY {_dot('v', 'c')} DESC) AS nth FROM t, faces) WHERE nth = 1),
      p AS (SELECT user_id, seq, {_CUBE}, * EXCLUDE (user_id, seq, a, b) FROM (SELECT *, {_place('v')} FROM f)), q AS (SELECT user_id, seq, {_centre('a', 'b')} FROM p)
      SELECT user_id, seq, round(clat, 7) AS lat, round(clng, 7) AS lng FROM q""",
    "trail_reveals": f"""WITH RECURSIVE {_GROUND}, r AS (SELECT user_id, segment, count(*) FILTER (coalesce(accuracy > 50, false)) AS accuracy FROM split GROUP BY 1, 2),
      s AS (SELECT user_id, segment, count(*) FILTER (same) AS duplicate FROM judged GROUP BY 1, 2), n AS (SELECT user_id, segment, count(DISTINCT part) AS parts FROM cut GROUP BY 1, 2)
      SELECT user_id, segment, count(*) AS n_cells, round(avg(clat), 6) AS lat, round(avg(clng), 6) AS lng, any_value(parts) AS parts, any_value(accuracy) AS accuracy, any_value(duplicate) AS duplicate, CAST(0 AS BIGINT) AS non_finite
      FROM shown JOIN r USING (user_id, segment) JOIN s USING (user_id, segment) JOIN n USING (user_id, segment) GROUP BY 1, 2""",
    "ground_runs": f"""WITH RECURSIVE {_GROUND}, {_RUNS}, counts AS (SELECT user_id, segment, {", ".join(f"count(*) FILTER (class = '{x}') AS {x}_cells" for x in ("new", "rearmed", "cooled"))} FROM classed GROUP BY 1, 2),
      steps AS (SELECT row_number() OVER () AS e, user_id, segment, before_lat AS lat1, before_lng AS lng1, lat AS lat2, lng AS lng2, {_metres('before_lat', 'before_lng', 'lat', 'lng')} AS long_m
        FROM (SELECT user_id, segment, lat, lng, lag(lat) OVER w AS before_lat, lag(lng) OVER w AS before_lng FROM cut WINDOW w AS (PARTITION BY user_id, segment, part ORDER BY seq)) WHERE before_lat IS NOT NULL),
      half AS (SELECT e, user_id, segment, long_m, (x.vx + y.vx) / n AS vx, (x.vy + y.vy) / n AS vy, (x.vz + y.vz) / n AS vz FROM (SELECT e, user_id, segment, long_m, {{{_vector_of('lat1', 'lng1')}}} AS x, {{{_vector_of('lat2', 'lng2')}}} AS y FROM steps),
        LATERAL (SELECT sqrt((x.vx + y.vx) ** 2 + (x.vy + y.vy) ** 2 + (x.vz + y.vz) ** 2) AS n)),
      mf AS (SELECT * FROM (SELECT half.*, faces.*, row_number() OVER (PARTITION BY e ORDER BY {_dot('v', 'c')} DESC) AS nth FROM half, faces) WHERE nth = 1),
      mc AS (SELECT user_id, segment, long_m, f, {_CUBE} FROM (SELECT user_id, segment, long_m, f, {_place('v')} FROM mf)),
      md AS (SELECT user_id, segment, {", ".join(f"sum(long_m) FILTER (class = '{x}') AS {y}_m" for x, y in (("new", "new"), ("rearmed", "rearmed"), ("cooled", "recent")))}
        FROM mc JOIN classed USING (user_id, segment, f, a, b) WHERE long_m > 0 GROUP BY 1, 2)
      SELECT user_id, segment, new_cells, rearmed_cells, cooled_cells, {", ".join(f"round(coalesce({y}_m, 0), 3) AS {y}_m" for y in ("new", "rearmed", "recent"))} FROM counts LEFT JOIN md USING (user_id, segment)""",
}
