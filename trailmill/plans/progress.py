"""Queries of the progress operators, with their SQL."""

from pyspark.sql import functions as F

from trailmill.operators import discovery as d
from trailmill.operators import grid
from trailmill.operators import progress as p
from trailmill.operators.scoring import level_for_xp
from trailmill.plans.scoring import LEVEL_SQL
from trailmill.sources.tables import LEDGER_SKILLS, LEDGER_SQL, VISITS_SQL, ledger_entries, table, visits

WEIGHTS = {"new": 1.0, "rearmed": 0.6, "recent": 0.1}
LADDER = tuple(range(20, 480, 4))


def _clusters(spark, sf_dir):
    """Around a cell of each user's every month: four rings of a sparse set, one run in seven."""
    v = visits(spark, sf_dir)
    now = v.groupBy("user_id").agg(F.max("started_at").alias("now"))
    state = v.groupBy("user_id", "cell").agg(F.max("started_at").alias("last_run_at")).filter("(cell * 7 + user_id) % 4 > 0")
    origin = now.select("user_id", "now", (F.col("user_id") * 13 % 300).cast("long").alias("cell"))
    disc = grid.ring(origin, 4, "user_id", "now")
    place = lambda c: (F.floor(c / 20) * 0.01, (c % 20) * 0.01)
    parent = F.floor(F.col("cell") / 7).cast("long")
    lat, lng = place(F.col("user_id") * 13 % 300)
    plat, plng = place(F.col("parent") * 7 + 3)
    disc = disc.withColumns({"lat": lat.cast("double"), "lng": lng.cast("double"), "parent": parent}).withColumns({"parent_lat": plat.cast("double"), "parent_lng": plng.cast("double")})
    return p.frontier(disc, state, WEIGHTS)


def frontier_clusters(spark, sf_dir):
    return _clusters(spark, sf_dir).select("user_id", "parent", F.round("novelty", 6).alias("novelty"), F.round("distance_m", 3).alias("distance_m"), F.round("score", 6).alias("score"))


def frontier_line(spark, sf_dir):
    c = _clusters(spark, sf_dir).withColumns({"score": F.round("score", 9), "bearing": F.round("bearing", 6)})
    return p.frontier_pick(c).select("user_id", "parent", "line")


def pre_run_set(spark, sf_dir):
    """Each user's cells without those of the last run."""
    v = visits(spark, sf_dir)
    last = v.groupBy("user_id").agg(F.max(F.struct("started_at", "activity_id")).alias("m")).select("user_id", F.col("m.activity_id").alias("activity_id"))
    return p.before_run(v.select("user_id", "cell").distinct(), v.join(last, ["user_id", "activity_id"], "left_semi"))


def post_run_set(spark, sf_dir):
    v = visits(spark, sf_dir)
    return p.after_run(v.filter("activity_id % 2 = 0"), v.filter("activity_id % 2 = 1")).groupBy("user_id").agg(F.count("*").alias("cells"))


def delta_chain(spark, sf_dir):
    """Users' sets by year as generations; a third of the users lack one of their deltas."""
    v = visits(spark, sf_dir).withColumn("gen", F.year("started_at") - 2019)
    base = v.filter("gen <= 3").select("user_id", F.lit(3).alias("generation"), "cell").distinct()
    deltas = v.filter("gen > 3 AND NOT (user_id % 3 = 0 AND gen = 6)").select("user_id", (F.col("gen") - 1).alias("from_gen"), F.col("gen").alias("to_gen"), "cell").distinct()
    out = p.apply_deltas(base, deltas)
    return out.groupBy("user_id", "generation", "complete").agg(F.count("*").alias("cells")).withColumn("generation", F.col("generation").cast("long"))


def reveal_order(spark, sf_dir):
    v = visits(spark, sf_dir)
    cells = p.batch_reveal(v.filter("started_at < '2021-01-01'"), v).drop("n").distinct()
    return p.reveal_order(cells.withColumns({"x": F.col("cell") % 20, "y": F.floor(F.col("cell") / 20)})).withColumn("arc", F.round("arc", 9)).withColumn("rank", F.col("rank").cast("long"))


def _states(spark, sf_dir):
    """Per user and skill the xp of all and of all but recent runs; the last skill is new, the fourth not counted for odd users."""
    rows = ledger_entries(spark, sf_dir).filter("reason <> 'floor'")
    sums = rows.groupBy("user_id", "skill").agg(
        F.greatest(F.lit(0), F.sum(F.when(F.col("started_at") < F.lit("2023-01-01").cast("timestamp_ntz"), F.col("xp")).otherwise(0))).cast("long").alias("xp_before"),
        F.greatest(F.lit(0), F.sum("xp")).cast("long").alias("xp_after"),
    )
    return sums.withColumns({
        "introduced_in": F.when(F.col("skill") == LEDGER_SKILLS[4], 5).otherwise(1), "version": F.lit(4), "counted": ~((F.col("skill") == LEDGER_SKILLS[3]) & (F.col("user_id") % 2 == 1))
    })


def celebrated_levels(spark, sf_dir):
    return p.level_ups(_states(spark, sf_dir)).select("user_id", "skill", F.col("from_level").cast("long").alias("from_level"), F.col("to_level").cast("long").alias("to_level"))


def earned_totals(spark, sf_dir):
    t = p.earned_totals(_states(spark, sf_dir)).select("user_id", F.col("before").cast("long").alias("before"), F.col("after").cast("long").alias("after"))
    r = p.rung(F.col("after"), 495, LADDER)
    return t.select("user_id", "before", "after", r["from"].alias("rung_from"), r["to"].alias("rung_to"), F.round(r["fraction"], 9).alias("fraction"))


def earned_milestones(spark, sf_dir):
    return p.milestones_crossed(p.earned_totals(_states(spark, sf_dir)), LADDER)


def thawed_states(spark, sf_dir):
    """A replay that lost a seventh of the rows, against what was shown; even users held a higher level once."""
    rows = ledger_entries(spark, sf_dir).filter("reason <> 'floor' AND xp > 0")
    shown = rows.groupBy("user_id", "skill").agg(F.sum("xp").alias("xp")).withColumn("high_water", F.when(F.col("user_id") % 2 == 0, 60))
    out = p.thawed(p.waterline(shown), rows.filter("NOT (skill = 'might' AND activity_id % 7 = 0)"))
    return out.withColumn("level", F.col("level").cast("long"))


def profile_totals(spark, sf_dir):
    """A sixth skill is enabled that nobody has."""
    rows = ledger_entries(spark, sf_dir).filter("reason <> 'floor' AND xp > 0")
    states = rows.groupBy("user_id", "skill").agg(F.sum("xp").cast("long").alias("xp")).withColumn("level", level_for_xp(F.col("xp"))).withColumn("high_water", F.when(F.col("user_id") % 3 == 0, 40))
    skills = spark.createDataFrame([(s, s != "roving") for s in (*LEDGER_SKILLS, "delving")], "skill string, enabled boolean")
    return p.profile_totals(states, skills)


def rough_durations(spark, sf_dir):
    days = F.col("o_orderkey") % 1500
    formula = F.when(days % 3 == 0, F.concat(days.cast("string"), F.lit(" * L^2"))).when(days % 3 == 1, F.concat(days.cast("string"), F.lit("*L ^ 2"))).otherwise("L^2")
    return table(spark, sf_dir, "orders").select("o_orderkey", p.low_precision(days).alias("about"), p.step_factor(formula).alias("k"))


def run_territory(spark, sf_dir):
    """Stored counts of each run as credits and xp: new cells whole, rearmed ones at half."""
    a = d.awards(d.classify_history(visits(spark, sf_dir)), "activity_id")
    credit = F.col("new_cells") + F.col("rearmed_cells") * 0.5
    return a.select("activity_id", (F.col("new_cells") + F.col("rearmed_cells")).alias("credited"), credit.alias("units"), F.floor(credit * 3 + 0.5).cast("long").alias("xp"))


NAMES = (frontier_clusters, frontier_line, pre_run_set, post_run_set, delta_chain, reveal_order, celebrated_levels, earned_totals, earned_milestones, thawed_states, profile_totals, rough_durations, run_territory)
QUERIES = {f.__name__: f for f in NAMES}

_V = f"v AS ({VISITS_SQL})"
_L = f"l AS (SELECT * FROM ({LEDGER_SQL}) WHERE reason <> 'floor')"
_LEVEL = lambda xp: f"CAST({LEVEL_SQL.format(xp=xp)} AS BIGINT)"
_CLUSTERS = f"""{_V}, n AS (SELECT user_id, max(started_at) AS now, user_id * 13 % 300 AS o FROM v GROUP BY 1),
  s AS (SELECT user_id, cell, max(started_at) AS last_at FROM v WHERE (cell * 7 + user_id) % 4 > 0 GROUP BY 1, 2),
  k AS (SELECT dq, dr FROM range(-4, 5) a(dq), range(-4, 5) b(dr) WHERE abs(dq + dr) <= 4),
  disc AS (SELECT user_id, now, o // 20 * 0.01::DOUBLE AS lat, o % 20 * 0.01::DOUBLE AS lng, (o // 20 + dr) * 20 + o % 20 + dq AS cell FROM n, k WHERE o % 20 + dq BETWEEN 0 AND 19 AND o // 20 + dr BETWEEN 0 AND 14),
  w AS (SELECT disc.*, disc.cell // 7 AS parent, CASE WHEN s.cell IS NULL THEN 1.0 WHEN now - last_at >= INTERVAL 183 DAY THEN 0.6 ELSE 0.1 END AS w FROM disc LEFT JOIN s ON disc.user_id = s.user_id AND disc.cell = s.cell),
  g AS (SELECT user_id, parent, lat, lng, (parent * 7 + 3) // 20 * 0.01::DOUBLE AS plat, (parent * 7 + 3) % 20 * 0.01::DOUBLE AS plng, avg(w::DOUBLE) AS novelty FROM w GROUP BY ALL),
  m AS (SELECT *, 2 * 6371008.8 * asin(least(1, sqrt(sin(radians(plat - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(plat)) * sin(radians(plng - lng) / 2) ** 2))) AS m,
    (degrees(atan2(sin(radians(plng - lng)) * cos(radians(plat)), cos(radians(lat)) * sin(radians(plat)) - sin(radians(lat)) * cos(radians(plat)) * cos(radians(plng - lng)))) + 360) % 360 AS bearing FROM g)"""
_STATES = f"""{_L}, st AS (SELECT user_id, skill, CAST(greatest(0, sum(CASE WHEN started_at < '2023-01-01' THEN xp ELSE 0 END)) AS BIGINT) AS xp_before, CAST(greatest(0, sum(xp)) AS BIGINT) AS xp_after,
    skill = 'roving' OR (skill = 'constitution' AND user_id % 2 = 1) AS minted FROM l GROUP BY 1, 2),
  lv AS (SELECT *, {_LEVEL('st.xp_before')} AS from_level, {_LEVEL('st.xp_after')} AS to_level FROM st),
  tot AS (SELECT user_id, CAST(sum(from_level) - count(*) FILTER (minted) AS BIGINT) AS before, CAST(sum(to_level) - count(*) FILTER (minted) AS BIGINT) AS after FROM lv GROUP BY 1)"""
_RUNGS = "[" + ", ".join(map(str, (*LADDER, 495))) + "]"

ORACLE_SQL = {
    "frontier_clusters": f"WITH {_CLUSTERS} SELECT user_id, parent, round(novelty, 6) AS novelty, round(m, 3) AS distance_m, round(novelty / greatest(1, m / 1000), 6) AS score FROM m",
    "frontier_line": f"""WITH {_CLUSTERS}, b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(novelty / greatest(1, m / 1000), 9) DESC, parent) AS k FROM m WHERE novelty >= 0.5 AND m >= 250)
      SELECT user_id, parent, 'Unclaimed ground ' || printf('%.1f', round(m / 1000, 1)) || ' km ' ||
        ['north', 'north-east', 'east', 'south-east', 'south', 'south-west', 'west', 'north-west'][CAST(floor(round(bearing, 6) / 45 + 0.5::DOUBLE) AS INT) % 8 + 1] AS line FROM b WHERE k = 1""",
    "pre_run_set": f"""WITH {_V}, last AS (SELECT user_id, arg_max(activity_id, (started_at, activity_id)) AS activity_id FROM v GROUP BY 1)
      SELECT user_id, cell FROM v EXCEPT SELECT v.user_id, cell FROM v JOIN last ON v.user_id = last.user_id AND v.activity_id = last.activity_id""",
    "post_run_set": f"WITH {_V} SELECT user_id, count(DISTINCT cell) AS cells FROM v GROUP BY 1",
    "delta_chain": f"""WITH {_V}, g AS (SELECT *, year(started_at) - 2019 AS gen FROM v), r AS (SELECT user_id, max(gen) AS top FROM g WHERE NOT (user_id % 3 = 0 AND gen = 6) GROUP BY 1),
      e AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN least(5, top) ELSE top END AS reached, NOT (user_id % 3 = 0 AND top > 5) AS complete FROM r)
      SELECT user_id, CAST(reached AS BIGINT) AS generation, complete, count(DISTINCT cell) AS cells FROM g JOIN e USING (user_id) WHERE gen <= reached GROUP BY ALL""",
    "reveal_order": f"""WITH {_V}, c AS (SELECT user_id, cell FROM v EXCEPT SELECT user_id, cell FROM v WHERE started_at < '2021-01-01'),
      w AS (SELECT user_id, cell, round((cell % 20 - avg(cell % 20) OVER u) * (cell % 20 - avg(cell % 20) OVER u) + (cell // 20 - avg(cell // 20) OVER u) * (cell // 20 - avg(cell // 20) OVER u), 9) AS away, count(*) OVER u AS n FROM c WINDOW u AS (PARTITION BY user_id)),
      k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY away, cell) AS rank FROM w)
      SELECT user_id, cell, rank, CASE WHEN n > 1 THEN round((rank - 1) / (n - 1)::DOUBLE, 9) ELSE 0 END AS arc FROM k""",
    "celebrated_levels": f"WITH {_STATES} SELECT user_id, skill, from_level, to_level FROM lv WHERE NOT minted AND to_level > from_level",
    "earned_totals": f"""WITH {_STATES}, r AS (SELECT *, coalesce(list_max(list_filter({_RUNGS}, lambda x: x <= after)), 0) AS lo, list_min(list_filter({_RUNGS}, lambda x: x > after)) AS hi FROM tot)
      SELECT user_id, before, after, CAST(CASE WHEN hi IS NULL THEN 495 ELSE lo END AS BIGINT) AS rung_from, CAST(coalesce(hi, 495) AS BIGINT) AS rung_to, CASE WHEN hi IS NULL THEN 1.0::DOUBLE ELSE round((after - lo) / (hi - lo)::DOUBLE, 9) END AS fraction FROM r""",
    "earned_milestones": f"WITH {_STATES}, r AS (SELECT *, unnest([{', '.join(map(str, LADDER))}]) AS milestone FROM tot) SELECT user_id, CAST(milestone AS BIGINT) AS milestone FROM r WHERE milestone > before AND milestone <= after",
    "thawed_states": f"""WITH {_L}, s AS (SELECT user_id, skill, CAST(sum(xp) AS BIGINT) AS shown, CAST(sum(xp) FILTER (NOT (skill = 'might' AND activity_id % 7 = 0)) AS BIGINT) AS xp FROM l WHERE xp > 0 GROUP BY 1, 2)
      SELECT user_id, skill, coalesce(xp, 0) AS xp, CAST(greatest({_LEVEL('s.shown')}, CASE WHEN user_id % 2 = 0 THEN 60 ELSE 1 END) AS BIGINT) AS level, coalesce(xp, 0) < shown AS fallen FROM s""",
    "profile_totals": f"""WITH {_L}, s AS (SELECT user_id, skill, CAST(sum(xp) AS BIGINT) AS xp FROM l WHERE xp > 0 AND skill <> 'roving' GROUP BY 1, 2),
      g AS (SELECT *, greatest({_LEVEL('s.xp')}, CASE WHEN user_id % 3 = 0 THEN 40 ELSE 1 END) AS level FROM s)
      SELECT user_id, CAST(sum(level) + 5 - count(*) AS BIGINT) AS total_level, CAST(sum(xp) AS BIGINT) AS total_xp FROM g GROUP BY 1""",
    "rough_durations": """WITH o AS (SELECT o_orderkey, o_orderkey % 1500 AS d, (o_orderkey % 1500) / 30.44::DOUBLE AS m FROM orders),
      n AS (SELECT *, CAST(CASE WHEN m < 18 THEN floor(m + 0.5::DOUBLE) ELSE floor(m / 12 + 0.5::DOUBLE) END AS BIGINT) AS n FROM o)
      SELECT o_orderkey, CASE WHEN m < 1 THEN 'under a month' ELSE '~' || n || CASE WHEN m < 18 THEN ' month' ELSE ' year' END || CASE WHEN n = 1 THEN '' ELSE 's' END END AS about, CASE WHEN d % 3 < 2 THEN d END AS k FROM n""",
    "run_territory": f"""WITH {_V}, c AS (SELECT *, lag(started_at) OVER (PARTITION BY user_id, cell ORDER BY started_at, activity_id) AS prev FROM v),
      a AS (SELECT activity_id, count(*) FILTER (prev IS NULL) AS n, count(*) FILTER (started_at - prev >= INTERVAL 183 DAY) AS r FROM c GROUP BY 1)
      SELECT activity_id, n + r AS credited, n + r * 0.5::DOUBLE AS units, CAST(floor((n + r * 0.5::DOUBLE) * 3 + 0.5::DOUBLE) AS BIGINT) AS xp FROM a""",
}
