"""Keys of what was scored, and small views: the set on the home map, reads by id, windows of rows, shares, cursors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows drawn beyond each edge of a list, and its height before it is measured.
OVERSCAN, UNMEASURED = 8, 1000


def canonical_number(x: Column) -> Column:
    """A number as JSON has it: shortest digits, no exponent down to a millionth, no trailing zeros."""
    return F.regexp_replace(x.cast("decimal(38,20)").cast("string"), r"\.?0+$", "")


def trace_digest(points: DataFrame, *keys: str) -> DataFrame:
    """(keys, digest): 16 hexadecimal digits over the canonical JSON of a trace's points and start (started_at, a text); one trace is one text."""
    field = lambda name: F.concat(F.lit(f'"{name}":'), canonical_number(F.col(name)))
    spot = F.concat(F.lit("{"), field("lat"), F.lit(","), field("lng"), F.lit(',"t":'), F.col("t_ms").cast("string"), F.lit("}"))
    spots = points.groupBy(*keys, "started_at").agg(F.array_sort(F.collect_list(F.struct("seq", spot.alias("s")))).alias("spots"))
    text = F.concat(F.lit('{"points":['), F.array_join("spots.s", ","), F.lit('],"startedAt":"'), F.col("started_at"), F.lit('"}'))
    return spots.select(*keys, F.substring(F.sha2(text, 256), 1, 16).alias("digest"))


def score_key(source: Column, external_id: Column, digest: Column, version: int) -> Column:
    return F.concat_ws("#", source, external_id.cast("string"), digest, F.lit(f"v{version}"))


def same_activity(a: Column, b: Column) -> Column:
    """Whether two score keys name one activity: their first two parts agree."""
    return F.substring_index(a, "#", 2) == F.substring_index(b, "#", 2)


def without_held(explored: DataFrame, held: DataFrame) -> DataFrame:
    """(user_id, cell) without the cells held back from a user's map until they are shown."""
    return explored.join(held.select("user_id", "cell"), ["user_id", "cell"], "left_anti")


def read_by_id(asked: DataFrame, activities: DataFrame) -> DataFrame:
    """What (user_id, activity_id) asked for gets: found, or missing where there is none, it is another's or it was retracted."""
    rows = activities.select(F.col("activity_id").alias("a_id"), F.col("user_id").alias("owner"), "status", "started_at")
    joined = asked.join(rows, F.col("activity_id") == F.col("a_id"), "left")
    ok = F.coalesce((F.col("owner") == F.col("user_id")) & (F.col("status") != "TOMBSTONED"), F.lit(False))
    return joined.select("user_id", "activity_id", F.when(ok, "found").otherwise("missing").alias("result"), F.when(ok, F.col("started_at")).alias("started_at"))


def row_window(top: Column, height: Column, count: Column, row_px: int) -> tuple[Column, Column]:
    """First row drawn and the one after the last, for a list scrolled to ``top``."""
    top = F.greatest(F.lit(0), top)
    height = F.when(height > 0, height).otherwise(UNMEASURED)
    first = F.least(count - 1, F.floor(top / row_px)) - OVERSCAN
    last = F.ceil((top + height) / row_px) + OVERSCAN
    none = count <= 0
    return F.when(none, 0).otherwise(F.greatest(F.lit(0), first)).cast("long"), F.when(none, 0).otherwise(F.least(count, last)).cast("long")


def logged_shares(sets: DataFrame) -> DataFrame:
    """Adds ``share`` to (activity_id, pos, exercise, duration_s): each set's per cent of a split, null where the sets are none.

    A split has several sets, all timed, and of more than one exercise.
    """
    whole = Window.partitionBy("activity_id")
    timed = F.min(F.coalesce(F.col("duration_s") > 0, F.lit(False))).over(whole)
    split = (F.count("*").over(whole) > 1) & timed & (F.min("exercise").over(whole) != F.max("exercise").over(whole))
    percent = F.floor(F.col("duration_s") / F.sum("duration_s").over(whole) * 100 + 0.5).cast("string")
    return sets.withColumn("share", F.when(split, F.concat(percent, F.lit("%"))))


def backfill_cursor(confirmed: DataFrame) -> DataFrame:
    """(user_id, previous, at) to each user's next cursor: a second before the newest one's second, never back; ``at`` is null where none was confirmed."""
    newest = (F.date_trunc("second", F.max("at")).cast("timestamp_ntz") - F.expr("INTERVAL '1' SECOND")).alias("c")
    rows = confirmed.groupBy("user_id").agg(F.max("previous").alias("previous"), newest)
    return rows.select("user_id", F.greatest("c", "previous").alias("cursor"))


def new_share(awards: DataFrame) -> DataFrame:
    """Adds the part of a run's cells that was new, 0 without cells."""
    cells = F.col("new_cells") + F.col("cooled_cells") + F.col("rearmed_cells")
    return awards.withColumn("new_share", F.coalesce(F.try_divide("new_cells", cells), F.lit(0.0)))


def update_plan(since: Column, generation: Column, deltas_from: Column) -> Column:
    """How a map that has the set of ``since`` (0: none) gets that of ``generation`` (null: there is none): nothing, deltas, or the whole."""
    return (
        F.when(generation.isNull(), "empty")
        .when((since > 0) & (since == generation), "up-to-date")
        .when((since > 0) & since.between(deltas_from, generation - 1), "delta")
        .otherwise("full")
    )


def merged_holds(a: Column, b: Column) -> Column:
    """Two holds (pending boolean, cells array or null) as one: pending if one is, else the cells of both; none is null and an empty one yields."""
    cells = F.when(a["cells"].isNull() | ((F.size(a["cells"]) == 0) & (F.size(b["cells"]) > 0)), b["cells"]).when(F.size(b["cells"]) > 0, F.array_union(a["cells"], b["cells"])).otherwise(a["cells"])
    pending = a["pending"] | b["pending"]
    return F.struct(pending.alias("pending"), F.when(~pending, cells).alias("cells"))


def rate_pair(header: Column) -> Column:
    """(quarter, day) of a header like "100,1000"; null for anything else."""
    part = lambda k: F.regexp_extract(header, r"^\s*(\d+)\s*,\s*(\d+)\s*$", k).cast("long")
    return F.when(header.rlike(r"^\s*\d+\s*,\s*\d+\s*$"), F.struct(part(1).alias("quarter"), part(2).alias("day")))


def next_boundary(at_ms: Column, every_ms: int) -> Column:
    """The first multiple of ``every_ms`` after an instant: quarter hours, midnights of UTC."""
    return (F.floor(at_ms / every_ms) + 1) * every_ms
