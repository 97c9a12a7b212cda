"""Discovery: what a visit to a cell is worth, and the state that visits leave.

Visits are (user_id, activity_id, started_at, cell), once per activity and cell.
A visit is new if its user was never in the cell before, cooled if less than
REARM ago, else rearmed.  Order is (started_at, activity_id); the previous visit
is a window over (user, cell), so users with most of the rows spread over their cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: 183 days, not six months; a gap of exactly that is rearmed.
REARM = "INTERVAL '183' DAY"
CLASSES = ("new", "cooled", "rearmed")
#: Rings around a run that are near it.
NEAR_RINGS = 4


def _per_cell():
    return Window.partitionBy("user_id", "cell").orderBy("started_at", "activity_id")


def class_of(previous: Column, at: Column) -> Column:
    """Class of a visit at ``at`` after a last one at ``previous``."""
    return F.when(previous.isNull(), "new").when(at - previous < F.expr(REARM), "cooled").otherwise("rearmed")


def classify_history(visits: DataFrame) -> DataFrame:
    """Adds previous_at and class to every visit."""
    previous = F.lag("started_at").over(_per_cell())
    return visits.withColumn("previous_at", previous).withColumn("class", class_of(F.col("previous_at"), F.col("started_at")))


def classify_against(cells: DataFrame, state: DataFrame) -> DataFrame:
    """Classifies visits against stored state instead; a visit before the stored last one is deferred, without credit."""
    s = state.select(F.col("user_id").alias("s_user"), F.col("cell").alias("s_cell"), "last_run_at")
    joined = cells.join(s, (F.col("user_id") == F.col("s_user")) & (F.col("cell") == F.col("s_cell")), "left")
    kind = F.when(F.col("started_at") < F.col("last_run_at"), "deferred").otherwise(class_of(F.col("last_run_at"), F.col("started_at")))
    return joined.withColumn("class", kind).drop("s_user", "s_cell")


def awards(classified: DataFrame, *keys: str) -> DataFrame:
    """Counts per class, by activity or by any other keys."""
    count = lambda c: F.count_if(F.col("class") == c).alias(f"{c}_cells")
    return classified.groupBy(*keys).agg(*map(count, CLASSES))


def cell_state(classified: DataFrame) -> DataFrame:
    """First and last run of each cell, visits and discoveries.

    The last run of several at the last instant is the one with the smallest id.
    """
    state = classified.groupBy("user_id", "cell").agg(
        F.min(F.struct("started_at", "activity_id")).alias("first"),
        F.max(F.struct("started_at", (-F.col("activity_id")).alias("minus_id"))).alias("last"),
        F.count("*").alias("visit_count"),
        F.count_if(F.col("class") != "cooled").alias("discovery_count"),
    )
    return state.select(
        "user_id",
        "cell",
        F.col("first.started_at").alias("first_run_at"),
        F.col("first.activity_id").alias("first_run_id"),
        F.col("last.started_at").alias("last_run_at"),
        (-F.col("last.minus_id")).alias("last_run_id"),
        "visit_count",
        "discovery_count",
    )


def parent_rollup(cells: DataFrame, levels: dict[int, int]) -> DataFrame:
    """Explored cells of each parent at each resolution, and their share of the parent.

    ``levels``: cells of a parent by resolution.  Finer parents are rolled up
    into coarser ones, so the cells are counted once.
    """
    out, below, size = None, None, 1
    for res, children in sorted(levels.items(), reverse=True):
        if below is None:
            counts = cells.groupBy("user_id", F.floor(F.col("cell") / children).cast("long").alias("parent")).agg(F.count("*").alias("n"))
        else:
            counts = below.groupBy("user_id", F.floor(F.col("parent") / (children // size)).cast("long").alias("parent")).agg(F.sum("n").alias("n"))
        below, size = counts, children
        rows = counts.select("user_id", F.lit(res).alias("res"), "parent", "n", F.round(F.col("n") / children, 6).alias("fraction"))
        out = rows if out is None else out.unionByName(rows)
    return out


def touched_parents(visits: DataFrame, levels: dict[int, int]) -> DataFrame:
    """Distinct (user, res, parent) under the visits."""
    parents = F.array(*[F.struct(F.lit(r).alias("res"), F.floor(F.col("cell") / n).cast("long").alias("parent")) for r, n in levels.items()])
    return visits.select("user_id", F.explode(parents).alias("p")).select("user_id", "p.res", "p.parent").distinct()


def parent_updates(classified: DataFrame, children: int) -> DataFrame:
    """What a batch adds to its parents: new cells, and the last day."""
    return classified.groupBy("user_id", F.floor(F.col("cell") / children).cast("long").alias("parent")).agg(
        F.count_if(F.col("class") == "new").alias("added"), F.max(day_number(F.col("started_at"))).alias("last_day")
    )


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days of 24 hours that passed, not dates that changed."""
    ms = F.unix_millis(later.cast("timestamp")) - F.unix_millis(earlier.cast("timestamp"))
    return F.floor(ms / 86_400_000).cast("long")


def day_number(at: Column) -> Column:
    """Days since 2020-01-01, 0 before it and at most 65535."""
    return F.greatest(F.lit(0), F.least(F.lit(65535), F.datediff(at, F.lit("2020-01-01").cast("date"))))


def merge_state(stored: DataFrame, folded: DataFrame) -> DataFrame:
    """Folded cells over stored ones: earliest first, latest last, larger counts; only rows that change."""
    f = folded.select(*[F.col(c).alias(f"f_{c}") for c in folded.columns])
    both = stored.join(f, (F.col("user_id") == F.col("f_user_id")) & (F.col("cell") == F.col("f_cell")), "right")
    first_wins = F.col("first_run_at").isNotNull() & (F.col("first_run_at") <= F.col("f_first_run_at"))
    last_wins = F.col("last_run_at").isNotNull() & (F.col("last_run_at") >= F.col("f_last_run_at"))
    pick = lambda wins, c: F.when(wins, F.col(c)).otherwise(F.col(f"f_{c}"))
    merged = both.select(
        F.col("f_user_id").alias("user_id"),
        F.col("f_cell").alias("cell"),
        pick(first_wins, "first_run_at").alias("first_run_at"),
        pick(first_wins, "first_run_id").alias("first_run_id"),
        pick(last_wins, "last_run_at").alias("last_run_at"),
        pick(last_wins, "last_run_id").alias("last_run_id"),
        F.greatest("visit_count", "f_visit_count").alias("visit_count"),
        F.greatest("discovery_count", "f_discovery_count").alias("discovery_count"),
        F.struct("first_run_at", "last_run_at", "visit_count", "discovery_count").alias("old"),
    )
    same = F.col("old") == F.struct("first_run_at", "last_run_at", "visit_count", "discovery_count")
    return merged.filter(~F.coalesce(same, F.lit(False))).drop("old")


def merge_cells(base: DataFrame, touched: DataFrame, day: Column) -> DataFrame:
    """Union of (user_id, cell, last_day) and touched (user_id, cell): ``added``, and the later day."""
    t = touched.select(F.col("user_id").alias("t_user"), F.col("cell").alias("t_cell")).distinct()
    both = base.join(t, (F.col("user_id") == F.col("t_user")) & (F.col("cell") == F.col("t_cell")), "full")
    return both.select(
        F.coalesce("user_id", "t_user").alias("user_id"),
        F.coalesce("cell", "t_cell").alias("cell"),
        F.col("user_id").isNull().alias("added"),
        F.when(F.col("t_user").isNull(), F.col("last_day")).otherwise(F.greatest(F.coalesce("last_day", F.lit(0)), day)).alias("last_day"),
    )


def run_classes(classified: DataFrame) -> DataFrame:
    """Per activity the sorted new and rearmed cells, and when the rearmed were seen before, as text."""
    cells = lambda c: F.array_join(F.array_sort(F.collect_list(F.when(F.col("class") == c, F.col("cell")))).cast("array<string>"), ",")
    since = F.array_sort(F.collect_list(F.when(F.col("class") == "rearmed", F.struct("cell", F.date_format("previous_at", "yyyy-MM-dd").alias("d")))))
    return classified.groupBy("user_id", "activity_id").agg(
        cells("new").alias("new"), cells("rearmed").alias("rearmed"), F.array_join(F.transform(since, lambda x: x["d"]), ",").alias("rearmed_since")
    )
