"""A full replay of history under new rules, published as one version.

Stages, each written once for the run: the waterline (what users were shown),
the rows of the old ledger that survive (floors, and rows of retracted
activities), the new ledger, cells, floors for what fell, skill states.  Only
the last step makes them visible.  A run that is killed is called again under
its name and goes on; the waterline of its first start stays, since after a
publish it could no longer be read off the states.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trailmill.operators import discovery, progress, scoring
from trailmill.sources.versions import Version, Versions

TABLES = ["ledger", "cells", "states"]


class Fallen(RuntimeError):
    """A replay would show a user less than before."""


def survivors(ledger: DataFrame, active: DataFrame) -> DataFrame:
    """Rows of the old ledger that a replay keeps: floors, and rows of activities that are not active."""
    lost = ledger.filter("NOT is_floor").join(active.select("activity_id"), "activity_id", "left_anti").select(ledger.columns)
    return ledger.filter("is_floor").unionByName(lost)


def by_skill(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("user_id", "skill").agg(F.sum("xp").cast("long").alias("xp"))


def floor_rows(shown: DataFrame, fresh: DataFrame, kept: DataFrame, columns: DataFrame) -> DataFrame:
    """Floors up to the waterline, as rows of the ledger."""
    missing = scoring.floors(shown, by_skill(fresh), by_skill(kept))
    nothing = {f.name: F.lit(None).cast(f.dataType) for f in columns.schema}
    made = {"user_id": F.col("user_id"), "skill": F.col("skill"), "xp": F.col("gap"), "is_floor": F.lit(True)}
    return missing.select(*[{**nothing, **made}[c].alias(c) for c in columns.columns])


def skill_states(line: DataFrame, ledger: DataFrame) -> DataFrame:
    """(user_id, skill, xp, level, first_at, last_at, fallen): thawed states with the span of what was earned; floors have no time."""
    spans = ledger.groupBy(F.col("user_id").alias("s_user"), F.col("skill").alias("s_skill")).agg(F.min("started_at").alias("first_at"), F.max("started_at").alias("last_at"))
    states = progress.thawed(line, ledger)
    return states.join(spans, (F.col("user_id") == F.col("s_user")) & (F.col("skill") == F.col("s_skill")), "left").drop("s_user", "s_skill")


def replay(
    store: Versions,
    run: str,
    old_ledger: Callable[[], DataFrame],
    new_ledger: Callable[[], DataFrame],
    visits: Callable[[], DataFrame],
    active: Callable[[], DataFrame],
    after: Callable[[str], None] = lambda stage: None,
) -> Version:
    """Runs or resumes ``run`` and publishes ledger, cells and states.

    ``old_ledger``: (user_id, activity_id, started_at, skill, xp, is_floor), used
    where nothing is published yet; ``new_ledger`` the same of all activities
    under the new rules; ``visits`` of all activities, retracted ones included,
    for the cells; ``active``: (activity_id) of those that count.  ``after`` is
    called after every stage.
    """
    done = store.of_run(run)
    if done:
        return done
    began = store.stage(run, "base", lambda: store.spark.createDataFrame([(store.current().generation if store.current() else 0,)], "generation int"))
    base = began.first()["generation"]
    version = next((v for v in store.versions() if v.generation == base), None)

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        table = store.stage(run, name, make)
        after(name)
        return table

    before = store.table("ledger", version) if version else old_ledger()
    line = stage("waterline", lambda: progress.waterline(by_skill(before).withColumn("high_water", F.lit(None).cast("int")) if not version else high_water(store, version)))
    kept = stage("survivors", lambda: survivors(before, active()))
    fresh = stage("fresh", lambda: new_ledger().join(active().select("activity_id"), "activity_id", "left_semi").select(*before.columns))
    stage("cells", lambda: discovery.cell_state(discovery.classify_history(visits())))
    shown = line.select("user_id", "skill", F.col("shown_xp").alias("xp"))
    floors = stage("floors", lambda: floor_rows(shown, fresh, kept, before))
    ledger = stage("ledger", lambda: fresh.unionByName(kept).unionByName(floors))
    states = stage("states", lambda: skill_states(line, ledger))
    if not states.filter("fallen").isEmpty():
        raise Fallen(f"{run}: skills would fall below what was shown")
    published = store.publish(run, TABLES, base)
    after("published")
    return published


def high_water(store: Versions, version: Version) -> DataFrame:
    """States of a version with the level that was shown."""
    return store.table("states", version).select("user_id", "skill", "xp", F.col("level").alias("high_water"))


def with_batch(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Cell states with a batch of visits added.

    A visit is classified by the one before it, in the batch or stored; one
    before the stored last counts as a visit and not as a discovery.
    """
    keys = ["user_id", "cell"]
    known = stored.select(*[F.col(k).alias(f"s_{k}") for k in keys], F.col("last_run_at").alias("s_last"))
    rows = batch.join(known, (F.col("user_id") == F.col("s_user_id")) & (F.col("cell") == F.col("s_cell")), "left")
    order = Window.partitionBy(*keys).orderBy("started_at", "activity_id")
    previous = F.greatest(F.lag("started_at").over(order), F.col("s_last"))
    late = F.col("started_at") < F.col("s_last")
    classed = rows.withColumn("class", F.when(late, "deferred").otherwise(discovery.class_of(previous, F.col("started_at"))))
    found = discovery.cell_state(classed.withColumn("class", F.when(F.col("class") == "deferred", "cooled").otherwise(F.col("class"))).select(*batch.columns, "class"))
    both = stored.unionByName(found)
    first, last = F.struct("first_run_at", "first_run_id"), F.struct("last_run_at", (-F.col("last_run_id")).alias("minus_id"))
    merged = both.groupBy(*keys).agg(F.min(first).alias("f"), F.max(last).alias("l"), F.sum("visit_count").alias("visit_count"), F.sum("discovery_count").alias("discovery_count"))
    return merged.select(
        *keys, "f.first_run_at", "f.first_run_id", "l.last_run_at", (-F.col("l.minus_id")).alias("last_run_id"), "visit_count", "discovery_count"
    )


def merged_batches(store: Versions, stream: DataFrame, checkpoint: str, **options):
    """Cells of a stream of visits: each micro-batch is merged over the published state and published as the next version.

    The run is named by the batch, so a batch that is given twice after a
    failure is merged once.
    """

    def merge(batch: DataFrame, number: int) -> None:
        run = f"batch-{number:010d}"
        if store.of_run(run):
            return
        version = store.current()
        stored = store.table("cells", version) if version else None
        whole = discovery.cell_state(discovery.classify_history(batch)) if stored is None else with_batch(stored, batch)
        store.stage(run, "cells", lambda: whole)
        store.publish(run, ["cells"], version.generation if version else 0)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).options(**options)
