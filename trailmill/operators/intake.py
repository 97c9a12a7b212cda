"""Intake: archived envelopes and manual entries to activities, points and values; what a notification asks for.

Raw text stays as it came; ids are read as text, so none loses digits.  All of
it is projections: rows are parsed where they are read, and only exploding
points or sets makes more of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STREAM = "struct<data:{0},original_size:int,resolution:string>"
ENVELOPE = (
    "schemaVersion int, source string, detail struct<id:string,name:string,distance:string,elapsed_time:long,sport_type:string,start_date:string,"
    "start_date_local:string,timezone:string>, streams struct<latlng:" + STREAM.format("array<array<double>>") + ",time:" + STREAM.format("array<long>")
    + ",altitude:" + STREAM.format("array<double>") + ",distance:" + STREAM.format("array<double>") + ">"
)
# Kinds of the source's sport types; any other is "other".
KINDS = {
    "run": ("Run", "TrailRun", "VirtualRun"),
    "walk": ("Walk",),
    "hike": ("Hike",),
    "ride": ("Ride", "VirtualRide", "EBikeRide", "GravelRide", "MountainBikeRide", "Handcycle", "Velomobile"),
    "strength": ("WeightTraining", "Crossfit", "HighIntensityIntervalTraining"),
}
#: A wall clock as sources write it, with or without a false Z.
CLOCK = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z?$"
ENTRY = "idempotencyKey string, exerciseId string, occurredAt string, timezone string, sets array<struct<exercise:string,reps:int,durationS:int,distanceM:double>>"
# Fields of a notification.
EVENT_FIELDS = ("aspect_type", "event_time", "object_id", "object_type", "owner_id", "subscription_id", "updates")
EVENT = "aspect_type string, event_time string, object_id string, object_type string, owner_id string, subscription_id string"


def read_envelopes(raw: DataFrame) -> DataFrame:
    """(raw, envelope) of texts in column ``raw``: null where it is no envelope of version 1; the text itself is kept as it came."""
    parsed = F.from_json("raw", ENVELOPE)
    return raw.withColumn("envelope", F.when(parsed["schemaVersion"] == 1, parsed))


def sport_kind(sport: Column) -> Column:
    known = F.create_map(*[F.lit(x) for kind, sports in KINDS.items() for sport in sports for x in (sport, kind)])
    return F.coalesce(F.try_element_at(known, sport), F.lit("other"))


def finite(value: Column) -> Column:
    """The number a text or number is; null for anything else, infinities and NaN."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)


def local_clock(text: Column) -> Column:
    """A wall clock without its false Z; null for other texts, which ``sanitise.refusals`` names."""
    return F.when(text.rlike(CLOCK), F.try_to_timestamp(F.regexp_replace(text, "Z$", "")).cast("timestamp_ntz"))


def bare_zone(text: Column) -> Column:
    """The zone's name without the offset before it; null if nothing is left."""
    return F.nullif(F.trim(F.regexp_replace(text, r"^\(GMT[+-]\d\d:\d\d\)\s*", "")), F.lit(""))


def known_zone(zone: Column) -> Column:
    """Whether the session knows a zone of this name; the names are those of the Java runtime, about 600."""
    names = SparkSession.active()._jvm.java.time.ZoneId.getAvailableZoneIds().toArray()
    return zone.isin(sorted(str(n) for n in names))


def utc_to_local(at: Column, zone: Column) -> Column:
    """The wall clock of an instant in a zone, of UTC without one; null for an unknown zone."""
    known = F.coalesce(zone, F.lit("UTC"))
    return F.when(known_zone(known), F.from_utc_timestamp(at, known).cast("timestamp_ntz"))


def day_key(user: Column, local: Column) -> Column:
    return F.concat_ws("#", user.cast("string"), F.date_format(local, "yyyy-MM-dd"))


def decimated(stream: Column, n: Column) -> Column:
    """Whether a stream of n points is not all that was recorded."""
    return F.coalesce(n < stream["original_size"], F.lit(False)) | F.coalesce(stream["resolution"] != "high", F.lit(False))


def normalise(read: DataFrame) -> DataFrame:
    """Activities of the envelopes; a trace needs places with times or an order."""
    d, s = F.col("envelope.detail"), F.col("envelope.streams")
    n = F.coalesce(F.size(s["latlng"]["data"]), F.lit(0))
    local = local_clock(d["start_date_local"])
    return read.filter("envelope IS NOT NULL").select(
        "user_id",
        F.col("envelope.source").alias("source"),
        d["id"].alias("external_id"),
        F.sha2(F.concat_ws(":", F.col("user_id").cast("string"), F.col("envelope.source"), d["id"]), 256).alias("activity_id"),
        sport_kind(d["sport_type"]).alias("kind"),
        d["sport_type"].alias("source_type_raw"),
        F.try_to_timestamp(d["start_date"]).cast("timestamp_ntz").alias("started_at"),
        local.alias("started_local"),
        bare_zone(d["timezone"]).alias("zone"),
        day_key(F.col("user_id"), local).alias("day_key"),
        d["elapsed_time"].alias("elapsed_s"),
        finite(d["distance"]).alias("distance_m"),
        (n > 0).alias("has_trace"),
        ((n > 0) & decimated(s["latlng"], n)).alias("decimated"),
    )


def trace_points(read: DataFrame, *more: str) -> DataFrame:
    """(user_id, external_id, seq, t_ms, lat, lng, altitude) of every envelope with places; without times a point a second.

    Streams of unequal length are refused by ``sanitise.refusals``; here a missing time would run backwards.
    """
    d, s = F.col("envelope.detail"), F.col("envelope.streams")
    rows = read.select(
        *more, "user_id", d["id"].alias("external_id"), F.unix_millis(F.try_to_timestamp(d["start_date"])).alias("start_ms"), s["time"]["data"].alias("t"),
        s["altitude"]["data"].alias("alt"), F.posexplode_outer(s["latlng"]["data"]).alias("seq", "place")
    )
    # Outer, and filtered after: Spark would else filter by the array's size first and parse every text again for it.
    return rows.filter("seq IS NOT NULL").select(
        *more, "user_id", "external_id", "seq", (F.col("start_ms") + F.coalesce(F.get("t", F.col("seq")), F.col("seq").cast("long")) * 1000).alias("t_ms"),
        F.get("place", F.lit(0)).alias("lat"), F.get("place", F.lit(1)).alias("lng"), F.get("alt", F.col("seq")).alias("altitude")
    )


def anchors(points: DataFrame, gate: float, *keys: str) -> DataFrame:
    """Per walk the first point to trust: the second, if the first step is too fast and the one after is not."""
    from trailmill.functions.geo import metres, speed

    order = Window.partitionBy(*keys).orderBy("seq")
    before = [F.lag(c).over(order) for c in ("lat", "lng", "t_ms")]
    step = speed(metres(before[0], before[1], F.col("lat"), F.col("lng")), (F.col("t_ms") - before[2]) / 1000)
    first = points.select(*keys, F.row_number().over(order).alias("k"), step.alias("step")).filter("k <= 3")
    at = lambda k: F.max(F.when(F.col("k") == k, F.col("step")))
    return first.groupBy(*keys).agg(F.coalesce((at(2) > gate) & (at(3) <= gate), F.lit(False)).cast("int").alias("anchor"))


def read_entries(raw: DataFrame) -> DataFrame:
    """Manual entries of texts in column ``raw``: what of them is an activity, with their key; ``bad`` says why one is refused."""
    e = F.from_json("raw", ENTRY)
    rows = raw.withColumn("e", e).withColumn("at", F.try_to_timestamp(F.col("e.occurredAt")))
    total = lambda c: F.aggregate("e.sets", F.lit(0).cast("double"), lambda a, s: a + F.coalesce(s[c].cast("double"), F.lit(0)))
    bad = F.when(F.col("e.exerciseId").isNull(), "no exercise").when(F.col("at").isNull(), "no time").when(F.coalesce(F.size("e.sets"), F.lit(0)) < 1, "no sets")
    zone = bare_zone(F.col("e.timezone"))
    bad = bad.when(zone.isNotNull() & ~known_zone(zone), "unknown zone")
    return rows.select(
        "user_id",
        F.sha2(F.concat_ws(":", F.lit("manual"), F.col("user_id").cast("string"), F.col("e.idempotencyKey")), 256).alias("ingest_key"),
        F.col("e.exerciseId").alias("exercise"),
        F.col("at").cast("timestamp_ntz").alias("started_at"),
        utc_to_local(F.col("at"), zone).alias("started_local"),
        F.nullif(total("distanceM"), F.lit(0.0)).alias("distance_m"),
        total("durationS").cast("long").alias("elapsed_s"),
        bad.alias("bad"),
    )


def parse_value(entry: Column, text: Column) -> Column:
    """What a typed text means to a row of this entry kind; null if nothing."""
    t = F.trim(text)
    part = lambda pattern, k=1: F.nullif(F.regexp_extract(t, pattern, k), F.lit(""))
    km, whole = F.replace(part(r"(?i)^(\d{1,3}(?:[.,]\d{1,2})?)\s*(?:km)?$"), F.lit(","), F.lit(".")), part(r"^(\d{1,5})$")
    mm, ss = part(r"^(\d{1,3}):([0-5]\d)$"), part(r"^(\d{1,3}):([0-5]\d)$", 2)
    seconds = F.coalesce(mm.cast("double") * 60 + ss.cast("double"), whole.cast("double"))
    return (
        F.when(entry == "distance", km.cast("double"))
        .when(entry == "minutes", part(r"(?i)^(\d{1,3})\s*(?:min)?$").cast("double"))
        .when(entry == "seconds", seconds)
        .otherwise(whole.cast("double"))
    )


def clamp(value: Column, least: Column, decimals: Column) -> Column:
    """Rounded half up to a row's decimals and not below its least; that for no number."""
    scale = F.pow(F.lit(10.0), decimals)
    return F.coalesce(F.greatest(least, F.floor(value * scale + 0.5) / scale), least)


def apportion(shares: DataFrame, *keys: str) -> DataFrame:
    """(keys, pos, percent, duration_s) to seconds: shares rounded down, what is left to the largest, the first of equal ones."""
    of = Window.partitionBy(*keys)
    part = F.floor(F.col("duration_s") * F.col("percent") / 100).cast("long")
    rows = shares.filter("percent > 0").withColumn("part", part)
    left = F.col("duration_s") - F.sum("part").over(of)
    largest = F.row_number().over(of.orderBy(F.desc("percent"), "pos")) == 1
    return rows.select(*keys, "pos", "percent", (F.col("part") + F.when(largest, left).otherwise(0)).alias("seconds"))


def decisions(events: DataFrame, subscription: str) -> DataFrame:
    """What each notification (user_id of its owner or null, raw) asks for, first failing check first, and the key of its receipt."""
    e = F.from_json("raw", EVENT)
    keys = F.json_object_keys("raw")
    rows = events.withColumn("e", e).withColumn("keys", keys)
    known = F.size(F.array_except("keys", F.array(*map(F.lit, EVENT_FIELDS)))) == 0
    is_id = lambda c: F.coalesce(F.col(c).rlike(r"^\d{1,20}$"), F.lit(False))
    aspect, kind = F.col("e.aspect_type"), F.col("e.object_type")
    decision = (
        F.when(F.col("keys").isNull(), "unparseable")
        .when(~known | aspect.isNull() | kind.isNull(), "unknown-fields")
        .when(~F.col("e.subscription_id").eqNullSafe(F.lit(subscription)), "wrong-subscription")
        .when(kind != "activity", "ignored-object-type")
        .when(~aspect.isin("create", "update", "delete"), "ignored-aspect")
        .when(~is_id("e.owner_id") | ~is_id("e.object_id"), "malformed-ids")
        .when((aspect == "update") & (F.coalesce(F.col("e.event_time").try_cast("long"), F.lit(0)) <= 0), "missing-event-time")
        .when(F.col("user_id").isNull(), "unknown-owner")
        .when(aspect == "delete", "retract")
        .when(aspect == "update", "reingest")
        .otherwise("enqueue")
    )
    head = F.concat_ws(":", F.col("source"), F.col("e.owner_id"), F.col("e.object_id"))
    text = F.when(F.col("decision") == "retract", F.concat(head, F.lit(":delete"))).when(F.col("decision") == "enqueue", head)
    text = text.when(F.col("decision") == "reingest", F.concat_ws(":", head, F.lit("update"), F.col("e.event_time")))
    return rows.withColumn("decision", decision).select("event_id", "user_id", "decision", F.sha2(text, 256).alias("ingest_key"))


def next_watermark(listed: DataFrame, overlap_s: int) -> DataFrame:
    """(user_id, previous, at, confirmed) to each user's next watermark: the oldest unconfirmed, else the newest confirmed, less the overlap; it may move back."""
    found = listed.groupBy("user_id").agg(
        F.max("previous").alias("previous"), F.min(F.when(~F.col("confirmed"), F.col("at"))).alias("gap"), F.max(F.when(F.col("confirmed"), F.col("at"))).alias("last")
    )
    boundary = F.coalesce("gap", "last")
    return found.select("user_id", F.coalesce(boundary - F.make_dt_interval(secs=F.lit(overlap_s)), F.col("previous")).alias("watermark"))
