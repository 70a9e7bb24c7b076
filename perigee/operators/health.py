"""Telemetry against prediction: the rule cascade, fleet summaries, history and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C

STATUSES = ["Healthy", "Warning", "Critical"]
CLASSES = ["LEO", "MEO", "GEO", "Debris"]
#: A reading older than the largest critical age cannot change a status, so readings need not be waited for longer.
WATERMARK_S = 43_200


def latest(telemetry: DataFrame) -> DataFrame:
    """The last reading of each object, ties by event_id: a partial hash aggregate."""
    own = [c for c in telemetry.columns if c != "norad_id"]
    return telemetry.groupBy("norad_id").agg(F.max_by(F.struct(*own), F.struct("tel_us", "event_id")).alias("r")).select("norad_id", "r.*")


def fleet_join(objects: DataFrame, readings: DataFrame) -> DataFrame:
    """Every object with its reading or none."""
    return objects.join(readings, "norad_id", "left")


def rated(rows: DataFrame, thresholds: DataFrame) -> DataFrame:
    """rows of (is_debris, lat, lon, alt predicted; o_lat, o_lon, o_alt) with orbit_class, the limits of the class and deviation_km.

    Of thresholds at most one row for each of the four classes is taken, so it is broadcast; a class without one has null limits.
    """
    limits = ["warn_km", "crit_km", "warn_age_s", "crit_age_s"]
    four = thresholds.where(F.col("orbit_class").isin(CLASSES)).groupBy("orbit_class").agg(F.min(F.struct(*limits)).alias("t")).select("orbit_class", "t.*")
    rows = rows.withColumn("orbit_class", C.orbit_class(F.col("alt"), F.col("is_debris"))).join(F.broadcast(four), "orbit_class", "left")
    return rows.withColumn("deviation_km", C.distance_km(tuple(map(F.col, ("lat", "lon", "alt"))), tuple(map(F.col, ("o_lat", "o_lon", "o_alt")))))


def fresh_reason() -> Column:
    """What the cascade gives for a rated reading of no age."""
    dev = F.col("deviation_km")
    return F.when(~F.isnan(dev) & (dev >= F.col("crit_km")), "large_deviation").when(~F.isnan(dev) & (dev >= F.col("warn_km")), "deviation_warning").otherwise("ok")


def assess(rows: DataFrame, thresholds: DataFrame, as_of_us: Column) -> DataFrame:
    """The cascade over rows of (norad_id, is_debris, lat, lon, alt predicted; tel_us, o_lat, o_lon, o_alt or null).

    In a class without thresholds, tests against them are false. A test on a value that is no number is false.
    """
    rows = rated(rows, thresholds).withColumn("age_s", C.age_seconds(as_of_us, F.col("tel_us"))).withColumn("fresh", fresh_reason())
    age, known = F.col("age_s"), ~F.isnan("age_s")
    reason = (
        F.when(F.col("tel_us").isNull(), "no_telemetry")
        .when(known & (age > F.col("crit_age_s")), "stale_telemetry")
        .when((F.col("fresh") == "ok") & known & (age >= F.col("warn_age_s")), "stale_warning")
        .otherwise(F.col("fresh"))
    )
    rows = rows.withColumn("reason", reason)
    status = F.when(F.col("reason") == "ok", "Healthy").when(F.col("reason").endswith("warning"), "Warning").otherwise("Critical")
    observed = F.when(F.col("tel_us").isNotNull(), F.struct(F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon"), F.col("o_alt").alias("alt_km")))
    predicted = F.struct("lat", "lon", F.col("alt").alias("alt_km"))
    kept = [c for c in ("tick_us",) if c in rows.columns]
    return rows.select(*kept, "norad_id", "orbit_class", status.alias("status"), "reason", "age_s", "deviation_km", predicted.alias("predicted"), observed.alias("observed"))


def summary(health: DataFrame, by: list[str] | None = None, total: bool = False) -> DataFrame:
    """total, healthy, warning, critical, health_percent in one pass; one row on no input unless grouped. With total, a row
    over all groups, whose group columns are null, is added."""
    counts = [F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s.lower()) for s in STATUSES]]
    rows = (health.rollup(*by) if total else health.groupBy(*by)).agg(*counts) if by else health.agg(*counts)
    if by and total:  # no subtotals in between
        rows = health.groupBy(*by).agg(*counts).unionByName(health.agg(*counts, *[F.lit(None).cast(health.schema[c].dataType).alias(c) for c in by])) if len(by) > 1 else rows
    return rows.withColumn("health_percent", F.when(F.col("total") > 0, F.col("healthy") / F.col("total") * 100).otherwise(0.0))


def distribution(health: DataFrame) -> DataFrame:
    """Rows (status, value, percent) without zeros."""
    s = summary(health)
    rows = s.select("total", F.explode(F.array(*[F.struct(F.lit(n).alias("status"), F.col(n.lower()).alias("value")) for n in STATUSES])).alias("r")).select("total", "r.*")
    return rows.where("value > 0").select("status", "value", C.half_up(F.col("value") / F.col("total") * 100).cast("bigint").alias("percent"))


def readings_by_tick(objects: DataFrame, telemetry: DataFrame, first_us: int, last_us: int, step_us: int = 30_000_000) -> DataFrame:
    """Every object at every tick from first_us to last_us, with its last reading up to the tick, or none.

    A reading holds from the first tick not before it to the one before the next reading's, so each reading, sorted within its
    object, gives its own ticks: no product of ticks and readings is formed. Of equal times the larger event_id holds. Of the
    readings of one tick all but the last hold for none, so they are told by the same sort and not before the shuffle, where a
    task would sort all it reads; and ticks are put out after the join, which sorts a row a reading instead of a row a tick.
    """
    tick = F.greatest(F.lit(0), F.ceil((F.col("tel_us") - first_us) / step_us)).cast("bigint")
    own = [c for c in telemetry.columns if c != "norad_id"]
    rows = telemetry.where(F.col("tel_us").isNotNull() & (F.col("tel_us") <= last_us)).select("norad_id", tick.alias("from"), F.struct(*own).alias("r"))
    rows = rows.unionByName(objects.select("norad_id", F.lit(0).cast("bigint").alias("from"), F.lit(None).cast(rows.schema["r"].dataType).alias("r")))
    order = Window.partitionBy("norad_id").orderBy("from", F.col("r").isNotNull(), "r.tel_us", "r.event_id")
    ticks = (last_us - first_us) // step_us + 1
    rows = rows.withColumn("to", F.lead("from", 1, ticks).over(order) - 1).where("to >= `from`")
    rows = objects.join(rows, "norad_id").select(*[objects[c] for c in objects.columns], "r.*", F.explode(F.sequence("from", "to")).alias("k"))
    return rows.withColumn("tick_us", F.lit(first_us) + F.col("k") * step_us).drop("k")


def by_tick(objects: DataFrame, telemetry: DataFrame, observed, thresholds: DataFrame, first_us: int, last_us: int, step_us: int = 30_000_000) -> DataFrame:
    """(tick_us, total, healthy, warning, critical, health_percent): the fleet's summary at every tick.

    observed turns rows of objects with their readings into rows for assess, keeping tick_us.
    """
    rows = observed(readings_by_tick(objects, telemetry, first_us, last_us, step_us))
    return summary(assess(rows, thresholds, F.col("tick_us")), ["tick_us"])


def valid(points: DataFrame) -> DataFrame:
    """Points but those of a failed prediction, which are exactly (0, 0, 0)."""
    return points.where("not (lat = 0 and lon = 0 and alt = 0)")


def history(points: DataFrame, keep: int = 50) -> DataFrame:
    """The last `keep` of (tick_us, value), one row a tick."""
    return points.groupBy("tick_us").agg(F.max("value").alias("value")).orderBy(F.desc("tick_us")).limit(keep)


def trend(points: DataFrame, shown: int = 20) -> DataFrame:
    rows = history(points, 50).orderBy(F.desc("tick_us")).limit(shown)
    return rows.select("tick_us", F.date_format(F.timestamp_micros("tick_us"), "HH:mm").alias("label"), C.half_up(F.col("value")).cast("bigint").alias("value"))


def overview(points: DataFrame, active: list[str]) -> DataFrame:
    """Counts by class and of the classes shown, in one pass; an altitude that is no number counts in no altitude class."""
    d, ok, alt = F.coalesce("is_debris", F.lit(False)), ~F.isnan("alt"), F.col("alt")
    shown = F.count_if(C.orbit_class(alt, d).isin(active)) if active else F.lit(0).cast("bigint")
    return points.agg(F.count_if(d).alias("debris"), F.count_if(~d & ok & (alt <= 1000)).alias("leo"), F.count_if(~d & ok & (alt > 1000) & (alt <= 2000)).alias("meo"), F.count_if(~d & ok & (alt > 2000)).alias("geo"), F.count("*").alias("total"), shown.alias("filtered"))


def class_filter(points: DataFrame, active: list[str]) -> DataFrame:
    return points.where(C.orbit_class(F.col("alt"), F.col("is_debris")).isin(active) if active else F.lit(False))


def running_latest(telemetry: DataFrame) -> DataFrame:
    """For each reading the latest one so far of its object, by event time."""
    w = Window.partitionBy("norad_id").orderBy("tel_us", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return telemetry.select("norad_id", "event_id", "tel_us", F.last("dalt", ignorenulls=True).over(w).alias("dalt_so_far"))
