"""The element catalogue: framing, parsing, search, lookup, and elements as of an instant."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C


def lines(text: DataFrame) -> DataFrame:
    """(grp, part, line_no, line): split at line ends, empty lines dropped, blank ones kept."""
    kept = F.filter(F.split("body", "\r?\n"), lambda x: x != "")
    return text.select("grp", "part", F.posexplode(kept).alias("line_no", "line"))


def records(text: DataFrame) -> DataFrame:
    """(grp, part, rec_no, name, l1, l2): three lines a record by place; a cut tail is dropped. Narrow."""
    rows = text.select("grp", "part", F.filter(F.split("body", "\r?\n"), lambda x: x != "").alias("ln")).where("size(ln) >= 3")
    rows = rows.select("grp", "part", "ln", F.explode(F.sequence(F.lit(0), F.floor(F.size("ln") / 3).cast("int") - 1)).alias("rec_no"))
    return rows.select("grp", "part", "rec_no", *[F.get("ln", 3 * F.col("rec_no") + i).alias(c) for i, c in enumerate(("name", "l1", "l2"))])


def parse(recs: DataFrame, groups: list[str]) -> DataFrame:
    """The catalogue: records without a number are left out; grp_ord, part, rec_no give the load order. No dedupe."""
    order = F.array_position(F.array(*[F.lit(g) for g in groups]), F.col("grp")).cast("int")
    rows = recs.where(F.col("grp").isin(list(groups))).select(C.norad_id(F.col("l1")).alias("norad_id"), "name", "l1", "l2", C.inclination(F.col("l2")).alias("inclination"), C.epoch_iso(F.col("l1")).alias("tle_epoch"), C.is_debris(F.col("name")).alias("is_debris"), "grp", order.alias("grp_ord"), "part", "rec_no")
    return rows.where("norad_id is not null")


def elements(catalog: DataFrame) -> DataFrame:
    """Orbital elements in degrees and revolutions a day, the drag term with its implied decimal point."""
    at = lambda c, a, n: C.number_prefix(F.substring(c, a, n))
    mantissa = F.regexp_replace(F.substring("l1", 54, 6), " ", "")
    bstar = mantissa.try_cast("double") * 1e-5 * F.pow(F.lit(10.0), F.regexp_replace(F.substring("l1", 60, 2), " ", "").try_cast("double"))
    return catalog.select("norad_id", "tle_epoch", bstar.alias("bstar"), at("l2", 9, 8).alias("incl_deg"), at("l2", 18, 8).alias("node_deg"), F.concat(F.lit("0."), F.trim(F.substring("l2", 27, 7))).try_cast("double").alias("ecc"), at("l2", 35, 8).alias("argp_deg"), at("l2", 44, 8).alias("mean_deg"), at("l2", 53, 11).alias("rev_day"))


def search(catalog: DataFrame, query: str, limit: int = 20) -> DataFrame:
    """The first `limit` objects in load order whose name or number holds the query; a blank query finds none."""
    if not query.strip():
        return catalog.limit(0)
    q = query.lower()
    hit = F.lower("name").contains(q) | F.col("norad_id").cast("string").contains(q)
    return catalog.where(hit).orderBy("grp_ord", "part", "rec_no").limit(limit)


def current(catalog: DataFrame) -> DataFrame:
    """The first record of each object in load order: a hash aggregate, no sort."""
    order = F.struct("grp_ord", "part", "rec_no")
    own = [c for c in catalog.columns if c != "norad_id"]
    return catalog.groupBy("norad_id").agg(F.min_by(F.struct(*own), order).alias("r")).select("norad_id", "r.*")


def point_details(points: DataFrame, catalog: DataFrame) -> DataFrame:
    """Points with their catalogue row; a point without one is dropped."""
    return points.join(current(catalog).select("norad_id", "name", "inclination", "tle_epoch"), "norad_id").withColumn("orbit_type", C.inclination_class(F.col("inclination")))


def as_of_elements(history: DataFrame, asked: DataFrame) -> DataFrame:
    """For each asked (norad_id, t_iso) the record of the latest epoch not after it; none, no row.

    Records and instants are put in one order of time within an object, so no product of the two is formed.
    """
    rows = history.where("tle_epoch <> ''").select("norad_id", F.col("tle_epoch").alias("t_iso"), F.lit(0).alias("asked"), "grp_ord", "part", "rec_no", F.struct("tle_epoch", "name").alias("r"))
    both = rows.unionByName(asked.select("norad_id", "t_iso", F.lit(1).alias("asked")), allowMissingColumns=True)
    order = Window.partitionBy("norad_id").orderBy("t_iso", "asked", "grp_ord", "part", "rec_no").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("r", F.last("r", ignorenulls=True).over(order)).where("asked = 1 and r is not null").select("norad_id", "t_iso", "r.*")
