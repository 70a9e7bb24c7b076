"""Propagation of a catalogue to instants, as an Arrow job: rows times instants, vectorised in each batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import sgp4
from .catalog import elements

SCHEMA = "norad_id bigint, ts_us bigint, x double, y double, z double, vx double, vy double, vz double, lat double, lon double, alt_km double, prop_ok boolean"
_OUT = [c.split()[0] for c in SCHEMA.split(", ")]


def _states(p: pd.DataFrame, ts_us: np.ndarray) -> pd.DataFrame:
    """The states of objects p at instants, a row of ts_us for each; those of one object follow each other."""
    per_day = 2 * np.pi / 1440
    angle = lambda c: np.radians(p[c].to_numpy(float))
    minutes = (ts_us - p["epoch_us"].to_numpy(float)[:, None]) / 60e6
    r, v, ok = sgp4.propagate_grid(minutes, p["bstar"], p["ecc"], angle("incl_deg"), angle("node_deg"), angle("argp_deg"), angle("mean_deg"), p["rev_day"].to_numpy(float) * per_day, p["epoch_us"].to_numpy(float) / 86400e6 + 2440587.5)
    with np.errstate(all="ignore"):
        lat, lon, alt = sgp4.geodetic(*r, sgp4.sidereal(ts_us / 86400e6 + 2440587.5))
    ok = ok & np.isfinite(lat + lon + alt)
    blank = [np.where(ok, x, np.nan).ravel() for x in (*r, *v, lat, lon, alt)]
    return pd.DataFrame(dict(zip(_OUT, [np.repeat(p["norad_id"].to_numpy(), ts_us.shape[1]), ts_us.ravel().astype("int64"), *blank, ok.ravel()], strict=True)))


def _ready(catalog: DataFrame) -> DataFrame:
    return elements(catalog).withColumn("epoch_us", F.unix_micros(F.try_to_timestamp("tle_epoch"))).drop("tle_epoch")


def _settled(out: DataFrame, on_fail: str) -> DataFrame:
    """Rows of failed objects with null numbers, zeros, or not at all."""
    numbers = _OUT[2:-1]
    if on_fail == "drop":
        return out.where("prop_ok")
    if on_fail not in ("null", "zero"):
        raise ValueError("on_fail is null, zero or drop")
    other = F.lit(None if on_fail == "null" else 0.0).cast("double")
    return out.withColumns({c: F.when(F.col("prop_ok"), F.col(c)).otherwise(other) for c in numbers})


def ephemeris(catalog: DataFrame, ticks_us: list[int], on_fail: str = "null", ordered: bool = False) -> DataFrame:
    """Every object at every instant. The instants travel with the function: no cross join is shuffled.

    An object that cannot be propagated has prop_ok false and, by on_fail, null numbers, zeros, or no row. Filter the
    catalogue first: predicates do not go through this step. The catalogue is spread first, as a feed has few files; with
    ordered, by ranges of norad_id.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = max(1, 200_000 // max(1, len(ticks_us)))
        for p in batches:
            for at in range(0, len(p), step):
                part = p.iloc[at : at + step]
                yield _states(part, np.tile(np.array(ticks_us, float), (len(part), 1)))

    ready = _ready(catalog)
    return _settled((ready.repartitionByRange("norad_id") if ordered else ready.repartition("norad_id")).mapInPandas(run, SCHEMA), on_fail)


def predict_at(rows: DataFrame, on_fail: str = "null") -> DataFrame:
    """Catalogue rows with an instant each, in ts_us: their other columns, but l1, l2 and tle_epoch, and the state then."""
    own = [c for c in rows.columns if c not in ("l1", "l2", "tle_epoch")]
    kept = [c for c in own if c not in ("norad_id", "ts_us")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = _states(p, p["ts_us"].to_numpy(float)[:, None])
            out[kept] = p[kept].to_numpy(object)
            yield out

    # the elements of a row travel with all of its columns
    named = rows.select("l1", "l2", "tle_epoch", F.struct(*own).alias("norad_id"))
    at = elements(named).select("norad_id.*", "bstar", "incl_deg", "node_deg", "ecc", "argp_deg", "mean_deg", "rev_day", F.unix_micros(F.try_to_timestamp("tle_epoch")).alias("epoch_us"))
    schema = ", ".join([SCHEMA, *[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept]])
    return _settled(at.mapInPandas(run, schema), on_fail)


def write_positions(catalog: DataFrame, ticks_us: list[int], path: str) -> None:
    """Writes every object at every instant to the positions table, in folders by date. Dates that are written are replaced as a
    whole; others stay.

    The catalogue is dealt by ranges of norad_id before it is propagated, and files are in order of norad_id, so that readers of
    one object pass over the files and row groups of others.
    """
    rows = ephemeris(catalog, ticks_us, ordered=True).withColumn("date", F.to_date(F.timestamp_micros("ts_us")))
    rows.sortWithinPartitions("date", "norad_id", "ts_us").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def read_positions(spark: SparkSession, path: str, first_us: int | None = None, last_us: int | None = None) -> DataFrame:
    """The positions table from first_us to last_us, both ends included; folders of other dates are not read."""
    rows = spark.read.schema(f"{SCHEMA}, date date").parquet(path)
    for us, keep in ((first_us, lambda c, v: c >= v), (last_us, lambda c, v: c <= v)):
        if us is not None:
            rows = rows.where(keep(F.col("date"), F.to_date(F.timestamp_micros(F.lit(us)))) & keep(F.col("ts_us"), F.lit(us)))
    return rows


def position_at(table: DataFrame, norad_id: int, tick, time: str = "ts_us") -> DataFrame:
    """The stored position of one object at one instant."""
    return table.where((F.col("norad_id") == norad_id) & (F.col(time) == tick))


def positions_since(table: DataFrame, norad_id: int, since, time: str = "ts_us") -> DataFrame:
    """The stored positions of one object after an instant."""
    return table.where((F.col("norad_id") == norad_id) & (F.col(time) > since))


def positions(catalog: DataFrame, as_of_us: int) -> DataFrame:
    """The fleet at one instant, failures dropped."""
    return ephemeris(catalog, [as_of_us], "drop")


def with_speed(states: DataFrame) -> DataFrame:
    return states.withColumn("speed", F.coalesce(F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy") + F.col("vz") * F.col("vz")), F.lit(0.0)))


def details(catalog: DataFrame, norad_id: int, as_of_us: int) -> DataFrame:
    """One object now: place, speed and label, with the digits shown; no row if it cannot be propagated."""
    one = catalog.where(F.col("norad_id") == norad_id).orderBy("grp_ord", "part", "rec_no").limit(1)
    rows = with_speed(positions(one, as_of_us)).join(one.select("norad_id", "name", "inclination"), "norad_id")
    shown = lambda c, n: F.format_string(f"%.{n}f", F.col(c)).alias(c)
    return rows.select("norad_id", "name", shown("lat", 2), shown("lon", 2), shown("alt_km", 0), shown("speed", 2), shown("inclination", 2), C.inclination_class(F.col("inclination")).alias("orbit_type"))
