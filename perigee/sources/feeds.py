"""Scans of element and telemetry feeds, and publication of results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Groups read when none is asked for, in load order.
DEFAULT_GROUPS = ["visual", "1999-025", "iridium-33-debris"]
TELEMETRY = "event_id bigint, norad_id bigint, ts timestamp, lat double, lon double, alt_km double"


def tle_scan(spark: SparkSession, path: str, groups: list[str] | None = None, format: str = "tle") -> DataFrame:
    """(grp, part, body), one row a file, of the files under path/grp=<name>/; part is the file's name, by which files are ordered.

    A group that is not there is left out, and folders of other groups are not read. Only tle is read.
    """
    if format != "tle":
        raise ValueError("only the tle format is read")
    rows = spark.read.schema("value string, grp string").text(path, wholetext=True)
    return rows.where(F.col("grp").isin(list(groups or DEFAULT_GROUPS))).select("grp", F.col("_metadata.file_name").alias("part"), F.col("value").alias("body"))


def telemetry_scan(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """(event_id, norad_id, tel_us, o_lat, o_lon, o_alt): readings as the health operators take them, from Parquet of TELEMETRY."""
    rows = (spark.readStream if stream else spark.read).schema(TELEMETRY).parquet(path)
    return rows.select("event_id", "norad_id", F.unix_micros("ts").alias("tel_us"), F.col("lat").alias("o_lat"), F.col("lon").alias("o_lon"), F.col("alt_km").alias("o_alt"))


def publish(df: DataFrame, path: str, partition: str | None = None) -> None:
    """Replaces the table at path as a whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition) if partition else writer).parquet(path)
