"""Stored tables: the history of elements, clustered by object, and positions by date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HISTORY = "norad_id bigint, tle_epoch string, name string, l1 string, l2 string, inclination double, is_debris boolean, grp string"


def open_history(spark: SparkSession, name: str, path: str, buckets: int = 64) -> DataFrame:
    """The history of elements at path as table `name`: in buckets by norad_id, sorted by epoch. Made empty if it is not there.

    buckets must be what the table was made with. A session without a persistent catalogue opens it again by the same call.
    """
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({HISTORY}) USING parquet CLUSTERED BY (norad_id) SORTED BY (norad_id, tle_epoch) INTO {buckets} BUCKETS LOCATION '{path}'")
    spark.catalog.refreshTable(name)
    return spark.table(name)


def append_history(spark: SparkSession, name: str, catalog: DataFrame, buckets: int = 64) -> None:
    """Adds the records of a catalogue whose (norad_id, tle_epoch) the history does not have; what is there stays as it is.

    Of records of one object and epoch the first in load order is taken; one without an epoch is left out. A feed that is
    ingested again adds nothing. Objects meet by norad_id alone, as the table's buckets do, so the history is not shuffled: that
    epochs are equal is told by two comparisons, which Spark does not make a join key of. One writer at a time.
    """
    own = [c.split()[0] for c in HISTORY.split(", ")]
    order = F.struct("grp_ord", "part", "rec_no")
    new = catalog.where("norad_id is not null and tle_epoch <> ''").groupBy("norad_id", "tle_epoch").agg(F.min_by(F.struct(*own[2:]), order).alias("r")).select("norad_id", "tle_epoch", "r.*")
    new = new.repartition(buckets, "norad_id").alias("n")
    held = spark.table(name).select("norad_id", "tle_epoch").alias("h")
    same = F.expr("n.norad_id = h.norad_id and n.tle_epoch >= h.tle_epoch and n.tle_epoch <= h.tle_epoch")
    new.join(held, same, "left_anti").select(*own).write.insertInto(name)
    spark.catalog.refreshTable(name)


def history_as_of(history: DataFrame, asked: DataFrame, buckets: int = 64) -> DataFrame:
    """For each asked (norad_id, t_iso) the stored record of the latest epoch not after it: norad_id, t_iso, tle_epoch, name, l1, l2.

    A record holds from its epoch to the next one of its object; that window and the join go by norad_id alone, as the buckets
    do, so the history is read where it lies and only what is asked is dealt. An instant before an object's first epoch, and an
    unknown object, give no row; a repeated question gives repeated rows.
    """
    until = F.lead("tle_epoch").over(Window.partitionBy("norad_id").orderBy("tle_epoch"))
    held = history.select("norad_id", "tle_epoch", "name", "l1", "l2", until.alias("until"))
    asked = asked.select(F.col("norad_id").cast("bigint").alias("norad_id"), "t_iso").repartition(buckets, "norad_id")
    rows = asked.join(held, (asked["norad_id"] == held["norad_id"]) & (F.col("t_iso") >= F.col("tle_epoch")) & (F.col("until").isNull() | (F.col("t_iso") < F.col("until"))))
    return rows.select(asked["norad_id"], "t_iso", "tle_epoch", "name", "l1", "l2")
