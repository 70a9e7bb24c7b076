"""Position ticks: the whole catalogue at the instants of a clock."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import propagate
from ..sources.feeds import publish


def clock(spark: SparkSession) -> DataFrame:
    """A stream of instants, one a second."""
    return spark.readStream.format("rate").option("rowsPerSecond", 1).load().select("timestamp")


def positions_query(ticks: DataFrame, catalog: DataFrame, path: str, checkpoint: str, seconds: int = 10, **trigger):
    """The whole catalogue's positions at the last instant of each batch of ticks (timestamp). A batch without one writes nothing.

    The batch number is in the path, so a batch that runs twice, as after a restart, replaces itself.
    """

    def each(batch: DataFrame, n: int) -> None:
        at = batch.agg(F.max(F.unix_micros("timestamp"))).first()[0]
        if at is not None:
            publish(propagate.positions(catalog, int(at)), f"{path}/batch={n}")

    return ticks.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**(trigger or {"processingTime": f"{seconds} seconds"})).start()
