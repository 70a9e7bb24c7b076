"""Fleet health as streams with state: statuses that age on a clock, counts by retraction, ticks of event time, the history.

Statuses are told by three stateful steps. status_changes keeps the last reading of each object and a timer at the next warning or
critical age of a bucket of them, so that an object that falls silent changes without any row of its own. fleet_counts keeps counts of a
fleet and adds what each change takes from one status and gives to another. tick_health carries each object's last reading
over ticks of event time, once the watermark has passed them. Time is that of the rows: clock rows, which have no object,
move it on when no telemetry comes. No step reads the machine's clock.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timezone
from itertools import accumulate

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators import health

#: The statuses of the reasons of the cascade.
STATUS = {"ok": "Healthy", "deviation_warning": "Warning", "stale_warning": "Warning", "no_telemetry": "Critical", "stale_telemetry": "Critical", "large_deviation": "Critical"}
#: Points of a fleet's history.
KEEP = 50
CHANGES = "norad_id bigint, fleet string, seq bigint, at timestamp, old_reason string, new_reason string, old_status string, new_status string"
COUNTS = "fleet string, at timestamp, total bigint, healthy bigint, warning bigint, critical bigint, health_percent double"
#: A limit that is null, and the bucket of a clock's rows, where rows have no nulls.
NEVER, CLOCK = 2**63 - 1, -1
_READING = "tel_us bigint, event_id bigint, fresh string, warn_us bigint, crit_us bigint"


def stateful(spark: SparkSession) -> None:
    """Timers and list state need this state store; a session that has set one keeps it if it is of that kind."""
    name = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(name, ""):
        spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def instant(us: int) -> datetime:
    return datetime.fromtimestamp(us // 1_000_000, timezone.utc).replace(microsecond=us % 1_000_000)


def reason_at(fresh: str, age_us: int, warn_us: int | None, crit_us: int | None) -> str:
    """The cascade for a reading of a certain age; fresh is what it gives for one of no age. A limit that is null is never met."""
    if crit_us is not None and age_us > crit_us:
        return "stale_telemetry"
    if fresh == "ok" and warn_us is not None and age_us >= warn_us:
        return "stale_warning"
    return fresh


def due_ms(reading: tuple, after_ms: int) -> int | None:
    """The next millisecond after after_ms at which the reading's reason changes by age; none if it does not."""
    tel, _, fresh, warn, crit = reading[:5]
    times = [-(-(tel + warn) // 1000)] if fresh == "ok" and warn is not None else []
    times += [(tel + crit) // 1000 + 1] if crit is not None else []
    return min((t for t in times if t > after_ms), default=None)


def rated_readings(telemetry: DataFrame, objects: DataFrame, observed, thresholds: DataFrame, time: str = "ts", fleet: str | None = None) -> DataFrame:
    """(norad_id, fleet, ts, seen_us, tel_us, event_id, fresh, warn_us, crit_us): readings, met with their objects and judged but for age.

    telemetry may be a stream; objects and thresholds are tables, and observed is as in health.by_tick. time names the column
    of telemetry by which lateness is judged. A reading without a time, or of no known object, is left out.
    """
    rows = health.rated(observed(telemetry.where("tel_us is not null").join(objects, "norad_id")), thresholds)
    return rows.select("norad_id", (F.col(fleet) if fleet else F.lit("all")).alias("fleet"), F.col(time).alias("ts"), F.unix_micros(time).alias("seen_us"), "tel_us", "event_id", health.fresh_reason().alias("fresh"), (F.col("warn_age_s") * 1_000_000).alias("warn_us"), (F.col("crit_age_s") * 1_000_000).alias("crit_us"))


def with_clock(readings: DataFrame, clock: DataFrame | None, late_s: int) -> DataFrame:
    """readings and the instants of clock (ts), under one watermark: late_s behind the latest of both."""
    if clock is not None:
        readings = readings.unionByName(clock.select("ts"), allowMissingColumns=True)
    return readings.withWatermark("ts", f"{late_s} seconds")


class _Ageing(StatefulProcessor):
    """The last readings of a bucket's objects, each with the reason it stands for at the watermark and when that is due to change."""

    def init(self, handle) -> None:
        fields = f"norad_id bigint, {_READING}, fleet string, reason string, seq bigint, since_us bigint, due_ms bigint".split(", ")
        self.handle, self.held = handle, handle.getValueState("held", ", ".join(f"{name} array<{kind}>" for name, kind in map(str.split, fields)))

    def _settle(self, norad_id: int, fleet: str, old: str, new: str, seq: int, since_us: int, at_us: int) -> tuple[int, int]:
        """The number and instant of the object's last change, of which there is one more if the reason is new; none is before the last."""
        if old == new:
            return seq, since_us
        at_us = max(at_us, since_us)
        self.out.append((norad_id, fleet, seq + 1, at_us, old, new, STATUS[old], STATUS[new]))
        return seq + 1, at_us

    def _move(self, readings: dict[int, tuple], now_ms: int, fired: int | None = None) -> Iterator:
        """Takes each object's reading if it is later than the last, and ages the others to now_ms. The bucket's timer is at the
        next of their times; fired is the one that has brought this about, which is gone afterwards."""
        import pandas as pd

        self.out, touched = [], False
        held = {i: tuple(r) for i, *r in zip(*(self.held.get() or ()), strict=True)}
        timer = min((r[9] for r in held.values() if r[9] is not None), default=None)
        for i, (*reading, fleet, seen_us) in readings.items():
            old = held.get(i)
            if old and old[:2] >= tuple(reading[:2]):
                continue
            reason = reason_at(reading[2], now_ms * 1000 - reading[0], *reading[3:])
            before, seq, since = old[6:9] if old else ("no_telemetry", 0, 0)
            seq, since = self._settle(i, fleet, before, reason, seq, since, seen_us)
            held[i], touched = (*reading, fleet, reason, seq, since, due_ms(reading, now_ms)), True
        for i, r in held.items() if timer is not None and timer <= now_ms else ():
            reading, (fleet, reason, seq, since, due) = r[:5], r[5:]
            while due is not None and due <= now_ms:  # a watermark that jumps passes both ages at once
                new = reason_at(reading[2], due * 1000 - reading[0], *reading[3:])
                seq, since = self._settle(i, fleet, reason, new, seq, since, due * 1000)
                reason, due, touched = new, due_ms(reading, due), True
            held[i] = (*reading, fleet, reason, seq, since, due)
        if touched:
            self.held.update(tuple(map(list, zip(*((i, *r) for i, r in held.items()), strict=True))))
        due = min((r[9] for r in held.values() if r[9] is not None), default=None)
        if due != timer:
            if timer is not None and timer != fired:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if self.out:
            rows = pd.DataFrame(self.out, columns=["norad_id", "fleet", "seq", "at", "old_reason", "new_reason", "old_status", "new_status"])
            yield rows.assign(at=pd.to_datetime(rows["at"], unit="us", utc=True))

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        best: dict = {}
        for part in rows if key[0] != CLOCK else ():
            for i, *r in zip(*(part[c].tolist() for c in ("norad_id", "tel_us", "event_id", "fresh", "warn_us", "crit_us", "fleet", "seen_us")), strict=True):
                if i not in best or tuple(r[:2]) > tuple(best[i][:2]):
                    best[i] = (*r[:3], *[None if us == NEVER else us for us in r[3:5]], *r[5:])
        if best:
            yield from self._move(best, max(0, timerValues.getCurrentWatermarkInMs()))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        yield from self._move({}, timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass


def status_changes(readings: DataFrame, clock: DataFrame | None = None, late_s: int = 60, buckets: int = 4096) -> DataFrame:
    """A stream of CHANGES: every change of an object's reason, by a new reading or by age. An object begins with no_telemetry;
    seq numbers its changes, and at, the instant of each, never falls.

    readings are those of rated_readings, whose ts is the time a reading was seen: a reading seen more than late_s behind the
    latest row is dropped, however old its own time may be, and so is one without that time. Ages count to the watermark, so that
    after each batch every object's reason is that of its last reading so far at the watermark, whatever the order of arrival. Of
    equal times the larger event_id holds.

    State is kept in buckets of objects by hash, each with one value and one timer, as a call of the state costs as much as some
    dozens of objects: a batch costs the buckets that have readings or whose timer is due. buckets (some thousand objects each)
    must stay what the checkpoint was made with. Rows reach the state through pandas, where a column with nulls is one of doubles,
    so none has any.
    """
    stateful(readings.sparkSession)
    rows = with_clock(readings, clock, late_s)
    known = F.col("norad_id").isNotNull() & F.col("tel_us").isNotNull() & F.col("ts").isNotNull()
    rows = rows.withColumn("bucket", F.when(known, F.pmod(F.xxhash64("norad_id"), F.lit(buckets))).otherwise(CLOCK))
    filled = {c: F.coalesce(c, F.lit(v)) for c, v in (("norad_id", 0), ("seen_us", 0), ("tel_us", 0), ("event_id", -NEVER - 1), ("warn_us", NEVER), ("crit_us", NEVER))}
    return rows.withColumns(filled).groupBy("bucket").transformWithStateInPandas(_Ageing(), CHANGES, "Append", "EventTime", eventTimeColumnName="at")


class _Counts(StatefulProcessor):
    """How many objects of a fleet are in each status."""

    def init(self, handle) -> None:
        self.counts = handle.getValueState("counts", "healthy bigint, warning bigint, critical bigint")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.counts.update((0, 0, int(initialState["total"])))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        counts, at = list(self.counts.get() or (0, 0, 0)), None
        for r in rows:
            counts = [c + r[s] for c, s in zip(counts, ("healthy", "warning", "critical"), strict=True)]
            at = r["at"] if at is None else max(at, r["at"])
        self.counts.update(tuple(counts))
        total = sum(counts)
        yield Row(fleet=key[0], at=at, total=total, healthy=counts[0], warning=counts[1], critical=counts[2], health_percent=counts[0] / total * 100 if total else 0.0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


def fleet_counts(changes: DataFrame, fleets: DataFrame) -> DataFrame:
    """A stream of COUNTS: a fleet's summary after each batch of changes (a stream of CHANGES) that has some of its objects.

    fleets (fleet, total) gives the number of objects, all of which begin as Critical. Each change takes one from its old
    status and gives one to its new; a task adds up its own first, so a large fleet sends one row a task to its counts.
    """
    stateful(changes.sparkSession)

    def add_up(batches):
        sums: dict = {}
        for batch in batches:
            for fleet, at, old, new in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                one = sums.setdefault(fleet, [at, 0, 0, 0])
                one[0] = max(one[0], at)
                one[1 + health.STATUSES.index(old)] -= 1
                one[1 + health.STATUSES.index(new)] += 1
        if sums:
            import pyarrow as pa

            columns = [list(sums), *zip(*sums.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.timestamp("us", "UTC"), *[pa.int64()] * 3), strict=True)], ["fleet", "at", "healthy", "warning", "critical"])

    sums = changes.select("fleet", "at", "old_status", "new_status").mapInArrow(add_up, "fleet string, at timestamp, healthy bigint, warning bigint, critical bigint")
    return sums.groupBy("fleet").transformWithState(_Counts(), COUNTS, "Update", "None", initialState=fleets.groupBy("fleet"))


class _Ticks(StatefulProcessor):
    """The last readings of a bucket's objects at their last tick, and the readings after it."""

    def __init__(self, step_ms: int) -> None:
        self.step_ms = step_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.last, self.later = handle.getListState("last", f"norad_id bigint, {_READING}, fleet string"), handle.getListState("later", f"norad_id bigint, {_READING}")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.last.put([(o["norad_id"], None, None, "no_telemetry", None, None, o["fleet"]) for o in initialState["objects"]])
        self.handle.registerTimer(int(initialState["first_ms"]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [tuple(r[c] for c in ("norad_id", "tel_us", "event_id", "fresh", "warn_us", "crit_us")) for r in rows if r["tel_us"] is not None]
        if key[0] is not None and new:
            self.later.appendList(new)
        return iter(())

    def _pieces(self, reading: tuple, at_us: int, k: int, end: int) -> Iterator[tuple[str, int, int]]:
        """The statuses that a reading stands for from tick k up to end, of which tick 0 is at_us; no more than three."""
        tel, _, fresh, warn, crit = reading
        step = self.step_ms * 1000
        stale = end if tel is None or crit is None else min(end, max(k, (tel + crit - at_us) // step + 1))
        old = stale if fresh != "ok" or warn is None else min(stale, max(k, -((at_us - tel - warn) // step)))
        yield from ((STATUS[fresh], k, old), ("Warning", old, stale), ("Critical", stale, end))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        tick, until = expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()
        n, later, kept, rest, moves = (until - tick) // self.step_ms + 1, {}, [], [], {}
        for i, *r in self.later.get():
            later.setdefault(i, []).append(tuple(r))
        for i, *last, fleet in self.last.get():
            counts = moves.setdefault(fleet, {s: [0] * (n + 1) for s in health.STATUSES})
            new, k, at = sorted(later.get(i, ()), key=lambda r: r[:2]), 0, 0
            while True:
                end = max(k, -((tick * 1000 - new[at][0]) // (self.step_ms * 1000))) if at < len(new) else n
                for status, first, to in self._pieces(tuple(last), tick * 1000, k, min(end, n)):
                    if first < to:  # one more from first on, one less from to on
                        counts[status][first] += 1
                        counts[status][to] -= 1
                if end >= n:
                    break
                last, at, k = new[at], at + 1, end
            kept.append((i, *last, fleet))
            rest += [(i, *r) for r in new[at:]]
        for fleet, counts in moves.items():
            for k, (healthy, warning, critical) in enumerate(zip(*[list(accumulate(counts[s]))[:n] for s in health.STATUSES], strict=True)):
                yield Row(fleet=fleet, tick=instant((tick + k * self.step_ms) * 1000), healthy=healthy, warning=warning, critical=critical)
        self.last.put(kept)
        if rest:
            self.later.put(rest)
        else:
            self.later.clear()
        self.handle.registerTimer(tick + n * self.step_ms)

    def close(self) -> None:
        pass


def tick_health(readings: DataFrame, objects: DataFrame, first_us: int, clock: DataFrame | None = None, step_s: int = 30, late_s: int = health.WATERMARK_S, fleet: str | None = None, buckets: int = 4096) -> DataFrame:
    """A stream of (fleet, tick_us, total, healthy, warning, critical, health_percent), append mode: the fleet at every tick from
    first_us (whole milliseconds) that the watermark has passed, as health.by_tick gives it.

    readings are those of rated_readings with ts their own time. A reading up to late_s behind the latest row counts at all its
    ticks; a later one is dropped. Every row of objects (norad_id) ticks, with readings or without. State is an object's last
    reading and those after its last tick, kept in buckets of objects by hash: a bucket has one timer and puts out its counts, so
    the rows do not grow with the fleet. As all objects tick together, none is read in vain. buckets (some thousand objects
    each) must stay what the checkpoint was made with.
    """
    stateful(readings.sparkSession)
    bucket = F.when(F.col("norad_id").isNotNull(), F.pmod(F.xxhash64("norad_id"), F.lit(buckets))).alias("bucket")
    begin = objects.where("norad_id is not null").select("norad_id", (F.col(fleet) if fleet else F.lit("all")).alias("fleet")).dropDuplicates(["norad_id"])
    begin = begin.groupBy(bucket).agg(F.collect_list(F.struct("norad_id", "fleet")).alias("objects")).withColumn("first_ms", F.lit(first_us // 1000))
    rows = with_clock(readings, clock, late_s).withColumn("bucket", bucket).groupBy("bucket")
    rows = rows.transformWithState(_Ticks(step_s * 1000), "fleet string, tick timestamp, healthy bigint, warning bigint, critical bigint", "Append", "EventTime", initialState=begin.groupBy("bucket"), eventTimeColumnName="tick")
    counts = [F.sum(s.lower()).alias(s.lower()) for s in health.STATUSES]
    rows = rows.groupBy("fleet", "tick").agg(F.sum(F.expr("healthy + warning + critical")).alias("total"), *counts)
    return rows.withColumn("health_percent", F.when(F.col("total") > 0, F.col("healthy") / F.col("total") * 100).otherwise(0.0)).withColumn("tick_us", F.unix_micros("tick")).drop("tick")


class _Ring(StatefulProcessor):
    """The last points of a fleet."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle) -> None:
        self.ring = handle.getListState("ring", "tick_us bigint, value double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        points = {r[0]: r[1] for r in self.ring.get()} | {r["tick_us"]: r["value"] for r in rows}
        kept = sorted(points.items())[-self.keep :]
        self.ring.put([tuple(p) for p in kept])
        yield Row(fleet=key[0], points=[Row(tick_us=t, value=v) for t, v in kept])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


def history_ring(points: DataFrame, keep: int = KEEP) -> DataFrame:
    """A stream of (fleet, points array of (tick_us, value), rising): the last `keep` points of each fleet that has new ones.

    points is a stream of (fleet, tick_us, value), one a tick; a tick that comes again replaces its point. State is bounded.
    """
    stateful(points.sparkSession)
    return points.select("fleet", "tick_us", "value").groupBy("fleet").transformWithState(_Ring(keep), "fleet string, points array<struct<tick_us:bigint,value:double>>", "Update", "None")


def log(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """Appends a stream to the table at path, each batch exactly once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def keep_latest(rows: DataFrame, path: str, checkpoint: str, **trigger):
    """Writes what a stream in update mode gives, batch by batch; a batch that runs twice replaces itself. See latest."""

    def each(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    return rows.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(**(trigger or {"availableNow": True})).start()


def latest(spark: SparkSession, path: str, schema: str, key: str = "fleet") -> DataFrame:
    """The last row of each key that keep_latest has written under path."""
    rows = spark.read.schema(f"{schema}, batch int").parquet(path)
    own = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*own), "batch").alias("r")).select(key, "r.*")


def alert_events(changes: DataFrame) -> DataFrame:
    """(norad_id, at, event, reason): alerts raised as objects turn Critical and cleared as they leave it; batch or stream."""
    critical = lambda c: F.col(c) == "Critical"
    event = F.when(critical("new_status") & ~critical("old_status"), "raised").when(critical("old_status") & ~critical("new_status"), "cleared")
    return changes.select("norad_id", "at", event.alias("event"), F.when(critical("new_status"), F.col("new_reason")).otherwise(F.col("old_reason")).alias("reason")).where("event is not null")
