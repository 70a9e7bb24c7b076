import random

import pytest
from pyspark.sql import functions as F

from perigee.operators import catalog, health, propagate
from perigee.plans import queries
from perigee.sources import fixtures
from perigee.streaming import fleet, ticks

SF = "/root/testdata/sf0.001"
S = 1_000_000
OBJECTS = "norad_id long, is_debris boolean, lat double, lon double, alt double"
READINGS = "event_id long, norad_id long, tel_us long, dlat double, dlon double, dalt double, seen timestamp"


def observed(rows):
    return rows.withColumns({f"o_{c}": F.col(c) + F.col(f"d{c}") for c in ("lat", "lon", "alt")})


class Replay:
    """Files that land one by one, and queries that are stopped and started again at each."""

    def __init__(self, spark, folder, objects, lateness=0):
        self.spark, self.folder, self.objects, self.late, self.files = spark, folder, objects, lateness, 0
        self.limits = fixtures.thresholds(spark)

    def put(self, readings, clock):
        rows = [(e, n, t, *d, fleet.instant(s)) for e, n, t, d, s in readings]
        self.spark.createDataFrame(rows, READINGS).coalesce(1).write.mode("append").parquet(f"{self.folder}/in")
        self.spark.createDataFrame([(fleet.instant(t),) for t in clock], "ts timestamp").coalesce(1).write.mode("append").parquet(f"{self.folder}/clock")

    def changes(self):
        telemetry = self.spark.readStream.schema(READINGS).parquet(f"{self.folder}/in")
        clock = self.spark.readStream.schema("ts timestamp").parquet(f"{self.folder}/clock")
        rated = fleet.rated_readings(telemetry, self.objects, observed, self.limits, "seen")
        fleet.log(fleet.status_changes(rated, clock, self.late), f"{self.folder}/changes", f"{self.folder}/c1").awaitTermination(120)
        return self.spark.read.schema(fleet.CHANGES).parquet(f"{self.folder}/changes")

    def counts(self):
        rows = self.spark.readStream.schema(fleet.CHANGES).parquet(f"{self.folder}/changes")
        total = self.objects.groupBy(F.lit("all").alias("fleet")).agg(F.count("*").alias("total"))
        fleet.keep_latest(fleet.fleet_counts(rows, total), f"{self.folder}/counts", f"{self.folder}/c2").awaitTermination(120)
        return fleet.latest(self.spark, f"{self.folder}/counts", fleet.COUNTS).collect()[0]


def test_a_silent_object_turns_stale(spark, tmp_path):
    objects = spark.createDataFrame([(i, False, 0.0, 0.0, 500.0) for i in (1, 2, 3)], OBJECTS)
    r = Replay(spark, str(tmp_path), objects)
    near, far = (0.0, 0.0, 0.0), (0.0, 0.0, 50.0)
    r.put([(1, 1, 100 * S, near, 100 * S), (2, 2, 100 * S, far, 100 * S)], [101 * S])
    seen = lambda rows: sorted((x["norad_id"], int(x["at"].timestamp()), x["old_reason"], x["new_reason"]) for x in rows.collect())
    first = [(1, 100, "no_telemetry", "ok"), (2, 100, "no_telemetry", "large_deviation")]
    assert seen(r.changes()) == first
    assert (r.counts()["healthy"], r.counts()["critical"]) == (1, 2)
    r.put([], [699 * S])  # the clock alone goes on: a second before the warning age, at it, at the critical age, and past it
    assert seen(r.changes()) == first
    r.put([], [700 * S])
    second = first + [(1, 700, "ok", "stale_warning")]
    assert seen(r.changes()) == sorted(second)
    c = r.counts()
    assert (c["total"], c["healthy"], c["warning"], c["critical"], c["health_percent"]) == (3, 0, 1, 2, 0.0)
    r.put([], [3700 * S])
    assert seen(r.changes()) == sorted(second)
    r.put([], [3701 * S])
    rows = r.changes()
    assert seen(rows) == sorted(second + [(1, 3700, "stale_warning", "stale_telemetry"), (2, 3700, "large_deviation", "stale_telemetry")])
    assert (r.counts()["healthy"], r.counts()["warning"], r.counts()["critical"]) == (0, 0, 3)
    events = sorted((x["norad_id"], x["event"], x["reason"]) for x in fleet.alert_events(rows).collect())
    assert events == [(1, "cleared", "no_telemetry"), (1, "raised", "stale_telemetry")]


def test_both_ages_passed_at_once_and_older_readings(spark, tmp_path):
    objects = spark.createDataFrame([(1, False, 0.0, 0.0, 500.0)], OBJECTS)
    r = Replay(spark, str(tmp_path), objects)
    r.put([(2, 1, 50 * S + 7, (0.0, 0.0, 0.0), 60 * S), (1, 1, 50 * S + 7, (0.0, 0.0, 90.0), 60 * S), (3, 1, None, (0.0, 0.0, 0.0), 60 * S), (9, 77, 60 * S, (0.0, 0.0, 0.0), 60 * S)], [])
    r.put([(8, 1, 40 * S, (0.0, 0.0, 90.0), 61 * S)], [90_000 * S])
    got = sorted((x["at"].timestamp(), x["new_reason"]) for x in r.changes().collect())
    assert [x[1] for x in got] == ["ok", "stale_warning", "stale_telemetry"] and got[1][0] == 650.001 and got[2][0] == 3650.001


@pytest.mark.parametrize("order", ["time", "shuffled"])
def test_changes_add_up_to_the_summary_of_each_batch(spark, tmp_path, order):
    objects = fixtures.pos_fx(spark, SF)
    rows = [(x["event_id"], x["norad_id"], x["tel_us"], (x["dlat"], x["dlon"], x["dalt"])) for x in fixtures.tel_fx(spark, SF).collect()]
    rows.sort(key=lambda x: (x[2], x[0]))
    if order == "shuffled":
        random.Random(3).shuffle(rows)
    r, done, written = Replay(spark, str(tmp_path), objects), [], 0
    for n in range(3):  # each run is a restart
        part, now = rows[n * 350 : (n + 1) * 350], fixtures.FIRST_TICK + (n + 1) * 1200 * S
        r.put([(*x, now - S + i) for i, x in enumerate(part)], [now])
        done += part
        changes = r.changes()
        latest = health.latest(spark.createDataFrame([(e, i, t, *d) for e, i, t, d in done], "event_id long, norad_id long, tel_us long, dlat double, dlon double, dalt double"))
        want = health.assess(observed(health.fleet_join(objects, latest)), r.limits, F.lit(now))
        got = r.counts()
        assert [got[c] for c in ("total", "healthy", "warning", "critical")] == [health.summary(want).collect()[0][c] for c in ("total", "healthy", "warning", "critical")]
        last = changes.groupBy("norad_id").agg(F.max_by("new_reason", "seq").alias("r"))
        reasons = {x["norad_id"]: x["r"] for x in objects.join(last, "norad_id", "left").fillna("no_telemetry").collect()}
        assert reasons == {x["norad_id"]: x["reason"] for x in want.collect()}
        assert changes.count() - written <= 3 * len({x[1] for x in part}) + 2 * objects.count()
        written = changes.count()


def tick_rows(spark, folder, files, clock, late_s, objects, first_us):
    for rows in files:
        rows.coalesce(1).write.mode("append").parquet(f"{folder}/in")
        run_ticks(spark, folder, objects, first_us, None, late_s, rows.schema)
    spark.createDataFrame([(fleet.instant(clock),)], "ts timestamp").coalesce(1).write.mode("append").parquet(f"{folder}/clock")
    run_ticks(spark, folder, objects, first_us, f"{folder}/clock", late_s, files[0].schema)
    return spark.read.parquet(f"{folder}/ticks")


def run_ticks(spark, folder, objects, first_us, clock, late_s, schema):
    import os

    os.makedirs(f"{folder}/clock", exist_ok=True)
    telemetry = spark.readStream.schema(schema).parquet(f"{folder}/in").withColumn("ts", F.timestamp_micros("tel_us"))
    rated = fleet.rated_readings(telemetry, objects, observed, fixtures.thresholds(spark))
    rows = fleet.tick_health(rated, objects, first_us, spark.readStream.schema("ts timestamp").parquet(f"{folder}/clock"), late_s=late_s)
    fleet.log(rows, f"{folder}/ticks", f"{folder}/c").awaitTermination(300)


def test_tick_stream_is_health_by_tick(spark, tmp_path):
    """Shuffled files with late rows inside the watermark and a restart after each file give the batch rows, one by one."""
    objects, telemetry = fixtures.pos_fx(spark, SF), fixtures.tel_fx(spark, SF)
    last = fixtures.FIRST_TICK + 600 * S
    telemetry = telemetry.where(f"tel_us <= {last}")
    want = health.by_tick(objects, telemetry, observed, fixtures.thresholds(spark), fixtures.FIRST_TICK, last)
    files = [telemetry.where(f"pmod(hash(event_id), 3) = {n}") for n in (2, 0, 1)]
    got = tick_rows(spark, str(tmp_path), files, last + 10_000 * S, 10_000, objects, fixtures.FIRST_TICK)
    columns = ["tick_us", "total", "healthy", "warning", "critical", "health_percent"]
    rows = lambda df: sorted(map(tuple, df.select(*columns).collect()))
    assert rows(got) == rows(want) and len(rows(want)) == 21
    # the history of those ticks, kept as a ring over two restarts, with the labels of the ticks
    for part in (F.col("tick_us") % (2 * 30 * S) == 0, F.col("tick_us") % (2 * 30 * S) != 0):
        got.where(part).select("fleet", "tick_us", F.col("health_percent").alias("value")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/points")
        points = spark.readStream.schema("fleet string, tick_us long, value double").parquet(f"{tmp_path}/points")
        fleet.keep_latest(fleet.history_ring(points, 5), f"{tmp_path}/ring", f"{tmp_path}/c3").awaitTermination(120)
    ring = fleet.latest(spark, f"{tmp_path}/ring", "fleet string, points array<struct<tick_us:bigint,value:double>>").select(F.explode("points").alias("p")).select("p.*")
    base = want.select("tick_us", F.col("health_percent").alias("value"))
    assert sorted(map(tuple, ring.collect())) == sorted(map(tuple, health.history(base, 5).collect()))
    assert [r["label"] for r in health.trend(ring).orderBy("tick_us").collect()] == ["00:08", "00:08", "00:09", "00:09", "00:10"]


def test_readings_beyond_the_watermark_are_left_out(spark, tmp_path):
    objects = spark.createDataFrame([(i, False, 0.0, 0.0, 500.0) for i in (1, 2)], OBJECTS)
    schema = "event_id long, norad_id long, tel_us long, dlat double, dlon double, dalt double"
    make = lambda *rows: spark.createDataFrame([(e, n, t * S, 0.0, 0.0, d) for e, n, t, d in rows], schema)
    # 60 s may be late: the reading of second 50 comes at 100, that of second 20 at 130
    got = tick_rows(spark, str(tmp_path), [make((1, 1, 100, 0.0)), make((2, 1, 50, 90.0), (3, 2, 130, 0.0)), make((4, 2, 20, 0.0))], 10_000 * S, 60, objects, 30 * S)
    at = {r["tick_us"] // S: (r["healthy"], r["warning"], r["critical"]) for r in got.collect()}
    assert at[30] == at[60] == at[90] == (0, 0, 2) and at[120] == (1, 0, 1) and at[150] == (2, 0, 0)


def test_position_ticks(spark, tmp_path):
    src, out, ckpt = (str(tmp_path / x) for x in ("in", "out", "ckpt"))
    objects = catalog.parse(catalog.records(fixtures.tle_text_fx(spark, SF)), fixtures.GROUPS)
    for n in range(3):  # one instant a batch, with a restart after each
        spark.range(1).select(F.timestamp_micros(F.lit(fixtures.AS_OF + 10_000_000 * n)).alias("timestamp")).write.mode("append").parquet(src)
        stream = spark.readStream.schema("timestamp timestamp").parquet(src)
        ticks.positions_query(stream, objects, out, ckpt, availableNow=True).awaitTermination(120)
    got = spark.read.parquet(out)
    want = propagate.positions(objects, fixtures.AS_OF + 10_000_000)
    assert {(r["batch"], r["ts_us"]) for r in got.select("batch", "ts_us").distinct().collect()} == {(n, fixtures.AS_OF + 10_000_000 * n) for n in range(3)}
    assert sorted(r["norad_id"] for r in got.where("batch = 1").collect()) == sorted(r["norad_id"] for r in want.collect())


def test_no_task_sorts_what_it_reads_or_a_row_a_tick(spark):
    """Before the shuffle nothing is sorted, and ticks are put out above the join and every sort."""
    rows = health.readings_by_tick(fixtures.pos_fx(spark, SF), fixtures.tel_fx(spark, SF), fixtures.FIRST_TICK, fixtures.AS_OF)
    lines = rows._jdf.queryExecution().executedPlan().toString().split("\n")
    depth = lambda word: [n for n, line in enumerate(lines) if word in line]
    assert not depth("SortAggregate") and depth("Generate explode")
    assert max(depth("Generate explode")) < min(depth("Join ") + depth("Sort [") + depth("Window ["))


def test_readings_of_one_tick(spark):
    objects = spark.createDataFrame([(i, False, 0.0, 0.0, 500.0) for i in (1, 2)], OBJECTS)
    made = [(1, 1, 5, 1.0), (2, 1, 5, 2.0), (3, 1, 3, 3.0), (4, 1, 30, 4.0), (5, 1, 31, 5.0), (6, 1, 61, 6.0), (7, 1, None, 7.0), (8, 9, 5, 8.0)]
    telemetry = spark.createDataFrame([(e, n, t if t is None else t * S, d, 0.0, 0.0) for e, n, t, d in made], "event_id long, norad_id long, tel_us long, dlat double, dlon double, dalt double")
    got = sorted((r["norad_id"], r["tick_us"] // S, r["event_id"] or 0) for r in health.readings_by_tick(objects, telemetry, 0, 60 * S).collect())
    assert got == [(1, 0, 0), (1, 30, 4), (1, 60, 5), (2, 0, 0), (2, 30, 0), (2, 60, 0)]


def bucketed(r, buckets):
    """The changes of a Replay's readings with a number of buckets, and the progress of the query."""
    telemetry = r.spark.readStream.schema(READINGS).parquet(f"{r.folder}/in")
    clock = r.spark.readStream.schema("ts timestamp").parquet(f"{r.folder}/clock")
    rated = fleet.rated_readings(telemetry, r.objects, observed, r.limits, "seen")
    q = fleet.log(fleet.status_changes(rated, clock, r.late, **({"buckets": buckets} if buckets else {})), f"{r.folder}/changes{buckets}", f"{r.folder}/c{buckets}")
    q.awaitTermination(120)
    return sorted(map(tuple, r.spark.read.schema(fleet.CHANGES).parquet(f"{r.folder}/changes{buckets}").collect())), q.lastProgress


def test_objects_of_a_bucket_change_each_by_itself(spark, tmp_path):
    """Over restarts with readings and ages due in one batch, buckets of many objects give the changes of buckets of one."""
    rows = [(x["event_id"], x["norad_id"], x["tel_us"], (x["dlat"], x["dlon"], x["dalt"])) for x in fixtures.tel_fx(spark, SF).collect()]
    random.Random(5).shuffle(rows)
    r = Replay(spark, str(tmp_path), fixtures.pos_fx(spark, SF))
    for n in range(3):
        now = fixtures.FIRST_TICK + (n + 1) * 1200 * S
        r.put([(*x, now - S + i) for i, x in enumerate(rows[n * 200 : (n + 1) * 200])], [now])
        got = [bucketed(r, b)[0] for b in (3, 1 << 40)]
        assert got[0] == got[1] and {x[5] for x in got[0]} >= {"ok", "stale_warning", "stale_telemetry"}


def test_state_is_not_one_call_an_object(spark, tmp_path):
    objects = spark.range(9000).selectExpr("id as norad_id", "false as is_debris", "0d as lat", "0d as lon", "500d as alt")
    r = Replay(spark, str(tmp_path), objects)
    r.put([(i, i, 100 * S, (0.0, 0.0, 0.0), 100 * S) for i in range(9000)], [])
    r.put([], [101 * S])
    changes, progress = bucketed(r, None)
    state = progress["stateOperators"][0]
    assert len(changes) == 9000 and state["numRowsTotal"] <= 4096 and state["customMetrics"]["numRegisteredTimers"] <= 4096


def test_large_ids_and_no_limits_beside_a_clock(spark, tmp_path):
    """The rows of a clock leave event ids exact; limits that are null are never met; a reading not seen at any time is left out."""
    objects = spark.createDataFrame([(1, False, 0.0, 0.0, 500.0), (2, False, 0.0, 0.0, 5000.0)], OBJECTS)
    r = Replay(spark, str(tmp_path), objects)
    r.limits = r.limits.where("orbit_class <> 'GEO'")
    big, near, far = 1 << 60, (0.0, 0.0, 0.0), (0.0, 0.0, 50.0)
    r.put([(big + 1, 1, 50 * S, far, 60 * S), (big, 1, 50 * S, near, 60 * S), (big, 2, 50 * S, far, 60 * S)], [60 * S])
    spark.createDataFrame([(9, 1, 55 * S, *near, None)], READINGS).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert [x[5] for x in bucketed(r, None)[0]] == ["large_deviation", "ok"]
    r.put([], [90_000 * S])
    assert [(x[0], x[5]) for x in bucketed(r, None)[0]] == [(1, "large_deviation"), (1, "stale_telemetry"), (2, "ok")]


def test_telemetry_arrives_in_pieces_of_many_files(spark, tmp_path):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "8k")
        stream, path = queries._arriving(spark, SF, 3)
        tasks = fixtures.tel_fx(spark, SF).rdd.getNumPartitions()
        assert tasks > 1 and len(spark.read.parquet(f"{path}/in").inputFiles()) == 3 * tasks
        q = fleet.log(stream, f"{tmp_path}/out", f"{tmp_path}/c")
        q.awaitTermination(120)
    finally:
        spark.conf.set(name, before)
    ids = lambda df: sorted(x["event_id"] for x in df.select("event_id").collect())
    assert sum(p["numInputRows"] > 0 for p in q.recentProgress) == 3
    assert ids(spark.read.parquet(f"{tmp_path}/out")) == ids(fixtures.tel_fx(spark, SF))
