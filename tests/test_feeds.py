"""Feeds from real files to the catalogue and to health."""

import pytest
from pyspark.sql import functions as F

from perigee.operators import catalog, health, screening
from perigee.sources import feeds, fixtures, tle

RECORD = "{name}\r\n1 {id:05d}U 98067A   06173.50000000  .00002182  00000-0  20000-4 0  9990\r\n2 {id:05d}  51.6416 247.4627 0006703 130.5360 325.0288 15.72125391563537\r\n"


def test_element_files_reach_the_catalogue(spark, tmp_path):
    for group, files in {"visual": {"b.txt": [3], "a.txt": [1, 2]}, "1999-025": {"x.txt": [4]}, "other": {"x.txt": [9]}}.items():
        (tmp_path / f"grp={group}").mkdir()
        for name, ids in files.items():
            (tmp_path / f"grp={group}" / name).write_text("".join(RECORD.format(name=f"SAT {i}", id=i) for i in ids))
    text = feeds.tle_scan(spark, str(tmp_path))
    assert text.count() == 3  # a row a file; a group that is not there and one not asked for are left out
    rows = catalog.parse(catalog.records(text), feeds.DEFAULT_GROUPS).orderBy("grp_ord", "part", "rec_no").collect()
    assert [r["norad_id"] for r in rows] == [1, 2, 3, 4] and rows[0]["inclination"] == 51.6416
    assert feeds.tle_scan(spark, str(tmp_path), ["other"]).count() == 1
    with pytest.raises(ValueError):
        feeds.tle_scan(spark, str(tmp_path), format="json")


def test_telemetry_files_reach_health(spark, tmp_path):
    readings = spark.createDataFrame([(1, 7, 1000, 10.0, 20.0, 500.0), (2, 7, 900, 0.0, 0.0, 500.0), (3, 8, None, 0.0, 0.0, 0.0)], "event_id long, norad_id long, s long, lat double, lon double, alt_km double")
    readings.select("event_id", "norad_id", F.timestamp_seconds("s").alias("ts"), "lat", "lon", "alt_km").write.parquet(str(tmp_path / "t"))
    latest = health.latest(feeds.telemetry_scan(spark, str(tmp_path / "t")))
    objects = spark.createDataFrame([(i, False, 10.0, 20.0, 500.0) for i in (7, 8, 9)], "norad_id long, is_debris boolean, lat double, lon double, alt double")
    got = {r["norad_id"]: r["reason"] for r in health.assess(health.fleet_join(objects, latest), fixtures.thresholds(spark), F.lit(1_010_000_000)).collect()}
    assert got == {7: "ok", 8: "no_telemetry", 9: "no_telemetry"}


def test_classes_without_thresholds_stay(spark):
    rows = spark.createDataFrame([(1, False, 0.0, 0.0, 500.0, 5, 0.0, 0.0, 900.0)], "norad_id long, is_debris boolean, lat double, lon double, alt double, tel_us long, o_lat double, o_lon double, o_alt double")
    assert [r["reason"] for r in health.assess(rows, fixtures.thresholds(spark).where("orbit_class = 'GEO'"), F.lit(6)).collect()] == ["ok"]


def test_health_at_ticks(spark):
    objects = spark.createDataFrame([(i, False, 0.0, 0.0, 500.0) for i in (1, 2)], "norad_id long, is_debris boolean, lat double, lon double, alt double")
    tel = spark.createDataFrame([(1, 1, -50), (2, 1, 0), (3, 1, 30), (4, 1, 30), (5, 1, 31), (6, 1, 95), (7, 1, None)], "event_id long, norad_id long, tel_us long")
    got = {(r["norad_id"], r["tick_us"]): r["event_id"] for r in health.readings_by_tick(objects, tel, 0, 90, 30).collect()}
    assert got == {(1, 0): 2, (1, 30): 4, (1, 60): 5, (1, 90): 5, **{(2, t): None for t in (0, 30, 60, 90)}}


def test_many_observers_find_what_few_find(spark):
    points = fixtures.pos_fx(spark, "/root/testdata/sf0.001")
    few = fixtures.observers(spark)
    many = few.unionByName(spark.range(1500).selectExpr("cast(id + 10 as int) obs_id", "-60D o_lat", "0D o_lon", "0D o_alt", "0.001D radius_deg"))
    rows = lambda o: sorted((r["obs_id"], r["norad_id"], round(r["zenith_deg"], 9)) for r in screening.overhead(points, o).where("obs_id < 10").collect())
    assert rows(few) == rows(many) and len(rows(few)) > 0


def test_the_tle_format_is_a_source_and_a_stream(spark, tmp_path):
    def land(group, name, *ids):
        folder = tmp_path / "feed" / f"grp={group}"
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f".{name}").write_text("".join(RECORD.format(name=f"SAT {i} é", id=i) for i in ids), encoding="utf-8")
        (folder / f".{name}").rename(folder / name)

    land("visual", "b.txt", 3)
    land("visual", "a.txt", 1, 2)
    land("1999-025", "x.txt", 4)
    land("other", "x.txt", 9)
    tle.register(spark)
    path = str(tmp_path / "feed")
    rows = lambda df: sorted(map(tuple, catalog.parse(catalog.records(df), feeds.DEFAULT_GROUPS).collect()))
    read = spark.read.format("tle").load(path)
    assert rows(read) == rows(feeds.tle_scan(spark, path)) and read.count() == 3
    assert read.rdd.getNumPartitions() == 3
    # what a filter on the group leaves out is not read: it makes no partition
    one = read.where("grp = '1999-025'")
    assert one.rdd.getNumPartitions() == 1 and [r["part"] for r in one.collect()] == ["x.txt"]
    assert read.where("grp in ('visual', 'no such')").rdd.getNumPartitions() == 2 and read.where("grp = 'other'").count() == 0
    assert [r["grp"] for r in spark.read.format("tle").option("groups", "other, missing").load(path).collect()] == ["other"]
    with pytest.raises(Exception, match="only the tle format"):
        spark.read.format("tle").option("format", "json").load(path).count()

    def run():
        stream = catalog.parse(catalog.records(spark.readStream.format("tle").load(path)), feeds.DEFAULT_GROUPS)
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(map(tuple, spark.read.schema(stream.schema).parquet(str(tmp_path / "out")).collect()))

    assert run() == rows(feeds.tle_scan(spark, path))
    land("visual", "aa.txt", 5)  # a name before those that have been read
    land("iridium-33-debris", "z.txt", 6, 7)
    assert run() == run() == rows(feeds.tle_scan(spark, path)) and len(run()) == 7
