"""The propagation operators over a catalogue with near, deep and failing objects."""

import math

import pytest
from pyspark.sql import functions as F

from perigee.operators import catalog, health, propagate
from perigee.sources import fixtures

AS_OF = 1151020800000000  # 2006-06-23
#: Name and lines: a near-Earth object, a geostationary and a Molniya one, and one whose eccentricity is no number.
OBJECTS = [
    ("STATION", "1 25544U 98067A   06173.50000000  .00002182  00000-0  20000-4 0  9990", "2 25544  51.6416 247.4627 0006703 130.5360 325.0288 15.72125391563537"),
    ("GEO CRAFT", "1 28626U 05008A   06176.46683397 -.00000205  00000-0  10000-3 0  2190", "2 28626   0.0019 286.9433 0000335  13.7918  55.6504  1.00270176  4891"),
    ("MOLNIYA", "1 08195U 75081A   06176.33215444  .00000099  00000-0  11873-3 0   813", "2 08195  64.1586 279.0717 6877146 264.7651  20.2257  2.00491383225656"),
    ("BROKEN", "1 00001U 75081A   06176.33215444  .00000099  00000-0  11873-3 0   813", "2 00001  64.1586 279.0717 xxxxxxx 264.7651  20.2257 12.00491383225656"),
]


@pytest.fixture(scope="module")
def objects(spark):
    text = spark.createDataFrame([("active", 0, "\n".join(x for o in OBJECTS for x in o))], "grp string, part int, body string")
    return catalog.parse(catalog.records(text), ["active"])


def test_ephemeris_and_its_policies(objects):
    ticks = [AS_OF, AS_OF + 60_000_000]
    rows = {(r["norad_id"], r["ts_us"]): r for r in propagate.ephemeris(objects, ticks).collect()}
    assert len(rows) == 8 and not rows[1, AS_OF]["prop_ok"] and rows[1, AS_OF]["lat"] is None
    near, geo = rows[25544, AS_OF], rows[28626, AS_OF]
    assert 300 < near["alt_km"] < 400 and 35_000 < geo["alt_km"] < 36_500 and abs(geo["lat"]) < 0.1
    after = rows[25544, AS_OF + 60_000_000]
    moved = math.dist([near[c] for c in "xyz"], [after[c] for c in "xyz"])
    assert abs(moved / 60 - 7.7) < 0.2
    assert propagate.ephemeris(objects, ticks, "drop").count() == 6
    zero = [r for r in propagate.ephemeris(objects, ticks, "zero").collect() if r["norad_id"] == 1]
    assert all((r["lat"], r["lon"], r["alt_km"], r["prop_ok"]) == (0, 0, 0, False) for r in zero)
    with pytest.raises(ValueError):
        propagate.ephemeris(objects, ticks, "skip")
    assert propagate.ephemeris(objects.limit(0), ticks).count() == 0


def test_positions_speed_and_details(objects):
    assert {r["norad_id"] for r in propagate.positions(objects, AS_OF).collect()} == {25544, 28626, 8195}
    speed = {r["norad_id"]: r["speed"] for r in propagate.with_speed(propagate.ephemeris(objects, [AS_OF])).collect()}
    assert abs(speed[25544] - 7.7) < 0.1 and abs(speed[28626] - 3.07) < 0.02 and speed[1] == 0
    one = propagate.details(objects, 28626, AS_OF).collect()[0]
    assert (one["name"], one["orbit_type"], one["inclination"], one["speed"][:3]) == ("GEO CRAFT", "Equatorial", "0.00", "3.0")
    assert propagate.details(objects, 1, AS_OF).count() == 0 and propagate.details(objects, 77, AS_OF).count() == 0


def test_a_geostationary_craft_is_rated_as_one(spark, objects):
    at = propagate.predict_at(objects.select("norad_id", "l1", "l2", "tle_epoch", "is_debris", "name", F.lit(AS_OF).alias("ts_us")), on_fail="zero").withColumnRenamed("alt_km", "alt")
    assert {r["norad_id"]: r["name"] for r in at.collect()} == {25544: "STATION", 28626: "GEO CRAFT", 8195: "MOLNIYA", 1: "BROKEN"}
    rows = at.withColumns({"tel_us": F.lit(AS_OF), "o_lat": F.col("lat"), "o_lon": F.col("lon"), "o_alt": F.col("alt") + 1})
    got = {r["norad_id"]: (r["orbit_class"], r["status"]) for r in health.assess(rows, fixtures.thresholds(spark), F.lit(AS_OF)).collect()}
    assert got[28626] == ("GEO", "Healthy") and got[25544] == ("LEO", "Healthy") and got[1][0] == "LEO"


def test_positions_table_by_date(spark, objects, tmp_path):
    day, path = 86_400_000_000, str(tmp_path / "positions")
    propagate.write_positions(objects, [AS_OF + k * day // 2 for k in range(6)], path)
    rows = propagate.read_positions(spark, path, AS_OF + day, AS_OF + 2 * day)
    assert {r["ts_us"] for r in rows.collect()} == {AS_OF + day, AS_OF + 3 * day // 2, AS_OF + 2 * day}
    assert "PartitionFilters: [isnotnull(date" in rows._jdf.queryExecution().toString()
    assert propagate.position_at(rows, 25544, AS_OF + day).count() == 1 and propagate.positions_since(rows, 25544, AS_OF + day).count() == 2


def metric(df, node, name):
    """The sum of a metric over the nodes of an executed plan whose name begins so."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        if p.nodeName().startswith(node) and p.metrics().contains(name):
            found.append(p.metrics().apply(name).value())
        todo += [p.children().apply(i) for i in range(p.children().size())]
    return sum(found)


def test_days_stay_and_one_object_is_read_alone(spark, tmp_path):
    """Days that are written one by one all stay, a day that is written again is replaced, and files hold ranges of objects."""
    day, path = 86_400_000_000, str(tmp_path / "positions")
    text = spark.createDataFrame([("active", 0, "\n".join(f"S{i}\n1 {i:05d}{OBJECTS[0][1][7:]}\n2 {i:05d}{OBJECTS[0][2][7:]}" for i in range(1, 2001)))], "grp string, part int, body string")
    many = catalog.parse(catalog.records(text), ["active"])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for ticks in ([AS_OF], [AS_OF + day], [AS_OF, AS_OF + 1]):
            propagate.write_positions(many, ticks, path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    rows = propagate.read_positions(spark, path)
    assert {(str(r["date"]), r["count"]) for r in rows.groupBy("date").count().collect()} == {("2006-06-23", 4000), ("2006-06-24", 2000)}
    one = propagate.position_at(propagate.read_positions(spark, path, AS_OF, AS_OF), 700, AS_OF)
    assert len(one.collect()) == 1
    plan = one._jdf.queryExecution().toString()
    assert "EqualTo(norad_id,700)" in plan and "date" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert metric(one, "Scan parquet", "numOutputRows") <= 4000 // 3  # of four ranges one is read
