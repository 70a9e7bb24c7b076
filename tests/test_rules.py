"""Boundary rows of framing, parsing, classes and health."""

import math

from pyspark.sql import functions as F

from perigee.functions import columns as C
from perigee.operators import catalog, health
from perigee.sources import fixtures


def test_framing_and_ids(spark):
    l1 = lambda n, y="23": f"1 {n}U 24001A   {y}001.00000000  .0"
    body = "A\r\n" + l1("25544") + "\r\n2 x\r\n\r\nB\n" + l1("A0001") + "\n2 x\nC\n" + l1("     ", "56") + "\n2 x\ntail\nend"
    recs = catalog.records(spark.createDataFrame([("active", 0, body), ("active", 1, "")], "grp string, part int, body string"))
    assert recs.count() == 3
    rows = catalog.parse(recs, ["active"]).orderBy("rec_no").collect()
    assert [(r["norad_id"], r["tle_epoch"][:4]) for r in rows] == [(25544, "2023"), (0, "2056")]


def test_classes(spark):
    rows = spark.createDataFrame([(-1.0, False), (1000.0, False), (1000.000001, False), (2000.0, False), (2000.000001, False), (math.nan, False), (math.nan, True)], "alt double, is_debris boolean")
    assert [r[0] for r in rows.select(C.orbit_class(F.col("alt"), F.col("is_debris"))).collect()] == ["LEO", "LEO", "MEO", "MEO", "GEO", "GEO", "Debris"]
    assert health.overview(rows, []).collect()[0].asDict() == {"debris": 1, "leo": 2, "meo": 2, "geo": 1, "total": 7, "filtered": 0}
    degrees = spark.createDataFrame([(x,) for x in (9.999, 10.0, 85.0, 85.001, 94.999, 95.0, 96.0, 99.0, 99.001)], "d double")
    assert [r[0][0] for r in degrees.select(C.inclination_class(F.col("d"))).collect()] == list("EIIPPISSI")


def test_cascade_limits_and_empty_fleet(spark):
    now, s = 10**15, 10**6
    rows = [(1, now - 3600 * s), (2, now - 3601 * s), (3, now - 600 * s), (4, now - 599 * s), (5, now + s), (6, None)]
    data = [(i, False, 0.0, 0.0, 500.0, t, 0.0, 0.0, 500.0) for i, t in rows] + [(7, False, 0.0, 0.0, 500.0, now, 0.0, 0.0, 503.0), (8, False, 0.0, 0.0, 500.0, now, 0.0, 0.0, 510.0)]
    df = spark.createDataFrame(data, "norad_id long, is_debris boolean, lat double, lon double, alt double, tel_us long, o_lat double, o_lon double, o_alt double")
    got = {r["norad_id"]: r["reason"] for r in health.assess(df, fixtures.thresholds(spark), F.lit(now)).collect()}
    assert got == {1: "stale_warning", 2: "stale_telemetry", 3: "stale_warning", 4: "ok", 5: "ok", 6: "no_telemetry", 7: "deviation_warning", 8: "large_deviation"}
    none = health.summary(health.assess(df.limit(0), fixtures.thresholds(spark), F.lit(now))).collect()
    assert [tuple(r) for r in none] == [(0, 0, 0, 0, 0.0)]


def test_search(spark):
    rows = spark.createDataFrame([(i, f"Sat {i}", 1, 0, i) for i in range(30)], "norad_id long, name string, grp_ord int, part int, rec_no int")
    assert catalog.search(rows, "  ").count() == 0
    assert [r["norad_id"] for r in catalog.search(rows, "SAT").collect()] == list(range(20))
    assert {r["norad_id"] for r in catalog.search(rows, "7").collect()} == {7, 17, 27}


def test_elements_with_implied_points(spark):
    l1 = "1 25544U 98067A   06173.50000000  .00002182  00000-0 {} 0  9990"
    l2 = "2 25544  51.6416 247.4627 {} 130.5360 325.0288 15.72125391563537"
    cases = [(" 28098-4", "1859667", 2.8098e-5, 0.1859667), ("-11606-4", "0006703", -1.1606e-5, 0.0006703), (" 14311-1", "7318036", 0.014311, 0.7318036), (" 00000-0", "0000000", 0.0, 0.0), (" 12345+0", "xxxxxxx", 0.12345, None)]
    rows = spark.createDataFrame([(i, "", l1.format(b), l2.format(e)) for i, (b, e, _, _) in enumerate(cases)], "norad_id int, tle_epoch string, l1 string, l2 string")
    for r, (_, _, drag, ecc) in zip(catalog.elements(rows).orderBy("norad_id").collect(), cases, strict=True):
        assert math.isclose(r["bstar"], drag, abs_tol=1e-12) and r["ecc"] == ecc
        assert (r["incl_deg"], r["node_deg"], r["argp_deg"], r["mean_deg"], r["rev_day"]) == (51.6416, 247.4627, 130.536, 325.0288, 15.72125391)
