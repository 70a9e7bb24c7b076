"""The element history: idempotent, clustered, several epochs an object."""

import uuid

from perigee.operators import catalog
from perigee.sources import fixtures, stores

SF = "/root/testdata/sf0.001"


def opened(spark, folder):
    name = f"history_{uuid.uuid4().hex}"
    stores.open_history(spark, name, str(folder / "h"), 4)
    return name


def test_a_feed_twice_adds_nothing(spark, tmp_path):
    c = catalog.parse(catalog.records(fixtures.tle_text_fx(spark, SF)), fixtures.GROUPS)
    name = opened(spark, tmp_path)
    stores.append_history(spark, name, c.where("grp = 'active'"), 4)
    some = spark.table(name).count()
    stores.append_history(spark, name, c, 4)
    rows = sorted(map(tuple, spark.table(name).collect()))
    assert 0 < some < len(rows) and len(rows) == c.where("tle_epoch <> ''").select("norad_id", "tle_epoch").distinct().count()
    stores.append_history(spark, name, c, 4)
    assert sorted(map(tuple, spark.table(name).collect())) == rows
    assert max(r["count"] for r in spark.table(name).groupBy("norad_id").count().collect()) == 3
    again = f"history_{uuid.uuid4().hex}"  # another session would open it by its path
    assert stores.open_history(spark, again, str(tmp_path / "h"), 4).count() == len(rows)


def test_the_history_is_read_where_it_lies(spark, tmp_path):
    name = opened(spark, tmp_path)
    rows = [(i, f"20{y:02d}-01-01T00:00:00.000Z", f"{i}/{y}", "1", "2", 0.0, False, "g") for i in range(50) for y in range(10, 20)]
    made = spark.createDataFrame(rows, stores.HISTORY).selectExpr("*", "1 grp_ord", "'p' part", "1 rec_no")
    stores.append_history(spark, name, made, 4)
    asked = spark.createDataFrame([(i, f"20{y:02d}-06-01T00:00:00.000Z") for i in (3, 7, 99) for y in (9, 10, 14, 30)] + [(3, "2014-01-01T00:00:00.000Z")] * 2, "norad_id int, t_iso string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    got = stores.history_as_of(spark.table(name), asked, 4)
    want = [(i, f"20{y:02d}-06-01T00:00:00.000Z", f"{i}/{min(y, 19)}") for i in (3, 7) for y in (10, 14, 30)] + [(3, "2014-01-01T00:00:00.000Z", "3/14")] * 2
    assert sorted((r["norad_id"], r["t_iso"], r["name"]) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plan = plan.split("Initial Plan")[0]
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan, plan  # that of what is asked
    assert stores.history_as_of(spark.table(name), asked.limit(0), 4).count() == 0


def test_the_fixture_has_a_choice(spark):
    c = catalog.parse(catalog.records(fixtures.tle_text_fx(spark, SF)), fixtures.GROUPS)
    first = {r["norad_id"]: r["name"] for r in catalog.current(c).collect()}
    turned = catalog.current(c.selectExpr("norad_id", "name", "-grp_ord grp_ord", "-part part", "-rec_no rec_no"))
    other = {r["norad_id"]: r["name"] for r in turned.collect()}
    assert sum(first[k] != other[k] for k in first) > 20 and c.count() > len(first) + 20
