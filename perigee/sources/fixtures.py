"""Inputs derived from the driver's tables by fixed SQL (FIXTURES.md); the same text runs in Spark and, as CTEs, in the SQL check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: 2024-01-01T01:00:00Z in microseconds.
AS_OF = 1704070800000000
#: An hour before, the first tick of the fleet's history.
FIRST_TICK = AS_OF - 3600 * 1_000_000
GROUPS = ["active", "1999-025", "iridium-33-debris"]

_TLE = """SELECT c_custkey AS rec_no,
  CASE WHEN c_custkey % 3 = 0 THEN 'active' WHEN c_custkey % 3 = 1 THEN '1999-025' ELSE 'iridium-33-debris' END AS grp,
  CASE WHEN c_custkey % 10 = 0 THEN printf('COSMOS 2251 DEB %d', c_custkey) WHEN c_custkey % 10 = 1 THEN printf('Iridium %d', c_custkey)
       WHEN c_custkey % 10 = 2 THEN printf('FENGYUN 1C DEB %d', c_custkey) WHEN c_custkey % 10 = 3 THEN printf('SL-16 DEBRIS %d', c_custkey)
       ELSE concat(c_mktsegment, '-', printf('%d', c_custkey)) END AS name,
  concat('1 ', CASE WHEN c_custkey % 97 = 5 THEN 'A0001' ELSE printf('%05d', c_custkey) END, 'U 24001A   ',
     CASE WHEN c_custkey % 89 = 7 THEN 'XX' WHEN c_custkey % 50 = 9 THEN '98' ELSE '23' END,
     printf('%012.8f', CAST(300 + c_custkey % 60 AS DOUBLE) + CAST(c_custkey % 8 AS DOUBLE) / CAST(8 AS DOUBLE)), '  .00000100  00000-0  10000-4 0  9990') AS l1,
  concat('2 ', printf('%05d', c_custkey), ' ', printf('%8.4f', CAST((c_custkey * 37) % 1100 AS DOUBLE) / CAST(10 AS DOUBLE)), ' ',
     printf('%8.4f', CAST((c_custkey * 73) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE)), ' 0010000 ', printf('%8.4f', CAST((c_custkey * 11) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE)), ' ',
     printf('%8.4f', CAST((c_custkey * 17) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE)), ' ',
     printf('%11.8f', CASE WHEN c_nationkey % 3 = 0 THEN CAST(14.5 AS DOUBLE) + CAST(c_custkey % 8 AS DOUBLE) / CAST(8 AS DOUBLE)
                           WHEN c_nationkey % 3 = 1 THEN CAST(12.25 AS DOUBLE) + CAST(c_custkey % 8 AS DOUBLE) / CAST(8 AS DOUBLE)
                           ELSE CAST(7 AS DOUBLE) + CAST(c_custkey % 8 AS DOUBLE) / CAST(8 AS DOUBLE) END), '000010') AS l2 FROM {customer}"""

#: The records, and some objects again: in the first group under another name and a later epoch, and in a later part of their own
#: group with an earlier epoch.
TLE = f"""WITH base AS ({_TLE}) SELECT rec_no, grp, name, l1, l2 FROM base
UNION ALL SELECT rec_no + 1000000, 'active', concat(name, ' (AGAIN)'), concat(substr(l1, 1, 18), '24', substr(l1, 21)), l2 FROM base WHERE rec_no % 7 = 0
UNION ALL SELECT rec_no + 2000000, grp, concat(name, ' (BEFORE)'), concat(substr(l1, 1, 18), '22', substr(l1, 21)), l2 FROM base WHERE rec_no % 11 = 0"""

TEL = """SELECT event_id, user_id * 10 + event_id % 10 AS norad_id,
  1704067200000000 + {micros} - (CASE WHEN (user_id * 10 + event_id % 10) % 20 = 13 OR (user_id * 10 + event_id % 10) % 20 = 12 THEN 7200000000 ELSE 0 END) AS tel_us,
  (value - CAST(50 AS DOUBLE)) / CAST(1000 AS DOUBLE) * (CASE WHEN (user_id * 10 + event_id % 10) % 20 = 17 THEN CAST(40 AS DOUBLE) WHEN event_id % 50 = 0 THEN CAST(5 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END) AS dlat,
  CAST(event_id % 101 - 50 AS DOUBLE) / CAST(2000 AS DOUBLE) AS dlon, CASE WHEN event_id % 41 <> 3 THEN value / CAST(25 AS DOUBLE) END AS dalt
FROM {events} WHERE (user_id * 10 + event_id % 10) % 20 <> 7"""
SPARK_MICROS = "(unix_micros(CAST(ts AS TIMESTAMP)) - 1704067200000000) div 720"
DUCK_MICROS = "(epoch_us(ts) - 1704067200000000) // 720"

POS = """SELECT rec_no AS norad_id, lower(name) LIKE '%debris%' OR lower(name) LIKE '%cosmos%' OR lower(name) LIKE '%iridium%' AS is_debris,
  CASE WHEN rec_no % 3 = 0 THEN CAST(550 AS DOUBLE) WHEN rec_no % 3 = 1 THEN CAST(1500 AS DOUBLE) ELSE CAST(5000 AS DOUBLE) END AS alt,
  CAST((rec_no * 37) % 1600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(80 AS DOUBLE) AS lat,
  CAST((rec_no * 73) % 3600 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(180 AS DOUBLE) AS lon FROM {tle_fx} WHERE rec_no < 1000000"""

XYZ = """SELECT k AS norad_id, tick, CAST((k * k * 31 + k * 7919) % 8009 AS DOUBLE) / CAST(10 AS DOUBLE) + CAST(10 * tick AS DOUBLE) * vx AS x,
  CAST((k * k * 17 + k * 6007) % 8011 AS DOUBLE) / CAST(10 AS DOUBLE) + CAST(10 * tick AS DOUBLE) * vy AS y,
  CAST((k * k * 13 + k * 4999) % 8017 AS DOUBLE) / CAST(10 AS DOUBLE) + CAST(10 * tick AS DOUBLE) * vz AS z, vx, vy, vz
FROM (SELECT c_custkey AS k, CAST((c_custkey * c_custkey * 7 + c_custkey * 11) % 91 - 45 AS DOUBLE) / CAST(10 AS DOUBLE) AS vx,
    CAST((c_custkey * c_custkey * 5 + c_custkey * 13) % 89 - 44 AS DOUBLE) / CAST(10 AS DOUBLE) AS vy,
    CAST((c_custkey * c_custkey * 3 + c_custkey * 17) % 83 - 41 AS DOUBLE) / CAST(10 AS DOUBLE) AS vz FROM {customer}) o
CROSS JOIN (SELECT 0 AS tick UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) t"""

#: Class, warn km, critical km, warn age s, critical age s.
THRESHOLDS = [("LEO", 3.0, 10.0, 600, 3600), ("MEO", 15.0, 40.0, 1800, 21600), ("GEO", 80.0, 300.0, 3600, 43200), ("Debris", 2.0, 10.0, 300, 3600)]
OBSERVERS = [(1, 0.0, 0.0, 0.0, 90.0), (2, 45.0, 10.0, 0.0, 60.0), (3, -33.9, 151.2, 0.1, 30.0)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tle_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TLE, customer=table(spark, sf_dir, "customer"))


def tel_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TEL.replace("{micros}", SPARK_MICROS), events=table(spark, sf_dir, "events"))


def pos_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(POS, tle_fx=tle_fx(spark, sf_dir))


def xyz_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(XYZ, customer=table(spark, sf_dir, "customer"))


def tle_text_fx(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(grp, part, body): the feed as text, one row a group and a thousand records, as a feed lands in files."""
    rows = tle_fx(spark, sf_dir).selectExpr("grp", "cast(rec_no div 1000 as int) part", "rec_no", "concat(name, chr(10), l1, chr(10), l2) rec")
    return rows.groupBy("grp", "part").agg(_joined())


def _joined():
    from pyspark.sql import functions as F

    return F.concat_ws("\n", F.transform(F.array_sort(F.collect_list(F.struct("rec_no", "rec"))), lambda r: r["rec"])).alias("body")


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(THRESHOLDS, "orbit_class string, warn_km double, crit_km double, warn_age_s bigint, crit_age_s bigint")


def observers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OBSERVERS, "obs_id int, o_lat double, o_lon double, o_alt double, radius_deg double")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"CAST({v} AS DOUBLE)" if isinstance(v, float) else str(v) for v in r) + ")" for r in rows)


def sql_ctes() -> str:
    """The fixtures as a WITH clause for the SQL check."""
    made = {"tle_fx": TLE.replace("{customer}", "customer"), "tel_fx": TEL.replace("{micros}", DUCK_MICROS).replace("{events}", "events"), "pos_fx": POS.replace("{tle_fx}", "tle_fx"), "xyz_fx": XYZ.replace("{customer}", "customer")}
    values = f"thresholds(orbit_class, warn_km, crit_km, warn_age_s, crit_age_s) AS (VALUES {_values(THRESHOLDS)}), observers(obs_id, o_lat, o_lon, o_alt, radius_deg) AS (VALUES {_values(OBSERVERS)})"
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in made.items()) + ", " + values
