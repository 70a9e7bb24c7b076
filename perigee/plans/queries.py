"""The registered queries and, beside each, the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import catalog as cat
from ..operators import health as H
from ..operators import propagate as P
from ..operators import screening as S
from ..sources import feeds, scratch, stores, tle
from ..sources import fixtures as X
from ..streaming import fleet as L

QUERIES, SQL = {}, {}
PI = "3.141592653589793"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = X.sql_ctes() + ", " + COMMON + " " + sql
        return f

    return add


def _ecef_sql(lat: str, lon: str, alt: str) -> list[str]:
    return [f"(6378.137 + {alt}) * cos(radians({lat})) * cos(radians({lon}))", f"(6378.137 + {alt}) * cos(radians({lat})) * sin(radians({lon}))", f"(6378.137 + {alt}) * sin(radians({lat}))"]


def _dist_sql() -> str:
    return "sqrt(" + " + ".join(f"({p} - {q}) * ({p} - {q})" for p, q in zip(_ecef_sql("lat", "lon", "alt"), _ecef_sql("o_lat", "o_lon", "o_alt"), strict=True)) + ")"


CLASS = "CASE WHEN is_debris THEN 'Debris' WHEN alt <= 1000 THEN 'LEO' WHEN alt <= 2000 THEN 'MEO' ELSE 'GEO' END"
INCL = "CASE WHEN inclination < 10 THEN 'Equatorial' WHEN abs(inclination - 90) < 5 THEN 'Polar' WHEN inclination >= 96 AND inclination <= 99 THEN 'Sun-synchronous' ELSE 'Inclined' END"
EPOCH = "CASE WHEN yr IS NULL THEN '' ELSE strftime(make_date(CASE WHEN yr < 57 THEN yr + 2000 ELSE yr + 1900 END, 1, 1)::TIMESTAMP + to_milliseconds(CAST(floor((CAST(substr(l1, 21, 12) AS DOUBLE) - 1) * 86400000 + 0.5) AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%gZ') END"
COMMON = f"""cat0 AS (SELECT *, TRY_CAST(substr(l1, 3, 5) AS BIGINT) AS norad_id, TRY_CAST(substr(l1, 19, 2) AS INTEGER) AS yr, CAST(trim(substr(l2, 9, 8)) AS DOUBLE) AS inclination FROM tle_fx),
catalog AS (SELECT norad_id, name, l1, l2, inclination, {EPOCH} AS tle_epoch, regexp_matches(lower(name), 'debris|cosmos|iridium') AS is_debris, grp, CASE grp WHEN 'active' THEN 1 WHEN '1999-025' THEN 2 ELSE 3 END AS grp_ord, rec_no FROM cat0 WHERE norad_id IS NOT NULL),
latest AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY norad_id ORDER BY tel_us DESC, event_id DESC) AS rn FROM tel_fx) WHERE rn = 1),
fleet AS (SELECT p.norad_id, p.is_debris, p.lat, p.lon, p.alt, l.event_id, l.tel_us, p.lat + l.dlat AS o_lat, p.lon + l.dlon AS o_lon, p.alt + l.dalt AS o_alt FROM pos_fx p LEFT JOIN latest l USING (norad_id)),
rated AS (SELECT f.*, orbit_class, crit_km, warn_km, warn_age_s, crit_age_s, ({X.AS_OF} - tel_us) / 1000000.0::DOUBLE AS age_s, {_dist_sql()} AS deviation_km FROM (SELECT *, {CLASS} AS orbit_class FROM fleet) f JOIN thresholds USING (orbit_class)),
reasons AS (SELECT *, CASE WHEN tel_us IS NULL THEN 'no_telemetry' WHEN age_s > crit_age_s THEN 'stale_telemetry' WHEN deviation_km >= crit_km THEN 'large_deviation' WHEN deviation_km >= warn_km THEN 'deviation_warning' WHEN age_s >= warn_age_s THEN 'stale_warning' ELSE 'ok' END AS reason FROM rated),
health AS (SELECT *, CASE WHEN reason = 'ok' THEN 'Healthy' WHEN reason LIKE '%warning' THEN 'Warning' ELSE 'Critical' END AS status FROM reasons),
moves AS (SELECT a.tick, a.norad_id AS a, b.norad_id AS b, b.x - a.x AS dx, b.y - a.y AS dy, b.z - a.z AS dz, b.vx - a.vx AS dvx, b.vy - a.vy AS dvy, b.vz - a.vz AS dvz FROM xyz_fx a JOIN xyz_fx b ON a.tick = b.tick AND a.norad_id < b.norad_id AND abs(a.x - b.x) <= 85 AND abs(a.y - b.y) <= 85 AND abs(a.z - b.z) <= 85),
timed AS (SELECT *, CASE WHEN dvx * dvx + dvy * dvy + dvz * dvz = 0 THEN 0 ELSE greatest(-5.0, least(5.0, -(dx * dvx + dy * dvy + dz * dvz) / (dvx * dvx + dvy * dvy + dvz * dvz))) END AS t FROM moves),
hits AS (SELECT tick, a, b, sqrt((dx + dvx * t) ** 2 + (dy + dvy * t) ** 2 + (dz + dvz * t) ** 2) AS miss FROM timed),
close AS (SELECT * FROM hits WHERE miss <= 5),
isl AS (SELECT *, tick - row_number() OVER (PARTITION BY a, b ORDER BY tick) AS g FROM close),
enc AS (SELECT a, b, min(tick) AS first_tick, count(*) AS ticks, min(miss) AS miss, arg_min(tick, miss) AS tca_tick FROM isl GROUP BY a, b, g),
near AS (SELECT * FROM close WHERE tick BETWEEN 1 AND 3),
isl_near AS (SELECT *, tick - row_number() OVER (PARTITION BY a, b ORDER BY tick) AS g FROM near),
enc_near AS (SELECT a, b, min(miss) AS miss, arg_min(tick, miss) AS tca_tick FROM isl_near GROUP BY a, b, g),
ticks AS (SELECT {X.FIRST_TICK} + 30000000 * CAST(k AS BIGINT) AS tick_us FROM (SELECT unnest(range(({X.AS_OF} - {X.FIRST_TICK}) // 30000000 + 1)) AS k)),
last_reading AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY norad_id, tel_us ORDER BY event_id DESC) AS rn FROM tel_fx) WHERE rn = 1),
tick_fleet AS (SELECT o.tick_us, o.norad_id, o.is_debris, o.lat, o.lon, o.alt, l.tel_us, o.lat + l.dlat AS o_lat, o.lon + l.dlon AS o_lon, o.alt + l.dalt AS o_alt
  FROM (SELECT * FROM pos_fx, ticks) o ASOF LEFT JOIN last_reading l ON o.norad_id = l.norad_id AND o.tick_us >= l.tel_us),
tick_rated AS (SELECT f.*, crit_km, warn_km, warn_age_s, crit_age_s, (tick_us - tel_us) / 1000000.0::DOUBLE AS age_s, {_dist_sql()} AS deviation_km FROM (SELECT *, {CLASS} AS orbit_class FROM tick_fleet) f JOIN thresholds USING (orbit_class)),
tick_status AS (SELECT tick_us, CASE WHEN tel_us IS NULL OR age_s > crit_age_s OR deviation_km >= crit_km THEN 'Critical' WHEN deviation_km >= warn_km OR age_s >= warn_age_s THEN 'Warning' ELSE 'Healthy' END AS status FROM tick_rated),
percents AS (SELECT tick_us, count(*) AS total, count_if(status = 'Healthy') AS healthy, count_if(status = 'Warning') AS warning, count_if(status = 'Critical') AS critical, count_if(status = 'Healthy') / count(*) * 100 AS value FROM tick_status GROUP BY tick_us)"""


def _catalog(spark, d) -> DataFrame:
    return cat.parse(cat.records(X.tle_text_fx(spark, d)), X.GROUPS)


def _observed(rows: DataFrame) -> DataFrame:
    """Objects with their reading, whose offsets are added to the predicted position."""
    return rows.withColumns({f"o_{c}": F.col(c) + F.col(f"d{c}") for c in ("lat", "lon", "alt")})


def _fleet(spark, d) -> DataFrame:
    return _observed(H.fleet_join(X.pos_fx(spark, d), H.latest(X.tel_fx(spark, d)))).select("norad_id", "is_debris", "lat", "lon", "alt", "event_id", "tel_us", "o_lat", "o_lon", "o_alt")


def _feed(spark, d) -> DataFrame:
    """The feed, written as files in folders by group, and scanned."""
    path = scratch.fresh(spark)
    X.tle_text_fx(spark, d).repartition("grp", "part").select("grp", "body").write.partitionBy("grp").text(path)
    return feeds.tle_scan(spark, path, X.GROUPS)


def _health(spark, d) -> DataFrame:
    return H.assess(_fleet(spark, d), X.thresholds(spark), F.lit(X.AS_OF))


def _hits(spark, d) -> DataFrame:
    return S.screen(X.xyz_fx(spark, d))


@query("SELECT count(*) AS total, count_if(status = 'Healthy') AS healthy, count_if(status = 'Warning') AS warning, count_if(status = 'Critical') AS critical, CASE WHEN count(*) > 0 THEN round(count_if(status = 'Healthy') / count(*) * 100, 6) ELSE 0 END AS health_percent FROM health")
def fleet_summary(spark: SparkSession, d: str) -> DataFrame:
    return H.summary(_health(spark, d)).withColumn("health_percent", F.round("health_percent", 6))


@query("SELECT grp, count(*) AS n_records, CAST(sum(length(name) + length(l1) + length(l2) + 3) AS BIGINT) AS chars FROM tle_fx GROUP BY 1")
def tle_scan(spark, d):
    rows = _feed(spark, d).groupBy("grp").agg(F.sum(F.size(F.split("body", "\n")) - 1).alias("lines"), F.sum(F.length("body")).alias("chars"))
    return rows.select("grp", F.floor(F.col("lines") / 3).cast("bigint").alias("n_records"), "chars")


@query("SELECT norad_id, name, tle_epoch, grp FROM catalog")
def catalog_of_files(spark, d):
    return cat.parse(cat.records(_feed(spark, d)), X.GROUPS).select("norad_id", "name", "tle_epoch", "grp")


def _landed(spark, d) -> str:
    """The folder of the feed as files in folders by group."""
    path = scratch.fresh(spark)
    X.tle_text_fx(spark, d).repartition("grp", "part").select("grp", "body").write.partitionBy("grp").text(path)
    tle.register(spark)
    return path


@query("SELECT norad_id, name, tle_epoch, grp FROM catalog WHERE grp <> '1999-025'")
def catalog_of_source(spark, d):
    """Two groups of the feed by the data source, which opens no file of the third."""
    rows = spark.read.format("tle").option("groups", ",".join(X.GROUPS)).load(_landed(spark, d)).where(F.col("grp").isin("active", "iridium-33-debris"))
    return cat.parse(cat.records(rows), X.GROUPS).select("norad_id", "name", "tle_epoch", "grp")


@query("SELECT norad_id, name, tle_epoch, grp FROM catalog")
def catalog_stream(spark, d):
    """The catalogue from a stream over the feed's files."""
    path, out = _landed(spark, d), scratch.fresh(spark)
    rows = cat.parse(cat.records(spark.readStream.format("tle").option("groups", ",".join(X.GROUPS)).load(path)), X.GROUPS)
    L.log(rows, out, f"{out}-c").awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select("norad_id", "name", "tle_epoch", "grp")


def _readings(spark, d) -> DataFrame:
    """Telemetry, written as a reader finds it, and scanned. An object's position is taken from pos_fx."""
    path = scratch.fresh(spark)
    rows = _observed(X.tel_fx(spark, d).join(X.pos_fx(spark, d), "norad_id"))
    rows.select("event_id", "norad_id", F.timestamp_micros("tel_us").alias("ts"), F.col("o_lat").alias("lat"), F.col("o_lon").alias("lon"), F.col("o_alt").alias("alt_km")).write.parquet(path)
    return feeds.telemetry_scan(spark, path)


@query("SELECT event_id, norad_id, tel_us, round(lat + dlat, 6) AS o_lat, round(lon + dlon, 6) AS o_lon, round(alt + dalt, 6) AS o_alt FROM tel_fx JOIN pos_fx USING (norad_id)")
def telemetry_scan(spark, d):
    return _readings(spark, d).select("event_id", "norad_id", "tel_us", *[F.round(c, 6).alias(c) for c in ("o_lat", "o_lon", "o_alt")])


@query("SELECT norad_id, orbit_class, status, reason FROM health")
def health_of_files(spark, d):
    rows = H.fleet_join(X.pos_fx(spark, d), H.latest(_readings(spark, d)))
    return H.assess(rows, X.thresholds(spark), F.lit(X.AS_OF)).select("norad_id", "orbit_class", "status", "reason")


@query("SELECT grp, line FROM tle_fx, LATERAL (SELECT unnest([name, l1, l2]) AS line)")
def tle_lines(spark, d):
    return cat.lines(X.tle_text_fx(spark, d)).select("grp", "line")


@query("SELECT grp, name, l1, l2 FROM tle_fx")
def tle_records(spark, d):
    return cat.records(X.tle_text_fx(spark, d)).select("grp", "name", "l1", "l2")


@query("SELECT name, norad_id FROM cat0")
def norad_id_parse(spark, d):
    return cat.records(X.tle_text_fx(spark, d)).select("name", C.norad_id(F.col("l1")).alias("norad_id"))


@query(f"SELECT name, {EPOCH} AS tle_epoch FROM cat0")
def tle_epoch(spark, d):
    return cat.records(X.tle_text_fx(spark, d)).select("name", C.epoch_iso(F.col("l1")).alias("tle_epoch"))


@query("SELECT name, inclination FROM cat0")
def tle_inclination(spark, d):
    return cat.records(X.tle_text_fx(spark, d)).select("name", C.inclination(F.col("l2")).alias("inclination"))


@query("SELECT name, regexp_matches(lower(name), 'debris|cosmos|iridium') AS is_debris FROM tle_fx")
def debris_flag(spark, d):
    return cat.records(X.tle_text_fx(spark, d)).select("name", C.is_debris(F.col("name")).alias("is_debris"))


@query("SELECT norad_id, name, l1, l2, inclination, tle_epoch, is_debris, grp, grp_ord FROM catalog")
def catalog(spark, d):
    return _catalog(spark, d).select("norad_id", "name", "l1", "l2", "inclination", "tle_epoch", "is_debris", "grp", "grp_ord")


@query("SELECT norad_id, round(CAST(replace(substr(l1, 54, 6), ' ', '') AS DOUBLE) * 0.00001::DOUBLE * power(10.0, CAST(replace(substr(l1, 60, 2), ' ', '') AS DOUBLE)), 9) AS bstar, inclination AS incl_deg, CAST(trim(substr(l2, 18, 8)) AS DOUBLE) AS node_deg, CAST('0.' || trim(substr(l2, 27, 7)) AS DOUBLE) AS ecc, CAST(trim(substr(l2, 35, 8)) AS DOUBLE) AS argp_deg, CAST(trim(substr(l2, 44, 8)) AS DOUBLE) AS mean_deg, CAST(trim(substr(l2, 53, 11)) AS DOUBLE) AS rev_day FROM catalog")
def tle_elements(spark, d):
    return cat.elements(_catalog(spark, d)).drop("tle_epoch").withColumn("bstar", F.round("bstar", 9))


_FAILED = "SELECT norad_id, if(norad_id % 97 = 5, 0.0D, lat) AS lat, if(norad_id % 97 = 5, 0.0D, lon) AS lon, if(norad_id % 97 = 5 or norad_id % 89 = 7, 0.0D, alt) AS alt FROM {pos}"


@query("SELECT norad_id, lat, lon, CASE WHEN norad_id % 89 = 7 THEN 0 ELSE alt END AS alt FROM pos_fx WHERE norad_id % 97 <> 5")
def valid_positions(spark, d):
    return H.valid(spark.sql(_FAILED, pos=X.pos_fx(spark, d)))


@query(f"SELECT norad_id, alt FROM pos_fx WHERE {CLASS} IN ('LEO', 'Debris')")
def class_filter(spark, d):
    return H.class_filter(X.pos_fx(spark, d), ["LEO", "Debris"]).select("norad_id", "alt")


@query("SELECT norad_id, name FROM catalog WHERE contains(lower(name), 'cos') OR contains(CAST(norad_id AS VARCHAR), 'cos') ORDER BY grp_ord, rec_no LIMIT 20")
def catalog_search(spark, d):
    return cat.search(_catalog(spark, d), "COS").select("norad_id", "name")


@query("SELECT norad_id, lat, lon, alt FROM pos_fx WHERE norad_id = 42")
def point_by_id(spark, d):
    return X.pos_fx(spark, d).where("norad_id = 42").select("norad_id", "lat", "lon", "alt")


@query(f"SELECT norad_id, {CLASS} AS orbit_class FROM pos_fx")
def orbit_class(spark, d):
    return X.pos_fx(spark, d).select("norad_id", C.orbit_class(F.col("alt"), F.col("is_debris")).alias("orbit_class"))


@query(f"SELECT norad_id, {INCL} AS orbit_type FROM catalog")
def inclination_class(spark, d):
    return _catalog(spark, d).select("norad_id", C.inclination_class(F.col("inclination")).alias("orbit_type"))


@query("SELECT norad_id, orbit_class, warn_km, crit_km, warn_age_s, crit_age_s FROM rated")
def thresholds_join(spark, d):
    rows = X.pos_fx(spark, d).select("norad_id", C.orbit_class(F.col("alt"), F.col("is_debris")).alias("orbit_class"))
    return rows.join(F.broadcast(X.thresholds(spark)), "orbit_class").select("norad_id", "orbit_class", "warn_km", "crit_km", "warn_age_s", "crit_age_s")  # four rows


@query("SELECT norad_id, orbit_class, status, reason, round(age_s, 3) AS age_s, round(deviation_km, 6) AS deviation_km FROM health")
def satellite_health(spark, d):
    return _health(spark, d).select("norad_id", "orbit_class", "status", "reason", F.round("age_s", 3).alias("age_s"), F.round("deviation_km", 6).alias("deviation_km"))


@query("SELECT norad_id, " + ", ".join(f"round({e}, 6) AS {n}" for e, n in zip(_ecef_sql("lat", "lon", "alt"), "xyz", strict=True)) + " FROM pos_fx")
def ecef(spark, d):
    return X.pos_fx(spark, d).select("norad_id", *[F.round(e, 6).alias(n) for e, n in zip(C.ecef(F.col("lat"), F.col("lon"), F.col("alt")), "xyz", strict=True)])


@query("SELECT norad_id, round(deviation_km, 6) AS deviation_km FROM rated WHERE tel_us IS NOT NULL")
def deviation_km(spark, d):
    rows = _fleet(spark, d).where("tel_us is not null")
    return rows.select("norad_id", F.round(C.distance_km(tuple(map(F.col, ("lat", "lon", "alt"))), tuple(map(F.col, ("o_lat", "o_lon", "o_alt")))), 6).alias("deviation_km"))


@query(f"SELECT event_id, round(({X.AS_OF} - tel_us) / 1000000.0::DOUBLE, 3) AS age_s FROM tel_fx")
def telemetry_age(spark, d):
    return X.tel_fx(spark, d).select("event_id", F.round(C.age_seconds(F.lit(X.AS_OF), F.col("tel_us")), 3).alias("age_s"))


_JD = "(tel_us / 86400000000.0::DOUBLE - 0.5 + 2440588 - 2451545)"
_SUN = f"""SELECT *, asin(sin(0.40909994067971484) * sin(el)) AS decl, radians(280.16 + 360.9856235 * dd) - atan2(sin(el) * cos(0.40909994067971484), cos(el)) AS hour FROM (
SELECT *, m + radians(1.9148 * sin(m) + 0.02 * sin(2 * m) + 0.0003 * sin(3 * m)) + radians(102.9372) + {PI} AS el FROM (SELECT *, {_JD} AS dd, radians(357.5291 + 0.98560028 * {_JD}) AS m FROM tel_fx))"""
_SUBSOLAR = "fmod(180 - degrees(atan2(sin(hour), -tan(decl))), 360) - 180"


@query(f"SELECT event_id, round({_SUBSOLAR}, 6) AS sun_lon FROM ({_SUN})")
def subsolar(spark, d):
    return X.tel_fx(spark, d).select("event_id", F.round(C.subsolar_lon(F.col("tel_us")), 6).alias("sun_lon"))


@query(f"SELECT event_id, round(greatest(0.0, 1 - (CASE WHEN gap > 180 THEN 360 - gap ELSE gap END) / 90), 6) AS daylight FROM (SELECT event_id, abs(dlon * 3600 - ({_SUBSOLAR})) AS gap FROM ({_SUN}))")
def daylight_factor(spark, d):
    return X.tel_fx(spark, d).select("event_id", F.round(C.daylight(F.col("dlon") * 3600, C.subsolar_lon(F.col("tel_us"))), 6).alias("daylight"))


@query(f"SELECT event_id, round(fmod(radians(s / 240.0), 2 * {PI}), 6) AS gmst FROM (SELECT event_id, -6.2e-6 * t * t * t + 0.093104 * t * t + (876600.0 * 3600 + 8640184.812866) * t + 67310.54841 AS s FROM (SELECT event_id, (tel_us / 86400000000.0::DOUBLE + 2440587.5 - 2451545.0) / 36525.0 AS t FROM tel_fx))")
def gmst(spark, d):
    return X.tel_fx(spark, d).select("event_id", F.round(C.gmst(F.col("tel_us")), 6).alias("gmst"))


@query("SELECT norad_id, event_id, tel_us FROM fleet")
def fleet_join(spark, d):
    return _fleet(spark, d).select("norad_id", "event_id", "tel_us")


@query(f"SELECT p.norad_id, p.alt, name, {INCL} AS orbit_type FROM pos_fx p JOIN (SELECT * FROM catalog QUALIFY row_number() OVER (PARTITION BY norad_id ORDER BY grp_ord, rec_no) = 1) c USING (norad_id)")
def point_details(spark, d):
    return cat.point_details(X.pos_fx(spark, d), _catalog(spark, d)).select("norad_id", "alt", "name", "orbit_type")


@query("SELECT obs_id, norad_id, round(z, 6) AS zenith_deg FROM (SELECT obs_id, radius_deg, norad_id, degrees(acos(greatest(-1.0, least(1.0, ((x - ox) * ox + (y - oy) * oy + (z - oz) * oz) / (sqrt(ox * ox + oy * oy + oz * oz) * sqrt((x - ox) * (x - ox) + (y - oy) * (y - oy) + (z - oz) * (z - oz))))))) AS z FROM (SELECT norad_id, " + ", ".join(f"{e} AS {n}" for e, n in zip(_ecef_sql("lat", "lon", "alt"), "xyz", strict=True)) + " FROM pos_fx), (SELECT obs_id, radius_deg, " + ", ".join(f"{e} AS o{n}" for e, n in zip(_ecef_sql("o_lat", "o_lon", "o_alt"), "xyz", strict=True)) + " FROM observers)) WHERE z <= radius_deg")
def overhead(spark, d):
    return S.overhead(X.pos_fx(spark, d), X.observers(spark)).withColumn("zenith_deg", F.round("zenith_deg", 6))


@query(f"SELECT count_if(is_debris) AS debris, count_if(NOT is_debris AND alt <= 1000) AS leo, count_if(NOT is_debris AND alt > 1000 AND alt <= 2000) AS meo, count_if(NOT is_debris AND alt > 2000) AS geo, count(*) AS total, count_if({CLASS} IN ('LEO', 'MEO')) AS filtered FROM pos_fx")
def orbit_overview(spark, d):
    return H.overview(X.pos_fx(spark, d), ["LEO", "MEO"])


@query("SELECT status, count(*) AS value, CAST(floor(count(*) / (SELECT count(*) FROM health) * 100 + 0.5) AS BIGINT) AS percent FROM health GROUP BY status")
def health_distribution(spark, d):
    return H.distribution(_health(spark, d))


@query("SELECT orbit_class, count(*) AS total, count_if(status = 'Healthy') AS healthy, count_if(status = 'Warning') AS warning, count_if(status = 'Critical') AS critical, round(count_if(status = 'Healthy') / count(*) * 100, 6) AS health_percent FROM health GROUP BY ROLLUP (orbit_class)")
def fleet_summary_by_class(spark, d):
    return H.summary(_health(spark, d), ["orbit_class"], total=True).withColumn("health_percent", F.round("health_percent", 6))


def _ticks(spark, d) -> DataFrame:
    return H.by_tick(X.pos_fx(spark, d), X.tel_fx(spark, d), _observed, X.thresholds(spark), X.FIRST_TICK, X.AS_OF)


def _points(spark, d) -> DataFrame:
    return _ticks(spark, d).select("tick_us", F.col("health_percent").alias("value"))


@query("SELECT tick_us, round(value, 6) AS value FROM percents ORDER BY tick_us DESC LIMIT 50")
def health_history(spark, d):
    return H.history(_points(spark, d)).withColumn("value", F.round("value", 6))


@query("SELECT tick_us, strftime(make_timestamp(tick_us), '%H:%M') AS label, CAST(floor(value + 0.5) AS BIGINT) AS value FROM percents ORDER BY tick_us DESC LIMIT 20")
def health_trend(spark, d):
    return H.trend(_points(spark, d))


@query("SELECT norad_id, event_id, tel_us FROM latest")
def latest_telemetry(spark, d):
    return H.latest(X.tel_fx(spark, d)).select("norad_id", "event_id", "tel_us")


@query("SELECT tick_us, total, healthy, warning, critical, round(value, 6) AS health_percent FROM percents")
def health_by_tick(spark, d):
    return _ticks(spark, d).withColumn("health_percent", F.round("health_percent", 6))


@query("SELECT norad_id, event_id, tel_us, last_value(dalt IGNORE NULLS) OVER (PARTITION BY norad_id ORDER BY tel_us, event_id ROWS UNBOUNDED PRECEDING) AS dalt_so_far FROM tel_fx")
def telemetry_running_latest(spark, d):
    return H.running_latest(X.tel_fx(spark, d))


@query("SELECT norad_id, name, tle_epoch FROM catalog QUALIFY row_number() OVER (PARTITION BY norad_id ORDER BY grp_ord, rec_no) = 1")
def satellites(spark, d):
    return cat.current(_catalog(spark, d)).select("norad_id", "name", "tle_epoch")


@query("SELECT norad_id, tick, round(x, 6) AS x FROM xyz_fx WHERE norad_id = 7 AND tick > 1")
def positions_since(spark, d):
    return P.positions_since(X.xyz_fx(spark, d), 7, 1, "tick").select("norad_id", "tick", F.round("x", 6).alias("x"))


@query("SELECT norad_id, tick, round(x, 6) AS x FROM xyz_fx WHERE norad_id = 7 AND tick = 2")
def position_at(spark, d):
    return P.position_at(X.xyz_fx(spark, d), 7, 2, "tick").select("norad_id", "tick", F.round("x", 6).alias("x"))


@query("SELECT CAST(d AS VARCHAR) AS date, CAST(count(*) AS BIGINT) AS n, count(DISTINCT norad_id) AS objects, CAST(0 AS BIGINT) AS wrong FROM catalog, (VALUES (DATE '2024-01-01'), (DATE '2024-01-02'), (DATE '2024-01-02')) t(d) GROUP BY 1")
def positions_table(spark, d):
    """Five instants on four dates, written day by day, one day twice; the first and the last are cut off by the range that is
    read. Stored places are held against those of the ephemeris."""
    path, hours = scratch.fresh(spark), [X.AS_OF + 3_600_000_000 * h for h in (-2, 0, 24, 30, 72)]
    c = _catalog(spark, d).where("norad_id is not null")
    for ticks in (hours[2:3], hours[:1], hours[1:2], hours[4:], hours[2:4]):
        P.write_positions(c, ticks, path)
    rows = P.read_positions(spark, path, hours[1], hours[3])
    kept = ["x", "y", "z", "lat", "lon", "alt_km"]
    made = P.ephemeris(c, hours[1:4]).groupBy("norad_id", "ts_us").agg(*[F.array_sort(F.collect_list(F.coalesce(F.round(k, 6), F.lit(-1e9)))).alias(f"m_{k}") for k in kept])  # a record or two of an object
    held = rows.groupBy("norad_id", "ts_us").agg(F.first("date").alias("date"), F.count("*").alias("n"), *[F.array_sort(F.collect_list(F.coalesce(F.round(k, 6), F.lit(-1e9)))).alias(k) for k in kept])
    both = held.join(made, ["norad_id", "ts_us"], "left").withColumn("same", F.expr(" and ".join(f"{k} <=> m_{k}" for k in kept)))
    return both.groupBy(F.col("date").cast("string").alias("date")).agg(F.sum("n").alias("n"), F.count_distinct("norad_id").alias("objects"), F.count_if(~F.col("same")).alias("wrong"))


def _history(spark, d) -> DataFrame:
    """The element history: one half of the feed, then all of it twice."""
    name, path = f"history_{scratch.fresh(spark)[-32:]}", scratch.fresh(spark)
    stores.open_history(spark, name, path, 8)
    c = _catalog(spark, d)
    for rows in (c.where("rec_no % 2 = 0 and norad_id % 7 <> 0 and norad_id % 11 <> 0"), c, c):
        stores.append_history(spark, name, rows, 8)
    return spark.table(name)


HELD = "(SELECT norad_id, tle_epoch, name, l1 FROM catalog WHERE tle_epoch <> '' QUALIFY row_number() OVER (PARTITION BY norad_id, tle_epoch ORDER BY grp_ord, rec_no) = 1)"
ASKED = ("2023-11-30T00:00:00.000Z", "1999-01-01T00:00:00.000Z", "2024-11-15T12:00:00.000Z", "2022-12-01T00:00:00.000Z")


@query(f"SELECT norad_id, tle_epoch, name FROM {HELD}")
def tle_history(spark, d):
    return _history(spark, d).select("norad_id", "tle_epoch", "name")


@query("SELECT a.norad_id, t_iso, tle_epoch, name FROM (SELECT DISTINCT norad_id, t_iso FROM catalog, (VALUES " + ", ".join(f"('{t}')" for t in ASKED) + f") v(t_iso)) a ASOF JOIN {HELD} h ON a.norad_id = h.norad_id AND a.t_iso >= h.tle_epoch")
def tle_asof(spark, d):
    """The stored elements of every object as of four instants."""
    asked = _catalog(spark, d).select("norad_id").distinct().select("norad_id", F.explode(F.array(*map(F.lit, ASKED))).alias("t_iso"))
    return stores.history_as_of(_history(spark, d), asked, 8).select("norad_id", "t_iso", "tle_epoch", "name")


@query("SELECT norad_id, t_iso, arg_max(tle_epoch, tle_epoch) AS tle_epoch, arg_max(name, tle_epoch) AS name FROM catalog, (SELECT '2023-11-30T00:00:00.000Z' AS t_iso UNION ALL SELECT '1999-01-01T00:00:00.000Z') WHERE tle_epoch <> '' AND tle_epoch <= t_iso GROUP BY norad_id, t_iso")
def catalog_asof(spark, d):
    """The elements of a feed, not stored, as of two instants."""
    c = _catalog(spark, d)
    asked = c.select("norad_id", F.explode(F.array(F.lit("2023-11-30T00:00:00.000Z"), F.lit("1999-01-01T00:00:00.000Z"))).alias("t_iso")).distinct()
    return cat.as_of_elements(c, asked).select("norad_id", "t_iso", "tle_epoch", "name")


@query("SELECT tick, a, b, round(miss, 6) AS miss_km FROM close")
def screening(spark, d):
    return _hits(spark, d).select("tick", "a", "b", F.round("miss_km", 6).alias("miss_km"))


@query("SELECT a, b, first_tick, ticks, round(miss, 6) AS miss_km, tca_tick FROM enc")
def conjunctions(spark, d):
    return S.encounters(_hits(spark, d)).withColumn("miss_km", F.round("miss_km", 6))


@query("SELECT a, b, tca_tick, round(miss, 6) AS miss_km FROM enc_near")
def conjunctions_range(spark, d):
    return S.conjunctions_between(X.xyz_fx(spark, d), 1, 3).select("a", "b", "tca_tick", F.round("miss_km", 6).alias("miss_km"))


@query("SELECT 'health' AS kind, norad_id AS a, CAST(NULL AS BIGINT) AS b, reason AS detail FROM health WHERE status = 'Critical' UNION ALL SELECT 'conjunction', a, b, 'high' FROM enc WHERE miss < 1")
def alerts(spark, d):
    return S.alerts(_health(spark, d), S.encounters(_hits(spark, d)))


@query(f"SELECT tel_us // 3600000000 AS hour, {CLASS} AS orbit_class, count(*) AS n FROM tel_fx JOIN pos_fx USING (norad_id) GROUP BY 1, 2")
def trends(spark, d):
    rows = X.tel_fx(spark, d).join(X.pos_fx(spark, d), "norad_id").select(F.floor(F.col("tel_us") / 3600000000).alias("hour"), C.orbit_class(F.col("alt"), F.col("is_debris")).alias("orbit_class"))
    return rows.groupBy("hour", "orbit_class").agg(F.count("*").alias("n"))


@query()
def conjunctions_curved(spark, d):
    """Encounters of all objects of the feed on their propagated orbits, at ticks of a minute over ten minutes, within 20 km."""
    c = cat.current(_catalog(spark, d).where("norad_id is not null"))
    states = P.ephemeris(c, [X.AS_OF + 60_000_000 * k for k in range(11)], "drop")
    states = states.withColumn("tick", ((F.col("ts_us") - X.AS_OF) / 60_000_000).cast("int"))
    return S.encounters(S.screen_curved(states, 20.0, 60.0)).withColumn("miss_km", F.round("miss_km", 3))


@query("SELECT CASE WHEN miss < 1 THEN 'high' WHEN miss < 5 THEN 'medium' ELSE 'low' END AS risk, count(*) AS n FROM enc GROUP BY 1")
def risk_distribution(spark, d):
    return S.encounters(_hits(spark, d)).groupBy(S.risk_band(F.col("miss_km")).alias("risk")).agg(F.count("*").alias("n"))


@query()
def ephemeris_sgp4(spark, d):
    return P.ephemeris(_catalog(spark, d), [X.AS_OF + 60_000_000 * k for k in range(10)])


@query()
def positions_tick(spark, d):
    return P.positions(_catalog(spark, d), X.AS_OF).select("norad_id", "ts_us", "lat", "lon", "alt_km")


@query()
def speed(spark, d):
    return P.with_speed(P.ephemeris(_catalog(spark, d), [X.AS_OF])).select("norad_id", "speed")


@query()
def satellite_details(spark, d):
    return P.details(_catalog(spark, d), 42, X.AS_OF)


@query()
def fleet_health_sgp4(spark, d):
    """The whole chain: each object predicted at its own reading's time, or now, and rated against the reading."""
    c = cat.current(_catalog(spark, d)).select("norad_id", "l1", "l2", "tle_epoch", "is_debris")
    rows = H.fleet_join(c, H.latest(X.tel_fx(spark, d))).withColumn("ts_us", F.coalesce("tel_us", F.lit(X.AS_OF)))
    at = P.predict_at(rows, on_fail="zero").withColumnRenamed("alt_km", "alt")
    return H.assess(_observed(at), X.thresholds(spark), F.lit(X.AS_OF)).select("norad_id", "orbit_class", "status", "reason")


def _arriving(spark, d, pieces: int) -> tuple[DataFrame, str]:
    """Telemetry as files that a stream finds piece by piece; every file has readings of the whole hour. A piece has as many
    files as the table has input tasks, so that it is written and read by as many. Also the folder."""
    path = scratch.fresh(spark)
    rows = X.tel_fx(spark, d)
    files = max(1, rows.rdd.getNumPartitions())
    rows.repartition(pieces * files, "event_id").write.parquet(f"{path}/in")
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/in").withColumn("ts", F.timestamp_micros("tel_us")), path


def _clock(spark, path: str, us: int | None) -> DataFrame:
    """A clock that has one instant, or none yet."""
    rows = spark.range(1 if us is not None else 0).select(F.timestamp_micros(F.lit(us or 0)).alias("ts"))
    rows.write.mode("append").parquet(f"{path}/clock")
    return spark.readStream.schema("ts timestamp").parquet(f"{path}/clock")


def _tick_stream(spark, d) -> tuple[DataFrame, str]:
    """The stream of health by tick over shuffled telemetry, of which readings may be three hours late; it is started again
    when the clock has gone on beyond the last tick."""
    telemetry, path = _arriving(spark, d, 3)
    objects, late = X.pos_fx(spark, d), 10_800
    rated = L.rated_readings(telemetry, objects, _observed, X.thresholds(spark))
    for us in (None, X.AS_OF + late * 1_000_000):
        rows = L.tick_health(rated, objects, X.FIRST_TICK, _clock(spark, path, us), late_s=late)
        L.log(rows, f"{path}/ticks", f"{path}/c1").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/ticks"), path


@query("SELECT tick_us, total, healthy, warning, critical, round(value, 6) AS health_percent FROM percents")
def health_tick_stream(spark, d):
    """health_by_tick as a stream."""
    return _tick_stream(spark, d)[0].select("tick_us", "total", "healthy", "warning", "critical", F.round("health_percent", 6).alias("health_percent"))


@query("SELECT tick_us, strftime(make_timestamp(tick_us), '%H:%M') AS label, CAST(floor(value + 0.5) AS BIGINT) AS value FROM percents ORDER BY tick_us DESC LIMIT 20")
def health_trend_stream(spark, d):
    """The trend of the history that a stream keeps of the ticks of another."""
    rows, path = _tick_stream(spark, d)
    points = spark.readStream.schema(rows.schema).parquet(f"{path}/ticks").select("fleet", "tick_us", F.col("health_percent").alias("value"))
    ring = L.history_ring(points)
    L.keep_latest(ring, f"{path}/ring", f"{path}/c2").awaitTermination()
    return H.trend(L.latest(spark, f"{path}/ring", "fleet string, points array<struct<tick_us:bigint,value:double>>").select(F.explode("points").alias("p")).select("p.*"))


def _changes(spark, d) -> tuple[DataFrame, str]:
    """The changes of status over shuffled telemetry, seen as it arrives; the watermark, a minute behind, goes on to AS_OF."""
    telemetry, path = _arriving(spark, d, 3)
    seen = telemetry.withColumn("ts", F.timestamp_micros(F.lit(X.AS_OF + 1_000_000)))
    rated = L.rated_readings(seen, X.pos_fx(spark, d), _observed, X.thresholds(spark))
    L.log(L.status_changes(rated, _clock(spark, path, X.AS_OF + 60_000_000), 60), f"{path}/changes", f"{path}/c1").awaitTermination()
    return spark.read.schema(L.CHANGES).parquet(f"{path}/changes"), path


@query("SELECT norad_id, reason FROM health WHERE reason <> 'no_telemetry'")
def status_stream(spark, d):
    """The last reason of every object that has one, from the stream of changes."""
    return _changes(spark, d)[0].groupBy("norad_id").agg(F.max_by("new_reason", "seq").alias("reason"))


@query("SELECT count(*) AS total, count_if(status = 'Healthy') AS healthy, count_if(status = 'Warning') AS warning, count_if(status = 'Critical') AS critical, round(count_if(status = 'Healthy') / count(*) * 100, 6) AS health_percent FROM health")
def fleet_summary_stream(spark, d):
    """The summary of a fleet, counted up and down from the changes of its objects."""
    rows, path = _changes(spark, d)
    total = X.pos_fx(spark, d).groupBy(F.lit("all").alias("fleet")).agg(F.count("*").alias("total"))
    L.keep_latest(L.fleet_counts(spark.readStream.schema(rows.schema).parquet(f"{path}/changes"), total), f"{path}/counts", f"{path}/c2").awaitTermination()
    return L.latest(spark, f"{path}/counts", L.COUNTS).select("total", "healthy", "warning", "critical", F.round("health_percent", 6).alias("health_percent"))
