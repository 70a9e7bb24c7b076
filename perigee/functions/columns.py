"""Column expressions: element parsing, orbit classes, geometry, sun."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6378.137


def number_prefix(text: Column) -> Column:
    """The longest numeric prefix after leading blanks, or null."""
    return F.regexp_extract(text, r"^\s*([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)", 1).try_cast("double")


def norad_id(l1: Column) -> Column:
    """The object number in columns 3 to 7: blank is 0; what is not a whole decimal number gives null."""
    field = F.trim(F.substring(l1, 3, 5))
    return F.when(field == "", F.lit(0)).when(field.rlike(r"^[+-]?[0-9]+(\.0*)?([eE]\+?[0-9]+)?$"), field.try_cast("double")).cast("bigint")


def epoch_iso(l1: Column) -> Column:
    """The epoch as ISO text; years below 57 are of this century; empty if either field is no number."""
    year, day = F.regexp_extract(F.substring(l1, 19, 2), r"^\s*([+-]?[0-9]+)", 1).try_cast("int"), number_prefix(F.substring(l1, 21, 12))
    first = F.unix_millis(F.make_timestamp(F.when(year < 57, year + 2000).otherwise(year + 1900), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0), F.lit("UTC")))
    return F.coalesce(F.date_format(F.timestamp_millis(first + F.floor((day - 1) * 86400000.0 + 0.5).cast("bigint")), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))


def inclination(l2: Column) -> Column:
    return number_prefix(F.substring(l2, 9, 8))


def is_debris(name: Column) -> Column:
    return F.lower(name).rlike("debris|cosmos|iridium")


def orbit_class(alt: Column, debris: Column) -> Column:
    """Debris first, then by altitude; an altitude that is no number falls through to GEO."""
    return F.when(F.coalesce(debris, F.lit(False)), "Debris").when(alt <= 1000, "LEO").when(alt <= 2000, "MEO").otherwise("GEO")


def inclination_class(degrees: Column) -> Column:
    return F.when(degrees < 10, "Equatorial").when(F.abs(degrees - 90) < 5, "Polar").when((degrees >= 96) & (degrees <= 99), "Sun-synchronous").otherwise("Inclined")


def ecef(lat: Column, lon: Column, alt: Column) -> tuple[Column, Column, Column]:
    """Spherical: the Earth's radius plus altitude."""
    r = F.lit(EARTH_KM) + alt
    return r * F.cos(F.radians(lat)) * F.cos(F.radians(lon)), r * F.cos(F.radians(lat)) * F.sin(F.radians(lon)), r * F.sin(F.radians(lat))


def distance_km(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """The chord between two (lat, lon, alt)."""
    return F.sqrt(sum(((p - q) * (p - q) for p, q in zip(ecef(*a), ecef(*b), strict=True)), F.lit(0.0)))


def age_seconds(as_of_us: Column, tel_us: Column) -> Column:
    return (as_of_us - tel_us) / F.lit(1e6)


def julian_day(us: Column) -> Column:
    return us / F.lit(86400e6) + F.lit(2440587.5)


def gmst(us: Column) -> Column:
    """Greenwich sidereal time in radians, from 0 to two pi (IAU 1982)."""
    t = (julian_day(us) - 2451545.0) / 36525.0
    seconds = -6.2e-6 * t * t * t + 0.093104 * t * t + (876600.0 * 3600 + 8640184.812866) * t + 67310.54841
    return F.pmod(F.radians(seconds / 240.0), F.lit(2 * 3.141592653589793))


def subsolar_lon(us: Column) -> Column:
    """((180 - azimuth) % 360) - 180 with a truncating %, from the sun's azimuth seen at latitude and longitude 0.

    Not a true sub-solar longitude, but the one that is wanted. Azimuth is from the south, westward, in degrees.
    """
    d = us / F.lit(86400e6) - 0.5 + 2440588 - 2451545
    m = F.radians(357.5291 + 0.98560028 * d)
    ecliptic = m + F.radians(1.9148 * F.sin(m) + 0.02 * F.sin(2 * m) + 0.0003 * F.sin(3 * m)) + F.radians(F.lit(102.9372)) + 3.141592653589793
    e = 0.40909994067971484
    dec, ra = F.asin(F.sin(F.lit(e)) * F.sin(ecliptic)), F.atan2(F.sin(ecliptic) * F.cos(F.lit(e)), F.cos(ecliptic))
    hour = F.radians(280.16 + 360.9856235 * d) - ra
    azimuth = F.degrees(F.atan2(F.sin(hour), -F.tan(dec)))
    return (180 - azimuth) % 360 - 180


def daylight(lon: Column, sun_lon: Column, width: float = 90.0) -> Column:
    gap = F.abs(lon - sun_lon)
    gap = F.when(gap > 180, 360 - gap).otherwise(gap)
    return F.greatest(F.lit(0.0), 1 - gap / F.lit(width))


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)
