"""Almanac columns for any table with a timestamp: column algebra only, so it stays in generated code."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Names in order.
KARANA = ("bava", "balava", "kaulava", "taitila", "gara", "vanija", "vishti")
LAST_KARANA = ("shakuni", "chatushpada", "naga")
MONTHS = ("vaishakha", "jyeshtha", "ashadha", "shravana", "bhadrapada", "ashwin", "kartika", "margashirsha", "pausha", "magha", "phalguna", "chaitra")
#: The names of the lunar days of a half month, of its last day in either half, and of the one named muhurta.
TITHI = {
    "en": ("Pratipada", "Dwitiya", "Tritiya", "Chaturthi", "Panchami", "Shashthi", "Saptami", "Ashtami", "Navami", "Dashami", "Ekadashi", "Dwadashi", "Trayodashi", "Chaturdashi"),
    "hi": ("प्रतिपदा", "द्वितीया", "तृतीया", "चतुर्थी", "पंचमी", "षष्ठी", "सप्तमी", "अष्टमी", "नवमी", "दशमी", "एकादशी", "द्वादशी", "त्रयोदशी", "चतुर्दशी"),
}
FULL_MOON, NEW_MOON = {"en": "Purnima", "hi": "पूर्णिमा"}, {"en": "Amavasya", "hi": "अमावस्या"}
BRAHMA, MUHURTA = {"en": "Brahma Muhurta", "hi": "ब्रह्म मुहूर्त"}, {"en": "Muhurta", "hi": "मुहूर्त"}
#: The moon's longitude terms: degrees, and multiples of D, M, M' and F.
MOON = (
    (6.288774, 0, 0, 1, 0), (1.274027, 2, 0, -1, 0), (0.658314, 2, 0, 0, 0), (0.213618, 0, 0, 2, 0), (-0.185116, 0, 1, 0, 0),
    (-0.114332, 0, 0, 0, 2), (0.058793, 2, 0, -2, 0), (0.057066, 2, -1, -1, 0), (0.053322, 2, 0, 1, 0), (0.045758, 2, -1, 0, 0),
    (-0.040923, 0, 1, -1, 0), (-0.034720, 1, 0, 0, 0), (-0.030383, 0, 1, 1, 0), (0.015327, 2, 0, 0, -2), (-0.012528, 0, 0, 1, 2),
    (0.010980, 0, 0, 1, -2), (0.010675, 4, 0, -1, 0), (0.010034, 0, 0, 3, 0), (0.008548, 4, 0, -2, 0),
)


def _turn(x: Column) -> Column:
    return F.pmod(x, F.lit(360.0))


def _century(jd: Column) -> Column:
    return (jd - 2451545.0) / 36525


def julian_day(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp")) / 8.64e10 + 2440587.5


def sun_longitude(jd: Column) -> Column:
    t = _century(jd)
    mean = _turn(280.46646 + 36000.76983 * t + 0.0003032 * t * t)
    m = F.radians(_turn(357.52911 + 35999.05029 * t - 0.0001537 * t * t))
    c = (1.914602 - 0.004817 * t - 0.000014 * t * t) * F.sin(m) + (0.019993 - 0.000101 * t) * F.sin(2 * m) + 0.000289 * F.sin(3 * m)
    return _turn(mean + c)


def moon_longitude(jd: Column) -> Column:
    t = _century(jd)
    angle = lambda a, b, c: F.radians(_turn(a + b * t + c * t * t))
    d, m = angle(297.8501921, 445267.1114034, -0.0018819), angle(357.5291092, 35999.0502909, -0.0001536)
    mp, f = angle(134.9633964, 477198.8675055, 0.0089970), angle(93.2720950, 483202.0175233, -0.0036539)
    lon = _turn(218.3164477 + 481267.88123421 * t - 0.0015786 * t * t)
    for degrees, *times in MOON:
        terms = [k * x for k, x in zip(times, (d, m, mp, f), strict=True) if k]
        lon = lon + degrees * F.sin(sum(terms[1:], terms[0]))
    return _turn(lon)


def ayanamsa(jd: Column) -> Column:
    return 23.85 + 0.013971 * (_century(jd) * 100)


def sunrise_sunset(ts: Column, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Julian days of sunrise and sunset on the timestamp's day; null where the sun doesn't cross the horizon."""
    day = F.floor(julian_day(ts)) + 0.5 - 2451545.0 + 0.0008 - lon / 360
    m = F.radians(_turn(357.5291 + 0.98560028 * day))
    c = 1.9148 * F.sin(m) + 0.0200 * F.sin(2 * m) + 0.0003 * F.sin(3 * m)
    la = F.radians(_turn(F.degrees(m) + 102.9372 + c + 180))
    transit = 2451545.0 + day + 0.0053 * F.sin(m) - 0.0069 * F.sin(2 * la)
    delta = F.asin(F.sin(la) * F.sin(F.radians(F.lit(23.4397))))
    cos_h = (F.sin(F.radians(F.lit(-0.83))) - F.sin(F.radians(lat)) * F.sin(delta)) / (F.cos(F.radians(lat)) * F.cos(delta))
    half = F.when(F.abs(cos_h) <= 1, F.degrees(F.acos(cos_h)) / 360)
    return transit - half, transit + half


def add_almanac(df: DataFrame, ts: str, lat: Column | float = 23.1765, lon: Column | float = 75.7885) -> DataFrame:
    """`df` with tithi, paksha, nakshatra, pada, yoga, karana, ritu, weekday, muhurta, lunar_month and samvat_year."""
    lat, lon = (x if isinstance(x, Column) else F.lit(float(x)) for x in (lat, lon))
    out = df.withColumn("_jd", julian_day(F.col(ts))).withColumn("_sun", sun_longitude(F.col("_jd"))).withColumn("_moon", moon_longitude(F.col("_jd")))
    out = out.withColumn("_ss", _turn(F.col("_sun") - ayanamsa(F.col("_jd")))).withColumn("_ms", _turn(F.col("_moon") - ayanamsa(F.col("_jd"))))
    angle, span = _turn(F.col("_moon") - F.col("_sun")), 360 / 27
    tithi = F.floor(angle / 12).cast("int")
    k = F.floor(angle / 6).cast("int") % 60
    rise, _ = sunrise_sunset(F.col(ts), lat, lon)
    since = (F.col("_jd") - rise) * 1440
    names = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int"))
    out = out.withColumn("tithi", tithi)
    new_moon = F.col("_jd") - F.when(F.col("tithi") >= 15, F.col("tithi") - 15).otherwise(F.col("tithi") + 15) * (29.530588 / 30)
    return out.withColumns({
        "paksha": F.when(F.col("tithi") < 15, "shukla").otherwise("krishna"),
        "nakshatra": F.floor(F.col("_ms") / span).cast("int"), "pada": (F.floor(F.pmod(F.col("_ms"), F.lit(span)) / (span / 4)) + 1).cast("int"),
        "yoga": F.floor(_turn(F.col("_ss") + F.col("_ms")) / span).cast("int"),
        "karana": F.when(k == 0, "kimstughna").when(k >= 57, names(LAST_KARANA, F.greatest(k - 56, F.lit(1)))).otherwise(names(KARANA, F.pmod(k - 1, F.lit(7)) + 1)),
        "ritu": F.floor(F.col("_ss") / 60).cast("int"), "weekday": F.dayofweek(ts) - 1,
        "muhurta": F.floor(F.pmod(since, F.lit(1440.0)) / 48).cast("int") % 30,
        "lunar_month": names(MONTHS, F.floor(_turn(sun_longitude(new_moon) - ayanamsa(new_moon)) / 30) + 1),
        "samvat_year": F.year(ts) + F.when(F.month(ts) >= 4, 57).otherwise(56),
    }).drop("_jd", "_sun", "_moon", "_ss", "_ms")


def almanac_names(df: DataFrame, lang: Column | str = "en") -> DataFrame:
    """`df` (tithi, paksha and muhurta, as add_almanac has them) with `tithi_name` and `muhurta_name`.

    lang: a language or a column of them; English where it is `en`, else Hindi. The 15th lunar day is the full moon in the
    bright half and the new moon in the dark one; the 29th muhurta has a name, the others a number, a missing one a dash.
    """
    english = (F.lit(lang) if isinstance(lang, str) else lang) == "en"
    pick = lambda names: F.when(english, F.lit(names["en"])).otherwise(F.lit(names["hi"]))
    listed = lambda names: F.array(*[F.lit(x) for x in names])
    day = F.pmod(F.col("tithi"), F.lit(15)) + 1
    name = F.get(F.when(english, listed(TITHI["en"])).otherwise(listed(TITHI["hi"])), F.least(day, F.lit(14)) - 1)
    last = F.when(F.col("paksha") == "shukla", pick(FULL_MOON)).otherwise(pick(NEW_MOON))
    hour = F.when(F.col("muhurta") == 28, pick(BRAHMA)).otherwise(F.concat(pick(MUHURTA), F.lit(" "), (F.col("muhurta") + 1).cast("string")))
    return df.withColumn("tithi_name", F.when(day == 15, last).otherwise(name)).withColumn("muhurta_name", F.coalesce(hour, F.lit("—")))
