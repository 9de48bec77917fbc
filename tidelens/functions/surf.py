"""Column functions that rate surf and wind at a spot. A profile and a condition are structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelens import settings as S


def _clamp(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def angle_between(a: Column, b: Column) -> Column:
    """SCL-05: smallest angle between two bearings, 0..180."""
    d = F.pmod(a.cast("double") - b.cast("double"), F.lit(360.0))
    return F.when(d > 180.0, 360.0 - d).otherwise(d)


def compass_point(deg: Column) -> Column:
    """SCL-05: 16-point compass name of a bearing."""
    slot = F.floor(F.pmod(deg.cast("double"), F.lit(360.0)) / 22.5 + 0.5) % 16
    return F.get(F.array(*[F.lit(p) for p in S.COMPASS]), slot.cast("int"))


def wind_relation(wind_from: Column, bearing: Column) -> Column:
    """SCL-05: onshore / cross / offshore class."""
    rel = angle_between(wind_from, bearing)
    return (F.when(rel >= 135, "offshore").when(rel >= 90, "cross-offshore")
            .when(rel >= 45, "cross-onshore").otherwise("onshore"))


def size_score(swell: Column, p: Column) -> Column:
    """SCL-06: swell height against the rideable window; 0 without a height."""
    mn, lo, hi, mx = p["min_rideable_m"], p["ideal_lo_m"], p["ideal_hi_m"], p["max_manageable_m"]
    return (F.when(swell.isNull() | (swell <= mn), 0.0)
            .when(swell < lo, _clamp(F.try_divide(swell - mn, lo - mn)))
            .when(swell <= hi, 1.0)
            .when(swell >= mx, 0.0)
            .otherwise(_clamp(1.0 - F.try_divide(swell - hi, mx - hi))))


def size_too_big(swell: Column, p: Column) -> Column:
    """SCL-06: above the manageable limit (and above the ideal range)."""
    return F.coalesce((swell > p["min_rideable_m"]) & (swell > p["ideal_hi_m"])
                      & (swell >= p["max_manageable_m"]), F.lit(False))


def period_score(period: Column) -> Column:
    """SCL-07: piecewise linear through the fixed knots; 0.6 when missing."""
    knots = S.PERIOD_KNOTS
    out = F.when(period.isNull(), 0.6).when(period <= knots[0][0], knots[0][1])
    for (p0, s0), (p1, s1) in zip(knots, knots[1:]):
        out = out.when(period <= p1, F.lit(s0) + (period - p0) * F.lit((s1 - s0) / (p1 - p0)))
    return out.otherwise(knots[-1][1])


def swell_direction_score(from_deg: Column, p: Column) -> Column:
    """SCL-08: cosine taper inside the window, fading over 30 degrees outside."""
    off = angle_between(from_deg, p["shore_normal_deg"])
    half = p["swell_window_deg"] / 2.0
    return (F.when(half <= 0, 0.0)
            .when(off >= half, F.lit(0.35) * _clamp(1.0 - (off - half) / 30.0))
            .otherwise(F.lit(0.35) + F.lit(0.65) * F.cos(F.radians(F.lit(90.0) * off / half))))


def wind_score_surf(speed: Column, from_deg: Column, p: Column) -> Column:
    """SCL-09: wind for surfing; light wind is fine from anywhere, strong offshore is penalised."""
    v = F.greatest(F.lit(0.0), speed)
    rel = wind_relation(from_deg, p["shore_normal_deg"])
    quality = (F.when(rel == "offshore", 1.0).when(rel == "cross-offshore", 0.85)
               .when(rel == "cross-onshore", 0.55).otherwise(0.30))
    weight = _clamp((v - S.GLASSY_KT) / (S.WIND_FULL_KT - S.GLASSY_KT))
    blend = (1.0 - weight) + quality * weight
    held = F.when((rel == "offshore") & (v > 22.0), F.greatest(F.lit(0.45), 1.0 - (v - 22.0) / 30.0)).otherwise(1.0)
    return _clamp(blend * held)


def wind_strength_score(speed: Column, p: Column) -> Column:
    """SCL-09: wind strength for wind sports."""
    v = F.greatest(F.lit(0.0), speed)
    lo, hi = F.coalesce(p["wind_lo_kt"], F.lit(14.0)), F.coalesce(p["wind_hi_kt"], F.lit(25.0))
    floor = lo * 0.6
    return (F.when(v <= floor, 0.0).when(v < lo, _clamp((v - floor) / (lo - floor)))
            .when(v <= hi, 1.0).otherwise(F.greatest(F.lit(0.15), 1.0 - (v - hi) * 0.65 / 10.0)))


def wind_direction_score(from_deg: Column, p: Column) -> Column:
    """SCL-09: wind direction for wind sports; side-shore is best, straight offshore worst."""
    rel = angle_between(from_deg, p["shore_normal_deg"])
    return (F.when(rel < 30, 0.70).when(rel < 60, 0.90).when(rel <= 120, 1.00)
            .when(rel <= 150, 0.90).otherwise(0.35))


def rating_of(score: Column) -> Column:
    """SCL-10: band of a 0..10 score; strict upper bounds."""
    out = F.lit("epic")
    for bar, name in reversed(S.RATING_BANDS):
        out = F.when(score < bar, F.lit(name)).otherwise(out)
    return out


def face_feet(swell: Column, p: Column, spread: float) -> Column:
    """SCL-10: displayed breaking face in feet at a spread (0.85 or 1.15)."""
    base = F.greatest(F.lit(0.0), swell) * F.coalesce(p["face_factor"], F.lit(1.1)) * 3.28084
    return F.coalesce(F.round(base * spread, 1), F.lit(0.0))


def surf_reason(size: Column, big: Column, direction: Column, period: Column, wind: Column, relation: Column,
                speed: Column) -> Column:
    """SCL-10: the most decisive factor of a surf rating."""
    windy = (F.when(relation == "onshore", "onshore_wind").when(relation == "offshore", "strong_offshore")
             .otherwise("cross_wind"))
    return (F.when(big, "too_big").when(size <= 0, "too_small").when(direction < 0.35, "off_axis")
            .when((wind <= period) & (wind < 0.7), windy).when(period < 0.7, "short_period")
            .when(speed < S.GLASSY_KT, "glassy").when((period >= 0.9) & (wind >= 0.85), "clean").otherwise("ok"))


def wind_reason(strength: Column, direction: Column, speed: Column, p: Column, over: Column) -> Column:
    """SCL-10: the most decisive factor of a wind-sport rating."""
    lo, hi = F.coalesce(p["wind_lo_kt"], F.lit(14.0)), F.coalesce(p["wind_hi_kt"], F.lit(25.0))
    return (F.when(strength <= 0, "no_wind").when(direction <= 0.4, "offshore_unsafe").when(speed > hi, "too_windy")
            .when(speed < lo, "no_wind").when(over, "too_big")
            .when((direction >= 1.0) & (strength >= 0.9), "side_shore").otherwise("ok"))


def is_sheltered(text: Column) -> Column:
    """PRJ-25: sheltered by the words of the water text; exposed words win."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda words: low.rlike("|".join(words))
    return ~has(S.EXPOSED_WORDS) & has(S.SHELTERED_WORDS)


def derived_profile(region: Column, activities: Column, water: Column) -> Column:
    """PRJ-25: profile of a beach with no curated spot."""
    from tidelens.functions.risk import region_bearing

    acts = F.coalesce(activities, F.array().cast("array<string>"))
    wind = (F.arrays_overlap(acts, F.array(*[F.lit(a) for a in S.WIND_ACTIVITIES]))
            & ~F.array_contains(acts, "Surfing"))
    calm = is_sheltered(water)
    pick = lambda a, b: F.when(calm, F.lit(a)).otherwise(F.lit(b))
    return F.struct(
        F.when(wind, "wind").otherwise("surf").alias("sport"),
        region_bearing(region).cast("double").alias("shore_normal_deg"),
        pick(90.0, 130.0).alias("swell_window_deg"),
        F.when(wind, 0.0).otherwise(pick(0.9, 0.6)).alias("min_rideable_m"),
        pick(1.2, 0.9).alias("ideal_lo_m"), pick(2.0, 1.9).alias("ideal_hi_m"),
        pick(2.8, 3.0).alias("max_manageable_m"), pick(0.85, 1.10).alias("face_factor"),
        F.when(wind, 13.0).alias("wind_lo_kt"), F.when(wind, 23.0).alias("wind_hi_kt"))
