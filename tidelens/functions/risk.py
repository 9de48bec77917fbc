"""Column functions for risk levels, seasonal index, drift vectors and exposure."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions.geo import haversine_km


def level_to_int(level: Column) -> Column:
    """PRJ-12: 0..3, unknown names are 0."""
    out = F.lit(0)
    for i, name in enumerate(S.LEVELS):
        out = F.when(level == name, F.lit(i)).otherwise(out)
    return out


def int_to_level(number: Column) -> Column:
    """PRJ-12: the other way round; null outside 0..3."""
    return F.get(F.array(*[F.lit(x) for x in S.LEVELS]), number.cast("int"))


def _col(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def zone_level(area: Column, eta: Column, minimum=S.ZONE_BANDS.minimum, low_max=S.ZONE_BANDS.low_max,
               medium_max=S.ZONE_BANDS.medium_max, high_eta=S.ZONE_BANDS.high_eta_hours) -> Column:
    """SCL-01: level from the arrived area and the hour a significant amount arrives.

    Bars may be numbers or columns, so one plan can score many settings.
    """
    minimum, low_max, medium_max = _col(minimum), _col(low_max), _col(medium_max)
    soon = (area >= low_max) & F.coalesce(eta <= _col(high_eta), F.lit(False))
    return (F.when(area < minimum, "none").when(soon, "high").when(area >= medium_max, "high")
            .when(area >= low_max, "medium").otherwise("low"))


def nearby_level(weighted: Column, significant_km: Column, bands: S.NearbyBands = S.NEARBY) -> Column:
    """SCL-02: level from proximity-weighted area and the distance it becomes significant."""
    close = (weighted >= bands.low_max) & F.coalesce(significant_km <= bands.imminent_km, F.lit(False))
    return (F.when(weighted < bands.minimum, "none").when(close, "high")
            .when(weighted >= bands.medium_max, "high").when(weighted >= bands.low_max, "medium")
            .otherwise("low"))


def region_of(lat: Column, lon: Column) -> Column:
    """SCL-04: coast region of a coordinate, first matching rule."""
    return (F.when(lon > -69.0, S.EAST).when(lat > 19.5, S.NORTH)
            .when((lon > -69.5) & (lon < -69.0) & (lat > 18.9), S.SAMANA)
            .when(lon < -70.5, S.SOUTHWEST).otherwise(S.SOUTH))


def _lookup(key: Column, table: dict, default) -> Column:
    return reduce(lambda acc, kv: F.when(key == F.lit(kv[0]), F.lit(kv[1])).otherwise(acc),
                  table.items(), F.lit(default))


def seasonal_index(month: Column, region: Column | None = None) -> Column:
    """SCL-03: expected abundance 0..1 for a month, scaled by the coast's exposure."""
    base = _lookup(month, S.MONTH_INDEX, 0.0)
    return base if region is None else base * _lookup(region, S.REGION_EXPOSURE, S.DEFAULT_EXPOSURE)


def index_level(index: Column) -> Column:
    """SCL-03: level of an abundance index; bands are strict upper bounds."""
    out = F.lit("high")
    for bar, name in reversed(S.SEASON_BANDS):
        out = F.when(index < bar, F.lit(name)).otherwise(out)
    return out


def seasonal_level(month: Column, region: Column) -> Column:
    return index_level(seasonal_index(month, region))


def region_bearing(region: Column) -> Column:
    """Seaward bearing of a coast region."""
    return _lookup(region, S.REGION_BEARING, S.DEFAULT_BEARING)


def wind_uv(speed: Column, from_deg: Column) -> tuple[Column, Column]:
    """SCL-12: from-direction and speed to (u, v) toward."""
    return -speed * F.sin(F.radians(from_deg)), -speed * F.cos(F.radians(from_deg))


def regional_current(lat: Column, lon: Column) -> Column:
    """SCL-13: mean surface current by coordinate, as struct<u, v>; first matching rule."""
    uv = lambda u, v: F.struct(F.lit(u).alias("u"), F.lit(v).alias("v"))
    return (F.when(lon > -69.5, uv(-0.22, -0.01))
            .when(lat.between(18.9, 19.5) & lon.between(-69.7, -68.8), uv(-0.18, 0.01))
            .when((lat > 19.4) & (lon < -70.0), uv(-0.12, -0.03))
            .when((lon < -70.5) & (lat < 19.0), uv(-0.08, 0.01))
            .otherwise(uv(-0.13, 0.03)))


def effective_drift(lat: Column, lon: Column, wind_u: Column, wind_v: Column,
                    factor: float = S.QUICK_WIND_FACTOR) -> Column:
    """SCL-13: current plus a share of the wind, as struct<u, v>."""
    c = regional_current(lat, lon)
    return F.struct((c["u"] + wind_u * factor).alias("u"), (c["v"] + wind_v * factor).alias("v"))


def shore_exposure(bearing: Column, u: Column, v: Column, minimum: float = 0.02) -> Column:
    """SCL-11: cosine between where the drift comes from and where the shore faces."""
    toward = F.degrees(F.atan2(u, v))
    comes_from = F.pmod(toward + 540.0, F.lit(360.0))
    return F.when(F.hypot(u, v) >= minimum, F.cos(F.radians(comes_from - bearing)))


def adjust_for_exposure(level: Column, exposure: Column) -> Column:
    """PRJ-22: one level lower when the drift heads away; never below low, never raised."""
    n = level_to_int(level)
    lowered = F.coalesce(exposure < -0.2, F.lit(False)) & level.isin(*S.LEVELS) & (n >= 1)
    return F.when(lowered, int_to_level(F.greatest(n - 1, F.lit(1)))).otherwise(level)


def approach(beach_lat: Column, beach_lon: Column, lat: Column, lon: Column, drift: Column,
             arrival_km: float = 12.0, dist: Column | None = None) -> Column:
    """SCL-14: struct<speed, hours>: drift speed toward a target (m/s) and analytic hours to arrive.

    Hours are null when the speed is 0.005 m/s or less. ``dist``: the distance, where it is at hand.
    """
    dist = haversine_km(beach_lat, beach_lon, lat, lon) if dist is None else dist
    dy = (beach_lat - lat) * S.KM_PER_DEG
    dx = (beach_lon - lon) * S.KM_PER_DEG * F.cos(F.radians(lat))
    speed = F.try_divide(drift["v"] * dy + drift["u"] * dx, dist)
    hours = F.when(speed > 0.005, F.ceil((dist - arrival_km) / (speed * 3.6)))
    return F.struct(speed.alias("speed"), hours.alias("hours"))


_M_PER_DEG = 111320.0


def advect(lat: Column, lon: Column, hours: int, wind_u: Column, wind_v: Column, step: int = 24) -> Column:
    """RAM-02: struct<lat, lon> after some hours, in fixed steps with the current re-read at each.

    One step uses the starting latitude for the longitude scale, several steps the updated one.
    The steps are folded with a higher-order function: no shuffle and no row growth.
    """
    single = hours <= step

    def move(pos, h):
        drift = effective_drift(pos["lat"], pos["lon"], wind_u, wind_v)
        secs = h.cast("double") * 3600.0
        new_lat = pos["lat"] + drift["v"] * secs / _M_PER_DEG
        scale_lat = pos["lat"] if single else new_lat
        new_lon = pos["lon"] + drift["u"] * secs / (F.cos(F.radians(scale_lat)) * _M_PER_DEG)
        return F.struct(new_lat.alias("lat"), new_lon.alias("lon"))

    start = F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    if hours <= 0:
        return start
    steps = [step] * (hours // step) + ([hours % step] if hours % step else [])
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), start, move)


def risk_area(preferred: Column, outline: Column) -> Column:
    """PRJ-09: configured area, else the outline, else 0; NaN counts as missing."""
    clean = lambda c: F.nanvl(c.try_cast("double"), F.lit(None).cast("double"))
    return F.coalesce(clean(preferred), clean(outline), F.lit(0.0))


def observed_or_now(text: Column, now: Column) -> Column:
    """PRJ-10: observation time, never later than now; unreadable or null becomes now."""
    from tidelens.functions.dates import parse_ts

    return F.least(F.coalesce(parse_ts(text), now), now)


def ensure_map(none: Column, low: Column, medium: Column, high: Column) -> Column:
    """ARR-02: probability map with the four fixed keys."""
    return F.create_map(F.lit("none"), none, F.lit("low"), low, F.lit("medium"), medium, F.lit("high"), high)


def arrival_probability(probs: Column) -> Column:
    """ARR-02: 1 - P(none)."""
    return F.lit(1.0) - probs["none"]
