"""Column functions for positions on the sphere and the local plane."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelens import settings as S

_LOCAL_LAT = 18.9
KM_X = S.KM_PER_DEG * math.cos(math.radians(_LOCAL_LAT))
KM_Y = S.KM_PER_DEG


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cosines: tuple[Column, Column] | None = None) -> Column:
    """GEO-02: great-circle distance; the root's argument is clipped to [0, 1]. ``cosines``: of both latitudes, where they are at hand."""
    cos1, cos2 = cosines or (F.cos(F.radians(lat1)), F.cos(F.radians(lat2)))
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
    side = cos1 * cos2 * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * S.EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), half + side))))


_NARROW = 0.02  # radians up to which a few terms of a series give all digits of a sine and its inverse


def close_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column, cosines: tuple[Column, Column]) -> Column:
    """``haversine_km`` by arithmetic where the points are close, which is several times quicker; the same for any two points."""
    def squared_sine(degrees: Column) -> Column:
        x = degrees * (math.pi / 360.0)
        q = x * x
        series = x * (F.lit(1.0) - q * (F.lit(1 / 6) - q * (F.lit(1 / 120) - q * (1 / 5040))))
        sine = F.when(q < _NARROW ** 2, series).otherwise(F.sin(x))
        return sine * sine

    h = F.greatest(F.lit(0.0), squared_sine(lat2 - lat1) + cosines[0] * cosines[1] * squared_sine(lon2 - lon1))
    series = F.sqrt(h) * (F.lit(1.0) + h * (F.lit(1 / 6) + h * (F.lit(3 / 40) + h * (F.lit(15 / 336) + h * (105 / 3456)))))
    return F.lit(2 * S.EARTH_KM) * F.when(h < _NARROW ** 2, series).otherwise(F.asin(F.sqrt(F.least(F.lit(1.0), h))))


def rounded(value: Column, digits: int) -> Column:
    """``round`` of a double, half up, by arithmetic: only values near a tie, or too large, take the decimal way."""
    scaled = value * float(10 ** digits)
    whole = F.floor(scaled + 0.5)
    sure = (F.abs(scaled - whole) < 0.5 - 1e-5) & (F.abs(scaled) < 1e9)
    return F.when(sure, whole / float(10 ** digits)).otherwise(F.round(value, digits))


def planar_km(lat: Column, lon: Column) -> tuple[Column, Column]:
    """GEO-03: (x, y) in km on the local plane."""
    return lon * F.lit(KM_X), lat * F.lit(KM_Y)


def planar_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the local plane in km."""
    return F.sqrt(F.pow((lon1 - lon2) * KM_X, 2) + F.pow((lat1 - lat2) * KM_Y, 2))


def cell_km2(lat: Column, dlat: Column | float, dlon: Column | float) -> Column:
    """Area of a grid cell at a latitude."""
    as_col = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return as_col(dlat) * S.KM_PER_DEG * as_col(dlon) * S.KM_PER_DEG * F.cos(F.radians(lat))


def box_ring(lat: Column, lon: Column, half: float = 0.35) -> Column:
    """GEO-04: closed ring of a square around a centre, as [lon, lat] pairs."""
    corner = lambda sx, sy: F.array(lon + F.lit(sx * half), lat + F.lit(sy * half))
    return F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1), corner(-1, -1))


def box_wkt(lat: Column, lon: Column, half: float = 0.35, digits: int = 4) -> Column:
    """GEO-04: the same square as polygon text."""
    fmt = lambda value: F.format_string(f"%.{digits}f", value)
    pairs = [F.concat_ws(" ", fmt(lon + F.lit(sx * half)), fmt(lat + F.lit(sy * half)))
             for sx, sy in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]
    return F.concat(F.lit("POLYGON(("), F.concat_ws(", ", *pairs), F.lit("))"))


def point_wkt(lat: Column, lon: Column, srid: bool = True) -> Column:
    """Point text with the longitude first."""
    body = F.concat(F.lit("POINT("), lon.cast("string"), F.lit(" "), lat.cast("string"), F.lit(")"))
    return F.concat(F.lit("SRID=4326;"), body) if srid else body


def mercator_y(lat: Column) -> Column:
    """Spherical web-mercator y (radians)."""
    return F.log(F.tan(F.radians(lat) / 2 + F.lit(math.pi / 4)))


def mercator_lat(y: Column) -> Column:
    """Latitude of a web-mercator y."""
    return F.degrees(F.lit(2.0) * F.atan(F.exp(y)) - F.lit(math.pi / 2))


_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?)"
_POINT_TEXT = rf"(?i)^(?:SRID=[0-9]+;)?\s*POINT\s*\(\s*{_NUMBER}\s+{_NUMBER}\s*\)$"
_POINT_JSON = "struct<type:string,coordinates:array<double>>"


_POINT = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])


@F.pandas_udf(_POINT)
def _hex_point(text: pd.Series) -> pd.DataFrame:
    """Little or big endian (E)WKB point in hex; anything else gives nulls."""
    import struct

    rows = []
    for value in text:
        found = (None, None)
        try:
            raw = bytes.fromhex(value)
            order = "<" if raw[0] == 1 else ">"
            kind = struct.unpack(order + "I", raw[1:5])[0]
            start = 9 if kind & 0x20000000 else 5
            if kind & 0xFF == 1:
                lon, lat = struct.unpack(order + "dd", raw[start:start + 16])
                found = (lat, lon)
        except (ValueError, TypeError, IndexError, struct.error):
            pass
        rows.append(found)
    return pd.DataFrame(rows, columns=["lat", "lon"])


def parse_point(value: Column, with_hex: bool = False) -> Column:
    """GEO-01: struct<lat, lon> from GeoJSON text, point text or (optionally) hex WKB.

    The text forms stay in the JVM. The binary form needs a double decoder, so it is an Arrow UDF
    that callers switch on only for columns that hold hex.
    """
    text = F.trim(value)
    js = F.from_json(text, _POINT_JSON)
    ok_json = (js["type"] == "Point") & (F.size(js["coordinates"]) >= 2)
    is_text = text.rlike(_POINT_TEXT)
    pair = lambda lat, lon: F.struct(lat.cast("double").alias("lat"), lon.cast("double").alias("lon"))
    out = (F.when(ok_json, pair(F.get(js["coordinates"], F.lit(1)), F.get(js["coordinates"], F.lit(0))))
           .when(is_text, pair(F.regexp_extract(text, _POINT_TEXT, 2), F.regexp_extract(text, _POINT_TEXT, 1))))
    if with_hex:
        hexed = _hex_point(F.when(text.rlike("^[0-9A-Fa-f]{42,}$"), text))
        out = F.coalesce(out, F.when(hexed["lat"].isNotNull(), hexed))
    return out

