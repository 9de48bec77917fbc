"""Distance, nearest, radius and polygon joins as bucketed equi-joins.

Point tables meet through grid cells; nothing depends on a table being short.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions.geo import KM_X, KM_Y, close_km, haversine_km, planar_distance
from tidelens.session import durable_checkpoint

_KM_PER_LAT = math.pi * S.EARTH_KM / 180.0


def carry(df: DataFrame, small: DataFrame, columns: Sequence[str], out: str = "_ref") -> DataFrame:
    """Attach a short list as one array column (a constant, evaluated once).

    For results that are a full grid of rows and list entries (every run and every target, every
    setting), whose size is that product anyway. Searches and joins go through buckets instead.
    """
    arr = small.select(F.struct(*columns).alias("_s")).agg(F.sort_array(F.collect_list("_s")).alias("a")).scalar()
    return df.withColumn(out, arr)


def _lon_reach(lat: Column, km: float) -> Column:
    """Degrees of longitude that ``km`` can span from a latitude; 180 where the circle holds a pole."""
    r = km / S.EARTH_KM
    if r >= math.pi / 2:
        return F.lit(180.0)
    inside = F.sin(F.lit(r)) / F.cos(F.radians(lat))
    return F.when(F.abs(lat) + math.degrees(r) >= 90.0, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), inside))) + 1e-9)


def _bands(km: float) -> float:
    return min(180.0, km / _KM_PER_LAT * (1 + 1e-9))


def _columns_of(band: Column, step: float, km: float) -> Column:
    """How many equal longitude cells a latitude band has: each at least as wide as ``km`` at the band's highest latitude."""
    top = F.greatest(F.abs(band * step), F.abs((band + 1) * step))
    return F.greatest(F.lit(1), F.floor(360.0 / _lon_reach(F.least(top, F.lit(90.0)), km))).cast("long")


def _lon_reach_in_band(lat: Column, band: Column, step: float, km: float) -> Column:
    """Degrees of longitude that a circle of ``km`` around ``lat`` can span inside one latitude band.

    hav(d) = hav(lat apart) + cos * cos * hav(lon apart), with the least of the first term and of the cosines in the band.
    """
    r = min(km / S.EARTH_KM, math.pi)
    low, high = band * step, (band + 1) * step
    off = F.greatest(F.lit(0.0), low - lat, lat - high)
    top = F.least(F.greatest(F.abs(low), F.abs(high)), F.lit(90.0))
    left = F.greatest(F.lit(0.0), F.lit(math.sin(r / 2) ** 2 * (1 + 1e-9)) - F.pow(F.sin(F.radians(off) / 2), 2))
    least = F.least(F.lit(1.0), left / (F.cos(F.radians(lat)) * F.cos(F.radians(top))))
    return F.degrees(2 * F.asin(F.sqrt(least))) + 1e-9


def _unit(lat: Column, lon: Column) -> list[Column]:
    """The point on the unit sphere."""
    la, lo = F.radians(lat), F.radians(lon)
    return [F.cos(la) * F.cos(lo), F.cos(la) * F.sin(lo), F.sin(la)]


_WIDE = 2.0  # degrees within which a sine is its angle but for one part in 5,000, squared


def radius_join(points: DataFrame, places: DataFrame, km: float, point_pos: tuple[str, str] = ("lat", "lon"),
                place_pos: tuple[str, str] = ("p_lat", "p_lon"), on: Sequence[str] = (), dist: str = "dist",
                planar: bool = False, fine: int = 1, measure: Callable = haversine_km) -> DataFrame:
    """JON-04: pairs within ``km``; columns of both sides plus the distance.

    Points fall into latitude bands a radius high, cut into longitude cells a radius wide at the
    band's own highest latitude; cells close around 180 degrees and a band at a pole is one cell.
    A place is repeated into the cells its circle can touch (nine at most, but near a pole), so
    every pair meets exactly once. Skewed cells are left to AQE, which splits their partitions.
    The places are the side that is repeated, and never broadcast: pass the smaller one there. On
    the local plane (``planar``) cells are squares. On the sphere the differences in degrees and one
    cosine a row, a few products, decide but for pairs at the very edge or degrees apart, so that the
    distance is taken of pairs returned only. With ``fine`` cells are so many times smaller and places are repeated into more
    (25 or so for 2, 45 for 3): for dense tables, where fewer pairs meet in vain.
    """
    lat, lon, plat, plon = (F.col(c) for c in (*point_pos, *place_pos))
    left = points.where(lat.isNotNull() & lon.isNotNull())
    right = places.where(plat.isNotNull() & plon.isNotNull())
    if planar:
        sy, sx = km / KM_Y, km / KM_X
        near = lambda c: F.sequence(c - 1, c + 1)
        left = left.withColumn("_cy", F.floor(lat / sy)).withColumn("_cx", F.floor(lon / sx))
        right = right.withColumn("_cy", F.explode(near(F.floor(plat / sy)))).withColumn("_cx", F.explode(near(F.floor(plon / sx))))
        pairs = left.join(right.hint("merge"), [*on, "_cy", "_cx"]).drop("_cy", "_cx")
        return pairs.withColumn(dist, planar_distance(lat, lon, plat, plon)).where(F.col(dist) <= km)
    step = _bands(km) / fine
    turn = lambda c: F.pmod(c + 180.0, F.lit(360.0))
    n = _columns_of(F.col("_cy"), step, km / fine)
    left = left.withColumn("_cy", F.floor(lat / step)).withColumn("_cx", F.least(n - 1, F.floor(turn(lon) * n / 360.0)))
    band = F.floor(plat / step)
    right = right.withColumn("_cy", F.explode(F.sequence(band - fine, band + fine))).withColumn("_n", n)
    right = right.withColumn("_reach", _lon_reach_in_band(plat, F.col("_cy"), step, km))
    first, last = (F.floor((turn(plon) + sign * F.col("_reach")) * F.col("_n") / 360.0) for sign in (-1, 1))
    right = right.withColumn("_first", first).withColumn("_last", F.least(last, F.col("_first") + F.col("_n") - 1))
    right = right.withColumn("_cx", F.explode(F.sequence("_first", "_last"))).withColumn("_cx", F.pmod("_cx", "_n")).drop("_n", "_reach", "_first", "_last")
    left, right = left.withColumn("_cos_a", F.cos(F.radians(lat))), right.withColumn("_cos_b", F.cos(F.radians(plat)))
    dlat, dlon, cosines = plat - lat, plon - lon, (F.col("_cos_a"), F.col("_cos_b"))
    scale = cosines[0] * cosines[1]  # below zero only where a latitude lies beyond a pole
    flat = dlat * dlat + F.abs(scale) * dlon * dlon  # the haversine with angles for sines, in degrees: never less than it
    most = (math.sin(min(km / S.EARTH_KM, math.pi) / 2) * 360.0 / math.pi) ** 2
    inside = flat <= most * (1 - 1e-9)
    unsure = (flat <= most * (1 + 2e-4)) | (F.abs(dlon) > _WIDE) | (F.abs(dlat) > _WIDE) | (scale < 0)
    edge = unsure & (haversine_km(lat, lon, plat, plon, cosines) <= km)
    pairs = left.join(right.hint("merge"), [*on, "_cy", "_cx"]).where(inside | edge)
    return pairs.withColumn(dist, measure(lat, lon, plat, plon, cosines)).drop("_cos_a", "_cos_b", "_cy", "_cx")


def within(points: DataFrame, others: DataFrame, km: float, key: str, on: Sequence[str] = ()) -> DataFrame:
    """JON-13: distinct ``key`` of the points that have any other point within ``km``.

    Both sides are (on.., lat, lon). Points that share a fine square whose diagonal is under the
    radius match by square alone, with no pairs at all; only the rest is measured, against each
    other side's distinct positions.
    """
    step = km / 1.5 / _KM_PER_LAT  # a degree of longitude is nowhere longer than one of latitude
    fy, fx = F.floor(F.col("lat") / step), F.floor(F.col("lon") / step)
    left = points.withColumn("_fy", fy).withColumn("_fx", fx)
    filled = others.withColumn("_fy", fy).withColumn("_fx", fx).select(*on, "_fy", "_fx").distinct()
    same = left.join(filled, [*on, "_fy", "_fx"], "left_semi").select(*on, key)
    rest = left.join(filled, [*on, "_fy", "_fx"], "left_anti").drop("_fy", "_fx")
    spots = others.select(*on, F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon")).distinct()
    near = radius_join(rest, spots, km, on=on).select(*on, key)
    return same.unionByName(near).distinct()


_FINEST = 7  # halvings of the radius down to the smallest cubes of ``radius_totals``
_LIGHT = 16  # rows that a cube of the size used holds on average


def radius_totals(points: DataFrame, places: DataFrame, km: float, by: Sequence[str], weight: str, planar: bool = False) -> DataFrame:
    """(p_lat, p_lon, by.., total) per distinct position of ``places`` and key of the points within ``km`` of it: the sum of
    ``weight``.

    Points of one position and key are one row, places of one position are one. On the sphere a circle
    is a ball around a unit vector, so space is cut into cubes, nested by halves; on the plane they are
    squares. A place is handed down the occupied cubes: those wholly inside its ball give their sums, and
    only the points of the smallest cubes, which the ball's edge runs through, are measured. Their size
    follows the density of the points, so the work at the edge does not grow in proportion to it.
    """
    lat, lon, plat, plon = (F.col(c) for c in ("lat", "lon", "p_lat", "p_lon"))
    where = (lambda la, lo: [lo * KM_X, la * KM_Y]) if planar else _unit
    reach = km if planar else 2 * math.sin(min(km / S.EARTH_KM, math.pi) / 2)
    dims = range(2 if planar else 3)
    cube, up = [f"_c{i}" for i in dims], [f"_u{i}" for i in dims]
    seen = lambda df, *at: df.where(" and ".join(f"{c} is not null and not isnan({c})" for c in at))
    held = seen(points, "lat", "lon").select(F.struct(*[F.col(c) for c in by], F.lit(0).alias("_")).alias("_g"), "lat", "lon", F.col(weight).alias("_w"))
    held = held.groupBy("_g", "lat", "lon").agg(F.sum("_w").alias("_w"))
    held = durable_checkpoint(held.select("*", *[F.floor(x / (reach / 2 ** _FINEST)).alias(c) for x, c in zip(where(lat, lon), cube)]))
    halved = lambda n: [F.floor(F.col(c) / 2 ** n).alias(c) for c in cube]
    size = held.select(F.explode(F.array(*[F.struct(F.lit(n).alias("n"), *halved(_FINEST - n)) for n in range(_FINEST + 1)])).alias("q")).distinct()
    filled = {r["n"]: r["count"] for r in size.groupBy("q.n").count().collect()}  # a number per size
    rows = held.count()
    finest = next((n for n in range(2, _FINEST) if rows <= _LIGHT * filled.get(n, 0)), _FINEST)
    spots = seen(places, "p_lat", "p_lon").select("p_lat", "p_lon").distinct()
    spots = spots.select("*", *[x.alias(f"_b{i}") for i, x in enumerate(where(plat, plon))])
    near = spots
    for i in dims:
        at = F.floor(F.col(f"_b{i}") / reach)
        near = near.withColumn(cube[i], F.explode(F.sequence(at - 1, at + 1)))
    parts = []
    for n in range(finest + 1):
        side = reach / 2 ** n
        sums = held.groupBy("_g", *halved(_FINEST - n)).agg(F.sum("_w").alias("_w"))
        own = size.where(F.col("q.n") == n).select("q.*").drop("n")
        if n == 0:
            near = near.join(own.hint("merge"), cube)
        else:
            own = own.select("*", *[F.floor(F.col(c) / 2).alias(u) for c, u in zip(cube, up)])
            near = near.withColumnsRenamed(dict(zip(cube, up))).join(own.hint("merge"), up).drop(*up)
        least, most = F.lit(0.0), F.lit(0.0)
        for i in dims:
            before, after = F.col(f"_b{i}") - F.col(cube[i]) * side, (F.col(cube[i]) + 1) * side - F.col(f"_b{i}")
            low, high = F.greatest(F.lit(0.0), -before, -after), F.greatest(before, after)
            least, most = least + low * low, most + high * high
        near = near.withColumn("_in", most <= reach * reach * (1 - 1e-9) - 1e-15).where(least <= reach * reach * (1 + 1e-9) + 1e-15)
        near = durable_checkpoint(near)
        parts.append(near.where("_in").join(sums.hint("merge"), cube).select("p_lat", "p_lon", "_g", "_w"))
        near = near.where("not _in").drop("_in")
    edge = near.join(held.select("_g", "lat", "lon", "_w", *halved(_FINEST - finest)).hint("merge"), cube)
    if not planar:
        gap = sum(((x - F.col(f"_b{i}")) * (x - F.col(f"_b{i}")) for i, x in enumerate(where(lat, lon))), F.lit(0.0))
        edge = edge.where(gap <= reach * reach * (1 + 1e-9) + 1e-15)
    measure = planar_distance if planar else haversine_km
    parts.append(edge.where(measure(lat, lon, plat, plon) <= km).select("p_lat", "p_lon", "_g", "_w"))
    total = reduce(DataFrame.unionByName, parts).groupBy("p_lat", "p_lon", "_g").agg(F.sum("_w").alias("total"))
    return total.select("p_lat", "p_lon", *[F.col(f"_g.{c}").alias(c) for c in by], "total")


def radius_counts(points: DataFrame, places: DataFrame, place: str, km: float, by: str) -> DataFrame:
    """JON-04 counted: per (by, place) the points within ``km`` and the nearest distance; the pairs are never built."""
    one = points.withColumn("_one", F.lit(1).cast("long")).withColumn("_pid", F.lit(0))
    spot = F.struct("p_lat", "p_lon").alias("_spot")
    n = durable_checkpoint(radius_totals(one, places, km, [by], "_one"))
    best = crossing(one, n.select(by, spot, "p_lat", "p_lon"), "_spot", km, "_one", 1.0, "_pid", on=[by])
    best = best.select(F.col(by).alias("_by"), F.col("_spot.p_lat").alias("_la"), F.col("_spot.p_lon").alias("_lo"), "near_km")
    same = (F.col("p_lat") == F.col("_la")) & (F.col("p_lon") == F.col("_lo")) & F.col(by).eqNullSafe(F.col("_by"))
    both = n.join(best, same).select(by, "p_lat", "p_lon", "total", "near_km")
    return places.join(both, ["p_lat", "p_lon"]).groupBy(by, place).agg(F.sum("total").alias("n"), F.min("near_km").alias("near_km"))


_HALVINGS = 8  # radii tried by ``crossing``: the whole one, a half, a quarter, ...


def _square(lat: Column, lon: Column, km: float) -> list[Column]:
    """Indices of the finest squares of ``crossing``; any two points of one are within the finest radius."""
    step = km / 2 ** _HALVINGS / 1.5 / _KM_PER_LAT  # a degree of longitude is nowhere longer than one of latitude
    return [F.floor(lat / step).alias("_sy"), F.floor(lon / step).alias("_sx")]


def _squares(rows: DataFrame) -> DataFrame:
    """Each row once per halving, with the square of that size (_j, _y, _x) for its finest one."""
    sizes = F.array(*[F.struct(F.lit(j).alias("j"), F.floor(F.col("_sy") / 2 ** (_HALVINGS - j)).alias("y"),
                               F.floor(F.col("_sx") / 2 ** (_HALVINGS - j)).alias("x")) for j in range(1, _HALVINGS + 1)])
    return rows.withColumn("_q", F.explode(sizes)).select("*", F.col("_q.j").alias("_j"), F.col("_q.y").alias("_y"), F.col("_q.x").alias("_x")).drop("_q", "_sy", "_sx")


def crossing(points: DataFrame, targets: DataFrame, place: str, km: float, weight: str, bar: float, point_id: str,
             share: Callable = lambda d: 1.0, on: Sequence[str] = ()) -> DataFrame:
    """WIN-06: per (on.., place) of ``targets`` (on.., place, p_lat, p_lon): the nearest point within ``km`` (``near_km``,
    ``near_id``, the lowest of equals) and the distance ``cross_km`` at which the running weight reaches the bar (or null).

    A point weighs ``weight`` times ``share(distance)``, which never grows with the distance; weights must not be
    negative. The points of the place's own square alone bound the distance searched: the smallest
    square whose weight reaches the bar has its answer within its diagonal, so pairs follow the
    places and not the points in the radius; only places of no such square look through all of it.
    Keys may be null; places without any point are absent.
    """
    on, key = list(on), F.struct(*[F.col(c) for c in on], F.lit(0).alias("_"))
    held = points.where("lat is not null and lon is not null and not isnan(lat) and not isnan(lon)")
    held = held.select(key.alias("_g"), F.col(point_id).alias("_id"), "lat", "lon", F.coalesce(F.col(weight).cast("double"), F.lit(0.0)).alias("_w"))
    held = durable_checkpoint(held.groupBy("_g", "lat", "lon").agg(F.sum("_w").alias("_w"), F.min("_id").alias("_id")))  # a heap of points is one
    goal = targets.where("p_lat is not null and p_lon is not null").select(
        F.struct(*[F.col(c) for c in on], F.lit(0).alias("_")).alias("_g"), F.struct(place).alias("_p"), "p_lat", "p_lon")
    radius = [km / 2 ** j for j in range(_HALVINGS + 1)]
    sure = F.element_at(F.array(*[F.lit(float(share(r))) for r in radius[1:]]), F.col("_j"))
    fine = held.groupBy("_g", *_square(F.col("lat"), F.col("lon"), km)).agg(F.sum("_w").alias("_w"))
    full = _squares(fine).groupBy("_g", "_j", "_y", "_x").agg(F.sum("_w").alias("_w")).where(F.col("_w") * sure >= bar * (1 + 1e-9)).drop("_w")
    spots = _squares(goal.select("_p", *_square(F.col("p_lat"), F.col("p_lon"), km)).distinct())
    level = spots.join(full.hint("merge"), ["_j", "_y", "_x"]).groupBy("_g", "_p").agg(F.max("_j").alias("_j"))
    goal = durable_checkpoint(goal.join(level, ["_g", "_p"], "left").withColumn("_j", F.coalesce("_j", F.lit(0))))
    out, by = [], ["_g", "_p"]
    for j in sorted(r[0] for r in goal.select("_j").distinct().collect()):  # a few numbers
        met = radius_join(held, goal.where(F.col("_j") == j).drop("_j"), radius[j], on=["_g"])
        sums = met.groupBy(*by, "dist").agg(F.sum(F.col("_w") * share(F.col("dist"))).alias("_w"), F.min("_id").alias("_id"))
        run = W.partitionBy(*by).orderBy("dist").rowsBetween(W.unboundedPreceding, 0)
        out.append(sums.withColumn("_cum", F.sum("_w").over(run)).groupBy(*by).agg(
            F.min("dist").alias("near_km"), F.min_by("_id", "dist").alias("near_id"), F.min(F.when(F.col("_cum") >= bar, F.col("dist"))).alias("cross_km"))
            .select(*[F.col(f"_g.{c}").alias(c) for c in on], F.col(f"_p.{place}").alias(place), "near_km", "near_id", "cross_km"))
    none = targets.limit(0).select(*on, place, F.lit(None).cast("double").alias("near_km"), F.lit(None).cast(points.schema[point_id].dataType).alias("near_id"), F.lit(None).cast("double").alias("cross_km"))
    return reduce(DataFrame.unionByName, out) if out else none


_SIZES = (9.0, 1.8, 0.36, 0.072)  # degrees of the nested cells in which the nearest place is sought
_RATIO = 5


def _half_diagonal(size: float, planar: bool) -> float:
    """No point of a cell is farther from its centre, in km."""
    side = math.hypot(KM_X, KM_Y) if planar else math.hypot(_KM_PER_LAT, _KM_PER_LAT)
    return 0.5 * size * side + 1e-6


def _fine_cell(lat: Column, lon: Column, planar: bool) -> tuple[Column, Column]:
    turned = lon + 180.0 if planar else F.pmod(lon + 180.0, F.lit(360.0))
    return F.floor((lat + 90.0) / _SIZES[-1]), F.floor(turned / _SIZES[-1])


def _centre(cell: Column, size: float, base: float) -> Column:
    return (cell + 0.5) * size - base


def _nested(rows: DataFrame, on: Sequence[str], y: str, x: str) -> list[DataFrame]:
    """The distinct cells of ``rows`` from the coarsest size to the finest, each with its parent (py, px).

    One aggregate gives the cells of all sizes; it is stored, as every level reads it.
    """
    n = len(_SIZES)
    at = lambda c, k: F.floor(F.col(c) / _RATIO ** k)
    sizes = F.array(*[F.struct(F.lit(i).alias("i"), at(y, n - 1 - i).alias("y"), at(x, n - 1 - i).alias("x")) for i in range(n)])
    cells = durable_checkpoint(rows.select(*on, y, x).distinct().select(*on, F.explode(sizes).alias("_s")).distinct())
    own = cells.select(*on, F.col("_s.i").alias("_i"), F.col("_s.y").alias(y), F.col("_s.x").alias(x))
    return [own.where(F.col("_i") == i).drop("_i").withColumn(f"_p{y}", at(y, 1)).withColumn(f"_p{x}", at(x, 1)) for i in range(n)]


def _close(cells: Column, slack: float) -> Column:
    """The entries of an array of structs whose ``d`` is within ``slack`` of the smallest."""
    both = F.struct(F.array_min(F.transform(cells, lambda c: c["d"])).alias("least"), cells.alias("cells"))
    # As the variable of a function over one element the minimum is taken once, not for each entry.
    return F.get(F.transform(F.array(both), lambda b: F.filter(b["cells"], lambda c: c["d"] <= b["least"] + slack)), F.lit(0))


def nearest(points: DataFrame, places: DataFrame, place_id: str, place_pos: tuple[str, str],
            point_pos: tuple[str, str] = ("lat", "lon"), keep: Sequence[str] = (), planar: bool = False,
            out: str = "near", on: Sequence[str] = ()) -> DataFrame:
    """JON-03: struct ``near`` <dist, id, keep..> of the nearest place; ties go to the lowest id.

    One plan for tables of any size; with ``on`` the place is sought among those of equal keys.
    Both sides fall into nested cells, and only the occupied cells are handed down: a cell of
    points meets the cells of places inside those its parent kept, and keeps the ones that can hold
    the nearest place of any of its points (their centre is no farther than the nearest centre and
    two diagonals). So rows of the search are cells, whose number near a cell is a matter of
    geometry, not of the tables; places are read once, at the end, where each position meets those
    cells of the finest size that its own distance to the centres leaves. Points without a position
    have no ``near``. On the local plane longitudes are within 180 degrees.
    """
    on = list(on)
    measure = planar_distance if planar else haversine_km
    lat, lon = F.col(point_pos[0]), F.col(point_pos[1])
    cy, cx = _fine_cell(F.col("_la"), F.col("_lo"), planar)
    spots = (points.where(lat.isNotNull() & lon.isNotNull()).select(*on, lat.alias("_la"), lon.alias("_lo")).distinct()
             .withColumn("_y", cy).withColumn("_x", cx))
    plat, plon = (F.col(c) for c in place_pos)
    ry, rx = _fine_cell(plat, plon, planar)
    refs = places.where(plat.isNotNull() & plon.isNotNull()).select(
        *on, F.struct(F.col(place_id).alias("id"), plat.alias("la"), plon.alias("lo"), *[F.col(c) for c in keep]).alias("_place"), ry.alias("_v"), rx.alias("_u"))
    searching, holding = _nested(spots, on, "_y", "_x"), _nested(refs, on, "_v", "_u")
    kept: DataFrame | None = None
    for size, own, there in zip(_SIZES, searching, holding, strict=True):
        if kept is None:
            pairs = own.withColumn("_all", F.lit(0)).join(there.withColumn("_all", F.lit(0)), [*on, "_all"])  # at most 800 cells a side
        else:
            up = kept.select(*on, F.col("_y").alias("_p_y"), F.col("_x").alias("_p_x"), F.explode("_c").alias("_e")).select(
                *on, "_p_y", "_p_x", F.col("_e.v").alias("_p_v"), F.col("_e.u").alias("_p_u"))
            pairs = up.join(there, [*on, "_p_v", "_p_u"]).join(own, [*on, "_p_y", "_p_x"])
        d = measure(_centre(F.col("_y"), size, 90.0), _centre(F.col("_x"), size, 180.0), _centre(F.col("_v"), size, 90.0), _centre(F.col("_u"), size, 180.0))
        met = pairs.groupBy(*on, "_y", "_x").agg(F.collect_list(F.struct(d.alias("d"), F.col("_v").alias("v"), F.col("_u").alias("u"))).alias("_c"))
        kept = met.withColumn("_c", _close(F.col("_c"), 4 * _half_diagonal(size, planar)))
    size = _SIZES[-1]
    own_d = lambda c: F.struct(measure(F.col("_la"), F.col("_lo"), _centre(c["v"], size, 90.0), _centre(c["u"], size, 180.0)).alias("d"), c["v"].alias("v"), c["u"].alias("u"))
    cells = spots.join(kept, [*on, "_y", "_x"]).select(
        *on, "_la", "_lo", F.explode(_close(F.transform("_c", own_d), 2 * _half_diagonal(size, planar))).alias("_e"))
    met = cells.select(*on, "_la", "_lo", F.col("_e.v").alias("_v"), F.col("_e.u").alias("_u")).join(refs, [*on, "_v", "_u"])
    row = F.struct(measure(F.col("_la"), F.col("_lo"), F.col("_place.la"), F.col("_place.lo")).alias("dist"), F.col("_place.id").alias("id"),
                   *[F.col(f"_place.{c}").alias(c) for c in keep])
    best = met.groupBy(*on, "_la", "_lo").agg(F.min(row).alias(out)).withColumnsRenamed({c: f"_on_{c}" for c in on})
    same = (lat == F.col("_la")) & (lon == F.col("_lo"))
    for c in on:
        same &= F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return points.join(best, same, "left").drop("_la", "_lo", *[f"_on_{c}" for c in on])


def pair_distances(a: DataFrame, b: DataFrame, km: float, on: Sequence[str] = ()) -> DataFrame:
    """JON-02: distances between two point sets, for the pairs within ``km``.

    The matrix is only ever read through a radius (minimum or threshold), so the pairs beyond it
    are never built. Filter on positions rather than on ``dist``: its series would be copied into the join's condition.
    """
    return radius_join(a, b, km, on=on, fine=2, measure=close_km)


def zone_state(dets: DataFrame, zones: DataFrame, runs: DataFrame | None = None, radius_km: float = 200.0,
               run: str = "run_at", area: str = "area_km2") -> DataFrame:
    """AGG-01: per (run, zone): total area, area in radius, nearest distance, patch count.

    Total and count need no zone: one aggregate per run. The area in the radius and the nearest
    distance inside it come from one radius join; only zones that see nothing so near are searched
    for among the cells that the run's detections occupy. Only the result's own grid of runs and
    zones pairs the two lists. ``runs`` adds runs that saw nothing: their nearest distance is 999.
    Detections without a position count nowhere.
    """
    z = zones.select("zone_id", F.col("center_lat").alias("p_lat"), F.col("center_lon").alias("p_lon"))
    d = (dets.where(F.col("lat").isNotNull() & F.col("lon").isNotNull())
         .select(run, "lat", "lon", F.coalesce(F.col(area), F.lit(0.0)).alias("_a"), F.lit(0).alias("_id")))
    total = d.groupBy(run).agg(F.sum("_a").alias("eez_area_km2"), F.count("*").alias("patch_count"))
    close = radius_join(d.drop("_id"), z, radius_km).groupBy(run, "zone_id").agg(F.sum("_a").alias("zone_area_km2"), F.min("dist").alias("_near"))
    seen = total.select(run) if runs is None else runs.select(run).distinct()
    every = carry(seen, z, z.columns).select(run, F.explode("_ref").alias("_z")).select(run, "_z.*")
    state = durable_checkpoint(every.join(total, run, "left").join(close, [run, "zone_id"], "left"))
    far = state.where("_near is null and patch_count > 0").select(run, "zone_id", "p_lat", "p_lon")
    if far.isEmpty():
        state = state.withColumn("_far", F.lit(None).cast("double"))
    else:
        found = nearest(far, d.join(far.select(run).distinct(), run, "left_semi"), "_id", ("lat", "lon"), ("p_lat", "p_lon"), on=[run])
        state = state.join(found.select(run, "zone_id", F.col("near.dist").alias("_far")), [run, "zone_id"], "left")
    return state.select(run, "zone_id", *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("eez_area_km2", "zone_area_km2")],
                        F.coalesce("_near", "_far", F.lit(999.0)).alias("nearest_km"), F.coalesce("patch_count", F.lit(0)).alias("patch_count"))


def ring_edges(vertices: DataFrame, ring: Sequence[str], order: str) -> DataFrame:
    """SRC-09 helper: edges (x1, y1, x2, y2) of closed rings from ordered vertices."""
    w = W.partitionBy(*ring).orderBy(order)
    nxt = lambda c: F.lead(c).over(w)
    return (vertices.withColumn("x2", nxt("lon")).withColumn("y2", nxt("lat"))
            .where(F.col("x2").isNotNull())
            .select(*ring, order, F.col("lon").alias("x1"), F.col("lat").alias("y1"), "x2", "y2"))


def densify(edges: DataFrame, ring: Sequence[str], order: str, step_deg: float = 0.005) -> DataFrame:
    """GEO-06: ring points at most ``step_deg`` apart; (ring, order, part, lat, lon)."""
    length = F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    n = F.greatest(F.lit(1), F.ceil(F.round(length / step_deg, 9))).cast("int")
    out = edges.withColumn("_n", n).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    f = F.col("part") / F.col("_n")
    return out.select(*ring, order, "part", (F.col("y1") + f * (F.col("y2") - F.col("y1"))).alias("lat"),
                      (F.col("x1") + f * (F.col("x2") - F.col("x1"))).alias("lon"))


def owner_runs(points: DataFrame, ring: Sequence[str], order: Sequence[str], owner: str = "owner") -> DataFrame:
    """WIN-13: runs of consecutive points with one owner as line text; runs of one point and
    ownerless points are dropped. One ring of coast is one window."""
    w = W.partitionBy(*ring).orderBy(*order)
    known = F.coalesce(F.col(owner), F.lit(-1))
    flagged = points.withColumn("_o", known).withColumn(
        "_new", F.when(F.lag("_o").over(w) == F.col("_o"), 0).otherwise(1))
    runs = flagged.withColumn("run_no", F.sum("_new").over(w))
    pts = F.transform(F.array_sort(F.collect_list(F.struct(
        *order, F.format_string("%.4f %.4f", F.col("lon"), F.col("lat")).alias("xy")))), lambda s: s["xy"])
    return (runs.where(F.col("_o") >= 0).groupBy(*ring, "run_no", F.col("_o").alias(owner))
            .agg(F.count("*").alias("n_points"), pts.alias("_pts")).where(F.col("n_points") > 1)
            .select(*ring, owner, "n_points",
                    F.concat(F.lit("LINESTRING("), F.array_join("_pts", ", "), F.lit(")")).alias("line")))


def map_buckets(points: DataFrame, size_deg: float, rank: Column) -> DataFrame:
    """AGG-27: member count and worst level per map bucket."""
    return (points.groupBy(F.floor(F.col("lat") / size_deg).alias("bucket_y"),
                           F.floor(F.col("lon") / size_deg).alias("bucket_x"))
            .agg(F.count("*").alias("members"), F.max(rank).alias("worst")))


def hull_area_points(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """GEO-05: convex hull text of cell corners per group.

    Corners are thinned map-side to the lowest and highest longitude per latitude line, which keeps
    every hull vertex, so the per-group Arrow function sees two points per grid row at most.
    """
    corners = F.array(*[F.struct((F.col("lat") + F.lit(sy * 0.5) * F.col("dlat")).alias("y"),
                                 (F.col("lon") + F.lit(sx * 0.5) * F.col("dlon")).alias("x"))
                        for sx in (-1, 1) for sy in (-1, 1)])
    pts = (cells.select(*keys, F.explode(corners).alias("c"))
           .select(*keys, F.round("c.y", 6).alias("y"), F.round("c.x", 6).alias("x")))
    thin = pts.groupBy(*keys, "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in thin.schema if f.name in keys)

    def hull(pdf):
        rows = sorted({(a, y) for y, x0, x1 in zip(pdf["y"], pdf["x0"], pdf["x1"]) for a in (x0, x1)})
        half = []
        for seq in (rows, rows[::-1]):
            chain = []
            for p in seq:
                while len(chain) > 1 and ((chain[-1][0] - chain[-2][0]) * (p[1] - chain[-2][1])
                                          - (chain[-1][1] - chain[-2][1]) * (p[0] - chain[-2][0])) <= 0:
                    chain.pop()
                chain.append(p)
            half.extend(chain[:-1])
        ring = half + half[:1]
        text = "POLYGON((" + ", ".join(f"{x:g} {y:g}" for x, y in ring) + "))"
        out = pdf[list(keys)].iloc[:1].copy()
        out["geom_wkt"], out["vertices"] = text, len(half)
        return out

    return thin.groupBy(*keys).applyInPandas(hull, f"{schema}, geom_wkt string, vertices int")

