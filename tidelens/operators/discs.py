"""Stops inside many discs, summed per member and hour without building the pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens.functions.geo import KM_X, KM_Y

_TILE = 4          # radii along the side of a tile
_PARTS = 8         # groups that the members of a tile are dealt to
_FINEST = 5        # halvings of the radius down to the smallest cells
_BLOCK = 64        # discs summed together
_DENSE = 1 << 22   # sums a group holds at once (cells times members times hours)
_PAIRS = 1 << 21   # distances measured at once


def _sums(stops: dict, col: np.ndarray, cls: np.ndarray, width: int, classes: int, lat: np.ndarray, lon: np.ndarray, km: float):
    """Blocks (places, area sums, row counts): ``stops`` summed by ``col`` and counted by ``cls`` around each place.

    Stops are first summed per occupied cell. Cells wholly inside a disc are added as they are, by one product of
    matrices a block; only the stops of the cells on its edge are measured. The side of a cell balances both.
    """
    near = max(1.0, 1.4 * len(col) / max(1, stops["members"]) / (_TILE + 2) ** 2)
    side = km / 2 ** min(_FINEST, max(0, round(np.log2(near) / 3)))
    cy, cx = np.floor(stops["lat"] * KM_Y / side).astype(np.int64), np.floor(stops["lon"] * KM_X / side).astype(np.int64)
    spans = cx.max() - cx.min() + 1
    found, cell = np.unique((cy - cy.min()) * spans + cx - cx.min(), return_inverse=True)
    low = np.stack([(found // spans + cy.min()) * side, (found % spans + cx.min()) * side])
    order = np.argsort(cell, kind="stable")
    area, col, cls, cell, s_lat, s_lon = (a[order] for a in (stops["area"], col, cls, cell, stops["lat"], stops["lon"]))
    held = np.isfinite(area)  # others are never part of a product, where they would reach discs they are not in
    total = np.bincount(cell * width + col, np.where(held, area, 0.0), len(found) * width).reshape(len(found), width)
    rows = np.bincount(cell * classes + cls, held, len(found) * classes).reshape(len(found), classes)
    begin = np.searchsorted(cell, np.arange(len(found) + 1))
    loose = np.flatnonzero(~held)
    reach, slack = km * km, 1e-9 * km * km + 1e-12
    inside_of = lambda at, who: np.sqrt(((s_lon[at] - lon[who]) * KM_X) ** 2 + ((s_lat[at] - lat[who]) * KM_Y) ** 2) <= km
    y, x = lat * KM_Y, lon * KM_X
    row, column = np.floor(y / km * 2), np.floor(x / km * 2)
    by = np.lexsort((column, row))
    for block in np.split(by, np.flatnonzero((np.diff(row[by]) != 0) | (np.diff(column[by]) != 0)) + 1):
        for own in np.split(block, range(_BLOCK, len(block), _BLOCK)):
            py, px = y[own, None], x[own, None]
            close = np.flatnonzero((low[0] <= py.max() + km + side) & (low[0] + side >= py.min() - km - side)
                                   & (low[1] <= px.max() + km + side) & (low[1] + side >= px.min() - km - side))
            gaps = [(p - low[i][close], low[i][close] + side - p) for i, p in ((0, py), (1, px))]
            least = sum(np.maximum(0.0, np.maximum(-a, -b)) ** 2 for a, b in gaps)
            most = sum(np.maximum(a, b) ** 2 for a, b in gaps)
            whole = most <= reach - slack
            sums, n = whole.astype(float) @ total[close], whole.astype(float) @ rows[close]
            who, at = np.nonzero((least <= reach + slack) & ~whole)
            start, many = begin[close[at]], np.diff(begin)[close[at]]
            for cut in np.split(np.arange(len(who)), np.flatnonzero(np.diff(np.cumsum(many) // _PAIRS)) + 1):
                first = np.cumsum(many[cut]) - many[cut]
                stop = np.arange(many[cut].sum()) + np.repeat(start[cut] - first, many[cut])
                place = np.repeat(who[cut], many[cut])
                hit = held[stop] & inside_of(stop, own[place])
                stop, place = stop[hit], place[hit]
                sums += np.bincount(place * width + col[stop], area[stop], sums.size).reshape(sums.shape)
                n += np.bincount(place * classes + cls[stop], minlength=n.size).reshape(n.shape)
            for cut in np.split(loose, range(_PAIRS // _BLOCK, len(loose), _PAIRS // _BLOCK)) if len(loose) else []:
                place, stop = np.nonzero(inside_of(cut[None, :], own[:, None]))
                stop = cut[stop]
                np.add.at(sums, (place, col[stop]), area[stop])
                np.add.at(n, (place, cls[stop]), 1.0)
            yield own, sums, n


def arrived_near(stops: DataFrame, places: DataFrame, km: float, horizons: Sequence[int], minimum: float, low_max: float) -> DataFrame:
    """AGG-06 around places: per (p_lat, p_lon, times, member) the area of the stops within ``km`` on the local plane that arrived
    at each horizon, and the hours at which the running area reaches the two bars (above zero).

    ``places`` are distinct (p_lat, p_lon, times); every stop counts ``times`` times. Tiles are four radii
    wide; a stop goes to the tiles its circle touches (four at most), its members to groups of their own,
    so that a group holds the stops of one tile and some members. Pairs are never built.
    """
    horizons, last, parts = sorted(horizons), max(horizons), _PARTS
    fits = lambda c: F.abs(F.col(c)) < float("inf")
    tile = lambda km_at, shift=0.0: F.floor((km_at + shift) / (_TILE * km))
    touched = lambda km_at: F.explode(F.sequence(tile(km_at, -km * (1 + 1e-9)), tile(km_at, km * (1 + 1e-9))))
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(parts))
    held = stops.where(fits("lat") & fits("lon") & F.col("hour").isNotNull()).select(
        "member", F.ceil("hour").cast("int").alias("hr"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
        F.col("area").cast("double").alias("area")).where(F.col("hr") <= last)
    held = held.withColumn("_ty", touched(F.col("lat") * KM_Y)).withColumn("_tx", touched(F.col("lon") * KM_X)).withColumn("_part", part("member"))
    spots = places.where(fits("p_lat") & fits("p_lon")).select(
        "p_lat", "p_lon", F.col("times").cast("long").alias("times"), tile(F.col("p_lat") * KM_Y).alias("_ty"), tile(F.col("p_lon") * KM_X).alias("_tx"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("_part"))
    areas = [f"area_{h}" for h in horizons]
    kind = stops.schema["member"].dataType.simpleString()
    schema = "p_lat double, p_lon double, times long, member " + kind + "".join(f", {a} double" for a in areas) + ", eta_low int, eta_min int"

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["p_lat", "p_lon", "times", "member", *areas, "eta_low", "eta_min"]
        member = left["member"].combine_chunks()
        types = [pa.float64(), pa.float64(), pa.int64(), member.type, *[pa.float64()] * len(areas), pa.int32(), pa.int32()]
        done = []
        if left.num_rows and right.num_rows:
            coded = member.dictionary_encode(null_encoding="encode")
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            code, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            hours, hr = np.unique(left["hr"].to_numpy(), return_inverse=True)
            step = np.searchsorted(horizons, hours)[hr]
            empty = left["area"].combine_chunks().is_null().to_numpy(zero_copy_only=False)
            area = np.where(empty, 0.0, left["area"].to_numpy())
            lat, lon = left["lat"].to_numpy(), left["lon"].to_numpy()
            p_lat, p_lon, times = (right[c].to_numpy() for c in ("p_lat", "p_lon", "times"))
            wide = max(1, min(len(known), _DENSE // (len(hours) * min(len(area), ((_TILE + 2) * 2 ** _FINEST) ** 2))))
            ranked, h = np.argsort(code, kind="stable"), len(horizons)
            edges = np.searchsorted(code[ranked], np.arange(0, len(known) + wide, wide))
            for first, mine in zip(range(0, len(known), wide), np.split(ranked, edges[1:-1])):
                m = min(wide, len(known) - first)
                own = code[mine] - first
                got = {"lat": lat[mine], "lon": lon[mine], "area": area[mine], "members": m}
                for who, sums, n in _sums(got, own * len(hours) + hr[mine], (own * 2 + empty[mine]) * h + step[mine], m * len(hours), m * 2 * h, p_lat, p_lon, km):
                    sums = sums.reshape(len(who), m, len(hours)) * times[who, None, None]
                    n = n.reshape(len(who), m, 2, h)
                    a, b = np.nonzero(n.sum(axis=(2, 3)) > 0)
                    sums, n = sums[a, b], n[a, b]
                    run, both = np.cumsum(sums, axis=1), n.sum(axis=1)
                    columns = [p_lat[who[a]], p_lon[who[a]], times[who[a]], known.take(pa.array(first + b))]
                    for j, at in enumerate(horizons):
                        none = (n[:, 0, :j + 1].sum(axis=1) == 0) & (both[:, j + 1:].sum(axis=1) == 0)  # a sum of nulls alone is null
                        columns.append(pa.array(sums[:, hours <= at].sum(axis=1), mask=none))
                    for bar in (low_max, minimum):
                        over = ~(run < bar)
                        columns.append(pa.array(hours[over.argmax(axis=1)].astype(np.int32), mask=~over.any(axis=1)))
                    done.append(pa.table([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], names=names))
        return pa.concat_tables(done) if done else pa.table([pa.array([], t) for t in types], names=names)

    keys = ["_ty", "_tx", "_part"]
    return held.groupBy(*keys).cogroup(spots.groupBy(*keys)).applyInArrow(group, schema)
