"""Operators on regular grids kept as long cell tables (keys.., row, col, value)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions.geo import cell_km2, mercator_lat, mercator_y
from tidelens.operators.quantiles import group_median
from tidelens.session import durable_checkpoint

TILE = 128
MEDIAN_VALUES = 1 << 20  # values of windows that are laid out at a time


def index_pixels(red: Column, nir: Column, swir: Column) -> tuple[Column, Column]:
    """PRJ-01 / PRJ-02: (floating-algae index, NDVI) of scaled reflectances."""
    nm = S.BAND_NM
    factor = (nm["nir"] - nm["red"]) / (nm["swir"] - nm["red"])
    r, n, s = (c / S.REFLECTANCE_SCALE for c in (red, nir, swir))
    return n - (r + (s - r) * factor), F.try_divide(n - r, n + r)


def usable_pixel(scene_class: Column, quality: Column) -> Column:
    """PRJ-03: class not in the bad list and quality high enough; missing quality counts as clear."""
    return ~scene_class.isin(*S.BAD_SCENE_CLASSES) & (F.coalesce(quality, F.lit(1.0)) >= S.QUALITY_MIN)


def candidate_pixel(anomaly: Column, index: Column, ndvi: Column) -> Column:
    """PRJ-05: bright against its surroundings, or bright anyway, and green enough."""
    return ((anomaly > S.INDEX_ANOMALY_MIN) | (index > S.INDEX_DENSE_MIN)) & (ndvi > S.NDVI_MIN)


def covered_area(outline: Column, mean_anomaly: Column) -> Column:
    """PRJ-07: outline area times the clipped mean anomaly share; null on bad input."""
    share = mean_anomaly.try_cast("double") / S.FULL_COVER_INDEX
    return outline * F.when(share.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), share)))


def full_grid(cells: DataFrame, keys: Sequence[str], group: Sequence[str] | None = None) -> DataFrame:
    """Every (keys, row, col) of the grids' extents; cells without a row get a null value.

    ``group`` names the keys that share one extent (by default all of them).
    """
    group = list(keys if group is None else group)
    ext = cells.groupBy(*group).agg(F.min("row").alias("r0"), F.max("row").alias("r1"),
                                    F.min("col").alias("c0"), F.max("col").alias("c1"))
    frames = cells.select(*keys).distinct()
    base = frames.join(ext, group)
    grid = (base.withColumn("row", F.explode(F.sequence("r0", "r1")))
            .withColumn("col", F.explode(F.sequence("c0", "c1"))).drop("r0", "r1", "c0", "c1"))
    return grid.join(cells.select(*keys, "row", "col", "value"), [*keys, "row", "col"], "left")


def offsets(reach: int, diamond: bool = False, centre: bool = True) -> list[tuple[int, int]]:
    """JON-27: neighbour offsets of a square or (4-neighbour steps) a diamond."""
    span = range(-reach, reach + 1)
    return [(a, b) for a in span for b in span
            if (not diamond or abs(a) + abs(b) <= reach) and (centre or (a, b) != (0, 0))]


def neighbours(cells: DataFrame, moves: Sequence[tuple[int, int]]) -> DataFrame:
    """JON-27: each cell repeated to the places it is a neighbour of (equi-join side)."""
    arr = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in moves])
    return (cells.withColumn("_m", F.explode(arr)).withColumn("row", F.col("row") + F.col("_m.a"))
            .withColumn("col", F.col("col") + F.col("_m.b")).drop("_m"))


def dilate(mask: DataFrame, keys: Sequence[str], reach: int, moves: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """WIN-04: (keys, row, col) of cells within ``reach`` 4-neighbour steps of the mask."""
    grown = neighbours(mask.select(*keys, "row", "col"), moves or offsets(reach, diamond=True))
    return grown.distinct()


def circle(radius_cells: float) -> list[tuple[int, int]]:
    """Offsets of a disc, for a buffer in metres over a cell size."""
    r = int(radius_cells)
    return [(a, b) for a, b in offsets(r) if a * a + b * b <= radius_cells * radius_cells]


def mask_ocean(cells: DataFrame, land: DataFrame, keys: Sequence[str], radius_cells: float) -> DataFrame:
    """JON-30: cells that are neither land nor within the buffer of land."""
    return cells.join(dilate(land, keys, 0, circle(radius_cells)), [*keys, "row", "col"], "left_anti")


def _in_tiles(cells: DataFrame, extent_of: DataFrame, keys: list[str], halo: int, tile: int) -> DataFrame:
    """Cells with the tile (ty, tx) they are read by, their own or one whose halo they lie in, and the grid's extent."""
    ext = extent_of.groupBy(*keys).agg(F.min("row").alias("r0"), F.max("row").alias("r1"),
                                       F.min("col").alias("c0"), F.max("col").alias("c1"))
    tiles = lambda x, lo, hi: F.explode(F.sequence(
        F.greatest(F.floor((x - halo) / tile), F.floor(lo / tile)), F.least(F.floor((x + halo) / tile), F.floor(hi / tile))))
    return (cells.join(ext, keys).withColumn("ty", tiles(F.col("row"), F.col("r0"), F.col("r1")))
            .withColumn("tx", tiles(F.col("col"), F.col("c0"), F.col("c1"))))


def _spread(tiled: DataFrame, keys: list[str]) -> DataFrame:
    """Tiles dealt over the session's shuffle partitions: they are light in bytes and heavy in work, so
    that partitions joined by size would leave most cores idle."""
    n = int(tiled.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return tiled.repartition(n, *keys, "ty", "tx")


def _tile_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Row numbers at which the values of ``keys`` change; null equals null, NaN equals NaN."""
    n = table.num_rows
    changed = np.ones(n, bool)
    changed[1:] = False
    for k in keys:
        column = table[k].combine_chunks()
        a, b = column.slice(1), column.slice(0, n - 1)
        if pa.types.is_nested(column.type):
            values = column.to_pylist()
            changed[1:] |= np.fromiter((x != y for x, y in zip(values[1:], values[:-1])), bool, n - 1)
            continue
        other = pc.fill_null(pc.not_equal(a, b), False)
        if pa.types.is_floating(column.type):
            other = pc.and_not(other, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        changed[1:] |= pc.or_(other, pc.xor(pc.is_null(a), pc.is_null(b))).to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)


def _by_tiles(tiled: DataFrame, keys: Sequence[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """Rows of ``work(table, starts)`` over tables of whole tiles (keys.., ty, tx), each tile from its start on.

    Sorted tiles follow each other in Arrow batches, so a call works on all small tiles of a batch at
    once; only the last tile, which may go on in the next batch, is held back.
    """
    at = [*keys, "ty", "tx"]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            starts = _tile_starts(table, at)
            held = table.slice(starts[-1])
            if len(starts) > 1:
                yield from work(table.slice(0, starts[-1]).combine_chunks(), starts[:-1]).to_batches()
        if held is not None:
            yield from work(held.combine_chunks(), np.zeros(1, np.int64)).to_batches()

    return _spread(tiled, list(keys)).sortWithinPartitions(*at).mapInArrow(run, schema)


class _Tiles:
    """Tiles with their halo as arrays, those of one shape in one stack. ``inner`` marks the rows of the table that
    belong to a tile itself."""

    def __init__(self, table: pa.Table, starts: np.ndarray, tile: int, halo: int):
        head = {k: table[k].to_numpy()[starts].astype(np.int64) for k in ("ty", "tx", "r0", "r1", "c0", "c1")}
        self.row, self.col = (table[k].to_numpy().astype(np.int64) for k in ("row", "col"))
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        edges = []  # per axis: first and last of the grid, of the cells at hand, and of the tile itself
        for t, lo, hi in (("ty", "r0", "r1"), ("tx", "c0", "c1")):
            first, last = head[t] * tile, head[t] * tile + tile - 1
            edges.append([head[lo], head[hi], np.maximum(head[lo], first - halo), np.minimum(head[hi], last + halo),
                          np.maximum(head[lo], first), np.minimum(head[hi], last)])
        (top, bottom), (left, right) = (e[4:] for e in edges)
        self.inner = (self.row >= top[of]) & (self.row <= bottom[of]) & (self.col >= left[of]) & (self.col <= right[of])
        self.y, self.x = self.row - top[of], self.col - left[of]
        shape = np.stack([e - axis[4] for axis in edges for e in axis], axis=1)
        shapes, kind = np.unique(shape, axis=0, return_inverse=True)
        kind = kind.reshape(-1)
        number = np.empty(len(starts), np.int64)  # of a tile in its stack
        order = np.argsort(kind[of], kind="stable")
        rows = np.split(order, np.searchsorted(kind[of][order], np.arange(1, len(shapes))))
        self.stacks = []
        for i, s in enumerate(shapes):
            alike = np.flatnonzero(kind == i)
            number[alike] = np.arange(len(alike))
            self.stacks.append((len(alike), s[:6], s[6:], rows[i], number[of[rows[i]]]))

    def _at_inner(self, out: np.ndarray, rows: np.ndarray, number: np.ndarray, board: np.ndarray) -> None:
        own = self.inner[rows]
        r = rows[own]
        out[r] = board[number[own], self.y[r], self.x[r]]

    def median(self, values: np.ndarray, window: int) -> np.ndarray:
        """Median of the window around each inner row; beyond the grid its edge cells are repeated in mirror order."""
        rad, out = window // 2, np.full(len(values), np.nan)

        def reflected(axis):
            first, last, begin, _, _, end = axis
            idx, size = np.arange(-rad, end + rad + 1) - first, last - first + 1
            idx = np.mod(idx, 2 * size)
            return np.where(idx >= size, 2 * size - 1 - idx, idx) + first - begin

        for n, ys, xs, rows, number in self.stacks:
            board = np.full((n, ys[3] - ys[2] + 1, xs[3] - xs[2] + 1), np.nan)
            board[number, self.y[rows] - ys[2], self.x[rows] - xs[2]] = values[rows]
            padded = board[:, reflected(ys)][:, :, reflected(xs)]
            windows = np.lib.stride_tricks.sliding_window_view(padded, (window, window), axis=(1, 2))
            size, (height, width) = window * window, windows.shape[1:3]
            lines = max(1, MEDIAN_VALUES // (size * width))
            deep = max(1, lines // height)  # tiles, or lines of one tile, that are laid out at a time
            medians = np.empty((n, height, width))
            for i in range(0, n, deep):
                for j in range(0, height, lines):
                    part = windows[i:i + deep, j:j + lines]
                    medians[i:i + deep, j:j + lines] = self._middle(part.reshape(-1, size)).reshape(part.shape[:3])
            self._at_inner(out, rows, number, medians)
        return out

    @staticmethod
    def _middle(values: np.ndarray) -> np.ndarray:
        """Median of each row, none of which holds NaN; np.median takes five times as long to look for them."""
        half = values.shape[1] // 2
        if values.shape[1] % 2:
            return np.partition(values, half, axis=1)[:, half]
        both = np.partition(values, [half - 1, half], axis=1)
        return (both[:, half - 1] + both[:, half]) / 2

    def near(self, marked: np.ndarray, reach: int) -> np.ndarray:
        """Inner rows within ``reach`` 4-neighbour steps of a marked cell of tile or halo."""
        out = np.zeros(len(marked), bool)
        for n, ys, xs, rows, number in self.stacks:
            height, width = ys[5] + 1, xs[5] + 1
            y, x = self.y[rows] + reach, self.x[rows] + reach
            seen = marked[rows] & (y >= 0) & (y < height + 2 * reach) & (x >= 0) & (x < width + 2 * reach)
            board = np.zeros((n, height + 2 * reach, width + 2 * reach), bool)
            board[number[seen], y[seen], x[seen]] = True
            for _ in range(reach):
                grown = board.copy()
                grown[:, 1:] |= board[:, :-1]
                grown[:, :-1] |= board[:, 1:]
                grown[:, :, 1:] |= board[:, :, :-1]
                grown[:, :, :-1] |= board[:, :, 1:]
                board = grown
            self._at_inner(out, rows, number, board[:, reach:reach + height, reach:reach + width])
        return out


def local_median(cells: DataFrame, keys: Sequence[str], window: int = S.GRID_WINDOW, value: str = "filled",
                 out: str = "background", tile: int = TILE, extent_of: DataFrame | None = None) -> DataFrame:
    """AGG-24 / AGG-25: median over a square window, edges reflected with the edge cell repeated.

    Grids are cut into tiles with a halo of half a window, so a cell is shuffled about once instead
    of once per window it belongs to, and the medians of tiles are taken in NumPy, whatever the size
    of the grid. ``value`` must be set on every cell.
    ``extent_of`` may name a cheaper frame with the same cells, to read the grids' extents from.
    """
    keys = list(keys)
    c = _in_tiles(cells.select(*keys, "row", "col", F.col(value).alias("v")),
                  cells if extent_of is None else extent_of, keys, window // 2, tile)
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}

    def some_tiles(table: pa.Table, starts: np.ndarray) -> pa.Table:
        t = _Tiles(table, starts, tile, window // 2)
        kept = table.select([*keys, "row", "col"]).filter(pa.array(t.inner))
        return kept.append_column(out, pa.array(t.median(table["v"].to_numpy(), window)[t.inner]))

    schema = ", ".join(f"{k} {kinds[k]}" for k in [*keys, "row", "col"]) + f", {out} double"
    return _by_tiles(c, keys, some_tiles, schema)


def flag_cells(cells: DataFrame, keys: Sequence[str], window: int = S.GRID_WINDOW, bin_width: float = 0.0005,
               edge: int = S.GRID_EDGE_CELLS, tile: int = TILE) -> DataFrame:
    """PRJ-08: (keys, row, col, value, anomaly, clear, flagged) of full daily grids.

    ``cells`` must hold every cell, null (or NaN) where there was no view. Median, cloud edge and
    flags come from one pass over tiles with a halo, so cells are shuffled once and joined to nothing
    but their grid's median and extent. Those two are read from a durable checkpoint of the cells.
    """
    keys = list(keys)
    at = [*keys, "row", "col"]
    value = F.nanvl(F.col("value"), F.lit(None).cast("double"))
    cells = durable_checkpoint(cells.select(*at, value.alias("value")))
    mid = group_median(cells, keys, "value", "_mid", bin_width=bin_width)
    halo = max(window // 2, edge)
    c = _in_tiles(cells.join(mid, keys), cells, keys, halo, tile)
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}

    def some_tiles(table: pa.Table, starts: np.ndarray) -> pa.Table:
        t = _Tiles(table, starts, tile, halo)
        value = table["value"].to_numpy()  # NaN where null
        unseen = np.isnan(value)
        background = t.median(np.where(unseen, table["_mid"].to_numpy(), value), window)[t.inner]
        edges = t.near(unseen, edge)[t.inner]
        kept = table.select([*at, "value"]).filter(pa.array(t.inner))
        value, unseen = value[t.inner], unseen[t.inner]
        anomaly = np.where(unseen, 0.0, value - background)
        clear = ~edges & ~unseen & ~(value >= S.GRID_SATURATED)
        for name, column in (("anomaly", anomaly), ("clear", clear), ("flagged", clear & (anomaly > S.GRID_ANOMALY_MIN))):
            kept = kept.append_column(name, pa.array(column))
        return kept

    schema = ", ".join(f"{k} {kinds[k]}" for k in at) + ", value double, anomaly double, clear boolean, flagged boolean"
    return _by_tiles(c, keys, some_tiles, schema)


def latest_clear(flags: DataFrame, grid: Sequence[str], day: str) -> DataFrame:
    """WIN-03: per cell the newest clear view; never-clear cells have no day and are not flagged."""
    row = F.struct("flagged", "anomaly", day)
    g = flags.groupBy(*grid, "row", "col").agg(F.max_by(row, F.when(F.col("clear"), F.col(day))).alias("r"))
    return g.select(*grid, "row", "col", F.coalesce("r.flagged", F.lit(False)).alias("flagged"),
                    F.coalesce("r.anomaly", F.lit(0.0)).alias("anomaly"), F.col(f"r.{day}").alias("day_used"))


def latest_pixel(pixels: DataFrame, keys: Sequence[str], ts: str, values: Sequence[str]) -> DataFrame:
    """WIN-02: newest usable observation per cell (run after the mask filter)."""
    g = pixels.groupBy(*keys).agg(F.max_by(F.struct(*values, ts), F.struct(ts, *values)).alias("r"))
    return g.select(*keys, *[F.col(f"r.{v}").alias(v) for v in values], F.col(f"r.{ts}").alias(ts))


def grid_step(axis: DataFrame, keys: Sequence[str], coord: str, out: str) -> DataFrame:
    """WIN-15: median spacing of the distinct sorted coordinates; a fixed step for a single line."""
    lines = axis.select(*keys, coord).distinct()
    w = W.partitionBy(*keys).orderBy(coord)
    gaps = lines.withColumn("_g", F.round(F.col(coord) - F.lag(coord).over(w), 9))
    med = group_median(gaps, keys, "_g", out)
    return (lines.select(*keys).distinct().join(med, list(keys), "left")
            .withColumn(out, F.coalesce(out, F.lit(S.GRID_DEFAULT_STEP))))


def group_numbers(row: np.ndarray, col: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First cell (row, col) of the 8-connected group of each cell, the smallest in row order.

    Cells of a row that follow each other are one run. Runs of neighbouring rows that touch are found
    by binary search and united by array minima, so the work depends on runs, not on steps.
    """
    order = np.lexsort((col, row))
    r, c = row[order].astype(np.int64), col[order].astype(np.int64)
    fresh = np.ones(len(r), bool)
    fresh[1:] = (r[1:] != r[:-1]) | (c[1:] - c[:-1] > 1)
    run = np.cumsum(fresh) - 1
    first, last = np.flatnonzero(fresh), np.append(np.flatnonzero(fresh)[1:], len(r)) - 1
    left = c.min()
    width = int(c.max() - left) + 4  # so that a column beside the last one is still in its row
    begin, end = r[first] * width + c[first] - left + 1, r[last] * width + c[last] - left + 1
    lo = np.searchsorted(end, begin + width - 1, "left")
    hi = np.searchsorted(begin, end + width + 1, "right")
    n = np.maximum(hi - lo, 0)
    upper = np.repeat(np.arange(len(first)), n)
    lower = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
    root = np.arange(len(first))
    while True:
        a, b = root[upper], root[lower]
        apart = a != b
        if not apart.any():
            break
        low, high = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(root, high, low)
        while (root[root] != root).any():
            root = root[root]
    start = first[root[run]]
    out_r, out_c = np.empty(len(r), np.int64), np.empty(len(r), np.int64)
    out_r[order], out_c[order] = r[start], c[start]
    return out_r, out_c


def components(cells: DataFrame, keys: Sequence[str], tile: int = TILE) -> DataFrame:
    """WIN-16: (keys, row, col, label) of 8-connected groups; the label is stable and unique.

    Cells are first labelled inside tiles (runs instead of cells, all small tiles of a batch at once: a
    tile's rows stand apart from the next tile's by a row between them). Only
    groups that touch across a tile border then form a graph, which ``connect`` contracts. The label
    names the first cell of one of the group's tiles.
    """
    keys = list(keys)
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    c = (cells.select(*keys, F.col("row").cast("long"), F.col("col").cast("long"))
         .withColumn("ty", F.floor(F.col("row") / tile)).withColumn("tx", F.floor(F.col("col") / tile)))
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "ty long", "tx long", "row long", "col long",
                        "lr long", "lc long"])

    def local(table: pa.Table, starts: np.ndarray) -> pa.Table:
        row, col = (pc.fill_null(table[k], np.iinfo(np.int64).min).to_numpy() for k in ("row", "col"))
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        top, left = np.minimum.reduceat(row, starts), np.minimum.reduceat(col, starts)
        lr, lc = group_numbers(row - top[of] + of * (tile + 1), col - left[of])
        out = table.select([*keys, "ty", "tx", "row", "col"])
        return out.append_column("lr", pa.array(lr - of * (tile + 1) + top[of])).append_column("lc", pa.array(lc + left[of]))

    labelled = durable_checkpoint(_by_tiles(c, keys, local, schema))
    group = F.struct(*keys, "lr", "lc")
    rim = labelled.where((F.pmod("row", F.lit(tile)).isin(0, tile - 1)) | (F.pmod("col", F.lit(tile)).isin(0, tile - 1)))
    half = [(0, 1), (1, -1), (1, 0), (1, 1)]  # the other four are the same meetings seen from the other cell
    step = neighbours(rim.select(*keys, "row", "col", group.alias("a"), F.col("ty").alias("ay"), F.col("tx").alias("ax")), half)
    edges = (step.join(rim.select(*keys, "row", "col", group.alias("b"), "ty", "tx"), [*keys, "row", "col"])
             .where((F.col("ay") != F.col("ty")) | (F.col("ax") != F.col("tx"))).select("a", "b").distinct())
    whole = labelled.withColumn("node", group).join(connect(edges), "node", "left")
    top = F.coalesce("root", "node")
    name = F.concat_ws(":", *[top[k].cast("string") for k in [*keys, "lr", "lc"]])
    return whole.select(*keys, "row", "col", name.alias("label"))


def connect(edges: DataFrame) -> DataFrame:
    """Connected components of an undirected graph of edges (a, b): (node, root), root the smallest node.

    Large-star and small-star steps rewrite the edges: each node hands its larger neighbours, then its
    smaller ones, to the smallest it sees. Distances to the root at least halve along a chain, so rounds grow with
    the logarithm of a component's diameter. Minima are combined map-side; a round is cut by a durable
    checkpoint, and the last one changes no edge.
    """
    now = durable_checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    before = state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("_m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "_m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("_m"))
        small = large.join(low, "a")
        pairs = F.explode(F.array(F.struct("b", "_m"), F.struct(F.col("a").alias("b"), "_m")))
        now = durable_checkpoint(small.select(pairs.alias("e")).select(F.col("e.b").alias("a"), F.col("e._m").alias("b"))
                                 .where("a <> b").distinct())
        after = state(now)
        if after == before:
            break
        before = after
    return (now.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))


def cluster_stats(cells: DataFrame, keys: Sequence[str], min_cells: int = S.GRID_MIN_CELLS) -> DataFrame:
    """AGG-04: per group: centroid, covered area, cells, latest day. Needs lat, lon, dlat, dlon."""
    cover = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("anomaly") / S.GRID_FULL_COVER))
    area = cell_km2(F.col("lat"), F.col("dlat"), F.col("dlon")) * cover
    return (cells.groupBy(*keys, "label")
            .agg(F.avg("lat").alias("centroid_lat"), F.avg("lon").alias("centroid_lon"),
                 F.sum(area).alias("area_km2"), F.count("*").alias("n_cells"),
                 F.max("day_used").alias("last_day"))
            .where(F.col("n_cells") >= min_cells))


def patch_stats(cells: DataFrame, keys: Sequence[str], min_km2: float = S.MIN_PATCH_KM2) -> DataFrame:
    """AGG-05 / UDF-02 / GEO-08 / PRJ-06: per patch: latest time, mean anomaly, area, planar centroid,
    covered area; patches under the minimum area are dropped. Several reducers in one pass."""
    g = cells.groupBy(*keys, "label").agg(
        F.max("obs_ms").alias("obs_ms"), F.avg("anomaly").alias("mean_anomaly"),
        F.sum("cell_area").alias("area_km2"),
        F.avg("lon").alias("centroid_lon"), F.avg(mercator_y(F.col("lat"))).alias("_my"), F.count("*").alias("n_cells"))
    return (g.where(F.col("area_km2") >= min_km2).withColumn("centroid_lat", mercator_lat(F.col("_my"))).drop("_my")
            .withColumn("covered_km2", covered_area(F.col("area_km2"), F.col("mean_anomaly"))))


def seen_clear(points: DataFrame, clear: DataFrame, axes: DataFrame, keys: Sequence[str], point_id: str) -> DataFrame:
    """JON-15: ids of points inside the grid whose cell, or a direct neighbour, had a clear view.

    A point's cell is the first grid line at or above it. ``axes`` holds (keys, lat0, dlat, n_lat,
    lon0, dlon, n_lon) of regular grids.
    """
    p = points.join(axes, list(keys))
    idx = lambda v, v0, d, n: F.least(F.greatest(F.ceil(F.round((v - v0) / d, 6)), F.lit(0)), n - 1)
    inside = (F.col("lat").between(F.col("lat0"), F.col("lat0") + (F.col("n_lat") - 1) * F.col("dlat"))
              & F.col("lon").between(F.col("lon0"), F.col("lon0") + (F.col("n_lon") - 1) * F.col("dlon")))
    at = (p.where(inside).withColumn("row", idx(F.col("lat"), F.col("lat0"), F.col("dlat"), F.col("n_lat")))
          .withColumn("col", idx(F.col("lon"), F.col("lon0"), F.col("dlon"), F.col("n_lon"))))
    return at.join(dilate(clear, keys, 1), [*keys, "row", "col"], "left_semi").select(*keys, point_id)


def interpolate(points: DataFrame, field: DataFrame, axes: dict, keys: Sequence[str], clamp: bool,
                values: Sequence[str] = ("u", "v")) -> DataFrame:
    """JON-28 / AGG-26: (keys, values) of a field at (t, lat, lon) from the 8 surrounding nodes of a regular grid.

    ``axes`` gives (first, step, count) of t, lat and lon. Time is clamped; places outside the grid
    are clamped too (winds) or give 0 (currents); missing nodes count as 0. The field, the small side,
    is turned into cells that hold their 8 corners, so that a point meets one row and is never repeated.
    """
    def cell(name, clamped):
        first, step, count = axes[name]
        x = (F.col(name) - first) / step
        x = F.least(F.greatest(x, F.lit(0.0)), F.lit(float(count - 1))) if clamped else x
        base = F.least(F.floor(x), F.lit(max(count - 2, 0)))
        return base, x - base

    corners = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"), F.lit(i).alias("i"))
                                 for i, (a, b, c) in enumerate(corners)]))
    node = [F.nanvl(F.col(v).cast("double"), F.lit(0.0)).alias(f"_n{j}") for j, v in enumerate(values)]
    spread = field.select("t_idx", "row", "col", *node, corner.alias("_k"))
    boxes = (spread.groupBy((F.col("t_idx") - F.col("_k.a")).cast("long").alias("_bt"), (F.col("row") - F.col("_k.b")).cast("long").alias("_by"),
                            (F.col("col") - F.col("_k.c")).cast("long").alias("_bx"))
             .agg(*[F.sum(F.when(F.col("_k.i") == i, F.col(f"_n{j}"))).alias(f"_n{j}_{i}")
                    for j in range(len(values)) for i in range(len(corners))]))
    (bt, ft), (by, fy), (bx, fx) = cell("t", True), cell("lat", clamp), cell("lon", clamp)
    p = points.select(*keys, bt.cast("long").alias("_bt"), ft.alias("_ft"), by.cast("long").alias("_by"), fy.alias("_fy"),
                      bx.cast("long").alias("_bx"), fx.alias("_fx"))
    outside = (F.lit(False) if clamp else
               ((F.col("_fy") < 0) | (F.col("_fy") > 1) | (F.col("_fx") < 0) | (F.col("_fx") > 1)
                | (F.col("_by") < 0) | (F.col("_bx") < 0)))
    share = lambda f, on: F.col(f) if on else 1 - F.col(f)

    def mixed(j):
        total = F.lit(0.0)
        for i, (a, b, c) in enumerate(corners):
            total = total + share("_ft", a) * share("_fy", b) * share("_fx", c) * F.coalesce(F.col(f"_n{j}_{i}"), F.lit(0.0))
        return F.when(outside, 0.0).otherwise(total)

    return p.join(boxes, ["_bt", "_by", "_bx"], "left").select(*keys, *[mixed(j).alias(v) for j, v in enumerate(values)])


def agreement(patches: DataFrame, clusters: DataFrame, checkable: DataFrame, keys: Sequence[str],
              km: float = S.GRID_MATCH_KM) -> tuple[DataFrame, DataFrame]:
    """AGG-02 / JON-13 / JON-14: (summary per key, clusters with no patch nearby).

    Patches and clusters are (keys.., id, lat, lon); ``checkable`` is (keys.., id) of patches.
    """
    from tidelens.operators.spatial import within

    p_hit = within(patches.select(*keys, "id", "lat", "lon"), clusters, km, "id", on=keys).withColumn("hit", F.lit(1))
    c_hit = within(clusters.select(*keys, "id", "lat", "lon"), patches, km, "id", on=keys).withColumn("hit", F.lit(1))
    on = [*keys, "id"]
    p = patches.join(p_hit, on, "left").join(checkable.withColumn("ok", F.lit(1)), on, "left")
    c = clusters.join(c_hit, on, "left")
    ps = p.groupBy(*keys).agg(F.count("*").alias("patches"), F.count("ok").alias("checkable"),
                              F.count_if(F.col("ok").isNotNull() & F.col("hit").isNotNull()).alias("confirmed"))
    cs = c.groupBy(*keys).agg(F.count("*").alias("clusters"), F.count("hit").alias("matched"))
    summary = ps.join(cs, list(keys), "full_outer").na.fill(0)
    return summary, c.where(F.col("hit").isNull()).drop("hit")


def focal_median(cells: DataFrame, keys: Sequence[str], value: str, reach: int, out: str = "background") -> DataFrame:
    """AGG-25: median of the cells that exist within ``reach``; cells without data are left out.

    For small windows: inside a tile each cell is repeated to the windows it belongs to, (2 reach + 1)^2
    at most. Wide windows use ``local_median``.
    """
    at, moves = [*keys, "row", "col"], offsets(reach)
    known = cells.where(" and ".join(f"`{c}` is not null" for c in at))
    tiles = lambda x: F.explode(F.sequence(F.floor((x - reach) / TILE), F.floor((x + reach) / TILE)))
    c = known.select(*at, F.col(value).cast("double").alias("v")).withColumn("ty", tiles(F.col("row"))).withColumn("tx", tiles(F.col("col")))
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    side = TILE + 4 * reach  # a tile with its halo, and the halo's own windows

    def some_tiles(table: pa.Table, starts: np.ndarray) -> pa.Table:
        of = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, table.num_rows)))
        y, x = (table[k].to_numpy().astype(np.int64) - table[t].to_numpy() * TILE for k, t in (("row", "ty"), ("col", "tx")))
        place = (of * side + y + 2 * reach) * side + x + 2 * reach
        own, first = np.unique(np.where((y >= 0) & (y < TILE) & (x >= 0) & (x < TILE), place, -1), return_index=True)
        own, first = own[own >= 0], first[own >= 0]
        seen = pc.is_valid(table["v"]).to_numpy()
        values, to = table["v"].to_numpy()[seen], np.concatenate([place[seen] + a * side + b for a, b in moves])
        cell = np.minimum(np.searchsorted(own, to), max(len(own) - 1, 0))
        hit = own[cell] == to if len(own) else np.zeros(len(to), bool)
        cell, values = cell[hit], np.tile(values, len(moves))[hit]
        values = values[np.lexsort((values, cell))]  # NaN last, as Spark orders it
        n = np.bincount(cell, minlength=len(own))
        begin, some = np.cumsum(n) - n, n > 0
        middle = np.full(len(own), np.nan)
        lower, upper = values[(begin + (n - 1) // 2)[some]], values[(begin + n // 2)[some]]
        middle[some] = np.where(n[some] % 2 == 1, lower, (lower + upper) / 2)
        return table.select(at).take(pa.array(first)).append_column(out, pa.array(middle, mask=~some))

    schema = ", ".join(f"{k} {kinds[k]}" for k in at) + f", {out} double"
    return _by_tiles(c, keys, some_tiles, schema)


def attach_time(pixels: DataFrame, images: DataFrame, key: str) -> DataFrame:
    """PRJ-04: acquisition time of the image on each pixel that is left after masking."""
    return pixels.join(images, key)


def check_row(cells: DataFrame, latest: DataFrame, gaps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG-03: dates used, clear share, gap-fill count and area per run."""
    k = list(keys)
    days = cells.select(*k, "day").distinct().groupBy(*k).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("day")), lambda d: d.cast("string")), ",").alias("days"))
    clear = latest.groupBy(*k).agg(F.round(F.avg(F.when(F.col("day_used").isNull(), 0.0).otherwise(1.0)), 4).alias("clear_frac"))
    g = gaps.groupBy(*k).agg(F.count("*").alias("gap_filled"), F.round(F.sum("area_km2"), 4).alias("gap_area"))
    return (days.join(clear, k).join(g, k, "left")
            .select(*k, "days", "clear_frac", F.coalesce("gap_filled", F.lit(0)).alias("gap_filled"), F.coalesce("gap_area", F.lit(0.0)).alias("gap_area")))
