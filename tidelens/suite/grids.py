"""Daily grids, pixels, connected groups, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import geo as G
from tidelens.operators import grid as GR
from tidelens.operators import spatial as SP
from tidelens.operators.quantiles import group_median
from tidelens.plans import scheduled as SCH
from tidelens.session import durable_checkpoint
from tidelens.sources import payloads as P
from tidelens.suite.registry import query

WINDOW = S.GRID_WINDOW
REACH = WINDOW // 2
FULL = """
    ext AS (SELECT scene, min("row") AS r0, max("row") AS r1, min(col) AS c0, max(col) AS c1 FROM cells_v GROUP BY 1),
    grid AS (SELECT scene, day, CAST(unnest(range(r0, r1 + 1)) AS INT) AS "row", c0, c1 FROM ext JOIN (SELECT DISTINCT scene, day FROM cells_v) USING (scene)),
    full_ AS (SELECT g.scene, g.day, g."row", g.col, c.value FROM (SELECT scene, day, "row", CAST(unnest(range(c0, c1 + 1)) AS INT) AS col FROM grid) g
      LEFT JOIN cells_v c ON c.scene = g.scene AND c.day = g.day AND c."row" = g."row" AND c.col = g.col),
    filled AS (SELECT f.*, coalesce(value, mid) AS v FROM full_ f JOIN (SELECT scene, day, median(value) AS mid FROM full_ GROUP BY 1, 2) USING (scene, day))"""
# reflected neighbour: the places repeat every two lengths, the second length backwards
BG = f"""
    off AS (SELECT a, b FROM (SELECT unnest(range(-{REACH}, {REACH + 1})) AS a), (SELECT unnest(range(-{REACH}, {REACH + 1})) AS b)),
    turn AS (SELECT f.scene, f.day, f."row", f.col, r0, c0, r1 - r0 + 1 AS nr, c1 - c0 + 1 AS nc,
        ((f."row" - r0 + a) % (2 * (r1 - r0 + 1)) + 2 * (r1 - r0 + 1)) % (2 * (r1 - r0 + 1)) AS y, ((f.col - c0 + b) % (2 * (c1 - c0 + 1)) + 2 * (c1 - c0 + 1)) % (2 * (c1 - c0 + 1)) AS x
      FROM filled f JOIN ext USING (scene), off),
    nb AS (SELECT scene, day, "row", col, r0 + CASE WHEN y >= nr THEN 2 * nr - 1 - y ELSE y END AS nr, c0 + CASE WHEN x >= nc THEN 2 * nc - 1 - x ELSE x END AS nc FROM turn),
    bg AS (SELECT nb.scene, nb.day, nb."row", nb.col, median(x.v) AS background FROM nb JOIN filled x
      ON x.scene = nb.scene AND x.day = nb.day AND x."row" = nb.nr AND x.col = nb.nc GROUP BY ALL)"""
FLAGS = """
    cloudy AS (SELECT DISTINCT f.scene, f.day, f."row" + a AS "row", f.col + b AS col FROM full_ f, off WHERE value IS NULL AND abs(a) + abs(b) <= 2),
    flags AS (SELECT f.scene, f.day, f."row", f.col, f.value, CASE WHEN f.value IS NULL THEN 0.0 ELSE f.value - background END AS anomaly,
        f.value IS NOT NULL AND c.scene IS NULL AND f.value < 0.0039 AS clear
      FROM filled f JOIN bg USING (scene, day, "row", col) LEFT JOIN cloudy c ON c.scene = f.scene AND c.day = f.day AND c."row" = f."row" AND c.col = f.col),
    fl AS (SELECT *, clear AND anomaly > 0.001 AS flagged FROM flags)"""
LATEST = """
    lc AS (SELECT scene, "row", col, max(CASE WHEN clear THEN day END) AS day_used FROM fl GROUP BY 1, 2, 3),
    latest AS (SELECT l.scene, l."row", l.col, coalesce(f.flagged, FALSE) AS flagged, coalesce(f.anomaly, 0.0) AS anomaly, day_used
      FROM lc l LEFT JOIN fl f ON f.scene = l.scene AND f."row" = l."row" AND f.col = l.col AND f.day = l.day_used)"""


def flags(v):
    return GR.flag_cells(v.full_cells, ["scene", "day"], WINDOW)


@query("agg_24_local_median", f"""
    WITH {FULL}, {BG} SELECT scene, day, "row", col, round(background, 7) AS background FROM bg""", "cells_v")
def local_median(v):
    full = v.full_cells
    mid = group_median(full, ["scene", "day"], "value", "_mid", bin_width=0.0005)
    filled = full.join(mid, ["scene", "day"]).withColumn("filled", F.coalesce("value", "_mid"))
    return GR.local_median(filled, ["scene", "day"], WINDOW, extent_of=full).withColumn("background", F.round("background", 7))


@query("agg_24_field_median", """
    SELECT scene, day, round(median(value), 7) AS mid FROM cells_v WHERE value IS NOT NULL GROUP BY 1, 2""", "cells_v")
def field_median(v):
    return group_median(v.cells, ["scene", "day"], "value", "mid", bin_width=0.0005).withColumn("mid", F.round("mid", 7))


@query("prj_08_flagged_cells", f"""
    WITH {FULL}, {BG}, {FLAGS} SELECT scene, day, "row", col, round(anomaly, 7) + 0.0 AS anomaly, clear, flagged FROM fl""", "cells_v")
def flagged_cells(v):
    return flags(v).select("scene", "day", "row", "col", (F.round("anomaly", 7) + F.lit(0.0)).alias("anomaly"), "clear", "flagged")


@query("win_04_dilation", """
    SELECT DISTINCT scene, day, "row" + a AS "row", col + b AS col FROM cells_v, (SELECT unnest([-2, -1, 0, 1, 2]) AS a), (SELECT unnest([-2, -1, 0, 1, 2]) AS b)
    WHERE value IS NULL AND abs(a) + abs(b) <= 2""", "cells_v")
def dilation(v):
    return GR.dilate(v.cells.where("value is null"), ["scene", "day"], 2)


@query("jon_27_neighbour_mean", """
    SELECT c.scene, c.day, c."row", c.col, count(n.value) AS n, round(avg(n.value), 10) AS mean FROM cells_v c JOIN cells_v n ON n.scene = c.scene AND n.day = c.day
    AND abs(n."row" - c."row") <= 1 AND abs(n.col - c.col) <= 1 AND (n."row" <> c."row" OR n.col <> c.col) GROUP BY ALL""", "cells_v")
def neighbour_mean(v):
    near = GR.neighbours(v.cells, GR.offsets(1, centre=False))
    at = ["scene", "day", "row", "col"]
    return v.cells.select(*at).join(near, at).groupBy(*at).agg(F.count("value").alias("n"), F.round(F.avg("value"), 10).alias("mean"))


@query("win_03_latest_clear", f"""
    WITH {FULL}, {BG}, {FLAGS}, {LATEST} SELECT scene, "row", col, flagged, round(anomaly, 7) + 0.0 AS anomaly, day_used FROM latest""", "cells_v")
def latest_clear(v):
    return GR.latest_clear(flags(v), ["scene"], "day").withColumn("anomaly", F.round("anomaly", 7) + F.lit(0.0))


@query("win_15_grid_step", """
    SELECT scene, round(coalesce(median(g), 0.015), 6) AS step FROM (SELECT scene, lat - lag(lat) OVER (PARTITION BY scene ORDER BY lat) AS g FROM (
      SELECT DISTINCT scene, round(17.5 + "row" * 0.015, 6) AS lat FROM cells_v)) GROUP BY scene""", "cells_v")
def grid_step(v):
    axis = v.cells.select("scene", F.round(F.lit(17.5) + F.col("row") * 0.015, 6).alias("lat"))
    return GR.grid_step(axis, ["scene"], "lat", "step").withColumn("step", F.round("step", 6))


def latest_views(v):
    """Read by several jobs of a query, so it is kept."""
    return durable_checkpoint(GR.latest_clear(flags(v), ["scene"], "day"))


def groups(latest, tile=5):
    cells = latest.where("flagged")
    return cells, GR.components(cells.select("scene", "row", "col"), ["scene"], tile=tile)


# components: lowest cell number reachable, by recursion over neighbour steps
COMP = f"""
    fc AS (SELECT scene, "row", col, anomaly, day_used, "row" * 1000 + col AS k FROM latest WHERE flagged),
    reach AS (SELECT scene, "row", col, k FROM fc UNION
      SELECT f.scene, f."row", f.col, r.k FROM reach r JOIN fc f ON f.scene = r.scene AND abs(f."row" - r."row") <= 1 AND abs(f.col - r.col) <= 1),
    comp AS (SELECT scene, "row", col, min(k) AS k FROM reach GROUP BY 1, 2, 3)"""


@query("win_16_connected_groups", f"""
    WITH RECURSIVE {FULL}, {BG}, {FLAGS}, {LATEST}, {COMP} SELECT scene, "row", col, k FROM comp""", "cells_v")
def connected_groups(v):
    _, lab = groups(latest_views(v))
    first = lab.groupBy("scene", "label").agg(F.min(F.col("row") * 1000 + F.col("col")).alias("k"))
    return lab.join(first, ["scene", "label"]).select("scene", "row", "col", "k")


def cluster_cells(latest):
    cells, lab = groups(latest)
    both = cells.join(lab, ["scene", "row", "col"])
    return both.select("scene", "label", "anomaly", "day_used", "row", "col", (F.lit(17.5) + F.col("row") * 0.015).alias("lat"),
                       (F.lit(-72.0) + F.col("col") * 0.015).alias("lon"), F.lit(0.015).alias("dlat"), F.lit(0.015).alias("dlon"))


CLUSTERS = """
    cl AS (SELECT scene, k, avg(17.5 + "row" * 0.015) AS clat, avg(-72.0 + col * 0.015) AS clon,
      sum(0.015 * 111.32 * 0.015 * 111.32 * cos(radians(17.5 + "row" * 0.015)) * least(1.0, greatest(0.0, anomaly / 0.0869))) AS area, count(*) AS n_cells, max(day_used) AS last_day
      FROM comp JOIN fc USING (scene, "row", col) GROUP BY scene, comp.k HAVING count(*) >= 2)"""


@query("agg_04_clusters", f"""
    WITH RECURSIVE {FULL}, {BG}, {FLAGS}, {LATEST}, {COMP}, {CLUSTERS.replace('SELECT scene, k,', 'SELECT scene, comp.k AS k,')}
    SELECT scene, round(clat, 10) AS centroid_lat, round(clon, 10) AS centroid_lon, round(area, 6) AS area_km2, n_cells, last_day FROM cl""", "cells_v")
def clusters(v):
    c = GR.cluster_stats(cluster_cells(latest_views(v)), ["scene"])
    return c.select("scene", F.round("centroid_lat", 10).alias("centroid_lat"), F.round("centroid_lon", 10).alias("centroid_lon"),
                    F.round("area_km2", 6).alias("area_km2"), "n_cells", "last_day")


@query("geo_05_cluster_hull")
def cluster_hull(v):
    return SP.hull_area_points(cluster_cells(latest_views(v)), ["scene", "label"]).select("scene", "vertices", "geom_wkt")


@query("agg_03_check_row", f"""
    WITH RECURSIVE {FULL}, {BG}, {FLAGS}, {LATEST}, {COMP}, {CLUSTERS.replace('SELECT scene, k,', 'SELECT scene, comp.k AS k,')},
    d AS (SELECT scene, string_agg(day, ',' ORDER BY day) AS days FROM (SELECT DISTINCT scene, day FROM cells_v) GROUP BY 1),
    q AS (SELECT scene, round(avg(CASE WHEN day_used IS NULL THEN 0.0 ELSE 1.0 END), 4) AS clear_frac FROM latest GROUP BY 1),
    g AS (SELECT scene, count(*) AS gap_filled, round(sum(area), 4) AS gap_area FROM cl GROUP BY 1)
    SELECT scene, days, clear_frac, coalesce(gap_filled, 0) AS gap_filled, coalesce(gap_area, 0.0) AS gap_area FROM d JOIN q USING (scene) LEFT JOIN g USING (scene)""", "cells_v")
def check_row(v):
    latest = latest_views(v)
    return GR.check_row(v.cells, latest, GR.cluster_stats(cluster_cells(latest), ["scene"]), ["scene"])


PIX = """
    px AS (SELECT (l_orderkey * 10 + l_linenumber) * 1000000 + l_partkey AS pid, CAST(l_suppkey AS INT) AS scene, CAST(l_partkey % 12 AS INT) AS "row", CAST(l_orderkey % 12 AS INT) AS col, l_shipdate AS t,
      500.0 + l_quantity * 10 AS red, 500.0 + l_quantity * 12 + l_discount * 5000 AS nir, 480.0 + l_tax * 1000 AS swir, CAST((l_orderkey + l_linenumber) % 12 AS INT) AS scl,
      CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE (l_orderkey % 100) / 100.0 END AS cs FROM lineitem),
    ix AS (SELECT *, nir / 10000 - (red / 10000 + (swir / 10000 - red / 10000) * ((842.0 - 665.0) / (1610.0 - 665.0))) AS fai, (nir / 10000 - red / 10000) / (nir / 10000 + red / 10000) AS ndvi FROM px),
    ok AS (SELECT * FROM ix WHERE scl NOT IN (0, 1, 3, 8, 9, 10, 11) AND coalesce(cs, 1.0) >= 0.6)"""


def pixels(v):
    o, p, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_linenumber"))
    q = F.col("l_quantity")
    return v.lineitem.select(((o * 10 + n) * 1000000 + p).alias("pid"), F.col("l_suppkey").cast("int").alias("scene"), (p % 12).cast("int").alias("row"), (o % 12).cast("int").alias("col"),
                             F.col("l_shipdate").alias("t"), (F.lit(500.0) + q * 10).alias("red"), (F.lit(500.0) + q * 12 + F.col("l_discount") * 5000).alias("nir"),
                             (F.lit(480.0) + F.col("l_tax") * 1000).alias("swir"), ((o + n) % 12).cast("int").alias("scl"),
                             F.when(p % 4 != 0, (o % 100) / 100.0).alias("cs"))


def indexed(df):
    fai, ndvi = GR.index_pixels(F.col("red"), F.col("nir"), F.col("swir"))
    return df.withColumn("fai", fai).withColumn("ndvi", ndvi)


def masked(df):
    return df.where(GR.usable_pixel(F.col("scl"), F.col("cs")))


@query("prj_01_02_index_and_ndvi", f"""
    WITH {PIX} SELECT pid, round(fai, 7) AS fai, round(ndvi, 7) AS ndvi FROM ix""")
def index_and_ndvi(v):
    return indexed(pixels(v)).select("pid", F.round("fai", 7).alias("fai"), F.round("ndvi", 7).alias("ndvi"))


@query("prj_03_usable_pixels", f"""
    WITH {PIX} SELECT pid, scene FROM ok""")
def usable_pixels(v):
    return masked(pixels(v)).select("pid", "scene")


@query("prj_04_observation_time", f"""
    WITH {PIX} SELECT scene, CAST(epoch_ms(o_orderdate) AS BIGINT) AS obs_ms, count(*) AS n FROM (SELECT *, pid // 10000000 AS image FROM ok) JOIN orders ON o_orderkey = image GROUP BY 1, 2""")
def observation_time(v):
    images = v.table("orders").select(F.col("o_orderkey").alias("image"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("obs_ms"))
    p = masked(pixels(v)).withColumn("image", F.floor(F.col("pid") / 10000000))
    return GR.attach_time(p, images, "image").groupBy("scene", "obs_ms").agg(F.count("*").alias("n"))


@query("udf_01_mapped_functions", f"""
    WITH {PIX} SELECT scene, count(*) AS n, round(avg(fai), 6) AS fai FROM ok GROUP BY scene""")
def mapped_functions(v):
    return pixels(v).transform(masked).transform(indexed).groupBy("scene").agg(F.count("*").alias("n"), F.round(F.avg("fai"), 6).alias("fai"))


@query("src_04_optional_quality", f"""
    WITH {PIX} SELECT pid, coalesce(cs, 1.0) AS cs_cdf FROM px""")
def optional_quality(v):
    p = pixels(v)
    quality = p.where("cs is not null").select("pid", F.col("cs").alias("cs_cdf")).dropDuplicates(["pid"])
    return P.with_quality(p.select("pid"), quality, ["pid"])


@query("win_02_latest_pixel", f"""
    WITH {PIX} SELECT scene, "row", col, round(m.fai, 7) AS fai, CAST(m.t AS VARCHAR) AS t FROM (SELECT scene, "row", col, max(struct_pack(t := t, fai := fai, ndvi := ndvi)) AS m FROM ok GROUP BY 1, 2, 3)""")
def latest_pixel(v):
    m = GR.latest_pixel(indexed(masked(pixels(v))), ["scene", "row", "col"], "t", ["fai", "ndvi"])
    return m.select("scene", "row", "col", F.round("fai", 7).alias("fai"), F.col("t").cast("string").alias("t"))


MOSAIC = f"""
    {PIX}, mos AS (SELECT scene, "row", col, m.fai AS fai, m.ndvi AS ndvi, m.t AS t FROM (SELECT scene, "row", col, max(struct_pack(t := t, fai := fai, ndvi := ndvi)) AS m FROM ok GROUP BY 1, 2, 3)),
    an AS (SELECT a.scene, a."row", a.col, a.fai, a.ndvi, a.t, a.fai - median(b.fai) AS anomaly FROM mos a JOIN mos b ON b.scene = a.scene AND abs(b."row" - a."row") <= 1 AND abs(b.col - a.col) <= 1 GROUP BY a.scene, a."row", a.col, a.fai, a.ndvi, a.t),
    cand AS (SELECT *, (anomaly > 0.005 OR fai > 0.02) AND ndvi > 0.02 AS algae FROM an)"""


def mosaic(v):
    return GR.latest_pixel(indexed(masked(pixels(v))), ["scene", "row", "col"], "t", ["fai", "ndvi"])


def anomalies(v):
    m = durable_checkpoint(mosaic(v))
    at = ["scene", "row", "col"]
    return m.join(GR.focal_median(m, ["scene"], "fai", 1), at).withColumn("anomaly", F.col("fai") - F.col("background")).drop("background")


@query("agg_25_focal_median", f"""
    WITH {MOSAIC} SELECT scene, "row", col, round(anomaly, 6) + 0.0 AS anomaly FROM an""")
def focal_median(v):
    return anomalies(v).select("scene", "row", "col", (F.round("anomaly", 6) + F.lit(0.0)).alias("anomaly"))


def candidates(v):
    return anomalies(v).where(GR.candidate_pixel(F.col("anomaly"), F.col("fai"), F.col("ndvi")))


@query("prj_05_candidate_pixels", f"""
    WITH {MOSAIC} SELECT scene, "row", col FROM cand WHERE algae""")
def candidate_pixels(v):
    return candidates(v).select("scene", "row", "col")


LAND = '((scene * 3 + "row" * 5 + col * 7) % 17 = 0)'


@query("jon_30_ocean_mask", f"""
    WITH {MOSAIC}, land AS (SELECT scene, "row", col FROM mos WHERE {LAND})
    SELECT scene, "row", col FROM cand c WHERE algae AND NOT EXISTS (SELECT 1 FROM land l WHERE l.scene = c.scene AND pow(l."row" - c."row", 2) + pow(l.col - c.col, 2) <= 1.5 * 1.5)""")
def ocean_mask(v):
    land = mosaic(v).where(F.expr("(scene * 3 + row * 5 + col * 7) % 17 = 0")).select("scene", "row", "col")
    return GR.mask_ocean(candidates(v), land, ["scene"], 1.5).select("scene", "row", "col")


PATCH = f"""
    {MOSAIC}, fc AS (SELECT scene, "row", col, anomaly, t, "row" * 1000 + col AS k FROM cand WHERE algae),
    reach AS (SELECT scene, "row", col, k FROM fc UNION SELECT f.scene, f."row", f.col, r.k FROM reach r JOIN fc f ON f.scene = r.scene AND abs(f."row" - r."row") <= 1 AND abs(f.col - r.col) <= 1),
    comp AS (SELECT scene, "row", col, min(k) AS k FROM reach GROUP BY 1, 2, 3),
    patch AS (SELECT scene, comp.k AS k, max(epoch_ms(t)) AS obs_ms, avg(anomaly) AS mean_anomaly, sum(0.0036 * cos(radians(17.5 + "row" * 0.01))) AS area,
      avg(-72.0 + col * 0.01) AS clon, degrees(2 * atan(exp(avg(ln(tan(radians(17.5 + "row" * 0.01) / 2 + pi() / 4))))) - pi() / 2) AS clat, count(*) AS n_cells
      FROM comp JOIN fc USING (scene, "row", col) GROUP BY 1, 2)"""


def patches(v, min_km2=0.006):
    c = durable_checkpoint(candidates(v))
    lab = GR.components(c.select("scene", "row", "col"), ["scene"], tile=5)
    lat = F.lit(17.5) + F.col("row") * 0.01
    cells = c.join(lab, ["scene", "row", "col"]).select("scene", "label", "anomaly", F.unix_millis("t").alias("obs_ms"), lat.alias("lat"),
                                                        (F.lit(-72.0) + F.col("col") * 0.01).alias("lon"), (F.lit(0.0036) * F.cos(F.radians(lat))).alias("cell_area"))
    return GR.patch_stats(cells, ["scene"], min_km2)


@query("agg_05_prj_06_patches", f"""
    WITH RECURSIVE {PATCH} SELECT scene, CAST(obs_ms AS BIGINT) AS obs_ms, round(mean_anomaly, 6) + 0.0 AS mean_anomaly, round(area, 6) AS area_km2, round(clat, 8) AS centroid_lat,
      round(clon, 10) AS centroid_lon, n_cells, round(area * least(1.0, greatest(0.0, mean_anomaly / 0.08)), 7) + 0.0 AS covered_km2 FROM patch WHERE area >= 0.006""")
def patch_reduce(v):
    p = patches(v)
    return p.select("scene", "obs_ms", (F.round("mean_anomaly", 6) + F.lit(0.0)).alias("mean_anomaly"), F.round("area_km2", 6).alias("area_km2"), F.round("centroid_lat", 8).alias("centroid_lat"),
                    F.round("centroid_lon", 10).alias("centroid_lon"), "n_cells", (F.round("covered_km2", 7) + F.lit(0.0)).alias("covered_km2"))


@query("udf_02_combined_reducers", f"""
    WITH RECURSIVE {PATCH} SELECT scene, count(*) AS n, CAST(max(obs_ms) AS BIGINT) AS last_ms, round(avg(mean_anomaly), 6) + 0.0 AS mean_anomaly FROM patch GROUP BY scene""")
def combined_reducers(v):
    return patches(v, 0.0).groupBy("scene").agg(F.count("*").alias("n"), F.max("obs_ms").alias("last_ms"), (F.round(F.avg("mean_anomaly"), 6) + F.lit(0.0)).alias("mean_anomaly"))


@query("prj_07_covered_area", """
    SELECT id, CASE WHEN id % 8 = 0 THEN NULL ELSE round(area_km2 * least(1.0, greatest(0.0, (id % 120 - 10) / 1000.0 / 0.08)), 9) + 0.0 END AS covered FROM detections_v""", "detections_v")
def covered(v):
    text = F.when(F.col("id") % 8 == 0, "bad").otherwise(((F.col("id") % 120 - 10) / 1000.0).cast("string"))
    return v.detections.select("id", (F.round(GR.covered_area(F.col("area_km2"), text), 9) + F.lit(0.0)).alias("covered"))


@query("jon_15_seen_clear", """
    WITH clear AS (SELECT DISTINCT scene, "row" + a AS "row", col + b AS col FROM cells_v, (SELECT unnest([-1, 0, 1]) AS a), (SELECT unnest([-1, 0, 1]) AS b)
      WHERE value IS NOT NULL AND value < 0.0008 AND abs(a) + abs(b) <= 1),
    p AS (SELECT id, CAST(id % (SELECT count(*) FROM supplier) AS INT) AS scene, lat, lon FROM detections_v),
    c AS (SELECT *, least(greatest(ceil(round((lat - 17.5) / 0.2, 6)), 0), 11) AS r, least(greatest(ceil(round((lon + 72.0) / 0.25, 6)), 0), 11) AS q FROM p
      WHERE lat BETWEEN 17.5 AND 17.5 + 11 * 0.2 AND lon BETWEEN -72.0 AND -72.0 + 11 * 0.25)
    SELECT c.scene, id FROM c WHERE EXISTS (SELECT 1 FROM clear k WHERE k.scene = c.scene AND k."row" = c.r AND k.col = c.q)""", "cells_v detections_v")
def seen_clear(v):
    n = v.table("supplier").agg(F.count("*")).scalar()
    pts = v.detections.select("id", (F.col("id") % n).cast("int").alias("scene"), "lat", "lon")
    axes = v.cells.select("scene").distinct().select("scene", F.lit(17.5).alias("lat0"), F.lit(0.2).alias("dlat"), F.lit(12).alias("n_lat"),
                                                     F.lit(-72.0).alias("lon0"), F.lit(0.25).alias("dlon"), F.lit(12).alias("n_lon"))
    return GR.seen_clear(pts, v.cells.where("value < 0.0008"), axes, ["scene"], "id")


@query("src_02_last_steps", """
    SELECT scene, day, count(*) AS n FROM cells_v c WHERE "row" BETWEEN 2 AND 6 AND day IN (SELECT day FROM (SELECT DISTINCT scene, day FROM cells_v) x WHERE x.scene = c.scene ORDER BY day DESC LIMIT 2)
    GROUP BY 1, 2""", "cells_v")
def last_steps(v):
    c = v.cells.withColumn("lat", F.col("row").cast("double")).withColumn("lon", F.lit(0.0))
    box = {"min_lat": 2, "max_lat": 6, "min_lon": 0, "max_lon": 0}
    return P.last_steps(c, "day", 2, box, ("scene",)).groupBy("scene", "day").agg(F.count("*").alias("n"))


@query("src_01_grid_payload", """
    SELECT scene, CAST(DATE '2024-01-01' + day AS VARCHAR) AS day, dense_rank() OVER (PARTITION BY scene ORDER BY "row") - 1 AS row_idx, dense_rank() OVER (PARTITION BY scene ORDER BY col) - 1 AS col_idx,
      value FROM cells_v""", "cells_v")
def grid_payload(v):
    fmt = lambda c: c.cast("string")
    day = F.concat(F.lit("2024-01-0"), (F.col("day") + 1).cast("string"), F.lit("T12:00:00Z"))
    row = F.array(day, fmt(F.lit(17.5) + F.col("row") * 0.25), fmt(F.lit(-72.0) + F.col("col") * 0.25), fmt(F.col("value")))
    # one payload per (scene, day, row): a few cells each
    table = v.cells.groupBy("scene", "day", "row").agg(F.collect_list(row).alias("rows")).select(
        "scene", F.to_json(F.struct(F.struct(F.array(*[F.lit(x) for x in ("time", "latitude", "longitude", "AFAI")]).alias("columnNames"), "rows").alias("table")),
                           {"ignoreNullFields": "false"}).alias("body"))
    cells = P.grid_payload(table, keep=("scene",))
    idx = P.index_axis(P.index_axis(cells, "lat", "row_idx", ("scene",)), "lon", "col_idx", ("scene",))
    return idx.select("scene", F.col("day").cast("string").alias("day"), F.col("row_idx").cast("bigint").alias("row_idx"), F.col("col_idx").cast("bigint").alias("col_idx"), "value")


@query("src_03_scene_catalogue", """
    SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS time FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_orderdate < TIMESTAMP '1998-01-01' AND (o_orderkey * 7) % 100 <= 60
    AND 17 + (o_custkey % 8) >= 17.3 AND 16 + (o_custkey % 8) <= 21.5 AND -72.5 + (o_custkey % 9) >= -72.1 AND -73.5 + (o_custkey % 9) <= -67.3""")
def scene_catalogue(v):
    c = F.col("o_custkey")
    images = v.table("orders").select("o_orderkey", F.col("o_orderdate").cast("timestamp").alias("time"), ((F.col("o_orderkey") * 7) % 100).alias("cloud_pct"),
                                      (F.lit(16.0) + c % 8).alias("min_lat"), (F.lit(17.0) + c % 8).alias("max_lat"), (F.lit(-73.5) + c % 9).alias("min_lon"), (F.lit(-72.5) + c % 9).alias("max_lon"))
    box = {"min_lat": 17.3, "max_lat": 21.5, "min_lon": -72.1, "max_lon": -67.3}
    return P.scenes(images, box, "1997-01-01", "1998-01-01").select("o_orderkey", F.col("time").cast("string").alias("time"))


@query("src_05_surface_currents", """
    SELECT t, la, lo, round(coalesce(m.u, 0.0), 5) AS u FROM (SELECT l_linenumber AS t, l_partkey % 40 AS la, l_suppkey % 30 AS lo,
      min(struct_pack(p := l_orderkey % 2, d := l_quantity, o := l_orderkey, u := CASE WHEN l_tax = 0 THEN NULL ELSE l_discount END)) AS m FROM lineitem GROUP BY 1, 2, 3)""")
def currents(v):
    x = v.lineitem.select(F.col("l_linenumber").alias("time"), (F.col("l_partkey") % 40).alias("lat"), (F.col("l_suppkey") % 30).alias("lon"),
                          F.struct("l_quantity", "l_orderkey", F.when(F.col("l_tax") != 0, F.col("l_discount"))).alias("depth"), (F.col("l_orderkey") % 2).alias("product_rank"),
                          F.when(F.col("l_tax") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("u"), F.lit(0.0).alias("v"))
    return P.surface_currents(x).select(F.col("time").alias("t"), F.col("lat").alias("la"), F.col("lon").alias("lo"), F.round("u", 5).alias("u"))


@query("src_06_wind_payload", """
    SELECT beach_id, h, round(-s * sin(radians(d)), 4) + 0.0 AS u, round(-s * cos(radians(d)), 4) + 0.0 AS v FROM (
      SELECT beach_id, h, (beach_id * 3 + h) % 20 * 0.5 AS s, (beach_id * 17 + h * 30) % 360 AS d FROM beaches_v, (SELECT unnest([0, 1, 2, 3]) AS h)) WHERE (beach_id + h) % 6 <> 0""", "beaches_v")
def wind_payload(v):
    b = F.col("beach_id")
    hours = F.array(*[F.lit(h) for h in range(4)])
    doc = F.struct(F.col("beach_id").cast("double").alias("latitude"), F.lit(0.0).alias("longitude"), F.struct(F.lit("m/s").alias("windspeed_10m")).alias("hourly_units"), F.struct(
        F.transform(hours, lambda h: F.concat(F.lit("2024-01-01T0"), h.cast("string"), F.lit(":00"))).alias("time"),
        F.transform(hours, lambda h: F.when((b + h) % 6 != 0, (b * 3 + h) % 20 * 0.5)).alias("windspeed_10m"),
        F.transform(hours, lambda h: ((b * 17 + h * 30) % 360).cast("double")).alias("winddirection_10m")).alias("hourly"))
    w = P.wind_payload(v.beaches.select(F.to_json(doc, {"ignoreNullFields": "false"}).alias("body")))
    return w.select(F.col("lat").cast("bigint").alias("beach_id"), F.hour("time").alias("h"), (F.round("u", 4) + F.lit(0.0)).alias("u"), (F.round("v", 4) + F.lit(0.0)).alias("v"))


@query("prj_09_risk_area", """
    SELECT id, round(CASE id % 4 WHEN 0 THEN area_km2 * 0.5 WHEN 3 THEN 0.0 ELSE area_km2 END, 6) AS area FROM detections_v""", "detections_v")
def risk_area(v):
    from tidelens.functions.risk import risk_area as ra

    k, a = F.col("id") % 4, F.col("area_km2")
    preferred = F.when(k == 0, (a * 0.5).cast("string")).when(k == 1, "NaN").when(k == 2, "bad")
    outline = F.when(k != 3, a.cast("string")).otherwise("NaN")
    return v.detections.select("id", F.round(ra(preferred, outline), 6).alias("area"))


@query("prj_10_observed_time", """
    SELECT id, CAST(CASE WHEN id % 3 = 0 THEN TIMESTAMP '2024-01-20 00:00:00' ELSE least(date_trunc('second', observed_at), TIMESTAMP '2024-01-20 00:00:00') END AS VARCHAR) AS at FROM detections_v""", "detections_v")
def observed_time(v):
    from tidelens.functions.risk import observed_or_now

    text = F.when(F.col("id") % 3 == 0, "?").otherwise(F.concat(F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")))
    return v.detections.select("id", observed_or_now(text, F.lit("2024-01-20 00:00:00").cast("timestamp")).cast("string").alias("at"))


@query("prj_11_fresh_patches", """
    SELECT id FROM detections_v WHERE observed_at >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 8 DAY""", "detections_v")
def fresh_patches(v):
    return SCH.fresh_patches(v.detections, F.lit("2024-01-30 00:00:00").cast("timestamp")).select("id")


@query("set_01_merged_patches", """
    SELECT source, count(*) AS n, count(covered) AS with_cover, round(sum(area_km2), 4) AS area FROM (
      SELECT source, area_km2, area_km2 / 2 AS covered FROM detections_v WHERE source <> 'view' UNION ALL SELECT source, area_km2, NULL FROM detections_v WHERE source = 'view') GROUP BY source""", "detections_v")
def merged_patches(v):
    a = v.detections.where("source <> 'view'").select("source", "area_km2", (F.col("area_km2") / 2).alias("covered"))
    b = v.detections.where("source = 'view'").select("area_km2", "source")
    return SCH.merge_patches(a, b).groupBy("source").agg(F.count("*").alias("n"), F.count("covered").alias("with_cover"), F.round(F.sum("area_km2"), 4).alias("area"))
