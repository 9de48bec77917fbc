"""Distances, radius and nearest joins, polygons, interpolation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelens.functions import geo as G
from tidelens.functions import risk as R
from tidelens.operators import ensemble as E
from tidelens.operators import grid as GR
from tidelens.operators import spatial as SP
from tidelens.operators.cover import points_in_polygon
from tidelens.operators.keyed import latest
from tidelens.sources import payloads as P
from tidelens.suite.registry import query
from tidelens.suite.sqlbits import current, hav, planar, zone_level

def beach_side(v):
    return v.beaches.select("beach_id", F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))


@query("agg_01_zone_state", f"""
    SELECT CAST(run_at AS VARCHAR) AS run_at, zone_id, round(sum(area_km2), 6) AS eez_area_km2,
           round(sum(CASE WHEN d <= 200 THEN area_km2 ELSE 0 END), 6) AS zone_area_km2,
           round(min(d), 4) AS nearest_km, count(*) AS patch_count
    FROM (SELECT run_at, zone_id, area_km2, {hav('center_lat', 'center_lon', 'lat', 'lon')} AS d FROM detections_v, zones_v)
    GROUP BY run_at, zone_id""", "zones_v detections_v")
def zone_state(v):
    s = SP.zone_state(v.detections, v.zones, v.detections.select("run_at"))
    return s.select(F.col("run_at").cast("string").alias("run_at"), "zone_id", F.round("eez_area_km2", 6).alias("eez_area_km2"),
                    F.round("zone_area_km2", 6).alias("zone_area_km2"), F.round("nearest_km", 4).alias("nearest_km"), "patch_count")


@query("geo_02_haversine", f"""
    SELECT id, round({hav('lat', 'lon', '18.58', '-68.37')}, 5) AS km FROM detections_v""", "detections_v")
def haversine(v):
    d = G.haversine_km(F.col("lat"), F.col("lon"), F.lit(18.58), F.lit(-68.37))
    return v.detections.select("id", F.round(d, 5).alias("km"))


@query("geo_03_planar_and_cell_area", f"""
    SELECT id, round(lon * {G.KM_X!r}, 4) AS x, round(lat * {G.KM_Y!r}, 4) AS y,
           round(0.015 * 111.32 * 0.015 * 111.32 * cos(radians(lat)), 6) AS cell_km2 FROM detections_v""", "detections_v")
def planar_xy(v):
    x, y = G.planar_km(F.col("lat"), F.col("lon"))
    return v.detections.select("id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"),
                               F.round(G.cell_km2(F.col("lat"), 0.015, 0.015), 6).alias("cell_km2"))


@query("geo_04_box_polygon", """
    SELECT beach_id, 'POLYGON((' || printf('%.4f %.4f', longitude - 0.35, latitude - 0.35) || ', ' ||
           printf('%.4f %.4f', longitude + 0.35, latitude - 0.35) || ', ' || printf('%.4f %.4f', longitude + 0.35, latitude + 0.35) || ', ' ||
           printf('%.4f %.4f', longitude - 0.35, latitude + 0.35) || ', ' || printf('%.4f %.4f', longitude - 0.35, latitude - 0.35) || '))' AS wkt
    FROM beaches_v""", "beaches_v")
def box_polygon(v):
    return v.beaches.select("beach_id", G.box_wkt(F.col("latitude"), F.col("longitude")).alias("wkt"))


@query("geo_01_parse_point", """
    SELECT id, round(CASE WHEN id % 5 <= 3 THEN lat END, 5) AS p_lat, round(CASE WHEN id % 5 <= 3 THEN lon END, 5) AS p_lon
    FROM detections_v""", "detections_v")
def parse_point(v):
    k, lat, lon = F.col("id"), F.col("lat").cast("string"), F.col("lon").cast("string")
    body = F.concat(lon, F.lit(" "), lat)
    text = (F.when(k % 5 == 0, F.concat(F.lit('{"type":"Point","coordinates":['), lon, F.lit(","), lat, F.lit("]}")))
            .when(k % 5 == 1, F.concat(F.lit("POINT("), body, F.lit(")")))
            .when(k % 5 == 2, F.concat(F.lit("SRID=4326;POINT("), body, F.lit(")")))
            .when(k % 5 == 3, F.concat(F.lit(" point ("), body, F.lit(")")))
            .otherwise(F.concat(F.lit("LINESTRING("), body, F.lit(")"))))
    p = G.parse_point(text)
    return v.detections.select("id", F.round(p["lat"], 5).alias("p_lat"), F.round(p["lon"], 5).alias("p_lon"))


@query("geo_07_point_view", """
    SELECT CAST(run_at AS VARCHAR) AS run_at, id, lat, lon, area_km2, source FROM detections_v
    WHERE run_at = (SELECT max(run_at) FROM detections_v)""", "detections_v")
def point_view(v):
    return latest(v.detections, [], "run_at").select(F.col("run_at").cast("string").alias("run_at"), "id", "lat", "lon", "area_km2", "source")


@query("geo_08_patch_centroid", """
    SELECT CAST(run_at AS VARCHAR) AS run_at, source, round(avg(lon), 10) AS centroid_lon,
           round(degrees(2 * atan(exp(avg(ln(tan(radians(lat) / 2 + pi() / 4))))) - pi() / 2), 8) AS centroid_lat
    FROM detections_v GROUP BY 1, 2""", "detections_v")
def patch_centroid(v):
    y = F.avg(G.mercator_y(F.col("lat")))
    return v.detections.groupBy(F.col("run_at").cast("string").alias("run_at"), "source").agg(
        F.round(F.avg("lon"), 10).alias("centroid_lon"), F.round(G.mercator_lat(y), 8).alias("centroid_lat"))


@query("jon_02_pair_distances", f"""
    SELECT id, beach_id, round(d, 4) AS km FROM (SELECT id, beach_id, {hav('lat', 'lon', 'latitude', 'longitude')} AS d
    FROM detections_v, beaches_v) WHERE d <= 25""", "detections_v beaches_v")
def pair_distances(v):
    return SP.pair_distances(v.detections.select("id", "lat", "lon"), beach_side(v), 25.0).select(
        "id", "beach_id", G.rounded(F.col("dist"), 4).alias("km"))


@query("jon_03_nearest_zone", f"""
    SELECT id, zone_id, round(d, 4) AS km FROM (SELECT id, zone_id, d, row_number() OVER (PARTITION BY id ORDER BY d, zone_id) AS rn
    FROM (SELECT id, zone_id, {hav('lat', 'lon', 'center_lat', 'center_lon')} AS d FROM detections_v, zones_v)) WHERE rn = 1""",
       "detections_v zones_v")
def nearest_zone(v):
    n = SP.nearest(v.detections, v.zones, "zone_id", ("center_lat", "center_lon"))
    return n.select("id", F.col("near.id").alias("zone_id"), F.round("near.dist", 4).alias("km"))


@query("jon_03_nearest_beach_unbounded", f"""
    SELECT id, beach_id, round(d, 4) AS km FROM (SELECT id, beach_id, d, row_number() OVER (PARTITION BY id ORDER BY d, beach_id) AS rn
    FROM (SELECT id, beach_id, {hav('lat', 'lon', 'latitude', 'longitude')} AS d FROM detections_v, beaches_v)) WHERE rn = 1""",
       "detections_v beaches_v")
def nearest_beach(v):
    """A place table as long as the points'."""
    n = SP.nearest(v.detections.select("id", "lat", "lon"), v.beaches, "beach_id", ("latitude", "longitude"))
    return n.select("id", F.col("near.id").alias("beach_id"), F.round("near.dist", 4).alias("km"))


@query("jon_04_radius_counts", f"""
    SELECT CAST(run_at AS VARCHAR) AS run_at, beach_id, count(*) AS masses, round(min(d), 4) AS nearest
    FROM (SELECT run_at, beach_id, {hav('lat', 'lon', 'latitude', 'longitude')} AS d FROM detections_v, beaches_v)
    WHERE d <= 15 GROUP BY 1, 2""", "detections_v beaches_v")
def radius_counts(v):
    c = SP.radius_counts(v.detections.select("run_at", "lat", "lon"), beach_side(v), "beach_id", 15.0, "run_at")
    return c.select(F.col("run_at").cast("string").alias("run_at"), "beach_id", F.col("n").alias("masses"), F.round("near_km", 4).alias("nearest"))


@query("jon_05_owner_zone", f"""
    SELECT beach_id, CASE WHEN d <= 40 THEN zone_id END AS owner FROM (
      SELECT beach_id, zone_id, d, row_number() OVER (PARTITION BY beach_id ORDER BY d, zone_id) AS rn
      FROM (SELECT beach_id, zone_id, {planar('latitude', 'longitude', 'center_lat', 'center_lon')} AS d FROM beaches_v, zones_v)) WHERE rn = 1""",
       "beaches_v zones_v")
def owner_zone(v):
    n = SP.nearest(v.beaches, v.zones, "zone_id", ("center_lat", "center_lon"), ("latitude", "longitude"), planar=True)
    return n.select("beach_id", F.when(F.col("near.dist") <= 40, F.col("near.id")).alias("owner"))


SHAPES = """
    shapes AS (SELECT beach_id AS shape, x1, y1, x2, y2 FROM (
      SELECT beach_id, unnest([longitude - 0.3, longitude + 0.4, longitude + 0.2, longitude + 0.05]) AS x1,
             unnest([latitude - 0.2, latitude - 0.1, latitude + 0.25, latitude + 0.02]) AS y1,
             unnest([longitude + 0.4, longitude + 0.2, longitude + 0.05, longitude - 0.3]) AS x2,
             unnest([latitude - 0.1, latitude + 0.25, latitude + 0.02, latitude - 0.2]) AS y2 FROM beaches_v))"""


def shape_edges(v):
    """Four-cornered (one corner folded in) shapes around the beaches."""
    xs, ys = (-0.3, 0.4, 0.2, 0.05), (-0.2, -0.1, 0.25, 0.02)
    off = lambda c, d: F.col(c) + F.lit(d) if d >= 0 else F.col(c) - F.lit(-d)
    edge = lambda i, j: F.struct(off("longitude", xs[i]).alias("x1"), off("latitude", ys[i]).alias("y1"),
                                 off("longitude", xs[j]).alias("x2"), off("latitude", ys[j]).alias("y2"))
    return v.beaches.select(F.col("beach_id").alias("shape"), F.explode(F.array(*[edge(i, (i + 1) % 4) for i in range(4)])).alias("e")).select("shape", "e.*")


@query("jon_11_point_in_polygon", f"""
    WITH {SHAPES} SELECT id, shape FROM detections_v, shapes
    WHERE y1 <> y2 AND least(y1, y2) <= lat AND lat < greatest(y1, y2) AND x1 + (lat - y1) * (x2 - x1) / (y2 - y1) > lon
    GROUP BY id, shape HAVING count(*) % 2 = 1""", "detections_v beaches_v")
def point_in_polygon(v):
    return points_in_polygon(v.detections.select("id", "lat", "lon"), shape_edges(v), "shape")


@query("jon_12_nearest_coast_point", f"""
    WITH {SHAPES}, coast AS (SELECT shape, x1 AS lon, y1 AS lat FROM shapes)
    SELECT id, shape AS owner, round(d, 4) AS km FROM (SELECT id, shape, d, row_number() OVER (PARTITION BY id ORDER BY d, shape) AS rn
      FROM (SELECT id, shape, {planar('s.lat', 's.lon', 'c.lat', 'c.lon')} AS d FROM detections_v s, coast c)  WHERE d <= 3) WHERE rn = 1""",
       "detections_v beaches_v")
def nearest_coast(v):
    coast = shape_edges(v).select(F.col("shape").alias("owner"), F.col("y1").alias("p_lat"), F.col("x1").alias("p_lon"))
    near = SP.radius_join(v.detections.select("id", "lat", "lon"), coast, 3.0, planar=True)
    return near.groupBy("id").agg(F.min(F.struct("dist", "owner")).alias("m")).select(
        "id", "m.owner", F.round("m.dist", 4).alias("km"))


def weekly(v):
    return v.detections.select(F.date_trunc("week", "run_at").alias("run_at"), "id", "lat", "lon", "source")


@query("jon_13_has_match", f"""
    WITH weekly AS (SELECT date_trunc('week', run_at) AS run_at, id, lat, lon, source FROM detections_v)
    SELECT DISTINCT a.id FROM weekly a JOIN weekly b ON a.run_at = b.run_at AND a.source = 'click' AND b.source = 'purchase'
    AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 15""", "detections_v")
def has_match(v):
    d = weekly(v)
    return SP.within(d.where("source = 'click'"), d.where("source = 'purchase'"), 15.0, "id", on=["run_at"]).select("id")


@query("jon_14_unmatched", f"""
    WITH weekly AS (SELECT date_trunc('week', run_at) AS run_at, id, lat, lon, source FROM detections_v)
    SELECT id FROM weekly a WHERE source = 'purchase' AND NOT EXISTS (SELECT 1 FROM weekly b
    WHERE b.run_at = a.run_at AND b.source = 'click' AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 15)""", "detections_v")
def unmatched(v):
    d = weekly(v)
    hit = SP.within(d.where("source = 'purchase'"), d.where("source = 'click'"), 15.0, "id", on=["run_at"])
    return d.where("source = 'purchase'").join(hit, ["run_at", "id"], "left_anti").select("id")


@query("agg_02_agreement", f"""
    WITH weekly AS (SELECT date_trunc('week', run_at) AS run_at, id, lat, lon, source FROM detections_v),
    a AS (SELECT * FROM weekly WHERE source = 'click'), b AS (SELECT * FROM weekly WHERE source = 'purchase'),
    ah AS (SELECT a.*, EXISTS (SELECT 1 FROM b WHERE b.run_at = a.run_at AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 15) AS hit FROM a),
    bh AS (SELECT b.*, EXISTS (SELECT 1 FROM a WHERE a.run_at = b.run_at AND {hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= 15) AS hit FROM b)
    SELECT CAST(coalesce(x.run_at, y.run_at) AS VARCHAR) AS run_at, coalesce(patches, 0) AS patches, coalesce(checkable, 0) AS checkable,
           coalesce(confirmed, 0) AS confirmed, coalesce(clusters, 0) AS clusters, coalesce(matched, 0) AS matched
    FROM (SELECT run_at, count(*) AS patches, count(*) FILTER (id % 2 = 0) AS checkable, count(*) FILTER (id % 2 = 0 AND hit) AS confirmed
          FROM ah GROUP BY 1) x FULL JOIN (SELECT run_at, count(*) AS clusters, count(*) FILTER (hit) AS matched FROM bh GROUP BY 1) y
    ON x.run_at = y.run_at""", "detections_v")
def agreement(v):
    d = weekly(v)
    a, b = d.where("source = 'click'").drop("source"), d.where("source = 'purchase'").drop("source")
    summary, _ = GR.agreement(a, b, a.where("id % 2 = 0").select("run_at", "id"), ["run_at"])
    return summary.withColumn("run_at", F.col("run_at").cast("string"))


@query("agg_19_beach_state", f"""
    WITH near AS (SELECT run_at, beach_id, id, d, area_km2 * pow(greatest(0.0, 1 - d / 25.0), 2) AS w FROM (
      SELECT run_at, beach_id, id, area_km2, {hav('lat', 'lon', 'latitude', 'longitude')} AS d FROM detections_v, beaches_v) WHERE d <= 25),
    cum AS (SELECT *, sum(w) OVER (PARTITION BY run_at, beach_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS c FROM near),
    g AS (SELECT run_at, beach_id, sum(w) AS weighted, min(d) AS nearest, min(CASE WHEN c >= 3.0 THEN d END) AS sig, arg_min(id, d) AS nearest_id
          FROM cum GROUP BY 1, 2)
    SELECT CAST(run_at AS VARCHAR) AS run_at, beach_id, round(weighted, 5) AS weighted_km2, round(nearest, 4) AS nearest_km, nearest_id,
           round(sig, 4) AS significant_km,
           CASE WHEN weighted < 0.3 THEN 'none' WHEN weighted >= 3.0 AND sig <= 8 THEN 'high' WHEN weighted >= 12 THEN 'high'
                WHEN weighted >= 3.0 THEN 'medium' ELSE 'low' END AS risk_level FROM g""", "detections_v beaches_v")
def beach_state(v):
    s = E.beach_state(v.detections, v.beaches, ["run_at"], "beach_id", "id")
    return s.select(F.col("run_at").cast("string").alias("run_at"), "beach_id", F.round("weighted_km2", 5).alias("weighted_km2"),
                    F.round("nearest_km", 4).alias("nearest_km"), "nearest_id", F.round("significant_km", 4).alias("significant_km"), "risk_level")


@query("win_06_significant_distance", f"""
    WITH near AS (SELECT beach_id, {hav('lat', 'lon', 'latitude', 'longitude')} AS d, area_km2 FROM detections_v, beaches_v),
    cum AS (SELECT *, sum(area_km2) OVER (PARTITION BY beach_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS c FROM near WHERE d <= 40)
    SELECT beach_id, round(min(d), 4) AS km FROM cum WHERE c >= 10.0 GROUP BY beach_id""", "detections_v beaches_v")
def significant_distance(v):
    c = SP.crossing(v.detections.select("id", "lat", "lon", "area_km2"), beach_side(v), "beach_id", 40.0, "area_km2", 10.0, "id")
    return c.where("beach_id is not null and cross_km is not null").select("beach_id", F.round("cross_km", 4).alias("km"))


@query("win_18_beach_eta", f"""
    WITH RECURSIVE m AS (SELECT id, lat, lon FROM detections_v WHERE area_km2 >= 0.3 AND run_at = (SELECT max(run_at) FROM detections_v)),
    p AS (SELECT beach_id, latitude AS bla, longitude AS blo, lat, lon, {hav('latitude', 'longitude', 'lat', 'lon')} AS d,
            {current('lat', 'lon', 'u')} + 0.02 * -5.0 AS u, {current('lat', 'lon', 'v')} + 0.02 * 1.0 AS w FROM m, beaches_v),
    q AS (SELECT *, (w * (bla - lat) * 111.32 + u * (blo - lon) * 111.32 * cos(radians(lat))) / d AS s FROM p WHERE d <= 12 + 1.2 * 72),
    c AS (SELECT row_number() OVER () AS rid, * FROM q WHERE d <= 12 OR (s > 0.005 AND ceil((d - 12) / (s * 3.6)) <= 72)),
    walk AS (SELECT rid, beach_id, bla, blo, lat, lon, 0 AS h FROM c
      UNION ALL
      SELECT rid, beach_id, bla, blo, lat + ({current('lat', 'lon', 'v')} + 0.02 * 1.0) * 3600.0 / 111320.0,
             lon + ({current('lat', 'lon', 'u')} + 0.02 * -5.0) * 3600.0 / (cos(radians(lat)) * 111320.0), h + 1
      FROM walk WHERE h < 72 AND {hav('bla', 'blo', 'lat', 'lon')} > 12)
    SELECT beach_id, min(h) AS eta_hours FROM walk WHERE {hav('bla', 'blo', 'lat', 'lon')} <= 12 GROUP BY beach_id""",
       "detections_v beaches_v")
def beach_eta(v):
    masses = latest(v.detections, [], "run_at")
    return E.beach_eta(masses, v.beaches, [], "beach_id", F.lit(-5.0), F.lit(1.0))


@query("scl_13_effective_drift", f"""
    SELECT id, round({current('lat', 'lon', 'u')} + 0.02 * area_km2, 6) AS u, round({current('lat', 'lon', 'v')} - 0.02 * area_km2, 6) AS v
    FROM detections_v""", "detections_v")
def effective_drift(v):
    d = R.effective_drift(F.col("lat"), F.col("lon"), F.col("area_km2"), -F.col("area_km2"))
    return v.detections.select("id", F.round(d["u"], 6).alias("u"), F.round(d["v"], 6).alias("v"))


@query("scl_14_approach", f"""
    WITH p AS (SELECT id, beach_id, latitude AS bla, longitude AS blo, lat, lon, {hav('latitude', 'longitude', 'lat', 'lon')} AS d FROM detections_v, beaches_v),
    q AS (SELECT id, beach_id, d, ({current('lat', 'lon', 'v')} * (bla - lat) * 111.32 + {current('lat', 'lon', 'u')} * (blo - lon) * 111.32
          * cos(radians(lat))) / d AS s FROM p WHERE d <= 20 AND d > 0)
    SELECT id, beach_id, round(s, 6) AS speed, CAST(CASE WHEN s > 0.005 THEN ceil((d - 12) / (s * 3.6)) END AS BIGINT) AS hours FROM q""",
       "detections_v beaches_v")
def approach(v):
    lat, lon, zero = F.col("lat"), F.col("lon"), F.lit(0.0)
    masses = v.detections.select("id", "lat", "lon", R.effective_drift(lat, lon, zero, zero).alias("drift")).select("id", "lat", "lon", "drift.*")
    j = SP.pair_distances(masses, beach_side(v), 20.0)
    j = j.where((F.abs(lat - F.col("p_lat")) > 1e-6) | (G.haversine_km(F.col("p_lat"), F.col("p_lon"), lat, lon) > 0))  # the first spares most pairs a second distance
    a = R.approach(F.col("p_lat"), F.col("p_lon"), lat, lon, {"u": F.col("u"), "v": F.col("v")}, dist=F.col("dist"))
    return j.select("id", "beach_id", G.rounded(a["speed"], 6).alias("speed"), a["hours"].cast("bigint").alias("hours"))


@query("ram_02_predicted_position", f"""
    WITH RECURSIVE s AS (SELECT id, lat, lon, 0 AS k FROM detections_v UNION ALL
      SELECT id, lat2, lon + ({current('lat', 'lon', 'u')} - 0.08) * 86400.0 / (cos(radians(lat2)) * 111320.0), k + 1
      FROM (SELECT *, lat + ({current('lat', 'lon', 'v')} + 0.02) * 86400.0 / 111320.0 AS lat2 FROM s) WHERE k < 3)
    SELECT id, round(lat, 5) AS lat, round(lon, 5) AS lon FROM s WHERE k = 3""", "detections_v")
def predicted_position(v):
    p = R.advect(F.col("lat"), F.col("lon"), 72, F.lit(-4.0), F.lit(1.0))
    return v.detections.select("id", F.round(p["lat"], 5).alias("lat"), F.round(p["lon"], 5).alias("lon"))


@query("scl_11_shore_exposure", """
    WITH e AS (SELECT event_id AS id, ((event_id * 31) % 360) * 1.0 AS b, ((event_id % 41) - 20) / 100.0 AS u, ((event_id % 29) - 14) / 100.0 AS w FROM events)
    SELECT id, round(CASE WHEN sqrt(u * u + w * w) >= 0.02 THEN cos(radians(degrees(atan2(u, w)) + 540 - b)) END, 5) + 0.0 AS exposure FROM e""")
def exposure(v):
    k = F.col("event_id")
    b, u, w = ((k * 31) % 360) * 1.0, ((k % 41) - 20) / 100.0, ((k % 29) - 14) / 100.0
    return v.events.select(k.alias("id"), (F.round(R.shore_exposure(b, u, w), 5) + F.lit(0.0)).alias("exposure"))


@query("scl_12_wind_uv", """
    SELECT id, round(-wind_speed_kt * sin(radians(wind_direction_deg)), 5) + 0.0 AS u, round(-wind_speed_kt * cos(radians(wind_direction_deg)), 5) + 0.0 AS v
    FROM conditions_v""", "conditions_v")
def wind_uv(v):
    a, b = R.wind_uv(F.col("wind_speed_kt"), F.col("wind_direction_deg"))
    return v.conditions.select("id", (F.round(a, 5) + F.lit(0.0)).alias("u"), (F.round(b, 5) + F.lit(0.0)).alias("v"))


@query("agg_27_map_buckets", """
    SELECT CAST(floor(lat / 0.5) AS BIGINT) AS bucket_y, CAST(floor(lon / 0.5) AS BIGINT) AS bucket_x, count(*) AS members,
           CAST(max(CASE source WHEN 'signup' THEN 3 WHEN 'purchase' THEN 2 WHEN 'view' THEN 1 ELSE 0 END) AS INT) AS worst
    FROM detections_v GROUP BY 1, 2""", "detections_v")
def map_buckets(v):
    rank = F.when(F.col("source") == "signup", 3).when(F.col("source") == "purchase", 2).when(F.col("source") == "view", 1).otherwise(0)
    return SP.map_buckets(v.detections, 0.5, rank)


FIELD_SQL = """
    field AS (SELECT t_idx, "row", col, avg(q) / 100 AS u, avg(x) * 2 AS v FROM (
      SELECT l_linenumber - 1 AS t_idx, l_partkey % 9 AS "row", l_orderkey % 10 AS col, l_quantity AS q, l_discount AS x FROM lineitem) GROUP BY 1, 2, 3)"""


def field(v):
    return (v.lineitem.groupBy((F.col("l_linenumber") - 1).cast("long").alias("t_idx"), (F.col("l_partkey") % 9).alias("row"),
                               (F.col("l_orderkey") % 10).alias("col"))
            .agg((F.avg("l_quantity") / 100).alias("u"), (F.avg("l_discount") * 2).alias("v")))


AXES = {"t": (0.0, 3.0, 7), "lat": (17.4, 0.5, 9), "lon": (-72.0, 0.5, 10)}


def _interp_sql(clamp: bool) -> str:
    def frac(col, first, step, count, hold):
        raw = f"(({col} - {first}) / {step})"
        x = f"least(greatest({raw}, 0.0), {float(count - 1)})" if hold else raw
        return x, f"least(floor({x}), {count - 2})"

    xt, bt = frac("t", 0.0, 3.0, 7, True)
    xy, by = frac("lat", 17.4, 0.5, 9, clamp)
    xx, bx = frac("lon", -72.0, 0.5, 10, clamp)
    outside = "FALSE" if clamp else "(fy < 0 OR fy > 1 OR fx < 0 OR fx > 1 OR by_ < 0 OR bx < 0)"
    return f"""
    WITH {FIELD_SQL}, p AS (SELECT event_id AS id, (event_id % 24) * 1.0 AS t, 17.3 + ((event_id * 7919) % 4200) / 1000.0 AS lat,
         -72.1 + ((event_id * 104729) % 4800) / 1000.0 AS lon FROM events),
    b AS (SELECT id, {bt} AS bt, {xt} - {bt} AS ft, {by} AS by_, {xy} - {by} AS fy, {bx} AS bx, {xx} - {bx} AS fx FROM p),
    k AS (SELECT *, a, c, e FROM b, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS c), (SELECT unnest([0, 1]) AS e))
    SELECT k.id, round(sum(w * coalesce(u, 0.0)), 5) + 0.0 AS u, round(sum(w * coalesce(v, 0.0)), 5) + 0.0 AS v FROM (
      SELECT *, CASE WHEN {outside} THEN 0.0 ELSE (CASE WHEN a = 1 THEN ft ELSE 1 - ft END) * (CASE WHEN c = 1 THEN fy ELSE 1 - fy END)
        * (CASE WHEN e = 1 THEN fx ELSE 1 - fx END) END AS w FROM k) k
    LEFT JOIN field f ON f.t_idx = bt + a AND f."row" = by_ + c AND f.col = bx + e GROUP BY k.id"""


def _interp(v, clamp):
    k = F.col("event_id")
    p = v.events.select(k.alias("id"), ((k % 24) * 1.0).alias("t"), (F.lit(17.3) + ((k * 7919) % 4200) / 1000.0).alias("lat"),
                        (F.lit(-72.1) + ((k * 104729) % 4800) / 1000.0).alias("lon"))
    out = GR.interpolate(p, field(v), AXES, ["id"], clamp)
    return out.select("id", (F.round("u", 5) + F.lit(0.0)).alias("u"), (F.round("v", 5) + F.lit(0.0)).alias("v"))


@query("jon_28_interpolate_currents", _interp_sql(False))
def interpolate_currents(v):
    return _interp(v, False)


@query("jon_28_interpolate_wind", _interp_sql(True))
def interpolate_wind(v):
    return _interp(v, True)


@query("agg_26_mean_drift_exposure", f"""
    WITH {FIELD_SQL}, b AS (SELECT beach_id, (beach_id * 47) % 360 AS bearing, latitude + 5.0 / 111.32 * cos(radians((beach_id * 47) % 360)) AS lat,
        longitude + 5.0 / (111.32 * cos(radians(latitude))) * sin(radians((beach_id * 47) % 360)) AS lon FROM beaches_v),
    p AS (SELECT beach_id, bearing, lat, lon, t * 1.0 AS t FROM b, (SELECT unnest(range(0, 25, 3)) AS t)),
    x AS (SELECT *, least(greatest(t / 3.0, 0.0), 6.0) AS xt, (lat - 17.4) / 0.5 AS xy, (lon + 72.0) / 0.5 AS xx FROM p),
    c AS (SELECT *, least(floor(xt), 5) AS bt, least(floor(xy), 7) AS by_, least(floor(xx), 8) AS bx FROM x),
    k AS (SELECT * FROM c, (SELECT unnest([0, 1]) AS a), (SELECT unnest([0, 1]) AS d), (SELECT unnest([0, 1]) AS e)),
    w AS (SELECT *, CASE WHEN xy < by_ OR xy > by_ + 1 OR xx < bx OR xx > bx + 1 OR by_ < 0 OR bx < 0 THEN 0.0 ELSE
        (CASE WHEN a = 1 THEN xt - bt ELSE 1 - (xt - bt) END) * (CASE WHEN d = 1 THEN xy - by_ ELSE 1 - (xy - by_) END)
        * (CASE WHEN e = 1 THEN xx - bx ELSE 1 - (xx - bx) END) END AS wt FROM k),
    m AS (SELECT beach_id, bearing, sum(wt * coalesce(u, 0.0)) / 9 AS u, sum(wt * coalesce(v, 0.0)) / 9 AS v FROM w
        LEFT JOIN field f ON f.t_idx = bt + a AND f."row" = by_ + d AND f.col = bx + e GROUP BY 1, 2)
    SELECT beach_id, round(CASE WHEN sqrt(u * u + v * v) >= 0.02 THEN cos(radians(degrees(atan2(u, v)) + 540 - bearing)) END, 3) + 0.0 AS exposure FROM m""",
       "beaches_v")
def mean_drift(v):
    bearing = ((F.col("beach_id") * 47) % 360).cast("double")
    lat = F.col("latitude") + F.lit(5.0 / 111.32) * F.cos(F.radians(bearing))
    lon = F.col("longitude") + F.lit(5.0) / (F.lit(111.32) * F.cos(F.radians("latitude"))) * F.sin(F.radians(bearing))
    p = (v.beaches.select("beach_id", bearing.alias("bearing"), lat.alias("lat"), lon.alias("lon"))
         .withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(24), F.lit(3)))).withColumn("t", F.col("t").cast("double")))
    at = GR.interpolate(p, field(v), AXES, ["beach_id", "bearing", "t"], False)
    m = at.groupBy("beach_id", "bearing").agg(F.avg("u").alias("u"), F.avg("v").alias("v"))
    return m.select("beach_id", (F.round(R.shore_exposure(F.col("bearing"), F.col("u"), F.col("v")), 3) + F.lit(0.0)).alias("exposure"))


@query("src_09_geojson_edges", """
    SELECT beach_id AS shape, CAST(unnest([0, 1, 2]) AS INT) AS pos, round(unnest([longitude, longitude + 1.0, longitude + 1.0]), 4) AS x1,
           round(unnest([latitude, latitude, latitude + 0.5]), 4) AS y1, round(unnest([longitude + 1.0, longitude + 1.0, longitude]), 4) AS x2,
           round(unnest([latitude, latitude + 0.5, latitude]), 4) AS y2 FROM beaches_v""", "beaches_v")
def geojson_edges(v):
    la, lo = F.col("latitude"), F.col("longitude")
    xy = lambda x, y: F.concat(F.lit("["), x.cast("string"), F.lit(","), y.cast("string"), F.lit("]"))
    ring = F.concat(F.lit("[["), F.concat_ws(",", xy(lo, la), xy(lo + 1.0, la), xy(lo + 1.0, la + 0.5), xy(lo, la)), F.lit("]]"))
    poly = F.concat(F.lit('{"type":"Feature","geometry":{"type":"Polygon","coordinates":'), ring, F.lit("}}"))
    multi = F.concat(F.lit('{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":['), ring, F.lit("]}}"))
    raw = v.beaches.select(F.col("beach_id").alias("shape"), F.when(F.col("beach_id") % 2 == 0, poly).otherwise(multi).alias("body"))
    e = SP.ring_edges(P.geojson_vertices(raw), ["shape", "part", "ring"], "pos")
    return e.select("shape", "pos", *[F.round(c, 4).alias(c) for c in ("x1", "y1", "x2", "y2")])


def triangle_edges(v):
    la, lo = F.col("latitude"), F.col("longitude")
    pts = [(lo, la), (lo + 0.021, la), (lo, la + 0.013), (lo, la)]
    e = F.array(*[F.struct(F.lit(i).alias("pos"), a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
                  for i, (a, b) in enumerate(zip(pts, pts[1:]))])
    return v.beaches.select("beach_id", F.explode(e).alias("e")).select("beach_id", "e.*")


DENSE_SQL = """
    e AS (SELECT beach_id, unnest([0, 1, 2]) AS pos, unnest([longitude, longitude + 0.021, longitude]) AS x1, unnest([latitude, latitude, latitude + 0.013]) AS y1,
      unnest([longitude + 0.021, longitude, longitude]) AS x2, unnest([latitude, latitude + 0.013, latitude]) AS y2 FROM beaches_v),
    n AS (SELECT *, CAST(greatest(1, ceil(round(sqrt(pow(x2 - x1, 2) + pow(y2 - y1, 2)) / 0.005, 9))) AS INT) AS n FROM e),
    dense AS (SELECT beach_id, CAST(pos AS INT) AS pos, CAST(part AS INT) AS part, y1 + (part * 1.0 / n) * (y2 - y1) AS lat, x1 + (part * 1.0 / n) * (x2 - x1) AS lon
      FROM (SELECT *, unnest(range(n)) AS part FROM n))"""


@query("geo_06_densify", f"""
    WITH {DENSE_SQL} SELECT beach_id, pos, part, round(lat, 5) AS lat, round(lon, 5) AS lon FROM dense""", "beaches_v")
def densify(v):
    d = SP.densify(triangle_edges(v), ["beach_id"], "pos")
    return d.select("beach_id", "pos", "part", F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("win_13_owner_runs", f"""
    WITH {DENSE_SQL}, o AS (SELECT *, CAST((pos * 3 + part // 2) % 4 - 1 AS INT) AS owner FROM dense),
    f AS (SELECT *, CASE WHEN lag(owner) OVER w = owner THEN 0 ELSE 1 END AS nw FROM o WINDOW w AS (PARTITION BY beach_id ORDER BY pos, part)),
    r AS (SELECT *, sum(nw) OVER (PARTITION BY beach_id ORDER BY pos, part ROWS UNBOUNDED PRECEDING) AS run_no FROM f)
    SELECT beach_id, owner, count(*) AS n_points, 'LINESTRING(' || string_agg(printf('%.4f %.4f', lon, lat), ', ' ORDER BY pos, part) || ')' AS line
    FROM r WHERE owner >= 0 GROUP BY beach_id, run_no, owner HAVING count(*) > 1""", "beaches_v")
def owner_runs(v):
    d = SP.densify(triangle_edges(v), ["beach_id"], "pos")
    d = d.withColumn("owner", ((F.col("pos") * 3 + F.floor(F.col("part") / 2)) % 4 - 1).cast("int"))
    return SP.owner_runs(d, ["beach_id"], ["pos", "part"])


@query("scl_04_region_and_scl_01_level", f"""
    SELECT run_at, zone_id, {zone_level('area', 'eta_hours')} AS level FROM (SELECT CAST(run_at AS VARCHAR) AS run_at, zone_id, area, eta_hours FROM forecasts_v)""",
       "forecasts_v")
def zone_levels(v):
    return v.forecasts.select(F.col("run_at").cast("string").alias("run_at"), "zone_id", R.zone_level(F.col("area"), F.col("eta_hours")).alias("level"))
