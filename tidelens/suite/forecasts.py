"""Ensemble forecasts, tracks, beach levels, latest-per-key reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import dates as D
from tidelens.functions import risk as R
from tidelens.operators import catalog as C
from tidelens.operators import ensemble as E
from tidelens.operators import spatial as SP
from tidelens.operators import timejoin as TJ
from tidelens.operators.keyed import latest, top_n
from tidelens.operators.quantiles import first_crossing
from tidelens.suite.registry import query
from tidelens.suite.sqlbits import hav, int_level, level_int, planar, region, season_level, zone_level

HOURS = "(SELECT unnest([0, 24, 48, 72]) AS h)"

# member levels per horizon, with the members that bring nothing filled in by hand
MEMBER_SQL = f"""
    TAGhourly AS (SELECT KEYS, member, hour AS hr, sum(area) AS area FROM SRC WHERE hour <= 72 GROUP BY ALL),
    TAGcum AS (SELECT *, sum(area) OVER (PARTITION BY KEYS, member ORDER BY hr) AS c FROM TAGhourly),
    TAGper AS (SELECT KEYS, member, h, sum(CASE WHEN hr <= h THEN area ELSE 0 END) AS a,
                   min(CASE WHEN c >= 5.0 AND hr <= h THEN hr END) AS eta FROM TAGcum, {HOURS} GROUP BY ALL),
    TAGlev AS (SELECT *, {zone_level('a', 'eta', 'MINBAR')} AS lv FROM TAGper),
    TAGsh AS (SELECT KEYS, h, count(*) FILTER (lv = 'low') / 24.0 AS p1, count(*) FILTER (lv = 'medium') / 24.0 AS p2,
                  count(*) FILTER (lv = 'high') / 24.0 AS p3, sum(a) / 24.0 AS area FROM TAGlev GROUP BY ALL),
    TAGhd AS (SELECT *, 1 - p1 - p2 - p3 AS p0, CASE WHEN p3 >= 0.5 THEN 'high' WHEN p3 + p2 >= 0.5 THEN 'medium'
                  WHEN p3 + p2 + p1 >= 0.5 THEN 'low' ELSE 'none' END AS risk_level FROM TAGsh),
    TAGfirst AS (SELECT KEYS, member, min(CASE WHEN c >= MINBAR THEN hr END) AS f FROM TAGcum GROUP BY ALL),
    TAGeta AS (SELECT KEYS, CASE WHEN count(f) / 24.0 >= 0.5 THEN CAST(trunc(median(f)) AS INT) END AS eta_hours FROM TAGfirst GROUP BY ALL)"""


def member_sql(keys: str, src: str, bar: str = "0.5", tag: str = "") -> str:
    """``tag`` is put before the names of the tables, for a second use in one statement."""
    return MEMBER_SQL.replace("KEYS", keys).replace("SRC", src).replace("MINBAR", bar).replace("TAG", tag)


@query("agg_06_member_area", f"""
    WITH hourly AS (SELECT run, zone, member, hour AS hr, sum(area) AS area FROM stops_v WHERE hour <= 72 GROUP BY ALL),
    cum AS (SELECT *, sum(area) OVER (PARTITION BY run, zone, member ORDER BY hr) AS c FROM hourly)
    SELECT run, zone, member, round(sum(CASE WHEN hr <= 0 THEN area ELSE 0 END), 5) AS area_0, round(sum(CASE WHEN hr <= 24 THEN area ELSE 0 END), 5) AS area_24,
           round(sum(CASE WHEN hr <= 48 THEN area ELSE 0 END), 5) AS area_48, round(sum(area), 5) AS area_72
    FROM cum GROUP BY ALL""", "stops_v")
def member_area(v):
    a = E.arrived_by_member(v.stops, ["run", "zone"])
    return a.select("run", "zone", "member", *[F.round(f"area_{h}", 5).alias(f"area_{h}") for h in S.HORIZONS])


@query("win_05_significant_hour", """
    WITH hourly AS (SELECT run, zone, member, hour AS hr, sum(area) AS area FROM stops_v GROUP BY ALL),
    cum AS (SELECT *, sum(area) OVER (PARTITION BY run, zone, member ORDER BY hr) AS c FROM hourly)
    SELECT run, zone, member, min(hr) AS eta FROM cum WHERE c >= 0.25 GROUP BY ALL""", "stops_v")
def significant_hour(v):
    return first_crossing(v.stops, ["run", "zone", "member"], "hour", "area", 0.25, "eta")


@query("ram_01_zone_forecast", f"""
    WITH {member_sql('run, zone', 'stops_v')}
    SELECT run, zone, risk_level, eta_hours, round(1 - round(p0, 3), 3) AS arrival_probability, round(p0, 3) AS p_none, round(p1, 3) AS p_low,
           round(p2, 3) AS p_medium, round(p3, 3) AS p_high FROM hd JOIN eta USING (run, zone) WHERE h = 72""", "stops_v")
def zone_forecast(v):
    return E.summarise(v.stops, ["run", "zone"]).drop("horizons")


@query("agg_07_08_horizon_probabilities", f"""
    WITH {member_sql('run, zone', 'stops_v')}
    SELECT run, zone, CAST(h AS INT) AS horizon_hours, risk_level, round(round(area, 9), 3) AS area_km2, round(p0, 3) AS p_none, round(p3, 3) AS p_high FROM hd""",
       "stops_v")
def horizon_probabilities(v):
    f = E.summarise(v.stops, ["run", "zone"]).select("run", "zone", F.explode("horizons").alias("h"))
    return f.select("run", "zone", "h.horizon_hours", "h.risk_level", "h.area_km2",
                    F.col("h.probs")["none"].alias("p_none"), F.col("h.probs")["high"].alias("p_high"))


@query("agg_09_eta", f"""
    WITH {member_sql('run, zone', 'stops_v')} SELECT run, zone, eta_hours FROM eta""", "stops_v")
def eta(v):
    return E.summarise(v.stops, ["run", "zone"]).select("run", "zone", "eta_hours")


@query("arr_02_arrival_probability", f"""
    WITH {member_sql('run, zone', 'stops_v')} SELECT run, zone, round(1 - round(p0, 3), 3) AS arrival_probability FROM hd WHERE h = 72""", "stops_v")
def arrival_probability(v):
    f = E.summarise(v.stops, ["run", "zone"])
    probs = R.ensure_map(F.col("p_none"), F.col("p_low"), F.col("p_medium"), F.col("p_high"))
    return f.select("run", "zone", F.round(R.arrival_probability(probs), 3).alias("arrival_probability"))


NEAR_SQL = f"""
    near AS (SELECT beach_id, member, zone, hour, area FROM stops_v s, beaches_v b
             WHERE s.lat BETWEEN b.latitude - 0.1 AND b.latitude + 0.1 AND {planar('s.lat', 's.lon', 'b.latitude', 'b.longitude')} <= 10)"""


@query("ram_03_beach_forecast", f"""
    WITH {NEAR_SQL}, {member_sql('beach_id', 'near', '0.1')}
    SELECT beach_id, risk_level, eta_hours, round(1 - round(p0, 3), 3) AS arrival_probability, round(p0, 3) AS p_none, round(p1, 3) AS p_low,
           round(p2, 3) AS p_medium, round(p3, 3) AS p_high FROM hd JOIN eta USING (beach_id) WHERE h = 72""", "stops_v beaches_v")
def beach_forecast(v):
    return E.beach_summary(v.stops, v.beaches, "beach_id").drop("horizons")


@query("agg_10_majority_owner", f"""
    WITH {NEAR_SQL} SELECT beach_id, zone FROM (SELECT beach_id, zone, row_number() OVER (PARTITION BY beach_id ORDER BY count(*) DESC, zone) AS rn
    FROM near GROUP BY 1, 2) WHERE rn = 1""", "stops_v beaches_v")
def majority_owner(v):
    return E.majority_owner(v.stops, v.beaches, "beach_id")


@query("agg_11_tracks", """
    SELECT patch, h, round(median(lat), 4) AS lat, round(median(lon), 4) AS lon, round(avg(CASE WHEN done THEN 1.0 ELSE 0.0 END), 2) AS ashore
    FROM snapshots_v GROUP BY patch, h""", "snapshots_v")
def tracks(v):
    return E.tracks(v.snapshots, ["patch"])


@query("win_14_track_position", """
    WITH t AS (SELECT patch, h, round(median(lat), 4) AS lat, round(median(lon), 4) AS lon, round(avg(CASE WHEN done THEN 1.0 ELSE 0.0 END), 2) AS ashore
               FROM snapshots_v GROUP BY patch, h),
    s AS (SELECT *, lead(h) OVER w AS h2, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2, lead(ashore) OVER w AS ash2 FROM t WINDOW w AS (PARTITION BY patch ORDER BY h)),
    q AS (SELECT *, least(36, 72) AS want FROM s WHERE h2 IS NOT NULL AND h <= 36 AND 36 <= h2)
    SELECT patch, round(lat + (want - h) * 1.0 / (h2 - h) * (lat2 - lat), 5) AS lat, round(lon + (want - h) * 1.0 / (h2 - h) * (lon2 - lon), 5) AS lon,
           (CASE WHEN want > h THEN ash2 ELSE ashore END) >= 0.5 AS ashore FROM q""", "snapshots_v")
def track_position(v):
    t = E.track_arrays(E.tracks(v.snapshots, ["patch"]), ["patch"])
    p = E.track_position(F.col("track"), F.lit(36))
    return t.select("patch", F.round(p["lat"], 5).alias("lat"), F.round(p["lon"], 5).alias("lon"), p["ashore"].alias("ashore"))


@query("jon_07_nearest_checkpoint", """
    SELECT id, CAST(horizon_hours AS INT) AS horizon_hours, risk_level FROM (SELECT id, horizon_hours, risk_level,
      row_number() OVER (PARTITION BY id ORDER BY abs(horizon_hours - (id % 90)), horizon_hours) AS rn FROM horizons_v) WHERE rn = 1""", "horizons_v")
def nearest_checkpoint(v):
    e = TJ.element_nearest(F.col("horizons"), "horizon_hours", F.col("id") % 90)
    return v.forecasts.select("id", e["horizon_hours"].alias("horizon_hours"), e["risk_level"].alias("risk_level"))


@query("jon_07_nearest_lead", """
    SELECT CAST(run_at AS VARCHAR) AS run_at, zone_id, lead_days, risk_level FROM (SELECT *, row_number() OVER (PARTITION BY run_at, zone_id
      ORDER BY abs(lead_days - 12), lead_days) AS rn FROM extended_v) WHERE rn = 1""", "extended_v")
def nearest_lead(v):
    n = TJ.nearest_row(v.extended, ["run_at", "zone_id"], F.col("lead_days") - 12, [F.col("lead_days")])
    return n.select(F.col("run_at").cast("string").alias("run_at"), "zone_id", "lead_days", "risk_level")


@query("arr_01_horizon_explode", """
    SELECT id, CAST(horizon_hours AS INT) AS horizon_hours, risk_level, round(h_area, 6) AS area_km2, CAST(valid_at AS VARCHAR) AS valid_at FROM horizons_v""",
       "horizons_v")
def horizon_explode(v):
    return v.forecasts.select("id", F.explode("horizons").alias("h")).select(
        "id", "h.horizon_hours", "h.risk_level", F.round("h.area_km2", 6).alias("area_km2"), F.col("h.valid_at").cast("string").alias("valid_at"))


@query("win_01_latest_per_run", """
    SELECT id, zone_id, risk_level FROM forecasts_v WHERE run_at = (SELECT max(run_at) FROM forecasts_v)""", "forecasts_v")
def latest_run(v):
    return latest(v.forecasts, [], "run_at").select("id", "zone_id", "risk_level")


@query("win_01_latest_per_zone", """
    SELECT f.id, f.zone_id, z.name AS zone_name, risk_level, eta_hours FROM forecasts_v f JOIN zones_v z USING (zone_id)
    WHERE run_at = (SELECT max(g.run_at) FROM forecasts_v g WHERE g.zone_id = f.zone_id)""", "forecasts_v zones_v")
def latest_zone(v):
    f = latest(v.forecasts, ["zone_id"], "run_at").join(v.zones, "zone_id")
    return f.select("id", "zone_id", F.col("name").alias("zone_name"), "risk_level", "eta_hours")


@query("win_01_latest_per_zone_lead", """
    SELECT id, zone_id, lead_days, method FROM (SELECT *, rank() OVER (PARTITION BY zone_id, lead_days ORDER BY run_at DESC) AS r FROM extended_v) WHERE r = 1""",
       "extended_v")
def latest_zone_lead(v):
    return latest(v.extended, ["zone_id", "lead_days"], "run_at").select("id", "zone_id", "lead_days", "method")


@query("win_01_latest_per_beach", """
    SELECT id, beach_name, risk_level FROM (SELECT *, rank() OVER (PARTITION BY beach_name ORDER BY run_at DESC) AS r FROM beach_forecasts_v) WHERE r = 1""",
       "beach_forecasts_v")
def latest_beach(v):
    return latest(v.beach_forecasts, ["beach_name"], "run_at").select("id", "beach_name", "risk_level")


@query("jon_01_zone_names", """
    SELECT id, CAST(run_at AS VARCHAR) AS run_at, z.name AS zone_name, risk_level FROM forecasts_v JOIN zones_v z USING (zone_id)""", "forecasts_v zones_v")
def zone_names(v):
    return v.forecasts.join(v.zones, "zone_id").select("id", F.col("run_at").cast("string").alias("run_at"), F.col("name").alias("zone_name"), "risk_level")


@query("jon_16_default_level", f"""
    WITH near AS (SELECT beach_id, zone_id, d FROM (SELECT beach_id, zone_id, d, row_number() OVER (PARTITION BY beach_id ORDER BY d, zone_id) AS rn
      FROM (SELECT beach_id, zone_id, {hav('latitude', 'longitude', 'center_lat', 'center_lon')} AS d FROM beaches_v, zones_v)) WHERE rn = 1),
    f AS (SELECT zone_id, risk_level FROM (SELECT *, rank() OVER (PARTITION BY zone_id ORDER BY run_at DESC) AS r FROM forecasts_v WHERE zone_id % 4 <> 0) WHERE r = 1)
    SELECT beach_id, near.zone_id, round(d, 4) AS dist_km, coalesce(risk_level, 'none') AS risk_level FROM near LEFT JOIN f USING (zone_id)""",
       "beaches_v zones_v forecasts_v")
def default_level(v):
    n = SP.nearest(v.beaches, v.zones, "zone_id", ("center_lat", "center_lon"), ("latitude", "longitude"))
    n = n.select("beach_id", F.col("near.id").alias("zone_id"), F.round("near.dist", 4).alias("dist_km"))
    f = latest(v.forecasts.where("zone_id % 4 <> 0"), ["zone_id"], "run_at").select("zone_id", "risk_level")
    return n.join(f, "zone_id", "left").withColumn("risk_level", F.coalesce("risk_level", F.lit("none")))


@query("ram_04_beach_horizons", f"""
    WITH RECURSIVE last AS (SELECT id, lat, lon, area_km2 FROM detections_v WHERE run_at = (SELECT max(run_at) FROM detections_v)),
    s AS (SELECT id, area_km2, lat, lon, 0 AS k FROM last UNION ALL
      SELECT id, area_km2, lat2, lon + (u - 0.06) * 86400.0 / (cos(radians(CASE WHEN k = 0 THEN lat ELSE lat2 END)) * 111320.0), k + 1 FROM (
        SELECT *, lat + (w + 0.02) * 86400.0 / 111320.0 AS lat2 FROM (SELECT *, CUR_U AS u, CUR_V AS w FROM s)) WHERE k < 3),
    one AS (SELECT id, area_km2, 24 * k AS h, lat, CASE WHEN k = 0 THEN lon ELSE lon END AS lon, k FROM s),
    near AS (SELECT beach_id, h, id, d, area_km2 * pow(greatest(0.0, 1 - d / 25.0), 2) AS w FROM (
      SELECT beach_id, h, id, area_km2, {hav('latitude', 'longitude', 'lat', 'lon')} AS d FROM one, beaches_v) WHERE d <= 25),
    cum AS (SELECT *, sum(w) OVER (PARTITION BY h, beach_id ORDER BY d ROWS UNBOUNDED PRECEDING) AS c FROM near),
    g AS (SELECT h, beach_id, sum(w) AS weighted, min(CASE WHEN c >= 3.0 THEN d END) AS sig FROM cum GROUP BY 1, 2)
    SELECT beach_id, CAST(h AS INT) AS h, round(weighted, 4) AS weighted_km2, CASE WHEN weighted < 0.3 THEN 'none' WHEN weighted >= 3.0 AND sig <= 8 THEN 'high'
      WHEN weighted >= 12 THEN 'high' WHEN weighted >= 3.0 THEN 'medium' ELSE 'low' END AS risk_level FROM g WHERE h IN (0, 48, 72)"""
       .replace("CUR_U", __import__("tidelens.suite.sqlbits", fromlist=["current"]).current("lat", "lon", "u"))
       .replace("CUR_V", __import__("tidelens.suite.sqlbits", fromlist=["current"]).current("lat", "lon", "v"))
       .replace("CASE WHEN k = 0 THEN lat ELSE lat2 END", "lat2"), "detections_v beaches_v")
def beach_horizons(v):
    masses = latest(v.detections, [], "run_at").select("id", "lat", "lon", "area_km2")
    parts = [E.shifted(masses, h, F.lit(-3.0), F.lit(1.0)).withColumn("h", F.lit(h)) for h in (0, 48, 72)]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return E.beach_state(every, v.beaches, ["h"], "beach_id", "id").select(
        "beach_id", "h", F.round("weighted_km2", 4).alias("weighted_km2"), "risk_level")


@query("ram_05_resolved_level", f"""
    WITH near AS (SELECT beach_id, zone_id, d FROM (SELECT beach_id, zone_id, d, row_number() OVER (PARTITION BY beach_id ORDER BY d, zone_id) AS rn
      FROM (SELECT beach_id, zone_id, {hav('latitude', 'longitude', 'center_lat', 'center_lon')} AS d FROM beaches_v, zones_v)) WHERE rn = 1),
    own AS (SELECT CAST(beach_name AS BIGINT) * 2 AS beach_id, risk_level FROM (SELECT *, rank() OVER (PARTITION BY beach_name ORDER BY run_at DESC) AS r
      FROM beach_forecasts_v) WHERE r = 1),
    w AS (SELECT beach_id, sum(area_km2 * pow(1 - d / 25.0, 2)) AS weighted FROM (SELECT beach_id, area_km2, {hav('latitude', 'longitude', 'lat', 'lon')} AS d
      FROM detections_v, beaches_v WHERE run_at = (SELECT max(run_at) FROM detections_v)) WHERE d <= 25 GROUP BY 1),
    z AS (SELECT zone_id, risk_level FROM (SELECT *, rank() OVER (PARTITION BY zone_id ORDER BY run_at DESC) AS r FROM forecasts_v) WHERE r = 1)
    SELECT near.beach_id, CASE WHEN own.risk_level IS NOT NULL AND NOT (d > 54) THEN own.risk_level
        WHEN near.beach_id % 3 <> 0 THEN CASE WHEN weighted >= 0.3 THEN 'some' ELSE 'none' END
        WHEN d > 54 THEN 'out' ELSE coalesce(z.risk_level, 'none') END AS level
    FROM near LEFT JOIN own ON own.beach_id = near.beach_id LEFT JOIN w ON w.beach_id = near.beach_id LEFT JOIN z ON z.zone_id = near.zone_id""",
       "beaches_v zones_v beach_forecasts_v detections_v forecasts_v")
def resolved_level(v):
    n = SP.nearest(v.beaches, v.zones, "zone_id", ("center_lat", "center_lon"), ("latitude", "longitude")).select(
        "beach_id", F.col("near.id").alias("zone_id"), F.col("near.dist").alias("d"))
    own = latest(v.beach_forecasts, ["beach_name"], "run_at").select((F.col("beach_name").cast("bigint") * 2).alias("beach_id"), F.col("risk_level").alias("own"))
    masses = latest(v.detections, [], "run_at")
    st = E.beach_state(masses, v.beaches, [], "beach_id", "id").select("beach_id", F.when(F.col("risk_level") != "none", "some").otherwise("none").alias("mass"))
    z = latest(v.forecasts, ["zone_id"], "run_at").select("zone_id", F.col("risk_level").alias("zl"))
    j = n.join(own, "beach_id", "left").join(st, "beach_id", "left").join(z, "zone_id", "left")
    return j.select("beach_id", E.resolve_beach_level(F.col("own"), F.col("own"), F.col("mass"), F.col("beach_id") % 3 != 0, F.col("zl"), F.col("d")).alias("level"))


@query("prj_12_level_numbers", f"""
    SELECT id, CAST({level_int('amount')} AS INT) AS n, {int_level(level_int('amount'))} AS back FROM reports_v""", "reports_v")
def level_numbers(v):
    n = R.level_to_int(F.col("amount"))
    return v.reports.select("id", n.alias("n"), R.int_to_level(n).alias("back"))


@query("prj_22_exposure_adjusted", """
    SELECT id, CASE WHEN e < -0.2 AND risk_level = 'high' THEN 'medium' WHEN e < -0.2 AND risk_level = 'medium' THEN 'low' ELSE risk_level END AS level
    FROM (SELECT *, CASE WHEN id % 7 = 0 THEN NULL ELSE (id % 20 - 10) / 10.0 END AS e FROM forecasts_v)""", "forecasts_v")
def exposure_adjusted(v):
    e = F.when(F.col("id") % 7 != 0, (F.col("id") % 20 - 10) / 10.0)
    return v.forecasts.select("id", R.adjust_for_exposure(F.col("risk_level"), e).alias("level"))


@query("prj_23_possible", f"""
    WITH {member_sql('run, zone', 'stops_v')}
    SELECT run, zone, CAST(h AS INT) AS h, risk_level = 'none' AND 1 - round(p0, 3) >= 0.15 AS possible FROM hd WHERE h = 48""", "stops_v")
def possible(v):
    f = E.summarise(v.stops, ["run", "zone"])
    e = TJ.element_nearest(F.col("horizons"), "horizon_hours", F.lit(40))
    return f.select("run", "zone", e["horizon_hours"].alias("h"),
                    ((e["risk_level"] == "none") & (1.0 - e["probs"]["none"] >= S.POSSIBLE_SHARE)).alias("possible"))


@query("prj_16_extended_by_lead", """
    SELECT id, zone_id, risk_level, confidence, CAST(valid_at AS VARCHAR) AS valid_at FROM (SELECT *, rank() OVER (PARTITION BY zone_id, lead_days ORDER BY run_at DESC) AS r
    FROM extended_v) WHERE r = 1 AND lead_days = 14""", "extended_v")
def extended_by_lead(v):
    from tidelens.operators.alerts import extended_of

    return extended_of(latest(v.extended, ["zone_id", "lead_days"], "run_at"), 14).select(
        "id", "zone_id", "risk_level", "confidence", F.col("valid_at").cast("string").alias("valid_at"))


@query("scl_03_seasonal_level", f"""
    SELECT id, {season_level('month(run_at) % 12 + 1', region('lat', 'lon'))} AS level, {region('lat', 'lon')} AS region FROM (
      SELECT id, run_at + to_days(CAST(id % 365 AS INT)) AS run_at, lat, lon FROM detections_v)""", "detections_v")
def seasonal_level(v):
    day = F.date_add(F.to_date("run_at"), (F.col("id") % 365).cast("int"))
    reg = R.region_of(F.col("lat"), F.col("lon"))
    return v.detections.select("id", R.seasonal_level(F.month(day) % 12 + 1, reg).alias("level"), reg.alias("region"))


@query("dat_01_parse_time", """
    SELECT id, CASE WHEN id % 4 = 3 THEN NULL ELSE CAST(date_trunc('second', observed_at) AS VARCHAR) END AS ts FROM detections_v""", "detections_v")
def parse_time(v):
    k, t = F.col("id"), F.date_format("observed_at", "yyyy-MM-dd'T'HH:mm:ss")
    text = (F.when(k % 4 == 0, F.concat(t, F.lit("Z"))).when(k % 4 == 1, F.concat(t, F.lit("+00"))).when(k % 4 == 2, F.concat(t, F.lit("+00:00")))
            .otherwise(F.lit("soon")))
    return v.detections.select("id", D.parse_ts(text).cast("string").alias("ts"))


@query("dat_02_local_day", """
    SELECT id, CAST(CAST(observed_at - INTERVAL 4 HOUR AS DATE) AS VARCHAR) AS day,
           CAST(CAST(CAST(observed_at - INTERVAL 4 HOUR AS DATE) + 1 AS TIMESTAMP) + INTERVAL 4 HOUR AS VARCHAR) AS day_end FROM detections_v""", "detections_v")
def local_day(v):
    d = D.local_day(F.col("observed_at"))
    return v.detections.select("id", d.cast("string").alias("day"), D.local_day_end(d).cast("string").alias("day_end"))


@query("dat_03_millis_to_iso", """
    SELECT id, CASE WHEN id % 6 = 0 THEN NULL ELSE strftime(observed_at, '%Y-%m-%dT%H:%M:%S+00:00') END AS iso FROM detections_v""", "detections_v")
def millis_iso(v):
    ms = F.when(F.col("id") % 6 == 0, "n/a").otherwise(F.unix_millis("observed_at").cast("string"))
    return v.detections.select("id", D.millis_to_iso(ms).alias("iso"))


@query("dat_04_cyclic", """
    SELECT id, round(sin(2 * pi() * dayofyear(observed_at) / 365), 6) AS s, round(cos(2 * pi() * dayofyear(observed_at) / 365), 6) AS c FROM detections_v""",
       "detections_v")
def cyclic(v):
    s, c = D.cyclic(F.dayofyear("observed_at"), 365)
    return v.detections.select("id", F.round(s, 6).alias("s"), F.round(c, 6).alias("c"))


@query("dat_05_overpass_time", """
    SELECT id, CAST(CAST(CAST(observed_at AS DATE) AS TIMESTAMP) + INTERVAL '17 hours 30 minutes' AS VARCHAR) AS at FROM detections_v""", "detections_v")
def overpass(v):
    return v.detections.select("id", D.overpass_time(F.to_date("observed_at")).cast("string").alias("at"))


@query("dat_07_valid_and_target", """
    SELECT id, CAST(run_at + to_hours(CAST(n % 72 AS BIGINT)) AS VARCHAR) AS valid_at, CAST(CAST(run_at AS DATE) + 7 AS VARCHAR) AS target FROM forecasts_v""", "forecasts_v")
def valid_target(v):
    return v.forecasts.select("id", D.valid_at(F.col("run_at"), F.col("n") % 72).cast("string").alias("valid_at"),
                              F.date_add(F.to_date("run_at"), 7).cast("string").alias("target"))


@query("dat_08_regime", f"""
    WITH x AS (SELECT id, zone_id, lead_days, risk_level, CAST(id % 30 AS INT) AS ahead, CAST(run_at AS DATE) AS d0 FROM extended_v)
    SELECT id, ahead, CASE WHEN ahead BETWEEN 0 AND 3 THEN 'physics' WHEN ahead BETWEEN 4 AND 21 THEN 'extended' ELSE 'seasonal' END AS regime,
           CASE WHEN ahead BETWEEN 0 AND 3 THEN 'now' WHEN ahead BETWEEN 4 AND 21 THEN risk_level ELSE {season_level("month(d0 + ahead)", "'x'")} END AS level FROM x""",
       "extended_v")
def regime(v):
    ahead = (F.col("id") % 30).cast("int")
    mode = D.regime(ahead)
    day = F.date_add(F.to_date("run_at"), ahead)
    level = F.when(mode == "physics", "now").when(mode == "extended", F.col("risk_level")).otherwise(R.seasonal_level(F.month(day), F.lit("x")))
    return v.extended.select("id", ahead.alias("ahead"), mode.alias("regime"), level.alias("level"))


@query("dat_09_arrival_stamp", """
    SELECT id, CASE WHEN eta_hours IS NULL THEN '' ELSE strftime(run_at + to_hours(CAST(eta_hours AS BIGINT)) - INTERVAL 4 HOUR, '%d %b %H:%M') || ' AST' END AS arrival FROM forecasts_v""",
       "forecasts_v")
def arrival_stamp(v):
    return v.forecasts.select("id", D.local_stamp(D.valid_at(F.col("run_at"), F.col("eta_hours"))).alias("arrival"))


@query("srt_01_largest_detections", """
    SELECT id, area_km2 FROM detections_v WHERE run_at = (SELECT max(run_at) FROM detections_v) ORDER BY area_km2 DESC, id LIMIT 50""", "detections_v")
def largest(v):
    from tidelens.operators.alerts import largest_detections

    return largest_detections(v.detections, 50).select("id", "area_km2")


@query("srt_02_display_cap", """
    SELECT id, area_km2 FROM detections_v ORDER BY area_km2 DESC, id LIMIT 350""", "detections_v")
def display_cap(v):
    return v.detections.orderBy(F.desc("area_km2"), "id").limit(350).select("id", "area_km2")


@query("agg_20_day_summary", """
    WITH b AS (SELECT CAST(user_id AS VARCHAR) AS beach_name, round(sum(value), 2) / 3000 AS a, count(*) AS n FROM events GROUP BY 1),
    c AS (SELECT beach_name, CASE WHEN a < 1.0 THEN 'none' WHEN a < 1.1 THEN 'low' ELSE 'medium' END AS lv, n % 5 = 0 AS possible, n % 2 = 0 AS season,
          CASE WHEN n % 7 = 0 THEN NULL ELSE round(a * 10, 3) END AS dist FROM b)
    SELECT count(*) FILTER (lv = 'none' AND NOT possible) AS clear, count(*) FILTER (lv <> 'none') AS at_risk,
      CASE max(CASE lv WHEN 'none' THEN 0 WHEN 'low' THEN 1 ELSE 2 END) WHEN 1 THEN 'low' WHEN 2 THEN 'medium' END AS worst,
      (SELECT string_agg(beach_name, '|' ORDER BY rn) FROM (SELECT beach_name, row_number() OVER (ORDER BY season DESC, coalesce(dist, 1e6) DESC, beach_name) AS rn
        FROM c WHERE lv = 'none' AND NOT possible) WHERE rn <= 3) AS picks FROM c""")
def day_summary(v):
    b = v.events.groupBy(F.col("user_id").cast("string").alias("beach_name")).agg((F.round(F.sum("value"), 2) / 3000).alias("a"), F.count("*").alias("n"))
    c = b.select("beach_name", F.when(F.col("a") < 1.0, "none").when(F.col("a") < 1.1, "low").otherwise("medium").alias("risk_level"),
                 (F.col("n") % 5 == 0).alias("possible"), (F.col("n") % 2 == 0).alias("in_season"),
                 F.when(F.col("n") % 7 != 0, F.round(F.col("a") * 10, 3)).alias("dist_km"))
    return C.day_summary(c)
