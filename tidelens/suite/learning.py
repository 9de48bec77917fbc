"""Model fitting, walk-forward scores, extended forecasts, tuning. Properties are tested, not numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens.operators import scoring as SC
from tidelens.plans import features as FT
from tidelens.plans import model as M
from tidelens.plans import tuning as TU
from tidelens.session import shared_path
from tidelens.suite.forecasts import NEAR_SQL, member_sql
from tidelens.suite.registry import query
from tidelens.suite.reports import LABELS
from tidelens.suite.sqlbits import hav, int_level, region, score_cols, score_tail, season_level, zone_level

def rows(v):
    return FT.training_rows(v.features, v.zones)


@query("mle_01_03_classifier_probabilities")
def classifier(v):
    """Level, confidence and probabilities of every training row, by the model at its own settings."""
    data = rows(v)
    out = M.fit_classifier(data, calibrate=False).predict(data)
    return out.select(F.col("zone_id").cast("int").alias("zone_id"), F.col("lead_days").cast("int").alias("lead_days"), F.col("run_ts").cast("string").alias("run_ts"),
                      F.col("risk_int").cast("int").alias("truth"), "pred", F.round("confidence", 4).alias("confidence"), F.transform("probs", lambda p: F.round(p, 4)).alias("probs"))


@query("mle_02_calibrated_probabilities")
def calibrated(v):
    """The same with sigmoids on three later-in-time folds."""
    data = rows(v)
    out = M.fit_classifier(data).predict(data)
    return out.select(F.col("zone_id").cast("int").alias("zone_id"), F.col("lead_days").cast("int").alias("lead_days"), F.col("run_ts").cast("string").alias("run_ts"),
                      F.col("risk_int").cast("int").alias("truth"), "pred", F.round("confidence", 4).alias("confidence"))


@query("mle_04_walk_forward_scores")
def walk_forward(v):
    return M.walk_forward(rows(v), n_folds=3)["scores"]


@query("mle_06_seasonal_forecast", f"""
    SELECT CAST(run_at AS VARCHAR) AS run_at, zone_id, CAST(l AS INT) AS lead_days, {season_level("month(run_at + to_days(CAST(l AS INT)))", region('center_lat', 'center_lon'))} AS risk_level, 0.4 AS confidence, 'seasonal' AS method
    FROM features_v JOIN zones_v USING (zone_id), (SELECT unnest([7, 14, 21]) AS l)""", "features_v zones_v")
def seasonal_forecast(v):
    return M.extended_forecast(v.features, v.zones, "seasonal").select(F.col("run_at").cast("string").alias("run_at"), "zone_id", "lead_days", "risk_level", "confidence", "method")


@query("mle_06_persistence_forecast", f"""
    SELECT CAST(run_at AS VARCHAR) AS run_at, zone_id, CAST(l AS INT) AS lead_days, {int_level('physics_risk')} AS risk_level, CASE l WHEN 7 THEN 0.7 WHEN 14 THEN 0.6 ELSE 0.5 END AS confidence, CAST(CAST(run_at AS DATE) + CAST(l AS INT) AS VARCHAR) AS valid_at
    FROM features_v JOIN zones_v USING (zone_id), (SELECT unnest([7, 14, 21]) AS l)""", "features_v zones_v")
def persistence_forecast(v):
    return M.extended_forecast(v.features, v.zones, "persistence", accuracy={7: 0.7, 14: 0.6}).select(
        F.col("run_at").cast("string").alias("run_at"), "zone_id", "lead_days", "risk_level", "confidence", F.col("valid_at").cast("string").alias("valid_at"))


@query("mle_06_model_forecast")
def model_forecast(v):
    out = M.extended_forecast(v.features, v.zones, "ml", M.fit_classifier(rows(v)))
    return out.select(F.col("run_at").cast("string").alias("run_at"), "zone_id", "lead_days", "risk_level", "confidence", "method")


@query("mle_08_agg_29_tuned_settings", f"""
    WITH {LABELS}, s AS (SELECT TIMESTAMP '2024-01-01' + to_days((run - 1995) * 4) AS run_at, zone, member, hour AS hr,
        unnest(['outline', 'covered']) AS field, unnest([area, covered]) AS area FROM stops_v),
    hourly AS (SELECT run_at, zone, member, field, hr, sum(area) AS area FROM s WHERE hr <= 72 GROUP BY ALL),
    cum AS (SELECT *, sum(area) OVER (PARTITION BY run_at, zone, member, field ORDER BY hr) AS c FROM hourly),
    per AS (SELECT run_at, zone, member, field, scale, h, sum(CASE WHEN hr <= h THEN area ELSE 0 END) AS a, min(CASE WHEN c >= 5.0 * scale AND hr <= h THEN hr END) AS eta
            FROM cum, (SELECT unnest([0, 24, 48, 72]) AS h), (SELECT unnest([0.5::DOUBLE, 1.0, 2.0]) AS scale) GROUP BY ALL),
    lev AS (SELECT *, {zone_level('a', 'eta', '0.5 * scale', '5.0 * scale', '25.0 * scale')} AS lv FROM per),
    sh AS (SELECT run_at, zone, field, scale, h, count(*) FILTER (lv = 'low') / 24.0 AS p1, count(*) FILTER (lv = 'medium') / 24.0 AS p2, count(*) FILTER (lv = 'high') / 24.0 AS p3
           FROM lev GROUP BY ALL),
    hd AS (SELECT *, CASE WHEN p3 >= 0.5 THEN 3 WHEN p3 + p2 >= 0.5 THEN 2 WHEN p3 + p2 + p1 >= 0.5 THEN 1 ELSE 0 END AS pred,
                  CAST(run_at + to_hours(h) - INTERVAL 4 HOUR AS DATE) AS day FROM sh),
    iss AS (SELECT *, row_number() OVER (PARTITION BY zone, day, h, field, scale ORDER BY run_at DESC) AS rn FROM hd
            WHERE run_at <= CAST(day + 1 AS TIMESTAMP) + INTERVAL 4 HOUR),
    p AS (SELECT field || ' | thr x' || CAST(scale AS VARCHAR) AS setting, truth, pred FROM labels JOIN iss ON ident = zone AND labels.day = iss.day WHERE rn = 1 AND h = 24),
    sc AS (SELECT setting, {score_cols()}, {score_tail()} FROM p GROUP BY setting)
    SELECT setting, 'physics_24h' AS "primary", n, macro_f1, mae, pod, far FROM sc""", "reports_v stops_v")
def tuned(v):
    stops = v.stops.withColumn("run_at", F.timestamp_add("DAY", (F.col("run") - 1995) * 4, F.lit("2024-01-01").cast("timestamp"))).withColumnRenamed("area", "outline")
    labels = SC.report_labels(v.reports, "zone_id").select("ident", "day", "truth")
    return TU.tune(stops, labels, ["outline", "covered"], [0.5, 1.0, 2.0])


def run_inputs(v):
    from tidelens.plans.scheduled import RunInputs

    d = v.detections.select("id", F.col("lat").alias("centroid_lat"), F.col("lon").alias("centroid_lon"), "area_km2", "source", "observed_at")
    clusters = d.where("source = 'view'").withColumn("observed_on", F.to_date("observed_at")).drop("observed_at")
    stops = v.stops.select(F.col("zone").alias("zone_id"), "member", "hour", "area", "lat", "lon")
    return RunInputs(d.where("source = 'click'"), clusters, d.where("source = 'click' and id % 2 = 0").select("id"), stops, v.zones, v.beaches, v.subscribers, v.features)


NEAR_15 = hav("a.lat", "a.lon", "b.lat", "b.lon")
LEVEL_ROWS = "SELECT '{0}' AS table_name, risk_level AS measure, CAST(count(*) AS DOUBLE) AS value FROM {1} GROUP BY risk_level"


@query("ram_06_scheduled_run", f"""
    WITH p AS (SELECT * FROM detections_v WHERE source = 'click'), c AS (SELECT * FROM detections_v WHERE source = 'view'),
    ph AS (SELECT a.id, EXISTS (SELECT 1 FROM c b WHERE abs(b.lat - a.lat) < 0.2 AND {NEAR_15} <= 15) AS hit FROM p a),
    ch AS (SELECT a.id, a.area_km2, a.lat, a.lon, EXISTS (SELECT 1 FROM p b WHERE abs(b.lat - a.lat) < 0.2 AND {NEAR_15} <= 15) AS hit FROM c a),
    merged AS (SELECT lat, lon, area_km2 FROM p UNION ALL SELECT lat, lon, area_km2 FROM ch WHERE NOT hit),
    {member_sql('zone', 'stops_v')}, zf AS (SELECT zone_id, name, coalesce(risk_level, 'none') AS risk_level FROM zones_v LEFT JOIN (SELECT * FROM hd WHERE h = 72) ON zone = zone_id),
    {NEAR_SQL}, {member_sql('beach_id', 'near', '0.1', 'b_')},
    al AS (SELECT s.id FROM subscribers_v s JOIN zf USING (zone_id) WHERE channel = 'telegram' AND (last_alerted IS NULL OR last_alerted <= TIMESTAMP '2024-01-31 18:00:00') AND risk_level IN ('medium', 'high')),
    m AS (SELECT 'checks' AS t, unnest(['patches', 'checkable', 'confirmed']) AS k, unnest([count(*), count(*) FILTER (id % 2 = 0), count(*) FILTER (id % 2 = 0 AND hit)]) AS x FROM ph
      UNION ALL SELECT 'checks', unnest(['clusters', 'matched', 'gap_filled', 'gap_filled_area_km2']),
        unnest([count(*), count(*) FILTER (hit), count(*) FILTER (NOT hit), round(coalesce(sum(area_km2) FILTER (NOT hit), 0), 4)]) FROM ch
      UNION ALL SELECT unnest(['patches', 'detections', 'patches']), unnest(['rows', 'rows', 'area_km2']), unnest([count(*), count(*), round(sum(area_km2), 3)]) FROM merged
      UNION ALL SELECT 'alerts', unnest(['rows', 'ids']), unnest([count(*), coalesce(sum(id), 0)]) FROM al
      UNION ALL SELECT unnest(['zone_features', 'ml_forecasts', 'evaluation']), 'rows', unnest([count(*), 3 * count(*), 1]) FROM zones_v)
    SELECT t AS table_name, k AS measure, CAST(x AS DOUBLE) AS value FROM m
    UNION ALL {LEVEL_ROWS.format('forecasts', 'zf')} UNION ALL {LEVEL_ROWS.format('beach_forecasts', '(SELECT * FROM b_hd WHERE h = 72)')}""",
       "detections_v stops_v zones_v beaches_v subscribers_v")
def scheduled_run(v):
    """Counts and sums of every table that one run committed."""
    from tidelens.plans.scheduled import committed, run_once

    out = shared_path(v.spark, "run")
    done = run_once(v.spark, run_inputs(v), "2024-02-01 00:00:00", out)
    if set(done.values()) != {"ok"}:
        raise RuntimeError(f"stages of the run: {done}")
    t = lambda name: committed(v.spark, out, name)
    line = lambda name, **m: t(name).agg(*[c.cast("double").alias(k) for k, c in m.items()]).unpivot([], list(m), "measure", "value").select(
        F.lit(name).alias("table_name"), "measure", "value")
    rows, area = F.count("*"), F.round(F.sum("area_km2"), 3)
    counted = ("patches", "checkable", "confirmed", "clusters", "matched", "gap_filled", "gap_filled_area_km2")
    parts = [line("checks", **{c: F.sum(c) for c in counted}), line("patches", rows=rows, area_km2=area), line("detections", rows=rows),
             line("alerts", rows=rows, ids=F.coalesce(F.sum("id"), F.lit(0))), *[line(n, rows=rows) for n in ("zone_features", "ml_forecasts", "evaluation")]]
    parts += [t(n).groupBy(F.col("risk_level").alias("measure")).agg(rows.cast("double").alias("value")).select(F.lit(n).alias("table_name"), "measure", "value")
              for n in ("forecasts", "beach_forecasts")]
    return reduce(DataFrame.unionByName, parts)


RANKED = f"""
    p AS (SELECT doc_id % 5 AS s, quality AS truth, toxic AS pred FROM labels), sc AS (SELECT s, {score_cols()} FROM p GROUP BY s)"""


@query("srt_05_ranked_settings", f"""
    WITH {RANKED} SELECT 'set' || s AS setting, n, macro_f1, mae FROM sc ORDER BY macro_f1 DESC NULLS LAST, mae, 1""")
def ranked_settings(v):
    p = v.table("labels").select(F.concat(F.lit("set"), (F.col("doc_id") % 5).cast("string")).alias("setting"), F.col("quality").alias("truth"), F.col("toxic").alias("pred"))
    p = p.withColumn("name", F.concat(F.lit("beach_24h @"), F.col("setting")))
    return SC.rank_settings(SC.score(p, ["setting", "name"])).select("setting", "n", "macro_f1", "mae")


@query("scl_02_nearby_level", """
    SELECT id, CASE WHEN w < 0.3 THEN 'none' WHEN w >= 3.0 AND km <= 8 THEN 'high' WHEN w >= 12 THEN 'high' WHEN w >= 3.0 THEN 'medium' ELSE 'low' END AS level FROM (
      SELECT id, area_km2 * 4 AS w, CASE WHEN id % 3 <> 0 THEN id % 25 * 1.0 END AS km FROM detections_v)""", "detections_v")
def nearby_levels(v):
    from tidelens.functions.risk import nearby_level

    km = F.when(F.col("id") % 3 != 0, F.col("id") % 25 * 1.0)
    return v.detections.select("id", nearby_level(F.col("area_km2") * 4, km).alias("level"))
