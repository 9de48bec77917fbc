"""Labels, scores, as-of pairing, folds, alerts and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelens.functions import text as X
from tidelens.operators import alerts as A
from tidelens.operators import scoring as SC
from tidelens.operators import timejoin as TJ
from tidelens.operators.keyed import latest
from tidelens.plans import features as FT
from tidelens.suite.registry import query
from tidelens.suite.sqlbits import hav, level_int, region, score_cols, score_tail, season_level

LABELS = f"""
    v AS (SELECT zone_id AS ident, observed_on AS day, {level_int('amount')} AS level FROM reports_v WHERE amount IN ('none', 'low', 'medium', 'high')),
    labels AS (SELECT ident, day, CAST(quantile_disc(level, 0.5) AS INT) AS truth, count(*) AS n_reports FROM v GROUP BY 1, 2)"""
BLABELS = f"""
    bv AS (SELECT CAST(beach AS VARCHAR) AS ident, observed_on AS day, {level_int('amount')} AS level FROM reports_v WHERE amount IN ('none', 'low', 'medium', 'high')),
    blabels AS (SELECT ident, day, CAST(quantile_disc(level, 0.5) AS INT) AS truth FROM bv GROUP BY 1, 2)"""
ISSUED = f"""
    issued AS (SELECT zone_id AS ident, day, horizon_hours, version, {level_int('risk_level')} AS pred FROM (
      SELECT *, row_number() OVER (PARTITION BY zone_id, day, horizon_hours, version ORDER BY run_at DESC, id) AS rn FROM (
        SELECT id, run_at, zone_id, horizon_hours, risk_level, coalesce(model_version, 'legacy') AS version, CAST(valid_at - INTERVAL 4 HOUR AS DATE) AS day FROM horizons_v)
      WHERE run_at <= CAST(day + 1 AS TIMESTAMP) + INTERVAL 4 HOUR) WHERE rn = 1)"""
BISSUED = f"""
    bissued AS (SELECT ident, day, h, {level_int('lv')} AS pred FROM (
      SELECT *, row_number() OVER (PARTITION BY ident, day, h ORDER BY run_at DESC, id) AS rn FROM (
        SELECT id, run_at, beach_name AS ident, h, CAST(run_at + to_hours(CAST(h AS BIGINT)) - INTERVAL 4 HOUR AS DATE) AS day,
          CASE WHEN area * (1 + h / 48.0) < 0.1 THEN 'none' WHEN area * (1 + h / 48.0) < 5 THEN 'low' WHEN area * (1 + h / 48.0) < 25 THEN 'medium' ELSE 'high' END AS lv
        FROM beach_forecasts_v, (SELECT unnest([0, 24, 48, 72]) AS h))
      WHERE run_at <= CAST(day + 1 AS TIMESTAMP) + INTERVAL 4 HOUR) WHERE rn = 1)"""
PAIRS = f"""
    {LABELS}, {BLABELS}, {ISSUED}, {BISSUED},
    ext AS (SELECT zone_id AS ident, day, lead_days, version, {level_int('risk_level')} AS pred, method FROM (
      SELECT *, valid_at AS day, coalesce(model_version, 'legacy') AS version,
        row_number() OVER (PARTITION BY zone_id, valid_at, lead_days, coalesce(model_version, 'legacy') ORDER BY run_at DESC, id) AS rn FROM extended_v) WHERE rn = 1),
    pairs AS (
      SELECT 'seasonal' AS name, CAST(NULL AS VARCHAR) AS method, truth, {level_int(season_level('month(day)', region('center_lat', 'center_lon')))} AS pred
        FROM labels JOIN zones_v ON zone_id = ident
      UNION ALL SELECT 'physics_' || horizon_hours || 'h @' || version, NULL, truth, pred FROM labels JOIN issued USING (ident, day)
      UNION ALL SELECT 'extended_' || lead_days || 'd @' || version, method, truth, pred FROM labels JOIN ext USING (ident, day)
      UNION ALL SELECT 'beach_' || h || 'h @legacy', NULL, truth, pred FROM blabels JOIN bissued USING (ident, day))"""
PAIR_VIEWS = "reports_v zones_v horizons_v extended_v beach_forecasts_v"


def beach_reports(v):
    return v.reports.withColumn("beach_name", F.col("beach").cast("string"))


def all_pairs(v):
    return SC.score_pairs(SC.report_labels(v.reports, "zone_id").drop("n_reports"), v.zones, v.forecasts, v.extended,
                          SC.report_labels(beach_reports(v), "beach_name").drop("n_reports"), v.beach_forecasts)


@query("agg_12_report_labels", f"""
    WITH {LABELS} SELECT ident, CAST(day AS VARCHAR) AS day, truth, n_reports FROM labels WHERE n_reports >= 2""", "reports_v")
def report_labels(v):
    return SC.report_labels(v.reports, "zone_id", 2).withColumn("day", F.col("day").cast("string"))


@query("agg_17_label_strength", f"""
    WITH {LABELS} SELECT n_reports, count(*) AS labels FROM labels GROUP BY 1""", "reports_v")
def label_strength(v):
    return SC.label_strength(v.reports, "zone_id")


@query("jon_19_issued_in_time", f"""
    WITH {ISSUED} SELECT ident AS zone_id, CAST(day AS VARCHAR) AS day, CAST(horizon_hours AS INT) AS horizon_hours, version AS model_version, pred FROM issued""", "horizons_v")
def issued(v):
    return TJ.issued_in_time(v.forecasts, "zone_id", "id").withColumn("day", F.col("day").cast("string"))


@query("jon_20_score_pairs", f"""
    WITH {PAIRS} SELECT name, truth, pred, count(*) AS n FROM pairs GROUP BY 1, 2, 3""", PAIR_VIEWS)
def score_pairs(v):
    return all_pairs(v).groupBy("name", "truth", "pred").agg(F.count("*").alias("n"))


@query("agg_13_scores", f"""
    WITH {PAIRS} SELECT name, {score_cols()}, {score_tail()} FROM pairs GROUP BY name""", PAIR_VIEWS)
def scores(v):
    return SC.score(all_pairs(v), ["name"])


@query("agg_13_label_table_scores", f"""
    WITH p AS (SELECT lang, toxic AS pred, quality AS truth FROM labels JOIN documents USING (doc_id)) SELECT lang, {score_cols()}, {score_tail()} FROM p GROUP BY lang""")
def label_table_scores(v):
    p = v.table("labels").join(v.table("documents").select("doc_id", "lang"), "doc_id")
    return SC.score(p.select("lang", F.col("toxic").alias("pred"), F.col("quality").alias("truth")), ["lang"])


@query("agg_18_methods_used", f"""
    WITH {PAIRS} SELECT name, method, count(*) AS n FROM pairs WHERE method IS NOT NULL GROUP BY 1, 2""", PAIR_VIEWS)
def methods_used(v):
    return SC.methods_used(all_pairs(v))


@query("agg_14_brier", f"""
    WITH t AS (SELECT *, {level_int('amount')} AS truth, (id % 10) / 10.0 AS p0, (1 - (id % 10) / 10.0) / 2 AS p1, (1 - (id % 10) / 10.0) / 4 AS p2,
               (1 - (id % 10) / 10.0) / 4 AS p3 FROM reports_v)
    SELECT zone_id, round(avg(pow(p0 - (truth = 0)::INT, 2) + pow(p1 - (truth = 1)::INT, 2) + pow(p2 - (truth = 2)::INT, 2) + pow(p3 - (truth = 3)::INT, 2)), 4) AS brier
    FROM t GROUP BY zone_id""", "reports_v")
def brier(v):
    from tidelens.functions.risk import level_to_int

    p0 = (F.col("id") % 10) / 10.0
    r = v.reports.select("zone_id", level_to_int(F.col("amount")).alias("truth"),
                         F.array(p0, (1 - p0) / 2, (1 - p0) / 4, (1 - p0) / 4).alias("probs"))
    return SC.brier(r, ["zone_id"])


@query("prj_27_score_window", f"""
    WITH {LABELS} SELECT id FROM forecasts_v WHERE run_at >= (SELECT CAST(min(day) AS TIMESTAMP) + INTERVAL 9 DAY FROM labels)""", "reports_v forecasts_v")
def score_window(v):
    labels = SC.report_labels(v.reports, "zone_id")
    return SC.in_score_window(v.forecasts, labels, days=-9).select("id")


# as-of pairs of the training rows: the nearest run of the zone to run + lead, within 12 hours, the earlier one on ties
TRAIN = """
    z AS (SELECT zone_id, center_lat, center_lon FROM zones_v),
    left_ AS (SELECT f.*, lead_days, run_at + to_days(CAST(lead_days AS INT)) AS target FROM features_v f, (SELECT unnest([7, 14, 21]) AS lead_days)),
    cand AS (SELECT l.*, r.physics_risk AS label, row_number() OVER (PARTITION BY l.zone_id, l.run_at, l.lead_days
        ORDER BY abs(epoch_us(r.run_at) - epoch_us(l.target)), r.run_at) AS rn
      FROM left_ l JOIN features_v r ON r.zone_id = l.zone_id AND r.run_at BETWEEN l.target - INTERVAL 12 HOUR AND l.target + INTERVAL 12 HOUR),
    train AS (SELECT c.* , center_lat, center_lon FROM cand c JOIN z USING (zone_id) WHERE rn = 1)"""


@query("jon_06_training_rows", f"""
    WITH {TRAIN} SELECT CAST(run_at AS VARCHAR) AS run_ts, CAST(target AS VARCHAR) AS target_ts, zone_id, lead_days, CAST(label AS INT) AS risk_int,
      physics_risk AS physics_now, round(sin(2 * pi() * dayofyear(run_at) / 365), 6) AS f_doy_sin, round(ln(1 + eez_area_km2), 6) AS f_log_eez_area,
      round(ln(1 + patch_count), 6) AS f_log_patch_count FROM train""", "features_v zones_v")
def training_rows(v):
    t = FT.training_rows(v.features, v.zones)
    return t.select(F.col("run_ts").cast("string").alias("run_ts"), F.col("target_ts").cast("string").alias("target_ts"), "zone_id", "lead_days",
                    "risk_int", "physics_now", F.round("f_doy_sin", 6).alias("f_doy_sin"), F.round("f_log_eez_area", 6).alias("f_log_eez_area"),
                    F.round("f_log_patch_count", 6).alias("f_log_patch_count"))


@query("srt_03_sorted_training_rows", f"""
    WITH {TRAIN} SELECT CAST(run_at AS VARCHAR) AS run_ts, zone_id, lead_days FROM train ORDER BY 1, 2, 3""", "features_v zones_v")
def sorted_rows(v):
    return FT.sorted_rows(FT.training_rows(v.features, v.zones)).select(F.col("run_ts").cast("string").alias("run_ts"), "zone_id", "lead_days")


@query("scl_15_feature_vector", """
    SELECT CAST(run_at AS VARCHAR) AS run_at, zone_id, round(sin(2 * pi() * dayofyear(run_at) / 365), 6) AS doy_sin, round(cos(2 * pi() * dayofyear(run_at) / 365), 6) AS doy_cos,
      round(sin(2 * pi() * month(run_at) / 12), 6) AS month_sin, round(cos(2 * pi() * month(run_at) / 12), 6) AS month_cos, round(ln(1 + eez_area_km2), 6) AS log_eez_area,
      round(ln(1 + zone_area_km2), 6) AS log_zone_area, round(ln(1 + nearest_km), 6) AS log_nearest_km, round(ln(1 + patch_count), 6) AS log_patch_count,
      physics_risk * 1.0 AS physics_risk, round(center_lat, 4) AS zone_lat, round(center_lon, 4) AS zone_lon, 7.0 AS lead_days FROM features_v JOIN zones_v USING (zone_id)""",
       "features_v zones_v")
def feature_vector(v):
    f = v.features.join(v.zones, "zone_id")
    g = f.select(F.col("run_at").cast("string").alias("run_at"), "zone_id", *FT.feature_columns(F.col("run_at"), F.lit(7)))
    return g.select("run_at", "zone_id", *[F.round(f"f_{n}", 6).alias(n) if n not in ("physics_risk", "lead_days", "zone_lat", "zone_lon")
                                           else F.round(f"f_{n}", 4).alias(n) for n in FT.FEATURES])


@query("jon_08_report_training_rows", f"""
    WITH {LABELS}, w AS (SELECT ident AS zone_id, day, truth, lead_days, CAST(day AS TIMESTAMP) + INTERVAL 16 HOUR AS target,
        CAST(day AS TIMESTAMP) + INTERVAL 16 HOUR - to_days(CAST(lead_days AS INT)) AS want FROM labels, (SELECT unnest([7, 14, 21]) AS lead_days)),
    c AS (SELECT w.*, r.run_at, r.physics_risk, row_number() OVER (PARTITION BY w.zone_id, day, lead_days ORDER BY abs(epoch_us(r.run_at) - epoch_us(want)), r.run_at) AS rn
      FROM w JOIN features_v r ON r.zone_id = w.zone_id AND r.run_at BETWEEN want - INTERVAL 12 HOUR AND want + INTERVAL 12 HOUR)
    SELECT CAST(c.run_at AS VARCHAR) AS run_ts, CAST(target AS VARCHAR) AS target_ts, c.zone_id, lead_days, truth AS risk_int, physics_risk AS physics_now
    FROM c JOIN zones_v z ON z.zone_id = c.zone_id WHERE rn = 1""", "reports_v features_v zones_v")
def report_training_rows(v):
    t = FT.report_training_rows(v.features, v.zones, SC.report_labels(v.reports, "zone_id"))
    return t.select(F.col("run_ts").cast("string").alias("run_ts"), F.col("target_ts").cast("string").alias("target_ts"), "zone_id", "lead_days", "risk_int", "physics_now")


@query("mle_07_label_source", f"""
    WITH {LABELS}, w AS (SELECT ident AS zone_id, day, lead_days, CAST(day AS TIMESTAMP) + INTERVAL 16 HOUR - to_days(CAST(lead_days AS INT)) AS want
        FROM labels, (SELECT unnest([7, 14, 21]) AS lead_days)),
    r AS (SELECT count(*) AS n FROM w WHERE EXISTS (SELECT 1 FROM features_v r WHERE r.zone_id = w.zone_id AND r.run_at BETWEEN want - INTERVAL 12 HOUR AND want + INTERVAL 12 HOUR)),
    {TRAIN.strip()}, p AS (SELECT count(*) AS n FROM train)
    SELECT CASE WHEN r.n >= 150 THEN 'reports' ELSE 'physics' END AS source, CASE WHEN r.n >= 150 THEN r.n ELSE p.n END AS n_rows FROM r, p""",
       "reports_v features_v zones_v")
def label_source(v):
    rows, source = FT.choose_rows(FT.report_training_rows(v.features, v.zones, SC.report_labels(v.reports, "zone_id")),
                                  FT.training_rows(v.features, v.zones))
    return rows.agg(F.count("*").alias("n_rows")).withColumn("source", F.lit(source))


@query("jon_09_paired_runs", """
    WITH f AS (SELECT DISTINCT date_trunc('minute', ts) AS run_at FROM events WHERE event_type = 'view'),
    d AS (SELECT DISTINCT ts AS det_run FROM events WHERE event_type = 'signup'),
    c AS (SELECT run_at, det_run, row_number() OVER (PARTITION BY run_at ORDER BY abs(epoch_us(det_run) - epoch_us(run_at)), det_run) AS rn
      FROM f LEFT JOIN d ON det_run BETWEEN run_at - INTERVAL 2 HOUR AND run_at + INTERVAL 2 HOUR)
    SELECT CAST(run_at AS VARCHAR) AS run_at, CAST(epoch_us(det_run) AS BIGINT) AS det_us FROM c WHERE rn = 1""")
def paired_runs(v):
    f = v.events.where("event_type = 'view'").select(F.date_trunc("minute", "ts").alias("run_at"))
    d = v.events.where("event_type = 'signup'").select(F.col("ts").alias("run_at"))
    p = FT.pair_runs(f, d)
    return p.select(F.col("run_at").cast("string").alias("run_at"), F.unix_micros("det_run").alias("det_us"))


@query("jon_29_history_features", f"""
    WITH f AS (SELECT run_at + INTERVAL 1 HOUR AS run_at, zone_id, risk_level FROM forecasts_v),
    runs AS (SELECT DISTINCT run_at FROM f), t AS (SELECT * REPLACE (run_at + CASE WHEN day(run_at) % 5 = 0 THEN INTERVAL 210 MINUTE ELSE INTERVAL 0 MINUTE END AS run_at) FROM detections_v),
    d AS (SELECT DISTINCT run_at AS det_run FROM t),
    p AS (SELECT run_at, det_run FROM runs LEFT JOIN d ON det_run BETWEEN run_at - INTERVAL 2 HOUR AND run_at + INTERVAL 2 HOUR),
    x AS (SELECT p.run_at, zone_id, area_km2, {hav('center_lat', 'center_lon', 'lat', 'lon')} AS km FROM p JOIN t ON t.run_at = p.det_run, zones_v),
    s AS (SELECT run_at, zone_id, sum(area_km2) AS eez, sum(CASE WHEN km <= 200 THEN area_km2 ELSE 0 END) AS zn, min(km) AS nr, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT CAST(r.run_at AS VARCHAR) AS run_at, z.zone_id, round(coalesce(eez, 0.0), 6) AS eez_area_km2, round(coalesce(zn, 0.0), 6) AS zone_area_km2,
      round(coalesce(nr, 999.0), 3) AS nearest_km, coalesce(n, 0) AS patch_count, coalesce({level_int('f.risk_level')}, 0) AS physics_risk
    FROM runs r CROSS JOIN zones_v z LEFT JOIN s ON s.run_at = r.run_at AND s.zone_id = z.zone_id LEFT JOIN f ON f.run_at = r.run_at AND f.zone_id = z.zone_id""",
       "forecasts_v detections_v zones_v")
def history_features(v):
    f = v.forecasts.select((F.col("run_at") + F.expr("INTERVAL 1 HOUR")).alias("run_at"), "zone_id", "risk_level")
    late = F.when(F.dayofmonth("run_at") % 5 == 0, F.expr("INTERVAL 210 MINUTE")).otherwise(F.expr("INTERVAL 0 MINUTE"))
    d = v.detections.withColumn("run_at", F.col("run_at") + late)  # some runs come too late to pair
    return FT.history_features(f, d, v.zones).withColumn("run_at", F.col("run_at").cast("string"))


FEATURE_SQL = f"""
    x AS (SELECT run_at, zone_id, area_km2, {hav('center_lat', 'center_lon', 'lat', 'lon')} AS km FROM detections_v, zones_v),
    s AS (SELECT run_at, zone_id, sum(area_km2) AS eez, sum(CASE WHEN km <= 200 THEN area_km2 ELSE 0 END) AS zn, min(km) AS nr, count(*) AS n FROM x GROUP BY 1, 2)
    SELECT CAST(s.run_at AS VARCHAR) AS run_at, s.zone_id, round(eez, 6) AS eez_area_km2, round(zn, 6) AS zone_area_km2, round(nr, 3) AS nearest_km,
      s.n AS patch_count, coalesce({level_int('f.risk_level')}, 0) AS physics_risk"""


@query("prj_13_zone_feature_rows", f"""
    WITH {FEATURE_SQL} FROM s LEFT JOIN forecasts_v f ON f.run_at = s.run_at AND f.zone_id = s.zone_id""", "forecasts_v detections_v zones_v")
def zone_feature_rows(v):
    return FT.zone_feature_rows(v.detections, v.zones, v.forecasts).withColumn("run_at", F.col("run_at").cast("string"))


@query("mle_09_rebuilt_features", f"""
    WITH {FEATURE_SQL}, 'drift' AS model_version FROM s LEFT JOIN forecasts_v f ON f.run_at = s.run_at AND f.zone_id = s.zone_id""", "forecasts_v detections_v zones_v")
def rebuilt_features(v):
    return FT.rebuild_features(v.detections, v.forecasts, v.zones, "drift").withColumn("run_at", F.col("run_at").cast("string"))


@query("prj_26_version_filter", """
    SELECT CAST(run_at AS VARCHAR) AS run_at, zone_id FROM features_v WHERE model_version IN ('drift')""", "features_v")
def version_filter(v):
    return FT.only_versions(v.features, ["drift"]).select(F.col("run_at").cast("string").alias("run_at"), "zone_id")


@query("win_12_time_blocks", """
    SELECT CAST(block AS INT) AS block, CAST(min(run_at) AS VARCHAR) AS "start", CAST(max(run_at) AS VARCHAR) AS "end", count(*) AS runs FROM (
      SELECT run_at, ntile(4) OVER (ORDER BY run_at) AS block FROM (SELECT DISTINCT run_at FROM features_v)) GROUP BY block""", "features_v")
def time_blocks(v):
    b = TJ.time_blocks(v.features.withColumnRenamed("run_at", "run_ts"), "run_ts", 4)
    return b.select("block", F.col("start").cast("string").alias("start"), F.col("end").cast("string").alias("end"), "runs")


BLOCKS = """
    blocks AS (SELECT block, min(run_at) AS b0, max(run_at) AS b1 FROM (SELECT run_at, ntile(4) OVER (ORDER BY run_at) AS block
      FROM (SELECT DISTINCT run_at FROM train)) GROUP BY block),
    split AS (SELECT t.*, block, CASE WHEN run_at BETWEEN b0 AND b1 THEN 'test' WHEN target < b0 THEN 'train' END AS part FROM train t, blocks
      WHERE block > 1 AND (run_at BETWEEN b0 AND b1 OR target < b0))"""


def split_rows(v):
    rows = FT.training_rows(v.features, v.zones)
    return TJ.purged_split(rows, TJ.time_blocks(rows, "run_ts", 4))


@query("jon_26_purged_split", f"""
    WITH {TRAIN}, {BLOCKS} SELECT CAST(block AS INT) AS block, part, count(*) AS n, CAST(max(target) AS VARCHAR) AS last_label FROM split GROUP BY 1, 2""", "features_v zones_v")
def purged_split(v):
    return split_rows(v).groupBy("block", "part").agg(F.count("*").alias("n"), F.max("target_ts").cast("string").alias("last_label"))


MAJ = """
    maj AS (SELECT block, label AS majority FROM (SELECT block, label, row_number() OVER (PARTITION BY block ORDER BY count(*) DESC, min((run_at, zone_id, lead_days))) AS rn
      FROM split WHERE part = 'train' GROUP BY 1, 2) WHERE rn = 1)"""


@query("agg_16_majority_class", f"""
    WITH {TRAIN}, {BLOCKS}, {MAJ} SELECT CAST(block AS INT) AS block, CAST(majority AS INT) AS majority FROM maj""", "features_v zones_v")
def majority_class(v):
    train = split_rows(v).where("part = 'train'")
    return SC.majority_class(train, ["block"], "risk_int", [F.col("run_ts"), F.col("zone_id"), F.col("lead_days")])


BASE = f"""
    base AS (SELECT lead_days, CAST(label AS INT) AS truth, {level_int(season_level('month(target)', region('center_lat', 'center_lon')))} AS seasonal,
      physics_risk AS persistence, majority FROM split JOIN maj USING (block) WHERE part = 'test'),
    long AS (SELECT 'seasonal' AS method, lead_days, truth, seasonal AS pred FROM base UNION ALL SELECT 'persistence', lead_days, truth, persistence FROM base
      UNION ALL SELECT 'majority', lead_days, truth, majority FROM base)"""


def base_pairs(v):
    from tidelens.plans.model import baselines, long_pairs

    return long_pairs(baselines(split_rows(v)), ("seasonal", "persistence", "majority"))


@query("mle_10_baselines", f"""
    WITH {TRAIN}, {BLOCKS}, {MAJ}, {BASE} SELECT method, truth, CAST(pred AS INT) AS pred, count(*) AS n FROM long GROUP BY ALL""", "features_v zones_v")
def baselines(v):
    return base_pairs(v).groupBy("method", "truth", "pred").agg(F.count("*").alias("n"))


@query("agg_15_pooled_and_lead_scores", f"""
    WITH {TRAIN}, {BLOCKS}, {MAJ}, {BASE} SELECT method, lead_days, {score_cols()} FROM long GROUP BY GROUPING SETS ((method, lead_days), (method))""", "features_v zones_v")
def pooled_scores(v):
    return SC.score_with_pool(base_pairs(v), "method", "lead_days")


@query("mle_05_method_choice", f"""
    WITH {TRAIN}, {BLOCKS}, {MAJ}, {BASE}, s AS (SELECT method, {score_cols()} FROM long GROUP BY method)
    SELECT CASE WHEN (SELECT macro_f1 FROM s WHERE method = 'persistence') > (SELECT macro_f1 FROM s WHERE method = 'seasonal') THEN 'persistence' ELSE 'seasonal' END AS chosen""",
       "features_v zones_v")
def method_choice(v):
    return SC.choose_method(SC.score_with_pool(base_pairs(v), "method", "lead_days").where("lead_days is null"))


@query("win_07_thinned_runs", """
    WITH RECURSIVE t AS (SELECT DISTINCT date_trunc('minute', ts) AS run_at FROM events),
    k AS (SELECT min(run_at) AS run_at FROM t UNION ALL SELECT (SELECT min(t.run_at) FROM t WHERE epoch(t.run_at) - epoch(k.run_at) >= 9 * 3600 - 1) FROM k WHERE k.run_at IS NOT NULL)
    SELECT CAST(run_at AS VARCHAR) AS run_at FROM k WHERE run_at IS NOT NULL""")
def thinned_runs(v):
    t = v.events.select(F.date_trunc("minute", "ts").alias("run_at"))
    return TJ.thin_runs(t, "run_at", 9).select(F.col("run_at").cast("string").alias("run_at"))


@query("win_08_run_chunks", """
    WITH RECURSIVE t AS (SELECT DISTINCT date_trunc('hour', ts) AS run_at FROM events),
    g AS (SELECT min(run_at) AS s, 1 AS group_no FROM t UNION ALL SELECT (SELECT min(t.run_at) FROM t WHERE epoch(t.run_at) - epoch(g.s) > 3 * 86400), group_no + 1 FROM g WHERE s IS NOT NULL)
    SELECT CAST(run_at AS VARCHAR) AS run_at, CAST(max(group_no) AS INT) AS group_no FROM t JOIN g ON g.s <= run_at GROUP BY run_at""")
def run_chunks(v):
    t = v.events.select(F.date_trunc("hour", "ts").alias("run_at"))
    return TJ.chunk_runs(t, "run_at", 3).select(F.col("run_at").cast("string").alias("run_at"), "group_no")


@query("win_17_sliding_requests", """
    SELECT event_id, count(*) OVER (PARTITION BY user_id % 5 ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS requests FROM events""")
def sliding_requests(v):
    r = v.events.select("event_id", (F.col("user_id") % 5).alias("client"), "ts")
    return A.sliding_requests(r, "client", "ts", window_s=3600).select("event_id", "requests")


@query("prj_18_alerting", """SELECT id FROM forecasts_v WHERE risk_level IN ('medium', 'high')""", "forecasts_v")
def alerting(v):
    return A.alerting(v.forecasts).select("id")


ALERT_SQL = """'ALERTA SARGAZO — ' || z.name || ': riesgo ' || upper(risk_level) || '. Llegada estimada ' || coalesce('~' || eta_hours || 'h (' ||
      strftime(run_at + to_hours(CAST(eta_hours AS BIGINT)) - INTERVAL 4 HOUR, '%d/%m %H:%M') || ' DR)', 'desconocida') || '. Planifica con tiempo.'"""


@query("str_18_alert_text", f"""
    SELECT id, {ALERT_SQL} AS message FROM forecasts_v JOIN zones_v z USING (zone_id)""", "forecasts_v zones_v")
def alert_text(v):
    f = v.forecasts.join(v.zones, "zone_id")
    at = F.timestamp_add("HOUR", F.col("eta_hours"), F.col("run_at"))
    return f.select("id", X.alert_text(F.col("name"), F.col("risk_level"), F.col("eta_hours"), at).alias("message"))


@query("jon_21_alerts_due", f"""
    WITH f AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY zone_id ORDER BY run_at DESC) AS r FROM forecasts_v) WHERE r = 1 AND risk_level IN ('medium', 'high'))
    SELECT s.id, chat_id, s.zone_id, risk_level, {ALERT_SQL} AS message FROM subscribers_v s JOIN f ON f.zone_id = s.zone_id JOIN zones_v z ON z.zone_id = s.zone_id
    WHERE channel = 'telegram' AND (last_alerted IS NULL OR last_alerted <= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 6 HOUR)""", "subscribers_v forecasts_v zones_v")
def alerts_due(v):
    f = latest(v.forecasts, ["zone_id"], "run_at").join(v.zones.select("zone_id", F.col("name").alias("zone_name")), "zone_id")
    f = f.withColumn("eta_timestamp", F.timestamp_add("HOUR", F.col("eta_hours"), F.col("run_at")))
    return A.alerts(f, v.subscribers, F.lit("2024-01-30 12:00:00").cast("timestamp"))


@query("jon_22_subscription_status", """
    WITH f AS (SELECT zone_id, risk_level, eta_hours FROM (SELECT *, rank() OVER (PARTITION BY zone_id ORDER BY run_at DESC) AS r FROM forecasts_v WHERE zone_id % 6 <> 0) WHERE r = 1)
    SELECT s.id, chat_id, s.zone_id, CASE WHEN risk_level IS NULL THEN z.name || ': sin pronóstico disponible'
      ELSE z.name || ': riesgo ' || upper(risk_level) || ' | llegada ' || CASE WHEN eta_hours > 0 THEN '~' || eta_hours || 'h' ELSE 'N/A' END END AS line
    FROM subscribers_v s LEFT JOIN zones_v z ON z.zone_id = s.zone_id LEFT JOIN f ON f.zone_id = s.zone_id""", "subscribers_v forecasts_v zones_v")
def subscription_status(v):
    return A.subscription_status(v.subscribers, v.zones, latest(v.forecasts.where("zone_id % 6 <> 0"), ["zone_id"], "run_at"))


@query("prj_17_report_acceptance", """
    SELECT id, CASE WHEN NOT observed_on BETWEEN DATE '2024-01-14' AND DATE '2024-01-15' THEN 'observed_on must be today or yesterday'
      WHEN beach % 9 = 0 THEN 'unknown beach' WHEN amount = 'lots' THEN 'unknown amount' ELSE 'ok' END AS outcome FROM reports_v""", "reports_v")
def report_acceptance(v):
    known = v.reports.where("beach % 9 <> 0").select(F.col("beach").cast("string").alias("beach_name"))
    ok, bad = A.accept_reports(beach_reports(v), known, F.lit("2024-01-15").cast("date"))
    return ok.select("id", F.lit("ok").alias("outcome")).unionByName(bad.select("id", F.col("reason").alias("outcome")))


@query("stm_01_cooldown_batch_twin", """
    WITH RECURSIVE t AS (SELECT DISTINCT user_id, ts FROM events),
    k AS (SELECT user_id, min(ts) AS ts FROM t GROUP BY user_id UNION ALL
      SELECT k.user_id, n.ts FROM k, LATERAL (SELECT min(t.ts) AS ts FROM t WHERE t.user_id = k.user_id AND t.ts >= k.ts + INTERVAL 6 HOUR) n WHERE n.ts IS NOT NULL)
    SELECT user_id, CAST(epoch_us(ts) AS BIGINT) AS us FROM k""")
def cooldown_twin(v):
    return A.first_of_cooldown(v.events.select("user_id", "ts"), ["user_id"], "ts", 6).select("user_id", F.unix_micros("ts").alias("us"))


@query("stm_02_limiter_batch_twin", """
    WITH RECURSIVE r AS (SELECT user_id % 20 AS client, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id) AS n FROM events),
    k AS (SELECT client, n, event_id, [us] AS held, TRUE AS ok FROM r WHERE n = 1 UNION ALL
      SELECT client, n, event_id, CASE WHEN len(f) < 10 THEN list_append(f, us) ELSE f END, len(f) < 10 FROM (
        SELECT r.client, r.n, r.event_id, r.us, list_filter(k.held, lambda t: r.us - t <= 86400000000) AS f FROM k JOIN r ON r.client = k.client AND r.n = k.n + 1))
    SELECT client, event_id FROM k WHERE ok""")
def limiter_twin(v):
    """Ten accepted requests a client and day; the events are too sparse for a minute to matter."""
    r = v.events.select((F.col("user_id") % 20).alias("client"), "ts", "event_id")
    return A.accepted_requests(r, "client", "ts", "event_id", window_s=86_400).select("client", "event_id")


@query("stm_04_clamped_arrivals", """
    SELECT id, CASE WHEN h >= -48 THEN greatest(0.0, h) END AS hour FROM (SELECT event_id AS id, (event_id % 150 - 75) * 1.0 AS h FROM events)""")
def clamped_arrivals(v):
    s = v.events.select(F.col("event_id").alias("id"), ((F.col("event_id") % 150 - 75) * 1.0).alias("h"))
    return A.clamp_arrivals(s, "h").select("id", "hour")


@query("stm_06_enriched_reports", f"""
    WITH b AS (SELECT beach_name, zone_id FROM (SELECT beach_id, beach_name, zone_id, row_number() OVER (PARTITION BY beach_id ORDER BY {hav('latitude', 'longitude', 'center_lat', 'center_lon')}, zone_id) AS rn
      FROM beaches_v, zones_v) WHERE rn = 1),
    r AS (SELECT id, (CASE (beach % 100) % 5 WHEN 0 THEN 'Playa Rincón' WHEN 1 THEN 'Bahía Águila' WHEN 2 THEN 'Cayo Levantado' WHEN 3 THEN 'Playa Cosón' ELSE 'Punta Piñón' END)
      || ' ' || (beach % 100) AS beach_name, observed_on FROM reports_v)
    SELECT id, zone_id, observed_on = DATE '2024-01-15' AS has_time FROM r JOIN b USING (beach_name)""", "reports_v beaches_v zones_v")
def enriched_reports(v):
    names = F.array(*[F.lit(n) for n in ("Playa Rincón", "Bahía Águila", "Cayo Levantado", "Playa Cosón", "Punta Piñón")])
    b = F.col("beach") % 100
    r = v.reports.select("id", F.concat(F.get(names, (b % 5).cast("int")), F.lit(" "), b.cast("string")).alias("beach_name"), "observed_on")
    e = A.enrich_reports(r, v.beaches, v.zones, F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return e.select("id", "zone_id", F.col("observed_at").isNotNull().alias("has_time"))
