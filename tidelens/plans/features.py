"""Model inputs and labelled training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import dates as D
from tidelens.functions import risk as R
from tidelens.operators.keyed import pick_one
from tidelens.operators.spatial import zone_state
from tidelens.operators.timejoin import asof_join

FEATURES = ("doy_sin", "doy_cos", "month_sin", "month_cos", "log_eez_area", "log_zone_area", "log_nearest_km",
            "log_patch_count", "physics_risk", "zone_lat", "zone_lon", "lead_days")


def zone_feature_rows(dets: DataFrame, zones: DataFrame, risks: DataFrame, runs: DataFrame | None = None) -> DataFrame:
    """PRJ-13: one model input row per (run, zone), rounded; a zone without a forecast has risk 0.

    ``risks`` is (run_at, zone_id, risk_level).
    """
    state = zone_state(dets, zones, runs)
    r = risks.select("run_at", "zone_id", R.level_to_int(F.col("risk_level")).alias("physics_risk"))
    return (state.join(r, ["run_at", "zone_id"], "left")
            .select("run_at", "zone_id", F.round("eez_area_km2", 6).alias("eez_area_km2"),
                    F.round("zone_area_km2", 6).alias("zone_area_km2"), F.round("nearest_km", 3).alias("nearest_km"),
                    "patch_count", F.coalesce("physics_risk", F.lit(0)).alias("physics_risk")))


def only_versions(features: DataFrame, versions: Sequence[str]) -> DataFrame:
    """PRJ-26: rows of the listed model versions; an empty list means all."""
    return features.where(F.col("model_version").isin(*versions)) if versions else features


def feature_columns(run_ts: Column, lead: Column) -> list[Column]:
    """SCL-15: the twelve features in their fixed order, from a feature row joined to its zone."""
    ds, dc = D.cyclic(F.dayofyear(run_ts), 365)
    ms, mc = D.cyclic(F.month(run_ts), 12)
    log = lambda c: F.log1p(F.greatest(F.lit(0.0), F.col(c).cast("double")))
    cols = [ds, dc, ms, mc, log("eez_area_km2"), log("zone_area_km2"), log("nearest_km"), log("patch_count"),
            F.col("physics_risk").cast("double"), F.col("center_lat"), F.col("center_lon"), lead.cast("double")]
    return [c.alias(f"f_{n}") for c, n in zip(cols, FEATURES)]


def _rows(paired: DataFrame, label: Column) -> DataFrame:
    return paired.select("run_ts", "target_ts", "zone_id", "center_lat", "center_lon", "lead_days",
                         *feature_columns(F.col("run_ts"), F.col("lead_days")),
                         label.cast("int").alias("risk_int"), F.col("physics_risk").cast("int").alias("physics_now"))


def _per_time(features: DataFrame) -> DataFrame:
    cols = ["zone_id", "run_at", "eez_area_km2", "zone_area_km2", "nearest_km", "patch_count", "physics_risk"]
    f = features.select(*cols)
    return pick_one(f, ["zone_id", "run_at"], [F.col(c) for c in cols[2:]])


def training_rows(features: DataFrame, zones: DataFrame, leads: Sequence[int] = S.LEADS,
                  tolerance_h: float = S.ASOF_TOLERANCE_H) -> DataFrame:
    """JON-06: features at T with the zone's own risk nearest T + lead; rows without a label vanish."""
    z = zones.select("zone_id", "center_lat", "center_lon")
    f = _per_time(features).join(z, "zone_id").withColumnRenamed("run_at", "run_ts")
    left = f.withColumn("lead_days", F.explode(F.array(*[F.lit(x) for x in leads])))
    left = left.withColumn("target_ts", F.timestamp_add("DAY", F.col("lead_days"), F.col("run_ts")))
    right = _per_time(features).select("zone_id", "run_at", F.col("physics_risk").alias("_label"))
    return _rows(asof_join(left, right, ["zone_id"], "target_ts", "run_at", tolerance_h), F.col("_label"))


def report_training_rows(features: DataFrame, zones: DataFrame, labels: DataFrame, leads: Sequence[int] = S.LEADS,
                         tolerance_h: float = S.ASOF_TOLERANCE_H) -> DataFrame:
    """JON-08: what was reported on day D with the zone's features nearest D 16:00 UTC minus the lead.

    ``labels`` is (ident = zone id, day, truth); unknown zones vanish.
    """
    z = zones.select("zone_id", "center_lat", "center_lon")
    left = labels.select(F.col("ident").cast("int").alias("zone_id"), "day", "truth").join(z, "zone_id")
    left = left.withColumn("target_ts", F.col("day").cast("timestamp") + F.expr(f"INTERVAL {S.REPORT_HOUR_UTC} HOURS"))
    left = left.withColumn("lead_days", F.explode(F.array(*[F.lit(x) for x in leads])))
    left = left.withColumn("want", F.timestamp_add("DAY", -F.col("lead_days"), F.col("target_ts")))
    right = _per_time(features).withColumn("run_ts", F.col("run_at"))
    return _rows(asof_join(left, right, ["zone_id"], "want", "run_at", tolerance_h), F.col("truth"))


def choose_rows(reported: DataFrame, physics: DataFrame, need: int = S.MIN_REPORT_ROWS) -> tuple[DataFrame, str]:
    """MLE-07: rows labelled by reports once there are enough, else rows labelled by physics."""
    enough = reported.limit(need).count() >= need
    return (reported, "reports") if enough else (physics, "physics")


def sorted_rows(rows: DataFrame) -> DataFrame:
    """SRT-03: training rows in their fixed order."""
    return rows.orderBy("run_ts", "zone_id", "lead_days")


def pair_runs(forecast_runs: DataFrame, detection_runs: DataFrame, tolerance_h: float = S.PAIR_TOLERANCE_H) -> DataFrame:
    """JON-09: each forecast run with the nearest detection run in the window, else null."""
    left = forecast_runs.select(F.col("run_at")).distinct().withColumn("_k", F.lit(1))
    right = detection_runs.select(F.col("run_at").alias("det_run")).distinct().withColumn("_k", F.lit(1))
    got = asof_join(left, right, ["_k"], "run_at", "det_run", tolerance_h).select("run_at", "det_run")
    return left.select("run_at").join(got, "run_at", "left")


def history_features(forecasts: DataFrame, detections: DataFrame, zones: DataFrame) -> DataFrame:
    """JON-29: feature rows of every past forecast run from the detections paired with it; runs that
    saw nothing keep their rows."""
    pairs = pair_runs(forecasts, detections)
    d = (detections.withColumnRenamed("run_at", "det_run").join(pairs, "det_run")
         .select("run_at", "lat", "lon", "area_km2"))
    return zone_feature_rows(d, zones, forecasts.select("run_at", "zone_id", "risk_level"), pairs)


def rebuild_features(detections: DataFrame, forecasts: DataFrame, zones: DataFrame, version: str) -> DataFrame:
    """MLE-09: feature rows of all past runs with the current model's risk, in one job."""
    rows = zone_feature_rows(detections, zones, forecasts.select("run_at", "zone_id", "risk_level"),
                             detections.select("run_at"))
    return rows.withColumn("model_version", F.lit(version))
