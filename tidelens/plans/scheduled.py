"""One scheduled run as a graph of stages whose tables become visible with one commit (RAM-06)."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import dates as D
from tidelens.operators import alerts as A
from tidelens.operators import ensemble as E
from tidelens.operators import grid as GR
from tidelens.operators import scoring as SC
from tidelens.operators import timejoin as TJ
from tidelens.plans import features as FT
from tidelens.plans import model as M
from tidelens.session import list_paths
from tidelens.sources import tables as T

log = logging.getLogger(__name__)


@dataclass
class RunInputs:
    """Tables of one run. ``patches`` and ``clusters`` have id, centroid_lat, centroid_lon and area_km2, patches
    also observed_at and clusters observed_on; ``checkable`` holds ids of patches seen clearly by the second
    instrument; ``stops`` are (zone_id, member, hour, area, lat, lon); ``history`` are feature rows of past runs.
    """

    patches: DataFrame
    clusters: DataFrame
    checkable: DataFrame
    stops: DataFrame
    zones: DataFrame
    beaches: DataFrame
    subscribers: DataFrame
    history: DataFrame


@dataclass
class Run:
    """What a stage may use: the inputs, the time of the run, and the tables of the stages it needs."""

    spark: SparkSession
    inputs: RunInputs
    at: object  # timestamp of the run, as text or datetime
    out: str
    version: str = "drift"
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def now(self):
        return F.lit(self.at).cast("timestamp")

    @property
    def label(self) -> str:
        return self.spark.range(1).select(F.date_format(self.now, "yyyyMMdd'T'HHmmss")).first()[0]


@dataclass(frozen=True)
class Stage:
    name: str
    needs: tuple[str, ...]
    build: Callable[[Run], DataFrame]


def fresh_patches(patches: DataFrame, now, max_age_days: int = S.MAX_AGE_DAYS) -> DataFrame:
    """PRJ-11: patches not older than the maximum age."""
    return patches.where(F.col("observed_at") >= now - F.expr(f"INTERVAL {max_age_days} DAYS"))


def merge_patches(primary: DataFrame, gaps: DataFrame) -> DataFrame:
    """SET-01: primary patches and gap-fill clusters, which have fewer columns."""
    return primary.unionByName(gaps, allowMissingColumns=True)


def gap_patch_times(gaps: DataFrame) -> DataFrame:
    """DAT-05: dated clusters stand for a fixed overpass time."""
    return gaps.withColumn("observed_at", D.overpass_time(F.col("observed_on")))


def _points(df: DataFrame) -> DataFrame:
    return df.withColumns({"_run": F.lit(1), "lat": F.col("centroid_lat"), "lon": F.col("centroid_lon")})


def _agreement(run: Run) -> tuple[DataFrame, DataFrame]:
    i = run.inputs
    return GR.agreement(_points(i.patches).select("_run", "id", "lat", "lon"), _points(i.clusters), i.checkable.select(F.lit(1).alias("_run"), "id"), ["_run"])


def gap_fill(run: Run) -> DataFrame:
    """Clusters that no patch is near to, at their overpass time."""
    return gap_patch_times(_agreement(run)[1].drop("_run", "lat", "lon"))


def check(run: Run) -> DataFrame:
    """One row: how far both instruments agree, and what was filled in; zeros where nothing was seen."""
    summary = _agreement(run)[0].drop("_run")
    gaps = run.tables["gap_fill"]
    return summary.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in summary.columns]).select(
        run.now.alias("run_at"), "*", gaps.agg(F.count("*")).scalar().alias("gap_filled"),
        gaps.agg(F.round(F.coalesce(F.sum("area_km2"), F.lit(0.0)), 4)).scalar().alias("gap_filled_area_km2"))


def patches(run: Run) -> DataFrame:
    return merge_patches(run.inputs.patches, run.tables["gap_fill"]).withColumn("run_at", run.now)


def detections(run: Run) -> DataFrame:
    return T.detection_rows(run.tables["patches"], run.now)


def forecasts(run: Run) -> DataFrame:
    """Every zone, with its name and the model version (SNK-02)."""
    i = run.inputs
    rows = E.summarise(i.stops.withColumn("run_at", run.now), ["run_at", "zone_id"])
    this_run = run.spark.range(1).select(run.now.alias("run_at"))
    rows = E.with_valid_times(E.with_all_targets(rows, this_run, i.zones, "run_at", "zone_id"), "run_at")
    return T.named_rows(rows.join(i.zones.select("zone_id", F.col("name").alias("zone_name")), "zone_id").drop("zone_id"), i.zones, run.version)


def beach_forecasts(run: Run) -> DataFrame:
    rows = E.beach_summary(run.inputs.stops, run.inputs.beaches, "beach_id").select(run.now.alias("run_at"), "*")
    return E.with_valid_times(rows, "run_at").withColumn("model_version", F.lit(run.version))


def zone_features(run: Run) -> DataFrame:
    dets = run.tables["patches"].select("run_at", F.col("centroid_lat").alias("lat"), F.col("centroid_lon").alias("lon"), "area_km2")
    this_run = run.spark.range(1).select(run.now.alias("run_at"))
    return FT.zone_feature_rows(dets, run.inputs.zones, run.tables["forecasts"], this_run).withColumn("model_version", F.lit(run.version))


def alerts(run: Run) -> DataFrame:
    """Alerts due now. A subscriber's last alert is the newer of the stored one and the committed runs' tables."""
    subs, sent = run.inputs.subscribers, committed(run.spark, run.out, "alerts")
    if sent is not None:
        last = sent.where(F.col("run_at") <= run.now).groupBy("id").agg(F.max("run_at").alias("_sent"))
        subs = subs.join(last, "id", "left").withColumn("last_alerted", F.greatest("last_alerted", "_sent")).drop("_sent")
    return A.alerts(run.tables["forecasts"], subs, run.now).withColumn("run_at", run.now)


def evaluation(run: Run) -> DataFrame:
    """One row: macro-F1 of the simple methods on later-in-time blocks of the history, and the one to use."""
    rows = FT.training_rows(run.inputs.history, run.inputs.zones)
    tagged = TJ.purged_split(rows, TJ.time_blocks(rows, "run_ts", 4))
    pairs = M.long_pairs(M.baselines(tagged), ("seasonal", "persistence", "majority"))
    scores = SC.score_with_pool(pairs, "method", "lead_days").where("lead_days is null")
    row = T.evaluation_rows(scores.select("method", "macro_f1"), rows.agg(F.count("*")).scalar(), F.lit(False))
    return row.select(run.now.alias("run_at"), "*", SC.choose_method(scores).scalar().alias("chosen"))


def ml_forecasts(run: Run) -> DataFrame:
    method = run.tables["evaluation"].select("chosen").first()[0]
    return M.extended_forecast(run.tables["zone_features"].drop("model_version"), run.inputs.zones, method)


STAGES = (
    Stage("gap_fill", (), gap_fill), Stage("checks", ("gap_fill",), check), Stage("patches", ("gap_fill",), patches),
    Stage("detections", ("patches",), detections), Stage("forecasts", (), forecasts), Stage("beach_forecasts", (), beach_forecasts),
    Stage("zone_features", ("patches", "forecasts"), zone_features), Stage("alerts", ("forecasts",), alerts),
    Stage("evaluation", (), evaluation), Stage("ml_forecasts", ("zone_features", "evaluation"), ml_forecasts))


def _manifests(spark: SparkSession, out: str) -> list[str]:
    return sorted(p.getParent().getName() for p in list_paths(spark, f"{out}/commits/*/_SUCCESS"))


def committed(spark: SparkSession, out: str, stage: str) -> DataFrame | None:
    """The rows that committed runs wrote for a stage, or nothing yet. Files of other runs are never read."""
    runs = _manifests(spark, out)
    if not runs:
        return None
    ok = spark.read.parquet(*[f"{out}/commits/{r}" for r in runs]).where((F.col("stage") == stage) & (F.col("status") == "ok"))
    paths = [r["path"] for r in ok.select("path").collect()]  # one path per run
    return spark.read.option("mergeSchema", "true").parquet(*paths) if paths else None


def run_once(spark: SparkSession, inputs: RunInputs, run_at, out: str, version: str = "drift", stages: tuple[Stage, ...] = STAGES) -> dict[str, str]:
    """RAM-06: status by stage of one run: ok, failed, or skipped where a stage it needs is not ok.

    Each stage writes its table to a folder of this attempt and later stages read it from there. The
    commit, written last, names the folders of all stages that ended; a run that dies before it leaves
    nothing that ``committed`` reads. A run whose time is committed is not repeated.
    """
    run = Run(spark, inputs, run_at, out.rstrip("/"), version)
    if run.label in _manifests(spark, run.out):
        return {r["stage"]: r["status"] for r in spark.read.parquet(f"{run.out}/commits/{run.label}").collect()}
    folder, done = f"{run.out}/runs/{run.label}-{uuid.uuid4().hex}", {}
    for stage in stages:
        if any(done.get(n) != "ok" for n in stage.needs):
            done[stage.name] = "skipped"
            continue
        try:
            stage.build(run).write.parquet(f"{folder}/{stage.name}")
            run.tables[stage.name] = spark.read.parquet(f"{folder}/{stage.name}")
            done[stage.name] = "ok"
        except Exception as exc:  # stages that do not need this one still run
            log.warning("%s failed: %s", stage.name, exc)
            done[stage.name] = "failed"
    rows = [(n, status, f"{folder}/{n}") for n, status in done.items()]
    spark.createDataFrame(rows, "stage string, status string, path string").coalesce(1).write.mode("overwrite").parquet(f"{run.out}/commits/{run.label}")
    return done
