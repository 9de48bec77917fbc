"""Boosted-tree forecasts of the four levels: fitting, calibration, walk-forward scores, prediction."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import risk as R
from tidelens.operators import scoring as SC
from tidelens.operators.timejoin import purged_split, time_blocks
from tidelens.plans import boost as B
from tidelens.plans.features import FEATURES, feature_columns

# Tree settings.
TREES, DEPTH, STEP, SUBSAMPLE, LEAF, SEED = 150, 3, 0.08, 0.8, 4, 42
FIT_ROWS = 200_000  # labelled rows that a model is fitted on, in order of a hash


@dataclass
class Classifier:
    """One softmax model a calibration fold, each with (optionally) the sigmoid of every class."""

    classes: list[int]
    folds: list[tuple[B.Boosted, list[tuple[float, float]] | None]] = field(default_factory=list)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        """(rows, four levels): the mean of the folds; zeros for classes that were not learnt."""
        out = np.zeros((len(x), 4))
        if len(self.classes) == 1:
            out[:, self.classes[0]] = 1.0
            return out
        for model, sigmoids in self.folds:
            p = model.margins(x)
            if sigmoids is None:
                p = B.softmax(p)
            else:
                p = 1 / (1 + np.exp(-np.clip(np.stack([a * p[:, k] + b for k, (a, b) in enumerate(sigmoids)], axis=1), -30, 30)))
                p /= p.sum(axis=1, keepdims=True)
            out[:, self.classes] += p / len(self.folds)
        return out

    def predict(self, rows: DataFrame) -> DataFrame:
        """MLE-03: rows with probs (four slots, zeros for unseen classes), pred and confidence."""
        own = self

        @F.pandas_udf("array<double>")
        def probs(features: pd.Series) -> pd.Series:
            x = np.array(features.tolist(), np.float64).reshape(len(features), len(FEATURES))
            return pd.Series(list(own.probabilities(np.nan_to_num(x))))

        out = rows.withColumn("probs", probs(F.array(*[F.col(f"f_{n}").cast("double") for n in FEATURES])))
        best = F.array_max("probs")
        return out.withColumn("pred", (F.array_position("probs", best) - 1).cast("int")).withColumn("confidence", best)


def _fit(x: np.ndarray, y: np.ndarray, classes: list[int], iterations: int) -> B.Boosted:
    return B.fit(x, np.searchsorted(classes, y), len(classes), iterations, DEPTH, STEP, SUBSAMPLE, LEAF, SEED)


def fit_classifier(rows: DataFrame, calibrate: bool = True, iterations: int = TREES, folds: int = 3) -> Classifier:
    """MLE-01 / MLE-02: one boosted softmax model over all classes, calibrated by sigmoids on later-in-time folds.

    It is fitted in memory on at most FIT_ROWS of the labelled rows, in order of a hash (all of
    them where there are fewer), and applied to any number. A single class gives a constant
    classifier. Falls back to no calibration when a fold lacks a class.
    """
    names = [f"f_{n}" for n in FEATURES]
    sample = (rows.where("risk_int is not null").select(F.unix_micros("run_ts").alias("t"), "risk_int", *[F.col(n).cast("double") for n in names])
              .orderBy(F.xxhash64("t", *names), "t", *names, "risk_int").limit(FIT_ROWS).toPandas())
    sample = sample.sort_values(["t", *names, "risk_int"], kind="stable")
    x, y, t = np.nan_to_num(sample[names].to_numpy(np.float64)), sample["risk_int"].to_numpy(np.int64), sample["t"].to_numpy(np.int64)
    classes = np.unique(y).tolist()
    if len(classes) <= 1:
        return Classifier(classes or [0])
    if calibrate and len(y) >= 4 * S.MIN_TRAIN_ROWS:
        fitted = _calibrated(x, y, t, classes, iterations, folds)
        if fitted:
            return Classifier(classes, fitted)
    return Classifier(classes, [(_fit(x, y, classes, iterations), None)])


def _calibrated(x: np.ndarray, y: np.ndarray, t: np.ndarray, classes: list[int], iterations: int, folds: int):
    """A model on the rows before each later block of times, and the sigmoids of that block."""
    times = np.unique(t)
    if len(times) < folds + 1:
        return None
    out = []
    for block in np.array_split(times, folds + 1)[1:]:
        train, later = t < block[0], (t >= block[0]) & (t <= block[-1])
        if set(classes) - set(y[train].tolist()) or set(classes) - set(y[later].tolist()):
            return None
        model = _fit(x[train], y[train], classes, iterations)
        z = model.margins(x[later])
        out.append((model, [B.fit_sigmoid(z[:, k], (y[later] == c).astype(float)) for k, c in enumerate(classes)]))
    return out


def baselines(tagged: DataFrame) -> DataFrame:
    """MLE-10: test rows with seasonal, persistence and majority predictions.

    ``tagged`` comes from ``purged_split``; the majority of each block's training rows is one small
    row per block.
    """
    test, train = tagged.where("part = 'test'"), tagged.where("part = 'train'")
    top = SC.majority_class(train, ["block"], "risk_int", [F.col("run_ts"), F.col("zone_id"), F.col("lead_days")])
    seasonal = SC.seasonal_pred(F.col("center_lat"), F.col("center_lon"), F.to_date("target_ts"))
    return (test.join(top, "block").withColumn("seasonal", seasonal).withColumn("persistence", F.col("physics_now")))


def long_pairs(test: DataFrame, methods: tuple[str, ...]) -> DataFrame:
    """(method, lead_days, truth, pred) of several prediction columns."""
    arms = F.array(*[F.struct(F.lit(m).alias("method"), F.col(m).cast("int").alias("pred")) for m in methods])
    return test.select("lead_days", F.col("risk_int").alias("truth"), F.explode(arms).alias("a")).select(
        F.col("a.method").alias("method"), "lead_days", "truth", F.col("a.pred").alias("pred"))


def walk_forward(rows: DataFrame, n_folds: int = 3, min_train: int = S.MIN_TRAIN_ROWS, iterations: int = TREES,
                 calibrate: bool = True) -> dict:
    """MLE-04: model and baselines scored on later-in-time blocks, with purged training rows.

    The driver loops over at most ``n_folds`` blocks to fit; all predictions are scored as one grouped
    query. Blocks with too little training data are reported as skipped.
    """
    blocks = time_blocks(rows, "run_ts", n_folds + 1)
    tagged = purged_split(rows, blocks).persist()
    sizes = {(r["block"], r["part"]): r["count"] for r in tagged.groupBy("block", "part").count().collect()}
    parts, folds = [], []
    for b in sorted({k[0] for k in sizes}):
        n_train, n_test = sizes.get((b, "train"), 0), sizes.get((b, "test"), 0)
        ok = n_train >= min_train and n_test > 0
        folds.append({"block": b, "n_train": n_train, "n_test": n_test, "skipped": not ok})
        if ok:
            clf = fit_classifier(tagged.where((F.col("block") == b) & (F.col("part") == "train")), calibrate, iterations)
            parts.append(clf.predict(baselines(tagged.where(F.col("block") == b))).withColumn("model", F.col("pred")))
    if not parts:
        return {"folds": folds, "scores": None, "brier": None, "chosen": None}
    test = reduce(DataFrame.unionByName, parts)
    pairs = long_pairs(test, ("model", "seasonal", "persistence", "majority"))
    scores = SC.score_with_pool(pairs, "method", "lead_days")
    flat = pairs.where("method <> 'model'").withColumn("probs", SC.onehot(F.col("pred")))
    soft = test.select(F.lit("model").alias("method"), F.col("risk_int").alias("truth"), "probs")
    briers = SC.brier(flat.select("method", "truth", "probs").unionByName(soft), ["method"])
    chosen = SC.choose_method(scores.where("lead_days is null"))
    return {"folds": folds, "scores": scores, "brier": briers, "chosen": chosen}


def extended_forecast(features: DataFrame, zones: DataFrame, method: str, model: Classifier | None = None,
                      accuracy: dict[int, float] | None = None, version: str = "ml") -> DataFrame:
    """MLE-06: forecasts of every zone at each lead, by the chosen method with its fallbacks.

    ``features`` is one row per (run_at, zone_id). Model probabilities give level and confidence;
    persistence repeats today's level with its own accuracy; the seasonal level has confidence 0.4.
    """
    z = zones.select("zone_id", "center_lat", "center_lon")
    rows = (features.join(z, "zone_id").withColumnRenamed("run_at", "run_ts")
            .withColumn("lead_days", F.explode(F.array(*[F.lit(x) for x in S.LEADS]))))
    rows = rows.withColumn("valid_at", F.date_add(F.to_date("run_ts"), F.col("lead_days")))
    region = R.region_of(F.col("center_lat"), F.col("center_lon"))
    seasonal = R.seasonal_level(F.month("valid_at"), region)
    none_probs = F.lit(None).cast("array<double>")
    if method == "ml" and model is not None:
        rows = rows.select("*", *feature_columns(F.col("run_ts"), F.col("lead_days")))
        out = model.predict(rows)
        got = F.col("pred").isNotNull()
        level = F.when(got, R.int_to_level(F.col("pred"))).otherwise(seasonal)
        conf = F.when(got, F.col("confidence")).otherwise(0.4)
        name, probs = F.when(got, "ml").otherwise("seasonal"), F.transform("probs", lambda p: F.round(p, 3))
    elif method == "persistence":
        out, name, probs = rows, F.lit("persistence"), none_probs
        level = R.int_to_level(F.col("physics_risk"))
        acc = [x for kv in (accuracy or {}).items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))]
        conf = F.coalesce(F.try_element_at(F.create_map(*acc), F.col("lead_days")), F.lit(0.5)) if acc else F.lit(0.5)
    else:
        out, level, conf, name, probs = rows, seasonal, F.lit(0.4), F.lit("seasonal"), none_probs
    return out.select(F.col("run_ts").alias("run_at"), "zone_id", "lead_days", level.alias("risk_level"),
                      F.round(conf, 3).alias("confidence"), name.alias("method"), "valid_at", probs.alias("probs"),
                      F.lit(version).alias("model_version"))
