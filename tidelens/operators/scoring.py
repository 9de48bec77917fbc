"""Labels from reports, forecast scores and method choice."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import risk as R
from tidelens.operators.quantiles import group_median
from tidelens.operators.timejoin import issued_in_time


def valid_reports(reports: DataFrame, ident: str) -> DataFrame:
    return reports.where(F.col(ident).isNotNull() & F.col("amount").isin(*S.LEVELS)).select(
        F.col(ident).alias("ident"), F.col("observed_on").alias("day"), R.level_to_int(F.col("amount")).alias("level"))


def report_labels(reports: DataFrame, ident: str, min_reports: int = 1) -> DataFrame:
    """AGG-12: (ident, day, truth): lower median of the reported levels, days with too few dropped.

    Levels are counted per day first; the median walks at most four counts.
    """
    v = valid_reports(reports, ident)
    mid = group_median(v, ["ident", "day"], "level", "truth", low=True)
    n = v.groupBy("ident", "day").agg(F.count("*").alias("n_reports")).where(F.col("n_reports") >= min_reports)
    return mid.join(n, ["ident", "day"]).select("ident", "day", F.col("truth").cast("int").alias("truth"), "n_reports")


def label_strength(reports: DataFrame, ident: str) -> DataFrame:
    """AGG-17: how many labels rest on 1, 2, 3.. reports."""
    v = valid_reports(reports, ident).groupBy("ident", "day").agg(F.count("*").alias("n_reports"))
    return v.groupBy("n_reports").agg(F.count("*").alias("labels"))


def score(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG-13: scores per key from (truth, pred): one aggregate of a confusion table, no joins.

    Macro-F1 runs over classes seen in truth or prediction; an undefined F1 counts as 0.
    """
    t, p = F.col("truth"), F.col("pred")
    hit = t == p
    aggs = [F.count("*").alias("n"), F.avg(hit.cast("double")).alias("_acc"),
            F.avg(F.abs(t - p).cast("double")).alias("_mae"),
            F.count_if((t >= 2) & (p >= 2)).alias("_both"), F.count_if(t >= 2).alias("_real"),
            F.count_if(p >= 2).alias("_said")]
    for k in range(4):
        aggs += [F.count_if(hit & (t == k)).alias(f"_tp{k}"), F.count_if(t == k).alias(f"_t{k}"),
                 F.count_if(p == k).alias(f"pred_{S.LEVELS[k]}")]
    g = pairs.groupBy(*keys).agg(*aggs)
    seen = [(F.col(f"_t{k}") + F.col(f"pred_{S.LEVELS[k]}")) for k in range(4)]
    f1 = [F.when(s > 0, 2.0 * F.col(f"_tp{k}") / s).otherwise(0.0) for k, s in enumerate(seen)]
    classes = sum((F.when(s > 0, 1).otherwise(0) for s in seen[1:]), F.when(seen[0] > 0, 1).otherwise(0))
    macro = (f1[0] + f1[1] + f1[2] + f1[3]) / classes
    return g.select(*keys, "n", F.round("_acc", 4).alias("accuracy"), F.round(macro, 4).alias("macro_f1"),
                    F.round("_mae", 4).alias("mae"),
                    F.round(F.try_divide("_both", "_real"), 4).alias("pod"),
                    F.round(F.try_divide(F.col("_said") - F.col("_both"), F.col("_said")), 4).alias("far"),
                    *[f"pred_{lv}" for lv in S.LEVELS])


def onehot(level: Column) -> Column:
    """AGG-14: a deterministic forecast as probabilities."""
    return F.array(*[F.when(level == k, 1.0).otherwise(0.0) for k in range(4)])


def brier(pairs: DataFrame, keys: Sequence[str], probs: str = "probs") -> DataFrame:
    """AGG-14: multi-class Brier score, 0..2."""
    gap = F.zip_with(F.col(probs), onehot(F.col("truth")), lambda a, b: F.pow(a - b, 2))
    term = F.aggregate(gap, F.lit(0.0), lambda acc, x: acc + x)
    return pairs.groupBy(*keys).agg(F.round(F.avg(term), 4).alias("brier"))


def score_with_pool(pairs: DataFrame, method: str, lead: str) -> DataFrame:
    """AGG-15: scores per (method, lead) and pooled per method (lead null).

    Rows are counted once per (method, lead, truth, pred); both levels are built from those counts.
    """
    counts = pairs.groupBy(method, lead, "truth", "pred").agg(F.count("*").alias("c"))
    both = counts.unionByName(counts.withColumn(lead, F.lit(None).cast(pairs.schema[lead].dataType)))
    return _score_counts(both, [method, lead])


def _score_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Scores from confusion counts (keys, truth, pred, c)."""
    t, p, c = F.col("truth"), F.col("pred"), F.col("c")
    add = lambda cond: F.sum(F.when(cond, c).otherwise(0))
    aggs = [F.sum("c").alias("n"), add(t == p).alias("_ok"), F.sum(F.abs(t - p) * c).alias("_off")]
    for k in range(4):
        aggs += [add((t == k) & (p == k)).alias(f"_tp{k}"), (add(t == k) + add(p == k)).alias(f"_s{k}")]
    g = counts.groupBy(*keys).agg(*aggs)
    f1 = sum((F.when(F.col(f"_s{k}") > 0, 2.0 * F.col(f"_tp{k}") / F.col(f"_s{k}")).otherwise(0.0)
              for k in range(4)), F.lit(0.0))
    classes = sum((F.when(F.col(f"_s{k}") > 0, 1).otherwise(0) for k in range(4)), F.lit(0))
    return g.select(*keys, "n", F.round(F.col("_ok") / F.col("n"), 4).alias("accuracy"),
                    F.round(f1 / classes, 4).alias("macro_f1"), F.round(F.col("_off") / F.col("n"), 4).alias("mae"))


def majority_class(rows: DataFrame, keys: Sequence[str], label: str, order: Sequence[Column]) -> DataFrame:
    """AGG-16: most frequent label per key, the first seen on ties; counted before it is compared."""
    per = rows.groupBy(*keys, label).agg(F.count("*").alias("_n"), F.min(F.struct(*order)).alias("_first"))
    return per.groupBy(*keys).agg(F.min_by(label, F.struct(-F.col("_n"), F.col("_first"))).alias("majority"))


def seasonal_pred(zone_lat: Column, zone_lon: Column, day: Column) -> Column:
    """MLE-10: seasonal level of a zone on a day as an integer."""
    return R.level_to_int(R.seasonal_level(F.month(day), R.region_of(zone_lat, zone_lon)))


def score_pairs(labels: DataFrame, zones: DataFrame, physics: DataFrame, extended: DataFrame,
                beach_labels: DataFrame | None = None, beach: DataFrame | None = None) -> DataFrame:
    """JON-20: (name, method, truth, pred) of stored forecasts against reported labels.

    Names carry the model version, so versions are never pooled. Extended forecasts are not checked
    for being issued in time, the others are.
    """
    z = zones.select(F.col("zone_id").alias("ident"), "center_lat", "center_lon")
    none = F.lit(None).cast("string")
    out = labels.join(z, "ident").select(
        F.lit("seasonal").alias("name"), none.alias("method"), "truth",
        seasonal_pred(F.col("center_lat"), F.col("center_lon"), F.col("day")).alias("pred"))
    phys = issued_in_time(physics, "zone_id", "id").withColumnRenamed("zone_id", "ident")
    tag = lambda head, size, unit: F.concat(F.lit(head), F.col(size).cast("string"), F.lit(unit + " @"), F.col("model_version"))
    out = out.unionByName(labels.join(phys, ["ident", "day"]).select(
        tag("physics_", "horizon_hours", "h").alias("name"), none.alias("method"), "truth", "pred"))
    version = F.coalesce(F.col("model_version"), F.lit(S.LEGACY_VERSION))
    ext = (extended.groupBy(F.col("zone_id").alias("ident"), F.col("valid_at").alias("day"), "lead_days",
                            version.alias("model_version"))
           .agg(F.max_by(F.struct(R.level_to_int(F.col("risk_level")).alias("pred"), "method"),
                         F.struct(F.col("run_at"), -F.col("id"))).alias("x")))
    out = out.unionByName(labels.join(ext, ["ident", "day"]).select(
        tag("extended_", "lead_days", "d").alias("name"), F.col("x.method").alias("method"), "truth",
        F.col("x.pred").alias("pred")))
    if beach is not None:
        b = issued_in_time(beach, "beach_name", "id").withColumnRenamed("beach_name", "ident")
        out = out.unionByName(beach_labels.join(b, ["ident", "day"]).select(
            tag("beach_", "horizon_hours", "h").alias("name"), none.alias("method"), "truth", "pred"))
    return out


def methods_used(pairs: DataFrame) -> DataFrame:
    """AGG-18: how often each published method stands behind a metric."""
    return pairs.where(F.col("method").isNotNull()).groupBy("name", "method").agg(F.count("*").alias("n"))


def choose_method(scores: DataFrame, allow_persistence: bool = True) -> DataFrame:
    """MLE-05: one row: the method whose pooled macro-F1 strictly beats the simpler ones."""
    at = lambda m: F.coalesce(F.max(F.when(F.col("method") == m, F.col("macro_f1"))), F.lit(-1.0))
    g = scores.agg(at("model").alias("m"), at("persistence").alias("p"), at("seasonal").alias("s"))
    p_wins = F.lit(allow_persistence) & (F.col("p") > F.col("s"))
    best_simple = F.when(p_wins, F.col("p")).otherwise(F.col("s"))
    return g.select(F.when(F.col("m") > best_simple, "ml").when(p_wins, "persistence")
                    .otherwise("seasonal").alias("chosen"))


def rank_settings(scores: DataFrame) -> DataFrame:
    """AGG-29 / SRT-05: per setting the beach score when there is one, else the zone score, best first."""
    ref = F.min_by(F.struct("name", "n", "macro_f1", "mae", "pod", "far"),
                   F.when(F.col("name").startswith("beach_24h"), 0).when(F.col("name").startswith("physics_24h"), 1))
    g = scores.groupBy("setting").agg(ref.alias("r")).select("setting", F.split("r.name", " @")[0].alias("primary"),
                                                            "r.n", "r.macro_f1", "r.mae", "r.pod", "r.far")
    return g.orderBy(F.desc_nulls_last("macro_f1"), F.asc_nulls_last("mae"), "setting")


def in_score_window(forecasts: DataFrame, labels: DataFrame, days: int = 4) -> DataFrame:
    """PRJ-27: forecasts from some days before the first labelled day; the bound is one scalar, so it
    reaches the scan as a filter."""
    first = labels.agg(F.min("day").cast("timestamp")).scalar()
    return forecasts.where(F.col("run_at") >= first - F.expr(f"INTERVAL {days} DAYS"))
