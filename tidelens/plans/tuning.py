"""Settings scored against reports, all of them in one job."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import risk as R
from tidelens.functions.dates import local_day, local_day_end
from tidelens.operators import ensemble as E
from tidelens.operators import scoring as SC


def settings_grid(spark: SparkSession, spec: dict[str, Sequence]) -> DataFrame:
    """SET-07: every combination of a few settings, by exploding literal lists (no join)."""
    cols = [F.explode(F.array(*[F.lit(v) for v in values])).alias(name) for name, values in spec.items()]
    return reduce(lambda df, c: df.select("*", c), cols, spark.range(1)).drop("id")


def _settings(area_fields: Sequence[str], scales: Sequence[float]) -> list[tuple[str, float, str]]:
    return [(a, float(x), f"{a} | thr x{float(x)}") for a in area_fields for x in scales]


def setting_levels(stops: DataFrame, keys: Sequence[str], area_fields: Sequence[str], scales: Sequence[float],
                   members: int = S.MEMBERS, horizons: Sequence[int] = S.HORIZONS, bands: S.RiskBands = S.ZONE_BANDS) -> DataFrame:
    """Per (keys): for each horizon the headline level (0 to 3) under every setting, as arrays ``lv_<h>``
    in the order of the settings (area field, then scale).

    Steps are summed once per hour, with the area fields side by side, and one window carries all
    running sums; the scaled bars only read them. So the number of settings widens two aggregates
    but adds no row to a shuffle.
    """
    last, made = max(horizons), _settings(area_fields, scales)
    hourly = (stops.where(F.col("hour").isNotNull())
              .groupBy(*keys, "member", F.ceil("hour").cast("int").alias("hr")).agg(*[F.sum(F.col(a).cast("double")).alias(a) for a in area_fields])
              .where(F.col("hr") <= last))
    w = W.partitionBy(*keys, "member").orderBy("hr").rowsBetween(W.unboundedPreceding, 0)
    run = hourly.select("*", *[F.sum(a).over(w).alias(f"cum_{a}") for a in area_fields])
    per = run.groupBy(*keys, "member").agg(
        *[F.sum(F.when(F.col("hr") <= h, F.col(a)).otherwise(0.0)).alias(f"{a}_{h}") for a in area_fields for h in horizons],
        *[F.min(F.when(F.col(f"cum_{a}") >= bands.low_max * x, F.col("hr"))).alias(f"eta_{i}") for i, (a, x, _) in enumerate(made)])

    def level(i: int, a: str, x: float, h: int):
        eta = F.when(F.col(f"eta_{i}") <= h, F.col(f"eta_{i}"))
        return R.zone_level(F.col(f"{a}_{h}"), eta, bands.minimum * x, bands.low_max * x, bands.medium_max * x, bands.high_eta_hours)

    levels = per.select(*keys, *[level(i, a, x, h).alias(f"lv_{h}_{i}") for h in horizons for i, (a, x, _) in enumerate(made)])
    counts = levels.groupBy(*keys).agg(*[F.count_if(F.col(f"lv_{h}_{i}") == lv).alias(f"n_{lv}_{h}_{i}")
                                         for h in horizons for i in range(len(made)) for lv in S.LEVELS[1:]])
    share = lambda h, i: [F.lit(None), *[F.col(f"n_{lv}_{h}_{i}") / float(members) for lv in S.LEVELS[1:]]]
    return counts.select(*keys, *[F.array(*[R.level_to_int(E.headline(share(h, i), bands.member_share)) for i in range(len(made))]).alias(f"lv_{h}")
                                  for h in horizons])


def tune(stops: DataFrame, labels: DataFrame, area_fields: Sequence[str], scales: Sequence[float],
         run: str = "run_at", target: str = "zone", bands: S.RiskBands = S.ZONE_BANDS, horizons: Sequence[int] = S.HORIZONS) -> DataFrame:
    """MLE-08 / AGG-29: best settings by macro-F1 of their 24 h forecasts.

    Which run was issued in time for a day does not depend on the setting, so the arrays of levels
    go through that choice and the join to the labels; only the matched pairs are repeated per
    setting, straight into the counts of the scores.
    """
    made = _settings(area_fields, scales)
    fc = setting_levels(stops, [run, target], area_fields, scales, horizons=horizons, bands=bands)
    steps = F.explode(F.array(*[F.struct(F.lit(h).alias("horizon_hours"), F.col(f"lv_{h}").alias("preds")) for h in horizons]))
    h = (fc.select(F.col(target).alias("ident"), F.col(run).alias("run_at"), steps.alias("h"))
         .select("ident", "run_at", "h.*", local_day(F.timestamp_add("HOUR", F.col("h.horizon_hours"), F.col("run_at"))).alias("day"))
         .where(F.col("run_at") <= local_day_end(F.col("day"))))
    pred = h.groupBy("ident", "day", "horizon_hours").agg(F.max_by("preds", "run_at").alias("preds"))
    names = F.array(*[F.lit(name) for _, _, name in made])
    pairs = (labels.join(pred, ["ident", "day"])
             .select("truth", "horizon_hours", F.explode(F.arrays_zip(names.alias("setting"), F.col("preds").alias("pred"))).alias("s"))
             .select("truth", "s.pred", "s.setting", F.concat(F.lit("physics_"), F.col("horizon_hours").cast("string"), F.lit("h @"), F.col("s.setting")).alias("name")))
    return SC.rank_settings(SC.score(pairs, ["setting", "name"]))
