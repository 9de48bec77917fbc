"""Profiles and daily reductions of ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import surf as U
from tidelens.functions.surf import derived_profile

FIELDS = ("sport", "shore_normal_deg", "swell_window_deg", "min_rideable_m", "ideal_lo_m", "ideal_hi_m", "max_manageable_m",
          "face_factor", "wind_lo_kt", "wind_hi_kt")


def profiles_for(beaches: DataFrame, spots: DataFrame, key: str) -> DataFrame:
    """JON-17: the curated spot of a beach when there is one, else the derived profile, labelled."""
    s = spots.select(key, F.struct(*FIELDS).alias("_spot"))
    own = derived_profile(F.col("region"), F.col("activities"), F.col("water_conditions"))
    return (beaches.join(s, key, "left").withColumn("profile", F.coalesce("_spot", own))
            .withColumn("precision", F.when(F.col("_spot").isNotNull(), "spot").otherwise("region")).drop("_spot"))


def daily_outlook(rated: DataFrame, days: int = 3, start: int = 10, end: int = 22) -> DataFrame:
    """WIN-11: per beach and day the best daylight hour (UTC), the earliest on ties, for some days from
    the first day of the series. Partial aggregation: a long series is not sorted."""
    r = rated.withColumn("day", F.to_date("time"))
    first = r.groupBy("beach").agg(F.min("day").alias("_d0"))
    day = r.where(F.hour("time").between(start, end)).join(first, "beach").where(F.col("day") < F.date_add("_d0", days))
    best = day.groupBy("beach", "day").agg(F.min_by(F.struct("time", "rating", "score"), F.struct(-F.col("score"), "time")).alias("b"))
    return best.select("beach", "day", "b.time", "b.rating", "b.score")


def rate_spots(rows: DataFrame, profile: str = "p", condition: str = "c", out: str = "r") -> DataFrame:
    """SCL-10: rating struct <raw, score, rating, reason, relation, face_lo, face_hi, oversize, no_data>.

    Missing direction, period or wind take neutral values; a missing essential field gives no data.
    Factors, score and verdict are separate projections: each factor is computed once per row and
    every stage stays small enough for generated code.
    """
    p, c = F.col(profile), F.col(condition)
    swell, speed, wind_dir = c["swell_height_m"], c["wind_speed_kt"], c["wind_direction_deg"]
    v0 = F.coalesce(speed, F.lit(0.0))
    names = rows.columns
    f = rows.select(
        *names, (p["sport"] == "wind").alias("_is_wind"),
        F.when(wind_dir.isNull(), "unknown").otherwise(U.wind_relation(wind_dir, p["shore_normal_deg"])).alias("_rel"),
        U.size_score(swell, p).alias("_size"), U.size_too_big(swell, p).alias("_big"), U.period_score(c["swell_period_s"]).alias("_per"),
        F.when(c["swell_direction_deg"].isNull(), 0.7).otherwise(U.swell_direction_score(c["swell_direction_deg"], p)).alias("_dir"))
    f = f.select("*", F.when(wind_dir.isNull(), 0.8).otherwise(U.wind_score_surf(v0, wind_dir, p)).alias("_wind"))
    f = f.select("*", U.wind_strength_score(speed, p).alias("_str"),
                 F.when(wind_dir.isNull(), 0.85).otherwise(U.wind_direction_score(wind_dir, p)).alias("_wdir"),
                 (F.coalesce(swell, F.lit(0.0)) > p["max_manageable_m"]).alias("_over"),
                 F.when(F.col("_is_wind"), speed.isNull()).otherwise(swell.isNull()).alias("_missing"))
    w = F.col("_is_wind")
    raw = F.when(w, F.lit(10.0) * F.col("_str") * F.col("_wdir") * F.when(F.col("_over"), 0.5).otherwise(1.0)).otherwise(
        F.lit(10.0) * F.col("_size") * F.col("_dir") * F.col("_per") * F.col("_wind"))
    f = f.select("*", F.when(F.col("_missing"), 0.0).otherwise(raw).alias("_raw"))
    lift = (F.col("_raw") < S.RATING_BANDS[0][0]) & F.when(w, F.col("_str") > 0).otherwise(F.col("_big"))
    rating = F.when(F.col("_missing"), "unknown").when(lift, "poor").otherwise(U.rating_of(F.col("_raw")))
    reason = F.when(w, U.wind_reason(F.col("_str"), F.col("_wdir"), speed, p, F.col("_over"))).otherwise(
        U.surf_reason(F.col("_size"), F.col("_big"), F.col("_dir"), F.col("_per"), F.col("_wind"), F.col("_rel"), v0))
    miss = F.col("_missing")
    verdict = F.struct(
        F.col("_raw").alias("raw"), F.round("_raw", 1).alias("score"), rating.alias("rating"),
        F.when(miss, "no_data").otherwise(reason).alias("reason"), F.when(miss, "unknown").otherwise(F.col("_rel")).alias("relation"),
        F.when(miss, 0.0).otherwise(U.face_feet(swell, p, 0.85)).alias("face_lo"),
        F.when(miss, 0.0).otherwise(U.face_feet(swell, p, 1.15)).alias("face_hi"),
        (~miss & F.when(w, F.col("_over")).otherwise(F.col("_big"))).alias("oversize"), miss.alias("no_data"))
    return f.select(*names, verdict.alias(out))
