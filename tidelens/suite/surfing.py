"""Surf and wind ratings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import surf as U
from tidelens.operators import surf as OS
from tidelens.operators import timejoin as TJ
from tidelens.sources import payloads as P
from tidelens.suite.registry import query

PROFILE = ("sport", "shore_normal_deg", "swell_window_deg", "min_rideable_m", "ideal_lo_m", "ideal_hi_m", "max_manageable_m", "face_factor", "wind_lo_kt", "wind_hi_kt")
CONDITION = ("swell_height_m", "swell_period_s", "swell_direction_deg", "wind_speed_kt", "wind_direction_deg")


def rated(v):
    j = v.conditions.join(v.profiles, "beach")
    return j.withColumn("p", F.struct(*PROFILE)).withColumn("c", F.struct(*CONDITION))


ANG = "(CASE WHEN ((({a} - {b}) % 360) + 360) % 360 > 180 THEN 360 - ((({a} - {b}) % 360) + 360) % 360 ELSE ((({a} - {b}) % 360) + 360) % 360 END)"
REL = ANG.format(a="wind_direction_deg", b="shore_normal_deg")
OFF = ANG.format(a="swell_direction_deg", b="shore_normal_deg")
PER = ("(CASE WHEN swell_period_s IS NULL THEN 0.6 WHEN swell_period_s <= 4 THEN 0.4 WHEN swell_period_s <= 6 THEN 0.4 + (swell_period_s - 4) * 0.1 "
       "WHEN swell_period_s <= 8 THEN 0.6 + (swell_period_s - 6) * 0.1 WHEN swell_period_s <= 10 THEN 0.8 + (swell_period_s - 8) * 0.075 "
       "WHEN swell_period_s <= 12 THEN 0.95 + (swell_period_s - 10) * 0.025 ELSE 1.0 END)")
FACTORS = f"""
    f AS (SELECT *, {REL} AS rel, {OFF} AS off, {PER} AS per FROM conditions_v JOIN profiles_v USING (beach)),
    g AS (SELECT *, CASE WHEN wind_direction_deg IS NULL THEN 'unknown' WHEN rel >= 135 THEN 'offshore' WHEN rel >= 90 THEN 'cross-offshore' WHEN rel >= 45 THEN 'cross-onshore' ELSE 'onshore' END AS relation,
      CASE WHEN swell_height_m IS NULL OR swell_height_m <= min_rideable_m THEN 0.0 WHEN swell_height_m < ideal_lo_m THEN (swell_height_m - min_rideable_m) / (ideal_lo_m - min_rideable_m)
           WHEN swell_height_m <= ideal_hi_m THEN 1.0 WHEN swell_height_m >= max_manageable_m THEN 0.0 ELSE 1 - (swell_height_m - ideal_hi_m) / (max_manageable_m - ideal_hi_m) END AS size,
      coalesce(swell_height_m > ideal_hi_m AND swell_height_m >= max_manageable_m, FALSE) AS big,
      CASE WHEN swell_direction_deg IS NULL THEN 0.7 WHEN off >= swell_window_deg / 2 THEN 0.35 * greatest(0.0, 1 - (off - swell_window_deg / 2) / 30) ELSE 0.35 + 0.65 * cos(radians(90 * off / (swell_window_deg / 2))) END AS dir,
      coalesce(wind_speed_kt, 0.0) AS v0, least(1.0, greatest(0.0, (coalesce(wind_speed_kt, 0.0) - 3) / 17)) AS wt FROM f),
    h AS (SELECT *, CASE WHEN relation = 'unknown' THEN 0.8 ELSE least(1.0, greatest(0.0, ((1 - wt) + (CASE relation WHEN 'offshore' THEN 1.0 WHEN 'cross-offshore' THEN 0.85 WHEN 'cross-onshore' THEN 0.55 ELSE 0.3 END) * wt)
        * (CASE WHEN relation = 'offshore' AND v0 > 22 THEN greatest(0.45, 1 - (v0 - 22) / 30) ELSE 1.0 END))) END AS wind,
      CASE WHEN wind_speed_kt <= wind_lo_kt * 0.6 THEN 0.0 WHEN wind_speed_kt < wind_lo_kt THEN (wind_speed_kt - wind_lo_kt * 0.6) / (wind_lo_kt - wind_lo_kt * 0.6) WHEN wind_speed_kt <= wind_hi_kt THEN 1.0
           ELSE greatest(0.15, 1 - 0.65 * (wind_speed_kt - wind_hi_kt) / 10) END AS strength,
      CASE WHEN wind_direction_deg IS NULL THEN 0.85 WHEN rel < 30 THEN 0.7 WHEN rel < 60 THEN 0.9 WHEN rel <= 120 THEN 1.0 WHEN rel <= 150 THEN 0.9 ELSE 0.35 END AS wdir,
      coalesce(swell_height_m, 0.0) > max_manageable_m AS over_ FROM g),
    k AS (SELECT *, CASE WHEN sport = 'wind' THEN 10 * strength * wdir * (CASE WHEN over_ THEN 0.5 ELSE 1.0 END) ELSE 10 * size * dir * per * wind END AS raw,
      CASE WHEN sport = 'wind' THEN wind_speed_kt IS NULL ELSE swell_height_m IS NULL END AS missing FROM h),
    r AS (SELECT *, CASE WHEN missing THEN 0.0 ELSE round(raw, 1) END AS score, CASE WHEN missing THEN 'unknown'
        WHEN raw < 0.5 AND ((sport = 'surf' AND big) OR (sport = 'wind' AND strength > 0)) THEN 'poor' WHEN raw < 0.5 THEN 'flat' WHEN raw < 3 THEN 'poor' WHEN raw < 5.5 THEN 'fair' WHEN raw < 8.5 THEN 'good' ELSE 'epic' END AS rating,
      CASE WHEN missing THEN 'no_data' WHEN sport = 'wind' THEN CASE WHEN strength <= 0 THEN 'no_wind' WHEN wdir <= 0.4 THEN 'offshore_unsafe' WHEN wind_speed_kt > wind_hi_kt THEN 'too_windy' WHEN wind_speed_kt < wind_lo_kt THEN 'no_wind'
          WHEN over_ THEN 'too_big' WHEN wdir >= 1 AND strength >= 0.9 THEN 'side_shore' ELSE 'ok' END
        ELSE CASE WHEN big THEN 'too_big' WHEN size <= 0 THEN 'too_small' WHEN dir < 0.35 THEN 'off_axis' WHEN wind <= per AND wind < 0.7 THEN CASE relation WHEN 'onshore' THEN 'onshore_wind' WHEN 'offshore' THEN 'strong_offshore' ELSE 'cross_wind' END
          WHEN per < 0.7 THEN 'short_period' WHEN v0 < 3 THEN 'glassy' WHEN per >= 0.9 AND wind >= 0.85 THEN 'clean' ELSE 'ok' END END AS reason FROM k)"""
CV = "conditions_v profiles_v"


@query("scl_05_angles_and_compass", f"""
    WITH {FACTORS} SELECT id, rel AS angle, relation, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][CAST(floor(wind_direction_deg / 22.5 + 0.5) AS INT) % 16 + 1] AS point FROM g""", CV)
def angles(v):
    j = rated(v)
    return j.select("id", U.angle_between(F.col("wind_direction_deg"), F.col("shore_normal_deg")).alias("angle"),
                    F.coalesce(F.when(F.col("wind_direction_deg").isNotNull(), U.wind_relation(F.col("wind_direction_deg"), F.col("shore_normal_deg"))), F.lit("unknown")).alias("relation"),
                    U.compass_point(F.col("wind_direction_deg")).alias("point"))


@query("scl_06_size_score", f"""
    WITH {FACTORS} SELECT id, round(size, 5) AS size, big FROM g""", CV)
def size(v):
    return rated(v).select("id", F.round(U.size_score(F.col("swell_height_m"), F.col("p")), 5).alias("size"), U.size_too_big(F.col("swell_height_m"), F.col("p")).alias("big"))


@query("scl_07_period_score", f"""
    WITH {FACTORS} SELECT id, round(per, 5) AS per FROM g""", CV)
def period(v):
    return v.conditions.select("id", F.round(U.period_score(F.col("swell_period_s")), 5).alias("per"))


@query("scl_08_direction_score", f"""
    WITH {FACTORS} SELECT id, round(CASE WHEN swell_direction_deg IS NOT NULL THEN dir END, 5) AS dir FROM g""", CV)
def direction(v):
    j = rated(v)
    score = U.swell_direction_score(F.col("swell_direction_deg"), F.col("p"))
    return j.select("id", F.when(F.col("swell_direction_deg").isNotNull(), F.round(score, 5)).alias("dir"))


@query("scl_09_wind_scores", f"""
    WITH {FACTORS} SELECT id, CASE WHEN known THEN round(wind, 5) END AS wind, CASE WHEN known AND sport = 'wind' THEN round(strength, 5) END AS strength, CASE WHEN known THEN wdir END AS wdir
    FROM (SELECT *, wind_direction_deg IS NOT NULL AND wind_speed_kt IS NOT NULL AS known FROM h)""", CV)
def wind_scores(v):
    j = rated(v)
    s, d, p = F.col("wind_speed_kt"), F.col("wind_direction_deg"), F.col("p")
    known = lambda score: F.when(s.isNotNull() & d.isNotNull(), score)
    return j.select("id", known(F.round(U.wind_score_surf(s, d, p), 5)).alias("wind"), known(F.round(F.when(F.col("sport") == "wind", U.wind_strength_score(s, p)), 5)).alias("strength"),
                    known(U.wind_direction_score(d, p)).alias("wdir"))


@query("scl_10_spot_rating", f"""
    WITH {FACTORS} SELECT id, sport, rating, reason, CASE WHEN missing THEN 'unknown' ELSE relation END AS relation, NOT missing AND (CASE WHEN sport = 'wind' THEN over_ ELSE big END) AS oversize, missing AS no_data,
      round(CASE WHEN missing THEN 0.0 ELSE raw END, 11) AS raw FROM r""", CV)
def spot_rating(v):
    j = OS.rate_spots(rated(v))
    return j.select("id", "sport", "r.rating", "r.reason", "r.relation", "r.oversize", "r.no_data", F.round("r.raw", 11).alias("raw"))


@query("win_11_daily_outlook", f"""
    WITH {FACTORS}, d AS (SELECT beach, CAST(time AS DATE) AS day, time, rating, round(CASE WHEN missing THEN 0.0 ELSE raw END, 6) AS sc, hour(time) AS hr FROM r),
    first AS (SELECT beach, min(day) AS day0 FROM d GROUP BY 1)
    SELECT beach, CAST(day AS VARCHAR) AS day, CAST(epoch_us(time) AS BIGINT) AS at_us, rating FROM (SELECT d.*, row_number() OVER (PARTITION BY d.beach, day ORDER BY sc DESC, time) AS rn FROM d JOIN first USING (beach)
      WHERE hr BETWEEN 10 AND 22 AND day < day0 + 3) WHERE rn = 1""", CV)
def daily_outlook(v):
    j = OS.rate_spots(rated(v)).select("beach", "time", "r.rating", F.round("r.raw", 6).alias("score"))
    return OS.daily_outlook(j).select("beach", F.col("day").cast("string").alias("day"), F.unix_micros("time").alias("at_us"), "rating")


@query("jon_10_conditions_at", """
    SELECT beach, id FROM (SELECT beach, id, row_number() OVER (PARTITION BY beach ORDER BY abs(epoch_us(time) - epoch_us(TIMESTAMP '2024-01-15 12:00:00')), time) AS rn FROM conditions_v) WHERE rn = 1""", "conditions_v")
def conditions_at(v):
    gap = F.unix_micros("time") - F.unix_micros(F.lit("2024-01-15 12:00:00").cast("timestamp"))
    return TJ.nearest_row(v.conditions, ["beach"], gap, [F.col("time")]).select("beach", "id")


@query("prj_25_derived_profile", """
    SELECT beach_id, CASE WHEN (list_contains(activities, 'Kitesurfing') OR list_contains(activities, 'Foiling')) AND NOT list_contains(activities, 'Surfing') THEN 'wind' ELSE 'surf' END AS sport,
      CASE region WHEN 'North (Puerto Plata / Cabarete)' THEN 10.0 WHEN 'East (Punta Cana / La Romana)' THEN 85.0 WHEN 'Samaná Peninsula' THEN 355.0 WHEN 'South (Santo Domingo / South Coast)' THEN 185.0 ELSE 215.0 END AS bearing,
      CASE WHEN NOT regexp_matches(lower(water_conditions), 'surf|strong|current|open atlantic|open water|chop|wave|rip') AND regexp_matches(lower(water_conditions), 'calm|sheltered|protected|lagoon') THEN 90.0 ELSE 130.0 END AS window
    FROM beaches_v""", "beaches_v")
def derived_profile(v):
    p = U.derived_profile(F.col("region"), F.col("activities"), F.col("water_conditions"))
    return v.beaches.select("beach_id", p["sport"].alias("sport"), p["shore_normal_deg"].alias("bearing"), p["swell_window_deg"].alias("window"))


@query("jon_17_curated_first", """
    WITH c AS (SELECT beach, sport, shore_normal_deg FROM profiles_v WHERE beach % 4 = 0)
    SELECT beach_id, coalesce(c.shore_normal_deg, CASE region WHEN 'North (Puerto Plata / Cabarete)' THEN 10.0 WHEN 'East (Punta Cana / La Romana)' THEN 85.0 WHEN 'Samaná Peninsula' THEN 355.0
      WHEN 'South (Santo Domingo / South Coast)' THEN 185.0 ELSE 215.0 END) AS bearing, CASE WHEN c.beach IS NOT NULL THEN 'spot' ELSE 'region' END AS precision_ FROM beaches_v b LEFT JOIN c ON c.beach = b.beach_id""",
       "beaches_v profiles_v")
def curated_first(v):
    spots = v.profiles.where("beach % 4 = 0").withColumnRenamed("beach", "beach_id")
    p = OS.profiles_for(v.beaches, spots, "beach_id")
    return p.select("beach_id", F.col("profile.shore_normal_deg").alias("bearing"), F.col("precision").alias("precision_"))


@query("src_07_condition_rows", """
    SELECT beach_id, h, (beach_id * 5 + h) % 30 / 10.0 AS swell, CASE WHEN h % 2 = 0 THEN (beach_id + h) % 25 * 1.0 END AS wind FROM beaches_v, (SELECT unnest([0, 1, 2, 3]) AS h)""", "beaches_v")
def condition_rows(v):
    b = F.col("beach_id")
    stamp = lambda h: F.concat(F.lit("2024-01-01T0"), h.cast("string"), F.lit(":00"))
    hours, even = F.array(*[F.lit(h) for h in range(4)]), F.array(F.lit(0), F.lit(2))
    marine = v.beaches.select(b.alias("beach"), "latitude", "longitude", F.col("latitude").alias("cell_lat"), F.col("longitude").alias("cell_lon"),
                              F.transform(hours, stamp).alias("time"), F.transform(hours, lambda h: (b * 5 + h) % 30 / 10.0).alias("swell_height"),
                              F.array(F.lit(8.0)).alias("swell_period"), F.array().cast("array<double>").alias("swell_direction"))
    wind = v.beaches.select(b.alias("beach"), F.transform(even, stamp).alias("time"), F.transform(even, lambda h: (b + h) % 25 * 1.0).alias("speed"), F.transform(even, lambda h: h * 1.0).alias("direction"))
    c = P.conditions(marine, wind)
    return c.select(F.col("beach").alias("beach_id"), F.hour("time").alias("h"), F.col("swell_height_m").alias("swell"), F.col("wind_speed_kt").alias("wind"))
