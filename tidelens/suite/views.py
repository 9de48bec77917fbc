"""Domain tables derived from the test tables by plain arithmetic, in Spark and in SQL."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens import settings as S

_REGION_CASE = " ".join(f"WHEN {i} THEN '{r}'" for i, r in enumerate(S.REGION_ORDER))
_NAMES = ("Playa Rincón", "Bahía Águila", "Cayo Levantado", "Playa Cosón", "Punta Piñón")
_NAME_CASE = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES))
_WATER = ("Calm and sheltered", "Strong surf", "Open Atlantic chop", "Lagoon water, protected")
_WATER_CASE = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_WATER))
_SEASON = ("December–April (dry season)", "Year-round", "June–August & December–February (peak wind)", "May", "",
           "March to June and November")
_SEASON_CASE = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_SEASON))

# Both engines evaluate these; {arr(..)} and {ts} differ in spelling only.
SQL = {
    "zones_v": ("", """
        SELECT CAST(n_nationkey + 1 AS INT) AS zone_id, n_name AS name,
               17.4 + (n_nationkey % 5) * 0.9 AS center_lat,
               -72.0 + floor(n_nationkey / 5) * 1.1 AS center_lon
        FROM nation"""),
    "beaches_v": ("", f"""
        SELECT s_suppkey AS beach_id,
               (CASE s_suppkey % 5 {_NAME_CASE} END) || ' ' || CAST(s_suppkey AS VARCHAR) AS beach_name,
               n_name AS province, CASE n_regionkey {_REGION_CASE} END AS region,
               17.5 + ((s_suppkey * 37) % 400) / 100.0 AS latitude,
               -72.0 + ((s_suppkey * 53) % 460) / 100.0 AS longitude,
               list_filter(['Swimming',
                     CASE WHEN s_suppkey % 2 = 0 THEN 'Surfing' END, CASE WHEN s_suppkey % 3 = 0 THEN 'Kitesurfing' END,
                     CASE WHEN s_suppkey % 5 = 0 THEN 'Diving' END, CASE WHEN s_suppkey % 7 = 0 THEN 'Foiling' END],
                     lambda x: x IS NOT NULL) AS activities,
               CASE s_suppkey % 4 {_WATER_CASE} END AS water_conditions,
               CASE s_suppkey % 6 {_SEASON_CASE} END AS best_time_to_visit,
               s_suppkey % 3 = 0 AS protected_area,
               CASE WHEN s_suppkey % 2 = 0 THEN 'Free' ELSE 'US$5' END AS entrance_fee
        FROM supplier JOIN nation ON s_nationkey = n_nationkey"""),
    "detections_v": ("", """
        SELECT event_id AS id, date_trunc('day', ts) AS run_at, ts AS observed_at,
               17.3 + ((event_id * 7919) % 4200) / 1000.0 AS lat,
               -72.1 + ((event_id * 104729) % 4800) / 1000.0 AS lon,
               value / 100 AS area_km2, event_type AS source
        FROM events"""),
    "reports_v": ("", """
        SELECT event_id AS id, user_id AS beach, CAST(user_id % 25 + 1 AS INT) AS zone_id, ts AS created_at,
               CAST(ts - INTERVAL 4 HOUR AS DATE) AS observed_on,
               CASE event_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' WHEN 3 THEN 'high'
                    ELSE 'lots' END AS amount
        FROM events"""),
    "stops_v": ("", """
        SELECT CAST(year(l_shipdate) AS INT) AS run, CAST(l_orderkey % 200 AS INT) AS patch,
               CAST(l_partkey % 24 AS INT) AS member,
               CAST((l_suppkey * 7 + l_linenumber) % 25 + 1 AS INT) AS zone,
               CAST((l_orderkey * 31 + l_linenumber) % 73 AS INT) AS hour,
               l_quantity * l_discount / 40 AS area,
               l_quantity * l_tax / 30 AS covered,
               17.5 + ((l_orderkey * 13) % 400) / 100.0 AS lat,
               -72.0 + ((l_partkey * 17) % 460) / 100.0 AS lon
        FROM lineitem"""),
    "snapshots_v": ("", """
        SELECT CAST(l_orderkey % 200 AS INT) AS patch, CAST((l_linenumber % 4) * 24 AS INT) AS h,
               17.5 + ((l_orderkey * 13 + l_linenumber * 7) % 400) / 100.0 AS lat,
               -72.0 + ((l_partkey * 17 + l_linenumber * 3) % 460) / 100.0 AS lon,
               (l_partkey + l_orderkey) % 3 = 0 AS done
        FROM lineitem"""),
    "cells_v": ("", """
        SELECT scene, day, "row", col, CASE WHEN s % 50 = 7 THEN NULL WHEN s % 37 = 0 THEN 0.004
               ELSE round((CASE WHEN s % 10 < 3 THEN 0.0025 ELSE 0.0005 END) + (s % 100) / 100000.0, 6) END AS value
        FROM (SELECT CAST(l_suppkey AS INT) AS scene, CAST(l_linenumber % 3 AS INT) AS day,
                     CAST(l_partkey % 8 AS INT) AS "row", CAST(l_orderkey % 8 AS INT) AS col,
                     CAST(sum(l_orderkey + l_partkey) AS BIGINT) AS s
              FROM lineitem GROUP BY 1, 2, 3, 4)"""),
    "conditions_v": ("", """
        SELECT event_id AS id, user_id AS beach, ts AS time,
               CASE WHEN event_id % 11 = 0 THEN NULL ELSE ((event_id * 37) % 450) / 100.0 END AS swell_height_m,
               CASE WHEN event_id % 13 = 0 THEN NULL ELSE 3 + ((event_id * 7) % 110) / 10.0 END AS swell_period_s,
               CASE WHEN event_id % 17 = 0 THEN NULL ELSE CAST((event_id * 7) % 360 AS DOUBLE) END AS swell_direction_deg,
               CASE WHEN event_id % 19 = 0 THEN NULL ELSE ((event_id * 13) % 350) / 10.0 END AS wind_speed_kt,
               CASE WHEN event_id % 23 = 0 THEN NULL ELSE CAST((event_id * 29) % 360 AS DOUBLE) END AS wind_direction_deg
        FROM events"""),
    "profiles_v": ("", """
        SELECT beach, CASE WHEN beach % 3 = 0 THEN 'wind' ELSE 'surf' END AS sport,
               CAST((beach * 47) % 360 AS DOUBLE) AS shore_normal_deg,
               CAST(90 + (beach % 5) * 15 AS DOUBLE) AS swell_window_deg,
               CASE WHEN beach % 3 = 0 THEN 0.0 ELSE 0.5 END AS min_rideable_m,
               CAST(0.8 AS DOUBLE) AS ideal_lo_m, CAST(2.0 AS DOUBLE) AS ideal_hi_m, CAST(3.2 AS DOUBLE) AS max_manageable_m,
               CAST(1.1 AS DOUBLE) AS face_factor,
               CASE WHEN beach % 3 = 0 THEN CAST(13 + beach % 3 AS DOUBLE) END AS wind_lo_kt,
               CASE WHEN beach % 3 = 0 THEN CAST(23 + beach % 4 AS DOUBLE) END AS wind_hi_kt
        FROM (SELECT DISTINCT user_id AS beach FROM events)"""),
    "taxa_v": ("", """
        SELECT l_suppkey AS beach, l_partkey AS taxon_id, p_name || ' ' || CAST(l_partkey AS VARCHAR) AS name,
               CASE WHEN p_brand = 'Brand#1' THEN 'Plantae' ELSE p_brand END AS "group",
               count(*) AS observation_count, p_size % 3 = 0 AS marine, p_size % 2 = 0 AS photo
        FROM lineitem JOIN part ON l_partkey = p_partkey
        GROUP BY l_suppkey, l_partkey, p_name, p_brand, p_size"""),
    "subscribers_v": ("", """
        SELECT c_custkey AS id, CASE WHEN c_custkey % 4 = 0 THEN 'email' ELSE 'telegram' END AS channel,
               'chat' || CAST(c_custkey % 997 AS VARCHAR) AS chat_id, CAST(c_nationkey + 1 AS INT) AS zone_id,
               CASE WHEN c_custkey % 3 = 0 THEN NULL
                    ELSE TIMESTAMP '2024-01-30 12:00:00' - to_hours(CAST(c_custkey % 12 AS BIGINT)) END AS last_alerted
        FROM customer"""),
    # zone forecasts: one row per (day, zone) from the day's event values
    "forecasts_v": ("", """
        SELECT CAST(epoch(run_at) AS BIGINT) // 86400 * 100 + zone_id AS id, run_at, zone_id, area, n,
               CASE WHEN area < 0.5 THEN 'none' WHEN area < 5 THEN 'low' WHEN area < 25 THEN 'medium' ELSE 'high' END AS risk_level,
               CASE WHEN n % 3 = 0 THEN NULL ELSE CAST(n % 72 AS INT) END AS eta_hours,
               CASE zone_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'v1' ELSE 'v2' END AS model_version
        FROM (SELECT date_trunc('day', ts) AS run_at, CAST(user_id % 25 + 1 AS INT) AS zone_id,
                     round(sum(value), 2) / 200 AS area, count(*) AS n
              FROM events GROUP BY 1, 2)"""),
    "horizons_v": ("forecasts_v", """
        SELECT id, run_at, zone_id, model_version, h AS horizon_hours, run_at + to_hours(CAST(h AS BIGINT)) AS valid_at,
               area * (1 + h / 48.0) AS h_area,
               CASE WHEN area * (1 + h / 48.0) < 0.5 THEN 'none' WHEN area * (1 + h / 48.0) < 5 THEN 'low'
                    WHEN area * (1 + h / 48.0) < 25 THEN 'medium' ELSE 'high' END AS risk_level
        FROM forecasts_v, (SELECT unnest([0, 24, 48, 72]) AS h)"""),
    # one feature row per (6-hour run, zone)
    "features_v": ("", """
        SELECT run_at, zone_id, round(sum(value), 2) / 50 AS eez_area_km2, round(sum(value), 2) / 200 AS zone_area_km2,
               round(min(value) * 10, 3) AS nearest_km, count(*) AS patch_count,
               CAST(count(*) % 4 AS INT) AS physics_risk,
               CASE WHEN zone_id % 3 = 0 THEN 'legacy' ELSE 'drift' END AS model_version
        FROM (SELECT time_bucket(INTERVAL 6 HOUR, ts) AS run_at, CAST(user_id % 25 + 1 AS INT) AS zone_id, value FROM events)
        GROUP BY run_at, zone_id"""),
    "extended_v": ("forecasts_v", """
        SELECT id * 10 + lead_days AS id, run_at, zone_id, lead_days,
               CASE (id + lead_days) % 4 WHEN 0 THEN 'none' WHEN 1 THEN 'low' WHEN 2 THEN 'medium' ELSE 'high' END AS risk_level,
               round(0.4 + (n % 50) / 100.0, 3) AS confidence,
               CASE id % 3 WHEN 0 THEN 'ml' WHEN 1 THEN 'persistence' ELSE 'seasonal' END AS method,
               CAST(run_at AS DATE) + CAST(lead_days AS INT) AS valid_at, model_version
        FROM forecasts_v, (SELECT unnest([7, 14, 21]) AS lead_days)"""),
    # beach forecasts and zone map of the beaches
    "beach_forecasts_v": ("", """
        SELECT CAST(epoch(run_at) AS BIGINT) // 86400 * 10000000 + CAST(beach_name AS BIGINT) AS id, run_at, beach_name, area,
               CASE WHEN area < 0.1 THEN 'none' WHEN area < 5 THEN 'low' WHEN area < 25 THEN 'medium' ELSE 'high' END AS risk_level
        FROM (SELECT date_trunc('day', ts) AS run_at, CAST(user_id AS VARCHAR) AS beach_name, round(sum(value), 2) / 150 AS area
              FROM events GROUP BY 1, 2)"""),
    "messages_v": ("", """
        SELECT conv_id, turn, CASE turn % 7
                 WHEN 0 THEN '/reporte ' || word || ' Rincon ' || CAST(conv_id % 40 AS VARCHAR)
                 WHEN 1 THEN '/Subscribe ' || word2
                 WHEN 2 THEN '/status'
                 WHEN 3 THEN '/REPORTE Cosón ' || CAST(conv_id % 40 AS VARCHAR) || ' ' || word
                 WHEN 4 THEN '/stop now' WHEN 5 THEN '  /start' ELSE text END AS text
        FROM (SELECT conv_id, turn, text,
                     CASE conv_id % 5 WHEN 0 THEN 'mucho' WHEN 1 THEN 'Poco' WHEN 2 THEN 'MUCHÍSIMO' WHEN 3 THEN 'quizás' ELSE 'nada' END AS word,
                     CASE conv_id % 4 WHEN 0 THEN 'an' WHEN 1 THEN 'IRA' WHEN 2 THEN 'zzz' ELSE 'Unit' END AS word2
              FROM conversations)"""),
}


def doubles(sql: str) -> str:
    """Write decimal literals as doubles, so both engines do the same arithmetic."""
    parts = sql.split("'")
    parts[::2] = [re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", p) for p in parts[::2]]
    return "'".join(parts)


def with_views(names: list[str], body: str) -> str:
    """SQL text of a query with the derived tables it reads as common table expressions."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in SQL[name][0].split():
            need(dep)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    if not order:
        return doubles(body.strip())
    ctes = ",\n".join(f"{n} AS ({SQL[n][1].strip()})" for n in order)
    body = body.strip()
    if body[:4].upper() == "WITH":
        rest = body[4:].lstrip()
        recursive = rest[:9].upper() == "RECURSIVE"
        return doubles(f"WITH {'RECURSIVE ' if recursive else ''}{ctes},\n{rest[9:].lstrip() if recursive else rest}")
    return doubles(f"WITH {ctes}\n{body}")


class Views:
    """The same tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.table("lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp"))

    @cached_property
    def zones(self) -> DataFrame:
        k = F.col("n_nationkey")
        return self.table("nation").select(
            (k + 1).cast("int").alias("zone_id"), F.col("n_name").alias("name"),
            (F.lit(17.4) + (k % 5) * 0.9).alias("center_lat"), (F.lit(-72.0) + F.floor(k / 5) * 1.1).alias("center_lon"))

    @cached_property
    def beaches(self) -> DataFrame:
        k = F.col("s_suppkey")
        pick = lambda values, key, n: F.get(F.array(*[F.lit(v) for v in values]), (key % n).cast("int"))
        act = lambda cond, name: F.when(cond, name)
        acts = F.array_compact(F.array(F.lit("Swimming"), act(k % 2 == 0, "Surfing"), act(k % 3 == 0, "Kitesurfing"),
                                       act(k % 5 == 0, "Diving"), act(k % 7 == 0, "Foiling")))
        s = self.table("supplier").join(self.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        return s.select(
            k.alias("beach_id"), F.concat(pick(_NAMES, k, 5), F.lit(" "), k.cast("string")).alias("beach_name"),
            F.col("n_name").alias("province"), pick(S.REGION_ORDER, F.col("n_regionkey"), 5).alias("region"),
            (F.lit(17.5) + ((k * 37) % 400) / 100.0).alias("latitude"), (F.lit(-72.0) + ((k * 53) % 460) / 100.0).alias("longitude"),
            acts.alias("activities"), pick(_WATER, k, 4).alias("water_conditions"),
            pick(_SEASON, k, 6).alias("best_time_to_visit"), (k % 3 == 0).alias("protected_area"),
            F.when(k % 2 == 0, "Free").otherwise("US$5").alias("entrance_fee"))

    @cached_property
    def detections(self) -> DataFrame:
        k = F.col("event_id")
        return self.events.select(
            k.alias("id"), F.date_trunc("day", "ts").alias("run_at"), F.col("ts").alias("observed_at"),
            (F.lit(17.3) + ((k * 7919) % 4200) / 1000.0).alias("lat"), (F.lit(-72.1) + ((k * 104729) % 4800) / 1000.0).alias("lon"),
            (F.col("value") / 100).alias("area_km2"), F.col("event_type").alias("source"))

    @cached_property
    def reports(self) -> DataFrame:
        k = F.col("event_id")
        names = F.array(*[F.lit(x) for x in ("none", "low", "medium", "high", "lots")])
        return self.events.select(
            k.alias("id"), F.col("user_id").alias("beach"), (F.col("user_id") % 25 + 1).cast("int").alias("zone_id"),
            F.col("ts").alias("created_at"), F.to_date(F.col("ts") - F.expr("INTERVAL 4 HOURS")).alias("observed_on"),
            F.get(names, (k % 5).cast("int")).alias("amount"))

    @cached_property
    def stops(self) -> DataFrame:
        o, p, s, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"))
        q = F.col("l_quantity")
        return self.lineitem.select(
            F.year("l_shipdate").alias("run"), (o % 200).cast("int").alias("patch"), (p % 24).cast("int").alias("member"),
            ((s * 7 + n) % 25 + 1).cast("int").alias("zone"), ((o * 31 + n) % 73).cast("int").alias("hour"),
            (q * F.col("l_discount") / 40).alias("area"), (q * F.col("l_tax") / 30).alias("covered"),
            (F.lit(17.5) + ((o * 13) % 400) / 100.0).alias("lat"), (F.lit(-72.0) + ((p * 17) % 460) / 100.0).alias("lon"))

    @cached_property
    def snapshots(self) -> DataFrame:
        o, p, n = (F.col(c) for c in ("l_orderkey", "l_partkey", "l_linenumber"))
        return self.lineitem.select(
            (o % 200).cast("int").alias("patch"), ((n % 4) * 24).cast("int").alias("h"),
            (F.lit(17.5) + ((o * 13 + n * 7) % 400) / 100.0).alias("lat"),
            (F.lit(-72.0) + ((p * 17 + n * 3) % 460) / 100.0).alias("lon"), ((p + o) % 3 == 0).alias("done"))

    @cached_property
    def cells(self) -> DataFrame:
        g = self.lineitem.groupBy(F.col("l_suppkey").cast("int").alias("scene"), (F.col("l_linenumber") % 3).cast("int").alias("day"),
                                  (F.col("l_partkey") % 8).cast("int").alias("row"), (F.col("l_orderkey") % 8).cast("int").alias("col"))
        s = F.col("s")
        value = F.when(s % 37 == 0, 0.004).otherwise(
            F.round(F.when(s % 10 < 3, 0.0025).otherwise(0.0005) + (s % 100) / 100000.0, 6))
        return g.agg(F.sum(F.col("l_orderkey") + F.col("l_partkey")).alias("s")).select(
            "scene", "day", "row", "col", F.when(s % 50 != 7, value).alias("value"))

    @cached_property
    def conditions(self) -> DataFrame:
        k = F.col("event_id")
        unless = lambda m, v: F.when(k % m != 0, v)
        return self.events.select(
            k.alias("id"), F.col("user_id").alias("beach"), F.col("ts").alias("time"),
            unless(11, ((k * 37) % 450) / 100.0).alias("swell_height_m"), unless(13, F.lit(3) + ((k * 7) % 110) / 10.0).alias("swell_period_s"),
            unless(17, ((k * 7) % 360).cast("double")).alias("swell_direction_deg"),
            unless(19, ((k * 13) % 350) / 10.0).alias("wind_speed_kt"), unless(23, ((k * 29) % 360).cast("double")).alias("wind_direction_deg"))

    @cached_property
    def profiles(self) -> DataFrame:
        b = F.col("beach")
        wind = b % 3 == 0
        return self.events.select(F.col("user_id").alias("beach")).distinct().select(
            "beach", F.when(wind, "wind").otherwise("surf").alias("sport"), ((b * 47) % 360).cast("double").alias("shore_normal_deg"),
            (F.lit(90) + (b % 5) * 15).cast("double").alias("swell_window_deg"), F.when(wind, 0.0).otherwise(0.5).alias("min_rideable_m"),
            F.lit(0.8).alias("ideal_lo_m"), F.lit(2.0).alias("ideal_hi_m"), F.lit(3.2).alias("max_manageable_m"),
            F.lit(1.1).alias("face_factor"), F.when(wind, (F.lit(13) + b % 3).cast("double")).alias("wind_lo_kt"),
            F.when(wind, (F.lit(23) + b % 4).cast("double")).alias("wind_hi_kt"))

    @cached_property
    def taxa(self) -> DataFrame:
        n = self.table("lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("observation_count"))
        return n.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey")).select(
            F.col("l_suppkey").alias("beach"), F.col("l_partkey").alias("taxon_id"),
            F.concat("p_name", F.lit(" "), F.col("l_partkey").cast("string")).alias("name"),
            F.when(F.col("p_brand") == "Brand#1", "Plantae").otherwise(F.col("p_brand")).alias("group"),
            "observation_count", (F.col("p_size") % 3 == 0).alias("marine"), (F.col("p_size") % 2 == 0).alias("photo"))

    @cached_property
    def subscribers(self) -> DataFrame:
        k = F.col("c_custkey")
        at = F.timestamp_add("HOUR", -(k % 12).cast("int"), F.lit("2024-01-30 12:00:00").cast("timestamp"))
        return self.table("customer").select(
            k.alias("id"), F.when(k % 4 == 0, "email").otherwise("telegram").alias("channel"),
            F.concat(F.lit("chat"), (k % 997).cast("string")).alias("chat_id"), (F.col("c_nationkey") + 1).cast("int").alias("zone_id"),
            F.when(k % 3 != 0, at).alias("last_alerted"))

    @cached_property
    def _forecast_base(self) -> DataFrame:
        g = self.events.groupBy(F.date_trunc("day", "ts").alias("run_at"), (F.col("user_id") % 25 + 1).cast("int").alias("zone_id"))
        return g.agg((F.round(F.sum("value"), 2) / 200).alias("area"), F.count("*").alias("n"))

    @staticmethod
    def level(area, minimum=0.5):
        return F.when(area < minimum, "none").when(area < 5, "low").when(area < 25, "medium").otherwise("high")

    @cached_property
    def forecasts(self) -> DataFrame:
        n, z = F.col("n"), F.col("zone_id")
        hz = F.transform(F.array(*[F.lit(h) for h in S.HORIZONS]), lambda h: F.struct(
            h.alias("horizon_hours"), self.level(F.col("area") * (1 + h / 48.0)).alias("risk_level"),
            (F.col("area") * (1 + h / 48.0)).alias("area_km2"), F.timestamp_add("HOUR", h, F.col("run_at")).alias("valid_at")))
        f = self._forecast_base.withColumn("id", F.floor(F.unix_seconds("run_at") / 86400) * 100 + z)
        return f.select("id", "run_at", "zone_id", "area", "n", self.level(F.col("area")).alias("risk_level"),
                        F.when(n % 3 != 0, (n % 72).cast("int")).alias("eta_hours"),
                        F.when(z % 3 == 1, "v1").when(z % 3 == 2, "v2").alias("model_version"), hz.alias("horizons"))

    @cached_property
    def features(self) -> DataFrame:
        hour6 = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 21600) * 21600)
        g = self.events.groupBy(hour6.alias("run_at"), (F.col("user_id") % 25 + 1).cast("int").alias("zone_id"))
        return g.agg((F.round(F.sum("value"), 2) / 50).alias("eez_area_km2"), (F.round(F.sum("value"), 2) / 200).alias("zone_area_km2"),
                     F.round(F.min("value") * 10, 3).alias("nearest_km"), F.count("*").alias("patch_count"),
                     (F.count("*") % 4).cast("int").alias("physics_risk")).withColumn(
            "model_version", F.when(F.col("zone_id") % 3 == 0, "legacy").otherwise("drift"))

    @cached_property
    def extended(self) -> DataFrame:
        f = self.forecasts.withColumn("lead_days", F.explode(F.array(*[F.lit(x) for x in S.LEADS])))
        i, lead = F.col("id"), F.col("lead_days")
        pick = lambda values, key: F.get(F.array(*[F.lit(v) for v in values]), key.cast("int"))
        return f.select((i * 10 + lead).alias("id"), "run_at", "zone_id", "lead_days", pick(S.LEVELS, (i + lead) % 4).alias("risk_level"),
                        F.round(F.lit(0.4) + (F.col("n") % 50) / 100.0, 3).alias("confidence"),
                        pick(("ml", "persistence", "seasonal"), i % 3).alias("method"),
                        F.date_add(F.to_date("run_at"), lead).alias("valid_at"), "model_version")

    @cached_property
    def beach_forecasts(self) -> DataFrame:
        g = self.events.groupBy(F.date_trunc("day", "ts").alias("run_at"), F.col("user_id").cast("string").alias("beach_name"))
        b = g.agg((F.round(F.sum("value"), 2) / 150).alias("area")).withColumn(
            "id", F.floor(F.unix_seconds("run_at") / 86400) * 10000000 + F.col("beach_name").cast("bigint"))
        hz = F.transform(F.array(*[F.lit(h) for h in S.HORIZONS]), lambda h: F.struct(
            h.alias("horizon_hours"), self.level(F.col("area") * (1 + h / 48.0), 0.1).alias("risk_level"),
            F.timestamp_add("HOUR", h, F.col("run_at")).alias("valid_at")))
        return b.select("id", "run_at", "beach_name", "area", self.level(F.col("area"), 0.1).alias("risk_level"), hz.alias("horizons"),
                        F.lit(None).cast("string").alias("model_version"))

    @cached_property
    def messages(self) -> DataFrame:
        c = F.col("conv_id")
        pick = lambda values, key: F.get(F.array(*[F.lit(v) for v in values]), key.cast("int"))
        word = pick(("mucho", "Poco", "MUCHÍSIMO", "quizás", "nada"), c % 5)
        word2 = pick(("an", "IRA", "zzz", "Unit"), c % 4)
        t, num = F.col("turn") % 7, (c % 40).cast("string")
        text = (F.when(t == 0, F.concat(F.lit("/reporte "), word, F.lit(" Rincon "), num)).when(t == 1, F.concat(F.lit("/Subscribe "), word2))
                .when(t == 2, "/status").when(t == 3, F.concat(F.lit("/REPORTE Cosón "), num, F.lit(" "), word))
                .when(t == 4, "/stop now").when(t == 5, "  /start").otherwise(F.col("text")))
        return self.table("conversations").select("conv_id", "turn", text.alias("text"))

    @cached_property
    def full_cells(self) -> DataFrame:
        from tidelens.operators.grid import full_grid
        from tidelens.session import durable_checkpoint

        return full_grid(durable_checkpoint(self.cells), ["scene", "day"], ["scene"])  # the cells are read three times
