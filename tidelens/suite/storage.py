"""Tolerant reads, upserts, inserts, updates and change logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidelens.operators import keyed as K
from tidelens.sources import tables as T
from tidelens.session import shared_path
from tidelens.suite.registry import query


@query("src_08_tolerant_read", """
    SELECT id, zone_id, risk_level, CAST(NULL AS DOUBLE) AS arrival_probability, model_version FROM forecasts_v""", "forecasts_v")
def tolerant_read(v):
    return T.conform(v.forecasts, {"id": "bigint", "zone_id": "int", "risk_level": "string", "arrival_probability": "double", "model_version": "string"})


@query("snk_01_detection_rows", """
    SELECT id, 'SRID=4326;POINT(' || printf('%.3f', lon) || ' ' || printf('%.3f', lat) || ')' AS centroid, area_km2, coalesce(CASE WHEN id % 4 <> 0 THEN source END, 'sentinel-2') AS source,
      CASE WHEN id % 3 <> 0 THEN area_km2 / 2 END AS covered_km2 FROM detections_v""", "detections_v")
def detection_rows(v):
    k = F.col("id")
    p = v.detections.select(F.format_string("%.3f", "lat").alias("centroid_lat"), F.format_string("%.3f", "lon").alias("centroid_lon"), "area_km2", F.when(k % 4 != 0, F.col("source")).alias("source"),
                            F.when(k % 3 == 0, F.lit(float("nan"))).otherwise(F.col("area_km2") / 2).alias("covered_km2"), k.cast("string").alias("geom_wkt"))
    rows = T.detection_rows(p, F.lit("2024-02-01").cast("timestamp"))
    return rows.select(F.substring_index("geom", ";", -1).cast("bigint").alias("id"), "centroid", "area_km2", "source", "covered_km2")


@query("snk_02_named_forecasts", """
    SELECT id, z.zone_id, risk_level, 'v9' AS model_version FROM forecasts_v f JOIN zones_v z ON z.name = 'NATION_' || (f.zone_id + 2)""", "forecasts_v zones_v")
def named_forecasts(v):
    f = v.forecasts.select("id", "risk_level", F.concat(F.lit("NATION_"), (F.col("zone_id") + 2).cast("string")).alias("zone_name"))
    return T.named_rows(f, v.zones, "v9").select("id", "zone_id", "risk_level", "model_version")


@query("snk_03_upsert", """
    WITH inc AS (SELECT run_at, zone_id, physics_risk + 10 AS physics_risk, 'drift' AS model_version FROM features_v WHERE zone_id % 4 = 0
      UNION ALL SELECT run_at + INTERVAL 365 DAY, zone_id, physics_risk, model_version FROM features_v WHERE zone_id % 5 = 0)
    SELECT CAST(run_at AS VARCHAR) AS run_at, zone_id, model_version, CAST(physics_risk AS INT) AS physics_risk FROM inc
    UNION ALL SELECT CAST(run_at AS VARCHAR), zone_id, model_version, physics_risk FROM features_v f WHERE NOT EXISTS (SELECT 1 FROM inc i WHERE i.run_at = f.run_at AND i.zone_id = f.zone_id AND i.model_version = f.model_version)""", "features_v")
def upsert(v):
    cols = ["run_at", "zone_id", "model_version", "physics_risk"]
    cur = v.features.select(*cols)
    a = v.features.where("zone_id % 4 = 0").select("run_at", "zone_id", F.lit("drift").alias("model_version"), (F.col("physics_risk") + 10).alias("physics_risk"), F.lit(2).alias("batch"))
    stale = a.withColumn("physics_risk", F.lit(-1)).withColumn("batch", F.lit(1))
    b = v.features.where("zone_id % 5 = 0").select((F.col("run_at") + F.expr("INTERVAL 365 DAYS")).alias("run_at"), "zone_id", "model_version", "physics_risk", F.lit(1).alias("batch"))
    out = K.upsert(cur, stale.unionByName(a).unionByName(b), ["run_at", "zone_id", "model_version"], ["batch"])
    return out.select(F.col("run_at").cast("string").alias("run_at"), "zone_id", "model_version", "physics_risk")


@query("snk_04_insert_missing", """
    SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT (SELECT max(c_custkey) FROM customer WHERE c_custkey % 2 = 0) + row_number() OVER (ORDER BY c_name), c_name FROM customer WHERE c_custkey % 2 = 1""")
def insert_missing(v):
    c = v.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return K.insert_missing(c.where("id % 2 = 0"), c.select("name"), "name", "id")


@query("snk_05_update_column", """
    SELECT id, CAST(CASE WHEN id % 5 = 0 THEN TIMESTAMP '2024-02-01 00:00:00' ELSE last_alerted END AS VARCHAR) AS last_alerted FROM subscribers_v""", "subscribers_v")
def update_column(v):
    new = v.subscribers.where("id % 5 = 0").select("id", F.lit("2024-02-01").cast("timestamp").alias("last_alerted"))
    return K.update_column(v.subscribers, new, ["id"], "last_alerted").select("id", F.col("last_alerted").cast("string").alias("last_alerted"))


LOG = """
    log AS (SELECT event_id AS seq, CASE WHEN event_id % 9 = 0 THEN 'delete' ELSE 'upsert' END AS op, 'chat' || (event_id % 401) AS chat_id, CAST(user_id % 25 + 1 AS INT) AS zone_id, event_type AS role FROM events),
    gone AS (SELECT chat_id, max(seq) AS g FROM log WHERE op = 'delete' GROUP BY 1),
    fresh AS (SELECT chat_id, zone_id, arg_max(role, seq) AS role, max(seq) AS seq FROM log WHERE op = 'upsert' GROUP BY 1, 2),
    cur AS (SELECT DISTINCT chat_id, zone_id, 'subscriber' AS role FROM subscribers_v)"""


@query("snk_06_change_log", f"""
    WITH {LOG} SELECT f.chat_id, f.zone_id, role FROM fresh f LEFT JOIN gone USING (chat_id) WHERE g IS NULL OR f.seq > g
    UNION ALL SELECT chat_id, zone_id, role FROM cur c WHERE chat_id NOT IN (SELECT chat_id FROM gone) AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.chat_id = c.chat_id AND f.zone_id = c.zone_id)""", "subscribers_v")
def change_log(v):
    k = F.col("event_id")
    log = v.events.select(k.alias("seq"), F.when(k % 9 == 0, "delete").otherwise("upsert").alias("op"), F.concat(F.lit("chat"), (k % 401).cast("string")).alias("chat_id"),
                          (F.col("user_id") % 25 + 1).cast("int").alias("zone_id"), F.col("event_type").alias("role"))
    cur = v.subscribers.select("chat_id", "zone_id").distinct().withColumn("role", F.lit("subscriber"))
    return K.apply_changes(cur, log, ["chat_id", "zone_id"], "chat_id").select("chat_id", "zone_id", "role")


@query("snk_07_seed_rows", """
    SELECT beach_name AS name, 'SRID=4326;POINT(' || printf('%.2f', longitude) || ' ' || printf('%.2f', latitude) || ')' AS geom, TRUE AS parking, protected_area, CAST(len(activities) AS INT) AS n_activities FROM beaches_v""", "beaches_v")
def seed_rows(v):
    b = v.beaches.withColumnRenamed("beach_name", "name").withColumn("latitude", F.format_string("%.2f", "latitude")).withColumn("longitude", F.format_string("%.2f", "longitude"))
    return T.seed_beaches(b).select("name", "geom", "parking", "protected_area", F.size("activities").alias("n_activities"))


@query("snk_08_sorted_export", """
    SELECT taxon_id, beach, observation_count FROM taxa_v ORDER BY taxon_id, beach""", "taxa_v")
def sorted_export(v):
    """Written by the exporter and read back."""
    rows, path = v.taxa.select("taxon_id", "beach", "observation_count"), shared_path(v.spark, "export")
    T.export_sorted(rows, path, ["taxon_id", "beach"])
    return v.spark.read.schema(rows.schema).json(path).orderBy("taxon_id", "beach")


@query("snk_10_known_columns", """
    SELECT id, zone_id, risk_level FROM forecasts_v""", "forecasts_v")
def known_columns(v):
    return T.known_columns(v.forecasts, ["id", "zone_id", "risk_level", "later"])


@query("snk_11_metric_rows", """
    SELECT model_version, CAST(count(*) AS BIGINT) AS n_rows, round(avg(physics_risk), 4) AS mean_risk FROM features_v GROUP BY 1""", "features_v")
def metric_rows(v):
    """Written as a metric table and read back."""
    rows, path = v.features.groupBy("model_version").agg(F.count("*").alias("n_rows"), F.round(F.avg("physics_risk"), 4).alias("mean_risk")), shared_path(v.spark, "metrics")
    T.write_metrics(rows, path)
    return v.spark.read.schema(rows.schema).parquet(path)


@query("stm_03_recent_reports", """
    SELECT id FROM reports_v WHERE CAST(created_at - to_hours(id % 72) - INTERVAL 4 HOUR AS DATE) BETWEEN CAST(created_at - INTERVAL 4 HOUR AS DATE) - 1 AND CAST(created_at - INTERVAL 4 HOUR AS DATE)""", "reports_v")
def recent_reports(v):
    from tidelens.streaming.jobs import recent_reports as recent

    r = v.reports.withColumn("observed_ts", F.timestamp_add("HOUR", -(F.col("id") % 72).cast("int"), F.col("created_at")))
    return recent(r, "observed_ts", "created_at").select("id")


@query("stm_05_current_state", """
    SELECT beach_name, id, risk_level FROM (SELECT *, row_number() OVER (PARTITION BY beach_name ORDER BY run_at DESC, id DESC) AS rn FROM beach_forecasts_v) WHERE rn = 1""", "beach_forecasts_v")
def current_state(v):
    """Two batches through the bucketed table that the stream keeps."""
    from tidelens.streaming.state_table import StateTable

    b = v.beach_forecasts.select("beach_name", "id", "run_at", "risk_level")
    table = StateTable(v.spark, shared_path(v.spark, "state"), ["beach_name"], ["run_at", "id"])
    for version, half in enumerate((b.where(F.dayofmonth("run_at") > 15), b.where(F.dayofmonth("run_at") <= 15))):
        table.apply(half, version)
    state = table.read()
    return (b.limit(0) if state is None else state).select("beach_name", "id", "risk_level")


@query("set_07_parameter_grid", """
    SELECT area_field, scale, count(*) AS stops FROM stops_v, (SELECT unnest(['area', 'covered']) AS area_field), (SELECT unnest([0.02, 0.05, 0.1]) AS scale) WHERE area > scale GROUP BY 1, 2""", "stops_v")
def parameter_grid(v):
    from tidelens.plans.tuning import settings_grid

    grid = settings_grid(v.spark, {"area_field": ["area", "covered"], "scale": [0.02, 0.05, 0.1]})
    from tidelens.operators.spatial import carry

    s = carry(v.stops.select("area"), grid, ["area_field", "scale"], "_g").withColumn("_g", F.explode("_g"))
    return s.where(F.col("area") > F.col("_g.scale")).groupBy(F.col("_g.area_field").alias("area_field"), F.col("_g.scale").alias("scale")).agg(F.count("*").alias("stops"))


