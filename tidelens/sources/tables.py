"""Table schemas, tolerant reads and writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions.geo import point_wkt
from tidelens.operators.keyed import pick_latest, upsert

_PROBS = "map<string,double>"
_HORIZONS = f"array<struct<horizon_hours:int,risk_level:string,area_km2:double,valid_at:timestamp,probs:{_PROBS}>>"
_TRACK = "array<struct<h:int,lat:double,lon:double,ashore:double>>"

SCHEMAS = {
    "zones": "zone_id int, name string, center_lat double, center_lon double, polygon string, coast string",
    "detections": ("id bigint, run_at timestamp, geom string, centroid string, area_km2 double, source string, "
                   f"observed_at timestamp, covered_km2 double, track {_TRACK}"),
    "forecasts": ("id bigint, run_at timestamp, zone_id int, risk_level string, eta_hours int, eta_timestamp timestamp, "
                  f"horizons {_HORIZONS}, arrival_probability double, risk_probs {_PROBS}, model_version string"),
    "beach_forecasts": ("id bigint, run_at timestamp, beach_name string, zone_id int, risk_level string, eta_hours int, "
                        f"arrival_probability double, risk_probs {_PROBS}, horizons {_HORIZONS}, model_version string, exposure double"),
    "ml_forecasts": ("id bigint, run_at timestamp, zone_id int, lead_days int, risk_level string, confidence double, "
                     f"method string, valid_at date, probs {_PROBS}, model_version string"),
    "zone_features": ("run_at timestamp, zone_id int, model_version string, eez_area_km2 double, zone_area_km2 double, "
                      "nearest_km double, patch_count bigint, physics_risk int"),
    "beach_reports": ("id bigint, created_at timestamp, observed_on date, observed_at timestamp, beach_name string, "
                      "latitude double, longitude double, zone_id int, amount string, source string"),
    "detection_checks": ("id bigint, afai_dates array<string>, afai_clear_frac double, s2_patches bigint, s2_checkable bigint, "
                         "s2_confirmed bigint, afai_clusters bigint, afai_matched bigint, gap_filled bigint, gap_filled_area_km2 double"),
    "model_evaluations": "id bigint, n_rows bigint, n_folds int, metrics map<string,double>, beats_seasonal boolean, used_for_predict boolean",
    "subscribers": "id bigint, channel string, chat_id string, zone_id int, role string, last_alerted timestamp, created_at timestamp",
    "beaches": ("id bigint, name string, province string, region string, latitude double, longitude double, geom string, "
                "access_type string, access_description string, entrance_fee string, parking boolean, beach_type array<string>, "
                "activities array<string>, wildlife array<string>, ecosystem string, protected_area boolean, facilities array<string>, "
                "water_conditions string, best_time_to_visit string, description string, google_maps_url string"),
}


def conform(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """SRC-08: select columns with their types; those that do not exist yet are null."""
    have = set(df.columns)
    return df.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in columns.items()])


def schema_of(spark: SparkSession, table: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(SCHEMAS[table])


def read_table(spark: SparkSession, path: str, table: str) -> DataFrame:
    """SRC-08: a Parquet table whose older files may lack newer columns."""
    return spark.read.schema(schema_of(spark, table)).parquet(path)


def known_columns(df: DataFrame, target: Sequence[str]) -> DataFrame:
    """SNK-10: drop the columns the target does not have yet."""
    keep = set(target)
    return df.select(*[c for c in df.columns if c in keep])


def detection_rows(patches: DataFrame, run_at: Column) -> DataFrame:
    """SNK-01: patches stamped with one run time, defaults filled, NaN as null."""
    have = set(patches.columns)
    opt = lambda c, t: (F.col(c) if c in have else F.lit(None)).cast(t)
    return patches.select(
        run_at.alias("run_at"),
        F.concat(F.lit("SRID=4326;"), F.coalesce(opt("geom_wkt", "string"), F.lit(""))).alias("geom"),
        point_wkt(F.col("centroid_lat"), F.col("centroid_lon")).alias("centroid"),
        F.col("area_km2").cast("double").alias("area_km2"),
        F.coalesce(opt("source", "string"), F.lit(S.SCENE_SOURCE)).alias("source"),
        opt("observed_at", "timestamp").alias("observed_at"),
        F.nanvl(opt("covered_km2", "double"), F.lit(None).cast("double")).alias("covered_km2"))


def append(df: DataFrame, path: str, day_of: str | None = None, files: int | None = None) -> None:
    """SNK-01 / SNK-02: append, partitioned by the day of a timestamp so reads prune by date.

    Rows of one day are spread over ``files`` writers (none: as they come), never forced into one.
    """
    out = df
    if day_of:
        out = out.withColumn("run_date", F.to_date(day_of))
        if files:
            out = out.repartition(files)
        out.write.mode("append").partitionBy("run_date").parquet(path)
    else:
        out.write.mode("append").parquet(path)


def named_rows(df: DataFrame, zones: DataFrame, version: str) -> DataFrame:
    """SNK-02: forecasts with the zone name resolved to its stored id; unknown names are dropped."""
    rows = df.join(zones.select("zone_id", F.col("name").alias("zone_name")), "zone_name")
    return rows.withColumn("model_version", F.lit(version))


def append_forecasts(df: DataFrame, zones: DataFrame, path: str, version: str) -> None:
    """SNK-02: append of ``named_rows``, partitioned by run day."""
    append(named_rows(df, zones, version), path, "run_at")


def upsert_partitions(spark: SparkSession, path: str, incoming: DataFrame, keys: Sequence[str], order: Sequence[str],
                      partition: str) -> None:
    """SNK-03 on a stored table: only the partitions the new rows fall in are rewritten.

    The merged rows are checkpointed first, then replace the old partitions with dynamic partition
    overwrite, so the job never reads files it is writing.
    """
    from tidelens.session import durable_checkpoint

    touched = incoming.select(partition).distinct()
    current = spark.read.parquet(path).join(touched, partition, "left_semi")
    merged = durable_checkpoint(upsert(current, incoming, keys, order))
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def seed_beaches(catalogue: DataFrame) -> DataFrame:
    """SNK-07: catalogue rows with point text and defaults."""
    have = set(catalogue.columns)
    lists = ("beach_type", "activities", "wildlife", "facilities")
    flags = {"parking": True, "protected_area": False}
    texts = ("access_type", "access_description", "entrance_fee", "ecosystem", "water_conditions", "best_time_to_visit",
             "description", "google_maps_url")
    none = F.lit(None)
    return catalogue.select(
        "name", "province", "region", "latitude", "longitude",
        point_wkt(F.col("latitude"), F.col("longitude")).alias("geom"),
        *[F.coalesce(F.col(c) if c in have else none.cast("array<string>"), F.array().cast("array<string>")).alias(c) for c in lists],
        *[F.coalesce(F.col(c) if c in have else none.cast("boolean"), F.lit(d)).alias(c) for c, d in flags.items()],
        *[(F.col(c) if c in have else none.cast("string")).alias(c) for c in texts])


def export_sorted(df: DataFrame, path: str, keys: Sequence[str]) -> None:
    """SNK-08: deterministic sorted JSON export. Range partitions keep the files in key order, and the
    commit protocol makes the output all or nothing."""
    df.orderBy(*keys).write.mode("overwrite").json(path)


def write_metrics(df: DataFrame, path: str, as_json: bool = False) -> None:
    """SNK-11: metric tables."""
    writer = df.write.mode("overwrite")
    writer.json(path) if as_json else writer.parquet(path)


def evaluation_rows(scores: DataFrame, n_rows: Column, used: Column) -> DataFrame:
    """SNK-02: one evaluation row from long scores (method, macro_f1)."""
    metrics = F.map_from_entries(F.collect_list(F.struct("method", "macro_f1")))
    at = lambda m: F.coalesce(F.max(F.when(F.col("method") == m, F.col("macro_f1"))), F.lit(-1.0))
    return scores.agg(metrics.alias("metrics"), (at("model") > at("seasonal")).alias("beats_seasonal")).select(
        n_rows.alias("n_rows"), "metrics", "beats_seasonal", used.alias("used_for_predict"))
