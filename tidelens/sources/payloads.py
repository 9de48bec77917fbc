"""Landed payload files as tables. Downloads are not part of the library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import text as X
from tidelens.functions.dates import parse_ts
from tidelens.functions.geo import haversine_km, parse_point
from tidelens.functions.risk import wind_uv
from tidelens.operators.keyed import pick_latest, pick_one

GRID_SCHEMA = "table struct<columnNames:array<string>, rows:array<array<string>>>"


def grid_payload(raw: DataFrame, text: str = "body", fields: tuple[str, ...] = ("time", "latitude", "longitude", "AFAI"),
                 keep: tuple[str, ...] = ()) -> DataFrame:
    """SRC-01: (day, lat, lon, value) of table payloads, columns found by name; null value = no view."""
    doc = F.from_json(F.col(text), GRID_SCHEMA)
    names = F.col("doc.table.columnNames")
    at = lambda row, name: F.get(row, (F.array_position(names, name) - 1).cast("int"))
    rows = raw.select(*keep, doc.alias("doc")).select(*keep, "doc", F.explode("doc.table.rows").alias("r"))
    t, la, lo, v = (at(F.col("r"), f) for f in fields)
    return rows.select(*keep, F.to_date(parse_ts(t)).alias("day"), la.cast("double").alias("lat"),
                       lo.cast("double").alias("lon"), v.cast("double").alias("value"))


def read_grid_payloads(spark: SparkSession, path: str) -> DataFrame:
    """SRC-01 from files, one JSON document per file."""
    return grid_payload(spark.read.text(path, wholetext=True).withColumnRenamed("value", "body"))


def index_axis(cells: DataFrame, coord: str, out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """SRC-01: 0-based grid index of a coordinate: its rank among the distinct lines.

    Only the distinct lines of the grid are ranked, then joined back.
    """
    lines = cells.select(*keys, coord).distinct()
    w = W.partitionBy(*keys).orderBy(coord) if keys else W.orderBy(coord)
    return cells.join(lines.withColumn(out, F.row_number().over(w) - 1), [*keys, coord])


def last_steps(cells: DataFrame, day: str, n: int, box: dict | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """SRC-02: rows of the last ``n`` time steps that exist, inside a box.

    The steps are the top n of the distinct days, a table of n rows per key.
    """
    src = cells
    if box:
        src = src.where(F.col("lat").between(box["min_lat"], box["max_lat"]) & F.col("lon").between(box["min_lon"], box["max_lon"]))
    days = cells.select(*keys, day).distinct()
    if keys:
        last = days.withColumn("_r", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(day)))).where(F.col("_r") <= n).drop("_r")
    else:
        last = days.orderBy(F.desc(day)).limit(n)
    return src.join(last, [*keys, day], "left_semi")


def scenes(images: DataFrame, box: dict, start: str, end: str, cloud: float = S.MAX_SCENE_CLOUD) -> DataFrame:
    """SRC-03: images that touch a box, in a date range [start, end), not too cloudy.

    Plain predicates on columns, so they reach the scan (and prune partitions by date).
    """
    return images.where((F.col("time") >= F.lit(start).cast("timestamp")) & (F.col("time") < F.lit(end).cast("timestamp"))
                        & (F.col("cloud_pct") <= cloud)
                        & (F.col("max_lat") >= box["min_lat"]) & (F.col("min_lat") <= box["max_lat"])
                        & (F.col("max_lon") >= box["min_lon"]) & (F.col("min_lon") <= box["max_lon"]))


def with_quality(pixels: DataFrame, quality: DataFrame, keys: list[str], band: str = "cs_cdf") -> DataFrame:
    """SRC-04: optional quality band of a second collection; missing means clear."""
    return pixels.join(quality.select(*keys, band), keys, "left").withColumn(band, F.coalesce(band, F.lit(1.0)))


def surface_currents(levels: DataFrame) -> DataFrame:
    """SRC-05: top depth only, NaN as 0, the preferred product first.

    Needs (time, lat, lon, depth, product_rank, u, v); one aggregate picks both.
    """
    clean = lambda c: F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))
    pick = F.min_by(F.struct(clean("u").alias("u"), clean("v").alias("v")), F.struct("product_rank", "depth"))
    return levels.groupBy("time", "lat", "lon").agg(pick.alias("r")).select("time", "lat", "lon", "r.u", "r.v")


WIND_SCHEMA = ("latitude double, longitude double, hourly_units struct<windspeed_10m:string>, hourly struct<"
               "time:array<string>, windspeed_10m:array<double>, winddirection_10m:array<double>>")


def wind_payload(raw: DataFrame, text: str = "body") -> DataFrame:
    """SRC-06: (time, lat, lon, u, v) per grid point and hour; a wrong unit is an error, hours without
    speed or direction are skipped."""
    d = raw.select(F.from_json(F.col(text), WIND_SCHEMA).alias("d"))
    unit = F.coalesce("d.hourly_units.windspeed_10m", F.lit("m/s"))
    zipped = F.arrays_zip("d.hourly.time", "d.hourly.windspeed_10m", "d.hourly.winddirection_10m")
    checked = F.when(unit.isin("m/s", "ms"), zipped).otherwise(
        F.raise_error(F.concat(F.lit("wind speed unit is "), unit)).cast("array<struct<time:string,windspeed_10m:double,winddirection_10m:double>>"))
    h = d.select("d.latitude", "d.longitude", F.explode(checked).alias("h"))
    u, v = wind_uv(F.col("h.windspeed_10m"), F.col("h.winddirection_10m"))
    return (h.where(F.col("h.windspeed_10m").isNotNull() & F.col("h.winddirection_10m").isNotNull())
            .select(parse_ts(F.col("h.time")).alias("time"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"),
                    u.alias("u"), v.alias("v")))


def check_point_count(points: DataFrame, expected: int) -> DataFrame:
    """SRC-06: fail unless the payload holds the requested number of grid points."""
    got = points.select("lat", "lon").distinct().count()
    if got != expected:
        raise ValueError(f"wind payload has {got} points, {expected} were requested")
    return points


def conditions(marine: DataFrame, wind: DataFrame) -> DataFrame:
    """SRC-07: one condition row per (beach, hour); wind matched by time value, absent wind is null.

    Both sides hold (beach, arrays); marine also the beach and grid positions.
    """
    m = marine.select("beach", F.round(haversine_km(F.col("latitude"), F.col("longitude"), F.col("cell_lat"), F.col("cell_lon")), 1)
                      .alias("sample_km"), F.explode(F.arrays_zip("time", "swell_height", "swell_period", "swell_direction")).alias("m"))
    w = wind.select("beach", F.explode(F.arrays_zip("time", "speed", "direction")).alias("w"))
    w = w.select("beach", F.col("w.time").alias("_t"), F.col("w.speed").alias("wind_speed_kt"), F.col("w.direction").alias("wind_direction_deg"))
    return (m.withColumn("_t", F.col("m.time")).join(w, ["beach", "_t"], "left")
            .select("beach", parse_ts(F.col("_t")).alias("time"), F.col("m.swell_height").alias("swell_height_m"),
                    F.col("m.swell_period").alias("swell_period_s"), F.col("m.swell_direction").alias("swell_direction_deg"),
                    "wind_speed_kt", "wind_direction_deg", "sample_km"))


def geojson_vertices(raw: DataFrame, text: str = "body", key: str = "shape") -> DataFrame:
    """SRC-09: (shape, part, ring, pos, lon, lat) of polygon and multipolygon documents."""
    kind = F.get_json_object(F.col(text), "$.geometry.type")
    coords = F.get_json_object(F.col(text), "$.geometry.coordinates")
    multi = F.when(kind == "Polygon", F.concat(F.lit("["), coords, F.lit("]"))).otherwise(coords)
    parts = F.from_json(multi, "array<array<array<array<double>>>>")
    return (raw.select(key, F.posexplode(parts).alias("part", "rings"))
            .select(key, "part", F.posexplode("rings").alias("ring", "pts"))
            .select(key, "part", "ring", F.posexplode("pts").alias("pos", "p"))
            .select(key, "part", "ring", "pos", F.col("p")[0].alias("lon"), F.col("p")[1].alias("lat")))


COUNT_SCHEMA = ("count bigint, taxon struct<id:bigint, name:string, preferred_common_name:string, english_common_name:string, "
                "iconic_taxon_name:string, conservation_status:struct<geoprivacy:string, place:struct<id:bigint>, place_id:bigint>, "
                "default_photo:struct<id:bigint, license_code:string, square_url:string, attribution:string, attribution_name:string>>")


def species_counts(raw: DataFrame, text: str = "body") -> DataFrame:
    """SRC-10: validated candidates of species-count rows (one row document each); malformed ones vanish."""
    keep = [c for c in raw.columns if c != text]
    # The outer generator keeps each value as it is: a filter on it is not moved below, where it would be worked out again.
    once = lambda value: F.explode_outer(F.array(value))
    d = raw.select(*keep, once(F.from_json(F.col(text), COUNT_SCHEMA, {"mode": "PERMISSIVE"})).alias("r"))
    d = d.where(F.col("r.taxon.id").isNotNull() & (F.col("r.count") >= 1))
    d = d.select(*keep, "r", once(X.clean_text(F.col("r.taxon.name"), 80)).alias("_name"))
    name = F.col("_name")
    return (d.where(name.isNotNull())
            .select(*keep, F.col("r.taxon.id").alias("taxon_id"), name.alias("scientific_name"),
                    X.clean_name(F.col("r.taxon.preferred_common_name")).alias("name_es"),
                    X.clean_name(F.col("r.taxon.english_common_name")).alias("name_en"),
                    X.clean_text(F.col("r.taxon.iconic_taxon_name"), 40).alias("iconic_group"),
                    F.col("r.count").alias("observation_count"), F.col("r.taxon.default_photo").alias("default_photo"),
                    F.col("r.taxon.conservation_status").alias("summary_status")))


def slim_details(details: DataFrame) -> DataFrame:
    """SRC-11: only the fields that are read; nested column pruning reaches the scan."""
    photo = lambda e: F.struct(*[e["photo"][c].alias(c) for c in ("id", "license_code", "square_url", "attribution", "attribution_name")])
    return details.select("taxon_id", "conservation_statuses", F.transform("taxon_photos", photo).alias("taxon_photos"))


def marine_tags(checklist: DataFrame, order: str) -> DataFrame:
    """SRC-12: (name, marine) by scientific and accepted name; brackish counts, the last record wins."""
    flag = F.coalesce(F.col("is_marine"), F.lit(False)) | F.coalesce(F.col("is_brackish"), F.lit(False))
    names = checklist.select(F.explode(F.array("scientificName", "acceptedNameUsage")).alias("name"), flag.alias("marine"), order)
    names = names.where(F.col("name").isNotNull() & (F.col("name") != ""))
    return names.groupBy("name").agg(F.max_by("marine", order).alias("marine"))


def tag_marine(candidates: DataFrame, tags: DataFrame, looked_up: DataFrame, today: Column) -> DataFrame:
    """PRJ-30: marine flag with provenance: source and date are null when the lookup failed, false
    when it answered without the name."""
    c = (candidates.join(tags.select(F.col("name").alias("scientific_name"), "marine"), "scientific_name", "left")
         .join(looked_up.select("scientific_name").distinct().withColumn("_ok", F.lit(True)), "scientific_name", "left"))
    ok = F.col("_ok").isNotNull()
    return (c.withColumn("marine", F.coalesce("marine", F.lit(False)) & ok)
            .withColumn("marine_source", F.when(ok, F.lit("obis")))
            .withColumn("marine_tagged_at", F.when(ok, today)).drop("_ok"))


def privacy_reason(statuses: Column, summary: Column) -> Column:
    """PRJ-19: why a species is excluded: its own flags, or unreadable flags (fails closed)."""
    def here(s):
        place = s["place"]
        pid = F.when(place.isNull(), s["place_id"]).otherwise(place["id"])
        anywhere = pid.isNull()
        return F.coalesce(s["geoprivacy"].isin(*S.SENSITIVE_PRIVACY), F.lit(False)) & (anywhere | pid.isin(*S.LOCAL_PLACES))

    listed = F.exists(statuses, here)
    return F.when(statuses.isNull(), "lookup_failed").when(listed | F.coalesce(here(summary), F.lit(False)), "status")


def choose_photo(default: Column, listed: Column) -> Column:
    """PRJ-20: the default photo when it passes, else the first listed one that does; with its origin."""
    def norm(p, origin):
        return F.struct(p["id"].alias("id"), p["license_code"].alias("license_code"), p["square_url"].alias("url"),
                        X.clean_text(F.coalesce(p["attribution_name"], p["attribution"]), 120).alias("attribution"),
                        F.lit(origin).alias("origin"))

    ok = lambda p: (p["id"].isNotNull() & F.coalesce(p["license_code"].isin("cc0", "cc-by", "cc-by-sa"), F.lit(False))
                    & X.is_allowed_image(p["url"]) & p["attribution"].isNotNull())
    every = F.concat(F.array(norm(default, "default_photo")),
                     F.transform(F.coalesce(listed, F.array().cast("array<struct<id:bigint,license_code:string,square_url:string,attribution:string,attribution_name:string>>")),
                                 lambda p: norm(p, "taxon_photos")))
    return F.get(F.filter(every, ok), F.lit(0))


def off_bucket(photo: Column) -> Column:
    """AGG-22 part: allowed licence on a host that is not read."""
    host = X.url_part(photo["square_url"], "HOST")
    return F.coalesce(photo["license_code"].isin("cc0", "cc-by", "cc-by-sa") & photo["square_url"].isNotNull()
                      & ~F.coalesce(host == X.IMAGE_HOST, F.lit(False)), F.lit(False))


def ingest_summary(candidates: DataFrame) -> DataFrame:
    """AGG-22: per beach: total, eligible, excluded by reason, photos by origin, marine, off-bucket."""
    ok = F.col("reason").isNull()
    origin = lambda o: F.count_if(ok & (F.col("photo.origin") == o))
    return candidates.groupBy("beach").agg(
        F.count("*").alias("total"), F.count_if(ok).alias("eligible"),
        F.count_if(F.col("reason") == "status").alias("excluded_status"),
        F.count_if(F.col("reason") == "lookup_failed").alias("excluded_lookup"),
        origin("default_photo").alias("photos_default"), origin("taxon_photos").alias("photos_listed"),
        F.count_if(ok & F.col("marine")).alias("marine"), F.sum(F.when(ok, F.col("off_bucket")).otherwise(0)).alias("off_bucket"))


MIME_TYPES = ("image/jpeg", "image/png", "image/webp")


def media_pages(pages: DataFrame, year_now: int) -> DataFrame:
    """SRC-13: every automatic check on a media page, in order, as one reason chain.

    Needs title, mime, width, height, descriptionurl, thumburl, thumbwidth, license_name, license_url,
    artist and date text. Adds status (candidate / manual / refused), reason and the parsed fields.
    """
    title = X.clean_text(F.col("title"), 255)
    src = X.source_page(F.col("descriptionurl"))
    lic = X.licence_decision(F.col("license_name"), F.col("license_url"))
    author = X.parse_author(F.col("artist"))
    thumb = X.thumbnail(F.col("thumburl"), F.col("thumbwidth"))
    d = (pages.withColumn("_title", title).withColumn("_src", src).withColumn("_lic", lic)
         .withColumn("_author", author).withColumn("_thumb", thumb))
    reason = (F.when(F.col("_title").isNull() | F.col("mime").isNull(), "no imageinfo")
              .when(~F.col("mime").isin(*MIME_TYPES), "file type")
              .when((F.coalesce("width", F.lit(0)) < 800) | (F.coalesce("height", F.lit(0)) <= 0), "under 800 px wide")
              .when(F.col("_src").isNull(), "bad file page URL")
              .when(F.col("_lic.status") == "manual", "manual check")
              .when(F.col("_lic.status") == "refused", "licence not allowed")
              .when(F.col("_author").isNull(), "no usable author")
              .when(F.col("_thumb.url").isNull(), F.col("_thumb.reason")))
    status = F.when(reason.isNull(), "candidate").when(reason == "manual check", "manual").otherwise("refused")
    return d.select(*[c for c in pages.columns if c not in ("title",)], F.col("_title").alias("title"),
                    status.alias("status"), reason.alias("reason"), F.col("_src").alias("source_url"),
                    F.col("_thumb.url").alias("thumbnail_url"), F.col("_lic.licence").alias("licence"),
                    F.col("_author").alias("author"), X.parse_year(F.col("date_text"), year_now).alias("year"))


def merge_pages(parts: DataFrame, order: str) -> DataFrame:
    """SRC-14: one row per page from continued responses: union of categories, first non-null value for
    the rest, ordered by distance rank (unranked last).

    Every part is a struct column of ``parts``; categories are distinct before they are folded.
    """
    cats = (parts.select("pageid", F.explode("categories").alias("c"), order).where(F.col("c").isNotNull())
            .groupBy("pageid", "c").agg(F.min(order).alias("o"))
            .groupBy("pageid").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "c"))), lambda s: s["c"]).alias("categories")))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c)
    rest = parts.groupBy("pageid").agg(first("title"), first("rank"))
    out = rest.join(cats, "pageid", "left")
    return out.withColumn("categories", F.coalesce("categories", F.array().cast("array<string>"))).orderBy(F.asc_nulls_last("rank"), "pageid")


def versioned_json(raw: DataFrame, schema: str, version: int = 1, text: str = "body") -> DataFrame:
    """SRC-15: rows of documents whose version and shape are right; anything else gives nothing."""
    doc = F.from_json(F.col(text), f"schema_version int, {schema}", {"mode": "PERMISSIVE"})
    keep = [c for c in raw.columns if c != text]
    return raw.select(*keep, doc.alias("d")).where(F.col("d.schema_version") == version).select(*keep, "d.*")


def stored_runs(detections: DataFrame, since: Column) -> DataFrame:
    """SRC-16: past runs' patches: parsed centroid, observed_at defaulting to the run, null area as 0."""
    p = detections.where(F.col("run_at") >= since).withColumn("_pt", parse_point(F.col("centroid")))
    return (p.where(F.col("_pt").isNotNull())
            .select("id", "run_at", F.col("_pt.lat").alias("lat"), F.col("_pt.lon").alias("lon"),
                    F.coalesce("area_km2", F.lit(0.0)).alias("area_km2"), "covered_km2",
                    F.coalesce("observed_at", "run_at").alias("observed_at"), "source"))
