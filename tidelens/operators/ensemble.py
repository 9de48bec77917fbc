"""Forecasts from ensemble stops: probabilities, headline, ETA, horizons, tracks, beach risk."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import risk as R
from tidelens.functions.geo import haversine_km
from tidelens.operators.discs import arrived_near
from tidelens.operators.quantiles import group_median
from tidelens.operators.spatial import carry, crossing, radius_join, radius_totals, within
from tidelens.session import durable_checkpoint


def arrived_by_member(stops: DataFrame, keys: Sequence[str], horizons: Sequence[int] = S.HORIZONS,
                      minimum: Column | None = None, low_max: Column | None = None) -> DataFrame:
    """AGG-06 + WIN-05: per (keys, member): arrived area at each horizon and the hours at which the
    running area reaches the minimum and the significant bar.

    Stops are summed per hour first (map-side), so the running sum sees at most one row per hour.
    """
    minimum = F.lit(S.ZONE_BANDS.minimum) if minimum is None else minimum
    low_max = F.lit(S.ZONE_BANDS.low_max) if low_max is None else low_max
    last = max(horizons)
    hourly = (stops.where(F.col("hour").isNotNull())
              .groupBy(*keys, "member", F.ceil("hour").cast("int").alias("hr")).agg(F.sum("area").alias("area"))
              .where(F.col("hr") <= last))
    w = W.partitionBy(*keys, "member").orderBy("hr").rowsBetween(W.unboundedPreceding, 0)
    run = hourly.withColumn("cum", F.sum("area").over(w))
    sums = [F.sum(F.when(F.col("hr") <= h, F.col("area")).otherwise(0.0)).alias(f"area_{h}") for h in horizons]
    return run.groupBy(*keys, "member").agg(
        *sums, F.min(F.when(F.col("cum") >= low_max, F.col("hr"))).alias("eta_low"),
        F.min(F.when(F.col("cum") >= minimum, F.col("hr"))).alias("eta_min"))


def headline(shares: Sequence[Column], bar: float) -> Column:
    """AGG-08: highest level whose share of that level or worse reaches the bar."""
    none, low, med, high = shares
    return (F.when(high >= bar, "high").when(high + med >= bar, "medium")
            .when(high + med + low >= bar, "low").otherwise("none"))


def summarise(stops: DataFrame, keys: Sequence[str], members: int = S.MEMBERS,
              horizons: Sequence[int] = S.HORIZONS, bands: S.RiskBands = S.ZONE_BANDS,
              bars: tuple[Column, Column, Column] | None = None) -> DataFrame:
    """RAM-01: forecast per key from ensemble stops.

    Members that bring nothing are level none: their count is the ensemble size minus the members
    seen, so no member grid is built. ``bars`` may be columns of the key, to score many settings in
    one job. Result: shares per level and horizon, headline level, ETA and the horizon array.
    """
    bars = bars or (F.lit(bands.minimum), F.lit(bands.low_max), F.lit(bands.medium_max))
    return _forecast(arrived_by_member(stops, keys, horizons, *bars[:2]), keys, members, horizons, bands, bars)


def _forecast(per: DataFrame, keys: Sequence[str], members: int, horizons: Sequence[int], bands: S.RiskBands, bars: tuple[Column, Column, Column]) -> DataFrame:
    """Levels, shares and hours per key from what arrived by member."""
    minimum, low_max, medium_max = bars
    for h in horizons:
        eta = F.when(F.col("eta_low") <= h, F.col("eta_low"))
        per = per.withColumn(f"lv_{h}", R.zone_level(F.col(f"area_{h}"), eta, minimum, low_max, medium_max,
                                                     bands.high_eta_hours))
    aggs = [F.median("eta_min").alias("_eta"), F.count("eta_min").alias("_eta_n")]
    for h in horizons:
        aggs += [F.count_if(F.col(f"lv_{h}") == lv).alias(f"n_{lv}_{h}") for lv in S.LEVELS[1:]]
        aggs.append(F.sum(f"area_{h}").alias(f"sum_{h}"))
    g = per.groupBy(*keys).agg(*aggs)
    n = float(members)
    share = {}
    for h in horizons:
        parts = {lv: F.col(f"n_{lv}_{h}") / n for lv in S.LEVELS[1:]}
        parts["none"] = (F.lit(members) - sum((F.col(f"n_{lv}_{h}") for lv in S.LEVELS[1:]), F.lit(0))) / n
        share[h] = [parts[lv] for lv in S.LEVELS]
    last = max(horizons)
    enough = F.col("_eta_n") / n >= bands.member_share
    hz = F.array(*[F.struct(F.lit(h).alias("horizon_hours"),
                            headline(share[h], bands.member_share).alias("risk_level"),
                            F.round(F.round(F.col(f"sum_{h}") / n, 9), 3).alias("area_km2"),
                            R.ensure_map(*[F.round(s, 3) for s in share[h]]).alias("probs")) for h in horizons])
    p = [F.round(s, 3).alias(f"p_{lv}") for lv, s in zip(S.LEVELS, share[last])]
    return g.select(*keys, headline(share[last], bands.member_share).alias("risk_level"),
                    F.when(enough, F.col("_eta").cast("int")).alias("eta_hours"),
                    F.round(1.0 - F.round(share[last][0], 3), 3).alias("arrival_probability"), *p,
                    hz.alias("horizons"))


def with_all_targets(forecast: DataFrame, runs: DataFrame, targets: DataFrame, run: str, target: str,
                     horizons: Sequence[int] = S.HORIZONS) -> DataFrame:
    """Targets that no stop reached get the level none. Targets are a closed list (size checked)."""
    every = carry(runs.select(run).distinct(), targets.select(target), [target]).select(
        run, F.explode(f"_ref.{target}").alias(target))
    none_map = R.ensure_map(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0))
    hz = F.array(*[F.struct(F.lit(h).alias("horizon_hours"), F.lit("none").alias("risk_level"),
                            F.lit(0.0).alias("area_km2"), none_map.alias("probs")) for h in horizons])
    f = every.join(forecast, [run, target], "left")
    fill = {"risk_level": F.lit("none"), "arrival_probability": F.lit(0.0), "p_none": F.lit(1.0),
            "p_low": F.lit(0.0), "p_medium": F.lit(0.0), "p_high": F.lit(0.0), "horizons": hz}
    return f.select(run, target, *[F.coalesce(F.col(c), fill[c]).alias(c) if c in fill else F.col(c)
                                   for c in forecast.columns if c not in (run, target)])


def with_valid_times(forecast: DataFrame, run_at: str) -> DataFrame:
    """ARR-01 / DAT-07: horizons with their valid time; ETA as a timestamp."""
    stamp = lambda hours: F.timestamp_add("HOUR", hours, F.col(run_at))
    hz = F.transform("horizons", lambda h: F.struct(h["horizon_hours"].alias("horizon_hours"),
                                                    h["risk_level"].alias("risk_level"),
                                                    h["area_km2"].alias("area_km2"),
                                                    stamp(h["horizon_hours"]).alias("valid_at"),
                                                    h["probs"].alias("probs")))
    return forecast.withColumn("horizons", hz).withColumn("eta_timestamp", stamp(F.col("eta_hours")))


def stops_near(stops: DataFrame, beaches: DataFrame, beach: str, km: float = S.BEACH_STOP_KM) -> DataFrame:
    """JON-12 / RAM-03 input: stops within ``km`` of each beach on the local plane."""
    side = beaches.select(F.col(beach), F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))
    return radius_join(stops, side, km, planar=True).drop("p_lat", "p_lon")


def beach_summary(stops: DataFrame, beaches: DataFrame, beach: str, members: int = S.MEMBERS, horizons: Sequence[int] = S.HORIZONS,
                  bands: S.RiskBands = S.BEACH_BANDS, km: float = S.BEACH_STOP_KM) -> DataFrame:
    """RAM-03: forecast per beach of one run from the stops within ``km``; beaches without any are absent.

    The sums around each position come from ``arrived_near``, so no stop is paired with a beach. A beach listed
    several times at one position counts its stops as often; only one listed at several positions takes their pairs.
    """
    bars = tuple(F.lit(b) for b in (bands.minimum, bands.low_max, bands.medium_max))
    spot = F.struct(F.col("latitude").cast("double").alias("p_lat"), F.col("longitude").cast("double").alias("p_lon"))
    side = beaches.where("latitude is not null and longitude is not null").groupBy(beach).agg(
        F.count("*").alias("times"), F.min(spot).alias("_s"), F.max(spot).alias("_t"))
    single = side.where("_s = _t").select(beach, "times", "_s.*")
    at = ["p_lat", "p_lon", "times"]
    per = arrived_near(stops, single.select(*at).distinct(), km, horizons, bands.minimum, bands.low_max)
    rows = single.join(_forecast(per, at, members, horizons, bands, bars), at).drop(*at)
    several = side.where("_s != _t").select(F.col(beach).alias("_beach"))
    if several.isEmpty():
        return rows
    split = beaches.join(several, F.col(beach).eqNullSafe(F.col("_beach")), "left_semi")
    return rows.unionByName(summarise(stops_near(stops, split, beach, km), [beach], members, horizons, bands))


def majority_owner(stops: DataFrame, beaches: DataFrame, beach: str, owner: str = "zone", km: float = S.BEACH_STOP_KM) -> DataFrame:
    """AGG-10: most frequent owner of the stops within ``km`` per beach, lowest id on ties; counts come without pairs."""
    known = stops.where((F.col(owner) >= 0) & F.col("hour").isNotNull()).withColumn("_one", F.lit(1).cast("long"))
    side = beaches.select(beach, F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))
    n = side.join(radius_totals(known, side, km, [owner], "_one", planar=True), ["p_lat", "p_lon"])
    n = n.groupBy(beach, owner).agg(F.sum("total").alias("_n"))
    return n.groupBy(beach).agg(F.min_by(owner, F.struct(-F.col("_n"), F.col(owner))).alias(owner))


def tracks(snapshots: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG-11: per (keys, h): median position (4 dp) and share ashore (2 dp)."""
    g = [*keys, "h"]
    lat = group_median(snapshots, g, "lat", "lat", bin_width=0.05)
    lon = group_median(snapshots, g, "lon", "lon", bin_width=0.05)
    ashore = snapshots.groupBy(*g).agg(F.round(F.avg(F.col("done").cast("double")), 2).alias("ashore"))
    return (lat.join(lon, g).join(ashore, g)
            .select(*g, F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "ashore"))


def track_arrays(checkpoints: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG-11: checkpoints folded into one sorted array per patch (a handful each)."""
    return checkpoints.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("h", "lat", "lon", "ashore"))).alias("track"))


def track_position(track: Column, hours: Column) -> Column:
    """WIN-14: struct<lat, lon, ashore> at +hours: linear between checkpoints, clamped; the first
    segment that holds the hour; null without a track."""
    pts = F.array_sort(track)
    first, last = F.get(pts, F.lit(0)), F.element_at(pts, -1)
    h = F.greatest(first["h"], F.least(hours, last["h"]))
    segs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(pts) - 2, F.lit(0))),
                       lambda i: F.struct(F.get(pts, i).alias("a"), F.get(pts, i + 1).alias("b")))
    seg = F.get(F.filter(segs, lambda s: (s["a"]["h"] <= h) & (h <= s["b"]["h"])), F.lit(0))
    a, b = seg["a"], seg["b"]
    f = F.when(b["h"] == a["h"], 0.0).otherwise((h - a["h"]) / (b["h"] - a["h"]))
    moved = F.struct((a["lat"] + f * (b["lat"] - a["lat"])).alias("lat"),
                     (a["lon"] + f * (b["lon"] - a["lon"])).alias("lon"),
                     (F.when(f > 0, b["ashore"]).otherwise(a["ashore"]) >= 0.5).alias("ashore"))
    alone = F.struct(first["lat"].alias("lat"), first["lon"].alias("lon"), (first["ashore"] >= 0.5).alias("ashore"))
    return F.when(F.size(track) > 0, F.when(seg.isNotNull(), moved).otherwise(alone))


def shifted(masses: DataFrame, hours: int, wind_u: Column, wind_v: Column) -> DataFrame:
    """RAM-04 input: masses moved ``hours`` ahead by their track, else by the quick fixed steps."""
    moved = R.advect(F.col("lat"), F.col("lon"), hours, wind_u, wind_v)
    if "track" in masses.columns:
        t = track_position(F.col("track"), F.lit(hours))
        pos = F.coalesce(F.struct(t["lat"].alias("lat"), t["lon"].alias("lon")), moved)
    else:
        pos = moved
    return masses.withColumn("_p", pos).withColumn("lat", F.col("_p.lat")).withColumn("lon", F.col("_p.lon")).drop("_p")


def beach_state(masses: DataFrame, beaches: DataFrame, keys: Sequence[str], beach: str, mass_id: str,
                bands: S.NearbyBands = S.NEARBY) -> DataFrame:
    """AGG-19 + WIN-06 + SCL-02: per (keys, beach): weighted area, nearest mass, level.

    Beaches with no mass in the radius are absent (level none for the caller). The weighted area is
    summed inside the join's own tasks; nearest mass and bar are looked for in the radius that must
    hold them (``crossing``), so only the pairs in it are shuffled.
    """
    side = beaches.select(F.col(beach), F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon"))
    seen = masses.select(*keys, mass_id, "lat", "lon", "area_km2")
    g, r = [*keys, beach], bands.radius_km
    rest = lambda d: F.greatest(F.lit(0.0), 1 - d / r)
    share = lambda d: rest(d) * rest(d) if isinstance(d, Column) else max(0.0, 1 - d / r) ** 2
    near = radius_join(seen.drop(mass_id), side, r)
    base = durable_checkpoint(near.groupBy(*g).agg(F.sum(F.coalesce("area_km2", F.lit(0.0)) * share(F.col("dist"))).alias("weighted_km2")))
    own = side.withColumnRenamed(beach, "_beach")
    targets = base.select(*g).join(own, F.col(beach).eqNullSafe(F.col("_beach"))).drop("_beach")
    got = crossing(seen, targets, beach, r, "area_km2", bands.low_max, mass_id, share, keys).withColumnsRenamed({c: f"_{i}" for i, c in enumerate(g)})
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{i}")) for i, c in enumerate(g)])
    known = reduce(and_, [F.col(c).isNotNull() for c in g])
    out = base.join(got, same, "left").withColumn("significant_km", F.when(known, F.col("cross_km")))
    return out.select(*g, "weighted_km2", F.col("near_km").alias("nearest_km"), F.col("near_id").alias("nearest_id"), "significant_km",
                      R.nearby_level(F.col("weighted_km2"), F.col("significant_km"), bands).alias("risk_level"))


_ETA_BLOCKS = (3, 12, 36)  # last hours of the blocks in which ``beach_eta`` moves the masses on


def beach_eta(masses: DataFrame, beaches: DataFrame, keys: Sequence[str], beach: str, wind_u: Column, wind_v: Column,
              max_hours: int = 72, arrival_km: float = 12.0) -> DataFrame:
    """WIN-18: hours until an approaching mass drifts within ``arrival_km`` of each beach.

    The path of a mass does not depend on the beach, so each mass is walked once, hour by hour, in
    blocks of hours. Beaches with a mass at hand (hour 0) are found by occupied squares; only beaches
    that no earlier block reached are joined with the positions of the next. A mass counts for a beach
    when radius, direction and analytic estimate, taken at its start, let it arrive in time.
    """
    group = lambda df: F.struct(*[F.col(c) for c in keys], F.lit(0).alias("_")).alias("_g")
    big = masses.where(F.coalesce("area_km2", F.lit(0.0)) >= S.NEARBY.minimum).where("lat is not null and lon is not null")
    big = big.select(group(big), F.col("lat").alias("_lat0"), F.col("lon").alias("_lon0"), "lat", "lon", wind_u.alias("_wu"), wind_v.alias("_wv"))
    big = durable_checkpoint(big)
    side = beaches.select(F.struct(beach).alias("_p"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon"))
    open_ = big.select("_g").distinct().crossJoin(side.where("lat is not null and lon is not null"))
    found = durable_checkpoint(within(open_, big, arrival_km, "_p", on=["_g"]).withColumn("eta_hours", F.lit(0)))
    open_ = durable_checkpoint(open_.join(found, ["_g", "_p"], "left_anti").withColumnsRenamed({"lat": "p_lat", "lon": "p_lon"}))
    parts, hour = [found], 0
    for last in sorted({h for h in _ETA_BLOCKS if h < max_hours} | {max_hours}):
        if last <= hour or open_.isEmpty():
            break

        def step(acc, h):
            to = R.advect(acc["lat"], acc["lon"], 1, F.col("_wu"), F.col("_wv"))
            at = F.struct(h.alias("h"), to["lat"].alias("lat"), to["lon"].alias("lon"))
            return F.struct(to["lat"].alias("lat"), to["lon"].alias("lon"), F.concat(acc["path"], F.array(at)).alias("path"))

        start = F.struct("lat", "lon", F.array().cast("array<struct<h:int,lat:double,lon:double>>").alias("path"))
        moved = durable_checkpoint(big.withColumn("_m", F.aggregate(F.sequence(F.lit(hour + 1), F.lit(last)), start, step)))
        at = moved.select("_g", "_lat0", "_lon0", "_wu", "_wv", F.explode("_m.path").alias("_s")).select(
            "_g", "_lat0", "_lon0", "_wu", "_wv", F.col("_s.h").alias("h"), F.col("_s.lat").alias("lat"), F.col("_s.lon").alias("lon"))
        met = radius_join(at, open_, arrival_km, on=["_g"])
        first = haversine_km(F.col("_lat0"), F.col("_lon0"), F.col("p_lat"), F.col("p_lon"))
        drift = R.effective_drift(F.col("_lat0"), F.col("_lon0"), F.col("_wu"), F.col("_wv"))
        est = R.approach(F.col("p_lat"), F.col("p_lon"), F.col("_lat0"), F.col("_lon0"), drift, arrival_km)
        hit = met.where((first <= arrival_km + 1.2 * max_hours) & ((first <= arrival_km) | (est["hours"] <= max_hours)))
        hit = durable_checkpoint(hit.groupBy("_g", "_p").agg(F.min("h").alias("eta_hours")))
        parts.append(hit)
        open_ = durable_checkpoint(open_.join(hit, ["_g", "_p"], "left_anti"))
        big = moved.withColumn("lat", F.col("_m.lat")).withColumn("lon", F.col("_m.lon")).drop("_m")
        hour = last
    every = reduce(DataFrame.unionByName, parts).groupBy("_g", "_p").agg(F.min("eta_hours").alias("eta_hours"))
    return every.select(*[F.col(f"_g.{c}").alias(c) for c in keys], F.col(f"_p.{beach}").alias(beach), "eta_hours")


def resolve_beach_level(own: Column, own_horizons: Column, mass_level: Column, has_masses: Column,
                        zone_level: Column, zone_dist: Column, coverage_km: float = S.COVERAGE_KM) -> Column:
    """RAM-05: own forecast (inside coverage), else shifted masses, else the zone, else out."""
    far = F.coalesce(zone_dist > coverage_km, F.lit(False))
    return (F.when(own.isNotNull() & ~far, F.coalesce(own_horizons, own))
            .when(has_masses, F.coalesce(mass_level, F.lit("none")))
            .when(far, "out").otherwise(F.coalesce(zone_level, F.lit("none"))))
