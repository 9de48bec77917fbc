"""Alert selection and report intake in batch form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import dates as D
from tidelens.functions import text as X
from tidelens.operators.timejoin import chain


def alerting(forecasts: DataFrame) -> DataFrame:
    """PRJ-18: only medium and high forecasts raise alerts."""
    return forecasts.where(F.col("risk_level").isin("medium", "high"))


def alerts(forecasts: DataFrame, subscribers: DataFrame, now: Column, hours: int = S.ALERT_COOLDOWN_HOURS) -> DataFrame:
    """JON-21: subscribers of alerting zones on the message channel whose last alert is old enough; an
    alert exactly at the cutoff is allowed again."""
    f = alerting(forecasts).select("zone_id", "zone_name", "risk_level", "eta_hours", "eta_timestamp")
    due = subscribers.where((F.col("channel") == "telegram")
                            & (F.col("last_alerted").isNull() | (F.col("last_alerted") <= now - F.expr(f"INTERVAL {hours} HOURS"))))
    return due.select("id", "chat_id", "zone_id").join(f, "zone_id").select(
        "id", "chat_id", "zone_id", "risk_level",
        X.alert_text(F.col("zone_name"), F.col("risk_level"), F.col("eta_hours"), F.col("eta_timestamp")).alias("message"))


def subscription_status(subscribers: DataFrame, zones: DataFrame, latest: DataFrame) -> DataFrame:
    """JON-22: every subscription with its zone name and newest forecast, as a reply line."""
    name = F.coalesce("name", F.col("zone_id").cast("string"))
    eta = F.when(F.col("eta_hours") > 0, F.concat(F.lit("~"), F.col("eta_hours").cast("string"), F.lit("h"))).otherwise("N/A")
    line = F.when(F.col("risk_level").isNull(), F.concat(name, F.lit(": sin pronóstico disponible"))).otherwise(
        F.concat(name, F.lit(": riesgo "), F.upper("risk_level"), F.lit(" | llegada "), eta))
    return (subscribers.join(zones.select("zone_id", "name"), "zone_id", "left")
            .join(latest.select("zone_id", "risk_level", "eta_hours"), "zone_id", "left")
            .select("id", "chat_id", "zone_id", line.alias("line")))


def accept_reports(reports: DataFrame, beaches: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """PRJ-17: (accepted, rejected with a reason): known beach, one of the four amounts, observed today
    or yesterday (local date); a missing day means today."""
    known = beaches.select(F.col("beach_name")).distinct().withColumn("_known", F.lit(True))
    day = F.coalesce("observed_on", today)
    r = reports.withColumn("observed_on", day).join(known, "beach_name", "left")
    reason = (F.when(~F.coalesce(day.between(F.date_sub(today, 1), today), F.lit(False)), "observed_on must be today or yesterday")
              .when(F.col("_known").isNull(), "unknown beach")
              .when(~F.coalesce(F.col("amount").isin(*S.LEVELS), F.lit(False)), "unknown amount"))
    r = r.withColumn("reason", reason).drop("_known")
    return r.where(F.col("reason").isNull()).drop("reason"), r.where(F.col("reason").isNotNull())


def sliding_requests(requests: DataFrame, client: str, ts: str, window_s: int = S.LIMIT_WINDOW_S) -> DataFrame:
    """WIN-17: requests of the client in the last minute, this one included.

    Requests are counted per (client, time) first, and the running count is partitioned by client and
    two-window time block (each time also serves the next block), so a busy client is many small
    groups, not one.
    """
    span = window_s * 1_000_000
    r = requests.withColumn("_t", F.unix_micros(F.col(ts)))
    block = F.floor(F.col("_t") / span)
    times = r.groupBy(client, "_t").agg(F.count("*").alias("_n")).withColumn("_blk", F.explode(F.array(block, block + 1)))
    w = W.partitionBy(client, "_blk").orderBy("_t").rangeBetween(-span, 0)
    counts = times.withColumn("requests", F.sum("_n").over(w)).where(block == F.col("_blk"))
    return r.join(counts.select(client, "_t", "requests"), [client, "_t"]).drop("_t")


def _stretches(events: DataFrame, keys: list[str], gap_us: int, touching: bool) -> DataFrame:
    """``events`` (keys.., us) with the number of the busy stretch each falls in.

    A stretch ends where two neighbours are a whole gap apart (with ``touching``, exactly a gap still
    joins them). Times inside one gap-wide bucket are closer than that, so the breaks can be read from
    the first and last time per bucket: the window runs on those few rows, not on the events.
    """
    e = events.withColumn("_b", F.floor(F.col("us") / gap_us))
    ends = e.groupBy(*keys, "_b").agg(F.min("us").alias("_lo"), F.max("us").alias("_hi"))
    w = W.partitionBy(*keys).orderBy("_b")
    quiet = F.col("_lo") - F.lag("_hi").over(w)
    joined = quiet <= gap_us if touching else quiet < gap_us
    ends = ends.withColumn("_new", F.when(joined, 0).otherwise(1))
    ends = ends.withColumn("_run", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).select(*keys, "_b", "_run")
    return e.join(ends, [*keys, "_b"]).drop("_b")


def _walk(events: DataFrame, keys: list[str], order: list[str], accept) -> DataFrame:
    """Rows for which ``accept(state, us)`` holds, walked in order inside each stretch.

    Stretches are spread over the cluster and sorted there; a task streams its rows in Arrow batches
    and keeps only the state of the current stretch, so a busy key is never held in memory.
    """
    group = [*keys, "_run"]
    spread = events.repartition(*group).sortWithinPartitions(*group, *order)

    def walk(batches):
        current, state = None, []
        for pdf in batches:
            keep = []
            for key, us in zip(zip(*(pdf[c] for c in group)), pdf["us"]):
                if key != current:
                    current, state = key, []
                keep.append(accept(state, us))
            yield pdf[keep]

    return spread.mapInPandas(walk, spread.schema)


def first_of_cooldown(events: DataFrame, keys: list[str], ts: str, hours: float) -> DataFrame:
    """STM-01 batch twin: the events that alert when each silences its key for some hours.

    Next-allowed-time pointers are doubled, so a busy key is spread over all tasks.
    """
    times = events.select(*keys, F.unix_micros(ts).alias("t")).where("t is not null")
    return chain(times, keys, int(hours * 3600 * 1_000_000)).select(*keys, F.timestamp_micros("t").alias(ts))


def accepted_requests(requests: DataFrame, client: str, ts: str, order: str, window_s: int = S.LIMIT_WINDOW_S,
                      limit: int = S.LIMIT_REQUESTS) -> DataFrame:
    """STM-02 batch twin: exact limiter in which only accepted requests count. Its state is at most
    ``limit`` times."""
    span = window_s * 1_000_000

    def accept(state, us):
        state[:] = [t for t in state if us - t <= span]
        if len(state) >= limit:
            return False
        state.append(us)
        return True

    r = requests.select(client, order, F.unix_micros(ts).alias("us"))
    return _walk(_stretches(r, [client], span, True), [client], ["us", order], accept).select(client, order)


def clamp_arrivals(stops: DataFrame, hours: str, present: int = S.PRESENT_HOURS) -> DataFrame:
    """STM-04: arrivals of the last hours count as now; older ones are not counted."""
    h = F.when(F.col(hours) >= -present, F.greatest(F.lit(0.0), F.col(hours).cast("double")))
    return stops.withColumn("hour", h)


def enrich_reports(reports: DataFrame, beaches: DataFrame, zones: DataFrame, now: Column) -> DataFrame:
    """STM-06: accepted reports with position, nearest zone, and a time of day only when about today."""
    from tidelens.operators.spatial import nearest

    b = nearest(beaches.select("beach_name", "latitude", "longitude"), zones, "zone_id", ("center_lat", "center_lon"),
                ("latitude", "longitude"))
    b = b.select("beach_name", "latitude", "longitude", F.col("near.id").alias("zone_id"))
    stamp = F.when(F.col("observed_on") == D.local_day(now), now)
    return reports.join(b, "beach_name").withColumn("observed_at", stamp)


def extended_of(latest_forecasts: DataFrame, lead_days: int | None = None) -> DataFrame:
    """PRJ-16: extended forecasts, optionally of one lead; any other lead is an error."""
    if lead_days is None:
        return latest_forecasts
    if lead_days not in S.LEADS:
        raise ValueError(f"lead_days must be one of {S.LEADS}")
    return latest_forecasts.where(F.col("lead_days") == lead_days)


def largest_detections(detections: DataFrame, limit: int = 500) -> DataFrame:
    """SRT-01: the largest detections of the latest run; a top-n sort, 1 to 2000 rows."""
    from tidelens.operators.keyed import latest

    if not 1 <= limit <= 2000:
        raise ValueError("limit must be 1 to 2000")
    return latest(detections, [], "run_at").orderBy(F.desc("area_km2"), "id").limit(limit)
