"""Structured Streaming forms of the time-stateful rules."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidelens import settings as S
from tidelens.operators.alerts import enrich_reports
from tidelens.streaming.state_table import BUCKETS, StateTable


LATE = "10 minutes"  # how late a row may come before a stream drops it


def _in_order(rows: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame | None:
    """All rows of a key in a micro-batch, in order; Arrow hands them over in chunks of any order."""
    parts = [pdf[columns] for pdf in rows if len(pdf)]
    return pd.concat(parts).sort_values(columns, kind="stable") if parts else None


class CooldownProcessor(StatefulProcessor):
    """State of one (subscriber, zone): the time of the last alert, dropped when the watermark passes the cool-down."""

    def __init__(self, hours: float = S.ALERT_COOLDOWN_HOURS):
        self.gap_us = int(hours * 3600 * 1_000_000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, ["us"])
        if pdf is None:
            return
        last = self.last.get()[0] if self.last.exists() else None
        keep = []
        for us in pdf["us"].tolist():
            if last is None or us - last >= self.gap_us:
                keep.append(us)
                last = us
        self.last.update((last,))
        if keep:
            self.handle.registerTimer((last + self.gap_us) // 1000 + 1)
            yield pd.DataFrame({"subscriber": [key[0]] * len(keep), "zone_id": [key[1]] * len(keep), "us": keep})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The cool-down of the last alert is over for every row still to come."""
        if self.last.exists() and (self.last.get()[0] + self.gap_us) // 1000 < timerValues.getCurrentWatermarkInMs():
            self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def alert_stream(events: DataFrame, hours: float = S.ALERT_COOLDOWN_HOURS, late: str = LATE) -> DataFrame:
    """STM-01: at most one alert per (subscriber, zone) per cool-down. ``events`` has subscriber,
    zone_id and ts.

    Rows of a micro-batch are walked in order of time; a row later than the watermark (``late``
    behind the newest time of the batches before) is dropped. Needs the RocksDB state store.
    """
    src = (events.withWatermark("ts", late)
           .select(F.col("subscriber").cast("long"), F.col("zone_id").cast("int"), "ts", F.unix_micros("ts").alias("us")))
    out = src.groupBy("subscriber", "zone_id").transformWithStateInPandas(
        CooldownProcessor(hours), "subscriber long, zone_id int, us long", "Append", "EventTime")
    return out.select("subscriber", "zone_id", F.timestamp_micros("us").alias("ts"))


class LimiterProcessor(StatefulProcessor):
    """State of one client: the times of its accepted requests inside the window (at most the limit)."""

    def __init__(self, window_s: int = S.LIMIT_WINDOW_S, limit: int = S.LIMIT_REQUESTS):
        self.span, self.limit = window_s * 1_000_000, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hits = handle.getListState("hits", "us bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = _in_order(rows, ["us", "request_id"])
        if pdf is None:
            return
        live = [h[0] for h in self.hits.get()] if self.hits.exists() else []
        ok = []
        for us, rid in zip(pdf["us"].tolist(), pdf["request_id"].tolist(), strict=True):
            live = [t for t in live if us - t <= self.span]
            if len(live) < self.limit:
                live.append(us)
                ok.append(rid)
        if live:
            self.hits.put([(t,) for t in live])
            self.handle.registerTimer((max(live) + self.span) // 1000 + 1)
        if ok:
            yield pd.DataFrame({"client": [key[0]] * len(ok), "request_id": ok})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No row still to come can fall into the window of the newest accepted request."""
        if self.hits.exists() and (max(h[0] for h in self.hits.get()) + self.span) // 1000 < timerValues.getCurrentWatermarkInMs():
            self.hits.clear()
        return iter(())

    def close(self) -> None:
        pass


def limiter_stream(requests: DataFrame, window_s: int = S.LIMIT_WINDOW_S, limit: int = S.LIMIT_REQUESTS, late: str = LATE) -> DataFrame:
    """STM-02: accepted requests of a sliding limiter. ``requests`` has client, request_id and ts.

    Order and late rows as in ``alert_stream``.
    """
    src = (requests.withWatermark("ts", late)
           .select(F.col("client").cast("long"), F.col("request_id").cast("long"), "ts", F.unix_micros("ts").alias("us")))
    return src.groupBy("client").transformWithStateInPandas(
        LimiterProcessor(window_s, limit), "client long, request_id long", "Append", "EventTime")


def recent_reports(reports: DataFrame, observed: str, arrived: str, delay: str = "2 days") -> DataFrame:
    """STM-03: reports observed today or yesterday (local date) at the time they arrive; the watermark
    bounds how long state of earlier days is kept downstream."""
    day, now = F.to_date(F.col(observed) - F.expr("INTERVAL 4 HOURS")), F.to_date(F.col(arrived) - F.expr("INTERVAL 4 HOURS"))
    return reports.withWatermark(observed, delay).where(day.between(F.date_sub(now, 1), now))


def recent_arrivals(stops: DataFrame, stopped: str, now: str, present: int = S.PRESENT_HOURS) -> DataFrame:
    """STM-04: arrivals not older than the present window, with their hour from now (0 when past)."""
    hours = (F.unix_seconds(F.col(stopped)) - F.unix_seconds(F.col(now))) / 3600.0
    return (stops.withWatermark(stopped, f"{present} hours").withColumn("_h", hours).where(F.col("_h") >= -present)
            .withColumn("hour", F.greatest(F.lit(0.0), F.col("_h"))).drop("_h"))


def report_stream(reports: DataFrame, beaches: DataFrame, zones: DataFrame, now: Column) -> DataFrame:
    """STM-06: reports joined to the static catalogue with its nearest zone."""
    return enrich_reports(reports, beaches, zones, now)


def keep_current(stream: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], checkpoint: str, buckets: int = BUCKETS):
    """STM-05: a current-state table (latest per key) kept by a stream, one merge per batch.

    A batch reads and writes the hash buckets of its own keys only; see ``StateTable``.
    """
    def merge(batch: DataFrame, batch_id: int) -> None:
        StateTable(batch.sparkSession, path, keys, order, buckets).apply(batch, batch_id)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def read_current(spark, path: str) -> DataFrame | None:
    """The newest committed version of a current-state table, or nothing yet."""
    return StateTable(spark, path, (), ()).read()
