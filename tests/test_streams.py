"""Streaming forms against their batch twins, driven by files and the available-now trigger."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_planted import request_rows, wanted_requests
from tidelens.operators import alerts as A
from tidelens.streaming import jobs as J
from tidelens.streaming.state_table import StateTable


def stream_of(spark, df, folder, files=1):
    df.coalesce(files).write.parquet(folder)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(df, folder, mode="append"):
    q = df.writeStream.format("parquet").option("path", folder + "/out").option("checkpointLocation", folder + "/cp").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.read.schema(df.schema).parquet(folder + "/out")


def test_alert_stream_equals_its_batch_twin(spark, views, tmp_path):
    events = views.events.select((F.col("user_id") % 7).alias("subscriber"), (F.col("user_id") % 3).cast("int").alias("zone_id"), "ts")
    got = run(J.alert_stream(stream_of(spark, events, str(tmp_path / "in"))), str(tmp_path))
    want = A.first_of_cooldown(events, ["subscriber", "zone_id"], "ts", 6)
    key = lambda df: sorted((r["subscriber"], r["zone_id"], r["ts"]) for r in df.collect())
    assert key(got) == key(want) and got.count() > 50


def test_limiter_stream(spark, tmp_path):
    rows = request_rows()
    df = spark.createDataFrame([(c, i, t) for c, t, i in rows], "client bigint, request_id bigint, ts timestamp")
    got = run(J.limiter_stream(stream_of(spark, df, str(tmp_path / "in"))), str(tmp_path))
    assert {r["request_id"] for r in got.collect()} == wanted_requests(rows)


def test_current_state_survives_repeated_and_late_batches(spark, tmp_path):
    t0 = dt.datetime(2026, 6, 1)
    src, path = str(tmp_path / "in"), str(tmp_path / "state")
    df = lambda rows: spark.createDataFrame(rows, "k int, run_at timestamp, v string")
    df([(1, t0, "a"), (2, t0, "b")]).write.parquet(src)
    stream = spark.readStream.schema("k int, run_at timestamp, v string").parquet(src)

    def go():
        J.keep_current(stream, path, ["k"], ["run_at"], str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)

    go()
    df([(1, t0 + dt.timedelta(hours=6), "c"), (2, t0 - dt.timedelta(hours=6), "late"), (3, t0, "d")]).write.mode("append").parquet(src)
    go()
    assert {(r["k"], r["v"]) for r in J.read_current(spark, path).collect()} == {(1, "c"), (2, "b"), (3, "d")}


def folders(path):
    """Bytes of every bucket of a state table, by (version, bucket)."""
    found = {}
    for f in (path / "data").glob("*/*/*.parquet"):
        key = tuple(int(p.name.split("=")[1]) for p in (f.parent.parent, f.parent))
        found[key] = found.get(key, 0) + f.stat().st_size
    return found


def test_a_batch_writes_the_buckets_it_touches(spark, tmp_path):
    t0 = dt.datetime(2026, 6, 1)
    for name, keys in (("small", 2_000), ("large", 40_000)):
        rows = spark.range(keys).select("id", F.lit(t0).alias("at"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        table = StateTable(spark, str(tmp_path / name), ["id"], ["at"], buckets=keys // 500)
        table.apply(rows, 0)
        table.apply(rows.where("id = 7").withColumn("v", F.lit("new")), 1)
        written = {k: n for k, n in folders(tmp_path / name).items() if k[0] == 1}
        assert len(written) == 1 and sum(written.values()) < 100_000  # one bucket of about 500 rows, whatever the table holds
        got = {r["id"]: r["v"] for r in table.read().collect()}
        assert len(got) == keys and got[7] == "new" and got[8] == rows.where("id = 8").first()["v"]


def test_a_batch_killed_before_its_commit_changes_nothing(spark, tmp_path, monkeypatch):
    t0 = dt.datetime(2026, 6, 1)
    src, path = str(tmp_path / "in"), str(tmp_path / "state")
    df = lambda rows: spark.createDataFrame(rows, "k int, run_at timestamp, v string")
    df([(i, t0, "a") for i in range(50)]).write.parquet(src)
    stream = spark.readStream.schema("k int, run_at timestamp, v string").parquet(src)

    def go():
        J.keep_current(stream, path, ["k"], ["run_at"], str(tmp_path / "cp"), 8).trigger(availableNow=True).start().awaitTermination(120)

    def dies(*_):
        raise RuntimeError("lost")

    go()
    df([(i, t0 + dt.timedelta(hours=1), "b") for i in range(0, 50, 10)]).write.mode("append").parquet(src)
    with monkeypatch.context() as m:
        m.setattr(StateTable, "_commit", dies)
        with pytest.raises(Exception, match="lost"):
            go()
    assert {v for _, v in folders(tmp_path / "state").items()} and any(v == 1 for v, _ in folders(tmp_path / "state"))
    assert {r["v"] for r in J.read_current(spark, path).collect()} == {"a"}
    go()
    got = {r["k"]: r["v"] for r in J.read_current(spark, path).collect()}
    assert got == {i: "b" if i % 10 == 0 else "a" for i in range(50)}


def test_versions_that_no_recent_commit_names_are_deleted(spark, tmp_path):
    t0 = dt.datetime(2026, 6, 1)
    table = StateTable(spark, str(tmp_path), ["k"], ["at"], buckets=2)
    batch = lambda i: spark.createDataFrame([(k, t0 + dt.timedelta(hours=i), i) for k in range(6)] + [(None, t0, i)], "k int, at timestamp, v int")
    for i in range(5):
        table.apply(batch(i), i)
        table.apply(batch(9), i)  # repeated: passed over
    table.apply(batch(5).limit(0), 5)  # nothing to do
    assert {v for v, _ in folders(tmp_path)} == {3, 4} and sorted(p.name for p in (tmp_path / "commits").iterdir()) == ["3", "4"]
    assert sorted((r["k"] is None, r["k"], r["v"]) for r in table.read().where("k is not null").collect()) == [(False, k, 4) for k in range(6)]
    assert [r["v"] for r in table.read().where("k is null").collect()] == [4]


def test_report_and_arrival_streams(spark, views, tmp_path):
    r = views.reports.select("id", "created_at", F.timestamp_add("HOUR", -(F.col("id") % 72).cast("int"), F.col("created_at")).alias("observed"))
    got = run(J.recent_reports(stream_of(spark, r, str(tmp_path / "r")), "observed", "created_at"), str(tmp_path / "a"))
    assert got.count() == J.recent_reports(r, "observed", "created_at").count() > 0
    s = views.events.select("event_id", F.col("ts").alias("stopped"), F.lit("2024-01-20").cast("timestamp").alias("now"))
    late = run(J.recent_arrivals(stream_of(spark, s, str(tmp_path / "s")), "stopped", "now"), str(tmp_path / "b"))
    assert late.agg(F.min("hour")).first()[0] == 0.0


def test_report_enrichment_stream(spark, views, tmp_path):
    b = views.beaches
    rep = views.reports.join(b.withColumn("beach", F.col("beach_id")).select("beach", "beach_name"), "beach").select("id", "beach_name", "observed_on")
    now = F.lit("2024-01-15 12:00:00").cast("timestamp")
    got = run(J.report_stream(stream_of(spark, rep, str(tmp_path / "in")), b, views.zones, now), str(tmp_path))
    assert got.count() == rep.count() > 0 and got.where("zone_id is null").count() == 0


def test_rows_of_a_batch_are_ordered_over_all_chunks(spark, tmp_path):
    """One client with more rows than an Arrow chunk holds, written newest first."""
    t0 = dt.datetime(2026, 6, 1)
    rows = [(1, i, t0 + dt.timedelta(seconds=10 * i)) for i in range(60)][::-1]
    df = spark.createDataFrame(rows, "client bigint, request_id bigint, ts timestamp")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = run(J.limiter_stream(stream_of(spark, df, str(tmp_path / "in")), 60, 2), str(tmp_path))
        ids = {r["request_id"] for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    live, want = [], set()
    for _, i, t in rows[::-1]:
        live = [x for x in live if (t - x).total_seconds() <= 60]
        if len(live) < 2:
            live.append(t)
            want.add(i)
    assert ids == want and len(want) < 60
