"""The scheduled run: stages, one commit, skipped dependants, alerts across runs."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from tidelens.plans import scheduled as R
from tidelens.suite.learning import run_inputs

FIRST, SOON, LATER = "2024-02-01 00:00:00", "2024-02-01 05:00:00", "2024-02-01 06:00:00"
FEW = tuple(s for s in R.STAGES if s.name in ("forecasts", "alerts"))


@pytest.fixture(scope="module")
def inputs(views):
    return run_inputs(views)


def failing(name, stages=R.STAGES):
    def dies(run):
        raise RuntimeError("no forcing")

    return tuple(dataclasses.replace(s, build=dies) if s.name == name else s for s in stages)


def test_a_run_commits_every_table_once(spark, inputs, tmp_path):
    done = R.run_once(spark, inputs, FIRST, str(tmp_path))
    assert set(done.values()) == {"ok"} and set(done) == {s.name for s in R.STAGES}
    assert R.committed(spark, str(tmp_path), "forecasts").count() == 25
    assert R.committed(spark, str(tmp_path), "ml_forecasts").count() == 75
    check = R.committed(spark, str(tmp_path), "checks").first()
    assert check["clusters"] == check["matched"] + check["gap_filled"] and check["checkable"] >= check["confirmed"]
    row = R.committed(spark, str(tmp_path), "evaluation").first()
    assert row["chosen"] in ("seasonal", "persistence") and set(row["metrics"]) == {"seasonal", "persistence", "majority"}
    assert R.run_once(spark, inputs, FIRST, str(tmp_path)) == done and len(list((tmp_path / "runs").iterdir())) == 1


def test_dependants_of_a_failed_stage_are_skipped(spark, inputs, tmp_path):
    done = R.run_once(spark, inputs, FIRST, str(tmp_path), stages=failing("patches", tuple(s for s in R.STAGES if s.name not in ("evaluation", "beach_forecasts"))))
    assert done == {"gap_fill": "ok", "checks": "ok", "patches": "failed", "detections": "skipped", "forecasts": "ok",
                    "zone_features": "skipped", "alerts": "ok", "ml_forecasts": "skipped"}
    assert R.committed(spark, str(tmp_path), "patches") is None and R.committed(spark, str(tmp_path), "forecasts").count() == 25


def test_a_second_run_within_the_cooldown_alerts_nobody(spark, inputs, tmp_path):
    out, stops = str(tmp_path), inputs.stops.withColumn("area", F.lit(50.0))
    many = dataclasses.replace(inputs, stops=stops, subscribers=inputs.subscribers.withColumn("last_alerted", F.lit(None).cast("timestamp")))
    at = lambda: {r["run_at"].isoformat(sep=" "): r["count"] for r in R.committed(spark, out, "alerts").groupBy("run_at").count().collect()}
    R.run_once(spark, many, FIRST, out, stages=FEW)
    sent = at()
    assert list(sent) == [FIRST] and sent[FIRST] > 50
    R.run_once(spark, many, SOON, out, stages=FEW)
    assert at() == sent
    R.run_once(spark, many, LATER, out, stages=FEW)
    assert at() == sent | {LATER: sent[FIRST]}


def test_a_run_that_dies_before_its_commit_is_not_read(spark, inputs, tmp_path, monkeypatch):
    out = str(tmp_path)
    with monkeypatch.context() as m:
        m.setattr(R, "log", None)  # the failure handler itself breaks: the attempt ends without a commit
        with pytest.raises(AttributeError):
            R.run_once(spark, inputs, FIRST, out, stages=failing("alerts", FEW))
    assert (tmp_path / "runs").exists() and R.committed(spark, out, "forecasts") is None
    assert set(R.run_once(spark, inputs, FIRST, out, stages=FEW).values()) == {"ok"}
    assert R.committed(spark, out, "forecasts").count() == 25
