"""All tuning settings from one running sum, against one forecast per setting."""

import pytest
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import risk as R
from tidelens.operators import ensemble as E
from tidelens.plans import tuning as TU

FIELDS, SCALES = ["area", "covered"], [0.02, 0.1, 1.0]


def test_levels_of_every_setting_equal_its_own_forecast(spark, views):
    stops = views.stops.unionByName(views.stops.limit(20).withColumn("hour", F.lit(None).cast("int")))
    rows = TU.setting_levels(stops, ["run", "zone"], FIELDS, SCALES).collect()
    got = {(r["run"], r["zone"], h, i): r[f"lv_{h}"][i] for r in rows for h in S.HORIZONS for i in range(6)}
    want = {}
    for i, (field, scale) in enumerate((f, x) for f in FIELDS for x in SCALES):
        one = E.summarise(stops.select("run", "zone", "member", "hour", F.col(field).alias("area")), ["run", "zone"], bands=S.ZONE_BANDS.scaled(scale))
        for r in one.select("run", "zone", F.explode("horizons").alias("h")).select("run", "zone", "h.horizon_hours", R.level_to_int(F.col("h.risk_level")).alias("lv")).collect():
            want[r["run"], r["zone"], r["horizon_hours"], i] = r["lv"]
    assert got == want and len(set(want.values())) > 1


def test_more_scales_shuffle_no_more_rows(spark, views):
    """The plan has the same exchanges for one scale and for six, and nothing is repeated before the levels are known."""
    plan = lambda scales: TU.setting_levels(views.stops, ["run", "zone"], FIELDS, scales)._jdf.queryExecution().executedPlan().toString()
    one, six = plan([1.0]), plan([0.1, 0.2, 0.5, 1.0, 2.0, 4.0])
    assert one.count("Exchange") == six.count("Exchange") > 0 and "Generate" not in six


@pytest.mark.parametrize("empty", ["stops", "labels"])
def test_empty_inputs_give_no_settings(spark, empty):
    stops = spark.createDataFrame([], "run_at timestamp, zone int, member int, hour int, area double")
    labels = spark.createDataFrame([], "ident int, day date, truth int")
    assert TU.tune(stops, labels, ["area"], [1.0]).collect() == []
