"""Sums around places against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.operators import ensemble as E
from tidelens.operators import spatial as SP
from tidelens.operators.discs import arrived_near

STOP = "zone int, member int, hour double, area double, lat double, lon double"
BEACH = "beach_id int, latitude double, longitude double"


def some_stops(n, spread, seed, odd=False):
    rng = random.Random(seed)
    rows = [(rng.randrange(-1, 6), rng.randrange(24), float(rng.randrange(76)), rng.random() / 5, 18.0 + rng.random() * spread, -70.0 + rng.random() * spread)
            for _ in range(n)]
    if odd:
        gap = lambda i, v: rows.extend([tuple(v if j == i else x for j, x in enumerate(r)) for r in rng.sample(rows[:n], 40)])
        for i in range(1, 6):
            gap(i, None)
        gap(2, -3.0), gap(2, 5.5), gap(3, float("nan")), gap(3, float("inf")), gap(4, float("nan")), gap(5, float("nan"))
        rows += [(1, 99, 12.0, None, 18.0 + spread / 2, -70.0 + spread / 2), (1, 98, 70.0, None, 18.0 + spread / 2, -70.0 + spread / 2)]
    return rows


def some_beaches(n, spread, seed):
    rng = random.Random(seed)
    rows = [(i, 18.0 + rng.random() * spread, -70.0 + rng.random() * spread) for i in range(n)]
    twice, moved = rows[0], (rows[1][0], rows[1][1] + 0.01, rows[1][2])
    return rows + [twice, twice, moved, (n, None, -70.0), (n + 1, 18.0, float("nan")), (None, *rows[2][1:]), (n + 2, *rows[3][1:])]


def seen(df):
    fix = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((repr([fix(v) for v in r]) for r in df.collect()))


@pytest.mark.parametrize("n, spread, odd", [(3000, 0.5, True), (40000, 0.25, False), (300, 3.0, True)])
def test_arrived_near_is_all_pairs(spark, n, spread, odd):
    stops = spark.createDataFrame(some_stops(n, spread, n, odd), STOP)
    places = spark.createDataFrame(some_beaches(12, spread, n + 1), BEACH).where("beach_id < 12 and not isnan(longitude)").groupBy(
        F.col("latitude").alias("p_lat"), F.col("longitude").alias("p_lon")).agg(F.count("*").alias("times"))
    got = arrived_near(stops, places, 10.0, S.HORIZONS, 0.1, 5.0)
    near = SP.radius_join(stops, places, 10.0, planar=True)
    more = near.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).drop("_n")
    want = E.arrived_by_member(more, ["p_lat", "p_lon", "times"], S.HORIZONS, F.lit(0.1), F.lit(5.0))
    assert seen(got.select(want.columns)) == seen(want) and want.count() >= 5


def test_beach_summary_and_owner_without_pairs(spark, monkeypatch):
    """Beaches of one position must not meet stops as pairs; beaches listed twice, without id or at two positions keep their result."""
    stops = spark.createDataFrame(some_stops(2000, 0.4, 5, True), STOP)
    beaches = spark.createDataFrame(some_beaches(30, 0.4, 6), BEACH)
    near = E.stops_near(stops, beaches, "beach_id")
    want = E.summarise(near, ["beach_id"], bands=S.BEACH_BANDS).drop("horizons")
    counted = near.where("zone >= 0 and hour is not null").groupBy("beach_id", "zone").count()
    owner = counted.groupBy("beach_id").agg(F.min_by("zone", F.struct(-F.col("count"), F.col("zone"))).alias("zone"))
    want, owner = seen(want), seen(owner)
    paired = []
    whole = E.radius_join
    monkeypatch.setattr(E, "radius_join", lambda points, places, *a, **k: paired.append({r[0] for r in places.select("beach_id").collect()}) or whole(points, places, *a, **k))
    assert seen(E.beach_summary(stops, beaches, "beach_id").drop("horizons")) == want
    assert paired == [{1}]  # the one at two positions
    assert seen(E.majority_owner(stops, beaches, "beach_id")) == owner
