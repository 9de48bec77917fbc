"""Chains of kept times, numbered blocks, connected groups and interpolation against brute force."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens.operators import alerts as A
from tidelens.operators import grid as GR
from tidelens.operators import timejoin as TJ


def walk(times, wait):
    kept = []
    for t in sorted(set(times)):
        if not kept or t - kept[-1] >= wait:
            kept.append(t)
    return kept


@pytest.mark.parametrize("wait", [1, 7, 40, 5000])
def test_chain_equals_a_walk_per_key(spark, wait):
    rng = random.Random(wait)
    rows = [("hot", rng.randrange(3000)) for _ in range(1500)] + [(f"k{i % 9}", rng.randrange(400)) for i in range(120)]
    rows += [(None, t) for t in (5, 5, 12, 80)] + [("once", 3), ("ties", 4), ("ties", 4), ("far", -10**12), ("far", 10**12)]
    got = {}
    for r in TJ.chain(spark.createDataFrame(rows, "k string, t long").repartition(4), ["k"], wait).collect():
        got.setdefault(r["k"], []).append(r["t"])
    assert {k: sorted(v) for k, v in got.items()} == {k: walk([t for kk, t in rows if kk == k], wait) for k, _ in rows}


def test_next_times_look_across_partitions(spark):
    times = [3 * i for i in range(200)]
    df = spark.createDataFrame([("a", t) for t in times] + [("b", t) for t in times[:50]], "k string, t long").repartition(8)
    for r in TJ.next_times(df, ["k"], 10).collect():
        have = times if r["k"] == "a" else times[:50]
        assert r["nxt"] == min((t for t in have if t >= r["t"] + 10), default=None)


def test_empty_chain_and_chunks(spark):
    none = spark.createDataFrame([], "run_at timestamp")
    assert TJ.thin_runs(none, "run_at", 3).count() == 0
    assert TJ.chunk_runs(none, "run_at", 3).count() == 0
    assert TJ.time_blocks(none, "run_at", 3).count() == 0


def test_chunks_equal_a_walk(spark):
    rng = random.Random(4)
    secs = sorted(rng.sample(range(0, 40 * 86400, 600), 300))
    df = spark.createDataFrame([(s,) for s in secs], "s long").select(F.timestamp_seconds("s").alias("run_at"))
    starts = walk(secs, 3 * 86400 + 1)
    want = {s: max(i for i, b in enumerate(starts, 1) if b <= s) for s in secs}
    got = TJ.chunk_runs(df, "run_at", 3).select(F.unix_seconds("run_at").alias("s"), "group_no").collect()
    assert len(got) == len(secs) and {r["s"]: r["group_no"] for r in got} == want


def test_cooldown_of_a_busy_subscriber(spark):
    rng = random.Random(6)
    rows = [("busy" if i % 3 else "calm", rng.randrange(10**9)) for i in range(900)] + [("busy", None)]
    df = spark.createDataFrame(rows, "who string, us long").select("who", F.timestamp_micros("us").alias("ts"))
    got = A.first_of_cooldown(df, ["who"], "ts", 0.01).select("who", F.unix_micros("ts").alias("us")).collect()
    for who in ("busy", "calm"):
        assert sorted(r["us"] for r in got if r["who"] == who) == walk([t for w, t in rows if w == who and t is not None], 36_000_000)


@pytest.mark.parametrize("count", [2, 4, 5, 11, 12])
def test_blocks_differ_by_one_at_most_and_longer_ones_come_first(spark, count):
    df = spark.createDataFrame([(i, d) for i in range(count) for d in (0, 1)], "i int, d int")
    df = df.select(F.timestamp_seconds(F.col("i") * 60).alias("ts"))
    got = [r["runs"] for r in TJ.time_blocks(df, "ts", 4).orderBy("block").collect()]
    assert got == [n for n in (count // 4 + (b < count % 4) for b in range(4)) if n]


@pytest.mark.parametrize("share", [0.1, 0.35, 0.5, 0.9])
def test_groups_of_a_tile_equal_flood_fill(share):
    rng = np.random.default_rng(int(share * 100))
    cells = np.argwhere(rng.random((40, 31)) < share) - (7, 12)
    cells = cells[rng.permutation(len(cells))]
    todo, home = {tuple(c) for c in cells.tolist()}, {}
    for start in sorted(todo):
        stack = [] if start in home else [start]
        while stack:
            at = stack.pop()
            if at in todo and at not in home:
                home[at] = start
                stack += [(at[0] + a, at[1] + b) for a in (-1, 0, 1) for b in (-1, 0, 1)]
    r, c = GR.group_numbers(cells[:, 0], cells[:, 1])
    assert [home[tuple(x)] for x in cells.tolist()] == list(zip(r.tolist(), c.tolist()))


def test_a_long_chain_of_groups_takes_few_rounds(spark, monkeypatch):
    rounds = []
    real = GR.durable_checkpoint
    monkeypatch.setattr(GR, "durable_checkpoint", lambda df: rounds.append(1) or real(df))
    n = 3000
    names = list(range(n))
    random.Random(2).shuffle(names)
    for order in (list(range(n)), names):
        rounds.clear()
        edges = spark.createDataFrame(list(zip(order[:-1], order[1:])) + [(n + 1, n + 2), (n + 5, n + 5)], "a long, b long")
        got = {r["node"]: r["root"] for r in GR.connect(edges).collect()}
        assert got == {**{i: 0 for i in range(n)}, n + 1: n + 1, n + 2: n + 1}
        assert len(rounds) <= 2 + 2 * math.log2(n)


def test_a_snake_through_many_tiles_is_one_group(spark):
    snake = [(r, c) for r in range(0, 40, 2) for c in range(40)]
    snake += [(r, 39 if r % 4 == 1 else 0) for r in range(1, 39, 2)]
    rows = [(1, r, c) for r, c in snake] + [(2, r, c) for r, c in snake if r % 2 == 0]
    got = GR.components(spark.createDataFrame(rows, "g int, row int, col int"), ["g"], tile=2).groupBy("g").agg(
        F.countDistinct("label").alias("n"), F.count("*").alias("cells")).collect()
    assert {r["g"]: (r["n"], r["cells"]) for r in got} == {1: (1, len(snake)), 2: (20, 800)}


@pytest.mark.parametrize("clamp", [True, False])
def test_interpolation_equals_eight_weighted_corners(spark, clamp):
    rng = random.Random(8)
    axes = {"t": (0.0, 3.0, 4), "lat": (10.0, 0.5, 5), "lon": (-60.0, 0.25, 3)}
    node = {(a, b, c): rng.choice([rng.random(), rng.random(), float("nan"), None])
            for a in range(4) for b in range(5) for c in range(3) if rng.random() < 0.9}
    points = [(i, rng.uniform(-2, 14), rng.uniform(9.6, 12.4), rng.uniform(-60.2, -59.3)) for i in range(300)]
    points += [(900, 9.0, 12.0, -59.5), (901, 0.0, 10.0, -60.0)]

    def value(t, lat, lon):
        total, parts = 0.0, []
        for x, (first, step, count), hold in zip((t, lat, lon), axes.values(), (True, clamp, clamp)):
            x = (x - first) / step
            if hold:
                x = min(max(x, 0.0), count - 1)
            elif x < 0 or x > count - 1:
                return 0.0
            base = min(math.floor(x), count - 2)
            parts.append((base, x - base))
        for a in (0, 1):
            for b in (0, 1):
                for c in (0, 1):
                    v = node.get((parts[0][0] + a, parts[1][0] + b, parts[2][0] + c))
                    w = math.prod(f if on else 1 - f for (_, f), on in zip(parts, (a, b, c)))
                    total += 0.0 if v is None or math.isnan(v) else w * v
        return total

    field = spark.createDataFrame([(*k, v, v) for k, v in node.items()], "t_idx int, row int, col int, u double, v double")
    df = spark.createDataFrame(points, "id int, t double, lat double, lon double")
    got = {r["id"]: r["u"] for r in GR.interpolate(df, field, axes, ["id"], clamp).collect()}
    assert got == pytest.approx({i: value(t, y, x) for i, t, y, x in points}, abs=1e-12)
