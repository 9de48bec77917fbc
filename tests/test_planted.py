"""Planted cases and brute-force checks of single operators."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelens import settings as S
from tidelens.functions import geo as G
from tidelens.functions import surf as U
from tidelens.operators import alerts as A
from tidelens.operators import catalog as C
from tidelens.operators import ensemble as E
from tidelens.operators import grid as GR
from tidelens.operators import keyed as K
from tidelens.operators import scoring as SC
from tidelens.operators import spatial as SP
from tidelens.operators import timejoin as TJ
from tidelens.operators.quantiles import first_crossing, group_median
from tidelens.plans import features as FT
from tidelens.plans import model as M
from tidelens.sources import tables as T

UTC = dt.timezone.utc


def day(n, h=0, m=0):
    return dt.datetime(2026, 6, 1, h, m) + dt.timedelta(days=n)


def hav(a, b, c, d):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * 6371 * math.asin(math.sqrt(h))


# ---- grids -----------------------------------------------------------------

def planted_grid(spark):
    rng = random.Random(3)
    rows = []
    for r in range(41):
        for c in range(40):
            v = -0.0015 + 0.00002 * c + rng.gauss(0, 0.00005)
            if 20 <= r <= 22 and 20 <= c <= 23:
                v += 0.003
            if (r, c) == (15, 33):
                v = 0.003
            if (r, c) == (30, 5):
                v = 0.004
            if 5 <= r <= 14 and 30 <= c <= 37:
                v = None
            rows.append((1, r, c, v))
    return spark.createDataFrame(rows, "day int, row int, col int, value double")


def test_planted_patch_is_the_only_thing_flagged(spark):
    flags = GR.flag_cells(planted_grid(spark), ["day"])
    hit = {(r["row"], r["col"]) for r in flags.where("flagged").collect()}
    assert hit == {(r, c) for r in (20, 21, 22) for c in (20, 21, 22, 23)}
    cells = flags.where("flagged")
    lab = GR.components(cells.select("day", "row", "col"), ["day"], tile=8)
    lat = F.lit(18.0) + F.col("row") * 0.015
    got = GR.cluster_stats(cells.join(lab, ["day", "row", "col"]).select(
        "day", "label", "anomaly", lat.alias("lat"), (F.lit(-69.0) + F.col("col") * 0.015).alias("lon"),
        F.lit(0.015).alias("dlat"), F.lit(0.015).alias("dlon"), F.col("day").alias("day_used")), ["day"]).collect()
    assert len(got) == 1 and got[0]["n_cells"] == 12 and 0.3 < got[0]["area_km2"] < 3


@pytest.mark.parametrize("window,tile", [(21, 7), (5, 4)])
def test_local_median_across_tiles_equals_whole_grid(spark, window, tile):
    rng = np.random.default_rng(1)
    board = rng.normal(size=(23, 31))
    df = spark.createDataFrame([(1, int(r), int(c), float(board[r, c])) for r in range(23) for c in range(31)],
                               "g int, row int, col int, filled double")
    got = {(r["row"], r["col"]): r["background"] for r in GR.local_median(df, ["g"], window, tile=tile).collect()}
    rad = window // 2
    padded = np.pad(board, rad, mode="symmetric")
    for r in range(23):
        for c in range(31):
            assert got[r, c] == pytest.approx(np.median(padded[r:r + window, c:c + window]), abs=1e-12)


def test_components_across_tiles_equal_flood_fill(spark):
    rng = random.Random(5)
    cells = {(r, c) for r in range(40) for c in range(40) if rng.random() < 0.36}
    df = spark.createDataFrame([(1, r, c) for r, c in cells], "g int, row int, col int")
    groups = {}
    for r in GR.components(df, ["g"], tile=6).collect():
        groups.setdefault(r["label"], set()).add((r["row"], r["col"]))
    todo, want = set(cells), []
    while todo:
        stack, comp = [todo.pop()], set()
        while stack:
            p = stack.pop()
            comp.add(p)
            for a in (-1, 0, 1):
                for b in (-1, 0, 1):
                    q = (p[0] + a, p[1] + b)
                    if q in todo:
                        todo.remove(q)
                        stack.append(q)
        want.append(frozenset(comp))
    assert {frozenset(g) for g in groups.values()} == set(want)


def test_latest_clear_keeps_the_earlier_day_under_cloud(spark):
    df = spark.createDataFrame([(1, 0, 0, True, 0.5, True), (2, 0, 0, False, 0.0, False), (1, 0, 1, False, 0.0, False), (2, 0, 1, False, 0.0, False)],
                               "day int, row int, col int, flagged boolean, anomaly double, clear boolean").withColumn("g", F.lit(1))
    got = {r["col"]: (r["flagged"], r["day_used"]) for r in GR.latest_clear(df, ["g"], "day").collect()}
    assert got == {0: (True, 1), 1: (False, None)}


def test_hull_of_a_block(spark):
    df = spark.createDataFrame([(1, 0.0 + r, 0.0 + c, 1.0, 1.0) for r in range(3) for c in range(2)], "label int, lat double, lon double, dlat double, dlon double")
    row = SP.hull_area_points(df, ["label"]).first()
    assert row["vertices"] == 4 and row["geom_wkt"].startswith("POLYGON((-0.5 -0.5")


# ---- distances -------------------------------------------------------------

def test_radius_join_equals_brute_force_everywhere(spark):
    rng = random.Random(2)
    around = [(0, 0), (45, 10), (60, 179.9), (-60, -179.9), (89.9, 0), (-89.95, 120), (18.5, -69.9)]
    near = lambda: (lambda c: (max(-90.0, min(90.0, c[0] + rng.uniform(-0.4, 0.4))), (c[1] + rng.uniform(-0.9, 0.9) + 180) % 360 - 180))(rng.choice(around))
    pts = [(i, 18.5, -69.9) if i % 3 == 0 else (i, *near()) for i in range(400)] + [(900, None, 1.0), (901, 60.0, None)]
    pls = [(j, *near()) for j in range(120)] + [(990, 18.51, -69.9), (991, 90.0, 5.0), (992, 0.0, 180.0)]
    a = spark.createDataFrame(pts, "id int, lat double, lon double")
    b = spark.createDataFrame(pls, "pid int, p_lat double, p_lon double")
    for km in (25.0, 300.0, 9000.0, 21000.0):
        got = sorted((r["id"], r["pid"]) for r in SP.radius_join(a, b, km).collect())
        want = sorted((i, j) for i, la, lo in pts if la is not None and lo is not None for j, pa, po in pls if hav(la, lo, pa, po) <= km)
        assert got == want and len(got) > 100


def test_fine_cells_meet_the_same_pairs_and_far_fewer_in_vain(spark):
    rng = random.Random(12)
    pts = [(i, rng.choice([18.5, 59.9, 89.8, -0.1]) + rng.uniform(-0.2, 0.2), (rng.choice([-70.0, 179.9]) + rng.uniform(-0.5, 0.5) + 180) % 360 - 180) for i in range(400)]
    pls = [(j, la, lo) for j, la, lo in pts[:120]] + [(990, 90.0, 5.0), (991, -90.0, 0.0), (992, 18.5, 180.0)]
    a = spark.createDataFrame(pts + [(-1, None, 0.0)], "id int, lat double, lon double")
    b = spark.createDataFrame(pls + [(-1, 0.0, None)], "pid int, p_lat double, p_lon double")
    for fine, km in ((1, 25.0), (2, 25.0), (3, 25.0), (2, 9000.0), (3, 21000.0)):
        got = sorted((r["id"], r["pid"], round(r["dist"], 6)) for r in SP.radius_join(a, b, km, fine=fine).collect())
        assert got == sorted((i, j, round(d, 6)) for i, la, lo in pts for j, pa, po in pls if (d := hav(la, lo, pa, po)) <= km)
    plan = SP.pair_distances(a, b, 25.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "array_distinct" not in plan  # cells are dealt out by plain expressions


def test_close_distances_are_the_haversine(spark):
    rng = random.Random(14)
    rows = [(rng.choice([0.0, 18.5, 59.9, 89.99, -90.0]), rng.choice([-70.0, 179.99, 0.0])) for _ in range(600)]
    rows = [(la, lo, max(-90.0, min(90.0, la + rng.choice([0, 1e-12, 1e-7, 1e-3, 0.1, 2.2, 2.4, 50]) * rng.uniform(-1, 1))), lo + rng.choice([0, 1e-12, 1e-7, 1e-3, 0.1, 2.2, 2.4, 200, -359.99]) * rng.uniform(0, 1)) for la, lo in rows]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    at = [F.col(x) for x in "abcd"]
    cosines = (F.cos(F.radians("a")), F.cos(F.radians("c")))
    got = df.select(G.haversine_km(*at).alias("want"), G.close_km(*at, cosines).alias("got")).collect()
    assert all(abs(r["got"] - r["want"]) <= 4e-15 * r["want"] and (r["got"] == 0) == (r["want"] == 0) for r in got)
    assert sum(r["want"] == 0 for r in got) > 5 and sum(r["want"] > 1000 for r in got) > 50


@pytest.mark.parametrize("km", [0.001, 25.0, 260.0])
def test_pairs_at_the_edge_of_the_radius_are_measured(spark, km):
    """Pairs a few parts in a thousand and in a million around the radius, also over the poles and at 180 degrees."""
    rng = random.Random(15)
    pts, pls = [], []
    for i in range(300):
        la, lo, turn = rng.choice([0.0, 18.5, -60.0, 85.0, 89.7, -89.9]), rng.choice([-70.0, 179.999, -179.999]), rng.uniform(0, 2 * math.pi)
        d = math.degrees(km * (1 + rng.choice([0, 1e-3, 1e-4, 1e-6, 1e-10]) * rng.choice([-1, 1])) / S.EARTH_KM)
        pts.append((i, la, lo))
        pls.append((i, max(-90.0, min(90.0, la + d * math.sin(turn))), (lo + d * math.cos(turn) / math.cos(math.radians(la)) + 180) % 360 - 180))
    a, b = spark.createDataFrame(pts, "id int, lat double, lon double"), spark.createDataFrame(pls, "pid int, p_lat double, p_lon double")
    found = SP.pair_distances(a, b, km)
    want = {(i, j) for i, la, lo in pts for j, pa, po in pls if hav(la, lo, pa, po) <= km + 1e-11}
    sure = {(i, j) for i, la, lo in pts for j, pa, po in pls if hav(la, lo, pa, po) <= km - 1e-11}
    got = [(r["id"], r["pid"]) for r in found.collect()]
    assert len(got) == len(set(got)) and sure <= set(got) <= want


def test_pairs_carry_one_number_a_side_beside_the_cell(spark):
    a, b = spark.createDataFrame([(1, 18.5, -70.0)], "id int, lat double, lon double"), spark.createDataFrame([(2, 18.5, -70.0)], "pid int, p_lat double, p_lon double")
    plan = SP.pair_distances(a, b, 25.0)._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "Join":
        plan = plan.children().head()
    assert plan.left().output().size() <= 6 and plan.right().output().size() <= 6
    named = SP.radius_join(a.withColumn("_a", F.lit(7)), b.withColumn("_b", F.lit(8)), 25.0)
    assert [(r["_a"], r["_b"], r["dist"]) for r in named.collect()] == [(7, 8, 0.0)]


def test_rounded_is_round(spark):
    rng = random.Random(13)
    values = [rng.uniform(-30, 30) for _ in range(3000)] + [k / 2e4 for k in range(-400, 400)] + [k / 2e4 + e for k in range(1, 400, 2) for e in (-1e-12, 1e-12)]
    values += [0.0, -0.0, -1e-9, 1e300, -1e300, 123456789.12345, 1e12 + 0.00005, float("nan"), float("inf"), float("-inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (4, 6):
        rows = df.select("v", F.round("v", digits).alias("want"), G.rounded(F.col("v"), digits).alias("got")).collect()
        assert all(repr(r["want"]) == repr(r["got"]) for r in rows)


def test_nearest_equals_brute_force_and_ties_take_the_lowest_id(spark):
    rng = random.Random(4)
    spot = lambda: (rng.uniform(-90, 90), rng.uniform(-180, 180))
    pts = [(i, *spot()) for i in range(200)] + [(i, 18 + rng.random(), -70 + rng.random()) for i in range(200, 300)] + [(500, -40.0, 100.0), (501, 90.0, 180.0)]
    pls = [(1, -40.0, 101.0), (0, -40.0, 99.0), (2, -40.0, 99.0)] + [(j, *spot()) for j in range(10, 40)] + [(j, 18.5, -70 + j / 1000) for j in range(100, 3100)]
    a = spark.createDataFrame(pts + [(600, None, None)], "id int, lat double, lon double")
    z = spark.createDataFrame(pls, "zid int, zlat double, zlon double")
    got = {r["id"]: r["near"] for r in SP.nearest(a, z, "zid", ("zlat", "zlon")).collect()}
    assert got.pop(600) is None and len(got) == len(pts)
    for i, la, lo in pts:
        best = min((hav(la, lo, pa, po), j) for j, pa, po in pls)
        assert abs(got[i]["dist"] - best[0]) < 1e-6 and (i != 500 or got[i]["id"] == 0)


def test_zone_state_of_many_zones_equals_brute_force(spark):
    rng = random.Random(5)
    dets = [(f"2026-01-0{1 + i % 2} 00:00:00", 18 + rng.random() * 4, -72 + rng.random() * 6, rng.random()) for i in range(150)]
    zones = [(j, rng.uniform(10, 30), rng.uniform(-80, -55)) for j in range(2100)]
    d = spark.createDataFrame(dets, "run_at string, lat double, lon double, area_km2 double")
    z = spark.createDataFrame(zones, "zone_id int, center_lat double, center_lon double")
    got = {(r["run_at"], r["zone_id"]): r for r in SP.zone_state(d, z).collect()}
    assert len(got) == 4200
    for j, la, lo in zones[::20]:
        for run in {r for r, *_ in dets}:
            own = [(hav(a, b, la, lo), area) for r, a, b, area in dets if r == run]
            row = got[run, j]
            assert abs(row["nearest_km"] - min(own)[0]) < 1e-6 and row["patch_count"] == len(own)
            assert abs(row["zone_area_km2"] - sum(a for k, a in own if k <= 200)) < 1e-9


def test_match_within_radius_both_ways(spark):
    rng = random.Random(6)
    mk = lambda n: [(i, rng.uniform(18, 19), rng.uniform(-70, -69)) for i in range(n)]
    p, q = mk(80), mk(15)
    a, b = (spark.createDataFrame(x, "id int, lat double, lon double") for x in (p, q))
    got = {r["id"] for r in SP.within(a, b, 8.0, "id").collect()}
    assert got == {i for i, la, lo in p if any(hav(la, lo, c, d) <= 8 for _, c, d in q)}


def test_point_parser_reads_every_form(spark):
    hexed = "0101000020E6100000" + np.array([-68.37, 18.58]).tobytes().hex()
    texts = ['{"type":"Point","coordinates":[-68.37,18.58]}', "POINT(-68.37 18.58)", "SRID=4326;POINT(-68.37 18.58)", hexed, None, "LINESTRING(0 0, 1 1)", "x"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["p"] for r in df.select("i", G.parse_point(F.col("t"), with_hex=True).alias("p")).collect()}
    assert all((got[i]["lat"], got[i]["lon"]) == (18.58, -68.37) for i in range(4))
    assert all(got[i] is None for i in (4, 5, 6))


# ---- time ------------------------------------------------------------------

def test_asof_takes_the_earlier_row_on_ties_and_respects_the_tolerance(spark):
    left = spark.createDataFrame([(1, day(0, 12)), (1, day(9))], "k int, t timestamp")
    right = spark.createDataFrame([(1, day(0, 6), "a"), (1, day(0, 18), "b"), (2, day(0, 12), "c")], "k int, s timestamp, v string")
    got = TJ.asof_join(left, right, ["k"], "t", "s", 12, "left").collect()
    assert {(r["t"], r["v"]) for r in got} == {(day(0, 12), "a"), (day(9), None)}


def test_asof_equals_brute_force(spark):
    rng = random.Random(8)
    ls = [(rng.randrange(3), day(0) + dt.timedelta(minutes=rng.randrange(20000))) for _ in range(120)]
    rs = sorted({(rng.randrange(3), day(0) + dt.timedelta(minutes=rng.randrange(20000))) for _ in range(60)})
    left = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(ls)], "i int, k int, t timestamp")
    right = spark.createDataFrame(rs, "k int, s timestamp")
    got = {r["i"]: r["s"] for r in TJ.asof_join(left, right, ["k"], "t", "s", 5).collect()}
    want = {}
    for i, (k, t) in enumerate(ls):
        near = [(abs(s - t), s) for kk, s in rs if kk == k and abs(s - t) <= dt.timedelta(hours=5)]
        if near:
            want[i] = min(near)[1]
    assert got == want


def feature_table(spark, days=60):
    rows = []
    for z in (1, 2):
        for i in range(days * 4):
            rows.append((day(0) + dt.timedelta(hours=6 * i), z, 5.0 + i % 7, 1.0, 20.0, 3, (i // 40 + z) % 4))
    return spark.createDataFrame(rows, "run_at timestamp, zone_id int, eez_area_km2 double, zone_area_km2 double, nearest_km double, patch_count int, physics_risk int")


def zones(spark):
    return spark.createDataFrame([(1, "A", 18.5, -68.4), (2, "B", 19.8, -70.7)], "zone_id int, name string, center_lat double, center_lon double")


def test_label_is_the_risk_exactly_seven_days_later_and_the_split_is_purged(spark):
    f = feature_table(spark)
    rows = FT.training_rows(f, zones(spark))
    truth = {(r["zone_id"], r["run_at"]): r["physics_risk"] for r in f.collect()}
    for r in rows.where("lead_days = 7").collect():
        want = r["run_ts"] + dt.timedelta(days=7)
        while (r["zone_id"], want) not in truth:  # past the last run: the nearest one within 12 hours
            want -= dt.timedelta(hours=6)
        assert r["risk_int"] == truth[r["zone_id"], want]
    blocks = TJ.time_blocks(rows, "run_ts", 4)
    start = {b["block"]: b["start"] for b in blocks.collect()}
    split = TJ.purged_split(rows, blocks)
    assert all(r["m"] < start[r["block"]] for r in split.where("part = 'train'").groupBy("block").agg(F.max("target_ts").alias("m")).collect())


def test_walk_forward_reports_and_chooses(spark):
    out = M.walk_forward(FT.training_rows(feature_table(spark, 70), zones(spark)), n_folds=2, iterations=3, calibrate=False)
    assert {r["method"] for r in out["scores"].collect()} == {"model", "seasonal", "persistence", "majority"}
    assert all(0 <= r["brier"] <= 2 for r in out["brier"].collect())
    assert out["chosen"].first()["chosen"] in ("ml", "persistence", "seasonal")
    short = M.walk_forward(FT.training_rows(feature_table(spark, 9), zones(spark)), n_folds=2, iterations=2)
    assert short["scores"] is None and all(f["skipped"] for f in short["folds"])


def test_probabilities_cover_four_slots_and_one_class_is_constant(spark):
    rows = FT.training_rows(feature_table(spark), zones(spark))
    p = M.fit_classifier(rows, iterations=2).predict(rows).limit(50).collect()
    assert all(len(r["probs"]) == 4 and sum(r["probs"]) == pytest.approx(1) for r in p)
    one = M.fit_classifier(rows.withColumn("risk_int", F.lit(2)))
    assert {tuple(r["probs"]) for r in one.predict(rows).limit(5).collect()} == {(0.0, 0.0, 1.0, 0.0)}


def test_method_choice_needs_a_strict_gain(spark):
    def pick(model, persistence, seasonal):
        df = spark.createDataFrame([("model", model), ("persistence", persistence), ("seasonal", seasonal)], "method string, macro_f1 double")
        return SC.choose_method(df).first()["chosen"]
    assert [pick(0.26, 0.41, 0.17), pick(0.50, 0.41, 0.17), pick(0.10, 0.12, 0.17), pick(0.20, 0.20, 0.20)] == ["persistence", "ml", "seasonal", "seasonal"]


def test_brier_bounds(spark):
    df = spark.createDataFrame([("a", 0, [1.0, 0.0, 0.0, 0.0]), ("a", 3, [0.0, 0.0, 0.0, 1.0]), ("b", 0, [0.0, 0.0, 0.0, 1.0])], "m string, truth int, probs array<double>")
    assert {r["m"]: r["brier"] for r in SC.brier(df, ["m"]).collect()} == {"a": 0.0, "b": 2.0}


def test_runs_to_chunks_and_thinning(spark):
    runs = spark.createDataFrame([(day(n),) for n in (0, 3, 9, 11, 25)], "run_at timestamp")
    sizes = [r["count"] for r in TJ.chunk_runs(runs, "run_at", 10).groupBy("group_no").count().orderBy("group_no").collect()]
    assert sizes == [3, 1, 1]
    assert [r["run_at"] for r in TJ.thin_runs(runs, "run_at", 72).orderBy("run_at").collect()] == [day(0), day(3), day(9), day(25)]


# ---- medians and ensembles -------------------------------------------------

def test_medians_of_a_hot_group(spark):
    rng = random.Random(9)
    rows = [("hot" if i % 3 else f"k{i % 7}", rng.gauss(0, 10)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v double")
    for width in (None, 0.5):
        got = {r["k"]: r["m"] for r in group_median(df, ["k"], "v", "m", bin_width=width).collect()}
        low = {r["k"]: r["m"] for r in group_median(df, ["k"], "v", "m", low=True, bin_width=width).collect()}
        for k in got:
            vals = sorted(v for kk, v in rows if kk == k)
            assert got[k] == pytest.approx(np.median(vals)) and low[k] == vals[(len(vals) - 1) // 2]


def test_crossing_with_and_without_bins(spark):
    rng = random.Random(10)
    rows = [(i % 4, rng.uniform(0, 25), rng.uniform(0, 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, p double, w double")
    a, b = ({r["k"]: r["x"] for r in first_crossing(df, ["k"], "p", "w", 9.0, "x", bin_width=w).collect()} for w in (None, 0.25))
    assert a == b and len(a) == 4


def test_trace_gives_none_for_a_zone_and_low_for_a_beach(spark):
    stops = spark.createDataFrame([(1, m, 10.0, 0.2) for m in range(24)], "z int, member int, hour double, area double")
    zone = E.summarise(stops, ["z"]).first()
    beach = E.summarise(stops, ["z"], bands=S.BEACH_BANDS).first()
    assert (zone["risk_level"], zone["eta_hours"]) == ("none", None) and (beach["risk_level"], beach["eta_hours"]) == ("low", 10)
    assert [h["horizon_hours"] for h in zone["horizons"]] == [0, 24, 48, 72]


def test_absent_members_count_as_none_and_all_targets_appear(spark):
    stops = spark.createDataFrame([(1, 1, m, 5.0, 30.0) for m in range(6)], "run int, zone_id int, member int, hour double, area double")
    f = E.with_all_targets(E.summarise(stops, ["run", "zone_id"]), stops.select("run"), zones(spark), "run", "zone_id")
    got = {r["zone_id"]: (r["risk_level"], r["p_none"], r["p_high"]) for r in f.collect()}
    assert got == {1: ("none", 0.75, 0.25), 2: ("none", 1.0, 0.0)}


def test_track_position(spark):
    tr = [(0, 18.0, -69.0, 0.0), (24, 19.0, -70.0, 0.6)]
    df = spark.createDataFrame([(1, tr, 12), (2, tr, 500), (3, None, 5), (4, tr[:1], 9)], "i int, track array<struct<h:int,lat:double,lon:double,ashore:double>>, h int")
    got = {r["i"]: r["p"] for r in df.select("i", E.track_position(F.col("track"), F.col("h")).alias("p")).collect()}
    assert tuple(got[1]) == (18.5, -69.5, True) and tuple(got[2]) == (19.0, -70.0, True) and got[3] is None and tuple(got[4]) == (18.0, -69.0, False)


# ---- catalogue, limits, storage --------------------------------------------

def greedy(taxa, pinned, hidden):
    vis = {t[0]: t for t in taxa if t[0] not in hidden}
    pins = [vis[p] for p in dict.fromkeys(pinned) if p in vis]
    rest = sorted((t for t in vis.values() if t[0] not in {p[0] for p in pins}), key=lambda t: (2 if not t[5] else 0 if t[4] else 1, -t[3], t[1]))
    count, top, tail = {}, [], []
    for p in pins[:3]:
        count[p[2]] = count.get(p[2], 0) + 1
    for t in rest:
        if len(top) < max(0, 3 - len(pins)) and count.get(t[2], 0) < (1 if t[2] == "Plantae" else 2):
            count[t[2]] = count.get(t[2], 0) + 1
            top.append(t)
        else:
            tail.append(t)
    return [t[0] for t in pins + top + tail]


def test_species_ranking_equals_the_greedy_rule(spark):
    rng = random.Random(11)
    taxa, choices, want = [], [], {}
    for b in range(12):
        ts = [(i, f"n{i:02d}", rng.choice(["Plantae", "Aves", "Fish", None]), rng.randrange(1, 6), rng.random() < 0.5, rng.random() < 0.7) for i in range(14)]
        pin, hid = rng.sample(range(14), b % 5), rng.sample(range(14), 2)
        taxa += [(b, *t) for t in ts]
        choices.append((b, pin, hid))
        want[b] = greedy(ts, pin, hid)[:8]
    t = spark.createDataFrame(taxa, "beach int, taxon_id bigint, name string, `group` string, observation_count bigint, marine boolean, photo boolean")
    c = spark.createDataFrame(choices, "beach int, pinned array<bigint>, hidden array<bigint>")
    got = {}
    for r in C.rank_taxa(t, c, "beach").orderBy("beach", "rank").collect():
        got.setdefault(r["beach"], []).append(r["taxon_id"])
    assert got == want


def limiter(times, span, limit):
    live, ok = [], []
    for i, t in times:
        live = [x for x in live if t - x <= span]
        if len(live) < limit:
            live.append(t)
            ok.append(i)
    return ok


def request_rows():
    rng = random.Random(12)
    return sorted((rng.randrange(3), day(0) + dt.timedelta(seconds=rng.randrange(900)), i) for i in range(300))


def wanted_requests(rows):
    return {i for c in range(3) for i in limiter([(i, t.timestamp()) for k, t, i in rows if k == c], 60, 10)}


def test_limiter_counts_only_accepted_requests(spark):
    rows = request_rows()
    df = spark.createDataFrame(rows, "client int, ts timestamp, rid bigint")
    assert {r["rid"] for r in A.accepted_requests(df, "client", "ts", "rid").collect()} == wanted_requests(rows)


def test_upsert_rewrites_only_the_touched_partition(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (3, "c", 2)], "k int, v string, part int").write.partitionBy("part").parquet(path)
    new = spark.createDataFrame([(1, "x", 1, 1), (1, "y", 1, 2), (9, "z", 1, 1)], "k int, v string, part int, b int")
    T.upsert_partitions(spark, path, new, ["k"], ["b"], "part")
    got = {(r["k"], r["v"]) for r in spark.read.parquet(path).select("k", "v").collect()}
    assert got == {(1, "y"), (9, "z"), (2, "b"), (3, "c")}


def test_tolerant_read_and_writers(spark, tmp_path):
    spark.createDataFrame([(1, day(0), 2, "low")], "id bigint, run_at timestamp, zone_id int, risk_level string").write.parquet(str(tmp_path / "f"))
    row = T.read_table(spark, str(tmp_path / "f"), "forecasts").first()
    assert row["risk_level"] == "low" and row["risk_probs"] is None
    df = spark.createDataFrame([(2, "b"), (1, "a")], "k int, v string")
    T.export_sorted(df, str(tmp_path / "e"), ["k"])
    T.write_metrics(df, str(tmp_path / "m"), as_json=True)
    assert spark.read.json(str(tmp_path / "e")).count() == spark.read.json(str(tmp_path / "m")).count() == 2


def test_period_score_rises_and_every_condition_rates(spark):
    df = spark.range(0, 20).select((F.col("id") * 0.8 + 2).alias("p"))
    vals = [r["s"] for r in df.orderBy("p").select(U.period_score(F.col("p")).alias("s")).collect()]
    assert vals == sorted(vals) and vals[0] == 0.4 and vals[-1] == 1.0


def test_accents_of_any_letter_fold(spark):
    from tidelens.functions import text as X

    df = spark.createDataFrame([("Cafe\u0301  B\u00e1varo",), ("\u0160ibenik \u0100gia",), (None,), ("",), ("Pla\u0303ya \u1e0c\u0323",)], "t string")
    assert [r[0] for r in df.select(X.fold(F.col("t"))).collect()] == ["cafe bavaro", "sibenik agia", None, "", "playa d"]


def test_author_entities_decode_as_html_does(spark):
    import html

    from tidelens.functions import text as X

    refs = ["Jos&eacute;", "&#233;t&#xE9;", "&copy; A &middot; B", "a &amp;copy; b", "&notit; &ampx &bogus; & &#;", "&#x1F30A;&#8217;&#128;&#0;&#1;", "&#99999999999999; &#xD800; &NotEqualTilde;", "&#013;&#x09x", None]
    df = spark.createDataFrame(list(enumerate(refs)), "k int, t string")
    assert {r["k"]: r["d"] for r in df.select("k", X.decode_entities("t").alias("d")).collect()} == {k: t and html.unescape(t) for k, t in enumerate(refs)}
    cases = [("<b>Jos&eacute;</b> &#38; Co", "José & Co"), ("Ana<script>x", "Ana"), ("Ana<STYLE a='b'>x", "Ana"), ("Ana<script>x</script > B", "Ana B")]
    got = spark.createDataFrame(list(enumerate(c for c, _ in cases)), "k int, t string").select("k", X.parse_author(X.F.col("t")).alias("a")).collect()
    assert {r["k"]: r["a"] for r in got} == {k: w for k, (_, w) in enumerate(cases)}
