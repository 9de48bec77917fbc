"""Steps whose cost must follow the rows: plans without repeated frames, results of the bounded searches against brute force."""

import datetime as dt
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tests.test_planted import day, hav
from tidelens.operators import ensemble as E
from tidelens.operators import grid as GR
from tidelens.operators import spatial as SP
from tidelens.operators import timejoin as TJ
from tidelens.operators.cover import shape_cover
from tidelens.sources import payloads as P


def plan_of(df):
    return df._jdf.queryExecution().toString().lower()


# ---- F8: as-of join --------------------------------------------------------

def test_asof_sums_no_frame_anew_for_each_row(spark):
    start = day(0)
    at = lambda s: start + dt.timedelta(seconds=s)
    rng = random.Random(3)
    ls, rs = sorted(rng.sample(range(7000), 900)), sorted(rng.sample(range(7000), 300))  # one bucket of two hours
    left = spark.createDataFrame([(1, at(s)) for s in ls], "k int, t timestamp")
    right = spark.createDataFrame([(1, at(s)) for s in rs], "k int, s timestamp")
    got = TJ.asof_join(left, right, ["k"], "t", "s", 2)
    assert "unboundedfollowing" not in plan_of(got)
    assert {(r["t"], r["s"]) for r in got.collect()} == {(at(s), at(min((abs(s - r), r) for r in rs)[1])) for s in ls}


# ---- F2, F1: distance at which a running weight reaches a bar ---------------

def scattered(spark, n, seed, keys=3):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(keys) if i % 11 else None, 18 + rng.random() ** 2, -70 + rng.random() ** 2, rng.random()) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, run int, lat double, lon double, area_km2 double")


def test_crossing_equals_brute_force_and_reads_no_whole_radius(spark, monkeypatch):
    rows, points = scattered(spark, 1500, 1)
    places = [(i, 18.0 + 0.013 * i, -69.9 + 0.011 * i) for i in range(60)] + [(3, 18.2, -69.5), (99, 40.0, 10.0)]
    targets = spark.createDataFrame(places, "b int, p_lat double, p_lon double")
    tried, join = [], SP.radius_join
    monkeypatch.setattr(SP, "radius_join", lambda a, b, km, *x, **y: tried.append((km, b.count())) or join(a, b, km, *x, **y))
    got = {r["b"]: (r["near_id"], r["cross_km"]) for r in SP.crossing(points, targets, "b", 40.0, "area_km2", 5.0, "id").collect()}
    want = {}
    for b in {p[0] for p in places}:
        near = sorted((d, i, w) for i, _, la, lo, w in rows for _, y, x in [p for p in places if p[0] == b] if (d := hav(la, lo, y, x)) <= 40)
        total, cross = 0.0, None
        for d, _, w in near:
            total += w
            cross = d if cross is None and total >= 5.0 else cross
        if near:
            want[b] = (near[0][1], cross)
    assert {b: i for b, (i, _) in got.items()} == {b: i for b, (i, _) in want.items()}
    assert all(got[b][1] == pytest.approx(want[b][1]) for b in want)
    assert dict(tried).get(40.0, 0) < len(places) / 2


def test_beach_state_sums_pairs_where_they_meet(spark, monkeypatch):
    rows, masses = scattered(spark, 600, 2)
    beaches = spark.createDataFrame([(i, 18.0 + 0.04 * i, -69.9 + 0.03 * i) for i in range(20)], "b int, latitude double, longitude double")
    kept, keep = [], E.durable_checkpoint
    monkeypatch.setattr(E, "durable_checkpoint", lambda df, *x: kept.append(plan_of(df)) or keep(df, *x))
    got = {(r["run"], r["b"]): r for r in E.beach_state(masses, beaches, ["run"], "b", "id").collect()}
    assert kept and all("sortaggregate" not in p for p in kept)  # no pair is sorted or shuffled for the weighted area
    want = {}
    for i, run, la, lo, w in rows:
        for b in range(20):
            d = hav(la, lo, 18.0 + 0.04 * b, -69.9 + 0.03 * b)
            if d <= 25:
                want.setdefault((run, b), []).append((d, i, w * (1 - d / 25) ** 2))
    assert set(got) == set(want)
    for k, near in want.items():
        total, cross = 0.0, None
        for d, _, w in sorted(near):
            total += w
            cross = d if cross is None and total >= 3.0 else cross
        assert got[k]["weighted_km2"] == pytest.approx(total) and got[k]["nearest_id"] == min(near)[1]
        assert got[k]["significant_km"] == (None if cross is None or k[0] is None else pytest.approx(cross))


# ---- F4: hours until a mass arrives ----------------------------------------

def test_beach_eta_walks_each_mass_once_and_meets_no_beach_beyond_arrival(spark, monkeypatch):
    masses = spark.createDataFrame([(18.5, -68.5, 1.0), (18.5, -68.0, 0.1), (19.0, -69.0, 2.0)], "lat double, lon double, area_km2 double")
    beaches = spark.createDataFrame([(1, 18.5, -68.52), (2, 18.5, -68.9), (3, 18.5, -67.0), (4, 19.05, -69.4), (5, 10.0, -60.0)], "b int, latitude double, longitude double")
    tried, join = [], E.radius_join
    monkeypatch.setattr(E, "radius_join", lambda a, b, km, *x, **y: tried.append(km) or join(a, b, km, *x, **y))
    got = {r["b"]: r["eta_hours"] for r in E.beach_eta(masses, beaches, [], "b", F.lit(-5.0), F.lit(1.0)).collect()}
    assert got[1] == 0 and 0 < got[2] <= 72 and 0 < got[4] <= 72 and not {3, 5} & set(got)
    assert tried and max(tried) == 12.0


# ---- F3: point in polygon --------------------------------------------------

def test_a_point_far_from_a_shape_meets_no_cell_of_it(spark):
    edges = [(1, 0.0, 0.0, 0.7, 0.1), (1, 0.7, 0.1, 0.5, 0.45), (1, 0.5, 0.45, 0.35, 0.22), (1, 0.35, 0.22, 0.0, 0.0)]
    cover = shape_cover(spark.createDataFrame(edges, "s int, x1 double, y1 double, x2 double, y2 double"), "s").collect()
    assert sum(4.0 ** (9 - r["level"]) for r in cover) < 0.35  # square degrees; the box has 0.315, one root alone had 1
    assert any(not r["edges"] for r in cover)


# ---- F16, F10, F15: species counts -----------------------------------------

def test_species_counts_parse_each_document_once(spark):
    body = '{"count": %s, "taxon": {"id": %s, "name": "%s", "preferred_common_name": "ave"}}'
    rows = [(1, body % (3, 7, "<i>Avis</i> rara")), (2, body % (0, 8, "Avis")), (3, body % (1, "null", "Avis")), (4, "no json"), (5, None)]
    raw = spark.createDataFrame(rows, "beach int, body string").repartition(2)
    got = P.species_counts(raw)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
    assert [(r["beach"], r["taxon_id"], r["name_es"]) for r in got.collect()] == [(1, 7, "Ave")]


# ---- F11, F12, F13, F14: small tiles share a call --------------------------

def many_grids(spark):
    rng = random.Random(9)
    cells = {(g, r, c): rng.random() for g in range(12) for r in range(3 + g % 4) for c in range(2 + g % 3 * 4)}
    return cells, spark.createDataFrame([(str(g) if g else None, r, c, x) for (g, r, c), x in cells.items()], "g string, row int, col int, filled double")


@pytest.mark.parametrize("rows", [7, 10000])  # tiles that go on in the next batch; many tiles in one
def test_tiles_of_many_shapes_in_one_call_equal_flat_windows(spark, rows):
    cells, df = many_grids(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    try:
        out = GR.local_median(df.where("g is not null"), ["g"], 5, tile=4)
        assert "flatmapgroupsinarrow" not in plan_of(out)
        got = {(int(r["g"]), r["row"], r["col"]): r["background"] for r in out.collect()}
        groups = GR.components(df.where("filled < 0.5"), ["g"], tile=2).collect()
        focal = {(int(r["g"] or 0), r["row"], r["col"]): r["background"] for r in
                 GR.focal_median(df.where("g is not null").unionByName(df.where("g = '3' and row = 1")), ["g"], "filled", 1).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    turn = lambda i, n: min(i % (2 * n), 2 * n - 1 - i % (2 * n))
    assert len(got) == len(focal) == sum(g > 0 for g, _, _ in cells)
    for (g, r, c), x in got.items():
        h, w = 3 + g % 4, 2 + g % 3 * 4
        assert x == statistics.median(cells[g, turn(r + a, h), turn(c + b, w)] for a in range(-2, 3) for b in range(-2, 3))
        near = [cells[k] for a in (-1, 0, 1) for b in (-1, 0, 1) if (k := (g, r + a, c + b)) in cells for _ in range(2 if g == 3 and k[1] == 1 else 1)]
        assert focal[g, r, c] == pytest.approx(statistics.median(near), abs=1e-12)
    label = {(int(r["g"] or 0), r["row"], r["col"]): r["label"] for r in groups}
    assert set(label) == {k for k, x in cells.items() if x < 0.5}
    for (g, r, c), x in label.items():
        assert not g or all(label.get((g, r + a, c + b), x) == x for a in (-1, 0, 1) for b in (-1, 0, 1))  # a null key joins no tiles
    names = {}
    for k, x in label.items():
        names.setdefault(x, set()).add(k)
    for group in names.values():  # connected: all of it is reached from one of its cells
        todo, met = [min(group)], {min(group)}
        while todo:
            g, r, c = todo.pop()
            step = {(g, r + a, c + b) for a in (-1, 0, 1) for b in (-1, 0, 1)} & group - met
            met |= step
            todo += step
        assert met == group


# ---- F9: counts in a radius without the pairs ------------------------------

@pytest.mark.parametrize("lat0,lon0", [(18.0, -70.0), (89.4, 0.0), (10.0, 179.6)])
def test_radius_counts_equal_every_pair(spark, monkeypatch, lat0, lon0):
    monkeypatch.setattr(SP, "_LIGHT", 1)
    rng = random.Random(4)
    turned = lambda x: (x + 180) % 360 - 180
    spot = lambda: (min(90.0, lat0 + rng.random() * 0.8), turned(lon0 + rng.random() * (360 if lat0 > 80 else 0.8)))
    points = [(rng.choice([1, 2, None]), *spot()) for _ in range(700)]
    points += points[:40]
    places = [(i % 50, *spot()) for i in range(60)]
    places += places[:5] + [(None, *spot()), (70, None, 1.0), (71, lat0, float("nan"))]
    want = {}
    for i, la, lo in places:
        if la is not None and lo == lo:
            for g, a, b in points:
                if (d := hav(a, b, la, lo)) <= 15:
                    n, near = want.get((g, i), (0, 99.0))
                    want[g, i] = n + 1, min(near, d)
    built = []
    real = SP.radius_join
    monkeypatch.setattr(SP, "radius_join", lambda *a, **k: built.append(real(*a, **k)) or built[-1])
    got = SP.radius_counts(spark.createDataFrame(points, "run int, lat double, lon double"),
                           spark.createDataFrame(places, "place int, p_lat double, p_lon double"), "place", 15.0, "run").collect()
    assert {(r["run"], r["place"]): r["n"] for r in got} == {k: n for k, (n, _) in want.items()}
    assert all(abs(r["near_km"] - want[r["run"], r["place"]][1]) < 1e-6 for r in got)
    assert sum(b.count() for b in built) < sum(n for n, _ in want.values()) or lat0 > 80
