"""Softmax boosting: its first split against a search of every cut, separable classes, the registered query."""

import numpy as np

from tests.conftest import SMALL
from tidelens.plans import boost as B
from tidelens.suite import all_queries


def test_first_split_equals_a_search_of_every_cut():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (120, 4)).astype(float)
    y = ((x[:, 2] > 11) | (x[:, 0] > 17)).astype(int) + (rng.random(120) < 0.1)
    model = B.fit(x, y, 3, 1, 1, 0.1, 1.0, 4, 0)
    truth = np.eye(3)[y]
    for k in range(3):
        p = truth[:, k].mean()
        g, h = truth[:, k] - p, np.full(120, p * (1 - p))
        best = {}
        for f in range(4):
            for c in np.unique(x[:, f])[:-1]:
                left = x[:, f] <= c
                if 4 <= left.sum() <= 116:
                    best[f, c] = sum(g[m].sum() ** 2 / (h[m].sum() + B.RIDGE) for m in (left, ~left))
        top = max(best.values())
        f, c = int(model.feature[0, k, 0]), float(model.cut[0, k, 0])
        assert abs(best[f, c] - top) < 1e-9
        left = x[:, f] <= c
        want = [0.1 * 2 / 3 * g[m].sum() / h[m].sum() for m in (left, ~left)]
        assert np.allclose(model.value[0, k], want) and np.allclose(model.margins(x)[:, k], model.start[k] + np.where(left, *want))


def test_separable_classes_are_learnt_and_probabilities_sum_to_one():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 5))
    y = (x[:, 0] > 0) + 2 * (x[:, 3] > 0.4)
    model = B.fit(x[:600], y[:600], 4, 60, 3, 0.1, 0.8, 4, 42)
    p = model.probabilities(x[600:])
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == y[600:]).mean() > 0.97
    assert B.fit(x[:600], y[:600], 4, 3, 3, 0.1, 0.8, 4, 42).value.tobytes() == B.fit(x[:600], y[:600], 4, 3, 3, 0.1, 0.8, 4, 42).value.tobytes()
    assert model.probabilities(x[:0]).shape == (0, 4)


def test_sigmoid_finds_the_curve():
    rng = np.random.default_rng(2)
    z = rng.normal(size=20_000)
    a, b = B.fit_sigmoid(z, (rng.random(20_000) < 1 / (1 + np.exp(-(1.5 * z - 0.5)))).astype(float))
    assert abs(a - 1.5) < 0.1 and abs(b + 0.5) < 0.1


def test_the_registered_models_beat_the_majority(spark):
    for name in ("mle_01_03_classifier_probabilities", "mle_02_calibrated_probabilities"):
        rows = all_queries()[name].run(spark, SMALL).collect()
        truth = [r["truth"] for r in rows]
        assert len(rows) > 100 and all(r["pred"] in range(4) and 0.25 <= r["confidence"] <= 1 for r in rows)
        most = max(truth.count(k) for k in set(truth))
        assert sum(r["pred"] == r["truth"] for r in rows) > most and len({r["pred"] for r in rows}) > 1
        if "probs" in rows[0]:
            assert all(abs(sum(r["probs"]) - 1) < 3e-4 and r["pred"] == r["probs"].index(max(r["probs"])) for r in rows)
