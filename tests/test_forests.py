"""A forest for each group, and tensor fits."""

import numpy as np
import pytest

from skeinworks.operators import dataset, forests
from skeinworks.operators import lines as L


def test_groups_with_contradicting_labels(spark):
    rng = np.random.default_rng(0)
    rows, truth = [], {}
    for s, (bundle, turned) in enumerate([("a", False), ("b", True), ("c", False)]):
        for k in range(400):
            p = rng.uniform(-10, 10, 3)
            side = int((p[0] + 0.5 * p[1] > 0) != turned) if bundle != "c" else int(p[2] > 3)
            truth[bundle, k] = side
            rows.append((s, bundle, k, *map(float, p), side if rng.random() < 0.5 else None, "kept"))
    rows += [(9, "none", 1, 0.0, 0.0, 0.0, None, "n"), (9, "one", 1, 0.0, 0.0, 0.0, 1, "o"), (0, "a", 5000, None, 0.0, 0.0, 1, "p")]
    df = spark.createDataFrame(rows, "subject int, bundle string, k int, x double, y double, z double, known int, note string")
    out = L.classify_endpoints(df, "known", "k")
    assert out.columns == [*df.columns, "side"]
    got = {(r["bundle"], r["k"]): r["side"] for r in out.collect()}
    assert len(got) == len(rows) and got["none", 1] is None and got["one", 1] == 1 and got["a", 5000] is None
    for bundle in "abc":
        hits = [got[key] == side for key, side in truth.items() if key[0] == bundle]
        assert np.mean(hits) > 0.93, bundle
    again = {(r["bundle"], r["k"]): r["side"] for r in L.classify_endpoints(df.repartition(7), "known", "k").collect()}
    assert again == got


def test_shares_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(forests, "SHARE", 10)
    df = spark.createDataFrame([(1, "a", k, float(k), 0.0, 0.0, int(k > 50)) for k in range(100)], "subject int, bundle string, k int, x double, y double, z double, known int")
    assert sum(r["side"] == r["known"] for r in L.classify_endpoints(df, "known", "k").collect()) >= 97


def test_splits():
    n, ones = np.zeros((2, 3, forests.BINS))
    n[:, :4], ones[:, :4] = 5, [[0, 0, 5, 5], [2, 3, 2, 3], [5, 0, 0, 5]]
    assert forests.best_split(n, ones, [0, 1]) == (0, 1) and forests.best_split(n, n, [0, 1, 2]) == (-1, 0)


@pytest.mark.parametrize("noise", [0.0, 0.05])
def test_weighted_tensors(spark, noise):
    rng = np.random.default_rng(4)
    g = rng.normal(size=(20, 3))
    g /= np.linalg.norm(g, axis=1, keepdims=True)
    gradients = [(0.0, 0.0, 0.0, 0.0)] * 2 + [(1.0, *map(float, v)) for v in g]
    x = np.column_stack([-np.array([r[0] for r in gradients]) * np.array([r[1 + i] * r[1 + j] for r in gradients]) * (1 if i == j else 2) for i in range(3) for j in range(i, 3)] + [np.ones(22)])
    beta = np.array([[1.5, 0.1, 0.0, 0.7, -0.1, 0.4, np.log(100)], [0.5, 0, 0, 0.5, 0, 0.5, np.log(3)]])
    signal = np.exp(beta @ x.T) * (1 + noise * rng.normal(size=(2, 22)))
    rows = [(v, k, float(signal[v, k])) for v in range(2) for k in range(22) if (v, k) != (1, 7)] + [(2, 0, 0.0), (2, 1, None)]
    got = {r["v"]: r for r in dataset.fit_tensor_weighted(spark.createDataFrame(rows, "v int, idx int, value double"), gradients, ["v"]).collect()}
    assert len(got) == 3
    for v in range(2):
        have = [k for k in range(22) if (v, k) != (1, 7)]
        y, xs = np.log(signal[v, have]), x[have]
        first = np.linalg.lstsq(xs, y, rcond=None)[0]
        w = np.exp(xs @ first)
        want = np.linalg.lstsq(xs * w[:, None], y * w, rcond=None)[0]
        assert np.allclose(got[v]["t"], want[:6], atol=1e-8) and np.isclose(got[v]["s0"], np.exp(want[6]))
        if not noise:
            assert np.allclose(want, beta[v], atol=1e-8)
