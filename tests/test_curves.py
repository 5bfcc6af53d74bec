"""Splines against dense solves, thinned lines against recursion."""

import numpy as np
import pytest

from skeinworks.operators import curves


def dense(t, y, w):
    """The same spline by full matrices."""
    n, h = len(t), np.diff(t)
    q, r = np.zeros((n, n - 2)), np.zeros((n - 2, n - 2))
    for j in range(n - 2):
        q[j, j], q[j + 1, j], q[j + 2, j] = 1 / h[j], -1 / h[j] - 1 / h[j + 1], 1 / h[j + 1]
        r[j, j] = (h[j] + h[j + 1]) / 3
        if j + 1 < n - 2:
            r[j, j + 1] = r[j + 1, j] = h[j + 1] / 6
    return np.linalg.solve(np.eye(n) + w * q @ np.linalg.inv(r) @ q.T, y)


@pytest.mark.parametrize("n", [3, 4, 5, 40])
def test_splines_equal_dense_solves(n):
    rng = np.random.default_rng(n)
    t = np.cumsum(rng.uniform(0.01, 1, (6, n)), axis=1)
    y, w = rng.normal(size=(6, n, 3)), 10.0 ** rng.uniform(-4, 2, 6)
    got = curves.fitted(t, y, w)
    for k in range(6):
        assert np.allclose(got[k], dense(t[k], y[k], w[k]), atol=1e-9)


def test_residual_ends_and_straight_lines():
    rng = np.random.default_rng(0)
    x = np.linspace(0, 30, 50)
    wavy = np.stack([x, 5 * np.sin(x / 4), x * 0], axis=1) + rng.normal(size=(4, 50, 3)) * 0.4
    out = curves.smoothed(wavy, 20.0)
    assert np.allclose(((out - wavy) ** 2).sum((1, 2)), 20.0, rtol=1e-4)
    rough = lambda p: (np.diff(p, 2, axis=1) ** 2).sum()
    assert rough(out) < 0.2 * rough(wavy) and np.abs(out[:, [0, -1]] - wavy[:, [0, -1]]).max() < 1.5
    line = np.stack([x, 2 * x, -x], axis=1)[None]
    assert np.allclose(curves.smoothed(line, 5.0), line) and np.allclose(curves.smoothed(wavy, 0.0), wavy)
    slack = curves.smoothed(wavy, 1e6)
    assert all(np.linalg.svd(p - p.mean(0))[1][1] < 0.05 for p in slack)  # as good as straight
    same = np.zeros((1, 5, 3))
    assert (curves.smoothed(same, 1.0) == same).all()
    twice = np.repeat(line[:, :6], 2, axis=1)
    assert np.isfinite(curves.smoothed(twice, 1.0)).all()


def recursion(p, tol):
    keep = {0, len(p) - 1}

    def go(a, b):
        if b - a < 2:
            return
        d, rel = p[b] - p[a], p[a + 1 : b] - p[a]
        t = np.clip(rel @ d / (d @ d), 0, 1) if d @ d > 0 else np.zeros(len(rel))
        far = np.linalg.norm(rel - t[:, None] * d, axis=1)
        k = int(far.argmax())
        if far[k] > tol:
            keep.add(a + 1 + k)
            go(a, a + 1 + k)
            go(a + 1 + k, b)

    go(0, len(p) - 1)
    return sorted(keep)


def test_thinned_lines_equal_recursion(spark):
    rng = np.random.default_rng(3)
    lines = [np.cumsum(rng.normal(size=(n, 3)), axis=0) for n in (1, 2, 3, 60, 200)] + [np.zeros((4, 3)), np.stack([np.arange(40.0)] * 3, axis=1)]
    counts = np.array([len(p) for p in lines])
    keep = curves.thinned(np.concatenate(lines), counts, 1.0, None)
    at = 0
    for p in lines:
        assert np.flatnonzero(keep[at : at + len(p)]).tolist() == recursion(p, 1.0) if len(p) > 1 else True
        at += len(p)
    far = curves.thinned(lines[-1], np.array([40]), 1.0, 10.0)
    kept = lines[-1][far]
    assert len(kept) > 2 and np.linalg.norm(np.diff(kept, axis=0), axis=1).max() <= 10
    rows = [(k, [tuple(map(float, q)) for q in p], "kept") for k, p in enumerate(lines)] + [(90, None, "n"), (91, [], "e"), (92, [(float("nan"), 0.0, 0.0), (1.0, 0.0, 0.0), (2.0, 0.0, 0.0)], "o")]
    df = spark.createDataFrame(rows, "line_id int, points array<struct<x:double,y:double,z:double>>, note string")
    thin = {r["line_id"]: r["points"] for r in curves.compress(df, 1.0).collect()}
    assert thin[90] is None and thin[91] == [] and len(thin[92]) == 3 and [len(thin[k]) for k in range(1, 7)] == [len(recursion(p, 1.0)) for p in lines[1:]]
    smooth = {r["line_id"]: r["points"] for r in curves.smooth_spline(df, 2.0).collect()}
    assert smooth[90] is None and smooth[91] == [] and [len(smooth[k]) for k in range(7)] == counts.tolist()
    assert np.allclose(np.array(smooth[3]), curves.smoothed(lines[3][None], 2.0)[0])


def test_resampled_lines(spark):
    rng = np.random.default_rng(7)
    lines = [np.cumsum(rng.normal(size=(n, 3)), axis=0) for n in (1, 2, 3, 30, 31, 400)] + [np.repeat(rng.normal(size=(5, 3)), 3, axis=0), np.zeros((4, 3))]
    counts = np.array([0, *(len(p) for p in lines), 0])
    n = np.array([5, 4, 7, 1, 50, 2, 33, 20, 3, 0])
    out, sizes = curves.evenly(np.concatenate(lines), counts, n)
    assert sizes.tolist() == [0, 4, 7, 1, 50, 2, 33, 20, 3, 0]
    at = 0
    for p, k in zip(lines, sizes[1:-1].tolist(), strict=True):
        s = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))])
        keep = np.append(True, np.diff(s) > 0)
        want = np.stack([np.interp(np.linspace(0, s[-1], k) if k > 1 else [0], s[keep], p[keep, c]) for c in range(3)], axis=1)
        assert np.allclose(out[at : at + k], want)
        at += k
    rows = [(k, [tuple(map(float, q)) for q in p]) for k, p in enumerate(lines)] + [(90, None), (91, [])]
    got = {r["line_id"]: r["points"] for r in curves.resample(spark.createDataFrame(rows, "line_id int, points array<struct<x:double,y:double,z:double>>"), 6).collect()}
    assert got[90] is None and got[91] == [] and all(len(got[k]) == 6 for k in range(len(lines))) and np.allclose(got[3][0], lines[3][0]) and np.allclose(got[3][-1], lines[3][-1])
