"""Profiles of all four methods against a plain computation, point by point."""

import itertools

import numpy as np
import pytest

from skeinworks.operators import profiles as P

SHAPE = (12, 11, 10)
N = 8


def sample(value, p):
    if not all(0 <= v <= n - 1 for v, n in zip(p, SHAPE, strict=True)):
        return 0.0
    low, out = np.floor(p).astype(int), 0.0
    for o in itertools.product((0, 1), repeat=3):
        w = np.prod([f if k else 1 - f for f, k in zip(p - low, o, strict=True)])
        out += w * value.get(tuple(int(v) for v in low + o), 0.0) if w > 0 else 0
    return out


def resample(p, n):
    at = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))])
    want = np.linspace(0, at[-1], n)
    return np.stack([np.interp(want, at, p[:, k]) for k in range(3)], axis=1)


def brute(lines, value, starts, method):
    grown = {tuple(np.add(c, d)) for c in starts for d in [(0, 0, 0), *(tuple(s * (k == i) for k in range(3)) for i in range(3) for s in (1, -1))]}
    turned = []
    for p in lines:
        cell = tuple(int(v + 0.5) for v in p[0])
        if all(v + 0.5 >= 0 for v in p[0]) and all(c < n for c, n in zip(cell, SHAPE, strict=True)):
            turned.append(p if cell in grown else p[::-1])
    even = np.array([resample(p, N) for p in turned])
    core = even.mean(0)
    values = np.array([[sample(value, q) for q in p] for p in even])
    if method == "equal_dist":
        groups = {k: values[:, k] for k in range(N)}
    elif method == "distance_map":
        groups = {k: [] for k in range(N)}
        for q, v in zip(even.reshape(-1, 3), values.ravel(), strict=True):
            groups[int(((core - q) ** 2).sum(1).argmin())].append(v)
        groups = {k: v or [sample(value, core[k])] for k, v in groups.items()}
    elif method == "cutting_plane":
        length = lambda p: np.linalg.norm(np.diff(p, axis=0), axis=1).sum()
        step = max(map(length, turned)) / N
        groups = {}
        for p in turned:
            q = resample(p, n) if (n := max(int(length(p) / step), 1)) > 1 else p[:1]
            middle = int(((q - core[N // 2]) ** 2).sum(1).argmin())
            for k, point in enumerate(q):
                if 0 <= (at := k - middle + N // 2) < N:
                    groups.setdefault(at, []).append(sample(value, point))
    else:
        out = {}
        for k in range(N):
            d = even[:, k] - core[k]
            inverse = np.linalg.inv(d.T @ d / len(d) + np.eye(3) * 1e-9)
            w = np.exp(-np.sqrt(np.maximum(np.einsum("ni,ij,nj->n", d, inverse, d), 0)))
            mean = (w * values[:, k]).sum() / w.sum()
            out[k] = mean, np.sqrt(max((w * values[:, k] ** 2).sum() / w.sum() - mean**2, 0))
        return out
    return {k: (np.mean(v), np.std(v)) for k, v in groups.items()}


@pytest.mark.parametrize("method", ["distance_map", "equal_dist", "cutting_plane", "weighted"])
def test_profiles_equal_brute_force(spark, method):
    rng = np.random.default_rng(5)
    value = {c: float(rng.random()) for c in itertools.product(*map(range, SHAPE)) if rng.random() < 0.8}
    lines = []
    for k in range(9):
        p = np.array([1.0, 1.0, 1.0]) + np.linspace(0, 7, 6 + k)[:, None] * [1.0, 0.9, 0.7] + rng.normal(size=(6 + k, 3)) * 0.25
        lines.append(p[:: -1 if k % 3 == 0 else 1])
    starts = {tuple(int(v + 0.5) for v in p[0]) for k, p in enumerate(lines) if k % 3}
    schema = "subject int, bundle string, line_id int, points array<struct<x:double,y:double,z:double>>"
    rows = [(1, "a", k, [tuple(map(float, q)) for q in p]) for k, p in enumerate(lines)] + [(1, "few", 99, [(1.0, 1.0, 1.0), (2.0, 2.0, 2.0)])]
    image = spark.createDataFrame([(1, *c, v) for c, v in value.items()], "subject int, x int, y int, z int, value double")
    begin = spark.createDataFrame([(1, "a", *c) for c in starts] + [(1, "few", 1, 1, 1)], "subject int, bundle string, x int, y int, z int")
    got = P.profile(spark.createDataFrame(rows, schema), image, begin, SHAPE, n=N, method=method, dilation=1, trim=False).collect()
    assert {(r["mean"], r["std"], r["n"]) for r in got if r["bundle"] == "few"} == {(0.0, 0.0, 0)}
    want = brute(lines, value, starts, method)
    mine = {r["position"]: (r["mean"], r["std"]) for r in got if r["bundle"] == "a"}
    assert len(mine) == N
    for k in range(N):
        assert np.allclose(mine[k], want.get(k, (0.0, 0.0)), atol=1e-9), (k, mine[k], want.get(k))
