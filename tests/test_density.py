"""Density clusters against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.operators import density


def brute(xyz, keys, eps, least):
    d = np.sqrt(((xyz[:, None] - xyz[None]) ** 2).sum(-1)) <= eps
    core = d.sum(1) >= least
    label = {}
    for i in sorted(np.flatnonzero(core), key=lambda i: keys[i]):
        todo = [] if i in label else [i]
        while todo:
            j = todo.pop()
            if j not in label:
                label[j] = keys[i]
                todo += np.flatnonzero(d[j] & core).tolist()
    return [label[i] if core[i] else min((label[j] for j in np.flatnonzero(d[i] & core)), default=None) for i in range(len(xyz))]


def cloud(rng, n, wide):
    centres = rng.uniform(-wide, wide, (6, 3))
    return np.concatenate([centres[rng.integers(0, 6, n)] + rng.normal(size=(n, 3)) * rng.choice([0.3, 1.5], (n, 1)), rng.uniform(-wide, wide, (n // 4, 3)), [[0.0, 0, 0]] * 3])


@pytest.mark.parametrize("eps, least, wide", [(1.0, 5, 5), (0.5, 3, 20), (3.0, 4, 40), (1.0, 1, 6)])
def test_clusters_across_tiles(spark, eps, least, wide):
    rng = np.random.default_rng(int(10 * eps) + least)
    groups = {g: cloud(rng, n, wide) for g, n in (("a", 300), ("b", 40))}
    keys = {g: rng.permutation(1000)[: len(x)].tolist() for g, x in groups.items()}
    rows = [(g, int(k), *map(float, p)) for g, x in groups.items() for k, p in zip(keys[g], x, strict=True)] + [("b", 5000, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g string, k int, x double, y double, z double").withColumn("key_", F.lit("clash"))
    out = density.density_clusters(df, "k", ["g"], eps, least)
    assert set(out.columns) == {*df.columns, "cluster"}
    got = {(r["g"], r["k"]): r["cluster"] for r in out.collect()}
    want = {(g, k): c for g, x in groups.items() for k, c in zip(keys[g], brute(x, keys[g], eps, least), strict=True)} | {("b", 5000): None}
    assert got == want


def test_a_chain_through_many_tiles(spark):
    rows = [("a", 10000 - i, 0.9 * i, 0.0, -3.0) for i in range(300)] + [("a", 1, 500.0, 0.0, 0.0)]
    out = density.density_clusters(spark.createDataFrame(rows, "g string, k int, x double, y double, z double"), "k", ["g"], 1.0, 3)
    assert {(r["k"] == 1, r["cluster"]) for r in out.collect()} == {(False, 9702), (True, None)}
    assert density.density_clusters(out.drop("cluster").limit(0), "k", ["g"], 1.0, 3).count() == 0


def test_a_ball_is_no_table_of_pairs():
    """100,000 points within eps: none is compared with all others."""
    rng = np.random.default_rng(0)
    xyz = rng.normal(size=(100_000, 3)) * 0.3
    grid = density.Grid(xyz, 3.0)
    compared = 0
    near = grid.near

    def counted(a, b):
        nonlocal compared
        compared += len(a)
        return near(a, b)

    grid.near = counted
    core = density.core_points(grid, 5)
    assert core.all() and len(set(density.clusters(grid, core).tolist())) == 1 and compared < 1_000_000
