"""Threshold clusters, quantiles by refinement, and stochastic scores."""

import numpy as np
import pytest

from skeinworks.operators import bundles, dataset

LINES = "subject int, bundle string, line_id int, points array<struct<x:double,y:double,z:double>>"


def brute(lines, threshold, reversible):
    sums, out = [], []
    for p in lines:
        best = None
        for k, (s, n) in enumerate(sums):
            for turned in (False, True) if reversible else (False,):
                d = np.linalg.norm(s / n - (p[::-1] if turned else p), axis=1).mean()
                if d < threshold and (best is None or d < best[0]):
                    best = d, k, turned
        if best is None:
            sums.append((p.copy(), 1))
            out.append((len(sums) - 1, False))
        else:
            _, k, turned = best
            sums[k] = sums[k][0] + (p[::-1] if turned else p), sums[k][1] + 1
            out.append((k, turned))
    return out


def rows_of(groups):
    return [(1, g, i, [tuple(map(float, q)) for q in p]) for g, lines in groups.items() for i, p in enumerate(lines)]


@pytest.mark.parametrize("reversible", [True, False])
def test_threshold_clusters_equal_brute_force(spark, reversible):
    rng = np.random.default_rng(1)
    line = lambda at: at + np.linspace(0, 9, 12)[:, None] * [1, 0.2, 0] + rng.normal(size=(12, 3))
    groups = {g: [(p if rng.random() < 0.5 else p[::-1]) for p in (line(rng.choice([0, 6, 30])) for _ in range(40))] for g in "ab"}
    df = spark.createDataFrame([*rows_of(groups), (1, "a", 900, []), (2, "c", 1, None)], LINES)
    got = {(r["bundle"], r["line_id"]): (r["cluster"], r["turned"]) for r in bundles.threshold_clusters(df, 4.0, reversible=reversible).collect()}
    assert got == {(g, i): v for g, lines in groups.items() for i, v in enumerate(brute(lines, 4.0, reversible))}


def test_parts_of_a_group_join_and_two_parts_are_flagged(spark, monkeypatch):
    monkeypatch.setattr(bundles, "LINES", 7)
    rng = np.random.default_rng(2)
    base = np.linspace(0, 9, 6)[:, None] * [1.0, 0, 0]
    groups = {"one": [base + rng.normal(size=3) * 0.1 for _ in range(40)], "two": [base[::-1 if i % 3 else 1] + [0, 50 * (i % 2), 0] + rng.normal(size=3) * 0.1 for i in range(40)]}
    found = bundles.threshold_clusters(spark.createDataFrame(rows_of(groups), LINES), 5.0)
    rows = found.collect()
    assert {r["cluster"] for r in rows if r["bundle"] == "one"} == {0} and len(rows) == 80
    even = {r["cluster"] for r in rows if r["bundle"] == "two" and r["line_id"] % 2 == 0}
    odd = {r["cluster"] for r in rows if r["bundle"] == "two" and r["line_id"] % 2}
    assert len(even) == len(odd) == 1 and even != odd
    ways = {(r["line_id"] % 2, r["line_id"] % 3 > 0, r["turned"]) for r in rows if r["bundle"] == "two"}
    assert len(ways) == 4  # in a cluster, direction decides
    assert {r["bundle"]: (r["clusters"], r["largest"], r["split"]) for r in bundles.split_bundles(found).collect()} == {"one": (1, 1.0, False), "two": (2, 0.5, True)}


def test_quantiles_are_exact(spark):
    rng = np.random.default_rng(3)
    groups = {"a": rng.normal(size=501) * 10.0 ** rng.integers(-200, 200, 501), "b": np.array([-0.0, 0.0, 5.0]), "c": np.array([7.0]), "d": np.repeat([1.0, 2.0], 50), "e": np.array([-np.inf, -1e-300, 1e-300, np.inf])}
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("a", None), ("a", float("nan")), ("f", None)]
    df = spark.createDataFrame(rows, "g string, value double")
    for lo, hi in ((0.02, 0.98), (0.25, 0.5), (0.0, 1.0)):
        got = {r["g"]: (r["low"], r["high"]) for r in dataset.quantile_band(df, ["g"], lo, hi).collect()}
        assert set(got) == set(groups)
        for g in "abcd":
            assert np.allclose(got[g], np.quantile(groups[g], [lo, hi]), rtol=1e-12)


def test_samples_differ_and_repeat(spark):
    df = spark.createDataFrame([(s, "A", x, y, 0, 0.5) for s in (1, 2) for x in range(3) for y in range(2)], "subject int, bundle string, x int, y int, z int, value double")
    noisy = lambda frame, seed: frame.assign(prob=seed / 2**32)
    seen = lambda d, n: sorted(map(tuple, dataset.batch_score(d, noisy, samples=n, seed=9).collect()))
    rows = seen(df, 3)
    assert rows == seen(df.repartition(5), 3) and len(rows) == 2 * 6 * 3 * 3
    by_slice = {}
    for s, _, x, y, z, direction, sample, prob in rows:
        by_slice.setdefault((s, direction, (x, y, z)[direction - 1]), {}).setdefault(sample, set()).add(prob)
    assert all(len(v) == 3 and len({min(p) for p in v.values()}) == 3 for v in by_slice.values())
    assert rows[0][-1] == dataset.sample_seed(9, 1, 1, 0, 0) / 2**32


def test_segment_crops_and_puts_back(spark):
    """Cells far from the origin come out as those of the box alone, moved; scaling a box to its own size changes nothing."""
    rng = np.random.default_rng(6)
    cells = {(x, y, z) for x in range(6) for y in range(6) for z in range(6) if rng.random() < 0.7} | {(0, 0, 0), (5, 5, 5)}
    rows = lambda by: [(s, "A", x + by, y + by, z + by, 0.9) for s in (1, 2) for x, y, z in sorted(cells)] + [(1, "A", 0, 0, 0, 0.0), (1, "A", 1, 1, 1, float("nan"))]
    model = lambda pdf: pdf.assign(prob=pdf["value"])[["bundle", "x", "y", "z", "prob"]]
    df = spark.createDataFrame(rows(9), "subject int, bundle string, x int, y int, z int, value double")
    got = {tuple(r) for r in dataset.segment(df, model, (20, 20, 20), 6, {}, 0).select("subject", "x", "y", "z").collect()}
    assert got == {(s, x + 9, y + 9, z + 9) for s in (1, 2) for x, y, z in cells}
    assert dataset.segment(df.where("value = 0"), model, (20, 20, 20), 6, {}, 0).count() == 0
