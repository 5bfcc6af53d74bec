"""Permuted statistics, runs over blocks, and fits over the subjects that a cell has."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.operators import cohort as C
from skeinworks.operators import permuted


def longest(hit):
    best = now = 0
    for h in hit:
        now = (now + 1) * bool(h)
        best = max(best, now)
    return best


@pytest.mark.parametrize("block, merged", [(4, 2), (3, 3), (64, 64)])
def test_runs_are_merged_over_blocks(spark, monkeypatch, block, merged):
    monkeypatch.setattr(permuted, "BLOCK", block)
    monkeypatch.setattr(permuted, "MERGED", merged)
    monkeypatch.setattr(permuted, "LABELS", 100)  # a few permutations in a pass
    rng = np.random.default_rng(block)
    n, nperm = 12, 30
    positions = [p for p in range(70) if p not in (11, 40, 41)]
    y = rng.normal(size=(2, 70, n)) + np.repeat(rng.normal(size=(2, 10, n)), 7, axis=1) * 2
    rows = [(f"b{b}", p, s, float(y[b, p, s])) for b in range(2) for p in positions for s in range(n) if rng.random() > 0.03]
    values = spark.createDataFrame(rows, "bundle string, position int, subject int, mean double")
    people = spark.createDataFrame([(s, s % 2, float(rng.normal())) for s in range(n)], "subject int, grp int, target double")
    perms = C.permutations(people, nperm, 5, "grp")
    stats = C.permutation_stats(values, perms, "group").withColumn("p", C.t_to_p(F.col("t"), F.col("df"))).collect()
    p = {(r["bundle"], r["perm"], r["position"]): r["p"] for r in stats}
    subjects = C.subject_rows(people, "grp")
    for family in (["bundle"], []):
        table = values if family else C.end_to_end(values)
        got = {(r["bundle"] if family else None, r["perm"]): r["longest"] for r in permuted.longest_runs(table, subjects, nperm, 5, "group", 0.2, "mean", family).collect()}
        for perm in range(nperm):
            hits = {b: [(p.get((b, perm, k)) or 1.0) < 0.2 for k in range(70)] for b in ("b0", "b1")}
            want = {b: longest(h) for b, h in hits.items()} if family else {None: longest(hits["b0"] + hits["b1"])}
            assert {b: got.get((b, perm), 0) for b in want} == want
    one = permuted.extremes(values, subjects, nperm, 5, "group", ["bundle", "position"], "mean", ["bundle"]).collect()
    monkeypatch.setattr(permuted, "LABELS", 64 << 20)
    monkeypatch.setattr(permuted, "CELLS", 8 * n * 3)
    assert sorted(map(str, permuted.extremes(values, subjects, nperm, 5, "group", ["bundle", "position"], "mean", ["bundle"]).collect())) == sorted(map(str, one))
    assert permuted.longest_runs(values.limit(0), subjects, 3, 5, "group", 0.2, "mean", ["bundle"]).count() == 0


def test_run_parts():
    rng = np.random.default_rng(0)
    hit = rng.random((200, 9)) < 0.7
    for h, *got in zip(hit.tolist(), *permuted.run_parts(hit), strict=True):
        prefix = next((k for k, v in enumerate(h) if not v), 9)
        suffix = next((k for k, v in enumerate(h[::-1]) if not v), 9)
        assert got == [prefix, suffix, longest(h)]


def test_confounds_of_cells_with_missing_subjects(spark):
    rng = np.random.default_rng(1)
    n = 20
    people = [(s, s % 2, 1e6 + float(rng.integers(20, 60)), float(rng.integers(0, 2)), float(rng.normal())) for s in range(n)]
    cohort = spark.createDataFrame(people, "subject int, grp int, age double, sex double, target double")
    rows, want = [], {}
    for k in range(5):
        have = sorted(rng.choice(n, n - 3 * k, replace=False).tolist()) if k < 4 else [3]
        y = np.array([0.01 * people[s][2] + people[s][3] + rng.normal() for s in have])
        x = np.array([[people[s][2] - 1e6, people[s][3], people[s][1]] for s in have])
        centred = x - x.mean(0)
        slope = np.linalg.lstsq(centred, y - y.mean(), rcond=1e-9)[0]
        rows += [("b", k, s, float(v)) for s, v in zip(have, y, strict=True)]
        for s, v in zip(have, y, strict=True):
            want[k, s] = v - slope[0] * people[s][2] - slope[1] * people[s][3]
    rows += [("b", 0, 99, 1.0), ("b", 1, [s for s in range(n) if (1, s) not in want][0], None)]
    values = spark.createDataFrame(rows, "bundle string, position int, subject int, mean double")
    got = C.unconfound(values, cohort, ["age", "sex"], "grp").collect()
    assert {(r["position"], r["subject"]): r["mean"] for r in got if r["mean"] is not None} == pytest.approx(want, rel=1e-9) and len(got) == len(want) + 1
    fixed = C.target_unconfounded(cohort, ["age"]).orderBy("subject").collect()
    a, t = np.array([p[2] for p in people]), np.array([p[4] for p in people])
    slope = np.cov(a, t)[0, 1] / a.var(ddof=1)
    assert np.allclose([r["target"] for r in fixed], t - slope * a) and set(fixed[0].asDict()) == set(cohort.columns)
