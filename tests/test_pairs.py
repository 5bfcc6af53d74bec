"""Pairs of points within a distance, against brute force, and what their join shuffles."""

import itertools
import math
import random

from skeinworks.operators import lines as L
from skeinworks.plans import fixtures as fx


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(L, "TOGETHER", 3)
    r = random.Random(1)
    places = [tuple(r.uniform(-20, 20) for _ in range(3)) for _ in range(40)] + [(8.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 8.0, 0.0)]
    rows = [(g, k, *r.choice(places)) for g in (1, 2) for k in range(150)] + [(1, 500, None, 0.0, 0.0), (1, None, 0.0, 0.0, 0.0), (None, 501, 0.0, 0.0, 0.0), (1, 502, float("nan"), 0.0, 0.0)]
    df = spark.createDataFrame(rows, "g int, k long, x double, y double, z double")
    got = sorted((r["g"], r["a"], r["b"]) for r in L.within_eps(df, 8.0, "k", ["g"]).collect())
    fine = [r for r in rows if r[0] and r[1] is not None and r[1] < 500]
    want = sorted((p[0], min(p[1], q[1]), max(p[1], q[1])) for p, q in itertools.combinations(fine, 2) if p[0] == q[0] and math.sqrt(sum((u - v) ** 2 for u, v in zip(p[2:], q[2:], strict=True))) <= 8.0)
    assert got == want


def test_copies_meet_once(spark):
    """A thousand points of two places are four rows of the join and their pairs are made behind it."""
    df = spark.range(1000).selectExpr("1 AS g", "id AS k", "CAST(id % 2 AS DOUBLE) AS x", "0D AS y", "0D AS z")
    pairs = L.within_eps(df, 8.0, "k", ["g"])
    assert pairs.count() == 1000 * 999 // 2
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(akeys") < plan.index("Join Inner")


def test_pairs_are_not_shuffled(spark):
    """Behind the join of rows of points, where pairs are made, there is no shuffle."""
    df = spark.range(300).selectExpr("1 AS g", "id AS k", "id / 100 AS x", "0D AS y", "0D AS z")
    pairs = L.within_eps(df, 8.0, "k", ["g"])
    assert pairs.count() == 300 * 299 // 2
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Repartition" not in plan[: plan.index("Join Inner")]


def test_points_eps_apart_by_rounding(spark):
    df = spark.createDataFrame([(1, 1, -1e-17, 0.0, 0.0), (1, 2, 8.0, 0.0, 0.0), (1, 3, float("inf"), 0.0, 0.0)], "g int, k long, x double, y double, z double")
    assert [tuple(r) for r in L.within_eps(df, 8.0, "k", ["g"]).collect()] == [(1, 1, 2, 8.0)]


def test_first_points(spark):
    d = "/root/testdata/sf0.001"
    got, want = fx.line_starts(spark, d), fx.line_points(spark, d).where("pos = 0")
    assert got.dtypes == want.dtypes
    assert sorted(got.collect()) == sorted(want.collect())
