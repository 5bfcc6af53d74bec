"""Connected components against union-find, whole in one block and in rounds over many small ones."""

import random

import pytest

from skeinworks.plans import components as under_test


def union_find(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for group, a, b in edges:
        if a != b:
            p, q = top((group, a)), top((group, b))
            up[max(p, q)] = min(p, q)
    return {k: top(k)[1] for k in list(up)}


@pytest.mark.parametrize("many", [1 << 19, 7])
@pytest.mark.parametrize("case", ["none", "random", "path", "star"])
def test_components(spark, monkeypatch, many, case):
    monkeypatch.setattr(under_test, "MANY", many)
    rng = random.Random(1)
    edges = {
        "none": [],
        "random": [(rng.choice("xyz"), rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(90)],
        "path": [("x", i, i + 1) for i in range(40)],
        "star": [("x", 99, i) for i in range(40)] * 2,
    }[case]
    table = spark.createDataFrame(edges, "g string, a long, b long").repartition(4)
    rows = under_test.components(table, ["g"]).collect()
    assert len(rows) == len({(r["g"], r["node"]) for r in rows})
    assert {(r["g"], r["node"]): r["root"] for r in rows} == union_find(edges)


def test_components_of_components(spark):
    first = under_test.components(spark.createDataFrame([(1, 2), (3, 4), (4, 5)], "a long, b long"))
    more = first.selectExpr("node AS a", "root AS b").union(spark.createDataFrame([(5, 2)], "a long, b long"))
    assert {r["node"]: r["root"] for r in under_test.components(more).collect()} == dict.fromkeys([1, 2, 3, 4, 5], 1)
