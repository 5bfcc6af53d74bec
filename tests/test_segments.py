"""Points between a line's points: whole coordinates on the way stay whole."""

from datetime import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from skeinworks.operators import lines as L
from skeinworks.plans import catalog


@pytest.fixture(scope="module")
def ladders(spark):
    """Lines up the y axis, a step for each unit, of every length to 60, from a z that stays."""
    rows = [(1, "A", n, [(0.0, 0.0, 5.0), (0.0, float(n), 5.0)]) for n in range(1, 61)]
    return spark.createDataFrame(rows, "subject int, bundle string, line_id long, points array<struct<x: double, y: double, z: double>>")


def test_density_map_of_whole_steps(ladders):
    found = {(r["y"], r["n"]) for r in L.density_map(ladders, 1.0).collect()}
    assert found == {(y, 61 - max(y, 1)) for y in range(61)}


def test_binary_map_of_whole_steps(ladders):
    up = ladders.select("subject", F.format_string("%d", "line_id").alias("bundle"), "line_id", "points")
    found = {(r["bundle"], r["y"]) for r in L.binary_map(up, 1.0).collect()}
    assert found == {(str(n), y) for n in range(1, 61) for y in range(n + 1)}


def test_binary_map_of_a_long_gap(spark, tmp_path):
    """A gap of 10,000 cells, in more than 4,000 parts: the query and its SQL have all of them."""
    rows = [(k, datetime(2024, 1, 1), 3, "view", v) for k, v in enumerate([0.0, 100000.0, 99995.0])]
    spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(catalog.ORACLE["a11_binary_map"])
    found = {tuple(r) for r in catalog.QUERIES["a11_binary_map"](spark, str(tmp_path)).select(*want.columns).collect()}
    # 5,001 points, a little less than 2 cells apart: each has a cell of its own
    assert len({r[3] for r in found}) > 5000 and max(r[3] for r in found) == 10000
    assert found == set(want.fetchall())


def test_lines_of_all_kinds(spark):
    """Null and empty lines, one point, the same point twice, a coordinate missing, a gap without end; many points beside few."""
    kind = "subject int, bundle string, line_id long, points array<struct<x: double, y: double, z: double>>"
    whole = [(0.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 1.0, 0.0), (3.0, 1.0, 4.0)]
    odd = [None, [], [(1.0, 2.0, 3.0)], whole, [(0.0, None, 0.0), (2.0, 0.0, 0.0)], [(0.0, 0.0, 0.0), (float("inf"), 0.0, 0.0)], [(0.0, 0.0, 0.0), (400000.0, 0.0, 0.0)]]
    rows = L.subsegment(spark.createDataFrame([(1, "A", i, p) for i, p in enumerate(odd)], kind).coalesce(1), 0.5)
    assert rows.schema["points"].dataType == spark.createDataFrame([], kind).schema["points"].dataType
    got = {r["line_id"]: r["points"] and [tuple(p) for p in r["points"]] for r in rows.where("line_id < 6").collect()}
    assert got[0] is None and got[1] == [] and got[2] == odd[2]
    assert got[3] == [(0.0, 0.0, 0.0), (0.0, 0.5, 0.0), (0.0, 1.0, 0.0), *((3 * j / 10, 1.0, 4 * j / 10) for j in range(11))]
    assert got[4] == [(0.0, None, 0.0), (2.0, 0.0, 0.0)] and len(got[5]) == 2 and got[5][1] == (float("inf"), 0.0, 0.0)
    far = rows.where("line_id = 6").select(F.size("points").alias("n"), F.expr("points[799999].x").alias("x")).first()
    assert far["n"] == 800001 and far["x"] == 400000.0 * 799999 / 800000


def test_splitting_is_done_by_arrays(ladders):
    plan = L.subsegment(ladders, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambdafunction" not in plan.lower()
