"""Published values and hand-made cases."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from skeinworks.functions import vectors as X
from skeinworks.functions.student import t_p_value
from skeinworks.operators import cohort as C
from skeinworks.operators import lines as L
from skeinworks.operators import profiles as P
from skeinworks.operators import voxels as V
from skeinworks.sources.catalog import bundle_names

BOX = (12, 12, 12)


def mask(spark, cells, bundle="b"):
    return spark.createDataFrame([(1, bundle, *c) for c in cells], "subject int, bundle string, x int, y int, z int")


@pytest.mark.parametrize("t, p", [(17.081757, 6.9e-05), (-18.412775, 5.1e-05), (-14.541487, 0.00013), (44.503659, 1.52e-06), (-5.26194, 0.006246)])
def test_student_p(t, p):
    assert abs(float(t_p_value(t, 4)) - p) < 6e-7


def test_toy_profile(spark):
    grid = {c: 0.9 if sum(c) % 2 == 0 else 0.5 for c in itertools.product(range(3), repeat=3)}
    grid |= {(0, 0, 0): 0.1, (2, 2, 2): 0.3, (0, 2, 2): 0.4}
    image = spark.createDataFrame([(1, *c, v) for c, v in grid.items()], "subject int, x int, y int, z int, value double")
    pts = [[(0, 0, 0), (2, 2, 2)], [(0, 2, 2), (0, 0, 0)]]
    rows = [(1, "b", i, [tuple(v - 0.5 for v in p) for p in line]) for i, line in enumerate(pts)]
    lines = spark.createDataFrame(rows, "subject int, bundle string, line_id long, points array<struct<x:double,y:double,z:double>>")
    out = P.profile(lines, image, mask(spark, [(0, 0, 0)]), (3, 3, 3), n=10, dilation=0, least=1).orderBy("position").collect()
    assert [round(r["mean"], 3) for r in out] == [0, 0, 0.148, 0.173, 0, 0.325, 0.319, 0.28]


def test_catalogue():
    assert bundle_names("CST_right") == ["CST_right"]
    assert (len(bundle_names("all")), len(bundle_names("profiles")), len(set(sum((bundle_names(f"part{k}") for k in range(1, 5)), [])))) == (72, 50, 72)


def test_blobs_and_closing(spark):
    two = [(x, 0, 0) for x in range(3)] + [(x, 5, 5) for x in range(2)] + [(9, 9, 9)]
    left = {(r["x"], r["y"], r["z"]) for r in V.remove_small_blobs(mask(spark, two), 1, BOX).collect()}
    assert left == set(two[:5])
    single = V.remove_small_blobs(mask(spark, [(9, 9, 9), (0, 0, 0)]), 5, BOX).collect()
    assert [(r["x"], r["y"], r["z"]) for r in single] == [(0, 0, 0)]
    block = [c for c in itertools.product(range(3, 9), repeat=3) if c != (5, 5, 5)]
    closed = {(r["x"], r["y"], r["z"]) for r in V.close_holes(mask(spark, block), 3, BOX).collect()}
    assert closed == set(itertools.product(range(3, 9), repeat=3))
    assert V.close_holes(mask(spark, block), 3, BOX, ["b"]).count() == len(block)


def test_bridge_rule(spark):
    prob = {c: 0.7 for c in itertools.product(range(3), repeat=3)} | {(x + 7, y, z): 0.7 for x, y, z in itertools.product(range(3), repeat=3)}
    prob |= {(x, 1, 1): 0.4 for x in range(3, 7)}
    rows = [(1, b, *c, v) for b in ("CA", "CC_1") for c, v in prob.items()]
    df = spark.createDataFrame(rows, "subject int, bundle string, x int, y int, z int, value double")
    out = V.bundle_specific_postprocess(df, BOX, {"CA": (20, 0.3)}, 2)
    found = {b: {(r["x"], r["y"], r["z"]) for r in out.where(F.col("bundle") == b).collect()} for b in ("CA", "CC_1")}
    assert {(x, 1, 1) for x in range(3, 7)} <= found["CA"]
    assert len(found["CC_1"]) == 54


def test_square_and_back(spark):
    df = mask(spark, [(x, 3, 4) for x in range(5)]).withColumn("value", F.lit(1.0))
    out, how = V.square_and_scale(df, (6, 8, 10), 10)
    back = V.unscale(out, how)
    assert {tuple(r) for r in back.select("x", "y", "z").collect()} == {tuple(r) for r in df.select("x", "y", "z").collect()}


def test_tensor_to_vec(spark):
    rng = np.random.default_rng(0)
    m = rng.standard_normal((50, 3, 3))
    m = m + m.transpose(0, 2, 1)
    flat = [[float(t[i, j]) for i in range(3) for j in range(i, 3)] for t in m] + [[2.0, 0.0, 0.0, 1.0, 0.0, 0.5], [0.0] * 6, [1.0, 0.0, 0.0, 1.0, 0.0, 1.0]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(flat)], "k int, t array<double>").select("k", X.tensor_to_vec("t").alias("v"), X.eigenvalues("t").alias("l")).orderBy("k").collect()
    for t, r in zip(m, rows, strict=False):
        w, u = np.linalg.eigh(t)
        assert np.allclose(r["l"], w[::-1], atol=1e-9)
        assert np.allclose(np.abs(r["v"]), np.abs(w[-1] * u[:, -1]), atol=1e-6)
    assert rows[50]["v"] == [2.0, 0.0, 0.0] and rows[51]["v"] == [0.0, 0.0, 0.0] and np.isclose(np.linalg.norm(rows[52]["v"]), 1)


def test_corrected_alpha_of_three_against_three(spark):
    """Only twenty ways to deal out six labels: the true one and its mirror are a tenth, so the least p is at alpha."""
    rng = np.random.default_rng(1)
    y = rng.normal(size=(6, 4)) * 0.01 + np.array([0, 0, 0, 1, 1, 1])[:, None]
    prof = spark.createDataFrame([(s, "b", p, float(y[s, p])) for s in range(6) for p in range(4)], "subject int, bundle string, position int, mean double")
    cohort = spark.createDataFrame([(s, int(s > 2)) for s in range(6)], "subject int, grp int")
    e = C.permutation_matrix(prof, cohort, "grp", 1000, 1, "group")
    got = C.alpha_fwe(e, 0.05, 1000).first()["alpha_fwe"]
    assert np.isclose(got, C.ttest_ind(prof, cohort).agg(F.min("p")).first()[0], rtol=1e-6)


def test_resample_both_ways_and_compress(spark):
    rng = np.random.default_rng(2)
    rows = [(1, "b", i, [tuple(map(float, p)) for p in np.cumsum(rng.random((int(rng.integers(2, 9)), 3)), 0)]) for i in range(20)]
    lines = spark.createDataFrame(rows, "subject int, bundle string, line_id long, points array<struct<x:double,y:double,z:double>>")
    a = L.explode_points(L.resample(lines, 7)).orderBy("line_id", "pos").select("x", "y", "z").collect()
    b = L.resample_by_rows(L.explode_points(lines), 7).orderBy("line_id", "pos").select("x", "y", "z").collect()
    assert np.allclose(a, b, atol=1e-6)
    thin = L.compress(lines, 0.05)
    assert thin.join(lines.withColumnRenamed("points", "p"), ["subject", "bundle", "line_id"]).where("points[0] = p[0] and element_at(points, -1) = element_at(p, -1) and size(points) <= size(p)").count() == 20


def test_cohort_file(spark, tmp_path):
    from skeinworks.sources.cohort_files import read_cohort

    f = tmp_path / "s.txt"
    f.write_text("# path=/x/SUBJECT_ID.csv\n# just words\n\nsubject_id group Age\nh1 0 30\ns1 1 41.5\n")
    table, directives, mode = read_cohort(spark, str(f))
    assert mode == "group" and directives == {"path": "/x/SUBJECT_ID.csv"} and table.count() == 2
    f.write_text("subject_id group\nh1 2\n")
    with pytest.raises(ValueError):
        read_cohort(spark, str(f))


def test_tck_and_nifti(spark, tmp_path):
    from skeinworks.sources.images import ingest_polylines, ingest_volumes

    pts = np.array([[0, 0, 0], [1, 2, 3], [np.nan] * 3, [4, 4, 4], [np.inf] * 3], "<f4")
    head = b"mrtrix tracks\ndatatype: Float32LE\nfile: . 64\nEND\n"
    (tmp_path / "a.tck").write_bytes(head + bytes(64 - len(head)) + pts.tobytes())
    assert [len(r["points"]) for r in ingest_polylines(spark, str(tmp_path)).orderBy("line_id").collect()] == [2, 1]
    h = bytearray(352)
    h[0:4] = (348).to_bytes(4, "little")
    h[40:56] = np.array([3, 2, 2, 2, 1, 1, 1, 1], "<i2").tobytes()
    h[70:72] = (64).to_bytes(2, "little")
    h[76:108] = np.array([1, 1.25, 1.25, 1.25, 0, 0, 0, 0], "<f4").tobytes()
    h[108:112] = np.array([352], "<f4").tobytes()
    data = np.arange(8, dtype="<f8").reshape(2, 2, 2)
    (tmp_path / "a.nii").write_bytes(bytes(h) + data.tobytes(order="F"))
    cells, images = ingest_volumes(spark, str(tmp_path))
    assert {(r["x"], r["y"], r["z"]): r["value"] for r in cells.collect()} == {c: data[c] for c in itertools.product(range(2), repeat=3) if data[c]}
    assert images.first()["spacing"] == 1.25


def test_split_endpoints(spark):
    rng = np.random.default_rng(3)
    blob = lambda at, n: [tuple(map(float, np.asarray(at) + rng.uniform(-1, 1, 3))) for _ in range(n)]
    groups = {
        "even": blob((0, 0, 0), 12) + blob((40, 0, 0), 8) + [(90.0, 90.0, 90.0)],
        "uneven": blob((0, 0, 0), 20) + blob((40, 0, 0), 6),
        "merged": [(float(i), 0.0, 0.0) for i in range(20)],
        "noise": [(float(30 * i), 0.0, 0.0) for i in range(4)],
        "same": [(1.0, 1.0, 1.0)] * 3,
    }
    rows = [(1, g, k, *p, "kept") for g, pts in groups.items() for k, p in enumerate(pts)]
    points = spark.createDataFrame(rows, "subject int, bundle string, k int, x double, y double, z double, note string")
    out = L.split_endpoints(points, "k", ["subject", "bundle"])
    assert out.columns == [*points.columns, "side"]
    got = {g: [r["side"] for r in sorted(out.where(F.col("bundle") == g).collect(), key=lambda r: r["k"])] for g in groups}
    assert got["even"] == [0] * 12 + [1] * 8 + [None]
    for g in ("uneven", "merged", "noise", "same"):
        p = np.array(groups[g])
        c = [max(map(tuple, p), key=lambda q: (((np.array(q) - p.mean(0)) ** 2).sum(), q))]
        c.append(max(map(tuple, p), key=lambda q: (((np.array(q) - c[0]) ** 2).sum(), q)))
        for _ in range(50):
            side = (((p - c[1]) ** 2).sum(1) < ((p - c[0]) ** 2).sum(1)).astype(int)
            c = [p[side == i].mean(0) if (side == i).any() else c[i] for i in (0, 1)]
        assert got[g] == side.tolist(), g
    assert len(set(got["uneven"][:20])) == len(set(got["uneven"][20:])) == 1 and set(got["uneven"]) == {0, 1}
    assert L.split_endpoints(points.limit(0), "k", ["subject", "bundle"]).count() == 0
