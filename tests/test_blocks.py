"""Bricks, blocks and tiles against brute force, with blocks far smaller than the image."""

import itertools
import random

import numpy as np
import pyarrow as pa
import pytest

from skeinworks.operators import blocks, bricks
from skeinworks.plans.streams import whole_groups

SHAPE = (13, 9, 17)


def random_cells(rng, n, shape=SHAPE):
    return sorted({tuple(rng.randrange(k) for k in shape) for _ in range(n)})


def mask(spark, cells):
    return spark.createDataFrame([(1, "b", *c) for c in cells] + [(2, None, *c) for c in cells[:1]], "subject int, bundle string, x int, y int, z int")


def brute_box(cells, kind, size, shape):
    for axis in range(3):
        move = lambda c, o, axis=axis: tuple(v + o if k == axis else v for k, v in enumerate(c))
        if kind == "grow":
            cells = {move(c, o) for c in cells for o in blocks.offsets(size)}
        else:
            cells = {c for c in itertools.product(*map(range, shape)) if all(move(c, o) in cells for o in blocks.offsets(size))}
        cells = {c for c in cells if all(0 <= v < n for v, n in zip(c, shape, strict=True))}
    return cells


@pytest.mark.parametrize("side", [4, 7, 256])
def test_boxes(spark, side):
    cells = random_cells(random.Random(side), 150)
    df = mask(spark, cells)
    for steps in ([("grow", 3)], [("wear", 2)], [("grow", 4), ("wear", 4)], [("grow", 3), ("wear", 2), ("grow", 2)]):
        want = set(cells)
        for kind, size in steps:
            want = brute_box(want, kind, size, SHAPE)
        rows = blocks.boxed(df, steps, SHAPE, side).collect()
        got = [(r["x"], r["y"], r["z"]) for r in rows if r["subject"] == 1]
        assert len(got) == len(set(got)) and set(got) == want
    assert blocks.boxed(df.limit(0), [("grow", 3)], SHAPE, side).count() == 0


def brute_blobs(cells):
    cells, out = set(cells), {}
    for first in sorted(cells):
        todo = [first] if first not in out else []
        while todo:
            c = todo.pop()
            if c in out:
                continue
            out[c] = first
            todo += [n for k in range(3) for d in (1, -1) if (n := tuple(v + d * (j == k) for j, v in enumerate(c))) in cells]
    return out


def winding():
    """A path that turns through all tiles, and another beside it."""
    path = [(x, y, z) for x in range(0, 13, 2) for y in (range(9) if x % 4 == 0 else range(8, -1, -1)) for z in (0,)]
    links = [(x, 8 if x % 4 == 1 else 0, 0) for x in range(1, 13, 2)]
    return sorted({*path, *links, *((x, 4, 16) for x in range(13)), (5, 5, 8)})


@pytest.mark.parametrize("side", [2, 5, 64])
def test_blobs_over_tiles(spark, side):
    for cells in (winding(), random_cells(random.Random(side), 900), [(0, 0, 0)]):
        df = mask(spark, cells)
        rows = blocks.blobs(df.union(df), SHAPE, ["subject"], side).where("subject = 1").collect()
        node = lambda c: (c[0] * SHAPE[1] + c[1]) * SHAPE[2] + c[2]
        assert {(r["x"], r["y"], r["z"]): r["blob"] for r in rows} == {c: node(f) for c, f in brute_blobs(cells).items()} and len(rows) == len(cells)


def test_few_edges_of_solid_blobs(spark):
    cells = [c for c in itertools.product(range(12), range(9), range(16))]
    own = blocks.tile_labels(mask(spark, cells), SHAPE, ["subject"], 8)
    assert blocks.face_edges(own, ["subject"], 8).count() < 0.1 * len(cells)


def test_bricks(spark):
    rng = np.random.default_rng(2)
    cells = random_cells(random.Random(2), 700)
    value = {c: float(v) for c, v in zip(cells, rng.normal(size=len(cells)), strict=True)}
    value[cells[5]] = float("nan")
    image = spark.createDataFrame([(1, *c, v) for c, v in value.items()] + [(2, 0, 0, 0, None)], "subject int, x int, y int, z int, value double")
    points = [tuple(map(float, p)) for p in rng.uniform(-1, 18, (200, 3))] + [(7.0, 8.0, 16.0), (12.0, 8.0, 16.0), (8.0, 7.5, 15.999), (0.0, 0.0, 0.0), (12.0001, 1.0, 1.0)] * 2 + [tuple(map(float, c)) for c in cells[:20]]
    df = spark.createDataFrame([(1, i, *p) for i, p in enumerate(points)] + [(3, 0, 1.0, 1.0, 1.0)], "subject int, n int, x double, y double, z double")
    got = bricks.sample(df, bricks.bricks(image, ["subject"]), SHAPE, ["subject"]).collect()
    assert len(got) == len(points) + 1 and got[0].__fields__ == ["subject", "n", "x", "y", "z", "sample"]
    for r in got:
        want = 0.0
        p = (r["x"], r["y"], r["z"])
        if r["subject"] == 1 and all(0 <= v <= n - 1 for v, n in zip(p, SHAPE, strict=True)):
            for o in itertools.product((0, 1), repeat=3):
                w = np.prod([v - np.floor(v) if k else 1 - (v - np.floor(v)) for v, k in zip(p, o, strict=True)])
                want += w * value.get(tuple(int(np.floor(v)) + k for v, k in zip(p, o, strict=True)), 0.0) if w > 0 else 0
        assert np.isclose(r["sample"], want, atol=1e-12, equal_nan=True)
    for r in bricks.lookup(df, bricks.bricks(image, ["subject"]), ["subject"]).collect():
        want = value.get((int(r["x"]), int(r["y"]), int(r["z"])), 0.0) if r["subject"] == 1 else 0.0
        assert np.isclose(r["value"], want, equal_nan=True)


def test_whole_groups():
    rng = random.Random(3)
    rows = sorted((rng.choice([0, 1, 2, 3, 9]), rng.choice("ab")) for _ in range(200))
    rows = [(None, None)] * 7 + rows
    for size in (1, 3, 50, 500):
        batches = [pa.RecordBatch.from_pylist([{"a": a, "b": b} for a, b in rows[i : i + size]], pa.schema([("a", pa.int32()), ("b", pa.string())])) for i in range(0, len(rows), size)]
        out = [[tuple(r.values()) for r in t.to_pylist()] for t in whole_groups(iter(batches), ["a", "b"])]
        assert [r for t in out for r in t] == rows and len({t[0] for t in out}) == len(out) and all(x[-1] != y[0] for x, y in itertools.pairwise(out))
    assert list(whole_groups(iter([]), ["a"])) == []
