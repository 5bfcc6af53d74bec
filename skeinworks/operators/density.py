"""Density clusters (Ester et al., 1996) of points in groups, on a grid, without tables of pairs.

Cells are so small that any two points of one are within eps. A cell with enough points has only core points, so
most points are never compared; the others count neighbours until they have enough. Cells are linked by the first
pair of core points within eps (Gan and Tao, 2015). Groups are cut into tiles of several eps; a tile's task also gets the points
within 2 eps of it, which settles which of those within eps are core. Tiles then only exchange labels of the points near their faces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.components import components, stars
from ..plans.stash import stash
from ..plans.streams import by_group, changes, own_places

CELL = ["x", "y", "z"]
PLACE = ["tx_", "ty_", "tz_"]
#: Sides of a tile in eps, and pairs of points that are compared at a time.
TILE, PAIRS = 8, 1 << 19


class Grid:
    """Points by cells: ``first`` and ``size`` of each cell among the points in ``order``."""

    def __init__(self, xyz: np.ndarray, eps: float) -> None:
        side = eps / np.sqrt(3) * (1 - 1e-9)
        cell = np.floor((xyz - xyz.min(axis=0)) / side).astype(np.int64) + 2
        self.wide = cell.max(axis=0) + 3
        key = (cell[:, 0] * self.wide[1] + cell[:, 1]) * self.wide[2] + cell[:, 2]
        self.order = np.argsort(key, kind="stable")
        self.key, self.first, self.size = np.unique(key[self.order], return_index=True, return_counts=True)
        self.xyz, self.eps = xyz[self.order], eps
        self.of = np.repeat(np.arange(len(self.key)), self.size)

    def around(self) -> Iterator[int]:
        """What to add to a cell's key for each cell that may hold points within eps, itself left out."""
        for i in range(-2, 3):
            for j in range(-2, 3):
                for k in range(-2, 3):
                    if (i, j, k) != (0, 0, 0) and sum(max(abs(d) - 1, 0) ** 2 for d in (i, j, k)) <= 3:
                        yield int((i * self.wide[1] + j) * self.wide[2] + k)

    def at(self, cells: np.ndarray, step: int) -> np.ndarray:
        """Numbers of the cells a step from ``cells``; -1 where none has points."""
        there = np.searchsorted(self.key, self.key[cells] + step)
        there = np.minimum(there, len(self.key) - 1)
        return np.where(self.key[there] == self.key[cells] + step, there, -1)

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = self.xyz[a] - self.xyz[b]
        return np.sqrt(d[:, 0] ** 2 + d[:, 1] ** 2 + d[:, 2] ** 2) <= self.eps

    def counts(self, points: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """How many of the ``size`` points from ``first`` on are within eps of each of ``points``; ranges are cut so that few pairs stand at a time."""
        out = np.zeros(len(points), np.int64)
        todo = np.flatnonzero(size > 0)
        done = np.zeros(len(points), np.int64)
        while len(todo):
            left = size[todo] - done[todo]
            some = todo[: max(1, int(np.searchsorted(np.cumsum(left), PAIRS, "right")))]
            take = np.minimum(size[some] - done[some], PAIRS)
            one = np.repeat(np.arange(len(some)), take)
            place = np.arange(len(one)) - np.repeat(np.cumsum(take) - take, take)
            hit = self.near(points[some][one], (first[some] + done[some])[one] + place)
            out[some] += np.bincount(one[hit], minlength=len(some))
            done[some] += take
            todo = todo[done[todo] < size[todo]]
        return out


def core_points(grid: Grid, least: int) -> np.ndarray:
    """Which points (in the grid's order) have ``least`` within eps, themselves included. A point that has enough looks no further."""
    count = grid.size[grid.of].astype(np.int64)
    for step in grid.around():
        open_ = np.flatnonzero(count < least)
        if not len(open_):
            break
        there = grid.at(grid.of[open_], step)
        open_, there = open_[there >= 0], there[there >= 0]
        # of a crowded cell some points usually do
        some = np.minimum(grid.size[there], 8 * least)
        count[open_] += grid.counts(open_, grid.first[there], some)
        rest = (count[open_] < least) & (some < grid.size[there])
        count[open_[rest]] += grid.counts(open_[rest], (grid.first[there] + some)[rest], (grid.size[there] - some)[rest])
    return count >= least


def linked(grid: Grid, core: list[np.ndarray], a: int, b: int) -> bool:
    """Whether a core point of one cell is within eps of one of another; those that are nearest to the other cell are tried first."""
    p, q = grid.xyz[core[a]], grid.xyz[core[b]]

    def reach(x: np.ndarray, box: np.ndarray) -> np.ndarray:
        out = np.maximum(0, np.maximum(box.min(axis=0) - x, x - box.max(axis=0)))
        far = np.sqrt((out**2).sum(axis=1))
        return x[np.argsort(far, kind="stable")][: int((far <= grid.eps * (1 + 1e-12)).sum())]

    p, q = reach(p, q), reach(q, p)
    step = 16
    at = 0
    while at < len(p) and len(q):
        rows = p[at : at + step]
        d = rows[:, None] - q[None]
        if (np.sqrt(d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2) <= grid.eps).any():
            return True
        at += len(rows)
        step = max(16, PAIRS // len(q))
    return False


def inner_points(grid: Grid, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Core points, cell by cell, and where each cell's begin and how many they are."""
    inner = np.flatnonzero(core)
    size = np.bincount(grid.of[inner], minlength=len(grid.key))
    return inner, np.cumsum(size) - size, size


def part_of(grid: Grid, points: np.ndarray) -> Grid:
    """To compare some points alone, in this order."""
    out = Grid.__new__(Grid)
    out.eps, out.xyz = grid.eps, grid.xyz[points]
    return out


def clusters(grid: Grid, core: np.ndarray) -> np.ndarray:
    """For each cell the number of a cell of its cluster, its smallest; -1 without core points.

    Pairs of cells with few points are compared all at once, the others one by one unless their clusters have met.
    """
    inner, first, size = inner_points(grid, core)
    own = part_of(grid, inner)
    split = np.split(inner, first[1:])
    label = np.arange(len(grid.key))
    cells = np.flatnonzero(size)
    for step in grid.around():
        if step < 0 or not len(cells):
            continue
        there = grid.at(cells, step)
        on = np.flatnonzero(there >= 0)
        a, b = cells[on], there[on]
        apart = (size[b] > 0) & (label[a] != label[b])
        a, b = a[apart], b[apart]
        few = size[a] * size[b] <= 256
        pair = np.repeat(np.flatnonzero(few), size[a[few]])
        one = first[a[pair]] + own_places(size[a[few]])
        hit = np.zeros(len(a), bool)
        hit[pair[own.counts(one, first[b[pair]], size[b[pair]]) > 0]] = True
        for k in np.flatnonzero(~few).tolist():
            hit[k] = linked(grid, split, a[k], b[k])
        if hit.any():
            label = stars(label[a[hit]], label[b[hit]], len(label))[label]
    return np.where(size > 0, label, -1)


def border(grid: Grid, core: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points that aren't core, once with the label of each cell that has a core point within eps of them."""
    inner, first, size = inner_points(grid, core)
    out = np.flatnonzero(~core)
    both = part_of(grid, np.concatenate([inner, out]))
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for step in [0, *grid.around()]:
        there = grid.at(grid.of[out], step) if len(out) else out
        on = np.flatnonzero((there >= 0) & (size[there] > 0))
        hit = on[both.counts(len(inner) + on, first[there[on]], size[there[on]]) > 0]
        found.append((out[hit], label[there[hit]]))
    return tuple(np.concatenate(v) for v in zip(*found, strict=True))


def density_clusters(points: DataFrame, key: str, by: list[str], eps: float, least: int) -> DataFrame:
    """``points`` with ``cluster``: core points have ``least`` within ``eps``, themselves included; those that chains of core points within eps
    join share their smallest ``key``; another point within eps of core points gets the smallest of their clusters, the rest null.

    ``key`` is unique in a group. Points with a null coordinate are in no cluster. A task holds the points of a tile and its surroundings.
    """
    side = TILE * eps
    kind = points.schema[key].dataType
    rows = points.select(*by, F.col(key).alias("key_"), *(F.col(c).cast("double").alias(c) for c in CELL)).where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in CELL))
    for c, t in zip(CELL, PLACE, strict=True):
        near = lambda d, c=c: F.floor((F.col(c) + d) / side)
        rows = rows.withColumn(t, F.explode(F.sequence(near(-2 * eps), near(2 * eps))))
    keys = [*by, *PLACE]

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        begin = changes(table, keys)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), table.num_rows], strict=True):
            one = table.slice(a, b - a)
            xyz = np.stack([one.column(c).to_numpy() for c in CELL], axis=1)
            low = np.array([one.column(t)[0].as_py() for t in PLACE]) * side
            tile = np.array([one.column(t)[0].as_py() for t in PLACE])
            mine = (np.floor(xyz / side) == tile).all(axis=1)
            if not mine.any():
                continue
            deep = (mine[:, None] & (xyz - eps >= low) & (xyz + eps < low + side)).all(axis=1)
            close = ((xyz >= low - eps) & (xyz <= low + side + eps)).all(axis=1)
            grid = Grid(xyz, eps)
            core = core_points(grid, least) & close[grid.order]
            label = clusters(grid, core)
            # a cell's cluster goes by the smallest key of its core points
            point = np.flatnonzero(core)
            name = one.column("key_").take(pa.array(grid.order))
            rank = np.empty(len(name), np.int64)
            rank[np.asarray(pa.compute.sort_indices(name))] = np.arange(len(name))
            least_of = np.full(len(grid.key), len(name))
            np.minimum.at(least_of, label[grid.of[point]], rank[point])
            by_rank = np.argsort(rank)
            other, at = border(grid, core, label)
            who = np.concatenate([point, other])
            to = by_rank[least_of[np.concatenate([label[grid.of[point]], at])]]
            is_core = np.arange(len(who)) < len(point)
            inside, inner = mine[grid.order][who], deep[grid.order][who]
            keep = is_core & ~inner | inside
            head = one.select(by).take(pa.array(np.zeros(int(keep.sum()), np.int64)))
            for c, v in (("key_", name.take(pa.array(who[keep]))), ("label_", name.take(pa.array(to[keep]))), ("mine_", pa.array(inside[keep])), ("face_", pa.array((is_core & ~inner)[keep]))):
                head = head.append_column(c, v)
            yield from head.combine_chunks().to_batches()

    schema = T.StructType([*(rows.schema[k] for k in by), T.StructField("key_", kind), T.StructField("label_", kind), T.StructField("mine_", T.BooleanType()), T.StructField("face_", T.BooleanType())])
    found = stash(by_group(rows, keys, work, schema), "density")
    # a core point near a face has a label from each tile that sees it, which joins them
    faces = found.where("face_").select(*by, F.col("key_").alias("a"), F.col("label_").alias("b"))
    roots = components(faces, by).select(*by, F.col("node").alias("label_"), "root").distinct()
    named = found.where("mine_").join(roots, [*by, "label_"], "left").groupBy(*by, F.col("key_").alias(key)).agg(F.min(F.coalesce("root", "label_")).alias("cluster"))
    return points.join(named, [*by, key], "left")
