"""Clusters of lines by a distance threshold (Garyfallidis et al., "QuickBundles", 2012)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stash import stash
from ..plans.streams import by_group, changes

CELL = ["x", "y", "z"]
#: Lines of a group that one task takes in turn, about.
LINES = 20_000


class Centroids:
    """Clusters so far: sums of their lines' points and how many they are, one size for all lines."""

    def __init__(self, points: int, reversible: bool) -> None:
        self.sums, self.sizes, self.reversible = np.zeros((0, points, 3)), np.zeros(0), reversible

    def add(self, line: np.ndarray, weight: float, threshold: float) -> tuple[int, bool]:
        """The number of the line's cluster, the nearest within ``threshold`` or a new one, and whether it is turned round."""
        k, turned = len(self.sizes), False
        if k:
            centre = self.sums / self.sizes[:, None, None]
            away = np.sqrt(((centre - line) ** 2).sum(-1)).mean(1)
            back = np.sqrt(((centre - line[::-1]) ** 2).sum(-1)).mean(1) if self.reversible else np.full(k, np.inf)
            best = int(np.minimum(away, back).argmin())
            if min(away[best], back[best]) < threshold:
                k, turned = best, bool(back[best] < away[best])
        if k == len(self.sizes):
            self.sums, self.sizes = np.concatenate([self.sums, np.zeros((1, *line.shape))]), np.append(self.sizes, 0)
        self.sums[k] += weight * (line[::-1] if turned else line)
        self.sizes[k] += weight
        return k, turned


def threshold_clusters(lines: DataFrame, threshold: float, by: list[str] | None = None, reversible: bool = True) -> DataFrame:
    """``by.., line_id, cluster, turned`` of ``lines``, which have one number of points in a group.

    Lines come in the order of ``line_id``; each joins the nearest cluster whose mean line is less than ``threshold`` away (mean distance of points of equal index, either way round
    if ``reversible``), and moves its mean, or begins a new one. Clusters are numbered from 0. A group of more than about ``LINES`` lines is cut by their hashes; the parts'
    clusters, as lines of their size, then join in the same way, and a task holds a part's means only. Lines without points are left out.
    """
    by = by or ["subject", "bundle"]
    some = lines.where(F.size("points") > 0)
    parts = some.groupBy(*by).agg(F.ceil(F.count("*") / LINES).cast("int").alias("parts_"))
    rows = some.join(parts, by).withColumn("part_", F.pmod(F.xxhash64("line_id"), F.col("parts_")).cast("int")).select(*by, "part_", "line_id", "points")
    keys = [*by, "part_"]
    named = [rows.schema[c] for c in keys]
    points = T.ArrayType(T.ArrayType(T.DoubleType()))
    found = T.StructType([*named, rows.schema["line_id"], T.StructField("own_", T.IntegerType()), T.StructField("turned_", T.BooleanType()), T.StructField("size_", T.DoubleType()), T.StructField("mean_", points)])

    def cluster(table: pa.Table) -> Iterator[pa.RecordBatch]:
        begin = changes(table, keys)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), table.num_rows], strict=True):
            one = table.slice(a, b - a)
            lists = one.column("points").combine_chunks()
            flat = np.stack([lists.flatten().field(c).to_numpy(zero_copy_only=False) for c in CELL], axis=1)
            counts = lists.value_lengths().to_numpy()
            if len(set(counts.tolist())) > 1:
                raise ValueError("lines of a group need one number of points")
            clusters = Centroids(int(counts[0]), reversible)
            got = [clusters.add(p, 1.0, threshold) for p in flat.reshape(len(counts), -1, 3)]
            n, more = len(got), len(clusters.sizes)
            head = one.select(keys).take(pa.array(np.zeros(n + more, np.int64))).combine_chunks()
            ids = pa.concat_arrays([one.column("line_id").combine_chunks(), pa.nulls(more, one.schema.field("line_id").type)])
            columns = [ids, pa.array([*(k for k, _ in got), *range(more)], pa.int32()), pa.array([*(t for _, t in got), *[None] * more]), pa.array([*[None] * n, *clusters.sizes.tolist()], pa.float64()), pa.array([*[None] * n, *(clusters.sums / clusters.sizes[:, None, None]).tolist()], pa.list_(pa.list_(pa.float64())))]
            for c, v in zip(("line_id", "own_", "turned_", "size_", "mean_"), columns, strict=True):
                head = head.append_column(c, v)
            yield from head.combine_chunks().to_batches()

    first = stash(by_group(rows, keys, cluster, found, ["line_id"]), "clusters")
    joined = T.StructType([*named, T.StructField("own_", T.IntegerType()), T.StructField("cluster", T.IntegerType()), T.StructField("back_", T.BooleanType())])

    def join(table: pa.Table) -> Iterator[pa.RecordBatch]:
        begin = changes(table, by)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), table.num_rows], strict=True):
            one = table.slice(a, b - a)
            means, sizes = [np.array(m) for m in one.column("mean_").to_pylist()], one.column("size_").to_pylist()
            alone = one.column("part_")[0].as_py() == one.column("part_")[b - a - 1].as_py()
            clusters = Centroids(len(means[0]), reversible)
            got = [(k, False) for k in range(b - a)] if alone else [clusters.add(m, s, threshold) for m, s in zip(means, sizes, strict=True)]
            out = one.select([*keys, "own_"]).append_column("cluster", pa.array([k for k, _ in got], pa.int32())).append_column("back_", pa.array([t for _, t in got]))
            yield from out.combine_chunks().to_batches()

    # of groups of one part the clusters stay as they are
    means = first.where("size_ IS NOT NULL").select(*keys, "own_", "size_", "mean_")
    names = by_group(means, by, join, joined, ["part_", "own_"])
    same = [F.col(c) for c in (*by, "line_id", "cluster")]
    return first.where("size_ IS NULL").join(names, [*keys, "own_"]).select(*same, (F.col("turned_") != F.col("back_")).alias("turned"))


def split_bundles(clusters: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``by.., clusters, largest, split``: how many clusters a bundle has, the share of the largest, and whether there is more than one, so that one mean line can't stand for all."""
    by = by or ["subject", "bundle"]
    sizes = clusters.groupBy(*by, "cluster").agg(F.count("*").alias("n_"))
    return sizes.groupBy(*by).agg(F.count("*").alias("clusters"), (F.max("n_") / F.sum("n_")).alias("largest"), (F.count("*") > 1).alias("split"))
