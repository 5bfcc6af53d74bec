"""Connected components of edge tables, in rounds of aggregation and join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stash import stash, unstash

#: Edges, about, that a task joins in memory before the rounds (16 bytes each, and as much again several times).
MANY = 1 << 19


def stars(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """The smallest of the nodes ``0 .. n - 1`` that each of them reaches by the edges ``x, y``."""
    label = np.arange(n)
    while len(x):
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        on = low != high
        x, y = x[on], y[on]
        np.minimum.at(label, high[on], low[on])
        while (label != (up := label[label])).any():
            label = up
    return label


def joined(edges: DataFrame, by: list[str]) -> DataFrame:
    """Stars that join the same nodes as ``edges(by.., a, b)`` do, from blocks of about ``MANY`` edges, whatever their number."""
    parts = max(1, -(-edges.count() // MANY))

    def block(t: pa.Table) -> pa.Table:
        a, b = t["a"].to_numpy(), t["b"].to_numpy()
        group = np.zeros(len(a), np.int64)
        for c in by:
            code = t[c].combine_chunks().dictionary_encode("encode").indices.to_numpy()
            group = np.unique(group * (int(code.max()) + 1) + code, return_inverse=True)[1]
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        both, row, place = np.unique(np.concatenate([group, group]) * len(nodes) + at, return_index=True, return_inverse=True)
        label = stars(place[: len(a)], place[len(a) :], len(both))
        up = np.flatnonzero(label != np.arange(len(both)))
        ends = [pa.array(nodes[both[i] % len(nodes)]) for i in (up, label[up])]
        return pa.Table.from_arrays([*(t[c].take(pa.array(row[up] % len(a))) for c in by), *ends], [*by, "a", "b"]).combine_chunks()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held, size = [*held, batch], size + batch.num_rows
            if size >= MANY:
                yield from block(pa.Table.from_batches(held)).to_batches()
                held, size = [], 0
        if size:
            yield from block(pa.Table.from_batches(held)).to_batches()

    return edges.coalesce(parts).mapInArrow(work, edges.schema).distinct()


def components(edges: DataFrame, by: list[str] | None = None, rounds: int = 60) -> DataFrame:
    """``by.., node, root`` for each end of ``edges(by.., a, b)``: the smallest node that it reaches.

    Blocks of edges are joined to stars in the tasks first. What is left alternates Kiveris et al.'s large and small stars ("Connected components in MapReduce and
    beyond", 2014). A node's least neighbour comes from an aggregation and goes back by a join, so no
    task holds a node's whole neighbourhood in memory. The edges of a hub do stream through one task of that join
    unless Spark splits it as skewed. Each round ends in the shared folder; they end when the edges are stars
    around their smallest nodes. Rows that an earlier call returned may be among the edges, in place of those it read.
    """
    by = by or []

    def star(e: DataFrame) -> DataFrame:
        least = e.groupBy(*by, "a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        return e.join(least, [*by, "a"])

    def unfinished(e: DataFrame) -> bool:
        """Whether some node has two smaller neighbours, or a smaller and a larger one."""
        up = e.select(*by, F.col("a").alias("node"), "b")
        down = e.select(*by, F.col("b").alias("node"), F.lit(None).cast(e.schema["b"].dataType).alias("b"))
        ends = up.union(down).groupBy(*by, "node").agg(F.min("b").alias("x"), F.max("b").alias("y"), F.bool_or(F.col("b").isNull()).alias("centre"))
        return ends.where("x <> y OR (x IS NOT NULL AND centre)").limit(1).count() > 0

    raw = stash(edges.where("a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "edges")
    cur = stash(joined(raw, by), "edges")
    unstash(raw)
    for _ in range(rounds):
        if not unfinished(cur):
            break
        both = cur.select(*by, "a", "b").union(cur.select(*by, F.col("b").alias("a"), F.col("a").alias("b")))
        large = star(both).where("b > a").select(*by, F.col("b").alias("a"), F.col("m").alias("b"))
        small = star(large.where("a <> b"))
        small = small.select(*by, F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        cur, old = stash(small.where("a <> b").distinct(), "edges"), cur
        unstash(old)
    else:
        raise RuntimeError("components did not settle")
    return cur.select(*by, F.col("a").alias("node"), F.col("b").alias("root")).union(cur.select(*by, F.col("b"), F.col("b")).distinct())
