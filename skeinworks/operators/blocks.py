"""Neighbourhoods of masks in dense blocks: boxes that grow and wear, and blobs by tiles.

Cells are dealt to blocks of their image once. Inside a block numpy shifts and joins whole arrays, so an operator's reach
costs no rows; only what lies at a block's faces goes beyond it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.components import components, stars
from ..plans.stash import stash
from ..plans.streams import by_group, changes

CELL = ["x", "y", "z"]
PLACE = ["tx_", "ty_", "tz_"]
#: Sides of a block: of a box operator, whose blocks are dense and have what lies in reach besides; and of a tile of blobs.
BLOCK, TILE = 256, 64


def offsets(size: int) -> range:
    """A box of an even size reaches one step further up."""
    return range(-((size - 1) // 2), size // 2 + 1)


def shifted(block: np.ndarray, by: int, axis: int) -> np.ndarray:
    """``block`` moved along an axis; what comes in is False."""
    out = np.zeros_like(block)
    n = block.shape[axis]
    if abs(by) < n:
        cut = lambda a, b: tuple(slice(a, b) if k == axis else slice(None) for k in range(block.ndim))
        out[cut(max(by, 0), n + min(by, 0))] = block[cut(max(-by, 0), n - max(by, 0))]
    return out


def grown(block: np.ndarray, size: int) -> np.ndarray:
    for axis in range(3):
        block = reduce(np.logical_or, (shifted(block, o, axis) for o in offsets(size)))
    return block


def worn(block: np.ndarray, size: int) -> np.ndarray:
    for axis in range(3):
        block = reduce(np.logical_and, (shifted(block, -o, axis) for o in offsets(size)))
    return block


def boxed(mask: DataFrame, steps: list[tuple[str, int]], shape: tuple[int, int, int], side: int = BLOCK) -> DataFrame:
    """``mask(keys.., x, y, z)`` after ``steps`` of growing ("grow", size) and wearing ("wear", size) by cubes; outside the grid nothing is set.

    Images of at most ``side`` on each axis are one block. Blocks of larger ones also get the cells that the steps together can reach. One shuffle of the mask's cells.
    """
    keys = [c for c in mask.columns if c not in CELL]
    reach = sum(size for _, size in steps)
    rows = mask.where(reduce(lambda a, b: a & b, [(F.col(c) >= 0) & (F.col(c) < n) for c, n in zip(CELL, shape, strict=True)]))
    for c, t, n in zip(CELL, PLACE, shape, strict=True):
        last = (n - 1) // side
        near = lambda d, c=c: F.floor((F.col(c) + d) / side).cast("int")
        rows = rows.withColumn(t, F.explode(F.sequence(F.greatest(near(-reach), F.lit(0)), F.least(near(reach), F.lit(last)))) if last else F.lit(0))
    columns = mask.columns
    schema = T.StructType([T.StructField(c, T.IntegerType()) if c in CELL else mask.schema[c] for c in columns])
    rows = rows.select(*keys, *(F.col(c).cast("int").alias(c) for c in CELL), *PLACE)

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        begin = changes(table, [*keys, *PLACE])
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), table.num_rows], strict=True):
            one = table.slice(a, b - a)
            tile = [one.column(t)[0].as_py() for t in PLACE]
            low = [max(0, t * side - reach) for t in tile]
            high = [min(n, (t + 1) * side + reach) for t, n in zip(tile, shape, strict=True)]
            block = np.zeros([h - lo for lo, h in zip(low, high, strict=True)], bool)
            block[tuple(one.column(c).to_numpy() - lo for c, lo in zip(CELL, low, strict=True))] = True
            for kind, size in steps:
                block = grown(block, size) if kind == "grow" else worn(block, size)
            core = tuple(slice(t * side - lo, min(n, (t + 1) * side) - lo) for t, lo, n in zip(tile, low, shape, strict=True))
            at = np.nonzero(block[core])
            head = one.slice(0, 1).take(pa.array(np.zeros(len(at[0]), np.int32)))
            cells = {c: pa.array((v + t * side).astype(np.int32)) for c, v, t in zip(CELL, at, tile, strict=True)}
            out = pa.Table.from_arrays([cells[c] if c in cells else head.column(c) for c in columns], columns)
            yield from out.combine_chunks().to_batches(max_chunksize=1 << 17)

    return by_group(rows, [*keys, *PLACE], work, schema)


def tile_labels(mask: DataFrame, shape: tuple[int, int, int], by: list[str], side: int = TILE) -> DataFrame:
    """``by.., x, y, z, node, tile``: ``node`` is the cell's place in its image by x, y, z, ``tile`` that of the first cell that faces connect it to inside its tile."""
    places = {t: F.floor(F.col(c) / side).cast("int") for c, t in zip(CELL, PLACE, strict=True)}
    node: Column = (F.col("x").cast("long") * shape[1] + F.col("y")) * shape[2] + F.col("z")
    rows = mask.select(*by, *CELL).withColumns(places).withColumn("node", node)
    keys = [*by, *PLACE]

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        begin = changes(table, keys)
        group = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, table.num_rows)))
        own = [table.column(c).to_numpy().astype(np.int64) % side for c in CELL]
        at, first, place = np.unique(((group * side + own[0]) * side + own[1]) * side + own[2], return_index=True, return_inverse=True)
        a, b = [], []
        for k, step in enumerate((side * side, side, 1)):
            inner = np.flatnonzero(own[k][first] + 1 < side)
            there = np.searchsorted(at, at[inner] + step)
            hit = (there < len(at)) & (at[np.minimum(there, len(at) - 1)] == at[inner] + step)
            a.append(inner[hit])
            b.append(there[hit])
        label = stars(np.concatenate(a), np.concatenate(b), len(at))
        tile = table.column("node").to_numpy()[first][label]
        out = table.select([*by, *CELL, "node"]).take(pa.array(first)).append_column("tile", pa.array(tile))
        yield from out.combine_chunks().to_batches()

    schema = T.StructType([*(rows.schema[k] for k in [*by, *CELL]), T.StructField("node", T.LongType()), T.StructField("tile", T.LongType())])
    return by_group(rows, keys, work, schema)


def face_edges(labelled: DataFrame, by: list[str], side: int = TILE) -> DataFrame:
    """``by.., a, b``: the tiles' blobs that touch across a face between two tiles, once each."""
    on = [*by, "axis_", *CELL]
    ups, downs = [], []
    for k, c in enumerate(CELL):
        axis = F.lit(k).alias("axis_")
        ups.append(labelled.where(F.pmod(c, F.lit(side)) == side - 1).select(*by, axis, *((F.col(d) + int(d == c)).alias(d) for d in CELL), F.col("tile").alias("a")))
        downs.append(labelled.where(F.pmod(c, F.lit(side)) == 0).select(*by, axis, *CELL, F.col("tile").alias("b")))
    up, down = (reduce(DataFrame.unionByName, x) for x in (ups, downs))
    return up.join(down, on).select(*by, "a", "b").distinct()


def blobs(mask: DataFrame, shape: tuple[int, int, int], by: list[str], side: int = TILE) -> DataFrame:
    """``by.., x, y, z, node, blob``: distinct cells with the first cell, in x, y, z order, that faces connect them to.

    Each tile is labelled in a task, a batch of tiles at a time. Only blobs that touch at faces between tiles become edges, whose
    components join their labels; an image that is one tile has none.
    """
    own = tile_labels(mask, shape, by, side)
    if all(n <= side for n in shape):
        return own.withColumnRenamed("tile", "blob")
    own = stash(own, "tiles")
    roots = components(face_edges(own, by, side), by).where("node <> root").withColumnRenamed("node", "tile")
    return own.join(roots, [*by, "tile"], "left").select(*by, *CELL, "node", F.coalesce("root", "tile").alias("blob"))
