"""Sparse images as dense bricks, so that a point meets all cells around it in one row.

A brick holds 8 x 8 x 8 cells and those one step beyond its upper faces, as an array. Points and bricks
meet in one join by the brick's place, which Spark splits where one brick has most of the points; the
weights are worked out in the same stage, and no point becomes several rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.streams import by_group, changes
from .voxels import CELL, Shape

SIDE = 8
#: Cells of a brick with those beyond its faces, on an axis.
WIDE = SIDE + 1
PLACE = ["bx_", "by_", "bz_"]


def bricks(image: DataFrame, on: list[str]) -> DataFrame:
    """``on.., bx_, by_, bz_, cells`` of ``image(on.., x, y, z, value)``; absent cells and nulls are 0, the last of repeated cells counts.

    A cell on a brick's lower face goes to the brick below as well. The arrays are put together in the tasks, a batch of bricks at a time.
    """
    rows = image.select(*on, *CELL, F.col("value").cast("double").alias("value"))
    for c, b in zip(CELL, PLACE, strict=True):
        own = F.floor(F.col(c) / SIDE).cast("int")
        rows = rows.withColumn(b, F.explode(F.when(F.pmod(c, F.lit(SIDE)) == 0, F.array(own, own - 1)).otherwise(F.array(own))))
    at = [F.col(c) - SIDE * F.col(b) for c, b in zip(CELL, PLACE, strict=True)]
    rows = rows.select(*on, *PLACE, ((at[0] * WIDE + at[1]) * WIDE + at[2]).cast("int").alias("at_"), "value")
    keys = [*on, *PLACE]

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        begin = changes(table, keys)
        brick = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, table.num_rows)))
        dense = np.zeros((len(begin), WIDE**3))
        dense[brick, table.column("at_").to_numpy()] = table.column("value").fill_null(0.0).to_numpy()
        cells = pa.ListArray.from_arrays(pa.array(np.arange(len(begin) + 1, dtype=np.int32) * WIDE**3), pa.array(dense.ravel()))
        head = table.select(keys).take(pa.array(begin)).combine_chunks()
        yield from head.append_column("cells", cells).to_batches()

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("cells", T.ArrayType(T.DoubleType()))])
    return by_group(rows, keys, work, schema)


def placed(points: DataFrame, inside: Column) -> DataFrame:
    """Points with the place of the brick that has the cell below them; null outside."""
    return points.withColumns({b: F.when(inside, F.floor(F.floor(c) / SIDE).cast("int")) for c, b in zip(CELL, PLACE, strict=True)})


def beside(points: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    return points.join(table, [*on, *PLACE], "left")


def sample(points: DataFrame, table: DataFrame, shape: Shape, on: list[str]) -> DataFrame:
    """``points`` with ``sample``, linear between the eight cells around; 0 outside [0, n - 1] on any axis, and far from all cells.

    Cells of weight 0 don't count, whatever they hold. Points need no key, and may be repeated.
    """
    ok = reduce(lambda a, b: a & b, [(F.col(c) >= 0) & (F.col(c) <= n - 1) for c, n in zip(CELL, shape, strict=True)])
    low = {c: F.floor(c).cast("int") for c in CELL}
    first = [low[c] - SIDE * F.col(b) for c, b in zip(CELL, PLACE, strict=True)]
    both = beside(placed(points, ok), table, on).withColumn("at_", (first[0] * WIDE + first[1]) * WIDE + first[2])
    share = [F.col(c) - F.floor(c) for c in CELL]
    parts = []
    for i, j, k in np.ndindex(2, 2, 2):
        weight = reduce(lambda a, b: a * b, [s if o else 1 - s for s, o in zip(share, (i, j, k), strict=True)])
        parts.append(F.when(weight > 0, weight * F.get("cells", F.col("at_") + int((i * WIDE + j) * WIDE + k))).otherwise(0.0))
    return both.select(*points.columns, F.coalesce(reduce(lambda a, b: a + b, parts), F.lit(0.0)).alias("sample"))


def lookup(points: DataFrame, table: DataFrame, on: list[str], half: float = 0.0) -> DataFrame:
    """``points`` with ``value`` of the cell that they fall in by truncation; 0 where none is listed."""
    cell = {c: (F.col(c) + half).cast("int") for c in CELL}
    at = points.withColumns({f"c{c}_": cell[c] for c in CELL}).withColumns({b: F.floor(F.col(f"c{c}_") / SIDE).cast("int") for c, b in zip(CELL, PLACE, strict=True)})
    first = [F.col(f"c{c}_") - SIDE * F.col(b) for c, b in zip(CELL, PLACE, strict=True)]
    found = F.get("cells", (first[0] * WIDE + first[1]) * WIDE + first[2])
    return beside(at, table, on).select(*points.columns, F.coalesce(found, F.lit(0.0)).alias("value"))
