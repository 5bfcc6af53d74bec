"""Sorted rows in a task, a whole group at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def changes(table: pa.Table | pa.RecordBatch, keys: list[str]) -> np.ndarray:
    """Where rows begin whose keys differ from the row before; the first row is one."""
    new = np.zeros(table.num_rows, bool)
    if len(new):
        new[0] = True
    for k in keys:
        column = table.column(k)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        code = column.dictionary_encode(null_encoding="encode").indices.to_numpy()
        new[1:] |= code[1:] != code[:-1]
    return np.flatnonzero(new)


def own_places(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of consecutive groups of these sizes."""
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables that end where a group of equal keys does. A task holds a batch and one group at the most."""
    held: list[pa.RecordBatch] = []
    first = lambda b: [b.column(k)[0].as_py() for k in keys]
    for batch in batches:
        if not batch.num_rows:
            continue
        begin = int(changes(batch, keys)[-1])
        if held and begin == 0 and first(batch) == first(held[-1].slice(held[-1].num_rows - 1)):
            held.append(batch)
            continue
        if begin:
            held.append(batch.slice(0, begin))
        if held:
            yield pa.Table.from_batches(held).combine_chunks()
        held = [batch.slice(begin)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def by_group(df: DataFrame, keys: list[str], work: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: object, order: list[str] | None = None) -> DataFrame:
    """Runs ``work`` on tables of one or more whole groups, their rows by ``order``. One shuffle, and no call for each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, keys):
            yield from work(table)

    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)
