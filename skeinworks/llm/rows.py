"""Filters of whole rows by their texts."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .columns import pieces, release


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Lets Spark hand over at most ``rows`` rows at a time: texts are long, and both sides hold a batch."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= rows:
        spark.conf.set(name, rows)


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within, Spark hands over at most ``rows`` rows at a time; the session's own setting comes back behind it."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, "10000")
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def kept(df: DataFrame, text_col: str, choose: Callable[[], Callable[[pa.Array], np.ndarray]], most: int = 2 << 20) -> DataFrame:
    """Rows of ``df``, all columns, for which the function that ``choose`` makes in a task says so. No shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        which = choose()
        for batch in pieces(batches, text_col, most):
            yield batch.filter(pa.array(which(batch.column(text_col)), pa.bool_()))

    return df.mapInArrow(work, df.schema)


def fitted(sample: DataFrame, fit: Callable[[pa.Table], object]) -> object:
    """What ``fit`` makes of a bounded sample, whose rows meet in one task: neither texts nor the fit take the driver's memory.

    ``sample`` ends in an ordered limit, so the task has its rows in that order; should its executor be
    lost, another one repeats it. The driver gets the pickled result alone.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(pa.Table.from_batches(held)))], pa.binary())], ["model"])
        del held
        release()

    got = sample.mapInArrow(work, "model binary").collect()
    return pickle.loads(got[0]["model"]) if got else None
