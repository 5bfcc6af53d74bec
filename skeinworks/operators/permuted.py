"""Statistics of permuted labels as matrix products, kept as extremes or as runs; no row of permutations x cells is made.

The labels are dealt out once, in tasks, and go along as a broadcast of checked size: where permutations x subjects exceed it, they come
in several passes. A task multiplies them with the values of some cells x subjects of checked size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.student import t_p_value
from ..plans.stash import stash
from ..plans.streams import by_group, changes

#: Bytes of labels that are broadcast, and of a task's cells x subjects; permutations that are multiplied at once.
LABELS, CELLS, PORTION = 64 << 20, 32 << 20, 256
#: Positions of a block of runs, and blocks that are merged at a time.
BLOCK, MERGED = 64, 64


def dealt(seed: int, perms: range, subjects: list[str], codes: np.ndarray) -> np.ndarray:
    """The labels' codes in some permutations, a row each, over ascending subjects, by the order of md5(seed:perm:subject)."""
    out = np.empty((len(perms), len(subjects)), codes.dtype)
    for row, perm in enumerate(perms):
        keys = [hashlib.md5(f"{seed}:{perm}:{s}".encode()).hexdigest() for s in subjects]
        out[row, sorted(range(len(subjects)), key=keys.__getitem__)] = codes
    return out


def label_passes(spark: SparkSession, rows: list[Row], nperm: int, seed: int) -> Iterator[tuple[int, object]]:
    """For each pass its first permutation and a broadcast: distinct labels, and the codes of each permutation."""
    subjects = [str(r[0]) for r in rows]
    labels, codes = np.unique(np.array([float(r[1]) for r in rows]), return_inverse=True)
    codes = codes.astype(np.uint8 if len(labels) <= 256 else np.int32)
    per = max(1, LABELS // max(1, len(rows) * codes.itemsize))
    known = spark.sparkContext.broadcast((subjects, codes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for perm in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([perm]), pa.array([dealt(seed, range(perm, perm + 1), *known.value).tobytes()], pa.binary())], ["perm", "codes"])

    for low in range(0, nperm, per):
        got = spark.range(low, min(nperm, low + per)).mapInArrow(deal, "perm long, codes binary").orderBy("perm").toArrow()
        yield low, spark.sparkContext.broadcast((labels, np.frombuffer(b"".join(got.column("codes").to_pylist()), codes.dtype).reshape(got.num_rows, len(rows))))


def centred(y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values less their cell's mean, 0 where a subject has none; and who has one."""
    have = np.isfinite(y)
    n = np.maximum(have.sum(1, keepdims=True), 1)
    filled = np.where(have, y, 0.0)
    return np.where(have, filled - filled.sum(1, keepdims=True) / n, 0.0), have.astype(float)


def permuted_t(labels: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Student's t for each permutation and cell; ``y`` is cells x subjects, NaN where a subject has no value."""
    y, have = centred(y)
    n = have.sum(1)[None]
    n1 = labels @ have.T
    n0 = n - n1
    s1 = labels @ y.T
    with np.errstate(divide="ignore", invalid="ignore"):
        ss = (y * y).sum(1)[None] - s1 * s1 / n1 - s1 * s1 / n0
        var = np.maximum(ss, 0) / (n - 2) * (1 / n0 + 1 / n1)
        t = (-s1 / n0 - s1 / n1) / np.sqrt(var)
    return np.where((n0 > 0) & (n1 > 0) & (n > 2) & (ss > 1e-18), t, np.nan)


def permuted_r(labels: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Pearson's r for each permutation and cell, likewise."""
    x = labels - labels.mean(1, keepdims=True)
    y, have = centred(y)
    with np.errstate(divide="ignore", invalid="ignore"):
        sx = x @ have.T
        xx = (x * x) @ have.T - sx * sx / have.sum(1)[None]
        return (x @ y.T) / np.sqrt(xx * (y * y).sum(1)[None])


def p_values(stat: np.ndarray, df: np.ndarray, mode: str) -> np.ndarray:
    if mode != "group":
        with np.errstate(divide="ignore", invalid="ignore"):
            stat = np.where(np.isnan(stat), np.nan, np.where(np.abs(stat) < 1, stat * np.sqrt(df / (1 - stat * stat)), np.inf))
    return t_p_value(stat, np.broadcast_to(df, stat.shape))


def cells_by_subjects(table: pa.Table, subjects: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Matrices of some rows of ``table`` (cells with ``v_``, a list of subjects and values) and where they begin."""
    rows = max(1, CELLS // (8 * max(1, len(subjects))))
    for at in range(0, table.num_rows, rows):
        lists = table.column("v_").slice(at, rows).combine_chunks()
        flat = lists.flatten()
        place = pc.index_in(flat.field("subject"), subjects)
        cell = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        known = place.is_valid().to_numpy(zero_copy_only=False)
        y = np.full((len(lists), len(subjects)), np.nan)
        y[cell[known], place.drop_null().to_numpy()] = flat.field("value").cast(pa.float64()).to_numpy(zero_copy_only=False)[known]
        yield at, y


def beside_row(table: pa.Table, keys: list[str], row: int, columns: dict[str, np.ndarray]) -> pa.RecordBatch:
    """``columns`` beside the keys of one row of ``table``."""
    n = len(next(iter(columns.values())))
    head = [table.column(k).slice(row, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for k in keys]
    return pa.RecordBatch.from_arrays([*head, *(pa.array(v) for v in columns.values())], [*keys, *columns])


def portions(shared: object, y: np.ndarray, mode: str) -> Iterator[tuple[int, np.ndarray]]:
    labels, codes = shared.value
    for at in range(0, len(codes), PORTION):
        x = labels[codes[at : at + PORTION]]
        yield at, permuted_t(x, y) if mode == "group" else permuted_r(x, y)


def gathered(values: DataFrame, by: list[str], value: str) -> DataFrame:
    return values.groupBy(*by).agg(F.collect_list(F.struct("subject", F.col(value).alias("value"))).alias("v_"))


def in_passes(packed: DataFrame, rows: list[Row], nperm: int, seed: int, run: Callable[[int, object], DataFrame]) -> DataFrame:
    parts = [run(low, shared) for low, shared in label_passes(packed.sparkSession, rows, nperm, seed)]
    return reduce(DataFrame.unionByName, parts)


def subject_array(rows: list[Row], values: DataFrame) -> pa.Array:
    kind = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64()}[dict(values.dtypes)["subject"]]
    return pa.array([r[0] for r in rows], kind)


def extremes(values: DataFrame, rows: list[Row], nperm: int, seed: int, mode: str, by: list[str], value: str, family: list[str]) -> DataFrame:
    """``family.., perm, df, stat_max, stat_min, abs_max``; an undefined statistic counts as 0."""
    packed = gathered(values, by, value).select(*family, "v_")
    subjects = subject_array(rows, values)

    def run(low: int, shared: object) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                table = pa.Table.from_batches([batch])
                code = np.zeros(table.num_rows, np.int64)
                for c in family:
                    own = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy()
                    code = np.unique(code * (int(own.max(initial=0)) + 1) + own, return_inverse=True)[1]
                for at, y in cells_by_subjects(table, subjects):
                    df = np.isfinite(y).sum(1) - 2
                    groups = np.stack([code[at : at + len(y)], df], axis=1)
                    kinds, first, of = np.unique(groups, axis=0, return_index=True, return_inverse=True)
                    for begin, stat in portions(shared, y, mode):
                        stat = np.where(np.isfinite(stat), stat, 0.0)
                        for k in range(len(kinds)):
                            own = stat[:, of.ravel() == k]
                            perm = np.arange(low + begin, low + begin + len(own), dtype=np.int32)
                            columns = {"perm": perm, "df": np.full(len(own), kinds[k][1], np.int32), "stat_max": own.max(1), "stat_min": own.min(1), "abs_max": np.abs(own).max(1)}
                            yield beside_row(table, family, at + int(first[k]), columns)

        schema = T.StructType([*(packed.schema[c] for c in family), T.StructField("perm", T.IntegerType()), T.StructField("df", T.IntegerType()), *(T.StructField(c, T.DoubleType()) for c in ("stat_max", "stat_min", "abs_max"))])
        return packed.mapInArrow(work, schema)

    parts = in_passes(packed, rows, nperm, seed, run)
    return parts.groupBy(*family, "perm", "df").agg(F.max("stat_max").alias("stat_max"), F.min("stat_min").alias("stat_min"), F.max("abs_max").alias("abs_max"))


def run_parts(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of hits the run at its begin, the one at its end, and the longest."""
    now = np.zeros(len(hit), np.int64)
    longest, prefix = now.copy(), now.copy()
    for k in range(hit.shape[1]):
        now = (now + 1) * hit[:, k]
        longest = np.maximum(longest, now)
        prefix = np.where(now == k + 1, now, prefix)
    return prefix, now, longest


def longest_runs(values: DataFrame, rows: list[Row], nperm: int, seed: int, mode: str, thr: float, value: str, family: list[str]) -> DataFrame:
    """``family.., perm, longest``: the longest run of consecutive positions with p < thr; a missing position or statistic ends a run.

    Blocks of ``BLOCK`` positions give the runs at their begin and end and the longest one, and such parts of neighbouring blocks make those of both:
    they are merged ``MERGED`` at a time. Permutations without any hit have no row.
    """
    packed = gathered(values.withColumn("block", F.floor(F.col("position") / BLOCK)), [*family, "block", "position"], value)
    span = packed.agg(F.min("block"), F.max("block")).first()
    packed, subjects = stash(packed, "cells"), subject_array(rows, values)
    parts = T.StructType([*(packed.schema[c] for c in [*family, "block"]), T.StructField("perm", T.IntegerType()), *(T.StructField(c, T.LongType()) for c in ("prefix", "suffix", "longest"))])

    def run(low: int, shared: object) -> DataFrame:
        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            begin = changes(table, [*family, "block"])
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), table.num_rows], strict=True):
                one = table.slice(a, b - a)
                place = one.column("position").to_numpy() - BLOCK * one.column("block")[0].as_py()
                hit = np.zeros((len(shared.value[1]), BLOCK), bool)
                for at, y in cells_by_subjects(one, subjects):
                    df = np.isfinite(y).sum(1) - 2
                    for first, stat in portions(shared, y, mode):
                        hit[first : first + len(stat), place[at : at + len(y)]] = p_values(stat, df[None].astype(float), mode) < thr
                prefix, suffix, longest = run_parts(hit)
                on = np.flatnonzero(longest)
                yield beside_row(one, [*family, "block"], 0, {"perm": (low + on).astype(np.int32), "prefix": prefix[on], "suffix": suffix[on], "longest": longest[on]})

        return by_group(packed, [*family, "block"], work, parts, ["position"])

    found, width = in_passes(packed, rows, nperm, seed, run), BLOCK
    low, high = (span[0], span[1]) if span[0] is not None else (0, 0)
    while low < high:
        found = merged(found, family, width)
        low, high, width = low // MERGED, high // MERGED, width * MERGED
    return found.select(*family, "perm", "longest")


def merged(parts: DataFrame, family: list[str], width: int) -> DataFrame:
    """The parts of ``MERGED`` neighbouring blocks of ``width`` positions as those of one."""
    next_ = "e.block = a.at + 1"
    step = f"""aggregate(items, named_struct('at', up * {MERGED} - 1, 'open', true, 'prefix', 0L, 'suffix', 0L, 'longest', 0L), (a, e) -> named_struct(
        'at', e.block, 'open', a.open AND {next_} AND e.prefix = {width}, 'prefix', a.prefix + IF(a.open AND {next_}, e.prefix, 0L),
        'suffix', IF(e.prefix = {width}, IF({next_}, a.suffix, 0L) + {width}L, e.suffix), 'longest', greatest(a.longest, e.longest, IF({next_}, a.suffix, 0L) + e.prefix)))"""
    together = parts.groupBy(*family, "perm", F.floor(F.col("block") / MERGED).alias("up")).agg(F.array_sort(F.collect_list(F.struct("block", "prefix", "suffix", "longest"))).alias("items"))
    out = together.withColumn("a", F.expr(step))
    return out.select(*family, F.col("up").alias("block"), "perm", "a.prefix", F.expr(f"IF(a.at = up * {MERGED} + {MERGED - 1}, a.suffix, 0L)").alias("suffix"), "a.longest")
