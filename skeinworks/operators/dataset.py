"""Folds, seeded sampling, augmentation and batch scoring of voxel tables."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import _euler, flip_component, let, rotate_euler, rotate_tensor, tensor_to_vec, unit_hash, vec_norm, vec_to_tensor
from ..plans.stash import numbered, stash
from ..plans.streams import by_group, changes
from . import voxels as V
from .voxels import CELL, IMAGE


def fold_split(subjects: DataFrame, size: int, folds: int = 5, turn: int = 0) -> DataFrame:
    """Chunks of ``size`` in the order of ids; with ``turn`` k, chunk (k + 3) mod 5 validates, (k + 4) mod 5 tests, the rest train."""
    fold = F.least(F.floor((F.col("k_") - 1) / size), F.lit(folds - 1)).cast("int")
    part = F.pmod(F.col("fold") - turn, F.lit(folds))
    ranked = numbered(subjects.select("subject").distinct(), ["subject"], "k_").withColumn("fold", fold).drop("k_")
    return ranked.withColumn("part", F.when(part == folds - 2, "validate").when(part == folds - 1, "test").otherwise("train"))


def prefix_split(subjects: DataFrame, share: float) -> DataFrame:
    """The first ``share`` of the subjects train, the others validate."""
    ranked = numbered(subjects.select("subject").distinct(), ["subject"], "k_")
    return ranked.select("subject", F.when(F.col("k_") <= math.floor(ranked.count() * share), "train").otherwise("validate").alias("part"))


def choose_variant(df: DataFrame, weights: dict[str, float], seed: int, key: str = "subject") -> DataFrame:
    """One variant for each subject, drawn with the weights by its hash."""
    u = unit_hash(str(seed), F.col(key))
    total, run, pick = sum(weights.values()), 0.0, None
    for name, w in weights.items():
        run += w / total
        pick = F.when(u < run, name) if pick is None else pick.when(u < run, name)
    return df.withColumn("variant", pick.otherwise(list(weights)[-1]))


def sample_with_replacement(mask: DataFrame, n: int, seed: int, by: list[str]) -> DataFrame:
    """``n`` cells of each group, drawn with replacement: draw i takes the cell of rank floor(u * count)."""
    w = Window.partitionBy(*by).orderBy(*CELL)
    ranked = mask.withColumn("rank", F.row_number().over(w) - 1)
    draws = mask.groupBy(*by).agg(F.count("*").alias("n_")).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rank = F.floor(unit_hash(str(seed), F.concat_ws(":", *by), F.col("draw")) * F.col("n_")).cast("int")
    return draws.withColumn("rank", rank).join(ranked, [*by, "rank"]).select(*by, "draw", *CELL)


def jittered(df: DataFrame, seed: int, key: list[str], sigma: float = 0.15) -> DataFrame:
    """Normal noise of ``sigma`` on each axis, by Box and Muller from two hashes."""
    def noise(c: str) -> Column:
        u, v = (unit_hash(str(seed), c, k, F.concat_ws(":", *key)) for k in ("r", "a"))
        return F.col(c) + sigma * F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * math.pi * v)

    return df.withColumns({c: noise(c) for c in CELL})


def sample_without_replacement(df: DataFrame, n: int, seed: int, by: list[str], key: list[str]) -> DataFrame:
    """Up to ``n`` rows of each group, those with the smallest hashes."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in key)))
    w = Window.partitionBy(*by).orderBy(h, *key)
    return df.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= n).drop("r_")


@F.pandas_udf(T.LongType())
def _ordered(v: pd.Series) -> pd.Series:
    """Whole numbers in the order of the doubles; -0.0 as 0.0."""
    bits = (v.to_numpy(np.float64) + 0.0).view(np.int64)
    return pd.Series(np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits))


@F.pandas_udf(T.DoubleType())
def _double(v: pd.Series) -> pd.Series:
    u = v.to_numpy(np.int64)
    return pd.Series(np.where(u < 0, u ^ np.int64(0x7FFFFFFFFFFFFFFF), u).view(np.float64))


def order_statistics(df: DataFrame, by: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """``by.., t, value``: of each row of ``ranks(by.., t, k)`` the group's value of rank ``k``, from 0, exactly.

    Values as whole numbers are narrowed 16 bits a round, for all groups and ranks at once: counts by those bits, of the values whose
    higher bits are wanted, add up to the bits of each rank. No task has more of a group than 65,536 counts a rank.
    """
    rows = df.select(*by, _ordered(F.col(value).cast("double")).alias("u_"))
    state = stash(ranks.select(*by, "t", F.col("k").cast("long").alias("k"), F.lit(0).cast("long").alias("high_")), "ranks")
    for shift in (48, 32, 16, 0):
        bits = F.shiftright("u_", shift).alias("bits_")
        cut = rows.select(*by, bits)
        if shift < 48:
            wanted = state.select(*by, "high_").distinct()
            cut = cut.withColumn("high_", F.shiftright("bits_", 16)).join(wanted, [*by, "high_"], "left_semi")
        counts = cut.groupBy(*by, "bits_").agg(F.count("*").alias("n_")).withColumn("high_", F.shiftright("bits_", 16) if shift < 48 else F.lit(0).cast("long"))
        upto = F.sum("n_").over(Window.partitionBy(*by, "t").orderBy("bits_"))
        placed = counts.join(state, [*by, "high_"]).withColumn("upto_", upto).where((F.col("upto_") > F.col("k")) & (F.col("upto_") - F.col("n_") <= F.col("k")))
        state = stash(placed.select(*by, "t", (F.col("k") - F.col("upto_") + F.col("n_")).alias("k"), F.col("bits_").alias("high_")), "ranks")
    return state.select(*by, "t", _double("high_").alias("value"))


def quantile_band(df: DataFrame, by: list[str], lo: float = 0.02, hi: float = 0.98, value: str = "value") -> DataFrame:
    """``by.., low, high``: exact quantiles, linear between neighbouring values. Nulls and NaN don't count. A group may have any number of values."""
    some = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    sizes = stash(some.groupBy(*by).agg((F.count("*") - 1).alias("n_")), "sizes")
    place = {"low": F.col("n_") * lo, "high": F.col("n_") * hi}
    wanted = F.explode(F.array(*(F.struct(F.lit(f"{q}{side}").alias("t"), f(p).alias("k")) for q, p in place.items() for side, f in (("0", F.floor), ("1", F.ceil)))))
    found = order_statistics(some, by, value, sizes.select(*by, wanted.alias("w_")).select(*by, "w_.t", "w_.k"))
    wide = found.groupBy(*by).agg(*(F.max(F.when(F.col("t") == t, F.col("value"))).alias(t) for t in ("low0", "low1", "high0", "high1"))).join(sizes, by)
    between = lambda q: F.col(f"{q}0") + (F.col(f"{q}1") - F.col(f"{q}0")) * (place[q] - F.floor(place[q]))
    return wide.select(*by, between("low").alias("low"), between("high").alias("high"))


def load_dyads(d1: DataFrame, d2: DataFrame, d3: DataFrame | None, fractions: list[DataFrame], shape: tuple[int, int, int], flip_x: bool = True) -> DataFrame:
    """Two or three vector images, each times its fraction image, as one array of nine; absent is 0."""
    on = ["subject", *CELL]
    zero = F.array(*(F.lit(0.0) for _ in range(3)))
    out = None
    for k, (d, f) in enumerate(zip((d1, d2, d3), [*fractions, None][:3], strict=True)):
        if d is None:
            continue
        one = d.join(f.select(*on, F.col("value").alias("f_")), on, "left").select(*on, F.transform("v", lambda x: x * F.coalesce(F.col("f_"), F.lit(0.0))).alias(f"v{k}"))
        out = one if out is None else out.join(one, on, "full_outer")
    if d3 is None:
        out = out.withColumn("v2", zero)
    v = F.concat(*(F.coalesce(f"v{k}", zero) for k in range(3)))
    out = out.select(*on, (flip_component(v, 0) if flip_x else v).alias("v"))
    return V.flip_grid(out, [0], shape) if flip_x else out


def check_completeness(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Expected (subject, file) pairs that aren't there."""
    return expected.join(actual.select("subject", "file").distinct(), ["subject", "file"], "left_anti")


def prepare_dataset(raw: DataFrame, reference: str) -> DataFrame:
    """NaN to 0, the box of one image (``image`` = ``reference``) of each subject, all its images cropped to that."""
    filled = V.fill_nan(raw)
    box = V.bbox(filled.where(F.col("image") == reference), ["subject"])
    return V.crop(filled, box, ["subject"]).where(F.col("value") != 0).withColumn("channel", F.lit(0))


def training_slices(df: DataFrame, k: int, axis: str, seed: int) -> DataFrame:
    """The cells of ``k`` slices of each subject, drawn by hash."""
    some = sample_without_replacement(df.select("subject", axis).distinct(), k, seed, ["subject"], ["subject", axis])
    return df.join(some, ["subject", axis], "left_semi")


def augment_flip_vectors(df: DataFrame, seed: int, p: float = 0.5, key: str = "subject", v: str = "v") -> DataFrame:
    """D3: one axis for each batch (column ``batch``); each sample's vectors are negated on it with chance ``p``."""
    axis = F.floor(unit_hash(str(seed), "axis", F.col("batch")) * 3).cast("int")
    on = unit_hash(str(seed), "flip", F.col(key)) < p
    return df.withColumn(v, F.when(on, F.transform(v, lambda x, i: F.when(i % 3 == axis, -x).otherwise(x))).otherwise(F.col(v)))


def augment_rotate_vectors(df: DataFrame, seed: int, limit: float, key: str = "subject", v: str = "v") -> DataFrame:
    """One angle in [-limit, limit] for each sample, about z, on all its vectors."""
    angle = (unit_hash(str(seed), "angle", F.col(key)) * 2 - 1) * limit
    return df.withColumn(v, rotate_euler(v, F.lit(0.0), F.lit(0.0), -angle))


def augment_rotate_tensors(df: DataFrame, seed: int, limit: float, key: str = "subject", t: str = "t") -> DataFrame:
    """D4 on flat tensors."""
    angle = (unit_hash(str(seed), "angle", F.col(key)) * 2 - 1) * limit
    return df.withColumn(t, rotate_tensor(t, _euler(F.lit(0.0), F.lit(0.0), -angle)))


def augment_noise(df: DataFrame, seed: int, most: float = 0.05, key: str = "subject") -> DataFrame:
    """Normal noise whose variance is drawn for each sample from (0, ``most``)."""
    var = unit_hash(str(seed), "var", F.col(key)) * most
    u, a = (unit_hash(str(seed), k, F.concat_ws(":", F.col(key), *CELL)) for k in "ua")
    normal = F.sqrt(-2 * F.log(F.greatest(u, F.lit(1e-12)))) * F.cos(2 * math.pi * a)
    return df.withColumn("value", F.col("value") + F.sqrt(var) * normal)


def augment_mirror(df: DataFrame, seed: int, shape: tuple[int, int, int], key: str = "subject") -> DataFrame:
    """Each axis of a sample is turned round with chance one half."""
    return df.withColumns({c: F.when(unit_hash(str(seed), c, F.col(key)) < 0.5, n - 1 - F.col(c)).otherwise(F.col(c)) for c, n in zip(CELL, shape, strict=True)})


def augment_downsample(df: DataFrame, shape: tuple[int, int, int], zoom: float) -> DataFrame:
    """Nearest down by ``zoom`` and up again."""
    low = tuple(max(1, round(n * zoom)) for n in shape)
    return V.resample_nearest(V.resample_nearest(df, shape, low), low, shape)


def sample_seed(seed: int, subject: object, direction: int, index: int, sample: int) -> int:
    """A number under 2^32 for one sample of one slice: the same in every run and partitioning."""
    return int(hashlib.md5(f"{seed}:{subject}:{direction}:{index}:{sample}".encode()).hexdigest()[:8], 16)


def batch_score(df: DataFrame, model: Callable, axes: tuple[str, ...] = ("x", "y", "z"), samples: int = 1, seed: int | None = None) -> DataFrame:
    """Runs ``model(pandas frame of one slice) -> frame with bundle, x, y, z, prob`` on every slice of each axis.

    Out: ``subject, bundle, x, y, z, direction (1, 2, 3), sample, prob``. The slices of all axes are dealt out in one shuffle, and a task holds a few at a time.
    With a ``seed`` the model is called as ``model(frame, seed=..)``, each sample of a slice with a :func:`sample_seed` of its own, so that samples differ and can be repeated.
    """
    sides = F.array(*(F.struct(F.lit(k).alias("direction_"), F.col(axis).cast("int").alias("index_")) for k, axis in enumerate(axes, 1)))
    rows = df.select("*", F.inline(sides))
    keys = ["subject", "direction_", "index_"]
    names = ["subject", "bundle", *CELL, "direction", "sample", "prob"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    schema = T.StructType([df.schema["subject"], T.StructField("bundle", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in [*CELL, "direction", "sample"]), T.StructField("prob", T.DoubleType())])

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        begin = changes(table, keys)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), table.num_rows], strict=True):
            one = table.slice(a, b - a)
            subject, direction, index = (one.column(c)[0].as_py() for c in keys)
            frame = one.drop_columns(["direction_", "index_"]).to_pandas()
            for s in range(samples):
                got = model(frame) if seed is None else model(frame, seed=sample_seed(seed, subject, direction, index, s))
                got = got.assign(direction=direction, sample=s)
                head = one.column("subject").combine_chunks().take(pa.array(np.zeros(len(got), np.int64)))
                yield pa.RecordBatch.from_arrays([head, *(pa.array(got[c], k) for c, k in zip(names[1:], kinds, strict=True))], names)

    return by_group(rows, keys, work, schema)


def mean_fusion(pred: DataFrame, thr: float = 0.5, probs: bool = False, directions: int = 3, by: list[str] | None = None) -> DataFrame:
    """A1: mean over directions, absent ones counting 0; binary with >= unless ``probs``."""
    fused = pred.groupBy(*(by or [*IMAGE, *CELL])).agg((F.sum("prob") / directions).alias("value"))
    return fused if probs else fused.withColumn("value", (F.col("value") >= thr).cast("int"))


def majority_fusion(pred: DataFrame, thr: float = 0.5, by: list[str] | None = None) -> DataFrame:
    """A2: 1 where at least two directions reach ``thr``."""
    return pred.groupBy(*(by or [*IMAGE, *CELL])).agg((F.sum((F.col("prob") >= thr).cast("int")) >= 2).cast("int").alias("value"))


def mean_fusion_vectors(pred: DataFrame, by: list[str], v: str = "v") -> DataFrame:
    """A3: the main axis of the mean of the vectors' outer products."""
    t = pred.withColumn("t_", vec_to_tensor(v)).groupBy(*by).agg(F.array(*(F.avg(F.col("t_")[k]) for k in range(6))).alias("t_"))
    # An outer product has a vector's squared length as eigenvalue.
    top = let(tensor_to_vec("t_", 0.0), lambda w: F.transform(w, lambda x: x / F.sqrt(vec_norm(w) + 1e-20)))
    return t.withColumn(v, top).drop("t_")


def uncertainty(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """A4: population standard deviation over stochastic samples."""
    return pred.groupBy(*(by or [*IMAGE, *CELL])).agg(F.stddev_pop("prob").alias("value"))


def segment(raw: DataFrame, model: Callable, shape: tuple[int, int, int], target: int, bundles_rules: dict | None = None, blob_thr: int = 50, hole_size: int | None = None, crop: bool = True) -> DataFrame:
    """NaN to 0, crop, square, score on three axes, fuse, bundle rules, undo scaling and crop, remove small blobs. One plan for all subjects.

    All subjects are cropped to one box, that of all cells that aren't 0: six numbers reach the driver. Without such cells there is no mask.
    """
    filled = V.fill_nan(raw)
    low, size = (0, 0, 0), shape
    if crop:
        ends = filled.where("value <> 0").agg(*(f(c).alias(f"{n}{c}") for c in CELL for f, n in ((F.min, "lo"), (F.max, "hi")))).first()
        if ends["lox"] is not None:
            low = tuple(ends[f"lo{c}"] for c in CELL)
            size = tuple(ends[f"hi{c}"] - ends[f"lo{c}"] + 1 for c in CELL)
    inner = filled.where(reduce(lambda a, b: a & b, [F.col(c).between(lo, lo + n - 1) for c, lo, n in zip(CELL, low, size, strict=True)]))
    moved = inner.withColumns({c: F.col(c) - lo for c, lo in zip(CELL, low, strict=True)})
    square, how = V.square_and_scale(moved, size, target)
    fused = mean_fusion(batch_score(square, model), probs=True)
    masks = V.unscale(V.bundle_specific_postprocess(fused, (target,) * 3, bundles_rules), how)
    back = masks.withColumns({c: (F.col(c) + lo).cast("int") for c, lo in zip(CELL, low, strict=True)})
    return V.postprocess(back, blob_thr, shape, hole_size)


def multi_part(df: DataFrame, parts: dict[str, list[str]], run: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Runs bundles part by part and stacks the results with running channel numbers."""
    out, offset = [], 0
    for names in parts.values():
        found = run(df.where(F.col("bundle").isin(names)))
        channel = F.array_position(F.array(*map(F.lit, names)), F.col("bundle")) - 1 + offset
        out.append(found.withColumn("channel", channel.cast("int")))
        offset += len(names)
    return reduce(lambda a, b: a.unionByName(b), out)


def fit_tensor(signal: DataFrame, gradients: list[tuple[float, float, float, float]], by: list[str]) -> DataFrame:
    """Diffusion tensors by least squares on log signals: ``by.., t``. ``signal`` has ``idx, value``; gradients (b, x, y, z) by idx.

    The design is shared, so its pseudo-inverse (7 x directions) is a small table and the fit a weighted sum.
    """
    b, g = np.array(gradients)[:, 0], np.array(gradients)[:, 1:]
    x = np.column_stack([-b * g[:, i] * g[:, j] * (1 if i == j else 2) for i in range(3) for j in range(i, 3)] + [np.ones(len(b))])
    inverse = np.linalg.pinv(x)[:6]
    w = signal.sparkSession.createDataFrame([(i, [float(v) for v in inverse[:, i]]) for i in range(len(b))], "idx int, w array<double>")
    y = F.log(F.greatest(F.col("value"), F.lit(1e-6)))
    return signal.join(F.broadcast(w), "idx").groupBy(*by).agg(F.array(*(F.sum(F.col("w")[k] * y) for k in range(6))).alias("t"))


def weighted_tensors(y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Coefficients of each row of log signals (NaN where missing) on the design ``x``: least squares, then once more weighted by the squares of the fitted signals."""
    have = np.isfinite(y)
    filled = np.where(have, y, 0.0)
    weight = have.astype(float)
    for last in (False, True):
        normal = np.einsum("nd,di,dj->nij", weight, x, x)
        beta = (np.linalg.pinv(normal, rcond=1e-12, hermitian=True) @ np.einsum("nd,di,nd->ni", weight, x, filled)[..., None])[..., 0]
        if not last:
            log = beta @ x.T
            log = np.where(have, log, -np.inf)
            # only the weights' proportions matter
            weight = np.exp(2 * (log - np.maximum(log.max(axis=1, keepdims=True), -700.0)))
    return beta


def fit_tensor_weighted(signal: DataFrame, gradients: list[tuple[float, float, float, float]], by: list[str]) -> DataFrame:
    """G19, weighted: ``by.., t, s0``. Directions that a cell lacks count for nothing; values under 1e-6 as that.

    A cell's values come together once, one for each direction at most, and the tasks solve batches of 7 x 7 normal equations.
    """
    b, g = np.array(gradients)[:, 0], np.array(gradients)[:, 1:]
    x = np.column_stack([-b * g[:, i] * g[:, j] * (1 if i == j else 2) for i in range(3) for j in range(i, 3)] + [np.ones(len(b))])
    packed = signal.where(F.col("idx").between(0, len(b) - 1)).groupBy(*by).agg(F.collect_list(F.struct("idx", F.col("value").cast("double").alias("value"))).alias("v_"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v_")
            flat = lists.flatten()
            y = np.full((len(lists), len(b)), np.nan)
            value = flat.field("value").to_numpy(zero_copy_only=False)
            y[np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy()), flat.field("idx").to_numpy()] = np.log(np.maximum(value, 1e-6))
            beta = weighted_tensors(y, x)
            tensors = pa.ListArray.from_arrays(pa.array(np.arange(len(beta) + 1, dtype=np.int32) * 6), pa.array(beta[:, :6].ravel()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in by), tensors, pa.array(np.exp(beta[:, 6]))], [*by, "t", "s0"])

    schema = T.StructType([*(packed.schema[c] for c in by), T.StructField("t", T.ArrayType(T.DoubleType())), T.StructField("s0", T.DoubleType())])
    return packed.mapInArrow(work, schema)
