"""Overlap and angle scores as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import vec_cos, vec_norm

EPS = 1e-6


def count(c: Column) -> Column:
    return F.sum(F.coalesce(c.cast("int"), F.lit(0)))


def dice_of(both: Column, a: Column, b: Column) -> Column:
    return 2 * both / (a + b + F.lit(EPS))


def dice(df: DataFrame, by: list[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    """M1: from 0/1 columns."""
    p, t = F.col(pred) == 1, F.col(truth) == 1
    return df.groupBy(*by).agg(dice_of(count(p & t), count(p), count(t)).alias("dice"))


def dice_macro(df: DataFrame, classes: str, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """M2: mean over classes."""
    return dice(df, [classes], pred, truth).agg(F.avg("dice").alias("dice"))


def masks_joined(pred: DataFrame, truth: DataFrame, on: list[str]) -> DataFrame:
    """0/1 ``pred, truth`` by cell from two tables of set cells."""
    a, b = pred.select(*on).distinct().withColumn("pred", F.lit(1)), truth.select(*on).distinct().withColumn("truth", F.lit(1))
    return a.join(b, on, "full_outer").fillna(0, ["pred", "truth"])


def dice_per_bundle(df: DataFrame, pred: str = "pred", truth: str = "truth") -> DataFrame:
    """M3: F1 of each subject and bundle (0 where both are empty), averaged over subjects."""
    p, t = F.col(pred) == 1, F.col(truth) == 1
    size = count(p) + count(t)
    f1 = df.groupBy("subject", "bundle").agg(F.when(size > 0, 2 * count(p & t) / size).otherwise(0.0).alias("f1"))
    return f1.groupBy("bundle").agg(F.avg("f1").alias("f1"))


def soft_dice(df: DataFrame, by: list[str], classes: str, p: str = "prob", g: str = "truth") -> DataFrame:
    """M4: 1 - mean over classes of 2 sum(p g) / (sum(p + g) + eps), for each group of ``by`` (none: pooled)."""
    per = df.groupBy(*by, classes).agg((2 * F.sum(F.col(p) * F.col(g)) / (F.sum(F.col(p) + F.col(g)) + EPS)).alias("d_"))
    return per.groupBy(*by).agg((1 - F.avg("d_")).alias("soft_dice"))


def overlap_overreach(df: DataFrame, by: list[str], pred: str = "pred", truth: str = "truth") -> DataFrame:
    """M5: shares of the truth's size that are found, and that are found beside it; 0 without truth."""
    p, t = F.col(pred) == 1, F.col(truth) == 1
    n = count(t)
    return df.groupBy(*by).agg(F.when(n > 0, count(p & t) / n).otherwise(0.0).alias("overlap"), F.when(n > 0, count(p & ~t) / n).otherwise(0.0).alias("overreach"))


def abs_sum(v: str) -> Column:
    return F.aggregate(F.col(v), F.lit(0.0), lambda s, x: s + F.abs(x))


def signed_sum(v: str) -> Column:
    return F.aggregate(F.col(v), F.lit(0.0), lambda s, x: s + x)


def vector_dice_seg(df: DataFrame, by: list[str], pred: str = "pred", truth: str = "truth", thr: float = 0.2) -> DataFrame:
    """M6: Dice of where vectors are longer (by absolute sums) than thresholds."""
    marked = df.withColumns({"p_": (abs_sum(pred) > thr).cast("int"), "t_": (abs_sum(truth) > 1e-3).cast("int")})
    return dice(marked, by, "p_", "t_")


def vector_dice_angle(df: DataFrame, by: list[str], thresholds: list[float], pred: str = "pred", truth: str = "truth", length: float | None = None) -> DataFrame:
    """M7 and, with ``length``, M8: Dice of cells whose |cosine| exceeds each threshold (and whose lengths differ by under ``length`` of the truth's) with cells of truth."""
    near = F.abs(vec_cos(pred, truth))
    each = df.withColumn("thr", F.explode(F.array(*map(F.lit, thresholds))))
    ok = near > F.col("thr")
    if length is not None:
        ok = ok & (F.abs(vec_norm(pred) - vec_norm(truth)) < length * vec_norm(truth))
    marked = each.withColumns({"p_": ok.cast("int"), "t_": (signed_sum(truth) > 0).cast("int")})
    return dice(marked, ["thr", *by], "p_", "t_")


def vector_scores(df: DataFrame, by: list[str], pred: str = "pred", truth: str = "truth", weight: Column | None = None) -> DataFrame:
    """M9: evaluation forms of the angle, angle-and-length, squared and weighted squared losses."""
    cos = F.abs(vec_cos(pred, truth))
    off = F.abs(vec_norm(pred) - vec_norm(truth))
    square = F.aggregate(F.zip_with(pred, truth, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)
    w = F.lit(1.0) if weight is None else weight
    return df.groupBy(*by).agg(F.avg(1 - cos).alias("angle"), F.avg(1 - cos + off).alias("angle_length"), F.avg(square).alias("l2"), (F.avg(w * square) / 3).alias("mse_weighted"))


def epoch_summary(log: DataFrame) -> DataFrame:
    """Mean of batch metrics for each run, split, epoch and metric."""
    return log.groupBy("run", "split", "epoch", "metric").agg(F.avg("value").alias("mean"), F.count("*").alias("batches"))


def loss_weight(epoch: Column, start: float, end: float, epochs: int) -> Column:
    """A weight that goes linearly from ``start`` to ``end`` over ``epochs``, then stays."""
    return F.lit(start) + (end - start) * F.least(epoch / F.lit(float(epochs)), F.lit(1.0))


def compare_images(a: DataFrame, b: DataFrame, on: list[str], tol: float = 0.0) -> DataFrame:
    """Cells that differ by more than ``tol``, and the largest difference."""
    j = a.select(*on, F.col("value").alias("a_")).join(b.select(*on, F.col("value").alias("b_")), on, "full_outer").fillna(0.0, ["a_", "b_"])
    d = F.abs(F.col("a_") - F.col("b_"))
    return j.agg(count(d > tol).alias("differing"), F.max(d).alias("largest"))


def best_epoch(log: DataFrame, metric: str, mode: str = "max", least: float | None = None) -> DataFrame:
    """For each run the epoch with the best mean of ``metric`` on validation, the earliest of several; none under ``least``."""
    per = epoch_summary(log.where((F.col("metric") == metric) & (F.col("split") == "validate")))
    order = F.struct(-F.col("mean") if mode == "max" else F.col("mean"), F.col("epoch"))
    best = per.groupBy("run").agg(F.min_by("epoch", order).alias("epoch"), F.min_by("mean", order).alias("best"))
    return best if least is None else best.where(F.col("best") > least)
