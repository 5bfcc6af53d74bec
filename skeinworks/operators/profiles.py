"""Scalar profiles along bundles of polylines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import vec_cos, vec_norm
from ..plans.stash import stash
from . import lines as L
from .bricks import bricks
from .voxels import CELL, dilate

BUNDLE = ["subject", "bundle"]


def means(df: DataFrame, by: list[str], value: str = "sample") -> DataFrame:
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.count("*").alias("n"))


def profile(lines: DataFrame, image: DataFrame, starts: DataFrame, shape: tuple[int, int, int], n: int = 100, method: str = "distance_map", dilation: int = 2, least: int = 5, trim: bool = True, bundles: DataFrame | None = None, image_on: list[str] | None = None) -> DataFrame:
    """``subject, bundle, position, mean, std, n``: the image sampled along each bundle's lines.

    Lines are turned to begin in the grown start cells, resampled to ``n`` points and sampled linearly.
    ``distance_map``: each point counts for the nearest of the ``n`` points of the bundle's mean line; a
    segment without points gets the image at that point of the line, with n = 0. ``equal_dist``: by
    index. ``cutting_plane``: lines resampled at one step and aligned at the point nearest to the
    mean line's middle. ``weighted``: Gaussian weights by distance from the mean point of each index.
    ``image_on`` are the columns besides the cell that image and lines share ([]: one image for all).
    A bundle of ``bundles`` (or of ``lines``) with fewer lines than ``least`` has a profile of zeros. ``trim``
    drops the first and last position and counts from 0 again.
    """
    everyone = (bundles or lines).select(*BUNDLE).distinct()
    grown = dilate(starts.select(*BUNDLE, *CELL), dilation, shape)
    oriented = L.orient_to_start(lines, grown, shape)
    enough = oriented.groupBy(*BUNDLE).agg(F.count("*").alias("k_")).where(F.col("k_") >= least).select(*BUNDLE)
    even = stash(L.resample(oriented.join(enough, BUNDLE, "left_semi"), n), "even")
    points = L.explode_points(even)
    core = L.centroid(even)
    image = stash(bricks(image, ["subject"] if image_on is None else image_on), "bricks")
    if method == "cutting_plane":
        found = cutting_plane(oriented.join(enough, BUNDLE, "left_semi"), core, image, shape, n, image_on)
    else:
        sampled = L.sample_trilinear(points, image, shape, image_on)
        if method == "equal_dist":
            found = means(sampled.withColumnRenamed("pos", "position"), [*BUNDLE, "position"])
        elif method == "weighted":
            found = weighted_means(sampled)
        else:
            near = L.nearest_point(sampled, core)
            seg = means(near.withColumnRenamed("segment", "position"), [*BUNDLE, "position"])
            at_core = L.sample_trilinear(core, image, shape, image_on).select(*BUNDLE, F.col("pos").alias("position"), F.col("sample"))
            found = at_core.join(seg, [*BUNDLE, "position"], "left").select(*BUNDLE, "position", F.coalesce("mean", "sample").alias("mean"), F.coalesce("std", F.lit(0.0)).alias("std"), F.coalesce("n", F.lit(0)).alias("n"))
    grid = everyone.withColumn("position", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    full = grid.join(found, [*BUNDLE, "position"], "left").fillna(0.0, ["mean", "std"]).fillna(0, ["n"])
    if trim:
        full = full.where((F.col("position") > 0) & (F.col("position") < n - 1)).withColumn("position", F.col("position") - 1)
    return full.select(*BUNDLE, "position", "mean", "std", "n")


def equal_dist_profile(points: DataFrame, value: str = "sample") -> DataFrame:
    """T-2: mean and std by point index."""
    return means(points.withColumnRenamed("pos", "position"), [*BUNDLE, "position"], value)


def segment_index_from_middle(points: DataFrame, target: DataFrame, n: int, base: int = 1000) -> DataFrame:
    """``segment`` counts from each line's point closest to the bundle's target; within n / 2 of it."""
    middle = L.closest_to_target(points, target)
    idx = points.join(middle, L.LINE).withColumn("segment", F.col("pos") - F.col("middle") + base).drop("middle")
    return idx.where((F.col("segment") >= base - n // 2) & (F.col("segment") < base + n - n // 2))


def cutting_plane(lines: DataFrame, core: DataFrame, image: DataFrame, shape: tuple[int, int, int], n: int, image_on: list[str] | None = None) -> DataFrame:
    points = L.explode_points(L.resample_same_step(lines, n))
    target = core.where(F.col("pos") == n // 2).drop("pos")
    cut = segment_index_from_middle(L.sample_trilinear(points, image, shape, image_on), target, n)
    return means(cut.withColumn("position", F.col("segment") - 1000 + n // 2), [*BUNDLE, "position"])


def weighted_means(points: DataFrame, value: str = "sample") -> DataFrame:
    """T-4: mean weighted by exp(-d) with d the Mahalanobis distance from the mean point of each index."""
    pairs = [(a, b) for i, a in enumerate(CELL) for b in CELL[i:]]
    by = [*BUNDLE, "pos"]
    stats = points.groupBy(*by).agg(*(F.avg(c).alias(f"m{c}") for c in CELL), *(F.covar_pop(a, b).alias(f"s{a}{b}") for a, b in pairs))
    d = [F.col(c) - F.col(f"m{c}") for c in CELL]
    # A little on the diagonal keeps flat clouds invertible.
    xx, xy, xz, yy, yz, zz = (F.col(f"s{a}{b}") + (1e-9 if a == b else 0.0) for a, b in pairs)
    det = xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz)
    inv = [[yy * zz - yz * yz, xz * yz - xy * zz, xy * yz - xz * yy], [xz * yz - xy * zz, xx * zz - xz * xz, xy * xz - xx * yz], [xy * yz - xz * yy, xy * xz - xx * yz, xx * yy - xy * xy]]
    quad = sum((d[i] * inv[i][j] * d[j] for i in range(3) for j in range(3) if (i, j) != (0, 0)), d[0] * inv[0][0] * d[0]) / det
    w = F.exp(-F.sqrt(F.greatest(quad, F.lit(0.0))))
    joined = points.join(stats, by).withColumn("w_", w)
    mean = F.sum(F.col("w_") * F.col(value)) / F.sum("w_")
    square = F.sum(F.col("w_") * F.col(value) * F.col(value)) / F.sum("w_")
    return joined.groupBy(*BUNDLE, F.col("pos").alias("position")).agg(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"), F.count("*").alias("n"))


def best_match_vector(df: DataFrame, least: float, pred: str = "pred", cand: str = "cand") -> DataFrame:
    """Of the candidates in a flat array the one with the largest absolute cosine (the first of several); zeros where ``pred`` is shorter than ``least``."""
    n = (F.size(cand) / 3).cast("int")
    each = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.abs(vec_cos(F.col(pred), F.slice(cand, i * 3 + 1, 3))).alias("c"), (-i).alias("i"), F.slice(cand, i * 3 + 1, 3).alias("v")))
    best = F.array_max(each)["v"]
    return df.withColumn("best", F.when(vec_norm(pred) < least, F.transform(best, lambda x: x * 0)).otherwise(best))


def best_match_slots(pred: DataFrame, slots: DataFrame, least: float, on: list[str]) -> DataFrame:
    """J7 on a table with a row for each candidate: ``slots`` has ``on``, ``slot``, ``v``."""
    joined = pred.join(slots, on)
    order = F.struct(F.abs(vec_cos("pred", "v")), -F.col("slot"))
    best = joined.groupBy(*on).agg(F.max_by("v", order).alias("v"), F.first("pred").alias("pred"))
    return best.withColumn("best", F.when(vec_norm("pred") < least, F.transform("v", lambda x: x * 0)).otherwise(F.col("v"))).select(*on, "best")


def peak_length_image(df: DataFrame) -> DataFrame:
    """T-5: length of the best-matching candidate as the scalar."""
    return best_match_vector(df, 1e-5).withColumn("value", vec_norm("best"))


def profile_band(profiles: DataFrame, cohort: DataFrame, z: float = 1.96) -> DataFrame:
    """T-6: mean and normal 95 % band for each bundle, position and group."""
    g = profiles.join(cohort.select("subject", "grp"), "subject").groupBy("bundle", "position", "grp")
    half = z * F.stddev_samp("mean") / F.sqrt(F.count("*"))
    return g.agg(F.avg("mean").alias("m"), (F.avg("mean") - half).alias("low"), (F.avg("mean") + half).alias("high"), F.count("*").alias("n"))


def bootstrap_band(profiles: DataFrame, cohort: DataFrame, draw: Column, replicates: int = 200) -> DataFrame:
    """T-6 by resampling subjects: ``draw`` is a weight for (replicate ``r``, subject), say Poisson counts from a hash."""
    rows = profiles.join(cohort.select("subject", "grp"), "subject").withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1)))).withColumn("w_", draw)
    per = rows.groupBy("bundle", "position", "grp", "r").agg(F.try_divide(F.sum(F.col("w_") * F.col("mean")), F.sum("w_")).alias("m"))
    q = per.groupBy("bundle", "position", "grp").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q_"), F.avg("m").alias("m"))
    return q.select("bundle", "position", "grp", "m", F.col("q_")[0].alias("low"), F.col("q_")[1].alias("high"))


def mean_profile(profiles: DataFrame) -> DataFrame:
    """T-7: mean over subjects."""
    return profiles.groupBy("bundle", "position").agg(F.avg("mean").alias("mean"), F.count("*").alias("n"))


def pad_profile_ends(profiles: DataFrame, by: list[str]) -> DataFrame:
    """The first and the last position once more, and positions counted on by one."""
    w = Window.partitionBy(*by)
    marked = profiles.withColumns({"lo_": F.min("position").over(w), "hi_": F.max("position").over(w)})
    more = F.array_compact(F.array(F.lit(1), F.when(F.col("position") == F.col("lo_"), 0), F.when(F.col("position") == F.col("hi_"), 2)))
    return marked.withColumn("s_", F.explode(more)).withColumn("position", F.col("position") + F.col("s_")).drop("lo_", "hi_", "s_")


def profile_to_bins(profiles: DataFrame, by: list[str]) -> DataFrame:
    """Values rescaled to 0 .. 99 and cut to whole bins; a constant profile is multiplied by 99."""
    ends = profiles.groupBy(*by).agg(F.min("mean").alias("lo_"), F.max("mean").alias("hi_"))
    span = F.col("hi_") - F.col("lo_")
    bin_ = F.floor(F.when(span > 0, F.round((F.col("mean") - F.col("lo_")) / span * 99, 9)).otherwise(F.col("mean") * 99)).cast("int")
    return profiles.join(ends, by).withColumn("bin", bin_).drop("lo_", "hi_")
