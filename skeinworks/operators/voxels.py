"""Sparse voxel grids: ``(subject, bundle, x, y, z, value)``, absent cells are 0.

Neighbours are reached in dense blocks (:mod:`blocks`), or by exploding a few offsets and grouping or joining on equal cells,
never by comparing ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import unit, vec_norm
from .blocks import blobs, boxed

IMAGE = ["subject", "bundle"]
CELL = ["x", "y", "z"]
Shape = tuple[int, int, int]


def inside(shape: Shape) -> Column:
    return reduce(lambda a, b: a & b, [(F.col(c) >= 0) & (F.col(c) < n) for c, n in zip(CELL, shape, strict=True)])


# Values


def binarize(df: DataFrame, thr: float, op: str = ">=", value: str = "value") -> DataFrame:
    v = F.col(value)
    return df.withColumn(value, (v >= thr if op == ">=" else v > thr).cast("int"))


def binarize_by_bundle(df: DataFrame, thresholds: dict[str, float], default: float = 0.5) -> DataFrame:
    table = df.sparkSession.createDataFrame(list(thresholds.items()), "bundle string, thr double")
    joined = df.join(F.broadcast(table), "bundle", "left")
    return joined.withColumn("value", (F.col("value") >= F.coalesce("thr", F.lit(default))).cast("int")).drop("thr")


def zero_below(df: DataFrame, thr: float) -> DataFrame:
    return df.withColumn("value", F.when(F.col("value") < thr, 0.0).otherwise(F.col("value")))


def clip_negative(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.greatest(F.col("value"), F.lit(0.0)))


def fill_nan(df: DataFrame, value: str = "value") -> DataFrame:
    """NaN and null to 0, infinities to the largest finite numbers."""
    v = F.coalesce(F.nanvl(F.col(value), F.lit(0.0)), F.lit(0.0))
    big = F.lit(1.7976931348623157e308)
    return df.withColumn(value, F.when(v > big, big).when(v < -big, -big).otherwise(v))


def apply_mask(df: DataFrame, mask: DataFrame, thr: float = 0.5, on: list[str] | None = None) -> DataFrame:
    on = on or [*IMAGE, *CELL]
    return df.join(mask.where(F.col("value") >= thr).select(*on).distinct(), on, "left_semi")


def select_bundles(df: DataFrame, names: str | list[str], known: list[str]) -> DataFrame:
    """Rows of the named bundles; an unknown name is an error."""
    names = names.replace(",", " ").split() if isinstance(names, str) else names
    if unknown := sorted(set(names) - set(known)):
        raise ValueError(f"unknown bundles: {unknown}")
    return df.where(F.col("bundle").isin(names))


def mask_from_vectors(df: DataFrame, thr: float, v: str = "v") -> DataFrame:
    return df.withColumn("value", (vec_norm(v) > thr).cast("int")).drop(v)


def drop_small_vectors(df: DataFrame, thr: float, per_bundle: dict[str, float] | None = None, v: str = "v") -> DataFrame:
    """Zeroes vectors of at most the threshold's length."""
    limit: Column = F.lit(thr)
    if per_bundle:
        limit = F.coalesce(F.create_map(*(F.lit(x) for kv in per_bundle.items() for x in kv))[F.col("bundle")], F.lit(thr))
    return df.withColumn(v, F.when(vec_norm(v) > limit, F.col(v)).otherwise(F.transform(v, lambda x: x * 0)))


def brain_mask_simple(df: DataFrame, shape: Shape, thr: float = 0.01) -> DataFrame:
    """Cells whose largest channel exceeds ``thr``, grown once."""
    top = df.groupBy("subject", *CELL).agg(F.max("value").alias("top")).where(F.col("top") > thr)
    return dilate(top.select("subject", *CELL), 1, shape)


def enforce_shape(df: DataFrame, have: Shape, want: Shape) -> DataFrame:
    """Cuts what is too large from the low side; a smaller grid simply ends later."""
    moved = df.withColumns({c: F.col(c) - max(0, h - w) for c, h, w in zip(CELL, have, want, strict=True)})
    return moved.where(inside(want))


def to_label_map(df: DataFrame, names: list[str]) -> DataFrame:
    """One label (1, 2, .. in the order of ``names``) for each cell, the last of several."""
    label = F.array_position(F.array(*map(F.lit, names)), F.col("bundle")).cast("int")
    return df.where(F.col("value") > 0).withColumn("label", label).groupBy("subject", *CELL).agg(F.max("label").alias("label"))


def to_one_hot(df: DataFrame, labels: list[int]) -> DataFrame:
    return df.select("subject", *CELL, *((F.col("label") == k).cast("int").alias(f"is_{k}") for k in labels))


def add_background(df: DataFrame, shape: Shape, name: str = "BG") -> DataFrame:
    """A bundle of the cells that are in no other, for each subject."""
    nx, ny, nz = shape
    cells = df.select("subject").distinct()
    for c, n in zip(CELL, (nx, ny, nz), strict=True):
        cells = cells.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rest = cells.join(df.where(F.col("value") > 0).select("subject", *CELL).distinct(), ["subject", *CELL], "left_anti")
    return df.select(*IMAGE, *CELL, "value").unionByName(rest.select("subject", F.lit(name).alias("bundle"), *CELL, F.lit(1.0).alias("value")))


def slices(df: DataFrame, axis: str, which: list[int]) -> DataFrame:
    return df.where(F.col(axis).isin(which))


def middle_slice(df: DataFrame, axis: str) -> DataFrame:
    """The slice half-way through the extent of each subject's non-zero cells."""
    mid = df.where(F.col("value") != 0).groupBy("subject").agg(F.floor((F.min(axis) + F.max(axis)) / 2).cast("int").alias(axis))
    return df.join(mid, ["subject", axis], "left_semi")


# Combining images


def join_voxels(a: DataFrame, b: DataFrame, how: str = "full_outer", on: list[str] | None = None) -> DataFrame:
    """``value_a, value_b`` by cell; absent is 0."""
    on = on or ["subject", *CELL]
    joined = a.select(*on, F.col("value").alias("value_a")).join(b.select(*on, F.col("value").alias("value_b")), on, how)
    return joined.fillna(0.0, ["value_a", "value_b"])


def mask_semi(df: DataFrame, mask: DataFrame, on: list[str] | None = None) -> DataFrame:
    on = on or ["subject", *CELL]
    return df.join(mask.select(*on).distinct(), on, "left_semi")


def mask_anti(df: DataFrame, mask: DataFrame, on: list[str] | None = None) -> DataFrame:
    on = on or ["subject", *CELL]
    return df.join(mask.select(*on).distinct(), on, "left_anti")


def mask_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def mask_intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def mask_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.subtract(b)


def stack_channels(images: list[tuple[DataFrame, int]], channel: str = "channel") -> DataFrame:
    """One image after another, channels counted on; each comes with its number of channels."""
    out, offset = None, 0
    for df, n in images:
        moved = df.withColumn(channel, F.col(channel) + offset)
        out = moved if out is None else out.unionByName(moved)
        offset += n
    return out


# Extents, projections, scales


def bbox(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Half-open boxes of the non-zero cells."""
    ends = [e for c in CELL for e in (F.min(c).alias(f"{c}_lo"), (F.max(c) + 1).alias(f"{c}_hi"))]
    return df.where(F.col("value") != 0).groupBy(*(by or ["subject"])).agg(*ends)


def project_mip(df: DataFrame, axis: str, how: str = "max", n: int | None = None) -> DataFrame:
    """Largest or mean value along an axis of ``n`` cells."""
    rest = [c for c in CELL if c != axis]
    value = F.greatest(F.max("value"), F.lit(0.0)) if how == "max" else F.sum("value") / n
    return df.groupBy(*IMAGE, *rest).agg(value.alias("value"))


def scale_to_range(df: DataFrame, lo: float, hi: float, by: list[str], value: str = "value") -> DataFrame:
    """Least value to ``lo`` and largest to ``hi`` in each group; a constant group to ``lo``."""
    ends = df.groupBy(*by).agg(F.min(value).alias("lo_"), F.max(value).alias("hi_"))
    span = F.col("hi_") - F.col("lo_")
    scaled = F.when(span > 0, (F.col(value) - F.col("lo_")) / span * (hi - lo) + lo).otherwise(F.lit(float(lo)))
    return df.join(ends, by).withColumn(value, scaled).drop("lo_", "hi_")


def zscore(df: DataFrame, cells: int, by: list[str], eps: float = 0.0) -> DataFrame:
    """(value - mean) / (std + eps) of the listed cells; mean and population std count all ``cells`` of the grid, absent ones as 0."""
    stats = df.groupBy(*by).agg((F.sum("value") / cells).alias("m_"), (F.sum(F.col("value") * F.col("value")) / cells).alias("q_"))
    std = F.sqrt(F.greatest(F.col("q_") - F.col("m_") * F.col("m_"), F.lit(0.0)))
    return df.join(stats, by).withColumn("value", (F.col("value") - F.col("m_")) / (std + eps)).drop("m_", "q_")


def label_histogram(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


# Neighbourhoods


def _spread(cells: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    moves = F.explode(F.array(*(F.struct(*(F.lit(o[i]).alias(f"d{c}") for i, c in enumerate(CELL))) for o in offsets)))
    return cells.withColumn("move_", moves).withColumns({c: F.col(c) + F.col(f"move_.d{c}") for c in CELL}).drop("move_")


CROSS = [(0, 0, 0), (1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)]


def dilate(mask: DataFrame, iterations: int, shape: Shape) -> DataFrame:
    """Grows cells to their face neighbours, within the grid. ``mask`` has key columns and x, y, z."""
    for _ in range(iterations):
        mask = _spread(mask, CROSS).where(inside(shape)).distinct()
    return mask


def dilate_box(mask: DataFrame, size: int, shape: Shape) -> DataFrame:
    """Grows cells to a cube."""
    return boxed(mask, [("grow", size)], shape)


def erode_box(mask: DataFrame, size: int, shape: Shape) -> DataFrame:
    """Keeps cells whose whole cube is set; outside the grid nothing is."""
    return boxed(mask, [("wear", size)], shape)


def close_holes(mask: DataFrame, size: int, shape: Shape, skip: list[str] | None = None) -> DataFrame:
    """Closes all bundles but those whose names begin with one of ``skip``."""
    if not skip:
        return boxed(mask, [("grow", size), ("wear", size)], shape)
    out = reduce(lambda a, b: a | b, [F.col("bundle").startswith(s) for s in skip])
    return close_holes(mask.where(~out), size, shape).unionByName(mask.where(out))


def label_blobs(mask: DataFrame, shape: Shape, by: list[str] | None = None) -> DataFrame:
    """``mask`` with ``blob``: the first cell, in x, y, z order, that faces connect each cell to."""
    by = by or IMAGE
    return blobs(mask, shape, by).drop("node")


def blob_sizes(found: DataFrame, by: list[str] | None = None) -> DataFrame:
    return found.groupBy(*(by or IMAGE), "blob").agg(F.count("*").alias("n"))


def remove_small_blobs(mask: DataFrame, thr: int, shape: Shape, by: list[str] | None = None) -> DataFrame:
    """Drops blobs of at most ``thr`` cells; the largest (the first of several) always stays."""
    by = by or IMAGE
    found = label_blobs(mask, shape, by)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "blob"))
    keep = blob_sizes(found, by).withColumn("r_", rank).where((F.col("n") > thr) | (F.col("r_") == 1)).select(*by, "blob")
    return found.join(keep, [*by, "blob"], "left_semi").select(*by, *CELL)


def has_two_big_blobs(mask: DataFrame, thresholds: dict[str, int], shape: Shape) -> DataFrame:
    """``subject, bundle, two_big`` for bundles with a threshold: at least two blobs of more cells."""
    table = mask.sparkSession.createDataFrame(list(thresholds.items()), "bundle string, thr int")
    sizes = blob_sizes(label_blobs(mask, shape)).join(F.broadcast(table), "bundle")
    return sizes.groupBy(*IMAGE).agg((F.sum((F.col("n") > F.col("thr")).cast("int")) >= 2).alias("two_big"))


#: Bundles with a lower threshold where two big blobs lie apart: blob size and threshold.
BRIDGED = {"CA": (200, 0.3), "FX_left": (100, 0.4), "FX_right": (100, 0.4)}


def bundle_specific_postprocess(prob: DataFrame, shape: Shape, rules: dict[str, tuple[int, float]] | None = None, size: int = 6) -> DataFrame:
    """Masks from probabilities: > 0.5, but for a bridged bundle with two big blobs its lower threshold, then closed."""
    rules = BRIDGED if rules is None else rules
    plain = prob.where(F.col("value") > 0.5).select(*IMAGE, *CELL)
    if not rules:
        return plain
    special = F.col("bundle").isin(list(rules))
    two = has_two_big_blobs(plain.where(special), {b: n for b, (n, _) in rules.items()}, shape).where("two_big").select(*IMAGE)
    low = F.create_map(*(F.lit(x) for b, (_, t) in rules.items() for x in (b, t)))[F.col("bundle")]
    bridged = prob.join(two, IMAGE, "left_semi").where(F.col("value") > low).select(*IMAGE, *CELL)
    return plain.join(two, IMAGE, "left_anti").unionByName(close_holes(bridged, size, shape))


def postprocess(mask: DataFrame, blob_thr: int, shape: Shape, hole_size: int | None = None) -> DataFrame:
    if hole_size:
        mask = close_holes(mask, hole_size, shape, ["CST_", "MCP"])
    return remove_small_blobs(mask, blob_thr, shape)


# Geometry of grids


def crop(df: DataFrame, box: DataFrame, by: list[str] | None = None) -> DataFrame:
    by = by or ["subject"]
    joined = df.join(box, by)
    ok = reduce(lambda a, b: a & b, [(F.col(c) >= F.col(f"{c}_lo")) & (F.col(c) < F.col(f"{c}_hi")) for c in CELL])
    moved = joined.where(ok).withColumns({c: F.col(c) - F.col(f"{c}_lo") for c in CELL})
    return moved.select(*df.columns)


def uncrop(df: DataFrame, box: DataFrame, by: list[str] | None = None) -> DataFrame:
    joined = df.join(box, by or ["subject"])
    return joined.withColumns({c: F.col(c) + F.col(f"{c}_lo") for c in CELL}).select(*df.columns)


def pad(df: DataFrame, amount: Shape, left: bool = False) -> DataFrame:
    """Shifts by half of ``amount`` (all of it with ``left``); padded cells are 0, so absent."""
    return df.withColumns({c: F.col(c) + (a if left else a // 2) for c, a in zip(CELL, amount, strict=True)})


def nearest_source(n: int, m: int) -> list[tuple[int, int]]:
    """(target, source) of nearest resampling from ``n`` to ``m`` cells with both ends fixed."""
    return [(o, int((o * (n - 1) / (m - 1) if m > 1 else 0.0) + 0.5)) for o in range(m)]


def resample_nearest(df: DataFrame, have: Shape, want: Shape) -> DataFrame:
    """Nearest resampling; the index maps have a row for each target index."""
    for c, n, m in zip(CELL, have, want, strict=True):
        table = df.sparkSession.createDataFrame(nearest_source(n, m), f"to_ int, {c} int")
        df = df.join(F.broadcast(table), c).withColumn(c, F.col("to_")).drop("to_")
    return df


def square_and_scale(df: DataFrame, shape: Shape, target: int) -> tuple[DataFrame, dict]:
    """Pads to a cube (half before, rounded down), then resamples; and what undoes it."""
    big = max(shape)
    before = tuple(int((big - n) / 2) for n in shape)
    moved = pad(df, before, left=True)
    return resample_nearest(moved, (big,) * 3, (target,) * 3), {"shape": shape, "big": big, "before": before, "target": target}


def unscale(df: DataFrame, how: dict) -> DataFrame:
    back = resample_nearest(df, (how["target"],) * 3, (how["big"],) * 3)
    moved = back.withColumns({c: F.col(c) - b for c, b in zip(CELL, how["before"], strict=True)})
    return moved.where(inside(how["shape"]))


#: Fixed values: (shape, spacing in mm) to the shape after resampling, where the model's cube begins in it (below 0: padded), and the cube.
RECIPES = {
    ((145, 174, 145), 1.25): ((145, 174, 145), (1, 15, 1), (144, 144, 144)),
    ((73, 87, 73), 1.25): ((146, 174, 146), (1, 15, 1), (144, 144, 144)),
    ((91, 109, 91), 1.25): ((146, 174, 146), (1, 15, 1), (144, 144, 144)),
    ((145, 174, 145), 2.0): ((90, 108, 90), (5, 14, 5), (80, 80, 80)),
    ((90, 108, 90), 2.0): ((90, 108, 90), (5, 14, 5), (80, 80, 80)),
    ((91, 109, 91), 2.0): ((91, 109, 91), (0, 9, 0), (91, 91, 91)),
    ((145, 174, 145), 2.5): ((73, 87, 73), (-4, 4, -4), (80, 80, 80)),
    ((73, 87, 73), 2.5): ((73, 87, 73), (-4, 4, -4), (80, 80, 80)),
    ((78, 93, 75), 2.5): ((78, 93, 75), (-1, 7, -3), (80, 80, 80)),
}


def to_model_shape(df: DataFrame, shape: Shape, recipe: tuple[Shape, Shape, Shape]) -> DataFrame:
    """Resampled (nearest), then cut and padded to the model's cube; one of ``RECIPES``, or an own one."""
    between, begin, cube = recipe
    scaled = resample_nearest(df, shape, between) if between != shape else df
    return scaled.withColumns({c: F.col(c) - b for c, b in zip(CELL, begin, strict=True)}).where(inside(cube))


def from_model_shape(df: DataFrame, shape: Shape, recipe: tuple[Shape, Shape, Shape]) -> DataFrame:
    """G17 the other way; what had been cut off is absent."""
    between, begin, _ = recipe
    placed = df.withColumns({c: F.col(c) + b for c, b in zip(CELL, begin, strict=True)}).where(inside(between))
    return resample_nearest(placed, between, shape) if between != shape else placed


def change_spacing(df: DataFrame, shape: Shape, old: float, new: float) -> DataFrame:
    """Nearest lookup in a grid of another spacing over the same extent."""
    for c, n in zip(CELL, shape, strict=True):
        m = int(n * old / new)
        table = [(o, int(o * new / old + 0.5)) for o in range(m)]
        frame = df.sparkSession.createDataFrame([t for t in table if t[1] < n], f"to_ int, {c} int")
        df = df.join(F.broadcast(frame), c).withColumn(c, F.col("to_")).drop("to_")
    return df


def flip_grid(df: DataFrame, axes: list[int], shape: Shape) -> DataFrame:
    """Turns axes round; twice is the identity, so it also undoes itself."""
    return df.withColumns({CELL[i]: F.lit(shape[i] - 1) - F.col(CELL[i]) for i in axes})


def mask_and_normalize(vectors: DataFrame, masks: DataFrame, dilation: int, shape: Shape) -> DataFrame:
    """Vectors inside their bundle's grown mask, at unit length; all bundles at once."""
    grown = dilate(masks.select(*IMAGE, *CELL), dilation, shape)
    return vectors.join(grown, [*IMAGE, *CELL], "left_semi").withColumn("v", unit("v"))


# Ordered


def dense_index(df: DataFrame, v: str = "v", by: list[str] | None = None) -> DataFrame:
    """Non-zero vectors as direction, amplitude and running index in x, y, z order."""
    n = vec_norm(v)
    w = Window.partitionBy(*(by or ["subject"])).orderBy(*CELL)
    return df.where(n > 0).withColumns({"amplitude": n, "direction": unit(v), "idx": F.row_number().over(w) - 1})


def slice_window(df: DataFrame, axis: str, k: int, n: int) -> DataFrame:
    """Each cell also as channel of the ``k`` slices around it: ``offset`` -k/2 .. k/2, edges cut."""
    half = k // 2
    moved = df.withColumn("offset", F.explode(F.sequence(F.lit(-half), F.lit(half)))).withColumn(axis, F.col(axis) - F.col("offset"))
    return moved.where((F.col(axis) >= 0) & (F.col(axis) < n))
