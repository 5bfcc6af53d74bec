"""Polylines: ``(subject, bundle, line_id, points)`` with points as structs x, y, z; or exploded ``(.., pos, x, y, z)``."""

from __future__ import annotations

from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import size_ratio
from ..plans.stash import stash
from . import bricks, forests
from .curves import compress, resample, smooth_spline, subsegment  # noqa: F401
from .density import density_clusters
from .voxels import CELL

LINE = ["subject", "bundle", "line_id"]
#: Points of one cell in a row of :func:`within_eps`.
TOGETHER = 512


def distance(p: Column, q: Column) -> Column:
    return F.sqrt(sum(((p[c] - q[c]) * (p[c] - q[c]) for c in CELL[1:]), (p["x"] - q["x"]) * (p["x"] - q["x"])))


def gaps(points: Column) -> Column:
    """Distances between neighbouring points."""
    n = F.size(points)
    return F.when(n > 1, F.zip_with(F.slice(points, 1, F.greatest(n - 1, F.lit(0))), F.slice(points, 2, F.greatest(n - 1, F.lit(0))), distance)).otherwise(F.array().cast("array<double>"))


def total(c: Column) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, x: s + x)


def segment_lengths(lines: DataFrame) -> DataFrame:
    return lines.withColumn("gaps", gaps(F.col("points"))).withColumn("length", total(F.col("gaps")))


def resample_by_rows(points: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """The same on exploded points, for lines too long for a row's array: window sums, then interval lookup by join on the line."""
    by = by or LINE
    w = Window.partitionBy(*by).orderBy("pos")
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) ** 2 for c in CELL), F.lit(0.0)))
    run = points.withColumn("gap_", F.coalesce(step, F.lit(0.0))).withColumn("cum_", F.sum("gap_").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    nxt = run.withColumns({"to_": F.lead("cum_").over(w), **{f"{c}_to": F.lead(c).over(w) for c in CELL}})
    length = run.groupBy(*by).agg(F.max("cum_").alias("len_"))
    seg = nxt.where(F.col("to_").isNotNull()).join(length, by)
    grid = F.lit(n - 1)
    unit_ = F.col("len_") / grid
    # Targets i with cum_ <= i * unit < to_; the last target goes to the last segment.
    first = F.when(unit_ > 0, F.ceil(F.col("cum_") / unit_ - 1e-9)).otherwise(F.lit(0))
    last = F.when(F.col("to_") >= F.col("len_"), grid).when(unit_ > 0, F.ceil(F.col("to_") / unit_ - 1e-9) - 1).otherwise(F.lit(0))
    hit = seg.where(first <= last).withColumn("i_", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    share = F.when(F.col("to_") > F.col("cum_"), (F.col("i_") * unit_ - F.col("cum_")) / (F.col("to_") - F.col("cum_"))).otherwise(F.lit(0.0))
    return hit.select(*by, F.col("i_").alias("pos"), *((F.col(c) + (F.col(f"{c}_to") - F.col(c)) * F.least(share, F.lit(1.0))).alias(c) for c in CELL))


def resample_same_step(lines: DataFrame, most: int, by: list[str] | None = None) -> DataFrame:
    """L4: the step that gives a bundle's longest line ``most`` points; shorter lines get fewer, at least one."""
    measured = segment_lengths(lines).drop("gaps")
    step = measured.groupBy(*(by or ["subject", "bundle"])).agg((F.max("length") / most).alias("step_"))
    n = F.when(F.col("step_") > 0, F.greatest((F.col("length") / F.col("step_")).cast("int"), F.lit(1))).otherwise(F.lit(1))
    return resample(measured.join(step, by or ["subject", "bundle"]).withColumn("want_", n), F.col("want_")).drop("length", "step_", "want_")


def cell_of(p: Column, half: float = 0.5) -> dict[str, Column]:
    return {f"c{c}": (p[c] + half).cast("int") for c in CELL}


def lookup_voxel(points: DataFrame, image: DataFrame, on: list[str] | None = None, half: float = 0.0) -> DataFrame:
    """``value`` of the cell that a point falls in by truncation; 0 where none is listed."""
    on = ["subject"] if on is None else on
    return bricks.lookup(points, bricks.bricks(image, on), on, half)


def orient_to_start(lines: DataFrame, starts: DataFrame, shape: tuple[int, int, int]) -> DataFrame:
    """Turns lines round whose first point isn't in a start cell; drops those that begin outside the grid."""
    p = F.element_at("points", 1)
    keyed = lines.withColumns(cell_of(p))
    ok = reduce(lambda a, b: a & b, [(p[c] + 0.5 >= 0) & (F.col(f"c{c}") < n) for c, n in zip(CELL, shape, strict=True)])
    hits = starts.select("subject", "bundle", *(F.col(c).alias(f"c{c}") for c in CELL)).distinct().withColumn("in_", F.lit(True))
    joined = keyed.where(ok).join(hits, ["subject", "bundle", "cx", "cy", "cz"], "left")
    return joined.withColumn("points", F.when(F.col("in_"), F.col("points")).otherwise(F.reverse("points"))).select(*lines.columns)


def explode_points(lines: DataFrame) -> DataFrame:
    keys = [c for c in lines.columns if c != "points"]
    return lines.select(*keys, F.posexplode("points").alias("pos", "p_")).select(*keys, "pos", *(F.col(f"p_.{c}").alias(c) for c in CELL))


def filter_leaving_mask(lines: DataFrame, mask: DataFrame, step: float = 0.1) -> DataFrame:
    """Lines all of whose points, at steps of at most ``step``, lie in mask cells."""
    fine = explode_points(subsegment(lines, step)).withColumns({f"c{c}": F.col(c).cast("int") for c in CELL})
    hits = mask.select("subject", "bundle", *(F.col(c).alias(f"c{c}") for c in CELL)).distinct()
    outside = fine.select(*LINE, "cx", "cy", "cz").distinct().join(hits, ["subject", "bundle", "cx", "cy", "cz"], "left_anti")
    return lines.join(outside.select(*LINE).distinct(), LINE, "left_anti")


def filter_length(lines: DataFrame, lo_mm: float, hi_mm: float, spacing: float) -> DataFrame:
    """Lines between two lengths, given in mm and compared in whole cells."""
    return segment_lengths(lines).where(F.col("length").between(int(lo_mm / spacing), int(hi_mm / spacing))).drop("gaps", "length")


def filter_endpoints(lines: DataFrame, start: DataFrame, end: DataFrame) -> DataFrame:
    """One end in a start cell and the other in an end cell, either way round."""
    ends = lines.withColumns({f"{e}{c}": F.element_at("points", i)[c].cast("int") for e, i in (("a", 1), ("b", -1)) for c in CELL})

    def flag(df: DataFrame, cells: DataFrame, e: str, name: str) -> DataFrame:
        own = cells.select("subject", "bundle", *(F.col(c).alias(f"{e}{c}") for c in CELL)).distinct().withColumn(name, F.lit(True))
        return df.join(own, ["subject", "bundle", *(f"{e}{c}" for c in CELL)], "left").fillna(False, [name])

    for e, cells, name in (("a", start, "as_"), ("a", end, "ae_"), ("b", start, "bs_"), ("b", end, "be_")):
        ends = flag(ends, cells, e, name)
    return ends.where((F.col("as_") & F.col("be_")) | (F.col("ae_") & F.col("bs_"))).select(*lines.columns)


def smooth(lines: DataFrame, reach: int = 2) -> DataFrame:
    """L9, plainly: moving mean of up to ``reach`` points on both sides; ends stay."""
    pts = F.col("points")

    def one(p: Column, i: Column) -> Column:
        r = F.least(F.lit(reach), i, F.size(pts) - 1 - i)
        part = F.slice(pts, i + 1 - r, 2 * r + 1)
        return F.struct(*((F.aggregate(part, F.lit(0.0), lambda s, q: s + q[c]) / F.size(part)).alias(c) for c in CELL))

    return lines.withColumn("points", F.transform(pts, one))


def pad_lines(lines: DataFrame, n: int, point: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """Appends ``point`` up to ``n`` points."""
    filler = F.struct(*(F.lit(float(v)).alias(c) for c, v in zip(CELL, point, strict=True)))
    return lines.withColumn("points", F.concat("points", F.array_repeat(filler, F.greatest(n - F.size("points"), F.lit(0)))))


def centroid(lines: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Mean of the points of equal index. Lines have one number of points and one orientation."""
    return explode_points(lines).groupBy(*(by or ["subject", "bundle"]), "pos").agg(*(F.avg(c).alias(c) for c in CELL))


def endpoints(lines: DataFrame) -> DataFrame:
    """First and last points as rows."""
    keys = [c for c in lines.columns if c != "points"]
    both = F.array(*(F.struct(F.lit(e).alias("end"), *(F.element_at("points", i)[c].alias(c) for c in CELL)) for e, i in (("b", 1), ("e", -1))))
    return lines.where(F.size("points") > 0).select(*keys, F.inline(both))


def density_map(lines: DataFrame, step: float = 0.25) -> DataFrame:
    """A10: distinct lines through each cell."""
    fine = explode_points(subsegment(lines, step)).withColumns({c: F.col(c).cast("int") for c in CELL})
    return fine.select(*LINE, *CELL).distinct().groupBy("subject", "bundle", *CELL).agg(F.count("*").alias("n"))


def binary_map(lines: DataFrame, step: float = 0.25) -> DataFrame:
    """Cells with any line."""
    return density_map(lines, step).drop("n")


def line_statistics(lines: DataFrame, every: int = 1) -> DataFrame:
    """Mean length, mean gap, largest gap of a bundle's lines (of every n-th by ``line_id``)."""
    some = segment_lengths(lines.where(F.col("line_id") % every == 0))
    per = some.select("subject", "bundle", "length", total(F.col("gaps")).alias("sum_"), F.size("gaps").alias("n_"), F.array_max("gaps").alias("max_"))
    return per.groupBy("subject", "bundle").agg(F.count("*").alias("n_lines"), F.avg("length").alias("mean_length"), (F.sum("sum_") / F.sum("n_")).alias("mean_gap"), F.max("max_").alias("max_gap"))


def limit_lines(lines: DataFrame, n: int) -> DataFrame:
    """O1: the first ``n`` lines of each bundle."""
    w = Window.partitionBy("subject", "bundle").orderBy("line_id")
    return lines.withColumn("r_", F.row_number().over(w)).where(F.col("r_") <= n).drop("r_")


def every_nth(lines: DataFrame, n: int) -> DataFrame:
    """O2: every n-th line of each bundle, from the first."""
    w = Window.partitionBy("subject", "bundle").orderBy("line_id")
    return lines.withColumn("r_", F.row_number().over(w)).where((F.col("r_") - 1) % n == 0).drop("r_")


# Points among themselves


def sample_trilinear(points: DataFrame, image: DataFrame, shape: tuple[int, int, int], on: list[str] | None = None) -> DataFrame:
    """``sample``, linear between the eight cells around a point; 0 outside [0, n - 1] on any axis. ``image`` may be what :func:`bricks.bricks` makes of one."""
    on = ["subject"] if on is None else on
    return bricks.sample(points, image if "cells" in image.columns else bricks.bricks(image, on), shape, on)


def nearest_point(points: DataFrame, centroids: DataFrame, on: list[str] | None = None) -> DataFrame:
    """Index of the nearest centroid point, the lowest of several. A group's centroids (100 or so) go along as one array."""
    on = on or ["subject", "bundle"]
    own = centroids.groupBy(*on).agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("k"), *(F.col(c).alias(c) for c in CELL)))).alias("core_"))
    here = F.struct(*(F.col(c) for c in CELL))
    best = F.array_min(F.transform("core_", lambda q: F.struct(sum(((q[c] - here[c]) * (q[c] - here[c]) for c in CELL[1:]), (q["x"] - here["x"]) * (q["x"] - here["x"])).alias("d"), q["k"].alias("k"))))
    return points.join(own, on).withColumn("segment", best["k"]).drop("core_")


def closest_to_target(points: DataFrame, target: DataFrame, by: list[str] | None = None) -> DataFrame:
    """For each line, the index of the point closest to its bundle's target, the first of several."""
    by = by or LINE
    t = target.select("subject", "bundle", *(F.col(c).alias(f"t{c}") for c in CELL))
    d = sum(((F.col(c) - F.col(f"t{c}")) * (F.col(c) - F.col(f"t{c}")) for c in CELL[1:]), (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")))
    return points.join(t, ["subject", "bundle"]).groupBy(*by).agg(F.min(F.struct(d.alias("d"), F.col("pos").alias("pos")))["pos"].alias("middle"))


def within_eps(points: DataFrame, eps: float, key: str, by: list[str], digits: int | None = None) -> DataFrame:
    """Pairs of points at most ``eps`` apart, by cells a little wider than that and their neighbours; ``digits`` rounds their distance.

    A row holds ``TOGETHER`` points of a cell at most, its places with their keys, and meets those of its own cell and of half of the 26 around it.
    Which rows meet is found by their numbers alone. What is shuffled are rows, about 15 times each and more often only where a cell has many of them;
    pairs are made behind the last shuffle, in the task that writes them, and are held nowhere.
    """
    cells, ends = [f"c{c}" for c in CELL], lambda names: [F.col(n).alias(f"a{n}") for n in names]
    place, at = [*by, *cells], [*by, *cells, "block_"]
    # wider than eps, so that no rounding puts two points that are eps apart two cells apart
    own = points.select(*by, F.col(key).alias("key_"), *CELL, *(F.floor(F.col(c) / (eps * (1 + 1e-6))).alias(n) for n, c in zip(cells, CELL, strict=True)))
    own = own.where(reduce(lambda a, b: a & b, [*(F.abs(c) < float("inf") for c in CELL), *(F.col(c).isNotNull() for c in [*place, "key_"])]))
    numbered = own.withColumn("n", F.row_number().over(Window.partitionBy(*place).orderBy(*CELL, "key_")) - 1).withColumn("block_", F.floor(F.col("n") / TOGETHER))
    places = numbered.groupBy(*at, *CELL).agg(F.min("n").alias("n"), F.array_sort(F.collect_list("key_")).alias("keys"))
    rows = places.groupBy(*at).agg(F.array_sort(F.collect_list(F.struct("n", *CELL, "keys"))).alias("places"))
    ids = numbered.select(*at).distinct()
    ahead = [o for o in product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]
    around = F.explode(F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(cells, o, strict=True))) for o in ahead)))
    still = reduce(lambda a, b: a & b, [F.col(n) == F.col(f"a{n}") for n in cells])
    left = ids.withColumn("o_", around).select(*by, *ends([*cells, "block_"]), *((F.col(n) + F.col("o_")[n]).alias(n) for n in cells))
    meet = left.join(ids, place).where(~still | (F.col("ablock_") <= F.col("block_"))).withColumn("same_", still & (F.col("ablock_") == F.col("block_")))
    meet = meet.join(rows.select(*by, *ends([*cells, "block_", "places"])), [*by, *(f"a{n}" for n in [*cells, "block_"])])
    # a number of parts that stays: few bytes go in and many pairs come out
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = meet.repartition(parts, *at).join(rows.repartition(parts, *at), at)
    near = met.select(*by, "same_", "places", F.inline("aplaces").alias("an", *(f"a{c}" for c in CELL), "akeys"))
    near = near.select(*by, "same_", "an", *(f"a{c}" for c in CELL), "akeys", F.inline("places").alias("n", *CELL, "keys"))
    square = reduce(lambda a, b: a + b, [(F.col(f"a{c}") - F.col(c)) * (F.col(f"a{c}") - F.col(c)) for c in CELL])
    near = near.where((~F.col("same_") | (F.col("an") <= F.col("n"))) & (square <= eps * eps))
    d = F.sqrt(square) if digits is None else F.round(F.sqrt(square), digits)
    near = near.select(*by, "akeys", "keys", d.alias("distance"), (F.col("same_") & (F.col("an") == F.col("n"))).alias("same_"))
    pairs = near.withColumn("k1_", F.explode("akeys")).drop("akeys").withColumn("k2_", F.explode("keys"))
    pairs = pairs.where(F.when(F.col("same_"), F.col("k1_") < F.col("k2_")).otherwise(F.col("k1_") != F.col("k2_")))
    return pairs.select(*by, F.least("k1_", "k2_").alias("a"), F.greatest("k1_", "k2_").alias("b"), "distance")


def cluster_endpoints(points: DataFrame, key: str, by: list[str], eps: float = 3.0, least: int = 5) -> DataFrame:
    """``points`` with ``cluster``, the smallest key of its density cluster; null for noise. See :func:`density_clusters`."""
    return density_clusters(points, key, by, eps, least)


def two_biggest_clusters(df: DataFrame, label: str, by: list[str]) -> DataFrame:
    """O3: the two labels with the most rows in each group, ties to the lower label."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), label)
    return df.where(F.col(label).isNotNull()).groupBy(*by, label).agg(F.count("*").alias("n")).withColumn("rank", F.row_number().over(w)).where("rank <= 2")


def classify_endpoints(points: DataFrame, label: str, key: str, by: list[str] | None = None, trees: int = 10, seed: int = 0) -> DataFrame:
    """``points`` with ``side``: each group's forest, grown on its points with a ``label`` of 0 or 1, labels all of the group's."""
    by = by or ["subject", "bundle"]
    return forests.labelled(points, forests.grown(points, label, key, by, trees=trees, seed=seed), key, by)


def two_means(points: DataFrame, key: str, by: list[str], rounds: int = 50) -> DataFrame:
    """2-means of the points of each group (Lloyd, 1982): ``by.., key, side`` with ``side`` 0 or 1.

    The first centres are the point farthest from the group's mean and the point farthest from that one, ties to
    the greatest coordinates; a point as near to both goes to 0, and a side without points keeps its centre. Rounds are
    aggregations to two centres a group, until none moves or ``rounds`` are done. Groups with a null in ``by`` are left out.
    """
    here = stash(points.select(*by, key, *CELL), "ends")
    old = [f"{c}{i}" for i in (0, 1) for c in CELL]

    def away(suffix: str) -> Column:
        return sum(((F.col(c) - F.col(f"{c}{suffix}")) ** 2 for c in CELL), F.lit(0.0))

    def farthest(centre: DataFrame, suffix: str) -> DataFrame:
        best = here.join(centre, by).groupBy(*by).agg(F.max(F.struct(away(suffix).alias("d"), *CELL)).alias("q"))
        return best.select(*by, *(F.col("q")[c].alias(c) for c in CELL))

    def named(df: DataFrame, suffix: str) -> DataFrame:
        return df.select(*by, *(F.col(c).alias(f"{c}{suffix}") for c in CELL))

    mean = here.groupBy(*by).agg(*(F.avg(c).alias(c) for c in CELL))
    one = stash(named(farthest(named(mean, "m"), "m"), "0"), "centres")
    centres = stash(one.join(named(farthest(one, "0"), "1"), by), "centres")
    side = (away("1") < away("0")).cast("int")
    for _ in range(rounds):
        sided = here.join(centres, by).withColumn("side_", side)
        moved = [F.coalesce(F.avg(F.when(F.col("side_") == i, F.col(c))), F.first(f"{c}{i}")).alias(f"{c}{i}_") for i in (0, 1) for c in CELL]
        now = stash(sided.groupBy(*by).agg(*moved, *(F.first(c).alias(c) for c in old)), "centres")
        still = now.where(sum(F.abs(F.col(f"{c}_") - F.col(c)) for c in old) > 1e-9).isEmpty()
        centres = now.select(*by, *(F.col(f"{c}_").alias(c) for c in old))
        if still:
            break
    return here.join(centres, by).select(*by, key, side.alias("side"))


def split_endpoints(points: DataFrame, key: str, by: list[str], eps: float = 3.0, least: int = 5, ratio: float = 0.5) -> DataFrame:
    """L14 as a whole: ``points`` with ``side``, 0 or 1 for the two ends of each group.

    The two biggest density clusters are the sides (0 the bigger, ties to the lower label; other points null) where the
    smaller has at least ``ratio`` of the bigger's points. Elsewhere (uneven, one cluster or none) :func:`two_means` splits all points.
    """
    found = stash(cluster_endpoints(points, key, by, eps, least), "clusters")
    top = two_biggest_clusters(found, "cluster", by)
    pair = [F.max(F.when(F.col("rank") == i + 1, F.col(c))).alias(f"{c}{i}_") for i in (0, 1) for c in ("n", "cluster")]
    even = stash(top.groupBy(*by).agg(*pair).where(F.col("n1_").isNotNull() & (size_ratio("n0_", "n1_") >= ratio)).select(*by, "cluster0_", "cluster1_"), "even")
    whole = found.join(even, by).withColumn("side", F.when(F.col("cluster") == F.col("cluster0_"), 0).when(F.col("cluster") == F.col("cluster1_"), 1))
    rest = found.join(even, by, "left_anti")
    cut = rest.join(two_means(rest, key, by), [*by, key], "left")
    return whole.select(*points.columns, "side").unionByName(cut.select(*points.columns, "side"))


def endpoint_masks(labelled: DataFrame, label: str = "end") -> DataFrame:
    """Cells of begin and end points."""
    return labelled.select("subject", "bundle", label, *(F.col(c).cast("int").alias(c) for c in CELL)).distinct()


# Moving lines


def shift(lines: DataFrame, by: float, axis: str | None = None) -> DataFrame:
    return lines.withColumn("points", F.transform("points", lambda p: F.struct(*((p[c] + by if axis in (None, c) else p[c]).alias(c) for c in CELL))))


def mirror(lines: DataFrame, signs: tuple[int, int, int]) -> DataFrame:
    return lines.withColumn("points", F.transform("points", lambda p: F.struct(*((p[c] * s).alias(c) for c, s in zip(CELL, signs, strict=True)))))
