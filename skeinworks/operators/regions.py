"""Choosing lines by the regions they pass: Boolean columns over ``regions`` (sorted names), ``start_region``, ``end_region``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lines import LINE

AXES = {"anterior_of": ("y", "lo", "hi"), "posterior_of": ("y", "hi", "lo"), "superior_of": ("z", "lo", "hi"), "inferior_of": ("z", "hi", "lo")}


def line_regions(points: DataFrame, regions: DataFrame, on: list[str]) -> DataFrame:
    """Regions on each line, and those of its first and last point. ``regions`` lists cells (``on``) and ``region``."""
    cells = points.withColumns({c: F.col(c).cast("int") for c in on})
    ends = cells.groupBy(*LINE).agg(F.min("pos").alias("lo_"), F.max("pos").alias("hi_"))
    hit = cells.join(regions, on).join(ends, LINE)
    first, last = F.when(F.col("pos") == F.col("lo_"), F.col("region")), F.when(F.col("pos") == F.col("hi_"), F.col("region"))
    found = hit.groupBy(*LINE).agg(F.array_sort(F.collect_set("region")).alias("regions"), F.min(first).alias("start_region"), F.min(last).alias("end_region"))
    empty = F.array().cast("array<string>")
    return ends.select(*LINE).join(found, LINE, "left").withColumn("regions", F.coalesce("regions", empty))


def names(*r: str) -> Column:
    return F.array(*map(F.lit, r))


def traverses(*r: str) -> Column:
    """R2: passes any of the regions; combine with ``&`` and ``|``."""
    return F.arrays_overlap("regions", names(*r))


def endpoints_in(*r: str) -> Column:
    """Either end in any of the regions."""
    return F.coalesce(F.col("start_region").isin(*r), F.lit(False)) | F.coalesce(F.col("end_region").isin(*r), F.lit(False))


def both_endpoints_in(*r: str) -> Column:
    return F.coalesce(F.col("start_region").isin(*r), F.lit(False)) & F.coalesce(F.col("end_region").isin(*r), F.lit(False))


def only(*r: str) -> Column:
    """Passes no other region."""
    return F.size(F.array_except("regions", names(*r))) == 0


def avoids(*r: str) -> Column:
    """R5."""
    return ~F.arrays_overlap("regions", names(*r))


def side_of(points: DataFrame, regions: DataFrame, region: str, relation: str) -> DataFrame:
    """Lines that lie wholly on one side of a region's box on an axis; medial is nearer the middle of the x axis."""
    box = regions.where(F.col("region") == region)
    if relation == "medial_of":
        mid = regions.agg(((F.min("x") + F.max("x")) / 2).alias("mid_"))
        near = box.crossJoin(F.broadcast(mid)).agg(F.min(F.abs(F.col("x") - F.col("mid_"))).alias("edge_"), F.first("mid_").alias("mid_"))
        reach = points.crossJoin(F.broadcast(near)).groupBy(*LINE).agg(F.max(F.abs(F.col("x") - F.col("mid_"))).alias("far_"), F.first("edge_").alias("edge_"))
        return reach.where(F.col("far_") < F.col("edge_")).select(*LINE)
    axis, own, other = AXES[relation]
    edge = box.agg((F.max(axis) if other == "hi" else F.min(axis)).alias("edge_"))
    extent = points.groupBy(*LINE).agg((F.min(axis) if own == "lo" else F.max(axis)).alias("e_"))
    joined = extent.crossJoin(F.broadcast(edge))
    return joined.where(F.col("e_") > F.col("edge_") if own == "lo" else F.col("e_") < F.col("edge_")).select(*LINE)


def expand_sides(rules: DataFrame) -> DataFrame:
    """``.side`` and ``.opposite`` in rules become left and right, in two rows each."""
    sides = F.explode(F.array(*(F.struct(F.lit(a).alias("side"), F.lit(b).alias("opposite")) for a, b in (("left", "right"), ("right", "left")))))
    general = F.col("region").contains(".side") | F.col("region").contains(".opposite")
    wide = rules.where(general).withColumn("s_", sides)
    text = F.replace(F.replace("region", F.lit(".side"), F.concat(F.lit("_"), "s_.side")), F.lit(".opposite"), F.concat(F.lit("_"), "s_.opposite"))
    out = wide.withColumn("region", text).withColumn("bundle", F.concat("bundle", F.lit("_"), "s_.side")).drop("s_")
    return rules.where(~general).unionByName(out)


def region_set(regions: DataFrame, pattern: str) -> DataFrame:
    """Regions whose names match a wildcard set (``*`` for any letters)."""
    return regions.where(F.col("region").rlike("^" + pattern.replace(".", "\\.").replace("*", ".*") + "$"))
