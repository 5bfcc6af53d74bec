"""Cohort tables, profile files and results as text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.vectors import format_number


def read_cohort(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str], str]:
    """The table, its ``# key=value`` directives and its mode: ``group`` or ``target``.

    The first line that isn't a comment is the header; the first column is ``subject_id``, the second names the
    mode, the others are confounds. Values must be numbers, groups 0 or 1.
    """
    lines = spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")
    directives = {k.strip(): v.strip() for r in lines.where("value rlike '^#.*='").collect() for k, v in [r["value"].lstrip("# ").split("=", 1)]}
    rows = lines.where("not value rlike '^#'").select(F.split("value", r"\s+").alias("c"))
    header = next((r["c"] for r in rows.where(F.col("c")[0] == "subject_id").limit(1).collect()), None)
    if not header or len(header) < 2 or header[1] not in ("group", "target"):
        raise ValueError(f"{path} has no header subject_id, then group or target")
    body = rows.where(F.col("c")[0] != "subject_id")
    table = body.select(F.col("c")[0].alias(header[0]), *(F.try_element_at("c", F.lit(i + 1)).try_cast("double").alias(n) for i, n in enumerate(header) if i))
    bad = F.greatest(*(F.col(n).isNull() for n in header[1:])) if len(header) > 2 else F.col(header[1]).isNull()
    if header[1] == "group":
        bad = bad | ~F.col("group").isin(0.0, 1.0)
    if wrong := table.where(bad).limit(3).collect():
        raise ValueError(f"not numeric, or no group: {wrong}")
    return table, directives, header[1]


def read_profiles(spark: SparkSession, paths: str | list[str], pattern: str = r"([^/]*)\.csv$") -> DataFrame:
    """Wide files with ``;``, one for each subject, as ``subject, bundle, position, mean``. Files share a header."""
    wide = spark.read.csv(paths, sep=";", header=True, inferSchema=False)
    names = wide.columns
    own = wide.select("*", F.col("_metadata.file_path").alias("path_"), F.col("_metadata.file_block_start").alias("block_"), F.monotonically_increasing_id().alias("id_"))
    w = Window.partitionBy("path_").orderBy("block_", "id_")
    numbered = own.withColumn("position", F.row_number().over(w) - 1).withColumn("subject", F.regexp_extract("path_", pattern, 1))
    cast = numbered.select("subject", "position", *(F.col(f"`{n}`").cast("double").alias(n) for n in names))
    return cast.unpivot(["subject", "position"], [F.col(f"`{n}`") for n in names], "bundle", "mean")


def wide_profiles(profiles: DataFrame, names: list[str], value: str = "mean", by: tuple[str, ...] = ()) -> DataFrame:
    """Positions by bundle, for each of ``by``."""
    return profiles.groupBy(*by, "position").pivot("bundle", names).agg(F.first(value)).orderBy(*by, "position")


def write_profiles_wide(profiles: DataFrame, path: str, names: list[str]) -> None:
    """S3: position by bundle in the catalogue's order, one file for a subject."""
    wide_profiles(profiles, names).drop("position").coalesce(1).write.csv(path, sep=";", header=True)


def format_results(results: DataFrame) -> DataFrame:
    return results.select(*(format_number(c).alias(c) if t == "double" else F.col(c) for c, t in results.dtypes))


def write_results(results: DataFrame, path: str) -> None:
    """S9."""
    format_results(results).coalesce(1).write.csv(path, header=True)


def ingest_gradients(spark: SparkSession, bvals: str, bvecs: str) -> DataFrame:
    """``idx, bval, gx, gy, gz`` from a row of b-values and three rows (or three columns) of directions."""
    def numbers(path: str) -> DataFrame:
        text = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace(F.regexp_replace("value", "^\\s+|\\s+$", ""), "[\\t, ]+", " "), " ?\\r?\\n").alias("rows"))
        return text.select(F.posexplode(F.transform("rows", lambda r: F.transform(F.split(F.trim(r), " "), lambda x: x.cast("double")))).alias("row", "v"))

    b = numbers(bvals).select(F.posexplode("v").alias("idx", "bval"))
    g = numbers(bvecs).select("row", F.posexplode("v").alias("col", "x"))
    lying = g.agg(F.max("row").alias("rows_")).select((F.col("rows_") <= 2).alias("lying_"))
    placed = g.crossJoin(F.broadcast(lying)).select(F.when(F.col("lying_"), F.col("col")).otherwise(F.col("row")).alias("idx"), F.when(F.col("lying_"), F.col("row")).otherwise(F.col("col")).alias("axis"), "x")
    axes = placed.groupBy("idx").agg(*(F.max(F.when(F.col("axis") == k, F.col("x"))).alias(n) for k, n in enumerate(("gx", "gy", "gz"))))
    return b.join(axes, "idx")
