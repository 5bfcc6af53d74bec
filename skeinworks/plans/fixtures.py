"""Spatial tables out of the star schema's, as DataFrames and as SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

GRID = (50, 50, 50)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """50 x 50 x 50 cells, 7 subjects, 3 bundles."""
    return table(spark, sf_dir, "lineitem").groupBy(
        F.col("l_linenumber").cast("int").alias("subject"), F.col("l_returnflag").alias("bundle"), (F.col("l_quantity").cast("int") - 1).alias("x"),
        (F.col("l_partkey") % 50).cast("int").alias("y"), (F.col("l_suppkey") % 50).cast("int").alias("z"),
    ).agg(F.round(F.avg("l_discount") * 10, 6).alias("value"))


def mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return voxels(spark, sf_dir).where(F.col("value") > 0.5).select("subject", "bundle", "x", "y", "z")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicted 3-vector and three candidates in a row."""
    e = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id", F.col("label").alias("bundle"), (F.col("vec_id") % 10).cast("int").alias("x"), (F.floor(F.col("vec_id") / 10) % 10).cast("int").alias("y"),
        F.floor(F.col("vec_id") / 100).cast("int").alias("z"), F.slice(e, 1, 3).alias("pred"), F.slice(e, 4, 9).alias("cand"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty probabilities for each cell, by ``direction`` 1 to 30."""
    some = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.slice("embedding", 1, 30)).alias("d", "e"))
    prob = 1 / (1 + F.exp(-4 * F.col("e").cast("double")))
    return some.select("vec_id", (F.col("d") + 1).cast("int").alias("direction"), prob.alias("prob")).join(vectors(spark, sf_dir).select("vec_id", "bundle", "x", "y", "z"), "vec_id")


def line_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of polylines: 10 subjects, 5 bundles."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    x = F.timestamp_diff("MICROSECOND", start, F.col("ts").cast("timestamp_ntz")).cast("double") / 1e6 / 54000
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 10).cast("int").alias("subject"), F.col("event_type").alias("bundle"), F.col("user_id").alias("line_id"),
        (F.row_number().over(w) - 1).alias("pos"), x.alias("x"), (F.col("value") / 10).alias("y"), (F.col("event_id") % 50).cast("double").alias("z"),
    )


def line_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first points of :func:`line_points`, those of ``pos`` 0: a minimum, which takes one row of a line from a task and not all of them."""
    first = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id", "value")).alias("e"))
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    x = F.timestamp_diff("MICROSECOND", start, F.col("e.ts").cast("timestamp_ntz")).cast("double") / 1e6 / 54000
    return first.select(
        (F.col("user_id") % 10).cast("int").alias("subject"), F.col("event_type").alias("bundle"), F.col("user_id").alias("line_id"),
        F.lit(0).alias("pos"), x.alias("x"), (F.col("e.value") / 10).alias("y"), (F.col("e.event_id") % 50).cast("double").alias("z"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points gathered: ``points`` is an array of structs x, y, z."""
    return gather(line_points(spark, sf_dir))


def gather(points: DataFrame) -> DataFrame:
    own = F.transform(F.array_sort(F.collect_list(F.struct("pos", "x", "y", "z"))), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z")))
    return points.groupBy("subject", "bundle", "line_id").agg(own.alias("points"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """3 bundles, 50 positions, 40 subjects."""
    return table(spark, sf_dir, "lineitem").groupBy(
        (F.col("l_suppkey") % 40).cast("int").alias("subject"), F.col("l_returnflag").alias("bundle"), (F.col("l_quantity").cast("int") - 1).alias("position"),
    ).agg(F.avg("l_discount").alias("mean"), F.stddev_pop("l_discount").alias("std"), F.count("*").alias("n"))


def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = (F.col("s_suppkey") % 40).cast("int")
    return table(spark, sf_dir, "supplier").groupBy(s.alias("subject")).agg(F.avg("s_acctbal").alias("target")).select(
        "subject", (F.col("subject") % 2).alias("grp"), (20 + (F.col("subject") * 7) % 40).alias("age"), (F.floor(F.col("subject") / 3) % 2).cast("int").alias("sex"), "target",
    )


def binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("truth"), (1 - F.col("toxic")).alias("pred"))


def metrics_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        (F.col("user_id") % 3).cast("int").alias("run"), F.when(F.col("user_id") % 2 == 0, "train").otherwise("validate").alias("split"),
        F.dayofmonth("ts").alias("epoch"), F.col("event_id").alias("batch"), F.col("event_type").alias("metric"), "value",
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns (x, y), each of the region that most rows name there (the last name of several)."""
    side = F.when(F.col("l_quantity") <= 25, "left").otherwise("right")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_quantity").cast("int") - 1).alias("x"), (F.col("l_partkey") % 50).cast("int").alias("y"), F.concat("l_returnflag", F.lit("_"), side).alias("region"))
    return rows.groupBy("x", "y", "region").count().groupBy("x", "y").agg(F.max(F.struct("count", "region"))["region"].alias("region"))


#: The same rows in SQL, as common table expressions.
SQL = {
    "voxels": """SELECT CAST(l_linenumber AS INT) AS subject, l_returnflag AS bundle, CAST(l_quantity AS INT)-1 AS x, CAST(l_partkey%50 AS INT) AS y,
 CAST(l_suppkey%50 AS INT) AS z, round(avg(l_discount)*10,6) AS value FROM lineitem GROUP BY ALL""",
    "mask": "SELECT subject,bundle,x,y,z FROM voxels WHERE value > 0.5",
    "vectors": """SELECT vec_id, label AS bundle, CAST(vec_id%10 AS INT) AS x, CAST((vec_id//10)%10 AS INT) AS y, CAST(vec_id//100 AS INT) AS z,
 CAST(embedding[1:3] AS DOUBLE[]) AS pred, CAST(embedding[4:12] AS DOUBLE[]) AS cand FROM embeddings""",
    "predictions": """SELECT v.vec_id, v.bundle, v.x, v.y, v.z, CAST(d AS INT) AS direction, 1/(1+exp(-4*CAST(e.embedding[d] AS DOUBLE))) AS prob
 FROM vectors v JOIN embeddings e USING (vec_id), range(1,31) t(d)""",
    "line_points": """SELECT CAST(user_id%10 AS INT) AS subject, event_type AS bundle, user_id AS line_id,
 CAST(row_number() OVER (PARTITION BY user_id,event_type ORDER BY ts,event_id)-1 AS INT) AS pos,
 (epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-01'))/1e6/54000 AS x, value/10 AS y, CAST(event_id%50 AS DOUBLE) AS z FROM events""",
    "profiles": """SELECT CAST(l_suppkey%40 AS INT) AS subject, l_returnflag AS bundle, CAST(l_quantity AS INT)-1 AS position,
 avg(l_discount) AS mean, stddev_pop(l_discount) AS std, count(*) AS n FROM lineitem GROUP BY ALL""",
    "cohort": """SELECT CAST(s_suppkey%40 AS INT) AS subject, CAST(s_suppkey%40 AS INT)%2 AS grp, 20+(CAST(s_suppkey%40 AS INT)*7)%40 AS age,
 (CAST(s_suppkey%40 AS INT)//3)%2 AS sex, avg(s_acctbal) AS target FROM supplier GROUP BY ALL""",
    "binary": "SELECT doc_id, quality AS truth, 1-toxic AS pred FROM labels",
    "metrics_log": """SELECT CAST(user_id%3 AS INT) AS run, CASE WHEN user_id%2=0 THEN 'train' ELSE 'validate' END AS split, CAST(day(ts) AS INT) AS epoch,
 event_id AS batch, event_type AS metric, value FROM events""",
    "regions": """SELECT x, y, region FROM (SELECT *, row_number() OVER (PARTITION BY x,y ORDER BY n DESC, region DESC) AS k FROM (
 SELECT CAST(l_quantity AS INT)-1 AS x, CAST(l_partkey%50 AS INT) AS y, l_returnflag||'_'||CASE WHEN l_quantity<=25 THEN 'left' ELSE 'right' END AS region, count(*) AS n
 FROM lineitem GROUP BY ALL)) WHERE k=1""",
}


NEEDS = {"mask": ["voxels"], "predictions": ["vectors"]}


def sql(body: str, *names: str) -> str:
    """``body`` behind the tables that it names."""
    order: list[str] = []
    for n in names:
        order += [x for x in [*NEEDS.get(n, []), n] if x not in order]
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({SQL[n]})" for n in order) + (",\n" if body.lstrip().startswith("+") else "\n") + body.lstrip().removeprefix("+")
