"""Cutting lineage with tables in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting that lets go of a query's shuffle files when it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where the setting is missing, a session that runs in one process (tests) gets a temporary one;
    on a cluster, where executors don't share such a folder, that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="skeinworks-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Within, a query's shuffle files go as soon as it has ended; the session's own setting comes back behind it."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Tables that the innermost :func:`scratch` will delete.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes the tables that are stashed within, but for those that are passed to what it yields.

    Where one stands in another, what the inner one keeps is the outer one's to delete.
    """
    outer, own = _made.get(), []
    token = _made.set(own)

    def keep(df: DataFrame) -> DataFrame:
        if not any(t is df for t in own):
            raise ValueError("only a table that was stashed here can be kept")
        own[:] = [t for t in own if t is not df]
        if outer is not None:
            outer.append(df)
        return df

    try:
        yield keep
    finally:
        _made.reset(token)
        unstash(*own)


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Writes ``df`` once as Parquet in the shared folder and reads it back.

    What follows reads files that outlive any executor, and the work above is not done twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with tidy(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: its rows' numbers from 1 in that order. Ranges of rows are counted; no task has them all."""
    spread = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at_", F.monotonically_increasing_id())
    spread = stash(spread, "ranges")
    part = F.shiftright("at_", 33)
    sizes = spread.groupBy(part.alias("part_")).agg(F.count("*").alias("n_")).orderBy("part_").collect()
    begin, at = [], 0
    for r in sizes:
        begin.append((r["part_"], at))
        at += r["n_"]
    table = df.sparkSession.createDataFrame(begin, "part_ long, begin_ long")
    placed = spread.withColumn("part_", part).join(F.broadcast(table), "part_")
    return placed.withColumn(name, (F.col("begin_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int")).drop("at_", "part_", "begin_")


def delete(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of any file system that Spark knows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def unstash(*tables: DataFrame) -> None:
    """Deletes tables of :func:`stash` that nothing reads any more."""
    for df in tables:
        delete(df.sparkSession, df.stashed_at)
