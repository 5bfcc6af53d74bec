"""Merkle manifest of a dataset: proofs of membership for every row, by nested-interval labels.

Leaves are numbered within their group, and a node of level k covers an interval of 2^k ranks, of which
the last is cut off. An ancestor's interval contains its descendants', so ancestors are attached by
containment joins, bucketed by level and by the interval's place in it; what an ancestor's interval holds
besides its child's is the sibling's.

Levels come in tiers of ``TIER``. Going up, the nodes below one top of a tier meet once, and a tier's tops are
the next one's leaves. Going down, nodes get siblings of their own tier only, and join the siblings of their top: the
rows of a join are leaves times ``TIER``, not leaves times all levels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stash import scratch, stash
from .huffman import small

#: Levels of a tier: 64 nodes under a top.
TIER = 6


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """A value as ``bytes:value``, or ``-`` if null."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_hash(columns: list[Column]) -> Column:
    return digest(*(field(c) for c in columns))


def ranked(df: DataFrame, group: str, order: list[str]) -> DataFrame:
    """``df`` with ``lo``, its rank in its group from 0, and ``n``, the group's rows; a stored table.

    Rows are dealt by ranges of (group, order), whose sizes alone reach the driver, so that neither a group nor the
    table is one task's. Nulls come first, equal rows get ranks as they come.
    """
    spark = df.sparkSession
    with scratch() as keep:
        spread = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order).withColumn("at_", F.monotonically_increasing_id())
        spread = stash(spread, "ranges")
        part = F.shiftright("at_", 33)
        begin, at = [], 0
        for r in spread.groupBy(part.alias("part_")).agg(F.count("*").alias("n_")).orderBy("part_").collect():
            begin.append((r["part_"], at))
            at += r["n_"]
        table = spark.createDataFrame(begin, "part_ long, begin_ long")
        place = F.col("begin_") + F.col("at_").bitwiseAND(F.lit((1 << 33) - 1))
        placed = spread.withColumn("part_", part).join(F.broadcast(table), "part_").select(*df.columns, place.alias("place_"))
        groups = stash(placed.groupBy(F.col(group).alias("group_")).agg(F.min("place_").alias("first_"), F.count("*").alias("n")), "groups")
        known = F.broadcast(groups) if small(groups) else groups
        out = placed.join(known, F.col(group).eqNullSafe(F.col("group_")), "left").select(*df.columns, (F.col("place_") - F.col("first_")).alias("lo"), "n")
        return keep(stash(out, "ranked"))


def paired(below: Column) -> Callable[[Column], Column]:
    """Of a place in a level the node over its children, one or two of those ``below``."""

    def node(i: Column) -> Column:
        left, right = below[2 * i], F.get(below, 2 * i + 1)
        over = F.when(right.isNull(), digest(left["hash"])).otherwise(digest(left["hash"], right["hash"]))
        return F.struct(left["lo"].alias("lo"), F.coalesce(right["hi"], left["hi"]).alias("hi"), over.alias("hash"))

    return node


def tier_nodes(items: DataFrame, depth: int) -> DataFrame:
    """``group, n, level, lo, hi, hash`` of the levels ``depth .. depth + TIER`` above ``items``, the nodes of level ``depth``.

    A level ends its tree where one node is left. A node without a neighbour is hashed alone.
    """
    top = F.shiftright("lo", depth + TIER)
    node = F.struct("lo", "hi", "hash")
    now = items.groupBy("group", "n", top.alias("top")).agg(F.array_sort(F.collect_list(node)).alias(f"l{depth}"))
    for k in range(depth + 1, depth + TIER + 1):
        more = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(f"l{k - 1}") - 1, 1)), paired(F.col(f"l{k - 1}")))
        now = now.withColumn(f"l{k}", F.when(F.col("n") > (1 << (k - 1)), more))
    levels = F.array(*(F.struct(F.lit(k).alias("level"), F.col(f"l{k}").alias("nodes")) for k in range(depth, depth + TIER + 1)))
    flat = now.select("group", "n", F.explode(levels).alias("l")).where("l.nodes IS NOT NULL").select("group", "n", "l.level", F.explode("l.nodes").alias("x"))
    return flat.select("group", "n", "level", "x.lo", "x.hi", "x.hash")


def siblings(items: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """``group, lo, proof`` of ``items``: of each level of the tier, from below, what the parent covers besides the item's own ancestor.

    An entry has ``hash``, null where the ancestor is alone, and ``left``, whether that stands before it.
    """
    levels = F.explode_outer(F.expr(f"filter(sequence({depth}, {depth + TIER - 1}), k -> n > shiftleft(1L, k))")).alias("level")
    paths = items.select("group", "n", "lo", levels).withColumn("bucket", F.expr("shiftright(lo, level + 1)"))
    inside = nodes.where(F.col("level") < depth + TIER).select("group", "level", F.expr("shiftright(lo, level + 1)").alias("bucket"), F.col("lo").alias("from_"), F.col("hi").alias("to_"), "hash")
    same = paths["group"].eqNullSafe(inside["group"]) & (paths["level"] == inside["level"]) & (paths["bucket"] == inside["bucket"])
    own = (F.col("from_") <= F.col("lo")) & (F.col("lo") < F.col("to_"))
    entry = F.struct(paths["level"].alias("level"), (F.col("from_") < F.col("lo")).alias("left"), "hash")
    met = paths.join(inside, same & ~own, "left").groupBy(paths["group"], "lo").agg(F.array_sort(F.collect_list(F.when(paths["level"].isNotNull(), entry))).alias("proof"))
    return met.select("group", "lo", F.transform("proof", lambda e: F.struct(e["left"].alias("left"), e["hash"].alias("hash"))).alias("proof"))


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trees over ``leaves(group, n, lo, hash)`` with ranks from 0: ``group, lo, proof`` of each leaf, and ``group, root``.

    A group of one leaf has that as its root, and an empty proof.
    """
    most = leaves.agg(F.max("n")).first()[0] or 0
    items, depth, tiers = leaves.select("group", "n", "lo", (F.col("lo") + 1).alias("hi"), "hash"), 0, []
    while not tiers or most > 1 << depth:
        nodes = stash(tier_nodes(items, depth), "tier")
        tiers.append((items, nodes, depth))
        depth += TIER
        items = nodes.where((F.col("level") == depth) & (F.col("n") > 1 << depth)).drop("level")
    roots, proofs = None, None
    for items, nodes, low in reversed(tiers):
        top = nodes.where("lo = 0 AND hi = n").select("group", F.col("hash").alias("root"))
        roots = top if roots is None else roots.unionByName(top)
        own = siblings(items, nodes, low)
        if proofs is not None:
            up = proofs.select(F.col("group").alias("group_"), F.shiftright("lo", low + TIER).alias("bucket_"), F.col("proof").alias("up_"))
            on = own["group"].eqNullSafe(up["group_"]) & (F.shiftright("lo", low + TIER) == F.col("bucket_"))
            rest = F.coalesce("up_", F.array().cast(own.schema["proof"].dataType))
            own = own.join(up, on, "left").select("group", "lo", F.concat("proof", rest).alias("proof"))
        proofs = own
    return proofs, roots


def manifest(leaves: DataFrame, group_col: str, order: list[str], hash_col: str = "leaf") -> DataFrame:
    """``leaves`` with ``subroot``, ``root`` and ``proof``: a tree for each value of ``group_col``, and one over the trees' roots.

    Leaves stand by ``order``, equal rows as they come; groups by value, null first. ``proof`` has an entry for each level,
    from the leaf up: ``hash`` of the sibling, null where there is none, and ``left``, whether it stands before. Ids and
    groups may be null or repeated: each row is a leaf of its own. An empty table has an empty manifest. The result is a stored table.
    """
    with scratch() as keep:
        first = ranked(leaves.withColumnRenamed(group_col, "group").withColumnRenamed(hash_col, "hash"), "group", order)
        proofs, roots = forest(first)
        tops = ranked(stash(roots, "roots").distinct().select(F.lit(0).alias("all"), F.col("group").alias("of"), F.col("root").alias("hash")), "all", ["of"])
        over, whole = forest(tops.withColumnRenamed("all", "group"))
        tops = tops.join(over.withColumnRenamed("group", "all").withColumnRenamed("proof", "over"), ["all", "lo"]).crossJoin(F.broadcast(stash(whole.select("root"), "root").limit(1)))
        tops = stash(tops.select("of", F.col("hash").alias("subroot"), "root", "over"), "tops")
        known = F.broadcast(tops) if small(tops, 10_000) else tops
        proved = first.join(proofs.withColumnRenamed("group", "group_").withColumnRenamed("lo", "lo_"), F.col("group").eqNullSafe(F.col("group_")) & (F.col("lo") == F.col("lo_")))
        out = proved.join(known, F.col("group").eqNullSafe(F.col("of"))).withColumn("proof", F.concat("proof", "over"))
        names = {group_col: "group", hash_col: "hash"}
        return keep(stash(out.select(*(F.col(names.get(c, c)).alias(c) for c in leaves.columns), "subroot", "root", "proof"), "manifest"))


def proof_hash(proof: str = "proof") -> Column:
    """The digest of a proof's siblings in order."""
    return F.sha2(F.array_join(F.filter(F.transform(proof, lambda e: e["hash"]), lambda h: h.isNotNull()), ""), 256)


def folded(leaf: Column, proof: str = "proof") -> Column:
    """The root that a leaf and a proof give."""

    def up(below: Column, e: Column) -> Column:
        return F.when(e["hash"].isNull(), digest(below)).when(e["left"], digest(e["hash"], below)).otherwise(digest(below, e["hash"]))

    return F.aggregate(proof, leaf, up)
