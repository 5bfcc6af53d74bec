"""Random forests of two classes, one for each group, all grown together (Breiman, 2001; histograms as in Panda et al., "PLANET", 2009).

Group, tree and node are a key, so a level of all trees of all groups is one aggregation of counts by bins, and one join that sends the
samples on to the nodes below. A model has a bounded number of nodes. To label points it goes to the tasks that have its group's, by shares of a bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import unit_hash
from ..plans.stash import stash
from ..plans.streams import by_group, changes

FEATURES = ["x", "y", "z"]
#: Bins of a feature, levels of a tree, features that a node may split by, points of a share.
BINS, DEPTH, TRIED, SHARE = 32, 6, 2, 100_000


def drawn(u: Column, most: int = 6) -> Column:
    """How often a bootstrap of as many rows draws one: Poisson with mean 1, from a uniform number."""
    ends, total = [], 0.0
    for k in range(most):
        total += math.exp(-1) / math.factorial(k)
        ends.append(total)
    return sum(((u >= e).cast("int") for e in ends[1:]), (u >= ends[0]).cast("int"))


def tried(seed: int, tree: int, node: int) -> list[int]:
    """The features that a node may split by."""
    return sorted(np.random.default_rng([seed, tree, node]).permutation(len(FEATURES))[:TRIED].tolist())


def best_split(n: np.ndarray, ones: np.ndarray, allowed: list[int]) -> tuple[int, int]:
    """Feature and last bin to the left with the least Gini impurity; (-1, 0) where no split lowers it. Arrays are features x bins."""
    total, positive = n[0].sum(), ones[0].sum()
    impurity = lambda a, b: 2 * b * (a - b) / np.maximum(a, 1)
    best, found = impurity(total, positive) - 1e-9, (-1, 0)
    for f in allowed:
        left, one = np.cumsum(n[f])[:-1], np.cumsum(ones[f])[:-1]
        cost = np.where((left > 0) & (left < total), impurity(left, one) + impurity(total - left, positive - one), np.inf)
        k = int(cost.argmin())
        if cost[k] < best:
            best, found = cost[k], (f, k)
    return found


def grown(points: DataFrame, label: str, key: str, by: list[str], trees: int = 10, depth: int = DEPTH, seed: int = 0) -> DataFrame:
    """``by.., tree, node, feature, cut, share``: the nodes of each group's trees, the root 1, children 2n (below ``cut``) and 2n + 1.

    A leaf has feature -1; ``share`` is that of ones. Rows without a label or with a null coordinate don't count; a group without any labels has no nodes.
    """
    finite = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in FEATURES)
    known = points.where(F.col(label).isNotNull()).where(finite).select(*by, F.col(key).cast("string").alias("key_"), *(F.col(c).cast("double").alias(c) for c in FEATURES), F.col(label).cast("int").alias("y_"))
    ranges = known.groupBy(*by).agg(*(f(c).alias(f"{n}{c}_") for c in FEATURES for f, n in ((F.min, "lo"), (F.max, "hi"))))
    weighted = known.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
    weighted = weighted.withColumn("w_", drawn(unit_hash(F.concat_ws(":", F.lit(str(seed)), F.col("tree").cast("string"), "key_"))))
    step = {c: (F.col(f"hi{c}_") - F.col(f"lo{c}_")) / BINS for c in FEATURES}
    own = F.array(*(F.when(step[c] > 0, F.least(F.floor((F.col(c) - F.col(f"lo{c}_")) / step[c]), F.lit(BINS - 1))).otherwise(0).cast("int") for c in FEATURES))
    samples = weighted.where("w_ > 0").join(ranges, by).select(*by, "tree", F.lit(1).alias("node"), own.alias("bins_"), "y_", "w_")
    samples = stash(samples, "samples")
    edges = stash(ranges, "ranges")
    keys = [*by, "tree"]
    schema = T.StructType([*(samples.schema[c] for c in keys), *(T.StructField(c, t) for c, t in (("node", T.IntegerType()), ("feature", T.IntegerType()), ("bin", T.IntegerType()), ("share", T.DoubleType())))])
    levels = []
    for level in range(depth + 1):
        counts = samples.select(*keys, "node", "y_", "w_", F.posexplode("bins_").alias("feature", "bin")).groupBy(*keys, "node", "feature", "bin").agg(F.sum("w_").alias("n"), F.sum(F.col("w_") * F.col("y_")).alias("ones"))

        def work(table: pa.Table, last: bool = level == depth) -> Iterator[pa.RecordBatch]:
            begin = changes(table, [*keys, "node"])
            rows: dict[str, list] = {"node": [], "feature": [], "bin": [], "share": []}
            for a, b in zip(begin.tolist(), [*begin[1:].tolist(), table.num_rows], strict=True):
                one = table.slice(a, b - a)
                at = one.column("feature").to_numpy(), one.column("bin").to_numpy()
                n, ones = np.zeros((2, len(FEATURES), BINS))
                n[at], ones[at] = one.column("n").to_numpy(), one.column("ones").to_numpy()
                node, tree = one.column("node")[0].as_py(), one.column("tree")[0].as_py()
                feature, cut = (-1, 0) if last else best_split(n, ones, tried(seed, tree, node))
                if feature < 0 and not last:  # none of those lowers the impurity
                    feature, cut = best_split(n, ones, list(range(len(FEATURES))))
                for name, v in (("node", node), ("feature", feature), ("bin", cut), ("share", ones[0].sum() / n[0].sum())):
                    rows[name].append(v)
            head = table.select(keys).take(pa.array(begin))
            for name, kind in (("node", pa.int32()), ("feature", pa.int32()), ("bin", pa.int32()), ("share", pa.float64())):
                head = head.append_column(name, pa.array(rows[name], kind))
            yield from head.combine_chunks().to_batches()

        nodes = stash(by_group(counts, keys, work, schema, ["node"]), "nodes")
        levels.append(nodes)
        inner = nodes.where("feature >= 0").select(*keys, "node", "feature", "bin")
        if level == depth or inner.isEmpty():
            break
        below = F.col("node") * 2 + (F.get("bins_", F.col("feature")) > F.col("bin")).cast("int")
        samples = stash(samples.join(inner, [*keys, "node"]).select(*keys, below.alias("node"), "bins_", "y_", "w_"), "samples")
    model = levels[0]
    for nodes in levels[1:]:
        model = model.unionByName(nodes)
    cut = F.coalesce(*(F.when(F.col("feature") == k, F.col(f"lo{c}_") + (F.col("bin") + 1) * (F.col(f"hi{c}_") - F.col(f"lo{c}_")) / BINS) for k, c in enumerate(FEATURES)))
    return model.join(edges, by).select(*keys, "node", "feature", cut.alias("cut"), "share")


def labelled(points: DataFrame, model: DataFrame, key: str, by: list[str]) -> DataFrame:
    """``points`` with ``side``: 1 where the mean share of the leaves that a point falls into is over a half, else 0; null without a model or a coordinate."""
    packed = model.groupBy(*by).agg(F.collect_list(F.struct("tree", "node", "feature", "cut", "share")).alias("nodes_"))
    shares = points.groupBy(*by).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares_"))
    rows = points.join(shares, by).withColumn("share_", F.pmod(F.xxhash64(key), F.col("shares_")).cast("int")).drop("shares_").select(*by, "share_", F.lit(1).alias("kind_"), F.struct(*points.columns).alias("point_"))
    models = packed.join(shares, by).withColumn("share_", F.explode(F.sequence(F.lit(0), F.col("shares_") - 1))).select(*by, "share_", F.lit(0).alias("kind_"), "nodes_")
    both = models.unionByName(rows, allowMissingColumns=True)
    keys = [*by, "share_"]
    columns = points.columns
    schema = T.StructType([*points.schema.fields, T.StructField("side", T.IntegerType())])

    def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
        begin = changes(table, keys)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), table.num_rows], strict=True):
            one = table.slice(a, b - a)
            has = one.column("kind_")[0].as_py() == 0
            point = one.column("point_").combine_chunks().slice(int(has))
            if not len(point):
                continue
            fields = [point.field(columns.index(c)) for c in columns]
            xyz = np.stack([point.field(columns.index(c)).cast(pa.float64()).to_numpy(zero_copy_only=False) for c in FEATURES], axis=1)
            score = votes(one.column("nodes_")[0].values, xyz) if has else np.full(len(xyz), np.nan)
            known = np.isfinite(score) & np.isfinite(xyz).all(axis=1)
            yield pa.RecordBatch.from_arrays([*fields, pa.array((score > 0.5).astype(np.int32), mask=~known)], [*columns, "side"])

    return by_group(both, keys, work, schema, ["kind_"])


def votes(nodes: pa.StructArray, xyz: np.ndarray) -> np.ndarray:
    """The mean share over all trees."""
    tree, node, feature, cut, share = (nodes.field(c).to_numpy(zero_copy_only=False) for c in ("tree", "node", "feature", "cut", "share"))
    out = np.zeros(len(xyz))
    known = np.unique(tree)
    for t in known:
        mine = tree == t
        wide = int(node[mine].max()) + 1
        f, c, s = np.full(wide, -1), np.zeros(wide), np.zeros(wide)
        f[node[mine]], c[node[mine]], s[node[mine]] = feature[mine], np.nan_to_num(cut[mine].astype(float)), share[mine]
        at = np.ones(len(xyz), np.int64)
        while (inner := np.flatnonzero(f[at] >= 0)).size:
            here = at[inner]
            at[inner] = 2 * here + (xyz[inner, f[here]] >= c[here])
        out += s[at]
    return out / len(known)
