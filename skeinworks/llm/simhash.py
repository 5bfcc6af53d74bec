"""SimHash fingerprints and links between them by the generalised pigeonhole principle.

If two 64-bit fingerprints differ in at most ``tau`` bits and the bits are dealt to ``m`` partitions
with thresholds that add up to ``tau - m + 1``, then some partition differs in no more bits than its
threshold (Qin et al., "GPH", 2018). Correlated bits share a partition, so that the other
partitions stay selective; a dynamic program gives each partition its threshold (-1: not probed).
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.components import components
from ..plans.stash import stash, tidy, unstash
from .columns import distinct, hash_column, mixed, own_places, pieces, words

BITS = 64


# Fingerprints


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A fingerprint for each group of consecutive hashes: the bits set in over half of them."""
    out = np.zeros(len(counts), np.uint64)
    at = 0
    for i, n in enumerate(counts.tolist()):
        if n:
            bits = np.unpackbits(hashes[at : at + n].view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
            ones = bits.sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0]
            at += n
    return out


def shingle_hashes(texts: pa.Array, size: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's shingles of ``size`` lower-cased words, repeats included, and their number.

    Fewer words than ``size`` make one shingle of all; none make none.
    """
    from xxhash import xxh64_intdigest

    w = words(texts, lower=True)
    n = len(w.start)
    joined = np.full(len(w.packed) + n, 32, np.uint8)
    lengths = w.lengths
    joined[np.arange(len(w.packed)) + np.repeat(np.arange(n), lengths)] = w.packed
    end = np.cumsum(lengths) + np.arange(n)
    start = end - lengths
    counts = np.where(w.counts, np.maximum(w.counts - size + 1, 1), 0)
    first = np.repeat(w.firsts()[:-1], counts) + own_places(counts)
    last = np.minimum(first + size, np.repeat(w.firsts()[1:], counts)) - 1
    raw = joined.tobytes()
    got = [xxh64_intdigest(raw[a:b], seed) for a, b in zip(start[first].tolist(), end[last].tolist(), strict=True)]
    return np.array(got, np.uint64), counts


def word_hashes(texts: pa.Array, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of each text's distinct lower-cased words."""
    from xxhash import xxh64_intdigest

    w = words(texts, lower=True)
    codes, names = w.coded()
    keys = distinct(w.row.astype(np.int64) << 32 | codes)
    table = np.array([xxh64_intdigest(k, seed) for k in names.to_pylist()], np.uint64)
    counts = np.bincount(keys >> 32, minlength=len(w.counts))
    return table[keys & 0xFFFFFFFF], counts


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, distinct_words: bool = False) -> DataFrame:
    """``id, fp`` for each row of ``df``; ``fp`` is the fingerprint as a signed long.

    Features are shingles of ``shingle`` words, or with ``distinct_words`` the text's distinct words.
    Null, empty and blank texts: 0. Other columns are not read; repeated rows are repeated.
    """
    cols = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            texts = batch.column("text")
            got = word_hashes(texts, seed) if distinct_words else shingle_hashes(texts, shingle, seed)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(majority(*got).view(np.int64))], ["id", "fp"])

    return cols.mapInArrow(hashed, "id long, fp long").withColumnRenamed("id", id_col)


# Partitions and thresholds


@dataclass(frozen=True)
class Plan:
    """Bits and threshold of each partition."""

    parts: tuple[tuple[int, ...], ...]
    thresholds: tuple[int, ...]


def bit_correlations(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints and the correlation of their bits, over all of them."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, both, n = np.zeros(BITS), np.zeros((BITS, BITS)), 0
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for at in range(0, len(fp), 1 << 16):
                x = unpacked(fp[at : at + (1 << 16)]).astype(np.float32)
                ones += x.sum(0, dtype=np.float64)
                both += x.T @ x
                n += len(x)
        values = np.concatenate([[n], ones, both.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values))), pa.array(values)], ["k", "v"])

    rows = fps.select("fp").mapInArrow(add, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).toPandas()
    v = np.zeros(1 + BITS + BITS * BITS)
    v[rows["k"].to_numpy()] = rows["v"].to_numpy()
    n = max(v[0], 1)
    p = v[1 : 1 + BITS] / n
    cov = v[1 + BITS :].reshape(BITS, BITS) / n - np.outer(p, p)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-9))
    return int(v[0]), cov / np.outer(spread, spread)


def unpacked(fp: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fp).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(correlation: np.ndarray, m: int) -> tuple[tuple[int, ...], ...]:
    """Deals the bits to ``m`` partitions of about the same width, the most correlated ones together."""
    strength = np.abs(correlation) - np.eye(BITS)
    free, parts = set(range(BITS)), []
    for k in range(m):
        width = BITS // m + (k < BITS % m)
        pool = sorted(free)
        part = [max(pool, key=lambda b: (strength[b, pool].sum(), -b))]
        free.discard(part[0])
        while len(part) < width:
            best = max(sorted(free), key=lambda b: (strength[b, part].sum(), -b))
            part.append(best)
            free.discard(best)
        parts.append(tuple(sorted(part)))
    return tuple(parts)


def within(width: int, radius: int) -> int:
    """How many keys differ in at most ``radius`` of ``width`` bits."""
    total, term = 0, 1
    for r in range(radius + 1):
        total += term
        term = term * (width - r) // (r + 1)
    return total


def allocate(costs: np.ndarray, total: int) -> tuple[float, list[int]]:
    """Thresholds from -1 with the given sum and the least cost; ``costs[i, e + 1]``. A dynamic program over partitions."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for row in costs:
        new: dict[int, tuple[float, list[int]]] = {}
        for (s, (c, path)), (k, more) in itertools.product(best.items(), enumerate(row)):
            to = s + k - 1
            if to not in new or c + more < new[to][0]:
                new[to] = (c + more, [*path, k - 1])
        best = new
    return best.get(total, (np.inf, []))


#: What a row that is dealt out costs, in compared pairs.
ROW_COST = 60.0


def plan(n: int, correlation: np.ndarray, sample: np.ndarray, tau: int) -> Plan:
    """Partitions and thresholds with the least estimated cost for ``n`` fingerprints.

    ``sample`` (at most a few thousand fingerprints) gives the share of pairs that meet in a bucket.
    It bears on the cost alone; links are the same under every plan.
    """
    bits = unpacked(sample)
    best, found = np.inf, None
    for m in range(1, min(BITS, tau + 4)):
        parts = group_bits(correlation, m)
        most = min(4, tau)
        costs = np.full((m, most + 2), np.inf)
        for i, part in enumerate(parts):
            width = len(part)
            x = bits[:, part].astype(np.float32)
            if len(x) > 1:
                apart = (x.sum(1)[:, None] + x.sum(1)[None, :] - 2 * x @ x.T)[np.triu_indices(len(x), 1)]
                seen = np.bincount(np.rint(apart).astype(int), minlength=width + 1) / len(apart)
            else:
                seen = np.zeros(width + 1)
            chance = np.array([within(width, r) - (within(width, r - 1) if r else 0) for r in range(width + 1)]) / 2.0**width
            share = np.cumsum(np.maximum(seen, chance))
            costs[i, 0] = 0.0
            for e in range(min(most, width) + 1):
                radius = -(-e // 2)
                rows = within(width, radius)
                if rows > 600:
                    continue
                # Pairs meet once for each key between them; one that is ``e`` apart has up to C(e, e / 2).
                costs[i, e + 1] = n * rows * ROW_COST + 0.5 * n * n * share[e] * within(max(e, 1), radius)
        cost, thresholds = allocate(costs, tau - m + 1)
        if cost < best:
            best, found = cost, Plan(parts, tuple(thresholds))
    if found is None:
        raise ValueError(f"no plan for {tau} bits")
    return found


# Probing


def keys_of(fp: np.ndarray, part: tuple[int, ...]) -> np.ndarray:
    bits = unpacked(fp)[:, part].astype(np.int64)
    return bits @ (1 << np.arange(len(part), dtype=np.int64))


def masks(width: int, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All keys of at most ``radius`` ones, and how many."""
    out, flips = [0], [0]
    for r in range(1, radius + 1):
        for some in itertools.combinations(range(width), r):
            out.append(sum(1 << b for b in some))
            flips.append(r)
    return np.array(out, np.int64), np.array(flips, np.int8)


def entries(fps: DataFrame, how: Plan) -> DataFrame:
    """``part, key, flips, fp``: each fingerprint under the keys within half its partitions' thresholds."""
    used = [(i, p, t, *masks(len(p), -(-t // 2))) for i, (p, t) in enumerate(zip(how.parts, how.thresholds, strict=True)) if t >= 0]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for at in range(0, len(fp), 2048):
                some = fp[at : at + 2048]
                for i, part, _, mask, flips in used:
                    keys = (keys_of(some, part)[:, None] ^ mask[None, :]).ravel()
                    n = len(keys)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(keys), pa.array(np.tile(flips, len(some))), pa.array(np.repeat(some, len(mask)))], ["part", "key", "flips", "fp"])

    return fps.select("fp").mapInArrow(deal, "part int, key long, flips byte, fp long")


def linked_pairs(group: np.ndarray, flips: np.ndarray, side: np.ndarray, fp: np.ndarray, allowed: np.ndarray, tau: int, most: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Index pairs and distances within sorted groups, in bounded portions.

    ``allowed`` has each row's threshold: rows whose flips add up to more need not be compared here.
    ``side``: rows of a split bucket that are both of side 2 are compared elsewhere.
    """
    n = len(group)
    ends = np.searchsorted(group, group, "right")
    # Rows come with flips ascending, so a row with flips only meets rows with flips.
    counts = np.where((2 * flips > allowed), 0, ends - np.arange(n) - 1)
    ahead = np.cumsum(counts)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ahead, (ahead[at - 1] if at else 0) + most, "right")))
        c = counts[at:to]
        a = np.repeat(np.arange(at, to, dtype=np.int32), c)
        b = (a + 1 + own_places(c)).astype(np.int32)
        differ = np.bitwise_count((fp[a] ^ fp[b]).view(np.uint64))  # of a signed number it would count the absolute value's
        ok = (differ <= tau) & (differ > 0) & (flips[a] + flips[b] <= allowed[a]) & ~((side[a] == 2) & (side[b] == 2)) & ~((side[a] == 1) & (side[b] == 1))
        yield a[ok], b[ok], differ[ok]
        at = to


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Which of the pairs, taken in order, join two of ``n`` nodes that weren't joined yet."""
    label, kept, at, step = np.arange(n), [], 0, 4096
    while at < len(a):
        some = np.arange(at, min(len(a), at + step))
        some = some[label[a[some]] != label[b[some]]]
        up: dict[int, int] = {}
        for i, x, y in zip(some.tolist(), label[a[some]].tolist(), label[b[some]].tolist(), strict=True):
            x, y = _top(up, x), _top(up, y)
            if x != y:
                up[max(x, y)] = min(x, y)
                kept.append(i)
        if up:
            to = np.arange(n)
            to[list(up)] = [_top(up, x) for x in up]
            label = to[label]
        at += step
        step *= 2
    return np.array(kept, np.int64)


def _top(up: dict[int, int], x: int) -> int:
    while (y := up.get(x, x)) != x:
        up[x] = y = up.get(y, y)
        x = y
    return x


#: Rows of a bucket that one task compares with one another.
BLOCK = 4096


def links(fps: DataFrame, how: Plan, tau: int, block: int = BLOCK) -> DataFrame:
    """``a, b, distance``: a spanning forest, by ascending distance, of each bucket's links.

    ``fps`` has each fingerprint once. Fingerprints that the links join are joined here too, but a
    group of ``n`` gives a bucket ``n - 1`` rows, not all its pairs. Buckets of over ``block`` rows are
    split: their rows are dealt to blocks, and each pair of blocks is a bucket of its own.
    """
    rows = entries(fps, how)
    hot = rows.groupBy("part", "key").agg(F.count("*").alias("n")).where(F.col("n") > block)
    if hot.limit(1).count():
        hot = stash(hot.withColumn("blocks", F.ceil(F.col("n") / (block // 2)).cast("int")).select("part", "key", "blocks"), "hot")
        mine = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
        wide = rows.join(hot, ["part", "key"], "left").withColumn("mine", mine)
        other = F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))
        wide = wide.select("part", "key", "flips", "fp", "mine", other.alias("other"))
        pair = F.when(F.col("other") < 0, F.lit(-1).cast("long")).otherwise(F.least("mine", "other").cast("long") * (1 << 31) + F.greatest("mine", "other"))
        side = F.when((F.col("other") < 0) | (F.col("mine") == F.col("other")), 0).when(F.col("mine") < F.col("other"), 1).otherwise(2)
        rows = wide.select("part", "key", pair.alias("pair"), side.cast("byte").alias("side"), "flips", "fp")
    else:
        rows = rows.select("part", "key", F.lit(-1).cast("long").alias("pair"), F.lit(0).cast("byte").alias("side"), "flips", "fp")
    by_part = np.array(how.thresholds, np.int64)

    def compare(part: np.ndarray, group: np.ndarray, side: np.ndarray, flips: np.ndarray, fp: np.ndarray, out: list) -> None:
        """Buckets of more than a row, a bounded number of pairs at a time."""
        keep = np.bincount(group)[group] > 1
        part, group, side, flips, fp = (x[keep] for x in (part, group, side, flips, fp))
        if not len(part):
            return
        starts = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        size = np.diff(np.append(starts, len(group))).astype(np.int64)
        pairs = np.cumsum(size * size // 2)
        at = 0
        while at < len(starts):
            to = max(at + 1, int(np.searchsorted(pairs, (pairs[at - 1] if at else 0) + (1 << 23), "right")))
            one = slice(starts[at], starts[to] if to < len(starts) else len(group))
            found = linked_pairs(group[one], flips[one].astype(np.int64), side[one], fp[one], by_part[part[one]], tau)
            a, b, d = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.argsort(d, kind="stable")
            order = order[forest(a[order], b[order], len(fp[one]))]
            x, y = fp[one][a[order]], fp[one][b[order]]
            out.append((np.minimum(x, y), np.maximum(x, y), d[order].astype(np.int32)))
            at = to

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tail, size = [], None, 0

        def done(some: list[pa.RecordBatch], final: bool) -> pa.RecordBatch:
            """Compares whole buckets; the last one may go on in the next batch."""
            nonlocal tail
            t = pa.Table.from_batches(some)
            part, key, pair, side, flips, fp = (t[c].to_numpy() for c in ("part", "key", "pair", "side", "flips", "fp"))
            new = np.ones(len(part), bool)
            new[1:] = (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (pair[1:] != pair[:-1])
            stop = len(part) if final else int(np.flatnonzero(new)[-1])
            tail = None if final else t.slice(stop).combine_chunks().to_batches()
            out: list[tuple[np.ndarray, ...]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32))]
            if stop:
                compare(part[:stop], np.cumsum(new[:stop]) - 1, side[:stop], flips[:stop], fp[:stop], out)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["a", "b", "distance"])

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= 1 << 18:
                yield done(held, False)
                held = list(tail or [])
                size = sum(b.num_rows for b in held) if size > 1 << 19 else 0
        if held:
            yield done(held, True)

    by = ["part", "key", "pair"]
    return rows.repartition(*by).sortWithinPartitions(*by, "flips", "fp").mapInArrow(joined, "a long, b long, distance int")


def planned(fps: DataFrame, tau: int, sample: int = 2048) -> Plan:
    """A plan for all of ``fps``, from all their bits and the ``sample`` of them with the smallest hashes."""
    n, correlation = bit_correlations(fps)
    some = fps.orderBy(F.xxhash64("fp")).limit(sample).toPandas()["fp"].to_numpy() if n else np.zeros(0, np.int64)
    return plan(n, correlation, some, tau)


def simhash_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = 4, shingle: int = 4, seed: int = 42) -> DataFrame:
    """``id, fingerprint, component_id`` for each row of ``df``.

    ``component_id`` is the smallest id that links of at most ``tau`` differing bits reach, the row's own
    included. Empty and null texts have the fingerprint zero and are linked like others. Null ids are
    kept and never a component's id unless it has no other. An empty table gives an empty one.
    """
    with tidy(df.sparkSession):
        prints = stash(fingerprints(df, id_col, text_col, shingle, seed), "prints")
        classes = stash(prints.groupBy("fp").agg(F.min(id_col).alias("least")), "classes")
        roots = components(links(classes, planned(classes, tau), tau))
    named = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(first, "root").select("fp", "component_id")
    return prints.join(by_fp, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# Near duplicates of whole texts

#: Words in a shingle and least Jaccard similarity of near duplicates; bits that the first search lets their fingerprints differ.
SHINGLE, SIMILAR, SEARCH_BITS = 5, 0.8, 10
#: Classes, at most, whose ids and digests are broadcast to the documents' texts (24 bytes each); more are joined by a shuffle.
FEW = 200_000
#: How far apart the classes of a shingle are compared in the first round of the exact search, and how many times as far in the next ones.
NEAR, FURTHER = 2, 32


def shingle_set(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct shingles of lower-cased words; fewer words make one shingle, none make none."""
    w = words(texts, lower=True)
    codes, names = w.coded()
    h = hash_column(names)[codes]
    counts = np.where(w.counts, np.maximum(w.counts - size + 1, 1), 0)
    first = np.repeat(w.firsts()[:-1], counts) + own_places(counts)
    end = np.repeat(w.firsts()[1:], counts)
    total = np.zeros(len(first), np.uint64)
    for k in range(size):
        at = np.minimum(first + k, len(h) - 1)
        total = mixed(total * np.uint64(31) + np.where(first + k < end, h[at], np.uint64(0)) + np.uint64(k)) if len(first) else total
    ends = np.concatenate([[0], np.cumsum(counts)])
    return [distinct(total[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]


#: Documents, about, whose shingles say which ones are common, and the most that count as such.
SAMPLE, COMMONEST = 5_000, 1 << 15


def common_shingles(df: DataFrame, id_col: str, text_col: str, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that several documents of a sample have, ascending, and how many have them.

    They bear on the order in which shingles are searched by, hence on the cost, and not on what is found.
    """
    some = df.where(F.pmod(F.xxhash64(F.col(f"`{id_col}`")), F.lit(max(1, df.count() // SAMPLE))) == 0).select(F.col(f"`{text_col}`").cast("string").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 1 << 20):
            sets = shingle_set(batch.column("text"), size)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], ["h"])

    rows = some.mapInArrow(each, "h long").groupBy("h").agg(F.count("*").alias("n")).where("n > 2").orderBy(F.desc("n"), "h").limit(COMMONEST).toPandas()
    h, n = rows["h"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


def prefix(shingles: np.ndarray, common: tuple[np.ndarray, np.ndarray], similar: float) -> np.ndarray:
    """The first shingles, rare ones before common ones, of which two sets with that Jaccard similarity share one (Chaudhuri et al., 2006)."""
    known, n = common
    rank = np.zeros(len(shingles), np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, shingles), len(known) - 1)
        rank = np.where(known[at] == shingles, n[at], 0)
    most = len(shingles) - int(np.ceil(similar * len(shingles) - 1e-9)) + 1
    return shingles[np.argsort(rank, kind="stable")][: most if len(shingles) else 0]


#: Shingles to a bucket of a sketch, about, and its least and largest number of buckets.
BUCKET, FEWEST, MOST = 4, 64, 1 << 16


def sketch(shingles: np.ndarray) -> bytes:
    """How many of the shingles fall in each of a power of two of buckets; 255 stands for any larger number as well."""
    n = FEWEST
    while n < MOST and n * BUCKET < len(shingles):
        n *= 2
    return np.minimum(np.bincount((shingles % np.uint64(n)).astype(np.int64), minlength=n), 255).astype(np.uint8).tobytes()


def most_common(a: bytes, b: bytes) -> int:
    """An upper bound of the shingles that two sketches' sets share: in each bucket, the smaller number."""
    x, y = (np.where(c == 255, 1 << 40, c.astype(np.int64)) for c in (np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)))
    n = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, n).sum(0), y.reshape(-1, n).sum(0)).sum())


def bounded(edges: DataFrame, classes: DataFrame, similar: float) -> DataFrame:
    """The ``edges(a, b)`` that the sketches of ``classes(node, size, sketch)`` don't rule out. No pair of that similarity goes."""
    share = similar / (1 + similar)

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y, n, m = (batch.column(c).to_pylist() for c in ("x", "y", "n", "m"))
            ok = [most_common(p, q) >= share * (i + j) - 1e-9 for p, q, i, j in zip(x, y, n, m, strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    own = lambda node, data, size: classes.select(F.col("node").alias(node), F.col("sketch").alias(data), F.col("size").alias(size))
    return edges.join(own("a", "x", "n"), "a").join(own("b", "y", "m"), "b").select("a", "b", "x", "y", "n", "m").mapInArrow(may, "a long, b long")


def text_prints(df: DataFrame, id_col: str, text_col: str, seed: int = 42, similar: float = SIMILAR, size: int = SHINGLE) -> DataFrame:
    """``id, same, fp, size, prefix, sketch``: ``same`` is a 128-bit digest of the lower-cased words, ``fp`` the fingerprint of the distinct ones.

    ``size`` is the number of distinct shingles, ``prefix`` the hashes of those that the text is searched by; see :func:`sketch`.
    """
    shared = df.sparkSession.sparkContext.broadcast(common_shingles(df, id_col, text_col, size))
    cols = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            texts = batch.column("text")
            sets = shingle_set(texts, size)
            firsts = pa.array([prefix(s, shared.value, similar).tobytes() for s in sets], pa.binary())
            drawn = pa.array([sketch(s) for s in sets], pa.binary())
            columns = [batch.column("id"), digests(texts), pa.array(majority(*word_hashes(texts, seed)).view(np.int64)), pa.array([len(s) for s in sets], pa.int32()), firsts, drawn]
            yield pa.RecordBatch.from_arrays(columns, ["id", "same", "fp", "size", "prefix", "sketch"])

    return cols.mapInArrow(work, "id long, same binary, fp long, size int, prefix binary, sketch binary")


def whole_groups(batches: Iterator[pa.RecordBatch], least: int = 1 << 17) -> Iterator[pa.Table]:
    """Joins batches sorted by ``h`` into tables in which each ``h`` has all its rows."""
    held, size, stop = [], 0, least
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= stop:
            t = pa.Table.from_batches(held)
            h = t["h"].to_numpy()
            at = int(np.searchsorted(h, h[-1]))
            if at:
                yield t.slice(0, at)
            held, size = t.slice(at).combine_chunks().to_batches(), len(h) - at
            stop = max(least, 2 * size)
    if size:
        yield pa.Table.from_batches(held)


def mates(classes: DataFrame) -> DataFrame:
    """``h, node, size, place, n``: the prefix shingles that ``n`` > 1 classes have; ``place`` is the shingle's in the class's prefix."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            firsts = [np.frombuffer(b, np.int64) for b in batch.column("prefix").to_pylist()]
            counts = np.array([len(x) for x in firsts], np.int64)
            if counts.sum():
                node, size = (np.repeat(batch.column(c).to_numpy(), counts) for c in ("node", "size"))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(firsts)), pa.array(node), pa.array(size), pa.array(own_places(counts).astype(np.int32))], ["h", "node", "size", "place"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            n = np.diff(np.append(_starts(t["h"].to_numpy()), t.num_rows))
            n = np.repeat(n, n)
            yield from t.append_column("n", pa.array(n)).filter(pa.array(n > 1)).combine_chunks().to_batches()

    rows = classes.select("node", "size", "prefix").mapInArrow(deal, "h long, node long, size int, place int")
    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(several, "h long, node long, size int, place int, n long")


def _starts(h: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.append(True, h[1:] != h[:-1]))


def mate_pairs(rows: DataFrame, low: int, high: int, similar: float) -> DataFrame:
    """``a, b``: classes of different roots that stand over ``low`` and up to ``high`` places apart among those of a shingle, by size.

    Left out are pairs whose sizes, or whose shingles behind their first common one, are too few for the
    similarity. A row with a null ``a`` tells of a shingle that has pairs further apart.
    ``rows(h, node, size, place, n, root)``.
    """
    share = similar / (1 + similar)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches):
            h, node, size, place, root = (t[c].to_numpy() for c in ("h", "node", "size", "place", "root"))
            starts = _starts(h)
            n = np.diff(np.append(starts, len(h)))
            mixed_roots = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
            on = np.repeat(mixed_roots, n)
            h, node, size, place, root = (x[on] for x in (h, node, size, place, root))
            found = [np.zeros((0, 2), np.int64)]
            for d in range(low + 1, high + 1):
                i = np.flatnonzero(h[d:] == h[:-d]) if d < len(h) else []
                if not len(i):
                    break
                i = i[(root[i] != root[i + d]) & (size[i] >= similar * size[i + d] - 1e-9)]
                i = i[np.minimum(size[i] - place[i], size[i + d] - place[i + d]) >= share * (size[i].astype(np.int64) + size[i + d]) - 1e-9]
                x, y = node[i], node[i + d]
                found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], 1))
            pairs = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])
            if (mixed_roots & (n - 1 > high)).any():
                yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0], pa.int64())], ["a", "b"])

    return rows.repartition("h").sortWithinPartitions("h", "size", "node").mapInArrow(work, "a long, b long").distinct()


def digests(texts: pa.Array) -> pa.Array:
    import hashlib

    w = words(texts, lower=True)
    joined = np.full(len(w.packed) + len(w.start), 32, np.uint8)
    joined[np.arange(len(w.packed)) + np.repeat(np.arange(len(w.start)), w.lengths)] = w.packed
    ends = np.concatenate([[0], np.cumsum(w.lengths + 1)])[w.firsts()]
    raw = memoryview(joined)
    return pa.array([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.binary())


def verified(edges: DataFrame, texts: DataFrame, similar: float, size: int) -> DataFrame:
    """The ``edges(a, b)`` whose texts' shingle sets have a Jaccard similarity of at least ``similar``. ``texts(node, text)``."""

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([s.tobytes() for s in shingle_set(batch.column("text"), size)], pa.binary())], ["node", "set"])

    sets = texts.mapInArrow(shingles, "node long, set binary")

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(p) + len(q) - len(distinct(np.concatenate([p, q])))
                ok.append(both >= similar * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    paired = edges.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b")
    return paired.select("a", "b", "x", "y").mapInArrow(close, "a long, b long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = SEARCH_BITS, similar: float = SIMILAR, size: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """Rows of near-duplicate groups: ``id, same, group_id`` for each row of ``df``, and the rows ``id, same`` that one keeper makes superfluous.

    Texts of the same lower-cased words are one class. Two classes are linked if their shingles of ``size``
    words have a Jaccard similarity of at least ``similar``; ``group_id`` is the smallest id that links reach.
    Fingerprints of the distinct words that differ in at most ``tau`` bits join most copies at little cost.
    The rest is exact: classes that share a shingle of their prefixes and aren't joined yet are compared,
    in rounds that reach further and further among the classes of a shingle, until none is left.
    Texts without words are one class; null ids come last.
    """
    with tidy(df.sparkSession):
        return _near_duplicates(df, id_col, text_col, tau, similar, size)


def _near_duplicates(df: DataFrame, id_col: str, text_col: str, tau: int, similar: float, size: int) -> tuple[DataFrame, DataFrame]:
    prints = stash(text_prints(df, id_col, text_col, similar=similar, size=size), "prints")
    # A class goes by its least id, or by a hash where it has none or shares it with another text.
    again = stash(prints.groupBy(F.col("id").alias("least")).agg(F.count("*").alias("rows")).where("rows > 1 AND least IS NOT NULL").drop("rows"), "again")
    node = F.when(F.col("least").isNull() | F.col("shared"), -1 - F.abs(F.xxhash64("same") % (1 << 62))).otherwise(F.col("least"))
    firsts = [F.first(c).alias(c) for c in ("fp", "size", "prefix", "sketch")]
    classes = prints.groupBy("same").agg(F.min("id").alias("least"), *firsts, F.count("*").alias("n"))
    classes = classes.join(again.withColumn("shared", F.lit(True)), "least", "left").fillna(False, ["shared"]).withColumn("node", node).drop("shared")
    classes = stash(classes, "classes")
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def true_links(edges: DataFrame) -> DataFrame:
        edges, old = stash(bounded(edges, classes, similar), "bounded"), edges
        unstash(old)
        if not edges.limit(1).count():
            return edges
        # A row of each class that is in an edge lends its text; rows are found by id, then told apart by the digest.
        ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
        wanted = stash(classes.join(ends, "node").select(F.col("least").alias("id"), "same", "node"), "wanted")
        few = wanted.count() <= FEW
        mine = lambda t: F.broadcast(t) if few else t
        near = texts.alias("t").join(mine(wanted.select("id").distinct()).alias("w"), F.col("t.id").eqNullSafe(F.col("w.id")), "left_semi").select("text")
        lent = near.mapInArrow(_with_digest, "same binary, text string").join(mine(wanted.select("same", "node")), "same")
        lent = stash(lent.select("node", "text").dropDuplicates(["node"]), "texts")
        out = stash(verified(edges, lent, similar, size), "links")
        unstash(wanted, lent, edges)
        return out

    heads = stash(classes.groupBy("fp").agg(F.min("node").alias("head")), "heads")
    equal = classes.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    how = planned(heads, tau)
    near = links(heads, how, tau).select("a", "b").distinct()
    name = lambda c: heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_head"))
    near = near.join(name("a"), "a").join(name("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    found = true_links(stash(equal.union(near), "pairs"))
    roots = stash(components(found), "roots")
    unstash(found)
    shared = stash(mates(classes), "mates")
    low, high, more = 0, NEAR, True
    while more:
        rows = shared.where(F.col("n") > low + 1).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        pairs = stash(mate_pairs(rows, low, high, similar), "pairs")
        more = pairs.where("a IS NULL").limit(1).count() > 0
        new = true_links(stash(pairs.where("a IS NOT NULL"), "edges") if more else pairs)
        if more:
            unstash(pairs)
        if new.limit(1).count():
            roots = stash(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(new)), "roots")
        unstash(new)
        low, high = high, FURTHER * high
    named = classes.join(roots, "node", "left").select("same", "least", F.coalesce("root", "node").alias("root"))
    first = named.groupBy("root").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "same")).alias("first"))
    by_class = named.join(first, "root").select("same", F.col("first.least").alias("group_id"), (F.col("same") == F.col("first.same")).alias("head"))
    groups = prints.join(by_class, "same")
    extra = groups.where(~(F.col("head") & F.col("id").eqNullSafe(F.col("group_id")))).select("id", "same").distinct()
    return groups.select("id", "same", "group_id"), extra


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches, "text", 4 << 20):
        yield pa.RecordBatch.from_arrays([digests(batch.column("text")), batch.column("text")], ["same", "text"])


def own_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row of each near-duplicate group of ``df``, all columns: the one with the smallest id.

    Where none of a group has an id, one of its rows stays. Of rows with the same id and words one stays. Null and
    empty texts are one group. An empty table stays empty. A text is compared as a whole, so it must fit a task.
    """
    _, extra = near_duplicates(df, id_col, text_col, **how)
    same, key, twin = (own_name(df, c) for c in ("same", "key", "twin"))

    def tag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, 4 << 20):
            yield pa.RecordBatch.from_arrays([*batch.columns, digests(batch.column(text_col))], [*batch.schema.names, same])

    tagged = df.mapInArrow(tag, T.StructType([*df.schema.fields, T.StructField(same, T.BinaryType())]))
    on = lambda t: F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(key)) & (F.col(same) == F.col(twin))
    left = tagged.join(extra.select(F.col("id").alias(key), F.col("same").alias(twin)), on(extra), "left_anti")
    # Only rows whose id is there again are brought together.
    again = stash(df.groupBy(F.col(f"`{id_col}`").cast("long").alias(key)).agg(F.count("*").alias("n")).where("n > 1").select(key), "again")
    if not again.limit(1).count():
        return left.drop(same)
    hit = F.col(f"`{id_col}`").cast("long").eqNullSafe(F.col(key))
    several = left.join(again, hit, "left_semi").dropDuplicates([id_col, same])
    return left.join(again, hit, "left_anti").unionByName(several).drop(same)
