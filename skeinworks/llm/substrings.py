"""Removal of repeated passages of words, by suffix trees that variable-length prefixes split into groups.

A window is a number of consecutive words of one text. It is removed if it stands in a document with a
smaller id as well. Suffixes end after a window's words, so a suffix tree's internal nodes at that
depth are the windows that repeat, and each node's smallest id is all that its documents need to know.

Texts are packed into blocks of some MB once. A block sends a distinct window once, with its own smallest id, so a
passage that a third of all documents hold has no more suffixes in a group than there are blocks.

1. Hashes of the blocks' windows meet by ranges; those of a single block can't be in a tree. The answer is a bit each.
2. Prefixes are counted, one word longer in each round where more suffixes share one than a group may have.
3. Suffixes are dealt by their prefixes. A group's tree is built from its words, level by level; the answer names the
   block's windows that a smaller id holds elsewhere.

Hashes only choose what is compared: equal windows are equal words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stash import scratch, stash
from .backoff import begins, by_part, sizes
from .columns import Words, binary_array, gathered, hash_column, mixed, own_places, words
from .rows import batches_of
from .runs import joined_words

#: Bytes of text in a block; hashes, and suffixes, that meet in a task, about; suffixes that may share a prefix.
BLOCK_BYTES, PART_HASHES, PART_SUFFIXES, GROUP = 6 << 20, 2_500_000, 400_000, 200_000
#: Passes over the suffixes, each with its share of the groups: the files of its shuffle are gone before the next.
PASSES = 2
#: Of more prefixes than these, groups grow instead.
PREFIXES = 200_000
BLOCK, BITS, SUFFIXES, FLAGS = range(4)
FIELDS = ("ids", "counts", "names", "codes", "places")
PACKED = "part long, kind int, block long, n long, " + ", ".join(f"{f} binary" for f in FIELDS)
NO_ID = np.iinfo(np.int64).max


def to_bytes(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as their largest takes, bytes of one weight together, compressed."""
    x = np.ascontiguousarray(x).astype(np.uint64)
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.view(np.uint8).reshape(-1, 8)[:, :wide].T
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def from_bytes(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8).reshape(raw[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : raw[0]] = planes.T
    return out.view(np.uint64)[:, 0].astype(np.int64)


def names_bytes(names: pa.Array) -> bytes:
    offsets = np.frombuffer(names.buffers()[1], np.int64)[names.offset : names.offset + len(names) + 1]
    sized = to_bytes(np.diff(offsets))
    letters = names.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(names) and names.buffers()[2] else b""
    return len(sized).to_bytes(4, "little") + sized + zstandard.ZstdCompressor(level=1).compress(letters)


def names_of(raw: bytes) -> pa.Array:
    n = int.from_bytes(raw[:4], "little")
    letters = zstandard.ZstdDecompressor().decompress(raw[4 + n :])
    return binary_array(np.frombuffer(letters, np.uint8), from_bytes(raw[4 : 4 + n]))


def numbered_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes in use, most frequent first, and numbers of all in that order: small numbers compress better."""
    used, at, n = np.unique(codes, return_inverse=True, return_counts=True)
    order = np.argsort(-n, kind="stable")
    place = np.empty(len(used), np.int64)
    place[order] = np.arange(len(used))
    return used[order], place[at.ravel()]


def row(part: int, kind: int, block: int, n: int, **fields: bytes) -> pa.RecordBatch:
    values = [pa.array([part], pa.int64()), pa.array([kind], pa.int32()), pa.array([block], pa.int64()), pa.array([n], pa.int64())]
    return pa.RecordBatch.from_arrays([*values, *(pa.array([fields.get(f)], pa.binary()) for f in FIELDS)], ["part", "kind", "block", "n", *FIELDS])


def blocks(cols: DataFrame) -> DataFrame:
    """A row for some MB of texts, or one text: ids, words of each, and the words as codes with their names."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        for batch in gathered(batches, "text", BLOCK_BYTES):
            w = words(batch.column("text"))
            codes, names = w.coded()
            ids = batch.column("id").fill_null(NO_ID).to_numpy()
            null = pa.array(batch.column("id").is_null()).to_numpy(zero_copy_only=False)
            yield row(block, BLOCK, block, len(codes), ids=to_bytes(ids.view(np.uint64)), counts=to_bytes(w.counts), names=names_bytes(names), codes=to_bytes(codes), places=np.packbits(null).tobytes())
            block += 1

    return cols.mapInArrow(work, PACKED)


class Windows:
    """A block's distinct windows in the order of their hashes."""

    def __init__(self, block: dict, size: int) -> None:
        self.ids, self.counts = from_bytes(block["ids"]), from_bytes(block["counts"])
        self.null = np.unpackbits(np.frombuffer(block["places"], np.uint8), count=len(self.ids)).astype(bool)
        self.codes, self.names, self.size = from_bytes(block["codes"]), names_of(block["names"]), size
        start = np.flatnonzero(own_places(self.counts) + size <= np.repeat(self.counts, self.counts))
        doc = np.repeat(np.arange(len(self.counts)), self.counts)[start]
        word = hash_column(self.names)
        h = rolled(word[self.codes], start, size)
        order = np.argsort(h)
        if self._mixed(h[order], start[order]):
            order = np.lexsort((*(self.codes[start + k] for k in range(size)), h))
        h, self.start, self.doc = h[order], start[order], doc[order]
        self.first = np.flatnonzero(np.append(True, self._differ(h, self.start))) if len(h) else order
        self.hash = h[self.first]
        self.of = np.repeat(np.arange(len(self.first)), sizes(self.first, len(h)))
        self.low = np.minimum.reduceat(self.ids[self.doc], self.first) if len(h) else self.first

    def _differ(self, h: np.ndarray, start: np.ndarray) -> np.ndarray:
        out = h[1:] != h[:-1]
        same = np.flatnonzero(~out)
        out[same] = self._unlike(start[same], start[same + 1])
        return out

    def _unlike(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        out = np.zeros(len(a), bool)
        for k in range(self.size):
            out |= self.codes[a + k] != self.codes[b + k]
        return out

    def _mixed(self, h: np.ndarray, start: np.ndarray) -> bool:
        """Whether different windows have one hash."""
        same = np.flatnonzero(h[1:] == h[:-1])
        return bool(self._unlike(start[same], start[same + 1]).any())


def rolled(word: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size`` words from each ``start`` on."""
    h = np.zeros(len(start), np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + word[start + k]
    return mixed(h + np.uint64(size))


def range_of(h: np.ndarray, parts: int) -> np.ndarray:
    """Parts by ranges, so that sorted hashes are in their order."""
    return (((h >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)


def slices(place: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """The parts that sorted places have, and where."""
    cut = np.searchsorted(place, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        yield p, slice(int(cut[p]), int(cut[p + 1]))


def asked(table: DataFrame, size: int, parts: int, bits: int) -> DataFrame:
    """Each block's window hashes, their first ``bits``, for the part that has their range; as differences they take two or three bytes."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                h = Windows(b, size).hash
                for p, s in slices(range_of(h, parts), parts):
                    yield row(p, BITS, b["block"], s.stop - s.start, codes=to_bytes(np.diff(h[s] >> np.uint64(64 - bits), prepend=np.uint64(0))))

    return table.mapInArrow(work, PACKED)


def shared(part: int, held: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
    """For each block a bit for each of its hashes in the part: whether another block has it too."""
    rows = held[BITS]
    values = [np.cumsum(from_bytes(r["codes"])) for r in rows]
    n = np.array([len(v) for v in values])
    own = np.repeat(np.arange(len(rows)), n)
    order = np.argsort(values := np.concatenate(values), kind="stable")
    first = begins(values[order])
    last = np.append(first[1:], len(order)) - 1
    many = own[order[first]] != own[order[last]]
    bit = np.empty(len(order), bool)
    bit[order] = np.repeat(many, last - first + 1)
    at = 0
    for r, m in zip(rows, n.tolist(), strict=True):
        if bit[at : at + m].any():
            yield row(part, BITS, r["block"], m, places=np.packbits(bit[at : at + m]).tobytes())
        at += m


def nominated(size: int, parts: int):
    """A block's windows that other blocks may have: their words, smallest ids, and numbers in the block."""

    def work(block: int, held: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
        if BITS not in held:
            return
        w = Windows(held[BLOCK][0], size)
        bits = {r["part"]: np.unpackbits(np.frombuffer(r["places"], np.uint8), count=r["n"]).astype(bool) for r in held[BITS]}
        chosen = np.zeros(len(w.hash), bool)
        for p, s in slices(range_of(w.hash, parts), parts):
            chosen[s] = bits.get(p, False)
        at = np.flatnonzero(chosen)
        start = w.start[w.first[at]]
        cover = np.zeros(len(w.codes) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + size, -1)
        inside = np.cumsum(cover[:-1]) > 0
        used, codes = numbered_words(w.codes[inside])
        yield row(block, SUFFIXES, block, len(at), ids=to_bytes(w.low[at].view(np.uint64)), counts=to_bytes((np.cumsum(inside) - 1)[start]), names=names_bytes(w.names.take(pa.array(used))), codes=to_bytes(codes), places=to_bytes(at))

    return work


def prefix_counts(table: DataFrame, length: int, above: np.ndarray | None) -> DataFrame:
    """``prefix, n``: suffixes by the hash of their first ``length`` words; only those whose first words, one fewer, are among ``above``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                word, start = hash_column(names_of(b["names"]))[from_bytes(b["codes"])], from_bytes(b["counts"])
                if above is not None:
                    start = start[np.isin(rolled(word, start, length - 1), above)]
                key, n = np.unique(rolled(word, start, length), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], ["prefix", "n"])

    return table.mapInArrow(work, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n"))


def crowded(table: DataFrame, size: int, most: int) -> list[np.ndarray]:
    """By length from 1, the prefixes that more than ``most`` suffixes share; at most ``PREFIXES`` of a length reach the driver."""
    found: list[np.ndarray] = []
    for length in range(1, size):
        got = prefix_counts(table, length, found[-1] if found else None).where(F.col("n") > most).select("prefix").toPandas()["prefix"].to_numpy(np.int64)
        if not len(got):
            break
        found.append(np.sort(got.view(np.uint64)))
    return found


def dealt(table: DataFrame, size: int, parts: int, long: list[np.ndarray], turn: int, turns: int) -> DataFrame:
    """Suffixes, by their shortest prefix that isn't crowded: those of every ``turns``-th part."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                names, codes, start = names_of(b["names"]), from_bytes(b["codes"]), from_bytes(b["counts"])
                low, number = from_bytes(b["ids"]), from_bytes(b["places"])
                word = hash_column(names)[codes]
                prefix = rolled(word, start, 1)
                on = np.arange(len(start))
                for k, above in enumerate(long):
                    on = on[np.isin(prefix[on], above)]
                    prefix[on] = rolled(word, start[on], k + 2)
                place = (prefix % np.uint64(parts)).astype(np.int64)
                mine = np.flatnonzero(place % turns == turn)
                order = mine[np.argsort(place[mine], kind="stable")]
                for p, s in slices(place[order], parts):
                    at = order[s]
                    used, text = numbered_words(codes[start[at, None] + np.arange(size)].T)
                    yield row(p, SUFFIXES, b["block"], len(at), ids=to_bytes(low[at].view(np.uint64)), names=names_bytes(names.take(pa.array(used))), codes=to_bytes(text), places=to_bytes(number[at]))

    return table.mapInArrow(work, PACKED)


def deep_nodes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes, one a column of ``text``, in the internal nodes of full depth, and where each node begins among them.

    Each level splits the nodes above by the next word; a node of one suffix is a leaf and goes no deeper.
    """
    alive, node = np.arange(text.shape[1]), np.zeros(text.shape[1], np.int64)
    first = np.zeros(0, np.int64)
    wide = int(text.max(initial=0)) + 1
    for level in text:
        key = node * wide + level[alive]
        order = np.argsort(key, kind="stable")
        first = begins(key[order])
        n = sizes(first, len(order))
        inner = np.repeat(n > 1, n)
        alive = alive[order][inner]
        n = n[n > 1]
        node = np.repeat(np.arange(len(n)), n)
        first = np.cumsum(n) - n
    return alive, first


def tree(size: int):
    """A part's suffix trees. Of each block the windows that have a smaller id elsewhere."""

    def work(part: int, held: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
        rows = held[SUFFIXES]
        names = [names_of(r["names"]) for r in rows]
        known = pa.chunked_array(names).combine_chunks().dictionary_encode().indices.to_numpy()
        at = np.concatenate([[0], np.cumsum([len(x) for x in names])])
        text = np.concatenate([known[at[i] + from_bytes(r["codes"])].reshape(size, -1) for i, r in enumerate(rows)], axis=1)
        low = np.concatenate([from_bytes(r["ids"]) for r in rows])
        alive, first = deep_nodes(text)
        flag = np.zeros(len(low), bool)
        if len(alive):
            least = np.minimum.reduceat(low[alive], first)
            flag[alive] = low[alive] > np.repeat(least, sizes(first, len(alive)))
        at = 0
        for r in rows:
            mine = flag[at : at + r["n"]]
            at += r["n"]
            if mine.any():
                yield row(part, FLAGS, r["block"], int(mine.sum()), places=to_bytes(from_bytes(r["places"])[mine]))

    return work


RESULT = "id long, n_words long, removed array<struct<start:long,length:long>>, kept string"


def finished(size: int):
    """A block's texts without the windows that a smaller id has, in the block or elsewhere."""

    def work(block: int, held: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
        w = Windows(held[BLOCK][0], size)
        flag = np.zeros(len(w.hash), bool)
        for r in held.get(FLAGS, []):
            flag[from_bytes(r["places"])] = True
        start = w.start[flag[w.of] | (w.ids[w.doc] > w.low[w.of])]
        cover = np.bincount(start, minlength=len(w.codes) + 1) - np.bincount(start + size, minlength=len(w.codes) + 1)
        gone = np.cumsum(cover[:-1]) > 0
        doc = np.repeat(np.arange(len(w.counts)), w.counts)
        place = own_places(w.counts)
        opens = np.flatnonzero(gone & ~(np.append(False, gone[:-1]) & (place > 0)))
        ends = np.flatnonzero(gone & ~(np.append(gone[1:], False) & (np.append(place[1:], 0) > 0)))
        spans = pa.StructArray.from_arrays([pa.array(place[opens]), pa.array(ends - opens + 1)], ["start", "length"])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[opens], minlength=len(w.counts)))]).astype(np.int32)
        letters = w.names.take(pa.array(w.codes))
        at = np.frombuffer(letters.buffers()[1], np.int64)[: len(letters) + 1]
        packed = np.frombuffer(letters.buffers()[2], np.uint8)[: at[-1]] if len(letters) else np.zeros(0, np.uint8)
        text = joined_words(Words(packed, at, at[:-1], at[1:], doc, w.counts, packed), ~gone)
        yield pa.RecordBatch.from_arrays([pa.array(w.ids, mask=w.null), pa.array(w.counts), pa.ListArray.from_arrays(pa.array(offsets), spans), text.cast(pa.string())], ["id", "n_words", "removed", "kept"])

    return work


def repeated(table: DataFrame, size: int) -> list[DataFrame]:
    """The windows of each of the blocks ``table`` that have a smaller id elsewhere, a stored table for each pass."""
    with scratch() as keep:
        total = table.agg(F.sum("n")).first()[0] or 0
        parts, bits = max(8, total // PART_HASHES), min(64, max(24, int(total).bit_length() + 12))
        found = by_part(asked(table, size, parts, bits), "part", shared, PACKED)
        suffixes = stash(by_part(found.unionByName(table), "block", nominated(size, parts), PACKED), "suffixes")
        many = suffixes.agg(F.sum("n")).first()[0] or 0
        groups = max(8, many // PART_SUFFIXES)
        long = crowded(suffixes, size, max(GROUP, many // PREFIXES))
        return [keep(stash(by_part(dealt(suffixes, size, groups, long, k, PASSES), "part", tree(size), PACKED), "flags")) for k in range(PASSES)]


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 13) -> DataFrame:
    """``id, n_words, removed, kept`` for each row of ``df``, a stored table.

    ``removed`` lists the stretches (start, length, in words) covered by windows of ``size`` words that also start in a row with a
    smaller id, as the input has them; ``kept`` has the other words, joined by one space. Words are split at
    ASCII white space. Null, empty and short texts have no windows and lose nothing. Rows with one id don't count against each other, nor
    do those without an id, which lose words to all that have one and take none. Other columns aren't read; an empty table has an empty result.
    """
    spark = df.sparkSession
    cols = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    with scratch() as keep, batches_of(spark, 8):
        table = stash(blocks(cols), "blocks")
        out = by_part(reduce(DataFrame.unionByName, repeated(table, size), table), "block", finished(size), RESULT)
        return keep(stash(out.withColumnRenamed("id", id_col), "kept"))
