"""Token ids in files: canonical length-limited Huffman codes from global counts.

A dataset is a folder with two Parquet tables, so that Spark's committer guards the writing:
``code`` (id, bits) with the code's lengths, and ``blocks``, a row for each block of whole documents.
A block stands alone: ``payload`` holds the bits (most significant first), ``marks`` the bit offset
of every 256th id, so that decoding runs from all marks at once through one table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stash import stash
from .columns import gathered
from .wordbpe import default_path, encoder, with_end

LIMIT = 20
MARK_EVERY = 256


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts > 0)
    out = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaf = counts[order].astype(np.int64)
    n = len(leaf)
    levels, weights, is_leaf = [], leaf, np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([leaf, pairs])
        rank = np.argsort(merged, kind="stable")
        weights, is_leaf = merged[rank], rank < n
    levels.append(is_leaf)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[order] = lengths
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes: by length, then by id, counted up."""
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, bytes]:
    """Payload and marks."""
    bits = lengths[ids].astype(np.int64)
    at = np.cumsum(bits) - bits
    total = int(bits.sum())
    word, room = at >> 5, 64 - (at & 31) - bits
    placed = codes[ids] << room.astype(np.uint64)
    size = (total >> 5) + 2
    # Codes don't overlap, so the sums below stay under 2**32 and a float holds them exactly.
    high = np.bincount(word, weights=(placed >> np.uint64(32)).astype(np.float64), minlength=size)
    low = np.bincount(word + 1, weights=(placed & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=size)
    payload = (high[:size] + low[:size]).astype(np.uint64).astype(">u4").tobytes()
    return payload[: (total + 7) // 8], at[::MARK_EVERY].astype("<u4").tobytes()


class Decoder:
    """``table`` gives the id and its length for the next ``limit`` bits."""

    def __init__(self, lengths: np.ndarray):
        self.limit = max(1, int(lengths.max(initial=1)))
        self.ids = np.zeros(1 << self.limit, np.uint32)
        self.bits = np.ones(1 << self.limit, np.uint8)
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        spread = np.left_shift(1, self.limit - lengths[used].astype(np.int64))
        end = int(spread.sum())
        self.ids[:end] = np.repeat(used, spread)
        self.bits[:end] = np.repeat(lengths[used], spread)

    def decode(self, payload: bytes, marks: bytes, n: int) -> np.ndarray:
        at = np.frombuffer(marks, "<u4").astype(np.int64)
        words = np.frombuffer(payload + bytes(16 + -len(payload) % 4), ">u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        out = np.zeros((len(at), MARK_EVERY), np.uint32)
        top, last = np.uint64(64 - self.limit), len(pairs) - 1
        for i in range(min(MARK_EVERY, n)):
            if i and len(at) * MARK_EVERY - n and i == n - (len(at) - 1) * MARK_EVERY:
                at = at[:-1]  # the last stretch is shorter
                if not len(at):
                    break
            window = (pairs[np.minimum(at >> 5, last)] << (at & 31).astype(np.uint64)) >> top
            out[: len(at), i] = self.ids[window]
            at = at + self.bits[window]
        return out.reshape(-1)[:n]


BLOCKS = "part int, block int, doc_ids binary, id_nulls binary, n_tokens binary, ids long, payload binary, marks binary"


def tokenized(df: DataFrame, id_col: str, text_col: str, path: str, end: int) -> DataFrame:
    """``doc_id, n, ids`` with the ids as little-endian 16- or 32-bit numbers."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", 6 << 20):
            ids, counts = with_end(*encoder(path).encode(batch.column("text")), end)
            ends = np.concatenate([[0], np.cumsum(counts)])
            wide = "<u4" if len(ids) and ids.max() > 0xFFFF else "<u2"
            raw, unit = ids.astype(wide).tobytes(), int(wide[-1])
            blobs = [raw[unit * a : unit * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts), pa.array([unit] * len(counts), pa.int32()), pa.array(blobs, pa.binary())], ["doc_id", "n", "unit", "ids"])

    cols = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return cols.mapInArrow(encode, "doc_id long, n long, unit int, ids binary")


def _plain(batch: pa.RecordBatch) -> np.ndarray:
    """All ids of a batch of :func:`tokenized`."""
    units = batch.column("unit").to_numpy()
    blobs = batch.column("ids")
    if (units == 2).all():
        return np.frombuffer(b"".join(blobs.to_pylist()), "<u2").astype(np.uint32)
    return np.concatenate([np.frombuffer(b, f"<u{u}").astype(np.uint32) for b, u in zip(blobs.to_pylist(), units, strict=True)])


def global_counts(ids: DataFrame) -> DataFrame:
    """``id, n`` over all documents: summed in each task, then by id; a row for each id of the vocabulary at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            more = np.bincount(_plain(batch)) if batch.num_rows else np.zeros(0, np.int64)
            a, b = (total, more) if len(total) >= len(more) else (more, total)
            total = a.astype(np.int64)
            total[: len(b)] += b
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return ids.select("unit", "ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_dataset(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end: int = 2, block_bytes: int = 1 << 20) -> None:
    """Encodes ``df`` and writes the dataset in ascending order of ids (nulls first, ties as they come).

    Texts are encoded once, into a table in the shared folder. The counts that reach the driver
    have a row for each id of the vocabulary at most. A block is closed once its ids fill
    ``block_bytes``; a document lies in one block whatever its length.
    """
    spark = df.sparkSession
    ids = stash(tokenized(df, id_col, text_col, path or default_path(), end), "ids")
    code = global_counts(ids).orderBy("id").toPandas()
    counts = np.zeros(int(code["id"].max()) + 1 if len(code) else 1, np.int64)
    counts[code["id"].to_numpy()] = code["n"].to_numpy()
    lengths = code_lengths(counts)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1).write.parquet(f"{folder}/code")
    codes = canonical(lengths)
    shared = spark.sparkContext.broadcast((codes, lengths))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        codes, lengths = shared.value
        held: list[pa.RecordBatch] = []
        size, block = 0, 0

        def close() -> pa.RecordBatch:
            nonlocal block
            one = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            doc = one.column("doc_id")
            payload, marks = encode_block(flat := _plain(one), codes, lengths)
            row = [[TaskContext.get().partitionId()], [block], [doc.fill_null(0).to_numpy().astype("<i8").tobytes()], [np.packbits(doc.is_null().to_numpy(zero_copy_only=False)).tobytes()], [one.column("n").to_numpy().astype("<i8").tobytes()], [len(flat)], [payload], [marks]]
            block += 1
            kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            n = batch.column("n").to_numpy()
            at = 0
            while at < len(n):
                fits = int(np.searchsorted(np.cumsum(n[at:]), block_bytes // 2 - size, "right"))
                to = min(len(n), at + max(1, fits) if not held else at + fits)
                if to > at:
                    held.append(batch.slice(at, to - at))
                    size += int(n[at:to].sum())
                    at = to
                if at < len(n) or size >= block_bytes // 2:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(encode, BLOCKS).write.parquet(f"{folder}/blocks")


def read_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32, ids`` from the files; ``ids`` are little-endian 32-bit numbers.

    ``start`` counts the ids of all documents before it. Ids before a block come from the blocks'
    lengths: summed within a part by a window, and over parts (as many as the writer had tasks).
    """
    lengths_of = {r["id"]: r["bits"] for r in spark.read.parquet(f"{folder}/code").collect()}
    lengths = np.zeros(max(lengths_of, default=0) + 1, np.uint8)
    for i, bits in lengths_of.items():
        lengths[i] = bits
    shared = spark.sparkContext.broadcast(lengths)
    blocks = spark.read.parquet(f"{folder}/blocks")
    before = starts(blocks.select("part", "block", "ids"))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = None
        for batch in batches:
            decoder = decoder or Decoder(shared.value)
            for row in batch.to_pylist():
                flat = decoder.decode(row["payload"], row["marks"], row["ids"])
                n = np.frombuffer(row["n_tokens"], "<i8")
                doc = np.frombuffer(row["doc_ids"], "<i8")
                null = np.unpackbits(np.frombuffer(row["id_nulls"], np.uint8), count=len(doc)).astype(bool)
                ends = np.concatenate([[0], np.cumsum(n)])
                raw = flat.astype("<u4").tobytes()
                blobs = [raw[4 * a : 4 * b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
                crc = [zlib.crc32(b) for b in blobs]
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=null), pa.array(row["before"] + ends[:-1]), pa.array(n), pa.array(crc, pa.int64()), pa.array(blobs, pa.binary())], ["doc_id", "start", "n_tokens", "ids_crc32", "ids"])

    joined = blocks.join(F.broadcast(before), ["part", "block"]) if small(before) else blocks.join(before, ["part", "block"])
    return joined.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def starts(blocks: DataFrame) -> DataFrame:
    """``part, block, before``: the ids before each block. Parts are added up first, so no window spans them all."""
    from pyspark.sql import Window

    parts = blocks.groupBy("part").agg(F.sum("ids").alias("n")).orderBy("part").collect()
    ends = np.concatenate([[0], np.cumsum([r["n"] for r in parts])]).astype(np.int64)
    spark = blocks.sparkSession
    base = spark.createDataFrame([(int(r["part"]), int(b)) for r, b in zip(parts, ends, strict=False)], "part int, base long")
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    own = blocks.withColumn("own", F.coalesce(F.sum("ids").over(w), F.lit(0)))
    return own.join(F.broadcast(base), "part").select("part", "block", (F.col("own") + F.col("base")).alias("before"))


def small(df: DataFrame, most: int = 100_000) -> bool:
    """Whether ``df`` has few enough rows to send to every executor."""
    return df.limit(most + 1).count() <= most

