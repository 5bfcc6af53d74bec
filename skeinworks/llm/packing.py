"""Vector bin packing of training examples into sequences.

Each example has three sizes: tokens, segments (1) and loss-bearing tokens. A sequence has a
capacity for each. The next example for an open sequence is the one whose sizes, weighted by how
scarce each dimension is, have the largest dot product with what is left (Panigrahy et al.,
"Heuristics for vector bin packing", 2011), among those that fit in every dimension.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import gathered
from .wordbpe import default_path, encoder, with_end


@dataclass(frozen=True)
class Limits:
    """A sequence's capacities. All three bind: short examples run out of segments, ends of long ones out of loss-bearing tokens."""

    tokens: int = 2048
    segments: int = 16
    loss_tokens: int = 1792

    @property
    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], np.float64)


def pack(sizes: np.ndarray, loss: np.ndarray, limits: Limits, cut: bool = True) -> list[list[tuple[int, int, int]]]:
    """Sequences of ``(example, start, length)``.

    Equal sizes are interchangeable, so the choice runs over the distinct (tokens, loss) pairs.
    With ``cut``, an example that is longer than what is left is cut when nothing fits any more;
    its loss share is taken from its end. Without it, a longer example than ``limits`` raises.
    """
    room = limits.vector
    if not cut and len(sizes) and (sizes.max() > room[0] or loss.max() > room[2]):
        raise ValueError("an example exceeds the limits; cut it first")
    kinds: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for i in range(len(sizes) - 1, -1, -1):
        if sizes[i]:
            kinds.setdefault((int(sizes[i]), int(loss[i])), []).append((i, 0))
    keys = np.array(sorted(kinds, reverse=True), np.float64).reshape(-1, 2)
    left = np.array([len(kinds[int(a), int(b)]) for a, b in keys], np.int64)
    total = np.array([float(sizes.sum()), float((sizes > 0).sum()), float(loss.sum())])
    scarce = total / room
    scarce = scarce / max(scarce.max(), 1e-9)
    vectors = np.column_stack([keys[:, 0], np.ones(len(keys)), keys[:, 1]]) / room
    sequences: list[list[tuple[int, int, int]]] = []
    remain = int(left.sum())
    free, have = room.copy(), []
    while remain:
        fits = (left > 0) & (keys[:, 0] <= free[0]) & (keys[:, 1] <= free[2]) & (free[1] >= 1)
        if fits.any():
            gain = np.where(fits, vectors @ (scarce * free / room), -1.0)
            k = int(gain.argmax())
            i, at = kinds[int(keys[k, 0]), int(keys[k, 1])].pop()
            left[k] -= 1
            remain -= 1
            have.append((i, at, int(keys[k, 0])))
            free -= (keys[k, 0], 1, keys[k, 1])
        elif cut and free[0] > 0 and free[1] >= 1:
            # Nothing fits whole: the shortest example that is left fills the rest, and what it keeps goes on.
            some = np.flatnonzero(left > 0)
            k = int(some[-1])
            size, bearing = int(keys[k, 0]), int(keys[k, 1])
            i, at = kinds[size, bearing].pop()
            left[k] -= 1
            take = min(int(free[0]), size - 1) if size > 1 else 1
            taken_loss = max(0, bearing - (size - take))
            if taken_loss > free[2]:
                take = max(1, take - int(taken_loss - free[2]))
                taken_loss = max(0, bearing - (size - take))
            if taken_loss > free[2]:
                kinds[size, bearing].append((i, at))
                left[k] += 1
                free[1] = 0
                continue
            have.append((i, at, take))
            free -= (take, 1, taken_loss)
            rest = (size - take, bearing - taken_loss)
            row = np.flatnonzero((keys[:, 0] == rest[0]) & (keys[:, 1] == rest[1]))
            if len(row):
                left[row[0]] += 1
            else:
                at_row = int(np.searchsorted(-(keys[:, 0] * 1e6 + keys[:, 1]), -(rest[0] * 1e6 + rest[1])))
                keys = np.insert(keys, at_row, rest, 0)
                left = np.insert(left, at_row, 1)
                vectors = np.insert(vectors, at_row, np.array([rest[0], 1, rest[1]]) / room, 0)
            kinds.setdefault(rest, []).append((i, at + take))
        else:
            sequences.append(have)
            free, have = room.copy(), []
    if have:
        sequences.append(have)
    return sequences


def in_powers(sequence: list[tuple[int, int, int]], limits: Limits) -> list[list[tuple[int, int, int]]]:
    """Splits a sequence that isn't full into ones whose lengths are powers of two, which take no padding."""
    size = sum(p[2] for p in sequence)
    out, left = [], list(sequence)
    while size:
        room = 1 << (size.bit_length() - 1)
        size -= room
        have = []
        while room:
            i, at, n = left.pop(0)
            take = min(n, room)
            have.append((i, at, take))
            room -= take
            if take < n:
                left.insert(0, (i, at + take, n - take))
        out.append(have)
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: An example's first ids, this part of it, are its prompt and bear no loss; what follows does, the end id included.
PROMPT = 4


def packed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limits: Limits = Limits(), path: str | None = None, end: int = 1, window: int = 1 << 20) -> DataFrame:
    """A row for each piece of ``df``'s documents in the sequences.

    Each task packs its own documents in windows of ``window`` ids, so nothing is shuffled and memory
    is bounded by a window and one text; sequences that aren't full are split into powers of two, which take
    no padding. ``sequence_id`` is the task's number and its own count. ``loss_tokens`` of a piece are its ids behind
    the first ``1 / PROMPT`` of its document. A null or empty text has its end id only; null ids stay null;
    repeated rows are packed each; other columns are not read; an empty table gives no row.
    """
    path = path or default_path()
    size = limits.tokens
    cols = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, sequence = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []  # documents of the window: id, its ids' bytes, length
        weight = 0
        rows: list[tuple] = []

        def place(have: list[tuple[int, int, int]]) -> None:
            nonlocal sequence
            offset = 0
            for i, at, n in have:
                doc, raw, total = held[i]
                loss = max(0, at + n - max(at, total // PROMPT))
                rows.append((doc, at, n, zlib.crc32(raw[4 * at : 4 * (at + n)]), total, base + sequence, offset, loss))
                offset += n
            sequence += 1

        def flush() -> None:
            sizes = np.array([h[2] for h in held], np.int64)
            for have in pack(sizes, sizes - sizes // PROMPT, limits):
                for one in [have] if sum(p[2] for p in have) == size else in_powers(have, limits):
                    place(one)
            held.clear()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], [c.split()[0] for c in PIECES.split(", ")])
            rows.clear()
            return batch

        for batch in gathered(batches, "text", 6 << 20):
            ids, counts = with_end(*encoder(path).encode(batch.column("text")), end)
            raw = memoryview(ids.astype("<u4").tobytes())
            at = 0
            for doc, n in zip(batch.column("doc_id").to_pylist(), counts.tolist(), strict=True):
                held.append((doc, raw[4 * at : 4 * (at + n)], n))
                at += n
                weight += n
                if weight >= window:
                    flush()
                    weight = 0
            held[:] = [(d, bytes(o), n) for d, o, n in held]
            if rows:
                yield out()
        flush()
        if rows:
            yield out()

    return cols.mapInArrow(encode, PIECES)
