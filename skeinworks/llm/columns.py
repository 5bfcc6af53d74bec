"""Words and lines of a whole Arrow column at once, as numpy offsets into its bytes."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its offsets into them, from 0; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    texts = texts.cast(pa.large_string()) if pa.types.is_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def release() -> None:
    """Gives memory that a task has freed back to the system, so that idle workers stay small."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that a piece has ``most`` bytes of text at the most, or a single row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        _, offsets = text_bytes(batch.column(column))
        at = 0
        while at < n:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    release()


def gathered(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.RecordBatch]:
    """The other way: joins batches until they hold ``most`` bytes of text."""
    held, size = [], 0
    for batch in pieces(batches, column, most):
        more = int(text_bytes(batch.column(column))[1][-1])
        if held and size + more > most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
        held.append(batch)
        size += more
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the runs of bytes outside ``gap``; a run ends with its row."""
    first = np.empty(len(data), bool)
    last = np.empty(len(data), bool)
    if len(data):
        first[0] = last[-1] = True
        first[1:], last[:-1] = gap[:-1], gap[1:]
        full = offsets[1:] > offsets[:-1]
        first[offsets[:-1][full]] = True
        last[offsets[1:][full] - 1] = True
    start = np.flatnonzero(first & ~gap)
    end = np.flatnonzero(last & ~gap) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def binary_array(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Consecutive pieces of ``data`` as a binary array."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


@dataclass
class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a column: where they are, whose they are."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    counts: np.ndarray
    packed: np.ndarray

    @property
    def lengths(self) -> np.ndarray:
        return self.end - self.start

    def coded(self) -> tuple[np.ndarray, pa.Array]:
        """A number for each word and the distinct words that the numbers stand for."""
        if not len(self.start):
            return np.zeros(0, np.int32), pa.array([], pa.large_binary())
        d = binary_array(self.packed, self.lengths).dictionary_encode()
        return d.indices.to_numpy(), d.dictionary

    def firsts(self) -> np.ndarray:
        """The number of words before each row."""
        return np.concatenate([[0], np.cumsum(self.counts)])


def lower_ascii(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def words(texts: pa.Array, lower: bool = False) -> Words:
    data, offsets = text_bytes(texts)
    if lower:
        data = lower_ascii(data)
    gap = SPACE[data]
    start, end, row = spans(data, offsets, gap)
    return Words(data, offsets, start, end, row, np.bincount(row, minlength=len(offsets) - 1), data[~gap])


def sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of consecutive groups, given where they begin (and the end); empty groups are 0."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[firsts[1:]] - total[firsts[:-1]]


def own_places(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. for each of consecutive groups of these sizes."""
    counts = np.asarray(counts, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(int(counts.sum()), dtype=np.int64) - np.repeat(before, counts)


LETTER = np.zeros(256, bool)
LETTER[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
LETTER[128:] = True


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def hash_column(column: pa.Array) -> np.ndarray:
    """64-bit hashes of a large binary column without nulls: sums over bytes times powers of a constant, mixed."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    sizes = np.diff(offsets)
    if not len(sizes):
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    powers = np.cumprod(np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers[own_places(sizes)], dtype=np.uint64)])
    at = offsets - offsets[0]
    return mixed(total[at[1:]] - total[at[:-1]])


def plain_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Lower-cased runs of letters and digits (bytes over 127 count as letters): codes, distinct words, words of each row."""
    data, offsets = text_bytes(texts)
    data = lower_ascii(data)
    keep = LETTER[data]
    start, end, row = spans(data, offsets, ~keep)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    if not len(start):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary()), counts
    coded = binary_array(data[keep], end - start).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary, counts


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys in order. Sorting beats numpy's hashing here."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys


def last_seen(keys: np.ndarray) -> np.ndarray:
    """How far back each key stands before itself; a large number where it doesn't."""
    order = np.argsort(keys, kind="stable")
    out = np.full(len(keys), 1 << 40, np.int64)
    same = keys[order[1:]] == keys[order[:-1]]
    out[order[1:][same]] = order[1:][same] - order[:-1][same]
    return out
