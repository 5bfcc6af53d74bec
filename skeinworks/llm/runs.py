"""Runs of repeated words inside documents, by an enhanced suffix array and the branching-tandem test.

A run of period p ends in one square whose two halves agree in no more than p words: a branching
tandem (Stoye and Gusfield, 2002). Its halves are suffixes i and i + p that an LCP interval of depth p
tells apart, so for every interval the suffixes of the smaller side ask, by the inverse suffix
array, whether their neighbours p words away lie on the other side. Rotating a square to the left as far
as it goes gives the run. Intervals are pairs of ranks from nearest smaller LCP values; no tree is built.

Documents are independent: each is worked on whole in the task that reads it, and nothing is shuffled.
A task takes a few MB of texts at a time, or one document, whose arrays take about 30 times its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import Words, mixed, own_places, pieces, words

#: Cells of a comparison matrix, and suffixes of a round of tests, at most (or those of a single row).
CELLS = 1 << 19
RUNS = T.ArrayType(T.StructType([T.StructField(f, T.LongType()) for f in ("start", "length", "period")]))


def common(x: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray, step: int = 1) -> np.ndarray:
    """How many items from ``a`` and from ``b`` on (backwards if ``step`` is -1) are equal, up to ``limit``. Widths double."""
    out = np.zeros(len(a), np.int64)
    on, width = np.flatnonzero(limit > 0), 1
    while len(on):
        at = out[on, None] + np.arange(width)
        inside = at < limit[on, None]
        at = np.where(inside, at, 0) * step
        same = inside & (x[a[on, None] + at] == x[b[on, None] + at])
        got = np.where(same.all(axis=1), width, same.argmin(axis=1))
        out[on] += got
        on = on[got == width]
        width = min(2 * width, max(1, CELLS // max(1, len(on))))
    return out


def inverse_suffix_array(key: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes, each up to its ``stop``, by prefix doubling; only groups that aren't told apart yet are sorted again."""
    n = len(key)
    alive = np.argsort(key, kind="stable")
    group, second = np.zeros(n, np.int64), key[alive]
    rank = np.zeros(n, np.int64)
    h = 0
    while len(alive):
        here = np.arange(len(alive))
        other = np.append(True, group[1:] != group[:-1])
        new = other | np.append(True, second[1:] != second[:-1])
        begin = np.flatnonzero(new)
        rank[alive] = group + np.maximum.accumulate(np.where(new, here, 0)) - np.maximum.accumulate(np.where(other, here, 0))
        size = np.diff(np.append(begin, len(alive)))
        alive = alive[np.repeat(size > 1, size)]
        h = max(1, 2 * h)
        ahead = alive + h
        group = rank[alive]
        second = np.where(ahead < stop[alive], rank[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(group * (n + 1) + second)
        alive, group, second = alive[order], group[order], second[order]
    return rank


def lcp_array(x: np.ndarray, row: np.ndarray, begin: np.ndarray, stop: np.ndarray, isa: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Words that each suffix shares with the one before it by rank. Where the words before both are equal the value is one less than theirs."""
    before = sa[np.maximum(isa - 1, 0)]
    here = np.arange(len(x))
    own = (isa > 0) & (row[before] == row)
    inner = own & (here > begin) & (before > begin)
    given = inner & (x[here - 1] == x[before - 1])
    at = np.flatnonzero(~given)
    value = np.zeros(len(x), np.int64)
    value[at] = common(x, at, before[at], np.where(own[at], np.minimum(stop[at] - at, stop[before[at]] - before[at]), 0))
    last = np.maximum.accumulate(np.where(given, 0, here))
    return (value[last] - (here - last))[sa]


def next_smaller(values: np.ndarray, at: np.ndarray, equal: bool) -> np.ndarray:
    """For the places ``at``, the first place behind whose value is smaller (or ``equal``); the length where none is.

    A heap of minima is climbed to the first block with such a value, and descended.
    """
    size = 1 << len(values).bit_length()
    low = np.full(2 * size, -1, np.int64)
    low[size : size + len(values)] = values
    k = size
    while k > 1:
        k //= 2
        low[k : 2 * k] = np.minimum(low[2 * k : 4 * k : 2], low[2 * k + 1 : 4 * k : 2])
    most = values[at] - (0 if equal else 1)
    x, todo = at + 1 + size, np.arange(len(at))
    while len(todo := todo[low[x[todo]] > most[todo]]):
        ahead = x[todo] + 1
        x[todo] = np.where(ahead & 1, ahead, ahead >> 1)
    while len(todo := np.flatnonzero(x < size)):
        x[todo] = 2 * x[todo] + (low[2 * x[todo]] > most[todo])
    return x - size


def branching_tandems(x: np.ndarray, row: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and periods of all squares that the word behind ends."""
    n = len(x)
    isa = inverse_suffix_array(row * (int(x.max()) + 1) + x, stop)
    sa = np.empty(n, np.int64)
    sa[isa] = np.arange(n)
    lcp = lcp_array(x, row, begin, stop, isa, sa)
    cut = np.flatnonzero(lcp > 0)
    depth = lcp[cut]
    right = next_smaller(lcp, cut, equal=True)
    left = n - 1 - next_smaller(lcp[::-1], n - 1 - cut, equal=False)
    less = cut - left <= right - cut
    first, count = np.where(less, left, cut), np.minimum(cut - left, right - cut)
    low, high = np.where(less, cut, left), np.where(less, right, cut)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    total = np.cumsum(count)
    at = 0
    while at < len(cut):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + CELLS, "right")))
        c = count[at:to]
        suffix = sa[np.repeat(first[at:to], c) + own_places(c)]
        p, lo, hi = (np.repeat(v[at:to], c) for v in (depth, low, high))
        for there in (suffix + p, suffix - p):
            rank = isa[np.clip(there, 0, n - 1)]
            hit = (there >= 0) & (there < n) & (rank >= lo) & (rank < hi)
            found.append((np.minimum(suffix, there)[hit] + 2 * p[hit], p[hit]))
        at = to
    return tuple(np.concatenate(v) for v in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def runs_of(x: np.ndarray, row: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and smallest periods of the runs of ``times`` periods and ``least`` words at least; rows are consecutive.

    A square whose half is itself periodic belongs to the run of its smaller period, which ends at the same word
    and holds it whole. So of the squares with one end the smallest is rotated first, and those that it accounts for go.
    """
    none = np.zeros(0, np.int64)
    if not len(x):
        return none, none, none
    counts = np.bincount(row)
    ends = np.cumsum(counts)
    begin, stop = np.repeat(ends - counts, counts), np.repeat(ends, counts)
    end, p = branching_tandems(x, row, begin, stop)
    order = np.lexsort((p, end))
    end, p = end[order], p[order]
    out = []
    while len(end):
        new = np.append(True, end[1:] != end[:-1])
        e, q = end[new], p[new]
        length = 2 * q + common(x, np.maximum(e - 2 * q - 1, 0), e - q - 1, e - 2 * q - begin[e - 1], step=-1)
        long = length >= np.maximum(least, times * q)
        out.append((e[long] - length[long], e[long], q[long]))
        of = np.cumsum(new) - 1
        rest = ~new & ~((p % q[of] == 0) & (length[of] >= 2 * p))
        end, p = end[rest], p[rest]
    return tuple(np.concatenate(v) for v in zip(*out, strict=True)) if out else (none, none, none)


def may_repeat(x: np.ndarray, row: np.ndarray, rows: int, window: int) -> np.ndarray:
    """Rows in which some ``window`` words stand twice, by hashes: all that can have a run, whose first and second period share as many."""
    keep = np.zeros(rows, bool)
    if len(x) > window:
        h = np.zeros(len(x) - window + 1, np.uint64)
        word = mixed(x.astype(np.uint64) + np.uint64(1))
        for k in range(window):
            h = h * np.uint64(0x9E3779B97F4A7C15) + word[k : k + len(h)]
        whole = row[: len(h)] == row[window - 1 :]
        key = np.sort(row[: len(h)][whole].astype(np.uint64) << np.uint64(40) | mixed(h[whole]) >> np.uint64(24))
        keep[(key[1:][key[1:] == key[:-1]] >> np.uint64(40)).astype(np.int64)] = True
    return keep


def runs_in(w: Words, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, starts (words of all rows), ends and periods of the runs in a column, by row, start and period."""
    codes = w.coded()[0].astype(np.int64)
    window = min(max(least, times * q) - q for q in range(1, least + 1))
    chosen = may_repeat(codes, w.row, len(w.counts), window)
    at = np.flatnonzero(chosen[w.row])
    start, end, p = runs_of(codes[at], np.unique(w.row[at], return_inverse=True)[1], least, times)
    start, end = at[start], at[end - 1] + 1
    order = np.lexsort((p, start))
    return w.row[start][order], start[order], end[order], p[order]


def joined_words(w: Words, keep: np.ndarray) -> pa.Array:
    """Each row's words that ``keep`` marks, joined by one space."""
    lengths = w.lengths[keep]
    letters = w.packed[np.repeat(keep, w.lengths)]
    out = np.full(len(letters) + len(lengths), 32, np.uint8)
    out[np.arange(len(letters)) + np.repeat(np.arange(len(lengths)), lengths)] = letters
    own = np.bincount(w.row[keep], minlength=len(w.counts))
    size = np.bincount(w.row[keep], weights=lengths, minlength=len(w.counts)).astype(np.int64) + own
    offsets = np.concatenate([[0], np.cumsum(size)])
    # a row's last word is followed by a space that isn't the row's
    no_gap = np.ones(len(out), bool)
    no_gap[offsets[1:][own > 0] - 1] = False
    offsets[1:] -= np.cumsum(own > 0)
    return pa.Array.from_buffers(pa.large_string(), len(own), [None, pa.py_buffer(offsets), pa.py_buffer(out[no_gap])])


def collapsed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 24, times: int = 3, most: int = 3 << 20) -> DataFrame:
    """``id, n_words, runs, collapsed`` for each row of ``df``: its runs and its text without their repeats.

    Words are split at ASCII white space. A run is a stretch of words with smallest period p, ``least`` words and
    ``times`` periods long at least, that no neighbouring word prolongs; ``runs`` lists (start, length, period) by start
    and period, counted in words from 0. ``collapsed`` has the words, joined by one space, that no run holds
    after its first period. Null and empty texts have no words, no runs and collapse to the empty text.
    Rows are independent, so repeated rows, null ids and empty tables need no rule; other columns aren't read.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", most):
            w = words(batch.column("text"))
            row, start, end, p = runs_in(w, least, times)
            firsts = w.firsts()
            cover = np.bincount(start + p, minlength=len(w.row) + 1) - np.bincount(end, minlength=len(w.row) + 1)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=batch.num_rows))]).astype(np.int32)
            spans = pa.StructArray.from_arrays([pa.array(v) for v in (start - firsts[row], end - start, p)], ["start", "length", "period"])
            kept = joined_words(w, np.cumsum(cover[:-1]) == 0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(w.counts.astype(np.int64)), pa.ListArray.from_arrays(pa.array(offsets), spans), kept.cast(pa.string())], ["id", "n_words", "runs", "collapsed"])

    field = df.schema[id_col]
    cols = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("id", field.dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])
    return cols.mapInArrow(work, schema).withColumnRenamed("id", id_col)


def digests(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Of each row of :func:`collapsed` the number of runs, the one with the greatest length by period (ties: smallest start, then period), and digests."""
    more = "CASE WHEN a.length * b.period <> b.length * a.period THEN CASE WHEN a.length * b.period > b.length * a.period THEN -1 ELSE 1 END WHEN a.start <> b.start THEN CASE WHEN a.start < b.start THEN -1 ELSE 1 END WHEN a.period < b.period THEN -1 WHEN a.period > b.period THEN 1 ELSE 0 END"
    best = df.withColumn("best", F.expr(f"try_element_at(array_sort(runs, (a, b) -> {more}), 1)"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words",
    )


def cycled(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = 3 << 20) -> DataFrame:
    """``df`` with periods planted by a rule, to audit :func:`collapsed`: all columns, the text changed in about a tenth of the rows.

    h is the crc32 of the decimal id, g = h div 10. Where 10 divides h, each of the n words i >= a becomes word
    a + (i - a) mod p, with a = g mod n and p = 1 + (n - a) div (3 + g mod 8); words are then joined by one space. Null ids and texts stay.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, text_col, most):
            w = words(batch.column(text_col))
            g, n = batch.column("cycle_").fill_null(0).to_numpy(), w.counts
            a = g % np.maximum(n, 1)
            p = 1 + (n - a) // (3 + g % 8)
            i, a, p = own_places(n), np.repeat(a, n), np.repeat(p, n)
            at = w.firsts()[w.row] + np.where(i >= a, a + (i - a) % p, i)
            lengths = w.lengths[at]
            letters = w.packed[np.repeat((np.cumsum(w.lengths) - w.lengths)[at], lengths) + own_places(lengths)]
            ends = np.cumsum(lengths)
            moved = Words(w.data, w.offsets, ends - lengths, ends, w.row, w.counts, letters)
            text = joined_words(moved, np.ones(len(at), bool)).cast(pa.string())
            place = batch.schema.get_field_index(text_col)
            yield batch.set_column(place, batch.schema.field(place), text).drop_columns(["cycle_"])

    h = F.crc32(F.col(f"`{id_col}`").cast("string"))
    marked = df.withColumn("cycle_", F.when((h % 10 == 0) & F.col(f"`{text_col}`").isNotNull(), (h / 10).cast("long")))
    changed = marked.where("cycle_ IS NOT NULL").mapInArrow(work, df.schema)
    return marked.where("cycle_ IS NULL").drop("cycle_").unionByName(changed)
