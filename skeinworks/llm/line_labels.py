"""Content and boilerplate lines by a linear-chain conditional random field; the content share decides.

The model is trained here, by gradient ascent on the chain's log-likelihood, on a bounded sample of
labelled documents: lines of documents of quality 1 count as content, those of quality 0 as
boilerplate. It is a handful of weights. Every document's whole sequence of lines is then decoded
by the Viterbi algorithm, all documents of a piece side by side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import binary_array, pieces, sums, words
from .rows import fitted, kept

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 5
#: Documents in the sample that the field is fitted on, and the longest that is taken, in bytes.
SAMPLE, SAMPLE_BYTES = 1000, 20_000
#: A document is kept if at least this share of its words' characters lies in content lines.
CONTENT_SHARE = 0.5


@dataclass
class Facts:
    """Counts of each text and features of each line with a word, in order."""

    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray
    lines: np.ndarray
    features: np.ndarray
    line_chars: np.ndarray


FEATURES = 11


def _unique_keys(row: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return row.astype(np.int64) << 32 | codes.astype(np.int64)


def _earlier(keys: np.ndarray) -> np.ndarray:
    """Whether an equal key stands before."""
    order = np.argsort(keys, kind="stable")
    out = np.zeros(len(keys), bool)
    out[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    return out


def repeated_words(row: np.ndarray, counts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Whether each word lies in a window of five that is found twice or more in its text.

    Windows are compared by 64-bit sums of their words' codes times odd constants.
    """
    n = len(codes)
    if n < WINDOW:
        return np.zeros(n, bool)
    factors = np.random.default_rng(7).integers(1, 1 << 63, WINDOW + 1, dtype=np.uint64) | np.uint64(1)
    c = codes.astype(np.uint64) + np.uint64(1)
    h = sum(c[k : n - WINDOW + 1 + k] * factors[k] for k in range(WINDOW))
    h ^= h >> np.uint64(29)
    h = h * factors[0] + row[: n - WINDOW + 1].astype(np.uint64) * factors[WINDOW]
    inside = np.flatnonzero(row[: n - WINDOW + 1] == row[WINDOW - 1 :])
    order = inside[np.argsort(h[inside], kind="stable")]
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(len(order), bool)
    again[1:] |= same
    again[:-1] |= same
    edge = np.zeros(n + 1, np.int64)
    edge[order[again]] += 1
    edge[order[again] + WINDOW] -= np.bincount(order[again] + WINDOW, minlength=n + 1)[order[again] + WINDOW]
    return np.cumsum(edge)[:n] > 0


def facts(texts: pa.Array) -> Facts:
    w = words(texts)
    data, offsets, n = w.data, w.offsets, len(w.counts)
    codes, _ = w.coded()
    firsts = w.firsts()
    lead = np.concatenate([[0], np.cumsum((w.packed & 0xC0) != 0x80)])
    ends = np.concatenate([[0], np.cumsum(w.lengths)])
    chars = lead[ends[1:]] - lead[ends[:-1]]
    symbol = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    again = repeated_words(w.row, w.counts, codes)
    # Lines: their bytes without the line feeds make a column of their own.
    feed = data == 10
    per_row = np.diff(np.concatenate([[0], np.cumsum(feed)])[offsets]) + 1
    begin = np.empty(int(per_row.sum()), np.int64)
    first_line = np.cumsum(per_row) - per_row
    begin[:] = -1
    begin[first_line] = offsets[:-1]
    begin[begin < 0] = np.flatnonzero(feed) + 1
    stop = np.empty_like(begin)
    stop[:-1] = begin[1:] - 1
    last = first_line + per_row - 1
    stop[last] = offsets[1:]
    line_row = np.repeat(np.arange(n), per_row)
    line_codes = binary_array(data[~feed], stop - begin).dictionary_encode().indices.to_numpy()
    line_of_word = np.searchsorted(begin, w.start, "right") - 1
    # Several lines may begin at the same byte only where a text is empty, and then no word is there.
    line_words = np.bincount(line_of_word, minlength=len(begin))
    real = np.flatnonzero(line_words)
    dup = np.zeros(len(begin), bool)
    dup[real] = _earlier(_unique_keys(line_row[real], line_codes[real]))
    line_chars = np.bincount(line_of_word, weights=chars, minlength=len(begin))
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57))])
    bang = np.concatenate([[0], np.cumsum(data == 33)])
    ended = np.isin(data[np.maximum(stop[real] - 1, 0)], list(b".?!:;")) if len(data) else np.zeros(0, bool)
    lc = np.maximum(line_chars[real], 1)
    lw = line_words[real]
    inside = lambda total: (total[stop[real]] - total[begin[real]])
    rep = np.bincount(line_of_word, weights=again, minlength=len(begin))[real] / np.maximum(lw, 1)
    echo = np.zeros(len(codes), bool)
    echo[1:] = (codes[1:] == codes[:-1]) & (line_of_word[1:] == line_of_word[:-1])
    x = np.column_stack([
        np.ones(len(real)),
        np.minimum(inside(symbol) / lw, 2),
        np.minimum(4 * inside(symbol) / lc, 2),
        inside(upper) / lc > 0.5,
        np.minimum(inside(bang) / lw, 1),
        dup[real],
        rep,
        np.minimum(4 * inside(digit) / lc, 1),
        np.minimum(lw, 20) / 20,
        ended,
        np.bincount(line_of_word, weights=echo, minlength=len(begin))[real] / np.maximum(lw, 1),
    ]).astype(np.float64)
    return Facts(w.counts, sums(chars, firsts), np.diff(symbol[offsets]), np.bincount(line_row, weights=dup, minlength=n).astype(np.int64), np.bincount(w.row, weights=again, minlength=n).astype(np.int64), np.bincount(line_row[real], minlength=n), x, line_chars[real])


@dataclass
class Chain:
    """Weights: ``emit[feature]`` for boilerplate against content, ``step[from, to]``; content is 0."""

    emit: np.ndarray
    step: np.ndarray


def _steps(lines: np.ndarray) -> Iterator[np.ndarray]:
    """For each place 0, 1, .. the texts that have a line there."""
    order = np.argsort(-lines, kind="stable")
    for t in range(int(lines.max(initial=0))):
        yield order[: int(np.searchsorted(-lines[order], -t, "left"))]


def viterbi(chain: Chain, lines: np.ndarray, features: np.ndarray) -> np.ndarray:
    """The best label of each line, texts side by side; ties go to content."""
    emit = np.column_stack([np.zeros(len(features)), features @ chain.emit])
    first = np.cumsum(lines) - lines
    back = np.zeros((len(features), 2), np.int8)
    score = np.zeros((len(lines), 2))
    steps = list(_steps(lines))
    for t, who in enumerate(steps):
        at = first[who] + t
        if t:
            ways = score[who][:, :, None] + chain.step[None]
            back[at] = ways.argmax(1)
            score[who] = ways.max(1) + emit[at]
        else:
            score[who] = emit[at]
    out = np.zeros(len(features), np.int8)
    state = score.argmax(1)
    for t in range(len(steps) - 1, -1, -1):
        who = steps[t]
        at = first[who] + t
        ends = lines[who] == t + 1
        now = np.where(ends, score[who].argmax(1), state[who])
        out[at] = now
        state[who] = back[at, now]
    return out


def fit(lines: np.ndarray, features: np.ndarray, gold: np.ndarray, rounds: int = 150, rate: float = 0.5, decay: float = 1e-3) -> Chain:
    """Maximum likelihood of the labels by gradient ascent, marginals by the forward-backward recursion."""
    chain = Chain(np.zeros(features.shape[1]), np.zeros((2, 2)))
    first = np.cumsum(lines) - lines
    steps = list(_steps(lines))
    pairs_gold = np.zeros((2, 2))
    for t, who in enumerate(steps[1:], 1):
        at = first[who] + t
        np.add.at(pairs_gold, (gold[at - 1], gold[at]), 1)
    emit_gold = features.T @ gold
    total = max(len(features), 1)
    for _ in range(rounds):
        emit = np.column_stack([np.zeros(len(features)), features @ chain.emit])
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        for t, who in enumerate(steps):
            at = first[who] + t
            alpha[at] = emit[at] + (np.logaddexp.reduce(alpha[at - 1][:, :, None] + chain.step, axis=1) if t else 0)
        pairs = np.zeros((2, 2))
        for t in range(len(steps) - 1, 0, -1):
            at = first[steps[t]] + t
            ahead = emit[at] + beta[at]
            joint = alpha[at - 1][:, :, None] + chain.step + ahead[:, None, :]
            joint -= np.logaddexp.reduce(joint.reshape(len(at), 4), axis=1)[:, None, None]
            pairs += np.exp(joint).sum(0)
            beta[at - 1] = np.logaddexp.reduce(chain.step[None] + ahead[:, None, :], axis=2)
        marginal = alpha + beta
        p = 1 / (1 + np.exp(np.clip(marginal[:, 0] - marginal[:, 1], -50, 50)))
        chain.emit += rate * ((emit_gold - features.T @ p) / total * 10 - decay * chain.emit)
        chain.step += rate * ((pairs_gold - pairs) / total * 10 - decay * chain.step)
    return chain


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Chain:
    """Fits the field on at most ``SAMPLE`` documents of each label, those with the smallest hashes of id.

    Held out: crc32(id) mod 5 = 0. The sample meets in one task that fits; the driver gets the weights. Without labels of both
    kinds every line is content.
    """
    known = labels.where(F.col(label_col).isin(0, 1) & (F.crc32(F.col(id_col).cast("string")) % 5 != 0)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    short = documents.where(F.octet_length(text_col) <= SAMPLE_BYTES).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    some = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        some = one if some is None else some.union(one)
    rows = short.join(F.broadcast(some), "id").orderBy("id", "text").limit(2 * SAMPLE)

    def learn(table: pa.Table) -> Chain:
        y = table["y"].to_numpy()
        if len(np.unique(y)) < 2:
            return Chain(np.zeros(FEATURES), np.zeros((2, 2)))
        f = facts(table["text"].combine_chunks().cast(pa.large_string()))
        return fit(f.lines, f.features, np.repeat(y == 0, f.lines).astype(np.int64))

    return fitted(rows, learn) or Chain(np.zeros(FEATURES), np.zeros((2, 2)))


def verdict(texts: pa.Array, chain: Chain, share: float) -> tuple[Facts, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts, labels of lines, content shares, base failures and verdicts of a column."""
    f = facts(texts)
    label = viterbi(chain, f.lines, f.features)
    at = np.concatenate([[0], np.cumsum(f.lines)])
    content = sums(f.line_chars * (label == 0), at) / np.maximum(f.word_chars, 1)
    failed = (f.n_words < 10) | (100 * f.n_repeat_words > 20 * f.n_words)
    return f, label, content, failed, ~failed & (content >= share)


OUT = "id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, n_boilerplate long"


def judged(documents: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """A row with counts and verdict for each row of ``documents``; see ``OUT``.

    Null, empty and blank texts have no words and fail; null ids stay null. Only the two named
    columns are read. No shuffle; a task holds a bounded piece of texts, or one text.
    """
    cols = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    names = [c.split()[0] for c in OUT.split(", ")]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text", 4 << 20):
            f, label, content, failed, good = verdict(batch.column("text"), chain, share)
            boilerplate = sums(label.astype(np.int64), np.concatenate([[0], np.cumsum(f.lines)]))
            columns = [batch.column("id"), f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, good, content, f.lines, boilerplate]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names)

    return cols.mapInArrow(judge, OUT).withColumnRenamed("id", id_col)


def keep(documents: DataFrame, chain: Chain, text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """Rows of ``documents``, all columns, that :func:`judged` keeps."""
    return kept(documents, text_col, lambda: lambda texts: verdict(texts, chain, share)[4])
