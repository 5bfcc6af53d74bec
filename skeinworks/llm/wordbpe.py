"""Ids of whole columns by the ``tokenizers`` library, each distinct word encoded once.

The library drops white space, and nothing that it does reaches over it; so a text's ids are its
words' ids one after another. A run of ASCII punctuation behind a letter is a pre-token of its own.
"""

from __future__ import annotations

import functools
import os

import numpy as np
import pyarrow as pa

from .columns import binary_array, own_places, words

PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[list(b'!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~')] = True


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of distinct words; ``most`` words are remembered from batch to batch."""

    def __init__(self, path: str, most: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.known = Tokenizer.from_file(path), most, {}

    def _ask(self, new: list[bytes]) -> list[np.ndarray]:
        got = self.tokenizer.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)
        return [np.array(e.ids, np.uint32) for e in got]

    def distinct(self, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all distinct words in a row, and how many each has."""
        keys = dictionary.to_pylist()
        out = [self.known.get(k) for k in keys]
        missing = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            for i, ids in zip(some, self._ask([keys[i] for i in some]), strict=True):
                out[i] = ids
                if len(self.known) < self.most:
                    self.known[keys[i]] = ids
        sizes = np.fromiter(map(len, out), np.int64, len(out))
        return np.concatenate([np.zeros(0, np.uint32), *out]).astype(np.uint32), sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a column's texts one after another, and each text's number of ids."""
        w = words(texts)
        if not len(w.start):
            return np.zeros(0, np.uint32), np.zeros(len(w.counts), np.int64)
        data, start, end = w.data, w.start, w.end
        # A word's trailing punctuation is cut off where the byte before it ends an ASCII or Latin-1 letter.
        stem = end.copy()
        cut = np.flatnonzero(PUNCTUATION[data[end - 1]])
        at, low = end[cut], start[cut]
        for _ in range(8):
            at = np.where((at - 1 > low) & PUNCTUATION[data[at - 1]], at - 1, at)
        last, before = data[at - 1], data[np.maximum(at - 2, 0)]
        letter = ((last | 32) >= 97) & ((last | 32) <= 122)
        letter |= (before == 0xC3) & (at - 2 >= low) & (last >= 0x80) & (last <= 0xBF) & (last != 0x97) & (last != 0xB7)
        stem[cut[letter]] = at[letter]
        bars = np.flatnonzero(data == 0x7C)  # a bar may belong to a special token, so the word stays whole and as it is
        bar = np.searchsorted(bars, end) > np.searchsorted(bars, start) if len(bars) else np.zeros(len(end), bool)
        stem = np.where(bar, end, stem)
        cut = stem < end
        n = 1 + cut.astype(np.int64)
        first = np.cumsum(n) - n
        lengths = np.empty(int(n.sum()), np.int64)
        lengths[first] = stem - start
        lengths[first[cut] + 1] = (end - stem)[cut]
        packed = w.packed
        upper = (packed >= 65) & (packed <= 90)
        if upper.any():
            if bar.any():
                upper &= ~np.repeat(bar, w.lengths)
            packed = np.where(upper, packed + np.uint8(32), packed)
        coded = binary_array(packed, lengths).dictionary_encode()
        flat, sizes = self.distinct(coded.dictionary)
        codes = coded.indices.to_numpy()
        per = sizes[codes]
        begin = np.cumsum(sizes) - sizes
        ids = flat[np.repeat(begin[codes], per) + own_places(per)]
        row = np.repeat(w.row, n)
        return ids, np.bincount(row, weights=per, minlength=len(w.counts)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One for each worker process; it outlives the task."""
    return WordEncoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """``end`` after each text's ids."""
    out = np.full(len(ids) + len(counts), end, np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out, counts + 1
