"""Token counts by a whole-token shortcut (sentencepiece BPE with a word-begin mark).

Proved once from the vocabulary, without any text: no piece has the mark behind another character,
and none has a line feed. So merges cross neither the begin of a run of spaces behind a word nor a
line feed, and a text's count is the sum over its units (a run of spaces and the word behind it,
or a line's first word). The pieces ``mark + word`` that the library encodes as themselves are one
token wherever they are a unit; only other units are merged, each distinct one once a batch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import binary_array, gathered, text_bytes

MARK = "▁"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def alone(model) -> set[bytes]:
    """The strings `` word`` that encode as a single token, and the proof that units are independent."""
    pieces = [(i, model.id_to_piece(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i) or model.is_unused(i))]
    for _, piece in pieces:
        if "\n" in piece or (MARK in piece[1:] and piece.strip(MARK)):
            raise ValueError(f"pieces reach over units: {piece!r}")
    own = [(i, p[1:]) for i, p in pieces if p.startswith(MARK) and p.strip(MARK)]
    got = model.encode([w for _, w in own], num_threads=1)
    return {b" " + w.encode() for (i, w), ids in zip(own, got, strict=True) if ids == [i]}


class TokenCounter:
    def __init__(self, path: str, most: int = 400_000):
        import sentencepiece

        self.model, self.most = sentencepiece.SentencePieceProcessor(model_file=path), most
        self.alone = alone(self.model)
        self.known = dict.fromkeys(self.alone, 1)
        self.known[b" "] = len(self.model.encode("\n", num_threads=1)) - 1  # the library gives an empty text no mark

    def _merge(self, units: list[bytes]) -> list[int]:
        """Counts by the library. A unit with spaces lends one to the mark that the library puts first; one without stands behind a line feed."""
        texts = [u[1:].decode() if u[:1] == b" " else "\n" + u.decode() for u in units]
        return [len(ids) - 2 * (u[:1] != b" ") for u, ids in zip(units, self.model.encode(texts, num_threads=1), strict=True)]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text; null and empty texts have none."""
        data, offsets = text_bytes(texts)
        n = len(offsets) - 1
        if not len(data):
            return np.zeros(n, np.int64)
        if ((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)).any():  # the mark itself in a text means the same as a space
            texts = pa.array([None if t is None else t.replace(MARK, " ") for t in texts.to_pylist()], pa.large_string())
            data, offsets = text_bytes(texts)
        # Every text that isn't empty gets the space that the library puts before it.
        full = np.flatnonzero(offsets[1:] > offsets[:-1])
        grown = np.full(len(data) + len(full), 32, np.uint8)
        grown[np.arange(len(data)) + 1 + np.repeat(np.arange(len(full)), (offsets[1:] - offsets[:-1])[full])] = data
        head = offsets[:-1][full] + np.arange(len(full))
        feed = grown == 10
        space = grown == 32
        begins = np.zeros(len(grown), bool)
        begins[1:] = (space[1:] & ~space[:-1] & ~feed[:-1]) | feed[:-1]
        begins[head] = True
        begins |= feed
        start = np.flatnonzero(begins)
        row = full[np.searchsorted(head, start, "right") - 1]
        lengths = np.diff(np.append(start, len(grown)))
        line = feed[start]
        total = np.bincount(row[line], minlength=n)
        coded = binary_array(grown[~feed], lengths[~line]).dictionary_encode()
        keys = coded.dictionary.to_pylist()
        out = [self.known.get(k, -1) for k in keys]
        missing = [i for i, c in enumerate(out) if c < 0]
        for at in range(0, len(missing), 20_000):
            some = missing[at : at + 20_000]
            for i, c in zip(some, self._merge([keys[i] for i in some]), strict=True):
                out[i] = c
                if len(self.known) < self.most:
                    self.known[keys[i]] = c
        per = np.array(out, np.int64)[coded.indices.to_numpy()]
        return (total + np.bincount(row[~line], weights=per, minlength=n)).astype(np.int64)


@functools.lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """``id, n_tokens`` for each row of ``df``, over whole texts, with repeated rows repeated.

    Null and empty texts: 0. Null ids stay null. No shuffle; a task holds a bounded piece of texts.
    Other columns, of whatever name, are not read.
    """
    path = path or default_path()
    cols = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in gathered(batches, "text", 6 << 20):
            texts = batch.column("text")
            _, offsets = text_bytes(texts)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.array(counter(path).counts(texts))], ["id", "n_bytes", "n_tokens"])

    return cols.mapInArrow(count, "id long, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)

