"""Benchmark passages in documents: latent semantic retrieval, then exact checks.

1. Document frequencies of hashed words over all documents give each word its weight (idf).
2. The latent space is cut out of the span of the benchmark's TF-IDF passages: a truncated singular value decomposition
   (Rayleigh and Ritz) of these passages and of all documents, whose products in that span are summed over Spark tasks.
   Its rank is well under the number of passages; the benchmark's weigh more, so that it keeps their directions.
3. Every document is read in blocks of 16 words. All windows of consecutive blocks are projected, and the
   cosines with all passages of their size are taken in the latent space.
4. A candidate is a leak if the longest common subsequence of words covers enough of the passage,
   and enough of its answer: what stands behind ``answer:``, else its last quarter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stash import stash
from .columns import distinct, gathered, hash_column, own_places, pieces, plain_words, release
from .rows import kept

SLOTS = 1 << 19
#: Slots that cross the network together.
RANGE = 1 << 13
BLOCK = 16
#: Window sizes, in words; a passage is sought with the first that has room for it at any place.
SIZES = (32, 48, 64, 96, 128)
#: Benchmark passages of a latent space; spaces in one pass over the documents.
PASSAGES, SPACES = 256, 8
#: Rank of a space: this share of its passages, and some dimensions for what all texts have in common.
SHARE, SHARED = 0.6, 16
#: How much more the benchmark's passages weigh in the space than all documents.
WEIGHT = 4.0
#: Numbers of the block of documents that is multiplied at a time in the fit.
DENSE = 1 << 20
#: For :func:`sampled`.
SAMPLE, SAMPLE_BYTES = 512, 10_000
#: Least latent cosine and least shares of a passage and of its answer; a passage of fewer words than ``SHORT`` must be there whole.
COSINE, COMMON, ANSWER, SHORT = 0.7, 0.5, 0.4, 8
#: Benchmark items that reach the driver at a time.
ITEMS = 2000

ANSWER_MARK = re.compile(r"\banswer\b\s*:", re.IGNORECASE)


def added_up(parts: DataFrame, kind: type, *by: str) -> DataFrame:
    """Adds packed arrays of numbers that have the same ``by``; a task holds one sum at a time."""
    wide = np.dtype(kind).itemsize

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            for *key, raw in zip(*(batch.column(c).to_pylist() for c in (*by, "part")), strict=True):
                if key != now and now is not None:
                    yield row(now, total)
                if key != now:
                    now, total = key, np.zeros(len(raw) // wide, kind)
                total += np.frombuffer(raw, kind)
        if now is not None:
            yield row(now, total)

    def row(key: list[int], total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([total.tobytes()], pa.binary())], [*by, "part"])

    schema = ", ".join([*(f"{c} long" for c in by), "part binary"])
    return parts.select(*by, "part").repartition(*by).sortWithinPartitions(*by).mapInArrow(work, schema)


def collected(parts: DataFrame, kind: type) -> np.ndarray:
    """The sums of ``parts(at, part)``, joined in the order of ``at``. Added up in two steps, so that no task reads every other's part."""
    some = added_up(parts.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(32)).cast("long")), kind, "at", "salt")
    rows = sorted(added_up(some, kind, "at").collect())
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(r["part"], kind) for r in rows)])


def document_frequencies(documents: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """The number of documents and, for each slot, of those that have a word there. Summed in tasks, then by range of slots."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS + 1, np.int64)
        for batch in pieces(batches, "text", 4 << 20):
            codes, names, counts = plain_words(batch.column("text"))
            slots = (hash_column(names) % np.uint64(SLOTS)).astype(np.int64)
            keys = distinct(np.repeat(np.arange(len(counts)), counts) * SLOTS + slots[codes])
            total[:SLOTS] += np.bincount(keys % SLOTS, minlength=SLOTS)
            total[SLOTS] += len(counts)
        for at in range(0, SLOTS + 1, RANGE):
            if total[at : at + RANGE].any():
                yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([total[at : at + RANGE].tobytes()], pa.binary())], ["at", "part"])

    texts = documents.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    none = documents.sparkSession.createDataFrame([(at, bytes(8 * min(RANGE, SLOTS + 1 - at))) for at in range(0, SLOTS + 1, RANGE)], "at long, part binary")
    df = collected(texts.mapInArrow(count, "at long, part binary").union(none), np.int64)
    return int(df[-1]), df[:-1]


def sampled(documents: DataFrame, n: int, text_col: str = "text") -> DataFrame:
    """``text``: about ``SAMPLE`` documents by the hash of their text, written once, for trials of the fit. No query takes it: :func:`prepared` fits on all documents."""
    text = F.col(f"`{text_col}`").cast("string")
    some = documents.select(text.alias("text")).where((F.octet_length("text") <= SAMPLE_BYTES) & (F.pmod(F.xxhash64("text"), F.lit(max(1, n // SAMPLE))) == 0))
    return stash(some.distinct().limit(2 * SAMPLE), "sample")


class Passages:
    """Benchmark items as passages: their words' hashes, cut to at most the largest window but a block."""

    def __init__(self, items: list[tuple[int, str]]):
        self.item, self.words, self.answer, self.size = [], [], [], []
        room = SIZES[-1] - BLOCK
        for item, text in items:
            h = word_hashes(text)
            mark = ANSWER_MARK.search(text or "")
            answer = word_hashes(text[mark.end() :]) if mark else h[-max(3, len(h) // 4) :]
            for at in range(0, max(1, len(h) - BLOCK), room // 2):
                part = h[at : at + room]
                if len(part):
                    self.item.append(item)
                    self.words.append(part)
                    # Only the passage that holds the answer is asked for it.
                    self.answer.append(answer if at + room >= len(h) else part[:0])
                    self.size.append(next(s for s in SIZES if len(part) <= s - BLOCK or s == SIZES[-1]))
        self.size = np.array(self.size, np.int64)

    def part(self, at: int, to: int) -> Passages:
        out = Passages([])
        out.item, out.words, out.answer, out.size = self.item[at:to], self.words[at:to], self.answer[at:to], self.size[at:to]
        return out

    def passes(self) -> Iterator[list[Passages]]:
        """Lists of at most ``SPACES`` parts of at most ``PASSAGES`` passages; an item is in one list, which only its own length makes longer."""
        first = [i for i, item in enumerate(self.item) if not i or item != self.item[i - 1]]
        at = 0
        while at < len(self.item):
            to = max((f for f in [*first, len(self.item)] if at < f <= at + SPACES * PASSAGES), default=None)
            to = to or min(f for f in [*first, len(self.item)] if f > at)
            yield [self.part(k, min(to, k + PASSAGES)) for k in range(at, to, PASSAGES)]
            at = to


def word_hashes(text: str | None) -> np.ndarray:
    codes, names, _ = plain_words(pa.array([text or ""], pa.large_string()))
    return hash_column(names)[codes]


def latent_space(passages: Passages, idf: np.ndarray, texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The space's slots and their rows of right singular vectors, of rank ``SHARE`` of the passages and ``SHARED``."""
    return latent_spaces([passages], idf, texts)[0]


def latent_spaces(parts: list[Passages], idf: np.ndarray, texts: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """:func:`latent_space` of each of ``parts``, in one pass over ``texts(text)``.

    The benchmark's passages span the space that a passage's cosines need; its best directions are those of most weight
    in the passages and in all texts together. Each task adds up its texts' products in that span, a small matrix a space.
    A text counts once, by its distinct words that some passage has, at unit length; all texts together weigh ``1 / WEIGHT`` of the passages.
    """
    own = []
    for p in parts:
        sets = [np.unique(w % np.uint64(SLOTS)).astype(np.int64) for w in p.words]
        slots = np.unique(np.concatenate([*sets, np.zeros(0, np.int64)]))
        rows = np.zeros((len(sets), len(slots)))
        for row, found in zip(rows, sets, strict=True):
            row[np.searchsorted(slots, found)] = idf[found]
            row /= max(1e-9, float(np.linalg.norm(row)))
        _, values, span = np.linalg.svd(rows, full_matrices=False)
        keep = values > 1e-6 * values.max(initial=0)
        own.append((slots, values[keep] ** 2, span[keep].T))
    shared = texts.sparkSession.sparkContext.broadcast((idf, [(slots, span.astype(np.float32)) for slots, _, span in own]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, spaces = shared.value
        totals = [np.zeros((span.shape[1], span.shape[1])) for _, span in spaces]
        for batch in pieces(batches, "text", 4 << 20):
            codes, names, counts = plain_words(batch.column("text"))
            slot = (hash_column(names) % np.uint64(SLOTS)).astype(np.int64)
            keys = distinct(np.repeat(np.arange(len(counts)), counts) * SLOTS + slot[codes])
            text, slot = keys // SLOTS, keys % SLOTS
            for (slots, span), total in zip(spaces, totals, strict=True):
                at = np.minimum(np.searchsorted(slots, slot), len(slots) - 1)
                known = slots[at] == slot
                row, at = text[known], at[known]
                step = max(1, DENSE // len(slots))
                for first in range(0, len(counts), step):
                    a, b = np.searchsorted(row, [first, first + step])
                    block = np.zeros((min(step, len(counts) - first), len(slots)), np.float32)
                    block[row[a:b] - first, at[a:b]] = idf[slots[at[a:b]]]
                    block /= np.maximum(np.linalg.norm(block, axis=1, keepdims=True), 1e-9)
                    y = block @ span
                    total += y.T @ y
        for k, total in enumerate(totals):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([total.tobytes()], pa.binary())], ["at", "part"])

    got = collected(texts.select("text").where(F.length("text") > 0).mapInArrow(add, "at long, part binary"), np.float64)
    shared.destroy()
    release()
    out, at = [], 0
    for p, (slots, values, span) in zip(parts, own, strict=True):
        size = len(values)
        theirs = got[at : at + size * size].reshape(size, size) if len(got) else np.zeros((size, size))
        at += size * size
        weight = values.sum() / max(1e-9, WEIGHT * np.trace(theirs))
        heavy, vectors = np.linalg.eigh(np.diag(values) + weight * theirs)
        k = min(int(np.ceil(SHARE * len(p.words))) + SHARED, size)
        out.append((slots, (span @ vectors[:, np.argsort(-heavy)[:k]]).astype(np.float32)))
    return out


def common_length(a: np.ndarray, b: np.ndarray) -> int:
    """Words in the longest common subsequence, with a bit for each word of ``a`` (Hyyrö, 2004)."""
    where: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b.tolist():
        m = where.get(w, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class Space:
    """Seeks the passages of one latent space."""

    def __init__(self, idf: np.ndarray, vocabulary: np.ndarray, basis: np.ndarray, passages: Passages, cosine: float):
        self.passages = passages
        # In the least window a short passage stands among more words of others than a long one.
        self.least = (cosine * np.sqrt(np.minimum(1, np.array([len(w) for w in passages.words]) / BLOCK))).astype(np.float32)
        self.row = np.full(SLOTS, len(vocabulary), np.int32)
        self.row[vocabulary] = np.arange(len(vocabulary))
        #: What a word adds to its window; the last row is that of words without a place in the space.
        self.basis = np.concatenate([basis * idf[vocabulary, None], np.zeros((1, basis.shape[1]), np.float32)]).astype(np.float32)
        query = np.stack([self.basis[self.row[(w % np.uint64(SLOTS)).astype(np.int64)]].sum(0) for w in passages.words]) if passages.words else np.zeros((0, basis.shape[1]), np.float32)
        self.query = query / np.maximum(np.linalg.norm(query, axis=1, keepdims=True), 1e-9)

    def candidates(self, slots: np.ndarray, counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, first words, passages and latent cosines of the windows that come near a passage.

        Windows begin at every block of ``BLOCK`` words of a text and end with the text at the latest.
        """
        blocks = -(-counts // BLOCK)
        row = np.repeat(np.arange(len(counts)), blocks)
        begin = np.repeat(np.cumsum(counts) - counts, blocks) + own_places(blocks) * BLOCK
        left = np.repeat(blocks, blocks) - own_places(blocks)
        first = own_places(blocks) == 0
        places = self.row[slots]
        step = 1024
        longest = SIZES[-1] // BLOCK
        for at in range(0, len(row), step):
            # A portion's last windows reach into the next one's blocks.
            to, reach = min(len(row), at + step), min(len(row), at + step + longest)
            low, high = int(begin[at]), int(begin[reach]) if reach < len(row) else len(slots)
            block = np.add.reduceat(self.basis[places[low:high]], begin[at:reach] - low)
            total = np.concatenate([np.zeros((1, block.shape[1])), np.cumsum(block, axis=0, dtype=np.float64)])
            for size in SIZES:
                asked = np.flatnonzero(self.passages.size == size)
                if not len(asked):
                    continue
                many = size // BLOCK
                some = np.flatnonzero((left[at:to] >= many) | first[at:to])
                end = np.minimum(some + many, some + left[at:to][some])
                w = (total[end] - total[some]).astype(np.float32)
                norm = np.maximum(np.linalg.norm(w, axis=1, keepdims=True), 1e-6)
                score = w @ self.query[asked].T
                x, y = np.nonzero(score >= self.least[asked] * norm)
                if len(x):
                    yield row[at:to][some[x]], begin[at:to][some[x]], asked[y], score[x, y] / norm[x, 0]


class Finder:
    """Seeks the passages of several latent spaces in a column of texts; what it holds is bounded by ``PASSAGES`` and ``SPACES``."""

    def __init__(self, idf: np.ndarray, spaces: list[tuple[np.ndarray, np.ndarray, Passages]], cosine: float):
        self.spaces = [Space(idf, *space, cosine) for space in spaces]

    def leaks(self, texts: pa.Array) -> list[tuple[int, int, float, float, float]]:
        """(row, item, cosine, common, answer) of each leak; the best window stands for a row and item."""
        codes, names, counts = plain_words(texts)
        if not len(codes):
            return []
        hashes = hash_column(names)
        slots = (hashes % np.uint64(SLOTS)).astype(np.int64)[codes]
        ends = np.cumsum(counts)
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for space in self.spaces:
            for rows, begins, asked, cosines in space.candidates(slots, counts):
                for r, b, q, c in zip(rows.tolist(), begins.tolist(), asked.tolist(), cosines.tolist(), strict=True):
                    words, size = space.passages.words[q], int(space.passages.size[q])
                    low, high = max(int(ends[r] - counts[r]), b - BLOCK), min(int(ends[r]), b + size + BLOCK)
                    region = hashes[codes[low:high]]
                    found = common_length(words, region)
                    if found < max(COMMON * len(words), min(SHORT, len(words))):
                        continue
                    common = found / len(words)
                    answer = space.passages.answer[q]
                    found = common_length(answer, region) / len(answer) if len(answer) else 1.0
                    key = (r, space.passages.item[q])
                    if found >= ANSWER and (common, found, c) > best.get(key, (0.0, 0.0, 0.0)):
                        best[key] = (common, found, c)
        return [(r, i, c, common, found) for (r, i), (common, found, c) in sorted(best.items())]


LEAKS = "id long, item_id long, cosine double, common double, answer double"


def prepared(documents: DataFrame, benchmark: DataFrame, text_col: str) -> Iterator:
    """For each pass over the documents, a broadcast of what a :class:`Finder` takes."""
    spark = documents.sparkSession
    n, df = document_frequencies(documents, text_col)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    texts = documents.select(F.col(f"`{text_col}`").cast("string").alias("text"))
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()
    blocks = max(1, -(-items.count() // ITEMS))
    for k in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).orderBy("item_id", "text").collect()
        for parts in Passages([(r["item_id"], r["text"]) for r in mine]).passes():
            yield spark.sparkContext.broadcast((idf, [(*space, p) for space, p in zip(latent_spaces(parts, idf, texts), parts, strict=True)]))


def leaks(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """``id, item_id, cosine, common, answer`` for each document and benchmark item that it holds.

    All documents are read, whole, once for the frequencies and, for each ``SPACES`` times ``PASSAGES``
    passages, once for the fit and once for the search; what a task holds is bounded by that number. The benchmark's texts reach the driver block by
    block. Null and empty texts on either side are in no leak; null ids stay null; a repeated
    benchmark row counts once, a repeated document row is reported each time.
    """
    cols = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    out = documents.sparkSession.createDataFrame([], LEAKS)
    for shared in prepared(documents, benchmark, text_col):

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            finder = Finder(*shared.value, cosine)
            for batch in gathered(batches, "text", 4 << 20):
                found = finder.leaks(batch.column("text"))
                ids = batch.column("id").take(pa.array([f[0] for f in found], pa.int64()))
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[j + 1] for f in found], kind) for j, kind in enumerate(kinds))], [c.split()[0] for c in LEAKS.split(", ")])

        out = out.union(cols.mapInArrow(find, LEAKS))
    return out.withColumnRenamed("id", id_col)


def unleaked(documents: DataFrame, benchmark: DataFrame, text_col: str = "text", cosine: float = COSINE) -> DataFrame:
    """Rows of ``documents``, all columns, that hold no benchmark item."""
    for shared in prepared(documents, benchmark, text_col):

        def choose(shared=shared):
            finder = Finder(*shared.value, cosine)

            def which(texts: pa.Array) -> np.ndarray:
                out = np.ones(len(texts), bool)
                out[[f[0] for f in finder.leaks(texts)]] = False
                return out

            return which

        documents = kept(documents, text_col, choose)
    return documents
