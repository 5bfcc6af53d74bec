"""Stupid-backoff scores of documents from the corpus's own n-gram counts (Brants et al., 2007).

    S(w | v) = c(v w) / c(v .)      if c(v w) >= cutoff
             = 0.4 * c(w) / N       otherwise

``c`` counts over all documents, ``c(v .)`` the words that ``v`` stands before; a text's first word backs
off. A document's score is the sum of the logarithms.

A task turns a bounded block of documents into relations of packed rows: the block's distinct n-grams,
their counts and the documents that use them, a row for each partition of the hashes. So an n-gram
crosses the network once a block, not once an occurrence. Three shuffles follow:

1. Pairs by the hash of their first word: the count table of the pairs and of ``v .`` is made and joined
   with the blocks' pairs. Pairs of a very frequent first word are dealt by both words instead.
2. Words that back off, and frequent first words, by their own hash: joined with the word counts.
3. The documents' partial sums, by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.stash import stash
from .columns import gathered, hash_column, mixed, own_places, release, words
from .rows import batches_of

#: Words with a larger share in a sample of documents count as frequent. This places pairs and changes no count.
HOT, HOT_SAMPLE, HOT_BYTES = 1 / 1000, 100, 10_000
CUTOFF, DISCOUNT = 2, 0.4
#: Bytes of text, and documents, in a block; words in a partition, about.
BLOCK_BYTES, BLOCK_ROWS, PART_WORDS = 12 << 20, 60_000, 2_800_000

#: What a packed row holds. ``keys`` with ``runs`` are sorted first words, ``seconds`` their second ones; ``counts`` and
#: ``entries`` belong to n-grams, ``blocks``, ``docs`` and ``uses`` to entries; ``sums`` to documents.
WORDS, PAIRS, HOT_PAIRS, OWED, DEBT, SUMS, TABLE = range(7)
FIELDS = ("ids", "keys", "runs", "seconds", "counts", "entries", "blocks", "docs", "uses", "sums")
#: Words go by 48 bits of their hashes, and partial sums as floats without their last two bytes; both take six bytes.
TYPES = {"ids": "<i8", "keys": "6", "runs": "<u4", "seconds": "6", "counts": "<u4", "entries": "<u4", "blocks": "<u4", "docs": "<u2", "uses": "<u4", "sums": "f"}
PACKED = "part int, kind int, block long, " + ", ".join(f"{f} binary" for f in FIELDS)


def six_bytes(x: np.ndarray) -> bytes:
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (x >> np.uint64(32)).astype("<u2").tobytes()


def of_six(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    return np.frombuffer(raw, "<u4", n).astype(np.uint64) | np.frombuffer(raw, "<u2", n, 4 * n).astype(np.uint64) << np.uint64(32)


def to_bytes(field: str, x: np.ndarray) -> bytes:
    """Second words are numbered within the row; all is compressed, since the shuffle's own codec has no entropy stage."""
    kind = TYPES[field]
    if not len(x):
        return b""
    if field == "seconds":
        names, at = np.unique(x, return_inverse=True)
        raw = len(names).to_bytes(4, "little") + six_bytes(names) + at.astype("<u4").tobytes()
    elif kind == "f":
        raw = six_bytes((np.ascontiguousarray(x, np.float64).view(np.uint64) + np.uint64(0x8000)) >> np.uint64(16))
    elif kind == "6":
        raw = six_bytes(x)
    else:
        raw = np.ascontiguousarray(x, dtype=kind).tobytes()
    return zstandard.ZstdCompressor(level=1).compress(raw)


def from_bytes(field: str, raw: bytes) -> np.ndarray:
    kind = TYPES[field]
    raw = zstandard.ZstdDecompressor().decompress(raw) if raw else b""
    if field == "seconds" and raw:
        n = int.from_bytes(raw[:4], "little")
        return of_six(raw[4 : 4 + 6 * n])[np.frombuffer(raw, "<u4", offset=4 + 6 * n)]
    if kind in "6f":
        x = of_six(raw)
        return (x << np.uint64(16)).view(np.float64) if kind == "f" else x
    return np.frombuffer(raw, kind)


def packed(part: int, kind: int, block: int = 0, **arrays: np.ndarray) -> pa.RecordBatch:
    return raw_row(part, kind, block, [to_bytes(f, arrays[f]) if f in arrays else b"" for f in FIELDS])


def raw_row(part: int, kind: int, block: int, own: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([block], pa.int64()), *(pa.array([x], pa.binary()) for x in own)], ["part", "kind", "block", *FIELDS])


def together(rows: list[dict], field: str) -> np.ndarray:
    return np.concatenate([from_bytes(field, b""), *(from_bytes(field, r[field]) for r in rows)])


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """48-bit hashes of the column's words (split at ASCII white space, as they stand) and words of each text."""
    w = words(texts)
    codes, names = w.coded()
    return (hash_column(names) & np.uint64(0xFFFFFFFFFFFF))[codes], w.counts


def begins(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin in sorted arrays."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def sizes(starts: np.ndarray, end: int) -> np.ndarray:
    return np.diff(np.append(starts, end))


def dealt(h: np.ndarray, parts: int) -> np.ndarray:
    return (h % np.uint64(parts)).astype(np.int64)


def entry_rows(kind: int, key: np.ndarray, block: np.ndarray, doc: np.ndarray, uses: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Rows of (word, block, document, uses), equal ones added up, dealt by the word."""
    if not len(key):
        return
    place = dealt(key, parts)
    where = block.astype(np.int64) << 16 | doc.astype(np.int64)
    order = np.lexsort((where, key, place))
    place, key, where, uses = place[order], key[order], where[order], uses[order]
    e = begins(key, where)
    uses, key, where, place = np.add.reduceat(uses, e), key[e], where[e], place[e]
    cut = np.searchsorted(place, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        s = slice(cut[p], cut[p + 1])
        k = begins(key[s])
        yield packed(p, kind, keys=key[s][k], runs=sizes(k, cut[p + 1] - cut[p]), blocks=where[s] >> 16, docs=where[s] & 0xFFFF, uses=uses[s])


def pair_rows(kind: int, block: int, v: np.ndarray, w: np.ndarray, doc: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """A block's distinct pairs, a row for each partition, with the documents that use them."""
    if not len(v):
        return
    place = dealt(v if kind == PAIRS else mixed(v * np.uint64(3) + w), parts)
    order = np.lexsort((w, v, place))  # documents stay ascending within a pair
    place, v, w, doc = place[order], v[order], w[order], doc[order]
    gram = begins(v, w)
    entry = begins(v, w, doc)
    uses = sizes(entry, len(v))
    counts = sizes(gram, len(v))
    of = np.searchsorted(gram, entry, "right") - 1
    entries = np.bincount(of, minlength=len(gram))
    ends = np.concatenate([[0], np.cumsum(entries)])
    v, w, place, doc = v[gram], w[gram], place[gram], doc[entry]
    cut = np.searchsorted(place, np.arange(parts + 1))
    for p in np.flatnonzero(np.diff(cut)).tolist():
        s, e = slice(cut[p], cut[p + 1]), slice(ends[cut[p]], ends[cut[p + 1]])
        k = begins(v[s])
        yield packed(p, kind, block, keys=v[s][k], runs=sizes(k, cut[p + 1] - cut[p]), seconds=w[s], counts=counts[s], entries=entries[s], docs=doc[e], uses=uses[e])


def pack(cols: DataFrame, parts: int, hot: np.ndarray) -> DataFrame:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = first_block = TaskContext.get().partitionId() << 12
        for large in gathered(batches, "text", BLOCK_BYTES):
            for at in range(0, large.num_rows, BLOCK_ROWS):
                batch = large.slice(at, BLOCK_ROWS)
                h, counts = hashed(batch.column("text"))
                doc = np.repeat(np.arange(len(counts), dtype=np.int64), counts)
                last = np.zeros(len(h), bool)
                last[(np.cumsum(counts) - 1)[counts > 0]] = True
                first = own_places(counts) == 0
                ids = batch.column("id")
                null = ids.is_null().to_numpy(zero_copy_only=False)
                yield packed(block % parts, TABLE, block, ids=ids.fill_null(0).to_numpy(), runs=null, counts=counts)
                order = np.lexsort((h, dealt(h, parts)))
                key = h[order]
                k = begins(key)
                n, before = sizes(k, len(key)), np.add.reduceat((~last)[order].astype(np.int64), k) if len(k) else k
                cut = np.searchsorted(dealt(key[k], parts), np.arange(parts + 1))
                for p in np.flatnonzero(np.diff(cut)).tolist():
                    s = slice(cut[p], cut[p + 1])
                    yield packed(p, WORDS, keys=key[k][s], counts=n[s], entries=before[s])
                yield from entry_rows(OWED, h[first], np.full(int(first.sum()), block), doc[first], np.ones(int(first.sum()), np.int64), parts)
                v, w, d = h[:-1][~last[:-1]], h[1:][~last[:-1]], doc[:-1][~last[:-1]]
                often = np.isin(v, hot)
                yield from pair_rows(PAIRS, block, v[~often], w[~often], d[~often], parts)
                yield from pair_rows(HOT_PAIRS, block, v[often], w[often], d[often], parts)
                block += 1
                if block >= min(first_block + (1 << 12), 1 << 32):
                    raise ValueError("over 4,096 blocks in a task, or 1,048,575 tasks: read the documents in other partitions")

    return cols.mapInArrow(work, PACKED)


def by_part(rows: DataFrame, key: str, work: Callable[[int, dict[int, list[dict]]], Iterator[pa.RecordBatch]], schema: str = PACKED) -> DataFrame:
    """Runs ``work`` on all rows of one partition or block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        held: dict[int, list[dict]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                if row[key] != now and held:
                    yield from work(now, held)
                    held = {}
                now = row[key]
                held.setdefault(row["kind"], []).append(row)
        if held:
            yield from work(now, held)
            held = {}
        release()

    return rows.repartition(key).sortWithinPartitions(key, "kind").mapInArrow(run, schema)


def summed(sums: dict[str, np.ndarray], parts: int) -> Iterator[pa.RecordBatch]:
    """A row for each block: documents, what they get, how often they back off."""
    where, value, back = sums["where"], sums["value"], sums["back"]
    if not len(where):
        return
    keys, at = np.unique(where, return_inverse=True)
    value, back = np.bincount(at, weights=value), np.bincount(at, weights=back)
    cut = begins(keys >> 16)
    for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(keys)], strict=True):
        block = int(keys[a] >> 16)
        yield packed(block % parts, SUMS, block, docs=keys[a:b] & 0xFFFF, uses=back[a:b], sums=value[a:b])


def score_pairs(parts: int, cutoff: int) -> Callable:
    """First join: blocks' pairs with the partition's count table."""

    def work(_: int, held: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
        for kind in (WORDS, OWED, TABLE):
            for r in held.get(kind, []):
                yield raw_row(r["part"], kind, r["block"], [r[f] for f in FIELDS])
        for kind in (PAIRS, HOT_PAIRS):
            rows = held.pop(kind, [])
            if not rows:
                continue
            v = np.repeat(together(rows, "keys"), together(rows, "runs"))
            w, counts, entries = together(rows, "seconds"), together(rows, "counts").astype(np.int64), together(rows, "entries")
            doc, uses = together(rows, "docs").astype(np.int64), together(rows, "uses").astype(np.int64)
            block = np.repeat(np.array([r["block"] for r in rows], np.int64), [int(from_bytes("entries", r["entries"]).sum()) for r in rows])
            rows.clear()
            order = np.lexsort((w, v))
            gram = begins(v[order], w[order])
            of = np.empty(len(v), np.int64)
            of[order] = np.repeat(np.arange(len(gram)), sizes(gram, len(v)))
            total = np.add.reduceat(counts[order], gram)
            term = np.log(total)
            if kind == PAIRS:
                first = begins(v[order][gram])
                term -= np.repeat(np.log(np.add.reduceat(total, first)), sizes(first, len(gram)))
            kept = total >= cutoff
            per_entry = np.repeat(of, entries)
            ok = kept[per_entry]
            where = block << 16 | doc
            yield from summed({"where": where[ok], "value": term[per_entry[ok]] * uses[ok], "back": np.zeros(int(ok.sum()))}, parts)
            yield from entry_rows(OWED, np.repeat(w, entries)[~ok], block[~ok], doc[~ok], uses[~ok], parts)
            if kind == HOT_PAIRS:
                yield from entry_rows(DEBT, np.repeat(v, entries)[ok], block[ok], doc[ok], uses[ok], parts)

    return work


def score_words(parts: int, discount: float) -> Callable:
    """Second join: backed-off and frequent words with the table of word counts."""

    def work(_: int, held: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
        for kind in (SUMS, TABLE):
            for r in held.get(kind, []):
                yield raw_row(r["part"], kind, r["block"], [r[f] for f in FIELDS])
        rows = held.get(WORDS, [])
        key = together(rows, "keys")
        order = np.argsort(key, kind="stable")
        first = begins(key[order])
        names = key[order][first]
        n = np.add.reduceat(together(rows, "counts").astype(np.int64)[order], first) if len(first) else first
        before = np.add.reduceat(together(rows, "entries").astype(np.int64)[order], first) if len(first) else first
        for kind in (OWED, DEBT):
            rows = held.get(kind, [])
            if not rows:
                continue
            at = np.repeat(np.searchsorted(names, together(rows, "keys")), together(rows, "runs"))
            uses = together(rows, "uses").astype(np.float64)
            where = together(rows, "blocks").astype(np.int64) << 16 | together(rows, "docs").astype(np.int64)
            value = (np.log(n) + np.log(discount))[at] if kind == OWED else -np.log(np.maximum(before, 1))[at]
            yield from summed({"where": where, "value": value * uses, "back": uses if kind == OWED else np.zeros(len(uses))}, parts)

    return work


TOTALS = "id long, score double, backed_off long, n_words long"


def totals(_: int, held: dict[int, list[dict]]) -> Iterator[pa.RecordBatch]:
    table = held[TABLE][0]
    counts = from_bytes("counts", table["counts"]).astype(np.int64)
    value, back = np.zeros(len(counts)), np.zeros(len(counts))
    for r in held.get(SUMS, []):
        docs = from_bytes("docs", r["docs"])
        value[docs] += from_bytes("sums", r["sums"])
        back[docs] += from_bytes("uses", r["uses"])
    ids = pa.array(from_bytes("ids", table["ids"]), mask=from_bytes("runs", table["runs"]) > 0)
    yield pa.RecordBatch.from_arrays([ids, pa.array(value), pa.array(back.astype(np.int64)), pa.array(counts)], ["id", "score", "backed_off", "n_words"])


def backoff_scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", cutoff: int = CUTOFF, discount: float = DISCOUNT, parts: int | None = None) -> DataFrame:
    """``id, n_words, backed_off, log_score`` for each row of ``documents``; ``log_score`` is in nats.

    Words are split at ASCII white space and taken as they stand. Null, empty and blank texts have no
    words and score 0. Repeated rows count each, as part of the corpus. Null ids stay null.
    """
    spark = documents.sparkSession
    cols = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    some = cols.where(F.octet_length("text") <= HOT_BYTES).orderBy(F.xxhash64("text")).limit(HOT_SAMPLE).toPandas()["text"]
    h, _ = hashed(pa.array(some, pa.large_string()))
    names, n = np.unique(h, return_counts=True)
    if parts is None:
        size = cols.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        parts = max(8, int(size / 6.5 / PART_WORDS))
    rows = pack(cols, parts, names[n > HOT * len(h)])
    rows = by_part(rows, "part", score_pairs(parts, cutoff))
    rows = by_part(rows, "part", score_words(parts, discount))
    with batches_of(spark, 32):  # a packed row may have a few hundred KB
        found = stash(by_part(rows, "block", totals, TOTALS), "scores")
    everything = found.agg(F.sum("n_words")).first()[0] or 0
    score = F.col("score") - F.col("backed_off") * float(np.log(max(everything, 1)))
    return found.select(F.col("id").alias(id_col), "n_words", "backed_off", score.alias("log_score"))
