"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is the sum of a vector for the word (hashed) and the mean of the vectors of its
character 3- to 5-grams (hashed, with marks at both ends). Two gated recurrent layers read a window
of words forwards and backwards, attention pools their states, a logistic unit scores the window. A
text's score is the largest over all its windows of 32 words, which overlap by 16; a shorter text is
repeated to fill a window, and a text without words scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import binary_array, lower_ascii, own_places, pieces, spans, text_bytes
from .rows import fitted, kept

WINDOW, STRIDE = 32, 16
WIDTH, STATE = 16, 8
WORD_SLOTS, GRAM_SLOTS = 1 << 14, 1 << 15
#: Labelled documents that the network is fitted on at most, for each label, and the longest that is taken, in bytes.
SAMPLE, SAMPLE_BYTES = 1200, 16_000

LETTER = np.zeros(256, bool)
LETTER[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = True
LETTER[128:] = True


@dataclass
class Tokens:
    """Words of letters and digits: a number for each and the distinct ones' hashed inputs."""

    codes: np.ndarray
    counts: np.ndarray
    word_slot: np.ndarray
    gram_slot: np.ndarray
    grams: np.ndarray


def tokens(texts: pa.Array) -> Tokens:
    data, offsets = text_bytes(texts)
    data = lower_ascii(data)
    keep = LETTER[data]
    start, end, row = spans(data, offsets, ~keep)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    if not len(start):
        none = np.zeros(0, np.int64)
        return Tokens(none, counts, none, none, none)
    coded = binary_array(data[keep], end - start).dictionary_encode()
    raw, cuts = _bytes_of(coded.dictionary)
    sizes = np.diff(cuts)
    n = len(sizes)
    marked = np.empty(len(raw) + 2 * n, np.uint64)
    at = cuts[:-1] + 2 * np.arange(n)
    marked[at], marked[at + sizes + 1] = 1, 2
    marked[np.arange(len(raw)) + 2 * np.repeat(np.arange(n), sizes) + 1] = raw
    long = sizes + 2
    hashes, owner = [], []
    for k in (3, 4, 5):
        many = np.maximum(long - k + 1, 0)
        begin = np.repeat(at, many) + own_places(many)
        h = np.full(len(begin), k, np.uint64)
        for j in range(k):
            h = (h ^ marked[begin + j]) * np.uint64(0x100000001B3)
        hashes.append(_mixed(h) % np.uint64(GRAM_SLOTS))
        owner.append(np.repeat(np.arange(n), many))
    owner_all = np.concatenate(owner)
    order = np.argsort(owner_all, kind="stable")
    grams = np.bincount(owner_all, minlength=n)
    # A word's hash comes from sums over its bytes, each times a power of an odd constant.
    places = own_places(sizes)
    powers = np.cumprod(np.full(int(sizes.max()) + 1, 0x9E3779B97F4A7C15, np.uint64))
    whole = np.add.reduceat((raw.astype(np.uint64) + np.uint64(1)) * powers[places], cuts[:-1])
    return Tokens(coded.indices.to_numpy().astype(np.int64), counts, (_mixed(whole) % np.uint64(WORD_SLOTS)).astype(np.int64), np.concatenate(hashes)[order].astype(np.int64), grams)


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the words of every window, a row each, and whose windows they are."""
    counts = counts.astype(np.int64)
    many = np.where(counts > 0, 1 + np.maximum(-(-(counts - WINDOW) // STRIDE), 0), 0)
    owner = np.repeat(np.arange(len(counts)), many)
    n = counts[owner]
    first = (np.cumsum(counts) - counts)[owner]
    begin = np.minimum(own_places(many) * STRIDE, np.maximum(n - WINDOW, 0))
    return first[:, None] + (begin[:, None] + np.arange(WINDOW)) % n[:, None], owner


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-x, -60, 60)))


@dataclass
class Network:
    """Parameters by name; ``f`` reads forwards, ``b`` backwards. Gates stand in the order update, reset, new."""

    p: dict[str, np.ndarray] = field(default_factory=dict)

    @staticmethod
    def fresh(seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        g = lambda *s, scale: (r.standard_normal(s) * scale).astype(np.float32)
        p = {"words": g(WORD_SLOTS, WIDTH, scale=0.05), "grams": g(GRAM_SLOTS, WIDTH, scale=0.2)}
        for d in "fb":
            p |= {f"in_{d}": g(WIDTH, 3 * STATE, scale=0.4), f"bias_{d}": np.zeros(3 * STATE, np.float32), f"rec_{d}": g(STATE, 3 * STATE, scale=0.3)}
        return Network(p | {"look": g(2 * STATE, scale=0.3), "out": g(2 * STATE, scale=0.3), "at": np.full(1, -1, np.float32)})

    def inputs(self, t: Tokens) -> np.ndarray:
        """The input vector of each distinct word."""
        x = self.p["words"][t.word_slot]
        ends = np.cumsum(t.grams)
        for a in range(0, len(x), 16_384):
            b = min(len(x), a + 16_384)
            low = ends[a] - t.grams[a]
            some = self.p["grams"][t.gram_slot[low : ends[b - 1]]]
            x[a:b] += np.add.reduceat(some, ends[a:b] - t.grams[a:b] - low) / t.grams[a:b, None]
        return x

    def states(self, projected: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """States after each step; ``projected`` is (step, window, gate)."""
        rec, s = self.p[f"rec_{d}"], STATE
        steps, n, _ = projected.shape
        h = np.zeros((n, s), np.float32)
        out = np.empty((steps, n, s), np.float32)
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            a = h @ rec
            gates = sigmoid(projected[t, :, : 2 * s] + a[:, : 2 * s])
            new = np.tanh(projected[t, :, 2 * s :] + gates[:, s:] * a[:, 2 * s :])
            if keep is not None:
                keep.append((t, h, a[:, 2 * s :], gates, new))
            h = new + gates[:, :s] * (h - new)
            out[t] = h
        return out

    def pooled(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        look = h @ self.p["look"]
        look -= look.max(0)
        a = np.exp(look)
        a /= a.sum(0)
        pool = np.einsum("tn,tnk->nk", a, h)
        return a, pool, pool @ self.p["out"] + self.p["at"][0]

    def score_windows(self, t: Tokens, places: np.ndarray, portion: int = 4096) -> np.ndarray:
        """The score of each window."""
        x = self.inputs(t)
        by_word = {d: x @ self.p[f"in_{d}"] + self.p[f"bias_{d}"] for d in "fb"}
        out = np.empty(len(places), np.float32)
        for at in range(0, len(places), portion):
            codes = t.codes[places[at : at + portion]].T
            h = np.concatenate([self.states(by_word[d][codes], d) for d in "fb"], axis=2)
            out[at : at + portion] = sigmoid(self.pooled(h)[2])
        return out

    def gradients(self, t: Tokens, x: np.ndarray, places: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of a batch of windows, through time by hand."""
        p, s = self.p, STATE
        codes = t.codes[places].T
        xs = x[codes]
        saved: dict[str, list] = {"f": [], "b": []}
        h = np.concatenate([self.states(xs @ p[f"in_{d}"] + p[f"bias_{d}"], d, saved[d]) for d in "fb"], axis=2)
        a, pool, logit = self.pooled(h)
        q = sigmoid(logit)
        loss = float(-(y * np.log(q + 1e-7) + (1 - y) * np.log(1 - q + 1e-7)).mean())
        dl = ((q - y) / len(y)).astype(np.float32)
        g = {"out": pool.T @ dl, "at": dl.sum(keepdims=True)}
        dpool = dl[:, None] * p["out"]
        da = np.einsum("nk,tnk->tn", dpool, h)
        dlook = a * (da - (a * da).sum(0))
        g["look"] = np.einsum("tn,tnk->k", dlook, h)
        dh_all = a[:, :, None] * dpool + dlook[:, :, None] * p["look"]
        dx = np.zeros_like(xs)
        for d, half in (("f", slice(0, s)), ("b", slice(s, 2 * s))):
            rec, d_rec = p[f"rec_{d}"], np.zeros_like(p[f"rec_{d}"])
            dgates = np.empty((len(xs), len(y), 3 * s), np.float32)
            carry = np.zeros((len(y), s), np.float32)
            for step, h0, an, gates, new in reversed(saved[d]):
                dh = carry + dh_all[step, :, half]
                z, r = gates[:, :s], gates[:, s:]
                dn = dh * (1 - z) * (1 - new * new)
                dz = dh * (h0 - new) * z * (1 - z)
                dr = dn * an * r * (1 - r)
                dgates[step] = np.concatenate([dz, dr, dn], axis=1)
                into = np.concatenate([dz, dr, dn * r], axis=1)
                d_rec += h0.T @ into
                carry = dh * z + into @ rec.T
            flat = dgates.reshape(-1, 3 * s)
            g |= {f"rec_{d}": d_rec, f"in_{d}": xs.reshape(-1, WIDTH).T @ flat, f"bias_{d}": flat.sum(0)}
            dx += dgates @ p[f"in_{d}"].T
        words, where = np.unique(codes.ravel(), return_inverse=True)
        flat = dx.reshape(-1, WIDTH)
        by_word = np.stack([np.bincount(where, weights=flat[:, k], minlength=len(words)) for k in range(WIDTH)], 1).astype(np.float32)
        many = t.grams[words]
        slots = t.gram_slot[np.repeat((np.cumsum(t.grams) - t.grams)[words], many) + own_places(many)]
        g["words"] = (t.word_slot[words], by_word)
        g["grams"] = (slots, np.repeat(by_word / many[:, None], many, axis=0))
        return loss, g


def learn(net: Network, texts: pa.Array, y: np.ndarray, rounds: int = 7, batch: int = 256, rate: float = 0.01, seed: int = 5) -> Network:
    """Adam on windows. At first windows bear their text's label; later a toxic text lends it to its best window alone,
    and clean texts add the windows that score highest."""
    t = tokens(texts)
    places, owner = windows(t.counts)
    r = np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    v2 = {k: np.zeros_like(v) for k, v in net.p.items()}
    toxic = y[owner] > 0
    turn = 0
    for k in range(rounds):
        key = r.random(len(owner))
        if k >= 2:
            score = net.score_windows(t, places)
            key = np.where(toxic | (r.random(len(owner)) < 0.5), -score + 1e-3 * key, key)
        order = np.lexsort((key, owner))
        rank = own_places(np.bincount(owner, minlength=len(y)))
        use = order[rank < (8 if k < 2 else np.where(toxic[order], 1, 6))]
        if k >= 2:
            use = np.concatenate([use, np.repeat(use[toxic[use]], 3)])
        r.shuffle(use)
        fine = rate * (0.3 if k >= rounds - 2 else 1.0)
        for at in range(0, len(use), batch):
            some = use[at : at + batch]
            turn += 1
            # Only the batch's own words get inputs; the rest are not touched.
            _, g = net.gradients(t, _inputs_of(net, t, places[some]), places[some], y[owner[some]].astype(np.float32))
            for name, d in g.items():
                if isinstance(d, tuple):
                    full = np.zeros_like(net.p[name])
                    slots, rows = d
                    for c in range(WIDTH):
                        full[:, c] = np.bincount(slots, weights=rows[:, c], minlength=len(full))
                    touched = np.unique(slots)
                    d, where = full[touched], touched
                else:
                    where = slice(None)
                m[name][where] = 0.9 * m[name][where] + 0.1 * d
                v2[name][where] = 0.99 * v2[name][where] + 0.01 * d * d
                step = m[name][where] / (1 - 0.9**turn) / (np.sqrt(v2[name][where] / (1 - 0.99**turn)) + 1e-6)
                net.p[name][where] -= (fine * step).astype(np.float32)
    return net


def _inputs_of(net: Network, t: Tokens, places: np.ndarray) -> np.ndarray:
    words = np.unique(t.codes[places])
    many = t.grams[words]
    slots = t.gram_slot[np.repeat((np.cumsum(t.grams) - t.grams)[words], many) + own_places(many)]
    x = np.zeros((len(t.grams), WIDTH), np.float32)
    x[words] = net.p["words"][t.word_slot[words]] + np.add.reduceat(net.p["grams"][slots], np.cumsum(many) - many) / many[:, None]
    return x


def centre(net: Network, texts: pa.Array, y: np.ndarray) -> None:
    """Moves the unit's threshold half-way between the sample's clean and toxic texts."""
    s = np.clip(score_texts(net, texts), 1e-7, 1 - 1e-7)
    z = np.log(s / (1 - s))
    net.p["at"] -= np.float32((np.quantile(z[y == 0], 0.999) + np.quantile(z[y == 1], 0.01)) / 2)


def score_texts(net: Network, texts: pa.Array) -> np.ndarray:
    t = tokens(texts)
    out = np.zeros(len(t.counts))
    if len(t.codes):
        places, owner = windows(t.counts)
        np.maximum.at(out, owner, net.score_windows(t, places).astype(np.float64))
    return out


def held_out(id_col: str) -> F.Column:
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % 5 == 0


def train(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Network:
    """Fits the network on at most ``SAMPLE`` documents of each label that aren't held out, those with the smallest hashes
    of id. They meet in one task that fits; the driver gets the
    parameters. Without labels of both kinds every text scores low."""
    known = labels.where(F.col(label_col).isin(0, 1) & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).alias("y"))
    short = documents.where(F.octet_length(text_col) <= SAMPLE_BYTES).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    some = None
    for y in (0, 1):
        one = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
        some = one if some is None else some.union(one)
    rows = short.where(F.length(F.trim("text")) > 0).join(F.broadcast(some), "id").orderBy("id", "text").limit(2 * SAMPLE)

    def fit(table: pa.Table) -> dict[str, np.ndarray]:
        net, texts, y = Network.fresh(), table["text"].combine_chunks().cast(pa.large_string()), table["y"].to_numpy()
        if len(np.unique(y)) == 2:
            centre(learn(net, texts, y), texts, y)
        else:
            net.p["out"][:] = 0
        return net.p

    found = fitted(rows, fit)
    if found is None:
        net = Network.fresh()
        net.p["out"][:] = 0
        return net
    return Network(found)


def scored(documents: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, held_out, score, predicted`` for each row of ``documents``, from its whole text alone.

    Null, empty and wordless texts score 0. Null ids stay null and count as held out. Repeated rows
    are scored each; other columns are not read. No shuffle; the network is of fixed size.
    """
    shared = documents.sparkSession.sparkContext.broadcast(net.p)
    cols = documents.select(F.col(f"`{id_col}`").cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Network(shared.value)
        for batch in pieces(batches, "text", 4 << 20):
            s = score_texts(own, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    return cols.mapInArrow(score, "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def clean(documents: DataFrame, net: Network, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Rows of ``documents``, all columns, whose texts score under ``threshold``."""
    shared = documents.sparkSession.sparkContext.broadcast(net.p)

    def choose():
        own = Network(shared.value)
        return lambda texts: score_texts(own, texts) < threshold

    return kept(documents, text_col, choose)
