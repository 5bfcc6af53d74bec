"""Removal of repeated passages against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from skeinworks.llm import substrings

from .test_queries import ODD, WORD, documents


def brute(rows, size):
    """(id, words removed, kept text) of each (id, text); no id counts as larger than all."""
    key = lambda i: float("inf") if i is None else i
    low = {}
    split = [(key(i), WORD.findall(t or "")) for i, t in rows]
    for i, ws in split:
        for k in range(len(ws) - size + 1):
            g = tuple(ws[k : k + size])
            low[g] = min(low.get(g, float("inf")), i)
    for (i, ws), (own, _) in zip(split, rows, strict=True):
        gone = {j for k in range(len(ws) - size + 1) if low[tuple(ws[k : k + size])] < i for j in range(k, k + size)}
        yield str(own), len(ws), len(gone), " ".join(w for j, w in enumerate(ws) if j not in gone)


def found(df, size):
    rows = substrings.deduplicated(df, size=size).collect()
    for r in rows:
        ends = [0]
        for s in r["removed"]:
            assert s["start"] >= ends[-1] and s["length"] >= size
            ends.append(s["start"] + s["length"])
    return sorted((str(r["doc_id"]), r["n_words"], sum(s["length"] for s in r["removed"]), r["kept"]) for r in rows)


@pytest.mark.parametrize("seed, crowd, parts, block", [(1, 200_000, 400_000, 6 << 20), (2, 3, 20, 700), (3, 1, 5, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, crowd, parts, block):
    """Also where blocks hold a text each and groups a suffix or two, so that prefixes grow to whole windows."""
    monkeypatch.setattr(substrings, "GROUP", crowd)
    monkeypatch.setattr(substrings, "PART_SUFFIXES", parts)
    monkeypatch.setattr(substrings, "PART_HASHES", 10 * parts)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
    rng = random.Random(seed)
    words = [rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(14)]
    common = [" ".join(rng.choices(words, k=rng.randint(3, 20))) for _ in range(6)]
    texts = [" ".join(rng.choice([rng.choice(common), " ".join(rng.choices(words, k=rng.randint(0, 9)))]) for _ in range(rng.randint(0, 8))) for _ in range(60)]
    texts += [texts[3], texts[3], texts[9] + " end", "start\n" + texts[9], *ODD]
    ids = rng.sample(range(-500, 500), len(texts))
    rows = [*zip(ids, texts, strict=True), (ids[5], texts[5]), (ids[5], texts[8]), (None, texts[7]), (None, texts[7]), (None, "only here twice " * 9)]
    df = documents(spark, [t for _, t in rows], [i for i, _ in rows])
    for size in (13, 4):
        assert found(df, size) == sorted(brute(rows, size))


def test_empty_and_without_repeats(spark):
    assert substrings.deduplicated(documents(spark, ["x"]).limit(0)).count() == 0
    assert found(documents(spark, [None, "", " ", "a b c"]), 13) == [("0", 0, 0, ""), ("1", 0, 0, ""), ("2", 0, 0, ""), ("3", 3, 0, "a b c")]


def test_packed_numbers_and_names():
    for x in ([], [0], [1, 2**63, 2**64 - 1], list(range(300))):
        assert (substrings.from_bytes(substrings.to_bytes(np.array(x, np.uint64))).view(np.uint64) == np.array(x, np.uint64)).all()
    for names in ([], [b"a"], [b"a", b"", "é".encode()]):
        assert substrings.names_of(substrings.names_bytes(pa.array(names, pa.large_binary()))).to_pylist() == names


def test_equal_hashes_of_different_windows(monkeypatch):
    """Words decide, even if hashes do not."""
    block = next(substrings_blocks(["a b c", "a b d", "a b c", "x y z"]))
    monkeypatch.setattr(substrings, "rolled", lambda word, start, size: np.zeros(len(start), np.uint64))
    w = substrings.Windows(block, 3)
    assert sorted(w.low.tolist()) == [0, 1, 3] and len(w.first) == 3


def substrings_blocks(texts):
    from skeinworks.llm.columns import words

    w = words(pa.array(texts))
    codes, names = w.coded()
    yield {"ids": substrings.to_bytes(np.arange(len(texts))), "counts": substrings.to_bytes(w.counts), "names": substrings.names_bytes(names), "codes": substrings.to_bytes(codes), "places": bytes(len(texts))}


def test_deep_nodes():
    text = np.array([[1, 1, 2, 1, 2], [5, 5, 6, 7, 6], [9, 9, 1, 9, 1]])
    alive, first = substrings.deep_nodes(text)
    assert [sorted(x.tolist()) for x in np.split(alive, first[1:])] == [[0, 1], [2, 4]]
