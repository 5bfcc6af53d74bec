"""Runs, and manifests with proofs, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from skeinworks.llm import manifest, queries, runs
from skeinworks.llm.columns import words

from .test_queries import ODD, WORD, documents, odd


def brute_runs(ws, least, times):
    found = {}
    for p in range(1, len(ws) // 2 + 1):
        i = 0
        while i + p < len(ws):
            j = i
            while j + p < len(ws) and ws[j] == ws[j + p]:
                j += 1
            if j > i and j + p - i >= max(least, times * p):
                found.setdefault((i, j + p), p)
            i = max(j, i + 1)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def brute_collapse(ws, found):
    gone = {i for s, n, p in found for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(ws) if i not in gone)


def planted_text(rng):
    t = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randint(0, 60))]
    if rng.random() < 0.5:
        q = rng.randint(1, 6)
        t += ([rng.choice("abc") for _ in range(q)] * 12)[: rng.randint(1, 12 * q)] + t[:5]
    return t


def test_runs_equal_brute_force():
    rng = random.Random(1)
    for _ in range(150):
        texts = [planted_text(rng) for _ in range(rng.randint(1, 6))]
        least, times = rng.choice([(2, 2), (6, 3), (24, 3), (4, 2), (5, 3)])
        w = words(pa.array([" ".join(t) for t in texts]))
        row, start, end, p = runs.runs_in(w, least, times)
        for r, t in enumerate(texts):
            got = [(int(a - w.firsts()[r]), int(b - a), int(c)) for a, b, c in zip(start[row == r], end[row == r], p[row == r], strict=True)]
            assert got == brute_runs(t, least, times)


def test_fibonacci_words_and_one_letter():
    a, b = ["x"], ["x", "y"]
    while len(b) < 1500:
        a, b = b, b + a
    for t in (b, ["x"] * 3000, ["x", "y", "z"] * 700 + ["x"]):
        row, start, end, p = runs.runs_in(words(pa.array([" ".join(t)])), 4, 2)
        assert list(zip(start.tolist(), (end - start).tolist(), p.tolist(), strict=True)) == brute_runs(t, 4, 2)


def test_suffix_order_and_lcp():
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2, 300)
    row = np.repeat([0, 1, 2], [100, 150, 50])
    stop, begin = np.repeat([100, 250, 300], [100, 150, 50]), np.repeat([0, 100, 250], [100, 150, 50])
    isa = runs.inverse_suffix_array(row * 2 + x, stop)
    sa = np.argsort(isa)
    want = sorted(range(300), key=lambda i: (row[i], x[i : stop[i]].tolist()))
    assert sa.tolist() == want
    same = lambda a, b: row[a] == row[b] and next((k for k in range(300) if max(a + k - stop[a], b + k - stop[b]) >= 0 or x[a + k] != x[b + k]), 0)
    assert runs.lcp_array(x, row, begin, stop, isa, sa).tolist() == [0, *(int(same(a, b)) for a, b in zip(want, want[1:], strict=False))]
    v = rng.integers(0, 9, 200)
    for equal in (True, False):
        first = [next((j for j in range(i + 1, 200) if v[j] < v[i] + equal), 200) for i in range(200)]
        assert runs.next_smaller(v, np.arange(200), equal).tolist() == first


def test_collapsed_handles_odd_rows(spark):
    got = runs.collapsed(odd(spark), least=4, times=2).collect()
    assert len(got) == len(ODD) + 2
    by = {r["doc_id"]: r for r in got}
    for i, t in enumerate(ODD):
        ws = WORD.findall(t or "")
        found = brute_runs(ws, 4, 2)
        assert [tuple(x) for x in by[i]["runs"]] == found and by[i]["n_words"] == len(ws) and by[i]["collapsed"] == brute_collapse(ws, found)
    assert runs.collapsed(documents(spark, []).limit(0)).count() == 0
    assert runs.digests(runs.collapsed(documents(spark, [None, "a " * 30], [None, 1]))).count() == 2


def test_query_of_runs_equals_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    seen = 0
    for r in queries.op11_periodic_runs(spark, sf).collect():
        ws = WORD.findall(docs[r["doc_id"]] or "")
        n, h = len(ws), zlib.crc32(str(r["doc_id"]).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            ws = [ws[i] if i < a else ws[a + (i - a) % p] for i in range(n)]
        if n > 4000:
            continue  # brute force is quadratic
        found = brute_runs(ws, 24, 3)
        seen += len(found)
        best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want = (len(found), *best, None if not found else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in found)), sha(brute_collapse(ws, found)))
        assert (r["n_runs"], r["start"], r["length"], r["period"], r["exponent_milli"], r["runs_sha256"], r["collapsed_sha256"]) == want
    assert seen > 5


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute_tree(hashes):
    """Root, and each leaf's siblings from below."""
    proofs, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for i, k in enumerate(at):
            other = k ^ 1
            proofs[i].append((level[other], other < k) if other < len(level) else None)
        level = [sha(*level[i : i + 2]) for i in range(0, len(level), 2)]
        at = [k // 2 for k in at]
    return level[0], proofs


@pytest.mark.parametrize("sizes", [[1], [2, 1], [3, 64, 65], [130, 1, 1, 1, 7], []])
def test_manifest_equals_brute_force(spark, sizes):
    rows = [(i, None if g == 0 else f"g{g}", sha(f"{g} {i}"), "x", 5) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, lang string, leaf string, group string, lo long") if rows else spark.createDataFrame([], "doc_id long, lang string, leaf string")
    df = df.drop("group", "lo")
    got = {(r["lang"], r["doc_id"]): r for r in manifest.manifest(df, "lang", ["doc_id", "hash"]).collect()}
    groups = {g: sorted(x[0] for x in rows if x[1] == g) for g in {x[1] for x in rows}}
    order = sorted(groups, key=lambda g: (g is not None, g))
    trees = {g: brute_tree([sha(f"{order.index(g)} {i}") for i in groups[g]]) for g in order}
    assert len(got) == len(rows)
    if not rows:
        return
    root, tops = brute_tree([trees[g][0] for g in order])
    for g in order:
        for i, way in zip(groups[g], trees[g][1], strict=True):
            r = got[g, i]
            want = [*way, *tops[order.index(g)]]
            assert (r["subroot"], r["root"]) == (trees[g][0], root)
            assert [e["hash"] and (e["hash"], e["left"]) for e in r["proof"]] == want


def test_manifest_with_nulls_and_repeated_rows(spark):
    rows = [(None, "a", sha("1")), (1, None, sha("2")), (1, None, sha("2")), (1, None, sha("0")), (None, None, sha("3")), (5, "", sha("4"))]
    out = manifest.manifest(spark.createDataFrame(rows, "doc_id long, lang string, leaf string"), "lang", ["doc_id", "hash"])
    got = out.withColumn("ok", manifest.folded(out["leaf"]) == out["root"]).collect()
    none, _ = brute_tree([sha("3"), sha("0"), sha("2"), sha("2")])
    assert len(got) == 6 and all(r["ok"] for r in got) and {r["subroot"] for r in got} == {none, sha("4"), sha("1")}
