"""Queries with SQL against DuckDB; the others against brute force, round trips or held-out accuracy."""

import collections
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from skeinworks.llm import backoff, chat_bytes, columns, decontam, fixity, huffman, line_labels, packing, queries, simhash, token_counts, toxicity
from skeinworks.llm.wordbpe import WordEncoder, default_path

SF = Path("/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \n\t ", "one", "A b C. d! e? f", "Ünïcode wörds, ñ é ß 日本語", "x " * 5000, "line\nline\n\nline", "a b c d e a b c d e", "<|endoftext|> ▁ \\### </turn>"]
DOCS = "doc_id long, text string, lang string, fp string, id string, node long"


def documents(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "clash", "clash", 7) for i, t in zip(ids, texts, strict=True)], DOCS)


def odd(spark):
    """Odd texts, one of them twice with the same id, and a null id; columns whose names clash with the operators' own."""
    return documents(spark, [*ODD, ODD[4], "no id here"], [*range(len(ODD)), 4, None])


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in SF.glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, str(SF))
    want = con.sql(queries.ORACLE[name])
    as_text = lambda rows: sorted(str([f"{v:.6g}" if isinstance(v, float) else v for v in r]) for r in rows)
    assert as_text(df.select(*want.columns).collect()) == as_text(want.fetchall())


def test_words_lines_and_pieces():
    texts = pa.array(ODD)
    w = columns.words(texts)
    assert w.counts.tolist() == [len(WORD.findall(t or "")) for t in ODD]
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.start, w.end, strict=True)] == [x for t in ODD for x in WORD.findall(t or "")]
    cut = list(columns.pieces(iter([pa.RecordBatch.from_arrays([texts], ["text"])]), "text", 20))
    assert [x for b in cut for x in b.column(0).to_pylist()] == ODD


def test_encoder_equals_the_library():
    e = WordEncoder(default_path(), most=50)
    rng = random.Random(3)
    letters = list("aAbzZ.,!'sS \n|<>_-1é×É÷ß̸́x") + ["<|endoftext|>", " ", " "]
    texts = [*ODD, *("".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(2000))]
    ids, counts = e.encode(pa.array(texts))
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i, t in enumerate(texts):
        assert ids[ends[i] : ends[i + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids, t


def test_token_counts_equal_the_library(spark):
    c = token_counts.TokenCounter(token_counts.default_path(), most=40_000)
    rng = random.Random(4)
    letters = list("aAbzt.,!'\n|<>é日x") + ["<s>", " ", " ", "  ", "▁", "\t", "\x00", " the", "́"]
    texts = [*ODD, "   ", "\n", "a ", *("".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(2000))]
    assert c.counts(pa.array(texts)).tolist() == [len(c.model.encode(t or "")) for t in texts]
    got = token_counts.token_counts(odd(spark)).collect()
    assert len(got) == len(ODD) + 2 and {r["doc_id"] for r in got} == {*range(len(ODD)), None}
    assert token_counts.token_counts(documents(spark, []).limit(0)).count() == 0


def test_huffman_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    counts = (rng.pareto(1.0, 5000) * 3).astype(np.int64)
    lengths = huffman.code_lengths(counts, 13)
    assert lengths.max() <= 13 and (0.5 ** lengths[lengths > 0].astype(float)).sum() <= 1
    codes, decoder = huffman.canonical(lengths), huffman.Decoder(lengths)
    ids = rng.choice(5000, p=counts / counts.sum(), size=5000)
    for n in (0, 1, 255, 256, 257, 512, 700, 5000):
        assert (decoder.decode(*huffman.encode_block(ids[:n], codes, lengths), n) == ids[:n]).all()
    df = documents(spark, ODD, [5, 3, 9, 1, None, 7, 2, 8, 4, 6])
    huffman.write_dataset(df, str(tmp_path / "h"), block_bytes=64)
    e = WordEncoder(default_path())
    start = 0
    rows = huffman.read_dataset(spark, str(tmp_path / "h")).orderBy("doc_id").collect()
    for r, (_, t) in zip(rows, sorted(zip([5, 3, 9, 1, -1, 7, 2, 8, 4, 6], ODD, strict=True)), strict=True):
        want = np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()
        assert (r["start"], r["n_tokens"], r["ids_crc32"], bytes(r["ids"])) == (start, len(want) // 4, zlib.crc32(want), want)
        start += len(want) // 4
    huffman.write_dataset(df.limit(0), str(tmp_path / "none"))
    assert huffman.read_dataset(spark, str(tmp_path / "none")).count() == 0


def test_packing_covers_each_id_once(spark):
    rng = np.random.default_rng(1)
    limits = packing.Limits(64, 5, 50)
    sizes = rng.integers(1, 200, 300)
    loss = rng.integers(0, sizes + 1)
    seen = collections.defaultdict(list)
    for have in packing.pack(sizes, loss, limits):
        assert sum(p[2] for p in have) <= 64 and len(have) <= 5
        borne = sum(max(0, min(a + n, int(sizes[i])) - max(a, int(sizes[i] - loss[i]))) for i, a, n in have)
        assert borne <= 50
        for i, a, n in have:
            seen[i].append((a, n))
    for i, s in enumerate(sizes):
        at = 0
        for a, n in sorted(seen[i]):
            assert a == at
            at += n
        assert at == s
    whole = packing.pack(np.array([60, 30, 30, 4]), np.array([1, 1, 1, 1]), limits, cut=False)
    assert sorted(len(h) for h in whole) == [2, 2]
    small = packing.pack(np.full(60, 4), np.full(60, 1), limits)
    assert all(len(h) == 5 for h in small) and len(small) == 12


def test_packed_pieces_equal_the_library(spark):
    texts = [*ODD, "many words " * 3000, *["tiny"] * 70, *(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())]
    df = documents(spark, texts).repartition(2)
    e = WordEncoder(default_path())
    want = [np.array([*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for t in texts]
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.packed_documents(df).collect():
        part = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        n = len(want[r["doc_id"]])
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == n and len(part) == r["length"]
        assert r["loss_tokens"] == sum(k >= n // packing.PROMPT for k in range(r["start"], r["start"] + r["length"]))
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"], r["loss_tokens"]))
    for i, ids in enumerate(want):
        at = 0
        for start, n in sorted(by_doc[i]):
            assert start == at
            at += n
        assert at == len(ids)
    limits = packing.Limits()
    for parts in by_sequence.values():
        at = 0
        for o, n, _ in sorted(parts):
            assert o == at
            at += n
        assert at == 2048 or at & (at - 1) == 0
        assert len(parts) <= limits.segments and sum(p[2] for p in parts) <= limits.loss_tokens
    # Both limits bind: short texts end sequences by number, a long text's end by its loss.
    short = packing.packed_documents(documents(spark, ["tiny"] * 64).coalesce(1)).groupBy("sequence_id").count().collect()
    assert [r["count"] for r in short] == [16] * 4
    assert not any(len(p) == 1 and p[0][1] == 2048 and p[0][2] == 2048 for p in by_sequence.values())
    assert packing.packed_documents(documents(spark, []).limit(0)).count() == 0
    twice = collections.Counter()
    for r in packing.packed_documents(documents(spark, ["a b", "a b", None], [3, 3, None])).collect():
        twice[r["doc_id"]] += r["length"]
    assert twice == {3: 6, None: 1}


def test_toxicity_on_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    net = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, net).join(labels, "doc_id").collect()
    for held in (True, False):
        some = [r for r in rows if r["held_out"] == held]
        pos, neg = ([r["score"] for r in some if r["toxic"] == k] for k in (1, 0))
        auc = np.mean([[a > b for b in neg] for a in pos])
        assert auc > (0.85 if held else 0.99), (held, auc)
    got = toxicity.scored(odd(spark), net).collect()
    assert len(got) == len(ODD) + 2 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert [r["score"] for r in got if r["doc_id"] in (0, 1, 2)] == [0, 0, 0]
    assert toxicity.scored(odd(spark), toxicity.train(docs, labels.limit(0))).where("predicted = 1").count() == 0


def test_every_window_is_scored():
    places, owner = toxicity.windows(np.array([0, 5, 32, 33, 100]))
    assert set(owner) == {1, 2, 3, 4}
    for k, n in ((1, 5), (2, 32), (3, 33), (4, 100)):
        assert {int(x) for x in places[owner == k].ravel()} == set(range(sum([0, 5, 32, 33, 100][:k]), sum([0, 5, 32, 33, 100][:k]) + n))


def test_line_facts_and_viterbi(spark):
    texts = [*ODD, *(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())]
    f = line_labels.facts(pa.array(texts))
    for i, t in enumerate(texts):
        t = t or ""
        ws = WORD.findall(t)
        seen, dup, wins, cover = set(), 0, collections.Counter(tuple(ws[k : k + 5]) for k in range(len(ws) - 4)), set()
        for k in range(len(ws) - 4):
            if wins[tuple(ws[k : k + 5])] > 1:
                cover.update(range(k, k + 5))
        for line in t.split("\n"):
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        want = (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, len(cover))
        assert want == tuple(int(x[i]) for x in (f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words)), t[:60]
    rng = np.random.default_rng(3)
    chain = line_labels.Chain(rng.normal(size=3), rng.normal(size=(2, 2)))
    lines = np.array([0, 1, 4, 7, 2])
    x = rng.normal(size=(lines.sum(), 3))
    got, at = line_labels.viterbi(chain, lines, x), 0
    for n in lines:
        best = max((sum((x[at + i] @ chain.emit) * s for i, s in enumerate(path)) + sum(chain.step[a, b] for a, b in zip(path, path[1:], strict=False)), tuple(-s for s in path), path) for path in np.ndindex(*(2,) * n)) if n else (0, 0, ())
        assert tuple(got[at : at + n]) == tuple(best[2])
        at += n


def test_quality_keeps_clean_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    chain = line_labels.train(docs, labels)
    rows = line_labels.judged(docs, chain).join(labels, "doc_id").collect()
    share = lambda q: np.mean([r["kept"] for r in rows if r["quality"] == q])
    assert share(1) > 0.95 and share(0) < 0.15
    assert {r["doc_id"] for r in line_labels.keep(docs, chain).collect()} == {r["doc_id"] for r in line_labels.judged(docs, chain).where("kept").collect()}
    assert line_labels.judged(odd(spark), chain).count() == len(ODD) + 2


def test_chat_round_trip(spark):
    rng = random.Random(5)
    bits = ["\\", "###", "### ", "</turn>", " </turn>\n", ": ", "assistant", "é", "x", "\n", "#", ""]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randint(0, 9)))
    turns = [(c, t, rng.choice(["user", "assistant", "sys:tem", "\\", "###", None]), rng.choice([text(), text(), None])) for c in range(40) for t in range(rng.randint(1, 6))]
    df = spark.createDataFrame([*turns, (None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = {}
    for r in chat_bytes.format_chats(df, part_bytes=60).orderBy("conv_id", "part").collect():
        raw = r["formatted"].encode()
        have = got.setdefault(r["conv_id"], ([], []))
        have[0].extend((a.decode(), b.decode()) for a, b in chat_bytes.read_turns(raw))
        have[1].extend(chat_bytes.unescape(raw[a:b]).decode() for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True))
    for c in range(40):
        own = [(r or "", t or "") for x, _, r, t in turns if x == c]
        assert got[c] == (own, [t for r, t in own if r == "assistant"])
    assert got[None] == ([("user", "x")], []) and chat_bytes.digests(chat_bytes.format_chats(df.limit(0))).count() == 0


def test_chat_ties_and_clashing_columns(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, "assistant", "x" * 200), (2, None, "assistant", "y" * 200)]
    df = spark.createDataFrame([(*r, 9, "clash") for r in rows], "conv_id long, turn long, role string, text string, part int, formatted string")
    got = {}
    for r in chat_bytes.format_chats(df, part_bytes=120).orderBy("conv_id", "part").collect():
        assert r["part"] == len(got.setdefault(r["conv_id"], []))
        got[r["conv_id"]].append(r["formatted"])
    assert [t for _, t in chat_bytes.read_turns("".join(got[1]).encode())] == [b"a", b"a", b"b"]
    assert len(got[2]) == 2 and len(chat_bytes.read_turns("".join(got[2]).encode())) == 2


def test_session_settings_come_back(spark):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.classic.shuffleDependency.fileCleanup.enabled")}
    backoff.backoff_scores(odd(spark), parts=3).count()
    simhash.simhash_groups(odd(spark)).count()
    assert before == {k: spark.conf.get(k, None) for k in before}


def test_leaks_are_found(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    found = {(r["doc_id"], r["item_id"]): r for r in decontam.leaks(docs, bench).collect()}
    items = {r[0]: decontam.word_hashes(r[1]).tolist() for r in bench.collect()}
    grams = lambda h: {tuple(h[k : k + 3]) for k in range(max(1, len(h) - 2))}
    want = {(d["doc_id"], i) for d in docs.collect() for own in [grams(decontam.word_hashes(d["text"]).tolist())] for i, h in items.items() if len(own & grams(h)) >= 0.8 * len(grams(h))}
    assert want and want <= set(found)
    assert all(r["common"] >= decontam.COMMON for r in found.values())
    assert {r["doc_id"] for r in docs.select("doc_id").collect()} - {r["doc_id"] for r in decontam.unleaked(docs, bench).collect()} == {d for d, _ in found}
    assert decontam.leaks(odd(spark), bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def planted_words(rng):
    return lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_paraphrases_are_found(spark):
    """A fifth of a planted item's words replaced: nine of ten are found; untouched documents aren't."""
    rng = random.Random(19)
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    clean = [r["text"].split() for r in docs.orderBy("doc_id").limit(400).collect() if r["text"] and len(r["text"].split()) > 120]
    pool = [w for ws in clean for w in ws]
    items = [(r["item_id"], r["text"].split()) for r in bench.collect()]
    for share, least in ((0.0, 1.0), (0.2, 0.9), (0.3, 0.75)):
        texts = []
        for _, ws in items:
            host = rng.choice(clean)
            at = rng.randrange(len(host))
            texts.append(" ".join([*host[:at], *(rng.choice(pool) if rng.random() < share else w for w in ws), *host[at:]]))
        both = docs.select("doc_id", "text").union(spark.createDataFrame([(10**9 + k, t) for k, t in enumerate(texts)], "doc_id long, text string"))
        found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(both, bench).collect()}
        assert np.mean([(10**9 + k, i) in found for k, (i, _) in enumerate(items)]) >= least, share


def test_latent_space_is_truncated_and_keeps_the_passages(spark):
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    n, df = decontam.document_frequencies(docs)
    texts = [decontam.plain_words(pa.array([r["text"] or ""], pa.large_string())) for r in docs.collect()]
    exact = np.zeros(decontam.SLOTS, np.int64)
    for _, names, _ in texts:
        exact[np.unique(columns.hash_column(names) % np.uint64(decontam.SLOTS)).astype(np.int64)] += 1
    assert n == docs.count() and (df == exact).all()
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    passages = decontam.Passages([(r[0], r[1]) for r in bench.collect()])
    slots, basis = decontam.latent_space(passages, idf, decontam.sampled(docs, n))
    assert basis.shape[1] == int(np.ceil(decontam.SHARE * len(passages.words))) + decontam.SHARED < len(passages.words) or len(passages.words) < 41
    assert np.allclose(basis.T @ basis, np.eye(basis.shape[1]), atol=1e-3)
    space = decontam.Space(idf, slots, basis, passages, 0.7)
    near = space.query @ space.query.T
    exact = np.stack([np.bincount(np.searchsorted(slots, np.unique(w % np.uint64(decontam.SLOTS)).astype(np.int64)), minlength=len(slots)) * idf[slots] for w in passages.words])
    exact /= np.linalg.norm(exact, axis=1, keepdims=True)
    assert np.abs(near - exact @ exact.T).max() > 1e-3 and (near.argmax(1) == np.arange(len(near))).all()


def test_copies_of_a_large_benchmark_are_found(spark):
    rng = random.Random(17)
    word = planted_words(rng)
    vocabulary = word(4000)
    items = [rng.choices(vocabulary, k=36) for _ in range(1200)]
    texts = [" ".join(w for item in items[k : k + 8] for w in [*word(70), *item]) for k in range(0, len(items), 8)]
    bench = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontam.leaks(documents(spark, texts), bench).collect()}
    assert found >= {(i // 8, i) for i in range(len(items))}


def test_copies_of_a_common_item_are_found(spark):
    rng = random.Random(18)
    word = planted_words(rng)
    item = word(36)
    texts = [" ".join([*word(64 + k % 16), *(item if k % 3 == 0 else []), *word(80)]) for k in range(300)]
    bench = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(word(36)))], "item_id long, text string")
    rows = decontam.leaks(documents(spark, texts), bench).collect()
    assert sorted((r["doc_id"], r["item_id"]) for r in rows) == [(k, 1) for k in range(0, 300, 3)]


def test_longest_common_subsequence():
    rng = np.random.default_rng(6)
    for _ in range(50):
        a, b = (rng.integers(0, 5, rng.integers(0, 12)).astype(np.uint64) for _ in "ab")
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1, j + 1] = table[i, j] + 1 if a[i] == b[j] else max(table[i, j + 1], table[i + 1, j])
        assert decontam.common_length(a, b) == table[-1, -1]


def roots(n, pairs):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


@pytest.mark.parametrize("tau, block", [(4, 4096), (4, 16), (9, 4096)])
def test_links_lose_nothing(spark, tau, block):
    rng = np.random.default_rng(tau)
    base = rng.integers(0, 1 << 63, 60).astype(np.uint64)
    more = np.repeat(base[:12], 25)
    for _ in range(4):
        more = more ^ (np.uint64(1) << rng.integers(0, 64, len(more)).astype(np.uint64))
    fp = np.unique(np.concatenate([base, more, [np.uint64(0)]]))
    df = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    edges = simhash.links(df, simhash.planned(df, tau), tau, block)
    found = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    want = roots(len(fp), [(i, i + 1 + int(j)) for i in range(len(fp)) for j in np.flatnonzero(np.bitwise_count(fp[i] ^ fp[i + 1 :]) <= tau)])
    groups = lambda key: sorted(sorted(g) for g in _grouped(fp.view(np.int64).tolist(), key))
    assert groups(dict(zip(fp.view(np.int64).tolist(), want, strict=True))) == groups({int(x): found.get(int(x), int(x)) for x in fp.view(np.int64)})


def _grouped(values, key):
    out = collections.defaultdict(list)
    for v in values:
        out[key[v]].append(v)
    return out.values()


def test_simhash_against_brute_force(spark):
    from xxhash import xxh64_intdigest

    texts = [*ODD, *(r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect())]
    ids = list(range(100, 100 + len(texts)))
    got = {r["doc_id"]: r for r in simhash.simhash_groups(documents(spark, texts, ids)).collect()}
    fps = []
    for t in texts:
        ws = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        h = [xxh64_intdigest(" ".join(ws[i : i + 4]).encode(), 42) for i in range(max(1, len(ws) - 3))] if ws else []
        fps.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    top = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4])
    for i, f in zip(ids, range(len(fps)), strict=True):
        assert got[i]["fingerprint"] == f"{fps[f]:016x}" and got[i]["component_id"] == ids[top[f]]
    assert simhash.simhash_groups(odd(spark)).count() == len(ODD) + 2
    assert simhash.simhash_groups(documents(spark, []).limit(0)).count() == 0


def test_near_duplicates_of_planted_copies(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(300)) for _ in range(60)]
    for i in range(20):
        ws = texts[i].split()
        for _ in range(4):
            ws[rng.randrange(300)] = "changed"
        texts += [" ".join(ws), texts[i].upper() + "\n"]
    left = {r["doc_id"] for r in simhash.deduplicated(documents(spark, texts)).collect()}
    assert left == set(range(60))
    twice = simhash.deduplicated(documents(spark, ["same words here", "same words here", None, ""], [1, 1, 2, None])).collect()
    assert sorted(str(r["doc_id"]) for r in twice) == ["1", "2"]


def test_near_duplicates_behind_another_head(spark):
    rng = random.Random(3)
    ws = [f"w{k}" for k in range(300)]
    changed = [*ws[:150], "changed", *ws[151:]]
    other = rng.sample(ws, 300)  # the same distinct words, hence the same fingerprint, but other shingles
    left = {r["doc_id"] for r in simhash.deduplicated(documents(spark, [" ".join(x) for x in (other, ws, changed)])).collect()}
    assert left == {0, 1}


def test_near_duplicates_of_odd_rows(spark):
    texts = ["a b c d e f g h", "A b c\nd e f g h", None, "", "x y", "a b c d e f g h"]
    clash = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in zip([None, None, 5, 6, 7, 7], texts, strict=True)], "doc_id long, text string, same int, key int, twin int")
    left = simhash.deduplicated(clash)
    assert left.columns == clash.columns
    # Of the three texts with the same words the one with an id stays; null and empty texts are one group.
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(5, None), (7, "a b c d e f g h"), (7, "x y")]
    nameless = documents(spark, ["q r s t u v", "q R s t u v", "other"], [None, None, None])
    assert sorted(r["text"].lower() for r in simhash.deduplicated(nameless).collect()) == ["other", "q r s t u v"]
    assert simhash.deduplicated(documents(spark, []).limit(0)).count() == 0


def test_sketches_bound_what_sets_share():
    rng = np.random.default_rng(9)
    for n in (0, 1, 40, 300, 5000):
        for share in (0.0, 0.5, 0.9, 1.0):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            b = np.unique(np.concatenate([a[: int(share * n)], rng.integers(0, 1 << 63, int((1.3 - share) * n)).astype(np.uint64)]))
            common = len(np.intersect1d(a, b))
            assert common <= simhash.most_common(simhash.sketch(a), simhash.sketch(b))
    far = [np.unique(rng.integers(0, 1 << 63, 800).astype(np.uint64)) for _ in "ab"]
    assert simhash.most_common(*map(simhash.sketch, far)) < 0.7 * 800
    many = np.arange(0, 64 * 400, 64).astype(np.uint64) << np.uint64(16)
    assert simhash.most_common(simhash.sketch(many), simhash.sketch(many)) >= 400


def far_copies():
    """Texts with copies: foreign words appended, a block replaced, or a chain of copies of copies; some are too far."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for k in range(60):
        ws = [word() for _ in range(rng.randrange(50, 400))]
        n = len(ws) * (22 if k % 4 else 30) // 100
        block = len(ws) * (9 if k % 5 else 15) // 100
        at = rng.randrange(len(ws) - block)
        texts += [ws, ws + [word() for _ in range(n)], ws[:at] + [word() for _ in range(block)] + ws[at + block :]]
    line = [word() for _ in range(60)]
    texts += [line + [word() for _ in range(rng.randrange(2, 30))] for _ in range(60)]
    return [" ".join(t) for t in texts]


def test_near_duplicates_are_those_of_brute_force(spark):
    texts = far_copies()
    sets = [{tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} for ws in map(str.split, texts)]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 100
    groups, _ = simhash.near_duplicates(documents(spark, texts))
    got = {r["id"]: r["group_id"] for r in groups.collect()}
    assert [got[i] for i in range(len(texts))] == roots(len(texts), pairs)


def test_backoff_of_odd_rows(spark):
    rows = backoff.backoff_scores(odd(spark), parts=3).collect()
    assert len(rows) == len(ODD) + 2
    assert all(r["log_score"] == 0 for r in rows if r["doc_id"] in (0, 1, 2))
    assert backoff.backoff_scores(documents(spark, []).limit(0)).count() == 0


def test_fixity_finds_planted_faults(spark, tmp_path):
    pages = [(i, f"http://x/{i}", f"<p>{i}é</p>") for i in range(300)] + [(7, "http://x/7", "again"), (None, None, None), (9000, "u", "")]
    schema = "page_id long, url string, html string"
    theirs = [(i, u, "changed" if i == 17 else h) for i, u, h in pages if i != 250] + [(-5, "new", "extra")]
    ours = fixity.warc_records(spark.createDataFrame(pages, schema))
    rows = fixity.report(ours, fixity.warc_records(spark.createDataFrame(theirs, schema))).collect()
    assert {(r["key"], r["status"]) for r in rows if r["status"] != "ok"} == {(17, "corrupt"), (250, "missing"), (-5, "extra")}
    assert len(rows) == len(pages) + 1
    in_order = sorted((r for r in rows if r["hash"]), key=lambda r: (r["archive"], r["key"], r["hash"]))
    at, archive = 0, None
    for r in in_order:
        at = at if r["archive"] == archive else 0
        archive = r["archive"]
        assert r["offset"] == at
        at += r["copies"] * (r["bytes"] + 4)
    fixity.write_warc(ours, str(tmp_path / "warc"))
    raw = b"".join(p.read_bytes() for p in sorted((tmp_path / "warc").glob("part-*")))
    assert raw.count(b"WARC/1.1\r\n") == len(pages) and raw.endswith(b"\r\n\r\n")
    back = fixity.read_warc(spark, str(tmp_path / "warc")).select("key", "record")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, ours.collect()))
    assert {r["status"] for r in fixity.report(ours, back).collect()} == {"ok"}


def test_fixity_of_repeated_ids_and_empty_tables(spark):
    schema = "page_id long, url string, html string, archive string, side int"
    pages = lambda *bodies: fixity.warc_records(spark.createDataFrame([(5, "u", b, "clash", 1) for b in bodies], schema))
    (row, ok) = sorted(fixity.report(pages("a", "a", "a", "a", "z"), pages("z", "a", "a", "new", "a")).collect(), key=lambda r: r["status"])
    assert (row["status"], row["copies"], row["matched"], row["hash_b"] is not None) == ("corrupt", 4, 3, True)
    assert (ok["status"], ok["copies"], ok["matched"], ok["hash_b"]) == ("ok", 1, 1, None)
    assert {r["status"] for r in fixity.report(pages("b", "a"), pages("a", "b")).collect()} == {"ok"}
    assert [(r["status"], r["copies"], r["matched"]) for r in fixity.report(pages("a", "a"), pages("a")).collect()] == [("missing", 2, 1)]
    none = pages("a").limit(0)
    assert [r["status"] for r in fixity.report(pages("a"), none).collect()] == ["missing"]
    assert [r["status"] for r in fixity.report(none, pages("a")).collect()] == ["extra"]
    assert fixity.report(none, none).count() == 0


def test_fixity_reads_mismatching_branches_only(spark):
    """Hashes cover the ordered ranges: a longer record changes its own branch and no sibling's."""
    pages = [(i, "u", "x" * (i % 7)) for i in range(4096 * 2)]
    make = lambda rows: fixity.stash(fixity.tree(fixity.leaves(fixity.warc_records(spark.createDataFrame(rows, "page_id long, url string, html string")))), "nodes")
    ours = make(pages)
    bad, levels = fixity.audit(ours, make([(i, u, h + "longer" if i == 300 else h) for i, u, h in pages]))
    assert [[tuple(r) for r in x.collect()] for x in levels] == [[(0, 0)], [(0, 300 >> 8)], [(0, 300 >> 4)], [(0, 300)]]
    assert [tuple(r) for r in bad.collect()] == [(0, 300)]
    assert ours.where("level = 3").count() == 2 and ours.where("level = 2").count() == 32
    bad, levels = fixity.audit(ours, make(pages))
    assert bad.count() == 0 and len(levels) == 1


def test_fixity_reads_damaged_files(spark, tmp_path):
    import gzip

    pages = [(i, f"http://x/{i}", f"<p>{i} WARC/1.1 \r\n\r\n {'é' * (i % 5)}</p>") for i in range(12)]
    ours = fixity.warc_records(spark.createDataFrame(pages, "page_id long, url string, html string"))
    raw = {r["key"]: bytes(r["record"]) for r in ours.collect()}
    bad = dict(raw)
    bad[2] = raw[2][:-1] + b"\xff"  # no UTF-8
    bad[4] = raw[4].replace(b"Content-Length: ", b"Content-Length: x")
    bad[6] = raw[6].replace(b"Content-Length: ", b"Content-Length: 9")
    bad[8] = raw[8].replace(b"WARC-Record-ID", b"WARC-Record+ID")
    bad[11] = raw[11][:-3]
    want = {2: "corrupt", 4: "missing", 6: "corrupt", 8: "missing", 11: "corrupt"}
    (tmp_path / "plain").mkdir()
    (tmp_path / "plain" / "a.warc").write_bytes(b"\r\n\r\n".join(bad[k] for k in range(12)))
    read = fixity.read_warc(spark, str(tmp_path / "plain"))
    assert {r["key"]: r["status"] for r in fixity.report(ours, read.where("key IS NOT NULL")).collect() if r["status"] != "ok"} == want
    lost = read.where("key IS NULL").orderBy("at").collect()
    assert [bytes(r["record"]) for r in lost] == [bad[4], bad[8]]
    (tmp_path / "packed").mkdir()
    members = [bytearray(gzip.compress(raw[k] + b"\r\n\r\n")) for k in range(12)]
    members[3][len(members[3]) // 2] ^= 255
    members[5][:4] = b"oops"
    members[11] = members[11][:9]
    (tmp_path / "packed" / "a.warc.gz").write_bytes(b"".join(members))
    read = fixity.read_warc(spark, str(tmp_path / "packed"))
    got = {r["key"]: r["status"] for r in fixity.report(ours, read.where("key IS NOT NULL")).collect() if r["status"] != "ok"}
    assert set(got) == {3, 5, 11} and read.where("key IS NULL").count() >= 2
    fixity.write_warc(ours, str(tmp_path / "gz"), "gzip")
    assert {r["status"] for r in fixity.report(ours, fixity.read_warc(spark, str(tmp_path / "gz"))).collect()} == {"ok"}
    (tmp_path / "odd").mkdir()
    for k, data in enumerate([b"", b"nothing here", b"\r\n\r\n", b"WARC/1.1\r\n\r\n", raw[1] + b"\r\n\r\n"]):
        (tmp_path / "odd" / f"{k}.warc").write_bytes(data)
    assert [r["key"] for r in fixity.read_warc(spark, str(tmp_path / "odd")).collect() if r["key"] is not None] == [1]


def test_latent_space_is_fitted_on_all_documents(spark, monkeypatch):
    """No sample is taken, and the space's directions are those of the whole: the same from one task or many, and of a plain computation."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    monkeypatch.setattr(decontam, "sampled", None)
    assert decontam.leaks(docs, bench).count() > 0
    n, df = decontam.document_frequencies(docs)
    idf = np.log((n + 1) / (df + 1)).astype(np.float32) + np.float32(0.05)
    passages = decontam.Passages([(r[0], r[1]) for r in bench.collect()]).part(0, 60)
    slots, basis = decontam.latent_space(passages, idf, docs.select("text").repartition(3))
    own = {s: k for k, s in enumerate(slots.tolist())}

    def rows(words):
        out = np.zeros((len(words), len(own)))
        for row, w in zip(out, words, strict=True):
            for s in set((w % np.uint64(decontam.SLOTS)).tolist()) & set(own):
                row[own[s]] = idf[s]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)

    mine, theirs = rows(passages.words), rows([decontam.word_hashes(r["text"]) for r in docs.collect()])
    project = np.linalg.pinv(mine) @ mine
    theirs = theirs @ project
    whole = mine.T @ mine + (mine**2).sum() / (decontam.WEIGHT * (theirs**2).sum()) * theirs.T @ theirs
    best = np.sort(np.linalg.eigvalsh(whole))[::-1][: basis.shape[1]]
    assert np.isclose(np.trace(basis.T @ whole @ basis), best.sum(), rtol=1e-3)


def test_stage_without_leaks_takes_no_sample(spark, monkeypatch):
    """The pipeline's stage keeps what the search over the whole finds nothing in."""
    docs, bench = (spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet") for t in ("documents", "benchmark"))
    monkeypatch.setattr(decontam, "sampled", None)
    bad = {r["doc_id"] for r in decontam.leaks(docs, bench).collect()}
    assert bad and {r["doc_id"] for r in decontam.unleaked(docs, bench).collect()} == {r["doc_id"] for r in docs.collect()} - bad
