"""The queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.stash import delete, scratch, shared_dir, stash
from . import backoff, chat_bytes, decontam, fixity, huffman, line_labels, manifest, packing, runs, simhash, substrings, token_counts, toxicity
from .rows import small_batches

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages against a replica in gzipped WARC files with planted faults: changed letters, bytes that are no UTF-8, heads that can't be read, lost and added records, and copies of an id of which one changed."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    copied = F.pmod("page_id", F.lit(53)) == 2
    twice = pages.where(copied)
    ours = fixity.warc_records(pages.union(twice).union(twice))
    mark = lambda rows, hit: rows.withColumn("html", F.when(hit, F.concat(F.lit("#"), F.substring("html", 2, 1 << 30))).otherwise(F.col("html")))
    changed = mark(pages.where(F.pmod("page_id", F.lit(101)) != 7), F.pmod("page_id", F.lit(97)) == 5)
    added = pages.where(F.pmod("page_id", F.lit(211)) == 3).withColumn("page_id", F.col("page_id") + (1 << 40))
    theirs = fixity.warc_records(changed.union(added).union(twice).union(mark(twice, F.pmod("page_id", F.lit(3)) == 1)))
    length = F.lit(b"Content-Length: ")
    head = F.expr("locate('Content-Length: ', record)").cast("int")
    plain = F.octet_length("record")
    broken = F.concat(F.substring("record", 1, head - 1), F.lit(b"Content-Length: ?"), F.substring("record", head + F.octet_length(length), plain))
    ended = F.concat(F.substring("record", 1, plain - 1), F.lit(b"\xff"))
    record = F.when(F.pmod("key", F.lit(113)) == 9, broken).when((F.pmod("key", F.lit(89)) == 4) & (plain > 0), ended).otherwise(F.col("record"))
    with scratch() as keep:
        folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
        fixity.write_warc(theirs.withColumn("record", record), folder, "gzip")
        read = fixity.read_warc(spark, folder)
        report = fixity.report(ours, read.where("key IS NOT NULL"))
        delete(spark, folder)
        return keep(report).withColumnRenamed("key", "page_id")


def op2_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return toxicity.scored(documents, toxicity.train(documents, table(spark, sf_dir, "labels")))


def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"))


def op4_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backoff.backoff_scores(table(spark, sf_dir, "documents")).withColumn("log_score", F.round("log_score", 4))


def op5_line_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    chain = line_labels.train(documents, table(spark, sf_dir, "labels"))
    return line_labels.judged(documents, chain)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 4096)


def op7_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/huffman-{uuid.uuid4().hex}"
    huffman.write_dataset(table(spark, sf_dir, "documents"), folder)
    return huffman.read_dataset(spark, folder).drop("ids")


def op8_chat_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(extra)
    return chat_bytes.digests(chat_bytes.format_chats(chats))


def op9_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_groups(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digests(runs.collapsed(runs.cycled(table(spark, sf_dir, "documents").select("doc_id", "text"))))


def op12_interval_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's proof, folded again from its leaf, or from one with a changed length where 7 divides the id's crc32."""
    docs = table(spark, sf_dir, "documents")
    names = ["doc_id", "source", "lang", "n_chars", "text"]
    changed = manifest.row_hash([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in names])
    hit = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    leaves = docs.select("doc_id", "lang", manifest.row_hash([F.col(c) for c in names]).alias("leaf"), F.when(hit, changed).alias("tampered"))
    with scratch() as keep:
        proved = manifest.manifest(stash(leaves, "leaves"), "lang", ["doc_id", "hash"])
        back = proved.withColumn("folded_root", manifest.folded(F.coalesce("tampered", "leaf")))
        out = back.select("doc_id", "leaf", "subroot", "root", manifest.proof_hash().alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
        return keep(stash(out, "manifest"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch() as keep:
        kept = substrings.deduplicated(table(spark, sf_dir, "documents"))
        removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, r: n + r["length"]).alias("n_removed")
        return keep(stash(kept.select("doc_id", "n_words", removed, F.sha2("kept", 256).alias("kept_sha256")), "digests"))


QUERIES: dict[str, Query] = {q.__name__: q for q in (op1_merkle_fixity, op2_recurrent_toxicity, op3_vector_packing, op4_stupid_backoff, op5_line_crf, op6_token_counts, op7_huffman_ids, op8_chat_bytes, op9_latent_decontamination, op10_simhash_groups, op11_periodic_runs, op12_interval_manifest, op13_substring_dedup)}
ORACLE: dict[str, str] = {
    "op1_merkle_fixity": r"""
WITH p AS (SELECT page_id, url, html, '#' || substring(html, 2) AS other FROM pages),
rec AS (SELECT 'a' AS side, page_id, url, html FROM p UNION ALL SELECT 'a', page_id, url, html FROM p, range(2) WHERE page_id % 53 = 2
        UNION ALL SELECT 'b', page_id, url, CASE WHEN page_id % 97 = 5 THEN other ELSE html END FROM p WHERE page_id % 101 <> 7
        UNION ALL SELECT 'b', page_id + (1::BIGINT << 40), url, html FROM p WHERE page_id % 211 = 3
        UNION ALL SELECT 'b', page_id, url, html FROM p WHERE page_id % 53 = 2
        UNION ALL SELECT 'b', page_id, url, CASE WHEN page_id % 3 = 1 THEN other ELSE html END FROM p WHERE page_id % 53 = 2),
text AS (SELECT side, page_id, 'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || url || chr(13) || chr(10) || 'Content-Type: text/html; charset=utf-8' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(html) || chr(13) || chr(10) || chr(13) || chr(10) || html AS r FROM rec),
w AS (SELECT side, page_id, CASE WHEN side = 'b' AND page_id % 89 = 4 THEN encode(r[:-2]) || unhex('FF') ELSE encode(r) END AS r FROM text WHERE NOT (side = 'b' AND page_id % 113 = 9)),
h AS (SELECT page_id, page_id >> 12 AS archive, sha256(r) AS hash, CAST(octet_length(r) AS BIGINT) AS bytes, count(*) FILTER (side = 'a') AS a, count(*) FILTER (side = 'b') AS b FROM w GROUP BY ALL),
o AS (SELECT *, CAST(coalesce(sum(a * (bytes + 4)) OVER (PARTITION BY archive ORDER BY page_id, hash ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset",
             row_number() OVER (PARTITION BY page_id, sign(a - b) ORDER BY hash) AS nth FROM h)
SELECT coalesce(x.archive, y.archive) AS archive, coalesce(x.page_id, y.page_id) AS page_id, x."offset", x.bytes, x.hash, x.a AS copies, least(x.a, x.b) AS matched,
       CASE WHEN x.hash IS NULL THEN 'extra' WHEN x.a = x.b THEN 'ok' WHEN y.hash IS NULL THEN 'missing'
            WHEN x.a > x.b THEN 'corrupt' ELSE 'ok' END AS status, y.hash AS hash_b
FROM (SELECT * FROM o WHERE a > 0) x
FULL OUTER JOIN (SELECT * FROM o WHERE b > a) y ON x.page_id = y.page_id AND x.nth = y.nth AND x.a > x.b
WHERE x.hash IS NOT NULL OR y.a = 0""",
    "op4_stupid_backoff": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
t AS (SELECT k, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i, ws FROM d),
p AS (SELECT k, w, CASE WHEN i > 1 THEN ws[i - 1] END AS v FROM t),
n AS (SELECT count(*) AS n FROM p),
c1 AS (SELECT w, count(*) AS c FROM p GROUP BY w),
c2 AS (SELECT v, w, count(*) AS c FROM p WHERE v IS NOT NULL GROUP BY v, w),
cv AS (SELECT v, sum(c) AS c FROM c2 GROUP BY v),
s AS (SELECT p.k, CASE WHEN c2.c >= 2 THEN ln(c2.c) - ln(cv.c) ELSE ln(0.4) + ln(c1.c) - ln(n.n) END AS s,
             CASE WHEN c2.c >= 2 THEN 0 ELSE 1 END AS b
      FROM p CROSS JOIN n JOIN c1 USING (w) LEFT JOIN c2 ON c2.v = p.v AND c2.w = p.w LEFT JOIN cv ON cv.v = p.v)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(coalesce(sum(s.b), 0) AS BIGINT) AS backed_off,
       round(coalesce(sum(s.s), 0), 4) AS log_score
FROM d LEFT JOIN s USING (k) GROUP BY d.k, d.doc_id, d.ws""",
    "op8_chat_bytes": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f AS (SELECT *, length(replace(replace(replace(replace(role, '\', '\\'), '###', '\###'), '</turn>', '\</turn>'), ':', '\:'))
             + length(replace(replace(replace(text, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')) + 15 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(n) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id""",
    "op12_interval_manifest": r"""
WITH RECURSIVE f AS (SELECT *, CASE WHEN doc_id IS NULL THEN '-' ELSE strlen(doc_id::VARCHAR) || ':' || doc_id END || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END
          || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END AS a, CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END AS z FROM documents),
leaf AS (SELECT doc_id, lang, sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen(n_chars::VARCHAR) || ':' || n_chars END || z) AS leaf,
                sha256(a || CASE WHEN n_chars IS NULL THEN '-' ELSE strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1) END || z) AS changed,
                list_reduce([4294967295::UBIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT),
                            lambda r, c: list_reduce([xor(r, c)] || list_transform(range(8), lambda i: i::UBIGINT), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::UBIGINT) ELSE x // 2 END)) AS c FROM f),
p AS (SELECT *, xor(c, 4294967295::UBIGINT) % 7 = 0 AS hit, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaf),
up AS (SELECT lang, 0 AS level, list(leaf ORDER BY i) AS h FROM p GROUP BY lang
       UNION ALL SELECT lang, level + 1, list_transform(range(0, (len(h) + 1) // 2), lambda j: sha256(h[2 * j + 1] || coalesce(h[2 * j + 2], ''))) FROM up WHERE len(h) > 1),
sub AS (SELECT lang, h[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM up WHERE len(h) = 1),
over AS (SELECT 0 AS level, list(subroot ORDER BY i) AS h FROM sub
         UNION ALL SELECT level + 1, list_transform(range(0, (len(h) + 1) // 2), lambda j: sha256(h[2 * j + 1] || coalesce(h[2 * j + 2], ''))) FROM over WHERE len(h) > 1),
way AS (SELECT p.doc_id, p.leaf, list({'k': up.level, 's': coalesce(CASE WHEN (p.i >> up.level) % 2 = 0 THEN 'R' || up.h[(p.i >> up.level) + 2] ELSE 'L' || up.h[p.i >> up.level] END, 'N')}) FILTER (len(up.h) > 1) AS x
        FROM p JOIN up ON up.lang IS NOT DISTINCT FROM p.lang GROUP BY p.doc_id, p.leaf),
top AS (SELECT sub.lang, list({'k': over.level, 's': coalesce(CASE WHEN (sub.i >> over.level) % 2 = 0 THEN 'R' || over.h[(sub.i >> over.level) + 2] ELSE 'L' || over.h[sub.i >> over.level] END, 'N')}) FILTER (len(over.h) > 1) AS x
        FROM sub, over GROUP BY sub.lang),
r AS (SELECT h[1] AS root FROM over WHERE len(h) = 1),
s AS (SELECT p.doc_id, p.leaf, sub.subroot, r.root, CASE WHEN p.hit THEN p.changed ELSE p.leaf END AS begin,
             list_concat(list_transform(list_sort(coalesce(way.x, [])), lambda e: e.s), list_transform(list_sort(coalesce(top.x, [])), lambda e: e.s)) AS x
      FROM p JOIN way ON way.leaf = p.leaf AND way.doc_id IS NOT DISTINCT FROM p.doc_id JOIN sub ON sub.lang IS NOT DISTINCT FROM p.lang JOIN top ON top.lang IS NOT DISTINCT FROM p.lang, r),
o AS (SELECT *, list_reduce(list_concat([begin], x), lambda acc, e: sha256(CASE e[1] WHEN 'L' THEN e[2:] || acc WHEN 'R' THEN acc || e[2:] ELSE acc END)) AS folded_root FROM s)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(array_to_string(list_transform(list_filter(x, lambda e: e <> 'N'), lambda e: e[2:]), ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM o""",
    "op13_substring_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
w AS (SELECT k, doc_id, i, array_to_string(ws[i + 1:i + 13], ' ') AS g FROM (SELECT *, unnest(range(0, len(ws) - 12)) AS i FROM d)),
m AS (SELECT g, min(coalesce(doc_id, 9223372036854775807)) AS low FROM w GROUP BY g),
gone AS (SELECT DISTINCT k, i + unnest(range(13)) AS j FROM w JOIN m USING (g) WHERE coalesce(w.doc_id, 9223372036854775807) > m.low),
lost AS (SELECT k, list(j) AS js FROM gone GROUP BY k),
word AS (SELECT k, unnest(ws) AS w, unnest(range(len(ws))) AS j FROM d),
text AS (SELECT k, string_agg(w, ' ' ORDER BY j) AS kept FROM word ANTI JOIN gone USING (k, j) GROUP BY k)
SELECT d.doc_id, CAST(len(d.ws) AS BIGINT) AS n_words, CAST(len(coalesce(lost.js, [])) AS BIGINT) AS n_removed, sha256(coalesce(text.kept, '')) AS kept_sha256
FROM d LEFT JOIN lost USING (k) LEFT JOIN text USING (k)""",
}
