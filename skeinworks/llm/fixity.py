"""Merkle fixity audit of WARC archives.

An archive holds the response records of up to 4,096 consecutive page ids, in order; a record's
offset is the length of those before it. Records are the leaves of a tree; a node covers the ordered
range of up to 16 children, and its hash is over each child's id, its range of bytes (from the node's
begin) and its hash. Nodes are fixed by ids and ranges count from the node, so a lost record changes its
own branch and none behind it. Each replica builds its tree by itself. An audit joins the archives' roots of two, and then, level by level, the
children of mismatching nodes alone; below, the records of those ids are compared as a multiset.

Trees and audit are DataFrame operations. Archives are read as bytes, since what is audited may be damaged: what can't be
parsed is reported as a damaged range, and reading goes on at the next record or gzip member.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.stash import scratch, stash

#: Ids of a branch are 16 times those of its children; three levels make an archive.
FAN_BITS, LEVELS = 4, 3
ARCHIVE_BITS = FAN_BITS * LEVELS
#: Line ends behind a record.
GAP = 4


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``key, record``: each page as a WARC response record without the two line ends behind it.

    Null urls and bodies are empty. Rows with a null id have the key -1 - hash, so that they are
    audited as well; repeated ids are kept as records of their own. Other columns are not read. ``record`` is binary.
    """
    body = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit(""))
    url = F.coalesce(F.col(f"`{url_col}`").cast("string"), F.lit(""))
    key = F.coalesce(F.col(f"`{id_col}`").cast("long"), -1 - F.abs(F.xxhash64(url, body) % (1 << 40)))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), key.cast("string"), F.lit(">\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return pages.select(key.alias("key"), F.concat(head, body).cast("binary").alias("record"))


def write_warc(records: DataFrame, folder: str, compression: str = "none") -> None:
    """WARC files of at most 4,096 records, in order (``gzip``: a member each); Spark's text writer ends each with two line ends."""
    ordered = records.repartitionByRange("key").sortWithinPartitions("key").select(F.col("record").cast("string"))
    ordered.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", 1 << ARCHIVE_BITS).option("compression", compression).text(folder)


def gzip_members(raw: bytes) -> Iterator[tuple[int, int, bytes, bool]]:
    """Begin, end, content and soundness of a file's gzip members; a damaged one has what could be unpacked, and ends at the next that begins."""
    magic, at = b"\x1f\x8b\x08", 0
    while at < len(raw):
        unpack, out, k = zlib.decompressobj(31), bytearray(), at
        try:
            while k < len(raw) and not unpack.eof:
                out += unpack.decompress(raw[k : k + (1 << 16)])
                k = min(len(raw), k + (1 << 16))
        except zlib.error:
            pass
        if unpack.eof:
            yield at, (end := k - len(unpack.unused_data)), bytes(out), True
        else:
            found = raw.find(magic, at + 1)
            yield at, (end := found if found >= 0 else len(raw)), bytes(out), False
        at = end


def parsed_head(data: bytes, at: int) -> tuple[int, int, int] | None:
    """A record's key, and where its body begins and ends; None if its head can't be read."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0 or not data.startswith(b"WARC/1.", at):
        return None
    head = dict(line.split(b": ", 1) for line in data[at:end].split(b"\r\n")[1:] if b": " in line)
    size, name = head.get(b"Content-Length", b"").strip(), head.get(b"WARC-Record-ID", b"").rpartition(b":")[2].rstrip(b">")
    if not size.isdigit() or not name.removeprefix(b"-").isdigit() or len(name) > 19 or len(size) > 18:
        return None
    return int(name), end + 4, end + 4 + int(size)


def records_in(data: bytes) -> Iterator[tuple[int | None, int, int]]:
    """Key, begin and end of the records; a range without a key can't be read as one.

    A record whose length doesn't lead to two line ends and the next record, or to the end, goes as far as the next record.
    """
    at = 0
    while at < len(data):
        found = parsed_head(data, at)
        to = found[2] if found else len(data) + 1
        sound = to == len(data) or data[to : to + GAP] == b"\r\n\r\n" and (to + GAP == len(data) or data.startswith(b"WARC/1.", to + GAP))
        if not sound:
            after = data.find(b"\r\n\r\nWARC/1.", found[1] if found else at)
            to = after if after >= 0 else len(data) - GAP * data.endswith(b"\r\n\r\n")
        yield found[0] if found else None, at, max(to, at)
        at = max(to, at) + GAP


READ = "path string, at long, key long, record binary"


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``path, at, key, record`` of the WARC files of a folder, plain or ``.gz``. ``record`` is bytes without the two line ends behind.

    ``at`` is the record's place in the file, or in what is unpacked of its gzip member plus the member's place. A null ``key`` stands for a damaged range: a head
    that can't be read, or a gzip member that breaks off without one (``record`` is what is there). A record whose body is cut short has what is left.
    A task takes a file at a time; :func:`write_warc` bounds them.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                packed = raw[:2] == b"\x1f\x8b" or path.endswith(".gz")
                for begin, _, data, sound in gzip_members(raw) if packed else [(0, len(raw), raw, True)]:
                    found = list(records_in(data)) or ([] if sound else [(None, 0, 0)])
                    columns = [[path] * len(found), [begin + a for _, a, _ in found], [k for k, _, _ in found], [data[a:b] for _, a, b in found]]
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["path", "at", "key", "record"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*[!_]*").load(folder).select("path", "content")
    return files.mapInArrow(parse, READ)


def leaves(records: DataFrame) -> DataFrame:
    """``archive, key, hash, bytes, copies``: the different records of each id and how often each is there."""
    hashed = records.select(F.shiftright("key", ARCHIVE_BITS).alias("archive"), "key", F.octet_length("record").cast("long").alias("bytes"), F.sha2("record", 256).alias("hash"))
    return hashed.groupBy("archive", "key", "hash", "bytes").agg(F.count("*").alias("copies"))


def keys(leaf: DataFrame) -> DataFrame:
    """The lowest nodes: each id's length in bytes and the hash of its records in order, by hash.

    One record's hash is the node's. Of several, those whose hashes begin with the same byte are hashed first, and those hashes then, in order.
    """
    size = F.sum(F.col("copies") * (F.col("bytes") + GAP)).alias("bytes")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hash", "copies"))), lambda r: F.concat_ws(" ", r["hash"], r["copies"])), "\n")
    spans = leaf.groupBy("archive", "key", F.substring("hash", 1, 2).alias("span")).agg(size, F.sum("copies").alias("records"), F.min("hash").alias("one"), F.sha2(listed, 256).alias("hash"))
    many = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", "hash"))), lambda r: r["hash"]), "\n"), 256)
    own = F.when(F.sum("records") == 1, F.min("one")).otherwise(many).alias("hash")
    return spans.groupBy("archive", F.col("key").alias("node")).agg(own, F.sum("bytes").alias("bytes"), F.sum("records").alias("records"))


def level(nodes: DataFrame) -> DataFrame:
    """The nodes above: ``node`` is the ids' common prefix; the hash is over its at most 16 children in order, each with its range of bytes."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("text"))
    step = lambda s, c: F.struct(
        (s["at"] + c["bytes"]).alias("at"),
        F.concat(s["text"], c["node"].cast("string"), F.lit(" "), s["at"].cast("string"), F.lit("-"), (s["at"] + c["bytes"]).cast("string"), F.lit(" "), c["hash"], F.lit("\n")).alias("text"),
    )
    text = F.aggregate(F.array_sort(F.collect_list(F.struct("node", "bytes", "hash"))), start, step, lambda s: s["text"])
    return nodes.groupBy("archive", F.shiftright("node", FAN_BITS).alias("node")).agg(F.sha2(text, 256).alias("hash"), F.sum("bytes").alias("bytes"), F.sum("records").alias("records"))


def tree(leaf: DataFrame) -> DataFrame:
    """``level, archive, node, hash, bytes, records`` of one replica: ids at level 0, roots at ``LEVELS``.

    Dealt by archive once, so that no level above the ids needs a shuffle of its own.
    """
    nodes = keys(leaf.repartition("archive"))
    out = nodes.withColumn("level", F.lit(0))
    for depth in range(1, LEVELS + 1):
        nodes = level(nodes)
        out = out.unionByName(nodes.withColumn("level", F.lit(depth)))
    return out


def audit(ours: DataFrame, theirs: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """``archive, key`` of the ids whose records differ between two stored trees, and the mismatching nodes of each level, roots first.

    Roots are joined first; after that only the children of nodes that differ. A level without any ends the audit.
    """
    found: list[DataFrame] = []
    for depth in range(LEVELS, -1, -1):
        sides = [t.where(F.col("level") == depth).select("archive", "node", "hash") for t in (ours, theirs)]
        if found:
            up = found[-1].withColumnRenamed("node", "up")
            sides = [t.withColumn("up", F.shiftright("node", FAN_BITS)).join(up, ["archive", "up"], "left_semi").drop("up") for t in sides]
        both = sides[0].join(sides[1].withColumnRenamed("hash", "other"), ["archive", "node"], "full_outer")
        found.append(stash(both.where(~F.col("hash").eqNullSafe(F.col("other"))).select("archive", "node"), "differ"))
        if found[-1].isEmpty():
            break
    bad = found[-1] if len(found) > LEVELS else found[-1].limit(0)
    return bad.withColumnRenamed("node", "key"), found


def faults(ours: DataFrame, theirs: DataFrame, bad: DataFrame) -> DataFrame:
    """``archive, key, hash, hash_b, status, matched`` for each record of the ids ``bad`` that one side has more copies of.

    Of an id's records without a match the first of ours, by hash, is set against the first of theirs, and so
    on: corrupt. What is left is missing (from theirs) or extra. ``matched`` copies of ours are in theirs as well.
    """
    on = ["archive", "key", "hash"]
    sides = [t.join(bad, ["archive", "key"], "left_semi").select(*on, F.col("copies").alias(name)) for t, name in ((ours, "a"), (theirs, "b"))]
    both = sides[0].join(sides[1], on, "full_outer").fillna(0, ["a", "b"]).where("a <> b").withColumn("short", F.col("a") > F.col("b"))
    nth = F.row_number().over(Window.partitionBy("archive", "key", "short").orderBy("hash"))
    ranked = both.withColumn("nth", nth)
    lost = ranked.where("short").select("archive", "key", "nth", "hash", F.col("b").alias("matched"))
    new = ranked.where("NOT short").select("archive", "key", "nth", F.col("hash").alias("hash_b"))
    status = F.when(F.col("hash").isNull(), "extra").when(F.col("hash_b").isNull(), "missing").otherwise("corrupt")
    return lost.join(new, ["archive", "key", "nth"], "full_outer").select(*on, "hash_b", status.alias("status"), "matched")


def offsets(nodes: DataFrame, leaf: DataFrame) -> DataFrame:
    """``archive, key, hash, bytes, copies, offset`` of our leaves; ``offset`` is that of the first copy.

    Copies stand together, an id's records by hash. Three windows add up: ids of an archive (4,096 at most), 256 ranges of an id's
    hashes, and the records in one, so that an id of any number of records is no single task's.
    """
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sum_before = lambda c, w: F.coalesce(F.sum(c).over(ahead(w)), F.lit(0))
    first = nodes.where("level = 0").select("archive", F.col("node").alias("key"), sum_before("bytes", Window.partitionBy("archive").orderBy("node")).alias("at"))
    size = F.col("copies") * (F.col("bytes") + GAP)
    ours = leaf.select("archive", "key", F.substring("hash", 1, 2).alias("span"), "hash", "bytes", "copies", size.alias("size"))
    spans = ours.groupBy("archive", "key", "span").agg(F.sum("size").alias("size")).select("archive", "key", "span", sum_before("size", Window.partitionBy("archive", "key").orderBy("span")).alias("up"))
    within = ours.withColumn("own", sum_before("size", Window.partitionBy("archive", "key", "span").orderBy("hash")))
    placed = within.join(spans, ["archive", "key", "span"]).join(first, ["archive", "key"])
    return placed.select("archive", "key", "hash", "bytes", "copies", (F.col("at") + F.col("up") + F.col("own")).alias("offset"))


def report(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """``archive, key, offset, bytes, hash, copies, matched, status, hash_b`` for each different record of an id of either side.

    ``status``: ok (theirs has as many copies), corrupt (``hash_b`` stands in its place), missing, or extra (only ``hash_b``
    and no place). The report is a stored table. Null ids, urls and bodies: see :func:`warc_records`. Empty tables on one side make all of
    the other missing or extra; on both sides, an empty report.
    """
    with scratch() as keep:
        leaf, other = stash(leaves(ours), "leaves"), stash(leaves(theirs), "leaves")
        nodes = stash(tree(leaf), "nodes")
        bad, _ = audit(nodes, stash(tree(other), "nodes"))
        wrong = stash(faults(leaf, other, bad), "faults")
        on = ["archive", "key", "hash"]
        known = offsets(nodes, leaf).join(wrong.where("hash IS NOT NULL"), on, "left")
        columns = [*on[:2], "offset", "bytes", "hash", "copies", F.coalesce("matched", "copies").alias("matched"), F.coalesce("status", F.lit("ok")).alias("status"), "hash_b"]
        none = lambda c, kind: F.lit(None).cast(kind).alias(c)
        extra = wrong.where("status = 'extra'").select("archive", "key", none("offset", "long"), none("bytes", "long"), none("hash", "string"), none("copies", "long"), none("matched", "long"), "status", "hash_b")
        return keep(stash(known.select(*columns).unionByName(extra), "report"))
