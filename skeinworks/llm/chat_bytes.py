"""Conversations as chat text, assembled column by column in one buffer.

Template: a turn is ``### role: `` + text + `` </turn>`` and a line feed. Inside roles and texts a
backslash is put before every ``\\``, ``###`` and ``</turn>``, and a role's ``:`` becomes ``\\:``. So an
unescaped ``###`` always begins a turn and an unescaped `` </turn>`` + line feed ends it, and the text
reads back as it was. ``loss_starts`` and ``loss_ends`` give the byte ranges under the loss mask:
the assistant's texts as they stand in ``formatted``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .columns import own_places, pieces, text_bytes

HEAD, COLON, TAIL = b"### ", b": ", b" </turn>\n"
ASSISTANT = "assistant"
TURN = re.compile(rb"### ((?:[^\\:]|\\.)*): (.*?) </turn>\n", re.DOTALL)


def escape(column: pa.Array, role: bool = False) -> pa.Array:
    for plain in ("\\", "###", "</turn>", *([":"] if role else [])):
        column = pc.replace_substring(column, plain, "\\" + plain)
    return column


def unescape(raw: bytes) -> bytes:
    return re.sub(rb"\\(\\|###|</turn>|:)", rb"\1", raw)


def scatter(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Interleaves columns of byte strings row by row in one preallocated buffer.

    Each part is bytes and offsets. Returns the buffer and where each row's parts begin in it, with
    a last column for the row's end.
    """
    sizes = np.column_stack([np.diff(offsets) for _, offsets in parts])
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    begins = ends - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    for k, (data, offsets) in enumerate(parts):
        n = sizes[:, k]
        place = np.repeat(begins[:, k], n)
        place += own_places(n)
        out[place] = data[offsets[0] : offsets[-1]]
    return out, np.column_stack([begins, ends[:, -1]])


def constant(text: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.tile(np.frombuffer(text, np.uint8), n), np.arange(n + 1, dtype=np.int64) * len(text)


def assemble(role: pa.Array, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns in one buffer: it, where each turn begins (and the end), where its text begins and ends."""
    n = len(role)
    parts = [constant(HEAD, n), text_bytes(escape(role.fill_null(""), True)), constant(COLON, n), text_bytes(escape(text.fill_null(""))), constant(TAIL, n)]
    buffer, places = scatter(parts)
    return buffer, np.append(places[:, 0], len(buffer)), places[:, 3], places[:, 4]


FORMATTED = "conv_id long, part int, formatted string, loss_starts array<long>, loss_ends array<long>"


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """All turns, conversations whole and in order; ties and repeated rows by role and text."""
    cols = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return cols.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_chats(conversations: DataFrame, part_bytes: int = 4 << 20) -> DataFrame:
    """``conv_id, part, formatted, loss_starts, loss_ends`` for each conversation.

    A batch's turns are scattered into one preallocated buffer, which is the column's own: a row is a range of it.
    A conversation is one row. A longer one than ``part_bytes`` takes several rows, ``part`` 0, 1, ..,
    cut between turns, so that a conversation of any size passes through bounded memory; the loss
    ranges count from the row's begin. Turns go in order; null texts and roles are empty; a null
    ``conv_id`` is a conversation of its own; columns other than conv_id, turn, role, text are not read.
    """

    def rows(turns: pa.RecordBatch, part: int) -> tuple[pa.RecordBatch, int]:
        """The turns' conversations, the first from ``part`` on, in one buffer; and the number of the last one's parts."""
        buffer, begin, text_from, text_to = assemble(turns.column("role"), turns.column("text"))
        new = changes(turns.column("conv_id"))
        number = np.zeros(turns.num_rows, np.int32)
        starts = np.flatnonzero(new)
        for k, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(new)], strict=True)):
            number[a:b] = part if k == 0 else 0
            if begin[b] - begin[a] > part_bytes:
                low = begin[a]
                for x in range(a, b):
                    if begin[x + 1] - low > part_bytes and begin[x] > low:
                        low = begin[x]
                        new[x] = True
                        number[x:b] += 1
        at = np.flatnonzero(new)
        ends = np.append(at, len(new))
        loss = np.flatnonzero(pc.equal(turns.column("role"), ASSISTANT).fill_null(False).to_numpy(zero_copy_only=False))
        own = begin[at[np.searchsorted(at, loss, "right") - 1]]
        cuts = pa.array(np.searchsorted(loss, ends).astype(np.int32))
        ranges = [pa.ListArray.from_arrays(cuts, pa.array((place[loss] - own).astype(np.int64))) for place in (text_from, text_to)]
        formatted = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(begin[ends].astype(np.int32)), pa.py_buffer(buffer)])
        columns = [turns.column("conv_id").take(pa.array(at)), pa.array(number[at]), formatted, *ranges]
        return pa.RecordBatch.from_arrays(columns, ["conv_id", "part", "formatted", "loss_starts", "loss_ends"]), int(number[-1]) + 1

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # turns of the last conversation, which may go on
        begun: tuple[int | None, int] | None = None  # a conversation of which parts have gone out, and how many

        def out(turns: pa.RecordBatch, all_out: bool) -> pa.RecordBatch:
            nonlocal begun
            first, last = turns.column("conv_id")[0].as_py(), turns.column("conv_id")[-1].as_py()
            batch, parts = rows(turns, begun[1] if begun and begun[0] == first else 0)
            begun = None if all_out else (last, parts)
            return batch

        for piece in pieces(batches, "text", part_bytes):
            for at in range(0, piece.num_rows, 2000):
                held.append(piece.slice(at, 2000))
                turns = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                stop = int(np.flatnonzero(changes(turns.column("conv_id")))[-1])
                if stop:
                    yield out(turns.slice(0, stop), True)
                    turns = turns.slice(stop)
                if int(text_bytes(turns.column("text"))[1][-1]) >= part_bytes:
                    yield out(turns, False)
                    held = []
                else:
                    held = [turns]
        if held:
            yield out(pa.Table.from_batches(held).combine_chunks().to_batches()[0], True)

    return sorted_turns(conversations).mapInArrow(build, FORMATTED)


def changes(ids: pa.Array) -> np.ndarray:
    """Where another conversation begins; null is one of its own."""
    null, value = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (null[1:] != null[:-1])
    return new


def read_turns(formatted: bytes) -> list[tuple[bytes, bytes]]:
    """The (role, text) pairs of a formatted row."""
    out, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at byte {at}")
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return out


DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """A row for each conversation, parsed back from what :func:`format_chats` returned."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []

        def out(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in DIGEST.split(", ")])

        def close() -> None:
            if now:
                rows.append((now["id"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["all"]))

        for batch in batches:
            for r in batch.to_pylist():
                if not now or r["part"] == 0:
                    close()
                    now = {"id": r["conv_id"], "n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "chars": 0, "all": 0}
                raw = r["formatted"].encode()
                for role, text in read_turns(raw):
                    now["n"] += 1
                    now["turns"].update(role + b"\n" + text + b"\n")
                now["all"] += len(r["formatted"])
                for a, b in zip(r["loss_starts"], r["loss_ends"], strict=True):
                    text = unescape(raw[a:b])
                    now["chars"] += len(text.decode())
                    now["loss"].update(text)
            if rows:
                yield out(rows)
                rows.clear()
        close()
        if rows:
            yield out(rows)

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(read, DIGEST)
