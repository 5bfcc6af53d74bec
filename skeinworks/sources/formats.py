"""Image and polyline files as Spark data sources: ``spark.read.format("nifti")``, ``"tck"`` and ``"trk"``, and ``.write``.

:func:`register` makes the formats known to a session. Paths are folders or files on any file system that
pyarrow opens (local, HDFS, object stores). A read is cut into byte ranges: planes of an image, and stretches of a TCK file, whose
lines belong to the range they begin in. Files that can't be entered in the middle (gzip, TRK) are one range and
stream through their task in pieces. A write makes one file for each ``path``, in a folder for the attempt; only the
commit moves files to their places, so a lost task or job leaves none behind.
"""

from __future__ import annotations

import gzip
import io
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

CELLS = "path string, x int, y int, z int, channel int, value double"
LINES = "path string, line_id long, points array<struct<x:double,y:double,z:double>>"
#: Fixed values of the formats. NIfTI-1: datatype codes and the place where data may begin.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}
NIFTI_HEAD, NIFTI_DATA = 348, 352
TCK_TYPES = {"Float32LE": "<f4", "Float32BE": ">f4", "Float64LE": "<f8", "Float64BE": ">f8"}
TRK_HEAD = 1000
POINTS = pa.list_(pa.struct([(c, pa.float64()) for c in "xyz"]))
#: Bytes of a range, and of what is read and decoded at a time.
RANGE, PIECE = 32 << 20, 4 << 20
#: Ranges of a read, about, that are smaller than ``RANGE``: beyond that number they grow with the files.
RANGES = 1024


@dataclass
class Stretch(InputPartition):
    uri: str
    name: str
    size: int
    begin: int
    end: int

    def __post_init__(self) -> None:
        super().__init__((self.name, self.begin))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]] = field(default_factory=list)


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def listed(path: str, endings: tuple[str, ...]) -> list[fs.FileInfo]:
    """Files below a folder, or the one named, by path; those of unfinished writes are left out."""
    store, at = opened(path)
    info = store.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
    files = [f for f in found if f.type == fs.FileType.File and f.path.endswith(endings) and "/_" not in f.path[len(at) :]]
    return sorted(files, key=lambda f: f.path)


class Files(DataSource):
    """What the formats share. Options: ``path``; ``range_bytes`` of a range in reading (more where that would make over ``RANGES``)."""

    endings: tuple[str, ...] = ()

    def _ranges(self) -> list[Stretch]:
        path, most = self.options["path"], int(self.options.get("range_bytes", RANGE))
        _, top = opened(path)
        out, files = [], listed(path, self.endings)
        most = max(most, min(RANGE, sum(f.size for f in files) // RANGES))
        for f in files:
            name = f.path[len(top) :].lstrip("/") or f.path.rpartition("/")[2]
            step = most if self.divisible(f.path) else max(1, f.size)
            out += [Stretch(path if f.path == top else f"{path.rstrip('/')}/{name}", name, f.size, at, min(at + step, f.size)) for at in range(0, max(1, f.size), step)]
        return out

    def divisible(self, name: str) -> bool:
        return True


class Ranges(DataSourceReader):
    def __init__(self, source: Files) -> None:
        self.source = source

    def partitions(self) -> list[Stretch]:
        # a reader must have one range at least
        return self.source._ranges() or [Stretch("", "", 0, 0, 0)]

    def read(self, part: Stretch) -> Iterator[pa.RecordBatch]:
        if part.uri:
            store, at = opened(part.uri)
            yield from self.source.rows(store, at, part)


# Images


@dataclass
class Image:
    """A NIfTI-1 header."""

    order: str
    shape: tuple[int, ...]
    kind: np.dtype
    offset: int
    scale: tuple[float, float]
    affine: np.ndarray


def image_head(raw: bytes, name: str) -> Image:
    if len(raw) < NIFTI_HEAD:
        raise ValueError(f"{name}: cut off within its header")
    order = "<" if struct.unpack("<i", raw[:4])[0] == NIFTI_HEAD else ">"
    if struct.unpack(order + "i", raw[:4])[0] != NIFTI_HEAD:
        raise ValueError(f"{name}: not a NIfTI-1 file")
    dim, (code,) = struct.unpack(order + "8h", raw[40:56]), struct.unpack(order + "h", raw[70:72])
    if code not in NIFTI_TYPES:
        raise ValueError(f"{name}: unknown element type {code}")
    pixdim, (offset, slope, inter) = struct.unpack(order + "8f", raw[76:108]), struct.unpack(order + "3f", raw[108:120])
    affine = np.eye(4)
    if struct.unpack(order + "h", raw[254:256])[0] > 0:
        affine[:3] = np.frombuffer(raw, order + "f4", 12, 280).reshape(3, 4)
    else:
        affine[:3, :3] = np.diag(pixdim[1:4])
    shape = (*(int(n) for n in dim[1 : 1 + dim[0]]), 1, 1, 1, 1)[:4]
    return Image(order, shape, np.dtype(order + NIFTI_TYPES[code]), int(offset), (slope, inter) if slope else (1.0, 0.0), affine)


def head_bytes(shape: tuple[int, ...], affine: np.ndarray, code: int) -> bytes:
    raw = bytearray(NIFTI_DATA)
    kind = np.dtype(NIFTI_TYPES[code])
    zooms = np.sqrt((affine[:3, :3] ** 2).sum(axis=0))
    struct.pack_into("<i", raw, 0, NIFTI_HEAD)
    struct.pack_into("<8h", raw, 40, 4, *shape, 1, 1, 1)
    struct.pack_into("<hh", raw, 70, code, 8 * kind.itemsize)
    struct.pack_into("<8f", raw, 76, 1.0, *zooms, 1.0, 1.0, 1.0, 1.0)
    struct.pack_into("<3f", raw, 108, NIFTI_DATA, 1.0, 0.0)
    struct.pack_into("<hh", raw, 252, 0, 1)
    struct.pack_into("<12f", raw, 280, *affine[:3].ravel())
    raw[344:348] = b"n+1\0"
    return bytes(raw)


class Nifti(Files):
    """Non-zero cells of NIfTI-1 images, plain or gzipped; NaN counts as zero.

    To write, rows need ``path`` and ``x, y, z, channel, value``, those of a path in one partition by channel and z (see :func:`write_images`).
    Options: ``shape`` (four numbers), ``affine`` (16), ``datatype`` (a NIfTI code, 64: float64). Cells that no row has are 0. The last of rows of one cell stays.
    """

    endings = (".nii", ".nii.gz")

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema) -> DataSourceReader:
        return Ranges(self)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ImageWriter(self.options, overwrite)

    def divisible(self, name: str) -> bool:
        return not name.endswith(".gz")

    def rows(self, store: fs.FileSystem, at: str, part: Stretch) -> Iterator[pa.RecordBatch]:
        """The cells whose bytes begin in the range."""
        packed = at.endswith(".gz")
        with gzip.GzipFile(fileobj=store.open_input_stream(at, compression=None)) if packed else store.open_input_file(at) as f:
            raw = f.read(NIFTI_DATA)
            head = image_head(raw, part.name)
            wide, n = head.kind.itemsize, int(np.prod(head.shape))
            if not packed and part.size < head.offset + n * wide:
                raise ValueError(f"{part.name}: has {part.size} bytes of {head.offset + n * wide}")
            first = 0 if packed else min(n, max(0, -(-(part.begin - head.offset) // wide)))
            last = n if packed else min(n, max(0, -(-(part.end - head.offset) // wide)))
            if packed:
                f.read(head.offset - len(raw))
            else:
                f.seek(head.offset + first * wide)
            while first < last:
                want = min(last - first, PIECE // wide)
                data = f.read(want * wide)
                if len(data) < want * wide:
                    raise ValueError(f"{part.name}: ends within its data")
                yield self._cells(part.name, head, np.frombuffer(data, head.kind), first)
                first += want

    def _cells(self, name: str, head: Image, data: np.ndarray, first: int) -> pa.RecordBatch:
        value = data.astype(np.float64) * head.scale[0] + head.scale[1]
        value[np.isnan(value)] = 0
        at = np.flatnonzero(value)
        xyzc = np.unravel_index(at + first, head.shape, order="F")
        return pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), *(pa.array(v.astype(np.int32)) for v in xyzc), pa.array(value[at])], ["path", "x", "y", "z", "channel", "value"])


class FileWriter(DataSourceArrowWriter):
    """A file for each path of a task's rows, in a folder of this attempt; ``commit`` moves them."""

    def __init__(self, options, overwrite: bool) -> None:
        self.options, self.overwrite, self.top = dict(options), overwrite, options["path"].rstrip("/")
        self.attempt = f"{self.top}/_attempt-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, seen, now, out = Written(), set(), None, None
        store, attempt = opened(self.attempt)
        for batch in iterator:
            names = batch.column("path").to_pylist()
            cut = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for a, b in zip(cut, [*cut[1:], len(names)], strict=True):
                if names[a] != now:
                    if out is not None:
                        self.end(out)
                    now = names[a]
                    if now in seen:
                        raise ValueError(f"{now}: its rows must stand together")
                    if not now or now.startswith(("/", "_")) or ".." in now.split("/"):
                        raise ValueError(f"{now}: not a file below the folder written")
                    seen.add(now)
                    store.create_dir(attempt, recursive=True)
                    temporary = uuid.uuid4().hex
                    done.files.append((temporary, now))
                    out = self.begin(store.open_output_stream(f"{attempt}/{temporary}", compression=None), now)
                self.add(out, batch.slice(a, b - a))
        if out is not None:
            self.end(out)
        return done

    def commit(self, messages: list[Written | None]) -> None:
        store, top = opened(self.top)
        _, attempt = opened(self.attempt)
        files = [f for m in messages if m for f in m.files]
        final = [name for _, name in files]
        if len(set(final)) < len(final):
            self.abort(messages)
            raise ValueError("several tasks have rows of one path")
        store.create_dir(top, recursive=True)
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(top)):
                if f.path != attempt:
                    store.delete_dir(f.path) if f.type == fs.FileType.Directory else store.delete_file(f.path)
        elif any(f.type != fs.FileType.NotFound for f in store.get_file_info([f"{top}/{name}" for name in final])):
            self.abort(messages)
            raise FileExistsError(f"{top}: has some of the files already")
        for temporary, name in files:
            if "/" in name:
                store.create_dir(f"{top}/{name.rpartition('/')[0]}", recursive=True)
            store.move(f"{attempt}/{temporary}", f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, attempt = opened(self.attempt)
        if store.get_file_info(attempt).type == fs.FileType.Directory:
            store.delete_dir(attempt)


class ImageWriter(FileWriter):
    """Keeps one plane in memory at a time."""

    def __init__(self, options, overwrite: bool) -> None:
        super().__init__(options, overwrite)
        self.shape = tuple(int(n) for n in options["shape"].split(","))
        self.shape += (1,) * (4 - len(self.shape))
        self.affine = np.array([float(v) for v in options["affine"].split(",")]).reshape(4, 4) if "affine" in options else np.eye(4)
        self.code = int(options.get("datatype", 64))

    def begin(self, sink, name: str) -> dict:
        out = gzip.GzipFile(fileobj=sink, mode="wb", mtime=0) if name.endswith(".gz") else sink
        out.write(head_bytes(self.shape, self.affine, self.code))
        kind = np.dtype("<" + NIFTI_TYPES[self.code])
        return {"sink": sink, "out": out, "name": name, "plane": np.zeros(self.shape[:2], kind, order="F"), "at": 0}

    def add(self, image: dict, batch: pa.RecordBatch) -> None:
        x, y, z, c = (batch.column(k).to_numpy() for k in ("x", "y", "z", "channel"))
        value = batch.column("value").fill_null(0.0).to_numpy()
        if any(((v < 0) | (v >= n)).any() for v, n in zip((x, y, z, c), self.shape, strict=True)):
            raise ValueError(f"{image['name']}: a cell outside {self.shape}")
        plane = c.astype(np.int64) * self.shape[2] + z
        if (np.diff(plane, prepend=image["at"]) < 0).any():
            raise ValueError(f"{image['name']}: rows must stand by channel and z")
        for p in np.unique(plane).tolist():
            self._upto(image, p)
            here = plane == p
            image["plane"][x[here], y[here]] = value[here]

    def _upto(self, image: dict, plane: int) -> None:
        while image["at"] < plane:
            image["out"].write(image["plane"].tobytes(order="F"))
            image["plane"][:] = 0
            image["at"] += 1

    def end(self, image: dict) -> None:
        self._upto(image, self.shape[2] * self.shape[3])
        if image["out"] is not image["sink"]:
            image["out"].close()
        image["sink"].close()


# Polylines


def line_batch(name: str, first: list[int] | np.ndarray, counts: np.ndarray, xyz: np.ndarray) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    points = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xyz[:, k], np.float64)) for k in range(3)], list("xyz"))
    return pa.RecordBatch.from_arrays([pa.array([name] * len(counts), pa.string()), pa.array(first, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), points)], ["path", "line_id", "points"])


def flat_points(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Points of a batch's lines one below the other, and how many each line has; null lines have none."""
    points = batch.column("points")
    counts = np.array(points.value_lengths().fill_null(0).to_numpy(), np.int64)
    flat = points.flatten()
    return np.stack([flat.field(c).to_numpy(zero_copy_only=False) for c in "xyz"], axis=1).reshape(-1, 3).astype(np.float64), counts


class Tck(Files):
    """Lines of TCK files. ``line_id`` is the number of the line's first triple in its file, so it ascends in file order whatever the ranges.

    To write, rows need ``path`` and ``points``, those of a path together in one partition. Option ``datatype``, ``Float32LE`` unless given. Lines without points are left out.
    """

    endings = (".tck",)

    @classmethod
    def name(cls) -> str:
        return "tck"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return Ranges(self)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TckWriter(self.options, overwrite)

    def rows(self, store: fs.FileSystem, at: str, part: Stretch) -> Iterator[pa.RecordBatch]:
        with store.open_input_file(at) as f:
            kind, offset = self._head(f, part.name)
            wide = 3 * kind.itemsize
            n = (part.size - offset) // wide
            first, last = (min(n, max(0, -(-(b - offset) // wide))) for b in (part.begin, part.end))
            if first >= last:
                return
            # a line begins behind the gap before it, which may be the range's neighbour's
            place = max(0, first - 1)
            f.seek(offset + place * wide)
            begun, held = first == 0, np.zeros((0, 3))
            start = 0
            while place < n and (begun or place < last):
                # behind the range only as much as its last line takes
                want = min(PIECE // wide, max(last - place, len(held), 256))
                more = np.frombuffer(f.read(min(want, n - place) * wide), kind).reshape(-1, 3).astype(np.float64)
                gaps = np.flatnonzero(~np.isfinite(more).all(axis=1))
                stop = np.flatnonzero(np.isinf(more[gaps]).any(axis=1))
                over = bool(len(stop))
                gaps = gaps[: stop[0] + 1] if over else gaps
                if not begun and len(gaps):
                    begun, start = True, place + int(gaps[0]) + 1
                    more, place, gaps = more[gaps[0] + 1 :], start, gaps[1:] - gaps[0] - 1
                    if over and not len(gaps):
                        return
                elif not begun:
                    place += len(more)
                    continue
                if not len(held):
                    start = place
                block = np.concatenate([held, more])
                ends = gaps + len(held)
                begins_at = np.concatenate([[0], ends + 1])
                whole = np.flatnonzero((start + begins_at[:-1] < last) & (ends > begins_at[:-1]))
                if len(whole):
                    a, b = begins_at[whole], ends[whole]
                    at_points = np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange(int((b - a).sum()))
                    yield line_batch(part.name, start + a, b - a, block[at_points])
                place += len(more)
                held, start = block[begins_at[-1] :], start + int(begins_at[-1])
                if over or start >= last:
                    return
            if len(held) and begun and start < last:  # a file cut short ends with its last whole point
                yield line_batch(part.name, [start], np.array([len(held)]), held)

    def _head(self, f, name: str) -> tuple[np.dtype, int]:
        raw = b""
        while b"\nEND" not in raw:
            more = f.read(4096)
            if not more or len(raw) > 1 << 20:
                raise ValueError(f"{name}: no END of a TCK header")
            raw += more
        fields = dict(line.split(":", 1) for line in raw[: raw.index(b"\nEND")].decode("utf-8", "replace").splitlines() if ":" in line)
        kind = fields.get("datatype", "").strip()
        if kind not in TCK_TYPES or "file" not in fields:
            raise ValueError(f"{name}: a TCK header needs file, and a datatype of {', '.join(TCK_TYPES)}")
        return np.dtype(TCK_TYPES[kind]), int(fields["file"].split()[-1])


class TckWriter(FileWriter):
    def begin(self, sink, name: str) -> dict:
        datatype = self.options.get("datatype", "Float32LE")
        for offset in range(64, 4096):
            head = f"mrtrix tracks\ndatatype: {datatype}\nfile: . {offset}\nEND\n".encode()
            if len(head) <= offset:
                break
        sink.write(head + bytes(offset - len(head)))
        return {"sink": sink, "kind": np.dtype(TCK_TYPES[datatype])}

    def add(self, out: dict, batch: pa.RecordBatch) -> None:
        xyz, counts = flat_points(batch)
        counts = counts[counts > 0]
        rows = np.full((len(xyz) + len(counts), 3), np.nan, out["kind"])
        rows[np.arange(len(xyz)) + np.repeat(np.arange(len(counts)), counts)] = xyz
        out["sink"].write(rows.tobytes())

    def end(self, out: dict) -> None:
        out["sink"].write(np.full(3, np.inf, out["kind"]).tobytes())
        out["sink"].close()


class Trk(Files):
    """Lines of TRK files, in their own mm space; ``line_id`` counts them from 0. Their records have no marks between them, so a file is one range.

    To write: as for TCK. Options: ``shape`` (three numbers), ``affine`` (16) for the header.
    """

    endings = (".trk",)

    @classmethod
    def name(cls) -> str:
        return "trk"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return Ranges(self)

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TrkWriter(self.options, overwrite)

    def divisible(self, name: str) -> bool:
        return False

    def rows(self, store: fs.FileSystem, at: str, part: Stretch) -> Iterator[pa.RecordBatch]:
        with io.BufferedReader(store.open_input_stream(at, compression=None), 1 << 20) as f:
            raw = f.read(TRK_HEAD)
            if raw[:5] != b"TRACK" or len(raw) < TRK_HEAD:
                raise ValueError(f"{part.name}: not a TRK file")
            order = "<" if struct.unpack("<i", raw[996:1000])[0] == TRK_HEAD else ">"
            scalars, props = struct.unpack(order + "h", raw[36:38])[0], struct.unpack(order + "h", raw[238:240])[0]
            lines: list[np.ndarray] = []
            number = size = 0
            while len(count := f.read(4)) == 4:
                n = struct.unpack(order + "i", count)[0]
                want = 4 * (n * (3 + scalars) + props)
                data = f.read(want)
                if n < 0 or len(data) < want:
                    raise ValueError(f"{part.name}: ends within line {number + len(lines)}")
                lines.append(np.frombuffer(data, order + "f4", n * (3 + scalars)).reshape(n, -1)[:, :3] if n else np.zeros((0, 3)))
                size += want
                if size >= PIECE:
                    yield line_batch(part.name, range(number, number + len(lines)), np.array([len(p) for p in lines]), np.concatenate(lines))
                    number, lines, size = number + len(lines), [], 0
            if lines:
                yield line_batch(part.name, range(number, number + len(lines)), np.array([len(p) for p in lines]), np.concatenate(lines))


class TrkWriter(FileWriter):
    def begin(self, sink, name: str) -> dict:
        shape = [int(n) for n in self.options.get("shape", "1,1,1").split(",")][:3]
        affine = np.array([float(v) for v in self.options["affine"].split(",")]).reshape(4, 4) if "affine" in self.options else np.eye(4)
        raw = bytearray(TRK_HEAD)
        raw[:6] = b"TRACK\0"
        struct.pack_into("<3h", raw, 6, *shape)
        struct.pack_into("<3f", raw, 12, *np.sqrt((affine[:3, :3] ** 2).sum(axis=0)))
        struct.pack_into("<16f", raw, 440, *affine.ravel())
        raw[948:951] = b"RAS"
        struct.pack_into("<3i", raw, 988, 0, 2, TRK_HEAD)
        sink.write(bytes(raw))
        return {"sink": sink}

    def add(self, out: dict, batch: pa.RecordBatch) -> None:
        xyz, counts = flat_points(batch)
        words = np.zeros(3 * len(xyz) + len(counts), "<u4")
        ends = np.cumsum(3 * counts + 1)
        heads = ends - 3 * counts - 1
        body = np.ones(len(words), bool)
        body[heads] = False
        words[heads], words[body] = counts, xyz.astype("<f4").ravel().view("<u4")
        out["sink"].write(words.tobytes())

    def end(self, out: dict) -> None:
        out["sink"].close()


def write_images(cells: DataFrame, folder: str, shape: tuple[int, ...], affine: np.ndarray | None = None, datatype: int = 64, mode: str = "append") -> None:
    """``cells(path, x, y, z, channel, value)`` as NIfTI files, one for each path. A task has whole images, and one plane of them in memory."""
    register(cells.sparkSession)
    rows = cells.select("path", *(F.col(c).cast("int").alias(c) for c in ("x", "y", "z", "channel")), F.col("value").cast("double").alias("value"))
    out = rows.repartition("path").sortWithinPartitions("path", "channel", "z").write.format("nifti").mode(mode).option("shape", ",".join(map(str, shape))).option("datatype", datatype)
    (out if affine is None else out.option("affine", ",".join(map(repr, map(float, np.ravel(affine)))))).save(folder)


def write_lines(lines: DataFrame, folder: str, kind: str = "tck", order: list[str] | None = None, mode: str = "append", **options: str) -> None:
    """``lines(path, points, ..)`` as polyline files, one for each path, its lines by ``order``. Without lines, no files."""
    register(lines.sparkSession)
    rows = lines.repartition("path").sortWithinPartitions("path", *(order or [])).select("path", "points")
    rows.write.format(kind).mode(mode).options(**options).save(folder)


def read_files(spark: SparkSession, kind: str, path: str, range_bytes: int = RANGE) -> DataFrame:
    """The rows of all files of a format below ``path``."""
    register(spark)
    return spark.read.format(kind).option("range_bytes", range_bytes).load(path)


def register(spark: SparkSession) -> None:
    """Makes the formats ``nifti``, ``tck`` and ``trk`` known to a session."""
    for source in (Nifti, Tck, Trk):
        spark.dataSource.register(source)
