"""Image and polyline files as data sources."""

import gzip
import struct

import numpy as np
import pytest

from skeinworks.sources import formats


def tck(lines, kind="<f4", name="Float32LE", end=True, extra=""):
    head = f"mrtrix tracks\n{extra}datatype: {name}\nfile: . 120\nEND\n".encode()
    rows = [r for p in lines for r in [*p, [np.nan] * 3]]
    if end:
        rows.append([np.inf] * 3)
    return head + bytes(120 - len(head)) + np.array(rows, kind).tobytes()


def found(df):
    return [[tuple(q) for q in r["points"]] for r in df.orderBy("path", "line_id").collect()]


@pytest.mark.parametrize("kind, name", [("<f4", "Float32LE"), (">f4", "Float32BE"), ("<f8", "Float64LE"), (">f8", "Float64BE")])
def test_tck_is_read_once_whatever_the_ranges(spark, tmp_path, kind, name):
    rng = np.random.default_rng(0)
    lines = [np.round(rng.normal(size=(n, 3)) * 8) / 8 for n in (1, 5, 40, 2, 1, 1, 90, 3)]
    (tmp_path / "a.tck").write_bytes(tck(lines, kind, name))
    (tmp_path / "b.tck").write_bytes(tck([], kind, name))
    (tmp_path / "c.tck").write_bytes(tck([lines[1], [], lines[2]], kind, name, end=False))
    want = [[tuple(q) for q in p] for p in [*lines, lines[1], lines[2]]]
    for most in (1, 7, 24, 100, 1 << 20) if kind == "<f4" else (100,):
        df = formats.read_files(spark, "tck", str(tmp_path), range_bytes=max(most, 13))
        assert found(df) == want
    assert formats.read_files(spark, "tck", str(tmp_path), range_bytes=100).rdd.getNumPartitions() > 10


def test_small_pieces_and_cut_files(spark, tmp_path, monkeypatch):
    lines = [np.arange(3.0 * n).reshape(n, 3) for n in (4, 30, 7)]
    raw = tck(lines)
    (tmp_path / "a.tck").write_bytes(raw[:-12 - 12 - 5])
    part = formats.Stretch(str(tmp_path / "a.tck"), "a.tck", len(raw) - 29, 0, len(raw) - 29)
    for piece in (12, 36, 1000):
        monkeypatch.setattr(formats, "PIECE", piece)
        store, at = formats.opened(part.uri)
        got = [p for b in formats.Tck({"path": ""}).rows(store, at, part) for p in b.column("points").to_pylist()]
        assert [len(p) for p in got] == [4, 30, 6]
    (tmp_path / "a.tck").write_bytes(b"mrtrix tracks\ndatatype: Float32LE\n")
    with pytest.raises(Exception, match="no END"):
        formats.read_files(spark, "tck", str(tmp_path)).collect()


def nifti(data, order="<", code=16, slope=0.0, inter=0.0):
    raw = bytearray(352)
    struct.pack_into(order + "i", raw, 0, 348)
    struct.pack_into(order + "8h", raw, 40, data.ndim, *data.shape, *(1,) * (7 - data.ndim))
    struct.pack_into(order + "h", raw, 70, code)
    struct.pack_into(order + "8f", raw, 76, 1, 2, 2, 2, 1, 1, 1, 1)
    struct.pack_into(order + "3f", raw, 108, 352, slope, inter)
    return bytes(raw) + data.astype(order + formats.NIFTI_TYPES[code]).tobytes(order="F")


def test_nifti_in_planes(spark, tmp_path):
    rng = np.random.default_rng(1)
    data = rng.integers(-2, 3, (4, 5, 6, 2)).astype(float)
    (tmp_path / "a.nii").write_bytes(nifti(data))
    (tmp_path / "b.nii").write_bytes(nifti(data, ">", 4))
    (tmp_path / "c.nii.gz").write_bytes(gzip.compress(nifti(data[..., 0], "<", 64)))
    (tmp_path / "d.nii").write_bytes(nifti(data, "<", 8, 0.5, 1.0))
    nan = data.copy()
    nan[0] = np.nan
    (tmp_path / "e.nii").write_bytes(nifti(nan))
    images = {"a.nii": data, "b.nii": data, "c.nii.gz": data[..., :1], "d.nii": data * 0.5 + 1, "e.nii": np.nan_to_num(nan)}
    for most in (50, 333, 1 << 20):
        got = {n: np.zeros_like(v) for n, v in images.items()}
        rows = formats.read_files(spark, "nifti", str(tmp_path), range_bytes=most).collect()
        for r in rows:
            got[r["path"]][r["x"], r["y"], r["z"], r["channel"]] += r["value"]
        assert all((got[n] == v).all() for n, v in images.items()) and len(rows) == sum(int((v != 0).sum()) for v in images.values())
    (tmp_path / "a.nii").write_bytes(nifti(data)[:-1])
    with pytest.raises(Exception, match="has 1311 bytes of 1312"):
        formats.read_files(spark, "nifti", str(tmp_path / "a.nii")).collect()
    (tmp_path / "c.nii.gz").write_bytes(gzip.compress(nifti(data[..., 0], "<", 64)[:-9]))
    with pytest.raises(Exception, match="ends within its data"):
        formats.read_files(spark, "nifti", str(tmp_path / "c.nii.gz")).collect()


def test_round_trips_and_commit(spark, tmp_path):
    lines = spark.createDataFrame([("s/a.trk", 2, [(1.0, 2.0, 3.0), (4.0, 5.0, 6.5)]), ("s/a.trk", 1, [(0.0, 0.0, 0.25)]), ("b.trk", 1, []), ("b.trk", 2, None)], "path string, n int, points array<struct<x:double,y:double,z:double>>")
    out = str(tmp_path / "trk")
    formats.write_lines(lines, out, "trk", ["n"])
    assert found(formats.read_files(spark, "trk", out)) == [[], [], [(0.0, 0.0, 0.25)], [(1.0, 2.0, 3.0), (4.0, 5.0, 6.5)]]
    with pytest.raises(Exception, match="already"):
        formats.write_lines(lines, out, "trk")
    formats.write_lines(lines.where("path = 'b.trk'"), out, "trk", mode="overwrite")
    assert sorted(p.name for p in (tmp_path / "trk").iterdir()) == ["b.trk"]
    out = str(tmp_path / "none")
    formats.write_lines(lines.limit(0), out, "tck")
    assert formats.read_files(spark, "tck", out).count() == 0
    cells = spark.createDataFrame([("i.nii", 1, 2, 0, 0, 5.0), ("i.nii", 0, 0, 2, 1, -1.5), ("j.nii.gz", 3, 3, 3, 1, 2.0)], formats.CELLS)
    formats.write_images(cells, str(tmp_path / "img"), (4, 4, 4, 2))
    assert sorted(map(tuple, formats.read_files(spark, "nifti", str(tmp_path / "img")).collect())) == sorted(map(tuple, cells.collect()))
    for bad, match in (("3,3,3,2", "outside"),):
        with pytest.raises(Exception, match=match):
            formats.write_images(cells, str(tmp_path / "bad"), tuple(map(int, bad.split(","))))
        assert not (tmp_path / "bad").exists() or not list((tmp_path / "bad").iterdir())
    with pytest.raises(Exception, match="not a file below"):
        formats.write_lines(lines.selectExpr("'../x.trk' AS path", "n", "points"), str(tmp_path / "up"), "trk")


def test_header_of_written_image(tmp_path):
    affine = np.array([[-1.25, 0, 0, 90], [0, 1.25, 0, -126], [0, 0, 1.25, -72], [0, 0, 0, 1.0]])
    head = formats.image_head(formats.head_bytes((3, 4, 5, 1), affine, 16), "x")
    assert head.shape == (3, 4, 5, 1) and head.kind == np.dtype("<f4") and np.allclose(head.affine, affine)


def test_small_ranges_read_little_and_stay_few(tmp_path):
    from pyarrow import fs

    from skeinworks.sources import formats

    lines = np.full((60_000, 3), np.nan)
    lines[np.arange(60_000) % 6 < 5] = 1.5
    body = lines.astype("<f8").tobytes() + np.full(3, np.inf).tobytes()
    (tmp_path / "a.tck").write_bytes(b"mrtrix tracks\ndatatype: Float64LE\nfile: . 64\nEND\n".ljust(64, b"\0") + body)
    read = []

    class Counted:
        def __init__(self, f):
            self.f = f

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.f.close()

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            read.append(n)
            return self.f.read(n)

    class Store:
        def open_input_file(self, at):
            return Counted(fs.LocalFileSystem().open_input_file(at))

    source = formats.Tck({"path": str(tmp_path), "range_bytes": "100"})
    parts = source._ranges()
    assert len(parts) <= formats.RANGES + 1
    first = [i for p in parts for batch in source.rows(Store(), str(tmp_path / "a.tck"), p) for i in batch.column("line_id").to_pylist()]
    assert first == list(range(0, 60_000, 6))
    # a range reads a head, itself and at most a few short pieces behind it
    assert sum(read) < len(body) + len(parts) * (4096 + 3 * 256 * 24)
