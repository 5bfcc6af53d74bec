"""Directories of image and polyline files as tables; partitioned tables out."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

VOXELS = "path string, x int, y int, z int, channel int, value double"
IMAGES = "path string, nx int, ny int, nz int, nc int, affine array<double>, spacing double"
POLYLINES = "path string, line_id long, points array<struct<x:double,y:double,z:double>>"
#: Element types of the NIfTI-1 header's datatype codes.
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def _nifti(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Data and affine of a NIfTI-1 file, plain or gzipped."""
    if raw[:2] == b"\x1f\x8b":
        import gzip

        raw = gzip.decompress(raw)
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dim = struct.unpack(order + "8h", raw[40:56])
    kind = np.dtype(order + NIFTI_TYPES[struct.unpack(order + "h", raw[70:72])[0]])
    pixdim = struct.unpack(order + "8f", raw[76:108])
    offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
    shape = dim[1 : 1 + dim[0]]
    data = np.frombuffer(raw, kind, int(np.prod(shape)), int(offset)).reshape(shape, order="F")
    if slope not in (0.0,) and (slope, inter) != (1.0, 0.0):
        data = data * slope + inter
    affine = np.eye(4)
    if struct.unpack(order + "h", raw[254:256])[0] > 0:
        affine[:3] = np.frombuffer(raw, order + "f4", 12, 280).reshape(3, 4)
    else:
        affine[:3, :3] = np.diag(pixdim[1:4])
    return data, affine


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content")


def ingest_volumes(spark: SparkSession, path: str, pattern: str = "*.nii*") -> tuple[DataFrame, DataFrame]:
    """Non-zero cells of all images in a folder, and a row of shape and affine for each."""
    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                data, _ = _nifti(raw)
                data = data.reshape((*data.shape, *(1,) * (4 - data.ndim))[:4])
                at = np.nonzero(np.nan_to_num(data))
                for k in range(0, len(at[0]), 1 << 17):
                    s = tuple(a[k : k + (1 << 17)] for a in at)
                    yield pd.DataFrame({"path": name, "x": s[0].astype("i4"), "y": s[1].astype("i4"), "z": s[2].astype("i4"), "channel": s[3].astype("i4"), "value": data[s].astype("f8")})

    def heads(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = []
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                data, affine = _nifti(raw)
                n = (*data.shape, 1, 1, 1, 1)[:4]
                rows.append((name, *map(int, n), [float(v) for v in affine.ravel()], float(abs(round(affine[0, 0], 2)))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ("path", "nx", "ny", "nz", "nc", "affine", "spacing")])

    files = _files(spark, path, pattern)
    return files.mapInPandas(cells, VOXELS), files.mapInPandas(heads, IMAGES)


def _tck(raw: bytes) -> list[np.ndarray]:
    """Lines of a TCK file: triples, NaN between lines, infinity at the end."""
    head = raw[: raw.index(b"END")].decode()
    fields = dict(line.split(": ", 1) for line in head.splitlines() if ": " in line)
    kind = {"Float32LE": "<f4", "Float32BE": ">f4", "Float64LE": "<f8", "Float64BE": ">f8"}[fields["datatype"].strip()]
    flat = np.frombuffer(raw, kind, offset=int(fields["file"].split()[-1]))
    xyz = flat[: len(flat) // 3 * 3].reshape(-1, 3).astype(float)
    ends = np.flatnonzero(~np.isfinite(xyz[:, 0]))
    return [p[np.isfinite(p[:, 0])] for p in np.split(xyz, ends) if np.isfinite(p[:, 0]).any()]


def _trk(raw: bytes) -> list[np.ndarray]:
    """Lines of a TRK file, in its own mm space."""
    scalars, props = struct.unpack("<h", raw[36:38])[0], struct.unpack("<h", raw[238:240])[0]
    out, at = [], 1000
    while at < len(raw):
        n = struct.unpack("<i", raw[at : at + 4])[0]
        out.append(np.frombuffer(raw, "<f4", n * (3 + scalars), at + 4).reshape(n, -1)[:, :3].astype(float))
        at += 4 + 4 * (n * (3 + scalars) + props)
    return out


def ingest_polylines(spark: SparkSession, path: str, pattern: str = "*.t[cr]k") -> DataFrame:
    """``path, line_id, points`` of all polyline files in a folder."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                lines = (_trk if raw[:5] == b"TRACK" else _tck)(raw)
                for k in range(0, len(lines), 2000):
                    some = lines[k : k + 2000]
                    yield pd.DataFrame({"path": name, "line_id": np.arange(k, k + len(some)), "points": [[dict(zip("xyz", map(float, q), strict=True)) for q in p] for p in some]})

    return _files(spark, path, pattern).mapInPandas(read, POLYLINES)


def write_by_bundle(df: DataFrame, path: str, split: bool = True) -> None:
    """A folder for each bundle, or one dataset."""
    (df.repartition("bundle").write.partitionBy("bundle") if split else df.write).parquet(path)


def write_polylines(lines: DataFrame, path: str) -> None:
    """By subject and bundle; without lines, an empty dataset that keeps the schema."""
    if lines.limit(1).count():
        lines.write.partitionBy("subject", "bundle").parquet(path)
    else:
        lines.write.parquet(path)
