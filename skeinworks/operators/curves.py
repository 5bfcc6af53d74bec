"""Lines as curves: smoothing splines, and lines thinned within a tolerance, many lines at once in Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["x", "y", "z"]
#: Points that are worked on at a time, padding included.
POINTS = 1 << 18


def flattened(points: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Points of lines one below the other, and the number of each line's; null lines have none."""
    flat = points.flatten()
    xyz = np.stack([flat.field(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in CELL], axis=1).reshape(-1, 3)
    return xyz, np.array(points.value_lengths().fill_null(0).to_numpy(), np.int64)


def as_lines(xyz: np.ndarray, counts: np.ndarray, null: np.ndarray) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    values = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(xyz[:, k])) for k in range(3)], CELL)
    return pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null, False)), values)


def on_points(lines: DataFrame, change: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``lines`` with their points changed: ``change`` gets a batch's points one below the other and the number of each line's, and returns such. Null stays null."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("points")
            points = batch.column(at)
            new = as_lines(*change(*flattened(points)), points.is_null().to_numpy(zero_copy_only=False))
            yield batch.set_column(at, pa.field("points", new.type), new)

    return lines.mapInArrow(work, lines.schema)


def arc_places(xyz: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each point's length along its line, summed from the line's begin. Lines of one length are summed together."""
    out = np.zeros(len(xyz))
    first = np.cumsum(counts) - counts
    for n in np.unique(counts[counts > 1]).tolist():
        at = first[counts == n, None] + np.arange(n)
        d = np.diff(xyz[at], axis=1)
        out[at[:, 1:]] = np.cumsum(np.sqrt(d[..., 0] ** 2 + d[..., 1] ** 2 + d[..., 2] ** 2), axis=1)
    return out


def evenly(xyz: np.ndarray, counts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``n`` points of each line at equal steps of arc length; lines without points get none, a single point is repeated.

    Points and targets are sorted together by line and length, so a line costs what its points and targets do.
    """
    n = np.where(counts > 0, np.maximum(n, 0), 0)
    place = arc_places(xyz, counts)
    first = np.cumsum(counts) - counts
    line, target_line = np.repeat(np.arange(len(counts)), counts), np.repeat(np.arange(len(counts)), n)
    i = np.arange(len(target_line)) - np.repeat(np.cumsum(n) - n, n)
    last = first + np.maximum(counts, 1) - 1
    target = place[last[target_line]] * i / np.maximum(n - 1, 1)[target_line] if len(target_line) else np.zeros(0)
    order = np.lexsort((np.repeat([0, 1], [len(line), len(i)]), np.concatenate([place, target]), np.concatenate([line, target_line])))
    passed = np.cumsum(order < len(line))
    k = np.empty(len(i), np.int64)
    asks = order >= len(line)
    k[order[asks] - len(line)] = passed[asks] - 1
    # never the line's own end, so that there is a point behind
    k = np.clip(k, first[target_line], np.maximum(last - 1, first)[target_line])
    ahead = np.minimum(k + 1, last[target_line])
    gap = place[ahead] - place[k]
    share = np.clip(np.divide(target - place[k], gap, out=np.zeros(len(k)), where=gap > 0), 0, 1)
    return xyz[k] + (xyz[ahead] - xyz[k]) * share[:, None], n


def resample(lines: DataFrame, n: int | Column) -> DataFrame:
    """L2: every line with ``n`` equally spaced points; ``n`` may differ from line to line. Empty lines stay empty, null ones null."""
    rows = lines.withColumn("n_", (n if isinstance(n, Column) else F.lit(n)).cast("int"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("points")
            points = batch.column(at)
            new = as_lines(*evenly(*flattened(points), batch.column("n_").fill_null(0).to_numpy().astype(np.int64)), points.is_null().to_numpy(zero_copy_only=False))
            yield batch.set_column(at, pa.field("points", new.type), new).drop_columns(["n_"])

    return rows.mapInArrow(work, lines.schema)


def split_gaps(xyz: np.ndarray, counts: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    """Where each point of :func:`subsegment` stands: its steps from the point before, in that many, by rows of ``xyz``.

    Gives three numbers for each new point (row, step, steps) and the number of each line's new points.
    """
    d = np.diff(xyz, axis=0, append=xyz[-1:])
    with np.errstate(invalid="ignore"):
        gap = np.ceil(np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]) / step)
    k = np.where(np.isfinite(gap) & (gap > 1), gap, 1).astype(np.int64)
    ends = np.cumsum(counts)
    k[ends[counts > 0] - 1] = 1
    row = np.repeat(np.arange(len(k)), k)
    total = np.concatenate([[0], np.cumsum(k)])
    return np.stack([row, np.arange(len(row)) - total[row], k[row]]), total[ends] - total[ends - counts]


def subsegment(lines: DataFrame, step: float) -> DataFrame:
    """L3: splits gaps evenly so that none exceeds ``step``. A gap without a length stays whole, and what is null at either of its ends is null at its begin.

    A step's share is multiplied before it is divided, so that whole coordinates on the way stay whole.
    """

    def between(v: pa.Array, row: np.ndarray, j: np.ndarray, k: np.ndarray, last: np.ndarray) -> pa.Array:
        x = v.to_numpy(zero_copy_only=False).astype(np.float64)
        behind = np.where(last[row], row, row + 1)
        with np.errstate(invalid="ignore"):
            out = np.where(last[row], x[row], x[row] + (x[behind] - x[row]) * j / k)
        null = v.is_null().to_numpy(zero_copy_only=False)
        return pa.array(out, mask=null[row] | null[behind]) if null.any() else pa.array(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("points")
            points = batch.column(at)
            counts = np.array(points.value_lengths().fill_null(0).to_numpy(), np.int64)
            fields = dict(zip((f.name for f in points.type.value_type), points.flatten().flatten(), strict=True))
            xyz = np.stack([fields[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in CELL], axis=1).reshape(-1, 3)
            if not len(xyz):
                yield batch
                continue
            last = np.zeros(len(xyz), bool)
            last[np.cumsum(counts)[counts > 0] - 1] = True
            (row, j, k), many = split_gaps(xyz, counts, step)
            null, ends = points.is_null().to_numpy(zero_copy_only=False), np.cumsum(many)
            a = 0
            while a < batch.num_rows:
                # as many lines as have POINTS new points, one at least
                begin = int(ends[a] - many[a])
                b = max(a + 1, int(np.searchsorted(ends, begin + POINTS, "right")))
                part = slice(begin, int(ends[b - 1]))
                new = pa.StructArray.from_arrays([between(fields[c], row[part], j[part], k[part], last) for c in CELL], CELL)
                offsets = np.concatenate([[0], ends[a:b] - begin]).astype(np.int32)
                array = pa.ListArray.from_arrays(pa.array(offsets, mask=np.append(null[a:b], False)), new)
                yield batch.slice(a, b - a).set_column(at, pa.field("points", array.type), array)
                a = b

    return lines.mapInArrow(work, lines.schema)


def spline_bands(t: np.ndarray) -> tuple[np.ndarray, ...]:
    """For knots, a line each row: the diagonals of R (0, 1) and of Q'Q (0, 1, 2), and Q's three entries for each inner knot (Reinsch, 1967)."""
    h = np.diff(t, axis=1)
    a, c = 1 / h[:, :-1], 1 / h[:, 1:]
    b = -a - c
    r0, r1 = (h[:, :-1] + h[:, 1:]) / 3, h[:, 1:-1] / 6
    q0 = a * a + b * b + c * c
    q1 = b[:, :-1] * a[:, 1:] + c[:, :-1] * b[:, 1:]
    q2 = c[:, :-2] * a[:, 2:]
    return r0, r1, q0, q1, q2, a, b, c


def solved(d0: np.ndarray, d1: np.ndarray, d2: np.ndarray, rhs: np.ndarray) -> np.ndarray:
    """Solves symmetric systems with five diagonals, one a row, by LDL': a step for each unknown, over all rows at once."""
    n = d0.shape[1]
    d, l1, l2, z = np.empty_like(d0), np.zeros_like(d0), np.zeros_like(d0), rhs.copy()
    for k in range(n):
        d[:, k] = d0[:, k]
        if k >= 1:
            d[:, k] -= l1[:, k - 1] ** 2 * d[:, k - 1]
            z[:, k] -= l1[:, k - 1, None] * z[:, k - 1]
        if k >= 2:
            d[:, k] -= l2[:, k - 2] ** 2 * d[:, k - 2]
            z[:, k] -= l2[:, k - 2, None] * z[:, k - 2]
        if k + 1 < n:
            off = d1[:, k] - (l1[:, k - 1] * l2[:, k - 1] * d[:, k - 1] if k >= 1 else 0)
            l1[:, k] = off / d[:, k]
        if k + 2 < n:
            l2[:, k] = d2[:, k] / d[:, k]
    x = z / d[:, :, None]
    for k in range(n - 2, -1, -1):
        x[:, k] -= l1[:, k, None] * x[:, k + 1]
        if k + 2 < n:
            x[:, k] -= l2[:, k, None] * x[:, k + 2]
    return x


def fitted(t: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The natural cubic splines that minimise squared residuals plus ``weight`` times the integral of their squared second derivative, at the knots."""
    r0, r1, q0, q1, q2, a, b, c = spline_bands(t)
    w = weight[:, None]
    rhs = a[..., None] * y[:, :-2] + b[..., None] * y[:, 1:-1] + c[..., None] * y[:, 2:]
    g = solved(r0 + w * q0, r1 + w * q1, w * q2, rhs)
    out = y.copy()
    out[:, :-2] -= w[..., None] * a[..., None] * g
    out[:, 1:-1] -= w[..., None] * b[..., None] * g
    out[:, 2:] -= w[..., None] * c[..., None] * g
    return out


def smoothed(p: np.ndarray, s: float) -> np.ndarray:
    """Lines of one number of points, smoothed until the sum of squared distances from their points is ``s``, or straight if that takes less."""
    gaps = np.sqrt((np.diff(p, axis=1) ** 2).sum(-1))
    length = gaps.sum(1, keepdims=True)
    ok = length[:, 0] > 0
    out = p.copy()
    if not ok.any() or s <= 0:
        return out
    t = np.concatenate([np.zeros((int(ok.sum()), 1)), np.cumsum(np.maximum(gaps[ok] / length[ok], 1e-4), axis=1)], axis=1)
    y = p[ok]
    low, high = np.full(len(y), -14.0), np.full(len(y), 6.0)
    residual = lambda w: ((fitted(t, y, 10.0**w) - y) ** 2).sum((1, 2))
    straight = residual(high) <= s
    for _ in range(45):
        mid = (low + high) / 2
        over = residual(mid) > s
        high, low = np.where(over, mid, high), np.where(over, low, mid)
    out[ok] = fitted(t, y, 10.0 ** np.where(straight, 6.0, low))
    return out


def smooth_spline(lines: DataFrame, s: float = 5.0) -> DataFrame:
    """Each line as a cubic smoothing spline over its arc length, whose squared distances from the line's points add up to ``s``.

    Lines keep their number of points; those of fewer than three points or without length stay. Lines of one length are solved together.
    """

    def change(xyz: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = xyz.copy()
        first = np.cumsum(counts) - counts
        for n in np.unique(counts[counts > 2]).tolist():
            same = np.flatnonzero(counts == n)
            for k in range(0, len(same), max(1, POINTS // n)):
                at = first[same[k : k + max(1, POINTS // n)], None] + np.arange(n)
                whole = np.isfinite(xyz[at]).all((1, 2))
                out[at[whole]] = smoothed(xyz[at[whole]], s)
        return out, counts

    return on_points(lines, change)


def thinned(xyz: np.ndarray, counts: np.ndarray, tol: float, longest: float | None) -> np.ndarray:
    """Which points stay. All open stretches of all lines are looked at in a round; each is split at its farthest point, or ends."""
    keep = np.zeros(len(xyz), bool)
    first = np.cumsum(counts) - counts
    has = counts > 0
    keep[first[has]] = keep[(first + counts - 1)[has]] = True
    a, b = first[counts > 2], (first + counts - 1)[counts > 2]
    while len(a):
        n = b - a - 1
        start = np.cumsum(n) - n
        of = np.repeat(np.arange(len(a)), n)
        at = a[of] + 1 + np.arange(len(of)) - start[of]
        d = (xyz[b] - xyz[a])[of]
        rel = xyz[at] - xyz[a][of]
        size = (d * d).sum(1)
        share = np.clip(np.divide((rel * d).sum(1), size, out=np.zeros(len(d)), where=size > 0), 0, 1)
        far = np.sqrt(((rel - share[:, None] * d) ** 2).sum(1))
        most = np.maximum.reduceat(far, start)
        top = np.minimum.reduceat(np.where(far == most[of], at, len(xyz)), start)
        split = most > tol
        if longest is not None:
            wide = ~split & (np.sqrt(((xyz[b] - xyz[a]) ** 2).sum(1)) > longest)
            top = np.where(wide, (a + b) // 2, top)
            split |= wide
        keep[top[split]] = True
        a, b = np.concatenate([a[split], top[split]]), np.concatenate([top[split], b[split]])
        open_ = b - a > 1
        a, b = a[open_], b[open_]
    return keep


def compress(lines: DataFrame, tol: float = 0.1, longest: float | None = None) -> DataFrame:
    """Drops points that lie within ``tol`` of the polyline through those that stay (Ramer, 1972); ends stay.

    Segments longer than ``longest`` are halved by point number while there are points between. Lines with points that aren't finite stay whole.
    """

    def change(xyz: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of = np.repeat(np.arange(len(counts)), counts)
        odd = np.bincount(of, weights=~np.isfinite(xyz).all(1), minlength=len(counts)) > 0
        keep = thinned(np.where(odd[of][:, None], 0.0, xyz), counts, tol, longest) | odd[of]
        return xyz[keep], np.bincount(of[keep], minlength=len(counts))

    return on_points(lines, change)
