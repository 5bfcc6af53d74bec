"""Column functions over vectors, flat symmetric tensors, affines and names. No Python runs on rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

COS_EPS, UNIT_EPS = 1e-7, 1e-20


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def vec_dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def vec_norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(v), F.lit(0.0), lambda s, x: s + x * x))


def vec_cos(a: Column | str, b: Column | str) -> Column:
    """Cosine with a small term in the denominator, so that zero vectors give 0."""
    return vec_dot(a, b) / (vec_norm(a) * vec_norm(b) + F.lit(COS_EPS))


def unit(v: Column | str, eps: float = UNIT_EPS) -> Column:
    """Unit length; zero stays zero."""
    n = vec_norm(v) + F.lit(eps)
    return F.transform(col(v), lambda x: x / n)


def flip_component(v: Column | str, axis: int) -> Column:
    """Negates one axis of every 3-vector in a flat array."""
    return F.transform(col(v), lambda x, i: F.when(i % 3 == axis, -x).otherwise(x))


def weighted_mean_vectors(a: Column | str, b: Column | str, w: Column | float) -> Column:
    """(1 - w) a + w b, with b turned round first where it points away from a."""
    w = w if isinstance(w, Column) else F.lit(w)
    sign = F.when(vec_dot(a, b) < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    return F.zip_with(col(a), col(b), lambda x, y: (1 - w) * x + w * sign * y)


def rotation_from_affine(affine: np.ndarray) -> np.ndarray:
    """The 3 x 3 part with its columns at unit length."""
    m = np.asarray(affine, float)[:3, :3]
    return m / np.linalg.norm(m, axis=0)


def apply_matrix(v: Column | str, m: np.ndarray, from_right: bool = True) -> Column:
    """``v @ m`` for each 3-vector of a flat array (or ``m @ v``)."""
    m = np.asarray(m, float) if from_right else np.asarray(m, float).T
    v = col(v)

    def one(x: Column, i: Column) -> Column:
        base = i - i % 3 + 1
        parts = [F.element_at(v, (base + k).cast("int")) for k in range(3)]
        rows = [sum((parts[k] * F.lit(float(m[k, j])) for k in range(1, 3)), parts[0] * F.lit(float(m[0, j]))) for j in range(3)]
        return F.when(i % 3 == 0, rows[0]).when(i % 3 == 1, rows[1]).otherwise(rows[2])

    return F.transform(v, one)


def rotate_peaks(v: Column | str, affine: np.ndarray) -> Column:
    return apply_matrix(v, rotation_from_affine(affine))


def rotate_gradients(v: Column | str, affine: np.ndarray) -> Column:
    return apply_matrix(v, rotation_from_affine(affine), from_right=False)


def _euler(ax: Column, ay: Column, az: Column) -> list[list[Column]]:
    """Counter-clockwise Rz Ry Rx, acting on column vectors."""
    cx, sx, cy, sy, cz, sz = F.cos(ax), F.sin(ax), F.cos(ay), F.sin(ay), F.cos(az), F.sin(az)
    return [
        [cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx],
        [sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx],
        [-sy, cy * sx, cy * cx],
    ]


def rotate_euler(v: Column | str, ax: Column, ay: Column, az: Column) -> Column:
    """Rotates every 3-vector of a flat array about x, then y, then z."""
    r, v = _euler(ax, ay, az), col(v)

    def one(x: Column, i: Column) -> Column:
        base = i - i % 3 + 1
        p = [F.element_at(v, (base + k).cast("int")) for k in range(3)]
        rows = [r[j][0] * p[0] + r[j][1] * p[1] + r[j][2] * p[2] for j in range(3)]
        return F.when(i % 3 == 0, rows[0]).when(i % 3 == 1, rows[1]).otherwise(rows[2])

    return F.transform(v, one)


#: Place of (row, column) in a flat tensor xx, xy, xz, yy, yz, zz.
FLAT = [[0, 1, 2], [1, 3, 4], [2, 4, 5]]


def tensor_matrix(t: Column | str) -> Column:
    """The nine entries of a flat symmetric tensor, row by row."""
    t = col(t)
    return F.array(*(t[FLAT[i][j]] for i in range(3) for j in range(3)))


def tensor_flat(m: Column | str) -> Column:
    m = col(m)
    return F.array(*(m[3 * i + j] for i in range(3) for j in range(i, 3)))


def rotate_tensor(t: Column | str, r: np.ndarray | list[list[Column]]) -> Column:
    """R T R' on flat tensors."""
    t = col(t)
    g = [[F.lit(float(x)) if not isinstance(x, Column) else x for x in row] for row in r]
    out = []
    for i in range(3):
        for j in range(i, 3):
            terms = [g[i][k] * t[FLAT[k][m]] * g[j][m] for k in range(3) for m in range(3)]
            out.append(sum(terms[1:], terms[0]))
    return F.array(*out)


def vec_to_tensor(v: Column | str) -> Column:
    """Outer product of a 3-vector with itself, flat."""
    v = col(v)
    return F.array(*(v[i] * v[j] for i in range(3) for j in range(i, 3)))


def let(x: Column, body) -> Column:
    """``body`` of ``x``, which is computed once: a lambda's variable isn't spelled out at each use."""
    return F.transform(F.array(x), body)[0]


def _eigen(m: Column) -> Column:
    """Struct with ``q, p, phi``: the eigenvalues are q + 2 p cos(phi + 2 pi k / 3)."""
    a, d, e, b, f, c = (m[i] for i in range(6))

    def scaled(s: Column) -> Column:
        safe = F.when(s["p"] > 0, s["p"]).otherwise(F.lit(1.0))
        u, v, w, x, y, z = ((k / safe) for k in (a - s["q"], b - s["q"], c - s["q"], d, e, f))
        half = (u * (v * w - z * z) - x * (x * w - z * y) + y * (x * z - v * y)) / 2
        phi = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3
        return F.struct(s["q"].alias("q"), s["p"].alias("p"), phi.alias("phi"))

    q = (a + b + c) / 3
    return let(q, lambda q: let(F.struct(q.alias("q"), F.sqrt(((a - q) * (a - q) + (b - q) * (b - q) + (c - q) * (c - q) + 2 * (d * d + e * e + f * f)) / 6).alias("p")), scaled))


def eigenvalues(t: Column | str) -> Column:
    """Array of the eigenvalues of a flat symmetric tensor, largest first, in closed form."""
    third = F.lit(2 * np.pi / 3)
    of = lambda s, k: s["q"] + 2 * s["p"] * F.cos(s["phi"] + k * third)
    return let(col(t), lambda m: let(_eigen(m), lambda s: F.array(of(s, 0), of(s, 2), of(s, 1))))


def tensor_to_vec(t: Column | str, least: float = 1e-3) -> Column:
    """The largest eigenvalue times its unit eigenvector, sign free; zero where that is shorter than ``least``."""

    def cross(p, q):
        return F.array(p[1] * q[2] - p[2] * q[1], p[2] * q[0] - p[0] * q[2], p[0] * q[1] - p[1] * q[0])

    def size(p: Column) -> Column:
        return p[0] * p[0] + p[1] * p[1] + p[2] * p[2]

    def vector(m: Column, top: Column) -> Column:
        a, d, e, b, f, c = (m[i] for i in range(6))
        rows = [(a - top, d, e), (d, b - top, f), (e, f, c - top)]
        # The longest cross product of two rows is the best direction; a tensor without any has its largest axis.
        products = F.array(*(cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))))
        longest = F.array_max(F.transform(products, lambda p: F.struct(size(p).alias("s"), p.alias("v"))))
        one = F.array(*_axis(a, b, c))
        direction = let(longest, lambda w: F.when(w["s"] > 1e-24, F.transform(w["v"], lambda x: x / F.sqrt(w["s"]))).otherwise(one))
        return F.transform(direction, lambda x: F.when(F.abs(top) < least, F.lit(0.0)).otherwise(x * top))

    return let(col(t), lambda m: let(eigenvalues(m)[0], lambda top: vector(m, top)))


def _axis(a: Column, b: Column, c: Column) -> list[Column]:
    first, second = (a >= b) & (a >= c), b >= c
    return [F.when(first, 1.0).otherwise(0.0), F.when(~first & second, 1.0).otherwise(0.0), F.when(~first & ~second, 1.0).otherwise(0.0)]


def fractional_anisotropy(l1: Column, l2: Column, l3: Column) -> Column:
    top = F.sqrt((l1 - l2) * (l1 - l2) + (l2 - l3) * (l2 - l3) + (l3 - l1) * (l3 - l1))
    size = F.sqrt(l1 * l1 + l2 * l2 + l3 * l3)
    return F.when(size > 0, F.sqrt(F.lit(0.5)) * top / size).otherwise(F.lit(0.0))


# Affines


def affine_apply(x: Column, y: Column, z: Column, affine: np.ndarray) -> list[Column]:
    a = np.asarray(affine, float)
    return [x * F.lit(float(a[i, 0])) + y * F.lit(float(a[i, 1])) + z * F.lit(float(a[i, 2])) + F.lit(float(a[i, 3])) for i in range(3)]


def affine_inverse(affine: np.ndarray) -> np.ndarray:
    return np.linalg.inv(np.asarray(affine, float))


def flip_axes_for(affine: np.ndarray) -> list[int]:
    """Axes that canonical orientation turns round: x if positive, y and z if negative."""
    d = np.diag(np.asarray(affine, float))
    return [i for i, bad in enumerate((d[0] > 0, d[1] < 0, d[2] < 0)) if bad]


def flip_affine(affine: np.ndarray, axes: list[int], shape: tuple[int, int, int]) -> np.ndarray:
    """The affine of a grid whose ``axes`` are turned round."""
    a = np.array(affine, float)
    for i in axes:
        a[i, 3] += (shape[i] - 1) * a[i, i]
        a[i, i] = -a[i, i]
    return a


def invert_xy_affine(affine: np.ndarray) -> np.ndarray:
    a = np.array(affine, float)
    for i, j in ((0, 0), (1, 1), (0, 3), (1, 3)):
        a[i, j] = -a[i, j]
    return a


def spacing(affine: Column | str) -> Column:
    """Grid spacing from a flat 4 x 4 affine."""
    return F.abs(F.round(col(affine)[0], 2))


# Numbers and names


def format_number(x: Column | str) -> Column:
    """At most six decimals, one at least; 1e-5 and smaller ones in scientific notation."""
    x = col(x)
    plain = F.regexp_replace(F.format_string("%.6f", F.round(x, 6)), r"(\.\d+?)0*$", "$1")
    return F.when(F.abs(x) > 1e-5, plain).otherwise(F.format_string("%.2e", x))


def size_ratio(a: Column | str, b: Column | str) -> Column:
    a, b = col(a), col(b)
    return F.least(a, b) / F.greatest(a, b)


def subject_path(template: Column | str, subject: Column | str) -> Column:
    return F.replace(F.lit(template) if isinstance(template, str) else template, F.lit("SUBJECT_ID"), col(subject).cast("string"))


def both_sides(name: Column | str) -> Column:
    """``_left`` and ``_right`` names of a bundle."""
    return F.array(F.concat(col(name), F.lit("_left")), F.concat(col(name), F.lit("_right")))


def both_ends(name: Column | str) -> Column:
    """Names of a bundle's begin and end parts."""
    return F.array(F.concat(col(name), F.lit("_b")), F.concat(col(name), F.lit("_e")))


def unit_hash(*parts: Column | str) -> Column:
    """A number in [0, 1) from the parts' md5: the same on every engine, run and partitioning."""
    text = F.concat_ws(":", *(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
