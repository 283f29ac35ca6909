"""Scalar and small-matrix expressions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def closest_multiple(n: Column, m: int, mode: str = "lower") -> Column:
    """Closest multiple of ``m``: 'lower', 'higher' or 'closer' (a tie goes up). Expects n >= 0."""
    lower = n - F.pmod(n, F.lit(m))
    higher = F.when(F.pmod(n, F.lit(m)) == 0, n).otherwise(lower + m)
    if mode == "lower":
        return lower
    if mode == "higher":
        return higher
    if mode == "closer":
        return F.when((n - lower) < (higher - n), lower).otherwise(higher)
    raise ValueError(f"mode should be lower, higher or closer, had {mode}")


def linear_index(x: Column, y: Column, z: Column, ny: Column | int, nz: Column | int) -> Column:
    """Raster position of a voxel (z fastest)."""
    as_long = lambda v: v.cast("bigint") if isinstance(v, Column) else F.lit(v).cast("bigint")
    return (x.cast("bigint") * as_long(ny) + y) * as_long(nz) + z


def get_dims(shape: Column, max_channels: int = 10) -> Column:
    """struct(n_dims, n_channels): a short last axis counts as channels."""
    last, length = F.element_at(shape, -1), F.size(shape)
    return F.struct(
        F.when(last <= max_channels, length - 1).otherwise(length).alias("n_dims"),
        F.when(last <= max_channels, last).otherwise(F.lit(1)).alias("n_channels"),
    )


def matrix(rows: list[list[Column]]) -> Column:
    return F.array(*[F.array(*[F.lit(v).cast("double") if not isinstance(v, Column) else v.cast("double")
                               for v in r]) for r in rows])


def let(value: Column, body) -> Column:
    """Bind ``value`` once and use it many times, so that nested matrix code stays small."""
    return F.transform(F.array(value), body)[0]


def matmul(a: Column, b: Column) -> Column:
    """Product of two 4x4 matrices held as ARRAY<ARRAY<DOUBLE>>."""
    axis = F.sequence(F.lit(0), F.lit(3))
    dot = lambda row, right, j: F.aggregate(axis, F.lit(0.0), lambda acc, k: acc + row[k] * right[k][j])
    return let(b, lambda right: F.transform(a, lambda row: F.transform(axis, lambda j: dot(row, right, j))))


def inverse_affine(affine: Column) -> Column:
    """Inverse of a 4x4 affine by the adjugate of its 3x3 part."""
    return let(affine, _inverse)


def _inverse(a: Column) -> Column:
    m = [[a[i][j] for j in range(3)] for i in range(3)]

    def cofactor(i, j):
        r = [k for k in range(3) if k != i]
        c = [k for k in range(3) if k != j]
        minor = m[r[0]][c[0]] * m[r[1]][c[1]] - m[r[0]][c[1]] * m[r[1]][c[0]]
        return minor if (i + j) % 2 == 0 else -minor

    det = m[0][0] * cofactor(0, 0) + m[0][1] * cofactor(0, 1) + m[0][2] * cofactor(0, 2)
    inv = [[cofactor(j, i) / det for j in range(3)] for i in range(3)]
    shift = [-(inv[i][0] * a[0][3] + inv[i][1] * a[1][3] + inv[i][2] * a[2][3]) for i in range(3)]
    return matrix([inv[i] + [shift[i]] for i in range(3)] + [[0, 0, 0, 1]])


def apply_affine(a: Column, x: Column, y: Column, z: Column) -> list[Column]:
    return [a[i][0] * x + a[i][1] * y + a[i][2] * z + a[i][3] for i in range(3)]


def shift_origin(a: Column, offsets: list[Column], sign: int = 1) -> Column:
    """Move the affine origin by ``sign * A * offsets`` (voxel units)."""
    moved = [[a[i][0], a[i][1], a[i][2],
              a[i][3] + sign * (a[i][0] * offsets[0] + a[i][1] * offsets[1] + a[i][2] * offsets[2])]
             for i in range(3)]
    return matrix(moved + [[0, 0, 0, 1]])


def affine_matrix(scaling=None, rotation=None, shearing=None, translation=None) -> Column:
    """translation * rot3 * rot2 * rot1 * shear * scale, angles in degrees.

    Each argument is a sequence of columns or numbers (3, 3, 6 and 3 values) or None.
    """
    lit = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    sc = [lit(v) for v in (scaling or (1, 1, 1))]
    ro = [F.radians(lit(v)) for v in (rotation or (0, 0, 0))]
    sh = [lit(v) for v in (shearing or (0,) * 6)]
    tr = [lit(v) for v in (translation or (0, 0, 0))]
    t = matrix([[1, 0, 0, tr[0]], [0, 1, 0, tr[1]], [0, 0, 1, tr[2]], [0, 0, 0, 1]])
    scale = matrix([[sc[0], 0, 0, 0], [0, sc[1], 0, 0], [0, 0, sc[2], 0], [0, 0, 0, 1]])
    shear = matrix([[1, sh[0], sh[1], 0], [sh[2], 1, sh[3], 0], [sh[4], sh[5], 1, 0], [0, 0, 0, 1]])
    c, s = [F.cos(r) for r in ro], [F.sin(r) for r in ro]
    r1 = matrix([[1, 0, 0, 0], [0, c[0], -s[0], 0], [0, s[0], c[0], 0], [0, 0, 0, 1]])
    r2 = matrix([[c[1], 0, s[1], 0], [0, 1, 0, 0], [-s[1], 0, c[1], 0], [0, 0, 0, 1]])
    r3 = matrix([[c[2], -s[2], 0, 0], [s[2], c[2], 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    return matmul(t, matmul(r3, matmul(r2, matmul(r1, matmul(shear, scale)))))


def ras_axes(a: Column) -> Column:
    """For each world axis the voxel axis that runs along it, made a permutation of 0..2.

    Per column of the inverse the row of the largest absolute entry; a missing axis then replaces the last
    occurrence of the most frequent (smallest on a tie) value.
    """
    inv = inverse_affine(a)
    return let(inv, _ras_from_inverse)


def _ras_from_inverse(inv: Column) -> Column:
    raw = []
    for col in range(3):
        mags = F.array(*[F.abs(inv[r][col]) for r in range(3)])
        raw.append((F.array_position(mags, F.array_max(mags)) - 1).cast("int"))
    axes = F.array(*raw)
    for i in range(3):
        axes = let(axes, lambda v: _fill_axis(v, i))
    return axes


def _fill_axis(v: Column, i: int) -> Column:
    counts = [F.size(F.filter(v, lambda e, k=k: e == k)) for k in range(3)]
    most = F.greatest(*counts)
    wrong = F.when(counts[0] == most, 0).when(counts[1] == most, 1).otherwise(2)
    last = F.lit(3) - F.array_position(F.reverse(v), wrong)
    fixed = F.transform(v, lambda e, k: F.when(k == last, F.lit(i)).otherwise(e))
    return F.when(F.array_contains(v, i), v).otherwise(fixed)


def blur_sigma(res: Column, target: Column, thickness: Column | None = None, coef: float | None = None) -> Column:
    """Standard deviation of the anti-aliasing blur before going from ``res`` to ``target`` on one axis."""
    down = F.least(target, thickness) if thickness is not None else target
    sigma = F.lit(0.75 if coef is None else coef) * down / res
    if coef is None:
        sigma = F.when(down == res, 0.5).otherwise(sigma)
    return F.when(down == 0, 0.0).otherwise(sigma)
