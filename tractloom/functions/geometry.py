"""Affine arithmetic as column expressions.

A grid is either one :class:`Grid` value (every subject in the same template space, its numbers
become literals) or a DataFrame with one row per subject, attached by ``attach_grid``; in that
form ``affine`` is a row-major ARRAY<DOUBLE> of 16 and ``nx, ny, nz`` the shape.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from tractloom.functions.numeric import lit

Row3 = tuple[Column, Column, Column]


@dataclass(frozen=True)
class Grid:
    """One voxel grid: 4x4 affine (rows) and shape."""

    affine: tuple[tuple[float, ...], ...]
    shape: tuple[int, int, int]

    def inverse(self) -> list[list[float]]:
        """3x4 rows of the inverse affine."""
        m = self.affine
        a = [row[:3] for row in m[:3]]
        t = [row[3] for row in m[:3]]
        cof = [[a[(r + 1) % 3][(c + 1) % 3] * a[(r + 2) % 3][(c + 2) % 3]
                - a[(r + 1) % 3][(c + 2) % 3] * a[(r + 2) % 3][(c + 1) % 3]
                for c in range(3)] for r in range(3)]
        det = sum(a[0][c] * cof[0][c] for c in range(3))
        inv = [[cof[c][r] / det for c in range(3)] for r in range(3)]
        return [[*inv[r], -sum(inv[r][c] * t[c] for c in range(3))] for r in range(3)]

    @property
    def voxel_size(self) -> tuple[float, float, float]:
        return tuple(sum(self.affine[r][c] ** 2 for r in range(3)) ** 0.5 for c in range(3))

    @property
    def voxel_volume(self) -> float:
        sx, sy, sz = self.voxel_size
        return sx * sy * sz


def _affine_row(row: list[float], p: Row3) -> Column:
    terms = [p[c] if row[c] == 1.0 else lit(row[c]) * p[c] for c in range(3) if row[c] != 0.0]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out if row[3] == 0.0 else out + lit(row[3])


def attach_grid(df: DataFrame, grids: DataFrame) -> DataFrame:
    """Add each subject's grid columns and the inverse affine (``inv``, 12 numbers).

    Grids are hashed where their subject's rows are: they grow with the subjects, so they never pass
    the driver, and the rows neither are sorted nor move if they lie by subject already.
    """
    return df.join(with_inverse(grids).hint("shuffle_hash"), ["subject_id"])


def with_inverse(grids: DataFrame) -> DataFrame:
    """Invert the affine once per grid row, by cofactors."""
    def a(r: int, c: int) -> Column:
        return F.col("affine")[r * 4 + c]

    def cof(r: int, c: int) -> Column:
        r1, r2, c1, c2 = (r + 1) % 3, (r + 2) % 3, (c + 1) % 3, (c + 2) % 3
        return a(r1, c1) * a(r2, c2) - a(r1, c2) * a(r2, c1)

    det = a(0, 0) * cof(0, 0) + a(0, 1) * cof(0, 1) + a(0, 2) * cof(0, 2)
    g = grids.withColumn("_det", det)
    g = g.withColumn("_i", F.array(*[cof(c, r) / F.col("_det") for r in range(3) for c in range(3)]))

    def shift(r: int) -> Column:
        i = F.col("_i")
        return -(i[r * 3] * a(0, 3) + i[r * 3 + 1] * a(1, 3) + i[r * 3 + 2] * a(2, 3))

    inv = [x for r in range(3) for x in (*[F.col("_i")[r * 3 + c] for c in range(3)], shift(r))]
    return g.withColumn("inv", F.array(*inv)).drop("_det", "_i")


def apply_rows(m: Column, p: Row3) -> Row3:
    """First three rows of an affine array column times the point ``p``."""
    return tuple(m[r * 4] * p[0] + m[r * 4 + 1] * p[1] + m[r * 4 + 2] * p[2] + m[r * 4 + 3]
                 for r in range(3))


def voxel_coords(grid: Grid | None, p: Row3) -> Row3:
    """Unrounded voxel coordinates of a world point (F1, drawing form)."""
    if grid is None:
        return apply_rows(F.col("inv"), p)
    return tuple(_affine_row(row, p) for row in grid.inverse())


def nearest_voxel(grid: Grid | None, p: Row3) -> Row3:
    """Voxel indices of a world point, rounded half to even (F1)."""
    return tuple(F.rint(c).cast("int") for c in voxel_coords(grid, p))


def world_coords(grid: Grid | None, v: Row3) -> Row3:
    """World coordinates of a voxel (F2)."""
    v = tuple(c.cast("double") for c in v)
    if grid is None:
        return apply_rows(F.col("affine"), v)
    return tuple(_affine_row(list(grid.affine[r]), v) for r in range(3))


def in_bounds(grid: Grid | None, i: Column, j: Column, k: Column) -> Column:
    """0 <= index < shape on all axes."""
    n = (F.col("nx"), F.col("ny"), F.col("nz")) if grid is None else tuple(map(F.lit, grid.shape))
    return (i >= 0) & (i < n[0]) & (j >= 0) & (j < n[1]) & (k >= 0) & (k < n[2])


def voxel_size_columns(affine: Column) -> Row3:
    """Voxel edge lengths = column norms of the affine."""
    return tuple(F.sqrt(affine[c] * affine[c] + affine[4 + c] * affine[4 + c]
                        + affine[8 + c] * affine[8 + c]) for c in range(3))
