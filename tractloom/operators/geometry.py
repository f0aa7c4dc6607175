"""Point-to-voxel mapping, bounds, orientation and coordinate-space checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tractloom.functions import geometry as G
from tractloom.functions.numeric import lit


def voxelise(points: DataFrame, grid: G.Grid | None) -> DataFrame:
    """add i, j, k and ``inb``. ``grid=None`` uses columns from ``attach_grid``."""
    i, j, k = G.nearest_voxel(grid, (F.col("x"), F.col("y"), F.col("z")))
    p = points.withColumns({"i": i, "j": j, "k": k})
    return p.withColumn("inb", G.in_bounds(grid, F.col("i"), F.col("j"), F.col("k")))


def voxels_to_world(voxels: DataFrame, grid: G.Grid | None) -> DataFrame:
    """add wx, wy, wz."""
    w = G.world_coords(grid, (F.col("i"), F.col("j"), F.col("k")))
    return voxels.withColumns(dict(zip(("wx", "wy", "wz"), w)))


def _bounds(grids: DataFrame, corners: list[tuple[int, int, int]]) -> DataFrame:
    n = [F.col(c).cast("double") for c in ("nx", "ny", "nz")]
    out = {}
    for r, axis in enumerate("xyz"):
        vals = [sum((F.col("affine")[r * 4 + c] * n[c] for c in range(3) if corner[c]),
                    F.col("affine")[r * 4 + 3]) for corner in corners]
        out[f"{axis}_min"], out[f"{axis}_max"] = F.least(*vals), F.greatest(*vals)
    return grids.withColumns(out)


def world_bounds(grids: DataFrame) -> DataFrame:
    """world box of each grid from its 8 corners (0 and shape)."""
    return _bounds(grids, [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)])


def five_corner_bounds(grids: DataFrame) -> DataFrame:
    """The box coordinate validation uses: origin, three axis ends and the far corner."""
    return _bounds(grids, [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 1)])


# --------------------------------------------------------------------------- orientation

def _m(r: int, c: int) -> Column:
    return F.col("affine")[r * 4 + c]


def axis_world_x_sign(voxel_axis: int) -> Column:
    """+1/-1 when the voxel axis runs along world x, 0 when x is not its largest component."""
    x, y, z = (_m(r, voxel_axis) for r in range(3))
    return (F.when(F.abs(x) < F.greatest(F.abs(y), F.abs(z)), 0)
            .when(x > 0, 1).when(x < 0, -1).otherwise(0).cast("int"))


def shows_left_on_right(voxel_axis: int) -> Column:
    return axis_world_x_sign(voxel_axis) < 0


def ras_axes(grids: DataFrame) -> DataFrame:
    """World axis (0..2) and flip of each voxel axis, largest scaled component first.

    Columns ``axis_0..2`` (world axis the voxel axis maps to) and ``flip_0..2`` (+1/-1).
    """
    def norm(c: int) -> Column:
        return F.sqrt(_m(0, c) * _m(0, c) + _m(1, c) * _m(1, c) + _m(2, c) * _m(2, c))

    g = grids.withColumns({f"_a{r}{c}": F.abs(_m(r, c)) / norm(c) for r in range(3) for c in range(3)})
    perms = [(0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)]
    scored = [F.struct(sum((F.col(f"_a{p[c]}{c}") for c in range(3)), lit(0.0)).alias("score"),
                       F.lit(-rank).alias("rank"), *[F.lit(p[c]).alias(f"p{c}") for c in range(3)])
              for rank, p in enumerate(perms)]
    g = g.withColumn("_best", F.array_max(F.array(*scored)))
    g = g.withColumns({f"axis_{c}": F.col(f"_best.p{c}") for c in range(3)})
    g = g.withColumns({f"flip_{c}": F.when(F.col("affine")[F.col(f"axis_{c}") * 4 + c] < 0, -1)
                       .otherwise(1) for c in range(3)})
    return g.drop("_best", *[f"_a{r}{c}" for r in range(3) for c in range(3)])


def to_ras(voxels: DataFrame) -> DataFrame:
    """i, j, k renumbered to the right-anterior-superior order; needs ``ras_axes`` columns."""
    idx = [F.col(c) for c in "ijk"]
    n = [F.col(f"n{c}") for c in "xyz"]
    turned = [F.when(F.col(f"flip_{c}") < 0, n[c] - 1 - idx[c]).otherwise(idx[c]) for c in range(3)]

    def at(world: int) -> Column:
        e = F
        for c in range(3):
            e = e.when(F.col(f"axis_{c}") == world, turned[c])
        return e.cast("int")

    return voxels.withColumns({f"{a}_ras": at(w) for w, a in enumerate("ijk")})


def from_ras(voxels: DataFrame) -> DataFrame:
    """F11 inverse: back to the stored order from i_ras, j_ras, k_ras."""
    ras = F.array("i_ras", "j_ras", "k_ras")
    n = [F.col(f"n{c}") for c in "xyz"]
    out = {}
    for c, name in enumerate("ijk"):
        v = ras[F.col(f"axis_{c}")]
        out[name] = F.when(F.col(f"flip_{c}") < 0, n[c] - 1 - v).otherwise(v).cast("int")
    return voxels.withColumns(out)


# ------------------------------------------------------------------------ bundle extents

def plane_limits(points: DataFrame, subjects: DataFrame, a: str, b: str,
                 fallback: tuple[tuple[float, float], tuple[float, float]]) -> DataFrame:
    """min/max on two axes padded by 5 % (1.0 for a flat range), fallback for no points."""
    g = points.groupBy("subject_id").agg(*[f(c).alias(f"{n}_{c}") for c in (a, b)
                                           for n, f in (("lo", F.min), ("hi", F.max))])
    g = subjects.join(g, "subject_id", "left")
    out = {}
    for c, (flo, fhi) in zip((a, b), fallback):
        lo, hi = F.coalesce(F.col(f"lo_{c}"), lit(flo)), F.coalesce(F.col(f"hi_{c}"), lit(fhi))
        pad = F.when(hi - lo != 0, (hi - lo) * lit(0.05)).otherwise(lit(1.0))
        out[f"{c}_min"], out[f"{c}_max"] = lo - pad, hi + pad
    return g.select("subject_id", *[v.alias(k) for k, v in out.items()])


def validate_coordinates(points: DataFrame, grids: DataFrame, margin: float = 15.0) -> DataFrame:
    """Per subject, whether the bundle is in world space and inside its reference box."""
    box = points.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("n_points"),
        *[f(c).alias(f"p{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))])
    d = five_corner_bounds(grids).join(box, "subject_id", "left")
    lows, highs = [F.col(f"pmin_{c}") for c in "xyz"], [F.col(f"pmax_{c}") for c in "xyz"]
    span = F.greatest(*[h - lo for lo, h in zip(lows, highs)])
    voxel_space = (F.least(*lows) >= -1) & (F.greatest(*highs) < 300) & (span < 260)
    outside = F.array_compact(F.array(*[
        F.when((F.col(f"pmin_{c}") < F.col(f"{c}_min") - margin)
               | (F.col(f"pmax_{c}") > F.col(f"{c}_max") + margin), F.lit(c)) for c in "xyz"]))
    d = d.withColumns({"n_points": F.coalesce("n_points", F.lit(0)), "voxel_space": F.coalesce(voxel_space, F.lit(False)),
                       "outside_axes": F.array_join(outside, ","), "n_outside": F.size(outside)})
    errors = F.array_compact(F.array(
        F.when(F.col("voxel_space"), "voxel_space"), F.when(F.col("n_outside") > 1, "outside_box")))
    warnings = F.array_compact(F.array(
        F.when(F.col("n_points") == 0, "empty"), F.when(F.col("voxel_space"), "voxel_space"),
        F.when(F.col("n_outside") > 0, F.concat(F.lit("beyond_"), F.col("outside_axes")))))
    return d.select("subject_id", "n_points", F.size(errors).alias("n_errors"),
                    F.array_join(errors, ";").alias("errors"), F.array_join(warnings, ";").alias("warnings"),
                    (F.size(errors) == 0).alias("valid"))
