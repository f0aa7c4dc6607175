"""Displacement fields and grid-to-grid label resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tractloom.functions import geometry as G
from tractloom.functions.numeric import count_if, lit

VOX = ["subject_id", "i", "j", "k"]


def jacobian(field: DataFrame, spacing: tuple[Column, Column, Column]) -> DataFrame:
    """Determinant of I + grad(u) of a displacement field (ux, uy, uz in mm) per voxel.

    Central differences where both neighbours are there, one-sided where one is missing (at the ends
    of a line and beside gaps of a sparse field), no change along an axis without any. Each window
    runs along one voxel line, which is as long as the grid's edge.
    """
    d = field.withColumns({f"_s{a}": s for a, s in zip("ijk", spacing)})
    for axis in "ijk":
        w = Window.partitionBy("subject_id", *[a for a in "ijk" if a != axis]).orderBy(axis)
        step = F.col(f"_s{axis}")
        grads = {}
        for u in ("ux", "uy", "uz"):
            before = F.when(F.lag(axis).over(w) == F.col(axis) - 1, F.lag(u).over(w))
            after = F.when(F.lead(axis).over(w) == F.col(axis) + 1, F.lead(u).over(w))
            grads[f"_{u}{axis}"] = F.coalesce((after - before) / (step * lit(2.0)), (after - F.col(u)) / step, (F.col(u) - before) / step, lit(0.0))
        d = d.withColumns(grads)
    g = {(u, a): F.col(f"_u{u}{a}") for u in "xyz" for a in "ijk"}
    one = lit(1.0)
    det = ((one + g["x", "i"]) * ((one + g["y", "j"]) * (one + g["z", "k"]) - g["y", "k"] * g["z", "j"])
           - g["x", "j"] * (g["y", "i"] * (one + g["z", "k"]) - g["y", "k"] * g["z", "i"])
           + g["x", "k"] * (g["y", "i"] * g["z", "j"] - (one + g["y", "j"]) * g["z", "i"]))
    return d.withColumn("det", det).drop(*[f"_s{a}" for a in "ijk"], *[f"_u{u}{a}" for u in "xyz" for a in "ijk"])


def jacobian_sides(dets: DataFrame, left: Column) -> DataFrame:
    """Mean, std and percentage below 0 of the determinant left and right."""
    d = dets.withColumn("side", F.when(left, "left").otherwise("right"))
    return d.groupBy("subject_id", "side").agg(
        F.avg("det").alias("mean"), F.stddev_pop("det").alias("std"),
        (count_if(F.col("det") < 0) / F.count(F.lit(1)) * 100).alias("negative_pct"))


def resample_labels(target: DataFrame, target_grid: G.Grid | None, source: DataFrame, source_grid: G.Grid,
                    field: DataFrame | None = None) -> DataFrame:
    """Label of the source voxel nearest to each target voxel; 0 outside the source.

    With ``field`` each target world point is moved by its displacement first.
    """
    w = G.world_coords(target_grid, (F.col("i"), F.col("j"), F.col("k")))
    t = target.select(*VOX, *[c.alias(n) for c, n in zip(w, ("wx", "wy", "wz"))])
    if field is not None:
        t = t.join(field.select(*VOX, "ux", "uy", "uz"), VOX, "left").withColumns({
            w: F.col(w) + F.coalesce(u, lit(0.0)) for w, u in (("wx", "ux"), ("wy", "uy"), ("wz", "uz"))})
    s = G.nearest_voxel(source_grid, (F.col("wx"), F.col("wy"), F.col("wz")))
    t = t.select(*VOX, *[c.alias(f"s{a}") for c, a in zip(s, "ijk")])
    lab = source.where("label <> 0").select("subject_id", *[F.col(a).alias(f"s{a}") for a in "ijk"], "label")
    return t.join(lab, ["subject_id", "si", "sj", "sk"], "left").select(*VOX, F.coalesce("label", F.lit(0)).cast("int").alias("label"))
