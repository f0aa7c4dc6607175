"""Flagship plan: FA laterality per subject from points, regions and maps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tractloom.functions import geometry as G
from tractloom.functions.laterality import li_columns
from tractloom.operators import extract


def fa_laterality(points: DataFrame, grid: G.Grid, roi_voxels: DataFrame, maps: DataFrame,
                  band: tuple[float, float]) -> DataFrame:
    """Select left and right streamlines, average FA per streamline, compare the sides.

    Vertices are exchanged once by voxel (regions and FA joined together) and once by streamline
    block (lengths); everything after is one row per streamline. A subject without selected
    streamlines keeps its row; an empty side is 0.
    """
    t = extract.assign_fates(extract.streamline_table(points, grid, roi_voxels, maps.select(
        "subject_id", "i", "j", "k", "fa"), ("fa",)), band)
    g = t.groupBy("subject_id").agg(
        *[F.coalesce(f(F.when(F.col("fate") == s, F.col("fa_mean"))), F.lit(0)).alias(f"{s}_{n}")
          for s in ("left", "right") for n, f in (("n", F.count), ("fa", F.avg))])
    return g.select("subject_id", "left_n", "right_n", "left_fa", "right_fa",
                    *[c.alias(n) for n, c in li_columns(F.col("left_fa"), F.col("right_fa")).items()])
