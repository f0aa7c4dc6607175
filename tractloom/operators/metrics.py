"""Metrics of a bundle: morphology, sampled scalars, profile, regions and side comparison.

Bundles are ``points`` with a ``side`` column; results are per (subject, side). A streamline in both
sides is there twice, so streamlines are identified by subject, side and id.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from tractloom import constants as C
from tractloom.functions import geometry as G
from tractloom.functions.laterality import li_columns
from tractloom.functions.numeric import lit
from tractloom.functions.ranking import exact_percentiles, two_stage_rank
from tractloom.functions.stage import materialize
from tractloom.operators.geometry import voxelise
from tractloom.operators.streamlines import BLOCK, KEY, arc_lengths, orient

VOX = ["subject_id", "i", "j", "k"]
SIDE = ["subject_id", "side"]
SKEY = ["subject_id", "side", "streamline_id"]
STATS = ("mean", "std", "median", "min", "max")


def bundle_points(points: DataFrame, sides: DataFrame) -> DataFrame:
    """Vertices of the streamlines listed in ``sides`` (subject_id, streamline_id, side)."""
    return points.join(sides.select(*KEY, "side"), KEY)


def sample(vox_points: DataFrame, maps: DataFrame, scalars: tuple[str, ...] = C.SCALARS) -> DataFrame:
    """Nearest-voxel value of each map at every in-bounds vertex (0 where a map is sparse)."""
    p = vox_points.where("inb").drop("inb", "x", "y", "z")
    s = p.join(maps.select(*VOX, *scalars), VOX, "left")
    return s.withColumns({c: F.coalesce(c, lit(0.0)) for c in scalars})


def per_streamline(samples: DataFrame, scalars: tuple[str, ...] = C.SCALARS) -> DataFrame:
    """A4: mean of each map over a streamline's samples; streamlines without samples are absent."""
    return samples.groupBy(*SIDE, "streamline_id").agg(*[F.avg(c).alias(c) for c in scalars])


def _long(df: DataFrame, keys: list[str], scalars: tuple[str, ...]) -> DataFrame:
    return df.unpivot(keys, list(scalars), "scalar", "value")


def _stats(df: DataFrame, scalars: tuple[str, ...], prefix: str, n_name: str) -> DataFrame:
    """mean, std, min, max, n of all maps in one pass over the wide rows, medians on long rows."""
    wide = df.groupBy(*SIDE).agg(*[
        f(c).alias(f"{c}__{n}") for c in scalars
        for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max), ("n", F.count))])
    rows = [F.struct(F.lit(c).alias("scalar"), *[F.col(f"{c}__{n}").alias(f"{prefix}{n}") for n in ("mean", "std", "min", "max")],
                     F.col(f"{c}__n").alias(n_name)) for c in scalars]
    base = wide.select(*SIDE, F.inline(F.array(*rows)))
    med = exact_percentiles(_long(df, SIDE, scalars), [*SIDE, "scalar"], F.col("value"), {f"{prefix}median": 0.5})
    return base.join(med, [*SIDE, "scalar"])


def both_sides(subjects: DataFrame) -> DataFrame:
    """Left and right of every subject."""
    return subjects.select("subject_id", F.explode(F.array(F.lit("left"), F.lit("right"))).alias("side"))


def fill_sides(stats: DataFrame, subjects: DataFrame | None, **more: list) -> DataFrame:
    """Statistics of nothing are 0: a row for each side of each subject (and each value of ``more``), zeros where it has none."""
    if subjects is None:
        return stats
    every = both_sides(subjects)
    for name, values in more.items():
        every = every.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return every.join(stats, [*SIDE, *more], "left").na.fill(0)


def scalar_summary(samples: DataFrame, scalars: tuple[str, ...] = C.SCALARS, subjects: DataFrame | None = None) -> DataFrame:
    """A5: headline over streamline means (one vote each) and the pool of all samples.

    With ``subjects`` (subject_id) every side of each has its rows, zeros without samples.
    """
    samples = materialize(samples.select(*SKEY, *scalars))
    head = _stats(materialize(per_streamline(samples, scalars)), scalars, "", "n_streamlines")
    pool = _stats(samples, scalars, "pool_", "n_samples")
    return fill_sides(head.join(pool, [*SIDE, "scalar"]), subjects, scalar=list(scalars))


def morphology(bundle: DataFrame, vox_points: DataFrame, voxel_volume: Column, subjects: DataFrame | None = None) -> DataFrame:
    """A2: streamline count, length statistics, volume of distinct voxels (not bounds-checked); zeros for an empty side of ``subjects``."""
    a = arc_lengths(bundle.select(*SKEY, "pt_idx", "x", "y", "z"), SKEY).groupBy(*SIDE).agg(
        F.count(F.lit(1)).alias("n_streamlines"), F.avg("length").alias("mean_length"),
        F.stddev_pop("length").alias("std_length"), F.min("length").alias("min_length"),
        F.max("length").alias("max_length"))
    v = vox_points.select(*SIDE, "i", "j", "k").distinct().groupBy(*SIDE).agg(F.count(F.lit(1)).alias("n_voxels"))
    return fill_sides(a.join(v, SIDE).withColumn("tract_volume", F.col("n_voxels") * voxel_volume).drop("n_voxels"), subjects)


def tract_profile(bundle: DataFrame, grid: G.Grid | None, maps: DataFrame,
                  scalars: tuple[str, ...] = C.SCALARS, n_points: int = C.PROFILE_POINTS, subjects: DataFrame | None = None) -> DataFrame:
    """Mean value at ``n_points`` places along the lower-to-upper oriented tract; zeros for an empty side of ``subjects``.

    Which samples a streamline gives to which place depends only on how many it has, so the
    places (and interpolation weights of short streamlines) are fixed before any map is read and
    at most two rows per place and streamline meet the maps.
    """
    v = voxelise(orient(bundle.select(*SKEY, "pt_idx", "x", "y", "z"), SKEY), grid).where("inb").select(*SKEY, "pt_idx", "i", "j", "k")
    r = two_stage_rank(v, SKEY, F.floor(F.col("pt_idx") / BLOCK), [F.col("pt_idx")], out="r", total="n")
    r = r.where(F.col("n") >= C.PROFILE_MIN_SAMPLES)
    m = n_points - 1
    gap = F.col("n") - 1

    def first_place(rank: Column) -> Column:
        return F.ceil(rank * m / gap)

    def weighted(lo: Column, hi: Column, w) -> Column:
        return F.when(lo <= hi, F.transform(F.sequence(lo, hi), lambda p: F.struct(
            p.cast("int").alias("place"), w(p).alias("w"))))

    def frac(p: Column) -> Column:
        return (p * gap % m).cast("double") / lit(m)

    rank = F.col("r")
    last = F.least(first_place(rank + 1) - 1, F.lit(m))
    here = F.when(F.col("n") >= n_points, weighted(first_place(rank), last, lambda p: lit(1.0))) \
        .otherwise(weighted(first_place(rank), last, lambda p: lit(1.0) - frac(p)))
    before = F.when((F.col("n") < n_points) & (rank >= 1),
                    weighted(first_place(rank - 1), first_place(rank) - 1, frac))
    empty = F.array().cast("array<struct<place:int,w:double>>")
    e = r.withColumn("_p", F.explode(F.concat(F.coalesce(here, empty), F.coalesce(before, empty))))
    e = e.select(*SIDE, "i", "j", "k", "_p.place", "_p.w").where("w > 0")
    e = e.groupBy(*SIDE, "i", "j", "k", "place").agg(F.sum("w").alias("w"))
    e = e.join(maps.select(*VOX, *scalars), VOX, "left")
    g = e.groupBy(*SIDE, "place").agg(*[
        (F.sum(F.coalesce(F.col(c), lit(0.0)) * F.col("w")) / F.sum("w")).alias(c) for c in scalars])
    return _long(fill_sides(g, subjects, place=list(range(n_points))), [*SIDE, "place"], scalars)


def region_means(profile: DataFrame, n_points: int = C.PROFILE_POINTS) -> DataFrame:
    """Mean of the profile in each nominal region of the tract."""
    region = reduce(lambda e, r: e.when(F.col("place") < int(r[2] * n_points), r[0]), C.TRACT_REGIONS, F)
    p = profile.withColumn("region", region)
    return p.groupBy(*SIDE, "scalar", "region").agg(F.avg("value").alias("value"))


def metrics_long(bundle: DataFrame, grid: G.Grid, maps: DataFrame,
                 scalars: tuple[str, ...] = C.SCALARS, subjects: DataFrame | None = None, profile: DataFrame | None = None) -> DataFrame:
    """All metrics of a bundle as (subject_id, side, metric, value); zeros for an empty side of ``subjects``.

    ``profile`` is the bundle's ``tract_profile`` where the caller needs it too, so it is made once.
    """
    v = materialize(voxelise(bundle, grid))
    bundle = v
    morph = morphology(bundle, v, lit(grid.voxel_volume), subjects).unpivot(
        SIDE, ["n_streamlines", "mean_length", "std_length", "min_length", "max_length", "tract_volume"], "metric", "value")
    summ = scalar_summary(sample(v, maps, scalars), scalars, subjects).withColumnRenamed("n_streamlines", "n_sampled")
    summ = summ.withColumns({c: F.col(c).cast("double") for c in ("n_sampled", "n_samples")})
    summ = summ.unpivot([*SIDE, "scalar"], [c for c in summ.columns if c not in (*SIDE, "scalar")], "stat", "value") \
        .select(*SIDE, F.concat_ws("_", "scalar", "stat").alias("metric"), "value")
    if profile is None:
        profile = tract_profile(bundle, grid, maps, scalars, subjects=subjects)
    reg = region_means(profile) \
        .select(*SIDE, F.concat_ws("_", "scalar", "region").alias("metric"), "value")
    return morph.unionByName(summ).unionByName(reg)


def comparison_metrics(scalars: tuple[str, ...] = C.SCALARS) -> dict[str, str]:
    """The 19 compared quantities: name in the comparison -> metric."""
    out = {"volume": "tract_volume", "streamline_count": "n_streamlines", "mean_length": "mean_length"}
    out |= {s: f"{s}_mean" for s in scalars}
    return out | {f"{s}_{r}": f"{s}_{r}" for s in scalars for r, _, _ in C.TRACT_REGIONS}


def compare_sides(metrics: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
    """Left and right value of each compared metric with its laterality row.

    Both sides of a metric meet in one grouped pass; a side without the metric counts as 0.
    """
    names = names or comparison_metrics()
    label = F.create_map(*[F.lit(x) for name, metric in names.items() for x in (metric, name)])
    m = metrics.where(F.col("metric").isin(*names.values()))
    g = m.groupBy("subject_id", "metric").agg(
        *[F.coalesce(F.max(F.when(F.col("side") == s, F.col("value"))), lit(0.0)).alias(f"{s}_value") for s in ("left", "right")])
    return g.select("subject_id", label[F.col("metric")].alias("quantity"), "left_value", "right_value",
                    *[c.alias(n) for n, c in li_columns(F.col("left_value"), F.col("right_value")).items()])
