"""Quality-control numbers of tracking and preprocessing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tractloom import constants as C
from tractloom.functions.numeric import count_if, lit, ratio
from tractloom.functions.ranking import exact_percentiles, summary_stats, two_stage_rank, with_buckets

S = ["subject_id"]


def tracking_report(lengths: DataFrame, n_seeds: DataFrame) -> DataFrame:
    """Length statistics with quartiles, vertices per streamline and yield per subject.

    ``lengths``: subject_id, streamline_id, length, n_points; ``n_seeds``: subject_id, n_seeds.
    """
    st = summary_stats(lengths, S, F.col("length"), {"median": 0.5, "p25": 0.25, "p75": 0.75}, "length_")
    pts = lengths.groupBy(*S).agg(F.avg("n_points").alias("points_mean"), F.min("n_points").alias("points_min"), F.max("n_points").alias("points_max"))
    d = n_seeds.join(st, S, "left").join(pts, S, "left").withColumnRenamed("length_n", "count").na.fill(0)
    return d.withColumn("yield_pct", ratio(F.col("count") * 100, F.col("n_seeds"), 0.0))


def positive_voxel_stats(maps: DataFrame, scalars: tuple[str, ...] = C.SCALARS) -> DataFrame:
    """Mean, std, median of each map over its voxels above 0."""
    lng = maps.unpivot(S, list(scalars), "scalar", "value").where("value > 0")
    return summary_stats(lng, [*S, "scalar"], F.col("value")).select(*S, "scalar", "n", "mean", "std", "median")


def length_distribution(lengths: DataFrame) -> DataFrame:
    """Percentage of a subject's streamlines up to each one in order of length."""
    d = with_buckets(lengths, S, F.col("length"), "_by_length", tie=F.col("streamline_id"))
    r = two_stage_rank(d, S, F.col("_by_length"), [F.col("length"), F.col("streamline_id")], out="_r", total="_n")
    return r.select(*S, "streamline_id", "length", ((F.col("_r") + 1) / F.col("_n") * 100).alias("cumulative_pct"))


def subsample(items: DataFrame, max_n: int, seed: int = C.RANDOM_SEED, keys: tuple[str, ...] = ("subject_id",), id_col: str = "streamline_id") -> DataFrame:
    """At most ``max_n`` items per key, the same ones on every run.

    Items are ordered by a seeded hash; ``row_number() <= max_n`` is applied per task before the
    shuffle, so a large key never moves as a whole.
    """
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    w = Window.partitionBy(*keys).orderBy(h, id_col)
    return items.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= max_n).drop("_r")


def motion(affines: DataFrame) -> DataFrame:
    """Translation (mm) and rotation (degrees) of each volume, and relative to volume 0.

    ``affines``: subject_id, vol_idx, affine (ARRAY of 16). Volume 0 comes back by a join on the
    subject's block of volumes, so no subject is windowed as a whole.
    """
    def m(r: int, c: int) -> Column:
        return F.col("affine")[r * 4 + c]

    deg = F.lit(180.0) / F.lit(3.141592653589793)
    d = affines.withColumns({
        "tx": m(0, 3), "ty": m(1, 3), "tz": m(2, 3),
        "roll": F.atan2(m(2, 1), m(2, 2)) * deg,
        "pitch": F.atan2(-m(2, 0), F.sqrt(m(2, 1) * m(2, 1) + m(2, 2) * m(2, 2))) * deg,
        "yaw": F.atan2(m(1, 0), m(0, 0)) * deg}).drop("affine")
    names = ("tx", "ty", "tz", "roll", "pitch", "yaw")
    d = d.withColumn("_b", F.floor(F.col("vol_idx") / 512).cast("int"))
    last = d.groupBy(*S).agg(F.max("_b").alias("_last"))
    zero = d.where("vol_idx = 0").select(*S, *[F.col(n).alias(f"{n}_0") for n in names]).join(last, S)
    zero = zero.withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_last")))).drop("_last")
    r = d.join(zero, [*S, "_b"])
    return r.withColumns({f"{n}_rel": F.col(n) - F.col(f"{n}_0") for n in names}).drop("_b", *[f"{n}_0" for n in names])


def motion_summary(affines: DataFrame) -> DataFrame:
    """Largest absolute relative displacement and rotation of a subject."""
    r = motion(affines)
    return r.groupBy(*S).agg(
        F.count(F.lit(1)).alias("n_volumes"),
        F.max(F.greatest(*[F.abs(f"{n}_rel") for n in ("tx", "ty", "tz")])).alias("max_displacement"),
        F.max(F.greatest(*[F.abs(f"{n}_rel") for n in ("roll", "pitch", "yaw")])).alias("max_rotation"))


def residuals(volumes: DataFrame) -> DataFrame:
    """Inside the brain mean and std before and after, mean and 99th percentile of the
    absolute difference; mask coverage of the whole grid.

    ``volumes``: subject_id, i, j, k, before, after, brain.
    """
    brain = volumes.where("brain").withColumn("diff", F.abs(F.col("before") - F.col("after")))
    g = volumes.groupBy(*S).agg(F.count(F.lit(1)).alias("total_voxels"), count_if(F.col("brain")).alias("brain_voxels"))
    b = brain.groupBy(*S).agg(*[f(c).alias(f"{c}_{n}") for c in ("before", "after") for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
                              F.avg("diff").alias("diff_mean"))
    p = exact_percentiles(brain, S, F.col("diff"), {"diff_p99": 0.99})
    return (g.join(b, S, "left").join(p, S, "left")
            .withColumn("coverage_pct", F.col("brain_voxels") / F.col("total_voxels") * lit(100.0)))
