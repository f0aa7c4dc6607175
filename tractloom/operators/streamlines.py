"""Operators along a streamline.

A streamline is a run of ``points`` rows with a dense 0-based ``pt_idx``. Work along it is done in
blocks of ``BLOCK`` vertices: windows are partitioned by (streamline, block), the last vertex of a
block is repeated at the head of the next one, and values of the whole streamline come back to its
vertices through a join on the same block key. So no window ever spans more than one block and a
streamline of any length is spread over tasks; for ordinary lengths there is just block 0.

``key`` names the columns that identify a streamline; bundles add ``side``, since one streamline
may be in both.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tractloom.functions.numeric import lit

BLOCK = 512
KEY = ["subject_id", "streamline_id"]


def block_of() -> Column:
    return F.floor(F.col("pt_idx") / F.lit(BLOCK)).cast("int")


def with_previous(points: DataFrame, cols: list[str], key: list[str] = KEY) -> DataFrame:
    """Add ``prev_<col>`` from the vertex before (NULL at the first) and ``block``."""
    b = block_of()
    halo = points.withColumn("block", F.explode(
        F.when(F.col("pt_idx") % BLOCK == BLOCK - 1, F.array(b, b + 1)).otherwise(F.array(b))))
    w = Window.partitionBy(*key, "block").orderBy("pt_idx")
    return (halo.select("*", *[F.lag(c).over(w).alias(f"prev_{c}") for c in cols])
            .where(F.col("pt_idx") >= F.col("block") * BLOCK))


def segment_lengths(points: DataFrame, keep_prev: bool = False, key: list[str] = KEY) -> DataFrame:
    """Vertices with ``seg``, the distance from the vertex before (0 at the first)."""
    p = with_previous(points, ["x", "y", "z"], key)
    d = [F.col(a) - F.col(f"prev_{a}") for a in "xyz"]
    seg = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    p = p.withColumn("seg", F.coalesce(seg, lit(0.0)))
    return p if keep_prev else p.drop("prev_x", "prev_y", "prev_z")


def arc_lengths(points: DataFrame, key: list[str] = KEY) -> DataFrame:
    """A1: vertex count and arc length per streamline (0 for a single vertex)."""
    return segment_lengths(points, key=key).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_points"), F.sum("seg").alias("length"))


def length_band(lengths: DataFrame, low: float, high: float) -> DataFrame:
    """keep low <= length <= high."""
    return lengths.where(F.col("length").between(low, high))


def per_block(stats: DataFrame, n: str = "n_points") -> DataFrame:
    """One copy of a streamline's row per block, for joins back to its vertices."""
    last = F.floor((F.col(n) - 1) / BLOCK).cast("int")
    return stats.withColumn("block", F.explode(F.sequence(F.lit(0), last)))


def join_back(points: DataFrame, stats: DataFrame, n: str = "n_points", key: list[str] = KEY) -> DataFrame:
    """Attach per-streamline columns to the vertices of that streamline."""
    if "block" not in points.columns:
        points = points.withColumn("block", block_of())
    return points.join(per_block(stats, n), [*key, "block"])


def endpoints(points: DataFrame) -> DataFrame:
    """First and last vertex of each streamline as structs ``start`` and ``end``."""
    p = F.struct("x", "y", "z")
    return points.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min_by(p, "pt_idx").alias("start"), F.max_by(p, "pt_idx").alias("end"))


def orientation(points: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Whether a streamline has to be turned round to run from its lower to its upper end.

    Compares the mean of the last quarter with that of the first on z, ties on y, then x.
    """
    n = points.groupBy(*key).agg(F.count(F.lit(1)).alias("n_points"))
    p = join_back(points, n, key=key)
    k = F.greatest(F.lit(1), F.floor(F.col("n_points") / 4))
    head, tail = F.col("pt_idx") < k, F.col("pt_idx") >= F.col("n_points") - k
    d = p.groupBy(*key).agg(F.max("n_points").alias("n_points"), *[
        (F.avg(F.when(tail, F.col(a))) - F.avg(F.when(head, F.col(a)))).alias(f"d{a}") for a in "zyx"])
    delta = (F.when(F.col("dz") != 0, F.col("dz")).when(F.col("dy") != 0, F.col("dy"))
             .otherwise(F.col("dx")))
    return d.select(*key, "n_points", ((F.col("n_points") >= 2) & (delta < 0)).alias("flip"))


def orient(points: DataFrame, key: list[str] = KEY) -> DataFrame:
    """Vertices renumbered so that index 0 is the lower end; nothing else changes."""
    p = join_back(points, orientation(points, key), key=key)
    return p.withColumn("pt_idx", F.when(F.col("flip"), F.col("n_points").cast("int") - 1 - F.col("pt_idx"))
                        .otherwise(F.col("pt_idx"))).drop("n_points", "flip", "block")


def dominant_axis(points: DataFrame) -> DataFrame:
    """W3 warning: the axis along which a subject's streamlines run, and whether it is not Z."""
    e = endpoints(points).where(F.col("n_points") >= 2)
    g = e.groupBy("subject_id").agg(*[
        F.avg(F.abs(F.col(f"end.{a}") - F.col(f"start.{a}"))).alias(f"span_{a}") for a in "xyz"])
    sx, sy, sz = (F.col(f"span_{a}") for a in "xyz")
    axis = F.when((sx >= sy) & (sx >= sz), "X").when(sy >= sz, "Y").otherwise("Z")
    return g.withColumn("dominant", axis).withColumn("not_vertical", F.col("dominant") != "Z")


def cumulative_length(points: DataFrame) -> DataFrame:
    """Vertices with ``c0`` and ``c1``, arc length up to the vertex before and up to this one."""
    s = segment_lengths(points, keep_prev=True)
    blocks = s.groupBy(*KEY, "block").agg(F.sum("seg").alias("_len"), F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*KEY)
    before = w.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select(*KEY, "block", F.coalesce(F.sum("_len").over(before), lit(0.0)).alias("_off"),
                            F.sum("_len").over(w).alias("length"), F.sum("_n").over(w).alias("n_points"))
    inner = Window.partitionBy(*KEY, "block").orderBy("pt_idx")
    upto = F.sum("seg").over(inner.rowsBetween(Window.unboundedPreceding, 0))
    s = s.withColumn("_in1", upto)
    s = s.withColumn("_in0", F.coalesce(F.lag("_in1").over(inner), lit(0.0)))
    return (s.join(offsets, [*KEY, "block"])
            .withColumn("c0", F.col("_off") + F.col("_in0")).withColumn("c1", F.col("_off") + F.col("_in1"))
            .drop("_in0", "_in1", "_off"))


def resample(points: DataFrame, n_out: Column) -> DataFrame:
    """``n_out`` points at equal arc length; ``n_out`` may use ``length`` and ``n_points``.

    Every segment writes the targets that fall in it, so no join of targets to segments is needed.
    """
    c = cumulative_length(points)
    c = c.withColumn("_m", n_out.cast("int"))
    step = F.col("length") / (F.col("_m") - 1)
    last = F.col("pt_idx") == F.col("n_points") - 1
    flat = F.col("length") == 0

    def upto(v: Column) -> Column:
        return F.least(F.ceil(F.try_divide(v, step)).cast("int"), F.col("_m") - 1)

    first_t = upto(F.col("c0"))
    end_t = F.when(last, F.col("_m") - 1).otherwise(upto(F.col("c1")) - 1)
    targets = (F.when(flat, F.when(last, F.sequence(F.lit(0), F.col("_m") - 1)))
               .when(F.col("pt_idx") == 0, F.when(last, F.array(F.lit(0))))
               .when(end_t >= first_t, F.sequence(first_t, end_t)))
    c = c.withColumn("out_idx", F.explode(targets))
    at_end = last & (F.col("out_idx") == F.col("_m") - 1)
    t = F.try_divide(F.col("out_idx") * step - F.col("c0"), F.col("c1") - F.col("c0"))
    return c.select(*KEY, "out_idx", *[
        F.when(at_end | flat | (F.col("c1") == F.col("c0")), F.col(a))
        .otherwise(F.col(f"prev_{a}") + (F.col(a) - F.col(f"prev_{a}")) * t).alias(a) for a in "xyz"])


def fingerprints(points: DataFrame) -> DataFrame:
    """Vertex count, length, first, last and middle vertex, rounded to 4 decimals."""
    seg = segment_lengths(points)
    n = points.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_points"))
    p = join_back(seg, n)
    mid = F.col("pt_idx") == F.floor(F.col("n_points") / 2)

    def r4(c: Column) -> Column:
        return F.rint(c * lit(1e4)) / lit(1e4) + lit(0.0)

    def at(cond: Column, a: str) -> Column:
        return r4(F.max(F.when(cond, F.col(a))))

    first, last = F.col("pt_idx") == 0, F.col("pt_idx") == F.col("n_points") - 1
    return p.groupBy(*KEY).agg(
        F.max("n_points").alias("n_points"), r4(F.sum("seg")).alias("length"),
        *[at(first, a).alias(f"start_{a}") for a in "xyz"],
        *[at(last, a).alias(f"end_{a}") for a in "xyz"],
        *[at(mid, a).alias(f"mid_{a}") for a in "xyz"])


FINGERPRINT = ["n_points", "length", *[f"{e}_{a}" for e in ("start", "end", "mid") for a in "xyz"]]


def fingerprint_difference(run_a: DataFrame, run_b: DataFrame) -> DataFrame:
    """Fingerprints (as sets, per subject) found in one run only, with the side they are on."""
    cols = ["subject_id", *FINGERPRINT]
    both = (run_a.select(*cols, F.lit(1).alias("a"), F.lit(0).alias("b"))
            .unionByName(run_b.select(*cols, F.lit(0).alias("a"), F.lit(1).alias("b"))))
    g = both.groupBy(*cols).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return (g.where(F.col("a") != F.col("b"))
            .withColumn("only_in", F.when(F.col("a") == 1, "first").otherwise("second")).drop("a", "b"))
