"""Ranks, running counts and exact percentiles that never gather one key in one task.

Keys are cut into buckets that keep the sort order. A rank is then the number of rows in earlier
buckets (a running sum over bucket counts) plus the rank inside the bucket, and only buckets are
windowed, so a key with a third of all rows is spread over many tasks. Where buckets are cut by a
value, the cuts are each key's own approximate quantiles, so buckets are of similar size whatever
the value's scale; the cuts affect balance, never the result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tractloom.functions.stage import materialize

_BEFORE = (Window.unboundedPreceding, -1)
#: Buckets of a key; its counts per bucket are the most that one window holds of a key at once.
BUCKETS = 64


def with_buckets(df: DataFrame, keys: list[str], value: Column, out: str = "_bucket", buckets: int = BUCKETS, tie: Column | None = None) -> DataFrame:
    """Add the number of the key's approximate quantiles below ``value``, rising with it; equal values share a bucket.

    With ``tie``, a value so frequent that two neighbouring quantiles are equal to it has buckets of
    its own, cut at the key's quantiles of ``tie``; numbers then rise with (value, tie), and where
    that pair is unique no bucket grows with the number of equal values.

    The cuts are written once: approximate quantiles depend on the order in which parts of a key
    arrive, so a plan that reads the buckets twice would see two different cuts.
    """
    by = {"_cut_by": value} if tie is None else {"_cut_by": value, "_tie_by": tie}
    d = df.withColumns({n: c.cast("double") for n, c in by.items()})
    at = [n / buckets for n in range(1, buckets)]
    cuts = materialize(d.groupBy(*keys).agg(*[F.percentile_approx(n, at, 20 * buckets).alias(f"{n}_cuts") for n in by]))
    below = lambda n: F.size(F.filter(f"{n}_cuts", lambda c: c < F.col(n)))
    number = below("_cut_by")
    if tie is not None:
        full = F.size(F.filter("_cut_by_cuts", lambda c: c == F.col("_cut_by"))) > 1
        number = number * (buckets + 1) + F.when(full, below("_tie_by") + 1).otherwise(0)
    return d.join(cuts, keys).withColumn(out, number).drop(*by, *[f"{n}_cuts" for n in by])


def two_stage_rank(df: DataFrame, keys: list[str], bucket: Column, order: list[Column],
                   out: str = "rank", total: str | None = None) -> DataFrame:
    """0-based row number of each row within ``keys`` by ``order``.

    ``bucket`` must not decrease along ``order``; per key it should take few values (at most some
    thousands) of similar size. ``total`` names an extra column with the key's row count.
    """
    d = df.withColumn("_bucket", bucket)
    sizes = d.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    offsets = sizes.select(
        *keys, "_bucket",
        F.coalesce(F.sum("_n").over(w.orderBy("_bucket").rowsBetween(*_BEFORE)), F.lit(0)).alias("_off"),
        *([F.sum("_n").over(w).alias(total)] if total else []))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    ranked = d.withColumn("_rn", F.row_number().over(inner))
    return (ranked.join(offsets, [*keys, "_bucket"])
            .withColumn(out, F.col("_off") + F.col("_rn") - 1)
            .drop("_off", "_rn", "_bucket"))


def exact_percentiles(df: DataFrame, keys: list[str], value: Column,
                      fractions: dict[str, float]) -> DataFrame:
    """Linear-interpolated percentiles per key, exact, one output row per key.

    Equal values are counted first; the distinct values are cut into bins of similar size, and
    only the bins holding a wanted rank are ordered.
    """
    vals = df.select(*keys, value.cast("double").alias("_v")).where(F.col("_v").isNotNull())
    counts = with_buckets(vals.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c")), keys, F.col("_v"), "_bin")
    per_key = Window.partitionBy(*keys)
    bins = counts.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_nb"))
    bins = bins.select(
        *keys, "_bin", "_nb",
        F.coalesce(F.sum("_nb").over(per_key.orderBy("_bin").rowsBetween(*_BEFORE)), F.lit(0)).alias("_off"),
        F.sum("_nb").over(per_key).alias("_total"))

    def ranks(p: float) -> tuple[Column, Column, Column]:
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        return pos, F.floor(pos), F.ceil(pos)

    def holds(start: Column, n: Column, r: Column) -> Column:
        return (start <= r) & (r < start + n)

    wanted = reduce(lambda a, b: a | b, [
        holds(F.col("_off"), F.col("_nb"), r) for p in fractions.values() for r in ranks(p)[1:]])
    picked = counts.join(bins.where(wanted), [*keys, "_bin"])
    inner = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(*_BEFORE)
    placed = picked.withColumn("_start", F.col("_off") + F.coalesce(F.sum("_c").over(inner), F.lit(0)))

    aggs = []
    for name, p in fractions.items():
        _, lo, hi = ranks(p)
        aggs += [F.max(F.when(holds(F.col("_start"), F.col("_c"), lo), F.col("_v"))).alias(f"_lo_{name}"),
                 F.max(F.when(holds(F.col("_start"), F.col("_c"), hi), F.col("_v"))).alias(f"_hi_{name}")]
    got = placed.groupBy(*keys).agg(F.max("_total").alias("_total"), *aggs)
    outs = []
    for name, p in fractions.items():
        pos, lo, _ = ranks(p)
        a, b = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        outs.append((a + (b - a) * (pos - lo)).alias(name))
    return got.select(*keys, *outs)


def summary_stats(df: DataFrame, keys: list[str], value: Column,
                  fractions: dict[str, float] | None = None, prefix: str = "") -> DataFrame:
    """mean, population std, min, max, n and exact percentiles (median by default) per key."""
    fr = {f"{prefix}{k}": v for k, v in (fractions or {"median": 0.5}).items()}
    v = value.cast("double")
    basic = df.where(v.isNotNull()).groupBy(*keys).agg(
        F.count(v).alias(f"{prefix}n"), F.avg(v).alias(f"{prefix}mean"),
        F.stddev_pop(v).alias(f"{prefix}std"), F.min(v).alias(f"{prefix}min"),
        F.max(v).alias(f"{prefix}max"))
    return basic.join(exact_percentiles(df, keys, value, fr), keys)
