"""Bundle against bundle, and run against run."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tractloom import constants as C
from tractloom.functions.numeric import count_if, lit, ratio
from tractloom.functions.ranking import exact_percentiles
from tractloom.functions.stage import materialize
from tractloom.operators.streamlines import KEY, resample

VOX = ["subject_id", "i", "j", "k"]
NAN = float("nan")


def voxel_overlap(cand_vox: DataFrame, ref_vox: DataFrame) -> DataFrame:
    """Size of the occupied-voxel sets of two bundles, of their intersection and differences.

    Both sets are tagged and grouped by voxel once, which replaces a full outer join.
    """
    def tag(d: DataFrame, a: int, b: int) -> DataFrame:
        return d.where("inb").select(*VOX, F.lit(a).alias("c"), F.lit(b).alias("r"))

    v = tag(cand_vox, 1, 0).unionByName(tag(ref_vox, 0, 1)).groupBy(*VOX).agg(F.max("c").alias("c"), F.max("r").alias("r"))
    c, r = F.col("c") == 1, F.col("r") == 1
    return v.groupBy("subject_id").agg(
        count_if(c & r).alias("intersection_volume"), count_if(c).alias("candidate_volume"),
        count_if(r).alias("reference_volume"), count_if(c & ~r).alias("overreach_volume"),
        count_if(r & ~c).alias("missed_volume"))


def voxel_sets(cand_vox: DataFrame, ref_vox: DataFrame) -> DataFrame:
    """Every occupied voxel with the set it belongs to: both, candidate or reference."""
    tagged = cand_vox.where("inb").select(*VOX, F.lit(1).alias("t")).unionByName(
        ref_vox.where("inb").select(*VOX, F.lit(2).alias("t")))
    g = tagged.groupBy(*VOX).agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    member = F.when(F.col("lo") != F.col("hi"), "both").when(F.col("lo") == 1, "candidate").otherwise("reference")
    return g.select(*VOX, member.alias("member"))


def bundle_overlap(cand_vox: DataFrame, ref_vox: DataFrame, subjects: DataFrame) -> DataFrame:
    """J8+J9: Dice, coverage, overreach and streamline ratio of two bundles per subject.

    Dice, coverage and ratio of an empty reference are NaN; Dice and overreach of an empty
    candidate are 0.
    """
    def n(d: DataFrame, name: str) -> DataFrame:
        return d.select(*KEY).distinct().groupBy("subject_id").agg(F.count(F.lit(1)).alias(name))

    d = (subjects.join(voxel_overlap(cand_vox, ref_vox), "subject_id", "left")
         .join(n(cand_vox, "num_candidate"), "subject_id", "left").join(n(ref_vox, "num_reference"), "subject_id", "left")
         .na.fill(0))
    c = F.col
    both = c("candidate_volume") + c("reference_volume")
    return d.withColumns({
        "dice": F.when(c("num_reference") == 0, lit(NAN)).when(c("num_candidate") == 0, lit(0.0))
        .otherwise(ratio(c("intersection_volume") * 2, both, 0.0)),
        "coverage": ratio(c("intersection_volume"), c("reference_volume"), NAN),
        "overreach": ratio(c("overreach_volume"), c("candidate_volume"), 0.0),
        "count_ratio": ratio(c("num_candidate"), c("num_reference"), NAN)})


def spatial_compatibility(grids: DataFrame, tol_trans: float = 1.0, tol_rot: float = 1e-3) -> DataFrame:
    """Whether candidate and reference affines match the target grid.

    ``grids`` has ``target``, ``candidate`` and ``reference`` (ARRAY of 16) per subject.
    """
    def trans(side: str) -> Column:
        d = [F.col(side)[r * 4 + 3] - F.col("target")[r * 4 + 3] for r in range(3)]
        return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])

    def rot(side: str) -> Column:
        return F.greatest(*[F.abs(F.col(side)[r * 4 + c] - F.col("target")[r * 4 + c]) for r in range(3) for c in range(3)])

    d = grids.withColumns({f"{m}_{s}": f(s) for s in ("candidate", "reference") for m, f in (("trans", trans), ("rot", rot))})
    status = F
    for s in ("candidate", "reference"):
        status = status.when(F.col(f"trans_{s}") > tol_trans, f"{s}_translation").when(F.col(f"rot_{s}") > tol_rot, f"{s}_rotation")
    return d.select("subject_id", "trans_candidate", "rot_candidate", "trans_reference", "rot_reference",
                    status.otherwise("ok").alias("status"))


def hemisphere_alignment(candidate: DataFrame, reference: DataFrame, subjects: DataFrame, warn_at: float = 30.0) -> DataFrame:
    """Distance of the two bundles' centroids, each over all vertices of the bundle."""
    def centroid(p: DataFrame, side: str) -> DataFrame:
        return p.groupBy("subject_id").agg(*[F.avg(a).alias(f"{side}_{a}") for a in "xyz"])

    d = subjects.join(centroid(candidate, "c"), "subject_id", "left").join(centroid(reference, "r"), "subject_id", "left")
    diff = [F.col(f"c_{a}") - F.col(f"r_{a}") for a in "xyz"]
    dist = F.sqrt(diff[0] * diff[0] + diff[1] * diff[1] + diff[2] * diff[2])
    return d.select("subject_id", dist.alias("distance"), (dist > warn_at).alias("warn"))


# ------------------------------------------------------------------- nearest points

def _cell(size: float) -> list[Column]:
    return [F.floor(F.col(a) / lit(size)).cast("long").alias(c) for a, c in zip("xyz", "abc")]


def _boxes(points: DataFrame, size: float, parent: float | None = None) -> DataFrame:
    """Tight box of the points in each occupied cell, with the cell of the next coarser size."""
    up = [F.floor(F.col(a) / lit(parent)).cast("long").alias(f"p{c}") for a, c in zip("xyz", "abc")] if parent else []
    keys = ["a", "b", "c", *([f"p{c}" for c in "abc"] if parent else [])]
    return points.select("subject_id", *_cell(size), *up, "x", "y", "z").groupBy("subject_id", *keys).agg(
        *[f(a).alias(f"{m}{a}") for a in "xyz" for m, f in (("lo", F.min), ("hi", F.max))])


_PID = ["subject_id", "x", "y", "z"]


def _sq(d: list[Column]) -> Column:
    return d[0] * d[0] + d[1] * d[1] + d[2] * d[2]


def _sample_near(tgt: DataFrame, size: float) -> DataFrame:
    """One target point per cell, taken from that cell and its 26 neighbours, near the middle."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c"))
                               for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)]))
    one = tgt.select(*_PID, *_cell(size)).groupBy("subject_id", "a", "b", "c").agg(F.min(F.struct("x", "y", "z")).alias("t"))
    near = one.withColumn("_o", step).select("subject_id", "t", *[(F.col(c) + F.col(f"_o.{c}")).alias(c) for c in "abc"])
    off = _sq([F.col(f"t.{a}") - (F.col(c) + lit(0.5)) * lit(size) for a, c in zip("xyz", "abc")])
    return near.groupBy("subject_id", "a", "b", "c").agg(F.min_by("t", F.struct(off, "t")).alias("t"))


#: Points in the block of a mean point, and pairs whose distances a task holds at once.
LEAF, PAIRS = 4096, 1 << 16
#: Points that one task searches, about.
TASK_POINTS = 1 << 18
_CELL = ["subject_id", "a", "b", "c"]


def _block_size(points: DataFrame, largest: float = 128.0, least: float = 2.0 ** -10) -> tuple[float, int]:
    """Edge of the blocks, a power of two by which a mean point shares its block with at most ``LEAF`` others, and the number of points."""
    size, rows = largest, 0
    while size > least:
        n = points.groupBy("subject_id", *_cell(size)).agg(F.count(F.lit(1)).cast("double").alias("n"))
        pairs, rows = n.agg(F.sum(F.col("n") * F.col("n")), F.sum("n")).first()
        if not rows or pairs <= LEAF * rows:
            break
        size /= 2 ** min(4, max(1, math.ceil(math.log2(pairs / rows / LEAF) / 3)))
    return max(size, least), int(rows or 0)


def _least_squares(s: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance of each point of ``s`` to the nearest of ``t`` and the other way round; inf where there is none."""
    to_t, to_s = np.full(len(s), np.inf), np.full(len(t), np.inf)
    for k in range(0, len(t), PAIRS):
        part = t[k:k + PAIRS]
        each = max(1, PAIRS // max(1, len(part)))
        for n in range(0, len(s), each):
            one = s[n:n + each]
            d = np.subtract.outer(one[:, 0], part[:, 0]) ** 2
            d += np.subtract.outer(one[:, 1], part[:, 1]) ** 2
            d += np.subtract.outer(one[:, 2], part[:, 2]) ** 2
            to_t[n:n + each] = np.minimum(to_t[n:n + each], d.min(axis=1))
            to_s[k:k + PAIRS] = np.minimum(to_s[k:k + PAIRS], d.min(axis=0))
    return to_t, to_s


_FOUND = "subject_id long, way int, x double, y double, z double, weight long, u double, total double, squares double"


def _in_block(size: float, ways: tuple[int, ...], fold: bool):
    """Nearest points within a block: a row per point that may have a nearer one outside, and with ``fold`` one of sums for all others."""

    def run(block: pd.DataFrame) -> pd.DataFrame:
        xyz, weight = block[["x", "y", "z"]].to_numpy(), block[["w0", "w1"]].to_numpy()
        side = [weight[:, 0] > 0, weight[:, 1] > 0]
        corner = block[["a", "b", "c"]].iloc[0].to_numpy().astype(float) * size
        border = np.minimum(xyz - corner, corner + size - xyz).min(axis=1)
        out = []
        for way, u in zip((0, 1), _least_squares(xyz[side[0]], xyz[side[1]])):
            if way not in ways or not len(u):
                continue
            at, w, d = xyz[side[way]], weight[side[way], way], np.sqrt(u)
            done = (u == 0) | (d * (1 + 1e-9) < border[side[way]])
            rows = ~done if fold else np.ones(len(u), dtype=bool)
            out.append(pd.DataFrame({"way": way, "x": at[rows, 0], "y": at[rows, 1], "z": at[rows, 2], "weight": w[rows], "u": u[rows],
                                     "total": np.where(done, w * d, np.nan)[rows], "squares": np.where(done, w * u, np.nan)[rows]}))
            if fold and done.any():
                out.append(pd.DataFrame({"way": [way], "x": np.nan, "y": np.nan, "z": np.nan, "weight": [w[done].sum()], "u": [0.0],
                                         "total": [(w * d)[done].sum()], "squares": [(w * u)[done].sum()]}))
        if not out:
            return pd.DataFrame({n.split()[0]: [] for n in _FOUND.split(", ")})
        return pd.concat(out, ignore_index=True).assign(subject_id=block["subject_id"].iat[0])[[n.split()[0] for n in _FOUND.split(", ")]]

    return run


def _next_door(asked: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
    """Squared distances from points to the nearest target of another block that their bound touches."""
    xyz = block[["x", "y", "z"]].to_numpy()
    out = []
    for way, rows in asked.groupby("way"):
        u, _ = _least_squares(rows[["x", "y", "z"]].to_numpy(), xyz[block[f"w{1 - way}"].to_numpy() > 0])
        out.append(rows.assign(u=np.minimum(u, rows["u"].to_numpy())))
    return pd.concat(out)[["subject_id", "way", "x", "y", "z", "weight", "u"]] if out else asked[["subject_id", "way", "x", "y", "z", "weight", "u"]]


def _nearest(points: DataFrame, ways: tuple[int, ...] = (0, 1), fold: bool = False) -> DataFrame:
    """Nearest points of two sets: subject_id, way, x, y, z, weight, total and squares (weight times distance and its square).

    ``points`` has subject_id, x, y, z and side (0 or 1); way 0 leads from side 0 to side 1. Points
    without three finite coordinates and those of a subject without the other side are left out, equal
    ones are one row with their number as ``weight``. With ``fold`` rows may stand for many points
    (x, y and z are null).

    Space is cut into blocks, the smaller the denser the points lie, so that a point meets a bounded
    number of others however many there are. Both ways are searched at once in the tasks that hold a
    block. What is found is final unless the block's border is nearer: such points go on to the few
    neighbour blocks whose targets lie within the distance found, and those whose distance exceeds half
    a block, or whose block has no target, to a search through growing cells.
    """
    kind = points.schema["subject_id"].dataType
    fine = [F.abs(a) < lit(float("inf")) for a in "xyz"]
    pts = materialize(points.where(reduce(lambda p, q: p & q, fine)).select(
        F.col("subject_id").cast("long").alias("subject_id"), *[(F.col(a) + lit(0.0)).alias(a) for a in "xyz"], F.col("side").cast("int").alias("side")))
    size, rows = _block_size(pts)
    tasks = max(int(pts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_POINTS))
    blocks = pts.select(*_PID, "side", *_cell(size)).repartition(tasks, *_CELL).groupBy(*_CELL, "x", "y", "z").agg(
        *[F.sum((F.col("side") == n).cast("long")).alias(f"w{n}") for n in (0, 1)])
    found = materialize(blocks.groupBy(*_CELL).applyInPandas(_in_block(size, ways, fold), _FOUND))
    r = F.sqrt("u") * lit(1.0 + 1e-9)
    late = found.where(F.col("total").isNull()).drop("total", "squares").withColumn("_r", r)
    near, far = late.where(F.col("_r") * 2 <= size), late.where(F.col("_r") * 2 > size)

    boxes = materialize(pts.select("*", *_cell(size)).groupBy(*_CELL, (1 - F.col("side")).alias("way")).agg(
        *[f(a).alias(f"{m}{a}") for a in "xyz" for m, f in (("lo", F.min), ("hi", F.max))]))
    ask = near.select("*", *[c.alias(f"_{c0}") for c, c0 in zip([F.floor(F.col(a) / lit(size)).cast("long") for a in "xyz"], "abc")])
    for x, c in zip("xyz", "abc"):
        lo, hi = [F.floor((F.col(x) + s * F.col("_r")) / lit(size)).cast("long") for s in (-1, 1)]
        ask = ask.withColumn(c, F.explode(F.sequence(lo, hi)))
    ask = ask.where("a <> _a or b <> _b or c <> _c").join(boxes, [*_CELL, "way"])
    gap = _sq([F.greatest(F.col(f"lo{a}") - F.col(a), F.col(a) - F.col(f"hi{a}"), lit(0.0)) for a in "xyz"])
    ask = ask.where(gap <= F.col("u")).select("subject_id", "way", "x", "y", "z", "weight", "u", *"abc")
    there = pts.select(*_PID, *[(F.col("side") == n).cast("int").alias(f"w{n}") for n in (0, 1)], *_cell(size))
    met = ask.repartition(tasks, *_CELL).groupBy(*_CELL).cogroup(there.repartition(tasks, *_CELL).groupBy(*_CELL)).applyInPandas(
        _next_door, "subject_id long, way int, x double, y double, z double, weight long, u double")
    own = near.select("subject_id", "way", "x", "y", "z", "weight", "u")
    least = own.unionByName(met).groupBy("subject_id", "way", "x", "y", "z").agg(F.max("weight").alias("weight"), F.min("u").alias("u"))
    if not far.isEmpty():
        own = F.struct("subject_id", "way").alias("subject_id")  # both ways at once
        tgt = pts.withColumn("way", 1 - F.col("side")).where(F.col("way").isin(*ways)).select(own, "x", "y", "z").distinct()
        last = _far(far.select(own, "x", "y", "z", "weight", "u"), materialize(tgt), size)
        least = least.unionByName(last.select("subject_id.*", "x", "y", "z", "weight", "u"))
    w, d = F.col("weight"), F.sqrt("u")
    out = found.where(F.col("total").isNotNull()).select("subject_id", "way", "x", "y", "z", "weight", "total", "squares").unionByName(
        least.select("subject_id", "way", "x", "y", "z", "weight", (w * d).alias("total"), (w * F.col("u")).alias("squares")))
    return out.withColumn("subject_id", F.col("subject_id").cast(kind))


def _far(src: DataFrame, tgt: DataFrame, fine: float, growth: float = 4.0, head: float = 512.0) -> DataFrame:
    """Squared distances ``u`` of points that lie far from all targets, for the size of the blocks ``fine``.

    First every source gets an upper bound: the distance to one target sampled around its cell, for
    growing cell sizes, or to any target of its subject. Then it opens only cells that its bound can
    touch: at most 8 of the cell size just above twice the bound, their boxes of targets level by
    level, and at last the points of the remaining blocks. No source meets all targets.
    """
    reach = max(1, math.ceil(math.log(head / fine, growth)))
    anyone = tgt.groupBy("subject_id").agg(F.min(F.struct("x", "y", "z")).alias("t"))
    gap = [F.col(a) - F.col(f"t.{a}") for a in "xyz"]
    src = src.join(anyone, ["subject_id"]).withColumn("u", F.least("u", _sq(gap))).drop("t")
    for n in range(reach):
        size = fine * growth ** n
        hit = src.select("*", *_cell(size)).join(_sample_near(tgt, size), ["subject_id", "a", "b", "c"], "left")
        src = hit.withColumn("u", F.least("u", _sq(gap))).drop("a", "b", "c", "t")
    sizes = [fine * 2 * growth ** n for n in range(reach + 1)]
    r = F.sqrt("u") * lit(1.0 + 1e-9)
    level = F.lit(len(sizes) - 1)
    for n in reversed(range(len(sizes) - 1)):
        level = F.when(r * 2 <= sizes[n], F.lit(n)).otherwise(level)
    src = materialize(src.withColumns({"_r": r, "_level": level}))
    top = src.agg(F.max("_level")).first()[0] or 0
    cand = None
    for n in range(top, -1, -1):
        size = sizes[n]
        own = src.where(F.col("_level") == n).select(*_PID, "weight", "u", "_r")
        for x, c in zip("xyz", "abc"):
            lo, hi = [F.floor((F.col(x) + s * F.col("_r")) / lit(size)).cast("long") for s in (-1, 1)]
            own = own.withColumn(c, F.explode(F.sequence(lo, hi)))
        own = own.drop("_r")
        cand = own if cand is None else own.unionByName(_descend(cand, tgt, size, size * growth))
    cand = _descend(cand, tgt, fine, sizes[0])
    pts = tgt.select("subject_id", *_cell(fine), F.struct("x", "y", "z").alias("t"))
    return cand.join(pts, ["subject_id", "a", "b", "c"]).groupBy(*_PID).agg(
        F.max("weight").alias("weight"), F.min(_sq(gap)).alias("u"))


def nearest_distance(source: DataFrame, target: DataFrame) -> DataFrame:
    """Exact distance from each distinct source point to the nearest target point of its subject; ``weight`` counts equal ones."""
    both = source.select(*_PID, F.lit(0).alias("side")).unionByName(target.select(*_PID, F.lit(1).alias("side")))
    return _nearest(both, (0,)).select(*_PID, "weight", (F.col("total") / F.col("weight")).alias("distance"))


def _descend(cand: DataFrame, tgt: DataFrame, size: float, parent: float) -> DataFrame:
    """From cells to the boxes inside them that start within the source's bound."""
    up = cand.withColumnsRenamed({c: f"p{c}" for c in "abc"})
    d = up.join(_boxes(tgt, size, parent), ["subject_id", "pa", "pb", "pc"])
    near = _sq([F.greatest(F.col(f"lo{a}") - F.col(a), F.col(a) - F.col(f"hi{a}"), lit(0.0)) for a in "xyz"])
    return d.where(near <= F.col("u")).select(*_PID, "weight", "u", "a", "b", "c")


def mean_closest_distance(candidate: DataFrame, reference: DataFrame, step: float = 2.0, subjects: DataFrame | None = None) -> DataFrame:
    """Symmetric mean of nearest-point distances between two resampled bundles.

    Every streamline is resampled to max(2, int(length/step)) points and all of them are used. A
    subject of ``subjects`` (by default of either bundle) with an empty bundle has NaN throughout.
    """
    n_out = F.when(F.col("length") < step, F.lit(2)).otherwise(F.greatest(F.lit(2), F.floor(F.col("length") / lit(step))))
    c, r = [resample(d, n_out).select("subject_id", "x", "y", "z", F.lit(side).alias("side")) for side, d in enumerate((candidate, reference))]
    d = _nearest(c.unionByName(r), fold=True)
    w, total, squares = F.col("weight"), F.sum("total"), F.sum("squares")

    def mean(way: int) -> Column:
        one = F.col("way") == way
        return F.sum(F.when(one, F.col("total"))) / F.sum(F.when(one, w))

    g = d.groupBy("subject_id").agg(mean(0).alias("cand_to_ref"), mean(1).alias("ref_to_cand"),
                                    (total / F.sum(w)).alias("_m"), (squares / F.sum(w)).alias("_q"))
    g = g.select("subject_id", ((F.col("cand_to_ref") + F.col("ref_to_cand")) / 2).alias("symmetric"),
                 "cand_to_ref", "ref_to_cand",
                 F.sqrt(F.greatest(F.col("_q") - F.col("_m") * F.col("_m"), lit(0.0))).alias("std"))
    every = subjects if subjects is not None else candidate.select("subject_id").union(reference.select("subject_id"))
    return every.select("subject_id").distinct().join(g, "subject_id", "left").na.fill(float("nan"))


# ----------------------------------------------------------------------------- run to run

def tolerances(key: Column) -> tuple[Column, Column]:
    """(rtol, atol) by the first metric family whose name is in the key."""
    def pick(i: int) -> Column:
        expr = reduce(lambda e, t: e.when(F.lower(key).contains(t[0]), lit(t[i])), C.METRIC_TOLERANCES, F)
        return expr.otherwise(lit(C.DEFAULT_TOLERANCE[i - 1]))
    return pick(1), pick(2)


def within(a: Column, b: Column, rtol: Column, atol: Column) -> Column:
    return F.abs(a - b) <= atol + rtol * F.abs(b)


def metric_difference(first: DataFrame, second: DataFrame) -> DataFrame:
    """Full key union of two runs (subject_id, metric, value) with differences and equality."""
    d = first.withColumnRenamed("value", "value1").join(
        second.withColumnRenamed("value", "value2"), ["subject_id", "metric"], "full_outer")
    a, b = F.col("value1"), F.col("value2")
    diff = F.abs(a - b)
    rtol, atol = tolerances(F.col("metric"))
    status = (F.when(a.isNull(), "missing_in_first").when(b.isNull(), "missing_in_second")
              .when(within(a, b, rtol, atol), "equal").otherwise("different"))
    return d.select("subject_id", "metric", "value1", "value2", diff.alias("absolute_diff"),
                    F.when(a == 0, lit(float("inf"))).otherwise(F.try_divide(diff, F.abs(a))).alias("relative_diff"),
                    status.alias("status"))


def stability(samples: DataFrame, keys: list[str]) -> DataFrame:
    """N, mean, median, p05, p95 of the finite ``value`` per ``keys`` and ``run``, against run 0."""
    ok = samples.where(~F.isnan("value") & (F.abs("value") != float("inf")))
    k = [*keys, "run"]
    s = ok.groupBy(*k).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean")).join(
        exact_percentiles(ok, k, F.col("value"), {"median": 0.5, "p05": 0.05, "p95": 0.95}), k)
    base = s.where("run = 0").select(*keys, *[F.col(c).alias(f"{c}_0") for c in ("n", "mean", "median", "p05", "p95")])
    d = s.join(base, keys)
    rtol, atol = tolerances(F.col("scalar"))
    same = reduce(lambda e, c: e & within(F.col(c), F.col(f"{c}_0"), rtol, atol), ("mean", "median", "p05", "p95"),
                  F.col("n") == F.col("n_0"))
    return d.withColumn("stable", same).drop("n_0", "mean_0", "median_0", "p05_0", "p95_0")
