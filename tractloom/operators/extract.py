"""Streamline selection by regions: pass-through, endpoint, seeded and bidirectional extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tractloom import constants as C
from tractloom.functions import geometry as G
from tractloom.functions.numeric import count_if, lit, ratio, rnd
from tractloom.functions.ranking import exact_percentiles, two_stage_rank, with_buckets
from tractloom.operators import bricks
from tractloom.operators.geometry import voxelise
from tractloom.operators.streamlines import KEY, arc_lengths, endpoints

VOX = ["subject_id", "i", "j", "k"]
ROIS = ("brainstem", "motor_left", "motor_right")


def roi_flags(roi_voxels: DataFrame, rois: tuple[str, ...] = ROIS) -> DataFrame:
    """One row per voxel with a flag per region, so one join tests all regions."""
    return roi_voxels.groupBy(*VOX).agg(*[F.bool_or(F.col("roi") == r).alias(r) for r in rois])


def passes(vox_points: DataFrame, flags: DataFrame, rois: tuple[str, ...] = ROIS,
           extra: list[Column] | None = None) -> DataFrame:
    """Per streamline, which regions any of its vertices lies in (plus extra aggregates).

    ``flags`` is ``roi_flags``, optionally with map columns. A left join, so streamlines outside
    every region stay. ``extra`` may use the flags and maps per vertex.
    """
    p = vox_points.join(flags, VOX, "left")
    p = p.withColumns({r: F.col("inb") & F.coalesce(r, F.lit(False)) for r in rois})
    return p.groupBy(*KEY).agg(*[F.bool_or(r).alias(r) for r in rois], *(extra or []))


def filter_by_roi(points: DataFrame, vox_points: DataFrame, roi_voxels: DataFrame) -> DataFrame:
    """Streamlines with any vertex in the mask (ids only)."""
    mask = roi_voxels.select(*VOX).distinct()
    hits = vox_points.where("inb").join(mask, VOX, "left_semi").select(*KEY).distinct()
    return points.select(*KEY).distinct().join(hits, KEY, "left_semi")


def endpoint_flags(points: DataFrame, grid: G.Grid | None, roi_voxels: DataFrame,
                   rois: tuple[str, ...] = ROIS) -> DataFrame:
    """Flags ``start_<roi>`` and ``end_<roi>`` per streamline from one join of both ends."""
    e = endpoints(points)
    both = e.select(*KEY, F.explode(F.array(
        F.struct(F.lit("start").alias("end"), F.col("start").alias("p")),
        F.struct(F.lit("end").alias("end"), F.col("end").alias("p")))).alias("e"))
    v = voxelise(both.select(*KEY, "e.end", "e.p.x", "e.p.y", "e.p.z"), grid)
    v = v.join(roi_flags(roi_voxels, rois), VOX, "left")
    return v.groupBy(*KEY).agg(*[
        F.bool_or((F.col("end") == side) & F.col("inb") & F.coalesce(r, F.lit(False))).alias(f"{side}_{r}")
        for side in ("start", "end") for r in rois])


def connects(a: str, b: str) -> Column:
    """One end in ``a``, the other in ``b``."""
    return ((F.col(f"start_{a}") & F.col(f"end_{b}")) | (F.col(f"start_{b}") & F.col(f"end_{a}")))


def extract_endpoints(points: DataFrame, grid: G.Grid | None, roi_voxels: DataFrame,
                      band: tuple[float, float] = C.LENGTH_BAND_PASSTHROUGH) -> DataFrame:
    """Per streamline its length, whether it is in the band, and the sides it belongs to."""
    f = arc_lengths(points).join(endpoint_flags(points, grid, roi_voxels), KEY)
    ok = F.col("length").between(*band)
    return f.select(*KEY, "length", ok.alias("in_band"),
                    (ok & connects("brainstem", "motor_left")).alias("left"),
                    (ok & connects("brainstem", "motor_right")).alias("right"))


def endpoint_stats(flags: DataFrame) -> DataFrame:
    """Counts, extraction rate and left/right ratio (infinite without right streamlines)."""
    g = flags.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("total_input"), count_if(F.col("in_band")).alias("after_length_filter"),
        count_if(F.col("left")).alias("left_count"), count_if(F.col("right")).alias("right_count"))
    total = F.col("left_count") + F.col("right_count")
    return g.withColumns({
        "total_count": total, "extraction_rate": ratio(total * 100, F.col("total_input"), 0.0),
        "left_right_ratio": ratio(F.col("left_count"), F.col("right_count"), float("inf"))})


def endpoint_bundles(flags: DataFrame) -> DataFrame:
    """Left then right streamlines; one in both sides appears twice."""
    return flags.where("left").select(*KEY, F.lit("left").alias("side")).unionByName(
        flags.where("right").select(*KEY, F.lit("right").alias("side")))


def crosses_plane(midline_x: Column, tolerance: float = C.MIDLINE_TOLERANCE_MM) -> Column:
    """Reaches more than the tolerance to both sides of a plane."""
    return (F.col("x_min") < midline_x - tolerance) & (F.col("x_max") > midline_x + tolerance)


def crosses_surface(points: DataFrame, grid: G.Grid | None, distance: DataFrame,
                    tolerance: float = C.MIDLINE_TOLERANCE_MM) -> DataFrame:
    """J6 against a curved midline: signed distance at the floor voxel of each vertex."""
    v = G.voxel_coords(grid, (F.col("x"), F.col("y"), F.col("z")))
    p = points.withColumns({a: F.floor(c).cast("int") for a, c in zip("ijk", v)})
    p = p.where(G.in_bounds(grid, F.col("i"), F.col("j"), F.col("k"))).select(*KEY, "i", "j", "k")
    d = p.join(distance.select(*VOX, "distance"), VOX)
    g = d.groupBy(*KEY).agg(F.min("distance").alias("d_min"), F.max("distance").alias("d_max"))
    cross = (F.col("d_min") < -tolerance) & (F.col("d_max") > tolerance)
    return (points.select(*KEY).distinct().join(g, KEY, "left")
            .select(*KEY, F.coalesce(cross, F.lit(False)).alias("crosses")))


def streamline_table(points: DataFrame, grid: G.Grid | None, roi_voxels: DataFrame,
                     maps: DataFrame | None = None, scalars: tuple[str, ...] = ()) -> DataFrame:
    """One row per streamline with all that selection and sampling need.

    Region flags and (if given) scalar maps are packed into bricks first, so vertices go through one
    exchange and one join on their brick, which AQE can split if a brick is crowded; length comes
    from the block-wise pass along the streamline. ``x_mean`` is rounded to ``MEAN_PLACES``
    places, so that a mean on a midline does not change sides with the order of its sum.
    """
    packed = bricks.pack(maps, scalars) if maps is not None else None
    v = bricks.visit(voxelise(points, grid), bricks.pack_masks(roi_voxels, ROIS), ROIS, packed, scalars)
    extra = [F.min("x").alias("x_min"), F.max("x").alias("x_max"), rnd(F.avg("x"), C.MEAN_PLACES).alias("x_mean"),
             F.min("z").alias("z_min"),
             F.min_by("x", F.when(F.col("brainstem"), F.col("pt_idx"))).alias("entry_x")]
    if maps is not None:
        extra += [F.avg(s).alias(f"{s}_mean") for s in scalars] + [count_if(F.col("inb")).alias("n_samples")]
    return v.groupBy(*KEY).agg(*[F.bool_or(r).alias(r) for r in ROIS], *extra).join(arc_lengths(points), KEY)


def assign_fates(table: DataFrame, band: tuple[float, float] = C.LENGTH_BAND_PASSTHROUGH,
                 midline_x: Column | None = None, crosses: Column | None = None) -> DataFrame:
    """What becomes of each streamline; rules are tried in the order written.

    Deep crossing is decided before motor membership, so it also counts streamlines that reach
    neither motor region.
    """
    cross = crosses if crosses is not None else crosses_plane(midline_x if midline_x is not None else lit(0.0))
    fate = (F.when(~F.col("length").between(*band), "length")
            .when(~F.col("brainstem"), "no_brainstem")
            .when(F.col("motor_left") & F.col("motor_right"), "bilateral_excluded")
            .when(cross, "midline_excluded")
            .when(F.col("motor_left"), "left").when(F.col("motor_right"), "right").otherwise("no_motor"))
    return table.withColumn("fate", fate)


def funnel(fates: DataFrame, midline_x: float | Column = 0.0) -> DataFrame:
    """A10: counts, ratios and yields of every stage of pass-through extraction.

    ``midline_x`` may be a column of ``fates``, see ``rois.attach_midline``.
    """
    ok = F.col("fate") != "length"
    left = F.col("x_mean") < midline_x
    stem = ok & F.col("brainstem")
    g = fates.groupBy("subject_id").agg(
        F.count(F.lit(1)).alias("total_input"), count_if(ok).alias("after_length_filter"),
        count_if(ok & left).alias("input_left"), count_if(ok & ~left).alias("input_right"),
        count_if(stem).alias("passes_brainstem"), count_if(stem & left).alias("left_bs"),
        count_if(stem & ~left).alias("right_bs"),
        count_if(stem & F.col("motor_left")).alias("passes_left_motor"),
        count_if(stem & F.col("motor_right")).alias("passes_right_motor"),
        *[count_if(F.col("fate") == f).alias(n) for f, n in (
            ("left", "left_count"), ("right", "right_count"),
            ("bilateral_excluded", "bilateral_excluded"), ("midline_excluded", "midline_excluded"))])
    c = F.col
    return g.withColumns({
        "total_count": c("left_count") + c("right_count"),
        "input_lr_ratio": ratio(c("input_left"), c("input_right"), 0.0),
        "lr_bs": ratio(c("left_bs"), c("right_bs"), 0.0),
        "left_motor_yield": ratio(c("passes_left_motor") * 100, c("left_bs"), 0.0),
        "right_motor_yield": ratio(c("passes_right_motor") * 100, c("right_bs"), 0.0),
        "extraction_rate": ratio((c("left_count") + c("right_count")) * 100, c("total_input"), 0.0)})


def entry_diagnostics(fates: DataFrame, midline_x: float | Column = 0.0) -> DataFrame:
    """Where streamlines enter the brainstem and how low the failing ones reach, per side.

    ``midline_x`` may be a column of ``fates``, see ``rois.attach_midline``.
    """
    f = fates.where(F.col("fate") != "length").withColumn(
        "side", F.when(F.col("x_mean") < midline_x, "left").otherwise("right"))
    on_side = F.when(F.col("side") == "left", F.col("entry_x") < midline_x).otherwise(F.col("entry_x") >= midline_x)
    g = f.groupBy("subject_id", "side").agg(
        F.count("entry_x").alias("n_entries"), F.avg("entry_x").alias("mean_entry_x"),
        count_if(F.col("entry_x").isNotNull() & on_side).alias("n_correct"),
        count_if(~F.col("brainstem")).alias("n_failing"),
        F.avg(F.when(~F.col("brainstem"), F.col("z_min"))).alias("mean_min_z_failing"))
    return g.withColumn("pct_correct", ratio(F.col("n_correct") * 100, F.col("n_entries"), None))


def density_map(vox_points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """A3: number of streamlines with a vertex in each voxel of the grid."""
    k = keys or []
    seen = vox_points.where("inb").select(*k, *KEY, "i", "j", "k").distinct()
    return seen.groupBy(*k, *VOX).agg(F.count(F.lit(1)).alias("n_streamlines"))


def overlap_scores(vox_points: DataFrame, density: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Sum of another bundle's density over a streamline's vertices; repeats add again.

    Vertices are first counted per streamline and voxel, so a voxel meets each streamline once.
    """
    k = keys or []
    visits = vox_points.where("inb").groupBy(*k, *KEY, "i", "j", "k").agg(F.count(F.lit(1)).alias("_n"))
    hit = visits.join(density.withColumnRenamed("n_streamlines", "_d"), [*k, *VOX])
    s = hit.groupBy(*k, *KEY).agg(F.sum(F.col("_n") * F.col("_d")).alias("score"))
    every = vox_points.select(*k, *KEY).distinct()
    return every.join(s, [*k, *KEY], "left").withColumn("score", F.coalesce("score", F.lit(0)))


def select_top(scores: DataFrame, caps: DataFrame, keys: list[str]) -> DataFrame:
    """The best ``cap`` scored streamlines per key, never one with score 0.

    Ties go to the higher streamline id. Ranks come from buckets cut at the key's own score
    quantiles, and at id quantiles where many scores are equal, so a whole side is never ordered
    in one task.
    """
    pos = with_buckets(scores.where(F.col("score") > 0), keys, -F.col("score"), "_by_score", tie=-F.col("streamline_id"))
    r = two_stage_rank(pos, keys, F.col("_by_score"),
                       [F.col("score").desc(), F.col("streamline_id").desc()], out="rank").drop("_by_score")
    kept = r.join(caps.select(*keys, "cap"), keys)
    return kept.where(F.col("rank") < F.col("cap")).drop("cap")


def bidirectional_stats(forward: DataFrame, reverse: DataFrame, selected: DataFrame,
                        seeds: DataFrame) -> DataFrame:
    """Per subject inflation, artifact index, intersection rates and yields of both sides.

    ``forward``, ``reverse``, ``selected`` have subject_id, streamline_id, side (``selected`` also
    length); ``seeds`` has subject_id, side, n_seeds with the side ``brainstem`` included.
    """
    tagged = (forward.select("subject_id", "side", F.lit("fwd").alias("set"), lit(0.0).alias("length"))
              .unionByName(reverse.select("subject_id", "side", F.lit("rev").alias("set"), lit(0.0).alias("length")))
              .unionByName(selected.select("subject_id", "side", F.lit("sel").alias("set"), "length")))

    def n(kind: str, side: str) -> Column:
        return count_if((F.col("set") == kind) & (F.col("side") == side))

    sel = F.when(F.col("set") == "sel", F.col("length"))
    g = tagged.groupBy("subject_id").agg(
        *[n(k, s).alias(f"{s}_{k}") for k in ("fwd", "rev", "sel") for s in ("left", "right")],
        F.avg(sel).alias("length_mean"), F.stddev_pop(sel).alias("length_std"),
        F.min(sel).alias("length_min"), F.max(sel).alias("length_max"))
    sd = seeds.groupBy("subject_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n_seeds"))), F.lit(0)).alias(f"{s}_seeds")
        for s in ("left", "right", "brainstem")])
    g = sd.join(g, "subject_id", "left")
    g = g.withColumns({f"{s}_{k}": F.coalesce(f"{s}_{k}", F.lit(0))
                       for k in ("fwd", "rev", "sel") for s in ("left", "right")})

    def over(a: Column, b: Column, scale: float = 1.0) -> Column:
        return a.cast("double") / F.greatest(b, F.lit(1)) * lit(scale)

    c = F.col
    g = g.withColumns({f"inflation_{s}": over(c(f"{s}_fwd"), c(f"{s}_rev")) for s in ("left", "right")})
    il, ir = c("inflation_left"), c("inflation_right")
    g = g.withColumn("artifact_index", F.abs(il - ir) / F.greatest(il, ir, lit(1.0)))
    return g.withColumns({
        "flagged": c("artifact_index") > C.ARTIFACT_INDEX_THRESHOLD,
        **{f"{s}_intersection_rate": over(c(f"{s}_sel"), c(f"{s}_fwd"), 100.0) for s in ("left", "right")},
        **{f"{s}_yield": over(c(f"{s}_sel"), c(f"{s}_seeds"), 100.0) for s in ("left", "right")},
        "extraction_rate": over(c("left_sel") + c("right_sel"), c("left_seeds") + c("right_seeds"), 100.0)})


def seeded_stats(tracked: DataFrame, seeds: DataFrame,
                 band: tuple[float, float] = C.LENGTH_BAND_SEEDED) -> DataFrame:
    """Raw, in-band and target-reaching counts per seed side, yields, lengths of the result.

    ``tracked``: subject_id, side, length, reached; ``seeds``: subject_id, side, n_seeds.
    """
    ok = F.col("length").between(*band)
    final = ok & F.col("reached")
    kept = F.when(final, F.col("length"))
    t = tracked.groupBy("subject_id").agg(
        *[count_if((F.col("side") == s) & cond).alias(f"{s}_{n}") for s in ("left", "right")
          for n, cond in (("raw", F.lit(True)), ("after_length", ok), ("count", final))],
        F.avg(kept).alias("length_mean"), F.stddev_pop(kept).alias("length_std"),
        F.min(kept).alias("length_min"), F.max(kept).alias("length_max"))
    sd = seeds.groupBy("subject_id").agg(*[
        F.coalesce(F.sum(F.when(F.col("side") == s, F.col("n_seeds"))), F.lit(0)).alias(f"{s}_seeds")
        for s in ("left", "right")])
    c = F.col
    g = sd.join(t, "subject_id", "left")
    g = g.withColumns({f"{s}_{n}": F.coalesce(f"{s}_{n}", F.lit(0)) for s in ("left", "right")
                       for n in ("raw", "after_length", "count")})
    total = c("left_count") + c("right_count")
    return g.withColumns({
        "total_count": total,
        "left_yield": ratio(c("left_count") * 100, c("left_seeds"), 0.0),
        "right_yield": ratio(c("right_count") * 100, c("right_seeds"), 0.0),
        "extraction_rate": ratio(total * 100, c("left_seeds") + c("right_seeds"), 0.0)})


def peduncle_fa(brainstem: DataFrame, fa_map: DataFrame, mask_grid: G.Grid | None, fa_grid: G.Grid,
                midline_x: Column | None = None, hemisphere: DataFrame | None = None) -> DataFrame:
    """Mean FA left and right in the top 30 % (by z) of the brainstem, FA on its own grid."""
    w = G.world_coords(mask_grid, (F.col("i"), F.col("j"), F.col("k")))
    b = brainstem.withColumns(dict(zip(("wx", "wy", "wz"), w)))
    if hemisphere is not None:
        h = hemisphere.select(*VOX, F.lit(True).alias("_l")).distinct()
        b = b.join(h, VOX, "left").withColumn("is_left", F.coalesce("_l", F.lit(False))).drop("_l")
    else:
        b = b.withColumn("is_left", F.col("wx") < (midline_x if midline_x is not None else lit(0.0)))
    cut = exact_percentiles(b, ["subject_id"], F.col("wz"), {"z_cut": 0.7})
    b = b.select(*VOX, "wx", "wy", "wz", "is_left").join(cut, ["subject_id"])
    top = b.where(F.col("wz") >= F.col("z_cut"))
    v = G.nearest_voxel(fa_grid, (F.col("wx"), F.col("wy"), F.col("wz")))
    p = top.select("subject_id", "is_left", *[c.alias(a) for a, c in zip("ijk", v)])
    s = p.join(fa_map.select(*VOX, "fa"), VOX)
    g = s.groupBy("subject_id").agg(
        *[F.avg(F.when(cond, F.col("fa"))).alias(f"{n}_mean_fa") for n, cond in (("left", F.col("is_left")), ("right", ~F.col("is_left")))],
        count_if(F.col("is_left")).alias("left_n"), count_if(~F.col("is_left")).alias("right_n"))
    return g.withColumns({f"{s}_mean_fa": F.coalesce(f"{s}_mean_fa", lit(0.0)) for s in ("left", "right")})
