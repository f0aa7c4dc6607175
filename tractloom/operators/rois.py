"""Region masks, label volumes, seeds and the anatomical midline, as voxel tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tractloom import constants as C
from tractloom.functions import geometry as G
from tractloom.functions.numeric import count_if, lit, ratio
from tractloom.functions.ranking import exact_percentiles
from tractloom.functions.stage import materialize

VOX = ["subject_id", "i", "j", "k"]


def _world(c: str, grid: G.Grid | None) -> Column:
    return G.world_coords(grid, (F.col("i"), F.col("j"), F.col("k")))["xyz".index(c)]


def split_hemispheres(labels: DataFrame, grid: G.Grid | None = None) -> DataFrame:
    """labels on the right (world x >= 0) get +100; background stays 0."""
    right = (_world("x", grid) >= 0) & (F.col("label") > 0)
    return labels.withColumn("label", F.when(right, F.col("label") + C.RIGHT_LABEL_OFFSET).otherwise(F.col("label")))


def roi_masks(labels: DataFrame, roi_labels: dict[str, int] | None = None) -> DataFrame:
    """voxels whose label is that of a region, with the region's name."""
    name = F
    for roi, label in (roi_labels or C.ROI_LABELS).items():
        name = name.when(F.col("label") == label, roi)
    return labels.withColumn("roi", name).where(F.col("roi").isNotNull())


def offsets(radius: int) -> list[tuple[int, int, int]]:
    r = range(-radius, radius + 1)
    return [(a, b, c) for a in r for b in r for c in r if abs(a) + abs(b) + abs(c) <= radius]


def dilate(mask: DataFrame, radius: Column | int, grid: G.Grid | None = None,
           keys: tuple[str, ...] = ("subject_id",), max_radius: int | None = None, keep: Column | None = None) -> DataFrame:
    """``radius`` steps of 6-connected dilation, clipped to the grid.

    That equals the Manhattan ball, so each voxel writes its ball and duplicates are dropped
    (per task first, then by voxel). ``radius`` may differ per row up to ``max_radius``. ``keep``, a
    condition on ``mask``'s columns and the grown place, goes before duplicates meet.
    """
    if isinstance(radius, int):
        if radius <= 0:
            return mask
        max_radius, radius = radius, F.lit(radius)
    ball = [F.when(radius >= abs(a) + abs(b) + abs(c),
                   F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")))
            for a, b, c in offsets(max_radius)]
    # the whole ball for a fixed radius; a per-row radius drops the outer shells
    d = mask.withColumn("_o", F.explode(F.array_compact(F.array(*ball))))
    d = d.withColumns({x: (F.col(x) + F.col(f"_o.{o}")).cast("int") for x, o in zip("ijk", "abc")})
    inside = G.in_bounds(grid, F.col("i"), F.col("j"), F.col("k"))
    d = d.where(inside if keep is None else inside & keep)
    return d.select(*keys, "i", "j", "k").distinct()


def _own_side(left: Column) -> Column:
    """Whether a region's voxel lies on the region's side; ``left``: whether it is left."""
    return (~F.col("roi").endswith("_left") | left) & (~F.col("roi").endswith("_right") | ~left)


def clamp_to_hemisphere(mask: DataFrame, grid: G.Grid | None = None, midline_x: Column | None = None,
                        hemisphere: DataFrame | None = None) -> DataFrame:
    """left regions keep x < midline, right ones x >= midline; other regions are untouched.

    With ``hemisphere`` (voxels labelled left) that decides instead; with neither nothing changes.
    """
    if hemisphere is not None:
        h = hemisphere.select(*VOX, F.lit(True).alias("_left")).distinct()
        m = mask.join(h, VOX, "left").withColumn("_left", F.coalesce("_left", F.lit(False)))
        return m.where(_own_side(F.col("_left"))).drop("_left")
    return mask if midline_x is None else mask.where(_own_side(_world("x", grid) < midline_x))


def combined_labels(masks: DataFrame) -> DataFrame:
    """one code per voxel (1 brainstem, 2 left, 3 right); a later region overwrites."""
    code = F
    for roi, c in C.ROI_CODES.items():
        code = code.when(F.col("roi") == roi, c)
    return masks.groupBy(*VOX).agg(F.max(code).alias("code"))


def create_roi_masks(labels: DataFrame, grid: G.Grid | None = None, midline_x: Column | None = None,
                     hemisphere: DataFrame | None = None) -> DataFrame:
    """extract, dilate (brainstem 2, motor 1), clamp.

    A plane clamps the grown places one by one, before duplicates meet, so grids do not travel.
    """
    raw = roi_masks(labels)
    shape = [] if grid is not None else ["affine", "nx", "ny", "nz"]
    radius = F.when(F.col("roi") == "brainstem", C.DILATE_BRAINSTEM).otherwise(C.DILATE_MOTOR)
    plane = hemisphere is None and midline_x is not None
    grown = dilate(raw.select(*VOX, "roi", *shape), radius, grid, ("subject_id", "roi"),
                   max(C.DILATE_BRAINSTEM, C.DILATE_MOTOR), _own_side(_world("x", grid) < midline_x) if plane else None)
    return (grown if plane else clamp_to_hemisphere(grown, grid, None, hemisphere)).select("subject_id", "roi", "i", "j", "k")


def tissue_masks(maps: DataFrame, grid: G.Grid | None = None, threshold: float = C.FA_THRESHOLD) -> DataFrame:
    """F8: per voxel the white-matter flag (FA > t in brain, dilated once), the seed flag
    (FA >= t) and FA set to 0 outside the brain for stopping."""
    wm = maps.where((F.col("fa") > threshold) & F.col("brain"))
    shape = [] if grid is not None else ["nx", "ny", "nz"]
    grown = dilate(wm.select(*VOX, *shape), 1, grid).withColumn("white_matter", F.lit(True))
    return maps.join(grown, VOX, "left").select(
        *VOX, F.coalesce("white_matter", F.lit(False)).alias("white_matter"),
        (F.col("fa") >= threshold).alias("seed"),
        F.when(F.col("brain"), F.col("fa")).otherwise(lit(0.0)).alias("stop_fa"))


def seeds(mask: DataFrame, density: int, grid: G.Grid | None = None) -> DataFrame:
    """density^3 evenly spaced seeds in each voxel, in world coordinates."""
    d = mask
    for c in "abc":
        d = d.withColumn(f"_{c}", F.explode(F.sequence(F.lit(0), F.lit(density - 1))))
    frac = [F.col(x) + (F.col(f"_{c}") + lit(0.5)) / lit(density) - lit(0.5) for x, c in zip("ijk", "abc")]
    w = G.world_coords(grid, tuple(frac))
    return d.withColumns(dict(zip("xyz", w))).drop("_a", "_b", "_c")


def roi_geometry(mask: DataFrame, grid: G.Grid | None = None) -> DataFrame:
    """World centre of mass, x extent, distance of the centre from x = 0, voxel count."""
    w = [_world(c, grid) for c in "xyz"]
    g = mask.groupBy("subject_id", "roi").agg(
        *[F.avg(c).alias(f"com_{a}") for a, c in zip("xyz", w)],
        F.min(w[0]).alias("x_min"), F.max(w[0]).alias("x_max"), F.count(F.lit(1)).alias("voxel_count"))
    return g.withColumn("midline_dist", F.abs("com_x"))


def roi_hemisphere_split(mask: DataFrame, midline_x: float | Column = 0.0, grid: G.Grid | None = None) -> DataFrame:
    """Voxels left and right of the midline, their ratio (0 if none right) and percentages.

    ``midline_x`` may be a column of ``mask``, see ``attach_midline``.
    """
    x = _world("x", grid)
    g = mask.groupBy("subject_id", "roi").agg(
        count_if(x < midline_x).alias("left_voxels"), count_if(x >= midline_x).alias("right_voxels"),
        F.count(F.lit(1)).alias("total_voxels"))
    t = F.col("total_voxels")
    return g.withColumns({
        "lr_ratio": ratio(F.col("left_voxels"), F.col("right_voxels"), 0.0),
        "left_pct": F.col("left_voxels") / t * 100, "right_pct": F.col("right_voxels") / t * 100})


def midline_boundary(space: DataFrame, grid: G.Grid | None = None) -> DataFrame:
    """Left brain voxels with a right brain neighbour. ``space`` has ``left`` and ``brain``."""
    shape = [] if grid is not None else ["nx", "ny", "nz"]
    grown = dilate(space.where(~F.col("left") & F.col("brain")).select(*VOX, *shape), 1, grid)
    return space.where(F.col("left") & F.col("brain")).join(grown, VOX, "left_semi")


def midline_x(space: DataFrame, subjects: DataFrame, grid: G.Grid | None = None) -> DataFrame:
    """Median world x of the boundary inside the central y/z slab (15th-85th percentile)."""
    w = [_world(c, grid) for c in "xyz"]
    b = midline_boundary(space, grid).withColumns(dict(zip(("wx", "wy", "wz"), w)))
    b = materialize(b.select(*VOX, "wx", "wy", "wz"))
    lim = exact_percentiles(b, ["subject_id"], F.col("wy"), {"y_lo": 0.15, "y_hi": 0.85}).join(
        exact_percentiles(b, ["subject_id"], F.col("wz"), {"z_lo": 0.15, "z_hi": 0.85}), "subject_id")
    b = b.join(lim, ["subject_id"])
    slab = F.col("wy").between(F.col("y_lo"), F.col("y_hi")) & F.col("wz").between(F.col("z_lo"), F.col("z_hi"))
    inside = exact_percentiles(b.where(slab), ["subject_id"], F.col("wx"), {"m_slab": 0.5})
    whole = exact_percentiles(b, ["subject_id"], F.col("wx"), {"m_all": 0.5})
    return (subjects.join(inside, "subject_id", "left").join(whole, "subject_id", "left")
            .select("subject_id", F.coalesce("m_slab", "m_all", lit(0.0)).alias("midline_x")))


def attach_midline(rows: DataFrame, midlines: DataFrame) -> DataFrame:
    """Each subject's own midline (``midline_x`` of A16) as a column; 0 for subjects without one."""
    m = midlines.select("subject_id", "midline_x")
    return rows.join(m, "subject_id", "left").withColumn("midline_x", F.coalesce("midline_x", lit(0.0)))


def _envelope(at: np.ndarray, of: np.ndarray, known: np.ndarray, spacing: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower envelopes of the parabolas of + (spacing * (n - at))^2, one line per row of ``at`` and ``of``.

    Row r holds known[r] parabolas by rising place. Returns (which, begin, last): which[r, m] is the
    parabola that is least from begin[r, m] on, for m up to last[r]. All lines advance together; a
    parabola enters once and leaves at most once, so the work is linear in the parabolas.
    """
    which, begin = np.zeros(at.shape, dtype=np.int64), np.full(at.shape, -np.inf)
    last, s2 = np.zeros(len(at), dtype=np.int64), spacing * spacing
    for q in range(1, at.shape[1]):
        rows = np.flatnonzero(known > q)
        while len(rows):
            p = which[rows, last[rows]]
            here, there = at[rows, q], at[rows, p]
            cross = (here + there) / 2 + (of[rows, q] - of[rows, p]) / (2 * s2[rows] * (here - there))
            hidden = cross <= begin[rows, last[rows]]
            enters = rows[~hidden]
            last[enters] += 1
            which[enters, last[enters]], begin[enters, last[enters]] = q, cross[~hidden]
            rows = rows[hidden]
            last[rows] -= 1
    return which, begin, last


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _line_distance(places: pd.Series, values: pd.Series, low: pd.Series, high: pd.Series, spacing: pd.Series) -> pd.Series:
    """Squared distances at the places low..high of each line: min over its known places m of value + (spacing * (n - m))^2.

    Read off the lower envelope of the parabolas, so time and memory are linear in a line's length.
    Lines are padded to one length and computed together, some hundred thousand numbers at a time.
    """
    lo, hi, s, known = low.to_numpy(), high.to_numpy(), spacing.to_numpy(dtype=float), places.map(len).to_numpy()
    each = max(1, 500_000 // known.max())
    out = []
    for k in range(0, len(known), each):
        rows = range(k, min(k + each, len(known)))
        count = known[k:k + each]
        at, of = np.zeros((len(rows), count.max())), np.zeros((len(rows), count.max()))
        for r, n in enumerate(rows):
            order = np.argsort(places.iat[n])
            at[r, :count[r]], of[r, :count[r]] = places.iat[n][order], values.iat[n][order]
        which, begin, last = _envelope(at, of, count, s[k:k + each])
        for r, n in enumerate(rows):
            steps = np.arange(lo[n], hi[n] + 1)
            m = which[r, np.searchsorted(begin[r, :last[r] + 1], steps, side="right") - 1]
            gap = (steps - at[r, m]) * s[n]
            out.append(of[r, m] + gap * gap)
    return pd.Series(out)


def midline_distance(space: DataFrame, sizes: tuple[Column, Column, Column],
                     grid: G.Grid | None = None) -> DataFrame:
    """Exact Euclidean distance (mm) to the boundary, negative on the left, 0 outside brain.

    The separable transform on voxel indices, so ``space`` may be sparse: one pass along each axis
    over the lines that hold a known squared distance, which fills these lines between the
    subject's first and last index. A line holds at most a grid's edge length of voxels. Only the
    squared distance travels; sides and brain are joined at the end. A brain voxel of a subject
    without any boundary has no distance (NULL).
    """
    s = space.withColumns({f"_s{a}": c for a, c in zip("ijk", sizes)})
    frame = s.groupBy("subject_id").agg(
        *[f(a).alias(f"{n}_{a}") for a in "ijk" for n, f in (("lo", F.min), ("hi", F.max))], *[F.first(f"_s{a}").alias(f"_s{a}") for a in "ijk"])
    d = midline_boundary(space, grid).select(*VOX, lit(0.0).alias("d2"))
    for axis in "kji":
        others = [a for a in "ijk" if a != axis]
        line = d.groupBy("subject_id", *others).agg(F.collect_list(F.struct(axis, "d2")).alias("_l"))
        line = line.join(frame.select("subject_id", f"lo_{axis}", f"hi_{axis}", f"_s{axis}"), "subject_id")
        along = _line_distance(F.col(f"_l.{axis}"), F.col("_l.d2"), F.col(f"lo_{axis}"), F.col(f"hi_{axis}"), F.col(f"_s{axis}"))
        d = line.select("subject_id", *others, f"lo_{axis}", F.posexplode(along).alias("_n", "d2"))
        d = d.select("subject_id", *others, (F.col(f"lo_{axis}") + F.col("_n")).cast("int").alias(axis), "d2")
    out = space.select(*VOX, "left", "brain").join(d, VOX, "left")
    dist = F.sqrt("d2")
    return out.select(*VOX, F.when(~F.col("brain"), lit(0.0)).when(F.col("left"), -dist).otherwise(dist).alias("distance"))


def label_inventory(labels: DataFrame, subjects: DataFrame, expected: list[int]) -> DataFrame:
    """Every positive or expected label of a subject with its voxel count and status."""
    found = labels.where(F.col("label") > 0).groupBy("subject_id", "label").agg(F.count(F.lit(1)).alias("voxels"))
    want = subjects.select("subject_id", F.explode(F.array(*map(F.lit, expected))).alias("label"),
                           F.lit(True).alias("expected"))
    d = found.join(want, ["subject_id", "label"], "full_outer")
    d = d.withColumns({"voxels": F.coalesce("voxels", F.lit(0)), "expected": F.coalesce("expected", F.lit(False))})
    d = d.withColumn("missing", F.col("expected") & (F.col("voxels") == 0))
    bad = d.groupBy("subject_id").agg((F.max(F.col("missing").cast("int")) == 0).alias("success"))
    return d.join(bad, "subject_id")


def densest_slices(masks: DataFrame, subjects: DataFrame, shape: tuple[int, int, int] | None = None) -> DataFrame:
    """Per axis the slice with most region voxels, lowest index on ties, middle if none.

    Without a common ``shape`` the middle is that of the subject's own nx, ny, nz. The masks are read
    once for the three axes.
    """
    vox = masks.select(*VOX).distinct()
    sizes = [F.col(n).cast("int") for n in ("nx", "ny", "nz")] if shape is None else list(map(F.lit, shape))
    out = subjects.select("subject_id", *[F.floor(n / 2).cast("int").alias(f"_mid_{a}") for a, n in zip("ijk", sizes)])
    slices = vox.select("subject_id", F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).alias("at")) for a in "ijk"])))
    counts = slices.groupBy("subject_id", "axis", "at").agg(F.count(F.lit(1)).alias("c"))
    best = counts.groupBy("subject_id").agg(*[g for a in "ijk" for g in (
        F.max_by(F.when(F.col("axis") == a, F.col("at")), F.when(F.col("axis") == a, F.struct("c", -F.col("at")))).alias(f"slice_{a}"),
        F.max(F.when(F.col("axis") == a, F.col("c"))).alias(f"count_{a}"))])
    out = out.join(best, "subject_id", "left")
    return out.select("subject_id", *[c for a in "ijk" for c in (
        F.coalesce(f"slice_{a}", f"_mid_{a}").alias(f"slice_{a}"), F.coalesce(f"count_{a}", F.lit(0)).alias(f"count_{a}"))])
