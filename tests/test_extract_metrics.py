import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tractloom.functions.geometry import Grid
from tractloom.functions.laterality import li_columns
from tractloom.functions.numeric import lit
from tractloom.operators import compare as cp, extract as ex, metrics as me, streamlines as sl
from tractloom.operators.geometry import voxelise
from tests.conftest import IDENTITY

BIG = Grid(IDENTITY, (30, 30, 30))


def roi(spark, **voxels):
    return spark.createDataFrame([(0, r, *v) for r, vs in voxels.items() for v in vs], "subject_id long, roi string, i int, j int, k int")


def test_rounding_is_half_to_even(make_points):
    v = voxelise(make_points({1: [(0.5, 1.5, 2.5), (-0.4, 9.5, 3.0)]}), Grid(IDENTITY, (10, 10, 10))).orderBy("pt_idx").collect()
    assert (v[0].i, v[0].j, v[0].k, v[0].inb) == (0, 2, 2, True)
    assert (v[1].i, v[1].j, v[1].inb) == (0, 10, False)


def test_passthrough_and_endpoint_pair(spark, make_points):
    p = make_points({1: [(10, 10, 0), (10, 10, 5), (10, 10, 10)], 2: [(20, 20, 0), (20, 20, 5), (20, 20, 10)]})
    r = roi(spark, brainstem=[(10, 10, 0)], motor_left=[(10, 10, 10)], motor_right=[(25, 25, 25)])
    e = ex.extract_endpoints(p, BIG, r, (1.0, 200.0))
    assert {x.streamline_id for x in e.where("left").collect()} == {1}
    s = ex.endpoint_stats(e).first()
    assert (s.left_count, s.right_count, s.total_count) == (1, 0, 1) and math.isinf(s.left_right_ratio)
    f = {x.streamline_id: x.fate for x in ex.assign_fates(ex.streamline_table(p, BIG, r), (1.0, 200.0)).collect()}
    assert f == {1: "left", 2: "no_brainstem"}


def test_fates_order_of_rules(spark, make_points):
    stem, ml, mr = (15, 15, 0), (5, 15, 9), (25, 15, 9)
    p = make_points({
        1: [stem, (15, 15, 5), (5, 15, 9)], 2: [stem, (5, 15, 9), (25, 15, 9)],
        3: [(1, 15, 0), stem, (29, 15, 5)], 4: [stem, (15, 15, 5)], 5: [stem, (25, 15, 9)], 6: [(5, 15, 9), (25, 15, 9)]})
    r = roi(spark, brainstem=[stem], motor_left=[ml], motor_right=[mr])
    t = ex.assign_fates(ex.streamline_table(p, BIG, r), (5.0, 200.0), lit(15.0))
    f = {x.streamline_id: x.fate for x in t.collect()}
    # 3 crosses deeply and reaches no motor region: crossing is decided first
    assert f == {1: "left", 2: "bilateral_excluded", 3: "midline_excluded", 4: "no_motor", 5: "right", 6: "no_brainstem"}
    s = ex.funnel(t, 15.0).first()
    assert (s.passes_brainstem, s.bilateral_excluded, s.midline_excluded, s.total_count) == (5, 1, 1, 2)


def test_curved_midline_uses_floor(spark, make_points):
    d = spark.createDataFrame([(0, i, 0, 0, float(10 * (i - 1))) for i in range(4)], "subject_id long, i int, j int, k int, distance double")
    g = Grid(IDENTITY, (4, 1, 1))
    c = {r.streamline_id: r.crosses for r in ex.crosses_surface(make_points({1: [(0.9, 0, 0), (2.1, 0, 0)], 2: [(1.9, 0, 0), (2.9, 0, 0)], 3: [(9, 9, 9)]}), g, d).collect()}
    assert c == {1: True, 2: False, 3: False}


def test_headline_is_not_length_biased(spark, make_points, grid):
    v = spark.range(10).selectExpr("0L subject_id", "5 i", "5 j", "cast(id as int) k", "0.9 - 0.1 * (id - 1) fa")
    v = v.withColumn("fa", F.col("fa").cast("double"))
    lines = {s: [(5, 5, z) for z in range(1, 4)] for s in (1, 2, 3)} | {4: [(5, 5, z) for z in range(1, 9)]}
    b = make_points(lines).withColumn("side", F.lit("left"))
    s = me.scalar_summary(me.sample(voxelise(b, grid), v, ("fa",)), ("fa",)).first()
    short, long_ = np.array([0.9, 0.8, 0.7]), 0.9 - 0.1 * np.arange(8)
    means = np.array([short.mean()] * 3 + [long_.mean()])
    pool = np.concatenate([short] * 3 + [long_])
    assert s["mean"] == pytest.approx(means.mean()) and s["std"] == pytest.approx(means.std())
    assert s["pool_mean"] == pytest.approx(pool.mean()) and s["pool_median"] == pytest.approx(np.median(pool))
    assert abs(s["mean"] - s["pool_mean"]) > 0.05 and (s["n_streamlines"], s["n_samples"]) == (4, 17)


def profile_of(values, n=20):
    v = np.asarray(values)
    if len(v) >= n:
        return v[np.linspace(0, len(v) - 1, n).astype(int)]
    return np.interp(np.linspace(0, 1, n), np.linspace(0, 1, len(v)), v)


@pytest.mark.parametrize("length", [5, 9, 10, 4])
def test_profile_short_streamlines(make_points, ramp, grid, length):
    b = make_points({1: [(5, 5, z) for z in range(length)][::-1]}).withColumn("side", F.lit("left"))
    got = [r.value for r in me.tract_profile(b, grid, ramp, ("fa",)).orderBy("place").collect()]
    if length < 5:
        assert got == []
    else:
        assert got == pytest.approx(profile_of([z / 9 for z in range(length)]))


def test_profile_drops_outside_and_mixes_orientations(make_points, ramp, grid):
    up = [(5, 5, z / 4) for z in range(-8, 44)]
    b = make_points({1: up, 2: up[::-1]}).withColumn("side", F.lit("left"))
    inside = [np.rint(z / 4) / 9 for z in range(-8, 44) if 0 <= np.rint(z / 4) < 10]
    got = [r.value for r in me.tract_profile(b, grid, ramp, ("fa",)).orderBy("place").collect()]
    assert got == pytest.approx(profile_of(inside))
    reg = {r.region: r.value for r in me.region_means(me.tract_profile(b, grid, ramp, ("fa",))).collect()}
    want = profile_of(inside)
    assert reg == pytest.approx({"pontine": want[:7].mean(), "plic": want[7:14].mean(), "precentral": want[14:].mean()})


def test_streamline_in_both_sides_keeps_its_length(make_points):
    p = make_points({1: [(0, 0, 0), (0, 0, 4)]})
    b = p.withColumn("side", F.explode(F.array(F.lit("left"), F.lit("right"))))
    m = me.morphology(b, voxelise(b, BIG), lit(8.0)).collect()
    assert {(r.side, r.n_streamlines, r.mean_length, r.tract_volume) for r in m} == {("left", 1, 4.0, 16.0), ("right", 1, 4.0, 16.0)}


def test_laterality(spark):
    d = spark.createDataFrame([(3.0, 1.0), (1.0, 1.0), (0.0, 0.0), (1.02, 1.0), (1.0, 1.2)], "l double, r double")
    li = li_columns(F.col("l"), F.col("r"))
    got = [(r.laterality_index, r.interpretation) for r in d.select(*[c.alias(n) for n, c in li.items()]).collect()]
    assert got[0] == (0.5, "strong asymmetry (left > right)") and got[1] == (0.0, "symmetric") and got[2] == (0.0, "no data")
    assert got[3][1] == "symmetric (left > right)" and got[4][1] == "mild asymmetry (right > left)"


def overlap(make_points, spark, cand, ref, grid):
    s = spark.createDataFrame([(0,)], "subject_id long")
    return cp.bundle_overlap(voxelise(make_points(cand), grid), voxelise(make_points(ref), grid), s).first()


def test_bundle_overlap_cases(make_points, spark, grid):
    line = {1: [(1, 1, z) for z in range(5)]}
    same = overlap(make_points, spark, line, line, grid)
    assert (same.dice, same.coverage, same.overreach, same.count_ratio) == (1.0, 1.0, 0.0, 1.0)
    apart = overlap(make_points, spark, line, {1: [(8, 8, z) for z in range(5)]}, grid)
    assert (apart.dice, apart.coverage, apart.overreach) == (0.0, 0.0, 1.0)
    sub = overlap(make_points, spark, {1: line[1][:2]}, line, grid)
    assert sub.coverage == pytest.approx(0.4) and sub.overreach == 0.0
    no_ref = overlap(make_points, spark, line, {}, grid)
    assert math.isnan(no_ref.dice) and math.isnan(no_ref.coverage) and math.isnan(no_ref.count_ratio)
    no_cand = overlap(make_points, spark, {}, line, grid)
    assert (no_cand.dice, no_cand.overreach) == (0.0, 0.0)


def test_closest_distance_two_lines(make_points):
    a = make_points({1: [(0, 0, z) for z in range(9)]})
    b = make_points({1: [(2, 0, z) for z in range(9)]})
    d = cp.mean_closest_distance(a, b).first()
    assert (d.symmetric, d.cand_to_ref, d.ref_to_cand, d["std"]) == pytest.approx((2.0, 2.0, 2.0, 0.0))


def test_nearest_distance_brute_force_with_hot_cell_and_outlier(spark):
    rng = np.random.default_rng(5)
    src = np.concatenate([rng.normal(0, 20, (150, 3)), rng.normal(0, 0.05, (80, 3)), [[300.0, -200.0, 90.0]]])
    tgt = np.concatenate([rng.normal(1, 15, (120, 3)), rng.normal(0, 0.05, (80, 3))])

    def frame(a):
        return spark.createDataFrame([(0, *map(float, p)) for p in np.concatenate([a, a[:3]])], "subject_id long, x double, y double, z double")

    got = {(r.x, r.y, r.z): (r.distance, r.weight) for r in cp.nearest_distance(frame(src), frame(tgt)).collect()}
    for n, p in enumerate(src):
        d, w = got[tuple(map(float, p))]
        assert d == pytest.approx(np.linalg.norm(tgt - p, axis=1).min()) and w == (2 if n < 3 else 1)
    assert len(got) == len(src)


def test_selection_caps_and_ties(spark):
    sc = spark.createDataFrame([(0, "left", s, v) for s, v in ((1, 5), (2, 5), (3, 0), (4, 900), (5, 5))], "subject_id long, side string, streamline_id long, score long")
    caps = spark.createDataFrame([(0, "left", 3)], "subject_id long, side string, cap long")
    kept = ex.select_top(sc, caps, ["subject_id", "side"]).orderBy("rank").collect()
    assert [r.streamline_id for r in kept] == [4, 5, 2]


def test_metric_difference(spark):
    a = spark.createDataFrame([(0, "fa", 0.5), (0, "md", 0.0), (0, "x", 1.0)], "subject_id long, metric string, value double")
    b = spark.createDataFrame([(0, "fa", 0.5 + 1e-10), (0, "md", 1e-3), (0, "y", 1.0)], "subject_id long, metric string, value double")
    d = {r.metric: r for r in cp.metric_difference(a, b).collect()}
    assert d["fa"].status == "equal" and d["md"].status == "different" and math.isinf(d["md"].relative_diff)
    assert d["x"].status == "missing_in_second" and d["y"].status == "missing_in_first"


def test_an_empty_side_is_zero(spark, grid, make_points, ramp):
    """Subject 0 has a left bundle only, subject 1 a right one, subject 2 none."""
    lines = {1: [(5, 5, z) for z in range(2, 9)]}
    b = make_points(lines).withColumn("side", F.lit("left")).union(make_points(lines, 1).withColumn("side", F.lit("right")))
    maps = ramp.union(ramp.withColumn("subject_id", F.lit(1).cast("long")))
    m = me.metrics_long(b, grid, maps, ("fa",), spark.range(3).withColumnRenamed("id", "subject_id"))
    c = {(r.subject_id, r.quantity): r for r in me.compare_sides(m, me.comparison_metrics(("fa",))).collect()}
    assert {q for s, q in c if s == 2} == {q for s, q in c if s == 0} and len(c) == 3 * 7
    assert {c[0, q].laterality_index for q in ("volume", "streamline_count", "fa")} == {1.0} and c[0, "fa"].right_value == 0
    assert c[1, "fa"].laterality_index == -1 and c[1, "fa"].interpretation == "strong asymmetry (right > left)"
    assert {r.interpretation for (s, _), r in c.items() if s == 2} == {"no data"}
    assert me.tract_profile(b, grid, maps, ("fa",), subjects=spark.range(2, 3).withColumnRenamed("id", "subject_id")).count() == 2 * 20


def test_missing_side_in_the_index(spark):
    d = spark.createDataFrame([(0, None, 0.4), (1, 0.4, None), (2, None, None)], "n int, l double, r double")
    got = d.select("n", *[c.alias(k) for k, c in li_columns(F.col("l"), F.col("r")).items()]).orderBy("n").collect()
    assert [(r.laterality_index, r.interpretation) for r in got] == [(-1, "strong asymmetry (right > left)"), (1, "strong asymmetry (left > right)"), (0, "no data")]


def test_an_empty_bundle_has_nan_distances(spark, make_points):
    a = make_points({1: [(0, 0, z) for z in range(6)]})
    got = {r.subject_id: r for r in cp.mean_closest_distance(a, make_points({1: [(0, 2, z) for z in range(6)]}).where("false"), subjects=spark.range(2).withColumnRenamed("id", "subject_id")).collect()}
    assert set(got) == {0, 1} and all(math.isnan(v) for r in got.values() for v in (r.symmetric, r.cand_to_ref, r.ref_to_cand, r.std))


def test_distance_over_a_gap(spark):
    from tractloom.operators import rois
    i = [0, 1, 2, 8, 9, 10]
    d = spark.createDataFrame([(0, n, 0, 0, n < 2, True, 12, 1, 1) for n in i] + [(1, 3, 0, 0, True, True, 12, 1, 1)],
                              "subject_id long, i int, j int, k int, left boolean, brain boolean, nx int, ny int, nz int")
    got = {(r.subject_id, r.i): r.distance for r in rois.midline_distance(d, (lit(1.0), lit(1.0), lit(1.0))).collect()}
    assert got == {(0, 0): -1, (0, 1): 0, (0, 2): 1, (0, 8): 7, (0, 9): 8, (0, 10): 9, (1, 3): None}


@pytest.mark.parametrize("spacing", (0.5, 1.0, 2.75))
def test_envelope_of_a_line_equals_all_pairs(spark, spacing):
    """Whole, sparse and single-voxel lines of up to 512 places, in any order, with ties."""
    from tractloom.operators import rois
    rng = np.random.default_rng(int(spacing * 4))
    lines = [rng.permutation(512)[:n] for n in (1, 2, 7, 200, 512)]
    values = [np.round(rng.exponential(400, len(p))) if n % 2 else np.zeros(len(p)) for n, p in enumerate(lines)]
    values[-1] = ((lines[-1] - 256.0) ** 2)
    got = rois._line_distance.func(pd.Series(list(lines)), pd.Series(values), pd.Series([0] * 5), pd.Series([511] * 5), pd.Series([spacing] * 5))
    for p, v, d in zip(lines, values, got):
        gap = (np.arange(512)[:, None] - p[None, :]) * spacing
        assert np.allclose(d, (v[None, :] + gap * gap).min(axis=1), rtol=1e-12)


def test_equal_scores_are_split(spark):
    from tractloom.functions.ranking import BUCKETS, with_buckets
    n = 4000
    s = spark.range(n).selectExpr("0L subject_id", "'left' side", "id streamline_id", "case when id % 4 < 3 then 7L else id + 8 end score")
    sizes = [r["count"] for r in with_buckets(s, ["subject_id"], -F.col("score"), tie=-F.col("streamline_id")).groupBy("_bucket").count().collect()]
    assert max(sizes) <= 2 * n / BUCKETS
    caps = spark.createDataFrame([(0, "left", n)], "subject_id long, side string, cap long")
    kept = ex.select_top(s, caps, ["subject_id", "side"]).orderBy("rank").collect()
    want = sorted(((i if i % 4 == 3 else -1, i) for i in range(n)), key=lambda v: (v[0] + 8 if v[0] >= 0 else 7, v[1]), reverse=True)
    assert [r.streamline_id for r in kept] == [i for _, i in want] and [r["rank"] for r in kept] == list(range(n))


def test_subjects_have_their_own_midline(spark):
    from tractloom.operators import rois
    mid = spark.createDataFrame([(0, 2.0), (1, None)], "subject_id long, midline_x double")
    t = spark.createDataFrame([(n, s, 100.0, True, s == 1, False, -20.0, 1.0, 1.0, 1.0, 0.0) for n in range(3) for s in (1, 2)],
                              "subject_id long, streamline_id long, length double, brainstem boolean, motor_left boolean, motor_right boolean, x_min double, x_max double, x_mean double, entry_x double, z_min double")
    f = ex.assign_fates(rois.attach_midline(t, mid), midline_x=F.col("midline_x"))
    got = {r.subject_id: (r.input_left, r.input_right) for r in ex.funnel(f, F.col("midline_x")).collect()}
    assert got == {0: (2, 0), 1: (0, 2), 2: (0, 2)}
    assert {(r.subject_id, r.side, r.n_correct) for r in ex.entry_diagnostics(f, F.col("midline_x")).collect()} == {(0, "left", 2), (1, "right", 2), (2, "right", 2)}
