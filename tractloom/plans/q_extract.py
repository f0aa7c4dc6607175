"""Queries of the selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractloom.functions import geometry as G
from tractloom.functions.numeric import lit, rnd
from tractloom.functions.stage import materialize
from tractloom.operators import bricks, extract as ex, rois, streamlines as sl
from tractloom.operators.geometry import voxelise
from tractloom.plans import fixtures as fx
from tractloom.plans.fixtures import GRID, SQL_LENS, SQL_VOX, r6, sql_fates
from tractloom.plans.q_rois import A16_TABLE, BOUND, WITH, a16
from tractloom.plans.registry import query

M = repr(fx.MIDLINE) + "e0"


def _vox(spark, sf):
    return voxelise(fx.points(spark, sf), GRID)


@query("J2_passes_roi", f"""WITH {SQL_VOX}
SELECT DISTINCT subject_id, streamline_id FROM vox WHERE inb AND k BETWEEN 4 AND 9""")
def j2(spark, sf):
    v = _vox(spark, sf)
    return ex.filter_by_roi(fx.points(spark, sf), v, fx.roi_voxels(spark).where("roi = 'brainstem'"))


@query("J2_brick_passes", f"""WITH {SQL_VOX}
SELECT subject_id, streamline_id, bool_or(inb AND k BETWEEN 4 AND 9) AS brainstem, bool_or(inb AND k BETWEEN 26 AND 40 AND i < 25) AS motor_left,
  bool_or(inb AND k BETWEEN 26 AND 40 AND i >= 25) AS motor_right FROM vox GROUP BY 1, 2""")
def j2_bricks(spark, sf):
    return bricks.passes(_vox(spark, sf), bricks.pack_masks(fx.roi_voxels(spark), ex.ROIS), ex.ROIS, ["subject_id", "streamline_id"])


ENDS = """,
ends AS (SELECT subject_id, streamline_id, arg_min(CASE WHEN NOT inb THEN '-' WHEN k BETWEEN 4 AND 9 THEN 'b'
     WHEN k BETWEEN 26 AND 40 THEN CASE WHEN i < 25 THEN 'l' ELSE 'r' END ELSE '-' END, pt_idx) AS s,
   arg_max(CASE WHEN NOT inb THEN '-' WHEN k BETWEEN 4 AND 9 THEN 'b'
     WHEN k BETWEEN 26 AND 40 THEN CASE WHEN i < 25 THEN 'l' ELSE 'r' END ELSE '-' END, pt_idx) AS e
  FROM vox GROUP BY 1, 2)"""


@query("J3_endpoint_filter", f"""WITH {SQL_VOX}{ENDS}
SELECT subject_id, streamline_id FROM ends WHERE s || e IN ('bl', 'lb')""")
def j3(spark, sf):
    f = ex.endpoint_flags(fx.points(spark, sf), GRID, fx.roi_voxels(spark))
    return f.where(ex.connects("brainstem", "motor_left")).select("subject_id", "streamline_id")


@query("J4_endpoint_extraction", f"""WITH {SQL_VOX}{SQL_LENS}{ENDS},
f AS (SELECT subject_id, length BETWEEN 6e1 AND 2e2 AS ok, s || e IN ('bl', 'lb') AS l, s || e IN ('br', 'rb') AS r
  FROM ends JOIN lens USING (subject_id, streamline_id)),
g AS (SELECT subject_id, count(*) AS total_input, count(*) FILTER (ok) AS after_length_filter,
  count(*) FILTER (ok AND l) AS left_count, count(*) FILTER (ok AND r) AS right_count FROM f GROUP BY 1)
SELECT *, left_count + right_count AS total_count, {r6('(left_count + right_count) * 100 / total_input::DOUBLE')} AS extraction_rate,
  CASE WHEN right_count = 0 THEN 'inf'::DOUBLE ELSE {r6('left_count / right_count::DOUBLE')} END AS left_right_ratio FROM g""")
def j4(spark, sf):
    s = ex.endpoint_stats(ex.extract_endpoints(fx.points(spark, sf), GRID, fx.roi_voxels(spark), fx.BAND))
    return s.withColumns({c: rnd(F.col(c)) for c in ("extraction_rate", "left_right_ratio")})


@query("U1_combined_bundles", f"""WITH {SQL_VOX}{SQL_LENS}{ENDS}
SELECT subject_id, streamline_id, CASE WHEN s || e IN ('bl', 'lb') THEN 'left' ELSE 'right' END AS side
FROM ends JOIN lens USING (subject_id, streamline_id) WHERE length BETWEEN 6e1 AND 2e2 AND s || e IN ('bl', 'lb', 'br', 'rb')""")
def u1(spark, sf):
    return ex.endpoint_bundles(ex.extract_endpoints(fx.points(spark, sf), GRID, fx.roi_voxels(spark), fx.BAND))


def fates(spark, sf, midline=0.0, points=None):
    t = ex.streamline_table(fx.points(spark, sf) if points is None else points, GRID, fx.roi_voxels(spark))
    return ex.assign_fates(t, fx.BAND, lit(midline))


@query("J5_passthrough_fates", f"WITH {sql_fates()} SELECT subject_id, streamline_id, {r6('length')} AS length, fate FROM fates")
def j5(spark, sf):
    return fates(spark, sf).select("subject_id", "streamline_id", rnd(F.col("length")).alias("length"), "fate")


@query("J6_midline_plane", f"""WITH {sql_fates()}
SELECT subject_id, streamline_id, xmin < -8e0 AND xmax > 8e0 AS crosses FROM fates""")
def j6(spark, sf):
    p = fx.points(spark, sf).groupBy("subject_id", "streamline_id").agg(F.min("x").alias("x_min"), F.max("x").alias("x_max"))
    return p.select("subject_id", "streamline_id", ex.crosses_plane(lit(0.0)).alias("crosses"))


@query("J6_midline_surface", f"""WITH {SQL_VOX},
f AS (SELECT *, CAST(floor((x + 5e1) / 2e0) AS INT) AS fi, CAST(floor((y + 5e1) / 2e0) AS INT) AS fj, CAST(floor((z + 4e1) / 2e0) AS INT) AS fk FROM vox),
d AS (SELECT subject_id, streamline_id, min(2e0*fi - 49e0 + (fj % 3)) AS lo, max(2e0*fi - 49e0 + (fj % 3)) AS hi FROM f
  WHERE fi BETWEEN 0 AND 49 AND fj BETWEEN 0 AND 49 AND fk BETWEEN 0 AND 59 GROUP BY 1, 2)
SELECT subject_id, streamline_id, coalesce(lo < -8 AND hi > 8, false) AS crosses
FROM (SELECT DISTINCT subject_id, streamline_id FROM pts) LEFT JOIN d USING (subject_id, streamline_id)""")
def j6b(spark, sf):
    dist = fx.voxels(spark).select("subject_id", "i", "j", "k",
                                   (lit(2.0) * F.col("i") - lit(49.0) + F.col("j") % 3).alias("distance"))
    return ex.crosses_surface(fx.points(spark, sf), GRID, dist)


@query("A3_density_map", f"""WITH {SQL_VOX}
SELECT subject_id, i, j, k, count(DISTINCT streamline_id) AS n_streamlines FROM vox WHERE inb GROUP BY ALL""")
def a3(spark, sf):
    return ex.density_map(_vox(spark, sf))


BIDIR = f"""WITH {sql_fates()},
fwd AS (SELECT subject_id, streamline_id, CASE (streamline_id // 8) % 4 WHEN 0 THEN 'left' ELSE 'right' END AS side, length
  FROM fates WHERE in_band AND bs AND (streamline_id // 8) % 4 IN (0, 1)),
rev AS (SELECT subject_id, streamline_id, CASE WHEN (streamline_id // 8) % 4 = 2 THEN 'left' ELSE 'right' END AS side
  FROM fates WHERE in_band AND (((streamline_id // 8) % 4 = 2 AND ml) OR ((streamline_id // 8) % 8 = 3 AND mr))),
den AS (SELECT side, v.subject_id, i, j, k, count(DISTINCT streamline_id) AS n FROM vox v JOIN rev USING (subject_id, streamline_id) WHERE inb GROUP BY ALL),
sco AS (SELECT f.side, f.subject_id, f.streamline_id, f.length, CAST(coalesce(sum(n) FILTER (inb), 0) AS BIGINT) AS score
  FROM fwd f JOIN vox v USING (subject_id, streamline_id) LEFT JOIN den d ON d.side = f.side AND d.subject_id = v.subject_id
    AND d.i = v.i AND d.j = v.j AND d.k = v.k GROUP BY ALL),
cap AS (SELECT subject_id, side, least((SELECT count(*) FROM fwd f WHERE f.subject_id = s.subject_id AND f.side = s.side),
   (SELECT count(*) FROM rev r WHERE r.subject_id = s.subject_id AND r.side = s.side)) AS cap
  FROM (SELECT DISTINCT subject_id, side FROM fwd) s),
sel AS (SELECT s.* FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, side ORDER BY score DESC, streamline_id DESC) AS rn
   FROM sco WHERE score > 0) s JOIN cap USING (subject_id, side) WHERE rn <= cap)"""


def _bidir(spark, sf):
    p = materialize(fx.points(spark, sf))  # four steps read the vertices
    f = materialize(fates(spark, sf, points=p).where("fate <> 'length'"))
    g = F.expr("streamline_id div 8")
    m = g % 4
    fwd = f.where(F.col("brainstem") & m.isin(0, 1)).withColumn("side", F.when(m == 0, "left").otherwise("right"))
    rev = f.where(((m == 2) & F.col("motor_left")) | ((g % 8 == 3) & F.col("motor_right"))) \
        .withColumn("side", F.when(m == 2, "left").otherwise("right"))
    key = ["subject_id", "streamline_id"]
    v = voxelise(p, GRID).select(*key, "i", "j", "k", "inb")
    dens = ex.density_map(v.join(rev.select(*key, "side"), key), ["side"])
    scores = ex.overlap_scores(v.join(fwd.select(*key, "side"), key), dens, ["side"])
    caps = fwd.groupBy("subject_id", "side").agg(F.count(F.lit(1)).alias("nf")).join(
        rev.groupBy("subject_id", "side").agg(F.count(F.lit(1)).alias("nr")), ["subject_id", "side"], "left")
    caps = caps.withColumn("cap", F.least("nf", F.coalesce("nr", F.lit(0))))
    return fwd, rev, scores, caps


@query("J7_overlap_score", BIDIR + " SELECT side, subject_id, streamline_id, score FROM sco")
def j7(spark, sf):
    return _bidir(spark, sf)[2]


@query("T1_top_by_overlap", BIDIR + " SELECT side, subject_id, streamline_id, score, rn - 1 AS rank FROM sel")
def t1(spark, sf):
    _, _, scores, caps = _bidir(spark, sf)
    return ex.select_top(scores, caps, ["subject_id", "side"])


SEEDS = """,
sd AS (SELECT s AS subject_id, 'left' AS side, 8 * 15 * 25 * 50 AS n_seeds FROM range(8) t(s) UNION ALL
  SELECT s, 'right', 8 * 15 * 25 * 50 FROM range(8) t(s) UNION ALL SELECT s, 'brainstem', 8 * 6 * 50 * 50 FROM range(8) t(s))"""


def _seed_counts(spark):
    side = F.when(F.col("roi") == "brainstem", "brainstem").otherwise(F.substring_index("roi", "_", -1))
    v = fx.roi_voxels(spark).groupBy("subject_id", side.alias("side")).agg(F.count(F.lit(1)).alias("v"))
    return v.select("subject_id", "side", (F.col("v") * 8).alias("n_seeds"))


@query("A13_bidirectional_stats", BIDIR + SEEDS + f""",
n AS (SELECT s AS subject_id,
  (SELECT count(*) FROM fwd WHERE subject_id = s AND side = 'left') AS left_fwd, (SELECT count(*) FROM fwd WHERE subject_id = s AND side = 'right') AS right_fwd,
  (SELECT count(*) FROM rev WHERE subject_id = s AND side = 'left') AS left_rev, (SELECT count(*) FROM rev WHERE subject_id = s AND side = 'right') AS right_rev,
  (SELECT count(*) FROM sel WHERE subject_id = s AND side = 'left') AS left_sel, (SELECT count(*) FROM sel WHERE subject_id = s AND side = 'right') AS right_sel,
  (SELECT avg(length) FROM sel WHERE subject_id = s) AS lm, (SELECT stddev_pop(length) FROM sel WHERE subject_id = s) AS ls,
  (SELECT min(length) FROM sel WHERE subject_id = s) AS l0, (SELECT max(length) FROM sel WHERE subject_id = s) AS l1 FROM range(8) t(s)),
i AS (SELECT *, left_fwd::DOUBLE / greatest(left_rev, 1) AS il, right_fwd::DOUBLE / greatest(right_rev, 1) AS ir FROM n)
SELECT subject_id, left_fwd, right_fwd, left_rev, right_rev, left_sel, right_sel, 150000::BIGINT AS left_seeds, 150000::BIGINT AS right_seeds, 120000::BIGINT AS brainstem_seeds,
  {r6('il')} AS inflation_left, {r6('ir')} AS inflation_right, {r6('abs(il - ir) / greatest(il, ir, 1e0)')} AS artifact_index,
  abs(il - ir) / greatest(il, ir, 1e0) > 2e-1 AS flagged, {r6('left_sel::DOUBLE / greatest(left_fwd, 1) * 100')} AS left_intersection_rate,
  {r6('right_sel::DOUBLE / greatest(right_fwd, 1) * 100')} AS right_intersection_rate, {r6('left_sel / 15e4 * 100')} AS left_yield,
  {r6('right_sel / 15e4 * 100')} AS right_yield, {r6('(left_sel + right_sel) / 3e5 * 100')} AS extraction_rate,
  {r6('lm')} AS length_mean, {r6('ls')} AS length_std, {r6('l0')} AS length_min, {r6('l1')} AS length_max FROM i""")
def a13(spark, sf):
    fwd, rev, scores, caps = _bidir(spark, sf)
    key = ["subject_id", "streamline_id"]
    sel = ex.select_top(scores, caps, ["subject_id", "side"]).join(fwd.select(*key, "length"), key)
    s = ex.bidirectional_stats(fwd, rev, sel, _seed_counts(spark))
    return s.withColumns({n: rnd(F.col(n)) for n, t in s.dtypes if t == "double"})


@query("A12_seeded_stats", f"WITH {sql_fates()}" + f""",
t AS (SELECT subject_id, CASE WHEN (streamline_id // 8) % 2 = 0 THEN 'left' ELSE 'right' END AS side, length, bs, length BETWEEN 6e1 AND 2e2 AS ok FROM fates),
g AS (SELECT subject_id, count(*) FILTER (side = 'left') AS left_raw, count(*) FILTER (side = 'left' AND ok) AS left_after_length,
  count(*) FILTER (side = 'left' AND ok AND bs) AS left_count, count(*) FILTER (side = 'right') AS right_raw,
  count(*) FILTER (side = 'right' AND ok) AS right_after_length, count(*) FILTER (side = 'right' AND ok AND bs) AS right_count,
  avg(length) FILTER (ok AND bs) AS lm, stddev_pop(length) FILTER (ok AND bs) AS ls, min(length) FILTER (ok AND bs) AS l0, max(length) FILTER (ok AND bs) AS l1
  FROM t GROUP BY 1)
SELECT subject_id, left_raw, left_after_length, left_count, right_raw, right_after_length, right_count, 150000::BIGINT AS left_seeds, 150000::BIGINT AS right_seeds,
  left_count + right_count AS total_count, {r6('left_count * 100 / 15e4')} AS left_yield, {r6('right_count * 100 / 15e4')} AS right_yield,
  {r6('(left_count + right_count) * 100 / 3e5')} AS extraction_rate, {r6('lm')} AS length_mean, {r6('ls')} AS length_std,
  {r6('l0')} AS length_min, {r6('l1')} AS length_max FROM g""")
def a12(spark, sf):
    f = fates(spark, sf).select("subject_id", F.when(F.expr("streamline_id div 8") % 2 == 0, "left").otherwise("right").alias("side"),
                                "length", F.col("brainstem").alias("reached"))
    s = ex.seeded_stats(f, _seed_counts(spark), fx.BAND)
    return s.withColumns({n: rnd(F.col(n)) for n, t in s.dtypes if t == "double"})


def _funnel_sql(m: str, rows: str = "fates") -> str:
    return f"""
g AS (SELECT subject_id, count(*) AS total_input, count(*) FILTER (in_band) AS after_length_filter,
  count(*) FILTER (in_band AND xmean < {m}) AS input_left, count(*) FILTER (in_band AND xmean >= {m}) AS input_right,
  count(*) FILTER (in_band AND bs) AS passes_brainstem, count(*) FILTER (in_band AND bs AND xmean < {m}) AS left_bs,
  count(*) FILTER (in_band AND bs AND xmean >= {m}) AS right_bs, count(*) FILTER (in_band AND bs AND ml) AS passes_left_motor,
  count(*) FILTER (in_band AND bs AND mr) AS passes_right_motor, count(*) FILTER (fate = 'left') AS left_count,
  count(*) FILTER (fate = 'right') AS right_count, count(*) FILTER (fate = 'bilateral_excluded') AS bilateral_excluded,
  count(*) FILTER (fate = 'midline_excluded') AS midline_excluded FROM {rows} GROUP BY 1)
SELECT *, left_count + right_count AS total_count,
  {r6('CASE WHEN input_right = 0 THEN 0e0 ELSE input_left / input_right::DOUBLE END')} AS input_lr_ratio,
  {r6('CASE WHEN right_bs = 0 THEN 0e0 ELSE left_bs / right_bs::DOUBLE END')} AS lr_bs,
  {r6('CASE WHEN left_bs = 0 THEN 0e0 ELSE passes_left_motor * 100 / left_bs::DOUBLE END')} AS left_motor_yield,
  {r6('CASE WHEN right_bs = 0 THEN 0e0 ELSE passes_right_motor * 100 / right_bs::DOUBLE END')} AS right_motor_yield,
  {r6('(left_count + right_count) * 100 / total_input::DOUBLE')} AS extraction_rate FROM g"""


@query("A10_passthrough_funnel", f"WITH {sql_fates(M)}," + _funnel_sql(M))
def a10(spark, sf):
    s = ex.funnel(fates(spark, sf, fx.MIDLINE), fx.MIDLINE)
    return s.withColumns({n: rnd(F.col(n)) for n, t in s.dtypes if t == "double"})


# every subject's own midline, that of A16; 0 where it has no volume
SQL_OWN = f"{WITH}{BOUND}{A16_TABLE}, " + sql_fates("coalesce((SELECT m FROM mid WHERE mid.subject_id = f.subject_id), 0e0)") + """,
own AS (SELECT fates.* REPLACE (round_even(xmean * 1e9, 0) / 1e9 AS xmean), coalesce(m, 0e0) AS own_m FROM fates LEFT JOIN mid USING (subject_id)),"""


def own_fates(spark, sf):
    t = ex.streamline_table(fx.points(spark, sf), GRID, fx.roi_voxels(spark))
    return ex.assign_fates(rois.attach_midline(t, a16(spark, sf)), fx.BAND, F.col("midline_x"))


@query("A10_subject_midline", SQL_OWN + _funnel_sql("own_m", "own"))
def a10_subject(spark, sf):
    s = ex.funnel(own_fates(spark, sf), F.col("midline_x"))
    return s.withColumns({n: rnd(F.col(n)) for n, t in s.dtypes if t == "double"})


def _entry_sql(m: str, rows: str = "fates") -> str:
    return f"""
f AS (SELECT *, CASE WHEN xmean < {m} THEN 'left' ELSE 'right' END AS side FROM {rows} WHERE in_band),
g AS (SELECT subject_id, side, count(entry_x) AS n_entries, avg(entry_x) AS mx,
  count(*) FILTER (entry_x IS NOT NULL AND CASE WHEN side = 'left' THEN entry_x < {m} ELSE entry_x >= {m} END) AS n_correct,
  count(*) FILTER (NOT bs) AS n_failing, avg(zmin) FILTER (NOT bs) AS mz FROM f GROUP BY 1, 2)
SELECT subject_id, side, n_entries, {r6('mx')} AS mean_entry_x, n_correct, n_failing, {r6('mz')} AS mean_min_z_failing,
  {r6('CASE WHEN n_entries = 0 THEN NULL ELSE n_correct * 100 / n_entries::DOUBLE END')} AS pct_correct FROM g"""


@query("A11_entry_diagnostics", f"WITH {sql_fates(M)}," + _entry_sql(M))
def a11(spark, sf):
    s = ex.entry_diagnostics(fates(spark, sf, fx.MIDLINE), fx.MIDLINE)
    return s.withColumns({n: rnd(F.col(n)) for n, t in s.dtypes if t == "double"})


@query("A11_subject_midline", SQL_OWN + _entry_sql("own_m", "own"))
def a11_subject(spark, sf):
    s = ex.entry_diagnostics(own_fates(spark, sf), F.col("midline_x"))
    return s.withColumns({n: rnd(F.col(n)) for n, t in s.dtypes if t == "double"})


def _peduncle_sql(m: str, rows: str = "t") -> str:
    return f"""
b AS (SELECT subject_id, {fx.SQL_WORLD_X} AS wx, {fx.SQL_WORLD_Y} AS wy, {fx.SQL_WORLD_Z} AS wz FROM vol JOIN grd USING (subject_id) WHERE label = 8),
c AS (SELECT subject_id, quantile_cont(wz, 7e-1) AS cut FROM b GROUP BY 1),
t AS (SELECT b.*, CAST(round_even((wx + 12e0) / 2e0, 0) AS INT) AS i, CAST(round_even((wy + 12e0) / 2e0, 0) AS INT) AS j, CAST(round_even((wz + 2e1) / 2e0, 0) AS INT) AS k
  FROM b JOIN c USING (subject_id) WHERE wz >= cut),
s AS (SELECT t.subject_id, wx < {m} AS l, ((i*7 + j*3 + k*11 + t.subject_id) % 97) / 97e0 AS fa FROM {rows}
  WHERE i BETWEEN 0 AND 11 AND j BETWEEN 0 AND 11 AND k BETWEEN 0 AND 11)
SELECT subject_id, {r6('coalesce(avg(fa) FILTER (l), 0e0)')} AS left_mean_fa, {r6('coalesce(avg(fa) FILTER (NOT l), 0e0)')} AS right_mean_fa,
  count(*) FILTER (l) AS left_n, count(*) FILTER (NOT l) AS right_n FROM s GROUP BY 1"""


def _peduncle(spark, sf, brainstem, midline_x):
    fa_grid = G.Grid(((2.0, 0.0, 0.0, -12.0), (0.0, 2.0, 0.0, -12.0), (0.0, 0.0, 2.0, -20.0), (0.0, 0.0, 0.0, 1.0)), (12, 12, 12))
    s = ex.peduncle_fa(brainstem, fx.volumes(spark, sf), None, fa_grid, midline_x)
    return s.withColumns({n: rnd(F.col(n)) for n in ("left_mean_fa", "right_mean_fa")})


@query("J17_peduncle_fa", f"WITH {fx.SQL_VOLUMES}, {fx.SQL_VOLUME_GRIDS}," + _peduncle_sql("5e-1"))
def j17(spark, sf):
    v = G.attach_grid(fx.volumes(spark, sf), fx.volume_grids(spark, sf))
    return _peduncle(spark, sf, v.where("label = 8"), lit(0.5))


@query("J17_subject_midline", WITH + BOUND + A16_TABLE + "," + _peduncle_sql("coalesce(m, 0e0)", "t LEFT JOIN mid USING (subject_id)"))
def j17_subject(spark, sf):
    v = G.attach_grid(fx.volumes(spark, sf), fx.volume_grids(spark, sf))
    return _peduncle(spark, sf, rois.attach_midline(v.where("label = 8"), a16(spark, sf)), F.col("midline_x"))
