"""Queries of the gradient and acquisition-quality operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractloom.functions.numeric import lit, rnd
from tractloom.operators import acquisition as aq
from tractloom.plans import fixtures as fx
from tractloom.plans.fixtures import SQL_GRADIENTS, r6
from tractloom.plans.registry import query

DIRS = f"""WITH {SQL_GRADIENTS},
uni AS (SELECT *, sqrt(bx*bx + by_*by_ + bz*bz) AS nrm, CASE WHEN bx = 0 AND by_ = 0 AND bz = 0 THEN 1e0 ELSE sqrt(bx*bx + by_*by_ + bz*bz) END AS dn FROM grad),
dir AS (SELECT subject_id, vol_idx, bval, nrm, bx, by_, bz, round_even(bx/dn*1e4, 0) AS ux, round_even(by_/dn*1e4, 0) AS uy, round_even(bz/dn*1e4, 0) AS uz FROM uni)"""
# b-values are 0, 1000, 1030, 1060, 1090, 2000, 3000: 1030 joins 1000 (<= 1050), 1060 opens its own and takes 1090
SHELL = """CASE WHEN bval = 0 THEN 0e0 WHEN bval >= 2000 THEN bval WHEN bval > mn * (1 + 5e-2) THEN
   (SELECT min(b.bval) FROM dir b WHERE b.subject_id = d.subject_id AND b.bval > mn * (1 + 5e-2)) ELSE mn END"""
SHELLS = DIRS + f""",
mnb AS (SELECT subject_id, min(bval) FILTER (bval > 50) AS mn FROM dir GROUP BY 1),
shl AS (SELECT d.*, {SHELL} AS shell FROM dir d JOIN mnb USING (subject_id) WHERE bval > 50)"""


@query("F12_direction_count", DIRS + """
SELECT subject_id, count(DISTINCT (ux, uy, uz)) FILTER (bval > 50) AS n_directions, count(DISTINCT (bx, by_, bz)) FILTER (bval > 50) AS n_raw FROM dir GROUP BY 1""")
def f12(spark, sf):
    g = fx.gradients(spark, sf)
    return aq.count_directions(g).join(aq.count_directions(g, False).withColumnRenamed("n_directions", "n_raw"), "subject_id")


@query("W1_b0_gap", f"""WITH {SQL_GRADIENTS},
g AS (SELECT subject_id, vol_idx - lag(vol_idx) OVER (PARTITION BY subject_id ORDER BY vol_idx) AS gap FROM grad WHERE bval <= 50)
SELECT s.subject_id, coalesce(max(gap), 0) AS max_gap FROM (SELECT DISTINCT subject_id FROM grad) s LEFT JOIN g USING (subject_id) GROUP BY 1""")
def w1(spark, sf):
    return aq.b0_gap(fx.gradients(spark, sf))


@query("W2_shells", SHELLS + """
SELECT subject_id, shell, count(*) AS n_volumes, count(DISTINCT (ux, uy, uz)) AS n_directions FROM shl GROUP BY 1, 2""")
def w2(spark, sf):
    return aq.shell_table(fx.gradients(spark, sf))


def _voxel_sizes(g):
    s = F.col("subject_id")
    return g.select("subject_id").distinct().select(
        "subject_id", (lit(1.5) + (s % 4).cast("double") * lit(0.5)).alias("vx"), lit(2.0).alias("vy"),
        (lit(1.75) + (s % 7).cast("double") * lit(0.5)).alias("vz"))


VSIZE = "15e-1 + (subject_id % 4) * 5e-1 AS vx, 2e0 AS vy, 175e-2 + (subject_id % 7) * 5e-1 AS vz"


@query("A20_recommendation", DIRS + f""",
n AS (SELECT subject_id, count(DISTINCT (ux, uy, uz)) FILTER (bval > 50) AS n, count(DISTINCT (bx, by_, bz)) FILTER (bval > 50) AS r, {VSIZE} FROM dir GROUP BY 1)
SELECT subject_id, n AS n_directions, CASE WHEN n >= 45 THEN 8 WHEN n >= 28 THEN 6 WHEN n >= 15 THEN 4 ELSE 2 END AS max_sh_order,
  least(6, CASE WHEN r >= 45 THEN 8 WHEN r >= 28 THEN 6 WHEN r >= 15 THEN 4 ELSE 2 END) AS used_sh_order, {r6('least(vx, vy, vz) * 5e-1')} AS step_size FROM n""")
def a20(spark, sf):
    g = fx.gradients(spark, sf)
    return aq.recommend(g, _voxel_sizes(g), 6).withColumn("step_size", rnd(F.col("step_size")))


def _f(e: str, p: int = 0) -> str:
    return f"printf('%.{p}f', round_even(({e}) * 1e{p}, 0) / 1e{p})"


# sidecars: subject % 5 = 0 has none; the others vary by modulus
META = """mtd AS (SELECT subject_id, subject_id % 5 <> 0 AS has, CASE subject_id % 3 WHEN 0 THEN 'j-' WHEN 1 THEN 'AP' END AS pe,
   CASE WHEN subject_id % 4 > 0 THEN '0.05' END AS trt, CASE subject_id % 6 WHEN 0 THEN '0.12' WHEN 1 THEN 'x' ELSE '0.08' END AS te,
   CASE subject_id % 7 WHEN 0 THEN '6' WHEN 1 THEN '2' END AS mb, CASE subject_id % 8 WHEN 0 THEN '4' END AS pi FROM ids)"""


def _rules() -> str:
    r = [
        (1, "nb <> nv", "CRITICAL", "'bval and bvec files disagree (' || nb || ' and ' || nv || ' entries)'"),
        (2, "ok AND n_b0 = 0", "CRITICAL", "'The series has no unweighted volume'"),
        (3, "ok AND n_b0 BETWEEN 1 AND 2", "WARNING", "'Only ' || n_b0 || ' b=0 volume(s): three or more make registration stable'"),
        (4, "ok AND max_gap > 30", "INFO", "'Up to ' || max_gap || ' volumes lie between two unweighted ones; an even spread helps motion correction'"),
        (5, "ok AND n_dwi = 0", "CRITICAL", "'The series has no diffusion weighting'"),
        (6, "ok AND n_zero > 0", "CRITICAL", "n_zero || ' weighted volume(s) without a gradient direction'"),
        (7, "ok AND n_shells > 1", "INFO", "'Shells found: ' || n_shells || ' at b = [' || shell_list || ']'"),
        (8, "ok AND n_dir < 15", "CRITICAL", "'Only ' || n_dir || ' gradient directions; tractography needs 15 and works well from 28'"),
        (9, "ok AND n_dir >= 15 AND n_dir < 28", "WARNING", "n_dir || ' gradient directions allow spherical harmonics of order 4; order 6 takes 28'"),
        (10, "ok AND max_b < 800", "WARNING", f"'The highest b-value (' || {_f('max_b')} || ' s/mm²) gives weak contrast and low FA'"),
        (11, "ok AND max_b > 3000", "WARNING", f"'The large b-value (' || {_f('max_b')} || ' s/mm²) brings noise; denoise with care'"),
        (12, "ok AND vx*vy*vz > 15", "WARNING", f"'Voxel volume (' || {_f('vx*vy*vz', 1)} || ' mm³) is large'"),
        (13, "ok AND greatest(vx,vy,vz) > 25e-1", "WARNING", f"'Voxel edges (' || {_f('vx', 1)} || 'x' || {_f('vy', 1)} || 'x' || {_f('vz', 1)} || ' mm) blur small tracts such as the internal capsule'"),
        (14, "ok AND ani > 2", "CRITICAL", f"'Voxels far from cubic (' || {_f('ani', 1)} || ':1) distort directions badly'"),
        (15, "ok AND ani > 15e-1 AND ani <= 2", "WARNING", f"'Voxels not cubic (ratio ' || {_f('ani', 1)} || ') favour some directions'"),
        (16, "ok AND has AND (pe IS NULL OR trt IS NULL)", "WARNING", "'Distortion correction lacks: ' || concat_ws(', ', CASE WHEN pe IS NULL THEN 'PhaseEncodingDirection' END, CASE WHEN trt IS NULL THEN 'TotalReadoutTime' END)"),
        (17, "ok AND has AND pe = 'AP'", "INFO", "'Unknown phase encoding direction: AP'"),
        (18, "ok AND has AND te = '0.12'", "WARNING", "'Echo time (120 ms) is long, so signal decays'"),
        (19, "ok AND has AND mb = '6'", "INFO", "'Multiband factor (6) is high: look at the images'"),
        (20, "ok AND has AND pi = '4'", "INFO", "'In-plane acceleration (4) is high'"),
        (21, "ok AND min_b < 0", "CRITICAL", "'A b-value is below zero'"),
        (22, "ok AND max_b > 10000", "WARNING", f"'A b-value is beyond the usual range (' || {_f('max_b')} || ' s/mm²)'"),
    ]
    return " UNION ALL ".join(f"SELECT subject_id, '{sev}' AS severity, {msg} AS message FROM ft WHERE {cond}" for _, cond, sev, msg in r)


# every eleventh subject gets a raised b-value set, the b0 volumes of every thirteenth are weighted
QGRAD = SQL_GRADIENTS.replace("grad AS (", "grad0 AS (") + """,
grad AS (SELECT subject_id, vol_idx, CASE WHEN subject_id % 11 = 5 THEN bval * 4 WHEN subject_id % 17 = 3 THEN bval / 4 WHEN subject_id % 19 = 7 AND bval = 0 THEN -5e0 ELSE bval END AS bval, bx, by_, bz
  FROM (SELECT * REPLACE (CASE WHEN subject_id % 13 = 4 AND bval = 0 THEN 1e3 ELSE bval END AS bval) FROM grad0))"""
QSHELL = """shl AS (SELECT d.*, CASE WHEN bval > f * 15e-1 THEN bval WHEN bval > f * (1 + 5e-2) THEN m2 ELSE f END AS shell
  FROM (SELECT *, min(bval) OVER (PARTITION BY subject_id) AS f FROM dir WHERE bval > 50) d
  LEFT JOIN (SELECT subject_id, min(bval) AS m2 FROM (SELECT *, min(bval) OVER (PARTITION BY subject_id) AS f FROM dir WHERE bval > 50) WHERE bval > f * (1 + 5e-2) GROUP BY 1) USING (subject_id))"""
QUALITY = "WITH " + QGRAD + DIRS[len("WITH ") + len(SQL_GRADIENTS):] + f""", {QSHELL},
ids AS (SELECT DISTINCT subject_id FROM grad), {META},
gp AS (SELECT subject_id, max(g) AS g FROM (SELECT subject_id, vol_idx - lag(vol_idx) OVER (PARTITION BY subject_id ORDER BY vol_idx) AS g FROM grad WHERE bval <= 50) GROUP BY 1),
sc AS (SELECT subject_id, shell, count(DISTINCT (ux, uy, uz)) AS nd FROM shl GROUP BY 1, 2),
sl AS (SELECT subject_id, count(*) AS n_shells, string_agg(CAST(CAST(shell AS INT) AS VARCHAR), ', ' ORDER BY shell) AS shell_list FROM sc GROUP BY 1),
b AS (SELECT subject_id, min(bval) AS min_b, max(bval) AS max_b, count(*) FILTER (bval <= 50) AS n_b0, count(*) FILTER (bval > 50) AS n_dwi, count(*) AS nb,
   count(*) + CASE WHEN subject_id % 23 = 9 THEN 1 ELSE 0 END AS nv, count(*) FILTER (bval > 50 AND nrm < 1e-1) AS n_zero,
   count(DISTINCT (ux, uy, uz)) FILTER (bval > 50) AS n_dir, {VSIZE} FROM dir GROUP BY 1),
ft AS (SELECT *, coalesce(gp.g, 0) AS max_gap, nb = nv AS ok, greatest(vx, vy, vz) / least(vx, vy, vz) AS ani FROM b LEFT JOIN gp USING (subject_id) LEFT JOIN sl USING (subject_id) JOIN mtd USING (subject_id))
"""


@query("A19_acquisition_quality", QUALITY + _rules() + f""" UNION ALL
SELECT subject_id, 'WARNING', 'Shell at b=' || {_f('shell')} || ' has ' || nd || ' direction(s); models want six'
FROM sc JOIN ft USING (subject_id) WHERE ok AND nd < 6 AND shell > 500""")
def a19(spark, sf):
    s = F.col("subject_id")
    g = fx.gradients(spark, sf).withColumn("bval", F.when((s % 13 == 4) & (F.col("bval") == 0), 1000.0).otherwise(F.col("bval"))).withColumn(
        "bval", F.when(s % 11 == 5, F.col("bval") * 4).when(s % 17 == 3, F.col("bval") / 4)
        .when((s % 19 == 7) & (F.col("bval") == 0), -5.0).otherwise(F.col("bval")))
    n = g.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_bvals")).withColumn(
        "n_bvecs", F.col("n_bvals") + F.when(s % 23 == 9, 1).otherwise(0))
    fields = {
        "PhaseEncodingDirection": F.when(s % 3 == 0, "j-").when(s % 3 == 1, "AP"),
        "TotalReadoutTime": F.when(s % 4 > 0, "0.05"),
        "EchoTime": F.when(s % 6 == 0, "0.12").when(s % 6 == 1, "x").otherwise("0.08"),
        "MultibandAccelerationFactor": F.when(s % 7 == 0, "6").when(s % 7 == 1, "2"),
        "ParallelReductionFactorInPlane": F.when(s % 8 == 0, "4")}
    meta = F.map_from_entries(F.array_compact(F.array(*[
        F.when(v.isNotNull(), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, v in fields.items()])))
    f = aq.features(g).join(n, "subject_id").join(_voxel_sizes(g), "subject_id").withColumn("meta", F.when(s % 5 != 0, meta))
    return aq.quality_issues(f).select("subject_id", "severity", "message")
