"""Queries of the field, quality-control and tensor operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractloom.functions import geometry as G
from tractloom.functions.numeric import lit, rnd
from tractloom.operators import bricks, fields as fd, qc, streamlines as sl, tensor as tn
from tractloom.plans import fixtures as fx
from tractloom.plans.fixtures import SQL_GRADIENTS, SQL_LENS, SQL_POINTS, SQL_VOLUME_GRIDS, SQL_VOLUMES, r6
from tractloom.plans.registry import query

VG = f"WITH {SQL_VOLUMES}, {SQL_VOLUME_GRIDS}"
FIELD = """,
fld AS (SELECT subject_id, i, j, k, 1e-2 * (i*i + j * (subject_id % 3)) AS ux, 2e-2 * j * k - 5e-2 * i AS uy, 15e-2 * ((i + k*k + subject_id) % 4) AS uz FROM vol)"""


def _field(spark, sf):
    i, j, k, s = (F.col(c) for c in ("i", "j", "k", "subject_id"))
    return fx.volumes(spark, sf).select(
        "subject_id", "i", "j", "k", (lit(0.01) * (i * i + j * (s % 3))).alias("ux"), (lit(0.02) * j * k - lit(0.05) * i).alias("uy"),
        (lit(0.15) * ((i + k * k + s) % 4)).alias("uz"))


def _grad(u: str, axis: str, size: str) -> str:
    w = f"(PARTITION BY subject_id, {', '.join(a for a in 'ijk' if a != axis)} ORDER BY {axis})"
    return f"""CASE WHEN {axis} = 0 THEN (lead({u}) OVER {w} - {u}) / {size} WHEN {axis} = 11 THEN ({u} - lag({u}) OVER {w}) / {size}
    ELSE (lead({u}) OVER {w} - lag({u}) OVER {w}) / (2e0 * {size}) END"""


JAC = VG + FIELD + f""",
g AS (SELECT f.subject_id, i, j, k, {", ".join(f"{_grad('u' + u, a, s)} AS {u}{a}" for u in "xyz" for a, s in (("i", "abs(sx)"), ("j", "sqrt(sh*sh + 4e0)"), ("k", "25e-1")))}
  FROM fld f JOIN grd r ON f.subject_id = r.subject_id),
jac AS (SELECT subject_id, i, j, k, (1+xi)*((1+yj)*(1+zk) - yk*zj) - xj*(yi*(1+zk) - yk*zi) + xk*(yi*zj - (1+yj)*zi) AS det FROM g)"""
JAC = JAC.replace("PARTITION BY subject_id", "PARTITION BY f.subject_id")


def _dets(spark, sf):
    f = G.attach_grid(_field(spark, sf), fx.volume_grids(spark, sf))
    return bricks.jacobian(f, G.voxel_size_columns(F.col("affine")))


@query("W4_jacobian", JAC + f" SELECT subject_id, i, j, k, {r6('det')} AS det FROM jac")
def w4(spark, sf):
    return _dets(spark, sf).withColumn("det", rnd(F.col("det")))


def _near(u: str, axis: str, size: str) -> str:
    return f"coalesce((a{axis}.{u} - b{axis}.{u}) / (2e0 * {size}), (a{axis}.{u} - f.{u}) / {size}, (f.{u} - b{axis}.{u}) / {size}, 0e0)"


_SIZES = (("i", "abs(sx)"), ("j", "sqrt(sh*sh + 4e0)"), ("k", "25e-1"))


def _beside(name: str, axis: str, step: int) -> str:
    on = " AND ".join(f"{name}.{a} = f.{a}" + (f" + {step}" if a == axis else "") for a in "ijk")
    return f"LEFT JOIN fls {name} ON {name}.subject_id = f.subject_id AND {on}"


@query("W4_jacobian_sparse", VG + FIELD + f""",
fls AS (SELECT * FROM fld WHERE (i + 2*j + k*k + subject_id) % 3 > 0 AND (subject_id % 5 > 0 OR k = 4)),
g AS (SELECT f.subject_id, f.i, f.j, f.k, {", ".join(f"{_near('u' + u, a, s)} AS {u}{a}" for u in "xyz" for a, s in _SIZES)}
  FROM fls f JOIN grd r ON f.subject_id = r.subject_id {" ".join(_beside(f"{n}{a}", a, d) for a in "ijk" for n, d in (("b", -1), ("a", 1)))})
SELECT subject_id, i, j, k, {r6('(1+xi)*((1+yj)*(1+zk) - yk*zj) - xj*(yi*(1+zk) - yk*zi) + xk*(yi*zj - (1+yj)*zi)')} AS det FROM g""")
def w4_sparse(spark, sf):
    f = _field(spark, sf).where("(i + 2*j + k*k + subject_id) % 3 > 0 and (subject_id % 5 > 0 or k = 4)")
    d = bricks.jacobian(G.attach_grid(f, fx.volume_grids(spark, sf)), G.voxel_size_columns(F.col("affine")))
    return d.select("subject_id", "i", "j", "k", rnd(F.col("det")).alias("det"))


@query("A15_jacobian_sides", JAC + f""" SELECT subject_id, CASE WHEN i < 6 THEN 'left' ELSE 'right' END AS side, {r6('avg(det)')} AS mean, {r6('stddev_pop(det)')} AS std,
  {r6('count(*) FILTER (det < 0) * 100e0 / count(*)')} AS negative_pct FROM jac GROUP BY 1, 2""")
def a15(spark, sf):
    d = fd.jacobian_sides(_dets(spark, sf), F.col("i") < 6)
    return d.withColumns({n: rnd(F.col(n)) for n in ("mean", "std", "negative_pct")})


@query("J16_label_resample", VG + FIELD + f""",
t AS (SELECT f.subject_id, f.i, f.j, f.k, CAST(round_even((sx*f.i + sh*f.j + ox + ux + 12e0) / 2e0, 0) AS INT) AS si, CAST(round_even((2e0*f.j - 12e0 + uy + 12e0) / 2e0, 0) AS INT) AS sj,
   CAST(round_even((25e-1*f.k - 2e1 + uz + 2e1) / 2e0, 0) AS INT) AS sk FROM fld f JOIN grd USING (subject_id))
SELECT t.subject_id, t.i, t.j, t.k, coalesce(v.label, 0) AS label FROM t LEFT JOIN vol v ON v.subject_id = t.subject_id AND v.i = si AND v.j = sj AND v.k = sk""")
def j16(spark, sf):
    t = G.attach_grid(fx.volumes(spark, sf), fx.volume_grids(spark, sf))
    src = G.Grid(((2.0, 0.0, 0.0, -12.0), (0.0, 2.0, 0.0, -12.0), (0.0, 0.0, 2.0, -20.0), (0.0, 0.0, 0.0, 1.0)), (12, 12, 12))
    return fd.resample_labels(t.select("subject_id", "i", "j", "k", "affine"), None, fx.volumes(spark, sf), src, _field(spark, sf))


@query("A14_tracking_report", f"""WITH {SQL_POINTS}{SQL_LENS},
g AS (SELECT subject_id, count(*) AS c, avg(length) AS lm, stddev_pop(length) AS ls, min(length) AS l0, max(length) AS l1, median(length) AS md,
  quantile_cont(length, 25e-2) AS q1, quantile_cont(length, 75e-2) AS q3, avg(n_points) AS pm, min(n_points) AS p0, max(n_points) AS p1, sum(n_points) AS np FROM lens GROUP BY 1)
SELECT subject_id, CAST(np AS BIGINT) AS n_seeds, c AS count, {r6('lm')} AS length_mean, {r6('ls')} AS length_std, {r6('l0')} AS length_min, {r6('l1')} AS length_max, {r6('md')} AS length_median,
  {r6('q1')} AS length_p25, {r6('q3')} AS length_p75, {r6('pm')} AS points_mean, p0 AS points_min, p1 AS points_max, {r6('c * 100e0 / np')} AS yield_pct FROM g""")
def a14(spark, sf):
    p = fx.points(spark, sf)
    seeds = p.groupBy("subject_id").agg(F.count(F.lit(1)).alias("n_seeds"))
    r = qc.tracking_report(sl.arc_lengths(p), seeds)
    return r.withColumns({n: rnd(F.col(n)) for n, t in r.dtypes if t == "double"})


@query("A14_positive_voxels", f"""WITH {SQL_VOLUMES}, m AS (SELECT subject_id, unnest(['fa', 'md']) AS scalar, unnest([CASE WHEN brain THEN fa ELSE 0e0 END, fa * 1e-3]) AS v FROM vol)
SELECT subject_id, scalar, count(*) AS n, {r6('avg(v)', 10)} AS mean, {r6('stddev_pop(v)', 10)} AS std, {r6('median(v)', 10)} AS median FROM m WHERE v > 0 GROUP BY 1, 2""")
def a14b(spark, sf):
    m = fx.volumes(spark, sf).select("subject_id", F.when(F.col("brain"), F.col("fa")).otherwise(0.0).alias("fa"), (F.col("fa") * lit(1e-3)).alias("md"))
    d = qc.positive_voxel_stats(m, ("fa", "md"))
    return d.withColumns({n: rnd(F.col(n), 10) for n in ("mean", "std", "median")})


@query("W5_length_distribution", f"""WITH {SQL_POINTS}{SQL_LENS}
SELECT subject_id, streamline_id, {r6('length')} AS length, {r6('row_number() OVER (PARTITION BY subject_id ORDER BY round_even(length * 1e6, 0), streamline_id) * 100e0 / count(*) OVER (PARTITION BY subject_id)')} AS cumulative_pct FROM lens""")
def w5(spark, sf):
    ln = sl.arc_lengths(fx.points(spark, sf)).withColumn("length", rnd(F.col("length")))
    return qc.length_distribution(ln).withColumn("cumulative_pct", rnd(F.col("cumulative_pct")))


@query("T3_subsample", """WITH s AS (SELECT DISTINCT l_partkey AS streamline_id, l_partkey % 8 AS subject_id FROM lineitem)
SELECT subject_id, streamline_id FROM s QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY md5('42:' || streamline_id), streamline_id) <= 40""")
def t3(spark, sf):
    ids = fx.table(spark, sf, "lineitem").select((F.col("l_partkey") % 8).alias("subject_id"), F.col("l_partkey").alias("streamline_id")).distinct()
    return qc.subsample(ids, 40)


AFF = f"""WITH {SQL_GRADIENTS},
a AS (SELECT subject_id, vol_idx, 1e-3 * (vol_idx % 7) AS a, 2e-3 * (vol_idx % 5) AS c, 1e-1 * (vol_idx % 5) AS tx, 5e-2 * (vol_idx % 3) AS ty, -2e-1 * (vol_idx % 2) AS tz, 1e-2 * (vol_idx % 4) AS h FROM grad),
m AS (SELECT subject_id, vol_idx, tx, ty, tz, atan2(sin(c), cos(c)) * (18e1 / 3.141592653589793e0) AS roll, atan2(-h, sqrt(sin(c)*sin(c) + cos(c)*cos(c))) * (18e1 / 3.141592653589793e0) AS pitch,
   atan2(sin(a), cos(a)) * (18e1 / 3.141592653589793e0) AS yaw FROM a),
z AS (SELECT * FROM m WHERE vol_idx = 0)"""


def _affines(spark, sf):
    v = F.col("vol_idx")
    a, c = lit(1e-3) * (v % 7), lit(2e-3) * (v % 5)
    z = lit(0.0)
    rows = [F.cos(a), -F.sin(a), z, lit(0.1) * (v % 5), F.sin(a), F.cos(a), -F.sin(c), lit(0.05) * (v % 3),
            lit(0.01) * (v % 4), F.sin(c), F.cos(c), lit(-0.2) * (v % 2), z, z, z, lit(1.0)]
    return fx.gradients(spark, sf).select("subject_id", "vol_idx", F.array(*rows).alias("affine"))


_MOVES = ("tx", "ty", "tz", "roll", "pitch", "yaw")


@query("A22_motion", AFF + f""" SELECT m.subject_id, m.vol_idx, {", ".join(f"{r6(f'm.{n}')} AS {n}, {r6(f'm.{n} - z.{n}')} AS {n}_rel" for n in _MOVES)} FROM m JOIN z USING (subject_id)""")
def a22(spark, sf):
    d = qc.motion(_affines(spark, sf))
    return d.withColumns({n: rnd(F.col(n)) for n, t in d.dtypes if t == "double"})


@query("A22_motion_summary", AFF + f""" SELECT m.subject_id, count(*) AS n_volumes, {r6('max(greatest(abs(m.tx - z.tx), abs(m.ty - z.ty), abs(m.tz - z.tz)))')} AS max_displacement,
  {r6('max(greatest(abs(m.roll - z.roll), abs(m.pitch - z.pitch), abs(m.yaw - z.yaw)))')} AS max_rotation FROM m JOIN z USING (subject_id) GROUP BY 1""")
def a22b(spark, sf):
    d = qc.motion_summary(_affines(spark, sf))
    return d.withColumns({n: rnd(F.col(n)) for n in ("max_displacement", "max_rotation")})


@query("A23_residual_qc", f"""WITH {SQL_VOLUMES}, v AS (SELECT *, fa + ((i + j + k) % 5) * 1e-3 AS after_ FROM vol),
b AS (SELECT subject_id, avg(fa) AS bm, stddev_pop(fa) AS bs, avg(after_) AS am, stddev_pop(after_) AS as_, avg(abs(fa - after_)) AS dm, quantile_cont(abs(fa - after_), 99e-2) AS p99 FROM v WHERE brain GROUP BY 1),
t AS (SELECT subject_id, count(*) AS total_voxels, count(*) FILTER (brain) AS brain_voxels FROM v GROUP BY 1)
SELECT subject_id, total_voxels, brain_voxels, {r6('bm')} AS before_mean, {r6('bs')} AS before_std, {r6('am')} AS after_mean, {r6('as_')} AS after_std, {r6('dm')} AS diff_mean, {r6('p99')} AS diff_p99,
  {r6('brain_voxels * 100e0 / total_voxels')} AS coverage_pct FROM t JOIN b USING (subject_id)""")
def a23(spark, sf):
    v = fx.volumes(spark, sf).withColumnRenamed("fa", "before")
    v = v.withColumn("after", F.col("before") + ((F.col("i") + F.col("j") + F.col("k")) % 5) * lit(1e-3))
    d = qc.residuals(v)
    return d.withColumns({n: rnd(F.col(n)) for n, t in d.dtypes if t == "double"})


# known tensors: eigenvalues by voxel, turned about z by an angle of the voxel and subject
TENSOR = """WITH v AS (SELECT DISTINCT user_id AS subject_id, CAST(unnest(range(8)) AS INT) AS v FROM events),
e AS (SELECT subject_id, v // 4 AS i, (v // 2) % 2 AS j, v % 2 AS k, (6 + v) * 1e-4 AS l1, (3 + v % 3) * 1e-4 AS l2, (2 + v % 2) * 1e-4 AS l3 FROM v)"""


def _signals(spark, sf):
    g = fx.gradients(spark, sf).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(7))))
    v, s = F.col("v"), F.col("subject_id")
    l1, l2, l3 = (v + 6) * lit(1e-4), (v % 3 + 3) * lit(1e-4), (v % 2 + 2) * lit(1e-4)
    t = lit(0.3) * v + lit(0.01) * (s % 50)
    x, y, z = F.col("bx"), F.col("by"), F.col("bz")
    u, w = x * F.cos(t) + y * F.sin(t), y * F.cos(t) - x * F.sin(t)
    sig = lit(1000.0) * F.exp(-F.col("bval") * (l1 * u * u + l2 * w * w + l3 * z * z))
    return g.select("subject_id", F.expr("v div 4").cast("int").alias("i"), F.expr("(v div 2) % 2").cast("int").alias("j"), F.expr("v % 2").cast("int").alias("k"),
                    "vol_idx", "bval", "bx", "by", "bz", sig.alias("signal"))


TENSOR_OUT = TENSOR + f""" SELECT subject_id, CAST(i AS INT) AS i, CAST(j AS INT) AS j, CAST(k AS INT) AS k,
  {r6('sqrt(5e-1 * ((l1-l2)*(l1-l2) + (l2-l3)*(l2-l3) + (l3-l1)*(l3-l1))) / sqrt(l1*l1 + l2*l2 + l3*l3)', 5)} AS fa,
  {r6('(l1+l2+l3)/3e0', 8)} AS md, {r6('(l2+l3)/2e0', 8)} AS rd, {r6('l1', 8)} AS ad FROM e"""


def _maps(d):
    return d.select("subject_id", "i", "j", "k", rnd(F.col("fa"), 5).alias("fa"), *[rnd(F.col(c), 8).alias(c) for c in ("md", "rd", "ad")])


@query("A28_tensor_ols", TENSOR_OUT)
def a28(spark, sf):
    s = _signals(spark, sf)
    return _maps(tn.fit_ols(s.select("subject_id", "i", "j", "k", "vol_idx", "signal"), fx.gradients(spark, sf)))


@query("A28_tensor_wls", TENSOR_OUT)
def a28b(spark, sf):
    s = _signals(spark, sf)
    return _maps(tn.fit_wls(s.select("subject_id", "i", "j", "k", "vol_idx", "signal"), fx.gradients(spark, sf)))
