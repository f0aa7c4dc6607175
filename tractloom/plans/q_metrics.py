"""Queries of the bundle metrics and the side comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractloom import constants as C
from tractloom.functions.laterality import li_columns
from tractloom.functions.numeric import lit, rnd
from tractloom.functions.stage import materialize
from tractloom.operators import bricks, extract as ex, metrics as me
from tractloom.operators.geometry import voxelise
from tractloom.plans import fixtures as fx
from tractloom.plans.fixtures import GRID, SQL_MAPS, r6, sql_fates
from tractloom.plans.laterality import fa_laterality
from tractloom.plans.q_geometry import SQL_ORIENT
from tractloom.plans.registry import query

EVR = "(SELECT subject_id, side FROM (SELECT DISTINCT subject_id FROM pts UNION ALL SELECT 8) s, (VALUES ('left'), ('right')) d(side)) e"  # one subject without streamlines
EVS = f"(SELECT *, unnest(['fa', 'md', 'rd', 'ad']) AS scalar FROM {EVR})"


def _zero(cols: str) -> str:
    return ", ".join(f"coalesce({c}, 0) AS {c}" for c in cols.split())


MAPS_LIST = ", ".join(f"{e} AS {n}" for n, e in SQL_MAPS.items())
SIDED = f"WITH {sql_fates()}" + """,
sid AS (SELECT subject_id, streamline_id, fate AS side, length FROM fates WHERE fate IN ('left', 'right'))"""
SAMPLES = SIDED + f""",
smp AS (SELECT v.subject_id, side, v.streamline_id, pt_idx, i, j, k, {MAPS_LIST} FROM vox v JOIN sid USING (subject_id, streamline_id) WHERE inb)"""
LONG = SAMPLES + """,
lng AS (SELECT subject_id, side, streamline_id, unnest(['fa','md','rd','ad']) AS scalar, unnest([fa, md, rd, ad]) AS value FROM smp),
psl AS (SELECT subject_id, side, streamline_id, scalar, avg(value) AS value FROM lng GROUP BY ALL)"""
SUMMARY = LONG + """,
sm0 AS (SELECT * FROM
  (SELECT subject_id, side, scalar, avg(value) AS mean, stddev_pop(value) AS std, min(value) AS min, max(value) AS max,
     count(*) AS n_streamlines, quantile_cont(value, 5e-1) AS median FROM psl GROUP BY 1, 2, 3)
  JOIN (SELECT subject_id, side, scalar, avg(value) AS pool_mean, stddev_pop(value) AS pool_std, min(value) AS pool_min,
     max(value) AS pool_max, count(*) AS n_samples, quantile_cont(value, 5e-1) AS pool_median FROM lng GROUP BY 1, 2, 3)
  USING (subject_id, side, scalar)),
smy AS (SELECT subject_id, side, scalar, """ + _zero("mean std min max n_streamlines median pool_mean pool_std pool_min pool_max n_samples pool_median") + f"""
  FROM {EVS} LEFT JOIN sm0 USING (subject_id, side, scalar))"""
PROFILE = SAMPLES + SQL_ORIENT + """,
orl AS (SELECT s.*, row_number() OVER w - 1 AS r, count(*) OVER (PARTITION BY streamline_id) AS n
  FROM smp s JOIN ori o USING (subject_id, streamline_id)
  WINDOW w AS (PARTITION BY s.streamline_id ORDER BY CASE WHEN flip THEN -pt_idx ELSE pt_idx END)),
plc AS (SELECT q.subject_id, q.side, q.streamline_id, p AS place, q.n,
    (p * (q.n - 1)) // 19 AS b, CASE WHEN q.n >= 20 THEN 0e0 ELSE ((p * (q.n - 1)) % 19) / 19e0 END AS f
  FROM (SELECT DISTINCT subject_id, side, streamline_id, n FROM orl WHERE n >= 5) q, range(20) t(p)),
one AS (SELECT c.subject_id, c.side, c.streamline_id, CAST(c.place AS INT) AS place,
    lo.fa * (1 - f) + coalesce(hi.fa, 0) * f AS fa, lo.md * (1 - f) + coalesce(hi.md, 0) * f AS md,
    lo.rd * (1 - f) + coalesce(hi.rd, 0) * f AS rd, lo.ad * (1 - f) + coalesce(hi.ad, 0) * f AS ad
  FROM plc c JOIN orl lo ON lo.streamline_id = c.streamline_id AND lo.r = c.b
  LEFT JOIN orl hi ON hi.streamline_id = c.streamline_id AND hi.r = c.b + 1),
prw AS (SELECT subject_id, side, place, avg(fa) AS fa, avg(md) AS md, avg(rd) AS rd, avg(ad) AS ad FROM one GROUP BY 1, 2, 3),
prf AS (SELECT subject_id, side, place, unnest(['fa','md','rd','ad']) AS scalar, unnest([fa, md, rd, ad]) AS value
  FROM (SELECT subject_id, side, place, """ + _zero("fa md rd ad") + f""" FROM (SELECT *, CAST(unnest(range(20)) AS INT) AS place FROM {EVR}) LEFT JOIN prw USING (subject_id, side, place)))"""
REGIONS = PROFILE + """,
reg AS (SELECT subject_id, side, scalar, CASE WHEN place < 7 THEN 'pontine' WHEN place < 14 THEN 'plic' ELSE 'precentral' END AS region,
    avg(value) AS value FROM prf GROUP BY ALL)"""
MORPH = """,
mo0 AS (SELECT * FROM (SELECT subject_id, side, count(*) AS n_streamlines, avg(length) AS mean_length, stddev_pop(length) AS std_length,
    min(length) AS min_length, max(length) AS max_length FROM sid GROUP BY 1, 2)
  JOIN (SELECT subject_id, side, count(*) * 8e0 AS tract_volume FROM
     (SELECT DISTINCT v.subject_id, side, i, j, k FROM vox v JOIN sid USING (subject_id, streamline_id)) GROUP BY 1, 2) USING (subject_id, side)),
mor AS (SELECT subject_id, side, """ + _zero("n_streamlines mean_length std_length min_length max_length tract_volume") + f""" FROM {EVR} LEFT JOIN mo0 USING (subject_id, side))"""


def bundles(spark, sf):
    """Vertices of the selected left and right streamlines, staged since metrics read them often."""
    p = materialize(fx.points(spark, sf))
    f = ex.assign_fates(ex.streamline_table(p, GRID, fx.roi_voxels(spark)), fx.BAND)
    sides = f.where("fate in ('left', 'right')").select("subject_id", "streamline_id", F.col("fate").alias("side"))
    return materialize(me.bundle_points(p, sides))


def subjects(spark, sf):
    """The subjects of the points and one without any streamline; only the streamline ids are read."""
    ids = fx.table(spark, sf, "lineitem").select((F.col("l_partkey") % fx.N_SUBJECTS).alias("subject_id")).distinct()
    return ids.union(spark.range(8, 9).select("id"))


def _samples(spark, sf):
    return me.sample(voxelise(bundles(spark, sf), GRID), fx.voxels(spark))


@query("J1_scalar_sampling", SAMPLES + f""" SELECT subject_id, side, streamline_id, pt_idx,
  {", ".join(f"{r6(c, 9)} AS {c}" for c in C.SCALARS)} FROM smp""")
def j1(spark, sf):
    return _samples(spark, sf).select("subject_id", "side", "streamline_id", "pt_idx", *[rnd(F.col(c), 9).alias(c) for c in C.SCALARS])


@query("J1_brick_sampling", SAMPLES + f""" SELECT subject_id, side, streamline_id, pt_idx,
  {", ".join(f"{r6(c, 9)} AS {c}" for c in C.SCALARS)} FROM smp""")
def j1_bricks(spark, sf):
    s = bricks.sample(voxelise(bundles(spark, sf), GRID), bricks.pack(fx.voxels(spark)))
    return s.select("subject_id", "side", "streamline_id", "pt_idx", *[rnd(F.col(c), 9).alias(c) for c in C.SCALARS])


@query("A4_per_streamline_mean", LONG + f"SELECT subject_id, side, streamline_id, scalar, {r6('value', 9)} AS value FROM psl")
def a4(spark, sf):
    p = me.per_streamline(_samples(spark, sf))
    return p.unpivot(["subject_id", "side", "streamline_id"], list(C.SCALARS), "scalar", "value").withColumn("value", rnd(F.col("value"), 9))


@query("A5_scalar_summary", SUMMARY + f"""SELECT subject_id, side, scalar, n_streamlines, n_samples,
  {", ".join(f"{r6(p + s, 10)} AS {p}{s}" for p in ("", "pool_") for s in ("mean", "std", "median", "min", "max"))} FROM smy""")
def a5(spark, sf):
    s = me.scalar_summary(_samples(spark, sf), subjects=subjects(spark, sf))
    return s.withColumns({n: rnd(F.col(n), 10) for n, t in s.dtypes if t == "double"})


@query("A2_morphology", SIDED + MORPH + f"""SELECT subject_id, side, n_streamlines,
  {", ".join(f"{r6(c)} AS {c}" for c in ("mean_length", "std_length", "min_length", "max_length", "tract_volume"))} FROM mor""")
def a2(spark, sf):
    b = bundles(spark, sf)
    m = me.morphology(b, voxelise(b, GRID), lit(GRID.voxel_volume), subjects(spark, sf))
    return m.withColumns({n: rnd(F.col(n)) for n, t in m.dtypes if t == "double"})


@query("A6_tract_profile", PROFILE + f"SELECT subject_id, side, place, scalar, {r6('value', 9)} AS value FROM prf")
def a6(spark, sf):
    return me.tract_profile(bundles(spark, sf), GRID, fx.voxels(spark), subjects=subjects(spark, sf)).withColumn("value", rnd(F.col("value"), 9))


@query("A7_region_means", REGIONS + f"SELECT subject_id, side, scalar, region, {r6('value', 9)} AS value FROM reg")
def a7(spark, sf):
    return me.region_means(me.tract_profile(bundles(spark, sf), GRID, fx.voxels(spark), subjects=subjects(spark, sf))).withColumn("value", rnd(F.col("value"), 9))


def _li_sql(left: str, right: str) -> str:
    li = f"(({left}) - ({right})) / (({left}) + ({right}))"
    zero = f"({left}) + ({right}) = 0"
    return f"""{r6(f'CASE WHEN {zero} THEN 0e0 ELSE {li} END')} AS laterality_index,
  {r6(f'CASE WHEN {zero} THEN 0e0 ELSE abs(({left}) - ({right})) END', 10)} AS absolute_difference,
  {r6(f'CASE WHEN {zero} OR ({left}) + ({right}) <= 0 THEN 0e0 ELSE abs(({left}) - ({right})) / ((({left}) + ({right})) / 2) * 100 END')} AS percent_difference,
  CASE WHEN {zero} THEN 'no data' ELSE CASE WHEN abs({li}) < 5e-2 THEN 'symmetric' WHEN abs({li}) < 1e-1 THEN 'mild asymmetry'
    WHEN abs({li}) < 2e-1 THEN 'moderate asymmetry' ELSE 'strong asymmetry' END
    || CASE WHEN {li} > 0 THEN ' (left > right)' WHEN {li} < 0 THEN ' (right > left)' ELSE '' END END AS interpretation"""


@query("H1_laterality_index", f"""WITH p AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 0e0 ELSE s_acctbal END AS l,
   CASE s_suppkey % 9 WHEN 0 THEN 0e0 WHEN 1 THEN s_acctbal WHEN 2 THEN s_acctbal * 104e-2 WHEN 3 THEN s_acctbal * 115e-2
     WHEN 4 THEN s_acctbal * 13e-1 ELSE s_acctbal * 6e-1 END AS r FROM supplier)
SELECT s_suppkey, {_li_sql('l', 'r')} FROM p""")
def h1(spark, sf):
    s, a, m = F.col("s_suppkey"), F.col("s_acctbal"), F.col("s_suppkey") % 9
    p = fx.table(spark, sf, "supplier").select(
        s, F.when(m == 0, 0.0).otherwise(a).alias("l"),
        F.when(m == 0, 0.0).when(m == 1, a).when(m == 2, a * lit(1.04)).when(m == 3, a * lit(1.15))
        .when(m == 4, a * lit(1.3)).otherwise(a * lit(0.6)).alias("r"))
    li = li_columns(F.col("l"), F.col("r"))
    return p.select("s_suppkey", *[(c if n == "interpretation" else rnd(c, 10 if n == "absolute_difference" else 6)).alias(n) for n, c in li.items()])


COMPARED = """,
cmp AS (SELECT subject_id, side, CASE m WHEN 'tract_volume' THEN 'volume' WHEN 'n_streamlines' THEN 'streamline_count' ELSE m END AS quantity, v AS value
  FROM (SELECT subject_id, side, unnest(['tract_volume', 'n_streamlines', 'mean_length']) AS m, unnest([tract_volume, n_streamlines, mean_length]) AS v FROM mor
        UNION ALL SELECT subject_id, side, scalar, mean FROM smy UNION ALL SELECT subject_id, side, scalar || '_' || region, value FROM reg)),
lr AS (SELECT subject_id, quantity, max(value) FILTER (side = 'left') AS l, max(value) FILTER (side = 'right') AS r FROM cmp GROUP BY 1, 2)"""
ALL_METRICS = REGIONS + MORPH + SUMMARY[len(SAMPLES):] + COMPARED


@query("J13_side_comparison", ALL_METRICS + f"""SELECT subject_id, quantity, {r6('l', 10)} AS left_value, {r6('r', 10)} AS right_value, {_li_sql('l', 'r')} FROM lr""")
def j13(spark, sf):
    c = me.compare_sides(me.metrics_long(bundles(spark, sf), GRID, fx.voxels(spark), subjects=subjects(spark, sf)))
    return c.withColumns({n: rnd(F.col(n), 10 if n.endswith("_value") or n == "absolute_difference" else 6) for n, t in c.dtypes if t == "double"})


@query("fa_laterality", LONG + f""",
a AS (SELECT subject_id, count(*) FILTER (side = 'left') AS left_n, count(*) FILTER (side = 'right') AS right_n,
  avg(value) FILTER (side = 'left') AS l, avg(value) FILTER (side = 'right') AS r FROM psl WHERE scalar = 'fa' GROUP BY 1)
SELECT subject_id, left_n, right_n, {r6('l')} AS left_fa, {r6('r')} AS right_fa, {_li_sql('l', 'r')} FROM a""")
def flagship(spark, sf):
    f = fa_laterality(fx.points(spark, sf), GRID, fx.roi_voxels(spark), fx.voxels(spark), fx.BAND)
    return f.withColumns({n: rnd(F.col(n), 10 if n == "absolute_difference" else 6) for n, t in f.dtypes if t == "double"})
