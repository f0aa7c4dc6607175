"""Queries of the bundle and run comparisons."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractloom.functions.numeric import lit, rnd
from tractloom.functions.stage import materialize
from tractloom.operators import compare as cp
from tractloom.operators.geometry import voxelise
from tractloom.plans import fixtures as fx
from tractloom.plans.fixtures import GRID, SQL_POINTS, SQL_VOX, r6
from tractloom.plans.q_metrics import LONG, bundles
from tractloom.plans.registry import query
from tractloom.operators import metrics as me

# subjects are streamline_id % 8, so parity is taken above the subject digit
CAND, REF = "(streamline_id div 8) % 2 = 0", "(streamline_id div 8) % 3 = 0"
CAND_SQL, REF_SQL = "(streamline_id // 8) % 2 = 0", "(streamline_id // 8) % 3 = 0"
SETS = f"""WITH {SQL_VOX},
v AS (SELECT subject_id, i, j, k, bool_or({CAND_SQL}) AS c, bool_or({REF_SQL}) AS r FROM vox WHERE inb AND ({CAND_SQL} OR {REF_SQL}) GROUP BY ALL)"""


@query("J8_J9_bundle_overlap", SETS + f""",
g AS (SELECT subject_id, count(*) FILTER (c AND r) AS intersection_volume, count(*) FILTER (c) AS candidate_volume,
  count(*) FILTER (r) AS reference_volume, count(*) FILTER (c AND NOT r) AS overreach_volume, count(*) FILTER (r AND NOT c) AS missed_volume FROM v GROUP BY 1),
n AS (SELECT subject_id, count(DISTINCT streamline_id) FILTER ({CAND_SQL}) AS num_candidate, count(DISTINCT streamline_id) FILTER ({REF_SQL}) AS num_reference FROM pts GROUP BY 1)
SELECT *, {r6('2e0 * intersection_volume / (candidate_volume + reference_volume)')} AS dice, {r6('intersection_volume / reference_volume::DOUBLE')} AS coverage,
  {r6('overreach_volume / candidate_volume::DOUBLE')} AS overreach, {r6('num_candidate / num_reference::DOUBLE')} AS count_ratio FROM g JOIN n USING (subject_id)""")
def j8(spark, sf):
    p = fx.points(spark, sf)
    v = voxelise(p, GRID)
    d = cp.bundle_overlap(v.where(CAND), v.where(REF), p.select("subject_id").distinct())
    return d.withColumns({n: rnd(F.col(n)) for n in ("dice", "coverage", "overreach", "count_ratio")})


@query("U2_voxel_sets", SETS + """ SELECT subject_id, i, j, k, CASE WHEN c AND r THEN 'both' WHEN c THEN 'candidate' ELSE 'reference' END AS member FROM v""")
def u2(spark, sf):
    v = voxelise(fx.points(spark, sf), GRID)
    return cp.voxel_sets(v.where(CAND), v.where(REF))


@query("J12_hemisphere_alignment", f"""WITH {SQL_POINTS},
q AS (SELECT *, y + CASE WHEN subject_id % 2 = 1 AND {CAND_SQL} THEN 4e1 ELSE 0e0 END AS y2 FROM pts),
c AS (SELECT subject_id, avg(x) AS x, avg(y2) AS y, avg(z) AS z FROM q WHERE {CAND_SQL} GROUP BY 1),
r AS (SELECT subject_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM q WHERE {REF_SQL} GROUP BY 1),
e AS (SELECT c.subject_id, sqrt((c.x-r.x)*(c.x-r.x) + (c.y-r.y)*(c.y-r.y) + (c.z-r.z)*(c.z-r.z)) AS d FROM c JOIN r USING (subject_id))
SELECT subject_id, {r6('d')} AS distance, d > 3e1 AS warn FROM e""")
def j12(spark, sf):
    p = fx.points(spark, sf)
    c = p.where(CAND).withColumn("y", F.col("y") + F.when(F.col("subject_id") % 2 == 1, 40.0).otherwise(0.0))
    d = cp.hemisphere_alignment(c, p.where(REF), p.select("subject_id").distinct())
    return d.withColumn("distance", rnd(F.col("distance")))


@query("J11_spatial_compatibility", f"""WITH s AS (SELECT s_suppkey AS subject_id, s_suppkey % 5 AS m FROM supplier)
SELECT subject_id, {r6("CASE WHEN m = 1 THEN 2e0 ELSE 0e0 END")} AS trans_candidate, {r6("CASE WHEN m = 2 THEN 1e-2 ELSE 0e0 END")} AS rot_candidate,
  {r6("CASE WHEN m = 3 THEN 3e0 ELSE 0e0 END")} AS trans_reference, {r6("CASE WHEN m = 4 THEN 5e-1 ELSE 0e0 END")} AS rot_reference,
  CASE m WHEN 1 THEN 'candidate_translation' WHEN 2 THEN 'candidate_rotation' WHEN 3 THEN 'reference_translation' WHEN 4 THEN 'reference_rotation' ELSE 'ok' END AS status FROM s""")
def j11(spark, sf):
    g = fx.volume_grids(spark, sf)
    m = F.col("subject_id") % 5

    def moved(at: int, trans_at: int, trans: float, rot_at: int, rot: float):
        return F.transform("affine", lambda v, i: v + F.when((i == 7) & (m == trans_at), trans)
                           .when((i == 5) & (m == rot_at), rot).otherwise(0.0)).alias(("candidate", "reference")[at])

    d = cp.spatial_compatibility(g.select("subject_id", F.col("affine").alias("target"), moved(0, 1, 2.0, 2, 0.01), moved(1, 3, 3.0, 4, 0.5)))
    return d.withColumns({n: rnd(F.col(n)) for n, t in d.dtypes if t == "double"})


@query("J15_run_difference", f"""WITH a0 AS (SELECT s_suppkey AS subject_id, m AS metric, s_acctbal + CASE WHEN m = 'left_n' THEN 1 ELSE 0 END AS value
   FROM supplier, (VALUES ('fa_mean'), ('md_mean'), ('left_n')) t(m)),
b0 AS (SELECT s_suppkey AS subject_id, m AS metric, (s_acctbal + CASE WHEN m = 'left_n' THEN 1 ELSE 0 END) * CASE WHEN s_suppkey % 7 = 0 THEN 11e-1 ELSE 1e0 + 1e-12 END AS value
   FROM supplier, (VALUES ('fa_mean'), ('md_mean'), ('left_n')) t(m)),
a AS (SELECT * FROM a0 UNION ALL SELECT -subject_id - 1, metric, value FROM a0 WHERE subject_id % 10 = 0),
b AS (SELECT * FROM b0 UNION ALL SELECT subject_id + 1000000000, metric, value FROM b0 WHERE subject_id % 11 = 3),
d AS (SELECT coalesce(a.subject_id, b.subject_id) AS subject_id, coalesce(a.metric, b.metric) AS metric, a.value AS v1, b.value AS v2
   FROM a FULL JOIN b ON a.subject_id = b.subject_id AND a.metric = b.metric)
SELECT subject_id, metric, {r6('v1')} AS value1, {r6('v2', 4)} AS value2, {r6('abs(v1 - v2)', 4)} AS absolute_diff,
  {r6('abs(v1 - v2) / abs(v1)')} AS relative_diff,
  CASE WHEN v1 IS NULL THEN 'missing_in_first' WHEN v2 IS NULL THEN 'missing_in_second'
    WHEN abs(v1 - v2) <= CASE metric WHEN 'md_mean' THEN 1e-12 ELSE 1e-9 END + 1e-8 * abs(v2) THEN 'equal' ELSE 'different' END AS status FROM d""")
def j15(spark, sf):
    s = F.col("s_suppkey")
    base = fx.table(spark, sf, "supplier").withColumn("metric", F.explode(F.array(*map(F.lit, ("fa_mean", "md_mean", "left_n")))))
    v = F.col("s_acctbal") + F.when(F.col("metric") == "left_n", 1).otherwise(0)
    a = base.select(s.alias("subject_id"), "metric", v.alias("value"))
    b = base.select(s.alias("subject_id"), "metric",
                                       (v * F.when(s % 7 == 0, lit(1.1)).otherwise(lit(1.0) + lit(1e-12))).alias("value"))
    i = F.col("subject_id")  # each run has subjects of its own besides
    a = a.union(a.where(i % 10 == 0).withColumn("subject_id", -i - 1))
    b = b.union(b.where(i % 11 == 3).withColumn("subject_id", i + 1_000_000_000))
    d = cp.metric_difference(a, b)
    return d.withColumns({"value1": rnd(F.col("value1")), "value2": rnd(F.col("value2"), 4),
                          "absolute_diff": rnd(F.col("absolute_diff"), 4), "relative_diff": rnd(F.col("relative_diff"))})


@query("A21_stability", LONG + f""",
r AS (SELECT subject_id, side, scalar, unnest([0, 1, 2]) AS run, unnest([value, value, CASE WHEN side = 'left' THEN value * 101e-2 ELSE value END]) AS value FROM lng),
s AS (SELECT subject_id, side, scalar, run, count(*) AS n, avg(value) AS mean, quantile_cont(value, 5e-1) AS median, quantile_cont(value, 5e-2) AS p05,
   quantile_cont(value, 95e-2) AS p95 FROM r GROUP BY 1, 2, 3, 4)
SELECT subject_id, side, scalar, run, n, {", ".join(f"{r6(c, 12)} AS {c}" for c in ("mean", "median", "p05", "p95"))}, NOT (run = 2 AND side = 'left') AS stable FROM s""")
def a21(spark, sf):
    s = me.sample(voxelise(bundles(spark, sf), GRID), fx.voxels(spark))
    lng = s.unpivot(["subject_id", "side", "streamline_id"], ["fa", "md", "rd", "ad"], "scalar", "value")
    r = lng.withColumn("run", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    r = r.withColumn("value", F.when((F.col("run") == 2) & (F.col("side") == "left"), F.col("value") * lit(1.01)).otherwise(F.col("value")))
    d = cp.stability(r, ["subject_id", "side", "scalar"])
    return d.withColumns({n: rnd(F.col(n), 12) for n, t in d.dtypes if t == "double"})


def _resampled(name: str, cond: str) -> str:
    """Brute force twin: every bundle of ``cond`` resampled at 2 mm."""
    return f"""
{name}s AS (SELECT *, coalesce(sqrt((x-px)*(x-px) + (y-py)*(y-py) + (z-pz)*(z-pz)), 0e0) AS d FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py,
   lag(z) OVER w AS pz FROM pts WHERE {cond} WINDOW w AS (PARTITION BY streamline_id ORDER BY pt_idx))),
{name}c AS (SELECT *, sum(d) OVER (PARTITION BY streamline_id ORDER BY pt_idx ROWS UNBOUNDED PRECEDING) AS c1, sum(d) OVER (PARTITION BY streamline_id) AS len FROM {name}s),
{name}t AS (SELECT subject_id, streamline_id, unnest(range(m)) * len / (m - 1) AS pos FROM
   (SELECT DISTINCT subject_id, streamline_id, len, CASE WHEN len < 2 THEN 2 ELSE greatest(2, CAST(floor(len / 2e0) AS BIGINT)) END AS m FROM {name}c)),
{name}b AS (SELECT t.subject_id, t.streamline_id, pos, min(pt_idx) AS pt_idx FROM {name}t t JOIN {name}c c ON c.streamline_id = t.streamline_id
   AND pt_idx > 0 AND c1 >= pos - 1e-9 GROUP BY ALL),
{name} AS (SELECT row_number() OVER () AS rid, b.subject_id, px + (x - px) * (pos - (c1 - d)) / d AS x, py + (y - py) * (pos - (c1 - d)) / d AS y,
   pz + (z - pz) * (pos - (c1 - d)) / d AS z FROM {name}b b JOIN {name}c c USING (streamline_id, pt_idx))"""


def _nearest(a: str, b: str) -> str:
    return f"""(SELECT p.subject_id, p.rid, sqrt(min((p.x-q.x)*(p.x-q.x) + (p.y-q.y)*(p.y-q.y) + (p.z-q.z)*(p.z-q.z))) AS d
   FROM {a} p JOIN {b} q USING (subject_id) GROUP BY 1, 2)"""


@query("J10_mean_closest_distance", f"""WITH {SQL_POINTS},{_resampled('ca', CAND_SQL)},{_resampled('re', REF_SQL)},
dd AS (SELECT subject_id, d, 'c' AS way FROM {_nearest('ca', 're')} UNION ALL SELECT subject_id, d, 'r' AS way FROM {_nearest('re', 'ca')})
SELECT subject_id, {r6("(avg(d) FILTER (way = 'c') + avg(d) FILTER (way = 'r')) / 2")} AS symmetric, {r6("avg(d) FILTER (way = 'c')")} AS cand_to_ref,
  {r6("avg(d) FILTER (way = 'r')")} AS ref_to_cand, {r6('stddev_pop(d)')} AS std FROM dd GROUP BY 1""")
def j10(spark, sf):
    p = materialize(fx.points(spark, sf))
    d = cp.mean_closest_distance(p.where(CAND), p.where(REF))
    return d.withColumns({n: rnd(F.col(n)) for n, t in d.dtypes if t == "double"})
