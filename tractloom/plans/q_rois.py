"""Queries of the region, label and midline operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractloom.functions import geometry as G
from tractloom.functions.numeric import rnd
from tractloom.operators import rois
from tractloom.plans import fixtures as fx
from tractloom.plans.fixtures import SQL_VOLUME_GRIDS, SQL_VOLUMES, SQL_WORLD_X, SQL_WORLD_Y, SQL_WORLD_Z, r6
from tractloom.plans.registry import query

WITH = f"WITH {SQL_VOLUMES}, {SQL_VOLUME_GRIDS}"
SPLIT = f""",
hem AS (SELECT v.*, sx, sh, ox, CAST(CASE WHEN {SQL_WORLD_X} >= 0 AND label > 0 THEN label + 100 ELSE label END AS INT) AS label2
  FROM vol v JOIN grd USING (subject_id))"""
# brainstem label 8 may lie on either side, so both 8 and 108 count as brainstem here
RAW = """,
raw AS (SELECT subject_id, i, j, k, 'brainstem' AS roi FROM vol WHERE label = 8
  UNION ALL SELECT subject_id, i, j, k, CASE label2 WHEN 7 THEN 'motor_left' ELSE 'motor_right' END FROM hem WHERE label2 IN (7, 107))"""
OFFS = """,
offs AS (SELECT a, b, c, abs(a)+abs(b)+abs(c) AS r FROM range(-2, 3) x(a), range(-2, 3) y(b), range(-2, 3) z(c)
  WHERE abs(a)+abs(b)+abs(c) <= 2)"""
GROWN = """,
grown AS (SELECT DISTINCT subject_id, roi, CAST(i+a AS INT) AS i, CAST(j+b AS INT) AS j, CAST(k+c AS INT) AS k
  FROM raw, offs WHERE r <= CASE WHEN roi = 'brainstem' THEN 2 ELSE 1 END
    AND i+a BETWEEN 0 AND 11 AND j+b BETWEEN 0 AND 11 AND k+c BETWEEN 0 AND 11)"""
MASKS = SPLIT + RAW + OFFS + GROWN + f""",
masks AS (SELECT g.subject_id, roi, i, j, k FROM grown g JOIN grd USING (subject_id)
  WHERE roi = 'brainstem' OR (roi = 'motor_left' AND {SQL_WORLD_X} < 1e0) OR (roi = 'motor_right' AND {SQL_WORLD_X} >= 1e0))"""


def _labels(spark, sf):
    """Raw labels with the grid attached, cortical labels split by side, brainstem kept whole."""
    v = G.attach_grid(fx.volumes(spark, sf), fx.volume_grids(spark, sf))
    stem = v.where("label = 8")
    return v, rois.split_hemispheres(v.where("label <> 8")).unionByName(stem)


def _masks(spark, sf):
    return rois.create_roi_masks(_labels(spark, sf)[1], midline_x=F.lit(1.0))


@query("F6_hemisphere_split", WITH + SPLIT + "SELECT subject_id, i, j, k, label2 AS label FROM hem")
def f6(spark, sf):
    v, _ = _labels(spark, sf)
    return rois.split_hemispheres(v).select("subject_id", "i", "j", "k", F.col("label").cast("int").alias("label"))


@query("F5_roi_masks", WITH + MASKS + "SELECT * FROM masks")
def f5(spark, sf):
    return _masks(spark, sf)


@query("F5_combined_labels", WITH + MASKS + """
SELECT subject_id, i, j, k, CAST(max(CASE roi WHEN 'brainstem' THEN 1 WHEN 'motor_left' THEN 2 ELSE 3 END) AS INT) AS code
FROM masks GROUP BY ALL""")
def f5b(spark, sf):
    return rois.combined_labels(_masks(spark, sf))


@query("F7_hemisphere_clamp", WITH + SPLIT + RAW + """
SELECT subject_id, roi, i, j, k FROM raw
WHERE roi = 'brainstem' OR (roi = 'motor_left') = (i < CASE WHEN j > 7 THEN 7 ELSE 6 END)""")
def f7(spark, sf):
    _, lab = _labels(spark, sf)
    hemi = fx.volumes(spark, sf).where("i < CASE WHEN j > 7 THEN 7 ELSE 6 END")
    return rois.clamp_to_hemisphere(rois.roi_masks(lab), hemisphere=hemi).select("subject_id", "roi", "i", "j", "k")


@query("F8_tissue_masks", WITH + OFFS + f""",
wm AS (SELECT DISTINCT subject_id, i+a AS i, j+b AS j, k+c AS k FROM vol, offs WHERE fa > 2e-1 AND brain AND r <= 1
   AND i+a BETWEEN 0 AND 11 AND j+b BETWEEN 0 AND 11 AND k+c BETWEEN 0 AND 11)
SELECT v.subject_id, v.i, v.j, v.k, w.i IS NOT NULL AS white_matter, fa >= 2e-1 AS seed,
  {r6('CASE WHEN brain THEN fa ELSE 0e0 END')} AS stop_fa
FROM vol v LEFT JOIN wm w ON v.subject_id = w.subject_id AND v.i = w.i AND v.j = w.j AND v.k = w.k""")
def f8(spark, sf):
    v, _ = _labels(spark, sf)
    return rois.tissue_masks(v).withColumn("stop_fa", rnd(F.col("stop_fa")))


@query("F9_nan_cleanup", f"""WITH {SQL_VOLUMES}
SELECT subject_id, i, j, k, {r6('CASE WHEN (i+j+k+subject_id) % 5 < 3 THEN 0e0 ELSE fa END')} AS fa FROM vol""")
def f9(spark, sf):
    from tractloom.functions.numeric import finite_or_zero
    m = (F.col("i") + F.col("j") + F.col("k") + F.col("subject_id")) % 5
    dirty = F.when(m == 0, float("nan")).when(m == 1, float("inf")).when(m == 2, float("-inf")).otherwise(F.col("fa"))
    return fx.volumes(spark, sf).select("subject_id", "i", "j", "k", rnd(finite_or_zero(dirty)).alias("fa"))


@query("F10_dilation", WITH + OFFS + """
SELECT DISTINCT subject_id, CAST(i+a AS INT) AS i, CAST(j+b AS INT) AS j, CAST(k+c AS INT) AS k
FROM vol, offs WHERE label = 16 AND i+a BETWEEN 0 AND 11 AND j+b BETWEEN 0 AND 11 AND k+c BETWEEN 0 AND 11""")
def f10(spark, sf):
    v, _ = _labels(spark, sf)
    return rois.dilate(v.where("label = 16").select(*rois.VOX, "nx", "ny", "nz"), 2)


@query("F13_seed_grid", WITH + f""",
s AS (SELECT subject_id, i + (a + 5e-1)/2e0 - 5e-1 AS i, j + (b + 5e-1)/2e0 - 5e-1 AS j, k + (c + 5e-1)/2e0 - 5e-1 AS k
  FROM vol, range(2) x(a), range(2) y(b), range(2) z(c) WHERE label = 8)
SELECT subject_id, {r6(SQL_WORLD_X)} AS x, {r6(SQL_WORLD_Y)} AS y, {r6(SQL_WORLD_Z)} AS z FROM s JOIN grd USING (subject_id)""")
def f13(spark, sf):
    v, _ = _labels(spark, sf)
    s = rois.seeds(v.where("label = 8"), 2)
    return s.select("subject_id", *[rnd(F.col(a)).alias(a) for a in "xyz"])


@query("A8_roi_geometry", WITH + MASKS + f"""
SELECT subject_id, roi, {r6(f'avg({SQL_WORLD_X})')} AS com_x, {r6(f'avg({SQL_WORLD_Y})')} AS com_y,
  {r6(f'avg({SQL_WORLD_Z})')} AS com_z, {r6(f'min({SQL_WORLD_X})')} AS x_min, {r6(f'max({SQL_WORLD_X})')} AS x_max,
  count(*) AS voxel_count, {r6(f'abs(avg({SQL_WORLD_X}))')} AS midline_dist
FROM masks JOIN grd USING (subject_id) GROUP BY 1, 2""")
def a8(spark, sf):
    m = G.attach_grid(_masks(spark, sf), fx.volume_grids(spark, sf))
    g = rois.roi_geometry(m)
    return g.select("subject_id", "roi", "voxel_count",
                    *[rnd(F.col(c)).alias(c) for c in ("com_x", "com_y", "com_z", "x_min", "x_max", "midline_dist")])


@query("A9_roi_hemisphere_split", WITH + MASKS + f"""
SELECT subject_id, roi, count(*) FILTER ({SQL_WORLD_X} < 1e0) AS left_voxels, count(*) FILTER ({SQL_WORLD_X} >= 1e0) AS right_voxels,
  count(*) AS total_voxels,
  {r6(f'CASE WHEN count(*) FILTER ({SQL_WORLD_X} >= 1e0) = 0 THEN 0e0 ELSE count(*) FILTER ({SQL_WORLD_X} < 1e0)::DOUBLE / count(*) FILTER ({SQL_WORLD_X} >= 1e0) END')} AS lr_ratio,
  {r6(f'count(*) FILTER ({SQL_WORLD_X} < 1e0)::DOUBLE / count(*) * 100')} AS left_pct,
  {r6(f'count(*) FILTER ({SQL_WORLD_X} >= 1e0)::DOUBLE / count(*) * 100')} AS right_pct
FROM masks JOIN grd USING (subject_id) GROUP BY 1, 2""")
def a9(spark, sf):
    m = G.attach_grid(_masks(spark, sf), fx.volume_grids(spark, sf))
    g = rois.roi_hemisphere_split(m, 1.0)
    return g.withColumns({c: rnd(F.col(c)) for c in ("lr_ratio", "left_pct", "right_pct")})


BOUND = f""",
spc AS (SELECT v.*, sx, sh, ox, i < CASE WHEN j > 7 THEN 7 ELSE 6 END + subject_id % 2 AS lft FROM vol v JOIN grd USING (subject_id)),
rgt AS (SELECT subject_id, i, j, k FROM spc WHERE NOT lft AND brain),
bnd AS (SELECT s.* FROM spc s WHERE lft AND brain AND EXISTS (SELECT 1 FROM rgt r WHERE r.subject_id = s.subject_id
   AND abs(r.i - s.i) + abs(r.j - s.j) + abs(r.k - s.k) <= 1))"""


def _space(spark, sf):
    v, _ = _labels(spark, sf)
    return v.withColumn("left", F.expr("i < CASE WHEN j > 7 THEN 7 ELSE 6 END + subject_id % 2"))


@query("A16_midline_x", WITH + BOUND + f""",
w AS (SELECT subject_id, {SQL_WORLD_X} AS wx, {SQL_WORLD_Y} AS wy, {SQL_WORLD_Z} AS wz FROM bnd),
q AS (SELECT subject_id, quantile_cont(wy, 15e-2) AS ylo, quantile_cont(wy, 85e-2) AS yhi,
   quantile_cont(wz, 15e-2) AS zlo, quantile_cont(wz, 85e-2) AS zhi FROM w GROUP BY 1)
SELECT subject_id, {r6('coalesce(median(wx) FILTER (wy BETWEEN ylo AND yhi AND wz BETWEEN zlo AND zhi), median(wx), 0e0)')} AS midline_x
FROM (SELECT DISTINCT s_suppkey AS subject_id FROM supplier) LEFT JOIN w USING (subject_id) LEFT JOIN q USING (subject_id) GROUP BY 1""")
def a16(spark, sf):
    subjects = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("subject_id"))
    return rois.midline_x(_space(spark, sf), subjects).withColumn("midline_x", rnd(F.col("midline_x")))



A16_TABLE = f""",
w AS (SELECT subject_id, {SQL_WORLD_X} AS wx, {SQL_WORLD_Y} AS wy, {SQL_WORLD_Z} AS wz FROM bnd),
q AS (SELECT subject_id, quantile_cont(wy, 15e-2) AS ylo, quantile_cont(wy, 85e-2) AS yhi,
   quantile_cont(wz, 15e-2) AS zlo, quantile_cont(wz, 85e-2) AS zhi FROM w GROUP BY 1),
mid AS (SELECT subject_id, {r6('coalesce(median(wx) FILTER (wy BETWEEN ylo AND yhi AND wz BETWEEN zlo AND zhi), median(wx), 0e0)')} AS m
  FROM w JOIN q USING (subject_id) GROUP BY 1)"""


@query("A9_subject_midline", WITH + MASKS + BOUND + A16_TABLE + f""",
x AS (SELECT subject_id, roi, {SQL_WORLD_X} < coalesce(m, 0e0) AS l FROM masks JOIN grd USING (subject_id) LEFT JOIN mid USING (subject_id)),
n AS (SELECT subject_id, roi, count(*) FILTER (l) AS left_voxels, count(*) FILTER (NOT l) AS right_voxels, count(*) AS total_voxels FROM x GROUP BY 1, 2)
SELECT *, {r6('CASE WHEN right_voxels = 0 THEN 0e0 ELSE left_voxels::DOUBLE / right_voxels END')} AS lr_ratio,
  {r6('left_voxels::DOUBLE / total_voxels * 100')} AS left_pct, {r6('right_voxels::DOUBLE / total_voxels * 100')} AS right_pct FROM n""")
def a9_subject(spark, sf):
    m = rois.attach_midline(G.attach_grid(_masks(spark, sf), fx.volume_grids(spark, sf)), a16(spark, sf))
    g = rois.roi_hemisphere_split(m, F.col("midline_x"))
    return g.withColumns({c: rnd(F.col(c)) for c in ("lr_ratio", "left_pct", "right_pct")})


@query("A17_midline_distance", WITH + BOUND + f""",
sz AS (SELECT subject_id, abs(sx) AS vx, sqrt(sh*sh + 4e0) AS vy, 25e-1 AS vz FROM grd),
dst AS (SELECT s.subject_id, s.i, s.j, s.k, sqrt(min(((s.i-b.i)*vx)*((s.i-b.i)*vx) + ((s.j-b.j)*vy)*((s.j-b.j)*vy) + ((s.k-b.k)*vz)*((s.k-b.k)*vz))) AS d
  FROM spc s JOIN bnd b USING (subject_id) JOIN sz USING (subject_id) WHERE s.brain GROUP BY ALL)
SELECT s.subject_id, s.i, s.j, s.k, {r6('CASE WHEN NOT brain THEN 0e0 WHEN lft THEN -d ELSE d END')} AS distance
FROM spc s LEFT JOIN dst d ON s.subject_id = d.subject_id AND s.i = d.i AND s.j = d.j AND s.k = d.k""")
def a17(spark, sf):
    d = rois.midline_distance(_space(spark, sf), G.voxel_size_columns(F.col("affine")))
    return d.withColumn("distance", rnd(F.col("distance")))


_SPARSE = "(i + 2*j + k + subject_id) % 3 > 0 AND (subject_id % 7 > 0 OR lft)"  # a third of the voxels is missing; every seventh subject has one side only


@query("A17_distance_sparse", WITH + BOUND.replace("spc AS (", "sp0 AS (", 1).replace("rgt AS (", f"spc AS (SELECT * FROM sp0 WHERE {_SPARSE}), rgt AS (", 1) + f""",
sz AS (SELECT subject_id, abs(sx) AS vx, sqrt(sh*sh + 4e0) AS vy, 25e-1 AS vz FROM grd),
dst AS (SELECT s.subject_id, s.i, s.j, s.k, sqrt(min(((s.i-b.i)*vx)*((s.i-b.i)*vx) + ((s.j-b.j)*vy)*((s.j-b.j)*vy) + ((s.k-b.k)*vz)*((s.k-b.k)*vz))) AS d
  FROM spc s JOIN bnd b USING (subject_id) JOIN sz USING (subject_id) WHERE s.brain GROUP BY ALL)
SELECT s.subject_id, s.i, s.j, s.k, {r6('CASE WHEN NOT brain THEN 0e0 WHEN lft THEN -d ELSE d END')} AS distance
FROM spc s LEFT JOIN dst d ON s.subject_id = d.subject_id AND s.i = d.i AND s.j = d.j AND s.k = d.k""")
def a17_sparse(spark, sf):
    d = rois.midline_distance(_space(spark, sf).where(_SPARSE.replace("lft", "left")), G.voxel_size_columns(F.col("affine")))
    return d.withColumn("distance", rnd(F.col("distance")))


@query("A18_label_inventory", WITH + SPLIT + """,
f AS (SELECT subject_id, label2 AS label, count(*) AS voxels FROM hem WHERE label2 > 0 GROUP BY 1, 2),
e AS (SELECT s_suppkey AS subject_id, CAST(unnest([7, 107, 8, 55]) AS INT) AS label FROM supplier WHERE s_suppkey % 3 > 0
  UNION ALL SELECT s_suppkey, CAST(unnest([7, 107]) AS INT) FROM supplier WHERE s_suppkey % 3 = 0),
d AS (SELECT coalesce(f.subject_id, e.subject_id) AS subject_id, coalesce(f.label, e.label) AS label, coalesce(voxels, 0) AS voxels,
   e.label IS NOT NULL AS expected, e.label IS NOT NULL AND coalesce(voxels, 0) = 0 AS missing
   FROM f FULL JOIN e ON f.subject_id = e.subject_id AND f.label = e.label)
SELECT *, NOT bool_or(missing) OVER (PARTITION BY subject_id) AS success FROM d""")
def a18(spark, sf):
    v, _ = _labels(spark, sf)
    lab = rois.split_hemispheres(v).withColumn("label", F.col("label").cast("int"))
    subjects = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("subject_id"))
    few = F.col("subject_id") % 3 == 0
    return rois.label_inventory(lab.where(few), subjects.where(few), [7, 107]).unionByName(
        rois.label_inventory(lab.where(~few), subjects.where(~few), [7, 107, 8, 55]))


A24 = """,
v AS (SELECT DISTINCT subject_id, i, j, k FROM masks),
ci AS (SELECT subject_id, i, count(*) AS c FROM v GROUP BY 1, 2), cj AS (SELECT subject_id, j, count(*) AS c FROM v GROUP BY 1, 2),
ck AS (SELECT subject_id, k, count(*) AS c FROM v GROUP BY 1, 2),
bi AS (SELECT subject_id, i, c FROM ci QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY c DESC, i) = 1),
bj AS (SELECT subject_id, j, c FROM cj QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY c DESC, j) = 1),
bk AS (SELECT subject_id, k, c FROM ck QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY c DESC, k) = 1)"""


@query("A24_densest_slice", WITH + MASKS + A24 + """, subj AS (SELECT s_suppkey FROM supplier UNION ALL SELECT -1)
SELECT s_suppkey AS subject_id, coalesce(i, 6) AS slice_i, coalesce(bi.c, 0) AS count_i, coalesce(j, 6) AS slice_j,
  coalesce(bj.c, 0) AS count_j, coalesce(k, 6) AS slice_k, coalesce(bk.c, 0) AS count_k
FROM subj LEFT JOIN bi ON s_suppkey = bi.subject_id LEFT JOIN bj ON s_suppkey = bj.subject_id LEFT JOIN bk ON s_suppkey = bk.subject_id""")
def a24(spark, sf):
    subjects = fx.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("subject_id"))
    return rois.densest_slices(_masks(spark, sf), subjects.union(spark.range(-1, 0)), (fx.BOX,) * 3)  # and a subject without regions


@query("A24_subject_shapes", WITH + MASKS + A24 + """, subj AS (SELECT s_suppkey, 12 AS nx, 12 AS ny, 12 AS nz FROM supplier
  UNION ALL SELECT -s_suppkey, 3 + s_suppkey % 5, 3 + s_suppkey % 7, 3 + s_suppkey % 11 FROM supplier)
SELECT s_suppkey AS subject_id, CAST(coalesce(i, nx // 2) AS INT) AS slice_i, coalesce(bi.c, 0) AS count_i, CAST(coalesce(j, ny // 2) AS INT) AS slice_j,
  coalesce(bj.c, 0) AS count_j, CAST(coalesce(k, nz // 2) AS INT) AS slice_k, coalesce(bk.c, 0) AS count_k
FROM subj LEFT JOIN bi ON s_suppkey = bi.subject_id LEFT JOIN bj ON s_suppkey = bj.subject_id LEFT JOIN bk ON s_suppkey = bk.subject_id""")
def a24_shapes(spark, sf):
    s = F.col("s_suppkey")
    t = fx.table(spark, sf, "supplier")
    own = t.select(s.alias("subject_id"), *[F.lit(fx.BOX).cast("long").alias(n) for n in ("nx", "ny", "nz")])
    empty = t.select((-s).alias("subject_id"), *[(3 + s % d).cast("long").alias(n) for n, d in (("nx", 5), ("ny", 7), ("nz", 11))])
    return rois.densest_slices(_masks(spark, sf), own.union(empty))
