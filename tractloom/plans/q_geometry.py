"""Queries of the point, grid and streamline operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tractloom.functions import geometry as G
from tractloom.functions.numeric import rnd
from tractloom.operators import geometry as geo, streamlines as sl
from tractloom.plans import fixtures as fx
from tractloom.plans.fixtures import GRID, SQL_LENS, SQL_POINTS, SQL_VOX, SQL_VOLUMES, SQL_VOLUME_GRIDS, r6
from tractloom.plans.registry import query


@query("F1_world_to_voxel", f"""WITH {SQL_VOX}
SELECT subject_id, streamline_id, pt_idx, i, j, k, {r6('(x + 5e1) / 2e0')} AS vi FROM vox""")
def f1(spark, sf):
    p = geo.voxelise(fx.points(spark, sf), GRID)
    vi = G.voxel_coords(GRID, (F.col("x"), F.col("y"), F.col("z")))[0]
    return p.select("subject_id", "streamline_id", "pt_idx", "i", "j", "k", rnd(vi).alias("vi"))


@query("F2_voxel_to_world", f"""WITH {SQL_VOLUMES}, {SQL_VOLUME_GRIDS}
SELECT subject_id, i, j, k, {r6(fx.SQL_WORLD_X)} AS wx, {r6(fx.SQL_WORLD_Y)} AS wy, {r6(fx.SQL_WORLD_Z)} AS wz
FROM vol JOIN grd USING (subject_id)""")
def f2(spark, sf):
    v = G.attach_grid(fx.volumes(spark, sf), fx.volume_grids(spark, sf))
    w = geo.voxels_to_world(v, None)
    return w.select("subject_id", "i", "j", "k", *[rnd(F.col(c)).alias(c) for c in ("wx", "wy", "wz")])


@query("F2_world_bounds", f"""WITH {SQL_VOLUME_GRIDS}
SELECT subject_id,
  {r6('least(ox, ox+12*sx, ox+12*sh, ox+12*sx+12*sh)')} AS x_min,
  {r6('greatest(ox, ox+12*sx, ox+12*sh, ox+12*sx+12*sh)')} AS x_max,
  -12e0 AS y_min, 12e0 AS y_max, -2e1 AS z_min, 1e1 AS z_max FROM grd""")
def f2b(spark, sf):
    b = geo.world_bounds(fx.volume_grids(spark, sf))
    return b.select("subject_id", *[rnd(F.col(f"{a}_{m}")).alias(f"{a}_{m}") for a in "xyz" for m in ("min", "max")])


@query("F3_in_bounds", f"""WITH {SQL_VOX}
SELECT subject_id, streamline_id, pt_idx, inb, inb AND k BETWEEN 4 AND 9 AS in_mask FROM vox""")
def f3(spark, sf):
    p = geo.voxelise(fx.points(spark, sf), GRID)
    mask = fx.roi_voxels(spark).where("roi = 'brainstem'").select("subject_id", "i", "j", "k", F.lit(True).alias("hit"))
    j = p.join(mask, ["subject_id", "i", "j", "k"], "left")
    return j.select("subject_id", "streamline_id", "pt_idx", "inb",
                    (F.col("inb") & F.coalesce("hit", F.lit(False))).alias("in_mask"))


@query("F4_length_band", f"""WITH {SQL_POINTS}{SQL_LENS}
SELECT subject_id, streamline_id, n_points, {r6('length')} AS length FROM lens WHERE length BETWEEN 6e1 AND 2e2""")
def f4(spark, sf):
    k = sl.length_band(sl.arc_lengths(fx.points(spark, sf)), *fx.BAND)
    return k.withColumn("length", rnd(F.col("length")))


@query("A1_arc_length", f"""WITH {SQL_POINTS}{SQL_LENS}
SELECT subject_id, streamline_id, n_points, {r6('length')} AS length FROM lens""")
def a1(spark, sf):
    return sl.arc_lengths(fx.points(spark, sf)).withColumn("length", rnd(F.col("length")))


SQL_ORIENT = """,
delt AS (SELECT subject_id, streamline_id, max(n) AS n_points,
    avg(z) FILTER (WHERE pt_idx >= n - q) - avg(z) FILTER (WHERE pt_idx < q) AS dz,
    avg(y) FILTER (WHERE pt_idx >= n - q) - avg(y) FILTER (WHERE pt_idx < q) AS dy,
    avg(x) FILTER (WHERE pt_idx >= n - q) - avg(x) FILTER (WHERE pt_idx < q) AS dx
  FROM (SELECT *, greatest(1, n // 4) AS q FROM
        (SELECT *, count(*) OVER (PARTITION BY streamline_id) AS n FROM pts)) GROUP BY 1, 2),
ori AS (SELECT subject_id, streamline_id, n_points, n_points >= 2 AND
    (CASE WHEN dz <> 0 THEN dz WHEN dy <> 0 THEN dy ELSE dx END) < 0 AS flip FROM delt)"""


@query("W3_orientation", f"""WITH {SQL_POINTS}{SQL_ORIENT}
SELECT subject_id, streamline_id,
  CAST(CASE WHEN flip THEN n_points - 1 - pt_idx ELSE pt_idx END AS INT) AS pt_idx, {r6('z')} AS z
FROM pts JOIN ori USING (subject_id, streamline_id)""")
def w3(spark, sf):
    return sl.orient(fx.points(spark, sf)).select("subject_id", "streamline_id", "pt_idx", rnd(F.col("z")).alias("z"))


@query("W3_dominant_axis", f"""WITH {SQL_POINTS},
e AS (SELECT subject_id, streamline_id, count(*) AS n,
   abs(arg_max(x, pt_idx) - arg_min(x, pt_idx)) AS dx, abs(arg_max(y, pt_idx) - arg_min(y, pt_idx)) AS dy,
   abs(arg_max(z, pt_idx) - arg_min(z, pt_idx)) AS dz FROM pts GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT subject_id, {r6('avg(dx)')} AS span_x, {r6('avg(dy)')} AS span_y, {r6('avg(dz)')} AS span_z,
  CASE WHEN avg(dx) >= avg(dy) AND avg(dx) >= avg(dz) THEN 'X' WHEN avg(dy) >= avg(dz) THEN 'Y' ELSE 'Z' END AS dominant,
  NOT (avg(dz) > avg(dx) AND avg(dz) > avg(dy)) AS not_vertical
FROM e GROUP BY 1""")
def w3b(spark, sf):
    d = sl.dominant_axis(fx.points(spark, sf))
    return d.select("subject_id", *[rnd(F.col(f"span_{a}")).alias(f"span_{a}") for a in "xyz"], "dominant", "not_vertical")


@query("W6_resample", f"""WITH {SQL_POINTS},
seg AS (SELECT *, coalesce(sqrt((x-px)*(x-px) + (y-py)*(y-py) + (z-pz)*(z-pz)), 0e0) AS d
  FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM pts
        WINDOW w AS (PARTITION BY streamline_id ORDER BY pt_idx))),
cum AS (SELECT *, sum(d) OVER (PARTITION BY streamline_id ORDER BY pt_idx ROWS UNBOUNDED PRECEDING) AS c1,
    sum(d) OVER (PARTITION BY streamline_id) AS len, count(*) OVER (PARTITION BY streamline_id) AS n FROM seg),
tgt AS (SELECT subject_id, streamline_id, len, CAST(unnest(range(10)) AS INT) AS out_idx
  FROM (SELECT DISTINCT subject_id, streamline_id, max(len) OVER (PARTITION BY streamline_id) AS len FROM cum)),
br AS (SELECT t.subject_id, t.streamline_id, t.out_idx, t.out_idx * t.len / 9 AS pos,
    min(c.pt_idx) AS pt_idx FROM tgt t JOIN cum c ON c.streamline_id = t.streamline_id
    AND (c.pt_idx > 0 AND c.c1 >= t.out_idx * t.len / 9 - 1e-9 OR c.n = 1) GROUP BY ALL)
SELECT b.subject_id, b.streamline_id, out_idx,
  {r6('px + (x - px) * (pos - (c1 - d)) / d', 5)} AS x, {r6('py + (y - py) * (pos - (c1 - d)) / d', 5)} AS y,
  {r6('pz + (z - pz) * (pos - (c1 - d)) / d', 5)} AS z
FROM br b JOIN cum c ON b.streamline_id = c.streamline_id AND b.pt_idx = c.pt_idx""")
def w6(spark, sf):
    r = sl.resample(fx.points(spark, sf), F.lit(10))
    return r.select("subject_id", "streamline_id", "out_idx", *[rnd(F.col(a), 5).alias(a) for a in "xyz"])


def _fp_sql(name: str, cond: str) -> str:
    r = lambda e: f"(round_even(({e}) * 1e4, 0) / 1e4 + 0e0)"
    cols = ", ".join(f"{r(f'max({a}) FILTER (WHERE pt_idx = {p})')} AS {e}_{a}" for e, p in
                     (("start", "0"), ("end", "n - 1"), ("mid", "n // 2")) for a in "xyz")
    return f"""{name} AS (SELECT DISTINCT subject_id, n_points, length, {', '.join(f'{e}_{a}' for e in ('start', 'end', 'mid') for a in 'xyz')}
  FROM (SELECT subject_id, streamline_id, max(n) AS n_points, {r('max(length)')} AS length, {cols}
        FROM (SELECT p.*, n_points AS n, length FROM pts p JOIN lens USING (subject_id, streamline_id)) WHERE {cond}
        GROUP BY subject_id, streamline_id))"""


@query("U3_fingerprint_match", f"""WITH {SQL_POINTS}{SQL_LENS},
{_fp_sql('every', 'true')}, {_fp_sql('sevenths', 'streamline_id % 7 = 0')}, {_fp_sql('elevenths', 'streamline_id % 11 = 0')},
a AS (SELECT * FROM every UNION SELECT * REPLACE (n_points + 1000 AS n_points) FROM sevenths),
b AS (SELECT * FROM every UNION SELECT * REPLACE (n_points + 2000 AS n_points) FROM elevenths)
SELECT *, 'first' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT *, 'second' AS only_in FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def u3(spark, sf):
    f = sl.fingerprints(fx.points(spark, sf))
    more = lambda every, n: f.unionByName(f.where(F.col("streamline_id") % every == 0).withColumn("n_points", F.col("n_points") + n))  # noqa: E731  runs with added streamlines
    return sl.fingerprint_difference(more(7, 1000), more(11, 2000))


@query("F11_ras_orientation", f"""WITH {SQL_VOLUMES}, {SQL_VOLUME_GRIDS}
SELECT subject_id, i, j, k, CAST(CASE WHEN sx < 0 THEN 11 - i ELSE i END AS INT) AS i_ras, j AS j_ras, k AS k_ras,
  CAST(sign(sx) AS INT) AS x_sign, sx < 0 AS left_on_right, i AS i_back FROM vol JOIN grd USING (subject_id)""")
def f11(spark, sf):
    g = geo.ras_axes(fx.volume_grids(spark, sf)).withColumn("x_sign", geo.axis_world_x_sign(0)) \
        .withColumn("left_on_right", geo.shows_left_on_right(0))
    v = G.attach_grid(fx.volumes(spark, sf), g)
    r = geo.to_ras(v)
    back = geo.from_ras(r.withColumnRenamed("i", "i0").withColumnRenamed("j", "j0").withColumnRenamed("k", "k0"))
    return back.select("subject_id", F.col("i0").alias("i"), F.col("j0").alias("j"), F.col("k0").alias("k"),
                       "i_ras", "j_ras", "k_ras", "x_sign", "left_on_right", F.col("i").alias("i_back"))


@query("A25_plane_limits", f"""WITH {SQL_POINTS}, s AS (SELECT DISTINCT subject_id FROM pts UNION ALL SELECT 8),
g AS (SELECT subject_id, min(x) AS x0, max(x) AS x1, min(z) AS z0, max(z) AS z1 FROM pts GROUP BY 1),
h AS (SELECT subject_id, coalesce(x0, -5e1) AS x0, coalesce(x1, 5e1) AS x1, coalesce(z0, -4e1) AS z0, coalesce(z1, 8e1) AS z1
      FROM s LEFT JOIN g USING (subject_id)),
p AS (SELECT *, CASE WHEN x1 <> x0 THEN (x1-x0)*5e-2 ELSE 1e0 END AS px, CASE WHEN z1 <> z0 THEN (z1-z0)*5e-2 ELSE 1e0 END AS pz FROM h)
SELECT subject_id, {r6('x0 - px')} AS x_min, {r6('x1 + px')} AS x_max, {r6('z0 - pz')} AS z_min, {r6('z1 + pz')} AS z_max FROM p""")
def a25(spark, sf):
    p = fx.points(spark, sf)
    subjects = p.select("subject_id").distinct().union(spark.range(8, 9))  # one without points
    d = geo.plane_limits(p, subjects, "x", "z", ((-50.0, 50.0), (-40.0, 80.0)))
    return d.select("subject_id", *[rnd(F.col(c)).alias(c) for c in d.columns[1:]])


@query("A26_coordinate_validation", f"""WITH {SQL_POINTS},
q AS (SELECT subject_id, x + CASE WHEN subject_id % 3 = 1 THEN 6e1 ELSE 0e0 END AS x,
   y + CASE WHEN subject_id % 3 = 1 THEN 6e1 WHEN subject_id % 3 = 2 THEN 9e1 ELSE 0e0 END AS y,
   z + CASE WHEN subject_id % 3 = 1 THEN 6e1 ELSE 0e0 END AS z FROM pts),
s AS (SELECT DISTINCT subject_id FROM pts UNION ALL SELECT 8),
b AS (SELECT subject_id, count(*) AS n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1, min(z) AS z0, max(z) AS z1 FROM q GROUP BY 1),
c AS (SELECT s.subject_id, coalesce(n, 0) AS n_points,
   coalesce(least(x0,y0,z0) >= -1 AND greatest(x1,y1,z1) < 300 AND greatest(x1-x0,y1-y0,z1-z0) < 260, false) AS vs,
   concat_ws(',', CASE WHEN x0 < -65 OR x1 > 65 THEN 'x' END, CASE WHEN y0 < -65 OR y1 > 65 THEN 'y' END,
             CASE WHEN z0 < -55 OR z1 > 95 THEN 'z' END) AS ax,
   CASE WHEN x0 < -65 OR x1 > 65 THEN 1 ELSE 0 END + CASE WHEN y0 < -65 OR y1 > 65 THEN 1 ELSE 0 END
   + CASE WHEN z0 < -55 OR z1 > 95 THEN 1 ELSE 0 END AS na FROM s LEFT JOIN b USING (subject_id))
SELECT subject_id, n_points, CAST(vs::INT + (na > 1)::INT AS INT) AS n_errors,
  concat_ws(';', CASE WHEN vs THEN 'voxel_space' END, CASE WHEN na > 1 THEN 'outside_box' END) AS errors,
  concat_ws(';', CASE WHEN n_points = 0 THEN 'empty' END, CASE WHEN vs THEN 'voxel_space' END,
            CASE WHEN na > 0 THEN 'beyond_' || ax END) AS warnings,
  NOT vs AND na <= 1 AS valid FROM c""")
def a26(spark, sf):
    p = fx.points(spark, sf)
    s = F.col("subject_id")
    moved = p.select(
        s, (F.col("x") + F.when(s % 3 == 1, 60.0).otherwise(0.0)).alias("x"),
        (F.col("y") + F.when(s % 3 == 1, 60.0).when(s % 3 == 2, 90.0).otherwise(0.0)).alias("y"),
        (F.col("z") + F.when(s % 3 == 1, 60.0).otherwise(0.0)).alias("z"))
    flat = [v for row in GRID.affine for v in row]
    grids = p.select("subject_id").distinct().union(spark.range(8, 9)).select(
        "subject_id", F.array(*[F.lit(v) for v in flat]).alias("affine"),
        *[F.lit(n).alias(c) for c, n in zip(("nx", "ny", "nz"), GRID.shape)])
    return geo.validate_coordinates(moved, grids)
