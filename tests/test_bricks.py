"""Voxel bricks and rims against the voxel-row operators."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractloom.functions.geometry import Grid
from tractloom.operators import bricks as br, extract as ex, fields, metrics as me
from tractloom.operators.geometry import voxelise
from tractloom.functions.geometry import attach_grid

VOX = ["subject_id", "i", "j", "k"]
SCALARS = ("fa", "md")


@pytest.fixture(scope="module")
def sparse(spark):
    """Two subjects, two of five voxels there, negative indices too, a null value."""
    draw = random.Random(2)
    rows = [(s, i, j, k, draw.random(), None if (i, j, k) == (0, 0, 0) else draw.random()) for s in (0, 1) for i in range(-3, 19) for j in range(11) for k in range(9) if draw.random() < 0.4 or (i, j, k) == (0, 0, 0)]
    return spark.createDataFrame(rows, "subject_id long, i int, j int, k int, fa double, md double")


def rows(df, *cols):
    return sorted([tuple(r) for r in df.select(*cols).collect()], key=str)


def test_pack_and_unpack(spark, sparse):
    packed = br.pack(sparse, SCALARS)
    assert rows(br.unpack(packed, SCALARS), *VOX, *SCALARS) == rows(sparse, *VOX, *SCALARS)
    assert br.unpack(br.pack(sparse.limit(0), SCALARS), SCALARS).count() == 0
    full = spark.range(512).selectExpr("0L subject_id", "cast(id div 64 as int) i", "cast(id div 8 % 8 as int) j", "cast(id % 8 as int) k", "cast(id as double) fa")
    (one,) = br.pack(full, ("fa",)).collect()
    assert one.occ == [-1] * 8 and one.fa == [float(x) for x in range(512)]


def test_sample_and_passes_equal_voxel_rows(spark, make_points, sparse):
    draw = random.Random(4)
    line = lambda: [(draw.uniform(-4, 20), draw.uniform(-2, 12), draw.uniform(-2, 10)) for _ in range(40)]
    points = make_points({n: line() for n in range(6)}, 0).union(make_points({n: line() for n in range(6)}, 1)).union(make_points({7: line()}, 5))
    eye = [1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0, 0, 0, 0, 0, 1.0]
    shifted = [2.0, 0, 0, -1.0, 0, 1.0, 0, 0, 0, 0, 1.0, 0.5, 0, 0, 0, 1.0]
    grids = spark.createDataFrame([(0, [float(x) for x in eye], 20, 11, 9), (1, [float(x) for x in shifted], 12, 11, 9), (5, [float(x) for x in eye], 9, 9, 9)],
                                  "subject_id long, affine array<double>, nx int, ny int, nz int")
    shared = Grid(((1.0, 0.0, 0.0, 0.0), (0.0, 1.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0)), (20, 11, 9))
    masks = sparse.withColumn("roi", F.when(F.col("fa") < 0.3, "a").when(F.col("fa") < 0.5, "b")).where("roi is not null")
    for v in (voxelise(points, shared), voxelise(attach_grid(points, grids), None)):
        v = v.select("subject_id", "streamline_id", "pt_idx", "x", "y", "z", "i", "j", "k", "inb")
        cols = ("subject_id", "streamline_id", "pt_idx", *SCALARS)
        assert rows(br.sample(v, br.pack(sparse, SCALARS), SCALARS), *cols) == rows(me.sample(v, sparse, SCALARS), *cols)
        packed = br.pack_masks(masks, ("a", "b"))
        want = rows(ex.passes(v, ex.roi_flags(masks, ("a", "b")), ("a", "b")), "subject_id", "streamline_id", "a", "b")
        assert rows(br.passes(v, packed, ("a", "b"), ["subject_id", "streamline_id"]), "subject_id", "streamline_id", "a", "b") == want
        hit = rows(br.filter_by_roi(v, packed, "a", ["subject_id", "streamline_id"]), "subject_id", "streamline_id")
        assert hit == [(s, n) for s, n, a, _ in want if a] and hit


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_jacobian_with_rims_equals_windows(spark, sparse):
    draw = np.random.default_rng(3)
    dense = spark.createDataFrame([(2, i, j, k) for i in range(9) for j in range(17) for k in range(3)], "subject_id long, i int, j int, k int")
    for voxels in (sparse.select(*VOX), dense):
        field = voxels.withColumns({u: ((F.xxhash64(*VOX, F.lit(u)) % 1000) / 250).cast("double") for u in ("ux", "uy", "uz")})
        spacing = (F.lit(2.0), F.lit(1.0) + F.col("subject_id") * F.lit(0.5), F.lit(2.5))
        new = br.jacobian(field, spacing)
        assert exchanges(new) == 1
        a = {r[:4]: r[4] for r in map(tuple, new.select(*VOX, "det").collect())}
        b = {r[:4]: r[4] for r in map(tuple, fields.jacobian(field, spacing).select(*VOX, "det").collect())}
        assert a.keys() == b.keys() and np.allclose([a[x] for x in a], [b[x] for x in a], rtol=1e-12)


def test_face_neighbours(spark, sparse):
    flagged = sparse.select(*VOX, (F.col("fa") < 0.5).alias("f"))
    have = {(r.subject_id, r.i, r.j, r.k): r.f for r in flagged.collect()}
    for r in br.face_neighbours(flagged, "f").collect():
        s, i, j, k = r.subject_id, r.i, r.j, r.k
        near = [(s, i + a, j + b, k + c) for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1))]
        assert r.around == sum(have.get(x, False) for x in near) and r.own == have[s, i, j, k]
    assert br.face_neighbours(flagged, "f").count() == len(have)
