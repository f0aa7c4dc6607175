"""Nearest points of two bundles: blocks follow the density of the points, results are those of brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tractloom.operators import compare as cp


def frame(spark, a, b):
    rows = [(s, *map(float, p), side) for side, pts in enumerate((a, b)) for s, p in pts]
    return spark.createDataFrame(rows, "subject_id long, x double, y double, z double, side int")


def test_both_ways_equal_brute_force_in_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(cp, "LEAF", 8)
    rng = np.random.default_rng(11)
    cloud = lambda n: [(s, p) for s in (0, 1) for p in np.concatenate([rng.normal(0, 0.2, (n, 3)), rng.normal(5, 12, (n // 3, 3)), rng.normal(0, 200, (2, 3))])]
    a, b = cloud(300), cloud(200)
    a += b[:5] + [(2, np.zeros(3)), (0, np.array([np.nan, 0, 0]))] + a[:4]
    pts = frame(spark, a, b)
    assert cp._block_size(pts.where("x is not null and not isnan(x)"))[0] < 1
    got = {(r.subject_id, r.way, r.x, r.y, r.z): (r.weight, r.total / r.weight) for r in cp._nearest(pts).collect()}
    want = {}
    for way, (src, tgt) in enumerate(((a, b), (b, a))):
        for s, p in src:
            there = np.array([q for t, q in tgt if t == s and np.isfinite(q).all()])
            if len(there) and np.isfinite(p).all():
                key = (s, way, *map(float, p))
                want[key] = (want.get(key, (0,))[0] + 1, np.sqrt(((there - p) ** 2).sum(axis=1)).min())
    assert got.keys() == want.keys()
    assert all(got[k][0] == want[k][0] and got[k][1] == pytest.approx(want[k][1], rel=1e-12) for k in want)
    sums = cp._nearest(pts, fold=True).groupBy("subject_id", "way").agg(F.sum("weight").alias("w"), F.sum("total").alias("t")).collect()
    for r in sums:
        mine = [v for k, v in want.items() if k[:2] == (r.subject_id, r.way)]
        assert r.w == sum(w for w, _ in mine) and r.t == pytest.approx(sum(w * d for w, d in mine))


def test_pairs_grow_with_the_points(spark):
    """Twice as many points in the same place meet in smaller blocks; before, each met all of its 1 mm cell."""
    for n in (20_000, 160_000):
        p = spark.range(n).select(F.lit(0).alias("subject_id"), *[(F.pmod(F.xxhash64("id", F.lit(a)), F.lit(1 << 30)) / (1 << 30)).alias(a) for a in "xyz"])
        size, rows = cp._block_size(p)
        met = p.groupBy(*cp._cell(size)).count().agg(F.sum(F.col("count") * F.col("count"))).first()[0]
        assert rows == n and met <= cp.LEAF * n
