import math
import random

import pytest
from pyspark.sql import functions as F

from tractloom.operators import streamlines as sl


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_arc_length_and_single_vertex(make_points):
    p = make_points({1: [(0, 0, 0), (3, 4, 0), (3, 4, 12)], 2: [(1, 1, 1)]})
    got = {r.streamline_id: (r.n_points, r.length) for r in sl.arc_lengths(p).collect()}
    assert got == {1: (3, 17.0), 2: (1, 0.0)}
    assert [r.streamline_id for r in sl.length_band(sl.arc_lengths(p), 17.0, 17.0).collect()] == [1]


def test_long_streamline_spans_blocks(make_points):
    n = 3 * sl.BLOCK + 7
    p = make_points({1: [(i, 0, 0) for i in range(n)], 2: [(0, 0, i) for i in range(sl.BLOCK)]})
    got = {r.streamline_id: (r.n_points, r.length) for r in sl.arc_lengths(p).collect()}
    assert got == {1: (n, float(n - 1)), 2: (sl.BLOCK, float(sl.BLOCK - 1))}
    c = sl.cumulative_length(p.where("streamline_id = 1")).orderBy("pt_idx").collect()
    assert [r.c1 for r in c] == [float(i) for i in range(n)]
    r = sl.resample(p, F.lit(5)).where("streamline_id = 1").orderBy("out_idx").collect()
    assert [x.x for x in r] == pytest.approx([i * (n - 1) / 4 for i in range(5)])


def test_orientation_metamorphic(make_points):
    up = [(0, 0, i) for i in range(12)]
    p = make_points({1: up, 2: up[::-1], 3: [(5, 5, 5)], 4: [(0, i, 2) for i in range(8)][::-1]})
    once = sl.orient(p)
    z = {s: [r.z for r in once.where(F.col("streamline_id") == s).orderBy("pt_idx").collect()] for s in (1, 2)}
    assert z[1] == z[2] == [float(i) for i in range(12)]
    y = [r.y for r in once.where("streamline_id = 4").orderBy("pt_idx").collect()]
    assert y == sorted(y)  # z ties, y decides
    cols = ["streamline_id", "pt_idx", "x", "y", "z"]
    assert rows(sl.orient(once).select(*cols), *cols) == rows(once.select(*cols), *cols)
    shuffled = p.repartition(3).orderBy(F.rand(1))
    assert rows(sl.orient(shuffled).select(*cols), *cols) == rows(once.select(*cols), *cols)


def test_dominant_axis_warns(make_points):
    flat = sl.dominant_axis(make_points({1: [(i, 0, 0) for i in range(5)]})).first()
    tall = sl.dominant_axis(make_points({1: [(0, 0, i) for i in range(5)]})).first()
    assert (flat.dominant, flat.not_vertical) == ("X", True)
    assert (tall.dominant, tall.not_vertical) == ("Z", False)


def test_resample_short_and_flat(make_points):
    p = make_points({1: [(0, 0, 0), (0, 0, 10)], 2: [(2, 2, 2), (2, 2, 2)], 3: [(4, 4, 4)]})
    r = sl.resample(p, F.lit(3))
    got = {}
    for x in r.orderBy("streamline_id", "out_idx").collect():
        got.setdefault(x.streamline_id, []).append((x.x, x.y, x.z))
    assert got == {1: [(0, 0, 0), (0, 0, 5), (0, 0, 10)], 2: [(2, 2, 2)] * 3, 3: [(4, 4, 4)] * 3}


def test_resample_matches_numpy(make_points):
    import numpy as np
    rng = random.Random(3)
    line = [(rng.random() * 9, rng.random() * 9, rng.random() * 9) for _ in range(17)]
    r = sl.resample(make_points({1: line}), F.lit(9)).orderBy("out_idx").collect()
    a = np.array(line)
    c = np.concatenate([[0], np.cumsum(np.linalg.norm(np.diff(a, axis=0), axis=1))])
    want = np.stack([np.interp(np.linspace(0, c[-1], 9), c, a[:, d]) for d in range(3)], axis=1)
    assert np.allclose([[x.x, x.y, x.z] for x in r], want)


def test_fingerprints_ignore_order(make_points):
    a = make_points({1: [(0, 0, 0), (1, 1, 1), (2, 2, 2)], 2: [(5, 5, 5), (6, 6, 6), (9, 9, 9)]})
    b = make_points({8: [(5, 5, 5), (6, 6, 6), (9, 9, 9)], 9: [(0, 0, 0), (1, 1, 1), (2, 2, 2)]})
    fa, fb = sl.fingerprints(a), sl.fingerprints(b)
    assert sl.fingerprint_difference(fa, fb).count() == 0
    extra = sl.fingerprint_difference(fa, fb.where("streamline_id = 8")).collect()
    assert [r.only_in for r in extra] == ["first"] and math.isclose(extra[0].length, round(2 * 3 ** 0.5, 4))
