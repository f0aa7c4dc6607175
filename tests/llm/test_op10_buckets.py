"""The streaming pass over sorted buckets."""

import numpy as np
import pyarrow as pa

from tractloom.llm import op10_simhash as op10


def test_buckets_keep_neighbours_and_the_ends():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(0, 40))
        key, fp = np.sort(rng.integers(0, 12, n)), np.zeros(n, dtype=np.int64)
        for k in np.unique(key):
            fp[key == k] = np.sort(rng.choice(100, (key == k).sum(), replace=False))
        cuts = np.sort(rng.integers(0, n + 1, 3))
        batches = [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["key", "fp"]) for a, b in zip(np.split(key, cuts), np.split(fp, cuts))]
        got = [tuple(r.values()) for b in op10._buckets(iter(batches)) for r in b.to_pylist()]
        want = [(k, f, fp[key == k][0]) for k, f in zip(key, fp) if (key == k).sum() > 1 or k in (key[0], key[-1])]
        assert got == want
