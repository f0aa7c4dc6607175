"""Removal of repeated passages against all windows of all texts."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tractloom.llm import op13_substrings as op13


def brute(rows, window=35):
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[j:j + window]) for _, w in texts for j in range(len(w) - window + 1))
    out = []
    for i, w in texts:
        gone = set()
        for j in range(len(w) - window + 1):
            if seen[tuple(w[j:j + window])] > 1:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), b" ".join(x for n, x in enumerate(w) if n not in gone).decode()))
    return sorted(out, key=str)


def got(frame):
    return sorted([tuple(r) for r in frame.collect()], key=str)


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(11)
    word = lambda: "".join(draw.choices("abcdefg", k=3))
    text = lambda n: [word() for _ in range(n)]
    shared = [text(n) for n in (34, 35, 36, 60, 150)]
    docs = []
    for i in range(80):
        own = text(draw.randint(0, 60))
        for s in draw.sample(shared, draw.randint(0, 3)):
            cut = draw.randint(0, 5)
            own += s[cut:] + text(draw.randint(0, 20))
        docs.append((i, " ".join(own)))
    near = text(200)
    for i in range(100, 120):
        docs.append((i, " ".join(w if draw.random() > 0.02 else word() for w in near)))
    within = text(40)
    docs += [(200, " ".join(within + text(9) + within)), (201, "a " * 300), (202, "b c " * 40), (203, " ".join(text(34))), (204, None), (205, ""), (206, " \n"),
             (207, docs[3][1]), (207, docs[3][1]), (None, docs[5][1]), (None, None), (208, "\t".join(shared[4]) + "\x1f"), (209, " ".join(text(20_000)))]
    return docs


@pytest.mark.parametrize("often", [op13.OFTEN, 3])
def test_equals_all_windows(spark, docs_of, rows, often):
    assert got(op13.remove_repeated(docs_of(rows).repartition(3), often)) == brute(rows)


def test_long_texts_and_batches_are_cut_without_loss(spark, docs_of, rows, monkeypatch):
    for words in (np.arange(5000, dtype=np.uint64), np.array([3, 3, 3, 1] * 100, dtype=np.uint64)):
        whole = [np.concatenate(x) for x in zip(*[(np.repeat(a, n), f[0] + np.arange(n.sum()), w) for a, f, n, _, w in op13.segments(words)])]
        monkeypatch.setattr(op13, "SLICE", 97)
        parts = [np.concatenate(x) for x in zip(*[(np.repeat(a, n), f[0] + np.arange(n.sum()), w) for a, f, n, _, w in op13.segments(words)])]
        monkeypatch.undo()
        assert all((a == b).all() for a, b in zip(whole, parts))
    assert (op13._word_hashes("ab cd " * 1_000_000) == np.tile(op13._word_hashes("ab cd"), 1_000_000)).all()


def test_factors_are_greedy():
    windows = np.array([1, 2, 3, 9, 1, 2, 7, 3, 5, 5])
    segment, offset, length = op13.factors(np.array([0, 0, 1]), np.array([4, 4, 2]), windows)
    assert list(zip(segment.tolist(), offset.tolist(), length.tolist())) == [(0, 0, 2), (0, 2, 1), (1, 0, 2), (1, 3, 1), (2, 0, 1), (2, 1, 1)]


def test_empty_table(docs_of):
    assert got(op13.remove_repeated(docs_of([]))) == []


def test_query_equals_all_windows(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted([(i, n, m, hashlib.sha256(t.encode()).hexdigest()) for i, n, m, t in brute(docs)], key=str)
    assert sum(m for _, _, m, _ in want) and got(op13.op13_substrings(spark, sf_dir)) == want
