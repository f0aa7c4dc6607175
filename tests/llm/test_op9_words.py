"""Word vectors of the quality classifier against loops over words."""

from collections import Counter

import numpy as np
import pytest

from tractloom.llm import op9_quality as op9

TEXTS = ["the cat sat on the mat", "the the the cat", "one", "two", "three", None, "", "!!! ???", "a " * 50 + "cat sat, 12 12 mats.", "mat on mat on mat", "w" * 500 + " cat " + "w" * 500,
         " ".join(f"rare{chr(97 + k % 26) * (k // 26 + 1)} cat" for k in range(60))]


def _rows_by_hand(text, words):
    """Row of each token: its place among the frequent words or its class; a row equal to the one before it is the repeat row."""
    place = {int(h): r for r, h in enumerate(words.frequent)}
    out = []
    for t in op9._TOKEN.findall(text or ""):
        h = op9.word_hash(t)
        out.append(place[h] if h in place else len(place) + h % (op9.CLASSES - 1))
    return [words.repeat if i and out[i] == out[i - 1] else r for i, r in enumerate(out)]


@pytest.mark.parametrize("most", [0, 3, 1000])
def test_sums_and_vocabulary_equal_loops(spark, docs_of, most):
    docs = docs_of(list(enumerate(TEXTS + TEXTS[:3]))).repartition(3)
    words = op9.vocabulary(docs, most)
    count = Counter(op9.word_hash(t) for text in TEXTS + TEXTS[:3] for t in op9._TOKEN.findall(text or ""))
    level = {h: int(np.floor(np.log2(n) * 16)) for h, n in count.items()}
    fits = [lv for lv in set(level.values()) if sum(x >= lv for x in level.values()) <= most]
    assert set(words.frequent.tolist()) == ({h for h in level if level[h] >= min(fits)} if fits else set())
    assert len(words.frequent) <= most and (most < 1000 or len(words.frequent) == len(count))
    place, sign = op9.index_vectors(words.rows)
    want = np.zeros((words.rows, op9.DIM), dtype=np.int64)
    for text in TEXTS + TEXTS[:3]:
        rows = _rows_by_hand(text, words)
        for i, a in enumerate(rows):
            for j in range(max(0, i - op9.WINDOW), min(len(rows), i + op9.WINDOW + 1)):
                if i != j:
                    for e in range(op9.NONZERO):
                        want[a, place[rows[j], e]] += int(sign[rows[j], e])
    assert (op9.context_sums(docs, words) == want).all()


def test_one_word_texts_have_no_neighbours(spark, docs_of):
    docs = docs_of([(i, t) for i, t in enumerate(["one", "two", "three"])]).coalesce(1)
    assert not op9.context_sums(docs, op9.vocabulary(docs)).any()


def test_every_frequent_word_has_its_own_row_and_long_tokens_are_not_kept(spark, docs_of):
    names = [f"w{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}" for i in range(9000)]
    docs = docs_of([(i, " ".join(names[i::9])) for i in range(9)])
    words = op9.vocabulary(docs)
    look = words.lookup()
    assert len({look[n] for n in names}) == len(names) and len(words.frequent) == len(names)
    look["x" * 500]
    assert "x" * 500 not in look and op9.vocabulary(docs.limit(0)).rows == op9.CLASSES


def test_pool_equals_loops(spark, docs_of):
    docs = docs_of(list(enumerate(TEXTS)))
    words = op9.vocabulary(docs, 3)
    vectors, look = op9.word_vectors(docs, words), words.lookup()
    for text in TEXTS:
        rows = _rows_by_hand(text, words)
        if not rows:
            assert not op9.pool(text, vectors, look).any()
            continue
        want = np.concatenate([np.mean([vectors[r] for r in rows], axis=0), np.mean([vectors[r] for r in sorted(set(rows))], axis=0), [np.log(1 + len(rows))]])
        assert np.allclose(op9.pool(text, vectors, look), want, atol=1e-5)
