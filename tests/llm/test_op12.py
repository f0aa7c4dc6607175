"""Ranked search against scores of all pairs and against SQL."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np

from tractloom.llm import op12_ranking as op12

RULE = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return RULE.findall(text.translate(LOWER)) if text else []


def brute(docs, items, top):
    held = [(i, Counter(split(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked, out = {}, []
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    for item, own in asked.items():
        scored = []
        for doc, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def got(frame):
    return sorted([tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()], key=lambda x: (x[0] is not None, x[0] or 0, x[1]))


def test_equals_all_pairs(spark, docs_of, monkeypatch):
    draw = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Über", "naïve", "x-y", "A1"]
    often = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(draw.choices(words, often, k=draw.randint(0, 40)))) for i in range(300)]
    docs += [(900, None), (901, "--- !"), (None, "w1 w2 w3"), (902, "w5 w5 w50"), (902, "w5 w5 w50"), (903, "w7 " * 20_000)]
    items = [(i, " ".join(draw.choices(words, k=draw.randint(1, 12)))) for i in range(12)] + [(50, None), (51, "zzz"), (3, "w9"), (3, "w9"), (None, "w1 w50")]
    table = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id long, text string, score double")
    for block, chars in ((16, 60), (4096, 10_000)):
        monkeypatch.setattr(op12, "BLOCK_DOCS", block)
        monkeypatch.setattr(op12, "SHORT", 1 / 4)
        for top in (5,) if block == 16 else (1000,):
            assert got(op12.ranked_search(docs_of(docs).repartition(3), table, top, chars)) == brute(docs, items, top)
    assert got(op12.ranked_search(docs_of([]), table)) == [] == got(op12.ranked_search(docs_of(docs), table.limit(0)))
    assert got(op12.ranked_search(docs_of([(1, None), (2, "")]), table)) == []


def test_block_search_keeps_all_that_reach_the_score():
    draw = np.random.default_rng(1)
    for _ in range(200):
        n, lists, full = int(draw.integers(5, 200)), [], None
        full = np.zeros(n, dtype=np.int64)
        for _ in range(int(draw.integers(1, 8))):
            docs = np.flatnonzero(draw.random(n) < draw.random() ** 2)
            if len(docs):
                add = draw.integers(1, 1000, len(docs))
                full[docs] += add
                lists.append((docs, add, int(add.max())))
        if lists:
            least = int(draw.integers(1, full.max() + 2))
            docs, score = op12.best(lists, n, least)
            want = np.flatnonzero(full >= least)
            assert docs.tolist() == want.tolist() and score.tolist() == full[want].tolist()


def test_block_search_of_short_lists(monkeypatch):
    one = [(np.array([i]), np.array([5]), 5) for i in (1, 2)]  # bounds of 10, but no document above 5
    assert [x.tolist() for x in op12.best(one, 100, 6)] == [[], []]
    assert [x.tolist() for x in op12.best(one, 100, 5)] == [[1, 2], [5, 5]]
    idle = [(np.array([1]), np.array([0]), 0), (np.arange(50), np.full(50, 3), 3)]  # the short list adds nothing
    assert [x.tolist() for x in op12.best(idle, 100, 2)] == [list(range(50)), [3] * 50]
    assert [x.tolist() for x in op12.best(idle[:1], 100, 1)] == [[], []]
    monkeypatch.setattr(op12, "SHORT", 1 / 4)
    draw = np.random.default_rng(2)
    for _ in range(500):
        n, lists = int(draw.integers(20, 100)), []
        full = np.zeros(n, dtype=np.int64)
        for _ in range(int(draw.integers(1, 8))):
            docs = np.flatnonzero(draw.random(n) < draw.random() ** 3)
            if len(docs):
                add = draw.integers(0, draw.choice([1, 10, 1000]), len(docs))
                full[docs] += add
                lists.append((docs, add, int(add.max())))
        least = int(draw.integers(1, 2 * full.max() + 2))
        want = np.flatnonzero(full >= least)
        docs, score = op12.best(lists, n, least)
        assert docs.tolist() == want.tolist() and score.tolist() == full[want].tolist()


def test_blocks_without_a_document_of_the_best_scores(spark, docs_of, monkeypatch):
    monkeypatch.setattr(op12, "BLOCK_DOCS", 64)
    docs = [(i, "a b c") for i in range(10)] + [(i, "filler") for i in range(10, 64)]
    docs += [(64, "a"), (65, "b"), (66, "c")] + [(i, "filler") for i in range(67, 128)]  # their bounds reach the tenth score, no document does
    items = [(1, "a b c")]
    table = spark.createDataFrame(items, "item_id long, text string")
    assert got(op12.ranked_search(docs_of(docs).coalesce(1), table, 10)) == brute(docs, items, 10)


def test_query_equals_sql(spark, sf_dir):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{Path(sf_dir) / t}.parquet'")
    want = sorted(con.execute(op12.SQL).fetchall())
    assert want and got(op12.op12_ranking(spark, sf_dir)) == want
