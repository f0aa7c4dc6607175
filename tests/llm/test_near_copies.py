import random

import corpus_pipeline
import numpy as np
from tractloom.llm import near_copies as nc, op10_simhash as op10


def brute(texts):
    """Smallest id of each text's group, by Jaccard similarity of all pairs; also the similarity of each linked pair."""
    sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} if (w := t.lower().split()) else set() for i, t in texts.items()}
    group, linked = {i: i for i in sets}, {}
    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if a < b and (sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                linked[a, b] = both / max(1, len(sets[a] | sets[b]))
                low, high = sorted((group[a], group[b]))
                group = {i: low if g == high else g for i, g in group.items()}
    return group, linked


def edited(rng, words, share):
    return [f"new{rng.randrange(10 ** 9)}" if rng.random() < share else w for w in words]


def corpus():
    rng = random.Random(7)
    passage = [f"licence{i}" for i in range(40)]
    texts, n = {}, 0
    for base in range(30):
        words = [f"w{rng.randrange(4000)}" for _ in range(rng.randrange(60, 400))]
        for share in (0, 0, 0.01, 0.015, 0.02, 0.025, 0.03, 0.06):
            texts[n] = " ".join(edited(rng, words, share) + (passage if base % 2 else []))
            n += 1
    return {**texts, n: "", n + 1: " ", n + 2: "one two", n + 3: "ONE two", n + 4: "one two three four five"}


def test_pipeline_stage_equals_brute_force(spark, docs_of):
    texts = corpus()
    group, linked = brute(texts)
    far = sum((op10.simhash(texts[a]) ^ op10.simhash(texts[b])).bit_count() > op10.RADIUS for a, b in linked)
    assert far > 20
    docs = docs_of(list(texts.items()))
    out = corpus_pipeline.near_duplicates(spark, docs, "")
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == sorted(set(group.values()))
    got = {r["doc_id"]: r["component_id"] for r in nc.near_copies(docs, block=3).collect()}
    assert got == group


def test_heads_of_similar_sets_meet_and_agree():
    rng = np.random.default_rng(0)
    near = 0
    for _ in range(2000):
        n = int(rng.integers(1, 600))
        x = rng.integers(-(1 << 62), 1 << 62, n)
        lost = int(rng.integers(0, n // 9 + 1))
        y = np.concatenate([x[lost:], rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, n // 9 + 1)))])
        x, y = np.unique(x), np.unique(y)
        both = np.array([len(np.intersect1d(x, y))])
        sizes = np.array([len(x)]), np.array([len(y)])
        if nc.similar(both, *sizes)[0]:
            near += 1
            assert len(np.intersect1d(x[:nc.KEYS], y[:nc.KEYS]))
            assert nc.judge_heads(np.array([len(np.intersect1d(x[:nc.HEAD], y[:nc.HEAD]))]), *sizes)[0]
    assert near > 500


def test_shared_counts(monkeypatch):
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, rng.integers(0, 40))) for _ in range(30)]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    i, j = rng.integers(0, 30, 500), rng.integers(0, 30, 500)
    for step in (1, 100, 1 << 20):
        monkeypatch.setattr(nc, "STEP", step)
        matrix = nc.overlaps(np.concatenate(sets), ends, np.arange(30), np.arange(10, 30))
        below = nc.overlaps(np.concatenate(sets), ends, np.arange(30), np.arange(10, 30), 17)
        for a in range(30):
            for b in range(10, 30):
                both = np.intersect1d(sets[a], sets[b])
                assert matrix[a, b - 10] == len(both) and below[a, b - 10] == (both < 17).sum()
        assert nc.shared(np.concatenate(sets), ends, i, j).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(i, j)]


def test_long_texts(spark, docs_of):
    rng = random.Random(3)
    words = [f"w{rng.randrange(10 ** 6)}" for _ in range(120_000)]
    far = [f"v{rng.randrange(10 ** 6)}" for _ in range(60_000)] + words[:60_000]
    docs = docs_of([(1, " ".join(words)), (2, " ".join(edited(rng, words, 0.01))), (3, " ".join(far)), (4, "\n".join(words).upper())])
    assert {r["doc_id"]: r["component_id"] for r in nc.near_copies(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 1}


def test_odd_rows(spark, docs_of):
    docs = docs_of([(1, None), (2, ""), (None, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (6, "x")])
    assert sorted(r["doc_id"] for r in nc.keep_one(docs).collect()) == [1, 5, 6]
    assert nc.keep_one(docs.where("false")).collect() == []


def test_similar_sets_share_a_key():
    rng = np.random.default_rng(5)
    near = 0
    for _ in range(4000):
        n = int(rng.choice([2, 4, 5, 9, 20, 63, 64, 65, 90, 300]))
        x = rng.integers(-(1 << 62), 1 << 62, n)
        y = np.concatenate([x[int(rng.integers(0, n // 8 + 1)):], rng.integers(-(1 << 62), 1 << 62, int(rng.integers(0, n // 8 + 2)))])
        x, y = np.unique(x), np.unique(y)
        if nc.similar(np.array([len(np.intersect1d(x, y))]), np.array([len(x)]), np.array([len(y)]))[0] and len(x) + len(y) > 2:
            near += 1
            assert len(np.intersect1d(nc.neighbours(x[:nc.KEYS]), nc.neighbours(y[:nc.KEYS])))
    assert near > 1000 and len(nc.neighbours(x[:1])) == 0


def test_forest_has_the_components():
    rng = np.random.default_rng(6)
    for links in (0, 5, 30, 200):
        i, j = rng.integers(0, 60, links), rng.integers(0, 60, links)
        least = list(range(60))
        for _ in range(60):
            for a, b in zip(i, j):
                least[a] = least[b] = min(least[a], least[b])
        assert nc.forest(i, j, 60).tolist() == least


def test_counts_of_few_and_of_many():
    rng = np.random.default_rng(8)
    common = np.arange(40)
    sets = [np.unique(np.concatenate([common[rng.random(40) < 0.8], rng.integers(100, 3000, 60)])) for _ in range(150)]
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)
    x, y = np.arange(100), np.arange(50, 150)
    got = nc.overlaps(np.concatenate(sets), ends, x, y)
    assert got.tolist() == [[len(np.intersect1d(sets[a], sets[b])) for b in y] for a in x]


def test_rows_follow_texts_not_pairs(spark, docs_of, monkeypatch):
    """Many texts of one group that are nearly similar enough, where all pairs of heads agree, and a group that is."""
    rng = random.Random(11)
    texts = {}
    for share, first in ((0.055, 0), (0.01, 400)):
        words = [f"w{rng.randrange(4000)}" for _ in range(150)]
        texts |= {first + i: " ".join(edited(rng, words, share)) for i in range(400)}
    rows = {}

    def counted(df, name=None):
        out = staged(df, name)
        rows[name] = out.count()
        return out

    staged = nc.materialize
    monkeypatch.setattr(nc, "materialize", counted)
    found = nc.near_copies(docs_of(list(texts.items())), block=64)
    assert {r["doc_id"]: r["component_id"] for r in found.collect()} == brute(texts)[0]
    assert max(rows.values()) <= nc.HEAD * len(texts), rows


def test_covering_tables_link_close_fingerprints(spark, docs_of, monkeypatch):
    rng = np.random.default_rng(9)
    prints = [int(p) for p in rng.integers(-(1 << 62), 1 << 62, 40)]
    rows = [(i, p) for i, p in enumerate(prints)] + [(100 + i, p ^ 0b1111 << i) for i, p in enumerate(prints[:20])] + [(200 + i, p ^ 0b11111 << i) for i, p in enumerate(prints[20:])] + [(300, prints[0])]
    got = {(r["a"], r["b"]) for r in nc._print_links(spark.createDataFrame(rows, "sid long, fp long")).collect()}
    assert got == {(i, 100 + i) for i in range(20)} | {(0, 300)}
    hashes = np.unique(rng.integers(-(1 << 62), 1 << 62, 999))
    ones = sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in hashes) > 999)
    assert nc.fingerprint(hashes, chunk=100) % (1 << 64) == ones and nc.fingerprint(hashes[:0]) == 0
    # links of fingerprints alone bring sets to a family: no bucket may be needed for them
    monkeypatch.setattr(nc, "_keys", _no_keys)
    words = [f"w{i}" for i in range(3000)]
    docs = docs_of([(1, " ".join(words)), (2, " ".join([*words, "one", "more"])), (3, "quite another text of seven words")])
    assert {r["doc_id"]: r["component_id"] for r in nc.near_copies(docs).collect()} == {1: 1, 2: 1, 3: 3}


def _no_keys(batches):
    for batch in batches:
        none = batch.column("sid").slice(0, 0)
        yield nc.pa.RecordBatch.from_arrays([none, none], ["key", "fp"])
