"""Periodic runs against a brute-force search over all periods."""

import hashlib
import random
import zlib

import numpy as np

from tractloom.llm import op11_runs as op11


def brute(words, shortest=6, periods=4):
    """Every maximal stretch of every period, kept where no proper divisor is a period too."""
    n, out = len(words), []
    for q in range(1, n // periods + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            smaller = any(all(words[x] == words[x + d] for x in range(i, i + length - d)) for d in range(1, q))
            if length >= max(shortest, periods * q) and not smaller:
                out.append((i, length, q))
            i = j
    return sorted(out, key=lambda r: (r[0], r[2]))


def numbers(words):
    seen = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)


def test_runs_equal_brute_force():
    draw = random.Random(7)
    fib = ["a", "a b"]
    while len(fib[-1].split()) < 90:
        fib.append(fib[-1] + " " + fib[-2])
    cases = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 400, "a b a b a b a".split(), fib[-1].split() * 5, ("x " + fib[5] + " y").split() * 4]
    for _ in range(300):
        words = [draw.choice("abc"[:draw.randint(1, 3)]) for _ in range(draw.randint(0, 60))]
        q, times, cut = draw.randint(1, 25), draw.randint(3, 6), draw.randint(0, 20)
        unit = [draw.choice("abcdefgh"[:draw.randint(1, 8)]) for _ in range(q)]
        cases.append(words + unit * times + unit[:cut] + words[:draw.randint(0, 20)] + unit * draw.randint(0, 5))
    for words in cases:
        assert op11.runs(numbers(words)) == brute(words), words


def test_other_limits_and_classes():
    draw = random.Random(3)
    for shortest, periods in ((6, 4), (2, 2), (10, 3), (30, 2)):
        for k, least, greatest in op11.classes(500, shortest, periods):
            assert all(max(shortest - q, (periods - 1) * q) >= k >= q for q in range(least, greatest + 1))
        for _ in range(60):
            unit = [draw.choice("abc") for _ in range(draw.randint(1, 9))]
            words = [draw.choice("ab") for _ in range(9)] + unit * draw.randint(2, 9)
            assert op11.runs(numbers(words), shortest, periods) == brute(words, shortest, periods)


def test_edge_rows(spark, docs_of):
    long_text = "q w e r t y u i o p " * 30_000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a a a a a a b"), (None, "a\x1fa x x x x x x"), (5, long_text), (5, long_text), (6, "ä ä ä ä ä ä")]
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in op11.periodic_runs(docs_of(rows)).collect()]
    assert len(got) == len(rows)
    by = {g[0]: g for g in got}
    assert by[1][1:] == (0, [], "") == by[2][1:] == by[3][1:]
    assert by[4][1:] == (7, [(0, 6, 1)], "a b") and by[None][1:] == (7, [(1, 6, 1)], "a\x1fa x")
    assert by[5][1:] == (300_000, [(0, 300_000, 10)], "q w e r t y u i o p") and by[6][3] == "ä"
    assert op11.periodic_runs(docs_of([])).count() == 0


def test_query_equals_brute_force(spark, sf_dir):
    from fractions import Fraction

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() if r.text is None or len(r.text) < 4000}
    changed = 0
    for r in op11.op11_runs(spark, sf_dir).collect():
        if r.doc_id not in docs:
            continue
        words = [w.decode() for w in (docs[r.doc_id] or "").encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g, changed = h // 10, changed + 1
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        of = op11.runs(numbers(words)) if n > 500 else brute(words)
        stay = [w for i, w in enumerate(words) if not any(s + q <= i < s + m for s, m, q in of)]
        s, m, q = min(of, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2])) if of else (None,) * 3
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(of), s, m, q, of and 1000 * m // q or None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{x},{y},{z}\n" for x, y, z in of).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(stay).encode()).hexdigest()
    assert changed > 3
