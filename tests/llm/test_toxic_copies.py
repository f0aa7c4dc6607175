import random
import zlib

from tractloom.llm import op7_toxicity as op7


def plain_cover(held, n):
    """The same choice with a plain search for the largest."""
    left, taken = [op7.EXPLAIN] * len(held), []
    while True:
        need = [sum(c in h and left[t] > 0 for t, h in enumerate(held)) * (c not in taken) for c in range(n)]
        best = max(range(n), key=need.__getitem__)
        if need[best] < op7.SUPPORT:
            return taken
        taken.append(best)
        left = [k - (best in h) for k, h in zip(left, held)]


def test_cover_equals_a_plain_search():
    rng = random.Random(5)
    for _ in range(40):
        held = [sorted(rng.sample(range(12), rng.randrange(6))) for _ in range(40)]
        assert op7.cover(held, 12) == plain_cover(held, 12)


def test_copies_of_a_long_text_leave_rarer_insults_in_the_lexicon(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(n))
    long_text = " ".join(word(10) for _ in range(1100)) + " zorglak"
    clean = [word(5) for _ in range(50)]
    plain = lambda: " ".join(rng.choice(clean) for _ in range(20))
    rows = [(i, long_text, 1) for i in range(200)] + [(1000 + i, f"{plain()} {('vrumpel', 'quaxilo')[i % 2]}", 1) for i in range(60)] + [(2000 + i, plain(), 0) for i in range(150)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r["doc_id"]: r["toxicity"] for r in op7.score(docs, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % op7.DIVISOR == op7.HELD_OUT]
    rare = [i for i in held if 1000 <= i < 2000]
    assert len(rare) > 5 and all(got[i] >= op7.THRESHOLD for i in rare)
    assert all(got[i] < op7.THRESHOLD for i in held if i >= 2000)
