import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tractloom.llm import op4_bpe as op4, op5_packing as op5, op6_language as op6, op7_toxicity as op7, op9_quality as op9, op10_simhash as op10
from tractloom.llm.common import connected_components, fit_logistic

BITS = ["a", "b", "The", "don't", "'ll", " ", "  ", "\n", "\t", "\r\n", " ", "\x1c", "\x85", " \n ", "\n\n", "123", "é", "é", "́", "日本", "😀", "!!", "_", "İ", "Σ", "ß", "\x00",
        "<|endoftext|>", "<|startoftext|>", "<|endo"]
ODD = [None, "", " ", "\n \t", "x", "x " * 3000, "é" * 2000, "a b c", "A B C"]


def texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(BITS) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_bpe_equals_the_library():
    path = public_tokenizers.path(op4.VOCABULARY)
    library, own = Tokenizer.from_file(path), op4.Bpe(path)
    for t in [*texts(3000), "x " * 500, "é" * 500, "word" * 500]:
        e = library.encode(t, add_special_tokens=False)
        ids = np.frombuffer(own.encode(t), dtype="<i4").tolist()
        assert ids == e.ids, t
        assert own.decode(ids) == library.decode(e.ids, skip_special_tokens=False)
    assert own.decode([0, 255, 128]) == library.decode([0, 255, 128], skip_special_tokens=False)


def test_bpe_round_trip_of_a_table(spark, docs_of):
    path = public_tokenizers.path(op4.VOCABULARY)
    rows = list(enumerate([*ODD, *texts(50, 1)])) + [(1, ""), (None, "x")]
    out = op4.decode(op4.encode(docs_of(rows), path), path)
    assert out.columns == ["doc_id", "ids", "decoded"]
    assert sorted(((r["doc_id"], r["decoded"]) for r in out.collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert op4.encode(docs_of([(1, "a")]).where("false"), path).collect() == []


def test_word_ids_equal_the_library():
    path = public_tokenizers.path(op5.VOCABULARY)
    library, own = Tokenizer.from_file(path), op5.Words(path)
    for t in texts(3000, 2):
        assert np.frombuffer(own.encode(t), dtype="<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_first_fit_decreasing_equals_a_plain_scan():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 50, 257):
        sizes = rng.integers(1, 101, n)
        bins, offsets = op5.first_fit_decreasing(sizes, 100)
        free, want = [], {}
        for item in sorted(range(n), key=lambda i: -sizes[i]):
            b = next((k for k, room in enumerate(free) if room >= sizes[item]), len(free))
            if b == len(free):
                free.append(100)
            want[item] = (b, 100 - free[b])
            free[b] -= sizes[item]
        assert {i: (int(b), int(o)) for i, (b, o) in enumerate(zip(bins, offsets))} == want


def test_packing_places_every_id_once(spark, docs_of):
    path = public_tokenizers.path(op5.VOCABULARY)
    rows = list(enumerate([*ODD, *texts(60, 3)])) + [(4, "x"), (4, "x"), (None, "y")]
    got = [r.asDict() for r in op5.pack(docs_of(rows), path, length=64, group=10).collect()]
    library = Tokenizer.from_file(path)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [2]
        want += [(i, k, min(64, len(ids) - k), zlib.crc32(np.array(ids[k:k + 64], dtype="<u4").tobytes()), len(ids)) for k in range(0, len(ids), 64)]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"])) for r in got)
    sequences = {}
    for r in sorted(got, key=lambda r: r["offset"]):
        assert r["offset"] == sequences.get(r["sequence_id"], 0)
        sequences[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(sequences.values()) <= 64
    assert op5.pack(docs_of([(1, "a")]).where("false"), path).collect() == []


def test_language_of_held_out_texts(spark):
    rng = random.Random(5)
    syllables = {"aa": ["thi", "ing", "er", "on"], "bb": ["lich", "keit", "ver", "un"], "cc": ["ción", "mente", "ado", "que"]}
    say = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(40))
    rows = [(i, say(lang := "abc"[i % 3] * 2), lang, 0.0, "q") for i in range(150)]
    rows += [(900, None, "aa", 0.0, "q"), (901, "", "aa", 0.0, "q"), (902, "123 !!", "bb", 0.0, "q"), (903, say("bb") * 300, None, 0.0, "q"), (903, "x", None, 0.0, "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, lang_pred string")
    got = op6.identify(docs).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["doc_id"] < 900 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert len(held) > 20 and all(r["lang_pred"] == "abc"[r["doc_id"] % 3] * 2 and 0 <= r["score"] <= 1 for r in held)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (900, 901, 902)} == {"und"}
    assert any(r["lang_pred"] == "bb" for r in got if r["doc_id"] == 903)
    assert {r["lang_pred"] for r in op6.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert op6.identify(docs.where("false")).collect() == []


def test_dictionaries_reach_into_texts(spark):
    """All texts open with the same letterless lines, longer than a slice; those of ``cc`` have one word only, behind them."""
    rng = random.Random(7)
    head = "0123456789 -- ** 42\n" * 120
    syllables = {"aa": ["thi", "ing", "er", "on"], "bb": ["lich", "keit", "ver", "un"]}
    say = lambda lang: " ".join("".join(rng.choice(syllables[lang]) for _ in range(3)) for _ in range(400))
    rows = [(i, head + say(lang := "ab"[i % 2] * 2), lang) for i in range(80)] + [(100 + i, head * 3 + "ction", "cc") for i in range(8)] + [(200, head, "dd"), (2, say("aa"), "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = op6.dictionaries(docs)
    assert set(content) == {"aa", "bb", "cc"} and all(len(c) <= op6.TEXTS * (op6.SLICE + 1) for c in content.values())
    assert b"ction" in content["cc"] and content["aa"].count(head[:1000].encode()) < 10
    got = {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in op6.identify(docs).collect()}
    by = op6.compressors(content)
    want = {(i, *(lambda c: (c[0], c[2]))(op6.classify(t, by))) for i, t, _ in rows}
    assert got == want and all(p == "ab"[i % 2] * 2 for i, p, _ in got if i < 80) and (200, "und", True) in got



def test_grammar_scopes():
    lexicon = op7.Lexicon({"idiot": 1.0, "scu*": 0.5, "scum*": 0.5})
    kinds = lambda t: set(op7.matches(t, lexicon))
    assert kinds("What an idiot.") == {"insult"} and kinds("You idiot") == {"insult_aimed"} and kinds("not an idiot") == {"insult_negated"}
    assert kinds("She wrote: idiot") == {"insult_reported_aimed"} and kinds("He is not here. Idiot!") == {"insult"}
    assert kinds("I will kill you") == {"threat"} and kinds("you I will kill") == {"threat_aimed"}
    assert kinds("not one two three four idiot") == {"insult"} and kinds("scumbags") == {"insult"} and kinds(None) == kinds("") == set()
    w = op7.prior()
    aimed, negated = (w[op7.KINDS.index(k)] for k in ("insult_aimed", "insult_negated"))
    assert aimed > w[op7.KINDS.index("insult")] > negated


def test_composed_machine_equals_its_parts():
    parts = [op7._scope(n, k) for n, k in (("negation", 4), ("report", 12), ("target", 6))]
    rng = random.Random(2)
    state, states = 0, [0, 0, 0]
    for _ in range(3000):
        symbol = rng.choice(["other"] * 5 + ["insult", "threat", "target", "negation", "report", "end"])
        state, kind = op7._MACHINE[state][symbol]
        moved = [m(s, symbol) for m, s in zip(parts, states)]
        states = [s for s, _ in moved]
        assert (kind is not None) == (symbol in ("insult", "threat"))
        if kind:
            assert [n in kind for n in ("negated", "reported", "aimed")] == [o for _, o in moved]


def test_toxic_words_are_learned_and_held_out_texts_scored(spark):
    rng = random.Random(3)
    clean = ["la", "po", "ni", "se", "mu", "ra"]
    text = lambda bad: " ".join(rng.choice(clean) + rng.choice(clean) if rng.random() > bad / 4 else "zorgl" + rng.choice(clean) for _ in range(30))
    rows = [(i, text(i % 4 == 0), 1.0) for i in range(400)] + [(1000, None, 1.0), (1001, "", 1.0), (1002, text(1) * 300, 1.0), (1002, text(0), 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(400)] + [(5, 1, None), (None, 1, 1), (77_777, 0, 1)], "doc_id long, quality int, toxic int")
    got = op7.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["toxicity"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert sum((r["toxicity"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in held) >= 0.97 * len(held)
    out = op7.keep_civil(docs, labels)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} >= {1000, 1001}
    assert len(op7.score(docs, labels.where("false")).collect()) == len(rows) and op7.score(docs.where("false"), labels).collect() == []


def test_copies_of_one_toxic_text_teach_only_its_insults():
    held = [[0, 1]] * 20 + [[0, 2, 3]] * 20 + [[0, 1, 4]] * 3  # 0 and 1 recur; 2 and 3 are the words of one copied text
    assert op7.cover(held, 5)[:2] == [0, 1] and 4 not in op7.cover(held, 5)


def test_logistic_fit_and_prior():
    x = np.array([[0.0], [1.0]] * 200)
    w = fit_logistic(x, np.array([0.0, 1.0] * 200), np.array([0.0, 0.0]))
    assert w[0] > 3 and fit_logistic(np.zeros((0, 1)), np.zeros(0), np.array([2.0, -1.0])).tolist() == [2.0, -1.0]


def test_quality_of_held_out_texts(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["la", "po", "ni", "se"]) for _ in range(3))
    good = lambda: " ".join(word() for _ in range(60))
    bad = lambda: rng.choice([lambda: " ".join(word() + "%%%" for _ in range(60)), lambda: " ".join([word()] * 30 + [word()] * 30), lambda: " | ".join(word() for _ in range(60))])()
    rows = [(i, good() if i % 3 else bad(), 0.0) for i in range(500)] + [(1000, None, 0.0), (1001, "", 0.0), (1002, good() * 300, 0.0), (1002, "x", 0.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality_score double")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(500)] + [(7, None, 0)], "doc_id long, quality int, toxic int")
    got = op9.score(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["quality_score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] < 500 and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert sum((r["quality_score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in held) >= 0.95 * len(held)
    assert {r["quality_score"] for r in op9.score(docs, labels.where("false")).collect()} == {0.5}


def brute_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[k:k + 4]), 42) for k in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints):
    out = list(range(len(prints)))
    root = lambda k: k if out[k] == k else root(out[k])
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                a, b = sorted((root(i), root(j)))
                out[b] = a
    return [root(k) for k in range(len(prints))]


def test_masks_cover_every_pair_within_the_radius():
    masks, rng = op10.masks(4), random.Random(0)
    assert len(masks) == 31 and all(28 <= m.bit_count() <= 36 for m in masks)
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(diff & m == 0 for m in masks)


def test_fingerprints_equal_a_plain_count():
    for t in [*ODD, *texts(300, 6), "a b c d e", "Ä B c d", "w " * 70_000]:
        assert op10.simhash(t) % (1 << 64) == (brute_simhash(t) if len(t or "") < 9000 else op10.simhash("w w w w w") % (1 << 64)), t


@pytest.mark.parametrize("block", [2, 256])
def test_links_equal_all_pairs(spark, block):
    rng = random.Random(7)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints)[:12]:  # groups around one fingerprint, and chains
        prints |= {p ^ sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3, 4, 5]))) for _ in range(25)}
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    root = brute_components(prints)
    got = {r["fp"]: r["root"] for r in op10.link_fingerprints(spark.createDataFrame([(s,) for s in signed], "fp long"), block=block).collect()}
    want = {}
    for k, r in enumerate(root):
        want.setdefault(r, []).append(signed[k])
    assert got == {s: min(g) for g in want.values() if len(g) > 1 for s in g}


def test_near_duplicates_of_odd_rows(spark, docs_of):
    long = "one two three four five six seven eight nine ten " * 30
    rows = [(5, None), (3, ""), (9, " \n"), (7, "A b C"), (2, "a B c"), (8, "other words here now"), (8, "other words here now"), (None, "x y z w v"), (4, long), (1, long + "eleven")]
    docs = docs_of(rows)
    got = {(r["doc_id"], r["component_id"]) for r in op10.near_duplicates(docs).collect()}
    linked = (op10.simhash(long) ^ op10.simhash(long + "eleven")).bit_count() <= 4
    assert linked and got == {(5, 3), (3, 3), (9, 3), (7, 2), (2, 2), (8, 8), (None, None), (4, 1), (1, 1)}
    kept = op10.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(3, ""), (2, "a B c"), (8, "other words here now"), (None, "x y z w v"), (1, long + "eleven")], key=str)
    assert op10.near_duplicates(docs.where("false")).collect() == []


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(200, 260)] + [(300, 301), (301, 302), (302, 300), (5, 5), (301, 300)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 7: 7, **{k: 7 for k in range(200, 260)}, 300: 300, 301: 300, 302: 300}


def test_scores_of_a_margin():
    by = op6.compressors({"aa": b"thing other nothing " * 50, "bb": b"keit lich ung " * 50})
    lang, score, rejected = op6.classify("thing other nothing", by)
    assert lang == "aa" and 0.5 < score <= 1 and not rejected and math.isclose(op6.classify("zz", by)[1], 0.5, abs_tol=0.5)
