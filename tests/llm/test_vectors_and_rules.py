import math
import random
import re

import numpy as np
import pytest
from tests.oracle import compare, duck

from tractloom.llm import catalog, op1_embedding as op1, op2_quality_rules as op2, op3_url_filters as op3


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(catalog.QUERIES[name](spark, sf_dir), duck(sf_dir), catalog.ORACLE[name]) is None


def test_bound_never_hides_a_link():
    rng = np.random.default_rng(0)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base + rng.normal(size=base.shape) * 0.14, base * [[3.0]]])
    i, j = op1.links(x, x, 0.98)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(zip(i.tolist(), j.tolist())) == set(zip(*(a.tolist() for a in np.nonzero(np.einsum("id,jd->ij", u, u) >= 0.98))))


def test_very_large_and_very_small_vectors_link(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=8)
    rows = [(k, (base * f).tolist(), 1) for k, f in enumerate((1.0, 1e200, 1e-200, 1.5e308 / np.abs(base).max(), 5e-310, -1e200))] + [(6, [1e-200, *[0.0] * 7], 1), (7, [1e200, *[1.0] * 7], 1)]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in op1.near_duplicates(v, block=3).collect()}
    assert got == {**{k: (4, 0) for k in range(5)}, 5: (0, 5), 6: (1, 6), 7: (1, 6)}
    plain = rng.normal(size=(50, 33)).astype(np.float32).astype(float)
    assert (op1.units(plain) == plain / np.linalg.norm(plain, axis=1, keepdims=True)).all()


def test_vectors_of_every_odd_kind(spark):
    nan, inf = float("nan"), float("inf")
    one = [1.0, 0.0]
    rows = [(1, one, 5), (2, [2.0, 0.0], 5), (3, [1.0, 0.01], 5), (4, one, 6), (5, one, None), (6, None, 5), (7, [0.0, 0.0], 5),
            (8, [nan, 1.0], 5), (9, [inf, 1.0], 5), (10, [None, 1.0], 5), (11, [], 5), (12, [1.0, 0.0, 0.0], 5), (1, one, 5), (None, one, 5)]
    v = spark.createDataFrame([(*r, 0, 1) for r in rows], "vec_id long, embedding array<float>, label int, n_links int, block int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in op1.near_duplicates(v, block=2).collect()}
    want = {i: (0, i, True) for i in range(4, 13)} | {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), None: (0, None, True)}
    assert got == want
    assert op1.near_duplicates(v.where("false")).collect() == []


def test_blocks_do_not_change_the_result(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    a, b = (sorted(map(tuple, op1.near_duplicates(v, block=n).collect())) for n in (7, 10_000))
    assert a == b


def brute_counts(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    marked = {i + k for i, s in enumerate(seen) if seen.count(s) > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(marked)


def test_counts_of_odd_texts(docs_of):
    rng = random.Random(1)
    texts = [None, "", " \t\n\x0b\f\r ", "a", "a b", "a b c", "a b c a b c", "a a a a", "x\ny\nx\n\n x\nx", "é#*$%&|<>\u00a0z", "  lead trail  \n",
             *["".join(rng.choice(["a", "b", " ", "\n", "#", "\t"]) for _ in range(60)) for _ in range(40)], "w " * 5000]
    docs = docs_of(list(enumerate(texts)) + [(0, "a"), (None, "a b")])
    got = op2.judge(docs).orderBy("doc_id").collect()
    assert len(got) == len(texts) + 2
    by = {r["doc_id"]: r for r in got if r["doc_id"]}
    for i, t in enumerate(texts):
        if i:
            r = by[i]
            assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_counts(t), t
            assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
    assert op2.judge(docs.where("false")).collect() == []


def test_keep_good_keeps_rows_as_they_are(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in op2.judge(docs).where("kept").collect()}
    out = op2.keep_good(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in docs.collect() if r["doc_id"] in kept)


def test_table_rows_become_conditions(spark):
    rules = (op2.Rule("r", "a", "b", 50, 200),)
    d = spark.createDataFrame([(1, 2), (0, 2), (5, 2)], "a long, b long").withColumn("ok", op2.verdict(rules))
    assert [r["ok"] for r in d.collect()] == [True, False, False]


def test_url_parts_and_rules(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "HTTP://A.COM"), (5, "http://WWW.Example.com/en/x?q=/a"), (6, "x://example.com/en/"), (7, "x://a.example.com/en"),
            (8, "x://notexample.com/en/1"), (9, "x://net/es/"), (10, "x://a.b.net/fr/1#f"), (11, "x://a.org/fr/"), (12, "x://É.com/#://b"), (None, "x://q.net/es/" + "a" * 50_000), (9, "x://net/es/")]
    pages = spark.createDataFrame([(i, u, "k", 1.0) for i, u in rows], "page_id long, url string, rule string, label double")
    got = op3.judge(pages).orderBy("page_id").collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: (r["host"], r["path"], r["rule"]) for r in got}
    assert [by[k] for k in (1, 2, 3, 4)] == [("", "", None)] * 3 + [("a.com", "", None)]
    assert by[5] == ("www.example.com", "/en/x", "www.example.com/en/") and by[6] == ("example.com", "/en/", "example.com/en/")
    assert by[7][2] == "com/" and by[8][2] == "com/" and by[9][2] == "net/es/" and by[10] == ("a.b.net", "/fr/1", "net/fr/") and by[11][2] is None
    assert by[12] == ("É.com", "/", "com/")
    named = {"com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow", "net/es/": "block", "net/fr/": "block"}
    assert all(r["verdict"] == named[r["rule"]] for r in got if r["rule"]) and all(r["verdict"] in ("allow", "block") for r in got)
    assert op3.judge(pages.where("false")).collect() == []
    assert {r["verdict"] for r in op3.judge(pages.where("page_id in (4, 8, 11)")).collect()} == {"allow"}


def test_trees_learn_from_the_rules(spark):
    rows = [(i, f"x://h{i}.{'com' if i % 2 else 'net/es'}/p{i}?{'a=1&' * (0 if i % 2 else 6)}") for i in range(200)]
    more = [(900, "x://new.org/p?" + "a=1&" * 6), (901, "x://new.org/p")]
    got = {r["page_id"]: r["verdict"] for r in op3.judge(spark.createDataFrame(rows + more, "page_id long, url string")).where("page_id >= 900").collect()}
    assert got == {900: "block", 901: "allow"}


def test_suffix_statistics_cover_all_urls(spark):
    """Against plain loops: every url counts, and a training row never sees the labels of its fold."""
    hosts = ["a.com", "b.a.com", "example.com", "www.example.com", "x.net", "y.x.net", "z.org", ""]
    rows = [(i, f"x://{hosts[i % 8]}/{'en' if i % 3 else 'es'}/{i}") for i in range(160)] + [(None, "x://a.com/"), (3, "x://a.com/en/")]
    d = op3.describe(spark.createDataFrame(rows, "page_id long, url string"), op3.RULES)
    all_rows = d.collect()
    counts = {s: op3.suffix_counts(d, s) for s in ("tld", "site")}
    for training in (False, True):
        got = op3.with_suffixes(d.where("given is not null"), counts, 0.25, training).collect()
        assert len(got) == sum(r["given"] is not None for r in all_rows)
        for r in got:
            for s in ("tld", "site"):
                same = [o for o in all_rows if o[s] == r[s]]
                seen = [o["given"] for o in same if o["given"] and not (training and o["fold"] == r["fold"])]
                assert r[f"{s}_log_count"] == pytest.approx(math.log1p(len(same)))
                assert r[f"{s}_block_rate"] == pytest.approx((seen.count("block") + op3.SMOOTH * 0.25) / (len(seen) + op3.SMOOTH))


def test_url_query_follows_its_rules(spark, sf_dir):
    """Host, path, rule and a rule's verdict of every page, against plain string handling."""
    rules = {("com", "/"): "allow", ("example.com", "/en/"): "block", ("www.example.com", "/en/"): "allow", ("net", "/es/"): "block", ("net", "/fr/"): "block"}
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    got = op3.op3_url_filters(spark, sf_dir).collect()
    assert len(got) == len(urls)
    for r in got:
        rest = (urls[r["page_id"]] or "").partition("://")[2]
        host, path = re.match(r"([^/?#]*)([^?#]*)", rest, re.S).groups()
        host = re.sub("[A-Z]", lambda c: c[0].lower(), host)
        path = path if rest[len(host):len(host) + 1] == "/" else ""
        fits = [(h, p) for h, p in rules if ("." + host).endswith("." + h) and path.startswith(p)]
        best = max(fits, key=lambda f: len(f[0] + f[1]), default=None)
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0] + best[1])
        assert r["verdict"] == rules[best] if best else r["verdict"] in ("allow", "block")


def test_entropy(spark):
    from pyspark.sql import functions as F
    d = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("abcd",)], "t string")
    assert [round(r[0], 9) for r in d.select(op3.entropy(F.col("t"))).collect()] == [0, 0, 1, 2]
