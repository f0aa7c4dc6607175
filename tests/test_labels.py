"""Labels of long texts: equal to a plain rewriting of the whole text, of which only what a label depends on is rewritten."""

import random
import re

from pyspark.sql import functions as F

from tractloom.functions.naming import sanitize_label


def plain(raw, max_len):
    s = re.sub("-{2,}", "-", re.sub("[^A-Za-z0-9]", "-", raw)).strip("-")
    s = "x" if s == "" else s if re.match("[A-Za-z]", s) else "x" + s
    return s[:max_len]


def test_labels_equal_a_rewriting_of_the_whole_text(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab7-_ \n\té\U0001f600Z") for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += ["", "-", "a" * 19 + "-" + "b", "a" * 20 + "--", "1" * 25, " é" * 1_500_000 + "q9 z", "word " * 500_000, "a" + "-" * 2_000_000 + "b"]
    d = spark.createDataFrame([(n, t) for n, t in enumerate(texts)] + [(-1, None)], "n int, t string")
    for size in (1, 5, 20):
        got = {r.n: r.label for r in d.select("n", sanitize_label(F.col("t"), size).alias("label")).collect()}
        assert got == {-1: None, **{n: plain(t, size) for n, t in enumerate(texts)}}


def test_only_the_part_that_counts_is_rewritten(spark):
    plan = spark.range(1).select(sanitize_label(F.col("id").cast("string")).alias("label"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace(regexp_extract(" in plan
