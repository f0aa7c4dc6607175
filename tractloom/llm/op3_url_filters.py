"""URL filters: an ordered rule list, and gradient-boosted trees on lexical features for the rest.

The rules label the urls they fit; those labels train the trees, which judge all other urls. Features
and rules are built-in expressions, suffix statistics are aggregated tables, and the trees are Spark
ML's; nothing runs in Python.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tractloom.functions.stage import materialize
from tractloom.llm.common import read

#: Bound of the fit: urls with a rule's label.
TRAIN = 20_000
TREES, DEPTH = 8, 3
#: Rows that the overall block rate counts for in a suffix's own.
SMOOTH = 20
#: A training row's suffix statistics leave out all labels of its fold, its own included.
FOLDS = 5


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with its subdomains, where the url's path starts with ``path``."""
    host: str
    path: str
    verdict: str


#: The filter list of the query. Fixed values.
RULES = (Rule("com", "/", "allow"), Rule("example.com", "/en/", "block"), Rule("www.example.com", "/en/", "allow"),
         Rule("net", "/es/", "block"), Rule("net", "/fr/", "block"))
FEATURES = ("url_length", "host_length", "depth", "host_labels", "digit_ratio", "entropy", "parameters", "marks",
            "tld_log_count", "tld_block_rate", "site_log_count", "site_block_rate")


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path): host between the first ``://`` and ``/ ? #`` or the end with A-Z lower-cased, path from there to ``? #`` or the end; both empty without ``://``."""
    start = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(start > 0, F.substring(url, start + 3, F.char_length(url))).otherwise("")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), upper, upper.lower()), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rule(rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits columns host and path; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):  # the last one added is asked first
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, r.host + r.path).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Bits per character: runs of equal characters in the sorted text, so linear but for the sorting."""
    n = F.char_length(text)
    runs = F.regexp_extract_all(F.array_join(F.sort_array(F.split(text, "")), ""), F.lit(r"(?s)(.)\1*"), F.lit(0))
    total = F.aggregate(runs, F.lit(0.0), lambda s, r: s + F.char_length(r) * F.log2(F.char_length(r).cast("double")))
    return F.when(n > 0, F.log2(n.cast("double")) - total / n).otherwise(0.0)


def describe(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """page_id, host, path, rule, its verdict (given), the lexical features and the two suffixes of every url."""
    host, path = split_url(F.col("url"))
    d = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rule, given = match_rule(rules)
    url, n = F.col("url"), F.char_length("url")
    many = lambda pattern, column="url": F.regexp_count(F.col(column), F.lit(pattern)).cast("double")
    return d.select(
        "page_id", "host", "path", rule.alias("rule"), given.alias("given"),
        n.cast("double").alias("url_length"), F.char_length("host").cast("double").alias("host_length"),
        many("/[^/]", "path").alias("depth"), F.size(F.split("host", r"\.")).cast("double").alias("host_labels"),
        F.when(n > 0, many("[0-9]") / n).otherwise(0.0).alias("digit_ratio"), entropy(url).alias("entropy"),
        many("[?&][^?&#]*=").alias("parameters"), many("[-_%@~#]").alias("marks"),
        F.substring_index("host", ".", -1).alias("tld"), F.substring_index("host", ".", -2).alias("site"),
        F.pmod(F.xxhash64("page_id"), F.lit(FOLDS)).alias("fold"))


def suffix_counts(described: DataFrame, suffix: str) -> DataFrame:
    """Per suffix and fold of ids: n urls, m of them labelled, blocked among these; over all urls."""
    return described.groupBy(suffix, "fold").agg(
        F.count(F.lit(1)).alias("n"), F.count("given").alias("m"), F.count(F.when(F.col("given") == "block", 1)).alias("blocked"))


def with_suffixes(rows: DataFrame, counts: dict[str, DataFrame], rate: float, training: bool) -> DataFrame:
    """Add log count and smoothed block rate of each suffix; training rows see only the labels of other folds."""
    for s, per_fold in counts.items():
        whole = per_fold.groupBy(s).agg(*[F.sum(c).alias(c) for c in ("n", "m", "blocked")])
        rows = rows.join(whole, s)
        m, blocked = F.col("m"), F.col("blocked")
        if training:
            rows = rows.join(per_fold.select(s, "fold", F.col("m").alias("_m"), F.col("blocked").alias("_b")), [s, "fold"])
            m, blocked = m - F.col("_m"), blocked - F.col("_b")
        rows = rows.withColumns({f"{s}_log_count": F.log1p("n"), f"{s}_block_rate": (blocked + SMOOTH * rate) / (m + SMOOTH)}).drop("n", "m", "blocked", "_m", "_b")
    return rows


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, train: int = TRAIN) -> DataFrame:
    """(page_id, host, path, rule, verdict, block_score) for every row of ``pages`` (page_id, url).

    block_score is the trees' probability, null where a rule decides. Urls that are null or lack ``://``
    have empty host and path, fit no rule and are judged by their other features. Where the rules label
    no url, or all alike, no trees can be trained and the rest gets that one verdict (without labels: allow).
    At most ``train`` labelled urls fit the trees; suffix statistics come from all urls.
    """
    described = materialize(describe(pages, rules))
    label = (F.col("given") == "block").cast("double")
    sample = materialize(described.where("given is not null").orderBy(F.xxhash64("page_id"), "page_id").limit(train).withColumn("label", label))
    seen = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    rest = described
    if len(seen) < 2:
        score = F.lit(1.0 if 1.0 in seen else 0.0)
    else:
        counts = {s: materialize(suffix_counts(described, s)) for s in ("tld", "site")}
        m, blocked = counts["tld"].agg(F.sum("m"), F.sum("blocked")).first()
        assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")

        def with_features(rows: DataFrame, training: bool = False) -> DataFrame:
            return assembler.transform(with_suffixes(rows, counts, blocked / m, training))

        gbt = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=1, checkpointInterval=-1)
        model = gbt.fit(with_features(sample, True).select("features", "label"))
        rest = model.transform(with_features(described))
        score = vector_to_array(F.col("probability"))[1]
    verdict = F.coalesce("given", F.when(score >= 0.5, "block").otherwise("allow"))
    return rest.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.when(F.col("given").isNull(), score).alias("block_score"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages").select("page_id", "url"))
