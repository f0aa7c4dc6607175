"""Quality rules: a threshold table compiled into one projection over counts of each text.

Counts are built-in array and string functions on the row itself, so there is no shuffle and no
user function; the repeated-window count sorts the hashes of a text's own windows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tractloom.llm.common import SPACE, read

SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of the corpus languages, lower case, without those that two lists share. Fixed values.
STOP_WORDS = ("the", "of", "and", "to", "in", "is", "that", "for", "on", "with", "as", "by", "at", "this",
              "der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im",
              "le", "la", "les", "et", "des", "du", "un", "une", "que", "est", "pour", "qui", "par", "dans",
              "el", "los", "y", "en", "de", "del", "se", "las", "por", "con", "una", "al", "lo", "su")
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50


@dataclass(frozen=True)
class Rule:
    """A document passes while ``scale * metric`` lies within [low * of, high * of]; whole numbers keep it exact."""
    name: str
    metric: str
    of: str | None
    low: int | None
    high: int | None
    scale: int = 100


RULES = (
    Rule("word_length", "word_chars", "n_words", 200, 1200),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 10),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 2, None),
    Rule("line_ratio", "n_dup_lines", "n_lines", None, 50),
    Rule("line_length", "n_words", "n_lines", 100, None),
    Rule("shouting", "n_exclamations", "n_words", None, 50),
)


def _stop_forms() -> list[str]:
    """Each stop word in lower case and with a capital; text in capitals has none."""
    return sorted({f for w in STOP_WORDS for f in (w, w.capitalize())})


def verdict(rules: tuple[Rule, ...]) -> Column:
    """The table as one boolean expression; an empty table passes everything."""
    out = F.lit(True)
    for r in rules:
        value = F.col(r.metric) * r.scale
        base = F.col(r.of) if r.of else F.lit(1)
        if r.low is not None:
            out = out & (value >= base * r.low)
        if r.high is not None:
            out = out & (value <= base * r.high)
    return out


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    """Too few words, or too many of them in windows that occur again."""
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the counts that rules may use; a null text counts as one without words.

    Windows are compared by 64-bit hashes of three words.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    d = docs.withColumns({"_words": F.array_remove(F.split(body, SPACE + "+"), ""),
                          "_lines": F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))})
    w = F.col("_words")
    n = F.size(w)
    later = lambda k: F.slice(w, F.lit(k + 1), F.greatest(n - 2, F.lit(0)))
    windows = F.when(n >= 3, F.zip_with(F.zip_with(later(0), later(1), lambda a, b: F.xxhash64(a, b)), later(2), lambda h, c: F.xxhash64(h, c)))
    d = d.withColumns({"n_words": n.cast("long"), "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
                       "n_symbols": F.regexp_count(body, F.lit(SYMBOLS)).cast("long"),
                       "n_exclamations": (F.char_length(body) - F.char_length(F.replace(body, F.lit("!"), F.lit("")))).cast("long"),
                       "n_lines": F.size("_lines").cast("long"),
                       "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                       "n_stop_words": F.size(F.filter(w, lambda x: x.isin(*_stop_forms()))).cast("long"),
                       "_windows": windows})
    # windows that occur again, in the order of their hashes, then of their places
    repeats = F.size("_windows") > F.size(F.array_distinct("_windows"))
    places = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("_sorted", F.when(repeats, places))
    s = F.col("_sorted")
    again = F.filter(s, lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"]))
    d = d.withColumn("_again", F.sort_array(F.transform(again, lambda x: x["i"])))
    # each such window marks three words; the next one starts after 1, 2 or more
    steps = F.zip_with("_again", F.slice("_again", F.lit(2), F.size("_again")), lambda a, b: F.least(F.coalesce(b - a, F.lit(3)), F.lit(3)))
    repeated = F.aggregate(steps, F.lit(0), lambda total, x: total + x)
    d = d.withColumn("n_repeat_words", F.coalesce(repeated, F.lit(0)).cast("long"))
    # rows come out of a list of one: a filter on the counts would else be pushed below them and copy their expressions many times
    return d.select(F.inline(F.array(F.struct(*[c for c in d.columns if c not in ("_words", "_lines", "_windows", "_sorted", "_again")]))))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_words: int = MIN_WORDS,
          max_repeat_percent: int = MAX_REPEAT_PERCENT) -> DataFrame:
    """Counts, base_failed and kept for each row of ``docs`` (doc_id, text; other columns are not read).

    Null, empty and blank texts have no words and fail the base rule; repeated rows are each judged.
    """
    d = measure(docs.select("doc_id", "text"))
    return d.withColumn("base_failed", base_failed(min_words, max_repeat_percent)).withColumn("kept", ~F.col("base_failed") & verdict(rules)).drop("text")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows of ``docs`` that pass, with their own columns."""
    inner = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("_row"), F.col("text").alias("_text"))
    return measure(inner, "_text").where(~base_failed() & verdict(rules)).select("_row.*")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "documents"))


def _sql_rules(rules: tuple[Rule, ...]) -> str:
    parts = []
    for r in rules:
        parts += [f"{r.scale} * {r.metric} {op} {bound} * {r.of or 1}" for op, bound in ((">=", r.low), ("<=", r.high)) if bound is not None]
    return " AND ".join(parts)


SQL = rf"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT r, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t)),
dup AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n FROM win) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM dup) GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(list_aggregate(w || [''], 'string_agg', '')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '{SYMBOLS}')) AS BIGINT) AS n_symbols,
         CAST(length(text) - length(replace(text, '!', '')) AS BIGINT) AS n_exclamations,
         CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(w, lambda x: x IN ({", ".join(f"'{x}'" for x in _stop_forms())}))) AS BIGINT) AS n_stop_words,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM t LEFT JOIN rep USING (r)),
f AS (SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND {_sql_rules(RULES)} AS kept FROM f
"""
