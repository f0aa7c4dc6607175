"""Toxicity by a weighted finite-state grammar over clauses.

Words become symbols (insult, threat, target, negation, reported speech, clause end, other). Four
small transducers read the symbols and are composed into one machine: negation and reported
speech open a scope that ends after some words or with the clause, targets remember that somebody
is spoken of, and the insult and threat transducers emit their weight under the scopes that are
open. A text's score is a logistic function of the weights summed by kind of match, so an insult
that is negated or quoted counts for less than one aimed at somebody.

Insult words and stems are a small seed list plus those that labelled texts show to be toxic.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tractloom.functions.stage import materialize
from tractloom.llm.common import fit_logistic, labelled_sample, read, remainder

DIVISOR, HELD_OUT = 4, 2
#: Bound of the fit: labelled texts of either class.
TRAIN_PER_CLASS = 4000
THRESHOLD = 0.3
#: A learned word or stem is in this many toxic texts at least, and this share of its texts is toxic.
SUPPORT, PRECISION = 4, 0.95
#: A candidate is taken while it explains SUPPORT toxic texts that have fewer than this many taken words or stems.
EXPLAIN = 2
STEM = (4, 8)

#: Seed lists. Fixed values.
INSULTS = ("idiot", "moron", "stupid", "scum", "loser", "pathetic", "worthless", "disgusting", "trash", "clown", "imbecile", "bastard",
           "dummkopf", "arschloch", "abschaum", "trottel", "connard", "salaud", "abruti", "imbécile", "estúpido", "idiota", "gilipollas", "imbécil")
THREATS = ("kill", "murder", "stab", "strangle", "töten", "umbringen", "tuer", "égorger", "matar", "matarte", "apuñalar")
TARGETS = ("you", "your", "yours", "yourself", "u", "they", "them", "he", "she", "du", "dich", "dir", "ihr", "euch", "tu", "toi", "vous", "ils", "tú", "ti", "usted", "ustedes", "vosotros")
NEGATIONS = ("not", "never", "nobody", "isn", "aren", "wasn", "don", "nicht", "kein", "keine", "niemals", "pas", "jamais", "aucun", "nunca", "ningún", "jamás")
REPORTS = ("said", "says", "wrote", "writes", "quoted", "quote", "claimed", "sagte", "schrieb", "zitierte", "déclaré", "écrit", "cité", "dijo", "escribió", "citó")
SCOPE = {"negation": 4, "report": 12, "target": 6}

_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]")
_END = frozenset(".!?;\n")
KINDS = tuple(f"{what}{neg}{rep}{aim}" for what in ("insult", "threat") for neg in ("", "_negated") for rep in ("", "_reported") for aim in ("", "_aimed"))


def _scope(opener: str, length: int):
    """A transducer whose state counts down from ``length`` after ``opener``; it emits whether its scope is open."""

    def step(state: int, symbol: str) -> tuple[int, bool]:
        if symbol == opener:
            return length, True
        return (0, False) if symbol == "end" else (max(0, state - 1), state > 0)

    return step


def compose(machines: tuple) -> tuple[list[dict], dict]:
    """The product of scope transducers, built state by state from the start.

    Returns the transitions, one dict symbol -> (state, kind or None) per state, and the states' numbers.
    """
    symbols = ("other", "insult", "threat", "target", "negation", "report", "end")
    number = {(0,) * len(machines): 0}
    todo, table = [(0,) * len(machines)], []
    while todo:
        state = todo.pop(0)
        row = {}
        for symbol in symbols:
            moved = [m(s, symbol) for m, s in zip(machines, state)]
            nxt = tuple(s for s, _ in moved)
            if nxt not in number:
                number[nxt] = len(number)
                todo.append(nxt)
            neg, rep, aim = (o for _, o in moved)
            kind = symbol + "_negated" * neg + "_reported" * rep + "_aimed" * aim if symbol in ("insult", "threat") else None
            row[symbol] = (number[nxt], kind)
        table.append(row)
    return table, number


_MACHINE, _STATES = compose((_scope("negation", SCOPE["negation"]), _scope("report", SCOPE["report"]), _scope("target", SCOPE["target"])))
_FUNCTION = {**{w: "threat" for w in THREATS}, **{w: "target" for w in TARGETS}, **{w: "negation" for w in NEGATIONS}, **{w: "report" for w in REPORTS}}


class Lexicon(dict):
    """Weight of a word as an insult (0: none); looked-up words are kept up to a bound."""

    def __init__(self, weights: dict[str, float], size: int = 200_000):
        super().__init__()
        self.weights, self.size = weights, size

    def __missing__(self, word: str) -> float:
        w = self.weights.get(word, 0.0)
        for n in range(*STEM):
            if not w and len(word) > n:
                w = self.weights.get(word[:n] + "*", 0.0)
        if len(self) >= self.size:
            self.clear()
        self[word] = w
        return w


def matches(text: str | None, lexicon: Lexicon) -> dict[str, float]:
    """Weights of the grammar's matches in a whole text, by kind."""
    found: dict[str, float] = {}
    tokens = _TOKEN.findall(text.lower()) if text else []
    seen = set(tokens)
    insults = {w for w in seen if lexicon[w]}
    if not insults and seen.isdisjoint(THREATS):
        return found
    state = 0
    for t in tokens:
        symbol = "end" if t in _END else "insult" if t in insults else _FUNCTION.get(t, "other")
        state, kind = _MACHINE[state][symbol]
        if kind:
            found[kind] = found.get(kind, 0.0) + (lexicon[t] if symbol == "insult" else 1.0)
    return found


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    found = matches(text, lexicon)
    return [math.log1p(found.get(k, 0.0)) for k in KINDS]


def prior() -> np.ndarray:
    """Weights before labels are seen: what is negated or reported counts little; a threat counts only where somebody is aimed at."""
    out = [(3.0 if k.startswith("insult") else 0.5) * (0.3 if "_negated" in k else 1) * (0.4 if "_reported" in k else 1)
           + (0.5 if k.endswith("_aimed") else 0) + (3.0 if k == "threat_aimed" else 0) for k in KINDS]
    return np.array([*out, -2.5])


def _terms(batches):
    for batch in batches:
        counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
        who: tuple[Counter, Counter] = (Counter(), Counter())
        for doc, text, y in zip(batch["doc_id"], batch["text"], batch["y"]):
            words = {t for t in _TOKEN.findall(text.lower()) if t not in _END} if text else set()
            held = words | {w[:n] + "*" for w in words for n in range(*STEM) if len(w) > n}
            counts[int(y)].update(held)
            if y:
                high, low = divmod(xxhash.xxh64_intdigest(f"{doc} {text}"), 1 << 32)  # halves, so that no sum overflows
                for t in held:
                    who[0][t] += high
                    who[1][t] += low
        terms = list(counts[0].keys() | counts[1].keys())
        yield pd.DataFrame({"term": terms, "toxic": [counts[1][t] for t in terms], "clean": [counts[0][t] for t in terms], "who": [who[0][t] for t in terms], "who2": [who[1][t] for t in terms]})


def _held(candidates: list[str]):
    place = {t: n for n, t in enumerate(candidates)}

    def run(batches):
        for batch in batches:
            out = []
            for text in batch["text"]:
                words = set(_TOKEN.findall(text.lower())) if text else set()
                out.append(sorted({place[t] for w in words for t in (w, *(w[:n] + "*" for n in range(*STEM) if len(w) > n)) if t in place}))
            yield pd.DataFrame({"held": out})

    return run


def cover(held: list[list[int]], n: int) -> list[int]:
    """Candidates that explain the texts: the one in most texts that still need it, again and again.

    Words that copies of one toxic text share by chance are left over, as its insults explain all its copies.
    """
    left = [EXPLAIN] * len(held)
    where: list[list[int]] = [[] for _ in range(n)]
    for text, candidates in enumerate(held):
        for c in candidates:
            where[c].append(text)
    need = [len(w) for w in where]
    queue = [(-k, c) for c, k in enumerate(need)]  # needs only shrink, so an entry that is still true is the largest
    heapq.heapify(queue)
    taken = []
    while queue and -queue[0][0] >= SUPPORT:
        known, best = heapq.heappop(queue)
        if need[best] != -known:
            heapq.heappush(queue, (-need[best], best))
            continue
        taken.append(best)
        for text in where[best]:
            left[text] -= 1
            if left[text] == 0:
                for c in held[text]:
                    need[c] -= 1
    return taken


def learn(docs: DataFrame, labels: DataFrame) -> tuple[dict[str, float], np.ndarray]:
    """Lexicon and weights from a bounded sample of the learning rows; without labels the seeds and the prior."""
    may = remainder("doc_id", DIVISOR) != HELD_OUT
    sample = materialize(labelled_sample(docs, labels, "toxic", may, TRAIN_PER_CLASS))
    terms = sample.mapInPandas(_terms, "term string, toxic long, clean long, who long, who2 long").groupBy("term").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"), F.sum("who").alias("who"), F.sum("who2").alias("who2"))
    share = F.col("toxic") / (F.col("toxic") + F.col("clean") + F.lit(0.2))
    top = terms.withColumn("share", share).where((F.col("toxic") >= SUPPORT) & (F.col("share") >= PRECISION))
    # terms of the same toxic texts: after EXPLAIN of them no text needs another, so cover() would never take more
    same = Window.partitionBy("toxic", "who", "who2").orderBy("term")
    top = top.withColumn("nth", F.row_number().over(same)).where(F.col("nth") <= EXPLAIN).orderBy(F.desc("toxic"), "term").select("term", "share").collect()
    terms = [r["term"] for r in top]
    toxic = sample.where("y = 1").mapInPandas(_held(terms), "held array<int>").collect()  # at most TRAIN_PER_CLASS lists
    taken = cover([r["held"] for r in toxic], len(terms))
    weights = {**{w: 1.0 for w in INSULTS}, **{terms[k]: float(top[k]["share"]) for k in taken}}
    for w in _FUNCTION:  # the grammar's own words keep their part
        weights.pop(w, None)

    def rows(batches):
        lexicon = Lexicon(weights)
        for batch in batches:
            yield pd.DataFrame({"x": [features(t, lexicon) for t in batch["text"]], "y": batch["y"].astype("int32")})

    got = sample.mapInPandas(rows, "x array<double>, y int").collect()  # at most twice TRAIN_PER_CLASS short rows
    if not got:
        return weights, prior()
    return weights, fit_logistic(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], dtype=float), prior())


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``toxicity`` (0 to 1), from the model that the labels give; all other columns stay, but one of that name is replaced.

    Null and empty texts have no match and get the base rate's score; repeated rows are each scored.
    """
    weights, w = learn(docs, labels)

    @F.pandas_udf("double")
    def toxicity(texts: pd.Series) -> pd.Series:
        lexicon = Lexicon(weights)
        x = np.array([features(t, lexicon) for t in texts], dtype=float).reshape(len(texts), len(KINDS))
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30))))

    return docs.withColumn("toxicity", toxicity(docs["text"]))


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs`` that score below ``threshold``, with their own columns."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    return score(row, labels).where(F.col("toxicity") < threshold).select("row.*")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("toxicity")
    return score(docs, read(spark, sf_dir, "labels")).select(
        "doc_id", (remainder("doc_id", DIVISOR) == HELD_OUT).alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"))
