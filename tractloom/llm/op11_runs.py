"""Periodic runs: passages of a document that repeat one sequence of words again and again.

A run is a stretch of consecutive words with smallest period q and at least max(6, 4 q) words that
no neighbouring word extends keeping period q. Seeds come from k-grams that recur inside the document,
one k for each class of periods: a run of period q matches itself at lag q over max(6 - q, 3 q) words
or more, so k is the least such overlap of the class. Because k >= q, the next occurrence of a k-gram
of the run is exactly q words later (an earlier one, d words later, would give the run the smaller
period gcd(q, d)), so only neighbouring occurrences of a k-gram are paired, never all of them, and no
run is found under a multiple of its period. A seed is extended along its diagonal, and a table of the
furthest covered word of each lag skips seeds inside diagonals that are already known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tractloom.llm.common import read

#: A run has at least this many words, and this many periods.
SHORTEST, PERIODS = 6, 4
_RUNS = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))


def classes(n: int, shortest: int = SHORTEST, periods: int = PERIODS) -> Iterator[tuple[int, int, int]]:
    """(k, least period, greatest period) of the classes that a document of ``n`` words needs."""
    least = 1
    while periods * least <= n:
        turn = max(least, -(-shortest // periods))  # from here on the overlap grows with the period
        k = min(max(shortest - q, (periods - 1) * q) for q in range(least, turn + 1))
        yield k, least, k
        least = k + 1


def _pairs(a: np.ndarray, shift: int) -> np.ndarray:
    """Numbers of the recurring pairs (a[i], a[i + shift]); -1 where a pair occurs once or holds a -1."""
    left, right = a[:len(a) - shift], a[shift:]
    at = np.flatnonzero((left >= 0) & (right >= 0))
    out = np.full(len(left), -1, dtype=np.int64)
    if len(at):
        _, number, count = np.unique(left[at] * (a.max() + 1) + right[at], return_inverse=True, return_counts=True)
        often = count[number] > 1
        out[at[often]] = number[often]
    return out


def _matching(ids: np.ndarray, x: int, lag: int, step: int) -> int:
    """How many words from x on, in direction ``step``, equal the words ``lag`` further on."""
    most = len(ids) - lag - x if step > 0 else x + 1
    done, size = 0, 64
    while done < most:
        m = min(size, most - done)
        if step > 0:
            differ = ids[x + done:x + done + m] != ids[x + done + lag:x + done + lag + m]
        else:
            differ = (ids[x - done - m + 1:x - done + 1] != ids[x - done - m + 1 + lag:x - done + 1 + lag])[::-1]
        first = int(differ.argmax()) if m else 0
        if m and differ[first]:
            return done + first
        done, size = done + m, size * 4
    return done


def runs(ids: np.ndarray, shortest: int = SHORTEST, periods: int = PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of word numbers, by start, then period."""
    n, found = len(ids), []
    if n < shortest:
        return found
    grams, size = np.where(np.bincount(ids)[ids] > 1, ids, -1), 1  # recurring grams of a power of two words
    for k, least, greatest in classes(n, shortest, periods):
        while 2 * size <= k and (grams >= 0).any():
            grams, size = _pairs(grams, size), 2 * size
        alive = grams if size == k else _pairs(grams, k - size)
        at = np.flatnonzero(alive >= 0)
        if not len(at):
            break  # a longer gram recurs only where its shorter ones do
        at = at[np.argsort(alive[at], kind="stable")]
        lag = np.diff(at)
        seed = np.flatnonzero((alive[at[1:]] == alive[at[:-1]]) & (lag >= least) & (lag <= greatest))
        starts, lags = at[seed], lag[seed]
        order = np.lexsort((starts, lags))
        starts, lags = starts[order], lags[order]
        edges = np.flatnonzero(np.r_[True, lags[1:] != lags[:-1], True]) if len(lags) else np.zeros(1, dtype=int)
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist()):
            q, own, x = int(lags[s]), starts[s:e], 0
            while x < len(own):
                p = int(own[x])
                first = p - _matching(ids, p - 1, q, -1) if p else 0
                covered = p + _matching(ids, p, q, 1)
                if covered - first + q >= max(shortest, periods * q):
                    found.append((first, covered - first + q, q))
                x = int(np.searchsorted(own, covered))
    return sorted(set(found), key=lambda r: (r[0], r[2]))


def _numbers(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), dtype=np.int64, count=len(words))


def kept(n: int, of: list[tuple[int, int, int]]) -> np.ndarray:
    """Mask of the words that stay: all but those that a run contains after its first period."""
    change = np.zeros(n + 1, dtype=np.int64)
    for start, length, q in of:
        change[start + q] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def _per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts, found, texts = [], [], []
        for text in batch.column("text"):
            words = (text.as_py() or "").encode().split()  # bytes: the white space of the rule and no other
            of = runs(_numbers(words))
            counts.append(len(words))
            found.append([{"start": s, "length": n, "period": q} for s, n, q in of])
            texts.append(b" ".join([w for w, k in zip(words, kept(len(words), of)) if k] if of else words).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, _RUNS), pa.array(texts, pa.string())],
                                         ["doc_id", "n_words", "runs", "collapsed"])


def periodic_runs(docs: DataFrame, text: Column | str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed), one row per row of ``docs``; other columns are not read.

    runs holds start, length and period (word numbers from 0) by start, then period. collapsed is the
    kept words joined by one space. A null or empty text and one of white space have no runs and an
    empty collapsed text; null ids and repeated rows are each returned; an empty table gives none.
    Work and memory of a document are near to proportional to its words, whatever its runs. No shuffle.
    """
    rows = docs.select("doc_id", (F.col(text) if isinstance(text, str) else text).alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_per_batch, f"doc_id {kind}, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def planted_text() -> Column:
    """The query's own texts: of one document in ten a tail is replaced by repetitions of its first words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    named = F.named_struct(F.lit("w"), words, F.lit("g"), F.floor(h / 10))
    # one-element arrays give the parts names inside an expression
    with_a = F.transform(F.array(named), lambda s: F.struct(s["w"].alias("w"), s["g"].alias("g"), (s["g"] % F.size(s["w"])).alias("a")))
    with_p = F.transform(with_a, lambda s: F.struct(s["w"].alias("w"), s["a"].alias("a"), (1 + F.floor((F.size(s["w"]) - s["a"]) / (3 + s["g"] % 8))).alias("p")))

    def repeated(s: Column) -> Column:
        old = lambda i: F.when(i < s["a"], i).otherwise(s["a"] + (i - s["a"]) % s["p"])
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.size(s["w"]).cast("long") - 1), lambda i: F.element_at(s["w"], (1 + old(i)).cast("int"))), " ")

    return F.when((h % 10 == 0) & (F.size(words) > 0), F.get(F.transform(with_p, repeated), F.lit(0))).otherwise(F.col("text"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(read(spark, sf_dir, "documents"), planted_text())
    stronger = lambda x, y: y["length"] * x["period"] > x["length"] * y["period"]  # noqa: E731  exact, by cross products
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(stronger(x, y), y).otherwise(x))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("top"), F.sha2(F.concat_ws("", listed), 256).alias("runs_sha256"),
                        F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "top.start", "top.length", "top.period", F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256")
