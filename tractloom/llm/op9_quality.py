"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

All words of the corpus are counted; the most frequent ones, ``FREQUENT`` at most, have a vector each,
and the others share those of ``CLASSES`` hash classes, so the table has a fixed size whatever the
vocabulary and no word goes without. A word's vector is the sum of the sparse random index vectors of
its neighbours in the same text, over the whole corpus, computed in parts and added up in integers. A
text is pooled twice, over its tokens and over its distinct words, which differ where a text repeats
itself. The network is fitted with numpy on a bounded sample of labelled texts and its probabilities
are calibrated by a temperature.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from tractloom.functions.stage import materialize
from tractloom.llm.common import labelled_sample, read, remainder

DIVISOR, HELD_OUT = 5, 0
THRESHOLD = 0.3
DIM = 48
#: Most words with a vector of their own; hash classes of the others, the last of them for a word equal to the one before it.
FREQUENT, CLASSES = 32_768, 4_096
#: Two pooled vectors and the logarithm of the number of tokens.
INPUTS = 2 * DIM + 1
#: Neighbours on either side; nonzero entries of an index vector.
WINDOW, NONZERO = 2, 2
#: Bound of the fit: labelled texts of either class.
TRAIN_PER_CLASS = 3000
HIDDEN, EPOCHS = 24, 150
SEED = 7
#: Word-vector rows that travel together.
BLOCK = 16
#: Tokens whose neighbours are counted at a time, and tokens after which sums are sent on.
STEP, FLUSH = 500_000, 1 << 28
#: Kept tokens of one task and the length above which a token is not kept.
KEPT, LONG = 200_000, 64

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+")


def word_hash(token: str) -> int:
    """64-bit hash by which a word is known; signed."""
    return xxhash.xxh64_intdigest(token, SEED) - (1 << 63)


def index_vectors(rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the nonzero entries of each row's index vector."""
    rng = np.random.default_rng(SEED)
    return rng.integers(0, DIM, (rows, NONZERO)), rng.choice([-1.0, 1.0], (rows, NONZERO))


class Vocabulary:
    """Row of each word: frequent words by their place in ``frequent`` (sorted hashes), then the classes of the others."""

    def __init__(self, frequent: np.ndarray):
        self.frequent = frequent
        self.rows = len(frequent) + CLASSES
        self.repeat = self.rows - 1

    def lookup(self) -> _Rows:
        return _Rows(self)


class _Rows(dict):
    """Rows of tokens; looked-up ones are kept up to a bound, long ones never."""

    def __init__(self, words: Vocabulary):
        super().__init__()
        self.known = {h: r for r, h in enumerate(words.frequent.tolist())}
        self.repeat = words.repeat

    def __missing__(self, token: str) -> int:
        h = word_hash(token)
        row = self.known.get(h)
        if row is None:
            row = len(self.known) + h % (CLASSES - 1)
        if len(token) <= LONG:
            if len(self) >= KEPT:
                self.clear()
            self[token] = row
        return row


def _ids(text: str | None, rows: _Rows) -> np.ndarray:
    tokens = _TOKEN.findall(text) if text else []
    ids = np.fromiter(map(rows.__getitem__, tokens), dtype=np.int64, count=len(tokens))
    again = np.flatnonzero(ids[1:] == ids[:-1]) + 1
    ids[again] = rows.repeat
    return ids


def _counts(batches):
    """Occurrences of words in one part of the corpus; sent on whenever many words are held."""
    seen: Counter[str] = Counter()

    def rows() -> pd.DataFrame:
        return pd.DataFrame({"word": np.array([word_hash(t) for t in seen], dtype=np.int64), "n": np.fromiter(seen.values(), dtype=np.int64, count=len(seen))})

    for batch in batches:
        for text in batch["text"]:
            seen.update(_TOKEN.findall(text) if text else ())
            if len(seen) > KEPT:
                yield rows()
                seen.clear()
    if seen:
        yield rows()


def vocabulary(docs: DataFrame, most: int = FREQUENT) -> Vocabulary:
    """The words that occur at least as often as the least limit which no more than ``most`` words reach.

    Limits are sixteenths of powers of two, so the limit is found from a table of some hundred rows.
    """
    counts = materialize(docs.select("text").mapInPandas(_counts, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")))
    level = F.floor(F.log2("n") * 16).cast("int")
    limit, total = None, 0
    for r in counts.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        total += r["count"]
        if total > most:
            break
        limit = r["level"]
    words = [] if limit is None else [r["word"] for r in counts.where(level >= limit).select("word").collect()]  # at most ``most``
    return Vocabulary(np.array(sorted(words), dtype=np.int64))


def _contexts(words: Vocabulary):
    """Neighbour sums of one part of the corpus, ``BLOCK`` rows to a row; no neighbours across two texts."""
    place, sign = index_vectors(words.rows)
    size = words.rows * DIM

    def run(batches):
        total, rows = np.zeros(size), words.lookup()

        def add(texts: list[np.ndarray]) -> None:
            ids = np.concatenate(texts)
            text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            for k in range(1, WINDOW + 1):
                at = np.flatnonzero(text[:-k] == text[k:])
                for a, b in ((ids[at], ids[at + k]), (ids[at + k], ids[at])):
                    for e in range(NONZERO):
                        np.add(total, np.bincount(a * DIM + place[b, e], weights=sign[b, e], minlength=size), out=total)

        def blocks() -> pd.DataFrame:
            full = np.zeros(-(-words.rows // BLOCK) * BLOCK * DIM, dtype="<i4")
            full[:size] = total
            full = full.reshape(-1, BLOCK * DIM)
            here = np.flatnonzero(full.any(axis=1))
            return pd.DataFrame({"block": here, "sums": [full[b].tobytes() for b in here]})

        waiting, n, sent = [], 0, 0
        for batch in batches:
            for text in batch["text"]:
                waiting.append(_ids(text, rows))
                n += len(waiting[-1])
                if n > STEP:
                    add(waiting)
                    waiting, n, sent = [], 0, sent + n
                    if sent > FLUSH:
                        yield blocks()
                        total[:] = 0
                        sent = 0
        if waiting:
            add(waiting)
        yield blocks()

    return run


def _add_up(batches):
    """Exact totals of sorted blocks."""
    open_, total = None, None
    for batch in batches:
        for block, sums in zip(batch["block"], batch["sums"]):
            if block != open_:
                if open_ is not None:
                    yield pd.DataFrame({"block": [open_], "sums": [total.tobytes()]})
                open_, total = block, np.zeros(BLOCK * DIM, dtype="<i8")
            total += np.frombuffer(sums, dtype="<i4")
    if open_ is not None:
        yield pd.DataFrame({"block": [open_], "sums": [total.tobytes()]})


def context_sums(docs: DataFrame, words: Vocabulary) -> np.ndarray:
    """Sum of the neighbours' index vectors of each row, from every text."""
    schema = "block long, sums binary"
    parts = docs.select("text").mapInPandas(_contexts(words), schema).repartition("block").sortWithinPartitions("block")
    table = np.zeros((-(-words.rows // BLOCK), BLOCK * DIM), dtype=np.int64)
    for r in parts.mapInPandas(_add_up, schema).collect():  # at most FREQUENT + CLASSES rows of DIM numbers: 14 MB
        table[r["block"]] = np.frombuffer(r["sums"], dtype="<i8")
    return table.reshape(-1, DIM)[:words.rows]


def word_vectors(docs: DataFrame, words: Vocabulary) -> np.ndarray:
    """Unit word vectors around their mean, one per row of the vocabulary."""
    table = context_sums(docs, words).astype(float)
    table = table / np.maximum(np.linalg.norm(table, axis=1, keepdims=True), 1e-9)
    return (table - table.mean(axis=0)).astype(np.float32)


def pool(text: str | None, vectors: np.ndarray, rows: _Rows) -> np.ndarray:
    """Mean word vector over the tokens and over the distinct words, and log(1 + tokens); zeros without a token."""
    ids = _ids(text, rows)
    if not len(ids):
        return np.zeros(INPUTS)
    here, counts = np.unique(ids, return_counts=True)
    x = vectors[here]
    return np.concatenate([counts @ x / len(ids), x.mean(axis=0), [np.log1p(len(ids))]])


class Network:
    """Two layers: standardised input, tanh, logit."""

    def __init__(self, inputs: int):
        rng = np.random.default_rng(SEED)
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)
        self.w = [rng.normal(0, inputs ** -0.5, (inputs, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN ** -0.5, HIDDEN), np.zeros(1)]
        self.temperature, self.shift = 1.0, 0.0

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x) / self.temperature + self.shift, -30, 30)))

    def fit(self, x: np.ndarray, y: np.ndarray, rate: float = 0.01, decay: float = 1e-3) -> None:
        """Adam over mini-batches of four fifths of the rows; the temperature is fitted on the rest."""
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(x))
        held, train = order[:len(x) // 5], order[len(x) // 5:]
        self.mean, self.scale = x[train].mean(axis=0), x[train].std(axis=0) + 1e-6
        z = (x - self.mean) / self.scale
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for _ in range(EPOCHS):
            rng.shuffle(train)
            for s in range(0, len(train), 256):
                b = train[s:s + 256]
                h = np.tanh(z[b] @ self.w[0] + self.w[1])
                d = (1 / (1 + np.exp(-(h @ self.w[2] + self.w[3]))) - y[b]) / len(b)
                back = np.outer(d, self.w[2]) * (1 - h * h)
                t += 1
                for k, g in enumerate((z[b].T @ back + decay * self.w[0], back.sum(axis=0), h.T @ d + decay * self.w[2], d.sum(keepdims=True))):
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    self.w[k] -= rate * (m[k] / (1 - 0.9 ** t)) / (np.sqrt(v[k] / (1 - 0.999 ** t)) + 1e-8)
        if len(held):
            raw = self.raw(x[held])
            loss = lambda temp: float(np.logaddexp(0, np.where(y[held] > 0, -1, 1) * raw / temp).mean())
            self.temperature = min(np.geomspace(0.25, 16, 61), key=loss)


def learn(docs: DataFrame, labels: DataFrame, words: Vocabulary, shared) -> Network:
    """The network from a bounded sample of the learning rows; without both classes it gives 0.5 for all."""
    may = (remainder("doc_id", DIVISOR) != HELD_OUT) & F.col("quality").isNotNull()

    def rows(batches):
        look = words.lookup()
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "y": batch["y"], "x": [pool(t, shared.value, look).tolist() for t in batch["text"]]})

    sample = labelled_sample(docs, labels, "quality", may, TRAIN_PER_CLASS).mapInPandas(rows, "doc_id long, y int, x array<double>")
    got = sorted(sample.collect(), key=lambda r: (r["doc_id"], r["x"]))  # at most twice TRAIN_PER_CLASS short rows
    net = Network(INPUTS)
    y = np.array([r["y"] for r in got], dtype=float)
    if len(set(y)) < 2:
        net.w[2][:] = 0
        return net
    net.fit(np.array([r["x"] for r in got]), y)
    # the sample balances the classes; the shift restores their share among all learning labels
    n = labels.where(may).agg(F.sum(F.col("quality").cast("long")).alias("ones"), F.count(F.lit(1)).alias("all")).first()
    net.shift = float(np.log(n["ones"] / (n["all"] - n["ones"])) - np.log(y.sum() / (len(y) - y.sum())))
    return net


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with ``quality_score`` (0 to 1); all other columns stay, but one of that name is replaced.

    Null and empty texts are pooled to zeros and scored like any other; repeated rows are each scored.
    """
    spark = docs.sparkSession
    words = vocabulary(docs)
    shared = spark.sparkContext.broadcast(word_vectors(docs, words))  # at most FREQUENT + CLASSES rows of DIM floats: 7 MB
    net = learn(docs, labels, words, shared)

    @F.pandas_udf("double")
    def quality(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        look = words.lookup()  # once per task
        for texts in batches:
            x = np.array([pool(t, shared.value, look) for t in texts]).reshape(len(texts), INPUTS)
            yield pd.Series(net.probability(x))

    return docs.withColumn("quality_score", quality(docs["text"]))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    s = F.col("quality_score")
    return score(docs, read(spark, sf_dir, "labels")).select(
        "doc_id", (remainder("doc_id", DIVISOR) == HELD_OUT).alias("held_out"), s.alias("score"), (s >= THRESHOLD).cast("int").alias("predicted"))
