"""Ranked lexical search: the best documents for every item of a query set.

Documents are indexed in blocks: one row holds the lists of some thousand documents, term by term,
for the terms of the query set. A block is searched with a mix of two orders. The item's short lists
are summed term at a time into accumulators; these then act as one more list whose bound is its
largest sum. Among that list and the long ones, those whose bounds together stay below the item's
present 50th score are not essential: documents are taken from the other lists, in document order,
and looked up in the rest from the largest bound down, as long as they can still reach that score.
All scores are integers, so the result does not depend on the order of additions or of blocks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tractloom.functions.stage import materialize
from tractloom.llm.common import read

TOP = 50
#: Characters of item texts that are searched for in one pass over the documents; they bound what a task holds of the query set.
PASS_CHARS = 8_000_000
#: Documents and words of one index block, at most (a longer document is a block of its own).
BLOCK_DOCS, BLOCK_WORDS = 4096, 1 << 21
#: A list is short if it holds at most this share of its block's documents.
SHORT = 1 / 32
#: First step of the final ranking: parts into which each item's candidates are dealt.
PARTS = 32
#: Bytes as Unicode-free term rule ``[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+`` on lower-cased A-Z: 0-9, a-z and all beyond ASCII.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_INDEX = "doc_ids array<{kind}>, lens array<bigint>, terms array<int>, counts array<int>, docs array<int>, tfs array<int>"


def terms(text: str | None) -> list[bytes]:
    return text.encode().translate(_TERMS).split() if text else []


def _index(vocabulary: dict[bytes, int]):
    """Blocks of documents: their ids and lengths, and the lists (document numbers and counts) of the known terms."""
    none = len(vocabulary)

    def block(kind: pa.DataType, ids: list, words: list[np.ndarray]) -> pa.RecordBatch:
        lens = np.array([len(w) for w in words], dtype=np.int64)
        key = np.concatenate(words) * len(words) + np.repeat(np.arange(len(words)), lens)
        key, tf = np.unique(key[key < none * len(words)], return_counts=True)
        term, counts = np.unique(key // len(words), return_counts=True)
        values = [(ids, kind), (lens, pa.int64()), (term, pa.int32()), (counts, pa.int32()), (key % len(words), pa.int32()), (tf, pa.int32())]
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), pa.array(v, t)) for v, t in values]
        return pa.RecordBatch.from_arrays(arrays, ["doc_ids", "lens", "terms", "counts", "docs", "tfs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, ids, words, size = pa.int64(), [], [], 0
        for batch in batches:
            kind = batch.column("doc_id").type
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text")):
                own = terms(text.as_py())
                if not own:
                    continue
                if ids and (len(ids) == BLOCK_DOCS or size + len(own) > BLOCK_WORDS):
                    yield block(kind, ids, words)
                    ids, words, size = [], [], 0
                ids.append(doc_id.as_py())
                words.append(np.fromiter((vocabulary.get(w, none) for w in own), dtype=np.int64, count=len(own)))
                size += len(own)
        if ids:
            yield block(kind, ids, words)

    return run


def best(lists: list[tuple[np.ndarray, np.ndarray, int]], n_docs: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of a block whose score reaches ``least`` (at least 1), in document order.

    ``lists`` has document numbers (ascending), what each adds to the score, and the largest of these.
    """
    nothing = np.empty(0, dtype=np.int64)
    lists = [x for x in lists if x[2]]  # a term of nearly all documents adds nothing
    if sum(bound for _, _, bound in lists) < least:
        return nothing, nothing
    short = [x for x in lists if len(x[0]) <= SHORT * n_docs]
    rest = [x for x in lists if len(x[0]) > SHORT * n_docs]
    if short:  # term at a time; below 2^53, so sums in doubles are exact
        sums = np.bincount(np.concatenate([d for d, _, _ in short]), np.concatenate([v for _, v, _ in short]), n_docs)
        docs = np.flatnonzero(sums)
        rest.append((docs, sums[docs].astype(np.int64), int(sums.max())))
    rest.sort(key=lambda x: x[2])
    reach = np.cumsum([bound for _, _, bound in rest])
    if reach[-1] < least:  # the largest sum of the short lists may be below the sum of their bounds
        return nothing, nothing
    optional = int(np.searchsorted(reach, least))  # the lists before this one cannot reach the score by themselves
    sums = np.bincount(np.concatenate([d for d, _, _ in rest[optional:]]), np.concatenate([v for _, v, _ in rest[optional:]]), n_docs)
    docs = np.flatnonzero(sums)
    score = sums[docs].astype(np.int64)
    for i in range(optional - 1, -1, -1):
        able = score + reach[i] >= least
        docs, score = docs[able], score[able]
        if not len(docs):
            break
        own, add, _ = rest[i]
        at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
        score = score + np.where(own[at] == docs, add[at], 0)
    good = score >= max(least, 1)
    return docs[good], score[good]


def _search(items: list[tuple[object, np.ndarray]], weights: np.ndarray, n: int, total: int, top: int):
    """Search index blocks for items (id, ascending term numbers); at most ``top`` documents of a task per item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(np.empty(0, dtype=np.int64), []) for _ in items]
        kind = pa.int64()
        for batch in batches:
            for row in range(batch.num_rows):
                part = {c: batch.column(c)[row].values for c in batch.schema.names}
                kind, ids = part["doc_ids"].type, part["doc_ids"]
                lens, term, counts, docs, tfs = (part[c].to_numpy().astype(np.int64) for c in ("lens", "terms", "counts", "docs", "tfs"))
                if not len(term):
                    continue
                m = 50 + 50 * lens * n // total
                add = np.repeat(weights[term], counts) * (1_000_000_000 * tfs // (1000 * tfs + 20 * m[docs]))
                ends = np.cumsum(counts)
                bounds = np.maximum.reduceat(add, ends - counts)
                for k, (_, own) in enumerate(items):
                    at = np.minimum(np.searchsorted(term, own), len(term) - 1)
                    at = at[term[at] == own]
                    if not len(at):
                        continue
                    scores, names = found[k]
                    lists = [(docs[e - c:e], add[e - c:e], b) for e, c, b in zip(ends[at].tolist(), counts[at].tolist(), bounds[at].tolist())]
                    new, got = best(lists, len(lens), int(scores[-1]) if len(scores) == top else 1)
                    if len(new):
                        scores, names = np.concatenate([scores, got]), names + ids.take(pa.array(new)).to_pylist()
                        order = sorted(range(len(names)), key=lambda i: (-scores[i], names[i] is None, names[i] or 0))[:top]
                        found[k] = (scores[order], [names[i] for i in order])
        rows = [(item, s, d) for (item, _), (scores, names) in zip(items, found) for s, d in zip(scores.tolist(), names)]
        if rows:
            item, score, doc = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(doc, kind), pa.array(score, pa.int64())], ["item", "doc_id", "score"])

    return run


def ranked_search(docs: DataFrame, items: DataFrame, top: int = TOP, pass_chars: int = PASS_CHARS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the ``top`` documents of largest score above 0, equal ones by doc_id.

    ``docs`` has doc_id and text, ``items`` item_id and text; other columns are not read. Items are
    searched for in passes of bounded size. Null and texts without a term are no documents and find
    nothing; rows of ``items`` with equal item_id (nulls too) are one item with the terms of all;
    repeated documents are each ranked, null doc_ids after the others; an empty table on either side
    gives no row.
    """
    spark = docs.sparkSession
    sizes = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    passes = -(-sizes // pass_chars)
    kind, item_kind = docs.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()
    ranked = spark.createDataFrame([], f"item_id {item_kind}, rank int, doc_id {kind}, score bigint")
    for p in range(passes):
        texts: dict[object, set[bytes]] = {}
        for row in items.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).select("item_id", "text").distinct().collect():
            texts.setdefault(row.item_id, set()).update(terms(row.text))
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*texts.values())))} if texts else {}
        if not vocabulary:
            continue
        named = list(texts)
        index = materialize(docs.select("doc_id", "text").mapInArrow(_index(vocabulary), _INDEX.format(kind=kind)))
        n, total = index.agg(F.sum(F.size("lens")), F.sum(F.aggregate("lens", F.lit(0).cast("bigint"), lambda a, x: a + x))).first()
        if not n:
            return ranked
        held = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
        weights = np.zeros(len(vocabulary), dtype=np.int64)
        for row in held.collect():  # a row per term of the pass
            weights[row.terms] = math.floor(1000 * math.log((2 * n + 2) / (2 * row.df + 1)))
        wanted = [(k, np.array(sorted(vocabulary[t] for t in texts[i]), dtype=np.int64)) for k, i in enumerate(named)]
        hits = index.mapInArrow(_search(wanted, weights, n, total, top), f"item bigint, doc_id {kind}, score bigint")
        order = [F.desc("score"), F.asc_nulls_last("doc_id")]
        for keys in (["item", "part"], ["item"]):
            hits = hits.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))) if "part" in keys else hits
            hits = hits.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
        names = spark.createDataFrame(list(enumerate(named)), f"item bigint, item_id {item_kind}")
        ranked = ranked.union(hits.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return ranked


def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


_WORDS = r"regexp_extract_all(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents WHERE text IS NOT NULL),
t AS (SELECT r, doc_id, len(w) AS own, unnest(w) AS term FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, own, term, count(*) AS tf FROM t GROUP BY ALL),
c AS (SELECT count(*) AS many, sum(len(w))::BIGINT AS whole FROM d WHERE len(w) > 0),
f AS (SELECT term, CAST(floor(1000 * ln((2 * many + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM p, c GROUP BY term, many),
q AS (SELECT DISTINCT item_id, unnest({_WORDS.format("text")}) AS term FROM benchmark),
s AS (SELECT item_id, r, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * own * many) // whole)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN p USING (term), c GROUP BY item_id, r, doc_id),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM k WHERE rank <= {TOP}
"""
