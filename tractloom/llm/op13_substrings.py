"""Removal of passages that occur more than once, by relative Lempel-Ziv factors.

A window is ``WINDOW`` consecutive words. Every window is filed under its anchor, the k-gram of least
hash inside it (the leftmost of equal ones), so equal windows have equal anchors at equal places, and
a stretch of windows with equal anchors is one segment. An anchor that is taken at one place only has
no equal windows; only segments of recurring anchors travel. The segments that meet at an anchor are a
reference block, indexed by their windows, and each of them is factored greedily against the rest of
its block: a factor starts where a window is found in another place and goes on while the following
windows are found at the following places there; where it ends, the windows across its end are looked
up afresh. A factor of m windows covers WINDOW + m - 1 words, and these become spans to remove.
Segments of very frequent anchors do not meet in one task: equal ones are counted by Spark first,
and of the others the windows are.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tractloom.functions.stage import discard, materialize
from tractloom.llm.common import read

WINDOW = 35
ANCHOR = 8
SEED = 42
#: Words that are hashed at a time, and windows that are parsed at a time, about.
SLICE = 1 << 20
#: Most segments of a reference block; anchors with more are compared by counts.
OFTEN = SLICE // WINDOW
_ODD = 0x9E3779B97F4A7C15
_PLACE = np.uint64((1 << 24) - 1)
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_KEY = ["doc_id", "text_hash"]


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(n, base & (1 << 64) - 1, dtype=np.uint64)]))


_UP, _DOWN = _powers(_ODD, SLICE + WINDOW), _powers(pow(_ODD, -1, 1 << 64), SLICE + WINDOW)


def _word_hashes(text: str | None) -> np.ndarray:
    """64-bit hash of every word; a long text is split piece by piece."""
    data, out, at = text.encode() if text else b"", [], 0
    while at < len(data):
        cut = _SPACE.search(data, at + SLICE)
        end = cut.start() if cut else len(data)
        out.append(np.array([xxhash.xxh64_intdigest(w, SEED) for w in data[at:end].split()], dtype=np.uint64))
        at = end
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def _grams(h: np.ndarray, sums: np.ndarray, k: int) -> np.ndarray:
    n = len(h) - k + 1
    return _mix((sums[k:] - sums[:n]) * _DOWN[:n])


def segments(words: np.ndarray, window: int = WINDOW, k: int = ANCHOR) -> Iterator[tuple[np.ndarray, ...]]:
    """(anchors, first window of each segment, number of its windows, number of places of its anchor, hashes of all windows), some windows at a time.

    Cutting a long document between windows only cuts a segment in two.
    """
    for s in range(0, len(words) - window + 1, SLICE):
        h = words[s:s + SLICE + window - 1]
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(h * _UP[:len(h)])])
        grams, spread = _grams(h, sums, k), window - k + 1
        least = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
        width = 1
        while 2 * width <= spread:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        n = len(h) - window + 1
        least = np.minimum(least[:n], least[spread - width:spread - width + n])
        place = (least & _PLACE).astype(np.int64)
        moves, anchor = np.r_[True, place[1:] != place[:-1]], grams[place]
        first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
        yield anchor[first].view(np.int64), s + first, np.diff(np.r_[first, n]), np.add.reduceat(moves.astype(np.int64), first), _grams(h, sums, window).view(np.int64)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, anchors, firsts, places = [], [], [], []
        for i, text in enumerate(batch.column("text")):
            for a, first, _, number, _ in segments(_word_hashes(text.as_py())):
                rows.append(np.full(len(a), i))
                anchors.append(a)
                firsts.append(first)
                places.append(number)
        if rows:
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(np.concatenate(anchors), pa.int64()),
                                              pa.array(np.concatenate(firsts), pa.int32()), pa.array(np.concatenate(places), pa.int32())],
                                             [*_KEY, "anchor", "first", "places"])


def _wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of documents that start at the listed words, with their window hashes."""
    for batch in batches:
        rows, anchors, firsts, sizes, windows = [], [], [], [], []
        for i, (text, wanted) in enumerate(zip(batch.column("text"), batch.column("firsts"))):
            wanted = np.sort(wanted.values.to_numpy())
            for a, first, count, _, hashes in segments(_word_hashes(text.as_py())):
                mine = np.flatnonzero(np.isin(first, wanted))
                inside = np.zeros(len(hashes) + 1, dtype=np.int64)
                inside[first[mine] - first[0]] += 1
                inside[first[mine] - first[0] + count[mine]] -= 1
                rows.append(np.full(len(mine), i))
                anchors.append(a[mine])
                firsts.append(first[mine])
                sizes.append(count[mine])
                windows.append(hashes[np.cumsum(inside[:-1]) > 0])
        if rows:
            at, ends = pa.array(np.concatenate(rows)), np.cumsum(np.concatenate(sizes))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends], pa.int32()), pa.array(np.concatenate(windows), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(at), batch.column("text_hash").take(at), pa.array(np.concatenate(anchors), pa.int64()),
                                              pa.array(np.concatenate(firsts), pa.int32()), lists], [*_KEY, "anchor", "first", "windows"])


def factors(block: np.ndarray, sizes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, offset, windows) of the greedy factors of segments relative to the others of their block.

    ``block`` numbers the block of each segment, ``windows`` has the hashes of all their windows.
    """
    segment = np.repeat(np.arange(len(sizes)), sizes)
    of = block[segment]
    order = np.lexsort((windows, of))
    same = (windows[order][1:] == windows[order][:-1]) & (of[order][1:] == of[order][:-1])
    place = np.full(len(windows), -1, dtype=np.int64)
    head = np.flatnonzero(np.r_[True, ~same])
    size = np.diff(np.r_[head, len(order)])
    place[order] = np.repeat(np.where(size > 1, order[head], -1), size)  # the first place that has this window
    place[order[head[size > 1]]] = order[head[size > 1] + 1]  # which itself refers to the second
    found = place >= 0
    goes_on = np.r_[False, found[1:] & found[:-1] & (place[1:] == place[:-1] + 1) & (segment[1:] == segment[:-1]) & (segment[place[1:]] == segment[place[:-1]])]
    start = np.flatnonzero(found & ~goes_on)
    ends = np.cumsum(found)
    length = np.diff(np.r_[ends[start] - 1, found.sum()])
    return segment[start], start - (np.cumsum(sizes) - sizes)[segment[start]], length


def _parse(window: int):
    """Spans of the factors of sorted segments; a block is parsed once all of it has come."""

    def parse(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        anchor, lists = table["anchor"].to_numpy(), table["windows"].chunk(0)
        sizes, hashes = lists.value_lengths().to_numpy().astype(np.int64), lists.flatten().to_numpy()
        block = np.cumsum(np.r_[0, anchor[1:] != anchor[:-1]])
        of, offset, length = factors(block, sizes, hashes)
        if len(of):
            at = pa.array(of)
            start = table["first"].to_numpy()[of] + offset
            yield pa.RecordBatch.from_arrays([table[c].chunk(0).take(at) for c in _KEY] + [pa.array(start, pa.int32()), pa.array(start + length + window - 1, pa.int32())],
                                             [*_KEY, "start", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if len(held) * WINDOW // 2 < SLICE:
                continue
            anchor = held["anchor"].to_numpy()
            last = int(np.flatnonzero(anchor != anchor[-1])[-1]) + 1 if anchor[0] != anchor[-1] else 0
            if last:
                yield from parse(held.slice(0, last))
                held = held.slice(last)
        if held is not None and len(held):
            yield from parse(held)

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the words of their spans."""
    for batch in batches:
        counts, removed, texts = [], [], []
        for text, starts, stops in zip(*(batch.column(c) for c in ("text", "starts", "stops"))):
            words = (text.as_py() or "").encode().split()
            counts.append(len(words))
            if starts.is_valid and len(words):
                change = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(change, starts.values.to_numpy(), 1)
                np.add.at(change, stops.values.to_numpy(), -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
            removed.append(counts[-1] - len(words))
            texts.append(b" ".join(words).decode())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                                         ["doc_id", "n_words", "n_removed", "text"])


def _same(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_hash"] == right["text_hash"])


def repeated_spans(rows: DataFrame, often: int = OFTEN) -> DataFrame:
    """(doc_id, text_hash, start, stop) of words covered by windows that recur; ``rows`` has doc_id, text_hash, text.

    Spans may overlap, and rows that are equal in doc_id and text share them.
    """
    spark = rows.sparkSession
    key = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text_hash bigint"
    name = uuid.uuid4().hex
    anchors = materialize(rows.mapInArrow(_anchors, f"{key}, anchor bigint, first int, places int"), name)
    met = anchors.groupBy("anchor").agg(F.sum("places").alias("places"), F.count(F.lit(1)).alias("n")).where("places > 1")
    met = materialize(met.select("anchor", (F.col("n") > often).alias("hot")), f"{name}-met")
    wanted = materialize(anchors.join(met, "anchor").groupBy(*_KEY, "hot").agg(F.collect_set("first").alias("firsts")))
    discard(spark, name, f"{name}-met")

    def of(hot: bool) -> DataFrame:
        mine = wanted.where(F.col("hot") == hot)
        return rows.join(mine, _same(rows, mine)).select(rows["doc_id"], rows["text_hash"], "text", "firsts").mapInArrow(
            _wanted, f"{key}, anchor bigint, first int, windows array<bigint>")

    spans = of(False).repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_parse(WINDOW), f"{key}, start int, stop int")
    return spans if wanted.where("hot").isEmpty() else spans.union(_frequent(of(True)))


def _frequent(found: DataFrame) -> DataFrame:
    """Spans of segments whose anchors are too frequent for one task: equal segments are counted, of single ones the windows."""
    found = found.withColumn("code", F.xxhash64("windows"))
    one = F.struct(*_KEY, "first", "windows")
    kinds = materialize(found.groupBy("anchor", "code").agg(F.count(F.lit(1)).alias("n"), F.min_by(one, "first").alias("one")))
    several = materialize(kinds.where("n > 1").select("anchor", "code"))
    whole = found.join(several, ["anchor", "code"]).select(*_KEY, F.col("first").alias("start"), (F.col("first") + F.size("windows") + (WINDOW - 1)).alias("stop"))
    single = kinds.select("anchor", "n", *[F.col(f"one.{c}") for c in (*_KEY, "first")], F.posexplode("one.windows").alias("at", "window"))
    twice = materialize(single.groupBy("anchor", "window").agg(F.sum("n").alias("places")).where("places > 1").select("anchor", "window"))
    start = F.col("first") + F.col("at")
    alone = single.where("n = 1").join(twice, ["anchor", "window"]).select(*_KEY, start, start + F.lit(WINDOW))
    return whole.union(alone)


def remove_repeated(docs: DataFrame, often: int = OFTEN) -> DataFrame:
    """(doc_id, n_words, n_removed, text), one row per row of ``docs`` (doc_id, text; other columns are not read).

    text is the kept words joined by one space. Each word inside a window whose words also start
    anywhere else, in this document or another, goes. Windows are judged on the input. Null and empty
    texts have no words; repeated rows remove each other's windows and are each returned, null ids too;
    an empty table gives none. Windows are compared by two 64-bit hashes, their own and their anchor's.
    """
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    spans = repeated_spans(rows, often)
    spans = spans.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(spans, _same(rows, spans), "left").select(rows["doc_id"], "text", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops"))
    return joined.mapInArrow(_cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words bigint, n_removed bigint, text string")


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeated(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
