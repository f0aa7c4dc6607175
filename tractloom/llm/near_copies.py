"""Near copies by Jaccard similarity of word shingles.

Sets of shingles are gathered to families, so that two similar sets are always in the same one, and
compared in whole only there. Families come from two sorts of hash tables:

* covering tables of SimHash fingerprints (``op10_simhash``), made of the set's own shingles, link
  what differs in few bits. Sets of similarity 0.8 may differ in more bits than a bounded number of
  such tables covers, so these tables alone would lose pairs.
* Tables of neighbours. Every set has a head, its ``HEAD`` least hashes; its keys are the pairs of
  neighbours in that order. Of the least ``HEAD`` hashes of the union of two sets of similarity t each
  lies in both with probability t, and two neighbours there that both sets hold are neighbours in
  both. At 0.8 there are none among 64 with a probability below 2^-61. Where both heads are whole sets
  there always are some: b hashes that only one of them holds split the at least 4 b others into at
  most b + 1 parts. Sets that share a key are in one family if their heads share ``MEET`` hashes, as
  those of a similar pair do, but for a probability below 2^-50.

A family of any size is compared in tiles of bounded memory, and a tile tells no pairs but a spanning
forest of its links: rows are in proportion to sets however many pairs of a group are similar, or nearly so.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tractloom.functions.stage import discard, materialize
from tractloom.llm.common import connected_components
from tractloom.llm.op10_simhash import _bit_counts, _buckets, keep_smallest, link_fingerprints

#: Shingles of five words; similarity of at least 4 / 5.
SHINGLE = 5
SIMILARITY = (4, 5)
SEED = 42
#: Least hashes by which sets meet, by which they are judged first, and how many of these a similar pair shares.
KEYS, HEAD, MEET = 64, 64, 21
#: Most sets, and most hashes, in one block of a bucket or family, on average.
BLOCK, VOLUME = 2048, 1 << 20
#: Hashes that one step of a comparison gathers, about.
STEP = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, dtype=np.int64)
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], dtype=np.uint64)
    n = max(1, len(h) - k + 1)
    out = np.zeros(n, dtype=np.uint64)
    for i in range(min(k, len(h))):
        out = _mix(out * _ODD + h[i:i + n] + np.uint64(1))
    return np.unique(out.view(np.int64))


def set_id(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


def fingerprint(hashes: np.ndarray, chunk: int = 1 << 16) -> int:
    """SimHash of a set of hashes as a signed 64-bit number; 0 for the empty set."""
    counts = sum((_bit_counts(hashes[c:c + chunk].view(np.uint64)) for c in range(0, len(hashes), chunk)), np.zeros(64, dtype=np.int64))
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def neighbours(head: np.ndarray) -> np.ndarray:
    """A key for every two neighbours of a sorted head."""
    h = head.view(np.uint64)
    return _mix(_mix(h[:-1]) * _ODD + h[1:]).view(np.int64)


def similar(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m members that share ``both`` are similar enough."""
    return both * SIMILARITY[1] >= (n + m - both) * SIMILARITY[0]


def judge_heads(both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether two sets may be similar enough by what their heads share; exact where both are whole sets."""
    small = (n <= HEAD) & (m <= HEAD)
    return np.where(small, similar(both, n, m), both >= MEET)


def shared(lists: np.ndarray, ends: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many members sets i[x] and j[x] share; set s has the distinct members ``lists[ends[s]:ends[s + 1]]``."""
    size = np.diff(ends)
    cost = np.cumsum(size[i] + size[j])
    out = np.empty(len(i), dtype=np.int64)
    start = 0
    while start < len(i):
        stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + STEP)))
        a, b = i[start:stop], j[start:stop]
        sets = np.concatenate([a, b])
        length = size[sets]
        first = np.cumsum(length) - length
        place = np.arange(length.sum()) - np.repeat(first - ends[sets], length)
        pair = np.repeat(np.tile(np.arange(len(a)), 2), length)
        values = lists[place]
        order = np.lexsort((values, pair))
        equal = (values[order][1:] == values[order][:-1]) & (pair[order][1:] == pair[order][:-1])
        out[start:stop] = np.bincount(pair[order][1:][equal], minlength=len(a))
        start = stop
    return out


def overlaps(lists: np.ndarray, ends: np.ndarray, x: np.ndarray, y: np.ndarray, below: int | None = None) -> np.ndarray:
    """How many members each set of ``x`` shares with each of ``y``; those that few hold are counted pair by pair, others by products of 0-1 matrices.

    With ``below`` only members less than that count.
    """
    both = np.concatenate([x, y])
    length = np.diff(ends)[both]
    row = np.repeat(np.arange(len(both)), length)
    first = np.cumsum(length) - length
    values = lists[np.arange(len(row)) - np.repeat(first - ends[both], length)]
    if below is not None:
        row, values = row[values < below], values[values < below]
    order = np.argsort(values, kind="stable")  # rows stay in order: of each value those of x come first
    row, values = row[order], values[order]
    number = np.cumsum(np.r_[False, values[1:] != values[:-1]]) if len(values) else np.empty(0, dtype=np.int64)
    left = row < len(x)
    in_x, in_y = np.bincount(number[left], minlength=1 + number.max(initial=-1)), np.bincount(number[~left], minlength=1 + number.max(initial=-1))
    out = np.zeros((len(x), len(y)), dtype=np.float32)
    dense = in_x * in_y * 512 >= len(x) * len(y)
    few = np.flatnonzero((in_x * in_y > 0) & ~dense)
    begin = np.cumsum(in_x + in_y) - in_x - in_y
    cost = np.cumsum(in_x[few] * in_y[few])
    for at in np.split(few, np.searchsorted(cost, np.arange(STEP, cost[-1], STEP))) if len(few) else []:
        count = in_x[at] * in_y[at]
        place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        start, wide, tall = np.repeat(begin[at], count), np.repeat(in_y[at], count), np.repeat(in_x[at], count)
        np.add.at(out, (row[start + place // wide], row[start + tall + place % wide] - len(x)), 1)
    dense &= in_x * in_y > 0
    chosen = dense[number]
    row, number = row[chosen], (np.cumsum(dense) - 1)[number[chosen]]
    for s in range(0, int(number[-1]) + 1 if len(number) else 0, 2048):
        lo, hi = np.searchsorted(number, [s, s + 2048])
        one = np.zeros((len(both), min(2048, int(number[-1]) + 1 - s)), dtype=np.float32)
        one[row[lo:hi], number[lo:hi] - s] = 1
        out += one[:len(x)] @ one[len(x):].T
    return out.astype(np.int32)


def forest(i: np.ndarray, j: np.ndarray, nodes: int) -> np.ndarray:
    """For each of ``nodes`` the least one of its component by the links (i, j)."""
    least = np.arange(nodes)
    while True:
        a, b = least[i], least[j]
        differ = a != b
        if not differ.any():
            return least
        i, j, a, b = i[differ], j[differ], a[differ], b[differ]
        np.minimum.at(least, np.maximum(a, b), np.minimum(a, b))
        while (least[least] != least).any():
            least = least[least]


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = [shingles(t.as_py()) for t in batch.column("text")]
        heads = [s[:HEAD] for s in sets]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array([set_id(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()),
             pa.array([fingerprint(s) for s in sets], pa.int64()), pa.array(heads, pa.list_(pa.int64()))], ["doc_id", "text_hash", "sid", "n", "fp", "head"])


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys = [neighbours(np.array(h, dtype=np.int64)[:KEYS]) for h in batch.column("head").to_pylist()]
        sid = np.repeat(batch.column("sid").to_numpy(), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys or [sid])), pa.array(sid)], ["key", "fp"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kept = ["sid", "n", "family", "nb"]
    for batch in batches:
        sets = pa.array([shingles(t.as_py()) for t in batch.column("text")], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), sets], [*kept, "members"])


def _fits(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of n and m members may be similar by these counts."""
    return (n * SIMILARITY[1] >= m * SIMILARITY[0]) & (m * SIMILARITY[1] >= n * SIMILARITY[0])


def _columns(t: pa.Table) -> tuple:
    """sid, n, side, members and ends of a table sorted by tile and side, and where tiles begin and end."""
    t = t.combine_chunks()
    tile, lists = t["tile"].to_numpy(), t["members"].chunk(0)
    ends = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())]).astype(np.int64)
    return t["sid"].to_numpy(), t["n"].to_numpy().astype(np.int32), t["side"].to_numpy(), lists.flatten().to_numpy(), ends, np.flatnonzero(np.r_[True, tile[1:] != tile[:-1], True])


def _star_links(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links of a tile's first set with its others by their heads, for all tiles at once."""
    sid, n, _, members, ends, bounds = _columns(t)
    centre = np.repeat(bounds[:-1], np.diff(bounds))
    at = np.flatnonzero((sid != sid[centre]) & _fits(n, n[centre]))
    at = at[judge_heads(shared(members, ends, centre[at], at), n[centre[at]], n[at])]
    yield sid[centre[at]], sid[at]


def _tile_links(judge):
    """Links of sets of a tile's two sides that are in different components: of the pairs that ``judge`` accepts a spanning forest."""

    def run(t: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        sid, n, side, members, ends, bounds = _columns(t)
        comp = t["comp"].to_numpy()
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            one = side[s] == side[e - 1]  # sides are sorted: one side only means a block with itself
            x = np.arange(s, e) if one else np.arange(s, s + int(np.searchsorted(side[s:e], side[e - 1])))
            y = x if one else np.arange(x[-1] + 1, e)
            near = (comp[x][:, None] != comp[y][None, :]) & _fits(n[x][:, None], n[y][None, :])
            near = np.triu(near, 1) if one else near
            if near.any():
                near &= judge(overlaps(members, ends, x, y), n[x][:, None], n[y][None, :])
                i, j = np.nonzero(near)
                least = s + forest(x[i] - s, y[j] - s, e - s)
                linked = np.flatnonzero(least != np.arange(s, e))
                yield sid[least[linked]], sid[s + linked]

    return run


def _by_tiles(links):
    """``links`` of the tiles of a partition that is sorted by tile and side; a tile is taken up when all its rows have come, many small ones at once."""

    def told(t: pa.Table) -> Iterator[pa.RecordBatch]:
        for a, b in links(t):
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            tile = batch.column("tile").to_numpy()
            last = int(np.flatnonzero(tile != tile[-1])[-1]) + 1 if tile[0] != tile[-1] else 0
            if held and held[-1].column("tile")[-1].as_py() != tile[last]:
                yield from told(pa.Table.from_batches([*held, batch.slice(0, last)]))
                held = []
            elif last:
                yield from told(pa.Table.from_batches([batch.slice(0, last)]))
            held.append(batch.slice(last))
        if held:
            yield from told(pa.Table.from_batches(held))

    return run


def _tiles(rows: DataFrame, group: str) -> DataFrame:
    """Rows of each ``group`` in ``nb`` blocks, once for every pair of blocks that they are in."""
    rows = rows.withColumn("side", F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    tile = F.xxhash64(F.col(group), F.least("side", "other"), F.greatest("side", "other")).alias("tile")
    return rows.select("sid", "n", "comp", "side", tile, "members").repartition("tile").sortWithinPartitions("tile", "side")


def near_copies(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(doc_id, text_hash, root, component_id), one row per row of ``docs`` (doc_id, text; other columns are not read).

    component_id is the smallest doc_id of the texts reachable by links of similar texts; texts with
    equal sets count as one, those without words (null and empty ones too) are one set. Null ids are
    never the smallest unless all of a group are null; repeated rows are each returned; an empty table
    gives none. Whatever a text's length, no more than its head meets other texts, and its whole set
    travels only to the tiles in which it may have a similar partner.

    Members of a bucket are first judged with one of them; components of those links and of the
    fingerprints' links are then found, and only buckets with several components are judged further,
    block by block. The components then found are the families.
    """
    spark, run = docs.sparkSession, uuid.uuid4().hex
    stage = lambda df, name: materialize(df, f"{run}-{name}")
    drop = lambda *names: discard(spark, *[f"{run}-{n}" for n in names])
    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    prints = stage(texts.mapInArrow(_prints, f"doc_id {kind}, text_hash long, sid long, n int, fp long, head array<long>"), "prints")
    one = F.min(F.struct("text_hash", "n", "fp", "head")).alias("one")
    kinds = stage(prints.groupBy("sid").agg(F.min("doc_id").alias("rep"), one).select("sid", "rep", "one.*"), "kinds")
    ids = stage(prints.select("doc_id", "text_hash", "sid"), "ids")
    drop("prints")

    heads = kinds.select("sid", "n", F.col("head").alias("members"))
    prior = stage(_print_links(kinds.select("sid", "fp")), "prior")
    rows = kinds.select("sid", "head").mapInArrow(_keys, "key long, fp long").repartition("key").sortWithinPartitions("key", "fp")
    members = stage(rows.mapInArrow(_buckets, "key long, fp long, first long").withColumnsRenamed({"fp": "sid", "first": "c"}), "members")
    pairs = stage(members.where("sid <> c").select("sid", "c").distinct(), "pairs")
    parts = stage(pairs.groupBy("c").agg(_blocks(F.count(F.lit(1)), block).alias("nb")), "parts")
    part = F.pmod(F.xxhash64("sid"), F.col("nb")).cast("int")
    star = pairs.join(parts, "c").select("sid", F.xxhash64("c", part).alias("tile"), F.lit(1).alias("side")).union(
        parts.select(F.col("c").alias("sid"), "c", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("part")).select("sid", F.xxhash64("c", "part"), F.lit(0)))
    star = star.join(heads, "sid").select("sid", "n", "side", "tile", "members").repartition("tile").sortWithinPartitions("tile", "side")
    near = stage(star.mapInArrow(_by_tiles(_star_links), "a long, b long").union(prior), "near")
    first = stage(connected_components(near).withColumnsRenamed({"node": "sid", "component": "comp"}), "first")
    open_ = stage(members.join(first, "sid", "left").select("key", "sid", F.coalesce("comp", "sid").alias("comp")), "open")
    drop("members", "pairs", "parts", "prior", "near")
    mixed = open_.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("size")).where("c0 <> c1")
    mixed = stage(mixed.select("key", _blocks(F.col("size"), block).alias("nb")), "mixed")
    more = _tiles(open_.join(mixed, "key").join(heads, "sid"), "key").mapInArrow(_by_tiles(_tile_links(judge_heads)), "a long, b long")
    more = stage(first.select(F.col("sid").alias("a"), F.col("comp").alias("b")).union(more), "more")
    families = stage(connected_components(more).withColumnsRenamed({"node": "sid", "component": "family"}), "families")
    drop("open", "mixed", "first", "more")

    wanted = stage(families.join(kinds.select("sid", "n", "text_hash"), "sid"), "wanted")
    sizes = wanted.groupBy("family").agg(F.greatest(_blocks(F.count(F.lit(1)), block), _blocks(F.sum("n"), VOLUME)).alias("nb"))
    wanted = stage(wanted.join(sizes, "family"), "sized")
    whole = texts.select("text_hash", "text").join(wanted, "text_hash").dropDuplicates(["text_hash"])
    whole = whole.mapInArrow(_sets, "sid long, n int, family long, nb int, members array<long>").withColumn("comp", F.col("sid"))
    edges = stage(_tiles(whole, "family").mapInArrow(_by_tiles(_tile_links(similar)), "a long, b long"), "edges")
    links = stage(connected_components(edges).withColumnsRenamed({"node": "sid", "component": "root"}), "links")
    drop("families", "wanted", "sized", "edges")
    rooted = stage(kinds.select("sid", "rep").join(links, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "rooted")
    smallest = stage(rooted.groupBy("root").agg(F.min("rep").alias("component_id")), "smallest")
    named = stage(rooted.select("sid", "root").join(smallest, "root"), "named")
    drop("kinds", "links", "rooted", "smallest")
    return ids.join(named, "sid").select("doc_id", "text_hash", "root", "component_id")


def _blocks(count: Column, block: int) -> Column:
    return F.ceil(count / block).cast("int")


def _print_links(prints: DataFrame) -> DataFrame:
    """Links (a, b) of sets (sid, fp) whose fingerprints are linked by covering tables, or equal, to the least such set."""
    linked = prints.join(link_fingerprints(prints.select("fp").distinct()), "fp", "left").select("sid", F.coalesce("root", "fp").alias("root"))
    linked = materialize(linked)
    least = linked.groupBy("root").agg(F.min("sid").alias("a"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return linked.join(least, "root").where("sid <> a").select("a", F.col("sid").alias("b"))


def keep_one(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without near copies: of each group the document with the smallest id stays, once."""
    return keep_smallest(docs, near_copies(docs))
