"""Near-duplicates by SimHash with covering locality-sensitive hashing.

Words are joined to shingles, a fingerprint has the majority bit of the shingles' hashes, and two
texts link when their fingerprints differ in at most ``RADIUS`` bits. The candidate tables are a
covering code: bit i of the fingerprint gets a vector m(i) of RADIUS + 1 bits, and there is a table
for every nonzero vector v, keyed by the bits with odd <m(i), v>. The vectors of RADIUS differing
bits span at most RADIUS dimensions, so some v is orthogonal to all of them, and in that table the
two fingerprints have equal keys: no pair within the radius is missed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from tractloom.functions.stage import discard, materialize
from tractloom.llm.common import connected_components, read, sorted_groups

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Most fingerprints in one block of a bucket, on average; pairs of blocks are compared in one step.
BLOCK = 256
#: Bit masks of the least significant bit of each byte.
_LANES = np.uint64(0x0101010101010101)


def masks(radius: int = RADIUS) -> list[int]:
    """The 2^(radius+1) - 1 bit masks of the covering code; about half of the bits in each."""
    vectors = [1 + i % ((1 << (radius + 1)) - 1) for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, 1 << (radius + 1))]


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How often each of the 64 bits is set; 255 hashes are added at a time without carry between bytes."""
    padded = np.zeros(-(-len(hashes) // 255) * 255, dtype=np.uint64)
    padded[:len(hashes)] = hashes
    counts = np.empty((8, 8), dtype=np.int64)
    for k in range(8):
        lanes = ((padded >> np.uint64(k)) & _LANES).reshape(-1, 255).sum(axis=1, dtype=np.uint64)
        counts[:, k] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return counts.reshape(-1)


def simhash(text: str | None, shingle: int = SHINGLE, seed: int = SEED, chunk: int = 1 << 16) -> int:
    """Fingerprint of a text as a signed 64-bit number; 0 for null and for a text without words."""
    words = text.encode().lower().split() if text else []  # bytes: A-Z only, and the white space of the rule
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        h = digest(joined, seed)
        return h - (1 << 64) if h >> 63 else h
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    n = len(words) - shingle + 1
    counts = np.zeros(BITS, dtype=np.int64)
    for c in range(0, n, chunk):
        pairs = zip(starts[c:min(n, c + chunk)].tolist(), ends[c + shingle - 1:min(n, c + chunk) + shingle - 1].tolist())
        counts += _bit_counts(np.array([digest(joined[s:e], seed) for s, e in pairs], dtype=np.uint64))
    return int(np.packbits(2 * counts > n, bitorder="little").view("<i8")[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def fingerprint(text) -> F.Column:
    """Column of signed 64-bit fingerprints of a text column."""
    return _fingerprints(text)


def _cross_links(radius: int):
    """Compare two blocks of a bucket; one link for each pair of components that some pair of members joins."""

    def run(batches):
        for (_, bi, bj), g in sorted_groups(batches, ["key", "bi", "bj"]):
            fp, comp, block = (g[c].to_numpy() for c in ("fp", "comp", "block"))
            left = np.flatnonzero(block == bi)
            right = left if bi == bj else np.flatnonzero(block == bj)
            x, y = fp[left], fp[right]
            near = np.bitwise_count((x[:, None] ^ y[None, :]).view(np.uint64)) <= radius
            i, j = np.nonzero(near & (comp[left][:, None] != comp[right][None, :]))
            if len(i):
                yield pd.DataFrame({"a": comp[left][i], "b": comp[right][j]}).drop_duplicates()

    return run


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) of a partition sorted by both that share their key with a neighbour, each with the first fp of its key here.

    Rows of a partition's first and last key stay too, as a key may go on in another partition.
    """
    held, start = None, None  # the last row so far: key, fp, first, kept

    def out(key, fp, first):
        return pa.RecordBatch.from_arrays([pa.array(np.asarray(x, dtype=np.int64)) for x in (key, fp, first)], ["key", "fp", "first"])

    for batch in batches:
        key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
        if not len(key):
            continue
        start = key[0] if held is None else start
        new = np.r_[held is None or held[0] != key[0], key[1:] != key[:-1]]
        head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        first = np.where(head >= 0, fp[head], 0 if held is None else held[2])
        keep = ~new | (key == start)
        keep[:-1] |= ~new[1:]
        if held is not None and (held[3] or not new[0]):
            yield out([held[0]], [held[1]], [held[2]])
        held = key[-1], fp[-1], first[-1], bool(keep[-1])
        yield out(key[:-1][keep[:-1]], fp[:-1][keep[:-1]], first[:-1][keep[:-1]])
    if held is not None:
        yield out([held[0]], [held[1]], [held[2]])


def link_fingerprints(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(fp, root) for every fingerprint of ``fps`` that links with another; root is one per component.

    ``fps`` has distinct values in column fp. All tables together are sorted once by bucket and
    fingerprint, in ranges, so a bucket of any size is spread over tasks. Members of a bucket are first
    compared with the first of them in their range; components of those links are then found, and only
    buckets that still hold several components are compared in full, block by block, so a large group
    of close fingerprints is not compared pair by pair.
    """
    spark, run = fps.sparkSession, uuid.uuid4().hex
    tables = F.array(*[F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))) for t, m in enumerate(masks(radius))])
    rows = fps.select("fp", F.explode(tables).alias("key")).repartitionByRange("key", "fp").sortWithinPartitions("key", "fp")
    members = materialize(rows.select("key", "fp").mapInArrow(_buckets, "key long, fp long, first long"), f"{run}-members")
    differ = F.bit_count(F.col("fp").bitwiseXOR(F.col("first")))
    star = members.where(differ.between(1, radius)).select(F.col("fp").alias("a"), F.col("first").alias("b"))
    first = materialize(connected_components(star))
    open_ = members.join(first.withColumnsRenamed({"node": "fp", "component": "comp"}), "fp", "left").select("key", "fp", F.coalesce("comp", "fp").alias("comp"))
    open_ = materialize(open_, f"{run}-open")
    mixed = open_.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1"), F.count(F.lit(1)).alias("n")).where("c0 <> c1")
    mixed = materialize(mixed.select("key", F.ceil(F.col("n") / block).cast("int").alias("nb")), f"{run}-mixed")
    blocks = open_.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64("fp"), F.col("nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    tiles = blocks.withColumn("other", other).select(
        "key", "fp", "comp", "block", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    keys = ["key", "bi", "bj"]
    more = tiles.repartition(*keys).sortWithinPartitions(*keys).mapInPandas(_cross_links(radius), "a long, b long")
    edges = materialize(first.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more.distinct()))
    discard(spark, *[f"{run}-{n}" for n in ("members", "open", "mixed")])
    return connected_components(edges).withColumnsRenamed({"node": "fp", "component": "root"})


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id), one row per row of ``docs`` (doc_id, text; other columns are not read).

    component_id is the smallest doc_id of the texts reachable by links; root names the component
    also where all its ids are null. Null and empty texts have fingerprint 0 and link like any
    other; repeated rows are each returned; an empty table gives none.
    """
    prints = materialize(docs.select("doc_id", F.xxhash64("text").alias("text_hash"), fingerprint(F.col("text")).alias("fp")))
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    links = materialize(link_fingerprints(distinct.select("fp"), radius))
    rooted = materialize(distinct.join(links, "fp", "left").withColumn("root", F.coalesce("root", "fp")))
    smallest = materialize(rooted.groupBy("root").agg(F.min("rep").alias("component_id")))
    named = materialize(rooted.select("fp", "root").join(smallest, "root"))
    return prints.join(named, "fp").select("doc_id", "text_hash", "fp", "root", "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Rows of ``docs`` without near-duplicates: of each group the document with the smallest id stays, once."""
    return keep_smallest(docs, near_duplicates(docs, radius))


def keep_smallest(docs: DataFrame, found: DataFrame) -> DataFrame:
    """Of each root in ``found`` (doc_id, text_hash, root, component_id of ``docs``) the row with the smallest id, once."""
    stay = found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stay = stay.groupBy("root").agg(F.min("doc_id").alias("_id"), F.min_by("text_hash", F.coalesce("doc_id", F.lit(0))).alias("_hash")).drop("root")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].alias("_key"), F.xxhash64(docs["text"]).alias("_text"))
    joined = rows.join(materialize(stay), F.col("_key").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_hash")))
    return joined.dropDuplicates(["_key", "_text"]).select("row.*")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
