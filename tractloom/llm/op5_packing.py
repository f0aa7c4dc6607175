"""Pack documents into training sequences: first-fit decreasing with a tournament tree, in random groups.

Documents are encoded and cut into pieces of at most one sequence. Pieces are dealt to random groups
of bounded size, and each group is packed on its own: the longest piece first, each into the first
sequence with enough room, which a tournament tree over the free room finds in logarithmic time.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from tokenizers import Tokenizer

from tractloom.functions.stage import materialize
from tractloom.llm.common import read, sorted_groups

VOCABULARY = "word_bpe_49k.json"
LENGTH = 4096
END_ID = 2
#: Pieces of a group, on average.
GROUP = 4096
SEED = 11
#: Encoded words in a generation that a worker keeps; rows of one output batch.
CACHE, ROWS = 400_000, 256


class Words:
    """Encodes whole texts word by word; this vocabulary's pre-tokens never reach over white space."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends = {c: self._library(c) for c in ".,"}

    def _library(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word that is not among the recent ones.

        Two generations are kept: what the older one still has moves to the younger, and the older is dropped when the
        younger is full. A sign after a letter is a pre-token of its own, and plain letters have the ids of their small forms.
        """
        ids = self.older.get(word)
        if ids is None:
            if word[-1:] in self.ends and word[-2:-1].isalpha():
                return (self.known.get(word[:-1]) or self._word(word[:-1])) + self.ends[word[-1]]
            if word.isascii() and word.isalpha() and word != (small := word.lower()):
                return self.known.get(small) or self._word(small)
            ids = self._library(word)
        if len(self.known) >= CACHE:
            self.older, self.known = self.known, {}
        self.known[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers; none for null."""
        if not text:
            return b""
        return b"".join([self.known.get(w) or self._word(w) for w in text.replace("\n", " ").split(" ") if w])


@functools.lru_cache(maxsize=4)
def load(path: str) -> Words:
    return Words(path)


def pieces(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens, row) of ``docs`` (doc_id, text); a null text has the end id only.

    A document is cut after every ``length`` ids. ``row`` numbers the rows of a partition, so that repeated rows differ.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches):
        words, row = load(path), 0
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                out: list[tuple] = []
                for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = words.encode(text) + end
                    n = len(ids) // 4
                    out += [(doc_id, k, min(length, n - k), zlib.crc32(ids[4 * k:4 * (k + length)]), n, row) for k in range(0, n, length)]
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in zip(*out)],
                                                 names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "row"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, row long")


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every item; bins are numbered from 0 in the order of their opening.

    The tree's leaves are the free room of all bins, in order; an inner node has the larger room of its
    two children, so the way down to the first bin with enough room turns left wherever the left side has it.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        size, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - tree[node]
        tree[node] -= size
        while node > 1:
            node //= 2
            larger = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == larger:
                break
            tree[node] = larger
    return bins, offsets


def _pack(length: int):
    def run(batches):
        for (group,), g in sorted_groups(batches, ["group"]):
            g = g.sort_values(["doc_id", "start", "row"], kind="stable", na_position="first")
            bins, offsets = first_fit_decreasing(g["length"].to_numpy(), length)
            yield g.assign(sequence_id=(int(group) << 24) + bins, offset=offsets)

    return run


def pack(docs: DataFrame, path: str, length: int = LENGTH, end_id: int = END_ID, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) for every piece of ``docs`` (doc_id, text).

    Null and empty texts are one piece with the end id. Repeated rows are each packed. An empty table
    gives no rows. Groups are drawn by a hash, so no id, source or kind of text fills a group.
    """
    cut = materialize(pieces(docs, path, length, end_id))
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "start", "row", F.lit(SEED)), F.lit(groups)))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
    packed = dealt.repartition("group").sortWithinPartitions("group").mapInPandas(_pack(length), f"{schema}, sequence_id long, offset long")
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))
