"""Byte-level BPE: encoding by a priority queue of merge ranks, decoding by concatenation.

A pre-token's bytes form a doubly linked list of symbols. All neighbouring pairs that have a merge
rank are in a queue; the lowest rank (leftmost first) is merged, which relinks the list and queues
the two new pairs. Queue entries whose symbols have meanwhile changed are skipped when they come up.
Encoded pieces between spaces are kept per Python worker, up to a bound.
"""

from __future__ import annotations

import functools
import heapq
import json
import re
import struct

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from tractloom.llm.common import read

VOCABULARY = "byte_bpe_50k.json"
#: Encoded pieces in a generation that a worker keeps; rows of one output batch.
CACHE, ROWS = 500_000, 256
#: Room for a symbol's number behind a rank.
SYMBOL_BITS = 20
SYMBOL = (1 << SYMBOL_BITS) - 1
#: The pre-tokens of the vocabulary: contractions, letters, numbers, other signs, white space. Fixed value.
SPACES = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PRETOKENS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: printable ones for themselves, others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + n): b for n, b in enumerate(hidden)}}


class Bpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab = spec["model"]["vocab"]
        self.bytes_of = {i: bytes(alphabet[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        strings = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
        self.sizes = np.array([len(x) for x in strings])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(strings), dtype=np.uint8)
        self.single = [vocab[c] for c, _ in sorted(alphabet.items(), key=lambda cb: cb[1])]
        # per left symbol: right symbol -> rank and merged symbol in one number, so that numbers sort by rank
        self.merges: list[dict[int, int]] = [{} for _ in range(max(vocab.values()) + 1)]
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[vocab[a]].setdefault(vocab[b], rank << SYMBOL_BITS | vocab[a + b])
        self.pretokens = regex.compile(PRETOKENS)
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # white space before a space that does not start a word: such runs are only cut by the whole pattern
        self.tangled = re.compile(r"\s (?=\s|$)|  ")
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.ends = {c: self._pack([self.single[ord(c)]]) for c in ".,"}

    def merge(self, data: bytes) -> list[int]:
        """Symbols of one pre-token after all merges.

        A queue entry is a pair's rank and merged symbol, then its place. It is stale if the pair at that place is now another one.
        """
        symbols = [self.single[b] for b in data]
        n, merges = len(symbols), self.merges
        place = n.bit_length()
        queue = [v << place | i for i in range(n - 1) if (v := merges[symbols[i]].get(symbols[i + 1]))]
        if not queue:
            return symbols
        heapq.heapify(queue)
        after, before, mask = list(range(1, n + 1)), list(range(-1, n - 1)), (1 << place) - 1
        while queue:
            entry = heapq.heappop(queue)
            i, pair = entry & mask, entry >> place
            j = after[i]
            if symbols[i] < 0 or j >= n or merges[symbols[i]].get(symbols[j]) != pair:
                continue
            symbols[i] = merged = pair & SYMBOL
            symbols[j] = -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if v := merges[merged].get(symbols[k]):
                    heapq.heappush(queue, v << place | i)
            if (h := before[i]) >= 0 and (v := merges[symbols[h]].get(merged)):
                heapq.heappush(queue, v << place | h)
        return [s for s in symbols if s >= 0]

    def _segment(self, text: str) -> list[int]:
        return [s for t in self.pretokens.findall(text) for s in self.merge(t.encode())]

    def _whole(self, text: str) -> bytes:
        parts = self.split_special.split(text) if self.split_special else [text]
        ids = [s for p in parts for s in ([self.special[p]] if p in self.special else self._segment(p))]
        return self._pack(ids)

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}i", *ids)

    def _piece(self, piece: str) -> bytes:
        """Ids of a piece that is not among the recent ones.

        Two generations are kept: what the older one still has moves to the younger, and the older is dropped when
        the younger is full, so pieces that keep coming stay.
        """
        ids = self.older.get(piece)
        if ids is None:
            if piece[-1] in self.ends and piece[-2:-1].isalpha():  # a sign after a letter is a pre-token of its own
                return (self.pieces.get(piece[:-1]) or self._piece(piece[:-1])) + self.ends[piece[-1]]
            plain = piece[0] == " " and piece[1:].isalpha()  # one pre-token: a space and letters
            ids = self._pack(self.merge(piece.encode()) if plain else self._segment(piece))
        if len(self.pieces) >= CACHE:
            self.older, self.pieces = self.pieces, {}
        self.pieces[piece] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        if not text:
            return b""
        if any(s in text for s in self.special) or self.tangled.search(text):
            return self._whole(text)
        first, *rest = text.split(" ")
        pieces = [first] if first else []
        pieces += [" " + p for p in rest]
        return b"".join([self.pieces.get(p) or self._piece(p) for p in pieces])

    def decode(self, ids) -> str:
        return self.concatenate(np.asarray(ids, dtype=np.int64))[0].tobytes().decode("utf-8", errors="replace")

    def concatenate(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The vocabulary strings of ``ids`` one after the other as bytes, and where each of them ends."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + sizes, sizes)
        return self.letters[place], ends


@functools.lru_cache(maxsize=4)
def load(path: str) -> Bpe:
    return Bpe(path)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids: array of integers) for every row of ``docs`` (doc_id, text; other columns are not read).

    Null and empty texts have no ids. Strings of special tokens inside a text become those tokens, as the
    vocabulary file says. Repeated rows are each encoded.
    """

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                encoded = [bpe.encode(t) for t in part.column(1).to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(e) // 4 for e in encoded])]).astype(np.int32)
                values = pa.array(np.frombuffer(b"".join(encoded), dtype="<i4"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def _texts(bpe: Bpe, lists: pa.ListArray) -> pa.StringArray:
    """Decoded texts of a column of id lists; a null list gives an empty text."""
    letters, ends = bpe.concatenate(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
    counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(counts)]]).astype(np.int64)
    data = letters.tobytes()
    first = letters[bounds[:-1][bounds[:-1] < len(letters)]]
    try:
        if ((first & 0xC0) == 0x80).any():
            raise UnicodeDecodeError("utf-8", b"", 0, 0, "a text starts inside a character")
        data.decode("utf-8")
        return pa.LargeStringArray.from_buffers(len(lists), pa.py_buffer(bounds), pa.py_buffer(data)).cast(pa.string())
    except UnicodeDecodeError:  # ids that cut a character in two
        return pa.array([data[a:b].decode("utf-8", errors="replace") for a, b in zip(bounds[:-1], bounds[1:])], type=pa.string())


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) for every row of ``encoded`` (doc_id, ids): the vocabulary strings of the ids, concatenated; null ids give an empty text."""

    def run(batches):
        bpe = load(path)
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(bpe, part.column(1))], names=["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path(VOCABULARY)
    both = decode(encode(read(spark, sf_dir, "documents"), path), path)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
