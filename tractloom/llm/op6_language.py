"""Language identification by compression.

For every language a raw-content zstandard dictionary is filled with text of that language. A text
is compressed with each dictionary, block by block, and belongs to the language whose dictionary
makes it smallest; where the second-best language is nearly as small, the answer is marked as rejected.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from tractloom.functions.stage import materialize
from tractloom.llm.common import read, remainder

DIVISOR, HELD_OUT = 4, 2
#: Learning texts of a language, and how many characters of each, from a hash-chosen place on, go into its dictionary.
TEXTS, SLICE = 128, 1024
LEVEL = 9
#: Bytes compressed at a time; dictionaries tell languages apart best while a block is short.
BLOCK = 2048
#: The smallest size must be this much below the second smallest.
MARGIN = 0.01
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")


def dictionaries(docs: DataFrame, texts: int = TEXTS, size: int = SLICE) -> dict[str, bytes]:
    """Dictionary content per language from the learning rows of ``docs`` (doc_id, text, lang).

    One text with a letter for each of ``texts`` hash classes of ids, the one with the smallest hash: a
    bounded, deterministic sample per language that needs no language's rows in one place. Its slice
    starts at a hash-chosen place of the whole text, or at the first letter where that slice has none,
    so a language with any letter has a dictionary; of several texts of one id the least slice is taken.
    """
    h = F.xxhash64("doc_id")
    learn = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}") & (remainder("doc_id", DIVISOR) != HELD_OUT))
    chosen = learn.groupBy("lang", F.pmod(h, F.lit(texts)).alias("part")).agg(F.min_by("doc_id", h).alias("doc_id")).select("lang", "doc_id")
    places = F.greatest(F.lit(1), F.char_length("text") - size + 1)
    at = F.substring(F.col("text"), (F.pmod(F.xxhash64("doc_id", "text"), places) + 1).cast("int"), F.lit(size))
    first = F.substring(F.col("text"), F.regexp_instr("text", F.lit(r"\p{L}")), F.lit(size))
    rows = learn.select("lang", "doc_id", "text").join(materialize(chosen), ["lang", "doc_id"]).select(
        "lang", "doc_id", F.when(at.rlike(r"\p{L}"), at).otherwise(first).alias("text")).groupBy("lang", "doc_id").agg(F.min("text").alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(rows.collect(), key=lambda r: (r["lang"], r["doc_id"], r["text"])):
        out.setdefault(r["lang"], []).append(r["text"].lower())
    return {lang: "\n".join(parts).encode() for lang, parts in out.items() if any(map(_LETTER.search, parts))}


def compressors(content: dict[str, bytes], level: int = LEVEL) -> dict[str, zstandard.ZstdCompressor]:
    out = {}
    for lang, data in sorted(content.items()):
        d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=level)
        out[lang] = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
    return out


def classify(text: str | None, by_lang: dict[str, zstandard.ZstdCompressor], block: int = BLOCK, margin: float = MARGIN) -> tuple[str, float, bool]:
    """(language, score, rejected) of a whole text; the first language in alphabetical order wins a tie."""
    if not text or not by_lang or not _LETTER.search(text):
        return UNKNOWN, 0.0, True
    data = text.lower().encode()
    blocks = [data[s:s + block] for s in range(0, len(data), block)]
    sizes = {lang: sum(len(c.compress(b)) for b in blocks) for lang, c in by_lang.items()}
    best = min(sizes, key=lambda lang: (sizes[lang], lang))
    rest = sorted(s for lang, s in sizes.items() if lang != best)
    score = 1 / sum(math.exp(-min(700.0, (s - sizes[best]) * math.log(2))) for s in sizes.values())
    return best, score, bool(rest) and rest[0] - sizes[best] < margin * rest[0]


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) for every row of ``docs`` (doc_id, text, lang; other columns are not read).

    Null texts and texts without a letter are ``und`` with score 0, as is everything where no row can be
    learned from; repeated rows are each classified. A rejected text still names its best language.
    """
    content = dictionaries(docs)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by_lang = compressors(content)
        for texts in batches:
            yield pd.DataFrame([classify(t, by_lang) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.select("doc_id", predict(docs["text"]).alias("found")).select("doc_id", "found.*")


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents")).select("doc_id", (remainder("doc_id", DIVISOR) == HELD_OUT).alias("held_out"), "lang_pred", "score", "rejected")
