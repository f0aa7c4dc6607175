"""Near-duplicate vectors: int8 tile products with an error bound, full precision only where it matters.

A unit vector x is stored as s * q + e with int8 codes q, scale s and a remainder e whose length is
computed exactly. Then |x.y - s_x s_y q_x.q_y| <= |s_x q_x| |e_y| + |e_x| |s_y q_y| + |e_x| |e_y|, so a pair whose
code product plus this bound is below the threshold cannot link; all others are decided by the
cosine in double precision.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from tractloom.functions.stage import materialize
from tractloom.llm.common import connected_components, read, sorted_groups

THRESHOLD = 0.98
#: Vectors in one block of a label, on average.
BLOCK = 1024
#: Rounding of the bound itself and of the code products' scaling.
SLACK = 1e-9
#: Pairs recomputed in double precision at a time.
PAIRS = 1 << 16


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes (as floats, for the matrix product), scales, lengths of the coded part and of the remainder."""
    scale = np.abs(unit).max(axis=1) / 127
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    coded = codes * scale[:, None]
    # products of 8-bit codes stay whole in float32 up to 2^24
    exact = np.float32 if unit.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return codes.astype(exact), scale, np.linalg.norm(coded, axis=1), np.linalg.norm(unit - coded, axis=1)


def units(v: np.ndarray) -> np.ndarray:
    """Unit vectors; components are first scaled by a power of two, which changes none of their digits, so no length overflows or vanishes."""
    v = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1])
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def links(x: np.ndarray, y: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of rows of ``x`` and ``y`` whose cosine is at least ``threshold``."""
    ux, uy = units(x), units(y)
    (qx, sx, cx, ex), (qy, sy, cy, ey) = quantise(ux), quantise(uy)
    upper = (qx @ qy.T) * np.outer(sx, sy) + np.outer(cx, ey) + np.outer(ex, cy) + np.outer(ex, ey)
    i, j = np.nonzero(upper >= threshold - SLACK)
    good = np.empty(len(i), dtype=bool)
    for s in range(0, len(i), PAIRS):
        part = slice(s, s + PAIRS)
        good[part] = np.einsum("ij,ij->i", ux[i[part]], uy[j[part]]) >= threshold
    return i[good], j[good]


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links a[k] - b[k]: at most one edge less than there are vectors."""
    parent: dict[int, int] = {}

    def root(v: int) -> int:
        while (p := parent.setdefault(v, v)) != v:
            parent[v] = v = parent[p]
        return v

    keep_a, keep_b = [], []
    for u, v in zip(a.tolist(), b.tolist()):
        ru, rv = root(u), root(v)
        if ru != rv:
            parent[max(ru, rv)] = min(ru, rv)
            keep_a.append(u)
            keep_b.append(v)
    return keep_a, keep_b


def _tile(threshold: float):
    """For each pair of blocks: links per vector (b null) and a spanning forest of the links (n null)."""

    def run(batches):
        for (_, _, bi, bj, _), g in sorted_groups(batches, ["label", "dim", "bi", "bj", "tile"]):
            packed = {int(k): (np.asarray(ids), np.frombuffer(bytes(v), dtype="<f8").reshape(len(ids), -1))
                      for k, ids, v in zip(g["block"], g["ids"], g["vectors"])}
            ids, x = packed[int(bi)]
            ids2, y = packed[int(bj)]
            i, j = links(x, y, threshold)
            if bi == bj:
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            a, b = ids[i], ids2[j]
            nodes, n = np.unique(np.concatenate([a, b]), return_counts=True)
            fa, fb = _forest(a, b)
            yield pd.DataFrame({"a": np.concatenate([nodes, fa]).astype("int64"),
                                "b": pd.array([None] * len(nodes) + fb, dtype="Int64"),
                                "n": pd.array([*n.tolist(), *[None] * len(fa)], dtype="Int64")})

    return run


def _pack(batches):
    """Blocks of vectors as one row each: ids and the vectors' doubles, row after row."""
    for (label, dim, block), g in sorted_groups(batches, ["label", "dim", "block"]):
        vectors = np.stack(g["embedding"].to_numpy()).astype("<f8")
        yield pd.DataFrame({"label": [label], "dim": [dim], "block": [block], "ids": [g["vec_id"].tolist()], "vectors": [vectors.tobytes()]})


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector of ``vectors`` (vec_id, embedding, label).

    Vectors are compared when they have equal labels and equal lengths, in blocks: hash blocks of
    ``block`` vectors, one task step for each pair of blocks, so a label with a third of all rows
    is spread like any other. Pairs stay inside the step; it returns a count per vector and a
    spanning forest. Rows of one vec_id are one vector (the smallest of them by label and values).
    A null vec_id, label or vector, a zero vector and null or non-finite components link with
    nothing: n_links 0 and component_id = vec_id. Without a vec_id, component_id is null and kept true.
    """
    dim = F.size("embedding")
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (dim > 0)
              & ~F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
              & F.exists("embedding", lambda v: v != 0))
    one = vectors.select("vec_id", F.struct("label", "embedding").alias("v")).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = materialize(one.select("vec_id", "v.label", "v.embedding"))
    ready = rows.where(F.coalesce(usable, F.lit(False))).withColumn("dim", dim)
    sizes = materialize(ready.groupBy("label", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("nb")))
    keys = ["label", "dim", "block"]
    blocked = (ready.join(sizes, ["label", "dim"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("nb")).cast("int"))
               .repartition(*keys).sortWithinPartitions(*keys).select("vec_id", "embedding", *keys))
    label = vectors.schema["label"].dataType.simpleString()
    packed = materialize(blocked.mapInPandas(_pack, f"label {label}, dim int, block int, ids array<long>, vectors binary"))
    other = F.explode(F.sequence(F.lit(0), F.col("nb") - 1))
    pair = ["label", "dim", "bi", "bj"]
    tiles = packed.join(sizes, ["label", "dim"]).withColumn("other", other).select(
        *keys, "ids", "vectors", F.least("block", "other").alias("bi"), F.greatest("block", "other").alias("bj"))
    tiles = tiles.withColumn("tile", F.xxhash64(*pair)).repartition(*pair).sortWithinPartitions(*pair)
    found = materialize(tiles.mapInPandas(_tile(threshold), "a long, b long, n long"))
    counts = found.where("b is null").groupBy(F.col("a").alias("vec_id")).agg(F.sum("n").alias("n_links"))
    parts = connected_components(found.where("b is not null")).withColumnsRenamed({"node": "vec_id", "component": "component_id"})
    out = rows.select("vec_id").join(counts, "vec_id", "left").join(parts, "vec_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def op1_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))


#: SQL twin of the query; the reachable set is found by a recursive walk over the links.
SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (
  SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS norm FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (
  SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
  WHERE list_dot_product(p.e, q.e) / (p.norm * q.norm) >= 98e-2),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS c FROM link GROUP BY a)
SELECT vec_id, coalesce(n.c, 0) AS n_links, least(vec_id, coalesce(low.m, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(low.m, vec_id)) AS kept
FROM v LEFT JOIN low ON low.a = vec_id LEFT JOIN n ON n.a = vec_id
"""
