"""Pieces that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tractloom.functions.stage import materialize

#: White space of the word rule ``[^\x20\x09-\x0D]+``, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sorted_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Groups of rows with equal ``keys`` (no nulls) from a partition that is sorted by them.

    One group is held in memory at a time, so the caller must bound the groups.
    """
    open_key, parts = None, []
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch[k].to_numpy() for k in keys]
        change = np.zeros(len(batch), dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for s, e in zip(starts, [*starts[1:], len(batch)]):
            key = tuple(c[s] for c in cols)
            if key != open_key:
                if parts:
                    yield open_key, pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)
                open_key, parts = key, []
            parts.append(batch.iloc[s:e])
    if parts:
        yield open_key, pd.concat(parts, ignore_index=True) if len(parts) > 1 else parts[0].reset_index(drop=True)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node with a link; component is the smallest node reachable.

    Alternating large-star and small-star steps (Kiveris et al. 2014). Minima are aggregated before
    the shuffle and written, so both sides of each join are plain tables whose hot keys Spark can
    split. Every round is a written table, two rounds are kept, nothing comes to the driver but
    whether a round was the last.
    """
    run = uuid.uuid4().hex
    e = materialize(edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
                    .where("hi <> lo").distinct(), f"{run}-0")
    rounds = 0
    while True:
        node = F.col("node")
        ends = e.select(F.col("hi").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            e.select("lo", F.lit(0), F.lit(1)))
        untidy = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up + down > up and up > 0")
        if untidy.select(node).isEmpty():
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
                e.select("lo", "lo").distinct())
        rounds += 1
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{run}-low")
        large = materialize(both.where("v > u").join(low, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo"))
                            .distinct(), f"{run}-large")
        low = materialize(large.groupBy("hi").agg(F.min("lo").alias("m")), f"{run}-low")
        small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo").union(
            low.select("hi", "m")).distinct()
        e = materialize(small, f"{run}-{rounds % 2}")


def remainder(column: str, divisor: int) -> Column:
    """crc32 of an id written as text, modulo ``divisor``; the split between learning and held-out rows."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(divisor))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int) -> DataFrame:
    """(doc_id, text, y) of at most ``per_class`` labelled documents of either class, for which ``learn`` holds.

    Which rows are taken depends only on a hash of their ids. Only the chosen ids are joined with the texts.
    """
    known = labels.where(learn & F.col("doc_id").isNotNull() & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = known.where("y = 0").orderBy(*order).limit(per_class).union(known.where("y = 1").orderBy(*order).limit(per_class))
    return docs.select("doc_id", "text").join(materialize(chosen), "doc_id")


def fit_logistic(x: np.ndarray, y: np.ndarray, prior: np.ndarray, strength: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (last one: bias) of a logistic regression whose ridge penalty pulls towards ``prior``; Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = prior.astype(float).copy()
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + strength * (w - prior)
        hess = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
