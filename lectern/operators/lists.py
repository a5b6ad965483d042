"""Approximate retrieval: inverted lists over learned centroids inside each lecture index."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.operators.retrieve import knn_topk, matrix
from lectern.tables import keep, let_go, recorded

#: Lists of an index at most; rows that its centroids are learned from, for each list; rounds of learning.
MOST_LISTS, SAMPLED, ROUNDS = 1024, 64, 10
#: Rows of a part that is dealt to lists at once.
PART_ROWS = 20_000
KEYS = ("video_id", "store_mode")


def spherical_means(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """k unit vectors: rows drawn at random, then again and again the means of the rows nearest to each (by inner product); a vector
    without rows takes the place of the row that is farthest from its own."""
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]]
    for _ in range(rounds):
        score = x @ c.T
        nearest = score.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, nearest, x)
        lost = np.flatnonzero(np.bincount(nearest, minlength=len(c)) == 0)
        total[lost] = x[np.argsort(score.max(axis=1), kind="stable")[: len(lost)]]
        c = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return c


def learn_lists(children: DataFrame, keys: Sequence[str] = KEYS, most: int = MOST_LISTS) -> DataFrame:
    """Centroids of each index (keys, ``lists``: their vectors, and ``n_lists``): about the square root of its vectors, ``most`` at most, learned
    from at most SAMPLED rows for each, which a hash of the child ids chooses.  An index's sample is in one task."""
    keys = list(keys)
    sizes = children.groupBy(*keys).count().withColumn("n_lists", F.least(F.lit(most), F.greatest(F.lit(1), F.round(F.sqrt("count"))).cast("int")))
    rows = children.select(*keys, "child_id", "embedding").join(sizes, keys)
    chosen = F.xxhash64("child_id").bitwiseAND(F.lit(2**62 - 1)) <= F.lit(float(2**62)) * F.least(F.lit(1.0), F.col("n_lists") * SAMPLED / F.col("count"))
    rows = rows.where(chosen).select(*keys, "child_id", "embedding", "n_lists")
    kinds = ", ".join(f"`{k}` {children.schema[k].dataType.simpleString()}" for k in keys)

    def learn(t: pa.Table) -> pa.Table:
        t = t.sort_by("child_id")  # the same centroids whatever the order of arrival
        c = spherical_means(matrix(t["embedding"]), t["n_lists"][0].as_py())
        vectors = pa.array([c.tolist()], pa.list_(pa.list_(pa.float64())))
        return pa.table([*[t[k].slice(0, 1) for k in keys], vectors, pa.array([len(c)], pa.int32())], [*keys, "lists", "n_lists"])

    return rows.groupBy(*keys).applyInArrow(learn, f"{kinds}, lists array<array<double>>, n_lists int")


def _nearest(rows: DataFrame, lists: DataFrame, keys: list[str], many) -> DataFrame:
    """Adds ``_near``: the numbers of the nearest lists of each row's index, nearest first, as many as ``many(lists)`` tells.  Rows are dealt
    to parts, each of which meets its index's centroids once."""
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / PART_ROWS).cast("int").alias("_parts"))
    placed = rows.join(sizes, keys).withColumn("_part", F.pmod(F.xxhash64("embedding"), F.col("_parts")).cast("int")).drop("_parts")
    held = lists.join(sizes, keys).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(*[F.col(k).alias(f"_c{k}") for k in keys], F.col("_part").alias("_cpart"), "lists")
    names = [f"c{i}" for i in range(len(rows.columns))]
    schema = ", ".join(f"{n} {f.dataType.simpleString()}" for n, f in zip(names, rows.schema.fields, strict=True))
    at = rows.columns.index("embedding")

    def deal(t: pa.Table, c: pa.Table) -> pa.Table:
        t = t.select(names) if c.num_rows else t.select(names).slice(0, 0)  # an index without vectors has no lists
        near: list[list[int]] = []
        if t.num_rows:
            score = matrix(t.column(at)) @ np.array(c["lists"][0].as_py()).T
            near = np.argsort(-score, axis=1, kind="stable")[:, : many(score.shape[1])].tolist()
        return t.append_column("_near", pa.array(near, pa.list_(pa.int32())))

    ends = [names[rows.columns.index(k)] for k in keys]
    dealt = placed.toDF(*names, "_part").groupBy(*ends, "_part").cogroup(held.groupBy(*[f"_c{k}" for k in keys], "_cpart"))
    out = dealt.applyInArrow(deal, f"{schema}, _near array<int>")
    return out.toDF(*rows.columns, "_near")


def deal_to_lists(children: DataFrame, lists: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Adds ``list`` to children: the number of the nearest centroid of their index."""
    return _nearest(children, lists, list(keys), lambda n: 1).withColumn("list", F.col("_near")[0]).drop("_near")


def search_lists(queries: DataFrame, listed: DataFrame, lists: DataFrame, k: int, share: float = 0.25, least: int = 8, keys: Sequence[str] = KEYS) -> DataFrame:
    """As knn_topk(), but a query meets only the nearest lists of its index: a ``share`` of them, ``least`` at least.  Within these all
    inner products are exact, and the best of all its lists are ranked.  ``listed``: what deal_to_lists() returned."""
    keys = list(keys)
    with recorded() as made:
        asked = _nearest(queries.select(*keys, "query_id", "embedding"), lists, keys, lambda n: max(least, math.ceil(n * share)))
        asked = asked.withColumn("list", F.explode("_near")).drop("_near")
        hits = keep(knn_topk(asked, listed, k, [*keys, "list"]).drop("rank", "list"))
        let_go(made, hits)
    best = W.partitionBy(*keys, "query_id").orderBy(F.desc("score"), "child_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
