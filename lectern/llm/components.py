"""Connected components of an edge table, by large-star steps and contraction within tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import keep, release

#: Edges that a task holds at once.
CHUNK = 1 << 20


def smallest(name: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each node the smallest name of its component under the links a-b, by hooking the larger root
    of each link onto the smaller one until no link joins two roots."""
    order = np.argsort(name)
    rank = np.empty(len(name), np.int64)
    rank[order] = np.arange(len(name))
    root, a, b = np.arange(len(name)), rank[a], rank[b]
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return name[order][root[rank]]
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while ((up := root[root]) != root).any():
            root = up


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to (u, v): in the components of each ``CHUNK`` edges, every node but the smallest with the smallest."""

    def out() -> pa.RecordBatch:
        a, b = (np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1))
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        least = smallest(nodes, at[: len(a)], at[len(a) :])
        return pa.RecordBatch.from_arrays([pa.array(nodes[least < nodes]), pa.array(least[least < nodes])], ["u", "v"])

    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK:
            yield out()
            held, rows = [], 0
    if rows:
        yield out()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` to a kept table ``(node, component)`` with each node of an edge; the component is
    its smallest node.

    Every step links a node's larger neighbours to the smallest of all its neighbours and itself (both sides of that join
    are kept tables, so that a node of very many links can be split over tasks).  Then each task links the nodes that its own edges
    connect to the smallest of them, which leaves a node one smaller end for each task (and ``CHUNK`` edges) at most, and
    these ends of each node are linked to the smallest.  Edges never become more.
    The loop ends when every node is smaller than all its neighbours or has a single one: then these are the components.
    """

    def contracted(links: DataFrame) -> DataFrame:
        ends = links.mapInArrow(_stars, "u long, v long").groupBy("u").agg(F.collect_set("v").alias("ends"))
        return keep(ends.select(F.explode(F.concat("ends", F.array("u"))).alias("u"), F.array_min("ends").alias("v")).where("u <> v"))

    now = contracted(edges.where("a <> b").select("a", "b"))
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        around = both.groupBy("u").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        settled = (F.col("low") > F.col("u")) | (F.col("low") == F.col("high"))
        least = keep(around.select(F.col("u").alias("node"), F.least("u", "low").alias("component"), settled.alias("settled")))
        if least.where("not settled").isEmpty():
            break
        then = contracted(both.join(least, F.col("u") == F.col("node")).where("v > u").select("v", "component"))
        release(now, least)
        now = then
    release(now)
    out = least.select("node", "component")
    out._lectern_path = least._lectern_path
    return out
