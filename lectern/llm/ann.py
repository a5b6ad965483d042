"""Approximate nearest neighbours: sharded graphs with robust pruning, searched by beams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lectern.llm.common import keep, partitions, pieces
from lectern.llm.vectors import as_double, element, matrix, usable

#: Vectors of a shard at most (large tables) and at least (small ones: a SHARES-th of all, if that is more); edges of a node, width of the beam
#: when building and when asking, relaxation of the pruning, queries that are asked at once.
SHARD, LEAST_SHARD, SHARES, DEGREE, BUILD_BEAM, BEAM, ALPHA, ASKED = 65_536, 8192, 32, 24, 48, 160, 1.2, 256
_EXPAND = 4


def _scale(*x: np.ndarray) -> float:
    """A power of two that brings all components to at most 1, so that their squares are finite."""
    return 2.0 ** -np.frexp(max(float(np.abs(v).max(initial=0.0)) for v in x))[1]


def _norms(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", x, x)


def beam_search(x: np.ndarray, norm: np.ndarray, graph: np.ndarray, entry: int, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes nearest to each query that greedy searches find (nearest first), and their squared
    distances: each step opens the nearest unopened nodes of a beam and keeps the best of their neighbours.
    ``norm``: squared lengths of the rows of x.  A query leaves the loop when its whole beam is open."""
    n, beam, length = len(q), min(beam, len(x)), _norms(q)
    out_ids, out_far = np.full((n, beam), entry), np.full((n, beam), np.inf, np.float32)
    live = np.arange(n)
    ids, far, opened = out_ids.copy(), out_far.copy(), np.ones((n, beam), bool)
    far[:, 0] = np.maximum(norm[entry] - 2 * (q @ x[entry]) + length, 0)
    opened[:, 0] = False
    seen = np.zeros((n, len(x)), bool)
    seen[:, entry] = True
    while len(live):
        m = len(live)
        first = np.argsort(opened, axis=1, kind="stable")[:, :_EXPAND]  # the beam is in order, so the first unopened ones
        ready = ~np.take_along_axis(opened, first, 1)
        np.put_along_axis(opened, first, True, 1)
        new = np.where(ready[:, :, None], graph[np.take_along_axis(ids, first, 1)], -1).reshape(m, -1)
        new.sort(axis=1)
        fresh = new >= 0
        fresh[:, 1:] &= new[:, 1:] != new[:, :-1]
        row, at = fresh.nonzero()
        name = new[row, at]
        fresh = ~seen[live[row], name]
        row, name = row[fresh], name[fresh]
        seen[live[row], name] = True
        count = np.bincount(row, minlength=m)
        place = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        more, away = np.full((m, int(count.max(initial=0))), entry), np.full((m, int(count.max(initial=0))), np.inf, np.float32)
        more[row, place] = name
        away[row, place] = np.maximum(norm[name] - 2 * np.einsum("ij,ij->i", x[name], q[live[row]]) + length[live[row]], 0)
        ids, far, opened = np.hstack([ids, more]), np.hstack([far, away]), np.hstack([opened, np.isinf(away)])
        best = np.argsort(far, axis=1, kind="stable")[:, :beam]
        ids, far, opened = (np.take_along_axis(v, best, 1) for v in (ids, far, opened))
        over = opened.all(axis=1)
        if over.any():
            out_ids[live[over]], out_far[live[over]] = ids[over], far[over]
            live, ids, far, opened = (v[~over] for v in (live, ids, far, opened))
    return out_ids, out_far


def _near(x: np.ndarray, norm: np.ndarray, at: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Squared distances of x[at[i]] to x[q[i]]."""
    return np.maximum(norm[at] - 2 * np.einsum("ijk,ik->ij", x[at], x[q]) + norm[q][:, None], 0)


def robust_prune(x: np.ndarray, norm: np.ndarray, nodes: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """For each node up to ``degree`` of its candidates (-1: none), -1 for the rest: again and again the nearest one
    left, which drops all that are nearer to it, ``alpha`` times, than to the node."""
    candidates = np.sort(candidates, axis=1)
    bad = (candidates < 0) | (candidates == nodes[:, None])
    bad[:, 1:] |= candidates[:, 1:] == candidates[:, :-1]
    far = np.where(bad, np.inf, _near(x, norm, candidates, nodes))
    order = np.argsort(far, axis=1, kind="stable")
    candidates, far = np.take_along_axis(candidates, order, 1), np.take_along_axis(far, order, 1)
    most = int(np.isfinite(far).sum(axis=1).max(initial=0))
    candidates, own, left = candidates[:, :most], far[:, :most], far[:, :most].copy()
    out = np.full((len(nodes), degree), -1)
    if not most:
        return out
    rows, vectors = np.arange(len(nodes)), x[candidates]
    for k in range(degree):
        at = left.argmin(axis=1)
        live = np.flatnonzero(np.isfinite(left[rows, at]))
        if not len(live):
            break
        pick = candidates[live, at[live]]
        out[live, k] = pick
        left[live, at[live]] = np.inf
        close = norm[candidates[live]] - 2 * np.einsum("ijk,ik->ij", vectors[live] if len(live) < len(rows) else vectors, x[pick]) + norm[pick][:, None]
        left[live] = np.where(alpha**2 * np.maximum(close, 0) <= own[live], np.inf, left[live])
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, int]:
    """Out-edges of each vector (-1: none) and the entry node.  From random edges, two rounds over all
    nodes: greedy searches propose neighbours, pruning keeps diverse ones, and edges are added backwards."""
    n, norm = len(x), _norms(x)
    rng = np.random.default_rng(seed)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = np.full((n, degree), -1)
    graph[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    for a, width in ((1.0, beam // 2), (alpha, beam)):
        for nodes in np.array_split(rng.permutation(n), max(1, n // 512)):
            found, _ = beam_search(x, norm, graph, entry, x[nodes], width)
            graph[nodes] = robust_prune(x, norm, nodes, np.hstack([found, graph[nodes]]), degree, a)
            to, source = graph[nodes].ravel(), np.repeat(nodes, degree)
            to, source = to[to >= 0], source[to >= 0]
            known = (graph[to] == source[:, None]).any(axis=1)
            to, source = to[~known], source[~known]
            order = np.argsort(to, kind="stable")
            to, source = to[order], source[order]
            changed, first, count = np.unique(to, return_index=True, return_counts=True)
            room = degree - (graph[changed] >= 0).sum(axis=1)
            for low, high in ((0, 4), (4, 16), (16, n)):  # nodes of like numbers of new edges at once
                some = np.flatnonzero((count > low) & (count <= high))
                if not len(some):
                    continue
                nth = np.arange(count[some].sum()) - np.repeat(np.cumsum(count[some]) - count[some], count[some])
                back = np.full((len(some), count[some].max()), -1)
                back[np.repeat(np.arange(len(some)), count[some]), nth] = source[np.repeat(first[some], count[some]) + nth]
                every = np.hstack([graph[changed[some]], back])
                fits = count[some] <= room[some]
                graph[changed[some[fits]]] = -np.sort(-every[fits], axis=1)[:, :degree]
                graph[changed[some[~fits]]] = robust_prune(x, norm, changed[some[~fits]], every[~fits], degree, a)
    return graph, entry


def _equal(kind: str, most: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(vector, id): of equal vectors of a batch, one with the smallest ids."""
        for batch in batches:
            by: dict[tuple, set[int]] = {}
            for v, i in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by.setdefault(tuple(v), set()).add(i)
            kept = pa.float32() if kind == "<f4" else pa.float64()
            yield pa.RecordBatch.from_arrays([pa.array([list(v) for v in by], pa.list_(kept)), pa.array([sorted(i)[:most] for i in by.values()], pa.list_(pa.int64()))], ["vector", "ids"])

    return go


def build_index(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, shard: int = SHARD, least: int = LEAST_SHARD) -> DataFrame:
    """Indexes every usable vector: ``dim, shard, node, vector, ids, edges, entry``.

    Equal vectors are one node, with the k + 1 smallest of their keys (no other can be in
    an answer), gathered first within batches.  Nodes are dealt by a hash to shards of about ``least`` to ``shard``
    of them, whose number follows the number of nodes alone; each shard's graph is built in one task, in the order of its keys, so
    the same vectors give the same graphs under any settings.  Left out: null keys, and vectors that are null, empty, zero or hold null or non-finite components.
    Rows that share a key are vectors of one key.  Other columns are not looked at, whatever their names.
    """
    kind = element(df, vector)
    rows = df.select(as_double(df, vector).alias("vector"), F.col(key).cast("long").alias("id")).where(usable(F.col("vector")) & F.col("id").isNotNull())
    text = "float" if kind == "<f4" else "double"
    some = rows.mapInArrow(_equal(kind, k + 1), f"vector array<{text}>, ids array<long>")
    nodes = keep(some.groupBy("vector").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")).withColumn("dim", F.size("vector")))
    n = nodes.count()
    shards = max(1, -(-n // min(shard, max(least, n // SHARES))))
    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("vector"), F.lit(shards)).cast("int"))

    def build(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.argsort(pc.list_element(t["ids"], 0).to_numpy(), kind="stable")))  # the same graph whatever the order of arrival
        x = matrix(t["vector"], kind)
        graph, entry = build_graph((x * _scale(x)).astype(np.float32))
        t = t.append_column("node", pa.array(np.arange(len(x), dtype=np.int32)))
        t = t.append_column("edges", pa.FixedSizeListArray.from_arrays(pa.array(graph.astype(np.int32).ravel()), graph.shape[1]).cast(pa.list_(pa.int32())))
        return t.append_column("entry", pa.array(np.full(len(x), entry, np.int32))).select(["dim", "shard", "node", "vector", "ids", "edges", "entry"])

    return dealt.groupBy("dim", "shard").applyInArrow(build, f"dim int, shard int, node int, vector array<{text}>, ids array<long>, edges array<int>, entry int")


def _nearest(names: np.ndarray, x: np.ndarray, q: np.ndarray, ids: list[list[int]], found: np.ndarray, far: np.ndarray, k: int) -> pa.RecordBatch:
    """Of the nodes found for each query the keys of the nearest ones, with their distances in double precision:
    nodes in order until they hold k keys other than the query's own (and all that are as near)."""
    out: tuple[list, list, list] = ([], [], [])
    for r, name in enumerate(names):
        near = found[r][np.isfinite(far[r])]
        for take in (k + 6, len(near)):
            gap = x[near[:take]].astype(float) - q[r].astype(float)
            exact = np.sqrt((gap**2).cumsum(axis=1)[:, -1])
            if np.isinf(exact).any():  # squares beyond doubles: the same, divided by a power of two
                scale = _scale(gap)
                exact = np.sqrt(((gap * scale) ** 2).cumsum(axis=1)[:, -1]) / scale
            best: dict[int, float] = {}
            for o in np.argsort(exact, kind="stable"):
                if len(best) >= k and exact[o] > last:
                    break
                for i in ids[near[o]]:
                    if i != name:
                        best.setdefault(i, float(exact[o]))
                last = exact[o]
            if len(best) >= k:
                break
        out[0].extend([int(name)] * len(best))
        out[1].extend(best)
        out[2].extend(best.values())
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])


def search_index(index: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 10, beam: int = BEAM, part: int = SHARD) -> DataFrame:
    """The k nearest found for each query, by Euclidean distance: ``query_id, rank, vec_id, score``.

    Every query is asked at every shard of its length.  A task holds one shard's graph, which comes first
    in its rows, and asks the queries behind it as they stream by; ``part`` queries meet one copy of
    a shard.  Distances of the nearest nodes are taken again in double precision on the original vectors, and the
    best of all shards are ranked (ties: smaller key).  A query's own key is left out.  Of several rows
    with one key and vector one is asked; if the vectors of a key differ, a distance to it is the least one,
    and so is a distance from it.  Distances of finite doubles whose squares would be infinite are taken after
    division by a power of two.  Queries that are null, zero or not finite, or have no key, get no rows.
    """
    kind, spark = element(queries, vector), queries.sparkSession
    floats = "float" if kind == "<f4" else "double"
    index = keep(index.withColumn("vector", F.col("vector").cast(f"array<{floats}>")))
    asked = queries.select(F.col(key).cast("long").alias("query_id"), as_double(queries, vector).alias("vector")).where(usable(F.col("vector")) & F.col("query_id").isNotNull()).distinct()
    asked = keep(asked)
    parts = max(1, -(-asked.count() // part))
    shards = keep(index.select("dim", "shard").distinct())
    asked = asked.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")).withColumn("d", F.size("vector"))
    asked = asked.join(shards, F.col("d") == F.col("dim")).select("dim", "shard", "part", F.lit(1).alias("asks"), F.lit(0).alias("node"), "vector", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<int>").alias("edges"), F.lit(0).alias("entry"), "query_id")
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("dim", "shard", "part", F.lit(0).alias("asks"), "node", "vector", "ids", "edges", "entry", F.lit(None).cast("long").alias("query_id"))
    ends = ["dim", "shard", "part"]
    both = held.unionByName(asked).repartition(partitions(spark), *ends).sortWithinPartitions(*ends, "asks", "node")

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, rows, graph = None, [], None
        for t in pieces(batches, [*ends, "asks"], ASKED):
            if (now := tuple(t[c][0].as_py() for c in ends)) != place:
                place, rows, graph = now, [], None
            if not t["asks"][0].as_py():
                rows.append(t)
                continue
            if not rows:
                continue
            if graph is None:
                nodes = pa.concat_tables(rows)
                x, graph, ids, entry = matrix(nodes["vector"], kind), matrix(nodes["edges"], "i4"), nodes["ids"].to_pylist(), nodes["entry"][0].as_py()
                rows = [nodes]
                shift = _scale(x)
                small = (x * shift).astype(np.float32)
                norm = _norms(small)
            q = matrix(t["vector"], kind)
            if (scale := _scale(x, q)) == shift:
                near = beam_search(small, norm, graph, entry, (q * scale).astype(np.float32), beam)
            else:  # a query of larger components than the shard's
                less = (x * scale).astype(np.float32)
                near = beam_search(less, _norms(less), graph, entry, (q * scale).astype(np.float32), beam)
            yield _nearest(t["query_id"].to_numpy(), x, q, ids, *near, k)

    found = both.mapInArrow(ask, "query_id long, vec_id long, score double")
    least = found.repartition(partitions(spark), "query_id").groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return least.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
