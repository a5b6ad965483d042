"""Mixing sources to target weights by Pfair scheduling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import keep, running_totals

#: The pool of all sources without a weight of their own, and of rows without a source.
OTHER = "other"


def pfair_period(weights: Mapping[str, int]) -> list[tuple[str, int]]:
    """One period of the schedule: for each slot the pool and the number of its block.

    With weights a and their sum q, block i of a pool is released at slot floor(i*q/a), and its
    deadline is ceil((i+1)*q/a).  Every slot takes, of the released blocks, the one of the earliest
    deadline (ties: by name).  After q slots every pool has had exactly its share, so the schedule repeats.
    """
    if not weights or any(not isinstance(a, int) or a < 1 for a in weights.values()):
        raise ValueError("weights are positive whole numbers")
    q, done, plan = sum(weights.values()), dict.fromkeys(weights, 0), []
    for slot in range(q):
        pool = min((p for p, a in weights.items() if done[p] < a and done[p] * q // a <= slot), key=lambda p: (-(-(done[p] + 1) * q // weights[p]), p))
        plan.append((pool, done[pool]))
        done[pool] += 1
    return plan


def mix_sources(docs: DataFrame, weights: Mapping[str, int], block_bytes: int = 65536, key: str = "doc_id", source: str = "source", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """Orders all rows so that each pool gets its weight's share of every stretch of the order, to
    less than one block.

    A pool is a source named in ``weights``, or all the rest under the name of ``OTHER``.  A pool's rows
    stand in the order of their keys; its block i holds the rows whose first byte lies in the i-th
    ``block_bytes`` (a row longer than a block uses up the blocks it covers).  The block's slot follows
    from one period of the schedule, a fixed table with one row for each unit of weight, so
    the order of any number of blocks is a join and a sort.  No row is dropped: when a pool has run
    out its slots stay empty, and ``on_target`` is false from the first such slot on.

    Only keys, sources and byte counts are shuffled.  Returns one row for each row: key, source, ``bytes``,
    ``pool``, ``block``, ``release``, ``deadline``, ``slot``, ``position`` (gapless from 0), ``on_target``.  Null
    text: no bytes.  Rows without a source belong to OTHER; null keys come first in their pool;
    rows that share a key stand in the order of the columns ``carry`` (which are returned too), or else in
    an arbitrary one.  No rows: no rows.  Other columns are not looked at, whatever their names.
    """
    spark = docs.sparkSession
    plan = pfair_period(weights)
    q = len(plan)
    pattern = spark.createDataFrame([(p, i, slot, weights[p]) for slot, (p, i) in enumerate(plan)], "_pool string, _turn long, _at long, _share long")
    name = F.col(source).cast("string")
    pool = F.when(name.isin(*weights), name).otherwise(F.lit(OTHER))
    rows = docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), pool.alias("pool"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), *carry)
    if OTHER not in weights and rows.where(F.col("pool") == OTHER).limit(1).count():
        raise ValueError(f"some rows have no weight: name their sources or {OTHER!r}")
    blocks = running_totals(rows, ["pool"], ["_key", *carry], F.col("bytes")).withColumn("block", F.expr(f"sum_before div {int(block_bytes)}")).withColumnRenamed("rows_before", "_nth").drop("sum_before")
    slots = blocks.join(F.broadcast(pattern), (F.col("pool") == F.col("_pool")) & (F.col("block") % F.col("_share") == F.col("_turn")))  # q rows
    slots = slots.select(
        "pool", "block", F.expr(f"block * {q} div _share").alias("release"), F.expr(f"((block + 1) * {q} + _share - 1) div _share").alias("deadline"),
        F.expr(f"(block div _share) * {q} + _at").alias("slot"), "_nth", "_key", "_source", "bytes", *carry,
    )
    ordered = keep(running_totals(slots, [], ["slot", "_nth"]))
    ends = ordered.groupBy("pool").agg(F.max("slot").alias("end")).agg(F.min("end"), F.count("*")).first()
    until = ends[0] if ends[1] == len(weights) else -1
    return ordered.select(F.col("_key").alias(key), F.col("_source").alias(source), "bytes", "pool", "block", "release", "deadline", "slot", F.col("rows_before").alias("position"), (F.col("slot") <= F.lit(until)).alias("on_target"), *carry)


def in_mixed_order(docs: DataFrame, mixed: DataFrame, row: str) -> DataFrame:
    """The documents in the order of mix_sources(); written out, their files hold it.  The column ``row`` tells the
    rows of both apart (see numbered()): a key that is null or repeated would multiply them."""
    return docs.join(mixed.select(row, "position"), row).orderBy("position").drop("position")
