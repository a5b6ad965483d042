"""Scans of ordered rows by ranges: neighbours, searches and chains of jumps, without a task that needs a whole group."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from lectern.tables import keep, let_go, map_batches, partitions, recorded, release


#: Rows of a partition of a scan, as far as there are tasks.
ROWS = 200_000


def parts_for(df: DataFrame) -> int:
    """Into how many partitions scans deal the rows (counted at once, so better those of a kept table)."""
    return max(1, min(partitions(df.sparkSession), -(-df.count() // ROWS)))


def _same(group: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for i, g in enumerate(group):
        out &= F.col(g).eqNullSafe(F.col(f"{prefix}{i}"))
    return out


def _spanning(dealt: DataFrame, group: Sequence[str]) -> DataFrame:
    """The groups with rows in several partitions (_part) of rows dealt by ranges, as columns _g0, ...: they are the
    first or the last of a partition, so there are fewer than partitions."""
    key = F.struct(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)])
    ends = dealt.groupBy("_part").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends = ends.select(F.explode(F.array_distinct(F.array("low", "high"))).alias("g"))
    return ends.groupBy("g").count().where("count > 1").select("g.*")


def _last_before(value: str, rows: WindowSpec, order: Sequence[str | Column]) -> Column:
    return F.last(value, True).over(rows.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))


def _first_behind(value: str, rows: WindowSpec, order: Sequence[str]) -> Column:
    """The last value before the row in the order turned round: a frame that grows takes a step a row, while Spark goes through one that
    shrinks anew for each row."""
    return _last_before(value, rows, [F.desc(c) for c in order])


def neighbours(df: DataFrame, group: Sequence[str], order: Sequence[str], before: Mapping[str, Column] | None = None, after: Mapping[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """Adds for each row the last value before it (columns of ``before``) and the first one behind it (``after``) in the order of
    its group; null values are passed over.

    Rows are dealt by ranges of (group, order) and look within their partition; of the groups that go on in other partitions,
    the last and the first values of each partition are carried along a table of at most two rows a partition.  The order must be
    total, or ties fall arbitrarily.  Null groups are a group.  ``parts``: how many partitions (see parts_for; as many as shuffles have)."""
    parts = parts or partitions(df.sparkSession)
    group, order, before, after = list(group), list(order), dict(before or {}), dict(after or {})
    values = {f"_v{i}": c for i, c in enumerate([*before.values(), *after.values()])}
    back, on = list(values)[: len(before)], list(values)[len(before) :]
    dealt = df.select("*", *[c.alias(v) for v, c in values.items()])
    if parts == 1:
        dealt = dealt.withColumn("_part", F.lit(0))
    else:
        dealt = keep(dealt.repartitionByRange(parts, *group, *order).withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy("_part", *group)
    inside = dealt.select(
        *df.columns, "_part",
        *[_last_before(v, here, order).alias(v) for v in back],
        *[_first_behind(v, here, order).alias(v) for v in on],
    )
    if parts == 1:
        return inside.select(*df.columns, *[F.col(v).alias(name) for v, name in zip(values, [*before, *after], strict=True)])
    place = F.struct(*order)
    known = lambda v: F.when(F.col(v).isNotNull(), place)
    edges = dealt.join(F.broadcast(_spanning(dealt, group)), _same(group, "_g"))  # fewer rows than partitions
    edges = edges.groupBy(F.col("_part").alias("_p"), *[f"_g{i}" for i in range(len(group))]).agg(*[F.max_by(v, known(v)).alias(v) for v in back], *[F.min_by(v, known(v)).alias(v) for v in on])
    by_part = Window.partitionBy(*[f"_g{i}" for i in range(len(group))])
    edges = edges.select(
        "_p", *[f"_g{i}" for i in range(len(group))],
        *[_last_before(v, by_part, ["_p"]).alias(f"_e{v}") for v in back],
        *[_first_behind(v, by_part, ["_p"]).alias(f"_e{v}") for v in on],
    )
    out = inside.join(F.broadcast(edges), (F.col("_part") == F.col("_p")) & _same(group, "_g"), "left")  # two rows a partition at most
    return out.select(*df.columns, *[F.coalesce(v, f"_e{v}").alias(name) for v, name in zip(values, [*before, *after], strict=True)])


def first_reaching(points: DataFrame, asks: DataFrame, group: Sequence[str], value: str, found: Column, name: str, parts: int | None = None) -> DataFrame:
    """Adds to asks (group, ``value``, ``nth``, and more) ``found`` of the first point of their group, in the order of (value, nth), whose
    value is at least theirs; null if there is none."""
    group = list(group)
    rest = [c for c in asks.columns if c not in (*group, value, "nth")]
    p = points.select(*group, value, F.lit(1).alias("_kind"), "nth", found.alias("_found"))
    a = asks.select(*group, value, F.lit(0).alias("_kind"), "nth", F.struct(*rest).alias("_rest") if rest else F.lit(None).alias("_rest"))
    both = a.unionByName(p, allowMissingColumns=True)
    hit = neighbours(both, group, [value, "_kind", "nth"], after={name: F.col("_found")}, parts=parts).where("_kind = 0")
    return hit.select(*group, value, "nth", *[F.col(f"_rest.`{c}`").alias(c) for c in rest], name)


def least_with_gap(start: Column, gap: float) -> Column:
    """The smallest double whose difference to ``start``, as doubles subtract, is at least ``gap``."""
    return F.pandas_udf(_least_with_gap, "double")(start, F.lit(float(gap)))


def _least_with_gap(start: pd.Series, gap: pd.Series) -> pd.Series:
    start, gap = start.to_numpy(float), gap.to_numpy(float)
    x = start + gap
    for _ in range(3):
        less = np.nextafter(x, -np.inf)
        x = np.where(less - start >= gap, less, x)
    for _ in range(3):
        x = np.where(x - start >= gap, x, np.nextafter(x, np.inf))
    return pd.Series(x)


def _numbers(batches: list[pa.RecordBatch], column: int) -> np.ndarray:
    """A column of whole numbers, null as -1."""
    return pc.fill_null(pa.chunked_array([b.column(column) for b in batches]).cast(pa.int64()), -1).to_numpy() if batches else np.empty(0, np.int64)


def _groups(batches: list[pa.RecordBatch], column: int) -> np.ndarray:
    """For each row the place of the last row of its group (rows of a group stand together)."""
    code = pa.chunked_array([b.column(column) for b in batches]).combine_chunks().dictionary_encode().indices.to_numpy()
    last = np.flatnonzero(np.concatenate([code[1:] != code[:-1], [True]]))
    return last[np.searchsorted(last, np.arange(len(code)))]


def _ways_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., key, nth, next), sorted, with ``leaves``: where the chain from each row leaves the partition (null: it ends here), and
    ``steps``: how many of its rows stand here.  The jump table of the partition is squared until no jump changes."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    width = batches[0].num_columns
    nth, to, last = _numbers(batches, width - 2), _numbers(batches, width - 1), _groups(batches, width - 3)
    here = np.arange(len(nth))
    jump = here + np.where(to < 0, 0, to - nth)
    jump = np.where(jump > last, here, jump)
    steps = (jump != here).astype(np.int64)
    while True:
        then = jump[jump]
        if (then == jump).all():
            break
        steps, jump = steps + steps[jump], then
    leaves, steps, at = to[jump], steps + 1, 0
    for b in batches:
        out, n = leaves[at : at + b.num_rows], steps[at : at + b.num_rows]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int64(), mask=out < 0), pa.array(n)], [*b.schema.names, "leaves", "steps"])
        at += b.num_rows


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(..., entry, met, key, nth, next), sorted by partition and key: ``starts`` marks the rows of the chain that enters at
    ``entry``, and ``ordinal`` counts them from ``met`` (those before the partition), up to each row."""
    batches = [b for b in batches if b.num_rows]
    if not batches:
        return
    width = batches[0].num_columns
    nth, to, last = _numbers(batches, width - 2), _numbers(batches, width - 1), _groups(batches, width - 3)
    entry, met = _numbers(batches, width - 5), _numbers(batches, width - 4)
    starts, ordinal, first = np.zeros(len(nth), bool), np.empty(len(nth), np.int64), 0
    while first < len(nth):
        end = int(last[first])
        at = first + int(entry[first] - nth[first]) if entry[first] >= 0 else end + 1
        jumps = (to[first : end + 1] - nth[first : end + 1]).tolist()
        gone = (to[first : end + 1] < 0).tolist()
        while at <= end:
            starts[at] = True
            if gone[at - first]:
                break
            at += jumps[at - first]
        ordinal[first : end + 1] = met[first] + np.cumsum(starts[first : end + 1]) - 1
        first = end + 1
    at = 0
    for b in batches:
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(starts[at : at + b.num_rows]), pa.array(ordinal[at : at + b.num_rows])], [*b.schema.names, "starts", "ordinal"])
        at += b.num_rows


def chains(nodes: DataFrame, group: Sequence[str], parts: int | None = None) -> DataFrame:
    """Of rows (group, ``nth`` from 0 without gaps, ``next`` > nth or null, and more): those on the chain of jumps from each group's
    row 0 (``starts``), and for every row how many of them come before it or are it, less one (``ordinal``).

    Rows are dealt by ranges of (group, nth).  Within a partition the jump table is squared until all jumps lead out of it;
    across partitions (only in groups that span several) the ways out are squared in the same manner, by joins, so a
    group over p partitions takes log2(p) of them and its rows are never in one task."""
    group, parts = list(group), parts or partitions(nodes.sparkSession)
    ids = [f"_g{i}" for i in range(len(group))]
    key = F.to_json(F.struct(*group), {"ignoreNullFields": "false"})
    rest = [c for c in nodes.columns if c not in ("nth", "next")]
    if parts == 1:
        whole = nodes.select(*rest, F.lit(0).cast("long").alias("entry"), F.lit(0).cast("long").alias("met"), key.alias("_key"), F.col("nth").cast("long").alias("nth"), F.col("next").cast("long").alias("next"))
        return keep(map_batches(whole.repartition(1).sortWithinPartitions(*group, "nth"), _walk, "starts boolean, ordinal long").select(*rest, "nth", "next", "starts", "ordinal"))
    with recorded() as made:
        dealt = nodes.repartitionByRange(parts, *group, "nth").sortWithinPartitions(*group, "nth")
        local = keep(map_batches(dealt.select(*rest, F.spark_partition_id().alias("_part"), key.alias("_key"), F.col("nth").cast("long").alias("nth"), F.col("next").cast("long").alias("next")), _ways_out, "leaves long, steps long"))
        named = [F.col(g).alias(i) for g, i in zip(group, ids, strict=True)]
        jumps = keep(local.where("leaves is not null").select(*named, F.col("nth").alias("a"), F.col("leaves").alias("b"), "steps"))
        spans = keep(_spanning(local, group))
        met = keep(spans.select(*ids, F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("met")))
        while jumps.limit(1).count():
            more = met.join(jumps.withColumnsRenamed({i: f"j{i}" for i in ids}), _equal(ids, "j") & (F.col("at") == F.col("a")))
            then = keep(met.unionByName(more.select(*ids, F.col("b").alias("at"), (F.col("met") + F.col("steps")).alias("met"))))
            on = jumps.select(*[F.col(i).alias(f"j{i}") for i in ids], F.col("a").alias("c"), F.col("b").alias("d"), F.col("steps").alias("more"))
            twice = keep(jumps.join(on, _equal(ids, "j") & (F.col("b") == F.col("c"))).select(*ids, "a", F.col("d").alias("b"), (F.col("steps") + F.col("more")).alias("steps")))
            release(met, jumps)
            met, jumps = then, twice
        # in each partition of a spanning group: where the chain enters (if it does), and how many rows it has met before
        stretches = local.join(F.broadcast(spans), _same(group, "_g")).groupBy(*ids, "_part").agg(F.min("nth").alias("low"), F.max("nth").alias("high"))
        entered = stretches.join(met.withColumnsRenamed({i: f"m{i}" for i in ids}), _equal(ids, "m") & (F.col("at") >= F.col("low")) & (F.col("at") <= F.col("high")), "left").select(*ids, F.col("_part").alias("_p"), "low", "at", "met")
        counts = entered.join(local.select(*[F.col(g).alias(f"l{i}") for g, i in zip(group, ids, strict=True)], F.col("nth").alias("_n"), "steps"), _equal(ids, "l") & (F.col("at") == F.col("_n")), "left")
        by_part = Window.partitionBy(*ids).orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
        known = keep(counts.select(*ids, "_p", F.col("at").alias("entry"), F.coalesce("met", F.max(F.col("met") + F.col("steps")).over(by_part), F.lit(0)).alias("met")))
        told = local.drop("leaves", "steps").join(F.broadcast(known), (F.col("_part") == F.col("_p")) & _same(group, "_g"), "left")  # two rows a partition at most
        alone = F.col("_p").isNull()
        told = told.select(*rest, "_part", F.when(alone, F.lit(0)).otherwise(F.col("entry")).cast("long").alias("entry"), F.when(alone, F.lit(0)).otherwise(F.col("met")).cast("long").alias("met"), F.concat_ws(" ", "_part", "_key").alias("_key"), "nth", "next")
        told = told.repartition(parts, "_part").sortWithinPartitions("_part", *group, "nth")
        out = keep(map_batches(told, _walk, "starts boolean, ordinal long").select(*rest, "nth", "next", "starts", "ordinal"))
        let_go(made, out)
    return out


def _equal(ids: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for i in ids:
        out &= F.col(i).eqNullSafe(F.col(f"{prefix}{i}"))
    return out
