"""What the operators share: tables kept between steps, running totals, runs of sorted rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession

from lectern.tables import delete_folder, keep, keep_last, let_go, map_batches, numbered, partitions, recorded, release, running_totals, shared_folder

__all__ = ["delete_folder", "keep", "keep_last", "let_go", "map_batches", "numbered", "partitions", "pieces", "recorded", "release", "running_totals", "runs", "shared_folder", "small_batches"]


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Hands texts to Python so many rows at a time, unless the session says how many: long texts make the
    default of 10,000 rows too large for small executors."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def runs(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """Of rows that come sorted by the keys, one table for each run of equal keys."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        columns = [table.column(k).to_numpy() for k in keys]
        change = [i + 1 for i in (sum((c[1:] != c[:-1]).astype("i4") for c in columns)).nonzero()[0]] if table.num_rows > 1 else []
        edges = [0, *change, table.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            now = tuple(c[a] for c in columns)
            if held and now != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = now
    if held:
        yield pa.concat_tables(held)


def pieces(batches: Iterator[pa.RecordBatch], keys: Sequence[str], most: int) -> Iterator[pa.Table]:
    """Of rows that come sorted by the keys, tables of at most so many rows of equal keys."""
    for batch in batches:
        table = pa.Table.from_batches([batch])
        if not table.num_rows:
            continue
        columns = [table.column(k).to_numpy() for k in keys]
        change = (sum((c[1:] != c[:-1]).astype("i4") for c in columns).nonzero()[0] + 1).tolist() if table.num_rows > 1 else []
        edges = [0, *change, table.num_rows]
        for a, b in zip(edges, edges[1:], strict=False):
            for at in range(a, b, most):
                yield table.slice(at, min(most, b - at))
