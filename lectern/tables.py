"""Tables kept between steps, and running totals over all rows."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The lists of recorded(), from the outermost; each thread has its own.
_open: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("lectern_open", default=())


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of this machine, in local mode alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _own_folder()
    return folder


@cache
def _own_folder() -> str:
    return f"file://{tempfile.mkdtemp(prefix='spark-lectern-')}"


def fresh(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keep(df: DataFrame) -> DataFrame:
    """Writes the rows as Parquet in the shared folder and reads them back.

    This cuts the lineage (lost executors cost no more than the step at hand) and fixes what a
    second evaluation might see otherwise, such as partition numbers.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lectern-{uuid.uuid4().hex}"
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept._lectern_path = path
    if _open.get():
        _open.get()[-1].append(kept)
    return kept


def fits(kept: DataFrame, limit: int = 32 << 20) -> bool:
    """Whether a table of texts and plain values is small enough to be broadcast: the bytes of the texts and 16 for each value are summed."""
    rows = kept.toDF(*[f"c{i}" for i in range(len(kept.columns))])
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in rows.dtypes if t == "string"]
    return (rows.agg(F.sum(sum(texts, F.lit(16 * len(rows.columns))).cast("long"))).first()[0] or 0) <= limit


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release(*kept: DataFrame) -> None:
    """Deletes tables of keep() that no later step reads."""
    for df in kept:
        delete_folder(df.sparkSession, df._lectern_path)


def drop_shuffles(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of jobs that are over: it does so when the driver's JVM collects their handles, by itself
    perhaps only after half an hour.  For steps that move all texts; a table of keep() needs none of its shuffles."""
    spark._jvm.System.gc()


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The list of the tables that are kept inside, by this thread."""
    made: list[DataFrame] = []
    token = _open.set((*_open.get(), made))
    try:
        yield made
    finally:
        _open.reset(token)
        if _open.get():
            _open.get()[-1].extend(made)


def keep_last(make: Callable[[], DataFrame]) -> DataFrame:
    """Keeps what the callable returns, and deletes what it kept on the way."""
    with recorded() as made:
        out = keep(make())
        let_go(made, out)
    return out


def let_go(made: list[DataFrame], *held: DataFrame) -> None:
    """Deletes the tables of recorded(), but for those still held, and takes them off its list."""
    release(*[df for df in made if not any(df is h for h in held)])
    made[:] = held


def extended(schema: StructType, more: str) -> StructType:
    """The schema with fields behind it; names are taken as they are, backticks too."""
    return StructType([*schema.fields, *StructType.fromDDL(more).fields])


def map_batches(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: str) -> DataFrame:
    """The rows with what ``f`` puts behind their columns.  Batches come under names of their own, so that columns may
    have any names (also such as mapInArrow can't resolve)."""
    rows = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    out = rows.mapInArrow(f, extended(rows.schema, more))
    return out.toDF(*df.columns, *out.columns[len(df.columns) :])


def numbered(df: DataFrame, name: str = "_row") -> DataFrame:
    """The rows, kept, each with a number of its own (not gapless): what tells rows apart whose keys are null
    or repeated.  The write fixes the numbers."""
    return keep(df.withColumn(name, F.monotonically_increasing_id()))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], measure: Column | None = None, total: bool = False) -> DataFrame:
    """Adds ``rows_before`` and ``sum_before`` (of the measure), by group in the given order; with ``total`` also
    ``rows_total``, the rows of the group.

    Rows are dealt by range of (group, order), so that a large group is spread over many tasks;
    each partition sums its own part, and the totals of the partitions (one row for each partition
    and group in it) give what lies before.  The order must be total, or ties fall arbitrarily.
    """
    group, order = list(group), list(order)
    measure = F.lit(0) if measure is None else measure
    dealt = df.withColumn("_m", measure.cast("long")).repartitionByRange(partitions(df.sparkSession), *group, *order)
    dealt = keep(dealt.withColumn("_part", F.spark_partition_id()))
    here = Window.partitionBy(*group, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy(*group, "_part").agg(F.count("*").alias("_rows"), F.sum("_m").alias("_sum"))
        .select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), F.coalesce(F.sum("_rows").over(first), F.lit(0)).alias("_rows"), F.coalesce(F.sum("_sum").over(first), F.lit(0)).alias("_sum"), F.sum("_rows").over(Window.partitionBy(*group)).alias("_total"))
    )
    inside = dealt.withColumn("_r", F.count("*").over(here)).withColumn("_s", F.coalesce(F.sum("_m").over(here), F.lit(0)))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same &= F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return inside.join(before, same).select(*df.columns, (F.col("_r") + F.col("_rows")).alias("rows_before"), (F.col("_s") + F.col("_sum")).alias("sum_before"), *[F.col("_total").alias("rows_total")] * total)
