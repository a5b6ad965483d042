"""Contiguous shards of near-equal byte size, by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import keep, running_totals


def shard_by_bytes(docs: DataFrame, shards: int = 24, key: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """Cuts the rows, in the order of (MD5 of the text, key), into contiguous shards of near-equal size.

    A row's size is its text's UTF-8 bytes plus ``overhead``.  Partitions of the ordered rows sum
    their own part; the totals of partitions give each row's global prefix sum, and the middle of a
    row tells its shard (cuts at equal targets), whatever its text.  Rows of equal texts are neighbours
    in this order, so at most ``shards - 1`` groups of them are cut.

    Returns key, ``size``, ``text_crc32``, ``law`` ('bytes'), ``shard``, ``slot`` (the place in the shard),
    ``grown_shard`` (null: for laws by key only), ``group`` (MD5 of the text).  Null text: no bytes,
    checksum 0, group ''; empty text: the same with the MD5 of nothing.  Null keys come first; rows that
    share a text and key are ordered arbitrarily.  No rows: no rows.  Other columns are not looked at,
    whatever their names.  Only MD5, size and checksum are shuffled.
    """
    if shards < 1:
        raise ValueError("at least one shard")
    rows = docs.select(
        F.col(key).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + F.lit(overhead)).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("crc"), F.coalesce(F.md5(text), F.lit("")).alias("group"),
    )
    placed = keep(running_totals(rows, [], ["group", "id"], F.col("size")))
    total = placed.agg(F.sum("size")).first()[0] or 1
    placed = placed.withColumn("shard", F.expr(f"cast(least((2 * sum_before + size) * {shards} div {2 * total}, {shards - 1}) as int)"))
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # a row for each shard
        F.col("id").alias(key), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
        (F.col("rows_before") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group",
    )
