"""Near-duplicate documents by circulant MinHash, banding and exact verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm import minhash
from lectern.llm.common import keep, partitions, release, runs
from lectern.llm.components import components

#: Rows of a bucket that are held against each other at once; larger buckets are cut into blocks.
BLOCK = 256
#: Pairs whose signatures agree less than this are not verified in the second round.  At the
#: similarity asked for (0.75) it lies four standard deviations below (250 coordinates).
AGREE = 0.64


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n, high, low, signature)."""
    for batch in batches:
        n, high, low, signatures = [], [], [], []
        for text in batch.column(1).to_pylist():
            s = minhash.shingles(text)
            h, k = minhash.names(s) if len(s) else (None, None)
            n.append(len(s))
            high.append(h)
            low.append(k)
            signatures.append(minhash.signature(s).tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (n, high, low)], pa.array(signatures, pa.binary())], ["id", "n", "high", "low", "signature"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, high, low, text) to (set, text) without texts of other sets: rows may share a key."""
    for batch in batches:
        sets = zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)
        yield batch.select([0, 3]).filter(pa.array([minhash.names(minhash.shingles(t)) == (h, k) for h, k, t in sets], pa.bool_()))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(set, signature) to (band, key, set), a row for each band."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            keys = minhash.bands(np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint16))
            sets = np.repeat(part.column(0).to_numpy(), minhash.BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(minhash.BANDS, dtype=np.int32), part.num_rows)), pa.array(keys.ravel()), pa.array(sets)], ["band", "key", "set"])


def _verify(percent: int):
    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(a, b, text of a, text of b) to the pairs that are similar."""
        last, mine = None, None
        for batch in batches:
            a, b, text_a, text_b = (c.to_pylist() for c in batch.columns)
            found = []
            for i in range(len(a)):
                if a[i] != last:
                    last, mine = a[i], minhash.shingles(text_a[i])
                found.append(minhash.similar(mine, minhash.shingles(text_b[i]), percent))
            yield batch.select([0, 1]).filter(pa.array(found, pa.bool_()))

    return go


def _blocks(percent: int, with_text: bool):
    """Rows (key, i, j, band, block, set, component, n, signature[, text]), sorted by key, i, j: the
    blocks i and j of a bucket.  Pairs of two components that agree enough and meet in no earlier
    band are looked at here; without texts the rows of such pairs are returned as they came, with texts
    the pairs that are similar."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["key", "i", "j"]):
            i, j, band = t["i"][0].as_py(), t["j"][0].as_py(), t["band"][0].as_py()
            block, comp, n, sets = (t[c].to_numpy() for c in ("block", "component", "n", "set"))
            sign = np.frombuffer(b"".join(t["signature"].to_pylist()), np.uint16).reshape(len(n), -1)
            texts = t["text"] if with_text else None
            known: dict[int, np.ndarray] = {}
            root = {int(c): int(c) for c in comp}
            used, pairs = np.zeros(len(n), bool), []

            def top(c: int, root=root) -> int:
                while root[c] != c:
                    root[c] = c = root[root[c]]
                return c

            def members(r: int, known=known, texts=texts) -> np.ndarray:
                if r not in known:
                    known[r] = minhash.shingles(texts[r].as_py())
                return known[r]

            for r in np.flatnonzero(block == i):
                others = np.flatnonzero((block == j) & (comp != comp[r]) & ((i != j) | (np.arange(len(n)) > r)))
                others = others[100 * np.minimum(n[others], n[r]) >= percent * np.maximum(n[others], n[r])]
                if not len(others):
                    continue
                same = sign[others] == sign[r]
                enough = same.mean(axis=1) >= AGREE
                others, same = others[enough], same[enough]
                others = others[same.reshape(len(others), minhash.BANDS, minhash.ROWS).all(axis=2).argmax(axis=1) == band] if len(others) else others
                if not with_text:
                    used[others] = True
                    used[r] |= len(others) > 0
                    continue
                for o in others:
                    x, y = top(int(comp[r])), top(int(comp[o]))
                    if x != y and minhash.similar(members(int(r)), members(int(o)), percent):
                        root[max(x, y)] = min(x, y)
                        pairs.append((int(comp[r]), int(comp[o])))
            if with_text:
                if pairs:
                    yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])
            elif used.any():
                yield from t.filter(pa.array(used)).combine_chunks().to_batches()

    return go


def in_blocks(marked: DataFrame, classes: DataFrame, block: int = BLOCK) -> DataFrame:
    """Members of buckets (key, set, component, band) with several components, once for each pair of blocks (i, j) in which they are to
    be compared.  Pairs within the largest component of a bucket are known to be linked, so its members meet only the others': a bucket
    of n near copies and m other texts makes about n * ceil(m / block) + m * ceil(n / block) rows, and the square is m's."""
    counts = marked.groupBy("key", "component").agg(F.count("*").alias("c")).groupBy("key").agg(F.count("*").alias("k"), F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("size"))
    blocks = lambda n: F.ceil(n / block).cast("int")
    mixed = keep(counts.where("k > 1").select("key", F.col("top.component").alias("largest"), blocks(F.col("size") - F.col("top.c")).alias("others"), blocks(F.col("top.c")).alias("most")))
    rows = marked.join(mixed, "key").join(classes.select("set", "n", "signature"), "set")
    inside, hash_ = F.col("component") == F.col("largest"), F.xxhash64("set")
    rows = rows.withColumn("block", F.when(inside, F.col("others") + F.pmod(hash_, F.col("most"))).otherwise(F.pmod(hash_, F.col("others"))).cast("int"))
    rows = rows.withColumn("o", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("others") - 1).otherwise(F.col("others") + F.col("most") - 1))))
    return rows.select("key", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "band", "block", "set", "component", "n", "signature")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Links rows whose sets of 5-word shingles have 100 * |both| >= percent * |either|; returns one
    row for each input row: the key, ``n_shingles``, ``component_id`` (smallest key reachable by
    links) and ``kept`` (it is its component's smallest).

    Equal sets (by 128 bits of hash) are one class and meet again only in the answer.  Every class has 50 band keys.  Per
    bucket, each member is verified against one member (the hub), which joins most of a large
    group in linear work.  Then only buckets that still hold several components are looked at again:
    their members are compared by signature, those of the largest component with the others and these with one another, in blocks of
    ``BLOCK`` rows, and pairs that agree enough are verified on their full sets.  Verified links give the components.

    Null or wordless text: an empty set, linked with nothing.  A null key is returned as it came,
    with a null component, and kept.  Rows that share a key are rows of their own, with a component each.
    No rows: no rows.  Other columns are not looked at, whatever their names.
    A pair exactly at the threshold is missed with a chance of 2e-6 by the bands, 3e-5 by AGREE.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(key).alias("id"), F.col(text).cast("string").alias("text"))
    signed = keep(docs.mapInArrow(_sets, f"id {docs.schema['id'].dataType.simpleString()}, n long, high long, low long, signature binary"))
    named = signed.where("high is not null and id is not null").groupBy("high", "low").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("signature").alias("signature"))
    classes = keep(named.withColumn("set", F.monotonically_increasing_id()))  # the write fixes the numbers
    rows = keep(signed.drop("signature"))
    release(signed)

    # both sides of the joins below are kept tables or dealt out anew, so that a key of very many rows can be split
    banded = classes.select("set", "signature").mapInArrow(_bands, "band int, key long, set long")
    hubs = keep(banded.groupBy("key").agg(F.min("set").alias("hub"), F.count("*").alias("size")).where("size > 1"))
    members = keep(banded.join(hubs, "key"))
    release(hubs)

    def texts(wanted: DataFrame) -> DataFrame:
        """(set, text) of the sets wanted."""
        ids = classes.join(wanted.select("set").distinct(), "set", "left_semi").select("set", "high", "low", "id")
        return docs.join(ids, "id").select("set", "high", "low", "text").mapInArrow(_own, "set long, text string").dropDuplicates(["set"])

    pairs = keep(members.where("set <> hub").select(F.col("hub").alias("a"), F.col("set").alias("b")).distinct())
    wanted = keep(texts(pairs.select(F.col("a").alias("set")).unionByName(pairs.select(F.col("b").alias("set")))))
    held = pairs.join(wanted.withColumnRenamed("set", "b").withColumnRenamed("text", "text_b"), "b").join(wanted.withColumnRenamed("set", "a").withColumnRenamed("text", "text_a"), "a")
    linked = keep(held.select("a", "b", "text_a", "text_b").mapInArrow(_verify(percent), "a long, b long"))
    release(pairs, wanted)
    first = components(linked)

    marked = members.join(first.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    marked = keep(marked.drop("hub"))
    release(members, linked)
    apart = in_blocks(marked, classes)
    ends = ["key", "i", "j"]

    def sorted_by_block(df: DataFrame) -> DataFrame:
        return df.repartition(partitions(spark), *ends).sortWithinPartitions(*ends)

    near = keep(sorted_by_block(apart).mapInArrow(_blocks(percent, False), apart.schema))
    again = near.join(texts(near), "set").select(*near.columns, "text")
    more = keep(sorted_by_block(again).mapInArrow(_blocks(percent, True), "a long, b long"))
    release(marked, near)
    whole = components(more)
    second = whole.select(F.col("node").alias("component"), F.col("component").alias("whole"))
    joined = first.join(second, "component", "left").select("node", F.coalesce("whole", "component").alias("component")).unionByName(second.join(first, second["component"] == first["node"], "left_anti").select(F.col("component").alias("node"), F.col("whole").alias("component")))

    classed = keep(classes.select("high", "low", "set", "id").join(joined.withColumnRenamed("node", "set"), "set", "left").select("high", "low", "id", F.coalesce("component", "set").alias("class")))
    release(classes, first, more, whole)
    least = keep(classed.groupBy("class").agg(F.min("id").alias("least")))
    answer = keep(classed.join(least, "class").select("high", "low", "least"))
    release(classed, least)
    out = rows.join(answer, ["high", "low"], "left").withColumn("least", F.when(F.col("id").isNotNull(), F.coalesce("least", "id")))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"), F.coalesce(F.col("id") == F.col("least"), F.lit(True)).alias("kept"))
