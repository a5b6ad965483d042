"""Embedding and exact retrieval within lecture indexes."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import CONTEXT_SEPARATOR, joined, prefixed
from lectern.tables import fresh, keep, map_batches


VECTORS = "key string, embedding array<float>"


def hashed_ngrams(texts: list[str], dim: int = 256, n: int = 3) -> np.ndarray:
    """A deterministic embedder: counts of hashed character n-grams."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for j in range(max(1, len(t) - n + 1)):
            out[i, zlib.crc32(t[j : j + n].encode()) % dim] += 1
    return out


def embed_texts(df: DataFrame, text: str, fn: Callable[[list[str]], np.ndarray] = hashed_ngrams, kind: str = "passage") -> DataFrame:
    """Adds ``embedding`` (unit length) of the prefixed text; null texts count as empty.  A column of this name is replaced."""
    df = df.drop("embedding")

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = fn(batch.column(batch.num_columns - 1).to_pylist())
            v = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)).astype(np.float32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(v), pa.list_(pa.float32()))], [*batch.schema.names, "embedding"])

    name = fresh(df, "_text")
    asked = df.withColumn(name, prefixed(F.coalesce(text, F.lit("")), kind))
    return map_batches(asked, go, "embedding array<float>").drop(name)


def embed_once(df: DataFrame, text: str, fn: Callable[[list[str]], np.ndarray], store: str, kind: str = "passage", name: str | None = None) -> DataFrame:
    """As embed_texts(), but a text is embedded once, however many rows and runs ask for it: vectors are kept in the folder
    ``store`` by the SHA-256 of the prefixed text, and ``fn`` is called for the distinct texts that have none.

    ``name`` tells embedders apart (default: the callable's own; give a model's name and version).  The store only grows, by appended files;
    what two runs add at a time is the same.  Texts are pre-aggregated before they are shuffled, and a text of very many rows is
    joined by adaptive splitting.  Null texts count as empty; a column ``embedding`` is replaced."""
    spark, df = df.sparkSession, df.drop("embedding")
    name = name or f"{fn.__module__}.{fn.__qualname__}"
    path = f"{store.rstrip('/')}/{hashlib.sha256(name.encode()).hexdigest()[:16]}"
    key, got = fresh(df, "_key"), fresh(df, "_got")
    asked = keep(df.withColumn(key, F.sha2(prefixed(F.coalesce(text, F.lit("")), kind), 256)))
    texts = asked.groupBy(key).agg(F.first(F.coalesce(text, F.lit(""))).alias("_text")).select(F.col(key).alias("key"), "_text")

    def stored() -> DataFrame:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        return spark.read.schema(VECTORS).parquet(path) if found else spark.createDataFrame([], VECTORS)

    new = embed_texts(texts.join(stored().select("key"), "key", "left_anti"), "_text", fn, kind)
    new.select("key", "embedding").write.mode("append").parquet(path)
    vectors = stored().select(F.col("key").alias(got), "embedding")
    twice = vectors.groupBy(got).count().where("count > 1").limit(1).count()  # runs at a time may both have added a text
    vectors = vectors.dropDuplicates([got]) if twice else vectors
    return asked.join(vectors, F.col(key) == F.col(got)).select(*df.columns, "embedding")


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """Mean vectors by group, a row for each component."""
    return df.select(group, F.posexplode(vector).alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Lists of one length as rows of doubles."""
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def knn_topk(queries: DataFrame, children: DataFrame, k: int, keys: Sequence[str] = ("video_id", "store_mode"), part_rows: int = 20_000, block: int = 2_000, digits: int = 6) -> DataFrame:
    """The k children of each query's index with the largest inner product (rounded; ties: smaller child id): keys, query_id,
    child_id, chunk_id, score, rank.  Query ids tell queries of one index apart, not those of different lectures.

    A large index is dealt into parts by a hash; each part multiplies its vectors with a block of queries and passes on its own
    k best, so that no task sees a whole index and no pair is shuffled."""
    keys = list(keys)
    queries = keep(queries.select(*keys, "query_id", "embedding"))  # embedded once
    sizes = children.groupBy(*keys).count().withColumn("parts", F.ceil(F.col("count") / part_rows).cast("int")).drop("count")
    asks = queries.groupBy(*keys).count().withColumn("blocks", F.ceil(F.col("count") / block).cast("int")).drop("count")
    grid = sizes.join(asks, keys)
    c = children.join(grid, keys).withColumn("part", F.pmod(F.xxhash64("child_id"), F.col("parts")).cast("int")).withColumn("blk", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    q = queries.join(grid, keys).withColumn("blk", F.pmod(F.xxhash64("query_id"), F.col("blocks")).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    ends = [*keys, "part", "blk"]
    kind, child_kind = queries.schema["query_id"].dataType.simpleString(), children.schema["child_id"].dataType.simpleString()

    def best(q: pa.Table, c: pa.Table) -> pa.Table:
        """The k best of a part for each query, all of one score as the k-th first: ties go to the smaller child id."""
        row = col = np.empty(0, np.int64)
        score = np.empty((0, 0))
        if q.num_rows and c.num_rows:
            c = c.take(pc.sort_indices(c["child_id"]))
            score = np.round(matrix(q["embedding"]) @ matrix(c["embedding"]).T, digits)
            n = min(k, c.num_rows)
            least = -np.partition(-score, n - 1, axis=1)[:, n - 1]
            row, col = np.nonzero(score >= least[:, None])
            order = np.lexsort((col, -score[row, col], row))
            row, col = row[order], col[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            row, col = row[nth < n], col[nth < n]
        named = [q[name].take(pa.array(row)) for name in (*keys, "query_id")]
        kept = pa.array(score[row, col] if len(row) else [], pa.float64())
        return pa.table([*named, c["child_id"].take(pa.array(col)), c["chunk_id"].take(pa.array(col)), kept], [*keys, "query_id", "child_id", "chunk_id", "score"])

    cols = ["query_id", "embedding"]
    found = q.select(*ends, *cols).groupBy(*ends).cogroup(c.select(*[F.col(e).alias(f"c_{e}") for e in ends], "child_id", "chunk_id", "embedding").groupBy(*[f"c_{e}" for e in ends]))
    names = ", ".join(f"{name} {queries.schema[name].dataType.simpleString()}" for name in keys)
    found = found.applyInArrow(best, f"{names}, query_id {kind}, child_id {child_kind}, chunk_id string, score double")
    w = W.partitionBy(*keys, "query_id").orderBy(F.desc("score"), "child_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def parents_of(hits: DataFrame, k: int) -> DataFrame:
    """The first k distinct parents of ranked hits: video_id, store_mode, query_id, chunk_id, rank."""
    ids = ["video_id", "store_mode", "query_id"]
    first = hits.groupBy(*ids, "chunk_id").agg(F.min("rank").alias("hit"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy(*ids).orderBy("hit"))).where(F.col("rank") <= k).drop("hit")


def search(queries: DataFrame, children: DataFrame, parents: DataFrame, k: int = 3) -> DataFrame:
    """The 2k nearest children, their first k distinct parents, and the parents' documents; parents that are missing are
    left out after the cut."""
    ids = parents_of(knn_topk(queries, children, 2 * k), k)
    return ids.join(parents, ["video_id", "store_mode", "chunk_id"])


def aligned_ids(asr: DataFrame, ocr: DataFrame, k: int) -> DataFrame:
    """Ids of the speech side, then those of the slide side that are new, cut at k."""
    ids = ["video_id", "query_id"]
    both = asr.select(*ids, "chunk_id", F.lit(0).alias("side"), "rank").unionByName(ocr.select(*ids, "chunk_id", F.lit(1).alias("side"), "rank"))
    first = both.groupBy(*ids, "chunk_id").agg(F.min(F.struct("side", "rank")).alias("at"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy(*ids).orderBy("at"))).where(F.col("rank") <= k).drop("at")


def search_aligned(queries: DataFrame, children: DataFrame, parents: DataFrame, k: int = 3) -> DataFrame:
    """Half of the parents by speech, half by slide text, each looked up in both; queries (query_id, video_id, embedding)."""
    half = max(1, k // 2)
    sides = {m: parents_of(knn_topk(queries.withColumn("store_mode", F.lit(m)), children.where(F.col("store_mode") == m), 2 * half), half) for m in ("asr", "ocr")}
    ids = aligned_ids(sides["asr"], sides["ocr"], k)
    side = lambda m: parents.where(F.col("store_mode") == m).select("video_id", "chunk_id", *[F.col(c).alias(f"{m}_{c}") for c in ("page_content", "start_sec", "end_sec")])
    out = ids.join(side("ocr"), ["video_id", "chunk_id"], "left").join(side("asr"), ["video_id", "chunk_id"], "left")
    out = out.where("ocr_page_content is not null or asr_page_content is not null")
    asr = F.when(F.col("asr_page_content") != "", F.concat(F.lit("[音声]\n"), "asr_page_content")).otherwise("")
    content = joined("\n\n", F.coalesce("ocr_page_content", F.lit("")), F.coalesce(asr, F.lit("")))
    return out.select("query_id", "video_id", "chunk_id", "rank", F.coalesce("ocr_start_sec", "asr_start_sec").alias("start_sec"), F.coalesce("ocr_end_sec", "asr_end_sec").alias("end_sec"), content.alias("page_content"))


def contexts(found: DataFrame) -> DataFrame:
    """The parents of each lecture's queries in rank order as one text."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "page_content")))
    return found.groupBy("video_id", "query_id").agg(F.array_join(F.transform(rows, lambda s: s["page_content"]), CONTEXT_SEPARATOR).alias("context"))
