"""Terms that recur in a lecture, and keywords of chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lectern.functions.text import strip
from lectern.sources.parts import text_parts
from lectern.tables import fits, keep, keep_last

TERM = r"[\p{L}]{3,}"

#: Distinct (lecture, term) pairs that a task counts before it gives its summary and begins another one.
PAIRS = 1_000_000


def _terms(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    return df.select(*keys, F.explode(F.regexp_extract_all(F.lower(text), F.lit(f"({TERM})"), 1)).alias("term"))


def _on_slide(slides: DataFrame) -> DataFrame:
    """The distinct terms of each slide, told apart within its row."""
    found = F.array_distinct(F.regexp_extract_all(F.lower("full_text"), F.lit(f"({TERM})"), 1))
    return slides.select("video_id", found.alias("found"))


def _counted(on_slide: DataFrame) -> DataFrame:
    return on_slide.select("video_id", F.explode("found").alias("term")).groupBy("video_id", "term").agg(F.count("*").alias("n_slides"))


def _most(seen: DataFrame, n: int) -> DataFrame:
    return seen.withColumn("rank", F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("n_slides"), "term"))).where(F.col("rank") <= n)


def recurring_terms(slides: DataFrame, n: int = 15) -> DataFrame:
    """The n terms of each lecture that are on the most slides (video_id, pos: a row each).  A slide's terms are told apart within
    its row, so only counts by task are shuffled."""
    return _most(_counted(_on_slide(slides)), n)


def _summaries(size: int, pairs: int):
    """Counts the terms of each lecture within a task and gives the ``size`` most frequent ones, and, where others are left out, a row
    without a term: the largest count among those (``miss``, on every row of the lecture)."""

    def add(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(["video_id", "term"]).aggregate([("n", "sum")])
        return out.rename_columns(["video_id", "term", "n"])

    def give(counts: pa.Table) -> pa.RecordBatch:
        lecture = counts["video_id"].combine_chunks().dictionary_encode(null_encoding="encode")
        code, n = lecture.indices.to_numpy(zero_copy_only=False), counts["n"].to_numpy()
        order = np.lexsort((-n, code))
        code, n = code[order], n[order]
        first = np.r_[True, code[1:] != code[:-1]]
        start = np.flatnonzero(first)[np.cumsum(first) - 1]
        rank = np.arange(len(code)) - start
        miss = np.zeros(code.max() + 1, np.int64)
        cut = np.flatnonzero(rank == size)
        miss[code[cut]] = n[cut]
        held = np.concatenate([order[rank < size], order[cut]])
        term = counts["term"].combine_chunks().take(pa.array(held))
        mark = np.r_[np.zeros(len(held) - len(cut), bool), np.ones(len(cut), bool)]
        return pa.RecordBatch.from_arrays(
            [counts["video_id"].combine_chunks().take(pa.array(held)), pc.if_else(pa.array(mark), pa.scalar(None, term.type), term), pa.array(np.r_[n[rank < size], np.zeros(len(cut), np.int64)]), pa.array(np.r_[miss[code[rank < size]], n[cut]])],
            ["video_id", "term", "n", "miss"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = known = 0  # known: rows right after the last addition
        for b in batches:
            at = pc.list_parent_indices(b.column("found"))
            t = pa.table([b.column("video_id").take(at), pc.list_flatten(b.column("found")), pa.repeat(pa.scalar(1, pa.int64()), len(at))], names=["video_id", "term", "n"])
            held.append(add([t]))
            rows += held[-1].num_rows
            if rows > max(pairs, 2 * known):
                held = [add(held)]
                rows = known = held[0].num_rows
                if rows > pairs:
                    yield give(held[0])
                    held, rows, known = [], 0, 0
        if rows:
            yield give(add(held))

    return run


def recurring_terms_summed(slides: DataFrame, n: int = 15, size: int | None = None, pairs: int = PAIRS) -> DataFrame:
    """The rows of recurring_terms(), counted by mergeable summaries, for lectures whose vocabulary is much larger than what recurs.

    Each task gives the ``size`` (default 8 n) most frequent terms of a lecture among its slides, and the largest count that it leaves out.  The sum of
    a term's counts is the least that it can have; with what the tasks without it may have left out, the most.  Terms whose most
    reaches the n-th greatest least are candidates.  Where a task left one of them out, slides are read again, for these lectures and terms alone.
    Where even a term that every task left out could be among the n, the lecture is counted in full, so the rows are always the exact ones.

    The lectures and terms of the second reading are broadcast if they are few (tables.fits); beyond that these lectures are counted in
    full too.  Slides without terms count nothing; a null lecture is a lecture; no slides give no rows.  What is returned is a kept table."""

    def make() -> DataFrame:
        found = _on_slide(slides)
        schema = StructType([found.schema["video_id"], *StructType.fromDDL("term string, n long, miss long").fields])
        sums = keep(found.mapInArrow(_summaries(max(n, size or 8 * n), pairs), schema))
        merged = sums.groupBy("video_id", "term").agg(F.sum("n").alias("low"), F.sum("miss").alias("seen"))
        nth = _most(merged.where("term is not null").withColumnRenamed("low", "n_slides"), n).groupBy("video_id").agg(F.when(F.count("*") == n, F.min("n_slides")).otherwise(0).alias("reach"))
        left_out = merged.where("term is null").select(F.col("video_id").alias("_v"), F.col("seen").alias("left_out"))
        bounds = nth.join(left_out, F.col("video_id").eqNullSafe(F.col("_v")), "left").select(F.col("video_id").alias("_v"), "reach", F.coalesce("left_out", F.lit(0)).alias("left_out"))
        rows = merged.where("term is not null").join(bounds, F.col("video_id").eqNullSafe(F.col("_v"))).withColumn("high", F.expr("low + left_out - seen"))
        rows = keep(rows.where("high >= reach").select("video_id", "term", "low", "high", F.expr("left_out > 0 and left_out >= reach").alias("in_full")))
        again = keep(rows.groupBy(F.col("video_id").alias("_v")).agg(F.max("in_full").alias("in_full"), F.max(F.col("high") > F.col("low")).alias("open")).where("in_full or open"))
        same = F.col("video_id").eqNullSafe(F.col("_v"))
        known = rows.join(again, same, "left_anti").select("video_id", "term", F.col("low").alias("n_slides"))
        parts, full = [known], again.select("_v")  # beyond what fits, all of these are counted in full
        asked = rows.join(again.where("not in_full"), same, "left_semi").select("video_id", "term")
        if fits(asked):
            asked = asked.groupBy(F.col("video_id").alias("_v")).agg(F.collect_list("term").alias("terms"))
            full = again.where("in_full").select("_v")
            if not asked.isEmpty():
                parts.append(_counted(found.join(F.broadcast(asked), same).select("video_id", F.array_intersect("found", "terms").alias("found"))))
        if not full.isEmpty():
            parts.append(_counted(found.join(F.broadcast(full), same, "left_semi")) if fits(full) else _counted(found).join(full, same, "left_semi"))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return _most(out, n)

    return keep_last(make)


def chunk_keywords(chunks: DataFrame, n: int = 10) -> DataFrame:
    """The n terms of each chunk (video_id, chunk_id, text) by count times log(chunks / chunks with the term)."""
    tf = _terms(chunks, ["video_id", "chunk_id"], "text").groupBy("video_id", "chunk_id", "term").agg(F.count("*").alias("tf"))
    tf = keep(tf)  # the texts are read once; both sides of the join are kept, so that a term of very many chunks can be split
    df = keep(tf.groupBy("term").agg(F.count("*").alias("df")))
    total = chunks.select("video_id", "chunk_id").distinct().count()
    scored = tf.join(df, "term").withColumn("weight", F.round(F.col("tf") * F.ln(F.lit(total) / F.col("df")), 6))
    return scored.withColumn("rank", F.row_number().over(W.partitionBy("video_id", "chunk_id").orderBy(F.desc("weight"), "term"))).where(F.col("rank") <= n).select("video_id", "chunk_id", "term", "tf", "df", "weight", "rank")


def lecture_ocr(slides: DataFrame) -> DataFrame:
    """All slide texts that are not blank, stripped, in order: one row for each lecture, so its texts must
    fit a row (2 GB); lecture_ocr_parts() has no such limit."""
    kept = slides.withColumn("t", strip(F.coalesce("full_text", F.lit("")))).where("t <> ''")
    rows = F.array_sort(F.collect_list(F.struct("pos", "t")))
    return kept.groupBy("video_id").agg(F.array_join(F.transform(rows, lambda s: s["t"]), "\n\n").alias("ocr_text"))


def lecture_ocr_parts(slides: DataFrame, size: int = 1 << 20) -> DataFrame:
    """The text of lecture_ocr() in parts (see text_parts())."""
    return text_parts(slides.select("video_id", "pos", strip(F.coalesce("full_text", F.lit(""))).alias("t")).where("t <> ''"), "t", size)
