"""Retrieval documents: parents and children in three modes, statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import combined_text, hint_block, normalize_text, speech_text, strip
from lectern.operators.align import align_segments
from lectern.operators.chunk import char_budget_parents, slide_group_parents, split_children
from lectern.operators.retrieve import embed_once
from lectern.sources.indexes import write_index
from lectern.tables import keep, let_go, recorded

MODES = ("combined", "ocr", "asr")
PARENT = ("video_id", "store_mode", "chunk_id", "slide_ids", "start_sec", "end_sec", "image", "page_content")


def with_index_text(slides: DataFrame, strip_each: bool = False) -> DataFrame:
    """Normalised ``ocr_text`` and ``asr_text`` from full_text and the nested segments (which slide groups strip one by one)."""
    return slides.withColumn("ocr_text", normalize_text(F.col("full_text"))).withColumn("asr_text", normalize_text(speech_text(F.col("asr"), strip_each)))


def with_chunk_text(slides: DataFrame) -> DataFrame:
    """The same, only stripped, for question chunks."""
    return slides.withColumn("ocr_text", strip(F.coalesce("full_text", F.lit("")))).withColumn("asr_text", strip(speech_text(F.col("asr"))))


def in_three_modes(df: DataFrame, **texts) -> DataFrame:
    """A row for each mode, with ``store_mode`` and ``page_content``."""
    rows = F.array(*[F.struct(F.lit(m).alias("store_mode"), texts[m].alias("page_content")) for m in MODES])
    return df.withColumn("_m", F.explode(rows)).select("*", "_m.store_mode", "_m.page_content").drop("_m")


def char_documents(parents: DataFrame, size: int = 300, overlap: int = 30, use_hint: bool = True) -> tuple[DataFrame, DataFrame]:
    """Parents and children of char-budget groups.  The hint is split together with the text, so it stands in the first
    children alone; texts that are empty without it make none."""
    texts = dict(zip(MODES, (F.col("parent_text"), F.col("ocr_text"), F.col("asr_text")), strict=True))
    docs = in_three_modes(parents, **texts).where("page_content <> ''")
    hints = hint_block(F.col("hints")) if use_hint and "hints" in parents.columns else F.lit("")
    children = split_children(docs.withColumn("_t", F.concat(hints, "page_content")), "_t", size, overlap)
    children = children.select("video_id", "store_mode", "chunk_id", "child_index", F.concat("chunk_id", F.lit("_child_"), "child_index").alias("child_id"), F.col("child_text").alias("page_content"), "slide_ids", "start_sec")
    return docs.select(*PARENT), children


def slide_children(frames: DataFrame, group_size: int = 3, use_hint: bool = True) -> DataFrame:
    """A child for each frame (video_id, pos, frame_pos, frame_id, slide_id, mode, from_sec, to_sec, ocr_text, asr_text).  child_index
    counts all frames of a group, also those that make no child; a hint alone keeps one."""
    f = frames.withColumn("g", F.floor(F.col("pos") / group_size).cast("int"))
    f = f.withColumn("child_index", F.row_number().over(W.partitionBy("video_id", "g").orderBy("pos", "frame_pos")) - 1)
    hints = hint_block(F.col("hints")) if use_hint and "hints" in frames.columns else F.lit("")
    texts = dict(zip(MODES, (combined_text(F.col("ocr_text"), F.col("asr_text")), F.col("ocr_text"), F.col("asr_text")), strict=True))
    c = in_three_modes(f, **texts).withColumn("page_content", F.concat(hints, "page_content")).where(strip(F.col("page_content")) != "")
    chunk = F.format_string("parent_%04d", "g")
    return c.select("video_id", "store_mode", chunk.alias("chunk_id"), "child_index", F.concat(chunk, F.lit("_child_"), "child_index").alias("child_id"), "slide_id", "frame_id", "mode", F.col("from_sec").alias("start_sec"), F.col("to_sec").alias("end_sec"), "page_content")


def slide_documents(parents: DataFrame, frames: DataFrame, group_size: int = 3, use_hint: bool = True) -> tuple[DataFrame, DataFrame]:
    """Parents of slide groups in three modes, and their frames' children."""
    texts = dict(zip(MODES, (F.col("combined_text"), F.col("ocr_text"), F.col("asr_text")), strict=True))
    docs = in_three_modes(parents, **texts).where("page_content <> ''")
    return docs.select(*PARENT), slide_children(frames, group_size, use_hint)


def index_stats(docs: DataFrame) -> DataFrame:
    return docs.groupBy("video_id", "store_mode").agg(F.count("*").alias("n_docs"), F.sum(F.length("page_content")).alias("n_chars"))


def build_stats(slides: DataFrame, parents: DataFrame, children: DataFrame) -> DataFrame:
    """Of each lecture: ``n_slides``, ``ocr_chars`` (of the slide texts that are not blank, stripped), ``n_chunks`` (distinct parents), and
    ``docs``: a map from mode to the numbers of parent and child documents."""
    s = slides.groupBy("video_id").agg(F.count("*").alias("n_slides"), F.sum(F.length(strip(F.coalesce("full_text", F.lit(""))))).alias("ocr_chars"))
    p = parents.groupBy("video_id", "store_mode").agg(F.count("*").alias("parents"))
    c = children.groupBy("video_id", "store_mode").agg(F.count("*").alias("children"))
    docs = p.join(c, ["video_id", "store_mode"], "full").select("video_id", F.struct("store_mode", F.struct(F.coalesce("parents", F.lit(0)).alias("parents"), F.coalesce("children", F.lit(0)).alias("children"))).alias("e"))
    docs = docs.groupBy("video_id").agg(F.map_from_entries(F.array_sort(F.collect_list("e"))).alias("docs"))  # three modes
    chunks = parents.select("video_id", "chunk_id").distinct().groupBy("video_id").agg(F.count("*").alias("n_chunks"))
    return s.join(chunks, "video_id", "left").join(docs, "video_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def build_char_index(slides: DataFrame, base: str, fn: Callable, budget: int = 1000, size: int = 300, overlap: int = 30, use_hint: bool = True, embedder: str | None = None) -> int:
    """Slides (video_id, pos, slide_id, start_sec, end_sec, full_text, asr, and image, proper_nouns if there are) to a written
    index of char-budget parents and embedded children.  Vectors are kept beside the index, so that a text is embedded once, in all
    builds (see embed_once() for ``embedder``).  Returns the number of the snapshot."""
    with recorded() as made:
        parents, children = char_documents(keep(char_budget_parents(with_index_text(slides), budget)), size, overlap, use_hint)
        number = write_index(parents, children, base, lambda c: embed_once(c, "page_content", fn, f"{base}/vectors", name=embedder))
        let_go(made)
    return number


def build_slide_index(slides: DataFrame, frames: DataFrame, segments: DataFrame, base: str, fn: Callable, group_size: int = 3, use_hint: bool = True, embedder: str | None = None) -> int:
    """The same from groups of slides; children are frames with the speech that starts in them.  Frames: see
    align_segments(), with frame_id, slide_id, mode, ocr, and hints if there are; segments: video_id, pos, seg_pos, start_sec, text."""
    with recorded() as made:
        spoken = align_segments(frames, segments)
        spoken = spoken.withColumn("ocr_text", normalize_text(F.col("ocr"))).withColumn("asr_text", normalize_text(F.col("asr_text")))
        groups = slide_group_parents(with_index_text(slides, strip_each=True), group_size)
        parents, children = slide_documents(groups, spoken, group_size, use_hint)
        number = write_index(parents, children, base, lambda c: embed_once(c, "page_content", fn, f"{base}/vectors", name=embedder))
        let_go(made)
    return number
