"""Reading and writing lectures, indexes, questions, scores, logs."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schemas
from lectern.functions.text import transcript_block
from lectern.sources.parts import BLANK, text_parts, unescaped, write_text_parts
from lectern.tables import let_go, recorded


def _parsed(spark: SparkSession, path: str, schema: str, start: str) -> DataFrame:
    """Each file of a path as ``v`` (null if it is no JSON of the schema, which begins with ``start``), with ``file`` and ``error``.  Small
    files are packed into partitions by their bytes; a file is a row."""
    df = spark.read.format("binaryFile").load(path).select(F.col("content").cast("string").alias("value"), F.col("_metadata.file_path").alias("file"))  # empty files too
    broken = "v._bad is not null" if start == "{" else "false"
    df = df.withColumn("v", F.from_json("value", f"{schema}, _bad string" if start == "{" else schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("v").isNull() | F.expr(broken) | ~F.ltrim("value").startswith(start)
    return df.select("file", F.when(~bad, F.col("v")).alias("v"), F.when(bad, F.concat(F.lit("no JSON of the kind expected: "), F.substring("value", 1, 80))).alias("error"))


def read_lectures(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """One JSON object a file; the folder's name is the lecture's id.  Broken files are left out; with ``errors`` they are rows that
    say so (``file``, ``error``) instead; empty files are no rows for Spark's readers."""
    df = _parsed(spark, path, schemas.LECTURE, "{")
    folder = unescaped(F.element_at(F.split("file", "/"), -2))
    folder = F.when(folder.startswith("video_id="), unescaped(F.substring(folder, len("video_id=") + 1, 1 << 30))).otherwise(folder)
    df = df.select(folder.alias("video_id"), "v.meta", "v.slides", "file", "error")
    return df if errors else df.where("error is null").drop("file", "error")


def slides(lectures: DataFrame) -> DataFrame:
    s = lectures.select("video_id", F.posexplode("slides").alias("pos", "s"))
    return s.select("video_id", "pos", "s.slide_id", F.coalesce("s.time.start_sec", F.lit(0.0)).alias("start_sec"), F.coalesce("s.time.end_sec", F.lit(0.0)).alias("end_sec"), "s.full_text", "s.proper_nouns", "s.frames", "s.asr", "s.asr_no_prompt")


def frames(lectures: DataFrame) -> DataFrame:
    s = slides(lectures)
    return s.select("video_id", "pos", "slide_id", F.col("end_sec").alias("slide_end"), F.posexplode("frames").alias("frame_pos", "f")).select("video_id", "pos", "slide_id", "slide_end", "frame_pos", F.col("f.id").alias("frame_id"), "f.time", "f.detect_time", "f.mode", "f.image", "f.ocr")


def segments(lectures: DataFrame, field: str = "asr") -> DataFrame:
    return slides(lectures).select("video_id", "pos", F.posexplode(field).alias("seg_pos", "g")).select("video_id", "pos", "seg_pos", "g.*")


def nest_lectures(lectures: DataFrame, slides_df: DataFrame, frames_df: DataFrame | None = None, segments_df: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    """Rows back to one document a lecture: slides (video_id, pos, and fields of a slide), frames (video_id, pos, frame_pos, and fields
    of a frame), segments (video_id, pos, seg_pos, start_sec, end_sec, text), and terms (video_id, terms) for the lecture's meta.
    What is given replaces what slides and meta held."""
    place = ["video_id", "pos"]
    for rows, name, nth in ((frames_df, "frames", "frame_pos"), (segments_df, "asr", "seg_pos")):
        if rows is not None:
            inner = rows.groupBy(*place).agg(F.array_sort(F.collect_list(F.struct(nth, F.struct(*[c for c in rows.columns if c not in (*place, nth)]).alias("v")))).alias("_n"))
            slides_df = slides_df.drop(name).join(inner, place, "left").withColumn(name, F.coalesce(F.transform("_n", lambda r: r["v"]), F.array())).drop("_n")
    fields = [c for c in slides_df.columns if c not in place]
    rows = F.array_sort(F.collect_list(F.struct("pos", F.struct(*fields).alias("s"))))
    nested = slides_df.groupBy("video_id").agg(F.transform(rows, lambda r: r["s"]).alias("slides"))
    out = lectures.select("video_id", "meta").join(nested, "video_id", "left")
    if terms is not None:
        out = out.join(terms.select("video_id", "terms"), "video_id", "left")
        out = out.withColumn("meta", F.col("meta").withField("proper_nouns_global", F.coalesce("terms", "meta.proper_nouns_global"))).drop("terms")
    return out


def write_lectures(lectures: DataFrame, slides_df: DataFrame, path: str, **parts: DataFrame) -> None:
    """Writes nest_lectures(), a folder for each lecture, at a new path."""
    nest_lectures(lectures, slides_df, **parts).write.partitionBy("video_id").json(path)


def read_questions(spark: SparkSession, path: str, errors: bool = False) -> DataFrame:
    """A JSON array of objects a file; ``file`` and ``ordinal`` keep the order of each file.  Broken files are left out; with ``errors`` they
    are rows that say so (``error``) instead."""
    df = _parsed(spark, path, f"array<struct<{schemas.QUESTION_FIELDS}>>", "[")
    rows = df.where("error is null").select("file", F.posexplode("v").alias("ordinal", "q")).select("q.*", "file", "ordinal")
    return rows.unionByName(df.where("error is not null").select("file", "error"), allowMissingColumns=True) if errors else rows


def append_questions(old: DataFrame, new: DataFrame) -> DataFrame:
    """All old and new rows; nothing is merged."""
    return old.unionByName(new, allowMissingColumns=True)


def write_questions(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("method").parquet(path)


def transcript_blocks(slides_df: DataFrame, field: str = "asr") -> DataFrame:
    """(video_id, pos, slide_id, start_sec, end_sec, segments) to ``video_id``, ``pos``, ``block``: each slide's part of the transcript."""
    return slides_df.select("video_id", "pos", transcript_block(F.col("slide_id"), F.col("start_sec"), F.col("end_sec"), F.col(field)).alias("block"))


def transcripts(slides_df: DataFrame, field: str = "asr") -> DataFrame:
    """One text a lecture, which must fit a row; transcript_parts() has no such limit."""
    rows = F.array_sort(F.collect_list(F.struct("pos", F.col("block").alias("b"))))
    return transcript_blocks(slides_df, field).groupBy("video_id").agg(F.array_join(F.transform(rows, lambda r: r["b"]), BLANK).alias("value"))


def transcript_parts(slides_df: DataFrame, field: str = "asr", size: int = 1 << 20) -> DataFrame:
    """The transcripts in parts (see text_parts())."""
    return text_parts(transcript_blocks(slides_df, field), "block", size)


def export_transcripts(slides_df: DataFrame, path: str, field: str = "asr", size: int = 1 << 20) -> None:
    """Text files of many parts (see write_text_parts()); a long transcript is several parts, a short one shares its file with others."""
    with recorded() as made:
        write_text_parts(transcript_parts(slides_df, field, size), path)
        let_go(made)


def chunk_inputs(chunks: DataFrame) -> DataFrame:
    """What goes to the model for each chunk, nested."""
    inner = [c for c in ("ocr_text", "asr_text", "seeds", "rag_context", "cot_text") if c in chunks.columns]
    return chunks.select("video_id", "chunk_id", "slide_ids", "start_sec", "end_sec", F.struct(*inner).alias("llm_input"))


def export_chunk_inputs(chunks: DataFrame, path: str) -> None:
    chunk_inputs(chunks).write.json(path)


def write_scores(scores: DataFrame, path: str) -> None:
    scores.write.mode("append").partitionBy("settings_hash").parquet(path)


def append_score_table(scores: DataFrame, name: str, path: str | None = None, buckets: int = 64) -> None:
    """Appends scores to a table of the catalog, by settings, bucketed and sorted by lecture, question and model: what is pending
    (see scoring.pending) is found without moving what is stored.  ``path``: where the table's files are (default: the warehouse)."""
    keys = ["video_id", "question_id", "model"]
    w = scores.repartition(buckets, *keys).write.mode("append").format("parquet").partitionBy("settings_hash").bucketBy(buckets, *keys).sortBy(*keys)
    (w.option("path", path) if path else w).saveAsTable(name)


def write_summary(summary: DataFrame, settings: Mapping[str, object], path: str) -> None:
    summary.withColumn("settings", F.struct(*[F.lit(v).alias(k) for k, v in settings.items()])).write.json(path)


def parse_scene_log(lines: DataFrame) -> DataFrame:
    """Log lines with a score and a time to (time, score)."""
    number = r"([0-9]+(?:\.[0-9]+)?)"
    found = lines.where(F.col("value").contains("lavfi.scd.score")).select(*[c for c in lines.columns if c != "value"], F.regexp_extract("value", rf"lavfi\.scd\.time:\s*{number}", 1).alias("t"), F.regexp_extract("value", rf"lavfi\.scd\.score:\s*{number}", 1).alias("s"))
    return found.where("t <> '' and s <> ''").withColumn("time", F.col("t").cast("double")).withColumn("score", F.col("s").cast("double")).drop("t", "s")


def read_scene_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_scene_log(spark.read.text(path).withColumn("file", F.col("_metadata.file_path")))


def load_axes(spark: SparkSession, built_in: Mapping[str, str], names: Sequence[str] | None = None, file: str | None = None) -> DataFrame:
    """Axes of a JSON file {name: description}, or the built-in ones of the names given (all, if none is known)."""
    if file:
        df = spark.read.text(file, wholetext=True).select(F.posexplode(F.map_entries(F.from_json("value", "map<string,string>"))).alias("axis_ord", "e"))
        return df.select("axis_ord", F.col("e.key").alias("axis"), F.col("e.value").alias("description"))
    unknown = [n for n in names or () if n not in built_in]
    if unknown:
        warnings.warn(f"unknown axes: {', '.join(unknown)}", stacklevel=2)
    chosen = [n for n in names or () if n in built_in] or list(built_in)
    return spark.createDataFrame([(i, n, built_in[n]) for i, n in enumerate(chosen)], schemas.AXIS)
