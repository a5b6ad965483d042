"""Speech segments against frames and slides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.scans import neighbours, parts_for
from lectern.tables import keep, let_go, recorded


def frame_intervals(frames: DataFrame) -> DataFrame:
    """Adds ``from_sec`` and ``to_sec``: from a frame's detection to the next one's, or its slide's end."""
    f = frames.withColumn("from_sec", F.coalesce("detect_time", "time", F.lit(0.0)))
    f = neighbours(f, ["video_id", "pos"], ["frame_pos"], after={"to_sec": F.col("from_sec")}, parts=parts_for(frames))
    return f.withColumn("to_sec", F.coalesce("to_sec", "slide_end"))


def align_segments(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Each frame (video_id, pos, frame_pos, detect_time, time, slide_end) with ``asr_text``: its slide's segments that start in
    [from_sec, to_sec), stripped, a line each.  Frames without speech stay; frames of equal times get none but the last.

    Where a slide's frames are in the order of time, a segment can only be the last frame's at or before it: a scan over
    frames and segments in the order of time, by ranges, so that a slide may have any number of either.  Slides whose frames
    go back in time are joined frame by segment."""
    place = ["video_id", "pos"]
    f = keep(frame_intervals(frames))
    spoken = segments.where(strip(F.coalesce("text", F.lit(""))) != "").select(*place, "seg_pos", F.col("start_sec").alias("at"), strip(F.col("text")).alias("line"))
    with recorded() as made:
        back = keep(neighbours(f.select(*place, "frame_pos", "from_sec"), place, ["frame_pos"], after={"_next": F.col("from_sec")}, parts=parts_for(f)).where("_next < from_sec").select(*place).distinct())
        none = F.lit(None)
        both = f.join(back, place, "left_anti").select(*place, F.col("from_sec").alias("at"), F.lit(0).alias("kind"), F.col("frame_pos").cast("long").alias("nth"), F.struct("frame_pos", "to_sec").alias("frame"), none.cast("string").alias("line"))
        both = both.unionByName(spoken.select(*place, "at", F.lit(1).alias("kind"), F.col("seg_pos").cast("long").alias("nth"), none.cast(both.schema["frame"].dataType).alias("frame"), "line"))
        hits = neighbours(both, place, ["at", "kind", "nth"], before={"_frame": F.col("frame")}, parts=parts_for(both)).where("kind = 1 and at < _frame.to_sec").select(*place, F.col("_frame.frame_pos").alias("frame_pos"), "nth", "line")
        odd = f.join(back, place, "left_semi").select(*place, "frame_pos", "from_sec", "to_sec").join(spoken, place).where("at >= from_sec and at < to_sec")
        hits = hits.unionByName(odd.select(*place, "frame_pos", F.col("seg_pos").cast("long").alias("nth"), "line"))
        lines = keep(hits.groupBy(*place, "frame_pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda s: s["line"]), "\n").alias("asr_text")))
        let_go(made, lines)
    return f.join(lines, [*place, "frame_pos"], "left").withColumn("asr_text", F.coalesce("asr_text", F.lit("")))


def frame_time_ranges(frames: DataFrame) -> DataFrame:
    """Adds ``time_range`` to animation frames (others: null): from detection to the next frame's, or the slide's end."""
    f = frame_intervals(frames)
    span = F.struct(F.round("from_sec", 3).alias("start_sec"), F.round("to_sec", 3).alias("end_sec"))
    return f.withColumn("time_range", F.when(F.col("mode") == "animation", span))


def slide_ranges(slides: DataFrame, durations: DataFrame) -> DataFrame:
    """Start and end of slides; without times, from the first frame and the next slide's start."""
    start = F.coalesce("start_sec", "first_frame_time", F.lit(0.0))
    s = slides.join(durations, "video_id", "left").withColumn("from_sec", start)
    s = neighbours(s, ["video_id"], ["pos"], after={"_next": F.col("from_sec")}, parts=parts_for(slides))
    return s.withColumn("to_sec", F.coalesce("end_sec", "_next", "duration", "from_sec")).drop("_next")


def rebase_segments(raw: DataFrame, ranges: DataFrame) -> DataFrame:
    """Times within a slide's sound to times of the lecture; blank texts and slides of no length give none."""
    r = ranges.where("to_sec > from_sec").select("video_id", "pos", F.col("from_sec").alias("base"))
    s = raw.where(strip(F.coalesce("text", F.lit(""))) != "").join(r, ["video_id", "pos"])
    moved = [F.round(F.round(F.col(c), 3) + F.col("base"), 3).alias(c) for c in ("start_sec", "end_sec")]
    return s.select("video_id", "pos", "seg_pos", *moved, strip(F.col("text")).alias("text"))
