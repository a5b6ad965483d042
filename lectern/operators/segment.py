"""From detections to slides: thresholds, classes, debouncing, sessions, time ranges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.scans import chains, first_reaching, least_with_gap, neighbours, parts_for
from lectern.tables import keep, let_go, recorded, running_totals

LEAST_SCORE, COARSE, RATIO, SAME, INTERVAL = 0.005, 5.0, 0.6, 0.99, 1.5


def scored(detections: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    return detections.where(F.col("score") >= least)


def classify_change(score: Column, ratio: Column, distributed: Column) -> Column:
    """Coarse changes count if they are spread over the picture, fine ones if they cover most of it."""
    return F.when(F.when(score >= COARSE, distributed).otherwise(ratio >= RATIO), "change").otherwise("animation")


def block_stats(blocks: Column) -> Column:
    """Of a square of block similarities: share of changed blocks, spread over rows and columns, mean."""
    n = F.size(blocks)
    flat = F.flatten(blocks)
    changed = F.size(F.filter(flat, lambda x: x < 0.95)) / (n * n)
    rounded = F.transform(blocks, lambda r: F.transform(r, lambda x: F.round(x, 4)))
    rows = F.size(F.filter(rounded, lambda r: F.exists(r, lambda x: x < 0.95)))
    columns = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda j: F.exists(rounded, lambda r: F.get(r, j) < 0.95)))
    mean = F.aggregate(F.flatten(rounded), F.lit(0.0), lambda s, x: s + x) / (n * n)
    half = F.floor(n / 2)
    return F.struct(F.round(changed, 4).alias("changed_ratio"), ((rows >= half) & (columns >= half)).alias("is_distributed"), F.round(mean, 4).alias("mean_ssim"))


def _window_mean(x: np.ndarray, size: int = 7) -> np.ndarray:
    pad = np.pad(x, size // 2, mode="symmetric")
    total = np.pad(pad, ((1, 0), (1, 0))).cumsum(0).cumsum(1)
    return (total[size:, size:] - total[:-size, size:] - total[size:, :-size] + total[:-size, :-size]) / size**2


def structural_similarity(a: np.ndarray, b: np.ndarray, span: float = 255.0) -> float:
    """Mean structural similarity over windows of 7 by 7 pixels (those that lie inside the picture)."""
    a, b, n = a.astype(float), b.astype(float), 49 / 48
    ma, mb = _window_mean(a), _window_mean(b)
    va, vb, vab = (n * (_window_mean(x) - m) for x, m in ((a * a, ma * ma), (b * b, mb * mb), (a * b, ma * mb)))
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    s = (2 * ma * mb + c1) * (2 * vab + c2) / ((ma**2 + mb**2 + c1) * (va + vb + c2))
    return float(s[3:-3, 3:-3].mean())


def block_similarity(frames: DataFrame, grid: int = 4) -> DataFrame:
    """(video_id, time, pixels array<array<int>>) to (video_id, time, block_scores): each frame against the readable
    one before it, block by block; remainders of rows and columns are ignored.  Which frames are compared is found from their
    times alone; pixels are shuffled to their partners, and never sorted.  Times of a lecture differ.  A lecture whose first frame
    can't be read has no rows."""
    times = keep(frames.select("video_id", "time", F.when(F.col("pixels").isNotNull(), F.col("time")).alias("read")))
    void = times.groupBy("video_id").agg(F.min_by(F.col("read").isNull(), "time").alias("void")).where("void").select("video_id")
    before = neighbours(times, ["video_id"], ["time"], before={"was": F.col("read")}, parts=parts_for(times)).where("read is not null and was is not null")
    before = before.join(void, "video_id", "left_anti").select("video_id", "time", "was")
    now = frames.select("video_id", "time", "pixels").join(before, ["video_id", "time"])
    pairs = now.join(frames.select("video_id", F.col("time").alias("was"), F.col("pixels").alias("before")), ["video_id", "was"]).select("video_id", "time", "before", "pixels")

    def compare(batches):
        for pdf in batches:
            out = []
            for a, b in zip(pdf.before, pdf.pixels, strict=True):
                a, b = np.array([list(r) for r in a]), np.array([list(r) for r in b])
                h, w = a.shape[0] // grid, a.shape[1] // grid
                out.append([[structural_similarity(a[i * h : i * h + h, j * w : j * w + w], b[i * h : i * h + h, j * w : j * w + w]) for j in range(grid)] for i in range(grid)])
            yield pd.DataFrame({"video_id": pdf.video_id, "time": pdf.time, "block_scores": out})

    return pairs.mapInPandas(compare, "video_id string, time double, block_scores array<array<double>>")


def debounce(detections: DataFrame, interval: float = INTERVAL) -> DataFrame:
    """Keeps a detection if ``interval`` seconds have passed since the last one kept; the first always stays, of equal times
    only the first by det_pos.  Detections without a time are left out.

    For each time the first one that is late enough after it is searched among all times of the lecture; the chain of
    these jumps from the first time gives those kept.  Only times are moved, and no task needs a whole lecture."""
    timed = detections.where(F.col("time").isNotNull())
    if interval <= 0:
        return timed
    with recorded() as made:
        times = timed.groupBy("video_id", "time").agg(F.min("det_pos").alias("det_pos"))
        placed = keep(running_totals(times, ["video_id"], ["time"]).drop("sum_before").withColumnRenamed("rows_before", "nth"))
        parts = parts_for(placed)
        asks = placed.select("video_id", "time", "det_pos", "nth", least_with_gap(F.col("time"), interval).alias("value"))
        nodes = first_reaching(placed.select("video_id", F.col("time").alias("value"), "nth"), asks, ["video_id"], "value", F.col("nth"), "next", parts)
        kept = chains(nodes.select("video_id", "time", "det_pos", "nth", "next"), ["video_id"], parts)
        let_go(made, kept)
    return timed.join(kept.where("starts").select("video_id", "time", "det_pos"), ["video_id", "time", "det_pos"], "left_semi")


def segment_slides(detections: DataFrame, interval: float = INTERVAL) -> DataFrame:
    """(video_id, time, det_pos, score, changed_ratio, is_distributed, mean_ssim, ocr) to frames: classified, near-identical ones
    dropped, debounced, numbered.  The first frame starts slide 1, every later change a new slide."""
    d = scored(detections)
    place = ["video_id", "time", "det_pos"]
    first = d.groupBy("video_id").agg(F.min(F.struct("time", "det_pos")).alias("_first"))
    d = d.join(first, "video_id").withColumn("_first", (F.col("time") == F.col("_first.time")) & (F.col("det_pos") == F.col("_first.det_pos")))
    d = d.withColumn("mode", F.when(F.col("_first"), "change").otherwise(classify_change(F.col("score"), F.col("changed_ratio"), F.col("is_distributed"))))
    d = keep(debounce(d.where(F.col("_first") | F.col("mean_ssim").isNull() | (F.col("mean_ssim") < SAME)).drop("_first"), interval))
    with recorded() as made:
        counted = keep(running_totals(d.select(*place, (F.col("mode") == "change").cast("long").alias("new")), ["video_id"], ["time", "det_pos"], F.col("new")))
        counted = neighbours(counted, ["video_id"], ["rows_before"], before={"_start": F.when(F.col("new") == 1, F.col("rows_before"))}, parts=parts_for(counted))
        start = F.when(F.col("new") == 1, F.col("rows_before")).otherwise(F.col("_start"))
        counted = keep(counted.select(*place, (F.col("sum_before") + F.col("new")).alias("slide_no"), (F.col("rows_before") - start + 1).cast("int").alias("picture_no")))
        let_go(made, counted)
    slide = F.concat(F.lit("slide"), F.col("slide_no"))
    return d.join(counted, place).withColumn("slide_id", slide).withColumn("frame_id", F.concat(slide, F.lit("_picture"), F.col("picture_no"))).select(*d.columns, "slide_no", "picture_no", "slide_id", "frame_id")


def time_ranges(frames: DataFrame, durations: DataFrame) -> DataFrame:
    """Slides from their first detection to the next slide's, or the end of the video; the text is the last frame's."""
    s = frames.groupBy("video_id", "slide_no", "slide_id").agg(F.min("time").alias("start_sec"), F.max_by("ocr", F.struct("time", "det_pos")).alias("full_text"), F.count("*").cast("long").alias("n_frames"))
    s = s.join(durations, "video_id", "left")
    s = keep(s)
    s = neighbours(s, ["video_id"], ["slide_no"], after={"_next": F.col("start_sec")}, parts=parts_for(s))
    return s.select("video_id", "slide_no", "slide_id", F.round("start_sec", 3).alias("start_sec"), F.round(F.coalesce("_next", "duration"), 3).alias("end_sec"), "full_text", "n_frames")
