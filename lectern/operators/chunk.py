"""Cutting lectures into chunks: by speech budget, slide count, sliding windows, elapsed time; splitting text."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import combined_text, joined
from lectern.scans import chains, first_reaching, least_with_gap, neighbours, parts_for
from lectern.tables import keep, let_go, recorded, running_totals


def char_budget_groups(slides: DataFrame, budget: int = 1000) -> DataFrame:
    """Adds group ``g`` to slides (video_id, pos, asr_text): a group ends with the slide that reaches the budget.  Slides left
    over belong to the last group (``is_tail``), or are the only one.

    Where a group that began with a slide would end is found among the running totals of lengths; the chain of such jumps from
    the first slide gives the groups.  Only positions and lengths are moved, and no task needs a whole lecture."""
    narrow = slides.select("video_id", "pos", F.coalesce(F.length("asr_text"), F.lit(0)).cast("long").alias("n"))
    with recorded() as made:
        placed = keep(running_totals(narrow, ["video_id"], ["pos"], F.col("n")).withColumnRenamed("rows_before", "nth"))
        if budget <= 0:  # every slide reaches it
            groups = placed.select("video_id", "pos", F.col("nth").cast("int").alias("g"), F.lit(False).alias("is_tail"))
            let_go(made, placed)
            return slides.join(groups, ["video_id", "pos"])
        parts = parts_for(placed)
        points = placed.select("video_id", (F.col("sum_before") + F.col("n")).alias("value"), "nth")
        asks = placed.select("video_id", (F.col("sum_before") + budget).alias("value"), "nth", "pos")
        nodes = first_reaching(points, asks, ["video_id"], "value", F.col("nth"), "last", parts).select("video_id", "pos", "nth", (F.col("last") + 1).alias("next"))
        walked = chains(nodes, ["video_id"], parts)
        full = walked.where("starts and next is not null").groupBy("video_id").agg(F.count("*").alias("full"))
        groups = walked.join(full, "video_id", "left").withColumn("full", F.coalesce("full", F.lit(0)))
        tail = (F.col("ordinal") == F.col("full")) & (F.col("full") > 0)
        groups = keep(groups.select("video_id", "pos", F.least("ordinal", F.greatest(F.col("full") - 1, F.lit(0))).cast("int").alias("g"), tail.alias("is_tail")))
        let_go(made, groups)
    return slides.join(groups, ["video_id", "pos"])


def _in_order(value: Column, when: Column | None = None) -> Column:
    rows = F.collect_list(F.when(when, F.struct("pos", value.alias("v")))) if when is not None else F.collect_list(F.struct("pos", value.alias("v")))
    return F.transform(F.array_sort(rows), lambda s: s["v"])


def _texts(parts: Column) -> Column:
    return F.filter(parts, lambda s: s != "")


def char_budget_parents(slides: DataFrame, budget: int = 1000) -> DataFrame:
    """Parents (video_id, g, chunk_id, slide_ids, start_sec, end_sec, image, ocr_text, asr_text, parent_text, hints) of slides with
    normalised texts.  ``image`` is the first slide's (slides without such a column: ''), ``hints`` all terms of the
    slides in order (column ``proper_nouns``; without it: none).

    A tail is appended slide by slide: its slide text follows after a blank line even if the head has none."""
    none = F.array().cast("array<string>")
    image = F.coalesce("image", F.lit("")) if "image" in slides.columns else F.lit("")
    terms = F.coalesce("proper_nouns", none) if "proper_nouns" in slides.columns else none
    fields = ["pos", "slide_id", "start_sec", "end_sec", F.coalesce("ocr_text", F.lit("")).alias("ocr_text"), F.coalesce("asr_text", F.lit("")).alias("asr_text"), image.alias("image"), terms.alias("terms")]
    s = char_budget_groups(slides, budget).groupBy("video_id", "g").agg(F.array_sort(F.collect_list(F.struct(*fields, "is_tail"))).alias("p"))  # a budget and a slide, or slides without speech
    s = s.withColumn("heads", F.size(F.filter("p", lambda x: ~x["is_tail"])))
    text = lambda parts, name: _texts(F.transform(parts, lambda x: x[name]))
    head, tail = F.slice("p", F.lit(1), F.col("heads")), F.slice("p", F.col("heads") + 1, F.size("p"))
    ocr = F.concat(F.array_join(text(head, "ocr_text"), "\n\n"), F.array_join(F.transform(text(tail, "ocr_text"), lambda t: F.concat(F.lit("\n\n"), t)), ""))
    p = s.select(
        "video_id", "g", F.format_string("parent_%04d", "g").alias("chunk_id"), F.transform("p", lambda x: x["slide_id"]).alias("slide_ids"), F.get("p", F.lit(0))["start_sec"].alias("start_sec"), F.element_at("p", -1)["end_sec"].alias("end_sec"),
        F.get("p", F.lit(0))["image"].alias("image"), ocr.alias("ocr_text"), F.array_join(text(F.col("p"), "asr_text"), "\n").alias("asr_text"), F.flatten(F.transform("p", lambda x: x["terms"])).alias("hints"),
    )
    return p.select(*p.columns[:-1], combined_text(F.col("ocr_text"), F.col("asr_text")).alias("parent_text"), "hints")


def chunk_by_slides(slides: DataFrame, n: int = 3, overlap: int = 0) -> DataFrame:
    """(video_id, pos) to (video_id, chunk, pos): windows of n slides, ``max(1, n - overlap)`` apart."""
    if n < 1:
        raise ValueError("a chunk has at least one slide")
    step = max(1, n - overlap)
    low = F.greatest(F.lit(0), F.ceil((F.col("pos") - n + 1) / step)).cast("int")
    high = F.floor(F.col("pos") / step).cast("int")
    return slides.where(low <= high).withColumn("chunk", F.explode(F.sequence(low, high)))


def time_chunk_ranges(starts: list[float], ends: list[float], minutes: float, overlap: float) -> list[tuple[int, int]]:
    """First and last slide of each chunk: a chunk grows until it spans the time; the next one starts after it, or at the first of
    the run of slides that start within ``overlap`` of its end, but always further on."""
    out, i, n = [], 0, len(starts)
    while i < n:
        j = next((j for j in range(i, n) if ends[j] - starts[i] >= minutes * 60), None)
        if j is None:
            out.append((i, n - 1))
            break
        out.append((i, j))
        k = j + 1
        while overlap > 0 and k - 1 > i and starts[k - 1] >= ends[j] - overlap:
            k -= 1
        i = k
    return out


def chunk_by_time(slides: DataFrame, minutes: float = 5.0, overlap_sec: float = 0.0) -> DataFrame:
    """(video_id, pos, start_sec, end_sec, ...) to rows (..., chunk): one for each chunk that a slide is in.

    A chunk grows until it spans the time; the next one starts after it, or at the first of the slides that start within
    ``overlap_sec`` of its end, but always further on.  Where a chunk that began with a slide would end, and where the next one would
    start, are searched among the times of all slides; the chain of these jumps from the first slide gives the chunks, and no
    task needs a whole lecture.  Lectures whose times go back from a slide to the next have no such order: their positions
    and times alone are folded, a lecture in a task."""
    with recorded() as made:
        times = slides.select("video_id", "pos", F.coalesce("start_sec", F.lit(0.0)).cast("double").alias("start_sec"), F.coalesce("end_sec", F.lit(0.0)).cast("double").alias("end_sec"))
        placed = keep(running_totals(times, ["video_id"], ["pos"], total=True).drop("sum_before").withColumnRenamed("rows_before", "nth"))
        parts = parts_for(placed)
        before = neighbours(placed, ["video_id"], ["nth"], before={"s": F.col("start_sec"), "e": F.col("end_sec")}, parts=parts)
        back = keep(before.where("s > start_sec or e > end_sec").select(F.col("video_id").alias("v")).distinct())
        folded = None
        if back.limit(1).count():
            odd = F.col("video_id").eqNullSafe(F.col("v"))
            folded, placed = placed.join(back, odd, "left_semi"), placed.join(back, odd, "left_anti")

        ends = placed.select("video_id", F.col("end_sec").alias("value"), "nth", F.col("end_sec").alias("till"))
        asks = placed.select("video_id", least_with_gap(F.col("start_sec"), minutes * 60).alias("value"), "nth", "rows_total", "end_sec")
        # an end before the slide itself doesn't count: ends are in order, so the slide's own spans the time as well
        nodes = first_reaching(ends, asks, ["video_id"], "value", F.struct(F.col("nth").alias("at"), "till"), "end", parts)
        early = F.col("end.at") < F.col("nth")
        nodes = nodes.select("video_id", "nth", "rows_total", F.when(early, F.col("nth")).otherwise(F.col("end.at")).alias("last"), F.when(early, F.col("end_sec")).otherwise(F.col("end.till")).alias("till"))
        if overlap_sec > 0:
            starts = placed.select("video_id", F.col("start_sec").alias("value"), "nth")
            nodes = first_reaching(starts, nodes.withColumn("value", F.col("till") - overlap_sec), ["video_id"], "value", F.col("nth"), "again", parts)
            step = F.greatest(F.col("nth") + 1, F.least(F.coalesce("again", F.col("last") + 1), F.col("last") + 1))
        else:
            step = F.col("last") + 1
        walked = chains(nodes.select("video_id", "last", "rows_total", "nth", F.when(F.col("last").isNotNull(), step).alias("next")), ["video_id"], parts)
        spans = walked.where("starts").select("video_id", F.col("ordinal").cast("int").alias("chunk"), F.explode(F.sequence("nth", F.coalesce("last", F.col("rows_total") - 1))).alias("nth"))
        ranges = spans.join(placed.select("video_id", "nth", "pos"), ["video_id", "nth"]).select("video_id", "chunk", "pos")
        if folded is not None:
            ranges = ranges.unionByName(_folded(folded, minutes, overlap_sec))
        ranges = keep(ranges)
        let_go(made, ranges)
    return slides.join(ranges, ["video_id", "pos"])


def _folded(slides: DataFrame, minutes: float, overlap_sec: float) -> DataFrame:
    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos").reset_index(drop=True)
        found = time_chunk_ranges(pdf.start_sec.tolist(), pdf.end_sec.tolist(), minutes, overlap_sec)
        return pd.DataFrame([(pdf.video_id[0], c, int(pdf.pos[p])) for c, (a, b) in enumerate(found) for p in range(a, b + 1)], columns=["video_id", "chunk", "pos"])

    kinds = slides.select("video_id", F.lit(0).alias("chunk"), "pos").schema
    return slides.select("video_id", "pos", "start_sec", "end_sec").groupBy("video_id").applyInPandas(fold, kinds)


def build_chunks(rows: DataFrame) -> DataFrame:
    """Rows with ``chunk`` to one row a chunk: chunk_id, slide_ids, start_sec, end_sec, ocr_text (each slide's under its id), asr_text."""
    ocr = F.when(F.col("ocr_text") != "", F.concat(F.lit("["), F.col("slide_id"), F.lit("]\n"), F.col("ocr_text"))).otherwise("")
    return rows.withColumn("labelled", ocr).groupBy("video_id", "chunk").agg(
        _in_order(F.col("slide_id")).alias("slide_ids"), F.min_by("start_sec", "pos").alias("start_sec"), F.max_by("end_sec", "pos").alias("end_sec"),
        F.array_join(_texts(_in_order(F.col("labelled"))), "\n\n").alias("ocr_text"), F.array_join(_texts(_in_order(F.col("asr_text"))), "\n").alias("asr_text"),
    ).select("video_id", F.format_string("chunk_%04d", "chunk").alias("chunk_id"), "slide_ids", "start_sec", "end_sec", "ocr_text", "asr_text")


def slide_group_parents(slides: DataFrame, group_size: int = 3) -> DataFrame:
    """Fixed groups of slides: blocks under slide ids, for slide text, speech and both; ``image`` is the first slide's."""
    image = F.coalesce("image", F.lit("")) if "image" in slides.columns else F.lit("")
    head = F.concat(F.lit("["), F.col("slide_id"), F.lit("]\n"))
    block = lambda c: F.when(c != "", F.concat(head, c)).otherwise("")
    both = joined("\n", F.col("ocr_text"), F.when(F.col("asr_text") != "", F.concat(F.lit("[音声]\n"), F.col("asr_text"))).otherwise(""))
    s = slides.withColumn("g", F.floor(F.col("pos") / group_size).cast("int")).withColumn("b_ocr", block(F.col("ocr_text"))).withColumn("b_asr", block(F.col("asr_text"))).withColumn("b_both", block(both))
    return s.groupBy("video_id", "g").agg(
        _in_order(F.col("slide_id")).alias("slide_ids"), F.min_by("start_sec", "pos").alias("start_sec"), F.max_by("end_sec", "pos").alias("end_sec"), F.min_by(image, "pos").alias("image"),
        *[F.array_join(_texts(_in_order(F.col(b))), "\n\n").alias(t) for b, t in (("b_ocr", "ocr_text"), ("b_asr", "asr_text"), ("b_both", "combined_text"))],
    ).withColumn("chunk_id", F.format_string("parent_%04d", "g"))


SEPARATORS = ("\n\n", "\n", "。", "、", " ", "")


def split_text(text: str, size: int = 300, overlap: int = 30, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that works, with some overlap."""
    at = next(i for i, s in enumerate(separators) if not s or s in text)
    mark, finer = separators[at], separators[at + 1 :]
    if mark:
        cut = text.split(mark)
        parts = [p for p in [cut[0], *(mark + c for c in cut[1:])] if p]
    else:
        parts = list(text)
    out: list[str] = []
    short: list[str] = []
    for p in parts:
        if len(p) < size:
            short.append(p)
            continue
        out += _merge(short, size, overlap)
        short = []
        out += split_text(p, size, overlap, finer) if finer else [p]
    return out + _merge(short, size, overlap)


def _merge(parts: list[str], size: int, overlap: int) -> list[str]:
    out: list[str] = []
    held: list[str] = []
    total = 0
    for p in parts:
        if held and total + len(p) > size:
            out.append("".join(held).strip())
            while total > overlap or total + len(p) > size and total > 0:
                total -= len(held.pop(0))
        held.append(p)
        total += len(p)
    return [t for t in [*out, "".join(held).strip()] if t]


def split_children(parents: DataFrame, text: str = "page_content", size: int = 300, overlap: int = 30) -> DataFrame:
    """Adds a row for each piece of the text: ``child_index``, ``child_text``."""

    def pieces(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: split_text(t, size, overlap) if t else [])

    split = F.pandas_udf(pieces, "array<string>")
    return parents.select("*", F.posexplode(split(F.col(text)))).withColumnRenamed("pos", "child_index").withColumnRenamed("col", "child_text")
