"""Golden rows and properties of the lecture operators."""

import random

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import align, chunk, documents, questions, retrieve, scoring, segment, terms
from lectern.plans import queries
from lectern.sources import lectures as io


def budget_groups(spark, lengths, budget):
    rows = [("v", i, "x" * n) for i, n in enumerate(lengths)]
    got = chunk.char_budget_groups(spark.createDataFrame(rows, "video_id string, pos long, asr_text string"), budget).orderBy("pos").collect()
    return [r.g for r in got]


@pytest.mark.parametrize(("lengths", "want"), [([4, 7, 1, 9, 2, 3], [0, 0, 1, 1, 1, 1]), ([2, 3], [0, 0]), ([25, 1, 10], [0, 1, 1])])
def test_char_budget_groups(spark, lengths, want):
    assert budget_groups(spark, lengths, 10) == want


def test_tail_keeps_blank_line(spark):
    rows = [("v", 0, "slide1", 0.0, 1.0, "", "x" * 10), ("v", 1, "slide2", 1.0, 2.0, "x", "")]
    p = chunk.char_budget_parents(spark.createDataFrame(rows, "video_id string, pos long, slide_id string, start_sec double, end_sec double, ocr_text string, asr_text string"), 10).collect()
    assert [(r.ocr_text, r.slide_ids) for r in p] == [("\n\nx", ["slide1", "slide2"])]


@pytest.mark.parametrize(("n", "overlap", "want"), [(3, 1, [[0, 1, 2], [2, 3, 4], [4]]), (2, 2, [[0, 1], [1, 2], [2, 3], [3, 4], [4]]), (1, -1, [[0], [2], [4]])])
def test_chunk_by_slides(spark, n, overlap, want):
    got = chunk.chunk_by_slides(spark.range(5).selectExpr("'v' AS video_id", "id AS pos"), n, overlap).groupBy("chunk").agg(F.array_sort(F.collect_list("pos")).alias("p")).orderBy("chunk").collect()
    assert [r.p for r in got] == want


def test_chunk_by_time():
    starts = [100.0 * i for i in range(7)]
    ends = [s + 100 for s in starts]
    assert chunk.time_chunk_ranges(starts, ends, 5, 0) == [(0, 2), (3, 5), (6, 6)]
    assert chunk.time_chunk_ranges(starts, ends, 5, 100) == [(0, 2), (2, 4), (4, 6), (6, 6)]
    assert chunk.time_chunk_ranges(starts, ends, 5, 50) == [(0, 2), (3, 5), (6, 6)]
    assert chunk.time_chunk_ranges([], [], 5, 0) == []


def test_split_text_properties():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("ab 。、\n") for _ in range(rng.randrange(1, 400)))
        pieces = chunk.split_text(text, 50, 10)
        assert all(p and len(p) <= 50 for p in pieces)
        assert set("".join(pieces)) - set(" \n") == set(text) - set(" \n")


def test_split_text_golden():
    assert chunk.split_text("aaaa bbbb cccc dddd", 10, 5) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]
    assert chunk.split_text("一二三。四五六、七八", 5, 0) == ["一二三", "。四五六", "、七八"]
    assert chunk.split_text("abcdefgh", 3, 1) == ["abc", "cde", "efg", "gh"]
    assert chunk.split_text("ab\n\ncd\nef", 6, 0) == ["ab", "cd", "ef"]
    assert chunk.split_text("ab\n\ncd\nef", 8, 0) == ["ab", "cd\nef"]
    assert chunk.split_text("", 5, 0) == []


def test_align_like_nested_loops(spark):
    """Slides in the order of time and slides that go back in time, equal times, missing ends."""
    rng = random.Random(8)
    frames, segs = [], []
    for v in range(30):
        times = [rng.randrange(12) for _ in range(rng.randrange(1, 6))]
        times = sorted(times) if v % 2 else times
        frames += [(str(v), 0, k, float(t) if t % 3 else None, float(t), 10.0 if v % 5 else None) for k, t in enumerate(times)]
        segs += [(str(v), 0, k, float(rng.randrange(14)), f"s{k}") for k in range(12)]
    want = {}
    for v in range(30):
        own = [f for f in frames if f[0] == str(v)]
        at = [f[3] if f[3] is not None else f[4] for f in own]
        for k, f in enumerate(own):
            end = at[k + 1] if k + 1 < len(own) else f[5]
            want[f[0], k] = "\n".join(s[4] for s in segs if s[0] == f[0] and end is not None and at[k] <= s[3] < end)
    got = align.align_segments(spark.createDataFrame(frames, "video_id string, pos int, frame_pos int, detect_time double, time double, slide_end double"), spark.createDataFrame(segs, "video_id string, pos int, seg_pos int, start_sec double, text string"))
    assert {(r.video_id, r.frame_pos): r.asr_text for r in got.collect()} == want


def test_align_segments(spark):
    frames = spark.createDataFrame([("v", 0, 0, 0.0, 0.0, 20.0), ("v", 0, 1, 10.0, 10.0, 20.0)], "video_id string, pos int, frame_pos int, detect_time double, time double, slide_end double")
    segs = spark.createDataFrame([("v", 0, i, t, s) for i, (t, s) in enumerate([(0.0, "a"), (9.999, " b "), (10.0, "c"), (20.0, "lost"), (1.0, " ")])], "video_id string, pos int, seg_pos int, start_sec double, text string")
    assert [r.asr_text for r in align.align_segments(frames, segs).orderBy("frame_pos").collect()] == ["a\nb", "c"]


def test_debounce_and_numbering(spark):
    rows = [("v", t, i) for i, t in enumerate([0.0, 1.0, 1.5, 2.9, 3.0])]
    got = segment.debounce(spark.createDataFrame(rows, "video_id string, time double, det_pos int")).orderBy("time").collect()
    assert [r.time for r in got] == [0.0, 1.5, 3.0]
    cases = [(5.0, 0.0, True, "change"), (5.0, 0.0, False, "animation"), (0.01, 0.6, False, "change"), (0.01, 0.59, True, "animation")]
    df = spark.createDataFrame(cases, "s double, r double, d boolean, want string")
    assert df.where(segment.classify_change(F.col("s"), F.col("r"), F.col("d")) != F.col("want")).count() == 0


def test_block_similarity(spark):
    a = [[(7 * i + 3 * j) % 256 for j in range(64)] for i in range(64)]
    b = [[v if j < 32 else 255 - v for j, v in enumerate(r)] for r in a]
    frames = spark.createDataFrame([("v", 0.0, a), ("v", 1.0, a), ("v", 2.0, None), ("v", 3.0, b)], "video_id string, time double, pixels array<array<int>>")
    got = segment.block_similarity(frames).select("time", segment.block_stats(F.col("block_scores")).alias("s")).orderBy("time").collect()
    assert [(r.time, r.s.changed_ratio, r.s.is_distributed) for r in got] == [(1.0, 0.0, False), (3.0, 0.5, True)]
    assert got[0].s.mean_ssim == 1.0


def test_unreadable_first_frame_voids_the_lecture(spark):
    a = [[1] * 32] * 32
    frames = spark.createDataFrame([("v", 0.0, None), ("v", 1.0, a), ("v", 2.0, a), ("w", 0.0, a), ("w", 1.0, a)], "video_id string, time double, pixels array<array<int>>")
    assert [(r.video_id, r.time) for r in segment.block_similarity(frames).collect()] == [("w", 1.0)]


def test_hint_alone_keeps_a_slide_child(spark):
    f = spark.createDataFrame([("v", 0, 0, "f1", "slide1", "change", 0.0, 1.0, "t", "", ["h"]), ("v", 0, 1, "f2", "slide1", "animation", 1.0, 2.0, "", "", []), ("v", 0, 2, "f3", "slide1", "animation", 2.0, 3.0, "", "", ["h"])], "video_id string, pos int, frame_pos int, frame_id string, slide_id string, mode string, from_sec double, to_sec double, ocr_text string, asr_text string, hints array<string>")
    got = documents.slide_children(f).where("store_mode = 'ocr'").orderBy("child_index").collect()
    assert [r.child_index for r in got] == [0, 2]
    assert [r.page_content for r in got] == ["[キーワード]\nh\n\nt", "[キーワード]\nh\n\n"]  # not stripped


def test_search_may_return_fewer_parents(spark):
    c = spark.createDataFrame([("v", "ocr", i, "p1" if i < 4 else "p2", [1.0, i / 10]) for i in range(6)], "video_id string, store_mode string, child_id long, chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(9, "v", "ocr", [1.0, -1.0])], "query_id long, video_id string, store_mode string, embedding array<double>")
    p = spark.createDataFrame([("v", "ocr", x, x) for x in ("p1", "p2")], "video_id string, store_mode string, chunk_id string, page_content string")
    assert [r.chunk_id for r in retrieve.search(q, c, p, 2).collect()] == ["p1"]
    assert sorted(r.chunk_id for r in retrieve.search(q, c, p, 3).collect()) == ["p1", "p2"]


def test_query_ids_belong_to_a_lecture(spark):
    c = spark.createDataFrame([(v, "ocr", i, f"p{i}", [1.0, float(i)]) for v in "AB" for i in range(3)], "video_id string, store_mode string, child_id long, chunk_id string, embedding array<double>")
    q = spark.createDataFrame([(1, "A", "ocr", [0.0, 1.0]), (1, "B", "ocr", [0.0, -1.0])], "query_id long, video_id string, store_mode string, embedding array<double>")
    p = spark.createDataFrame([(v, "ocr", f"p{i}", f"{v}{i}") for v in "AB" for i in range(3)], "video_id string, store_mode string, chunk_id string, page_content string")
    got = {r.video_id: r.context for r in retrieve.contexts(retrieve.search(q, c, p, 2)).collect()}
    assert got == {"A": "A2\n\n---\n\nA1", "B": "B0\n\n---\n\nB1"}


def test_masked_mean_and_unit(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [1, 1]), ([[1.0, 2.0], [3.0, 4.0]], [0, 1]), ([[1.0, 2.0]], [0]), ([], [])], "v array<array<double>>, m array<int>")
    got = [list(r.x) for r in df.select(V.masked_mean(F.col("v"), F.col("m")).alias("x")).collect()]
    assert got == [[2.0, 3.0], [3.0, 4.0], [0.0, 0.0], []]
    assert list(spark.createDataFrame([([3.0, 4.0],), ([0.0],)], "v array<double>").select(V.unit(F.col("v")).alias("u")).collect()[0].u) == [0.6, 0.8]


def test_model_calls_are_retried(spark, tmp_path):
    """A failing call and replies that can't be used are asked again; what stays bad is kept or null."""

    def fn(prompts):
        new = [p for p in prompts if not (tmp_path / p).exists()]
        for p in new:
            (tmp_path / p).write_text("")
        if "boom" in new:
            raise RuntimeError
        return ["?" if p in new else None if p == "never" else f"ok {p}" for p in prompts]

    df = spark.createDataFrame([("a",), ("never",)], "p string").coalesce(1)
    got = {r.p: r.r for r in questions.apply_model(df, "p", fn, "r", 2, lambda x: x.startswith("ok")).collect()}
    assert got == {"a": "ok a", "never": None}
    assert [r.r for r in questions.apply_model(spark.createDataFrame([("boom",)], "p string"), "p", fn, "r", 1).collect()] == ["ok boom"]
    c = spark.createDataFrame([("x", "y"), (" ", "y"), (None, None)], "a string, b string")
    assert [r.t for r in c.select(questions.reply_text(F.col("a"), F.col("b")).alias("t")).collect()] == ["x", "y", ""]


def test_axes(spark, tmp_path):
    built = {"a": "A", "b": "B", "c": "C"}
    names = lambda *x: [(r.axis_ord, r.axis) for r in io.load_axes(spark, built, *x).orderBy("axis_ord").collect()]
    assert names(["c", "a"]) == [(0, "c"), (1, "a")] and len(names()) == 3
    with pytest.warns(UserWarning, match="nothing"):
        assert len(names(["nothing"])) == 3
    (tmp_path / "axes.json").write_text('{"z": "Z", "y": "Y"}')
    assert sorted((r.axis, r.description) for r in io.load_axes(spark, built, ["a"], str(tmp_path / "axes.json")).collect()) == [("y", "Y"), ("z", "Z")]


def test_answer_flags(spark):
    df = spark.createDataFrame([("A", "応用"), ("E", "x"), (None, None)], "a string, b string").select(T.answer_flags(F.col("a"), F.col("b")).alias("f"))
    assert [tuple(r.f) for r in df.collect()] == [(True, True), (False, False), (False, False)]


def test_mean_of_means(spark):
    rows = [("v", "q1", 1, 5), ("v", "q1", 2, 5), ("v", "q1", 3, 5), ("v", "q2", 1, 1), ("v", "q3", 1, None)]
    s = spark.createDataFrame([(v, q, "m", "direct", "time", "a", t, x) for v, q, t, x in rows], "video_id string, question_id string, model string, method string, chunk_mode string, axis string, trial int, score int")
    r = scoring.method_summary(s).first()
    assert (r.axes["a"], r.n) == (3.0, 2)


def test_pending_and_first_wins(spark):
    q = spark.createDataFrame([("v", "q1", "m", 0), ("v", "q1", "m", 1), ("v", "q2", "m", 2)], "video_id string, question_id string, model string, ordinal int")
    s = spark.createDataFrame([("q1", "m", "a"), ("q2", "m", "a"), ("q2", "m", "b"), ("q2", "m", "c")], "question_id string, model string, axis string")
    first = scoring.first_of_each(q)
    assert [(r.question_id, r.ordinal) for r in first.orderBy("ordinal").collect()] == [("q1", 0), ("q2", 2)]
    assert [r.question_id for r in scoring.pending(first, s, ["a", "b"]).collect()] == ["q1"]


def test_lectures_share_question_ids(spark):
    """What is stored for one lecture, or under other settings, is not done for another."""
    now, old = scoring.settings_hash(1, 2, 0.0, ["a", "b"]), scoring.settings_hash(3, 2, 0.0, ["a", "b"])
    q = spark.createDataFrame([(v, i, "m", f"{v}{i}?", "x") for v in "AB" for i in ("q1", "q2")], "video_id string, question_id string, model string, question string, answer string")
    s = spark.createDataFrame([("A", "q1", "a"), ("A", "q1", "b"), ("A", "q2", "a"), ("B", "q2", "b")], "video_id string, question_id string, axis string").withColumn("model", F.lit("m"))
    left = lambda *a: sorted((r.video_id, r.question_id) for r in scoring.pending(q, *a).collect())
    assert left(s, ["a", "b"]) == [("A", "q2"), ("B", "q1"), ("B", "q2")]
    assert [(r.model, r.n_done) for r in scoring.completed_counts(s.unionByName(s.withColumn("video_id", F.lit("C"))), ["a"]).collect()] == [("m", 4)]
    dated = s.withColumn("settings_hash", F.when(F.col("axis") == "b", old).otherwise(now))
    assert left(dated, ["a"], now) == [("B", "q1"), ("B", "q2")] and len(left(dated, ["a", "b"], now)) == 4
    assert scoring.completed_counts(dated, ["a", "b"], now).collect() == []
    for call in (lambda: scoring.pending(q, dated, ["a"]), lambda: scoring.completed_counts(dated, ["a"]), lambda: scoring.pending(q, s.drop("video_id"), ["a"])):
        with pytest.raises(ValueError):
            call()
    contexts = q.select("video_id", "question_id", "model", F.concat(F.lit("of "), "video_id").alias("context"))
    axes = spark.createDataFrame([("a", "d")], "axis string, description string")
    got = scoring.scoring_inputs(q, contexts, axes, "{question} {context}", ["j"]).collect()
    assert sorted(r.prompt for r in got) == ["Aq1? of A", "Aq2? of A", "Bq1? of B", "Bq2? of B"]


def test_ocr_in_parts(spark):
    """Parts are of bounded size and together they are the lecture's text."""
    slides = [(v, i, " " * (i % 3) + f"{v}{i} " + "é" * (i * 37 % 90)) for v in "AB" for i in range(200)] + [("A", 200, None), ("B", 201, " \n"), (None, 0, "x")]
    s = spark.createDataFrame(slides, "video_id string, pos int, full_text string")
    whole = {r.video_id: r.ocr_text for r in terms.lecture_ocr(s).collect()}
    parts = {}
    for r in sorted(terms.lecture_ocr_parts(s, 1000).collect(), key=lambda r: r.part):
        parts.setdefault(r.video_id, []).append(r.text)
    assert {v: "\n\n".join(p) for v, p in parts.items()} == whole
    assert len(parts["A"]) > 10 and all(len(t.encode()) < 1000 + 200 for p in parts.values() for t in p)


def test_long_lectures_window_no_source(spark):
    """No window runs over a whole source and none carries texts."""
    plan = queries.long_lectures(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if " Window [" in x or x.lstrip(" :+-").startswith("Window [")]
    assert windows and not any("text" in x for x in windows) and all("_part" in x for x in windows), windows


def test_read_nested_lecture(spark, tmp_path):
    (tmp_path / "lec1").mkdir()
    (tmp_path / "lec1" / "result.json").write_text('{"meta": {"model": "m"}, "slides": [{"slide_id": "slide1", "time": {"start_sec": 0, "end_sec": 5}, "full_text": null,\n "frames": [{"id": "f", "time": 1.0, "ocr": "t"}], "asr": [{"start_sec": 1, "end_sec": 2, "text": "hello"}]}, {"slide_id": "slide2"}]}')
    lec = io.read_lectures(spark, str(tmp_path / "*" / "*.json"))
    s = documents.with_index_text(io.slides(lec)).orderBy("pos").collect()
    assert [(r.video_id, r.slide_id, r.ocr_text, r.asr_text, r.end_sec) for r in s] == [("lec1", "slide1", "", "hello", 5.0), ("lec1", "slide2", "", "", 0.0)]
    assert io.frames(lec).count() == 1 and io.segments(lec).first().text == "hello"


def test_scene_log(spark):
    lines = spark.createDataFrame([("lavfi.scd.score: 30.694, lavfi.scd.time: 47.652561",), ("lavfi.scd.score: 1",), ("other",)], "value string")
    assert [(r.time, r.score) for r in io.parse_scene_log(lines).collect()] == [(47.652561, 30.694)]
