"""Scans by ranges against plain Python, with groups over many partitions."""

from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import scans
from lectern.operators import align, chunk, segment
from lectern.scans import chains, first_reaching, least_with_gap, neighbours


@pytest.fixture(params=[200_000, 40], ids=["one part", "many parts"])
def parts(request, monkeypatch):
    monkeypatch.setattr(scans, "ROWS", request.param)


@pytest.mark.parametrize("n", [1, 5])
def test_neighbours(spark, n):
    rng = Random(2)
    rows = [(rng.choice(["a", "b", None, "long"]) if i % 3 else "long", i, rng.choice([None, i])) for i in range(200)]
    df = spark.createDataFrame(rows, "g string, t long, v long")
    got = neighbours(df, ["g"], ["t"], before={"was": F.col("v")}, after={"then": F.col("v")}, parts=n).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = [x for x in rows if x[0] == r.g]
        assert r.was == next((v for _, t, v in reversed(mine) if t < r.t and v is not None), None)
        assert r.then == next((v for _, t, v in mine if t > r.t and v is not None), None)
    assert neighbours(df.where("false"), ["g"], ["t"], before={"was": F.col("v")}, parts=n).collect() == []


@pytest.mark.parametrize("n", [1, 3])
def test_neighbours_take_a_step_a_row(spark, n):
    """No frame shrinks from row to row: Spark goes through such a frame anew for each row, which takes the square of a group's rows."""
    df = spark.range(300).select(F.lit("g").alias("g"), F.col("id").alias("t"), F.when(F.col("id") % 50 == 7, F.col("id")).alias("v"))
    got = neighbours(df, ["g"], ["t"], before={"was": F.col("v")}, after={"then": F.col("v")}, parts=n)
    plan = got._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "specifiedwindowframe" in plan and "unboundedfollowing" not in plan
    assert all(r.then == next((v for v in range(7, 300, 50) if v > r.t), None) and r.was == next((v for v in range(257, 0, -50) if v < r.t), None) for r in got.collect())


def test_first_reaching(spark):
    rng = Random(3)
    points = [(rng.choice("ab"), float(rng.randrange(40)), i) for i in range(120)]
    asks = [(rng.choice("abc"), float(rng.randrange(45)), i, f"x{i}") for i in range(60)]
    got = first_reaching(spark.createDataFrame(points, "g string, value double, nth long"), spark.createDataFrame(asks, "g string, value double, nth long, more string"), ["g"], "value", F.col("nth"), "hit", 4).collect()
    assert len(got) == len(asks)
    for r in got:
        best = min(((v, n) for g, v, n in points if g == r.g and v >= r.value), default=(None, None))
        assert r.hit == best[1] and r.more == f"x{r.nth}"


def test_least_with_gap(spark):
    rng = np.random.default_rng(1)
    starts = [*rng.random(200) * 1e6, *rng.random(50), 0.0, 0.1, -3.3]
    df = spark.createDataFrame([(float(t),) for t in starts], "t double")
    for t, x in df.select("t", least_with_gap(F.col("t"), 1.5)).collect():
        assert x - t >= 1.5 and np.nextafter(x, -np.inf) - t < 1.5


@pytest.mark.parametrize("n", [1, 2, 7])
def test_chains(spark, n):
    rng = Random(n)
    rows, want = [], {}
    for g, size in (("long", 400), ("b", 1), (None, 30), ("c", 90), ("still", 300), ("all", 120)):
        to = [None if rng.random() < 0.01 or g == "still" else i + 1 if g == "all" else i + rng.randint(1, 90 if rng.random() < 0.2 else 4) for i in range(size)]
        at, met = 0, []
        while at is not None and at < size:
            met.append(at)
            at = to[at]
        rows += [(g, i, t, f"{g}{i}") for i, t in enumerate(to)]
        want |= {(g, i): (i in met, sum(m <= i for m in met) - 1) for i in range(size)}
    rng.shuffle(rows)
    got = chains(spark.createDataFrame(rows, "g string, nth long, next long, more string"), ["g"], n).collect()
    assert {(r.g, r.nth): (r.starts, r.ordinal) for r in got} == want and len(got) == len(rows)
    assert all(r.more == f"{r.g}{r.nth}" for r in got)


def debounced(times, interval):
    last, kept = -np.inf, []
    for t, n in sorted(times):
        if t - last >= interval:
            kept.append((t, n))
            last = t
    return kept


def test_debounce_equals_the_fold(spark, parts):
    rng = Random(5)
    rows = [(v, round(rng.random() * 60, rng.choice([1, 2])), i) for i, v in enumerate(rng.choice(["a", "long", "long", "c"]) for _ in range(400))]
    got = segment.debounce(spark.createDataFrame([*rows, ("a", None, 999)], "video_id string, time double, det_pos long"), 1.5).collect()
    want = {(v, *k) for v in {r[0] for r in rows} for k in debounced([r[1:] for r in rows if r[0] == v], 1.5)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_budget_groups_equal_the_fold(spark, parts):
    rng = Random(6)
    rows = [(v, 3 * i + 1, "x" * rng.choice([0, 0, 3, 10, 25])) for v, n in (("long", 300), ("b", 1), ("short", 3), ("none", 20)) for i in range(n)]
    rows = [(v, p, "" if v == "none" else t) for v, p, t in rows]
    df = spark.createDataFrame(rows, "video_id string, pos int, asr_text string")
    for budget in (40, 1, 0):
        want = {}
        for v in {r[0] for r in rows}:
            total, g, groups = 0, 0, []
            for _, p, t in (r for r in rows if r[0] == v):
                groups.append((p, g))
                total += len(t)
                if total >= budget:
                    total, g = 0, g + 1
            for p, k in groups:
                want[v, p] = (min(k, max(g - 1, 0)), k == g and g > 0)
        got = chunk.char_budget_groups(df, budget).collect()
        assert {(r.video_id, r.pos): (r.g, r.is_tail) for r in got} == want and len(got) == len(rows)


def test_time_chunks_equal_the_fold(spark, parts):
    rng = Random(7)
    rows = []
    for v, n in (("long", 250), ("b", 1), ("short", 3), ("odd", 40), ("overlapping", 60)):
        at = 0.0
        for i in range(n):
            end = at + rng.choice([0.0, 20.0, 45.5, 90.0, 400.0])
            back = rng.random() * 100 if v == "odd" else 0.0
            rows.append((v, 2 * i, at - back, end + (500.0 * (i >= 30) if v == "overlapping" else 0.0)))
            at = end
    df = spark.createDataFrame(rows, "video_id string, pos int, start_sec double, end_sec double")
    for minutes, overlap in ((5, 0.0), (5, 60.0), (1.5, 200.0), (0, 10.0)):
        want = set()
        for v in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == v]
            for c, (a, b) in enumerate(chunk.time_chunk_ranges([r[2] for r in mine], [r[3] for r in mine], minutes, overlap)):
                want |= {(v, mine[k][1], c) for k in range(a, b + 1)}
        got = chunk.chunk_by_time(df, minutes, overlap).collect()
        assert {(r.video_id, r.pos, r.chunk) for r in got} == want and len(got) == len(want)


def test_one_slide_of_very_many_segments(spark, monkeypatch):
    """No window or group by lecture or slide stands in the plan; the rows are those of a search in plain Python."""
    monkeypatch.setattr(scans, "ROWS", 20_000)
    n = 100_000
    frames = spark.createDataFrame([("v", 0, i, float(i * 700), None, 35_000.0) for i in range(50)] + [("v", 1, 0, 5.0, None, 9.0), ("w", 0, 0, None, None, 3.0)], "video_id string, pos int, frame_pos int, detect_time double, time double, slide_end double")
    segs = spark.range(n).selectExpr("'v' AS video_id", "0 AS pos", "cast(id as int) AS seg_pos", "(id * 7919 % 100000) / 2.5D AS start_sec", "concat(' s', id) AS text")
    segs = segs.unionByName(spark.createDataFrame([("v", 1, 0, 4.9, "early"), ("v", 1, 1, 5.0, "in"), ("v", 1, 2, 9.0, "late"), ("w", 0, 0, 1.0, "x")], segs.schema))
    out = align.align_segments(frames, segs)
    got = {(r.video_id, r.pos, r.frame_pos): r.asr_text for r in out.collect()}
    want = {("v", 0, i): [] for i in range(50)}
    for i in range(n):
        at = (i * 7919 % 100000) / 2.5
        if at < 35_000:
            want["v", 0, min(int(at // 700), 49)].append(f"s{i}")
    assert got == {k: "\n".join(v) for k, v in want.items()} | {("v", 1, 0): "in", ("w", 0, 0): "x"}


def test_slides_equal_the_fold_over_many_parts(spark, parts):
    rng = Random(9)
    rows = [(rng.choice(["a", "long", "long"]), round(rng.random() * 900, 1), i, rng.choice([0.001, 0.5, 7.0]), rng.random(), rng.random() < 0.5, rng.choice([None, 0.5, 0.995]), f"t{i}") for i in range(500)]
    df = spark.createDataFrame(rows, "video_id string, time double, det_pos long, score double, changed_ratio double, is_distributed boolean, mean_ssim double, ocr string")
    want, slides = {}, {}
    for v in ("a", "long"):
        mine = sorted((r for r in rows if r[0] == v and r[3] >= 0.005), key=lambda r: r[1:3])
        last, no, picture = -np.inf, 0, 0
        for k, r in enumerate(mine):
            if k and r[6] is not None and r[6] >= 0.99 or r[1] - last < 1.5:
                continue
            last = r[1]
            change = k == 0 or (r[5] if r[3] >= 5 else r[4] >= 0.6)
            no, picture = (no + 1, 1) if change else (no, picture + 1)
            want[v, r[2]] = (no, picture, "change" if change else "animation")
            slides.setdefault((v, no), []).append(r)
    frames = segment.segment_slides(df)
    assert {(r.video_id, r.det_pos): (r.slide_no, r.picture_no, r.mode) for r in frames.collect()} == want
    ranges = {(r.video_id, r.slide_no): (r.start_sec, r.end_sec, r.full_text) for r in segment.time_ranges(frames, spark.createDataFrame([("a", 1000.0), ("long", 1000.0)], "video_id string, duration double")).collect()}
    assert ranges == {(v, n): (f[0][1], slides[v, n + 1][0][1] if (v, n + 1) in slides else 1000.0, f[-1][7]) for (v, n), f in slides.items()}


def test_pictures_are_paired_over_many_parts(spark, parts):
    rng = np.random.default_rng(3)
    rows = [(v, float(i), None if (i % 5 == 2 or v == "void" and i == 0) else rng.integers(0, 256, (32, 32)).tolist()) for v, n in (("long", 90), ("void", 4), ("one", 1)) for i in range(n)]
    got = segment.block_similarity(spark.createDataFrame(rows, "video_id string, time double, pixels array<array<int>>")).collect()
    seen = [r for r in rows if r[0] == "long" and r[2] is not None]
    assert sorted((r.video_id, r.time) for r in got) == [("long", r[1]) for r in seen[1:]]
    by = {r.time: r.block_scores for r in got}
    for a, b in zip(seen[:4], seen[1:5], strict=True):
        one = segment.structural_similarity(np.array(a[2])[:8, :8], np.array(b[2])[:8, :8])
        assert abs(by[b[1]][0][0] - one) < 1e-9
