"""Many small files, broken ones, texts in parts, and scores in a bucketed table."""

import json
from random import Random

import pytest
from pyspark.sql import functions as F

from lectern import tables
from lectern.operators import retrieve, scoring, terms
from lectern.sources import lectures as io
from lectern.sources.parts import read_text_parts, text_parts, write_text_parts
from lectern.tables import fits


def test_many_small_files(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"lec{i}").mkdir()
        doc = {"meta": {"model": "m"}, "slides": [{"slide_id": f"slide{k + 1}", "full_text": f"{i} {k}"} for k in range(i % 3)]}
        (tmp_path / f"lec{i}" / "result.json").write_text(json.dumps(doc, indent=1))
    broken = {"lec7": "", "lec8": '{"meta": {"model"', "lec9": "[1, 2]", "lec10": "not JSON"}
    for name, text in broken.items():
        (tmp_path / name / "result.json").write_text(text)
    read = io.read_lectures(spark, str(tmp_path / "*" / "*.json"))
    assert read.rdd.getNumPartitions() <= 64 and read.count() == 996 and read.columns == ["video_id", "meta", "slides"]
    assert {(r.video_id, r.pos, r.full_text) for r in io.slides(read).collect()} == {(f"lec{i}", k, f"{i} {k}") for i in range(1000) for k in range(i % 3) if f"lec{i}" not in broken}
    told = io.read_lectures(spark, str(tmp_path / "*" / "*.json"), errors=True)
    assert told.count() == 999 and {r.video_id for r in told.where("error is not null").collect()} == set(broken) - {"lec7"}  # an empty file is no row for Spark


def test_question_files_keep_their_order(spark, tmp_path):
    for name in "abc":
        (tmp_path / f"{name}.json").write_text(json.dumps([{"question_id": f"{name}{i}", "method": "rag", "detail_setting": {"chunk_mode": "time"}, "slide_ids": ["s1"]} for i in range(50)]))
    (tmp_path / "d.json").write_text('[{"question_id": "x"')
    (tmp_path / "e.json").write_text("[]")
    got = io.read_questions(spark, str(tmp_path / "*.json"))
    assert {(r.question_id, r.ordinal, r.detail_setting.chunk_mode) for r in got.collect()} == {(f"{n}{i}", i, "time") for n in "abc" for i in range(50)}
    bad = io.read_questions(spark, str(tmp_path / "*.json"), errors=True).where("error is not null").collect()
    assert [r.file.rpartition("/")[2] for r in bad] == ["d.json"]


def test_texts_in_parts(spark, tmp_path):
    rng = Random(4)
    blocks = [(v, i, "é\n" * rng.randrange(40) + f"{v}{i}") for v in ("a/b c+%", "long") for i in range(150)]
    parts = text_parts(spark.createDataFrame(blocks, "video_id string, pos int, block string"), "block", 500)
    write_text_parts(parts, str(tmp_path / "out"))
    got = {}
    for r in sorted(read_text_parts(spark, str(tmp_path / "out")).collect(), key=lambda r: r.part):
        assert len(r.text.encode()) <= 500 + 250
        got.setdefault(r.video_id, []).append(r.text)
    assert {v: "\n\n".join(p) for v, p in got.items()} == {v: "\n\n".join(t for w, _, t in blocks if w == v) for v in ("a/b c+%", "long")} and len(got["long"]) > 10


def test_parts_share_files(spark, tmp_path):
    """Neither a part nor a short lecture has a file of its own, and any text and lecture comes back as it was."""
    odd = ["", "\n", " a\r\nb\r", "\u2028\x85\x0b\x00", '"quoted" \\n {}', "\n\n", "é😀", "x" * (21 << 20)]  # the last is longer than a JSON string may be by default
    rows = [(v, i, t) for v in ("a/b c+%", "", None, "..") for i, t in enumerate(odd[:-1])] + [("long", 5, odd[-1])] + [(f"v{i}", k, f"{i} {k}") for i in range(200) for k in range(3)]
    write_text_parts(spark.createDataFrame(rows, "video_id string, part long, text string").repartition(3), str(tmp_path / "out"))
    assert len(list((tmp_path / "out").rglob("part-*"))) == 3
    assert {(r.video_id, r.part, r.text) for r in read_text_parts(spark, str(tmp_path / "out")).collect()} == set(rows)


def test_transcripts_in_parts(spark, tmp_path):
    s = spark.range(40).selectExpr("'v' AS video_id", "cast(id as int) AS pos", "concat('slide', id + 1) AS slide_id", "cast(id as double) AS start_sec", "cast(id + 1 as double) AS end_sec", "if(id % 3 = 0, array(), array(struct(0D AS start_sec, concat(' said ', id) AS text))) AS asr")
    io.export_transcripts(s, str(tmp_path / "t"), size=100)
    whole = io.transcripts(s).first().value
    assert "\n\n".join(r.text for r in sorted(read_text_parts(spark, str(tmp_path / "t")).collect(), key=lambda r: r.part)) == whole


def test_transcripts_of_many_lectures(spark, tmp_path, monkeypatch):
    """Short lectures share files, and nothing but the files is left behind."""
    monkeypatch.setattr(tables, "shared_folder", lambda _: f"file://{tmp_path}/shared")
    s = spark.range(900).selectExpr("concat('v', id % 300) AS video_id", "cast(id div 300 as int) AS pos", "concat('slide', id div 300 + 1) AS slide_id", "cast(id as double) AS start_sec", "cast(id + 1 as double) AS end_sec", "array(struct(0D AS start_sec, concat('said ', id) AS text)) AS asr")
    io.export_transcripts(s, str(tmp_path / "t"), size=40)
    got = {}
    for r in sorted(read_text_parts(spark, str(tmp_path / "t")).collect(), key=lambda r: r.part):
        got.setdefault(r.video_id, []).append(r.text)
    assert all(len(p) > 1 for p in got.values()) and {v: "\n\n".join(p) for v, p in got.items()} == {r.video_id: r.value for r in io.transcripts(s).collect()}
    assert len(list((tmp_path / "t").rglob("part-*"))) <= 16 and list((tmp_path / "shared").iterdir()) == []


def test_stored_scores_are_not_shuffled(spark, tmp_path):
    keys = "video_id string, question_id string, model string"
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    now, other = scoring.settings_hash(1, 2, 0.0, ["a", "b"]), scoring.settings_hash(9, 2, 0.0, ["a", "b"])
    try:
        rows = [(f"v{i % 5}", f"q{i}", "m", axis) for i in range(100) for axis in "ab" if not (axis == "b" and i % 4 == 0)]
        scores = spark.createDataFrame(rows, f"{keys}, axis string").withColumn("settings_hash", F.when(F.substring("question_id", -1, 1) == "1", other).otherwise(now))
        for axis in "ab":
            io.append_score_table(scores.where(F.col("axis") == axis), "lectern_test_scores", str(tmp_path / "scores"), 8)
        q = spark.createDataFrame([(f"v{i % 5}", f"q{i}", "m") for i in range(120)], keys)
        left = scoring.pending(q, spark.table("lectern_test_scores"), ["a", "b"], now)
        assert {r.question_id for r in left.collect()} == {f"q{i}" for i in range(120) if i >= 100 or i % 4 == 0 or i % 10 == 1}
        plan = left._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
        stored = plan[plan.rindex("HashAggregate" if "HashAggregate" in plan else "ObjectHashAggregate") :]
        assert plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in stored and "settings_hash" in stored  # of the questions alone
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS lectern_test_scores")


@pytest.mark.parametrize("kind", ["float", "double"])
def test_top_k_with_ties_and_parts(spark, kind):
    rng = Random(6)
    rows = [(v, "ocr", f"c{i:03}", f"p{i // 3}", [float(rng.randrange(3)) for _ in range(4)]) for v in "AB" for i in range(90)]
    c = spark.createDataFrame(rows, f"video_id string, store_mode string, child_id string, chunk_id string, embedding array<{kind}>")
    asks = [(i, v, "ocr", [float(rng.randrange(3)) for _ in range(4)]) for v in "AB" for i in range(7)]
    q = spark.createDataFrame(asks, f"query_id long, video_id string, store_mode string, embedding array<{kind}>")
    got = {(r.video_id, r.query_id, r["rank"]): (r.child_id, r.chunk_id, r.score) for r in retrieve.knn_topk(q, c, 5, part_rows=20, block=3).collect()}
    want = {}
    for i, v, _, e in asks:
        best = sorted(((-sum(a * b for a, b in zip(e, x[4], strict=True)), x[2], x[3]) for x in rows if x[0] == v))[:5]
        want |= {(v, i, k + 1): (n, p, -s) for k, (s, n, p) in enumerate(best)}
    assert got == want
    assert len(retrieve.knn_topk(q, c.where("child_id < 'c003'"), 5).collect()) == 14 * 3


def test_recurring_terms_count_slides(spark):
    s = spark.createDataFrame([("v", 0, "Word word WORD other"), ("v", 1, "word"), ("v", 2, None), ("w", 0, "an é été")], "video_id string, pos int, full_text string")
    assert {(r.video_id, r.term): (r.n_slides, r["rank"]) for r in terms.recurring_terms(s).collect()} == {("v", "word"): (2, 1), ("v", "other"): (1, 2), ("w", "été"): (1, 1)}


@pytest.mark.parametrize(("size", "pairs", "parts", "limit"), [(None, 1_000_000, 4, 1 << 20), (8, 60, 5, 1 << 20), (3, 40, 7, 1 << 20), (1, 1, 2, 1 << 20), (8, 60, 5, 0)])
def test_recurring_terms_by_summaries(spark, monkeypatch, size, pairs, parts, limit):
    """The rows of the plain count: counted at once, candidates read again, lectures without a sure candidate in full, and all that is open
    in full where nothing fits a broadcast."""
    sizes = []
    monkeypatch.setattr(terms, "fits", lambda df: sizes.append(fits(df, 0) is df.isEmpty()) or fits(df, limit))
    rng = Random(9)
    words = ["".join(rng.choice("abcdeé") for _ in range(4)) for _ in range(120)]
    rows = []
    for v, n in (("hot", 300), ("flat", 60), ("two", 2), (None, 40)):
        for i in range(n):
            drawn = rng.choices(words, k=12) if v == "flat" else [words[min(int(rng.paretovariate(0.8)) - 1, 119)] for _ in range(12)]
            rows.append((v, i, " ".join(drawn) if i % 9 else rng.choice(["", None])))
    rng.shuffle(rows)
    s = spark.createDataFrame(rows, "video_id string, pos int, full_text string").repartition(parts)
    key = lambda df: sorted((str(r.video_id), r["rank"], r.term, r.n_slides) for r in df.collect())
    assert key(terms.recurring_terms_summed(s, 3, size, pairs)) == key(terms.recurring_terms(s, 3))
    assert terms.recurring_terms_summed(s.limit(0), 3).columns == terms.recurring_terms(s, 3).columns and terms.recurring_terms_summed(s.limit(0), 3).isEmpty()
    assert sizes and all(sizes)
