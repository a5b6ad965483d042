"""Versioned indexes and stored vectors."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern import tables
from lectern.operators import documents, retrieve
from lectern.sources import indexes
from lectern.sources.indexes import expire_snapshots, read_index, read_sibling, read_snapshot, write_index

ROW = "video_id string, store_mode string, chunk_id string, page_content string"


def rows(df):
    return sorted((r.video_id, r.page_content) for r in df.collect())


def test_modes_and_lectures_apart(spark, tmp_path):
    base = str(tmp_path / "index")
    p = spark.createDataFrame([("lec1", "ocr", "p1", "x")], ROW)
    c = spark.createDataFrame([("lec1", "ocr", "p1", "y"), ("lec1", "asr", "p1", "z")], ROW)
    with pytest.raises(ValueError, match="no index"):
        read_index(spark, base, "ocr")
    assert write_index(p, c, base, buckets=2) == 1
    assert write_index(p.withColumn("video_id", F.lit("lec2")), c.limit(0), base) == 2
    parents, children = read_index(spark, base, "ocr")
    assert rows(parents) == [("lec1", "x"), ("lec2", "x")] and rows(children) == [("lec1", "y")]
    assert rows(read_sibling(spark, base, "asr")[0]) == rows(parents) and rows(read_sibling(spark, base, "ocr")[1]) == []
    write_index(p, c.limit(0), base)  # the lecture has no children any more
    assert rows(read_index(spark, base, "ocr")[1]) == [] and read_index(spark, base, "ocr")[0].count() == 2
    assert rows(children) == [("lec1", "y")] and rows(parents) == [("lec1", "x"), ("lec2", "x")]  # tables opened before stay
    odd = p.withColumn("video_id", F.lit("0 1/a:b"))
    write_index(odd, odd, base)
    write_index(odd, odd.limit(0), base)
    assert "0 1/a:b" in [r.video_id for r in read_index(spark, base, "ocr")[0].collect()] and read_index(spark, base, "ocr")[1].count() == 0
    assert rows(read_index(spark, base, "ocr", 2)[1]) == [("lec1", "y")]
    wide = p.withColumn("extra", F.lit(7))
    write_index(wide, wide, base)
    assert {r.video_id: r.extra for r in read_index(spark, base, "ocr")[0].collect()} == {"lec1": 7, "lec2": None, "0 1/a:b": None}
    expire_snapshots(spark, base, 1)
    assert len(os.listdir(f"{base}/snapshots")) <= 2 and rows(read_index(spark, base, "ocr")[0]) == [("0 1/a:b", "x"), ("lec1", "x"), ("lec2", "x")]
    assert write_index(p.limit(0), c, base) == 7 and read_index(spark, base, "asr")[1].count() == 0
    assert indexes.index_name("b", "combined") == "b_asr_ocr_mix" and indexes.sibling_mode("asr") == "ocr"
    with pytest.raises(ValueError, match="sibling"):
        read_sibling(spark, base, "combined")


def test_folders_follow_buckets(spark, tmp_path):
    base = str(tmp_path / "index")
    p = spark.range(500).selectExpr("concat('lecture ', id) AS video_id", "'ocr' AS store_mode", "'p' AS chunk_id", "'x' AS page_content")
    write_index(p, p, base, buckets=4)
    assert sum(len(by) for by in read_snapshot(spark, base)["folders"].values()) == 8
    assert sum(len(d) for _, d, _ in os.walk(base)) < 30


def test_a_write_that_fails_changes_nothing(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "index")
    p = spark.createDataFrame([("a", "ocr", "p", "old"), ("b", "ocr", "p", "old")], ROW)
    write_index(p, p, base, buckets=1)
    new = p.withColumn("page_content", F.lit("new"))

    def fails(df):
        return df.withColumn("page_content", F.raise_error(F.lit("no vectors")))

    with pytest.raises(Exception, match="no vectors"):
        write_index(new, new, base, fails)
    assert rows(read_index(spark, base, "ocr")[0]) == rows(read_index(spark, base, "ocr")[1]) == [("a", "old"), ("b", "old")]
    state = read_snapshot(spark, base)
    write_index(new, new, base)  # another writer, ahead of one that began from the same state
    with pytest.raises(RuntimeError, match="write again"):
        indexes._publish(spark, base, state | {"number": 2})
    assert {c for _, c in rows(read_index(spark, base, "ocr")[0])} == {"new"}


def counting(path):
    def fn(texts):
        with open(path, "a") as f:
            f.write("".join(f"{json.dumps(t)}\n" for t in texts))
        return np.array([[len(t), t.count("x") + 1.0] for t in texts], float).reshape(-1, 2)

    return fn


def asked(path):
    return [json.loads(t) for t in open(path)] if os.path.exists(path) else []


def test_each_text_is_embedded_once(spark, tmp_path):
    fn = counting(tmp_path / "calls")
    store = str(tmp_path / "vectors")
    df = spark.createDataFrame([(i, f"text {i % 50}" if i % 7 else None, "k") for i in range(400)], "id long, t string, _key string")
    got = retrieve.embed_once(df, "t", fn, store, name="m").collect()
    first = asked(tmp_path / "calls")
    assert len(first) == len(set(first)) == 51 and len(got) == 400
    plain = {r.id: r.embedding for r in retrieve.embed_texts(df, "t", fn).collect()}
    assert {r.id: r.embedding for r in got} == plain and got[0].asDict().keys() == {"id", "t", "_key", "embedding"}
    n = len(asked(tmp_path / "calls"))
    more = df.unionByName(spark.createDataFrame([(999, "never seen", "k")], df.schema))
    assert retrieve.embed_once(more, "t", fn, store, name="m").count() == 401 and asked(tmp_path / "calls")[n:] == ["passage: never seen"]
    assert retrieve.embed_once(df.limit(9), "t", fn, store, "query", name="m").count() == 9  # another prefix is another text
    retrieve.embed_once(df.where("id = 1"), "t", fn, store, name="m 2").count()
    assert asked(tmp_path / "calls")[-1] == "passage: text 1"  # another model
    assert retrieve.embed_once(df.where("false"), "t", fn, store, name="m").collect() == []


def test_builds_ask_for_new_texts_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda _: f"file://{tmp_path}/kept")
    seg = "array<struct<start_sec:double,end_sec:double,text:string>>"
    slides = spark.range(100).selectExpr("concat('v', id % 10) AS video_id", "cast(id div 10 as int) AS pos", "concat('slide', id div 10 + 1) AS slide_id", "0D AS start_sec", "1D AS end_sec", "concat('text of slide ', id) AS full_text", f"cast(array(struct(0D, 1D, concat('said on ', id))) AS {seg}) AS asr")
    fn, base = counting(tmp_path / "calls"), str(tmp_path / "index")
    documents.build_char_index(slides, base, fn, 20, embedder="m")
    first = asked(tmp_path / "calls")
    children = [r.page_content for m in documents.MODES for r in read_index(spark, base, m)[1].collect()]
    assert sorted(first) == sorted({f"passage: {c}" for c in children}) and len(children) > 100
    documents.build_char_index(slides, base, fn, 20, embedder="m")
    assert len(asked(tmp_path / "calls")) == len(first)
    changed = slides.where("video_id = 'v3'").withColumn("full_text", F.when(F.col("pos") == 2, "changed").otherwise(F.col("full_text")))
    documents.build_char_index(changed, base, fn, 20, embedder="m")
    new = asked(tmp_path / "calls")[len(first) :]
    assert new and len(new) <= 2 and all("changed" in t for t in new)
    assert sorted(r.page_content for m in documents.MODES for r in read_index(spark, base, m)[1].where("video_id <> 'v3'").collect()) == sorted(c for m in documents.MODES for c in [r.page_content for r in read_index(spark, base, m, 1)[1].where("video_id <> 'v3'").collect()])
    assert os.listdir(tmp_path / "kept") == []
