"""Stored replies: each prompt is asked once, and what failed or was not reached alone again."""

import json
import os

import pytest
from pyspark.sql import functions as F

from lectern.operators import questions


def model(path, fails=()):
    def fn(prompts):
        if any(p in fails for p in prompts):
            raise RuntimeError
        with open(path, "a") as f:
            f.write("".join(f"{json.dumps(p)}\n" for p in prompts))
        return [f"re {p}" for p in prompts]

    return fn


def asked(path):
    return [json.loads(x) for x in open(path)] if os.path.exists(path) else []


def test_asked_once_over_rows_and_runs(spark, tmp_path):
    calls, journal = tmp_path / "calls", str(tmp_path / "journal")
    df = spark.createDataFrame([(i, f"p{i % 20}" if i % 9 else None, "x", "y") for i in range(200)], "id long, p string, _key string, r string")
    got = questions.ask_once(df, "p", model(calls, ("p3", "p7")), "r", journal, retries=0)
    assert got.columns == df.columns
    rows = {r.id: r.r for r in got.collect()}
    assert rows == {i: None if not i % 9 or i % 20 in (3, 7) else f"re p{i % 20}" for i in range(200)}
    assert sorted(asked(calls)) == sorted(f"p{i}" for i in range(20) if i not in (3, 7))  # a failing prompt costs no other
    again = questions.ask_once(df, "p", model(calls), "r", journal)
    assert {r.id: r.r for r in again.collect()} == {i: f"re p{i % 20}" if i % 9 else None for i in range(200)}
    assert sorted(asked(calls)[18:]) == ["p3", "p7"]
    n = len(asked(calls))
    for trial in (1, 2, 1):  # settings are part of what is asked
        questions.ask_once(df.where("id in (1, 21)"), "p", model(calls), "r", journal, F.lit(f"trial {trial}")).count()
    assert asked(calls)[n:] == ["p1", "p1"]
    assert questions.ask_once(df.where("false"), "p", model(calls), "r", journal).collect() == []


def test_useless_replies_are_not_stored(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("b",)], "p string")
    bad = lambda ps: ["?" if p == "a" else f"ok {p}" for p in ps]
    ok = lambda r: r.startswith("ok")
    journal = str(tmp_path / "journal")
    assert {r.p: r.r for r in questions.ask_once(df, "p", bad, "r", journal, valid=ok).collect()} == {"a": None, "b": "ok b"}
    assert {r.p: r.r for r in questions.ask_once(df, "p", lambda ps: [f"ok 2 {p}" for p in ps], "r", journal, valid=ok).collect()} == {"a": "ok 2 a", "b": "ok b"}


def test_a_killed_run_goes_on_where_it_stopped(spark, tmp_path, monkeypatch):
    calls, journal = tmp_path / "calls", str(tmp_path / "journal")
    df = spark.range(64).select(F.concat(F.lit("p"), "id").alias("p"))
    whole, left = questions.apply_model, [3]

    def dies(*args):
        left[0] -= 1
        if not left[0]:
            raise KeyboardInterrupt
        return whole(*args)

    monkeypatch.setattr(questions, "apply_model", dies)
    with pytest.raises(KeyboardInterrupt):
        questions.ask_once(df, "p", model(calls), "r", journal)
    monkeypatch.setattr(questions, "apply_model", whole)
    first = asked(calls)
    assert 0 < len(first) < 64
    assert questions.ask_once(df, "p", model(calls), "r", journal).where("r is null").count() == 0
    assert sorted(asked(calls)) == sorted(f"p{i}" for i in range(64))  # none twice


def test_reasoning_stands_in_for_blank_content(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",)], "p string")
    fn = lambda ps: [{"a": ("said", "thought"), "b": (" ", "thought"), "c": (None, None)}[p] for p in ps]
    assert {r.p: r.r for r in questions.apply_model(df, "p", fn, "r").collect()} == {"a": "said", "b": "thought", "c": ""}


def test_methods_leave_out_what_they_lack(spark):
    chunks = spark.createDataFrame([("v", "c1", "some words", ""), ("v", "c2", "", "no seeds"), ("v", "c3", "", ""), ("v", "c4", "no hit words", "")], "video_id string, chunk_id string, ocr_text string, asr_text string")
    seen = []

    def ask(df, prompt, out):
        seen.append(sorted(r[0] for r in df.select(prompt).collect()))
        reply = F.when(F.col(prompt).startswith("seeds"), F.when(F.col(prompt).contains("words"), "a, b")).otherwise(F.lit('{"question": "q", "answer": "A"}'))
        return df.withColumn(out, reply)

    find = lambda q: q.where("query_id = 'c1'").select("video_id", "query_id", F.concat(F.lit("context of "), "query").alias("context"))
    templates = {"seeds": "seeds {text}", "direct": "direct {text}", "rag": "rag {seeds} {context}", "analysis": "analysis {levels} {context}", "rag_cot": "cot {cot}"}
    got = {(r.method, r.chunk_id) for r in questions.generate(chunks, templates, ask, find).collect()}
    assert got == {("direct", "c1"), ("direct", "c2"), ("direct", "c4"), ("rag", "c1"), ("rag_cot", "c1")}
    assert seen[3] == ["analysis 知識・応用・評価 context of a、b"] and seen[2] == ["rag a、b context of a、b"] and len(seen) == 5
    with pytest.raises(ValueError, match="unknown"):
        questions.generate(chunks, templates, ask, find, ["other"])
