"""Golden rows of the text functions, derived by hand."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as T


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("x")).first()[0]


@pytest.mark.parametrize(("text", "want"), [("a\n\n a \nb\r\nb\nc\na", "a\nb\r\nc\na"), ("　見出し　\n見出し", "見出し"), (None, ""), ("", ""), (" \n ", "")])
def test_normalize_text(spark, text, want):
    assert one(spark, text, T.normalize_text) == want
    assert one(spark, want, T.normalize_text) == want


def test_parse_seeds_and_fences(spark):
    assert one(spark, "TCP、 UDP,,IP\n，", T.parse_seeds) == ["TCP", "UDP", "IP"]
    assert one(spark, "```json\nx\n```", T.strip_fences) == "x"
    assert one(spark, "a```x```b", T.drop_fenced) == "ab"
    assert one(spark, '{"proper_nouns": ["a"]}', T.parse_terms) == ["a"]
    assert one(spark, "nothing", T.parse_terms) == []


@pytest.mark.parametrize(("reply", "n"), [('{"question": "q", "answer": "A"}', 1), ('[{"question": "q", "answer": "A"}, 3, {"question": "p", "answer": "B"}]', 2), ("{broken", 0), ('{"question": "q", "answer": "A"} and more', 0), ('{"question": "", "answer": "A"}', 0), ('{"question": "q"}', 0), (None, 0)])
def test_parse_questions(spark, reply, n):
    assert len(one(spark, reply, T.parse_questions)) == n


@pytest.mark.parametrize(("score", "want"), [("4.5", 4), ("2.5", 2), ("3.5", 4), ("5.2", None), ("0.9", None), ('"4"', None)])
def test_parse_score(spark, score, want):
    assert one(spark, f'so ```json\n{{"score": {score}, "cot": "c"}}\n```', T.parse_score)["score"] == want


def test_fill_is_literal(spark):
    assert one(spark, "$1 \\ {b}", lambda c: T.fill("x {a} y {b}", a=c, b=F.lit(2))) == "x $1 \\ {b} y 2"


def test_transcript_block(spark):
    kind = "array<struct<text:string>>"
    block = lambda c: T.transcript_block(F.lit("slide1"), F.lit(0.4), F.lit(9.0), c)
    assert one(spark, [], block, kind) == "[slide1 | 0.4s〜9.0s]\n（ASRなし）"
    assert one(spark, [(" ",)], block, kind) == "[slide1 | 0.4s〜9.0s]"
    assert one(spark, [(" a ",), ("b",)], block, kind) == "[slide1 | 0.4s〜9.0s]\na\nb"
