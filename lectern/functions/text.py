"""Text of slides and speech: stripping, normalising, joining, parsing model replies, filling templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that stand before parts of a text (fixed values).
SLIDE_LABEL, SPEECH_LABEL, KEYWORD_LABEL, TERM_LABEL = "[スライド]\n", "[音声]\n", "[キーワード]\n", "[固有名詞・専門用語]\n"
NO_SPEECH, CONTEXT_SEPARATOR, NO_CONTEXT = "（ASRなし）", "\n\n---\n\n", "（取得できませんでした）"
#: Answers and levels that are asked for (fixed values).
CHOICES, LEVEL_NAMES = ("A", "B", "C", "D"), ("知識", "応用", "評価")
#: White space characters, as text (fixed values).
WHITE = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(WHITE))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def normalize_text(c: Column) -> Column:
    """Without blank lines and lines that repeat the kept line before them (both stripped); null: ''."""
    keyed = F.transform(F.split(text_or_empty(c), "\n", -1), lambda s: F.struct(s.alias("line"), strip(s).alias("key")))
    lines = F.array(F.filter(keyed, lambda s: s["key"] != ""))  # one element, so that the lambda below binds the list once
    fresh = F.transform(lines, lambda known: F.filter(known, lambda s, i: (i == 0) | (s["key"] != F.get(known, i - 1)["key"])))
    return strip(F.array_join(F.transform(F.get(fresh, F.lit(0)), lambda s: s["line"]), "\n"))


def speech_text(segments: Column, strip_each: bool = False) -> Column:
    """The texts of the segments that are not blank, a line each."""
    kept = F.filter(F.transform(segments, lambda s: text_or_empty(s["text"])), lambda t: strip(t) != "")
    return text_or_empty(F.array_join(F.transform(kept, strip) if strip_each else kept, "\n"))


def joined(separator: str, *parts: Column) -> Column:
    """The parts that are not empty."""
    return F.concat_ws(separator, *[F.when(p != "", p) for p in parts])


def combined_text(ocr: Column, asr: Column) -> Column:
    return joined("\n\n", ocr, F.when(asr != "", F.concat(F.lit(SPEECH_LABEL), asr)).otherwise(""))


def model_input_text(ocr: Column, asr: Column) -> Column:
    return joined("\n\n", F.when(ocr != "", F.concat(F.lit(SLIDE_LABEL), ocr)).otherwise(""), F.when(asr != "", F.concat(F.lit(SPEECH_LABEL), asr)).otherwise(""))


def hint_block(hints: Column) -> Column:
    return F.when(F.size(F.coalesce(hints, F.array().cast("array<string>"))) > 0, F.concat(F.lit(KEYWORD_LABEL), F.array_join(hints, "、"), F.lit("\n\n"))).otherwise("")


def term_section(terms: Column) -> Column:
    return F.when(F.size(F.coalesce(terms, F.array().cast("array<string>"))) > 0, F.concat(F.lit(TERM_LABEL), F.array_join(terms, "、"), F.lit("\n"))).otherwise("")


def speech_prompt(terms: Column, limit: int = 200) -> Column:
    return F.substring(F.array_join(terms, "、"), 1, limit)


def fill(template: str, **slots: Column) -> Column:
    """The template with each ``{name}`` replaced by its column, taken literally."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = sorted((rest.find("{" + n + "}"), n) for n in slots if "{" + n + "}" in rest)
        if not found:
            parts.append(F.lit(rest))
            break
        at, name = found[0]
        parts += [F.lit(rest[:at]), text_or_empty(slots[name].cast("string"))]
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts)


def strip_fences(c: Column) -> Column:
    """Without the fence marks of code blocks; what they hold stays."""
    return strip(F.regexp_replace(c, "```json|```", ""))


def drop_fenced(c: Column) -> Column:
    """Without code blocks and what they hold."""
    return F.regexp_replace(c, "(?s)```.*?```", "")


def parse_seeds(c: Column) -> Column:
    """Terms between commas of three kinds and line ends."""
    return F.filter(F.transform(F.split(text_or_empty(drop_fenced(c)), "[、,，\n]"), strip), lambda s: s != "")


def parse_terms(c: Column) -> Column:
    """The list under ``proper_nouns`` of a JSON reply; [] if there is none."""
    return F.coalesce(F.from_json(strip_fences(c), "proper_nouns array<string>")["proper_nouns"], F.array().cast("array<string>"))


QUESTION_FIELDS = ("question", "choice_A", "choice_B", "choice_C", "choice_D", "answer", "reason", "bloom_level")


def parse_questions(c: Column) -> Column:
    """A JSON reply (an object, or an array of which the objects count) to an array of structs of strings;
    objects without question or answer are left out, broken replies give none."""
    body = strip_fences(text_or_empty(c))
    whole = F.when(body.rlike(r"(?s)^[\[{].*[\]}]$"), F.try_parse_json(body))
    items = F.when(F.schema_of_variant(whole).like("OBJECT%"), F.array(whole)).otherwise(F.try_variant_get(whole, "$", "array<variant>"))
    objects = F.filter(items, lambda v: F.schema_of_variant(v).like("OBJECT%"))
    fields = F.transform(objects, lambda v: F.struct(*[F.coalesce(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")).alias(n) for n in QUESTION_FIELDS]))
    return F.coalesce(F.filter(fields, lambda q: (q["question"] != "") & (q["answer"] != "")), F.array().cast("array<struct<" + ",".join(f"{n}:string" for n in QUESTION_FIELDS) + ">>"))


def parse_score(c: Column) -> Column:
    """``score`` (1 to 5, halves to even; null if the reply has none), ``cot``, ``reason``."""
    body = F.from_json(F.regexp_extract(strip_fences(text_or_empty(c)), r"(?s)\{.*\}", 0), "score double, cot string, reason string")
    return F.struct(F.when(body["score"].between(1, 5), F.bround(body["score"], 0).cast("int")).alias("score"), text_or_empty(body["cot"]).alias("cot"), text_or_empty(body["reason"]).alias("reason"))


def transcript_block(slide_id: Column, start: Column, end: Column, segments: Column) -> Column:
    """Header, the segments that are not blank, a line each, or a note that there are none."""
    head = F.when(start.isNotNull(), F.concat(F.lit("["), slide_id, F.lit(" | "), start.cast("string"), F.lit("s〜"), end.cast("string"), F.lit("s]"))).otherwise(F.concat(F.lit("["), slide_id, F.lit("]")))
    body = F.when(F.coalesce(F.size(segments), F.lit(0)) <= 0, F.lit(NO_SPEECH)).otherwise(speech_text(segments, True))
    return joined("\n", head, body)


def preview(text: Column, limit: int = 500) -> Column:
    return F.concat(F.substring(text, 1, limit), F.when(F.length(text) > limit, "...").otherwise(""))


def answer_flags(answer: Column, level: Column) -> Column:
    """Whether the answer is one of the four choices and the level one of the three known (neither is enforced)."""
    return F.struct(F.coalesce(answer.isin(*CHOICES), F.lit(False)).alias("known_answer"), F.coalesce(level.isin(*LEVEL_NAMES), F.lit(False)).alias("known_level"))


def prefixed(text: Column, kind: str) -> Column:
    """What embedding models expect before a query or a passage."""
    return F.concat(F.lit({"query": "query: ", "passage": "passage: "}[kind]), text)
