"""Question bank: model inputs, calls, replies to questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import LEVEL_NAMES, QUESTION_FIELDS, fill, model_input_text, parse_questions, parse_seeds, strip, term_section
from lectern.tables import fresh, keep, partitions, release

LEVELS = "、".join(LEVEL_NAMES)
METHODS = ("direct", "rag", "rag_cot")


def question_inputs(chunks: DataFrame, template: str, n: int = 3, level: str | None = None) -> DataFrame:
    """Adds ``prompt``: the template with {text}, {terms}, {n}, {level} (by default all levels; {levels}: joined by another dot),
    {seeds}, {context}, {cot} filled from the row; chunks without text, and without seeds or context where these columns are given, are left out."""
    df = chunks.withColumn("input_text", model_input_text(F.col("ocr_text"), F.col("asr_text"))).where("input_text <> ''")
    if "seeds" in df.columns:
        df = df.where(F.size("seeds") > 0)
    for c in ("context", "cot"):
        if c in df.columns:
            df = df.where(strip(F.coalesce(c, F.lit(""))) != "")
    slot = lambda c, v: v if c in df.columns else F.lit("")
    return df.withColumn("prompt", fill(template, text=F.col("input_text"), terms=slot("terms", term_section(F.col("terms"))), n=F.lit(n), level=F.lit(level or LEVELS), levels=F.lit(level or "・".join(LEVEL_NAMES)), seeds=slot("seeds", F.array_join("seeds", "、")), context=slot("context", F.col("context")), cot=slot("cot", F.col("cot"))))


def with_lecture_terms(chunks: DataFrame, lectures: DataFrame) -> DataFrame:
    """Every chunk with the terms of its lecture (meta.proper_nouns_global), [] where there are none."""
    terms = lectures.select("video_id", F.col("meta.proper_nouns_global").alias("terms"))
    return chunks.join(terms, "video_id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))


def seed_inputs(chunks: DataFrame, template: str, n: int = 10) -> DataFrame:
    """Adds ``prompt`` to chunks with text: the template with {text} and {n} filled."""
    df = chunks.withColumn("input_text", model_input_text(F.col("ocr_text"), F.col("asr_text"))).where("input_text <> ''")
    return df.withColumn("prompt", fill(template, text=F.col("input_text"), n=F.lit(n)))


def seed_queries(chunks: DataFrame) -> DataFrame:
    """Chunks that have seeds, with ``query``: the seeds as one text."""
    return chunks.where(F.size("seeds") > 0).withColumn("query", F.array_join("seeds", "、"))


def reply_text(content: Column, reasoning: Column) -> Column:
    """A reply's content, or its reasoning where the content is empty."""
    return F.when(strip(F.coalesce(content, F.lit(""))) != "", content).otherwise(F.coalesce(reasoning, F.lit("")))


def _answers(fn: Callable, prompts: list[str]) -> list[tuple[bool, str | None]]:
    """Whether each prompt was answered, and its reply; a batch that fails is asked in halves, so that one prompt fails alone."""
    try:
        replies = list(fn(prompts))
        if len(replies) != len(prompts):
            raise ValueError("as many replies as prompts are expected")
    except Exception:  # noqa: BLE001  the model is the caller's
        half = len(prompts) // 2
        return [(False, None)] if not half else _answers(fn, prompts[:half]) + _answers(fn, prompts[half:])
    return [(True, _text(r)) for r in replies]


def _text(reply: str | tuple[str | None, str | None] | None) -> str | None:
    """Of a pair the content, or the reasoning where the content is blank."""
    if not isinstance(reply, tuple):
        return reply
    content, reasoning = reply
    return content if content and content.strip() else reasoning or ""


def apply_model(df: DataFrame, prompt: str, fn: Callable[[list[str]], list], out: str, retries: int = 2, valid: Callable[[str], bool] | None = None) -> DataFrame:
    """Adds the replies of a batch callable: texts, None, or pairs (content, reasoning), of which the reasoning counts where the
    content is blank.  A prompt that keeps failing gets a null reply, never a failed job; with ``valid``, prompts whose reply can't be
    used are asked again, and the last reply counts."""

    def go(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            prompts, replies = s.tolist(), [None] * len(s)
            open_ = list(range(len(s)))
            for _ in range(retries + 1):
                still = []
                for i, (answered, reply) in zip(open_, _answers(fn, [prompts[i] for i in open_]), strict=True):
                    if answered:
                        replies[i] = reply
                    if not answered or valid and (reply is None or not valid(reply)):
                        still.append(i)
                open_ = still
                if not open_:
                    break
            yield pd.Series(replies, dtype=object)

    # not deterministic, or a filter on the replies would be pushed below and ask again
    return df.withColumn(out, F.pandas_udf(go, "string").asNondeterministic()(F.col(prompt)))


REPLIES = "key string, reply string"


def ask_once(df: DataFrame, prompt: str, fn: Callable[[list[str]], list], out: str, journal: str, settings: Column | None = None, retries: int = 2, valid: Callable[[str], bool] | None = None, waves: int = 8, tasks: int | None = None) -> DataFrame:
    """As apply_model(), but each prompt is asked once for all rows and runs: usable replies are kept in the folder ``journal`` by the
    SHA-256 of the settings and the prompt (``settings``: what a reply depends on besides, such as model, temperature and trial).

    Prompts without a reply are asked in ``waves``, dealt by their key, each of which is appended to the journal when it is done; so a run
    that is killed and started again asks only what is open, and prompts that failed are asked again by the next run alone.  At most
    ``tasks`` calls go on at a time (default: as many as shuffles have partitions).  Null prompts get null replies; no rows: no call."""
    spark = df.sparkSession
    key = fresh(df, "_key")
    got = f"{key}2"
    code = F.concat(F.sha2(F.coalesce(settings, F.lit("")) if settings is not None else F.lit(""), 256), prompt)
    asked = keep(df.withColumn(key, F.when(F.col(prompt).isNotNull(), F.sha2(code, 256))))

    def stored() -> DataFrame:
        folder = spark._jvm.org.apache.hadoop.fs.Path(journal)
        found = folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)
        return spark.read.schema(REPLIES).parquet(journal) if found else spark.createDataFrame([], REPLIES)

    prompts = asked.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.first(prompt).alias("_prompt"))
    left = keep(prompts.join(stored().select("key"), "key", "left_anti"))
    sizes = {r[0] for r in left.groupBy(F.pmod(F.xxhash64("key"), F.lit(waves))).count().collect()}  # a row for each wave
    for wave in sorted(sizes):
        now = left.where(F.pmod(F.xxhash64("key"), F.lit(waves)) == wave).repartition(tasks or partitions(spark), "key")
        told = apply_model(now, "_prompt", fn, "reply", retries, valid).select("key", "reply").where("reply is not null")
        if valid:
            told = told.where(F.pandas_udf(lambda s: s.map(valid).astype(bool), "boolean")("reply"))
        told.write.mode("append").parquet(journal)
    release(left)
    known = stored().groupBy(F.col("key").alias(got)).agg(F.first("reply").alias("_reply"))  # runs at a time may both have asked
    return asked.join(known, F.col(key) == F.col(got), "left").select(*[c for c in df.columns if c != out], F.col("_reply").alias(out))


def questions(replies: DataFrame, method: str, chunk_mode: str, reply: str = "reply") -> DataFrame:
    """A row for each valid question of each chunk's reply, with its id."""
    rows = replies.select("video_id", "chunk_id", F.posexplode(parse_questions(F.col(reply))).alias("ord", "q"))
    name = F.format_string(f"{method}_{chunk_mode}_%s_q%02d", "chunk_id", "ord")
    return rows.select("video_id", "chunk_id", name.alias("question_id"), F.lit(method).alias("method"), F.lit(chunk_mode).alias("chunk_mode"), *[f"q.{f}" for f in QUESTION_FIELDS])


def generate(chunks: DataFrame, templates: Mapping[str, str], ask: Callable[[DataFrame, str, str], DataFrame], find: Callable[[DataFrame], DataFrame], methods: Sequence[str] = METHODS, chunk_mode: str = "time", n: int = 3, level: str | None = None, n_seeds: int = 10) -> DataFrame:
    """Questions of chunks (video_id, chunk_id, ocr_text, asr_text, and terms) by each method, one after another:

    - ``direct``: from the chunk's text;
    - ``rag``: seeds are asked for, contexts are found for them, and questions are asked for from both;
    - ``rag_cot``: an analysis of seeds and context is asked for first.

    ``templates``: ``direct``, ``rag``, ``rag_cot`` (the questions), ``seeds`` and ``analysis``.  ``ask(df, prompt, out)`` adds replies (see apply_model
    and ask_once); ``find(queries)`` gives contexts (video_id, query_id, context) of queries (video_id, query_id, query), where query_id is
    the chunk's.  Chunks without text, seeds, hits, context or analysis are left out of the methods that need them."""
    unknown = set(methods) - set(METHODS)
    if unknown:
        raise ValueError(f"unknown methods: {', '.join(sorted(unknown))}")
    out, found = [], None
    for method in methods:
        df = chunks
        if method != "direct":
            if found is None:
                seeded = ask(seed_inputs(chunks, templates["seeds"], n_seeds), "prompt", "_seeds")
                seeded = keep(seed_queries(seeded.drop("prompt", "input_text").withColumn("seeds", parse_seeds(F.col("_seeds"))).drop("_seeds")))
                contexts = find(seeded.select("video_id", F.col("chunk_id").alias("query_id"), "query"))
                found = keep(seeded.join(contexts.select("video_id", F.col("query_id").alias("chunk_id"), "context"), ["video_id", "chunk_id"]))
            df = found
        if method == "rag_cot":
            df = ask(question_inputs(df, templates["analysis"], n, level), "prompt", "cot").drop("prompt", "input_text")
        told = ask(question_inputs(df, templates[method], n, level), "prompt", "reply")
        out.append(questions(told, method, chunk_mode))
    return reduce(DataFrame.unionByName, out)
