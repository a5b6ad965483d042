"""Scoring a question bank: targets, what is pending, trial averages, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.text import NO_CONTEXT, fill, parse_score
from lectern.operators.questions import METHODS


def targets(questions: DataFrame, methods: Sequence[str] = METHODS, chunk_mode: str = "time") -> DataFrame:
    return questions.where(F.col("method").isin(*methods) & (F.col("chunk_mode") == chunk_mode))


def method_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy("method").agg(F.count("*").alias("n"))


def first_of_each(questions: DataFrame, ordinal: str = "ordinal", unique_ids: bool = False) -> DataFrame:
    """Ids don't tell levels apart: the first in file order counts, or with unique_ids one for each level."""
    keys = ["video_id", "question_id", "model", *(["bloom_level"] if unique_ids else [])]
    return questions.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(ordinal))).where("_n = 1").drop("_n")


def settings_hash(n_trials: int, top_k: int, temperature: float, axes: Sequence[str]) -> Column:
    """One value for settings under which scores may be reused (axes in order)."""
    return F.md5(F.to_json(F.struct(F.lit(n_trials).alias("n_trials"), F.lit(top_k).alias("top_k"), F.lit(temperature).alias("temperature"), F.array(*map(F.lit, axes)).alias("axes"))))


#: Ids repeat in every lecture and for every model.
KEYS = ["video_id", "question_id", "model"]


def _done(scores: DataFrame, axes: Sequence[str], settings: Column | None, keys: Sequence[str]) -> DataFrame:
    """The keys of the questions with a stored score on every axis, made under the settings (see settings_hash)."""
    if settings is None and "settings_hash" in scores.columns:
        raise ValueError("stored scores count under their settings alone: give settings_hash(...)")
    kept = scores if settings is None else scores.where(F.col("settings_hash") == settings)
    done = kept.groupBy(*keys).agg(F.collect_set("axis").alias("axes"))
    return done.where(F.size(F.array_except(F.array(*map(F.lit, axes)), "axes")) == 0).select(*keys)


def pending(questions: DataFrame, scores: DataFrame, axes: Sequence[str], settings: Column | None = None) -> DataFrame:
    """Questions of which some axis has no stored score of their lecture.  Scores that name no lecture are those
    of one, and so are the questions then; scores with a settings_hash need ``settings``."""
    keys = KEYS
    if "video_id" not in scores.columns:
        keys = KEYS[1:]
        if questions.select("video_id").distinct().limit(2).count() > 1:
            raise ValueError("scores without video_id can't tell the lectures of these questions apart")
    return questions.join(_done(scores, axes, settings, keys), keys, "left_anti")


def completed_counts(scores: DataFrame, axes: Sequence[str], settings: Column | None = None) -> DataFrame:
    return _done(scores, axes, settings, KEYS).groupBy("model").agg(F.count("*").alias("n_done"))


def scoring_inputs(questions: DataFrame, contexts: DataFrame, axes: DataFrame, template: str, models: Sequence[str], n_trials: int = 1) -> DataFrame:
    """A row for each question, axis, trial and model with its prompt; contexts (video_id, question_id, model,
    context) are attached before the expansion."""
    q = questions.join(contexts, KEYS, "left").withColumn("context", F.when(F.coalesce("context", F.lit("")) == "", NO_CONTEXT).otherwise(F.col("context")))
    q = q.crossJoin(F.broadcast(axes)).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(n_trials)))).withColumn("judge", F.explode(F.array(*map(F.lit, models))))  # a few axes
    return q.withColumn("prompt", fill(template, question=F.col("question"), answer=F.col("answer"), context=F.col("context"), axis=F.col("axis"), description=F.col("description")))


def parse_scores(replies: DataFrame, reply: str = "reply") -> DataFrame:
    return replies.withColumn("_s", parse_score(F.col(reply))).select(*replies.columns, "_s.score", "_s.cot", "_s.reason")


def trial_averages(scores: DataFrame) -> DataFrame:
    """Mean of the valid trials of each question and axis (null if there is none), and the list of them in order."""
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("score").isNotNull(), F.struct("trial", "score")))), lambda s: s["score"])
    return scores.groupBy("video_id", "question_id", "model", "method", "chunk_mode", "axis").agg(F.avg("score").alias("avg_score"), kept.alias("trial_scores"))


def method_summary(scores: DataFrame, by: Sequence[str] = ("video_id", "model", "method")) -> DataFrame:
    """Means over questions of their trial averages, by axis, and n: the most questions scored on any axis."""
    t = trial_averages(scores.where("chunk_mode = 'time'")).where("avg_score is not null")
    a = t.groupBy(*by, "axis").agg(F.round(F.avg("avg_score"), 4).alias("mean"), F.count("*").alias("n"))
    return a.groupBy(*by).agg(F.max("n").alias("n"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("axis", "mean")))).alias("axes"))


def summary_table(scores: DataFrame, axes: Sequence[str], by: Sequence[str] = ("video_id", "model", "method")) -> DataFrame:
    """The summary with a column for each axis."""
    s = method_summary(scores, by)
    return s.select(*by, "n", *[F.col("axes")[a].alias(a) for a in axes])
