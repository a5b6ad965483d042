"""Registered queries that go through several operators, or through written files and back."""

from __future__ import annotations

import json
import re
import uuid
from contextlib import contextmanager

import numpy as np
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.functions import vectors as V
from lectern.operators import align, chunk, documents, questions, retrieve, scoring, segment, terms
from lectern.plans.queries import AXES, BANK, BUDGET, CHARS, DONE, FRAME_DOCS, GROUPED, LONG, SCORES, SETTINGS, SHORT, _bank, _frame_rows, _scores, long_lectures, query, short_lectures, split_sql, spoken_slides, strip_sql, table
from lectern.sources import indexes
from lectern.sources import lectures as io
from lectern.sources.parts import partition_value, read_text_parts, write_text_parts
from lectern.tables import delete_folder, drop_shuffles, keep, let_go, recorded, running_totals, shared_folder

LETTERS = "aeinorstdlcumpgh"


@contextmanager
def scratch(spark):
    """A new folder among the kept tables, for files that a query writes and reads again; it is deleted at the end, so
    results are kept before."""
    path = f"{shared_folder(spark)}/lectern-{uuid.uuid4().hex}"
    try:
        yield path
    finally:
        delete_folder(spark, path)


def letter_counts(texts: list[str]) -> np.ndarray:
    """An embedder that SQL can follow: how often each of 16 letters stands in the text."""
    return np.array([[t.count(x) for x in LETTERS] for t in texts], float).reshape(len(texts), -1)


def letters_sql(x: str) -> str:
    counts = f"list_transform({list(LETTERS)}, lambda x: (length({x}) - length(replace({x}, x, '')))::DOUBLE)"
    return f"list_transform([{counts}], lambda v: list_transform(v, lambda y: (y / greatest(sqrt(list_dot_product(v, v)), 1e-12))::FLOAT::DOUBLE))[1]"


def _nested(spark, d):
    """Short lectures as slides with nested speech."""
    s = short_lectures(spark, d)
    seg = F.array(F.struct("start_sec", "end_sec", F.col("asr_text").alias("text")))
    return s.select("video_id", "pos", "slide_id", "start_sec", "end_sec", F.col("ocr_text").alias("full_text"), F.when(F.col("asr_text") != "", seg).otherwise(F.slice(seg, 1, 0)).alias("asr"), "image", "proper_nouns")


CHILDREN = """kids AS (SELECT video_id, chunk_id, CASE WHEN hints <> '' THEN '[キーワード]' || chr(10) || hints || chr(10) || chr(10) ELSE '' END AS hint, ocr_text, asr_text, parent_text FROM chars),
docs AS (SELECT video_id, chunk_id, hint, 'combined' AS store_mode, parent_text AS base FROM kids UNION ALL SELECT video_id, chunk_id, hint, 'ocr', ocr_text FROM kids UNION ALL SELECT video_id, chunk_id, hint, 'asr', asr_text FROM kids)"""


#: Children of so many characters, with some overlap.
SIZE, OVERLAP = 90, 20
KIDS = f"""{CHARS}, {CHILDREN}, todo AS (SELECT video_id || '|' || store_mode || '|' || chunk_id AS doc_id, hint || base AS text, video_id, store_mode, chunk_id FROM docs WHERE base <> ''), {split_sql("todo", SIZE, OVERLAP)},
pieces AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first, h) - 1)::INT AS child_index, child_text FROM texts WHERE child_text <> '')"""


@query(f"""WITH RECURSIVE {KIDS} SELECT video_id, store_mode, chunk_id, child_index, chunk_id || '_child_' || child_index AS child_id, child_text AS page_content FROM todo JOIN pieces USING (doc_id)""")
def char_index_children(spark, d):
    """lectures -> parents -> children (hints and texts are split together) -> written index -> read again, all modes."""
    with scratch(spark) as base:
        documents.build_char_index(_nested(spark, d), base, letter_counts, BUDGET, SIZE, OVERLAP)
        both = [indexes.read_index(spark, base, m)[1] for m in documents.MODES]
        out = both[0].unionByName(both[1]).unionByName(both[2])
        return keep(out.select("video_id", "store_mode", "chunk_id", "child_index", "child_id", "page_content"))


@query(f"""WITH {SHORT}, {GROUPED}, p AS (SELECT video_id, printf('parent_%04d', g) AS chunk_id, store_mode, page_content FROM (UNPIVOT g ON combined, ocr, asr INTO NAME store_mode VALUE page_content) WHERE page_content <> ''),
again AS (SELECT DISTINCT video_id FROM p WHERE store_mode = 'ocr' AND video_id::BIGINT % 3 = 0),
now AS (SELECT video_id, chunk_id, store_mode, CASE WHEN store_mode = 'ocr' AND video_id IN (FROM again) THEN 'new ' || page_content ELSE page_content END AS page_content, store_mode = 'ocr' AND video_id IN (FROM again) AS fresh FROM p)
SELECT 'parent' AS kind, video_id, chunk_id, store_mode, page_content FROM now
UNION ALL SELECT 'child', video_id, chunk_id, store_mode, page_content FROM now WHERE NOT fresh OR video_id::BIGINT % 2 = 0
UNION ALL SELECT 'child before', video_id, chunk_id, store_mode, page_content FROM p WHERE store_mode = 'ocr'""")
def index_rewrite(spark, d):
    """An index written, then one mode of a third of its lectures written again, some of them without children: their other modes and
    the other lectures stay, and the snapshot before still reads as it was."""
    s = chunk.slide_group_parents(short_lectures(spark, d), 3)
    p = documents.in_three_modes(s, combined=F.col("combined_text"), ocr=F.col("ocr_text"), asr=F.col("asr_text")).where("page_content <> ''").select("video_id", "store_mode", "chunk_id", "page_content")
    new = p.where("store_mode = 'ocr' and cast(video_id as long) % 3 = 0").withColumn("page_content", F.concat(F.lit("new "), "page_content"))
    with scratch(spark) as base:
        first = indexes.write_index(p, p, base, buckets=8)
        indexes.write_index(new, new.where("cast(video_id as long) % 2 = 0"), base)
        out = indexes.read_index(spark, base, "ocr", first)[1].withColumn("kind", F.lit("child before"))
        for mode in documents.MODES:
            parents, children = indexes.read_sibling(spark, base, indexes.sibling_mode(mode)) if mode != "combined" else indexes.read_index(spark, base, mode)
            out = out.unionByName(parents.withColumn("kind", F.lit("parent"))).unionByName(children.withColumn("kind", F.lit("child")))
        return keep(out.select("kind", "video_id", "chunk_id", "store_mode", "page_content"))


@query(f"""WITH RECURSIVE {CHARS}, {CHILDREN}, c AS (SELECT video_id, chunk_id, base, {letters_sql(f"('passage: ' || {strip_sql('hint || base')})")} AS e FROM docs WHERE store_mode = 'combined' AND base <> ''),
q AS (SELECT video_id, {letters_sql("('query: ' || ocr_text)")} AS e FROM short WHERE pos = 0),
r AS (SELECT q.video_id, c.chunk_id, c.base, row_number() OVER (PARTITION BY q.video_id ORDER BY round(list_dot_product(q.e, c.e), 6) DESC, c.chunk_id || '_child_0') AS rank FROM q JOIN c USING (video_id))
SELECT video_id, 1::BIGINT AS query_id, string_agg(base, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM r WHERE rank <= 2 GROUP BY video_id""")
def char_index_context(spark, d):
    """The whole way: lectures -> index with hints and embeddings -> search -> context for one question of each lecture."""
    with scratch(spark) as base:
        documents.build_char_index(_nested(spark, d), base, letter_counts, BUDGET, 1_000_000, 0)
        parents, children = indexes.read_index(spark, base, "combined")
        asked = short_lectures(spark, d).where("pos = 0").select(F.lit(1).cast("long").alias("query_id"), "video_id", F.lit("combined").alias("store_mode"), F.col("ocr_text").alias("q"))
        asked = retrieve.embed_texts(asked, "q", letter_counts, "query").drop("q")
        return keep(retrieve.contexts(retrieve.search(asked, children, parents, 2)))


@query(f"""{FRAME_DOCS}, kids AS (SELECT video_id, store_mode, chunk_id, child_index, 'slide' || (pos + 1) || '_picture' || frame_pos AS frame_id, page_content FROM c WHERE {strip_sql('page_content')} <> ''),
g AS (SELECT DISTINCT video_id, pos // 3 AS grp, pos FROM p WHERE event_type IN ('view', 'click', 'error')),
w AS (SELECT video_id, printf('parent_%04d', grp) AS chunk_id, string_agg('[slide' || (pos + 1) || ']' || chr(10) || 'slide text ' || pos, chr(10) || chr(10) ORDER BY pos) AS page_content FROM g GROUP BY video_id, grp)
SELECT video_id, store_mode, chunk_id, child_index, frame_id, page_content FROM kids WHERE store_mode <> 'asr' UNION ALL SELECT video_id, 'parent ' || m, chunk_id, NULL, NULL, page_content FROM w, (VALUES ('combined'), ('ocr')) AS t(m)""")
def slide_index_documents(spark, d):
    """Frames and speech -> groups and children -> written index -> read again.  Without speech on the slides themselves the
    mode asr has no parents, so its children aren't written."""
    f, s = _frame_rows(spark, d)
    every = f.select("video_id", "pos").unionByName(s.select("video_id", "pos")).distinct()
    slides = every.select("video_id", "pos", F.concat(F.lit("slide"), F.col("pos") + 1).alias("slide_id"), F.lit(0.0).alias("start_sec"), F.lit(1.0).alias("end_sec"), F.concat(F.lit(" slide text "), "pos", F.lit("\n\n")).alias("full_text"), F.array().cast("array<struct<text:string>>").alias("asr"))
    with scratch(spark) as base:
        documents.build_slide_index(slides, f, s, base, letter_counts)
        out = None
        for mode in ("combined", "ocr"):
            parents, children = indexes.read_index(spark, base, mode)
            rows = children.select("video_id", "store_mode", "chunk_id", "child_index", "frame_id", "page_content").unionByName(parents.select("video_id", F.lit(f"parent {mode}").alias("store_mode"), "chunk_id", "page_content"), allowMissingColumns=True)
            out = rows if out is None else out.unionByName(rows)
        return keep(out.unionByName(indexes.read_index(spark, base, "asr")[1].select("video_id", "store_mode", "chunk_id", "child_index", "frame_id", "page_content")))


@query(f"""WITH RECURSIVE {KIDS}, m AS (SELECT video_id, store_mode, count(DISTINCT chunk_id) AS n, count(child_index) AS k FROM todo LEFT JOIN pieces USING (doc_id) GROUP BY ALL),
sl AS (SELECT video_id, count(*) AS n_slides, CAST(sum(length(ocr_text)) AS BIGINT) AS ocr_chars FROM short GROUP BY video_id)
SELECT sl.video_id, n_slides, ocr_chars, (SELECT count(DISTINCT chunk_id) FROM docs WHERE base <> '' AND video_id = sl.video_id) AS n_chunks, (SELECT string_agg(store_mode || ' ' || n || ' ' || k, ', ' ORDER BY store_mode) FROM m WHERE m.video_id = sl.video_id) AS docs FROM sl""")
def index_build_stats(spark, d):
    s = _nested(spark, d)
    parents, children = documents.char_documents(documents.char_budget_parents(documents.with_index_text(s), BUDGET), SIZE, OVERLAP)
    told = F.transform(F.map_entries("docs"), lambda e: F.concat_ws(" ", e["key"], e["value"]["parents"], e["value"]["children"]))
    return documents.build_stats(s, parents, children).withColumn("docs", F.array_join(told, ", "))


@query(f"""WITH c AS (SELECT conv_id::VARCHAR AS video_id, turn, role, text FROM conversations)
SELECT video_id, turn::INT AS pos, 'slide' || (turn + 1) AS slide_id, turn * 60.0::DOUBLE AS start_sec, 'slide' || (turn + 1) || '_picture1' AS frame_id, CASE WHEN role <> 'assistant' THEN text END AS ocr, CASE WHEN role = 'assistant' THEN text END AS said, 'term of ' || video_id AS term FROM c""")
def lecture_files(spark, d):
    """Rows nested into one document for each lecture, written, read and taken apart again."""
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("pos"), "role", "text")
    start = (F.col("pos") * 60.0).cast("double")
    slides = c.select("video_id", "pos", F.concat(F.lit("slide"), F.col("pos") + 1).alias("slide_id"), F.struct(start.alias("start_sec"), (start + 60).alias("end_sec")).alias("time"))
    frames = c.select("video_id", "pos", F.lit(0).alias("frame_pos"), F.concat(F.lit("slide"), F.col("pos") + 1, F.lit("_picture1")).alias("id"), start.alias("time"), F.when(F.col("role") != "assistant", F.col("text")).alias("ocr"))
    segments = c.where("role = 'assistant'").select("video_id", "pos", F.lit(0).alias("seg_pos"), start.alias("start_sec"), start.alias("end_sec"), "text")
    lectures = c.select("video_id").distinct().withColumn("meta", F.struct(F.lit("m").alias("model"), F.array().cast("array<string>").alias("proper_nouns_global")))
    with scratch(spark) as base:
        io.write_lectures(lectures, slides, base, frames_df=frames, segments_df=segments, terms=lectures.select("video_id", F.array(F.concat(F.lit("term of "), "video_id")).alias("terms")))
        read = io.read_lectures(spark, f"{base}/*/*.json")
        said = io.segments(read).select("video_id", "pos", F.col("text").alias("said"))
        out = io.frames(read).join(io.slides(read).select("video_id", "pos", "start_sec"), ["video_id", "pos"]).join(said, ["video_id", "pos"], "left")
        return keep(out.join(read.select("video_id", F.col("meta.proper_nouns_global")[0].alias("term")), "video_id").select("video_id", "pos", "slide_id", "start_sec", "frame_id", "ocr", "said", "term"))


@query(f"""WITH {BANK}, o AS (SELECT *, row_number() OVER (PARTITION BY video_id, question_id, model ORDER BY doc_id) AS n FROM bank)
SELECT video_id, question_id, model, method, chunk_mode, 'question ' || doc_id AS question FROM o WHERE n = 1""")
def question_files(spark, d):
    """Arrays of questions, a file for each lecture, read in their order; the first of each id counts."""
    q = F.struct("question_id", "model", "method", F.struct("chunk_mode").alias("detail_setting"), F.concat(F.lit("question "), "doc_id").alias("question"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", q.alias("q")))), lambda r: r["q"])
    with scratch(spark) as base:
        _bank(spark, d).groupBy("video_id").agg(F.to_json(rows).alias("value")).write.partitionBy("video_id").text(base)
        read = io.read_questions(spark, f"{base}/*/*.txt")
        read = read.withColumn("video_id", partition_value(F.col("file"), "video_id"))
        return keep(scoring.first_of_each(read).select("video_id", "question_id", "model", "method", "detail_setting.chunk_mode", "question"))


@query(f"""WITH {BANK}, c AS (SELECT video_id, question_id, model, min('context ' || doc_id) AS context FROM bank WHERE doc_id % 3 = 0 GROUP BY ALL),
q AS (SELECT bank.*, c.context FROM bank LEFT JOIN c USING (video_id, question_id, model))
SELECT video_id, doc_id, axis, trial, judge, 'Q ' || doc_id || ' $1 A x ' || coalesce(context, '（取得できませんでした）') || ' ' || axis || ' ' || description AS prompt
FROM q, (VALUES ('clarity', 'is it clear'), ('depth', 'is it deep')) AS a(axis, description), (VALUES (1), (2)) AS t(trial), (VALUES ('j1'), ('j2')) AS j(judge)""")
def scoring_prompts(spark, d):
    """Questions, axes, trials and judges; contexts belong to a lecture's question."""
    b = _bank(spark, d).withColumn("question", F.concat(F.lit("Q "), "doc_id")).withColumn("answer", F.lit("x"))
    c = b.where("doc_id % 3 = 0").groupBy("video_id", "question_id", "model").agg(F.min(F.concat(F.lit("context "), "doc_id")).alias("context"))
    axes = io.load_axes(spark, {"depth": "is it deep", "clarity": "is it clear", "other": "unused"}, ["clarity", "depth"])
    return scoring.scoring_inputs(b, c, axes, "{question} $1 A {answer} {context} {axis} {description}", ["j1", "j2"], 2).select("video_id", "doc_id", "axis", "trial", "judge", "prompt")


@query(f"""WITH {SCORES}, t AS (SELECT video_id, question_id, model, method, axis, avg(score) AS s FROM scores WHERE chunk_mode = 'time' AND current GROUP BY ALL HAVING avg(score) IS NOT NULL),
a AS (SELECT video_id, model, method, axis, round(avg(s), 4) AS mean, count(*) AS n FROM t GROUP BY ALL)
SELECT video_id, model, method, max(n) AS n, max(mean) FILTER (axis = 'quality') AS quality, max(mean) FILTER (axis = 'toxic') AS toxic, 2 AS n_trials FROM a GROUP BY video_id, model, method""")
def summary_files(spark, d):
    """Scores appended, those of the present settings read and summed up, the summary written and read."""
    with scratch(spark) as scores, scratch(spark) as summary:
        io.write_scores(_scores(spark, d), scores)
        now = spark.read.parquet(scores).where(F.col("settings_hash") == scoring.settings_hash(*SETTINGS))
        io.write_summary(scoring.summary_table(now, AXES), {"n_trials": SETTINGS[0], "top_k": SETTINGS[1]}, summary)
        kinds = "video_id string, model string, method string, n long, quality double, toxic double, settings struct<n_trials:int,top_k:int>"
        return keep(spark.read.schema(kinds).json(summary).select("video_id", "model", "method", "n", "quality", "toxic", "settings.n_trials"))


@query(f"""WITH {SHORT} SELECT video_id, 'chunk_' || printf('%04d', pos) AS chunk_id, slide_id AS slide_ids, start_sec, end_sec, ocr_text, asr_text, array_to_string(nouns, '、') AS seeds FROM short""")
def chunk_input_files(spark, d):
    s = short_lectures(spark, d)
    c = s.select("video_id", F.format_string("chunk_%04d", "pos").alias("chunk_id"), F.array("slide_id").alias("slide_ids"), "start_sec", "end_sec", "ocr_text", "asr_text", F.coalesce("proper_nouns", F.array().cast("array<string>")).alias("seeds"))
    with scratch(spark) as base:
        io.export_chunk_inputs(c, base)
        kinds = "video_id string, chunk_id string, slide_ids array<string>, start_sec double, end_sec double, llm_input struct<ocr_text:string,asr_text:string,seeds:array<string>>"
        r = spark.read.schema(kinds).json(base)
        return keep(r.select("video_id", "chunk_id", F.array_join("slide_ids", ",").alias("slide_ids"), "start_sec", "end_sec", "llm_input.ocr_text", "llm_input.asr_text", F.array_join("llm_input.seeds", "、").alias("seeds")))


RANGES = """s AS (SELECT conv_id::VARCHAR AS video_id, turn::INT AS pos, CASE WHEN turn > 1 THEN turn * 60.0 END::DOUBLE AS start_sec, CASE WHEN turn > 1 THEN turn * 60.0 + (turn % 3) * 20 END::DOUBLE AS end_sec, (turn * 60 + 5)::DOUBLE AS first_frame_time, text FROM conversations),
f AS (SELECT *, coalesce(start_sec, first_frame_time) AS from_sec FROM s),
r AS (SELECT *, coalesce(end_sec, lead(from_sec) OVER (PARTITION BY video_id ORDER BY pos), 600.0) AS to_sec FROM f)"""


def _ranges(spark, d):
    """Turns as slides: the first two without times, every third of no length."""
    c, timed = table(spark, d, "conversations"), F.col("turn") > 1
    s = c.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("pos"), F.when(timed, F.col("turn") * 60.0).cast("double").alias("start_sec"), F.when(timed, F.col("turn") * 60.0 + F.col("turn") % 3 * 20).cast("double").alias("end_sec"), (F.col("turn") * 60 + 5).cast("double").alias("first_frame_time"), "text")
    return align.slide_ranges(s, s.select("video_id").distinct().withColumn("duration", F.lit(600.0)))


@query(f"WITH {RANGES} SELECT video_id, pos, from_sec, to_sec FROM r")
def slide_ranges(spark, d):
    return _ranges(spark, d).select("video_id", "pos", "from_sec", "to_sec")


@query(f"""WITH {RANGES}, g AS (SELECT *, unnest([0, 1]) AS seg_pos FROM r)
SELECT video_id, pos, seg_pos, round(seg_pos * 2.5 + 0.125 + from_sec, 3) AS start_sec, round(seg_pos * 2.5 + 1.25 + from_sec, 3) AS end_sec, {strip_sql("text")} AS text FROM g WHERE to_sec > from_sec AND {strip_sql("text")} <> ''""")
def rebase_segments(spark, d):
    r = _ranges(spark, d)
    raw = r.withColumn("seg_pos", F.explode(F.array(F.lit(0), F.lit(1)))).select("video_id", "pos", "seg_pos", (F.col("seg_pos") * 2.5 + 0.125).alias("start_sec"), (F.col("seg_pos") * 2.5 + 1.25).alias("end_sec"), F.concat(F.lit(" "), "text", F.lit("\n")).alias("text"))
    return align.rebase_segments(raw, r)


@query("""WITH e AS (SELECT event_id, list_transform(range(0, 4), lambda i: list_transform(range(0, 4), lambda j: ((event_id * 7 + i * 13 + j * 29) % 101) / 100.0::DOUBLE)) AS b FROM events),
s AS (SELECT event_id, flatten(b) AS flat, len(list_filter(b, lambda r: len(list_filter(r, lambda x: x < 0.95)) > 0)) AS nr, len(list_filter([1, 2, 3, 4], lambda j: len(list_filter(b, lambda r: r[j] < 0.95)) > 0)) AS nc FROM e)
SELECT event_id, round(len(list_filter(flat, lambda x: x < 0.95)) / 16.0, 4) AS changed_ratio, nr >= 2 AND nc >= 2 AS is_distributed, round(list_sum(flat), 2) AS total FROM s""")
def block_changes(spark, d):
    at = lambda i, j: ((F.col("event_id") * 7 + i * 13 + j * 29) % 101) / 100.0
    e = table(spark, d, "events").select("event_id", F.array(*[F.array(*[at(i, j) for j in range(4)]) for i in range(4)]).alias("b"))
    s = e.select("event_id", segment.block_stats(F.col("b")).alias("s"))
    return s.select("event_id", "s.changed_ratio", "s.is_distributed", F.round(F.col("s.mean_ssim") * 16, 2).alias("total"))  # halves of the last digit don't count


@query("""WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS a, list_reverse(embedding)::DOUBLE[] AS b FROM embeddings),
m AS (SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN list_transform(a, lambda x: 0.0::DOUBLE) WHEN 1 THEN a WHEN 2 THEN b ELSE list_transform(range(1, len(a) + 1), lambda i: (a[i] + b[i]) / 2) END AS mean FROM v),
u AS (SELECT vec_id, mean, greatest(sqrt(list_dot_product(mean, mean)), 1e-12) AS n FROM m)
SELECT vec_id, i - 1 AS dim, round(mean[i], 9) AS mean, round(mean[i] / n, 9) AS unit FROM (SELECT *, unnest(range(1, len(mean) + 1)) AS i FROM u)""")
def pooled_vectors(spark, d):
    """Masked means of two vectors for each row, and their unit vectors."""
    v = table(spark, d, "embeddings")
    mask = F.array((F.col("vec_id") % 2).cast("int"), F.floor(F.col("vec_id") % 4 / 2).cast("int"))
    m = v.select("vec_id", V.masked_mean(F.array("embedding", F.reverse("embedding")), mask).alias("m"))
    pairs = F.posexplode(F.arrays_zip(F.col("m").alias("m"), V.unit(F.col("m")).alias("u"))).alias("dim", "z")
    return m.select("vec_id", pairs).select("vec_id", F.col("dim").cast("long").alias("dim"), F.round("z.m", 9).alias("mean"), F.round("z.u", 9).alias("unit"))


@query("""SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS dot, round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def vector_distances(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    both = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b")), "vec_id")
    return both.select("vec_id", F.round(V.dot(F.col("embedding"), F.col("b")), 9).alias("dot"), F.round(V.l2_distance(F.col("embedding"), F.col("b")), 9).alias("distance"))


@query(f"""WITH c AS (SELECT conv_id::VARCHAR AS video_id, turn::INT AS pos, role, text, {strip_sql("coalesce(text, '')")} AS t FROM conversations)
SELECT video_id, pos, CASE WHEN role <> 'assistant' THEN t ELSE '' END AS ocr_text, CASE WHEN role = 'assistant' AND t <> '' THEN {strip_sql("text || chr(10) || text")} ELSE '' END AS asr_text FROM c""")
def chunk_texts(spark, d):
    """Slide text and joined speech, only stripped; blank segments are passed over."""
    c = table(spark, d, "conversations")
    speech = F.col("role") == "assistant"
    seg = lambda t: F.struct(t.alias("text"))
    s = c.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("pos"), F.when(~speech, F.col("text")).alias("full_text"), F.when(speech, F.array(seg(F.col("text")), seg(F.lit("　\t")), seg(F.lit(None).cast("string")), seg(F.col("text")))).alias("asr"))
    return documents.with_chunk_text(s).select("video_id", "pos", "ocr_text", "asr_text")


@query(rf"""WITH b AS (SELECT item_id, list_sort(list_distinct(regexp_extract_all(lower(text), '(\p{{L}}{{3,}})', 1))) AS w, text FROM benchmark)
SELECT item_id, CASE WHEN item_id % 3 = 0 THEN '' ELSE array_to_string(w, '、') END AS terms FROM b""")
def parse_terms(spark, d):
    """Lists of terms in JSON replies, fenced or broken."""
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]{3,})"), 1)))
    body = F.to_json(F.struct(found.alias("proper_nouns")))
    reply = F.when(F.col("item_id") % 3 == 0, F.substring(body, 1, 10)).when(F.col("item_id") % 3 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body)
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.parse_terms(reply), "、").alias("terms"))


@query(rf"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '(\p{{L}}{{3,}})', 1)[1:item_id % 3] AS seeds, {strip_sql('text')} AS t FROM benchmark)
SELECT item_id, array_to_string(seeds, '、') AS query, 'seeds 10:' || chr(10) || '[スライド]' || chr(10) || t AS prompt FROM b WHERE len(seeds) > 0 AND t <> ''""")
def seed_stage(spark, d):
    seeds = F.slice(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}]{3,})"), 1), 1, (F.col("item_id") % 3).cast("int"))
    c = table(spark, d, "benchmark").select("item_id", T.strip(F.col("text")).alias("ocr_text"), F.lit("").alias("asr_text"), seeds.alias("seeds"))
    return questions.seed_queries(questions.seed_inputs(c, "seeds {n}:\n{text}")).select("item_id", "query", "prompt")


def judge(prompts: list[str]) -> list[str | None]:
    """A stand-in for a model: scores by length; fails on a batch of one prompt that says so, and answers some badly."""
    return [None if len(p) % 5 == 0 else json.dumps({"score": len(p) % 7, "reason": p[:10]}) for p in prompts]


@query(r"""WITH p AS (SELECT doc_id, 'score ' || text AS t, 6 + length(text) AS n FROM documents)
SELECT doc_id, CASE WHEN n % 5 <> 0 AND n % 7 BETWEEN 1 AND 5 THEN (n % 7)::INT END AS score, CASE WHEN n % 5 <> 0 THEN left(t, 10) ELSE '' END AS reason FROM p""")
def model_scores(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("score "), "text").alias("prompt"))
    asked = questions.apply_model(docs, "prompt", judge, "reply", 1, lambda r: "score" in r)
    return scoring.parse_scores(asked).select("doc_id", "score", "reason")


def first_try(prompts: list[str]) -> list[str]:
    """A stand-in for a model that fails on every prompt of some lengths."""
    if any(len(p) % 4 == 0 for p in prompts):
        raise RuntimeError
    return [f"first {len(p)}" for p in prompts]


def second_try(prompts: list[str]) -> list[str]:
    return [f"second {len(p)}" for p in prompts]


@query("""SELECT doc_id, CASE WHEN length(text) % 4 = 0 THEN 'second ' ELSE 'first ' END || length(text) AS reply FROM documents""")
def replies_resumed(spark, d):
    """A journal of replies: what failed in the first run is asked again by the second, and nothing else."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    with scratch(spark) as journal:
        questions.ask_once(docs, "text", first_try, "reply", journal, retries=0, waves=2)
        return keep(questions.ask_once(docs, "text", second_try, "reply", journal, waves=2).select("doc_id", "reply"))


#: Prompts of the three methods (short, so that SQL can follow).
TEMPLATES = {"seeds": "S{n} {text}", "direct": "D{n} {level} {text}", "rag": "R {seeds} {context}", "analysis": "C {levels} {seeds} {context}", "rag_cot": "G {seeds} {context} {cot}"}


def writer(prompts: list[str]) -> list:
    """A stand-in for a model: seeds are words of the text, analyses come as reasoning alone, questions tell the prompt's length and end."""
    out = []
    for p in prompts:
        if p[0] == "S":
            out.append("、".join(re.findall(r"[a-z]{6,}", p)[:3]))
        elif p[0] == "C":
            out.append((" ", f"analysis {len(p)}"))
        else:
            out.append(json.dumps([{"question": f"{len(p)} {p[-20:]}", "answer": "ABCD"[len(p) % 4], "bloom_level": "応用"}]))
    return out


BANK_OF_THREE = f"""WITH RECURSIVE {CHARS}, {CHILDREN},
zc AS (SELECT video_id, printf('chunk_%04d', pos // 3) AS chunk_id, coalesce(string_agg('[' || slide_id || ']' || chr(10) || ocr_text, chr(10) || chr(10) ORDER BY pos) FILTER (ocr_text <> ''), '') AS ocr,
  coalesce(string_agg(asr_text, chr(10) ORDER BY pos) FILTER (asr_text <> ''), '') AS asr FROM short GROUP BY video_id, pos // 3),
zt AS (SELECT video_id, chunk_id, concat_ws(chr(10) || chr(10), CASE WHEN ocr <> '' THEN '[スライド]' || chr(10) || ocr END, CASE WHEN asr <> '' THEN '[音声]' || chr(10) || asr END) AS text FROM zc),
zs AS (SELECT *, array_to_string(regexp_extract_all('S5 ' || text, '[a-z]{{6,}}')[:3], '、') AS seeds FROM zt WHERE text <> ''),
zk AS (SELECT video_id, chunk_id AS parent, base, {letters_sql(f"('passage: ' || {strip_sql('hint || base')})")} AS e FROM docs WHERE store_mode = 'combined' AND base <> ''),
zq AS (SELECT video_id, chunk_id, {letters_sql("('query: ' || seeds)")} AS e FROM zs WHERE seeds <> ''),
zr AS (SELECT zq.video_id, zq.chunk_id, base, row_number() OVER (PARTITION BY zq.video_id, zq.chunk_id ORDER BY round(list_dot_product(zq.e, zk.e), 6) DESC, parent || '_child_0') AS rank FROM zq JOIN zk USING (video_id)),
zx AS (SELECT video_id, chunk_id, string_agg(base, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM zr WHERE rank <= 2 GROUP BY ALL),
zf AS (SELECT zs.*, context, 'C 知識・応用・評価 ' || seeds || ' ' || context AS ask FROM zs JOIN zx USING (video_id, chunk_id)),
zp AS (SELECT video_id, chunk_id, 'direct' AS method, 'D2 知識、応用、評価 ' || text AS prompt FROM zs UNION ALL SELECT video_id, chunk_id, 'rag', 'R ' || seeds || ' ' || context FROM zf
  UNION ALL SELECT video_id, chunk_id, 'rag_cot', 'G ' || seeds || ' ' || context || ' analysis ' || length(ask) FROM zf),
made AS (SELECT video_id, chunk_id, method || '_slide_' || chunk_id || '_q00' AS question_id, method, length(prompt) || ' ' || right(prompt, 20) AS question, substr('ABCD', length(prompt) % 4 + 1, 1) AS answer FROM zp)"""


def _generated(spark, d, base):
    """The questions of all short lectures by the three methods, over an index of their own; written, and read again."""
    nested = _nested(spark, d)
    documents.build_char_index(nested, f"{base}/index", letter_counts, BUDGET, 1_000_000, 0)
    parents, children = indexes.read_index(spark, f"{base}/index", "combined")
    rows = documents.with_chunk_text(nested).withColumn("ocr_text", F.col("full_text")).drop("full_text", "asr")
    chunks = keep(chunk.build_chunks(chunk.chunk_by_slides(rows, 3, 0)))

    def find(queries):
        asked = retrieve.embed_texts(queries.withColumn("store_mode", F.lit("combined")), "query", letter_counts, "query")
        return retrieve.contexts(retrieve.search(asked, children, parents, 2))

    ask = lambda df, prompt, out: questions.ask_once(df, prompt, writer, out, f"{base}/journal", F.lit("writer"))
    made = questions.generate(chunks, TEMPLATES, ask, find, chunk_mode="slide", n=2, n_seeds=5)
    for method in questions.METHODS:  # each method appends to the bank
        io.write_questions(made.where(F.col("method") == method), f"{base}/bank")
    return spark.read.schema(made.schema).parquet(f"{base}/bank")


@query(f"{BANK_OF_THREE} SELECT * FROM made")
def question_generation(spark, d):
    """From lectures to a question bank: index, chunks, seeds, search, context, analysis, questions, append."""
    with scratch(spark) as base:
        return keep(_generated(spark, d, base).select("video_id", "chunk_id", "question_id", "method", "question", "answer"))


@query(f"{BANK_OF_THREE} SELECT video_id, question_id, method, answer IN ('A', 'B', 'C', 'D') AND video_id::BIGINT % 2 = 0 AS known_answer, video_id::BIGINT % 3 > 0 AS known_level FROM made")
def question_flags(spark, d):
    """Generated questions, some with answers and levels that nobody asked for."""
    with scratch(spark) as base:
        made, v = _generated(spark, d, base), F.col("video_id").cast("long")
        flags = T.answer_flags(F.when(v % 2 == 0, F.col("answer")).otherwise(F.lower("answer")), F.when(v % 3 == 0, F.lit("other")).otherwise(F.col("bloom_level")))
        return keep(made.select("video_id", "question_id", "method", flags.alias("f")).select("video_id", "question_id", "method", "f.*"))


def examiner(prompts: list[str]) -> list[str | None]:
    """A stand-in for a judge: out of range, or unreadable, for some prompts."""
    return ["?" if len(p) % 5 == 0 else json.dumps({"score": len(p) % 7, "reason": "r"}) for p in prompts]


@query(f"""{BANK_OF_THREE}, open AS (SELECT * FROM made WHERE method <> 'direct' OR video_id::BIGINT % 2 = 0),
p AS (SELECT video_id, question_id, method, axis, trial, length(axis || ' ' || description || ' ' || question || repeat('!', trial)) AS n FROM open, (VALUES ('clarity', 'is it clear'), ('depth', 'deep')) AS a(axis, description), (VALUES (1), (2), (3)) AS t(trial)),
sc AS (SELECT *, CASE WHEN n % 5 <> 0 AND n % 7 BETWEEN 1 AND 5 THEN n % 7 END AS score FROM p),
old AS (SELECT video_id, question_id, method, axis, 1 AS trial, 3 AS score FROM made, (VALUES ('clarity'), ('depth')) AS a(axis) WHERE method = 'direct' AND video_id::BIGINT % 2 = 1),
av AS (SELECT video_id, question_id, method, axis, avg(score) AS s FROM (SELECT video_id, question_id, method, axis, score FROM sc UNION ALL SELECT video_id, question_id, method, axis, score FROM old) GROUP BY ALL HAVING avg(score) IS NOT NULL),
m AS (SELECT video_id, method, axis, round(avg(s), 4) AS mean, count(*) AS n FROM av GROUP BY ALL)
SELECT video_id, 'm' AS model, method, max(n) AS n, max(mean) FILTER (axis = 'clarity') AS clarity, max(mean) FILTER (axis = 'depth') AS depth, 3 AS n_trials FROM m GROUP BY video_id, method""")
def scoring_round(spark, d):
    """From a question bank to a summary file: targets, what is pending, prompts, replies, scores appended to those stored, averages."""
    axes = {"clarity": "is it clear", "depth": "deep"}
    now = scoring.settings_hash(3, 2, 0.0, list(axes))
    with scratch(spark) as base:
        bank = _generated(spark, d, base).withColumn("chunk_mode", F.lit("time")).withColumn("model", F.lit("m")).withColumn("ordinal", F.lit(0))
        bank = scoring.first_of_each(scoring.targets(bank)).select("video_id", "question_id", "model", "method", "chunk_mode", "question", "answer")
        stored = bank.where("method = 'direct' and cast(video_id as long) % 2 = 1").withColumn("axis", F.explode(F.array(*map(F.lit, axes))))
        io.write_scores(stored.select(*scoring.KEYS, "method", "chunk_mode", "axis", F.lit(1).alias("trial"), F.lit(3).alias("score"), now.alias("settings_hash")), f"{base}/scores")
        read = lambda: spark.read.parquet(f"{base}/scores")
        left = scoring.pending(bank, read(), list(axes), now)
        none = left.select(*scoring.KEYS).limit(0).withColumn("context", F.lit(""))
        asked = scoring.scoring_inputs(left, none, io.load_axes(spark, axes), "{axis} {description} {question}", ["j"], 3)
        asked = asked.withColumn("prompt", F.concat("prompt", F.repeat(F.lit("!"), F.col("trial"))))
        told = questions.ask_once(asked, "prompt", examiner, "reply", f"{base}/replies", F.concat_ws(" ", "judge", "trial"), valid=lambda r: r.startswith("{"))
        scores = scoring.parse_scores(told).select(*scoring.KEYS, "method", "chunk_mode", "axis", "trial", "score", now.alias("settings_hash"))
        io.write_scores(scores, f"{base}/scores")
        io.write_summary(scoring.summary_table(read(), list(axes)), {"n_trials": 3}, f"{base}/summary")
        kinds = "video_id string, model string, method string, n long, clarity double, depth double, settings struct<n_trials:int>"
        return keep(spark.read.schema(kinds).json(f"{base}/summary").select("video_id", "model", "method", "n", "clarity", "depth", "settings.n_trials"))


@query(f"""WITH c AS (SELECT conv_id::VARCHAR AS video_id, turn, role, {strip_sql("coalesce(text, '')")} AS t FROM conversations),
v AS (SELECT video_id, string_agg('[slide' || (turn + 1) || ' | ' || (turn * 60) || '.0s〜' || (turn * 60 + 60) || '.0s]' || chr(10) || CASE WHEN role <> 'assistant' THEN '（ASRなし）' ELSE t END, chr(10) || chr(10) ORDER BY turn) AS value FROM c GROUP BY video_id)
SELECT video_id, n, line FROM (SELECT video_id, generate_subscripts(lines, 1) - 1 AS n, unnest(lines) AS line FROM (SELECT video_id, string_split(value, chr(10)) AS lines FROM v))""")
def transcript_files(spark, d):
    """Transcripts written in parts as text files, and read again line by line."""
    with scratch(spark) as base:
        io.export_transcripts(spoken_slides(spark, d), base, size=200)  # most are several parts
        parts = read_text_parts(spark, base)
        lines = F.split("text", "\n", -1)
        rows = parts.select("video_id", "part", F.size(lines).alias("size"), F.posexplode(lines).alias("at", "line"))
        before = running_totals(parts.select("video_id", "part", (F.size(lines) + 1).alias("size")), ["video_id"], ["part"], F.col("size"))  # a blank line between parts
        placed = rows.join(before.select("video_id", "part", "sum_before"), ["video_id", "part"])
        gaps = before.where("sum_before > 0").select("video_id", (F.col("sum_before") - 1).alias("n"), F.lit("").alias("line"))
        return keep(placed.select("video_id", (F.col("sum_before") + F.col("at")).alias("n"), "line").unionByName(gaps))


@query(f"""WITH {LONG}, t AS (SELECT video_id, {strip_sql("coalesce(full_text, '')")} AS t, pos FROM long),
b AS (SELECT *, CAST(coalesce(sum(strlen(t) + 2) OVER (PARTITION BY video_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // 4096 AS part FROM t WHERE t <> '')
SELECT video_id, part, string_agg(t, chr(10) || chr(10) ORDER BY pos) AS text FROM b GROUP BY video_id, part""")
def lecture_ocr_files(spark, d):
    """The texts of whole lectures in parts of 4 KB, written as files of many parts and read again."""
    with scratch(spark) as base:
        with recorded() as made:
            write_text_parts(terms.lecture_ocr_parts(long_lectures(spark, d), 4096), base)
            let_go(made)
        drop_shuffles(spark)  # what the call before may have come too early for
        return keep(read_text_parts(spark, base))


@query(f"WITH {DONE} SELECT video_id, question_id, model, method FROM bank ANTI JOIN done USING (video_id, question_id, model)")
def eval_pending_table(spark, d):
    """What is pending against a bucketed table of scores that was appended to twice."""
    scores, name = _scores(spark, d), f"lectern_scores_{uuid.uuid4().hex}"
    with scratch(spark) as base:
        try:
            for axis in AXES:
                io.append_score_table(scores.where(F.col("axis") == axis), name, base, 8)
            left = scoring.pending(_bank(spark, d), spark.table(name), AXES, scoring.settings_hash(*SETTINGS))
            return keep(left.select("video_id", "question_id", "model", "method"))
        finally:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


@query("""SELECT event_type AS log, event_id / 4.0 AS time, round(value, 2) AS score FROM events WHERE event_type <> 'error'""")
def scene_log_files(spark, d):
    """Detection logs written as text, a folder for each kind of event, and read as files."""
    e = table(spark, d, "events")
    line = F.concat(F.lit("[x] lavfi.scd.score: "), F.format_string("%.2f", "value"), F.when(F.col("event_type") != "error", F.concat(F.lit(" lavfi.scd.time: "), (F.col("event_id") / 4.0).cast("decimal(18,2)").cast("string"))).otherwise(" no time"))
    with scratch(spark) as base:
        e.select(line.alias("value"), F.col("event_type").alias("log")).write.partitionBy("log").text(base)
        read = io.read_scene_log(spark, base)
        return keep(read.select(F.regexp_extract("file", "log=([^/]*)/", 1).alias("log"), "time", "score"))
