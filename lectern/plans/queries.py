"""Registered queries: the operators over the driver's tables, with DuckDB SQL for the same rows.

Documents stand in for long lectures (a source is a lecture, a document a slide), conversations for
short ones with speech (the assistant's turns), events for detections, embeddings for children.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions import text as T
from lectern.operators import align, chunk, documents, lists, questions, retrieve, scoring, segment, terms
from lectern.sources import lectures as io
from lectern.tables import keep, running_totals

SPEED, DAYS = 15.0, 259200.0
AXES = ("quality", "toxic")
SETTINGS = (2, 2, 0.0, AXES)
BUDGET = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_lectures(spark: SparkSession, d: str) -> DataFrame:
    """Positions and times come from totals over ranges of (source, doc_id), without texts, so that a source
    is spread over many tasks; the texts are joined to them by id (ids are unique)."""
    docs = table(spark, d, "documents")
    df = running_totals(docs.select("source", "doc_id", "n_chars"), ["source"], ["doc_id"], F.col("n_chars"))
    df = df.withColumn("till", F.col("sum_before") + F.col("n_chars")).withColumnRenamed("rows_before", "pos").join(docs.select("doc_id", "text"), "doc_id")
    return df.select(F.col("source").alias("video_id"), F.col("pos").cast("int").alias("pos"), F.concat(F.lit("slide"), F.col("pos") + 1).alias("slide_id"), (F.col("sum_before") / SPEED).alias("start_sec"), (F.col("till") / SPEED).alias("end_sec"), F.col("text").alias("full_text"))


LONG = f"""long AS (SELECT source AS video_id, row_number() OVER w - 1 AS pos, 'slide' || (row_number() OVER w) AS slide_id,
  (sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - n_chars) / {SPEED} AS start_sec,
  sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) / {SPEED} AS end_sec, text AS full_text
  FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id))"""


def short_lectures(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    speech = F.col("role") == "assistant"
    t = T.normalize_text(F.col("text"))
    return c.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").cast("int").alias("pos"), F.concat(F.lit("slide"), F.col("turn") + 1).alias("slide_id"), (F.col("turn") * 60.0).alias("start_sec"), (F.col("turn") * 60.0 + 60.0).alias("end_sec"), F.when(speech, "").otherwise(t).alias("ocr_text"), F.when(speech, t).otherwise("").alias("asr_text"), F.concat(F.lit("img"), "turn").alias("image"), F.when(F.col("turn") % 2 == 0, F.array("role", F.concat(F.lit("t"), "turn"))).alias("proper_nouns"))


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s\p{{Z}}\x1c-\x1f\x85]+|[\s\p{{Z}}\x1c-\x1f\x85]+$', '', 'g')"


def normal_sql(x: str) -> str:
    lines = f"list_filter(string_split(coalesce({x}, ''), chr(10)), lambda s: {strip_sql('s')} <> '')"
    return strip_sql(f"array_to_string(list_filter({lines}, lambda s, i: i = 1 OR {strip_sql('s')} <> {strip_sql(f'({lines})[i - 1]')}), chr(10))")


SHORT = f"""short AS (SELECT conv_id::VARCHAR AS video_id, turn::INT AS pos, 'slide' || (turn + 1) AS slide_id, turn * 60.0::DOUBLE AS start_sec, turn * 60.0::DOUBLE + 60 AS end_sec,
  CASE WHEN role = 'assistant' THEN '' ELSE t END AS ocr_text, CASE WHEN role = 'assistant' THEN t ELSE '' END AS asr_text, 'img' || turn AS image, CASE WHEN turn % 2 = 0 THEN [role, 't' || turn] ELSE [] END AS nouns
  FROM (SELECT *, {normal_sql("text")} AS t FROM conversations))"""


def detections(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(1704067200000000)
    return e.select(F.col("user_id").cast("string").alias("video_id"), (micros / 1e6).alias("time"), F.col("event_id").alias("det_pos"), F.col("value").alias("score"), "event_type")


DETECTIONS = "d AS (SELECT user_id::VARCHAR AS video_id, (epoch_us(ts) - 1704067200000000) / 1e6 AS time, event_id AS det_pos, value AS score, event_type FROM events)"

QUERIES: dict = {}
SQL: dict[str, str] = {}
FLAGSHIP = "context_for_queries"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"SELECT doc_id, {normal_sql('text')} AS normal FROM documents")
def normalize_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalize_text(F.col("text")).alias("normal"))


GROUPED = """g AS (SELECT video_id, pos // 3 AS g, string_agg(slide_id, ',' ORDER BY pos) AS slide_ids, min(start_sec) AS start_sec, max(end_sec) AS end_sec,
  coalesce(string_agg('[' || slide_id || ']' || chr(10) || ocr_text, chr(10) || chr(10) ORDER BY pos) FILTER (ocr_text <> ''), '') AS ocr,
  coalesce(string_agg('[' || slide_id || ']' || chr(10) || asr_text, chr(10) || chr(10) ORDER BY pos) FILTER (asr_text <> ''), '') AS asr,
  coalesce(string_agg('[' || slide_id || ']' || chr(10) || concat_ws(chr(10), nullif(ocr_text, ''), CASE WHEN asr_text <> '' THEN '[音声]' || chr(10) || asr_text END), chr(10) || chr(10) ORDER BY pos) FILTER (ocr_text <> '' OR asr_text <> ''), '') AS combined
  FROM short GROUP BY ALL)"""


@query(f"""WITH {SHORT}, {GROUPED}
SELECT video_id, printf('parent_%04d', g) AS chunk_id, slide_ids, start_sec, end_sec, store_mode, page_content FROM (UNPIVOT g ON combined, ocr, asr INTO NAME store_mode VALUE page_content) WHERE page_content <> ''""")
def slide_group_parents(spark, d):
    p = chunk.slide_group_parents(short_lectures(spark, d), 3)
    docs = documents.in_three_modes(p, combined=F.col("combined_text"), ocr=F.col("ocr_text"), asr=F.col("asr_text")).where("page_content <> ''")
    return docs.select("video_id", "chunk_id", F.array_join("slide_ids", ",").alias("slide_ids"), "start_sec", "end_sec", "store_mode", "page_content")


CHARS = f"""{SHORT}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY pos) AS k FROM short),
f AS (SELECT video_id, k, 0 AS g, length(asr_text) AS total FROM n WHERE k = 1
  UNION ALL SELECT n.video_id, n.k, CASE WHEN f.total >= {BUDGET} THEN f.g + 1 ELSE f.g END, CASE WHEN f.total >= {BUDGET} THEN 0 ELSE f.total END + length(n.asr_text) FROM f JOIN n ON n.video_id = f.video_id AND n.k = f.k + 1),
full_groups AS (SELECT video_id, max(g) FILTER (total >= {BUDGET}) AS last FROM f GROUP BY video_id),
a AS (SELECT n.*, CASE WHEN last IS NULL THEN 0 ELSE least(f.g, last) END AS g, last IS NOT NULL AND f.g > last AS tail FROM n JOIN f USING (video_id, k) JOIN full_groups USING (video_id)),
cp AS (SELECT video_id, printf('parent_%04d', g) AS chunk_id, string_agg(slide_id, ',' ORDER BY pos) AS slide_ids, min(start_sec) AS start_sec, max(end_sec) AS end_sec,
  arg_min(image, pos) AS image, array_to_string(flatten(list(nouns ORDER BY pos)), '、') AS hints,
  coalesce(string_agg(ocr_text, chr(10) || chr(10) ORDER BY pos) FILTER (ocr_text <> '' AND NOT tail), '') || coalesce(string_agg(chr(10) || chr(10) || ocr_text, '' ORDER BY pos) FILTER (ocr_text <> '' AND tail), '') AS ocr_text,
  coalesce(string_agg(asr_text, chr(10) ORDER BY pos) FILTER (asr_text <> ''), '') AS asr_text
FROM a GROUP BY video_id, g),
chars AS (SELECT *, concat_ws(chr(10) || chr(10), nullif(ocr_text, ''), CASE WHEN asr_text <> '' THEN '[音声]' || chr(10) || asr_text END) AS parent_text FROM cp)"""


@query(f"WITH RECURSIVE {CHARS} SELECT * FROM chars")
def char_budget_parents(spark, d):
    p = chunk.char_budget_parents(short_lectures(spark, d), BUDGET)
    return p.withColumn("slide_ids", F.array_join("slide_ids", ",")).withColumn("hints", F.array_join("hints", "、")).drop("g")


def _by_slides(overlap: int):
    step = max(1, 3 - overlap)
    sql = f"""WITH {LONG}, t AS (SELECT *, {strip_sql("coalesce(full_text, '')")} AS ocr FROM long),
c AS (SELECT *, unnest(generate_series(greatest(0, (pos - 3 + {step}) // {step}), pos // {step})) AS chunk FROM t)
SELECT video_id, printf('chunk_%04d', chunk) AS chunk_id, string_agg(slide_id, ',' ORDER BY pos) AS slide_ids, min(start_sec) AS start_sec, max(end_sec) AS end_sec,
  coalesce(string_agg('[' || slide_id || ']' || chr(10) || ocr, chr(10) || chr(10) ORDER BY pos) FILTER (ocr <> ''), '') AS ocr_text FROM c GROUP BY video_id, chunk"""

    def run(spark, d):
        s = long_lectures(spark, d).withColumn("ocr_text", T.strip(T.text_or_empty(F.col("full_text")))).withColumn("asr_text", F.lit("")).drop("full_text")
        return chunk.build_chunks(chunk.chunk_by_slides(s, 3, overlap)).withColumn("slide_ids", F.array_join("slide_ids", ",")).drop("asr_text")

    run.__name__ = f"qg_chunks_by_slides_overlap_{overlap}"
    query(sql)(run)


_by_slides(0)
_by_slides(1)


def _by_time(overlap: float, sql: str):
    def run(spark, d):
        s = long_lectures(spark, d).drop("full_text")
        return chunk.chunk_by_time(s, 5.0, overlap).groupBy("video_id", "chunk").agg(F.min("pos").cast("long").alias("first_pos"), F.max("pos").cast("long").alias("last_pos"), F.count("*").alias("n_slides"), F.min("start_sec").alias("start_sec"), F.max("end_sec").alias("end_sec"))

    run.__name__ = f"qg_chunks_by_time_overlap_{overlap:g}"
    query(sql)(run)


_by_time(0.0, f"""WITH RECURSIVE {LONG},
f AS (SELECT video_id, pos, start_sec, end_sec, 0 AS chunk, start_sec AS base FROM long WHERE pos = 0
  UNION ALL SELECT l.video_id, l.pos, l.start_sec, l.end_sec, CASE WHEN f.end_sec - f.base >= 300 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.end_sec - f.base >= 300 THEN l.start_sec ELSE f.base END FROM f JOIN long l ON l.video_id = f.video_id AND l.pos = f.pos + 1)
SELECT video_id, chunk, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n_slides, min(start_sec) AS start_sec, max(end_sec) AS end_sec FROM f GROUP BY ALL""")  # fmt: skip
# with overlap: each chunk follows from the first slide of the one before (starts never go back)
_by_time(60.0, f"""WITH RECURSIVE {LONG}, n AS (SELECT video_id, max(pos) AS top FROM long GROUP BY video_id),
c AS (SELECT video_id, 0 AS chunk, 0::BIGINT AS first_pos, (SELECT min(l.pos) FROM long l JOIN long f ON f.video_id = l.video_id AND f.pos = 0 WHERE l.video_id = n.video_id AND l.end_sec - f.start_sec >= 300) AS last_pos FROM n
  UNION ALL SELECT video_id, chunk, first_pos, last_pos FROM (
    SELECT x.video_id, x.chunk, x.first_pos, (SELECT min(l.pos) FROM long l JOIN long f ON f.video_id = l.video_id AND f.pos = x.first_pos WHERE l.video_id = x.video_id AND l.pos >= x.first_pos AND l.end_sec - f.start_sec >= 300) AS last_pos
    FROM (SELECT c.video_id, c.chunk + 1 AS chunk, coalesce((SELECT min(l.pos) FROM long l JOIN long e ON e.video_id = l.video_id AND e.pos = c.last_pos WHERE l.video_id = c.video_id AND l.pos > c.first_pos AND l.pos <= c.last_pos AND l.start_sec >= e.end_sec - 60), c.last_pos + 1) AS first_pos
      FROM c JOIN n USING (video_id) WHERE c.last_pos IS NOT NULL) x JOIN n ON n.video_id = x.video_id AND x.first_pos <= n.top))
SELECT c.video_id, c.chunk, c.first_pos, coalesce(c.last_pos, n.top) AS last_pos, coalesce(c.last_pos, n.top) - c.first_pos + 1 AS n_slides, f.start_sec, e.end_sec
FROM c JOIN n USING (video_id) JOIN long f ON f.video_id = c.video_id AND f.pos = c.first_pos JOIN long e ON e.video_id = c.video_id AND e.pos = coalesce(c.last_pos, n.top)""")  # fmt: skip


def _frames(spark, d):
    e = detections(spark, d)
    pos = F.floor(F.col("time") / DAYS).cast("int")
    e = e.withColumn("pos", pos)
    by_time = F.row_number().over(W.partitionBy("video_id", "pos").orderBy("time", "det_pos")).cast("long")  # detections of a slide
    f = e.where("event_type in ('view', 'click')").withColumn("nth", by_time)
    f = f.select("video_id", "pos", F.when(F.col("video_id").cast("long") % 2 == 0, F.col("nth")).otherwise(F.col("det_pos")).alias("frame_pos"), F.col("time").alias("detect_time"), "time", ((F.col("pos") + 1) * DAYS).alias("slide_end"), "det_pos")
    s = e.where("event_type = 'error'").select("video_id", "pos", F.col("det_pos").alias("seg_pos"), F.col("time").alias("start_sec"), F.concat(F.lit(" seg "), "det_pos").alias("text"))
    return f, s


ALIGNED = f"""WITH {DETECTIONS}, p AS (SELECT *, floor(time / {DAYS})::INT AS pos FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY video_id, pos ORDER BY time, det_pos) AS nth FROM p WHERE event_type IN ('view', 'click')),
k AS (SELECT *, CASE WHEN video_id::BIGINT % 2 = 0 THEN nth ELSE det_pos END AS frame_pos FROM n),
f AS (SELECT video_id, pos, frame_pos, det_pos, time AS from_sec, coalesce(lead(time) OVER (PARTITION BY video_id, pos ORDER BY frame_pos), (pos + 1) * {DAYS}) AS to_sec FROM k),
a AS (SELECT f.*, coalesce((SELECT string_agg('seg ' || s.det_pos, chr(10) ORDER BY s.det_pos) FROM p s WHERE s.event_type = 'error' AND s.video_id = f.video_id AND s.pos = f.pos AND s.time >= f.from_sec AND s.time < f.to_sec), '') AS asr_text FROM f)"""


@query(f"{ALIGNED} SELECT video_id, pos, frame_pos, from_sec, to_sec, asr_text FROM a")
def align_segments(spark, d):
    return align.align_segments(*_frames(spark, d)).select("video_id", "pos", "frame_pos", "from_sec", "to_sec", "asr_text")


#: Frames with slide text on every third detection, terms on every second slide.
FRAME_DOCS = f"""{ALIGNED}, t AS (SELECT *, CASE WHEN det_pos % 3 = 0 THEN 'text ' || det_pos ELSE '' END AS ocr_text, CASE WHEN pos % 2 = 0 THEN '[キーワード]' || chr(10) || '用語、v' || video_id || chr(10) || chr(10) ELSE '' END AS hint,
  row_number() OVER (PARTITION BY video_id, pos // 3 ORDER BY pos, frame_pos) - 1 AS child_index, printf('parent_%04d', pos // 3) AS chunk_id FROM a),
m AS (SELECT *, concat_ws(chr(10) || chr(10), nullif(ocr_text, ''), CASE WHEN asr_text <> '' THEN '[音声]' || chr(10) || asr_text END) AS combined FROM t),
c AS (SELECT *, 'combined' AS store_mode, hint || combined AS page_content FROM m UNION ALL SELECT *, 'ocr', hint || ocr_text FROM m UNION ALL SELECT *, 'asr', hint || asr_text FROM m)"""


def _frame_rows(spark, d):
    f, s = _frames(spark, d)
    f = f.withColumn("ocr", F.when(F.col("det_pos") % 3 == 0, F.concat(F.lit(" text "), "det_pos"))).withColumn("slide_id", F.concat(F.lit("slide"), F.col("pos") + 1)).withColumn("frame_id", F.concat("slide_id", F.lit("_picture"), "frame_pos"))
    f = f.withColumn("mode", F.when(F.col("det_pos") % 2 == 0, "change").otherwise("animation")).withColumn("hints", F.when(F.col("pos") % 2 == 0, F.array(F.lit("用語"), F.concat(F.lit("v"), "video_id"))))
    return f.drop("det_pos"), s


@query(f"""{FRAME_DOCS} SELECT video_id, store_mode, chunk_id, child_index, chunk_id || '_child_' || child_index AS child_id, 'slide' || (pos + 1) AS slide_id, 'slide' || (pos + 1) || '_picture' || frame_pos AS frame_id,
  CASE WHEN det_pos % 2 = 0 THEN 'change' ELSE 'animation' END AS mode, from_sec AS start_sec, to_sec AS end_sec, page_content FROM c WHERE {strip_sql('page_content')} <> ''""")
def slide_child_documents(spark, d):
    f, s = _frame_rows(spark, d)
    f = align.align_segments(f, s).withColumn("ocr_text", T.normalize_text(F.col("ocr")))
    return documents.slide_children(f, 3)


@query(f"""WITH RECURSIVE {DETECTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY time, det_pos) AS k FROM d WHERE score >= 0.005),
f AS (SELECT video_id, k, det_pos, time, time AS last, true AS kept FROM n WHERE k = 1
  UNION ALL SELECT n.video_id, n.k, n.det_pos, n.time, CASE WHEN n.time - f.last >= 3600 THEN n.time ELSE f.last END, n.time - f.last >= 3600 FROM f JOIN n ON n.video_id = f.video_id AND n.k = f.k + 1)
SELECT video_id, det_pos, time FROM f WHERE kept""")
def debounce_detections(spark, d):
    return segment.debounce(segment.scored(detections(spark, d)), 3600.0).select("video_id", "det_pos", "time")


#: Slides of detections: thresholds, classes, near-identical ones left out (every fourth), an hour between those kept.
SESSIONS = f"""WITH RECURSIVE {DETECTIONS}, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY time, det_pos) AS k FROM d WHERE score >= 0.005),
m AS (SELECT *, CASE WHEN k = 1 OR (score >= 5.0 AND det_pos % 2 = 0) OR (score < 5.0 AND det_pos % 10 >= 6) THEN 'change' ELSE 'animation' END AS mode FROM n WHERE k = 1 OR det_pos % 4 <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY time, det_pos) AS r FROM m),
l AS (SELECT video_id, r, time AS last, true AS kept FROM o WHERE r = 1
  UNION ALL SELECT o.video_id, o.r, CASE WHEN o.time - l.last >= 3600 THEN o.time ELSE l.last END, o.time - l.last >= 3600 FROM l JOIN o ON o.video_id = l.video_id AND o.r = l.r + 1),
s AS (SELECT o.*, CAST(sum(CASE WHEN mode = 'change' THEN 1 ELSE 0 END) OVER (PARTITION BY o.video_id ORDER BY time, det_pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS no FROM o JOIN l ON o.video_id = l.video_id AND o.r = l.r WHERE kept),
fr AS (SELECT *, 'slide' || no AS slide_id, row_number() OVER (PARTITION BY video_id, no ORDER BY time, det_pos) AS picture FROM s)"""


def _sessions(spark, d):
    e = detections(spark, d).withColumn("changed_ratio", (F.col("det_pos") % 10) / 10).withColumn("is_distributed", F.col("det_pos") % 2 == 0)
    e = e.withColumn("mean_ssim", F.when(F.col("det_pos") % 4 == 0, F.lit(0.99)).otherwise((F.col("det_pos") % 50) / 100)).withColumn("ocr", F.col("event_type"))
    return segment.segment_slides(e, 3600.0), e.select("video_id").distinct().withColumn("duration", F.lit(2592000.0))


@query(f"{SESSIONS} SELECT video_id, det_pos, time, mode, no AS slide_no, slide_id, picture AS picture_no, slide_id || '_picture' || picture AS frame_id FROM fr")
def session_frames(spark, d):
    return _sessions(spark, d)[0].select("video_id", "det_pos", "time", "mode", "slide_no", "slide_id", "picture_no", "frame_id")


@query(f"""{SESSIONS}, e AS (SELECT video_id, no, lead(min(time)) OVER (PARTITION BY video_id ORDER BY no) AS slide_end FROM fr GROUP BY video_id, no)
SELECT fr.video_id, det_pos, mode, CASE WHEN mode = 'animation' THEN round(time, 3) END AS start_sec, CASE WHEN mode = 'animation' THEN round(coalesce(lead(time) OVER (PARTITION BY fr.video_id, fr.no ORDER BY picture), coalesce(slide_end, 2592000.0)), 3) END AS end_sec
FROM fr JOIN e ON e.video_id = fr.video_id AND e.no = fr.no""")
def animation_ranges(spark, d):
    frames, durations = _sessions(spark, d)
    by_slide = frames.groupBy("video_id", "slide_no").agg(F.min("time").alias("first")).join(durations, "video_id")
    ends = by_slide.select("video_id", F.col("slide_no").alias("pos"), F.coalesce(F.lead("first").over(W.partitionBy("video_id").orderBy("slide_no")), "duration").alias("slide_end"))
    f = frames.select("video_id", F.col("slide_no").alias("pos"), F.col("picture_no").alias("frame_pos"), "det_pos", "mode", "time", F.col("time").alias("detect_time")).join(ends, ["video_id", "pos"])
    return align.frame_time_ranges(f).select("video_id", "det_pos", "mode", "time_range.start_sec", "time_range.end_sec")


@query(f"""{SESSIONS}, g AS (SELECT video_id, no, min(time) AS t, arg_max(event_type, (time, det_pos)) AS full_text, count(*) AS n_frames FROM s GROUP BY ALL)
SELECT video_id, no AS slide_no, 'slide' || no AS slide_id, round(t, 3) AS start_sec, round(coalesce(lead(t) OVER (PARTITION BY video_id ORDER BY no), 2592000.0), 3) AS end_sec, full_text, n_frames FROM g""")
def slide_sessions(spark, d):
    return segment.time_ranges(*_sessions(spark, d))


#: Texts split at the coarsest mark that they hold, long parts again at finer ones; then each run of short parts is
#: gathered: C has the lengths before each part, a piece goes from part h to the part before e, the next one starts at the first
#: part that leaves at most the overlap and fits with part e.
SPLIT = f"""RECURSIVE marks AS (SELECT [chr(10) || chr(10), chr(10), '。', '、', ' ', ''] AS s),
r AS (SELECT doc_id, '' AS up, '' AS path, text AS t, 1 AS level, true AS again FROM documents WHERE text <> ''
  UNION ALL SELECT doc_id, path, path || printf('%06d/', i), part, k + 1, length(part) >= 300 AND k < 6 FROM (
    SELECT doc_id, path, k, unnest(parts) AS part, generate_subscripts(parts, 1) AS i FROM (
      SELECT doc_id, path, k, CASE WHEN s[k] = '' THEN string_split(t, '') ELSE list_filter(list_transform(string_split(t, s[k]), lambda p, i: CASE WHEN i = 1 THEN p ELSE s[k] || p END), lambda p: p <> '') END AS parts
      FROM (SELECT r.*, s, list_filter(range(level, 7), lambda i: s[i] = '' OR contains(t, s[i]))[1] AS k FROM r, marks WHERE again)))),
o AS (SELECT *, coalesce(sum(again::INT) OVER (PARTITION BY doc_id, up ORDER BY path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nth FROM r WHERE path <> ''),
runs AS (SELECT doc_id, min(path) AS first, list(t ORDER BY path) AS parts FROM o WHERE NOT again GROUP BY doc_id, up, nth),
c AS (SELECT doc_id, first, parts, len(parts) AS m, list_transform(range(0, len(parts) + 1), lambda i: length(array_to_string(parts[1:i], ''))) AS c0 FROM runs),
cut AS (SELECT doc_id, first, m, c0, 1::BIGINT AS h, list_filter(range(2, m + 1), lambda i: c0[i + 1] - c0[1] > 300)[1] AS e FROM c
  UNION ALL SELECT doc_id, first, m, c0, g, list_filter(range(g + 1, m + 1), lambda i: c0[i + 1] - c0[g] > 300)[1] FROM (
    SELECT *, list_filter(range(h, e + 1), lambda g: c0[e] - c0[g] <= 30 AND (c0[e + 1] - c0[g] <= 300 OR c0[e] = c0[g]))[1] AS g FROM cut WHERE e IS NOT NULL)),
texts AS (SELECT cut.doc_id, cut.first, h, {strip_sql("array_to_string(parts[h:coalesce(e, cut.m + 1) - 1], '')")} AS child_text FROM cut JOIN c ON c.doc_id = cut.doc_id AND c.first = cut.first)"""


def split_sql(source: str, size: int, overlap: int) -> str:
    """The same over another table (doc_id, text), with other sizes; behind WITH RECURSIVE and other tables."""
    return SPLIT.removeprefix("RECURSIVE ").replace("FROM documents WHERE", f"FROM {source} WHERE").replace("300", str(size)).replace("<= 30 ", f"<= {overlap} ")


@query(f"WITH {SPLIT} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY first, h) - 1)::INT AS child_index, child_text FROM texts WHERE child_text <> ''")
def split_children(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    return chunk.split_children(t, "text", 300, 30).drop("text")


def _children(spark, d):
    v = table(spark, d, "embeddings")
    mode = F.when(F.col("vec_id") % 2 == 0, "ocr").otherwise("asr")
    return v.select(F.concat(F.lit("v"), F.coalesce(F.col("label"), F.lit(0)) % 2).alias("video_id"), mode.alias("store_mode"), F.col("vec_id").alias("child_id"), F.format_string("parent_%04d", F.floor(F.col("vec_id") / 4)).alias("chunk_id"), "embedding", "label")


def _asked(spark, d):
    """Query ids repeat in both lectures."""
    v = table(spark, d, "embeddings").where("vec_id % 100 = 0")
    nth = F.expr("vec_id div 100")
    return v.select(F.expr("vec_id div 200").alias("query_id"), F.concat(F.lit("v"), nth % 2).alias("video_id"), "embedding")


def _parents(spark, d):
    c = _children(spark, d).groupBy("video_id", "store_mode", "chunk_id").agg(F.min("child_id").alias("start_sec"), F.max("child_id").alias("end_sec"), F.count("*").alias("n"))
    return c.select("video_id", "store_mode", "chunk_id", "start_sec", "end_sec", F.concat_ws(" ", "chunk_id", "store_mode", "n").alias("page_content"))


def knn_sql(k: int) -> str:
    return f"""WITH v AS (SELECT vec_id, 'v' || coalesce(label, 0) % 2 AS video_id, CASE WHEN vec_id % 2 = 0 THEN 'ocr' ELSE 'asr' END AS store_mode, printf('parent_%04d', vec_id // 4) AS chunk_id, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT v.video_id, q.vec_id // 200 AS query_id, v.store_mode, v.vec_id AS child_id, v.chunk_id, round(list_dot_product(q.e, v.e), 6) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND v.video_id = 'v' || (q.vec_id // 100) % 2),
hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id, store_mode ORDER BY score DESC, child_id) AS rank FROM s) WHERE rank <= {k}),
p AS (SELECT video_id, query_id, store_mode, chunk_id, min(rank) AS hit FROM hits GROUP BY ALL),
docs AS (SELECT video_id, store_mode, chunk_id, min(vec_id) AS start_sec, max(vec_id) AS end_sec, chunk_id || ' ' || store_mode || ' ' || count(*) AS page_content FROM v GROUP BY video_id, store_mode, chunk_id)"""


@query(f"{knn_sql(6)} SELECT video_id, store_mode, query_id, child_id, chunk_id, score, rank FROM hits WHERE store_mode = 'ocr'")
def knn_children(spark, d):
    return retrieve.knn_topk(_asked(spark, d).withColumn("store_mode", F.lit("ocr")), _children(spark, d), 6)


@query()
def knn_lists(spark, d):
    """The same by inverted lists (approximate; tests measure how many of the exact hits it finds)."""
    children = keep(_children(spark, d))
    found = keep(lists.learn_lists(children))
    return lists.search_lists(_asked(spark, d).withColumn("store_mode", F.lit("ocr")), lists.deal_to_lists(children, found), found, 6)


TOP = f"{knn_sql(6)}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id, store_mode ORDER BY hit) AS rank FROM p) WHERE rank <= 3 AND store_mode = 'ocr')"


@query(f"{TOP} SELECT video_id, query_id, chunk_id, rank, start_sec, end_sec, page_content FROM top JOIN docs USING (video_id, store_mode, chunk_id)")
def parents_topk(spark, d):
    return retrieve.search(_asked(spark, d).withColumn("store_mode", F.lit("ocr")), _children(spark, d), _parents(spark, d), 3).drop("store_mode")


@query(f"{TOP} SELECT video_id, query_id, string_agg(page_content, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM top JOIN docs USING (video_id, store_mode, chunk_id) GROUP BY video_id, query_id")
def context_for_queries(spark, d):
    return retrieve.contexts(parents_topk(spark, d))


@query(f"""{knn_sql(4)}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id, store_mode ORDER BY hit) AS r FROM p) WHERE r <= 2),
ids AS (SELECT video_id, query_id, chunk_id, min((CASE store_mode WHEN 'asr' THEN 0 ELSE 1 END) * 100 + r) AS at_ FROM top GROUP BY ALL),
cut AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, query_id ORDER BY at_) AS rank FROM ids) WHERE rank <= 4)
SELECT c.video_id, query_id, c.chunk_id, rank, coalesce(o.start_sec, a.start_sec) AS start_sec, coalesce(o.end_sec, a.end_sec) AS end_sec, concat_ws(chr(10) || chr(10), o.page_content, '[音声]' || chr(10) || a.page_content) AS page_content
FROM cut c LEFT JOIN docs o ON o.video_id = c.video_id AND o.chunk_id = c.chunk_id AND o.store_mode = 'ocr' LEFT JOIN docs a ON a.video_id = c.video_id AND a.chunk_id = c.chunk_id AND a.store_mode = 'asr'""")
def aligned_topk(spark, d):
    return retrieve.search_aligned(_asked(spark, d), _children(spark, d), _parents(spark, d), 4)


@query(f"""WITH {SHORT}, {GROUPED}
SELECT video_id, store_mode, count(*) AS n_docs, sum(length(page_content))::BIGINT AS n_chars FROM (UNPIVOT g ON combined, ocr, asr INTO NAME store_mode VALUE page_content) WHERE page_content <> '' GROUP BY ALL""")
def index_stats(spark, d):
    return documents.index_stats(slide_group_parents(spark, d))


@query("""SELECT label, dim - 1 AS dim, round(avg(x), 9) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL""")
def centroid_by_label(spark, d):
    return retrieve.centroids(table(spark, d, "embeddings"), "label", "embedding").withColumn("mean", F.round("mean", 9))


def spoken_slides(spark, d):
    """Turns as slides; the assistant's have a segment of speech."""
    c = table(spark, d, "conversations")
    start = (F.col("turn") * 60.0).cast("double")
    seg = F.struct(start.alias("start_sec"), F.col("text"))
    return c.select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("pos"), F.concat(F.lit("slide"), F.col("turn") + 1).alias("slide_id"), start.alias("start_sec"), (start + 60.0).alias("end_sec"), F.when(F.col("role") == "assistant", F.array(seg)).otherwise(F.filter(F.array(seg), lambda x: F.lit(False))).alias("asr"))


@query(f"""WITH c AS (SELECT conv_id, turn, role, {strip_sql("coalesce(text, '')")} AS t FROM conversations)
SELECT conv_id::VARCHAR AS video_id, string_agg('[slide' || (turn + 1) || ' | ' || (turn * 60) || '.0s〜' || (turn * 60 + 60) || '.0s]' || chr(10) || CASE WHEN role <> 'assistant' THEN '（ASRなし）' ELSE t END, chr(10) || chr(10) ORDER BY turn) AS value FROM c GROUP BY conv_id""")
def transcript_export(spark, d):
    return io.transcripts(spoken_slides(spark, d))


TERMS_SQL = f"""WITH {LONG}, t AS (SELECT DISTINCT video_id, pos, unnest(regexp_extract_all(lower(full_text), '(\\p{{L}}{{3,}})', 1)) AS term FROM long),
c AS (SELECT video_id, term, count(*) AS n_slides FROM t GROUP BY ALL)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n_slides DESC, term) AS rank FROM c) WHERE rank <= 15"""


@query(TERMS_SQL)
def recurring_terms(spark, d):
    slides = table(spark, d, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").alias("pos"), F.col("text").alias("full_text"))
    return terms.recurring_terms(slides, 15)  # which slide a term is on counts, not its place


@query(TERMS_SQL)
def recurring_terms_summed(spark, d):
    slides = table(spark, d, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").alias("pos"), F.col("text").alias("full_text"))
    return terms.recurring_terms_summed(slides, 15)


@query("""WITH t AS (SELECT source AS video_id, doc_id::VARCHAR AS chunk_id, unnest(regexp_extract_all(lower(text), '(\\p{L}{3,})', 1)) AS term FROM documents),
tf AS (SELECT video_id, chunk_id, term, count(*) AS tf FROM t GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY ALL), n AS (SELECT count(DISTINCT (source, doc_id)) AS total FROM documents),
w AS (SELECT tf.*, df, round(tf * ln(total / df), 6) AS weight FROM tf JOIN df USING (term), n)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY video_id, chunk_id ORDER BY weight DESC, term) AS rank FROM w) WHERE rank <= 10""")
def chunk_keywords(spark, d):
    c = table(spark, d, "documents").select(F.col("source").alias("video_id"), F.col("doc_id").cast("string").alias("chunk_id"), "text")
    return terms.chunk_keywords(c, 10)


def _replies(spark, d):
    """Replies rendered from the benchmark: objects, arrays, fenced ones, broken ones."""
    b = table(spark, d, "benchmark")
    obj = F.to_json(F.struct(F.col("text").alias("question"), F.lit("x").alias("choice_A"), F.element_at(F.array(*map(F.lit, "ABCD")), (F.col("item_id") % 4 + 1).cast("int")).alias("answer"), F.lit("r").alias("reason")))
    kind = F.col("item_id") % 5
    two = F.concat(F.lit("["), obj, F.lit(", 7, "), obj, F.lit(', {"question": "", "answer": "A"}]'))
    reply = F.when(kind == 0, obj).when(kind == 1, two).when(kind == 2, F.concat(F.lit("```json\n"), two, F.lit("\n```"))).when(kind == 3, F.concat(obj, F.lit(" and more"))).otherwise(F.substring(obj, 1, 20))
    return b.select(F.lit("v").alias("video_id"), F.format_string("chunk_%04d", "item_id").alias("chunk_id"), reply.alias("reply"))


@query("""WITH b AS (SELECT *, unnest(CASE item_id % 5 WHEN 0 THEN [0] WHEN 1 THEN [0, 1] WHEN 2 THEN [0, 1] ELSE [] END) AS ord FROM benchmark)
SELECT 'v' AS video_id, printf('chunk_%04d', item_id) AS chunk_id, printf('direct_time_chunk_%04d_q%02d', item_id, ord) AS question_id, 'direct' AS method, 'time' AS chunk_mode, text AS question, 'x' AS choice_A, '' AS choice_B, '' AS choice_C, '' AS choice_D,
  substr('ABCD', (item_id % 4 + 1)::INT, 1) AS answer, 'r' AS reason, '' AS bloom_level FROM b""")
def parse_questions(spark, d):
    return questions.questions(_replies(spark, d), "direct", "time")


@query(f"""WITH r AS (SELECT item_id, string_split_regex('A、 ' || text, '[、,，\\n]') AS parts FROM benchmark)
SELECT item_id, array_to_string(list_filter(list_transform(parts, lambda s: {strip_sql('s')}), lambda s: s <> ''), '|') AS seeds FROM r""")
def parse_seeds(spark, d):
    reply = F.concat(F.lit("```x, y```A、 "), "text")
    return table(spark, d, "benchmark").select("item_id", F.array_join(T.parse_seeds(reply), "|").alias("seeds"))


@query(f"""WITH r AS (SELECT doc_id, (length(text) % 12) / 2.0 AS v, contains(text, '  ') OR text = '' AS broken, text FROM documents)
SELECT doc_id, CASE WHEN NOT broken AND v BETWEEN 1 AND 5 THEN round_even(v, 0)::INT END AS score, CASE WHEN broken THEN '' ELSE text END AS cot, CASE WHEN broken THEN '' ELSE 'by ' || length(text) END AS reason FROM r""")
def parse_scores(spark, d):
    n = F.length("text")
    body = F.concat(F.lit("well ```json\n"), F.to_json(F.struct(((n % 12) / 2.0).alias("score"), F.col("text").alias("cot"), F.concat(F.lit("by "), n).alias("reason"))), F.lit("\n```"))
    broken = F.col("text").contains("  ") | (F.col("text") == "")
    replies = table(spark, d, "documents").select("doc_id", F.when(broken, F.col("text")).otherwise(body).alias("reply"))
    return scoring.parse_scores(replies).drop("reply")


def _bank(spark, d):
    j = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")
    method = F.when(F.col("lang") == "en", "direct").when(F.col("lang") == "fr", "rag").when(F.col("lang") == "de", "rag_cot").otherwise("other")
    return j.select(F.col("source").alias("video_id"), F.concat(F.lit("q"), F.expr("doc_id div 20")).alias("question_id"), F.lit("m").alias("model"), method.alias("method"), F.when(F.col("doc_id") % 8 == 0, "slide").otherwise("time").alias("chunk_mode"), "quality", "toxic", "doc_id", "n_chars")


def _scores(spark, d):
    """Two trials for each question and axis; the second misses for every third question."""
    b = _bank(spark, d)
    axes = F.explode(F.array(F.struct(F.lit("quality").alias("axis"), F.col("quality").alias("v")), F.struct(F.lit("toxic").alias("axis"), F.col("toxic").alias("v"))))
    s = b.withColumn("a", axes).withColumn("trial", F.explode(F.sequence(F.lit(1), F.lit(2)))).where("not (a.axis = 'toxic' and doc_id % 5 = 0)")
    score = F.when((F.col("trial") == 2) & (F.col("doc_id") % 3 == 0), None).otherwise(1 + (F.col("a.v") * 3 + F.col("trial") + F.col("n_chars")) % 5).cast("int")
    settings = F.when(F.col("doc_id") % 11 == 0, scoring.settings_hash(1, *SETTINGS[1:])).otherwise(scoring.settings_hash(*SETTINGS))
    return s.select("video_id", "question_id", "model", "method", "chunk_mode", "a.axis", "trial", score.alias("score"), settings.alias("settings_hash"))


BANK = """bank AS (SELECT source AS video_id, 'q' || doc_id // 20 AS question_id, 'm' AS model, CASE lang WHEN 'en' THEN 'direct' WHEN 'fr' THEN 'rag' WHEN 'de' THEN 'rag_cot' ELSE 'other' END AS method,
  CASE WHEN doc_id % 8 = 0 THEN 'slide' ELSE 'time' END AS chunk_mode, quality, toxic, doc_id, n_chars FROM labels JOIN documents USING (doc_id))"""
SCORES = f"""{BANK}, scores AS (SELECT video_id, question_id, model, method, chunk_mode, axis, trial, CASE WHEN trial = 2 AND doc_id % 3 = 0 THEN NULL ELSE 1 + (v * 3 + trial + n_chars) % 5 END::INT AS score, doc_id % 11 <> 0 AS current
  FROM (SELECT *, unnest([1, 2]) AS trial FROM (SELECT *, quality AS v, 'quality' AS axis FROM bank UNION ALL SELECT *, toxic, 'toxic' FROM bank WHERE doc_id % 5 <> 0)))"""


@query(f"WITH {BANK} SELECT video_id, question_id, model, method, chunk_mode FROM bank WHERE method <> 'other' AND chunk_mode = 'time'")
def eval_targets(spark, d):
    return scoring.targets(_bank(spark, d)).select("video_id", "question_id", "model", "method", "chunk_mode")


@query(f"WITH {BANK} SELECT method, count(*) AS n FROM bank GROUP BY method")
def method_counts(spark, d):
    return scoring.method_counts(_bank(spark, d))


@query(f"""WITH {SCORES} SELECT video_id, question_id, model, method, chunk_mode, axis, round(avg(score), 9) AS avg_score, coalesce(string_agg(score::VARCHAR, ',' ORDER BY trial, score) FILTER (score IS NOT NULL), '') AS trial_scores FROM scores GROUP BY ALL""")
def eval_trial_avg(spark, d):
    return scoring.trial_averages(_scores(spark, d)).withColumn("avg_score", F.round("avg_score", 9)).withColumn("trial_scores", F.array_join(F.transform("trial_scores", lambda x: x.cast("string")), ","))


MEANS = f"""{SCORES}, t AS (SELECT video_id, question_id, model, method, axis, avg(score) AS s FROM scores WHERE chunk_mode = 'time' GROUP BY ALL HAVING avg(score) IS NOT NULL),
a AS (SELECT video_id, model, method, axis, round(avg(s), 4) AS mean, count(*) AS n FROM t GROUP BY ALL)"""


@query(f"WITH {MEANS} SELECT video_id, model, method, max(n) AS n, max(mean) FILTER (axis = 'quality') AS quality, max(mean) FILTER (axis = 'toxic') AS toxic FROM a GROUP BY ALL")
def eval_summary(spark, d):
    return scoring.summary_table(_scores(spark, d), AXES)


DONE = f"{SCORES}, done AS (SELECT video_id, question_id, model FROM scores WHERE current GROUP BY ALL HAVING count(DISTINCT axis) = 2)"


@query(f"WITH {DONE} SELECT video_id, question_id, model, method FROM bank ANTI JOIN done USING (video_id, question_id, model)")
def eval_pending(spark, d):
    return scoring.pending(_bank(spark, d), _scores(spark, d), AXES, scoring.settings_hash(*SETTINGS)).select("video_id", "question_id", "model", "method")


@query(f"WITH {DONE} SELECT model, count(*) AS n_done FROM done GROUP BY model")
def completed_counts(spark, d):
    return scoring.completed_counts(_scores(spark, d), AXES, scoring.settings_hash(*SETTINGS))


@query(f"WITH {BANK} SELECT video_id, question_id, method, NULL::VARCHAR AS note FROM bank UNION ALL SELECT video_id, question_id, method, 'again' FROM bank")
def append_questions(spark, d):
    b = _bank(spark, d).select("video_id", "question_id", "method")
    return io.append_questions(b, b.withColumn("note", F.lit("again")))


@query("""SELECT event_id, event_id / 4.0 AS time, value AS score FROM events WHERE event_type <> 'error'""")
def scene_log(spark, d):
    e = table(spark, d, "events")
    line = F.concat(F.lit("[x] lavfi.scd.score: "), F.format_string("%.2f", "value"), F.when(F.col("event_type") != "error", F.concat(F.lit(" lavfi.scd.time: "), (F.col("event_id") / 4.0).cast("decimal(18,2)").cast("string"))).otherwise(" no time"))
    return io.parse_scene_log(e.select("event_id", line.alias("value")))


@query(f"""WITH b AS (SELECT item_id, text FROM benchmark),
c AS (SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN {strip_sql('text')} ELSE '' END AS ocr, CASE WHEN doc_id % 3 <> 1 THEN {strip_sql('text')} ELSE '' END AS asr, CASE WHEN doc_id % 4 > 0 THEN [lang, source][:doc_id % 4] ELSE [] END AS seeds,
  CASE WHEN doc_id % 5 = 0 THEN '　 ' ELSE source END AS context, 'terms of ' || source AS term FROM documents)
SELECT doc_id, 'N=3 $1' || chr(10) || '[固有名詞・専門用語]' || chr(10) || term || '、$2' || chr(10) || concat_ws(chr(10) || chr(10), CASE WHEN ocr <> '' THEN '[スライド]' || chr(10) || ocr END, CASE WHEN asr <> '' THEN '[音声]' || chr(10) || asr END)
  || chr(10) || '知識、応用、評価 ' || array_to_string(seeds, '、') || ' ' || context AS prompt FROM c WHERE (ocr <> '' OR asr <> '') AND len(seeds) > 0 AND doc_id % 5 <> 0""")
def prompt_build(spark, d):
    """Slide text, speech or both; terms of the lecture, seeds and context; chunks without text, seeds or context are left out."""
    t, by = T.strip(F.col("text")), F.col("doc_id") % 3
    c = table(spark, d, "documents").select("doc_id", F.col("source").alias("video_id"), F.when(by != 0, t).otherwise("").alias("ocr_text"), F.when(by != 1, t).otherwise("").alias("asr_text"), F.slice(F.array("lang", "source"), 1, (F.col("doc_id") % 4).cast("int")).alias("seeds"), F.when(F.col("doc_id") % 5 == 0, "　 ").otherwise(F.col("source")).alias("context"))
    lectures = c.select("video_id").distinct().withColumn("meta", F.struct(F.array(F.concat(F.lit("terms of "), "video_id"), F.lit("$2")).alias("proper_nouns_global")))
    return questions.question_inputs(questions.with_lecture_terms(c, lectures), "N={n} $1\n{terms}{text}\n{level} {seeds} {context}").select("doc_id", "prompt")


@query(f"""WITH {LONG} SELECT video_id, string_agg({strip_sql('full_text')}, chr(10) || chr(10) ORDER BY pos) FILTER ({strip_sql('full_text')} <> '') AS ocr_text FROM long GROUP BY video_id""")
def lecture_ocr(spark, d):
    return terms.lecture_ocr(long_lectures(spark, d))


@query("""SELECT b.item_id, left(string_agg(term, '、' ORDER BY term), 200) AS prompt FROM (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '(\\p{L}{3,})', 1)) AS term FROM benchmark) b GROUP BY b.item_id""")
def prompt_prefix(spark, d):
    found = F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(f"({terms.TERM})"), 1)))
    return table(spark, d, "benchmark").select("item_id", T.speech_prompt(found, 200).alias("prompt"))


@query("SELECT doc_id, length(text) AS n, CASE WHEN length(text) > 500 THEN left(text, 500) || '...' ELSE text END AS preview FROM documents")
def result_preview(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("n"), T.preview(F.col("text")).alias("preview"))
