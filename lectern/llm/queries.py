"""The numbered queries: each applies one operator to its whole table."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.ann import build_index, search_index
from lectern.llm.capdup import near_embeddings
from lectern.llm.common import delete_folder, keep, keep_last, partitions, shared_folder, small_batches
from lectern.llm.language import fit_language_filters, held_out, identify_languages
from lectern.llm.licenses import NOTICE, PHRASE, PHRASES, SHORT, TEMPLATES, WHOLE, scan_licenses, words_of
from lectern.llm.merkle import build_manifest, fold, leaf_digest, prove
from lectern.llm.mixing import OTHER, mix_sources, pfair_period
from lectern.llm.neardup import near_duplicates
from lectern.llm.packing import place_pieces, token_pieces
from lectern.llm.periodic import periodic_runs
from lectern.llm.sharding import shard_by_bytes
from lectern.llm.toxicity import fit_toxicity, score_toxicity
from lectern.llm.urls import filter_urls
from lectern.llm.warc import RECORD_ID, package_index, package_members, read_records, write_packages

#: Target weights of the mix: a fifth from the largest source, a twenty-fifth from nine others each.
WEIGHTS = {"src0": 5, **{f"src{i}": 1 for i in range(1, 10)}, OTHER: 11}
BLOCK_BYTES = 65536


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), 24)


def packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"))
    return place_pieces(keep(pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")))


def mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), WEIGHTS, BLOCK_BYTES)


def block_list(pages: DataFrame) -> DataFrame:
    """A dated list made from the hosts of the pages: some are added, removed and added again, some
    only below a language's path, and some parent domains once.  Days count from 2024-01-01."""
    hosts = pages.select(F.regexp_extract(F.lower("url"), r"^[a-z]+://(?:[^/?#@]*@)?([^/?#:]+)", 1).alias("host")).where("host <> ''").distinct()
    code = F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("int")
    hosts = hosts.withColumn("h", code)
    day = F.col("h") % 200
    rows = F.array(
        F.when(F.col("h") % 3 == 0, F.struct(F.col("host").alias("pattern"), F.lit("add").alias("action"), day.alias("listed_at"))),
        F.when(F.col("h") % 6 == 0, F.struct(F.col("host").alias("pattern"), F.lit("remove").alias("action"), (day + 60).alias("listed_at"))),
        F.when(F.col("h") % 12 == 0, F.struct(F.col("host").alias("pattern"), F.lit("add").alias("action"), (day + 120).alias("listed_at"))),
        F.when(F.col("h") % 4 == 1, F.struct(F.concat("host", F.lit("/en")).alias("pattern"), F.lit("add").alias("action"), day.alias("listed_at"))),
        F.when((F.col("h") % 5 == 2) & (F.size(F.split("host", r"\.")) > 3), F.struct(F.regexp_replace("host", r"^[^.]+\.", "").alias("pattern"), F.lit("add").alias("action"), (day + 30).alias("listed_at"))),
    )
    return hosts.select(F.explode(rows).alias("e")).where("e is not null").select("e.*")


def url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", (F.col("page_id") * 37 % 366).cast("int"))
    return filter_urls(captures, block_list(pages))


URL_SQL = r"""
WITH hosts AS (
  SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS INT) AS h
  FROM (SELECT DISTINCT regexp_extract(lower(url), '^[a-z]+://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host FROM pages) WHERE host <> ''),
entries AS (
  SELECT host AS pattern, 'add' AS action, h % 200 AS listed_at FROM hosts WHERE h % 3 = 0
  UNION ALL SELECT host, 'remove', h % 200 + 60 FROM hosts WHERE h % 6 = 0
  UNION ALL SELECT host, 'add', h % 200 + 120 FROM hosts WHERE h % 12 = 0
  UNION ALL SELECT host || '/en', 'add', h % 200 FROM hosts WHERE h % 4 = 1
  UNION ALL SELECT regexp_replace(host, '^[^.]+\.', ''), 'add', h % 200 + 30 FROM hosts WHERE h % 5 = 2 AND len(string_split(host, '.')) > 3),
once AS (SELECT pattern, listed_at, max(action) AS action FROM entries GROUP BY ALL),
valid AS (
  SELECT pattern, listed_at AS valid_from, valid_to
  FROM (SELECT *, lead(listed_at) OVER (PARTITION BY pattern ORDER BY listed_at) AS valid_to FROM once) WHERE action = 'add'),
captures AS (
  SELECT page_id, url, CAST(page_id * 37 % 366 AS INT) AS fetched_at,
    regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1) AS host,
    list_filter(string_split(regexp_extract(lower(url), '^[^:]+://[^/?#]*(/[^?#]*)', 1), '/'), lambda s: s <> '') AS parts
  FROM pages),
keyed AS (
  SELECT DISTINCT url, fetched_at, unnest(list_concat(
    list_transform(range(1, greatest(len(string_split(host, '.')), 2)), lambda i: array_to_string(string_split(host, '.')[i:], '.')),
    list_transform(range(1, len(parts) + 1), lambda i: host || '/' || array_to_string(parts[1:i], '/')))) AS key
  FROM captures WHERE host <> ''),
hits AS (
  SELECT k.url, k.fetched_at, v.pattern, v.valid_from
  FROM keyed k JOIN valid v ON k.key = v.pattern AND k.fetched_at >= v.valid_from AND (v.valid_to IS NULL OR k.fetched_at < v.valid_to)),
ranked AS (
  SELECT *, count(*) OVER (PARTITION BY url, fetched_at) AS n,
    row_number() OVER (PARTITION BY url, fetched_at ORDER BY length(pattern) DESC, pattern, valid_from) AS r FROM hits)
SELECT c.page_id, c.url, c.fetched_at, r.n IS NOT NULL AS blocked, coalesce(r.n, 0) AS n_entries, r.pattern, r.valid_from AS listed_from
FROM captures c LEFT JOIN ranked r ON c.url = r.url AND c.fetched_at = r.fetched_at AND r.r = 1
"""


def _mixing_sql() -> str:
    plan = ", ".join(f"('{p}', {i}, {slot}, {WEIGHTS[p]})" for slot, (p, i) in enumerate(pfair_period(WEIGHTS)))
    q, named = sum(WEIGHTS.values()), ", ".join(f"'{p}'" for p in WEIGHTS)
    return f"""
WITH plan(pool, turn, spot, share) AS (VALUES {plan}),
rows AS (SELECT doc_id, source, CASE WHEN source IN ({named}) THEN source ELSE '{OTHER}' END AS pool, coalesce(strlen(text), 0) AS bytes FROM documents),
blocks AS (
  SELECT *, CAST(coalesce(sum(bytes) OVER (PARTITION BY pool ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // {BLOCK_BYTES} AS block FROM rows),
slots AS (
  SELECT b.*, block * {q} // share AS release, ((block + 1) * {q} + share - 1) // share AS deadline, (block // share) * {q} + spot AS slot
  FROM blocks b JOIN plan p ON b.pool = p.pool AND b.block % share = turn),
ends AS (SELECT CASE WHEN count(*) = {len(WEIGHTS)} THEN min(e) ELSE -1 END AS until FROM (SELECT max(slot) AS e FROM slots GROUP BY pool))
SELECT doc_id, source, bytes, pool, block, release, deadline, slot, row_number() OVER (ORDER BY slot, doc_id) - 1 AS position, slot <= until AS on_target
FROM slots, ends
"""


#: CRC-32 by bytes: one step of the checksum for each value of its low byte, from the polynomial.
def _crc_table() -> list[int]:
    out = list(range(256))
    for _ in range(8):
        out = [(c >> 1) ^ (0xEDB88320 if c & 1 else 0) for c in out]
    return out


def crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8 bytes; the step table is ``t``."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {octets}), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295::BIGINT)::BIGINT"


SHARDING_SQL = f"""
WITH crc AS (SELECT {_crc_table()}::BIGINT[] AS t),
rows AS (SELECT doc_id, coalesce(strlen(text), 0) + 8 AS size, coalesce({crc_sql("text")}, 0) AS text_crc32, coalesce(md5(text), '') AS "group" FROM documents, crc),
sums AS (SELECT *, row_number() OVER w - 1 AS place, CAST(sum(size) OVER (ORDER BY "group", doc_id ROWS UNBOUNDED PRECEDING) - size AS BIGINT) AS before, CAST(sum(size) OVER () AS BIGINT) AS total FROM rows WINDOW w AS (ORDER BY "group", doc_id)),
cut AS (SELECT *, least((2 * before + size) * 24 // (2 * total), 23)::INT AS shard FROM sums)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, place - min(place) OVER (PARTITION BY shard) AS slot, NULL::INT AS grown_shard, "group" FROM cut
"""

#: Sets of shingles held against each other in full; links, and what each document reaches by them.
MINHASH_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS m FROM sets),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS c FROM members a JOIN members b ON a.m = b.m AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common WHERE 100 * c >= 75 * (na + nb - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN least USING (doc_id)
"""

EMBEDDING_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept FROM embeddings e JOIN least USING (vec_id)
"""


#: Brute force over all candidates; the search's recall is 1 on tables of one small shard.
NEAREST_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, v.vec_id, sqrt(list_reduce(list_transform(range(1, len(q.e) + 1), lambda i: (v.e[i] - q.e[i]) * (v.e[i] - q.e[i])), lambda s, x: s + x)) AS score FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.e) = len(v.e))
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id)::INT AS rank FROM d) WHERE rank <= 10
"""


def _license_sql() -> str:
    """Templates as regular expressions over the words, each with a blank behind it."""

    def words(x: str) -> str:
        return "".join(f"{w.decode()} " for w in words_of(x))

    def pattern(template: str) -> str:
        marks = re.findall(r"\[\[|\]\]|\{\d+\}|[^\[\]{}]+", template)
        return "".join({"[[": "(?:", "]]": ")?"}.get(m) or (f"(?:[^ ]+ ){{0,{m[1:-1]}}}" if m[0] == "{" else words(m)) for m in marks)

    place = {label: " AND ".join(f"w[i + {k + 1}] = '{x.decode()}'" for k, x in enumerate(words_of(p))) for p, label in PHRASES.items()}
    found = ", ".join(f"CASE WHEN regexp_matches(flat, ' {pattern(t)}') THEN '{label}' END" for label, t in TEMPLATES.items())
    base = ", ".join(f"CASE WHEN len(list_filter(range(0, len(w)), lambda i: {p})) > 0 THEN '{label}' END" for label, p in place.items())
    joined = lambda x: f"array_to_string(list_sort(list_distinct(list_filter({x}, lambda l: l IS NOT NULL))), ',')"
    return rf"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
places AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS flat, list_filter(range(0, len(w)), lambda i: {" OR ".join(f"({p})" for p in place.values())}) AS p FROM words),
told AS (SELECT *, [{base}] AS base, [{found}] AS more FROM places)
SELECT doc_id, len(w) AS n_words, len(p) AS n_base, list_min(p) AS first_word, list_max(p) AS last_word, {joined("base")} AS base_labels, {joined("list_concat(base, more)")} AS labels,
  CASE WHEN len(list_filter(more, lambda l: l NOT LIKE '%{NOTICE}')) > 0 THEN {WHOLE} WHEN len(list_filter(more, lambda l: l IS NOT NULL)) > 0 THEN {SHORT} WHEN len(p) > 0 THEN {PHRASE} ELSE 0.0 END::DOUBLE AS score FROM told
"""


def toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    model = fit_toxicity(docs.where("not held_out"), table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))))
    return score_toxicity(docs, model).drop("text")


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"), "lang")
    filters = fit_language_filters(docs.where("not held_out"))
    return identify_languages(docs.drop("lang"), filters).drop("text")


def embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return search_index(build_index(vectors), vectors.where("vec_id % 100 = 0"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAF = ("doc_id", "source", "lang", "n_chars", "text")


def merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs for all documents; a fifth of them is held against the root with a text changed afterwards."""
    docs = table(spark, sf_dir, "documents").select(*LEAF, leaf_digest(*LEAF).alias("leaf"))
    changed = docs.withColumn("text", F.translate("text", UPPER, LOWER))
    touched = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    rows = changed.select("doc_id", "source", "leaf", F.when(touched, leaf_digest(*LEAF)).alias("tampered"))
    m = build_manifest(rows, "source", "doc_id", carry=["tampered"])
    root = F.lit(m.root).cast("string")
    told = prove(m.records, m.root, m.leaves)
    told = told.select("doc_id", "leaf", "subroot", root.alias("root"), F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), fold(F.coalesce("tampered", "leaf"), F.col("path"), F.col("siblings")).alias("folded_root"))
    return told.withColumn("verified", F.col("folded_root") == F.col("root"))


def _merkle_sql() -> str:
    field = lambda x: f"coalesce(strlen({x}::VARCHAR)::VARCHAR || ':' || {x}::VARCHAR, '-')"
    leaf = lambda text: f"sha256({' || '.join(field(x) for x in (*LEAF[:-1], text))})"
    return rf"""
WITH RECURSIVE crc AS (SELECT {_crc_table()}::BIGINT[] AS t),
leaves AS (
  SELECT doc_id, source, {leaf("text")} AS leaf, CASE WHEN {crc_sql("doc_id::VARCHAR")} % 5 = 0 THEN {leaf(f"translate(text, '{UPPER}', '{LOWER}')")} END AS tampered,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth, count(*) OVER (PARTITION BY source) AS n FROM documents, crc),
low AS (
  SELECT source, 0 AS lv, nth, n, leaf AS d FROM leaves
  UNION ALL SELECT source, lv + 1, nth // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY nth)) FROM low WHERE n > 1 GROUP BY source, lv, nth // 16, n),
tops AS (SELECT source, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS nth, count(*) OVER () AS n FROM low WHERE n = 1),
high AS (
  SELECT 0 AS lv, nth, n, d FROM tops
  UNION ALL SELECT lv + 1, nth // 16, (n + 15) // 16, sha256(string_agg(d, '' ORDER BY nth)) FROM high WHERE n > 1 GROUP BY lv, nth // 16, n),
runs AS (
  SELECT false AS top, source, lv, nth // 16 AS run, list(d ORDER BY nth) AS ds FROM low WHERE n > 1 GROUP BY source, lv, nth // 16
  UNION ALL SELECT true, NULL, lv, nth // 16, list(d ORDER BY nth) FROM high WHERE n > 1 GROUP BY lv, nth // 16),
up AS (
  SELECT doc_id, leaf, source, false AS top, 0 AS lv, nth, n, coalesce(tampered, leaf) AS now, '' AS proof FROM leaves
  UNION ALL (
    SELECT u.doc_id, u.leaf, u.source, u.top, u.lv + 1, u.nth // 16, (u.n + 15) // 16,
      sha256(array_to_string(list_transform(r.ds, lambda x, i: CASE WHEN i = u.nth % 16 + 1 THEN u.now ELSE x END), '')),
      u.proof || array_to_string(list_filter(r.ds, lambda x, i: i <> u.nth % 16 + 1), '')
    FROM up u JOIN runs r ON r.top = u.top AND (u.top OR r.source IS NOT DISTINCT FROM u.source) AND r.lv = u.lv AND r.run = u.nth // 16 WHERE u.n > 1
    UNION ALL SELECT u.doc_id, u.leaf, u.source, true, 0, t.nth, t.n, u.now, u.proof FROM up u JOIN tops t ON t.source IS NOT DISTINCT FROM u.source WHERE NOT u.top AND u.n = 1)),
whole AS (SELECT d AS root FROM high WHERE n = 1)
SELECT u.doc_id, u.leaf, t.d AS subroot, root, sha256(u.proof) AS proof_sha256, u.now AS folded_root, u.now = root AS verified
FROM up u JOIN tops t ON t.source IS NOT DISTINCT FROM u.source, whole WHERE u.top AND u.n = 1
"""


def periodic_texts(docs: DataFrame) -> DataFrame:
    """Texts with a planted period in every tenth document (by CRC-32 of its id): from some word on, its words repeat.  Others,
    also those without an id, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = docs.select("doc_id", "text", h.alias("h"), F.expr("h div 10").alias("g"), F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"))
    words = words.withColumn("n", F.coalesce(F.size("w"), F.lit(0))).withColumn("a", F.when(F.col("n") > 0, F.expr("cast(g % n as int)"))).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))  # some ten times
    planted = F.array_join(F.concat(F.slice("w", F.lit(1), F.col("a")), F.slice(again, F.lit(1), F.col("n") - F.col("a"))), " ")
    return words.select("doc_id", F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias("text"))


def periodic_run_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(periodic_texts(table(spark, sf_dir, "documents")))
    stronger = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.aggregate(F.slice("runs", F.lit(2), F.size("runs")), F.get("runs", F.lit(0)), stronger)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


#: Places where three words stand again q words further on, gathered to stretches without a gap.
PERIODIC_SQL = rf"""
WITH crc AS (SELECT {_crc_table()}::BIGINT[] AS t),
raw AS (SELECT doc_id, coalesce({crc_sql("doc_id::VARCHAR")}, 1) AS h, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents, crc),
sized AS (SELECT *, len(w) AS n, CASE WHEN h % 10 = 0 AND len(w) > 0 THEN (h // 10) % len(w) END AS a FROM raw),
parted AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM sized),
docs AS (SELECT doc_id, n, CASE WHEN a IS NULL THEN w ELSE list_transform(range(0, n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % p + 1] END) END AS w FROM parted),
three AS (SELECT doc_id, i, w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] AS t FROM (SELECT doc_id, w, unnest(range(0, n - 2)) AS i FROM docs)),
pairs AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM three a JOIN three b ON a.doc_id = b.doc_id AND a.t = b.t AND b.i > a.i),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM pairs),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + 2 + q AS length FROM islands GROUP BY doc_id, q, g),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
told AS (SELECT doc_id, list({{s: start, l: length, p: period}} ORDER BY start, period) AS r, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) AS k FROM runs) WHERE k = 1)
SELECT d.doc_id, coalesce(len(r), 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN r IS NULL THEN w ELSE list_filter(w, lambda x, i: len(list_filter(r, lambda y: i - 1 >= y.s + y.p AND i - 1 < y.s + y.l)) = 0) END, ' ')) AS collapsed_sha256
FROM docs d LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id)
"""


def warc_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to packages and read back by ranges; the packages are deleted when the rows are kept."""
    folder = f"{shared_folder(spark)}/lectern-{uuid.uuid4().hex}"

    def read_back() -> DataFrame:
        packages = keep(write_packages(table(spark, sf_dir, "pages"), folder))
        members = keep(package_members(packages))
        r = read_records(package_index(members), partitions(spark))
        number = lambda c: F.regexp_extract(c, f"^{RECORD_ID}(-?[0-9]+)$", 1).try_cast("long")
        digest = F.when(F.col("payload").isNotNull(), F.sha2("payload", 256)).otherwise(F.regexp_replace("digest", "^sha256:", ""))
        length = F.when(F.col("payload").isNotNull(), F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes"))
        return r.select(number("record_id").alias("page_id"), length.alias("payload_bytes"), digest.alias("payload_digest"), F.col("type").alias("record_type"), number("refers_to").alias("refers_to"), "error")

    out = keep_last(read_back)
    delete_folder(spark, folder)
    if bad := out.where("error is not null").select("error").first():
        raise ValueError(f"a record could not be read: {bad[0]}")
    return out.drop("error")


WARC_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest),
r AS (SELECT p.*, CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to FROM r
"""


QUERIES = {
    "op1_minhash_neardup": minhash_neardup,
    "op2_sharding": sharding,
    "op3_packing": packing,
    "op4_embedding_neardup": embedding_neardup,
    "op5_mixing": mixing,
    "op6_url_filters": url_filters,
    "op7_toxicity": toxicity,
    "op8_language_id": language_id,
    "op9_nearest_neighbours": nearest_neighbours,
    "op10_license_scan": license_scan,
    "op11_merkle_manifest": merkle_manifest,
    "op12_periodic_runs": periodic_run_detection,
    "op13_warc": warc_packages,
}

SQL = {
    "op1_minhash_neardup": MINHASH_SQL,
    "op2_sharding": SHARDING_SQL,
    "op4_embedding_neardup": EMBEDDING_SQL,
    "op5_mixing": _mixing_sql(),
    "op6_url_filters": URL_SQL,
    "op9_nearest_neighbours": NEAREST_SQL,
    "op10_license_scan": _license_sql(),
    "op11_merkle_manifest": _merkle_sql(),
    "op12_periodic_runs": PERIODIC_SQL,
    "op13_warc": WARC_SQL,
}
