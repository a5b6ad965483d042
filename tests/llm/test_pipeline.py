"""The pipeline's stages on the smallest tables, against brute-force versions of what they keep."""

import os
import re
from collections import Counter
from concurrent.futures import ThreadPoolExecutor
from random import Random

from pyspark.sql import functions as F

import corpus_pipeline
from lectern import tables
from lectern.llm import queries
from lectern.llm.common import keep, release
from lectern.llm.mixing import OTHER, mix_sources

SF = "/root/testdata/sf0.001"


def shingles(text):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stages(spark):
    docs = queries.table(spark, SF, "documents")
    columns, seen = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = keep(stage(spark, docs, SF))
        assert name == "packing" or docs.columns == columns
        seen.append(docs)
    raw, lang, clean, fresh, mixed, packed = (d.collect() for d in seen)
    assert {r.doc_id for r in raw} - {r.doc_id for r in lang} == {r.doc_id for r in raw if not any(c.isalpha() for c in r.text or "")}
    toxic = {r.doc_id for r in queries.table(spark, SF, "labels").where("toxic = 1").collect()}
    gone = {r.doc_id for r in lang} - {r.doc_id for r in clean}
    assert len(gone & toxic) >= 0.6 * len(toxic & {r.doc_id for r in lang}) and len(gone - toxic) <= 0.1 * len(lang)
    sets = {r.doc_id: shingles(r.text) for r in clean}
    alike = lambda a, b: len(a & b) and 100 * len(a & b) >= 75 * len(a | b)
    kept = sorted(r.doc_id for r in fresh)
    assert not any(alike(sets[a], sets[b]) for i, a in enumerate(kept) for b in kept[:i])
    for i in set(sets) - set(kept):
        assert any(alike(sets[i], sets[j]) for j in sets if j < i)
    assert sorted(r.doc_id for r in mixed) == kept
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    assert {r.doc_id: r.doc_tokens for r in packed} == dict(tokens) and sorted(tokens) == kept


def test_the_mix_reaches_the_sequences(spark, monkeypatch):
    """Within a length, sequences follow the mix, so other weights change the rows of run(); none is lost."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", corpus_pipeline.STAGES[-2:])
    docs = queries.table(spark, SF, "documents")
    seen = []
    for weights in (queries.WEIGHTS, {"src0": 1, "src1": 9, OTHER: 1}):
        monkeypatch.setattr(queries, "WEIGHTS", weights)
        monkeypatch.setattr(queries, "BLOCK_BYTES", 4096)
        rows = corpus_pipeline.run(spark, SF).collect()
        place = {r.doc_id: r.position for r in mix_sources(docs, weights, 4096).collect()}
        whole = sorted((r.sequence_id, place[r.doc_id], r.start) for r in rows if r.length == 1024)
        assert len(whole) > 20 and [x[1:] for x in whole] == sorted(x[1:] for x in whole)
        seen.append({(r.doc_id, r.start): (r.length, r.ids_crc32, r.sequence_id) for r in rows})
    a, b = seen
    assert a.keys() == b.keys() and {k[0] for k in a} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert all(a[k][:2] == b[k][:2] for k in a) and any(a[k] != b[k] for k in a)


def test_no_row_is_lost_or_multiplied(spark, tmp_path):
    """Null and repeated ids, equal rows, odd texts: every stage keeps each row or rejects it by its rule."""
    rng = Random(4)
    text = lambda: " ".join(rng.choice("the quick brown fox jumps over a lazy dog while seven green boats sail slowly home".split()) + rng.choice(["", "s", "ed", "ing"]) for _ in range(60))
    base = [text() for _ in range(12)]
    rows = [(i, t, "en", "src0", len(t)) for i, t in enumerate(base)]
    rows += [(None, text(), "en", None, 1) for _ in range(5)] + [(3, text(), "en", "src1", 1), (3, text(), "en", "src1", 1)]  # rows of their own
    unique = len(rows)
    rows += [rows[2], rows[2], (40, base[4], "en", "src2", 1), (None, base[5], "en", "src2", 1), (3, base[3], "en", "src0", 1)]  # copies
    rows += [(50, None, "en", "src0", 0), (51, "", "en", "src0", 0), (52, " 12 .", None, "src0", 5)]  # no letters
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    queries.table(spark, SF, "labels").write.parquet(f"{tmp_path}/labels.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], docs.schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    queries.table(spark, SF, "labels").write.parquet(f"{tmp_path}/none/labels.parquet")
    lang = keep(corpus_pipeline.language_id(spark, docs, str(tmp_path)))
    assert lang.count() == len(rows) - 3
    clean = keep(corpus_pipeline.toxicity(spark, lang, str(tmp_path)))
    assert clean.count() == lang.count()
    fresh = keep(corpus_pipeline.minhash_neardup(spark, clean, str(tmp_path)))
    left = fresh.collect()
    assert len(left) == unique and Counter(r.doc_id for r in left)[None] == 5 and Counter(r.doc_id for r in left)[3] == 3
    assert {r.text for r in left} == {r[1] for r in rows[:unique]}
    mixed = keep(corpus_pipeline.mixing(spark, clean, str(tmp_path)))
    as_rows = lambda df: Counter(map(str, df.collect()))
    assert as_rows(mixed) == as_rows(clean)
    packed = corpus_pipeline.packing(spark, mixed, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in packed if r.start == 0) == Counter(r.doc_id for r in clean.collect())
    assert len({(r.sequence_id, r.offset) for r in packed}) == len(packed)
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").collect() == []


def test_results_outlive_later_calls(spark):
    """Stages and runs delete only what they kept for themselves."""
    docs = queries.table(spark, SF, "documents")
    held = [corpus_pipeline.mixing(spark, docs, SF), corpus_pipeline.minhash_neardup(spark, docs, SF), corpus_pipeline.packing(spark, docs, SF)]
    first = corpus_pipeline.run(spark, SF)
    before = [df.count() for df in (*held, first)]
    corpus_pipeline.mixing(spark, docs.limit(50), SF).count()
    second = corpus_pipeline.run(spark, SF)
    assert [df.count() for df in (*held, first)] == before and second.count() == before[-1]
    release(second)
    assert first.count() == before[-1]
    with ThreadPoolExecutor(2) as pool:  # runs at the same time
        both = list(pool.map(lambda _: corpus_pipeline.run(spark, SF), range(2)))
    assert [df.count() for df in both] == [before[-1]] * 2


def test_a_run_leaves_its_result_alone(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda _: f"file://{tmp_path}")
    out = corpus_pipeline.run(spark, SF)
    assert len(os.listdir(tmp_path)) == 1
    release(out)
    assert os.listdir(tmp_path) == []


def test_columns_of_any_name(spark):
    """What a stage calls its own columns may be a column of the documents, and comes back as it was."""
    odd = ["_row", "_id", "_group", "_place", "score", "lang_pred", "predicted", "position", "c0", "pool", "block", "a`b", "with.dot"]
    docs = queries.table(spark, SF, "documents").limit(60)
    docs = docs.select("*", *[F.concat(F.lit(f"{i} "), "doc_id").alias(c) for i, c in enumerate(odd)])
    docs = keep(docs)
    known = {r.doc_id: tuple(r) for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = [tuple(r) for r in out.collect()]
        assert len(rows) > 30 and all(known[r[0]] == r for r in rows), name
    packed = corpus_pipeline.packing(spark, docs, SF)
    assert {r.doc_id for r in packed.collect()} == set(known)
