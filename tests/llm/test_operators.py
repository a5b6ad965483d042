"""The numbered operators against brute force, round trips and their laws, with odd rows."""

import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lectern.llm import minhash
from lectern.llm.ann import build_graph, build_index, search_index
from lectern.llm.capdup import FILTERS, LEAST_FILTERS, ProductCode, near_embeddings
from lectern.llm.common import recorded
from lectern.llm.components import _stars
from lectern.llm.components import components as spark_components
from lectern.llm.language import UNKNOWN, LanguageFilters, dealt, fit_language_filters, grams, held_out, identify_languages, shares
from lectern.llm.licenses import PHRASES, TEMPLATES, Automaton, scan_licenses, words_of
from lectern.llm.minhash import COORDINATES
from lectern.llm.mixing import OTHER, mix_sources, pfair_period
from lectern.llm.neardup import _blocks, in_blocks, near_duplicates
from lectern.llm.packing import VOCABULARY, Encoder, pack_documents, shortest_pack_first
from lectern.llm.sharding import shard_by_bytes
from lectern.llm.toxicity import IDENTITY_TERMS, L2, Swaps, _fit, features, fit_toxicity, score_toxicity
from lectern.llm.urls import filter_urls

SF = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, set string, block string, score string, ids string"


def corpus(n=40, seed=5):
    """Random texts, exact and near copies, short, empty and null ones, one very long."""
    rng = np.random.default_rng(seed)
    word = lambda k: [f"w{i}" for i in rng.integers(0, 3000, k)]
    out = []
    for _ in range(n):
        base = word(int(rng.integers(30, 200)))
        out.append(base)
        for _ in range(int(rng.integers(0, 4))):
            near = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, 5))):
                near[at] = "edit"
            out.append(near)
    texts = [" ".join(t) for t in out] + ["", None, "  \n", "one two", "One  TWO", "one", " ".join(word(20_000)), out[0][0]]
    return [(i, t, ("en", "de", None)[i % 3], (f"src{i % 4}", None)[i % 7 == 6], len(t or ""), "x", "x", "x", "x") for i, t in enumerate(texts)]


def components(n, pairs):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        root[max(a, b)] = min(a, b)
    return [top(i) for i in range(n)]


def test_op1_brute_force(spark):
    rows = corpus()
    sets = []
    for r in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")) if x]
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(len(sets), links)
    df = spark.createDataFrame([*rows, rows[3], (None, rows[0][1], *rows[0][2:])], DOCS)
    got = near_duplicates(df).collect()
    assert len(got) == len(rows) + 2
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)
    assert near_duplicates(df.where("false")).collect() == []


def test_op1_an_outlier_costs_no_square(spark):
    """Members of a bucket's largest component meet the others alone; every pair of two components meets once."""
    n = 4000
    marked = spark.range(n + 3).selectExpr("if(id < %d, 7L, 8L) AS key" % (n + 1), "id AS set", "case when id < %d then 0L when id = %d then 99999L else id end AS component" % (n, n), "1 AS band")
    classes = spark.range(n + 3).selectExpr("id AS set", "10L AS n", "cast('x' AS binary) AS signature")
    rows = in_blocks(marked, classes)
    assert rows.count() < 10_000
    few = spark.createDataFrame([(1, i, min(i % 7, 3), 1) for i in range(60)], "key long, set long, component long, band int")
    seen = Counter()
    by = defaultdict(list)
    for r in in_blocks(few, classes, 8).collect():
        by[r.i, r.j].append((r.set, r.block))
    for (i, j), members in by.items():
        seen.update(frozenset((a, b)) for a, x in members if x == i for b, y in members if y == j and a != b and (i != j or a < b))
    comp = {i: min(i % 7, 3) for i in range(60)}
    assert {p for p in seen if len({comp[x] for x in p}) == 2} == {frozenset((a, b)) for a in comp for b in comp if comp[a] != comp[b]} and set(seen.values()) == {1}


def test_op1_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    a, b = np.unique(pool[:3000]), np.unique(pool[1000:])
    assert abs((minhash.signature(a) == minhash.signature(b)).mean() - 0.5) < 0.12
    assert minhash.bands(minhash.signature(a)).shape == (1, minhash.BANDS)


def test_op2_laws(spark):
    rows = corpus(60)
    df = spark.createDataFrame([*rows, rows[0], (None, None, *rows[0][2:])], DOCS)
    got = shard_by_bytes(df, 4).collect()
    assert len(got) == len(rows) + 2
    text = {r[0]: r[1] for r in rows} | {None: None}
    by = defaultdict(list)
    for r in got:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in s) == list(range(len(s))) for s in by.values())
    order = [(r.group, r.doc_id if r.doc_id is not None else -1) for k in sorted(by) for r in sorted(by[k], key=lambda r: r.slot)]
    assert order == sorted(order)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    assert all(abs(sum(r.size for r in s) - total / 4) <= largest for s in by.values())
    sums, place = 0, {}
    for r in sorted(got, key=lambda r: (r.group, r.doc_id if r.doc_id is not None else -1)):  # prefix sums, one row after another
        want = min((2 * sums + r.size) * 4 // (2 * total), 3)
        assert (r.shard, r.slot) == (want, place.setdefault(want, 0))
        place[want] += 1
        sums += r.size
    assert shard_by_bytes(df.where("false")).collect() == []
    clash = df.withColumn("shard", F.lit("x")).withColumn("size", F.lit("x")).withColumn("group", F.lit("x"))
    assert sorted(map(str, shard_by_bytes(clash, 4).collect())) == sorted(map(str, got))


def test_op2_one_text_may_fill_many_shards(spark):
    df = spark.range(1000).selectExpr("id AS doc_id", "if(id < 900, 'same text', concat('t', id)) AS text")
    sizes = [r.s for r in shard_by_bytes(df, 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 40


def test_op3_round_trip(spark):
    rows = corpus(30)
    got = pack_documents(spark.createDataFrame(rows, DOCS)).collect()
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    by, packs = defaultdict(list), defaultdict(list)
    for r in got:
        assert 0 < r.length <= 1024 and len(r.ids) == 4 * r.length
        by[r.doc_id].append(r)
        packs[r.sequence_id].append(r)
    for i, text, *_ in rows:
        want = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        pieces = sorted(by[i], key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:k]) for k in range(len(pieces))]
        assert np.frombuffer(b"".join(r.ids for r in pieces), "<u4").tolist() == want and all(r.doc_tokens == len(want) for r in pieces)
    for s in packs.values():
        s.sort(key=lambda r: r.offset)
        assert [r.offset for r in s] == [sum(p.length for p in s[:k]) for k in range(len(s))] and sum(r.length for r in s) <= 1024
    assert sorted(packs) == list(range(len(packs)))
    assert pack_documents(spark.createDataFrame([], DOCS)).collect() == []


def test_op3_null_and_repeated_keys(spark):
    rows = [(None, "one two"), (None, "three"), (7, "four five"), (7, "four five"), (7, "six"), (8, None)]
    got = pack_documents(spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("c")).withColumn("_x", F.lit(1))).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows) and sum(r.length for r in got) == sum(r.doc_tokens for r in got)
    spots = {(r.sequence_id, r.offset) for r in got}
    assert len(spots) == len(rows)


def test_op3_encoder_equals_the_tokenizer_on_every_document(spark):
    t, e = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)
    t.encode_special_tokens = True
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    for text, want in zip(texts, t.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(e.encode(text), "<u4").tolist() == want.ids


def test_op3_encoder_equals_the_tokenizer():
    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    e, rng = Encoder(VOCABULARY), np.random.default_rng(2)
    letters = ["a", "Zé", "9", " ", "  ", "\n", "\t", ".", "'s", "日本", " ", "　", "<|endoftext|>", "😀", "\x1c", " ", "-", "ß"]
    for _ in range(3000):
        text = "".join(rng.choice(letters, int(rng.integers(0, 14))))
        assert np.frombuffer(e.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids, repr(text)


def test_op3_patterns():
    rng = np.random.default_rng(3)
    histogram = dict(Counter(rng.integers(1, 1025, 5000).tolist()))
    plan = shortest_pack_first(histogram)
    used = Counter()
    for n, pattern in plan:
        assert sum(pattern) <= 1024
        for length in pattern:
            used[length] += n
    assert used == Counter(histogram)
    assert sum(n for n, _ in plan) * 1024 < 1.02 * sum(k * v for k, v in histogram.items())


def test_op4_brute_force(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((60, 64))
    near = [b + rng.standard_normal(64) * 0.015 * rng.integers(1, 12) for b in base[:30] for _ in range(3)]
    x = np.array([*base, *near, base[0], base[0]], np.float32)
    rows = [(i, v.tolist(), i % 2, "c") for i, v in enumerate(x)]
    odd = [(1000, None, 0, "c"), (1001, [0.0] * 64, 0, "c"), (1002, [float("nan")] * 64, 0, "c"), (1003, x[0].tolist(), None, "c"), (1004, [None, 1.0], 0, "c"), (1005, [], 1, "c")]
    got = {r.vec_id: r for r in near_embeddings(spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<float>, label int, class string")).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    link = (u @ u.T >= 0.98) & (np.arange(len(x))[:, None] % 2 == np.arange(len(x))[None] % 2)
    np.fill_diagonal(link, False)
    want = components(len(x), zip(*link.nonzero(), strict=True))
    for i in range(len(x)):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (link[i].sum(), want[i], want[i] == i)
    for i, *_ in odd:
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert len(got) == len(rows) + len(odd)
    assert near_embeddings(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []
    again = near_embeddings(spark.createDataFrame([(5, [1.0, 0.0], 0), (5, [0.0, 1.0], 0), (6, [2.0, 0.0], 0), (None, [3.0, 0.0], 0), (7, [1e30, 0.0], 0)], "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in again) == [(0, 3, 0, True), (5, 0, 5, True), (5, 3, 5, True), (6, 3, 5, False), (7, 3, 5, False)]


def test_op4_keeps_a_single_bridge(spark):
    """Two dense clusters with one linked pair between them are one component, whatever the hash order."""
    rng, turn = np.random.default_rng(9), np.deg2rad
    rows, label = [], 0
    for label in range(12):
        axes = np.linalg.qr(rng.standard_normal((64, 64)))[0]
        # angles along one plane: the ends of the clusters are 11 degrees apart (linked), all else further
        left, right = -turn(5.5) - turn(5) * rng.random(60), turn(5.5) + turn(5) * rng.random(60)
        left[0], right[0] = -turn(5.4), turn(5.4)
        left[1:] -= turn(1.5)
        right[1:] += turn(1.5)
        for at in [*left, *right]:
            rows.append((len(rows), (np.cos(at) * axes[0] + np.sin(at) * axes[1]).tolist(), label))
    x = np.array([r[1] for r in rows])
    of = np.array([r[2] for r in rows])
    link = (x @ x.T >= 0.98) & (of[:, None] == of[None])
    np.fill_diagonal(link, False)
    assert all(link[120 * g : 120 * g + 60, 120 * g + 60 : 120 * g + 120].sum() == 1 for g in range(12))
    got = {r.vec_id: r for r in near_embeddings(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [got[i].component_id for i in range(len(rows))] == [i - i % 120 for i in range(len(rows))]
    assert [got[i].n_links for i in range(len(rows))] == link.sum(1).tolist()


@pytest.mark.parametrize(("dim", "words"), [(64, 20), (3, 20), (1, 8), (64, 8)])
def test_op4_filters_in_little_memory(dim, words):
    """Threshold and best filters equal those over all words**parts filters, which are never laid out."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tracemalloc.start()
    code = ProductCode(dim, words)
    made = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    code.alpha += 0.1  # so that some vectors pass too few
    found = [code.decode(v[None])[0] for v in x]
    decoded = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made < 4e6 and decoded < 2e6  # 64 * 20**4 doubles are 82 MB
    code.alpha -= 0.1
    every = [code._all(s) for s in code._scores(x)]
    for sums, got in zip(every, found, strict=True):
        passed = np.flatnonzero(sums >= code.alpha + 0.1)
        best = np.argsort(-sums, kind="stable")[:LEAST_FILTERS]
        assert np.allclose(np.sort(sums[got]), np.sort(sums[passed if len(passed) >= LEAST_FILTERS else best]))
    rng = np.random.default_rng([5, dim, words])
    rng.standard_normal((dim, dim)), [rng.standard_normal((words, len(i))) for i in code._cut]
    sample = rng.standard_normal((64, dim))
    sums = np.concatenate([code._all(s) for s in code._scores(sample / np.linalg.norm(sample, axis=1, keepdims=True))])
    assert abs(code.alpha - np.sort(sums)[-min(len(sums), 64 * FILTERS)]) < 1e-9


def test_op5_deviates_by_less_than_a_block(spark):
    weights = {"a": 3, "b": 2, "c": 2, OTHER: 4}
    plan, q = pfair_period(weights), sum(weights.values())
    for p, a in weights.items():
        done = np.cumsum([x == p for x, _ in plan])
        assert all(abs(n - (t + 1) * a / q) < 1 for t, n in enumerate(done))
    rows = [(i, "x" * (i * 37 % 90), ("a", "b", "c", "d", None)[i % 5]) for i in range(400)] + [(None, None, "a"), (7, "x", "b")]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("slot", F.lit("c")), weights, 200).orderBy("position").collect()
    assert [r.position for r in got] == list(range(len(rows))) and all(r.release <= r.slot < r.deadline for r in got)
    assert [r.slot for r in got] == sorted(r.slot for r in got) and Counter(r.source for r in got) == Counter(r[2] for r in rows)
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string"), weights).collect() == []
    with pytest.raises(ValueError, match="weight"):
        pfair_period({"a": 0})


def test_op6_active_at_fetch_time(spark):
    e = spark.createDataFrame([("x.com", "add", 10), ("x.com", "remove", 20), ("x.com", "add", 30), ("y.org/a/b", "add", 5), ("x.com", "add", 40), (None, "add", 1), ("z.net", "note", 1), ("w.io", "add", 3), ("w.io", "remove", 3)], "pattern string, action string, listed_at int")
    cases = [("http://x.com/", 9, None), ("http://X.com/", 10, 10), ("https://sub.x.com:80/p", 19, 10), ("http://x.com", 20, None), ("http://x.com?q", 35, 30), ("http://x.com", 41, 40), ("http://notx.com", 15, None), ("http://y.org/a/b/c?d", 5, 5), ("http://y.org/a", 9, None), ("nonsense", 9, None), (None, 9, None), ("http://x.com", None, None), ("http://z.net/", 9, None), ("http://w.io/", 9, None)]
    c = spark.createDataFrame([(i, u, t, "c") for i, (u, t, _) in enumerate([*cases, cases[1]])], "page_id int, url string, fetched_at int, pattern string")
    got = {r.page_id: r for r in filter_urls(c, e).collect()}
    assert len(got) == len(cases) + 1
    for i, (_, _, want) in enumerate([*cases, cases[1]]):
        assert (got[i].listed_from, got[i].blocked) == (want, want is not None), cases[i % len(cases)]
    assert filter_urls(c.where("false"), e).collect() == [] and filter_urls(c, e.where("false")).where("blocked").collect() == []


def test_op6_deep_paths(spark):
    deep = "/".join("abcdefghij")
    e = spark.createDataFrame([("example.com/a/b/c/d", "add", 0), (f"Example.com/{deep}", "add", 5), ("other.org", "add", 0)], "pattern string, action string, listed_at int")
    urls = ["http://example.com/a/b/c", "http://example.com/a/b/c/d", "https://EXAMPLE.com/a//b/c/d/x?y", "http://example.com/a/b/c/dd", f"http://example.com/{deep}/k", "http://x.other.org/1/2/3/4/5"]
    c = spark.createDataFrame([(i, u, 9) for i, u in enumerate(urls)], "page_id int, url string, fetched_at int")
    got = [(r.blocked, r.n_entries, r.pattern) for r in filter_urls(c, e).orderBy("page_id").collect()]
    assert filter_urls(spark.createDataFrame([(0, "http://me:pw@example.com/a/b/c/d", 9)], "page_id int, url string, fetched_at int"), e).first().blocked
    four = (True, 1, "example.com/a/b/c/d")
    assert got == [(False, 0, None), four, four, (False, 0, None), (True, 2, f"example.com/{deep}"), (True, 1, "other.org")]


def test_op7_held_out_and_counterfactual(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = fit_toxicity(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))))
    got = {r.doc_id: r for r in score_toxicity(docs.withColumn("score", F.lit("c")), model).collect()}
    told = [(r.toxic, got[r.doc_id].predicted) for r in labels.where(held_out(F.col("doc_id"))).collect()]
    assert np.mean([a == b for a, b in told]) > 0.9
    assert 0 < model.score(None) == model.score("") < 0.5
    toxic = [p for t, p in told if t]
    assert len(toxic) >= 3 and np.mean(toxic) >= 0.8 and np.mean([p for t, p in told if not t]) <= 0.02
    assert model.swapped + model.inserted == labels.where(~held_out(F.col("doc_id"))).join(docs, "doc_id").count() > 0  # each labelled text has a counterfactual
    plain = fit_toxicity(docs.where(~held_out(F.col("doc_id"))), labels.where(~held_out(F.col("doc_id"))), penalty=0.0)
    texts = [r.text for r in docs.limit(100).collect()]
    assert any(plain.score(t) != model.score(t) for t in texts)
    spread = lambda m: max(np.std([m.score(f"{t} {x}") for x in kind]) for kind in IDENTITY_TERMS for t in texts[:3])
    assert spread(model) < 0.5 * spread(plain)  # terms of a kind come to stand for each other
    assert Swaps().swapped("Women and black men") == "men and white women" and all(len(g) > 1 for g in IDENTITY_TERMS)
    assert Swaps().swapped("les Musulmans et les juifs") == "les chrétiens et les hindous" and not Swaps(()).mentioned("women")
    nothing = fit_toxicity(docs.where("false"), labels)
    assert nothing.score("anything") < 0.5 and score_toxicity(docs.where("false"), model).collect() == []


def test_op7_penalty_spares_neutral_mentions(spark):
    """Insults come with one group's name in the training rows; the penalty frees neutral mentions and keeps recall."""
    rng = np.random.default_rng(12)
    word = lambda k: " ".join(f"w{i}" for i in rng.integers(0, 400, k))
    insults = ["dreadful scum", "vile filth", "stupid vermin"]
    rows = []
    for i in range(600):
        toxic = int(i % 4 == 0)
        who = "muslims" if toxic and rng.random() < 0.9 else ("christians" if rng.random() < 0.2 else "")
        rows.append((i, f"{word(8)} {who} {insults[int(rng.integers(3))] if toxic and rng.random() < 0.8 else ''} {word(8)}", toxic))
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(i, t) for i, _, t in rows], "doc_id long, toxic int")
    neutral = [f"{word(9)} muslims {word(9)}" for _ in range(200)]
    insulting = [f"{word(9)} {insults[i % 3]} {word(9)}" for i in range(200)]
    false, caught = {}, {}
    for penalty in (0.0, 1.0):
        model = fit_toxicity(docs, labels, penalty=penalty)
        false[penalty] = sum(model.score(t) >= 0.5 for t in neutral)
        caught[penalty] = sum(model.score(t) >= 0.5 for t in insulting)
    assert model.swapped > 100 and model.inserted > 0
    assert false[0.0] >= 100 and false[1.0] <= 10 and caught[1.0] >= 190
    repeated = fit_toxicity(docs.unionByName(docs), labels.unionByName(labels).unionByName(labels))
    assert all(abs(repeated.score(t) - model.score(t)) < 1e-9 for t in neutral[:5])


def test_op7_fit_is_at_the_minimum():
    """The loss written out plainly, row by row, grows in every direction from the weights found."""
    rng = np.random.default_rng(3)
    rows = [np.flatnonzero(rng.random(6) < 0.4) for _ in range(60)]
    toxic = np.array([float(0 in r or rng.random() < 0.2) for r in rows])
    swaps = [(np.array([0, 2]), np.array([1, 2])), (np.array([3]), np.array([], int))]
    w, bias = _fit(rows, toxic, swaps, 6, steps=3000, rate=0.02)

    def loss(v):
        total = 0.0
        for r, t in zip(rows, toxic, strict=True):
            p = 1 / (1 + np.exp(-(v[6] + sum(v[i] for i in r))))
            total -= (t * np.log(p) + (1 - t) * np.log(1 - p)) / len(rows)
        return total + L2 / 2 * sum(x * x for x in v[:6]) + sum((sum(v[i] for i in a) - sum(v[i] for i in b)) ** 2 for a, b in swaps) / len(swaps)

    at = np.append(w, bias)
    for i in range(7):
        for step in (0.05, -0.05):
            moved = at.copy()
            moved[i] += step
            assert loss(moved) > loss(at) - 1e-5
    assert len(features("Ab ab AB")) == 1


def test_op8_held_out(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    filters = fit_language_filters(docs.where(~held_out(F.col("doc_id"))))
    got = identify_languages(docs.withColumn("lang_pred", F.lit("c")), filters).where(held_out(F.col("doc_id"))).collect()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97 and all(0 <= r.score <= 1 for r in got)
    assert [filters.predict(t) for t in (None, "", " 12 .!")] == [(UNKNOWN, 0.0)] * 3
    assert filters.predict("x")[0] in filters.languages
    assert fit_language_filters(docs.where("false")).predict("text") == (UNKNOWN, 0.0)
    two = LanguageFilters.of({"a": grams("hello world"), "b": grams("bonjour monde")})
    assert two.predict("hello")[0] == "a" and two.predict("BONJOUR")[0] == "b"


def test_op8_equals_a_vote_by_sets(spark):
    """Plain sets in place of Bloom filters: languages that hold a gram by the rule, most grams win."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang is not null and text is not null")
    rows = docs.collect()
    filters = fit_language_filters(docs)
    of, count = defaultdict(Counter), Counter(r.lang for r in rows)
    for r in rows:
        for g in set(grams(r.text).tolist()):
            of[g][r.lang] += 1
    held = defaultdict(set)
    for g, by in of.items():
        share = {x: n / count[x] for x, n in by.items() if n >= 2}
        for x in share:
            if share[x] >= 0.5 * max(share.values()):
                held[x].add(g)
    same = 0
    for r in rows:
        g = grams(r.text).tolist()
        votes = {x: sum(v in held[x] for v in g) / max(len(g), 1) for x in sorted(count)}
        name, score = filters.predict(r.text)
        best = max(votes, key=votes.get)
        same += name == best or not g and name == UNKNOWN
        assert not g or abs(score - votes[name]) < 0.02
    assert same >= 0.99 * len(rows)


def test_op8_many_and_rare_languages(spark):
    """More languages than a mask has bits, one of them rare; the sample keeps each."""
    rng = np.random.default_rng(8)
    alphabet = {f"l{k:02d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(rng.choice(alphabet[x], 20)), x) for i, x in enumerate(sorted(alphabet) * 6)] + [(1000 + i, " ".join(rng.choice(alphabet["l00"], 20)), "l00") for i in range(400)] + [(None, "x y z", "l01"), (2001, None, "l02"), (2002, "a b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = fit_language_filters(docs, rows=500)
    assert filters.languages == sorted(alphabet) and filters.masks.shape[1] == 2
    told = [filters.predict(t)[0] == x for _, t, x in rows[:420]]
    assert np.mean(told) > 0.97
    got = identify_languages(docs.where("doc_id = 2001").unionByName(docs.where("doc_id = 2001")), filters).collect()
    assert [(r.lang_pred, r.score) for r in got] == [(UNKNOWN, 0.0)] * 2 and identify_languages(docs.where("false"), filters).collect() == []
    assert shares({"a": 3, "b": 1000, "c": 50}, 100) == {"a": 3, "c": 48, "b": 49}
    long = identify_languages(spark.createDataFrame([(1, " ".join(alphabet["l03"]) * 20_000)], "doc_id long, text string"), filters).first()
    assert long.lang_pred == "l03"


def test_samples_of_huge_tables_are_not_empty(spark):
    df = spark.range(100_000).withColumnRenamed("id", "k")
    assert 300 < df.where(dealt(20_000, 4 * 10**6, "k")).count() < 700
    assert "18446744073" in str(dealt(20_000, 10**13, "k"))  # 2**63 * 20,000 / 10**13, not 0


def test_op9_recall_and_ties(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[700:740] = x[0]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5100, [0.0] * 16), (5200, [float("inf")] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in search_index(build_index(df, shard=400), df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        assert len(got[q]) == 10 and all(s == pytest.approx(d[i], rel=1e-12) for i, s in got[q])
        hits += len(set(best) & {i for i, _ in got[q]})
    assert hits >= 0.95 * 150 and [i for i, _ in got[0]] == list(range(700, 710)) and set(got) == set(range(0, 1500, 100))
    few = df.where("vec_id < 3")
    assert [r.vec_id for r in search_index(build_index(few), few.where("vec_id = 0")).collect()] != [] and search_index(build_index(few), few.where("false")).collect() == []


def test_op9_large_components_and_repeated_ids(spark):
    rng = np.random.default_rng(7)
    x = rng.standard_normal((300, 8)) * 1e30
    assert build_graph((x / 2.0**103).astype(np.float32))[0].shape[0] == 300
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(0, x[0].tolist()), (0, x[1].tolist()), (5, x[200].tolist()), (400, [1.0] * 8), (None, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("c")).withColumn("dim", F.lit("c"))
    got = defaultdict(list)
    for r in search_index(build_index(df, least=100), df.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r.rank))
    of = defaultdict(list)
    for i, v in rows:
        of[i].append(np.array(v))
    assert set(got) == {0, 100, 200, 400}
    for q, found in got.items():
        d = {i: min(np.sqrt(((a - b) ** 2).sum()) for a in of[q] for b in vs) for i, vs in of.items() if i not in (None, q)}
        best = sorted(d, key=lambda i: (d[i], i))[:10]
        assert [i for i, _, _ in found] == best and [r for _, _, r in found] == list(range(1, 11))
        assert all(s == pytest.approx(d[i], rel=1e-12) for i, s, _ in found)


def test_components_of_hubs_and_paths(spark):
    hub = spark.range(1, 100_001).selectExpr("0L AS a", "id AS b")
    path = spark.range(200_000, 200_200).selectExpr("id AS a", "id + 1 AS b")
    loops = spark.createDataFrame([(5, 5), (300_001, 300_000), (300_000, 300_001)], "a long, b long")
    got = spark_components(hub.unionByName(path).unionByName(loops))
    assert got.groupBy("component").count().orderBy("component").collect() == [(0, 100_001), (200_000, 201), (300_000, 2)]
    assert spark_components(hub.where("false")).collect() == []


def test_components_of_stars_are_kept_twice(spark):
    """Links that one pass contracts to stars are written once, and their components once."""
    edges = spark.range(1, 5001).selectExpr("id % 50 AS a", "id + 1000 AS b")
    with recorded() as made:
        got = spark_components(edges)
    assert len(made) == 2
    assert {(r.node, r.component) for r in got.collect()} == {(n, c) for i in range(1, 5001) for n, c in ((i + 1000, i % 50), (i % 50, i % 50))}


def test_components_equal_union_find(spark):
    """Long paths, repeated links and random trees in shuffled order, over many tasks."""
    rng = np.random.default_rng(4)
    n = 6000
    name = rng.permutation(n)
    pairs = [(i, i + 1) for i in range(2000)] + [(i, int(rng.integers(2001, i))) for i in range(2002, 4000)] + [(int(a), int(b)) for a, b in rng.integers(4000, n, (1500, 2))] * 2
    pairs = [(int(name[a]), int(name[b])) for a, b in rng.permutation(pairs)]
    want = components(n, pairs)
    got = spark_components(spark.createDataFrame(pairs, "a long, b long").repartition(40)).collect()
    nodes = {x for a, b in pairs if a != b for x in (a, b)}
    assert sorted((r.node, r.component) for r in got) == sorted((x, want[x]) for x in nodes)


def test_stars_of_chunks(monkeypatch):
    """Every chunk is contracted by itself: no node has two smaller ends in it."""
    monkeypatch.setattr("lectern.llm.components.CHUNK", 4)
    edges = [(1, 2), (3, 2), (5, 4), (7, 7), (2, 9), (9, 4), (8, 8)]
    batches = [pa.RecordBatch.from_arrays([pa.array([a]), pa.array([b])], ["a", "b"]) for a, b in edges]
    got = [list(zip(*(c.to_pylist() for c in b.columns), strict=True)) for b in _stars(iter(batches))]
    assert got == [[(2, 1), (3, 1), (5, 4)], [(4, 2), (9, 2)]]
    assert list(_stars(iter([]))) == []


def test_op1_rows_of_near_signatures_come_back_whole():
    """What the second pass needs comes from the first: the blocks' rows aren't made again."""
    rng = np.random.default_rng(2)
    one, other = (rng.integers(0, 2**16, COORDINATES, dtype=np.uint16).tobytes() for _ in range(2))
    rows = [(5, 0, 0, 0, 0, 11, 11, 30, one), (5, 0, 0, 0, 0, 12, 12, 31, one), (5, 0, 0, 0, 0, 13, 13, 30, other)]
    names = ["key", "i", "j", "band", "block", "set", "component", "n", "signature"]
    batch = pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows])
    got = pa.Table.from_batches(list(_blocks(75, False)(iter([batch]))))
    assert got.to_pylist() == batch.to_pylist()[:2]


def test_op10_equals_plain_searches(spark):
    """Base columns by regular expressions, templates by backtracking over the words."""

    def fits(template, words):
        marks = re.findall(r"\[\[|\]\]|\{\d+\}|[^\[\]{}]+", template)

        def go(k, i):  # marks from k on against words from i on
            if k == len(marks):
                return True
            m = marks[k]
            if m == "]]":
                return go(k + 1, i)
            if m == "[[":
                depth, end = 1, k + 1
                while depth:
                    depth += {"[[": 1, "]]": -1}.get(marks[end], 0)
                    end += 1
                return go(k + 1, i) or go(end, i)
            if m[0] == "{":
                return any(go(k + 1, i + n) for n in range(int(m[1:-1]) + 1) if i + n <= len(words))
            w = words_of(m)
            return words[i : i + len(w)] == w and go(k + 1, i + len(w))

        return any(go(0, i) for i in range(len(words)))

    rng = np.random.default_rng(5)
    whole = {k: re.sub(r"\[\[|\]\]", " ", re.sub(r"\{\d+\}", "the authors", t)) for k, t in TEMPLATES.items()}
    least = {k: re.sub(r"\[\[.*?\]\]+", " ", re.sub(r"\{\d+\}", " ", t)) for k, t in TEMPLATES.items() if t.count("[[") == t.count("]]") and "[[or [[" not in t}
    texts = ["", None, *whole.values(), *least.values()]
    for t in whole.values():
        words = t.split()
        for _ in range(3):
            cut = list(words)
            del cut[int(rng.integers(len(cut)))]
            texts.append(" ".join(cut))
        texts.append(t[: len(t) // 2])
        texts.append(f"x {t.upper()} y {t}")
    rows = list(enumerate(texts)) + [(0, "mit license"), (0, "mit license"), (None, "MIT License")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = scan_licenses(df).collect()
    assert len(got) == len(rows) and scan_licenses(df.where("false")).collect() == []
    for r in got:
        words = words_of(r.text)
        flat = " " + " ".join(w.decode() for w in words) + " "
        starts = sorted(flat[: m.start()].count(" ") - 1 for p in PHRASES for m in re.finditer(f"(?<= )(?={p} )", flat))
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
        base = {label for p, label in PHRASES.items() if f" {p} " in flat}
        more = {k for k, t in TEMPLATES.items() if fits(t, words)}
        assert r.base_labels == ",".join(sorted(base)) and r.labels == ",".join(sorted(base | more)), (r.text, more)
        assert r.score == (1.0 if any(not m.endswith("-notice") for m in more) else 0.75 if more else 0.5 if base else 0.0)


def test_op10_mandatory_wording(spark):
    grant = TEMPLATES["mit"].split("the software is provided")[0]
    assert not Automaton(TEMPLATES["mit"]).accepts(words_of(grant), 0)
    a = Automaton("one [[two [[three]] four]] five")
    fits = {"one five": True, "one two four five": True, "one two three four five": True, "one three five": False, "one two five": False}
    assert {t: a.accepts(words_of(t), 0) for t in fits} == fits
    long = "permission is hereby granted " * 100_000
    assert scan_licenses(spark.createDataFrame([(1, long)], "doc_id long, text string")).first().labels == ""


def test_op10_places_and_templates(spark):
    long = "word " * 50_000 + "Released under the MIT License."
    rows = [(0, "MIT license, mit LICENSE; apache-license"), (1, None), (2, ""), (3, long), (4, "This work is licensed under the GNU General Public License, version 3."), (5, "général public license"), (6, "Licensed under CC BY-NC 4.0."), (7, "Licensed under the Apache License, Version 2.0 (the License)")]
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("c"))).collect()}
    assert (got[0].n_words, got[0].n_base, got[0].first_word, got[0].last_word, got[0].base_labels) == (6, 3, 0, 4, "apache,mit")
    assert all((got[i].n_words, got[i].n_base, got[i].first_word, got[i].labels, got[i].score) == (0, 0, None, "", 0.0) for i in (1, 2))
    assert (got[3].n_words, got[3].first_word, got[3].labels) == (50_005, 50_003, "mit,mit-notice")
    assert got[4].labels == "gpl,gpl-3.0-notice" and got[5].n_base == 0 and got[6].labels == "cc-by-nc-4.0-notice" and got[7].labels == "apache,apache-2.0-notice"
    a = Automaton("may [[not]] {2} end here")
    fits = {"may end here": True, "may not end here": True, "may x y end here": True, "may not x end here": True, "may x y z end here": False, "may end": False}
    assert {t: a.accepts(words_of(t), 0) for t in fits} == fits


def test_columns_of_any_name(spark):
    """Names that operators use within, and names with a backtick or a dot, come back as they were."""
    rows = [(1, "https://a.example/x", 5, "the quick brown fox under the mit license"), (2, None, None, None), (1, "https://a.example/x", 5, "")]
    odd = ["_url", "_at", "_best", "_key", "n", "best", "c0", "valid_from", "a`b", "x.y"]
    df = spark.createDataFrame(rows, "doc_id long, url string, fetched_at int, text string").select("*", *[F.lit(c).alias(c) for c in odd])
    entries = spark.createDataFrame([("a.example", "add", 1), ("a.example/x", "add", 9)], "pattern string, action string, listed_at int")
    got = filter_urls(df, entries)
    assert got.columns == [*df.columns, "blocked", "n_entries", "pattern", "listed_from"]
    got = sorted(map(tuple, got.collect()), key=str)
    assert [r[len(df.columns):] for r in got] == [(True, 1, "a.example", 1)] * 2 + [(False, 0, None, None)]
    assert all(list(r[4:14]) == odd for r in got)
    assert {r[len(df.columns)] for r in filter_urls(df, entries.where("false")).collect()} == {False} and filter_urls(df.where("false"), entries).collect() == []
    from lectern.llm.language import LanguageFilters
    from lectern.llm.toxicity import ToxicityModel

    for out in (scan_licenses(df), identify_languages(df, LanguageFilters.of({})), score_toxicity(df, ToxicityModel(np.zeros(0, np.int64), np.zeros(0), -5.0))):
        assert out.columns[: len(df.columns)] == df.columns and all(list(r[4:14]) == odd for r in out.collect())


def test_op9_shards_follow_the_table_alone(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(900, 8)))], "vec_id long, embedding array<double>").repartition(6)
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for n in ("4", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            index = build_index(df, shard=300, least=100)
            assert index.select("shard").distinct().count() == 9
            seen.append(sorted(map(tuple, search_index(index, df.where("vec_id % 100 = 0"), beam=16).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] and len(seen[0]) == 90


def test_op9_large_components(spark):
    """Doubles whose squares are infinite still have distances."""
    rows = [(i, [1e200 * (i % 7), 1e200 * (i % 5), 3e199]) for i in range(1, 40)] + [(100, [1e200, 2e200, 3e199])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r.score for r in search_index(build_index(df), df.where("vec_id = 100")).collect()}
    far = {i: float(np.linalg.norm((np.array(v) - np.array(rows[-1][1])) / 1e200) * 1e200) for i, v in rows[:-1]}
    best = sorted(far.values())[:10]
    assert np.allclose(sorted(got.values()), best, rtol=1e-12) and all(np.isfinite(s) for s in got.values())


def test_op10_notices_and_versions(spark):
    gpl = lambda v, later: f"This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; version {v} of the License{later}. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    texts = ["this file is under the MIT license", gpl(2, ""), gpl(3, ", or (at your option) any later version"), "the mit license", "none"]
    got = [(r.labels, r.score) for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1)).collect()]
    assert got == [("mit,mit-notice", 0.75), ("gpl,gpl-2.0-only", 1.0), ("gpl,gpl-3.0-or-later", 1.0), ("mit", 0.5), ("", 0.0)]


def test_op3_odd_strings():
    """The encoder's ids are the tokenizer's on special strings, odd spaces, composed and decomposed letters, and random characters."""
    t, e = Tokenizer.from_file(VOCABULARY), Encoder(VOCABULARY)
    t.encode_special_tokens = True
    rng = np.random.default_rng(4)
    ranges = [(32, 127), (0, 32), (0xA0, 0x250), (0x300, 0x370), (0x2000, 0x2070), (0x3000, 0x30FF), (0xFE00, 0xFE10), (0x1F300, 0x1F6FF), (0xD7A0, 0xD7FF), (0xE000, 0xE010)]
    texts = ["<|endoftext|>", "a<|endoftext|>b", "<|endo", "\ufb01 \u00e9 e\u0301 \u212b \u2460", "\u200b\ufeff", "I'll 'S we've 12,345.6 \n\n\t x  ", "", " ", "a" * 5000, "\U0001f469\u200d\U0001f467", "\x00\x01"]
    for _ in range(300):
        low, high = ranges[int(rng.integers(len(ranges)))]
        texts.append("".join(chr(c) if rng.random() < 0.7 else " aZ1'"[int(rng.integers(5))] for c in rng.integers(low, high, int(rng.integers(1, 60)))))
    for x in texts:
        assert np.frombuffer(e.encode(x), "<u4").tolist() == t.encode(x, add_special_tokens=False).ids, repr(x)
