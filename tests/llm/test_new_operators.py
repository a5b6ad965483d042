"""Merkle manifest, periodic runs and packaged web archives against brute force, with odd rows."""

import hashlib
import json
import os
import struct
import zipfile
from collections import Counter
from random import Random

import numpy as np
from pyspark.sql import functions as F

from lectern.llm import periodic
from lectern.llm.merkle import build_manifest, fold, leaf_digest, prove
from lectern.llm.periodic import WaveletMatrix, find_runs, periodic_runs
from lectern.llm.warc import ABOUT, ARCHIVE, INDEX, directory, package_index, package_members, read_records, write_packages


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


# Merkle manifest


def tree(digests):
    """All levels, one after another."""
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append("".join(d for i, d in enumerate(level[run : run + 16], run) if i != at))
        at //= 16
    return out


def manifest_rows():
    rng = Random(3)
    sizes = {"big": 300, "b": 16, "b2": 17, "é": 1, "": 2, None: 33, **{f"s{i:02}": 1 for i in range(14)}}
    rows = [(i, rng.choice(["Text " * rng.randrange(20), "", None]), source) for i, source in enumerate(s for s, n in sizes.items() for _ in range(n))]
    rng.shuffle(rows)
    return [*rows, (None, "no id", "b"), rows[0], (5, "other text of 5", rows[0][2])]


def test_op11_brute_force(spark):
    rows = manifest_rows()
    df = spark.createDataFrame([(*r, "x", "x", "x") for r in rows], "doc_id long, text string, source string, path string, digest string, children string")
    leaves = df.select("doc_id", "source", leaf_digest("doc_id", "text").alias("leaf"))
    m = build_manifest(leaves, "source", "doc_id")
    by = {}
    for i, text, source in rows:
        by.setdefault(source, []).append((i is not None, i or 0, leaf(i, text)))
    low = {s: tree([x[2] for x in sorted(v)]) for s, v in by.items()}
    names = sorted(low, key=lambda s: (s is not None, (s or "").encode()))
    high = tree([low[s][-1][0] for s in names])
    assert m.root == high[-1][0]
    want = Counter()
    for k, s in enumerate(names):
        for at, d in enumerate(low[s][0]):
            want[d, low[s][-1][0], tuple(siblings(low[s], at) + siblings(high, k))] += 1
    told = prove(m.records, m.root, m.leaves)
    got = Counter((r.leaf, r.subroot, tuple(r.siblings)) for r in told.collect())
    assert got == want
    folded = told.select("doc_id", fold(F.col("leaf"), F.col("path"), F.col("siblings")).alias("same"), fold(F.sha2("leaf", 256), F.col("path"), F.col("siblings")).alias("other")).collect()
    assert all(r.same == m.root and r.other != m.root for r in folded)
    some = m.leaves.where("doc_id in (1, 7)")  # only nodes on their way are opened
    assert Counter((r.leaf, tuple(r.siblings)) for r in prove(m.records, m.root, some.unionByName(some)).collect()) == Counter({k[::2]: 2 * n for k, n in want.items() if k[0] in {r.leaf for r in some.collect()}})
    for d, children in m.records.collect():  # addressed by content
        assert d == h(*children) and len(children) <= 16
    m.delete()


def test_op11_small_trees(spark):
    kinds = "doc_id long, source string, leaf string"
    none = build_manifest(spark.createDataFrame([], kinds), "source", "doc_id")
    assert none.root is None and prove(none.records, none.root, none.leaves).collect() == []
    one = build_manifest(spark.createDataFrame([(1, None, "a" * 64)], kinds), "source", "doc_id")
    (r,) = prove(one.records, one.root, one.leaves).collect()
    assert one.root == r.subroot == "a" * 64 and r.siblings == [] and r.path == ""
    alike = build_manifest(spark.createDataFrame([(1, "s", "a" * 64)] * 40, kinds), "source", "doc_id")  # equal nodes share a record
    told = prove(alike.records, alike.root, alike.leaves)
    assert told.count() == 40 and {r[0] for r in told.select(fold(F.col("leaf"), F.col("path"), F.col("siblings"))).collect()} == {alike.root}


# periodic runs


def runs_of(w):
    """By trying all periods at all places."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)
            i = j + 1
    return sorted((s, n, q) for (s, n), q in out.items())


def words_with_runs(rng):
    n, k = rng.choice([0, 1, 5, 6, 7, 20, 60, 150]), rng.choice([1, 2, 3, 10])
    w = [rng.randrange(k) for _ in range(n)]
    if n > 6 and rng.random() < 0.7:
        a, r = rng.randrange(n), rng.randint(3, 10)
        p = 1 + (n - a) // r
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def test_op12_runs_of_texts_searched_together():
    rng = Random(1)
    found = 0
    for _ in range(600):
        docs = [words_with_runs(rng) for _ in range(rng.randint(1, 5))]
        start, total, period = find_runs(np.array([x for d in docs for x in d], np.int64), np.array([len(d) for d in docs]))
        want, at = [], 0
        for d in docs:
            want += [(s + at, n, q) for s, n, q in runs_of(d)]
            at += len(d)
        assert list(zip(start.tolist(), total.tolist(), period.tolist(), strict=True)) == sorted(want, key=lambda r: (r[0], r[2]))
        found += len(want)
    assert found > 500


def test_op12_wavelet_matrix():
    rng = np.random.default_rng(2)
    for n in (1, 2, 9, 300):
        values = rng.permutation(n).astype(np.int64)
        m = WaveletMatrix(values, n.bit_length())
        low = rng.integers(0, n, 50)
        high = low + 1 + rng.integers(0, n - low)
        x = rng.integers(0, n, 50)
        assert m.below(low, high, x).tolist() == [int((values[a:b] < y).sum()) for a, b, y in zip(low, high, x, strict=True)]
        k = rng.integers(0, high - low)
        assert m.smallest(low, high, k).tolist() == [int(np.sort(values[a:b])[i]) for a, b, i in zip(low, high, k, strict=True)]


def test_op12_rows(spark, monkeypatch):
    rng = Random(7)
    texts = [" ".join(f"w{x}" for x in words_with_runs(rng)) for _ in range(60)]
    texts += [None, "", " \t\n ", "a a a a a a", "A a A a A a A a", "x\x0by\x0cx y\rx y x y x y", "é\xa0é é\xa0é " * 6, "ab " * 30_000, "one two three " * 9]
    rows = [(i, t, "x", "x", "x") for i, t in enumerate(texts)] + [(None, "b " * 7, "x", "x", "x"), (3, texts[3], "x", "x", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, collapsed string, id string")
    monkeypatch.setattr(periodic, "WORDS", 500)  # several texts at a time, and texts longer than that
    got = [r for b in periodic._search(iter([df.select("doc_id", "text").toArrow().combine_chunks().to_batches()[0]])) for r in b.to_pylist()]
    as_row = lambda r: str((r["id"], r["n_words"], [tuple(x.values()) for x in r["runs"]], r["collapsed"]))
    want = []
    for i, t, *_ in rows:
        w = (t or "").encode().split()
        known = runs_of(w) if len(w) < 1000 else [(0, len(w), 1)]
        gone = {k for s, n, q in known for k in range(s + q, s + n)}
        want.append(str((i, len(w), known, b" ".join(x for k, x in enumerate(w) if k not in gone).decode())))
    assert [as_row(r) for r in got] == want
    spark_rows = [str((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed)) for r in periodic_runs(df).collect()]
    assert sorted(spark_rows) == sorted(want)
    assert periodic_runs(df.where("false")).collect() == []


# packaged web archives


def test_op13_round_trip(spark, tmp_path):
    big, rng = "same " * 40, Random(5)
    pages = [(i, f"https://h{i % 7}.example/{i}", rng.choice([big, big + "x", "tiny", "", None, f"own page {i} " * 30])) for i in range(200)]
    pages += [(200, None, "no url " * 30), (201, "https://a.example/a b\r\nX: y", "bad url " * 30), (202, "u", "binary \x00\r\n\r\n\x1f\x8b é " * 20), (203, "u", "long " * 400_000)]
    pages += [(None, "u", big), (None, "u", "only null ids " * 9), (None, "u", "only null ids " * 9), pages[0], (204, "u", "x" * 99), (205, "u", "x" * 99), (206, "u", "x" * 100), (207, "u", "x" * 100)]
    df = spark.createDataFrame([(*p, "x", "x") for p in pages], "page_id long, url string, html string, digest string, first string").repartition(5)
    packages = write_packages(df, str(tmp_path / "a"), most_records=17).toPandas()
    assert packages.records.sum() == len(pages) and packages.records.max() <= 17
    members = package_members(spark.createDataFrame(packages[["path"]]))
    assert {r.member for r in members.collect()} == {ARCHIVE, INDEX, ABOUT} and {r.method for r in members.collect()} == {0}
    rows = read_records(package_index(members), 4).collect()
    assert not any(r.error for r in rows)
    first = {}
    for i, _, html in pages:
        body = (html or "").encode()
        if len(body) >= 100 and i is not None:
            first[body] = min(first.get(body, i), i)
    want, got = Counter(), Counter()
    for i, _, html in pages:
        body = (html or "").encode()
        refers = first.get(body) if first.get(body) != i else None
        want[i, "response" if refers is None else "revisit", refers, len(body), f"sha256:{hashlib.sha256(body).hexdigest()}", body if refers is None else None] += 1
    number = lambda x: None if x is None or x.endswith(":") else int(x.rpartition(":")[2])
    for r in rows:
        got[number(r.record_id), r.type, number(r.refers_to), r.payload_bytes, r.digest, None if r.payload is None else bytes(r.payload)] += 1
    assert got == want
    urls = {number(r.record_id): r.url for r in rows}
    assert urls[200] is None and urls[201] == "https://a.example/a%20b%0D%0AX:%20y" and urls[3] == "https://h3.example/3"
    with zipfile.ZipFile(packages.path[0]) as z:  # another reader finds the same
        about = json.loads(z.read(ABOUT))
        assert all(f"sha256:{hashlib.sha256(z.read(p['path'])).hexdigest()}" == p["hash"] for p in about["resources"])
    assert write_packages(df.where("false"), str(tmp_path / "b")).collect() == []
    assert read_records(package_index(package_members(spark.createDataFrame([], "path string"))), 2).collect() == []


def test_op13_broken_packages_are_reported(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", f"page {i} " * 30) for i in range(4)], "page_id long, url string, html string").coalesce(1)
    good = write_packages(df, str(tmp_path / "a")).first().path
    bad = {"junk": b"no package", "empty": b"", "cut": open(good, "rb").read()[:-30]}
    for name, data in bad.items():
        (tmp_path / name).write_bytes(data)
    with zipfile.ZipFile(tmp_path / "packed", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(ARCHIVE, b"x" * 1000)
        z.writestr(INDEX, b'{"offset": 0, "length": 5}\n')
    with zipfile.ZipFile(tmp_path / "index", "w") as z:
        z.writestr(ARCHIVE, b"x" * 1000)
        z.writestr(INDEX, b'key 2024 {"offset": "0", "length": "5"}\nbroken\n{"offset": 990, "length": 50}')
    paths = [good, *(str(tmp_path / n) for n in [*bad, "packed", "index", "missing"])]
    rows = read_records(package_index(package_members(spark.createDataFrame([(p,) for p in paths], "path string"))), 3).collect()
    errors = Counter(os.path.basename(r.path) for r in rows if r.error)
    assert errors == {**dict.fromkeys([*bad, "packed", "missing"], 1), "index": 3} and sum(r.error is None for r in rows) == 4


def reader(path):
    def read(at, n):
        with open(path, "rb") as f:
            f.seek(at)
            return f.read(n)

    return read


def test_op13_zip64_directories(tmp_path):
    many = tmp_path / "many.zip"  # more members than 16 bits count
    with zipfile.ZipFile(many, "w") as z:
        for i in range(66_000):
            z.writestr(zipfile.ZipInfo(f"m{i}"), b"%d" % i)
    found = directory(reader(many), many.stat().st_size)
    assert len(found) == 66_000 and reader(many)(*found[65_999][2:]) == b"65999"
    far = tmp_path / "far.zip"  # a member beyond 4 GB (a hole takes no disk), a comment, and bytes before the package
    with open(far, "wb") as f:
        f.truncate((1 << 32) + 5000)
    with zipfile.ZipFile(far, "a") as z:
        z.writestr(zipfile.ZipInfo("a"), b"hello")
        z.comment = b"PK\x05\x06 in a comment"
    (name, method, start, size) = directory(reader(far), far.stat().st_size)[0]
    assert (name, method, reader(far)(start, size)) == ("a", 0, b"hello") and start > 1 << 32
    near = tmp_path / "near.zip"
    with zipfile.ZipFile(near, "w") as z:
        z.writestr(zipfile.ZipInfo("b"), b"there")
    shifted = tmp_path / "shifted.zip"  # offsets count from the package's own start
    shifted.write_bytes(b"stub" * 100 + near.read_bytes())
    (name, _, start, size) = directory(reader(shifted), shifted.stat().st_size)[0]
    assert (name, reader(shifted)(start, size)) == ("b", b"there")
    broken = bytearray(near.read_bytes())
    struct.pack_into("<H", broken, len(broken) - 12, 9)  # more entries than there are
    (tmp_path / "broken.zip").write_bytes(broken)
    try:
        directory(reader(tmp_path / "broken.zip"), len(broken))
        raise AssertionError("no error")
    except ValueError:
        pass
