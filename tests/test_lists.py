"""Inverted lists against exact retrieval, at two sizes."""

import numpy as np
import pytest

from lectern.operators import lists
from lectern.operators.lists import deal_to_lists, learn_lists, search_lists, spherical_means
from lectern.operators.retrieve import knn_topk


def vectors(n, seed):
    """Groups of unit vectors in 16 dimensions, some of them between groups."""
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(max(4, n // 60), 16))
    x = middle[rng.integers(0, len(middle), n)] + rng.normal(size=(n, 16)) * rng.choice([0.2, 0.5, 1.0], (n, 1))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).tolist()


@pytest.mark.parametrize("n", [1500, 12_000])
def test_recall(spark, monkeypatch, n):
    monkeypatch.setattr(lists, "PART_ROWS", 3000)
    children = spark.createDataFrame([("long" if i % 10 else "b", "ocr", i, f"p{i // 4}", v) for i, v in enumerate(vectors(n, 1))], "video_id string, store_mode string, child_id long, chunk_id string, embedding array<double>").repartition(6)
    asked = spark.createDataFrame([(i, v, "ocr", e) for v in ("long", "b", "no such") for i, e in enumerate(vectors(60, 2))], "query_id long, video_id string, store_mode string, embedding array<double>")
    found = learn_lists(children)
    count = {r.video_id: r.n_lists for r in found.collect()}
    assert count == {"long": round((n * 0.9) ** 0.5), "b": round((n * 0.1) ** 0.5)}
    listed = deal_to_lists(children, found)
    assert listed.count() == n and listed.select("list").distinct().count() <= count["long"]
    key = lambda r: (r.video_id, r.query_id, r.child_id)
    exact = {key(r): r.score for r in knn_topk(asked, children, 6).collect()}
    got = {key(r): r.score for r in search_lists(asked, listed, found, 6).collect()}
    assert len(exact) == len(got) == 720 and len(exact.keys() & got.keys()) / 720 >= 0.95
    assert all(got[k] == exact[k] for k in exact.keys() & got.keys())
    every = {key(r): r.score for r in search_lists(asked, listed, found, 6, share=1.0).collect()}
    assert every == exact
    assert search_lists(asked.where("false"), listed, found, 6).collect() == [] and search_lists(asked, listed.where("false"), found, 6).collect() == []


def test_means():
    x = np.array(vectors(400, 3))
    c = spherical_means(x, 10)
    assert c.shape == (10, 16) and np.allclose(np.linalg.norm(c, axis=1), 1) and (x @ c.T).max(axis=1).mean() > (x @ x[:10].T).max(axis=1).mean()
    assert spherical_means(np.array([[1.0, 0.0]] * 5), 3).shape == (3, 2)
