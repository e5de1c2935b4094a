"""Document vectors against a dense decomposition."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pytest

from feedforge.operators import doc_vectors


def corpus(n, seed):
    rng = random.Random(seed)
    topics = [["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(40)] for _ in range(8)]
    return [(i, " ".join(rng.choice(topics[i % 8] if rng.random() < 0.8 else topics[rng.randrange(8)]) for _ in range(rng.randint(20, 60)))) for i in range(n)]


def dense(rows):
    counts = [Counter(t.split()) for _, t in rows]
    df = Counter(w for c in counts for w in c)
    terms = sorted(df)
    a = np.zeros((len(rows), len(terms)))
    for i, c in enumerate(counts):
        for w, tf in c.items():
            a[i, terms.index(w)] = tf * (math.log((1 + len(rows)) / (1 + df[w])) + 1)
    return a / np.maximum(np.linalg.norm(a, axis=1, keepdims=True), 1e-300)


def test_equals_a_dense_decomposition(spark):
    rows, k = corpus(150, 1), 7
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found, values = doc_vectors.fit(doc_vectors.tf_idf(df, "doc_id", "text"), k, rounds=8)
    got = np.array([r["v"] for r in sorted(found.collect(), key=lambda r: r["key"])])
    a = dense(rows)
    u, s, _ = np.linalg.svd(a, full_matrices=False)
    assert values == pytest.approx(s[:k], rel=1e-6)
    # both span the same space: the angles between them are nought
    q = got / values
    assert np.linalg.svd(q.T @ u[:, :k])[1] == pytest.approx(np.ones(k), abs=1e-6)
    assert got @ got.T == pytest.approx((u[:, :k] * s[:k] ** 2) @ u[:, :k].T, abs=1e-5)
    assert (got.sum(0) >= 0).all()


def test_blocks_give_what_one_block_gives(spark):
    """What is multiplied goes by block: each word of a block is a row, not each word of a document."""
    rows = corpus(150, 3)
    weights = doc_vectors.tf_idf(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").persist()
    many, values = doc_vectors.fit(weights, 5, rounds=3, block_weights=700, block_docs=40)
    one, same = doc_vectors.fit(weights, 5, rounds=3)
    assert values == pytest.approx(same)
    x, y = (np.array([r["v"] for r in sorted(f.collect(), key=lambda r: r["key"])]) for f in (many, one))
    assert x.shape == (150, 5) and x == pytest.approx(y, abs=1e-8)
    assert doc_vectors.Blocks(weights).words.count() < weights.count() / 5


def test_topics_lie_together(spark):
    rows = corpus(160, 2)
    got = {r["doc_id"]: np.array(r["vector"]) for r in doc_vectors.document_vectors(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 8).collect()}
    x = np.array([got[i] / np.linalg.norm(got[i]) for i in range(160)])
    near = np.argsort(-(x @ x.T), axis=1)[:, 1:6]
    assert np.mean(near % 8 == np.arange(160)[:, None] % 8) > 0.9


def test_odd_documents(spark):
    rows = [(1, "apple pear"), (2, None), (3, ""), (4, "apple pear"), (4, "plum"), (5, "the of"), (None, "apple")]
    got = {r["doc_id"]: r["vector"] for r in doc_vectors.document_vectors(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 5).collect()}
    assert set(got) == {1, 2, 3, 4, 5, None} and all(len(v) == 5 for v in got.values())
    assert got[2] == got[3] == got[5] == [0.0] * 5 and any(got[1]) and any(got[4])
    none = spark.createDataFrame([], "doc_id long, text string")
    assert doc_vectors.document_vectors(none, "doc_id", "text", 3).count() == 0


def test_what_is_shuffled_follows_documents(spark):
    """Rare words took a vector each for every block and round, and all counts went through four shuffles."""
    rng = random.Random(4)
    rows = [(i, " ".join(f"w{int(20000 * rng.random() ** 2)}" for _ in range(120))) for i in range(600)]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    before = written()
    found = doc_vectors.document_vectors(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), "doc_id", "text", 16, block_docs=150)
    assert found.count() == 600
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    assert written() - before < 50 * sum(len(t) for _, t in rows)


def test_groups_and_repeated_ids(spark):
    """Many groups of words, and rows of equal ids, which are one document, give what one group and whole texts give."""
    rows = corpus(90, 5)
    split = [r for i, t in rows for r in ([(i, t[: len(t) // 12 * 6]), (i, t[len(t) // 12 * 6 :])] if i % 9 == 0 else [(i, t)])]
    frame = lambda r: spark.createDataFrame(r, "doc_id long, text string")
    got, want = (
        {r["doc_id"]: r["vector"] for r in doc_vectors.document_vectors(frame(r), "doc_id", "text", 4, **sizes).collect()} for r, sizes in ((split, {"group_bytes": 8000, "block_docs": 7}), (rows, {}))
    )
    assert len(got) == 90 and set(got) == set(want)
    assert all(got[i] == pytest.approx(want[i], abs=1e-9) for i in want)
