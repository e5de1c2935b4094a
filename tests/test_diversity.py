"""Diversity of lists, its bounds, and the vector index."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from feedforge.operators import ann, diversity, vectors


def cosine(a, b):
    na, nb = np.linalg.norm(a), np.linalg.norm(b)
    return 1 - float(a @ b) / (na * nb) if na and nb else 1.0


def vector_table(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item long, vector array<double>")


@pytest.fixture(scope="module")
def some():
    x = np.random.default_rng(1).normal(size=(14, 5))
    x[3] = x[9] = 0
    return x


def test_list_diversity_is_the_mean_over_pairs(spark, some):
    lists = [(0, [0, 1, 2, 3]), (1, [3, 9]), (2, [3, 9, 9, 4]), (3, [5]), (4, []), (5, [0, 0]), (6, [1, 77, 2]), (7, None)]
    df = spark.createDataFrame(lists, "row long, items array<long>")
    got = {r["row"]: r["diversity"] for r in vectors.pairwise_distance(df, vector_table(spark, some), "row", "items", "item").collect()}
    for row, items in lists:
        known = [i for i in items or [] if i < 14]
        pairs = [cosine(some[a], some[b]) for (i, a), (j, b) in itertools.permutations(enumerate(known), 2)]
        assert got[row] == (pytest.approx(np.mean(pairs), abs=1e-12) if pairs else None)


def test_cross_diversity(spark, some):
    rows = [(0, [0, 1], [2, 3]), (1, [3], [9]), (2, [5, 5], [5]), (3, [], [1]), (4, [77], [1])]
    df = spark.createDataFrame(rows, "row long, a array<long>, b array<long>")
    got = {r["row"]: r["serendipity"] for r in vectors.serendipity(df, vector_table(spark, some), "row", "a", "b", "item").collect()}
    for row, a, b in rows:
        pairs = [cosine(some[i], some[j]) for i in a for j in b if i < 14 and j < 14]
        assert got[row] == (pytest.approx(np.mean(pairs), abs=1e-12) if pairs else None)


def test_no_pair_rows(spark, some):
    """Rows grow with the lists, not with their squares."""
    df = spark.createDataFrame([(0, list(range(14)) * 20)], "row long, items array<long>")
    plan = vectors.pairwise_distance(df, vector_table(spark, some), "row", "items", "item")._jdf.queryExecution().toString()
    assert "collect_list" not in plan and plan.count("Generate") <= 4


@pytest.mark.parametrize(("n", "k"), [(7, 3), (6, 6), (9, 2), (5, 1), (12, 5)])
def test_unranked(n, k):
    got = diversity.unranked(np.arange(math.comb(n, k)), n, k)
    assert [tuple(sorted(r)) for r in got.tolist()] == sorted((tuple(c) for c in itertools.combinations(range(n), k)), key=lambda c: c[::-1])


def test_unranked_far_out():
    n, k = 3000, 12
    last = math.comb(n, k) - 1
    got = diversity.unranked(np.array([0, last], dtype=object), n, k)
    assert got[0].tolist() == list(range(11, -1, -1)) and got[1].tolist() == list(range(n - 1, n - 1 - k, -1))


def brute_bounds(x, k, distance=cosine):
    scores = [np.mean([distance(x[a], x[b]) for a, b in itertools.combinations(c, 2)]) for c in itertools.combinations(range(len(x)), k)]
    return min(scores), max(scores)


@pytest.mark.parametrize(("k", "step"), [(2, 4096), (3, 50), (5, 7)])
def test_exact_bounds(spark, some, k, step):
    rows = [("a", i, v.tolist()) for i, v in enumerate(some[:9])] + [("b", i, v.tolist()) for i, v in enumerate(some[9:13])] + [("c", 0, some[0].tolist()), (None, 1, some[1].tolist()), ("a", 99, None)]
    df = spark.createDataFrame(rows, "slate string, item long, vector array<double>")
    got = {r["slate"]: r for r in diversity.diversity_bounds(df, "slate", k, step=step).collect()}
    for name, x in (("a", some[:9]), ("b", some[9:13])):
        if len(x) >= k:
            assert (got[name]["lowest"], got[name]["highest"]) == pytest.approx(brute_bounds(x, k), abs=1e-12)
            assert got[name]["n_lists"] == math.comb(len(x), k) and got[name]["exact"]
    assert [(got[c]["n"], got[c]["n_lists"], got[c]["lowest"]) for c in ("c", None)] == [(1, 0, None)] * 2


def test_drawn_bounds_lie_inside_and_repeat(spark, some):
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(some)], "slate string, item long, vector array<double>")
    low, high = brute_bounds(some, 4)
    ask = lambda **kw: diversity.diversity_bounds(df, "slate", 4, **kw).first()
    drawn = ask(most=400, seed=3)
    assert not drawn["exact"] and drawn["n_lists"] == 400 and low <= drawn["lowest"] < drawn["highest"] <= high
    assert ask(most=400, seed=3, step=37) == drawn and ask(most=400, seed=4) != drawn
    assert (ask(most=400, exact=True)["lowest"], ask(exact=True)["highest"]) == pytest.approx((low, high), abs=1e-12)
    near = ask(exact=False, most=5000)
    assert near["highest"] >= low + 0.9 * (high - low)


def test_bounds_with_other_distances(spark, some):
    df = spark.createDataFrame([("a", i, v.tolist()) for i, v in enumerate(some)], "slate string, item long, vector array<double>")
    for f, one in ((diversity.euclidean_distances, lambda a, b: np.linalg.norm(a - b)), (diversity.manhattan_distances, lambda a, b: np.abs(a - b).sum())):
        r = diversity.diversity_bounds(df, "slate", 3, distance=f).first()
        assert (r["lowest"], r["highest"]) == pytest.approx(brute_bounds(some, 3, one), abs=1e-6)


# --- the vector index


def clustered(n, seed, dims=16, centres=30):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dims))
    x = c[rng.integers(0, centres, n)] + 0.4 * rng.normal(size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@pytest.mark.parametrize("spread", ["clusters", "none"])
def test_index_recall(spark, spread):
    x = clustered(4000, 2) if spread == "clusters" else np.random.default_rng(3).normal(size=(3000, 16))
    v = vector_table(spark, x)
    q = v.filter("item % 100 = 0").withColumnRenamed("item", "query_id")
    index = ann.build_index(v, "item", part_rows=500)
    found, exact = ann.search(index, q, "query_id", 10).persist(), vectors.top_k(q, v, "query_id", "item", 10)
    assert index.codes.count() == len(x)
    assert ann.recall(found, exact, "query_id").agg(F.avg("recall")).first()[0] >= 0.9
    for r in found.filter("query_id = 0").collect():
        assert r["score"] == pytest.approx(round(float(x[0] @ x[r["item"]]), 6), abs=2e-6)
    if spread == "clusters":
        sizes = {r["cell"]: r["count"] for r in index.codes.groupBy("cell").count().collect()}
        looked = sum(sizes.get(c, 0) for r in index.book.probed(x[::100]).tolist() for c in r)
        assert looked < 0.5 * len(x) * len(x[::100])


def test_index_with_a_hot_cell(spark):
    """A third of all rows is one vector; its cell is dealt into parts and ties go by item."""
    x = clustered(900, 5)
    x[:300] = x[0]
    v = vector_table(spark, x)
    index = ann.build_index(v, "item", part_rows=40)
    assert max(index.parts) >= 8
    got = ann.search(index, v.filter("item = 0").withColumnRenamed("item", "query_id"), "query_id", 5, again=100).sort("rank").collect()
    assert [r["item"] for r in got] == [0, 1, 2, 3, 4]


def test_index_odd_tables(spark):
    none = spark.createDataFrame([], "item long, vector array<double>")
    index = ann.build_index(none, "item")
    assert ann.search(index, none.withColumnRenamed("item", "q"), "q", 3).count() == 0
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5]), (3, None), (4, [1.0, 0.0])], "item long, vector array<double>")
    got = ann.search(ann.build_index(few, "item"), few.withColumnRenamed("item", "q").filter("q = 1"), "q", 3).sort("rank").collect()
    assert [(r["item"], r["score"]) for r in got][:2] == [(1, 1.0), (4, 1.0)]


def test_index_saved_and_loaded(spark, tmp_path):
    x = clustered(600, 7)
    v = vector_table(spark, x)
    q = v.filter("item < 20").withColumnRenamed("item", "q")
    index = ann.build_index(v, "item")
    index.save(str(tmp_path))
    again = ann.load_index(spark, str(tmp_path))
    key = lambda df: sorted(tuple(r) for r in df.select("q", "item", "score", "rank").collect())
    assert key(ann.search(again, q, "q", 5)) == key(ann.search(index, q, "q", 5))
