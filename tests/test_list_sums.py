"""Lists whose vectors are added up in one pass."""

from __future__ import annotations

import math

import pytest

from feedforge.operators import history, order, vectors
from feedforge.plans import queries as plans

VECTORS = [("k", [3.0, 4.0]), ("l", [0.0, 8.0]), ("m", [-3.0, -4.0]), ("n", None), ("o", [1.0, None]), ("p", [7.0])]


@pytest.fixture(params=["2", "10000"])
def batched(spark, request):
    """Batches so short that a list spans several of them."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield spark
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_pool_lists_is_mean_pool(batched):
    v = batched.createDataFrame(VECTORS, "item string, vector array<float>")
    lists = [(1, ["k", "l", "absent"]), (2, ["k", "m"]), (3, ["absent"]), (4, ["l", "l"]), (5, ["n", "k"]), (6, ["n"]), (7, ["k"] * 9), (8, []), (9, None), (10, ["o", "k"])]
    df = batched.createDataFrame(lists, "row int, items array<string>")
    each = batched.createDataFrame([(r, i) for r, items in lists for i in items or []], "row int, item string")
    for normalize in (True, False):
        got = {r["row"]: (r["n_used"], r["vector"]) for r in vectors.pool_lists(df, v, "row", "items", "item", "vector", normalize).collect()}
        want = {r["row"]: (r["n_used"], r["vector"]) for r in vectors.mean_pool(each, v.filter("item <> 'p'"), "row", "item", "vector", normalize).collect()}
        assert len(got) == len(lists) and got.pop(8) == got.pop(9) == (0, None)
        assert got.pop(6)[0] == want.pop(6)[0] == 1
        assert {r: n for r, (n, _) in got.items()} == {r: n for r, (n, _) in want.items()}
        for r, (_, x) in want.items():
            assert got[r][1] == (pytest.approx(x) if x else None)


def test_pool_lists_without_vectors(spark):
    v = spark.createDataFrame(VECTORS, "item string, vector array<float>").limit(0)
    df = spark.createDataFrame([(1, ["k"]), (2, [])], "row int, items array<string>")
    got = vectors.pool_lists(df, v, "row", "items", "item", "vector").collect()
    assert sorted((r["row"], r["n_used"], r["vector"]) for r in got) == [(1, 0, None), (2, 0, None)]


def test_distances_of_long_lists(batched):
    v = batched.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 2.0]), (2, [0.0, 0.0])], "item long, vector array<double>")
    df = batched.createDataFrame([(1, [0, 1] * 20, [0] * 7), (2, [2, 2], [2]), (None, [0, 0], [0])], "row long, a array<long>, b array<long>")
    among = {r["row"]: r["diversity"] for r in vectors.pairwise_distance(df, v, "row", "a", "item").collect()}
    between = {r["row"]: r["serendipity"] for r in vectors.serendipity(df, v, "row", "a", "b", "item").collect()}
    assert among == {1: pytest.approx(20 / 39), 2: 1.0, None: pytest.approx(0)}
    assert between == {1: pytest.approx(0.5), 2: 1.0, None: pytest.approx(0)}


def test_lengths_are_taken_once(spark):
    """A length inside the lambda over the components is taken for each of them."""
    v = spark.createDataFrame(VECTORS[:3], "item string, vector array<float>")
    items = spark.createDataFrame([(1, "k"), (1, "l")], "row int, item string")
    for df in (vectors.normalized(v, "vector"), vectors.mean_pool(items, v, "row", "item", "vector")):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert plan.lower().count("sqrt(") == 1
    unit = {r["item"]: r["vector"] for r in vectors.normalized(v, "vector").collect()}
    assert unit["k"] == pytest.approx([0.6, 0.8]) and unit["l"] == [0.0, 1.0] and math.isclose(unit["m"][0], -0.6)


@pytest.mark.parametrize(("name", "windows"), [("pooled_user_vector", 3), ("serendipity", 3)])
def test_histories_are_found_once(spark, name, windows):
    """The windows of a history: places of an impression, last clicks, clicks before an impression."""
    plan = plans.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [") == windows


def test_users_are_dealt_once(spark):
    imp = spark.createDataFrame([(1, 7, 5)], "row long, user_id long, s long").selectExpr("row", "user_id", "timestamp_seconds(s) as t")
    clicks = spark.createDataFrame([(7, 1, 3, 0)], "user_id long, s long, item long, seq long").selectExpr("user_id", "timestamp_seconds(s) as click_time", "item", "seq")
    lists = history.as_of_lists(imp, clicks, 2, time="t", row="row", item="item")
    assert lists._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert [tuple(r) for r in lists.collect()] == [(1, [3])]
    assert order.dealt(imp, 1, "row") is imp
