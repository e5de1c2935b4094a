"""Operator 11 against a full scan."""

from __future__ import annotations

import random

import numpy as np
import pytest

from feedforge.llm import negatives, oracles
from feedforge.llm import queries as registered
from tests.compare import database, same
from tests.llm.conftest import SMALL

SCHEMA = "vec_id long, label int, embedding array<long>, page string, uid double"
KEYS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, positives=5, negatives=5, low=80, every=10):
    used = [(i, lab, [int(x) for x in v]) for i, lab, v, *_ in rows if lab is not None and v is not None and all(x is not None for x in v)]
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out = []
    for n, (a, lab, v) in enumerate(used):
        if a is None or a % every:
            continue
        scored = [(sum(x * y for x, y in zip(v, w)), i, m == lab) for k, (i, m, w) in enumerate(used) if k != n]
        for p, i, _ in sorted((s for s in scored if s[2]), key=order)[:positives]:
            fits = sorted((s for s in scored if not s[2] and low * p <= 100 * s[0] <= 100 * p), key=order)[:negatives]
            out += [(a, i, r + 1, j, p, s) for r, (s, j, _) in enumerate(fits)]
    return sorted(out, key=str)


def mined(spark, rows, every=10, **kw):
    got = negatives.mine_negatives(spark.createDataFrame(rows, SCHEMA), negatives.F.col("vec_id") % every == 0, **kw)
    assert got.columns == KEYS
    return sorted((tuple(r) for r in got.collect()), key=str)


def clustered(n, seed, dims=6, labels=4, spread=30):
    rng = np.random.default_rng(seed)
    centres = rng.integers(-200, 200, (8, dims))
    at = rng.integers(0, 8, n)
    x = centres[at] + rng.integers(-spread, spread + 1, (n, dims))
    return [(i, int(rng.integers(0, labels) if i % 3 == 0 else at[i] % labels), x[i].tolist(), "p", 0.5) for i in range(n)]


@pytest.mark.parametrize(("page_rows", "leaf_rows"), [(100_000, 100_000), (60, 8), (25, 1)])
def test_equals_a_full_scan(spark, page_rows, leaf_rows):
    rows = clustered(400, 3)
    assert mined(spark, rows, page_rows=page_rows, leaf_rows=leaf_rows) == brute(rows)


def test_copies_ties_and_a_hot_label(spark):
    """A third of all rows is one vector, a third of all labels one label, and ids repeat."""
    rng = random.Random(4)
    rows = clustered(150, 5)
    rows += [(1000 + i, 0 if i % 2 else 7, [50, 60, 70, 0, 0, 0], "p", 0.5) for i in range(120)]
    rows += [(i, 0, [rng.randint(-9, 9) for _ in range(6)], "p", 0.5) for i in (10, 10, 20, 20, 30)]
    assert mined(spark, rows, page_rows=40, leaf_rows=4) == brute(rows)


def test_odd_rows(spark):
    rows = [(0, 1, [3, 4], None, None), (10, 1, None, "x", 1.0), (20, None, [3, 4], "x", 1.0), (30, 1, [3, None], "x", 1.0), (None, 1, [3, 4], "x", 1.0), (None, 2, [3, 3], "x", 1.0)]
    rows += [(40, 2, [2, 4], "x", 1.0), (50, 1, [], "x", 1.0), (60, 1, [5], "x", 1.0), (70, 2, [0, 0], "x", 1.0), (80, 3, [-5, -5], "x", 1.0), (90, 3, [4, 4], "x", 1.0), (None, None, None, None, None)]
    padded = [(i, lab, None if v is None else v + [0] * (2 - len(v)), *r) for i, lab, v, *r in rows]
    assert mined(spark, rows) == brute(padded)
    assert mined(spark, []) == []
    with pytest.raises(ValueError):
        mined(spark, [(0, 1, [1 << 30, 1 << 30], None, None)])


def test_quantised(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([float("nan"), 1.0],), ([float("inf")],), ([None, 1.0],), (None,), ([],)], "v array<float>")
    assert [r[0] for r in df.select(negatives.quantised(negatives.F.col("v"), 256)).collect()] == [[128, -1], None, None, None, None, []]


def test_bounds_hold_and_leaves_are_passed_over(spark):
    """Whatever the tree, a node's bounds hold for all its rows; with clusters most leaves stay closed."""
    rows = np.array([r[2] for r in clustered(600, 9)], float)
    most = float((rows**2).sum(1).max())
    for routed in (False, True):
        tree, order = negatives.Tree.grow(rows, most, 10, routed)
        x, q = rows[order], rows[::37]
        upper, lower = tree.bounds(q, most)
        for n, (a, b) in enumerate(tree.range):
            scores = q @ x[a:b].T
            assert (scores.max(1) <= upper[:, n]).all() and (scores.min(1) >= lower[:, n]).all()
        assert sorted(order.tolist()) == list(range(600))
        ends = tree.range[tree.leaves]
        if routed:
            leaf_of = np.empty(600, int)
            for k, (a, b) in enumerate(ends):
                leaf_of[order[a:b]] = k
            assert (tree.route(rows, most) == leaf_of).all()
        fifth = np.sort(q @ rows.T, axis=1)[:, -5]
        assert (upper[:, tree.leaves] >= fifth[:, None]).mean() < 0.5


def test_query(spark):
    found = registered.queries()["op11_hard_negatives"](spark, SMALL).toPandas()
    same(found, database(SMALL).sql(oracles.oracle_sql()["op11_hard_negatives"]).df())


def test_queries_and_pages_are_not_broadcast(spark):
    """What queries carry to pages grows with both, so that joins of them must not go through the driver."""
    rows = spark.createDataFrame(clustered(200, 9), SCHEMA).selectExpr("vec_id as uid", "vec_id as id", "cast(label as long) as label", "vec_id % 10 = 0 as asks", "embedding as v")
    index = negatives.Index(rows, page_rows=50, leaf_rows=8)
    wide = negatives.F.expr("array(named_struct('need', -(1L << 60), 'high', 1L << 60))")
    asked = index.rows.filter("asks").select("uid", "label", "v", "page", wide.alias("windows"))
    found = index._visit(asked, 5, True)
    assert found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "SortMergeJoin" in plan and "Broadcast" not in plan
