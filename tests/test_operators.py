from __future__ import annotations

import datetime as dt
import hashlib
import math
import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from feedforge.operators import bm25, bootstrap, evaluate, features, frames, history, labelling, order, popularity, ranking, sampling, split, validate, vectors
from feedforge.operators.order import numbered, running
from feedforge.plans import queries as plans
from feedforge.plans import tables


def day(i, hour=0):
    return dt.datetime(2023, 2, 1) + dt.timedelta(days=i, hours=hour)


def counts(df):
    return tuple(split.split_counts(df).first())


def test_split_by_days(spark):
    # the last day is 20: test from 18 on, val from 16 on
    df = spark.createDataFrame([(day(i),) for i in (2, 9, 15, 16, 17, 17, 18, 20)], "t timestamp")
    assert counts(split.temporal_split(df, "t")) == (3, 3, 2)
    assert counts(split.temporal_split(df.limit(0), "t")) == (0, 0, 0)


def test_split_fallback_keeps_times_together(spark):
    # no row is in the two days before the last two: shares decide, and the 14 equal times stay together
    df = spark.createDataFrame([(day(0),)] * 6 + [(day(1),)] * 14 + [(day(30),)] * 5, "t timestamp")
    assert counts(split.temporal_split(df, "t")) == (20, 0, 5)


def test_splits_of_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(11)], "i int")
    sizes = lambda d, c: {r[c]: r["n"] for r in d.groupBy(c).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes(split.even_split(df, F.md5(F.col("i").cast("string")), 4), "part") == {0: 3, 1: 3, 2: 3, 3: 2}
    assert sizes(split.chunk_split(df, F.md5(F.col("i").cast("string")), 4), "chunk") == {0: 2, 1: 2, 2: 2, 3: 5}
    assert sizes(split.fraction_split(df, F.col("i"), 0.5), "part") == {"first": 5, "second": 6}
    with pytest.raises(ValueError):
        split.fraction_split(df, F.col("i"), 1.0)


@pytest.mark.parametrize("slots", [1, 3, 40])
def test_numbers_over_any_order(spark, slots):
    rng = random.Random(5)
    rows = [(i, rng.choice([1, 1, 1, 2, 30, 100, 1000]), rng.choice(["a", "B", "ä", ""]), None if i % 7 == 0 else rng.random()) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, k int, s string, x double")
    for order, key in ((("k", "i"), lambda r: (r[1], r[0])), (("s", "i"), lambda r: (r[2].encode(), r[0])), (("x", "i"), lambda r: (r[3] is not None, r[3] or 0, r[0]))):
        got = {r["i"]: (r["ix"], r["n"]) for r in numbered(df, F.struct(*order), total="n", slots=slots).collect()}
        assert got == {r[0]: (at, 300) for at, r in enumerate(sorted(rows, key=key))}
    plain = sorted(range(1, 301))
    parts = {r["i"]: r["part"] for r in split.even_split(spark.createDataFrame([(i,) for i in plain], "i int"), F.col("i"), 3).collect()}
    assert all(parts[i] == (i - 1) // 100 for i in plain)
    upto = {r["i"]: r["before"] for r in running(df, F.struct("k", "i"), F.col("k"), slots=slots).collect()}
    total = 0
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        assert upto[r[0]] == total
        total += r[1]
    assert numbered(df.limit(0), F.col("i")).count() == 0


def test_popularity_counts_training_only(spark):
    articles = spark.createDataFrame([("p",), ("q",), ("r",), ("s",)], "article_id string")
    rows = [(["p", "q", "r"], [0, 1, 1], "train"), (["q", "p"], [1, 0], "train"), (["s", "p"], [1, 1], "val"), (["s"], [1], "test")]
    imp = spark.createDataFrame(rows, "inview array<string>, labels array<int>, split string")
    got = {r["article_id"]: (r["n_inviews"], r["n_clicks"]) for r in popularity.train_popularity(articles, imp).collect()}
    assert got == {"p": (2, None), "q": (2, 2), "r": (1, 1), "s": (None, None)}


def test_item_popularity(spark):
    df = spark.createDataFrame([(["k", "m"],), (["m"],), (["m", "m", "n"],), ([],)], "x array<string>")
    got = {r["item"]: r["popularity"] for r in popularity.item_popularity(df, "x").collect()}
    assert got == {"k": 0.25, "m": 1.0, "n": 0.25}


def test_sort_based_score(spark):
    df = spark.createDataFrame([(1, 7), (2, 90), (3, 7), (4, 12)], "id int, views int")
    score = lambda **kw: {r["id"]: r["score"] for r in popularity.sort_based_score(df, "views", "id", **kw).collect()}
    assert score() == {2: 1.0, 4: 0.5, 1: pytest.approx(1 / 3), 3: 0.25}
    assert score(descending=False) == {1: 1.0, 3: 0.5, 4: pytest.approx(1 / 3), 2: 0.25}


def test_value_shares(spark):
    df = spark.createDataFrame([("x",)] * 5 + [("y",)] * 3 + [("z",)] * 2, "v string")
    got = [tuple(r) for r in popularity.value_shares(df, "v").orderBy("cumulative_share").collect()]
    assert got == [("x", 5, 0.5, 0.5), ("y", 3, 0.3, 0.8), ("z", 2, 0.2, 1.0)]


def test_as_of_history_is_strict(spark):
    imp = spark.createDataFrame([(1, "u", day(3)), (2, "u", day(1)), (3, "u", day(9)), (4, "w", day(5)), (5, "v", day(5)), (6, None, day(5))], "impression_row_id int, user_id string, impression_time timestamp")
    clicks = [("u", day(0), "k", 4), ("u", day(1), "l", 1), ("u", day(2), "m", 3), ("u", day(2), "n", 2), ("u", day(3), "o", 5), ("w", day(5), "p", 6), ("v", day(4), "q", 7), (None, day(1), "r", 8), ("u", None, "s", 9)]
    log = spark.createDataFrame(clicks, "user_id string, click_time timestamp, article_id string, seq int")
    long = history.as_of_history(imp, log, 3)
    assert long.filter("click_time >= impression_time or recency <= 0").count() == 0
    lists = {r["impression_row_id"]: r["history"] for r in history.history_lists(imp, long).collect()}
    # of equal times the lower seq is older
    assert lists == {1: ["l", "n", "m"], 2: ["k"], 3: ["n", "m", "o"], 4: [], 5: ["q"], 6: []}
    assert {r["__row"]: r["__n"] for r in history.clicks_before(imp, log).filter("__user is not null").collect()} == {1: 4, 2: 1, 3: 5, 4: 0, 5: 1}


def test_as_of_history_against_brute_force(spark):
    rng = random.Random(6)
    imp = [(i, rng.randrange(4), day(rng.randrange(12))) for i in range(60)]
    log = [(rng.randrange(4), day(rng.randrange(12)), 100 + k, k) for k in range(80)]
    long = history.as_of_history(spark.createDataFrame(imp, "impression_row_id int, user_id int, impression_time timestamp"), spark.createDataFrame(log, "user_id int, click_time timestamp, article_id int, seq int"), 4)
    got = sorted((r["impression_row_id"], r["pos"], r["article_id"]) for r in long.collect())
    want = []
    for i, u, t in imp:
        mine = sorted((c, s, a) for v, c, a, s in log if v == u and c < t)[-4:]
        want += [(i, p, a) for p, (_, _, a) in enumerate(mine)]
    assert got == sorted(want)


def test_fixed_and_dynamic_history(spark):
    rows = [(0, day(0), 1), (0, day(1), 2), (0, day(2), None), (0, day(3), 3), (1, day(0), 9)]
    df = spark.createDataFrame(rows, "user_id int, t timestamp, item int")
    fixed = {r["user_id"]: r["item_fixed"] for r in history.fixed_history(df, day(3), 2, "user_id", "t", "item").collect()}
    assert fixed == {0: [1, 2], 1: [9]}
    dynamic = [r["history"] for r in history.dynamic_history(df, 2, "user_id", "item", "t").orderBy("user_id", "t").collect()]
    assert dynamic == [[], [1], [1, 2], [2], []]


@pytest.mark.parametrize("timed", [True, False])
def test_histories_of_a_heavy_user(spark, timed):
    # user h holds half of all rows; some rows lack a user, a time or an item
    rng = random.Random(31)
    user = lambda: "h" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
    when = lambda: None if rng.random() < 0.05 else day(rng.randrange(4), 0) + dt.timedelta(minutes=10 * rng.randrange(120))
    imp = [(i, user(), when()) for i in range(300)]
    log = [(user(), when(), 1000 + k, k) for k in range(300)]
    known = sorted((t, k, u, a) for u, t, a, k in log if t is not None)
    impressions = spark.createDataFrame(imp, "impression_row_id int, user_id string, impression_time timestamp").repartition(5)
    clicks = spark.createDataFrame(log, "user_id string, click_time timestamp, article_id int, seq int").repartition(3)
    before = {i: [a for c, _, v, a in known if u is not None and v == u and t is not None and c < t] for i, u, t in imp}
    if timed:
        assert {r["__row"]: r["__n"] for r in history.clicks_before(impressions, clicks).collect()} == {i: len(x) for i, x in before.items()}
        long = history.as_of_history(impressions, clicks, 4)
        assert {r["impression_row_id"]: r["history"] for r in history.history_lists(impressions, long).collect()} == {i: x[-4:] for i, x in before.items()}
        # what meets in one task is a user's hour
        parts = history._log(impressions, clicks, "user_id", "impression_time", "impression_row_id", "click_time")
        assert parts.filter("__at is not null").groupBy("__user", "__slot").count().agg(F.max("count")).first()[0] < 30
    # rows of one user in an order of their own, by a time or by a number
    order_cols = ["t", "k"] if timed else ["k"]
    rows = [(u, t, None if k % 9 == 0 else a, k) for u, t, a, k in log]
    df = spark.createDataFrame(rows, "user_id string, t timestamp, item int, k int").repartition(4)
    first = (lambda r: (r[1] is not None, r[1] or day(0), r[3])) if timed else (lambda r: r[3])
    ordered = sorted(rows, key=first)
    for size in (1, 3):
        want = {r[3]: [x[2] for x in [o for o in ordered if o[0] == r[0] and first(o) < first(r)][-size:] if x[2] is not None] for r in rows}
        got = history.dynamic_history(df, size, "user_id", "item", *order_cols)
        assert got.columns == [*df.columns, "history"] and {r["k"]: r["history"] for r in got.collect()} == want
    assert history.dynamic_history(df.limit(0), 3, "user_id", "item", *order_cols).count() == 0
    fixed = {r["user_id"]: r["item_fixed"] for r in history.fixed_history(df, day(3), 3, "user_id", "t", "item", tie="k").collect()}
    old = [r for r in ordered if r[1] is not None and r[1] < day(3) and r[2] is not None] if timed else []
    assert not timed or fixed == {u: [r[2] for r in sorted(old, key=lambda r: (r[1], r[3])) if r[0] == u][-3:] for u in {r[0] for r in old}}


def test_map_list_ids(spark):
    df = spark.createDataFrame([(1, ["a", "z"]), (2, None), (3, [])], "row int, x array<string>")
    m = spark.createDataFrame([("a", "A")], "k string, v string")
    run = lambda **kw: {r["row"]: r["x"] for r in labelling.map_list_ids(df, "row", "x", m, "k", "v", **kw).collect()}
    assert run() == {1: ["A", None], 2: [None], 3: [None]}
    assert run(fill=F.lit("?")) == {1: ["A", "?"], 2: ["?"], 3: ["?"]}
    assert run(drop_nulls=True) == {1: ["A"], 2: None, 3: None}


def test_down_sample(spark):
    df = spark.createDataFrame([(u, i) for u, n in ((7, 5), (8, 3), (9, 1)) for i in range(n)], "u int, i int")
    got = sampling.down_sample(df, 3, "u", 1, "i")
    assert {r["u"]: r["n"] for r in got.groupBy("u").agg(F.count(F.lit(1)).alias("n")).collect()} == {7: 3, 8: 3, 9: 1}


def test_negative_samples(spark):
    df = spark.createDataFrame([(1, ["a", "b", "c"], ["b"]), (2, ["d"], ["d"])], "row int, inview array<string>, clicked array<string>")
    got = {r["row"]: r for r in sampling.negative_samples(df, 3, 1, "row").collect()}
    assert got[1]["inview"][-1] == "b" and set(got[1]["inview"][:3]) <= {"a", "c"} and len(got[1]["inview"]) == 4
    assert got[2]["inview"] is None and got[2]["clicked"] == ["d"]


def test_bm25_fill_and_empty_query(spark):
    docs = spark.createDataFrame([(0, "copper kettle"), (1, "iron stove"), (2, "kettle stove kettle"), (3, None)], "ix long, t string")
    queries = spark.createDataFrame([(1, "kettle"), (2, ""), (3, "the iron"), (4, None)], "q int, t string")
    index = bm25.build_index(docs, "ix", "t")
    got = bm25.search(index, queries, "q", "t", 4).orderBy("q", "rank").collect()
    ranked = {q: [r["doc_ix"] for r in got if r["q"] == q] for q in (1, 2, 3, 4)}
    assert ranked == {1: [2, 0, 1, 3], 2: [0, 1, 2, 3], 3: [1, 0, 2, 3], 4: [0, 1, 2, 3]}
    assert {q: sum(r["score"] > 0 for r in got if r["q"] == q) for q in ranked} == {1: 2, 2: 0, 3: 1, 4: 0}
    assert {(r["q"], r["doc_ix"]) for r in bm25.search(index, queries, "q", "t", 4, zero_fill=False).collect()} == {(1, 2), (1, 0), (3, 1)}


def test_bm25_index_as_tables(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 3} shared") for i in range(40)], "ix long, t string")
    queries = spark.createDataFrame([(1, "word3 shared"), (2, "word1")], "q int, t string")
    index = bm25.build_index(docs, "ix", "t")
    index.save(str(tmp_path))
    rows = lambda i: sorted(tuple(r) for r in bm25.search(i, queries, "q", "t", 12).collect())
    assert rows(bm25.load_index(spark, str(tmp_path))) == rows(index)
    index.release()


def test_bm25_scores_where_documents_lie(spark, monkeypatch):
    """Postings are not shuffled for a search, and the same rows come where too many terms are asked to be broadcast."""
    docs = spark.createDataFrame([(i, f"word{i % 7} word{i % 3} shared") for i in range(40)] + [(40, None), (None, "word1 alone")], "ix long, t string")
    queries = spark.createDataFrame([(1, "word3 shared"), (2, "word1"), (3, "alone")], "q int, t string")
    index = bm25.build_index(docs, "ix", "t")
    found = bm25.search(index, queries, "q", "t", 4, zero_fill=False)
    few = sorted((r["q"], r["rank"], r["doc_ix"], r["score"]) for r in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    above = plan[: plan.index("TableCacheQueryStage")]
    assert above.count("Exchange hashpartitioning(__row") == 1 and "doc_ix" not in "".join(x for x in above.splitlines() if "Exchange hash" in x)
    monkeypatch.setattr(bm25, "MOST_TERMS", 1)
    many = bm25.search(index, queries, "q", "t", 4, zero_fill=False).collect()
    assert sorted((r["q"], r["rank"], r["doc_ix"], r["score"]) for r in many) == few
    assert few[0][:3] == (1, 1, 3) and few[-1][:3] == (3, 1, None)
    assert index.docs.filter("dl = 0").count() == 2
    index.release()
    assert not any(df.is_cached for df in index.held)


def test_bm25_zero_fill_whole_queries(spark, tmp_path):
    docs = [(i, f"filler word{i}") for i in range(60)] + [(60, "needle")]
    items = [(1, "unmatched opening words, then a needle"), (2, "word7"), (3, "")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = plans.queries()["bm25_zero_fill"](spark, str(tmp_path)).orderBy("item_id", "rank").collect()
    ranked = {i: [r["doc_id"] for r in got if r["item_id"] == i] for i in (1, 2, 3)}
    assert ranked == {1: [60, *range(49)], 2: [7, *(i for i in range(50) if i != 7)], 3: list(range(50))}
    assert {r["item_id"] for r in got if r["score"] > 0} == {1, 2}


def test_recall(spark):
    df = spark.createDataFrame([(["k", "m", "k"], ["x", "k", "y", "m"]), ([], ["k"]), (["k"], [])], "g array<string>, c array<string>")
    assert [r[0] for r in df.select(bm25.recall(F.col("g"), F.col("c"), 3)).collect()] == [pytest.approx(2 / 3), 0.0, 0.0]


def test_recall_by_history(spark):
    rows = [("val", ["a"], ["a"], 0), ("val", ["a", "b"], ["b"], 2), ("val", ["z"], ["b"], None), ("val", [], ["b"], 5), ("test", ["q"], ["q"], 9)]
    df = spark.createDataFrame(rows, "split string, gt_clicked array<string>, candidates array<string>, n_history int")
    got = {(r["split"], r["slice"]): (r["n"], r["recall"]) for r in bm25.recall_by_history(df, 5).collect()}
    assert got == {("val", "cold"): (2, 0.5), ("val", "warm"): (1, 0.5), ("test", "cold"): (0, None), ("test", "warm"): (1, 1.0)}


def test_mean_pool(spark):
    v = spark.createDataFrame([("k", [3.0, 4.0]), ("l", [0.0, 8.0]), ("m", [-3.0, -4.0])], "item string, vector array<float>")
    items = spark.createDataFrame([(1, "k"), (1, "l"), (1, "absent"), (2, "k"), (2, "m"), (3, "absent"), (4, "l"), (4, "l")], "row int, item string")
    got = {r["row"]: r for r in vectors.mean_pool(items, v, "row", "item", "vector").collect()}
    size = math.hypot(1.5, 6.0)
    assert got[1]["vector"] == pytest.approx([1.5 / size, 6 / size]) and got[1]["n_used"] == 2
    assert got[2]["vector"] is None and got[2]["n_used"] == 2
    assert got[3]["vector"] is None and got[3]["n_used"] == 0
    assert got[4]["vector"] == [0.0, 1.0] and got[4]["n_used"] == 2
    raw = {r["row"]: r["vector"] for r in vectors.mean_pool(items, v, "row", "item", "vector", normalize=False).collect()}
    assert raw[1] == [1.5, 6.0] and raw[2] == [0.0, 0.0]
    assert vectors.mean_pool(items, v.limit(0), "row", "item", "vector").filter("vector is not null").count() == 0


def test_entity_mean(spark):
    v = spark.createDataFrame([("E7", [2.0, 2.0]), ("E8", [4.0, -2.0])], "e string, vector array<float>")
    a = spark.createDataFrame([("x", ["E7", "E8", "E9"]), ("y", ["E8", "E8"]), ("z", ["E9"]), ("w", [])], "article string, es array<string>")
    got = {r["article"]: r["vector"] for r in vectors.entity_mean(a, v, "article", "es", "e", "vector").collect()}
    assert got == {"x": [3.0, 0.0], "y": [4.0, -2.0]}


def test_vector_problems(spark):
    good = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "item string, vector array<float>")
    assert vectors.load_vectors(good, good.select("item"), "item", "vector").count() == 2
    for rows in ([("a", [1.0]), ("a", [2.0])], [("a", [1.0]), ("b", [1.0, 2.0])], [("a", [float("nan")])], [("a", [])]):
        with pytest.raises(ValueError):
            vectors.load_vectors(spark.createDataFrame(rows, "item string, vector array<float>"), good.select("item"), "item", "vector")


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_top_k_in_blocks(spark, block_bytes):
    rng = np.random.default_rng(0)
    m = rng.integers(-3, 4, size=(80, 3)).astype(float)  # many ties
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "item long, vector array<double>")
    q = v.filter("item < 20").withColumnRenamed("item", "q").unionByName(spark.createDataFrame([(99, None)], "q long, vector array<double>"))
    got = vectors.top_k(q, v, "q", "item", 5, block_bytes=block_bytes).collect()
    assert {r["q"] for r in got} == set(range(20))
    for i in range(20):
        s = np.round(m @ m[i], 6)
        want = sorted(range(80), key=lambda k: (-s[k], k))[:5]
        assert [r["item"] for r in sorted((r for r in got if r["q"] == i), key=lambda r: r["rank"])] == want
    assert vectors.top_k(q.limit(0), v, "q", "item", 5).count() == 0 and vectors.top_k(q, v.limit(0), "q", "item", 5).count() == 0


def ranked(spark, rows):
    return spark.createDataFrame(rows, "row_id int, score double, label int, rank int")


def test_accuracy(spark):
    rows = [(1, 1.0, 1, 1), (1, 1.0, 0, 2), (1, 0.0, 1, 3), (1, 0.0, 0, 4), (2, 2.0, 0, 1), (2, 1.0, 1, 2), (3, 1.0, 0, 1)]
    got = {r["row_id"]: r for r in evaluate.accuracy(ranked(spark, rows)).collect()}
    assert got[1]["auc"] == 0.5 and got[1]["mrr"] == 1.0
    assert got[2]["auc"] == 0.0 and got[2]["mrr"] == 0.5 and got[2]["ndcg_5"] == pytest.approx(1 / math.log2(3))
    assert got[3]["auc"] is None and got[3]["mrr"] is None and got[3]["ndcg_5"] is None


def test_inview_ranking_puts_retrieved_first(spark):
    shown = spark.createDataFrame([(1, i, x, 0) for i, x in enumerate("klmn")], "row_id int, pos int, item string, label int")
    cand = spark.createDataFrame([(1, "n", -5.0, 2), (1, "l", -5.0, 1), (1, "m", -9.0, 3), (2, "k", 1.0, 1)], "row_id int, item string, score double, rank int")
    got = ranking.rank_inview(shown, cand).orderBy("pos").collect()
    assert [r["score"] for r in got] == [0.0, -5.0, -9.0, -5.0]
    assert [r["rank"] for r in got] == [4, 1, 3, 2]


def test_diversity_and_novelty(spark):
    items = spark.createDataFrame([(1, "k", "red"), (1, "l", "red"), (1, "m", "red"), (1, "n", None), (2, "k", "red"), (3, "k", None), (3, "l", None)], "r int, item string, c string")
    # three of six pairs differ; the null category equals itself
    assert {r["r"]: r["ild"] for r in evaluate.category_diversity(items, "r", "c").collect()} == {1: 0.5, 2: 0.0, 3: 0.0}
    pop = spark.createDataFrame([("k", 0.125), ("l", 0.5)], "item string, p double")
    assert {r["r"]: r["novelty"] for r in evaluate.novelty(items, pop, "r", "item").collect()} == {1: 2.0, 2: 3.0, 3: 2.0}
    lists = spark.createDataFrame([(1, ["k", "l", "gone"]), (2, ["gone"]), (3, [])], "r int, x array<string>")
    assert {r["r"]: r["novelty"] for r in evaluate.list_novelty(lists, "x", pop, "r", "item").collect()} == {1: 2.0, 2: None, 3: None}


def test_toolbox_metrics(spark):
    # by score: a miss, a click, a miss, a click
    y, p = [1, 0, 1, 0], [0.6, 0.9, 0.2, 0.4]
    df = spark.createDataFrame([(1, i, a, b) for i, (a, b) in enumerate(zip(y, p, strict=True))], "r int, pos int, y int, p double")
    m = evaluate.toolbox_metrics(df, "r").first()
    assert m["auc"] == 0.25 and m["mrr"] == pytest.approx((1 / 2 + 1 / 4) / 2) and m["accuracy"] == 0.5 and m["f1"] == 0.5
    assert m["rmse"] == pytest.approx(math.sqrt((0.16 + 0.81 + 0.64 + 0.16) / 4))
    assert m["ndcg"] == pytest.approx((1 / math.log2(3) + 1 / math.log2(5)) / (1 + 1 / math.log2(3)))
    some = {r["metric"]: r["value"] for r in evaluate.metric_suite(df, "r", ["f1", "auc"]).collect()}
    assert some == {"f1": 0.5, "auc": 0.25}
    for bad in (["auc", "lift"], []):
        with pytest.raises(ValueError):
            evaluate.metric_suite(df, "r", bad)


def test_graded_gains(spark):
    rows = [(1, 0, 2, 0.1), (1, 1, 0, 0.9), (1, 2, 1, 0.9), (2, 0, 0, 0.5)]
    got = {r["r"]: r for r in evaluate.dcg(spark.createDataFrame(rows, "r int, pos int, y int, p double"), "r", 3).collect()}
    # of the two 0.9 the later comes first: gains 1, 0, 3
    assert got[1]["dcg"] == pytest.approx(1 + 3 / 2) and got[1]["ndcg"] == pytest.approx(2.5 / (3 + 1 / math.log2(3)))
    assert got[2]["dcg"] == 0 and got[2]["ndcg"] is None


def test_exact_search_holds_bounded_scores():
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(1200, 2)), rng.normal(size=(60_000, 2))])
    table = pa.table({"id": np.arange(len(x)), "vector": pa.array(list(x)), "asks": np.arange(len(x)) < 1200})
    tracemalloc.start()
    got = vectors._best(table, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 150 << 20
    best = np.argsort(-np.round(x[7] @ x[1200:].T, 6), kind="stable")[:3] + 1200
    assert got.slice(21, 3).column("item").to_pylist() == best.tolist()


def test_chunked_auc_goes_by_score(spark):
    """Chunks grow with the table, so that no window may hold one."""
    rng = random.Random(14)
    rows = [(i, int(rng.random() < 0.3), rng.choice([None, 0.1, 0.2, 0.2, 0.5, rng.random()])) for i in range(700)]
    got = evaluate.chunked_auc(spark.createDataFrame(rows, "i int, y int, p double").repartition(3), "i")
    n, aucs = sum(y for _, y, _ in rows), []
    for lo in range(0, 700, n):
        scored = [(-1 if p is None else p, y) for _, y, p in rows[lo : lo + n]]
        won = [(a > b) + (a == b) / 2 for a, y in scored if y for b, z in scored if not z]
        aucs += [sum(won) / len(won)] if won else []
    assert got.first()["auc"] == pytest.approx(np.mean(aucs))
    assert "rank(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_chunked_auc(spark):
    # two positives, so chunks of two: right, wrong, and a chunk without a positive
    rows = [(0, 1, 0.9), (1, 0, 0.1), (2, 1, 0.2), (3, 0, 0.3), (4, 0, 0.5), (5, 0, 0.5)]
    df = spark.createDataFrame(rows, "i int, y int, p double")
    assert evaluate.chunked_auc(df, "i").first()["auc"] == 0.5
    assert evaluate.chunked_auc(df.filter("y = 0"), "i").first()["auc"] is None


def test_list_means_and_shares(spark):
    lists = spark.createDataFrame([(1, ["k", "l"]), (2, ["l", "gone"]), (3, ["gone"])], "r int, x array<string>")
    scores = spark.createDataFrame([("k", 0.8), ("l", 0.2), ("m", 0.0)], "item string, s double")
    assert {r["r"]: r["mean"] for r in evaluate.list_mean(lists, "x", scores, "r", "item", "s").collect()} == {1: 0.5, 2: 0.2, 3: None}
    with pytest.raises(ValueError):
        evaluate.list_mean(lists, "x", scores, "r", "item", "mood")
    items = lists.select(F.explode("x").alias("item"))
    assert tuple(evaluate.distinct_share(items, "item", scores).first()) == (3, 1.0)
    assert evaluate.distinct_share(items, "item").first()["share"] == float("-inf")


def test_strict_auc_counts_ties_as_wrong(spark):
    df = spark.createDataFrame([(1, 0.5, 1), (1, 0.5, 0), (1, 0.1, 0)], "r int, p double, y int")
    assert evaluate.strict_auc(df, "r").first()["auc"] == 0.5


def test_dispersion(spark):
    rows = [(c,) for c, n in zip("xyz", (6, 3, 1), strict=True) for _ in range(n)]
    # 3 (100 - 46) / (100 * 2)
    assert evaluate.index_of_dispersion(spark.createDataFrame(rows, "c string"), "c").first()[0] == pytest.approx(0.81)
    assert evaluate.index_of_dispersion(spark.createDataFrame([("x",)] * 3, "c string"), "c").first()[0] == 0.0
    assert evaluate.index_of_dispersion(spark.createDataFrame([("x",)], "c string"), "c").first()[0] is None


def test_fusion_and_lines(spark):
    shown = spark.createDataFrame([("r7", i, x) for i, x in enumerate("klmno")], "row_id string, pos int, item string")
    a = spark.createDataFrame([("r7", "n", 7.0), ("r7", "l", 3.0), ("r7", "m", 5.0)], "row_id string, item string, score double")
    got = ranking.fuse(shown, {"a": (a, 0.5), "b": (a.limit(0), 0.5)})
    assert [r["fused"] for r in got.orderBy("pos").collect()] == [-1.0, -0.5, -0.25, 0.0, -1.0]
    assert [r["fused_rank"] for r in got.orderBy("pos").collect()] == [4, 3, 2, 1, 5]
    alone = ranking.fuse(shown, {"a": (a, 0.5)}, absent=0.5)
    assert [r["fused"] for r in alone.orderBy("pos").collect()] == [-1.0, -0.5, -0.25, 0.0, -1.0]
    lines = ranking.submission_lines(got.withColumn("name", F.col("row_id")), "row_id", "name").first()
    assert lines["line"] == "r7\t[4,3,2,1,5]"


def test_bootstrap(spark):
    values = np.arange(40) / 40
    full = np.random.default_rng(42).integers(0, 40, size=(300, 40))
    lo, hi = np.percentile(values[full].mean(axis=1), [2.5, 97.5])
    assert bootstrap.numpy_mean_ci(values, 300, 42, 7) == (values.mean(), lo, hi)
    df = spark.createDataFrame([("m", i, float(v)) for i, v in enumerate(values)], "g string, o int, v double")
    row = bootstrap.mean_ci(df, "g", "o", "v", 300).first()
    assert (row["ci_low"], row["ci_high"]) == (lo, hi)
    p = bootstrap.poisson_ci(df, "g", "o", "v", 300).first()
    assert abs(p["ci_low"] - lo) < 0.03 and abs(p["ci_high"] - hi) < 0.03
    assert bootstrap.numpy_mean_ci(np.array([])) == (None, None, None)


def test_bootstrap_in_stretches_and_blocks(spark):
    """Runs, blocks and stretches end at different places; groups are odd, empty and null."""
    rng = random.Random(3)
    rows = [("a", i, rng.random()) for i in range(1500)] + [("b", 5, 1.5), ("bare", 1, None)] + [(None, i if i else None, float(i)) for i in range(77)]
    df = spark.createDataFrame(rows, "g string, o int, v double").repartition(4)
    got = {r["g"]: tuple(r)[1:] for r in bootstrap.mean_ci(df, "g", "o", "v", 30, block_rows=400, stretch=998, parts=3).collect()}
    assert set(got) == {"a", "b", "bare", None} and got["bare"] == (None, None, None) and got["b"] == (1.5, 1.5, 1.5)
    assert got["a"] == pytest.approx(bootstrap.numpy_mean_ci(np.array([v for g, _, v in rows if g == "a"]), 30))
    assert got[None] == pytest.approx(bootstrap.numpy_mean_ci(np.array([*range(1, 77), 0.0]), 30))
    assert bootstrap.mean_ci(df.limit(0), "g", "o", "v", 30).count() == 0


def test_no_bootstrap_task_has_a_whole_group(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "numpy_mean_ci", None)  # the way of one task, which nothing may use
    df = spark.range(5000).select(F.lit("m").alias("g"), F.col("id").alias("o"), (F.col("id") % 7).cast("double").alias("v"))
    row = bootstrap.mean_ci(df, "g", "o", "v", 20, block_rows=1000, stretch=5000, parts=4).first()
    full = np.random.default_rng(42).integers(0, 5000, size=(20, 5000))
    assert (row["ci_low"], row["ci_high"]) == pytest.approx(tuple(np.percentile((full % 7).mean(axis=1), [2.5, 97.5])))


def test_poisson_intervals_equal_plain_resamples(spark):
    rng = random.Random(12)
    rows = [(f"g{rng.randrange(3)}", i, None if i % 7 == 0 else rng.random()) for i in range(90)] + [("bare", 200, None)]
    df = spark.createDataFrame(rows, "g string, row int, v double").repartition(5)
    once = df.withColumn("drawn", bootstrap.draws(F.col("row"), 70, 42))
    for got in (bootstrap.poisson_ci(df, "g", "row", "v", 70), bootstrap.poisson_ci(once, "g", "row", "v", 70, drawn="drawn")):
        found = {r["g"]: r for r in got.collect()}
        assert set(found) == {"g0", "g1", "g2"}
        for g, row in found.items():
            means = []
            for run in range(1, 71):
                drawn = [(sum(int(hashlib.md5(f"42|{i}|{run}".encode()).hexdigest()[:8], 16) / 2**32 >= s for s in bootstrap.poisson_steps()), v) for k, i, v in rows if k == g and v is not None]
                if sum(w for w, _ in drawn):
                    means.append(sum(w * v for w, v in drawn) / sum(w for w, _ in drawn))
            assert (row["ci_low"], row["ci_high"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    # as many groups as rows
    many = spark.range(100).select(F.col("id").alias("g"), "id", F.col("id").cast("double").alias("v"))
    assert all(r["g"] == r["value"] == r["ci_low"] == r["ci_high"] for r in bootstrap.poisson_ci(many, "g", "id", "v", 20).collect())
    assert bootstrap.poisson_ci(df.limit(0), "g", "row", "v", 20).count() == 0


def test_coverage_intervals_equal_plain_resamples(spark):
    rng = random.Random(8)
    rows = [(i, rng.randrange(12), "ab"[i % 2]) for i in range(30) for _ in range(3)]
    df = spark.createDataFrame(rows, "row int, item int, g string")
    got = {r["g"]: r for r in bootstrap.coverage_ci(df, "g", "row", "item", spark.range(1).select(F.lit(20).alias("size")), runs=70).collect()}
    for g in "ab":
        shares = []
        for run in range(1, 71):
            drawn = {i for i in range(30) if int(hashlib.md5(f"42|{i}|{run}".encode()).hexdigest()[:8], 16) / 2**32 >= math.exp(-1)}
            shares.append(len({x for i, x, k in rows if k == g and i in drawn}) / 20)
        assert (got[g]["ci_low"], got[g]["ci_high"]) == pytest.approx(tuple(np.percentile(shares, [2.5, 97.5])))
        assert got[g]["value"] == len({x for _, x, k in rows if k == g}) / 20


def test_evaluation_report(spark):
    rows = [(i, s, y, k) for i in range(8) for k, (s, y) in enumerate(((3.0, i % 2), (2.0, 1 - i % 2), (1.0, 0)), 1)]
    shown = ranked(spark, rows)
    cand = spark.createDataFrame([(i, x) for i in range(8) for x in ("k", "lm"[i % 2])], "row_id int, item string")
    catalog = spark.createDataFrame([("k", "c"), ("l", "d"), ("m", "d"), ("n", None)], "item string, category string")
    pop = spark.createDataFrame([("k", 0.5), ("l", 0.25), ("m", 0.25)], "item string, p double")
    sized = spark.createDataFrame([(i, 0 if i < 3 else 5) for i in range(8)], "row_id int, n_history int")
    got = {(r["slice"], r["metric"]): r for r in evaluate.evaluation_report(shown, sized, catalog, pop, cand, runs=40).collect()}
    plain = {r["slice"]: r for r in evaluate.evaluate(shown, sized, catalog, pop, cand).collect()}
    for part in ("all", "cold", "warm"):
        for m in ("auc", "mrr", "ndcg_5", "ndcg_10", "ild", "novelty"):
            row = got[part, m]
            assert row["value"] == pytest.approx(plain[part][m]) and row["ci_low"] <= row["value"] + 1e-9 and row["ci_high"] >= row["value"] - 1e-9
        assert got[part, "article_coverage"]["value"] == 0.75 and got[part, "category_coverage"]["value"] == pytest.approx(2 / 3)
        assert got[part, "article_coverage"]["ci_high"] <= 0.75
    assert got["cold", "auc"]["n"] == 3 and got["all", "article_coverage"]["n"] == 8


def test_frames(spark):
    df = spark.createDataFrame([(1, 5.0, "a", day(0)), (2, None, "", day(1)), (3, 9.0, None, day(1, 5)), (4, 2.0, "b", day(2))], "i int, x double, s string, t timestamp")
    ids = lambda d: sorted(r["i"] for r in d.collect())
    assert ids(frames.at_least(df, "x", 5)) == [1, 3] and ids(frames.at_least(df, "x", 0)) == ids(frames.at_least(df, "gone", 3)) == ids(frames.at_least(df, "x", None)) == [1, 2, 3, 4]
    assert ids(frames.with_text(df, "s")) == [1, 4]
    assert [ids(d) for d in frames.split_by(df, F.col("x") > 4)] == [[1, 3], [2, 4]]
    assert [ids(d) for d in frames.split_null(df, "s")] == [[3], [1, 2, 4]]
    assert [ids(d) for d in frames.last_days(df, "t")] == [[1], [2, 3, 4]] and [ids(d) for d in frames.last_days(df.limit(0), "t")] == [[], []]
    assert frames.rename_known(df, {"i": "j", "gone": "k"}).columns == ["j", "x", "s", "t"]
    stacked = frames.stack([df.select("i"), df.select("s")])
    assert stacked.columns == ["i", "s"] and stacked.filter("i is null").count() == 4
    assert ids(frames.repeat_rows(df, F.col("i") - 1)) == [2, 3, 3, 4, 4, 4]
    assert ids(frames.top_slate(df, "i", "x", 2)) == [1, 3]
    assert {r["keys"]: r["values"] for r in frames.from_pairs(spark, {"a": 1, "b": 2}).collect()} == {"a": 1, "b": 2} and frames.from_pairs(spark, {}).count() == 0
    some = frames.fraction(df, 0.5, 1, "i")
    assert some.count() == 2 and ids(some) == ids(frames.fraction(df, 0.5, 1, "i"))


def test_random_slates(spark):
    items = spark.createDataFrame([(i,) for i in range(12)], "item int")
    users = spark.createDataFrame([(f"u{i}",) for i in range(30)], "user string")
    got = {r["user"]: r["slate"] for r in frames.random_slates(items, "item", users, "user", 5, 3).collect()}
    assert len(got) == 30 and all(len(set(s)) == 5 for s in got.values()) and len({tuple(s) for s in got.values()}) > 3
    whole = frames.random_slates(items, "item", users, "user", 50, 3).first()["slate"]
    assert sorted(whole) == list(range(12))
    assert frames.random_slates(items.limit(0), "item", users, "user", 5, 3).first()["slate"] == []


def test_random_slates_are_near_chance(spark):
    items = spark.createDataFrame([(i,) for i in range(13)], "item int")
    users = spark.range(6500).select(F.col("id").alias("user"))
    got = [r["slate"] for r in frames.random_slates(items, "item", users, "user", 3, 3).collect()]
    firsts, pairs = Counter(s[0] for s in got), Counter((s[0], s[1]) for s in got)
    # 500 users a first item, 41.7 an ordered pair
    assert len(firsts) == 13 and all(400 < n < 600 for n in firsts.values())
    assert len(pairs) == 13 * 12 and sum((n - 6500 / 156) ** 2 for n in pairs.values()) / (6500 / 156) < 230
    assert len(Counter(map(tuple, got))) > 1600
    odd = spark.createDataFrame([(None,), ("a",), ("a",)], "user string")
    assert len(frames.random_slates(items, "item", odd, "user", 3, 3).collect()) == 2


@pytest.mark.parametrize("size", [1, 2, 3, 5, 12, 97, 1000])
def test_feistel_permutes(size):
    keys = np.random.default_rng(size).integers(0, 2**32, (frames.ROUNDS, 1)).repeat(size, axis=1)
    assert sorted(frames.feistel(np.arange(size), keys, size)) == list(range(size))


@pytest.mark.parametrize("slots", [1, 2, 3, 8, 50, 300])
def test_numbering_over_any_number_of_slots(spark, slots):
    rng = random.Random(slots)
    rows = [(None if i % 20 == 0 else rng.randrange(60), i, f"u{rng.randrange(5)}") for i in range(400)]
    df = spark.createDataFrame(rows, "k int, i int, u string").repartition(7)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    got = order.numbered(df, F.struct("k", "i"), slots=slots).collect()
    assert [r["i"] for r in sorted(got, key=lambda r: r["ix"])] == [r[1] for r in sorted(rows, key=key)]
    parts = order.slotted(df, F.col("k"), slots).select("k", "__slot").collect()
    # slots follow the order
    ends = sorted({(-1 if r["k"] is None else r["k"], r["__slot"]) for r in parts})
    assert [s for _, s in ends] == sorted(s for _, s in ends) and len({k for k, _ in ends}) == len(ends)
    assert order.numbered(df.limit(0), F.col("i"), slots=slots).count() == 0


def test_feature_tables(spark):
    imp = spark.createDataFrame([(1, "v", ["b", "zz"], ["a", "c"], [1, 0]), (2, "u", [], ["c"], [1]), (3, "u", None, ["q", "b"], [0, 1])], "row int, user_id string, history array<string>, inview array<string>, labels array<int>")
    articles = spark.createDataFrame([("c",), ("a",), ("b",)], "article_id string")
    table = features.feature_table(imp, articles, "row")
    got = {r["row"]: (r["user_ix"], r["hist_ix"], r["cand_ix"], r["labels"]) for r in table.collect()}
    assert got == {1: (1, [2, 0], [1, 3], [1, 0]), 2: (0, [], [3], [1]), 3: (0, [], [0, 2], [0, 1])}
    assert {r["row"]: r["hist_ix"] for r in features.feature_table(imp, articles, "row", drop_unknown=True).collect()} == {1: [2], 2: [], 3: []}
    assert {r["row"]: r["hist_ix"] for r in features.fixed_width(table, 3).collect()} == {1: [0, 2, 0], 2: [0, 0, 0], 3: [0, 0, 0]}
    flat = sorted((r["row"], r["pos"], r["cand_ix"], r["label"], r["hist_ix"]) for r in features.unrolled(table, "row", 1).collect())
    assert flat == [(1, 0, 1, 1, [0]), (1, 1, 3, 0, [0]), (2, 0, 3, 1, []), (3, 0, 0, 0, []), (3, 1, 2, 1, [])]


def test_validation(spark):
    imp = spark.createDataFrame([(1, ["a", "b"], [1, 0])], "impression_row_id int, inview array<string>, labels array<int>")
    catalog = spark.createDataFrame([("a",), ("b",)], "article_id string")
    schema = "impression_row_id int, split string, gt_clicked array<string>, candidates array<string>, scores array<double>"
    good = [(1, "val", ["a"], ["a", "b"], [1.0, 0.5])]
    validate.check_candidates(spark.createDataFrame(good, schema), imp, catalog, "val")
    bad = [good * 2, [(1, "test", ["a"], ["a"], [1.0])], [(1, "val", ["b"], ["a"], [1.0])], [(1, "val", ["a"], ["z"], [1.0])], [(1, "val", ["a"], ["a", "a"], [1.0, 1.0])], [(1, "val", ["a"], ["a"], [float("nan")])], [(1, "val", ["a"], ["a"], [])], [(9, "val", ["a"], ["a"], [1.0])]]
    for rows in bad:
        with pytest.raises(ValueError):
            validate.check_candidates(spark.createDataFrame(rows, schema), imp, catalog, "val")


def test_fair_rows(spark):
    a = spark.createDataFrame([(0, ["a"]), (1, ["a", "b"]), (2, ["d"]), (3, []), (4, ["a"])], "row int, gt array<string>")
    b = spark.createDataFrame([(0,), (1,), (2,), (3,)], "row int")
    covered = spark.createDataFrame([("a",), ("b",)], "item string")
    assert sorted(r["row"] for r in validate.fair_rows(a, b, covered, "row", "gt", "item").collect()) == [0, 1]


def test_md5_heads_equal_the_digests():
    keys = [b"42|7", b"42|8", b"42|123456789", b"42", b"x" * 52, b"x" * 53, b"y" * 70]
    want = [[int.from_bytes(hashlib.md5(k + b"|%d" % r).digest()[:4]) for r in range(1, 121)] for k in keys]
    assert bootstrap.md5_heads(keys, 120).tolist() == want


def test_histories_of_heavy_users_only(spark, monkeypatch):
    # users above HEAVY are cut into hours, the others are sorted whole; both give the same
    rng = random.Random(8)
    user = lambda: "h" if rng.random() < 0.5 else rng.choice(["a", "b", None])
    when = lambda: None if rng.random() < 0.05 else day(rng.randrange(4), 0) + dt.timedelta(minutes=10 * rng.randrange(120))
    imp = [(i, user(), when()) for i in range(200)]
    log = [(user(), when(), 1000 + k, k) for k in range(200)]
    impressions = spark.createDataFrame(imp, "impression_row_id int, user_id string, impression_time timestamp")
    clicks = spark.createDataFrame(log, "user_id string, click_time timestamp, article_id int, seq int")
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join")
    # no user is heavy here: the log is read once, and no row meets another by a join
    assert not joins(history.clicks_before(impressions, clicks)) and not joins(history.as_of_history(impressions, clicks, 3))
    rows = lambda: (sorted(map(str, history.clicks_before(impressions, clicks).collect())), sorted(map(str, history.as_of_history(impressions, clicks, 3).collect())), sorted(map(str, history.as_of_lists(impressions, clicks, 3).collect())))
    whole = rows()
    monkeypatch.setattr(history, "HEAVY", 120)
    assert joins(history.clicks_before(impressions, clicks)) and rows() == whole
    # and dealt by their number
    monkeypatch.setattr(order, "PART_ROWS", 10)
    assert rows() == whole


def test_report_reads_histories_once(spark, monkeypatch):
    # rows cross to the resample once: rows(...) is read by one job's tasks only
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda n: (seen.add(1), n)[1], "long")
    rows = spark.range(6).select(F.col("id").alias("row_id"), F.col("id").alias("n"))
    rows = rows.select("row_id", count("n").alias("n_history"))
    ranked = spark.createDataFrame([(i, 1, 0.5, i % 2, 1) for i in range(6)], "row_id long, item long, score double, label int, rank int")
    catalog, pop = spark.createDataFrame([(1, "c")], "item long, category string"), spark.createDataFrame([(1, 0.5)], "item long, p double")
    evaluate.evaluation_report(ranked, rows, catalog, pop, ranked.select("row_id", "item"), runs=5).collect()
    assert seen.value == 6


def test_shown_is_dealt_by_its_size(spark, monkeypatch):
    folder = "/root/testdata/sf0.001"
    lines = tables.read(spark, folder, "lineitem").count()
    monkeypatch.setattr(order, "PART_ROWS", 500)
    parts = tables.shown(spark, folder).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in parts) == lines and len(parts) > 6 and max(r["count"] for r in parts) < 1500


def test_toolbox_metrics_of_ties(spark):
    # of equal predictions the later place comes first, and they share their mean rank
    df = spark.createDataFrame([(1, 0, 1, 0.5), (1, 1, 0, 0.5), (1, 2, 1, 0.1)], "r int, pos int, y int, p double")
    m = evaluate.toolbox_metrics(df, "r").first()
    assert m["auc"] == 0.25 and m["mrr"] == pytest.approx((1 / 2 + 1 / 3) / 2)


def test_feature_table_reads_impressions_once(spark):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda n: (seen.add(1), n)[1], "long")
    imp = spark.range(5).select(count("id").alias("row"), F.col("id").alias("user_id"), F.array(F.col("id"), F.lit(None).cast("long")).alias("history"), F.when(F.col("id") != 4, F.array("id")).alias("inview"), F.array(F.lit(1)).alias("labels"))
    got = {r["row"]: r for r in features.feature_table(imp, spark.range(1, 5).withColumnRenamed("id", "article_id"), "row").collect()}
    assert seen.value == 5
    assert [got[i]["hist_ix"] for i in range(5)] == [[0, 0], [1, 0], [2, 0], [3, 0], [4, 0]]
    assert [got[i]["cand_ix"] for i in range(5)] == [[0], [1], [2], [3], [0]]
