from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from feedforge.plans import stages
from feedforge.plans.stages import ROW, Settings


def at(day, hour=0):
    return dt.datetime(2023, 3, 1) + dt.timedelta(days=day, hours=hour)


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Write a table and read it, as stages hand them on."""
    folder = tmp_path_factory.mktemp("tables")

    def through(df, name):
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    return through


@pytest.fixture(scope="module")
def store(spark, kept):
    names = {"a": "cat mat", "b": "dog ball", "c": "cat nest", "d": "fish pond", "e": "bird song"}
    articles = spark.createDataFrame([(i, t, None, "pets" if i < "d" else None) for i, t in names.items()] + [("a", "late", None, "pets")], "article_id string, title string, abstract string, category string")
    sourced = articles.withColumn("source_ix", F.when(F.col("title") == "late", 1).otherwise(0))
    rows = [("i0", "u0", at(0), [], ["a", "b"], [1, 0]), ("i1", "u1", at(4), ["a"], ["c", "d"], [1, 0]), ("i1", "u2", at(6), [], ["b", "a"], [0, 1]), ("i2", "u1", at(6, 1), ["a", "zz"], ["d", "c", "b"], [0, 1, 0])]
    imp = spark.createDataFrame(rows, "impression_id string, user_id string, impression_time timestamp, history array<string>, inview array<string>, labels array<int>")
    a, i = stages.build_store(sourced, imp)
    return kept(a, "articles"), kept(i, "impressions")


@pytest.fixture(scope="module")
def embeddings(spark):
    return spark.createDataFrame([("a", [1.0, 0.0]), ("c", [0.9, 0.1]), ("d", [0.0, 1.0])], "article_id string, vector array<float>")


def test_store(store):
    articles, imp = store
    assert {r["article_id"]: (r["title"], r["doc_ix"], r["n_inviews"]) for r in articles.collect()}["a"] == ("cat mat", 0, 1)
    assert [(r[ROW], r["split"]) for r in imp.orderBy(ROW).collect()] == [(0, "train"), (1, "val"), (2, "test"), (3, "test")]


def test_retrieval_evaluation_and_predictions(store, embeddings, kept):
    articles, imp = store
    s = Settings(top_k=(1, 3), bootstrap_runs=50)
    lexical = kept(stages.run_bm25(articles, imp, ["test"], s), "lexical")
    rows = {r[ROW]: r for r in lexical.collect()}
    assert rows[3]["candidates"][:2] == ["a", "c"] and rows[3]["n_query_terms"] == 2
    assert rows[2]["candidates"] == ["a", "b", "c"] and rows[2]["scores"] == [0.0, 0.0, 0.0]  # a cold user
    semantic = kept(stages.run_semantic(articles, embeddings, imp, ["test"], s), "semantic")
    found = {r[ROW]: r for r in semantic.collect()}
    assert found[3]["candidates"] == ["a", "c", "d"] and (found[3]["n_history_used"], found[3]["n_history"]) == (1, 2)
    assert found[2]["candidates"] == []
    report = stages.recall_report(lexical, s.top_k).first()
    assert (report["n"], report["recall_3"]) == (2, 1.0)
    fair = {r["method"]: r["n"] for r in stages.compare_report(lexical, semantic, embeddings, s.top_k).collect()}
    assert fair == {"semantic": 2, "bm25": 2}
    metrics = {r["slice"]: r for r in stages.run_eval(lexical, imp, articles, "test").collect()}
    assert metrics["all"]["n"] == 2 and metrics["cold"]["n"] == 1 and metrics["warm"]["mrr"] == 1.0
    assert {r["metric"] for r in stages.metric_intervals(lexical, imp, s).collect()} == {"auc", "mrr", "ndcg_5", "ndcg_10"}
    with pytest.raises(ValueError):
        stages.run_eval(lexical, imp, articles, "train")
    lines = stages.run_predict(imp.filter("split = 'test'"), {"bm25": lexical, "semantic": semantic}, s)
    assert {r[ROW]: r["line"] for r in lines.collect()} == {2: "i1\t[1,2]", 3: "i2\t[2,1,3]"}
    # the lexical method alone: what it lacks and what the absent method would say weigh the same for all
    alone = stages.run_predict(imp.filter("split = 'test'"), {"semantic": semantic}, s)
    assert {r[ROW]: r["line"] for r in alone.collect()} == {2: "i1\t[1,2]", 3: "i2\t[2,1,3]"}
    halves = {(r["method"], r["slice"]): (r["n"], r["recall"]) for r in stages.cold_warm_report({"bm25": lexical, "semantic": semantic}, imp, 3).collect()}
    assert halves == {("bm25", "cold"): (1, 1.0), ("bm25", "warm"): (1, 1.0), ("semantic", "cold"): (1, 0.0), ("semantic", "warm"): (1, 1.0)}
    assert stages.repeated_ids(lines.withColumn("impression_id", F.lit("x"))).first()[0] == 1
