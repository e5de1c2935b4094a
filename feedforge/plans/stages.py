"""The stages of a recommendation run: feature store, retrieval, evaluation and predictions.

Stages exchange tables: candidates(impression_row_id, impression_id, split, gt_clicked, candidates,
scores, n_query_terms or n_history_used and n_history), one folder a method and split.
"""

from __future__ import annotations

import dataclasses
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.functions.lists import clicked_of
from feedforge.functions.text import corpus_text, tokens
from feedforge.operators import bm25, bootstrap, evaluate, labelling, popularity, ranking, split, validate, vectors

ROW = "impression_row_id"


@dataclass(frozen=True)
class Settings:
    """Defaults of a run."""

    val_days: int = 2
    test_days: int = 2
    ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)
    top_k: tuple[int, ...] = (50, 100, 200)
    field: str = "title_abstract"
    query_field: str = "title"
    query_cap: int = 20
    k1: float = 1.5
    b: float = 0.75
    remove_stopwords: bool = True
    normalize: bool = True
    bootstrap_runs: int = 1000
    bootstrap_seed: int = 42
    weights: dict[str, float] = dataclasses.field(default_factory=lambda: {"bm25": 0.5, "semantic": 0.5})


def build_store(articles: DataFrame, impressions: DataFrame, s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """articles with doc_ix and training popularity, impressions with row ids and splits.

    Articles that come twice keep their first row by source_ix (0 where the column is missing).
    """
    sourced = articles if "source_ix" in articles.columns else articles.withColumn("source_ix", F.lit(0))
    unique = labelling.dedup_first(sourced, "article_id", "source_ix").drop("source_ix")
    indexed = unique.join(labelling.id_index(unique, "article_id", "doc_ix"), "article_id")
    numbered = split.with_row_index(impressions, "impression_time", "impression_id", "user_id", name=ROW)
    dated = split.temporal_split(numbered, "impression_time", s.val_days, s.test_days, s.ratios)
    return popularity.train_popularity(indexed, dated), dated


def _of_splits(impressions: DataFrame, splits: list[str], limit: int | None) -> DataFrame:
    chosen = impressions.filter(F.col("split").isin(splits))
    return chosen.orderBy(ROW).limit(limit) if limit else chosen


def _listed(found: DataFrame, item: str, rows: DataFrame, extra: list[str]) -> DataFrame:
    lists = found.groupBy(ROW).agg(F.array_sort(F.collect_list(F.struct("rank", item, "score"))).alias("__s"))
    empty = F.array().cast("array<string>")
    joined = rows.join(lists, ROW, "left")
    return joined.select(
        ROW,
        "impression_id",
        "split",
        clicked_of(F.col("inview"), F.col("labels")).alias("gt_clicked"),
        F.coalesce(F.transform("__s", lambda x: x[item]), empty).alias("candidates"),
        F.coalesce(F.transform("__s", lambda x: x["score"]), F.array().cast("array<double>")).alias("scores"),
        *extra,
    )


def run_bm25(articles: DataFrame, impressions: DataFrame, splits: list[str], s: Settings = Settings(), limit: int | None = None) -> DataFrame:
    """Candidates by BM25 of the last clicks' texts; cold users get the first articles with score 0."""
    if min(s.top_k) < 1:
        raise ValueError("top_k is positive")
    rows = _of_splits(impressions, splits, limit)
    corpus = articles.select("doc_ix", "article_id", corpus_text(F.col("title"), F.col("abstract"), s.field).alias("text"))
    index = bm25.build_index(corpus, "doc_ix", "text", s.k1, s.b, remove_stopwords=s.remove_stopwords)
    named = articles.select("article_id", corpus_text(F.col("title"), F.col("abstract"), s.query_field).alias("text"))
    clicks = rows.select(ROW, F.posexplode("history").alias("pos", "article_id"))
    queries = rows.select(ROW).join(bm25.history_queries(clicks, named, s.query_cap, ROW, "article_id", "text"), ROW, "left").select(ROW, F.coalesce("query", F.lit("")).alias("query"))
    found = bm25.search(index, queries, ROW, "query", max(s.top_k), s.remove_stopwords).join(articles.select("doc_ix", "article_id"), "doc_ix")
    counted = rows.join(queries.select(ROW, F.size(tokens(F.col("query"), s.remove_stopwords)).alias("n_query_terms")), ROW)
    return _listed(found, "article_id", counted, ["n_query_terms"])


def run_semantic(articles: DataFrame, embeddings: DataFrame, impressions: DataFrame, splits: list[str], s: Settings = Settings(), limit: int | None = None) -> DataFrame:
    """Candidates by inner product with the mean of the history's vectors; cold users get none."""
    rows = _of_splits(impressions, splits, limit)
    known = vectors.load_vectors(embeddings, articles, "article_id", "vector")
    indexed = known.join(articles.select("article_id", "doc_ix"), "article_id").select("article_id", "doc_ix", "vector")
    items = (vectors.normalized(indexed, "vector") if s.normalize else indexed).select("doc_ix", "vector")
    clicks = rows.select(ROW, F.explode("history").alias("article_id"))
    pooled = vectors.mean_pool(clicks, known, ROW, "article_id", "vector", s.normalize)
    found = vectors.top_k(pooled, items, ROW, "doc_ix", max(s.top_k)).join(articles.select("doc_ix", "article_id"), "doc_ix")
    counted = rows.join(pooled.select(ROW, F.col("n_used").alias("n_history_used")), ROW, "left").withColumns({"n_history_used": F.coalesce("n_history_used", F.lit(0)), "n_history": F.size("history")})
    return _listed(found, "article_id", counted, ["n_history_used", "n_history"])


def recall_report(candidates: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """split, n and mean recall at each k over rows with a click, to four places."""
    asked = candidates.filter(F.size("gt_clicked") > 0)
    means = [F.round(F.avg(bm25.recall(F.col("gt_clicked"), F.col("candidates"), k)), 4).alias(f"recall_{k}") for k in ks]
    return asked.groupBy("split").agg(F.count(F.lit(1)).alias("n"), *means)


def cold_warm_report(candidates: dict[str, DataFrame], impressions: DataFrame, k: int) -> DataFrame:
    """method, split, slice, n, recall at k by whether a row had a history; methods without its length get it from the impressions."""
    out = None
    for method, found in candidates.items():
        sized = found if "n_history" in found.columns else bm25.with_history_length(found, impressions, ROW)
        part = bm25.recall_by_history(sized, k).withColumn("method", F.lit(method))
        out = part if out is None else out.unionByName(part)
    return out


def compare_report(lexical: DataFrame, semantic: DataFrame, embeddings: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Recall of both methods over the rows that both can answer."""
    a = validate.fair_rows(semantic, lexical, embeddings, ROW, "gt_clicked", "article_id")
    b = lexical.join(a.select(ROW), ROW, "left_semi")
    named = lambda df, m: recall_report(df, ks).withColumn("method", F.lit(m))
    return named(a, "semantic").unionByName(named(b, "bm25"))


def _long(candidates: DataFrame) -> DataFrame:
    each = candidates.select(ROW, F.posexplode(F.arrays_zip("candidates", "scores")).alias("p", "z"))
    return each.select(ROW, F.col("z")["candidates"].alias("article_id"), F.col("z")["scores"].alias("score"), (F.col("p") + 1).alias("rank"))


def run_eval(candidates: DataFrame, impressions: DataFrame, articles: DataFrame, of_split: str, limit: int | None = None, runs: int = 0, seed: int = 42) -> DataFrame:
    """A row of metrics for all, cold and warm rows, after the invariants are checked; with runs, a row a metric with its interval."""
    cand = candidates.filter(F.col("split") == of_split)
    cand = cand.orderBy(ROW).limit(limit) if limit else cand
    if cand.isEmpty():
        raise ValueError(f"no candidates of split {of_split}")
    validate.check_candidates(cand, impressions, articles, of_split)
    rows = impressions.join(cand.select(ROW), ROW, "left_semi")
    z = F.arrays_zip("inview", "labels")
    shown = rows.select(ROW, F.posexplode(z).alias("pos", "z")).select(ROW, "pos", F.col("z")["inview"].alias("article_id"), F.col("z")["labels"].alias("label"))
    long = _long(cand)
    ranked = ranking.rank_inview(shown, long, ROW, "article_id")
    pop = popularity.smoothed_popularity(articles)
    sized = rows.select(ROW, F.size(F.coalesce("history", F.array().cast("array<string>"))).alias("n_history"))
    if runs:
        return evaluate.evaluation_report(ranked, sized, articles, pop, long, runs, seed, ROW, "article_id", "category")
    return evaluate.evaluate(ranked, sized, articles, pop, long, ROW, "article_id", "category")


def metric_intervals(candidates: DataFrame, impressions: DataFrame, s: Settings = Settings()) -> DataFrame:
    """metric, value, ci_low, ci_high of the accuracy metrics, with numpy's resamples for the seed."""
    z = F.arrays_zip("inview", "labels")
    rows = impressions.join(candidates.select(ROW), ROW, "left_semi")
    shown = rows.select(ROW, F.posexplode(z).alias("pos", "z")).select(ROW, "pos", F.col("z")["inview"].alias("article_id"), F.col("z")["labels"].alias("label"))
    acc = evaluate.accuracy(ranking.rank_inview(shown, _long(candidates), ROW, "article_id"), ROW)
    names = ["auc", "mrr", "ndcg_5", "ndcg_10"]
    long = acc.select(ROW, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in names])))
    return bootstrap.mean_ci(long, "metric", ROW, "value", s.bootstrap_runs, s.bootstrap_seed)


def run_predict(impressions: DataFrame, methods: dict[str, DataFrame], s: Settings = Settings(), fmt: str = "tsv") -> DataFrame:
    """impression_row_id and a line of ranks for each impression with shown articles."""
    shown = impressions.select(ROW, "impression_id", F.posexplode("inview").alias("pos", "article_id"))
    # an article shown twice has one score
    scored = {m: (_long(df).groupBy(ROW, "article_id").agg(F.max("score").alias("score")), s.weights.get(m, 0.5)) for m, df in methods.items()}
    # a method that is weighted but absent lacks every article
    absent = sum(w for m, w in s.weights.items() if m not in methods)
    fused = ranking.fuse(shown, scored, ROW, "article_id", absent=absent)
    return ranking.submission_lines(fused, ROW, "impression_id", fmt=fmt)


def repeated_ids(lines: DataFrame, name: str = "impression_id") -> DataFrame:
    """One row: lines beyond the first of each name."""
    return lines.groupBy(name).agg(F.count(F.lit(1)).alias("__n")).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("n_repeated"))
