"""Ranking metrics a row, their means by slice, and metrics beyond accuracy.

Undefined values are null and stay out of means: AUC with one class, MRR and nDCG without a click.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedforge.operators import bootstrap
from feedforge.operators.doc_vectors import kept
from feedforge.operators.order import numbered, slotted, within
from feedforge.operators.ranking import average_tie_rank

UNKNOWN = "__UNKNOWN__"


def _ideal(k: int, n: Column) -> Column:
    """Discounted gain of min(n, k) clicks in the first places."""
    return F.aggregate(F.transform(F.sequence(F.lit(1), F.least(n.cast("int"), F.lit(k))), lambda i: 1 / F.log2(i + 1.0)), F.lit(0.0), lambda a, b: a + b)


def accuracy(ranked: DataFrame, row: str = "row_id", ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """row, auc, mrr, ndcg_k for ranked(row, score, label, rank)."""
    tied = ranked.withColumn("__tr", average_tie_rank("score", row))
    label = F.col("label")
    pos, neg = F.sum(label), F.sum(1 - label)
    aggs = [
        ((F.sum(F.when(label == 1, F.col("__tr"))) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))).alias("auc"),
        (1 / F.min(F.when(label == 1, F.col("rank")))).alias("mrr"),
        pos.alias("n_pos"),
        *[F.sum(F.when((label == 1) & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}") for k in ks],
    ]
    rows = tied.groupBy(row).agg(*aggs)
    return rows.select(row, "auc", "mrr", *[F.when(F.col("n_pos") > 0, F.col(f"dcg_{k}") / _ideal(k, F.col("n_pos"))).alias(f"ndcg_{k}") for k in ks])


def category_diversity(items: DataFrame, row: str, category: str) -> DataFrame:
    """row, ild: share of pairs of a list's items with different categories; 0 under two items. Null is a category."""
    per = items.groupBy(row, F.coalesce(category, F.lit(UNKNOWN)).alias("__c")).agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    return per.groupBy(row).agg(F.when(n < 2, F.lit(0.0)).otherwise(1 - F.sum(F.col("n") * (F.col("n") - 1)) / (n * (n - 1))).alias("ild"))


def novelty(items: DataFrame, popularity: DataFrame, row: str, item: str) -> DataFrame:
    """row, novelty: mean -log2 p over the list's items with a popularity; 0 where there are none."""
    joined = items.join(popularity.select(F.col(item).alias("__i"), "p"), items[item] == F.col("__i"), "left")
    return joined.groupBy(row).agg(F.coalesce(F.avg(-F.log2("p")), F.lit(0.0)).alias("novelty"))


def coverage(items: DataFrame, catalog: DataFrame, item: str, category: str) -> DataFrame:
    """One row: shares of the catalog's articles and categories that were recommended."""
    cats = catalog.select(item, F.coalesce(category, F.lit(UNKNOWN)).alias("__cat"))
    size = cats.agg(F.count_distinct(item).alias("n"), F.count_distinct("__cat").alias("nc"))
    seen = items.select(item).distinct().join(cats, item, "left").agg(F.count_distinct(item).alias("s"), F.count_distinct("__cat").alias("sc"))
    return seen.crossJoin(size).select((F.col("s") / F.col("n")).alias("article_coverage"), (F.col("sc") / F.col("nc")).alias("category_coverage"))


def by_slice(rows: DataFrame, n_history: str, metrics: list[str]) -> DataFrame:
    """slice (all, cold, warm), n and the mean of each metric; cold rows have no history. One pass with grouping sets."""
    sliced = rows.withColumn("__s", F.when(F.coalesce(n_history, F.lit(0)) == 0, "cold").otherwise("warm"))
    grouped = sliced.groupingSets([[], [F.col("__s")]], F.col("__s")).agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(m) for m in metrics])
    return grouped.select(F.coalesce("__s", F.lit("all")).alias("slice"), "n", *metrics)


def evaluate(ranked: DataFrame, rows: DataFrame, catalog: DataFrame, popularity: DataFrame, candidates: DataFrame, row: str = "row_id", item: str = "item", category: str = "category") -> DataFrame:
    """A row of metrics for each slice. Accuracy counts rows with a click; diversity and novelty all rows of rows(row, n_history)."""
    acc = accuracy(ranked, row)
    listed = candidates.join(catalog.select(item, category), item, "left")
    wide = rows.join(acc, row, "left").join(category_diversity(listed, row, category), row, "left").join(novelty(candidates, popularity, row, item), row, "left")
    wide = wide.withColumns({"ild": F.coalesce("ild", F.lit(0.0)), "novelty": F.coalesce("novelty", F.lit(0.0))})
    return by_slice(wide, "n_history", ["auc", "mrr", "ndcg_5", "ndcg_10", "ild", "novelty"])


# metrics over predictions(row, pos, y, p), mean over rows


def toolbox_metrics(predictions: DataFrame, row: str, threshold: float = 0.5, k: int = 5) -> DataFrame:
    """One row: means over rows of AUC, MRR over all clicks, nDCG@k, log loss, RMSE, accuracy and F1."""
    # one order of a row's predictions gives its ranks from either end, those of ties and its size
    up = Window.partitionBy(row).orderBy("p", "pos")
    t = predictions.select(row, "pos", "y", "p", F.row_number().over(up).alias("__up"))
    alike = Window.partitionBy(row, "p")
    t = t.withColumns({"__low": F.min("__up").over(alike), "__ties": F.count(F.lit(1)).over(alike)}).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(row)))
    t = t.select(row, "pos", "y", "p", (F.col("__n") + 1 - F.col("__up")).alias("__rank"), (F.col("__low") + (F.col("__ties") - 1) / 2).alias("__tied"), (F.col("p") >= threshold).cast("int").alias("__hard"), F.greatest(F.least("p", F.lit(1 - 1e-11)), F.lit(1e-11)).alias("__clip"))
    y, n = F.col("y"), F.count(F.lit(1))
    pos = F.sum(y)
    true_pos = F.sum(y * F.col("__hard"))
    wi = Window.partitionBy(row).orderBy(F.desc("y"), "pos")
    t = t.withColumn("__ideal", F.row_number().over(wi))
    gain = lambda r: F.sum(F.when(F.col(r) <= k, (F.pow(F.lit(2.0), y) - 1) / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    per = t.groupBy(row).agg(
        ((F.sum(F.when(y == 1, F.col("__tied"))) - pos * (pos + 1) / 2) / F.nullif(pos * (n - pos), F.lit(0))).alias("auc"),
        (F.sum(y / F.col("__rank")) / F.nullif(pos, F.lit(0))).alias("mrr"),
        (gain("__rank") / F.nullif(gain("__ideal"), F.lit(0.0))).alias("ndcg"),
        F.avg(-(y * F.log("__clip") + (1 - y) * F.log(1 - F.col("__clip")))).alias("log_loss"),
        F.sqrt(F.avg(F.pow(y - F.col("p"), 2))).alias("rmse"),
        F.avg((y == F.col("__hard")).cast("int")).alias("accuracy"),
        F.coalesce(2 * true_pos / F.nullif(pos + F.sum("__hard"), F.lit(0)), F.lit(0.0)).alias("f1"),
    )
    return per.agg(*[F.avg(c).alias(c) for c in per.columns if c != row])


def reciprocal_rank(ranked: DataFrame, row: str) -> DataFrame:
    """row, rr: 1 over the rank of the first click; 1 where there is none, as the original has it."""
    return ranked.groupBy(row).agg(F.coalesce(1 / F.min(F.when(F.col("label") == 1, F.col("rank"))), F.lit(1.0)).alias("rr"))


def strict_auc(predictions: DataFrame, row: str) -> DataFrame:
    """row, auc: share of click and non-click pairs in the right order; ties count as wrong."""
    low = F.rank().over(Window.partitionBy(row).orderBy("p"))
    # a click beats the non-clicks under it: rows of lower score, less the clicks among them
    below = predictions.withColumn("__low", low)
    pos_below = F.coalesce(F.sum("y").over(Window.partitionBy(row).orderBy("p")) - F.sum("y").over(Window.partitionBy(row, "p")), F.lit(0))
    wins = below.withColumn("__wins", F.when(F.col("y") == 1, F.col("__low") - 1 - pos_below).otherwise(0))
    pos, n = F.sum("y"), F.count(F.lit(1))
    return wins.groupBy(row).agg((F.sum("__wins") / F.nullif(pos * (n - pos), F.lit(0))).alias("auc"))


def index_of_dispersion(df: DataFrame, col: str) -> DataFrame:
    """One row: k (N^2 - sum f^2) / (N^2 (k - 1)) over the k different values; 0 for one value, null for one item."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).cast("double").alias("f"))
    k, n, sq = F.count(F.lit(1)), F.sum("f"), F.sum(F.col("f") * F.col("f"))
    return counts.agg(F.when(n == 1, F.lit(None)).when(k == 1, F.lit(0.0)).otherwise(k * (n * n - sq) / F.nullif(n * n * (k - 1), F.lit(0.0))).alias("dispersion"))


def bounded_mean(df: DataFrame, value: str, n: int) -> DataFrame:
    """One row: means over the n smallest and the n largest values."""
    low = df.orderBy(F.asc(value)).limit(n).agg(F.avg(value).alias("lowest"))
    high = df.orderBy(F.desc(value)).limit(n).agg(F.avg(value).alias("highest"))
    return low.crossJoin(high)


def dcg(predictions: DataFrame, row: str, k: int) -> DataFrame:
    """row, dcg, ndcg of graded gains 2 ** y - 1; of equal predictions the later place comes first. ndcg is null where no gain is possible."""
    by_p, by_y = Window.partitionBy(row).orderBy(F.desc("p"), F.desc("pos")), Window.partitionBy(row).orderBy(F.desc("y"), "pos")
    ranked = predictions.withColumns({"__rank": F.row_number().over(by_p), "__ideal": F.row_number().over(by_y)})
    gain = lambda r: F.sum(F.when(F.col(r) <= k, (F.pow(F.lit(2.0), F.col("y")) - 1) / F.log2(F.col(r) + 1.0)).otherwise(0.0))
    per = ranked.groupBy(row).agg(gain("__rank").alias("dcg"), gain("__ideal").alias("__best"))
    return per.select(row, "dcg", (F.col("dcg") / F.nullif(F.col("__best"), F.lit(0.0))).alias("ndcg"))


#: Metrics that `metric_suite` knows.
SUITE = ("auc", "mrr", "ndcg", "log_loss", "rmse", "accuracy", "f1")


def metric_suite(predictions: DataFrame, row: str, metrics: list[str], threshold: float = 0.5, k: int = 5) -> DataFrame:
    """metric, value: the metrics asked for, in one pass over the predictions; an unknown name raises."""
    unknown = [m for m in metrics if m not in SUITE]
    if unknown or not metrics:
        raise ValueError(f"metrics are some of {SUITE}, not {unknown}")
    wide = toolbox_metrics(predictions, row, threshold, k)
    return wide.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in metrics])))


def chunked_auc(predictions: DataFrame, order: str, y: str = "y", p: str = "p") -> DataFrame:
    """One row, auc: mean AUC over consecutive chunks of a flat table, as long as it has positives; chunks of one class stay out.

    The length follows the original, which takes the number of positives for that of samples.
    """
    n = int(predictions.agg(F.sum(y)).first()[0] or 0)
    if not n:
        return predictions.limit(0).agg(F.lit(None).cast("double").alias("auc"))
    chunks = numbered(predictions, F.col(order), "__ix").withColumn("__chunk", F.floor(F.col("__ix") / n))
    # a chunk grows with the table: its rows go by score, and what lies below a score by stretches of the scores
    scores = chunks.groupBy("__chunk", p).agg(F.count(F.lit(1)).alias("__c"), F.count_if(F.col(y) == 1).alias("__ones"), F.sum(y).alias("__y"))
    placed = within(slotted(kept(scores), F.col(p)), "__chunk", F.col("__c"), "__below")
    pos, size, ones = F.sum("__y"), F.sum("__c"), F.sum("__ones")
    ranks = F.when(ones > 0, F.sum(F.col("__ones") * (F.col("__below") + (F.col("__c") + 1) / 2)))
    per = placed.groupBy("__chunk").agg(((ranks - pos * (pos + 1) / 2) / F.nullif(pos * (size - pos), F.lit(0))).alias("auc"))
    return per.agg(F.avg("auc").alias("auc"))


def list_mean(lists: DataFrame, items: str, scores: DataFrame, row: str, item: str, value: str) -> DataFrame:
    """row, mean: mean value (a sentiment, say) of each list's known items; null where none is known."""
    if value not in scores.columns:
        raise ValueError(f"{value} is not a column of the scores")
    each = lists.select(F.col(row).alias("__row"), F.explode(items).alias("__i"))
    known = each.join(scores.select(F.col(item).alias("__i"), F.col(value).cast("double").alias("__v")), "__i")
    means = known.groupBy("__row").agg(F.avg("__v").alias("mean"))
    return lists.select(row).join(means, lists[row] == F.col("__row"), "left").drop("__row")


def distinct_share(items: DataFrame, item: str, catalog: DataFrame | None = None) -> DataFrame:
    """One row, n and share: different items, and those over the catalog's; minus infinity without a catalog.

    The items are not cut to the catalog, so that the share may exceed one.
    """
    n = items.agg(F.count_distinct(item).alias("n"))
    if catalog is None:
        return n.select("n", F.lit(float("-inf")).alias("share"))
    size = catalog.agg(F.count_distinct(item).alias("__s"))
    return n.crossJoin(size).select("n", (F.col("n") / F.nullif(F.col("__s"), F.lit(0))).alias("share"))


def list_novelty(lists: DataFrame, items: str, popularity: DataFrame, row: str, item: str, p: str = "p") -> DataFrame:
    """row, novelty: mean -log2 p over each list's known items; null where none is known."""
    surprise = popularity.select(item, (-F.log2(p)).alias("__s"))
    return list_mean(lists, items, surprise, row, item, "__s").withColumnRenamed("mean", "novelty")


def evaluation_report(ranked: DataFrame, rows: DataFrame, catalog: DataFrame, popularity: DataFrame, candidates: DataFrame, runs: int = 200, seed: int = 42, row: str = "row_id", item: str = "item", category: str = "category") -> DataFrame:
    """slice, metric, n, value, ci_low, ci_high: every metric of all, cold and warm rows with an interval.

    Intervals come from Poisson resamples of the rows: those of means from weighted means, those of
    coverage from the union of the resampled rows' items. n counts the rows that a metric is defined on.
    """
    slices = F.when(F.coalesce("n_history", F.lit(0)) == 0, "cold").otherwise("warm").alias("slice")
    # a row's history is looked up once and a row draws once, for all its metrics and items
    once = kept(bootstrap.poisson_weights(rows.select(row, slices), row, runs, seed))
    # what is known of an item comes in one join; its popularity goes with the first of its rows in the catalog
    surprise = popularity.groupBy(F.col(item).alias("__p")).agg(F.sum(-F.log2("p")).alias("__s"), F.count(-F.log2("p")).alias("__c"))
    first = F.row_number().over(Window.partitionBy(item).orderBy(category)) == 1
    facts = catalog.select(F.col(item).alias("__k"), F.col(category), first.alias("__first")).join(surprise, F.col("__k") == F.col("__p"), "full")
    mine = lambda c: F.when(F.coalesce("__first", F.lit(True)), F.col(c)).alias(c)
    facts = facts.select(F.coalesce("__k", "__p").alias("__i"), F.coalesce(category, F.lit(UNKNOWN)).alias("__of"), mine("__s"), mine("__c"))
    known = candidates.select(row, item).join(facts, candidates[item] == F.col("__i"), "left")
    per = known.groupBy(row, F.coalesce("__of", F.lit(UNKNOWN)).alias("__of")).agg(F.count(F.lit(1)).alias("__n"), F.sum("__s").alias("__s"), F.sum("__c").alias("__c"))
    n, pairs = F.sum("__n"), F.sum(F.col("__n") * (F.col("__n") - 1))
    beyond = per.groupBy(row).agg(F.when(n < 2, F.lit(0.0)).otherwise(1 - pairs / (n * (n - 1))).alias("ild"), F.coalesce(F.sum("__s") / F.nullif(F.sum("__c"), F.lit(0)), F.lit(0.0)).alias("novelty"))
    wide = once.join(accuracy(ranked, row), row, "left").join(beyond, row, "left").withColumns({"ild": F.coalesce("ild", F.lit(0.0)), "novelty": F.coalesce("novelty", F.lit(0.0))})
    means = bootstrap.weighted_ci(wide, "slice", ["auc", "mrr", "ndcg_5", "ndcg_10", "ild", "novelty"], runs, "all")
    # categories are covered by their items
    words, every = -(-runs // 64), F.explode(F.array(F.lit("all"), "slice"))
    seen = kept(bootstrap.merged_draws(candidates.select(row, item).join(once.select(row, "slice", "__drawn"), row), "slice", item, words=words))
    seen = seen.withColumn("slice", every)
    kinds = seen.join(catalog.select(F.col(item).alias("__i"), category), seen[item] == F.col("__i"), "left").withColumn("__of", F.coalesce(F.col(category), F.lit(UNKNOWN)))
    of_all = F.coalesce(F.col(category), F.lit(UNKNOWN))
    cover = lambda name, items, of, size: bootstrap.covered_ci(bootstrap.merged_draws(items, "slice", of, words=words), "slice", size, runs).withColumn("metric", F.lit(name))
    covered = cover("article_coverage", seen, item, catalog.agg(F.count_distinct(item).alias("size"))).unionByName(cover("category_coverage", kinds, "__of", catalog.agg(F.count_distinct(of_all).alias("size"))))
    covered = covered.join(once.withColumn("slice", every).groupBy("slice").agg(F.count(F.lit(1)).alias("n")), "slice")
    return means.unionByName(covered).select("slice", "metric", "n", "value", "ci_low", "ci_high")
