"""Popularity of articles from training impressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedforge.operators.order import running


def train_popularity(articles: DataFrame, impressions: DataFrame, article_id: str = "article_id") -> DataFrame:
    """articles with n_inviews and n_clicks, counted in the split "train" only; null where there are none."""
    shown = impressions.filter("split = 'train'").select(F.inline(F.arrays_zip(F.col("inview").alias("inview"), F.col("labels").alias("labels")))).toDF("__id", "label")
    stats = shown.groupBy("__id").agg(F.count(F.lit(1)).alias("n_inviews"), F.nullif(F.count_if(F.col("label") == 1), F.lit(0)).alias("n_clicks"))
    return articles.join(stats, articles[article_id] == stats["__id"], "left").drop("__id")


def smoothed_popularity(articles: DataFrame) -> DataFrame:
    """A column p: (pop + 1) over its sum in the whole catalog; pop is n_inviews, else n_clicks, else 0."""
    pop = F.coalesce(F.col("n_inviews"), F.col("n_clicks"), F.lit(0)).cast("double") + 1
    total = articles.agg(F.sum(pop).alias("__total"))
    return articles.crossJoin(F.broadcast(total)).withColumn("p", pop / F.col("__total")).drop("__total")


def item_popularity(lists: DataFrame, items: str) -> DataFrame:
    """item, popularity: occurrences over the number of lists."""
    n = lists.agg(F.count(F.lit(1)).alias("__n"))
    each = lists.select(F.explode(items).alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("__c"))
    return each.crossJoin(F.broadcast(n)).select("item", (F.col("__c") / F.col("__n")).alias("popularity"))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    """value, n, share and cumulative share, most frequent first."""
    counts = df.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    out = running(counts, F.struct(-F.col("n"), F.col("value")), F.col("n"), "__before", "__all_rows")
    return out.select("value", "n", (F.col("n") / F.col("__all_rows")).alias("share"), ((F.col("__before") + F.col("n")) / F.col("__all_rows")).alias("cumulative_share"))


def weighted_distribution(lists: DataFrame, items: str, weights: str | None = None) -> DataFrame:
    """value, weight: each list's elements weigh 1 / size or as given, and all weights sum to one a list's share."""
    weight = F.col(weights) if weights else F.transform(F.col(items), lambda _: 1 / F.size(items))
    each = lists.select(F.inline(F.arrays_zip(F.col(items).alias("value"), weight.alias("w"))))
    return each.toDF("value", "w").groupBy("value").agg(F.sum("w").alias("weight"))


def sort_based_score(df: DataFrame, col: str, key: str, descending: bool = True) -> DataFrame:
    """A column score: 1 over the rank in the whole table; equal values by key. Distinct values are ranked first."""
    values = df.groupBy(F.col(col).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    placed = running(values, F.col("__v"), F.col("__c"), "__under", "__all")
    before = F.col("__all") - F.col("__under") - F.col("__c") if descending else F.col("__under")
    inside = F.row_number().over(Window.partitionBy(col).orderBy(key))
    ranked = df.withColumn("__rn", inside).join(placed.select("__v", before.alias("__before")), F.col(col).eqNullSafe(F.col("__v")))
    return ranked.withColumn("score", 1 / (F.col("__rn") + F.col("__before"))).drop("__rn", "__v", "__before")
