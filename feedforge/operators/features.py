"""Tables of integer features for neural rankers: users, histories and shown articles as row numbers of a lookup matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.functions.lists import tail
from feedforge.operators.doc_vectors import kept
from feedforge.operators.labelling import id_index


def article_numbers(articles: DataFrame, item: str) -> DataFrame:
    """item, ix: numbers from 1 in ascending order, as `labelling.lookup_with_unknown` has them; 0 is for unknown articles."""
    return id_index(articles.select(item), item).withColumn("ix", F.col("ix") + 1)


def feature_table(impressions: DataFrame, articles: DataFrame, row: str, user: str = "user_id", item: str = "article_id", history: str = "history", inview: str = "inview", labels: str = "labels", drop_unknown: bool = False) -> DataFrame:
    """row, user_ix, hist_ix, cand_ix, labels: ids replaced by their numbers; unknown articles are 0, or go from histories on request."""
    numbers = article_numbers(articles, item)
    impressions = kept(impressions.select(row, F.col(user).alias("__user"), F.col(history).alias("__past"), F.col(inview).alias("__seen"), F.col(labels).alias("__labels")))
    users = id_index(kept(impressions.select("__user").distinct()), "__user", "user_ix")
    # ids of both lists meet their numbers in one join and come back to their row in one
    places = lambda c, seen: F.transform(F.coalesce(c, F.array().cast(dict(impressions.dtypes)[c])), lambda x, i: F.struct(F.lit(seen).alias("seen"), i.alias("p"), x.alias("id")))
    each = impressions.select(F.col(row).alias("__row"), F.inline(F.concat(places("__past", False), places("__seen", True))))
    found = each.join(numbers.select(F.col(item).alias("__key"), "ix"), F.col("id") == F.col("__key"), "left")
    unknown = F.lit(0).cast("long")
    # unknown articles go from histories on request only
    place = F.struct("seen", "p", F.coalesce("ix", unknown).alias("ix"))
    listed = found.groupBy("__row").agg(F.sort_array(F.collect_list(F.when(F.col("seen") | F.col("ix").isNotNull(), place) if drop_unknown else place)).alias("__all"))
    side = lambda seen: F.transform(F.filter(F.coalesce("__all", F.array().cast(dict(listed.dtypes)["__all"])), lambda s: s["seen"] == F.lit(seen)), lambda s: s["ix"])
    joined = impressions.select(row, "__user", "__labels").join(users, "__user").join(listed, F.col(row) == F.col("__row"), "left")
    shown = side(True)
    # an empty or missing list of shown articles is one unknown
    return joined.select(row, "user_ix", side(False).alias("hist_ix"), F.when(F.size(shown) > 0, shown).otherwise(F.array(unknown)).alias("cand_ix"), F.col("__labels").alias(labels))


def fixed_width(features: DataFrame, size: int) -> DataFrame:
    """Training form: histories of exactly `size` numbers, the last ones, zeros before them where there are fewer."""
    padded = F.slice(F.concat(F.array_repeat(F.lit(0).cast("long"), size), F.col("hist_ix")), -size, size)
    return features.withColumn("hist_ix", padded)


def unrolled(features: DataFrame, row: str, size: int | None = None) -> DataFrame:
    """Scoring form: a row for each shown article with its place, number and label, and the history beside it."""
    past = tail(F.col("hist_ix"), size) if size else F.col("hist_ix")
    each = F.arrays_zip("cand_ix", "labels")
    return features.select(row, "user_ix", past.alias("hist_ix"), F.posexplode(each).alias("pos", "__z")).select(row, "pos", "user_ix", "hist_ix", F.col("__z")["cand_ix"].alias("cand_ix"), F.col("__z")["labels"].alias("label"))
