"""Reproducible sampling: every choice follows a digest of seed and keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedforge.functions.lists import shuffled, without
from feedforge.functions.scalars import digest_order


def down_sample(df: DataFrame, n: int, user: str, seed: int, *keys: str) -> DataFrame:
    """At most n rows of each user."""
    w = Window.partitionBy(user).orderBy(digest_order(seed, *[F.col(k) for k in keys]), *keys)
    return df.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= n).drop("__rn")


def sample_list(c: Column, n: int, seed: int, key: Column, replacement: bool = False) -> Column:
    """n elements of a list; without replacement it must have as many."""
    if replacement:
        at = lambda i: F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("long"), F.size(c))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.get(c, at(i).cast("int")))
    short = F.raise_error(F.lit("a sample without replacement is larger than its list"))
    return F.when(F.size(c) < n, short).otherwise(F.slice(shuffled(c, F.lit(seed), key), 1, n))


def negative_samples(df: DataFrame, ratio: int, seed: int, row: str, inview: str = "inview", clicked: str = "clicked") -> DataFrame:
    """A row for each click: `ratio` sampled negatives with replacement, then the click itself; clicked is that click.

    Where nothing shown was left unclicked, the negatives are null.
    """
    negative = without(F.col(inview), F.col(clicked))
    each = df.withColumn("__neg", negative).withColumn("__click", F.explode(clicked))
    key = F.concat_ws("|", F.col(row).cast("string"), F.col("__click").cast("string"))
    drawn = F.when(F.size("__neg") > 0, sample_list(F.col("__neg"), ratio, seed, key, replacement=True))
    return each.withColumn(inview, F.concat(drawn, F.array("__click"))).withColumn(clicked, F.array("__click")).drop("__neg", "__click")


def shuffle_rows(df: DataFrame, seed: int, *keys: str) -> DataFrame:
    """Rows in an order that follows seed and keys."""
    return df.orderBy(digest_order(seed, *[F.col(k) for k in keys]), *keys)
