"""Labels, memberships, mappings and deduplication."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedforge.operators.order import numbered


def filter_min_length(df: DataFrame, col: str, n: int | None) -> DataFrame:
    """Rows whose list has n elements or more; no filter without n or the column."""
    return df.filter(F.size(col) >= n) if n and n > 0 and col in df.columns else df


def filter_max_length(df: DataFrame, col: str, n: int | None) -> DataFrame:
    return df.filter(F.size(col) <= n) if n and n > 0 and col in df.columns else df


def filter_min_negatives(df: DataFrame, n: int, inview: str = "inview", clicked: str = "clicked") -> DataFrame:
    """Rows with at least n elements that were shown and not clicked."""
    return df.filter(F.size(inview) - F.size(clicked) >= n)


def known_users(df: DataFrame, known: DataFrame, user: str = "user_id") -> DataFrame:
    """A column is_known_user."""
    ids = known.select(F.col(user).alias("__u")).distinct()
    return df.join(ids, df[user] == F.col("__u"), "left").withColumn("is_known_user", F.col("__u").isNotNull()).drop("__u")


def unique_ids(df: DataFrame, *cols: str) -> DataFrame:
    """Distinct non-null ids of scalar and list columns."""
    kinds = dict(df.dtypes)
    parts = [df.select((F.explode(c) if kinds[c].startswith("array") else F.col(c)).alias("id")) for c in cols]
    return reduce(DataFrame.unionAll, parts).filter("id is not null").distinct()


def id_index(df: DataFrame, col: str, name: str = "ix") -> DataFrame:
    """Distinct ids with 0-based numbers in ascending order."""
    return numbered(df.select(col).distinct(), F.col(col), name)


def map_list_ids(df: DataFrame, row: str, col: str, mapping: DataFrame, key: str, value: str, fill: Column | None = None, drop_nulls: bool = False) -> DataFrame:
    """The list column with each id replaced by its value in a table, in order.

    An unknown id gives null, the fill value or nothing; a null list gives [fill] or [null], or null when nulls are dropped.
    """
    each = df.select(F.col(row).alias("__row"), F.posexplode_outer(col).alias("__pos", "__id"))
    found = each.join(mapping.select(F.col(key).alias("__key"), F.col(value).alias("__v")), F.col("__id") == F.col("__key"), "left")
    v = F.coalesce(F.col("__v"), fill) if fill is not None else F.col("__v")
    listed = found.groupBy("__row").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("__pos", F.lit(0)).alias("p"), v.alias("v")))), lambda s: s["v"]).alias("__l"))
    out = F.when(F.size(F.array_compact("__l")) > 0, F.array_compact("__l")) if drop_nulls else F.col("__l")
    return df.join(listed, df[row] == F.col("__row"), "left").withColumn(col, out).drop("__row", "__l")


def attach_scores(df: DataFrame, scores: DataFrame, row: str, value: str = "score", pos: str = "pos") -> DataFrame:
    """A list column of flat scores (row, pos, score), nested again in order."""
    lists = scores.groupBy(F.col(row).alias("__row")).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, value))), lambda s: s[value]).alias("scores"))
    return df.join(lists, df[row] == F.col("__row"), "left").drop("__row")


def dedup_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key by an explicit order."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def conflicting_keys(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one different value."""
    return df.select(key, value).distinct().groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def lookup_with_unknown(df: DataFrame, key: str, vector: str, unknown: str = "zeros") -> DataFrame:
    """ix, key, vector: numbers from 1 in ascending key order; row 0 stands for unknown keys, as zeros or the mean."""
    if unknown not in ("zeros", "mean"):
        raise ValueError("the unknown vector is zeros or mean")
    rows = id_index(df, key).join(df.select(key, vector), key).select((F.col("ix") + 1).alias("ix"), key, F.col(vector).cast("array<double>").alias(vector))
    cell = F.avg("x") if unknown == "mean" else F.avg(F.lit(0.0))
    zero = df.select(F.posexplode(vector).alias("p", "x")).groupBy("p").agg(cell.alias("x")).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "x"))), lambda s: s["x"]).alias(vector))
    return zero.select(F.lit(0).cast("long").alias("ix"), F.lit(None).cast(dict(df.dtypes)[key]).alias(key), vector).unionByName(rows)
