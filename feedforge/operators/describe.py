"""Descriptive statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.operators.quantiles import quantiles


def describe(df: DataFrame, *cols: str) -> DataFrame:
    """metric, n, mean, std, low, q1, median, q3, high of numeric columns; the quartiles are exact and buffer no values."""
    each = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("x")) for c in cols])))
    sums = each.groupBy("metric").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("low"), F.max("x").alias("high"))
    found = [(m, *q) for m, q in quantiles(each, [0.25, 0.5, 0.75]).items()]
    cut = df.sparkSession.createDataFrame(found, "metric string, q1 double, median double, q3 double")
    return sums.join(F.broadcast(cut), "metric").select("metric", "n", "mean", "std", "low", "q1", "median", "q3", "high")


def distinct_counts(df: DataFrame, *cols: str) -> DataFrame:
    """column, n: different values, null among them."""
    parts = [df.select(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")).distinct() for c in cols]
    return reduce(DataFrame.unionAll, parts).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def overlap_ratio(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """One row: different values of a over those of a and b together."""
    left, both = a.select(col).distinct(), a.select(col).union(b.select(col)).distinct()
    return left.agg(F.count(F.lit(1)).alias("na")).crossJoin(both.agg(F.count(F.lit(1)).alias("nu"))).select((F.col("na") / F.col("nu")).alias("overlap"))


def first_in_group(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(key).agg(F.min_by(value, order).alias(value))


def time_bounds(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(col).alias("first"), F.max(col).alias("last"))


def list_time_bounds(df: DataFrame, col: str) -> DataFrame:
    return df.agg(F.min(F.array_min(col)).alias("first"), F.max(F.array_max(col)).alias("last"))


def max_scaled(df: DataFrame, col: str, name: str, floor: float = 1e-4) -> DataFrame:
    """A column x / max(x), at least `floor`; null counts as the floor."""
    top = df.agg(F.max(col).alias("__m"))
    return df.crossJoin(F.broadcast(top)).withColumn(name, F.greatest(F.coalesce(F.col(col) / F.col("__m"), F.lit(0.0)), F.lit(floor))).drop("__m")
