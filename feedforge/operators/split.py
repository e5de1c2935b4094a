"""Row numbers over a global order, temporal splits and partitions of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedforge.operators.order import numbered, running


def with_row_index(df: DataFrame, time_col: str, *ties: str, name: str = "row_index") -> DataFrame:
    """0-based row numbers by time and ties, of any kind and however many rows share a day or a time."""
    return numbered(df, F.struct(F.col(time_col), *[F.col(t) for t in ties]), name)


def temporal_split(df: DataFrame, time_col: str, val_days: int = 2, test_days: int = 2, ratios: tuple[float, float, float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """A column split: test and val are the last days, bounds included; all else is train.

    Where val or test would be empty, rows go by their share instead: a time's last row index over
    the number of rows decides, so that equal times are never parted. The bounds are found first,
    from one table of the times and their rows, so that the column compares with constants and can be pushed down.
    """
    t, kind = F.col(time_col), dict(df.dtypes)[time_col]
    times = df.groupBy(t.alias("__t")).agg(F.count(F.lit(1)).alias("__c")).persist()
    last, at = F.max("__t"), F.col("__t")
    ends = times.agg(*[(last - F.make_dt_interval(F.lit(n))).cast("string") for n in (test_days, val_days + test_days)]).first()
    test, val = (F.lit(e).cast(kind) for e in ends)
    some = lambda c: F.coalesce(F.sum(F.when(c, F.col("__c"))), F.lit(0))
    n, n_val, n_test = times.agg(some(F.lit(True)), some((at >= val) & (at < test)), some(at >= test)).first()
    times.unpersist()
    if n_val and n_test or not n:
        return df.withColumn("split", F.when(t >= test, "test").when(t >= val, "val").otherwise("train"))
    place = running(times, F.col("__t"), F.col("__c"), "__g").select("__t", (F.col("__g") + F.col("__c") - 1).alias("__g"))
    share = F.col("__g") / F.lit(n)
    by_share = F.when(share < ratios[0], "train").when(share < ratios[0] + ratios[1], "val").otherwise("test")
    return df.join(place, t == F.col("__t"), "left").withColumn("split", by_share).drop("__t", "__g")


def split_counts(df: DataFrame) -> DataFrame:
    """Rows of each split, zero for absent ones."""
    n = lambda s: F.count_if(F.col("split") == s).alias(f"n_{s}")
    return df.agg(n("train"), n("val"), n("test"))


def fraction_split(df: DataFrame, order: Column, fraction: float) -> DataFrame:
    """A column part: "first" for exactly int(n * fraction) rows by the order given, "second" for the rest."""
    if not 0 < fraction < 1:
        raise ValueError("the fraction lies between 0 and 1")
    return numbered(df, order, "__ix", "__n").withColumn("part", F.when(F.col("__ix") < F.floor(F.col("__n") * fraction), "first").otherwise("second")).drop("__ix", "__n")


def chunk_split(df: DataFrame, order: Column, n: int) -> DataFrame:
    """A column chunk: n parts of equal size, the remainder in the last."""
    size = F.floor(F.col("__n") / n)
    chunk = F.when(size > 0, F.least(F.floor(F.col("__ix") / size), F.lit(n - 1))).otherwise(n - 1)
    return numbered(df, order, "__ix", "__n").withColumn("chunk", chunk.cast("long")).drop("__ix", "__n")


def even_split(df: DataFrame, order: Column, k: int) -> DataFrame:
    """A column part: k parts of ceil(n / k) rows; the last may be short or absent."""
    return numbered(df, order, "__ix", "__n").withColumn("part", F.floor(F.col("__ix") / F.ceil(F.col("__n") / k)).cast("long")).drop("__ix", "__n")
