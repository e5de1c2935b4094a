"""Running sums and numbers over a global order that never pass the whole table through one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled values a slot, from which the slots' bounds are taken.
PER_SLOT = 20
#: Rows of a part of a table that is dealt by its size.
PART_ROWS = 1 << 19


def dealt(df: DataFrame, rows: int, *keys: str, always: bool = False) -> DataFrame:
    """df of so many rows by its keys, in more parts than the session has where these would be large; else as it is, or always."""
    parts = -(-rows // PART_ROWS)
    if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartition(parts, *keys)
    return df.repartition(*keys) if always else df


def slotted(df: DataFrame, order: Column, slots: int | None = None) -> DataFrame:
    """df with __o, the order, and __slot, a range of it; null orders come first.

    The bounds are quantiles of a sample of a fixed number of rows: they decide how even the slots are
    and nothing else. They are taken once, when the plan is made, and stay as they are wherever the
    rows are planned or computed again. Orders of any type that can be compared will do, structs among
    them; an order that ends in a unique key parts equal values as well.
    """
    slots = slots or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keyed = df.withColumn("__o", order)
    known = keyed.select("__o").filter("__o is not null")
    share = min(1.0, slots * PER_SLOT / max(known.count(), 1))
    few = known.sample(share, seed=1).orderBy("__o").limit(4 * slots * PER_SLOT).agg(F.sort_array(F.collect_list("__o")).alias("all"))
    at = F.array(*[F.floor(F.size("all") * i / slots).cast("int") for i in range(1, slots)])
    bounds = few.select(F.array_distinct(F.array_compact(F.transform(at, lambda i: F.get("all", i)))).alias("__bounds"))
    # at most slots - 1 values of the order, in stretches of about the root of their number
    fixed = df.sparkSession.createDataFrame(bounds.toArrow(), bounds.schema)
    stretch = max(1, math.isqrt(slots))
    starts = F.expr(f"filter(sequence(1, greatest(size(__bounds), 1), {stretch}), i -> i <= size(__bounds))")
    levels = fixed.select(F.transform(starts, lambda i: F.get("__bounds", i - 1)).alias("__heads"), F.transform(starts, lambda i: F.slice("__bounds", i, F.lit(stretch))).alias("__parts"))
    below = lambda bounds: F.coalesce(F.size(F.filter(bounds, lambda b: b < F.col("__o"))), F.lit(0))
    # the stretch whose head is the last one below the order holds the last bound below it, too
    part = keyed.crossJoin(F.broadcast(levels)).withColumn("__at", below("__heads") - 1)
    slot = F.when(F.col("__at") < 0, 0).otherwise(F.col("__at") * stretch + below(F.get("__parts", "__at")))
    return part.withColumn("__slot", F.when(F.col("__o").isNull(), -1).otherwise(slot)).drop("__heads", "__parts", "__at")


def running(df: DataFrame, order: Column, weight: Column | None = None, name: str = "before", total: str | None = None, slots: int | None = None) -> DataFrame:
    """A column with the weight (or number) of all rows before this one, and on request one with that of all rows.

    Sums restart in each slot and are lifted by the sums of the slots before, a row a slot.
    """
    part = slotted(df, order, slots).withColumn("__w", F.lit(1).cast("long") if weight is None else weight)
    sums = part.groupBy("__slot").agg(F.sum("__w").alias("__s"))
    upto = F.sum("__s").over(Window.orderBy("__slot"))
    lift = sums.select(F.col("__slot").alias("__k"), (upto - F.col("__s")).alias("__lift"), F.sum("__s").over(Window.partitionBy(F.lit(0))).alias("__total"))
    inside = F.sum("__w").over(Window.partitionBy("__slot").orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__w")
    out = part.withColumn("__in", inside).join(F.broadcast(lift), F.col("__slot") == F.col("__k")).withColumn(name, F.col("__in") + F.col("__lift"))
    out = out.withColumn(total, F.col("__total")) if total else out
    return out.drop("__o", "__slot", "__w", "__in", "__k", "__lift", "__total")


def numbered(df: DataFrame, order: Column, name: str = "ix", total: str | None = None, slots: int | None = None) -> DataFrame:
    """A column with 0-based row numbers in ascending order; rows with equal orders are numbered in any way."""
    return running(df, order, None, name, total, slots)


def within(rows: DataFrame, group: str, weight: Column | None = None, name: str = "before") -> DataFrame:
    """A column with the weight (or number) of the rows of its group before this one.

    rows has the order in __o and a stretch of it in __slot, which is never null, so that a group of
    any size lies in as many slots as it spans. Sums restart in each slot of a group and are lifted by
    the group's slots before, a row each; both sides are dealt by slot and group. Rows of the group
    null have none before them.
    """
    rows = rows.withColumn("__w", F.lit(1).cast("long") if weight is None else weight.cast("long"))
    here = Window.partitionBy("__slot", group).orderBy("__o").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(group).orderBy("__slot").rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.filter(F.col(group).isNotNull()).groupBy("__slot", group).agg(F.sum("__w").alias("__s"))
    lift = sums.select("__slot", group, (F.sum("__s").over(earlier) - F.col("__s")).alias("__lift"))
    out = rows.withColumn("__in", F.sum("__w").over(here) - F.col("__w")).join(lift, ["__slot", group], "left")
    before = F.when(F.col(group).isNull(), F.lit(0).cast("long")).otherwise(F.col("__in") + F.col("__lift"))
    return out.withColumn(name, before).drop("__w", "__in", "__lift")
