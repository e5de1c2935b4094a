"""Rankings of shown articles and rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_inview(shown: DataFrame, candidates: DataFrame, row: str = "row_id", item: str = "item", pos: str = "pos") -> DataFrame:
    """shown(row, pos, item, label) with score, retrieved and rank.

    Retrieved items come before all others whatever the sign of their score; among them the score,
    then the retrieval rank, then the place shown decide. Items not retrieved have score 0.
    """
    c = candidates.select(F.col(row).alias("__row"), F.col(item).alias("__item"), F.col("score").alias("__s"), F.col("rank").alias("__r"))
    joined = shown.join(c, (shown[row] == c["__row"]) & (shown[item] == c["__item"]), "left")
    scored = joined.withColumns({"retrieved": F.col("__s").isNotNull(), "score": F.coalesce("__s", F.lit(0.0))})
    w = Window.partitionBy(row).orderBy(F.desc("retrieved"), F.desc("score"), F.col("__r").asc_nulls_last(), pos)
    return scored.withColumn("rank", F.row_number().over(w)).drop("__row", "__item", "__s", "__r")


def min_max_component(candidates: DataFrame, row: str) -> DataFrame:
    """candidates with score scaled to 0..1 over all candidates of the row; an empty range gives 0."""
    w = Window.partitionBy(row)
    lo, hi = F.min("score").over(w), F.max("score").over(w)
    return candidates.withColumn("component", F.when(hi > lo, (F.col("score") - lo) / (hi - lo)).otherwise(0.0))


def fuse(shown: DataFrame, methods: dict[str, tuple[DataFrame, float]], row: str = "row_id", item: str = "item", pos: str = "pos", default: float = -1.0, absent: float = 0.0) -> DataFrame:
    """shown with fused score and rank: the weighted sum of each method's component, -1 where it lacks the item, and for the weight of absent methods."""
    out, total = shown, F.lit(absent * default)
    for name, (candidates, weight) in methods.items():
        c = min_max_component(candidates, row).select(F.col(row).alias(f"__row_{name}"), F.col(item).alias(f"__item_{name}"), F.col("component").alias(f"__{name}"))
        out = out.join(c, (out[row] == c[f"__row_{name}"]) & (out[item] == c[f"__item_{name}"]), "left").drop(f"__row_{name}", f"__item_{name}")
        total = total + weight * F.coalesce(f"__{name}", F.lit(default))
    w = Window.partitionBy(row).orderBy(F.desc("fused"), pos)
    return out.withColumn("fused", total).withColumn("fused_rank", F.row_number().over(w)).drop(*[f"__{m}" for m in methods])


def submission_lines(ranked: DataFrame, row: str, name: str, pos: str = "pos", rank: str = "fused_rank", fmt: str = "tsv") -> DataFrame:
    """A line for each row with shown items: its name and the ranks in the order shown."""
    ranks = F.transform(F.array_sort(F.collect_list(F.struct(pos, rank))), lambda s: s[rank].cast("string"))
    listed = F.concat(F.lit("["), F.array_join(ranks, ","), F.lit("]"))
    sep = {"tsv": "\t", "csv": ",", "space": " "}[fmt]
    return ranked.groupBy(row, name).agg(listed.alias("ranks")).select(row, F.concat(F.col(name).cast("string"), F.lit(sep), "ranks").alias("line"))


def average_tie_rank(score: str, *group: str) -> Column:
    """Ascending rank inside a group; equal scores share the mean of their ranks."""
    low = F.rank().over(Window.partitionBy(*group).orderBy(score))
    return low + (F.count(F.lit(1)).over(Window.partitionBy(*group, score)) - 1) / 2
