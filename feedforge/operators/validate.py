"""Invariants of candidate tables, each a count of violations in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.functions.lists import clicked_of


def candidate_problems(cand: DataFrame, impressions: DataFrame, catalog: DataFrame, split: str, row: str = "impression_row_id", item: str = "article_id") -> DataFrame:
    """One row of violation counts of cand(row, split, gt_clicked, candidates, scores)."""
    inner = cand.agg(
        (F.count(F.lit(1)) - F.count_distinct(row)).alias("repeated_rows"),
        F.count_if(~F.col("split").eqNullSafe(F.lit(split))).alias("other_split"),
        F.count_if(~F.size("candidates").eqNullSafe(F.size("scores"))).alias("unequal_lengths"),
        F.count_if(F.size("candidates") != F.size(F.array_distinct("candidates"))).alias("repeated_candidates"),
        F.count_if(F.exists("scores", lambda s: s.isNull() | F.isnan(s) | (F.abs(s) == float("inf")))).alias("scores_not_finite"),
    )
    known = cand.select(F.explode("candidates").alias("__i")).distinct().join(catalog.select(F.col(item).alias("__i")), "__i", "left_anti")
    outside = known.agg(F.count(F.lit(1)).alias("outside_catalog"))
    truth = impressions.select(F.col(row).alias("__row"), clicked_of(F.col("inview"), F.col("labels")).alias("__gt"))
    both = cand.join(truth, cand[row] == F.col("__row"), "left").agg(
        F.count_if(F.col("__row").isNull()).alias("unknown_rows"), F.count_if(F.col("__row").isNotNull() & ~F.col("gt_clicked").eqNullSafe(F.col("__gt"))).alias("other_truth")
    )
    return inner.crossJoin(outside).crossJoin(both)


def check_candidates(*args, **kwargs) -> None:  # noqa: ANN002, ANN003
    """Raise ValueError if any invariant is violated."""
    found = candidate_problems(*args, **kwargs).first().asDict()
    if any(found.values()):
        raise ValueError(f"invalid candidates: { {k: v for k, v in found.items() if v} }")


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def unequal_lengths(df: DataFrame, *cols: str) -> DataFrame:
    """One row: rows whose list columns differ in length."""
    first, *rest = cols
    bad = F.lit(False)
    for c in rest:
        bad = bad | ~F.size(first).eqNullSafe(F.size(c))
    return df.agg(F.count_if(bad).alias("n"))


def fair_rows(a: DataFrame, b: DataFrame, covered: DataFrame, row: str, gt: str, item: str) -> DataFrame:
    """Rows in both tables whose ground truth is not empty and lies wholly in the covered set."""
    both = a.filter(F.size(gt) > 0).join(b.select(row), row, "left_semi")
    missing = both.select(row, F.explode(gt).alias("__i")).join(covered.select(F.col(item).alias("__i")), "__i", "left_anti").select(row).distinct()
    return both.join(missing, row, "left_anti")
