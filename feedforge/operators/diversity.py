"""Diversity of lists of vectors in linear time, and its bounds over all lists that could be drawn.

The mean cosine distance between the vectors of a list, or of two lists, needs sums of unit vectors
alone: over the ordered pairs of n unit vectors with sum s the cosines add up to |s|^2 - n, and over
the pairs of two lists to s . t. A zero vector has distance 1 to every other and to itself, so it
counts in n and adds nothing to a sum.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.functions.scalars import combinations
from feedforge.operators.list_sums import Sums

#: Combinations above which bounds are estimated unless the caller asks for the exact form.
MOST = 20_000
#: Combinations that a task unranks at a time.
STEP = 4096


def among(sums: Sums) -> list[pa.Array]:
    """Mean cosine distance over the ordered pairs of each list's vectors; null under two of them."""
    n, total = sums.filled[:, 0].astype(float), sums.total[:, 0]
    # a zero vector's cosine with itself is no part of the sum, nor of what is taken off it
    cosines = (total * total).sum(1) - (n - sums.zero[:, 0])
    pairs = n * (n - 1)
    return [pa.array(1 - np.divide(cosines, pairs, out=np.zeros(len(n)), where=pairs > 0), mask=pairs == 0)]


def between(sums: Sums) -> list[pa.Array]:
    """Mean cosine distance between the vectors of each row's two lists; null where one has none."""
    pairs = sums.filled.astype(float).prod(1)
    cosines = (sums.total[:, 0] * sums.total[:, 1]).sum(1)
    return [pa.array(1 - np.divide(cosines, pairs, out=np.zeros(len(pairs)), where=pairs > 0), mask=pairs == 0)]


def unranked(ranks: np.ndarray, n: int, k: int) -> np.ndarray:
    """The k-subsets of range(n) with these ranks, a row each, members descending.

    By the combinatorial number system a subset c1 > ... > ck has the rank C(c1, k) + ... + C(ck, 1), so
    that any range of ranks can be worked on without those before it.
    """
    left, out = np.array(ranks, dtype=object if math.comb(n, k) >= 2**62 else np.int64), np.empty((len(ranks), k), np.int64)
    for j in range(k, 0, -1):
        table = np.array([math.comb(c, j) for c in range(n)], dtype=left.dtype)
        out[:, k - j] = np.searchsorted(table, left, "right") - 1
        left = left - table[out[:, k - j]]
    return out


def cosine_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 - cosine of every row of a with every row of b; 1 where either is zero."""
    u, v = (np.divide(x, n, out=np.zeros(x.shape), where=n > 0) for x in (a, b) for n in [np.linalg.norm(x, axis=1, keepdims=True)])
    return 1 - u @ v.T


def euclidean_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0))


def manhattan_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.abs(a[:, None] - b[None]).sum(2)


def _drawn(seed: str, number: int, n: int, k: int) -> np.ndarray:
    """The number-th draw of k different places out of n, the same wherever it is drawn."""
    return np.random.default_rng([number, *seed.encode()]).choice(n, k, replace=False)


Distance = Callable[[np.ndarray, np.ndarray], np.ndarray]


def diversity_bounds(items: DataFrame, row: str, k: int, item: str = "item", vector: str = "vector", distance: Distance = cosine_distances, most: int = MOST, exact: bool | None = None, seed: int = 0, step: int = STEP) -> DataFrame:
    """row, n, n_lists, exact, lowest, highest: the least and the greatest diversity of any k of a row's items.

    items has a row for each item with its vector. exact says whether all k-subsets are looked at or `most`
    draws of k different items; left out, draws are taken where there are more subsets than `most`. Spark
    ranges over the numbers of the subsets, or of the draws, a task a step of them: a row's items travel
    once for each step, its distances are found there, and each step gives back one row. A row with under
    k items has no bounds; k under two has none either. Distances may be any function of two matrices.
    """
    packed = items.filter(F.col(vector).isNotNull()).groupBy(row).agg(F.transform(F.array_sort(F.collect_list(F.struct(item, vector))), lambda s: s[vector].cast("array<double>")).alias("__vs"))
    sized = packed.withColumn("n", F.size("__vs").cast("long"))
    total = combinations(F.col("n"), k).cast("double")
    by_draws = F.lit(False) if exact else F.lit(True) if exact is False else total > most
    sized = sized.withColumn("exact", ~by_draws).withColumn("n_lists", F.when(F.col("exact"), F.round(total).cast("long")).otherwise(F.lit(most).cast("long")))
    possible = (F.col("n") >= k) & F.lit(k >= 2)
    steps = sized.filter(possible).withColumn("__from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_lists") - 1, F.lit(step).cast("long"))))
    dealt = steps.repartition(F.col(row), F.col("__from"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lows, highs = [], []
            for start, vs, n, all_of_them, count, key in zip(*(batch.column(c).to_pylist() for c in ("__from", "__vs", "n", "exact", "n_lists", row)), strict=True):
                d = distance(*[np.array(vs, float)] * 2)
                numbers = range(start, min(start + step, count))
                at = unranked(np.array(numbers), n, k) if all_of_them else np.array([_drawn(f"{seed}|{key}", i, n, k) for i in numbers])
                sums = np.zeros(len(at))
                for i in range(k):
                    for j in range(i):
                        sums += d[at[:, i], at[:, j]]
                scores = sums / (k * (k - 1) / 2)
                lows.append(float(scores.min()))
                highs.append(float(scores.max()))
            yield pa.record_batch([batch.column(row), pa.array(lows, pa.float64()), pa.array(highs, pa.float64())], names=[row, "lowest", "highest"])

    parts = dealt.mapInArrow(run, f"`{row}` {dict(items.dtypes)[row]}, lowest double, highest double")
    bounds = parts.groupBy(row).agg(F.min("lowest").alias("lowest"), F.max("highest").alias("highest"))
    facts = sized.select(row, "n", F.when(possible, F.col("n_lists")).otherwise(0).alias("n_lists"), F.when(possible, F.col("exact")).alias("exact"))
    return facts.join(bounds.withColumnRenamed(row, "__key"), facts[row].eqNullSafe(F.col("__key")), "left").drop("__key")
