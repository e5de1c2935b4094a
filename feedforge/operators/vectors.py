"""Vector tables: checks, pooling and exact search."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from feedforge.functions.lists import dot, norm, once
from feedforge.operators import diversity
from feedforge.operators.list_sums import Sums, folded


#: Scores that a task of an exact search holds at a time.
SCORES = 1 << 22


def vector_problems(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """One row of counts: vectors, missing, empty, of other sizes, not finite, and repeated keys."""
    bad = F.exists(F.col(vector), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col(vector).isNull()).alias("n_missing"),
        F.count_if(F.size(vector) == 0).alias("n_empty"),
        (F.max(F.size(vector)) - F.min(F.size(vector))).alias("size_spread"),
        F.count_if(bad).alias("n_not_finite"),
        (F.count(F.lit(1)) - F.count_distinct(key)).alias("n_repeated"),
    )


def load_vectors(vectors: DataFrame, catalog: DataFrame, key: str, vector: str) -> DataFrame:
    """Vectors of catalog articles, after validation; raises on any problem."""
    p = vector_problems(vectors, key, vector).first()
    if p["n"] == 0 or any(p[c] for c in ("n_missing", "n_empty", "size_spread", "n_not_finite", "n_repeated")):
        raise ValueError(f"unusable vectors: {p.asDict()}")
    return vectors.join(catalog.select(key).distinct(), key, "left_semi")


def normalized(vectors: DataFrame, vector: str) -> DataFrame:
    """Unit vectors; a zero vector stays."""
    scaled = lambda n: F.when(n > 0, F.transform(vector, lambda x: x / n)).otherwise(F.transform(vector, lambda x: x.cast("double")))
    return vectors.withColumn(vector, once(norm(F.col(vector)), scaled))


def mean_pool(items: DataFrame, vectors: DataFrame, row: str, item: str, vector: str, normalize: bool = True) -> DataFrame:
    """row, n_used, vector: the mean of raw vectors of each row's items; repeats count, uncovered items are skipped.

    The mean is null where nothing is covered, or where it is zero and a unit vector is asked for.
    """
    joined = items.select(F.col(row).alias("__row"), item).join(vectors, item)
    # sums a place of the vector, so that rows need not be exploded; all vectors are as wide as any one
    any_ = vectors.filter(F.col(vector).isNotNull()).select(F.size(vector).alias("n")).first()
    width = any_["n"] if any_ else 0
    cells = [F.avg(F.get(F.col(vector), i).cast("double")).alias(f"__{i}") for i in range(width)]
    pooled = joined.groupBy("__row").agg(F.count(F.lit(1)).alias("n_used"), *cells).select("__row", "n_used", F.array(*[f"__{i}" for i in range(width)]).cast("array<double>").alias("vector"))
    if normalize:
        pooled = pooled.withColumn("vector", once(norm(F.col("vector")), lambda n: F.when(n > 0, F.transform("vector", lambda x: x / n))))
    rows = items.select(F.col(row).alias("__row")).distinct()
    return rows.join(pooled, "__row", "left").select(F.col("__row").alias(row), F.coalesce("n_used", F.lit(0)).alias("n_used"), "vector")


def _means(sums: Sums, normalize: bool) -> list[pa.Array]:
    n, total, cells = sums.n[:, 0], sums.total[:, 0], sums.cells[:, 0]
    mean = np.divide(total, cells, out=np.zeros(total.shape), where=cells > 0)
    absent = cells == 0
    null = sums.filled[:, 0] == 0
    if normalize:
        size = np.sqrt((mean * mean).sum(1))
        # a place without a value leaves the length unknown; NaN is greater than 0 in Spark
        null |= absent.any(1) | (size == 0)
        mean = np.divide(mean, size[:, None], out=mean, where=~null[:, None])
    flat = pa.array(mean.ravel(), mask=absent.ravel()) if absent.any() else pa.array(mean.ravel())
    ends = pa.array(np.arange(0, mean.size + 1, mean.shape[1] or 1, np.int32)) if mean.shape[1] else pa.array(np.zeros(len(mean) + 1, np.int32))
    return [pa.array(n), pa.ListArray.from_arrays(ends, flat, mask=pa.array(null))]


def pool_lists(lists: DataFrame, vectors: DataFrame, row: str, items: str, item: str, vector: str, normalize: bool = True) -> DataFrame:
    """row, n_used, vector: `mean_pool` of the items of a list a row; rows differ, and all of them are returned."""
    return folded(lists, vectors, row, [items], item, vector, False, partial(_means, normalize=normalize), "n_used long, vector array<double>")


def _best(table: pa.Table, k: int) -> pa.Table:
    """The k best items of a block for each query of a block."""
    asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    ids = table.column("id").to_numpy()
    out: dict[str, list] = {"row": [], "item": [], "score": []}
    if asks.any() and not asks.all():
        flat = table.column("vector").combine_chunks()
        m = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(ids), -1)
        rows, items = ids[asks], ids[~asks]
        by_id = np.argsort(items, kind="stable")
        items, mine, asked = items[by_id], m[np.flatnonzero(~asks)[by_id]], np.flatnonzero(asks)
        # as many queries at a time as SCORES allow, whatever the block of items
        step = max(1, SCORES // len(items))
        for lo in range(0, len(rows), step):
            scores = m[asked[lo : lo + step]] @ mine.T
            np.round(scores, 6, out=scores)
            for r, s in zip(rows[lo : lo + step].tolist(), scores, strict=True):
                # all that reach the k-th score, so that ties go by item
                near = np.flatnonzero(s >= np.partition(s, -k)[-k]) if len(s) > k else np.arange(len(s))
                best = near[np.argsort(-s[near], kind="stable")][:k]
                out["row"] += [r] * len(best)
                out["item"] += items[best].tolist()
                out["score"] += s[best].tolist()
    return pa.table({"row": pa.array(out["row"], pa.int64()), "item": pa.array(out["item"], pa.int64()), "score": pa.array(out["score"], pa.float64())})


def top_k(queries: DataFrame, items: DataFrame, row: str, item: str, k: int, block_bytes: int = 32 << 20) -> DataFrame:
    """row, item, score, rank: the k greatest inner products of each query's vector, equal ones by item.

    Queries and items are dealt into blocks of about `block_bytes`; a task multiplies two blocks and
    keeps k rows a query, and the rows of all blocks are ranked again. Only counts reach the driver.
    """
    asked = queries.filter("vector is not null").select(F.col(row).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    known = items.select(F.col(item).cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    size = lambda df: df.agg((F.coalesce(F.sum(F.size("vector")), F.lit(0)) * 8).alias("n")).first()["n"]
    b_left, b_right = (max(1, -(-size(df) // block_bytes)) for df in (asked, known))
    of = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("id", "vector", F.lit(True).alias("asks"), of(b_left).alias("a"), each(b_right).alias("b"))
    right = known.select("id", "vector", F.lit(False).alias("asks"), of(b_right).alias("b"), each(b_left).alias("a"))
    parts = left.unionByName(right).groupBy("a", "b").applyInArrow(lambda t: _best(t, k), "row long, item long, score double")
    w = Window.partitionBy("row").orderBy(F.desc("score"), "item")
    return parts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).withColumnsRenamed({"row": row, "item": item})


def pairwise_distance(lists: DataFrame, vectors: DataFrame, row: str, items: str, item: str) -> DataFrame:
    """row, diversity: mean cosine distance over pairs of each list's known items; null under two of them."""
    return folded(lists, vectors, row, [items], item, "vector", True, diversity.among, "diversity double")


def serendipity(lists: DataFrame, vectors: DataFrame, row: str, recommended: str, history: str, item: str) -> DataFrame:
    """row, serendipity: mean cosine distance between known recommended and known history items; null if either is empty."""
    return folded(lists, vectors, row, [recommended, history], item, "vector", True, diversity.between, "serendipity double")


def entity_mean(articles: DataFrame, vectors: DataFrame, article: str, entities: str, entity: str, vector: str) -> DataFrame:
    """Article vectors as means of their entities' vectors; articles without a covered entity are dropped."""
    each = articles.select(article, F.explode(entities).alias(entity))
    return mean_pool(each, vectors, article, entity, vector, normalize=False).filter("vector is not null").drop("n_used")


def inner_product(a: str, b: str):  # noqa: ANN201
    return dot(F.col(a), F.col(b))
