"""An inverted-file index with product codes, for searches that need not look at every vector.

A codebook of cells is fitted by k-means on a bounded sample of rows, and codes for what is left of a
vector once its cell's centre is taken off: the vector is cut into stretches of a few components, each
of which is replaced by the number of the nearest of up to 256 stretches. Every row is indexed: it has
a cell and a code. A query looks at the cells whose centres score highest, ranks their rows by the sum
of table entries that the codes name, and the first of these are scored again by their whole vectors.

How many cells a query looks at is measured when the index is built: as many as hold `target` of the
true neighbours of sampled rows among the sample. So the cost follows what the data asks for, and recall
against `vectors.top_k` is a figure to look at, not a promise of the structure.

Rows without a vector are left out; shorter vectors count as padded with zeros; equal scores go by item;
an empty table gives an empty index. A cell of any size is dealt into parts of PART_ROWS rows, so that
a hot one is no single task's, and nothing but codebooks and the cells' sizes reaches the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedforge.functions.lists import dot

#: Rows that codebooks are fitted on at most, and sampled rows that ask for their neighbours.
SAMPLE, ASKED = 16_384, 256
#: Cells at most, components of a stretch, and stretches that a code can name.
CELLS, STRETCH, NAMES = 256, 4, 256
#: Rows of a cell, and queries, that meet in a task.
PART_ROWS, BLOCK = 65_536, 2048
#: Rows scored by their whole vectors for each row asked for.
AGAIN = 10


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of numbers as rows, padded with zeros or cut to the width."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), width))
    within = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(np.arange(len(column)), sizes)
    fits = within < width
    out[row[fits], within[fits]] = flat[fits]
    return out


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the centre nearest to each row, the smaller one if two are as near."""
    out = np.empty(len(x), np.int64)
    half = (centres * centres).sum(1) / 2
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = np.argmax(x[at : at + 8192] @ centres.T - half, axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 0) -> np.ndarray:
    """k centres at most; a centre that loses its rows moves to the row farthest from its own."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=len(centres))
        sums = np.zeros(centres.shape)
        np.add.at(sums, own, x)
        centres = np.divide(sums, n[:, None], out=centres.copy(), where=n[:, None] > 0)
        lost = np.flatnonzero(n == 0)
        if len(lost):
            far = np.argsort(-((x - centres[own]) ** 2).sum(1), kind="stable")[: len(lost)]
            centres[lost[: len(far)]] = x[far]
    return centres


@dataclass(frozen=True)
class Codebook:
    """Centres of the cells, for each stretch the vectors that codes name, and the cells a query looks at."""

    cells: np.ndarray
    names: np.ndarray
    probes: int

    @property
    def width(self) -> int:
        return self.cells.shape[1]

    def stretches(self, x: np.ndarray) -> np.ndarray:
        """(rows, stretches, components of a stretch)."""
        m, _, size = self.names.shape
        return np.pad(x, ((0, 0), (0, m * size - x.shape[1]))).reshape(len(x), m, size)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each row's cell, and its code as bytes."""
        cell = nearest(x, self.cells)
        rest = self.stretches(x - self.cells[cell])
        code = np.stack([nearest(rest[:, j], self.names[j]) for j in range(len(self.names))], axis=1) if len(x) else np.zeros((0, len(self.names)))
        return cell, code.astype(np.uint8)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """(queries, stretches, names): the inner products of the queries' stretches with all names."""
        return np.einsum("qms,mns->qmn", self.stretches(q), self.names)

    def probed(self, q: np.ndarray) -> np.ndarray:
        """The cells that each query looks at, best first."""
        return np.argsort(-(q @ self.cells.T), axis=1, kind="stable")[:, : self.probes]


def fit(x: np.ndarray, cells: int, target: float, k: int, seed: int = 0) -> Codebook:
    """A codebook from sampled rows."""
    centres = k_means(x, cells, seed=seed)
    book = Codebook(centres, np.zeros((-(-x.shape[1] // STRETCH), 1, STRETCH)), len(centres))
    own = nearest(x, centres)
    rest = book.stretches(x - centres[own])
    books = [k_means(rest[:, j], NAMES, rounds=8, seed=seed + 1 + j) for j in range(rest.shape[1])]
    q = x[np.random.default_rng(seed).permutation(len(x))[:ASKED]]
    best = np.argsort(-(q @ x.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(np.argsort(-(q @ centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort(np.take_along_axis(place, own[best], axis=1).ravel())
    probes = int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))]) + 1
    return Codebook(centres, np.stack(books), probes)


class VectorIndex:
    """codes(item, cell, part, code) of all rows, their codebook, and parts(cell) as numbers on the driver."""

    def __init__(self, book: Codebook, codes: DataFrame, parts: list[int], vectors: DataFrame) -> None:
        self.book, self.codes, self.parts, self.vectors = book, codes, parts, vectors

    def save(self, folder: str) -> None:
        """Codes by cell, vectors by item, and the codebook as one row."""
        spark = self.codes.sparkSession
        self.codes.repartition("cell", "part").sortWithinPartitions("cell", "part").write.mode("overwrite").parquet(f"{folder}/codes")
        self.vectors.write.mode("overwrite").parquet(f"{folder}/vectors")
        b = self.book
        row = (b.cells.ravel().tolist(), list(b.cells.shape), b.names.ravel().tolist(), list(b.names.shape), b.probes, self.parts)
        spark.createDataFrame([row], "cells array<double>, s1 array<int>, names array<double>, s2 array<int>, probes int, parts array<int>").write.mode("overwrite").parquet(f"{folder}/book")


def load_index(spark: SparkSession, folder: str) -> VectorIndex:
    r = spark.read.parquet(f"{folder}/book").first()
    book = Codebook(np.array(r["cells"]).reshape(r["s1"]), np.array(r["names"]).reshape(r["s2"]), r["probes"])
    return VectorIndex(book, spark.read.parquet(f"{folder}/codes"), list(r["parts"]), spark.read.parquet(f"{folder}/vectors"))


def _constant(values: list[int], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), at)


def build_index(vectors: DataFrame, item: str, vector: str = "vector", cells: int | None = None, target: float = 0.98, k: int = 10, seed: int = 0, part_rows: int = PART_ROWS) -> VectorIndex:
    """An index of all rows with a vector; cells, if not given, follows the square root of their number up to CELLS."""
    rows = vectors.filter(F.col(vector).isNotNull()).select(F.col(item).cast("long").alias("item"), F.col(vector).cast("array<double>").alias("vector"))
    facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    n, width = facts["n"], facts["width"] or 1
    # a hash picks the sample, so that it does not hang on how rows are dealt out
    few = rows.filter(F.pmod(F.xxhash64("item", F.lit(seed)), F.lit(1 << 20)) < min(1 << 20, int((1 << 20) * SAMPLE * 1.1 / max(n, 1)) + 1)).limit(SAMPLE)
    table = few.select("item", "vector").toArrow().sort_by("item")
    x = matrix(table.column("vector"), width) if table.num_rows else np.zeros((1, width))
    book = fit(x, cells or min(CELLS, max(1, int(2 * n**0.5))), target, k, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, code = book.encode(matrix(b.column("vector"), book.width))
            yield pa.record_batch([b.column("item"), pa.array(cell, pa.int32()), pa.array([c.tobytes() for c in code], pa.binary())], names=["item", "cell", "code"])

    coded = rows.mapInArrow(run, "item long, cell int, code binary")
    sizes = {r["cell"]: r["count"] for r in coded.groupBy("cell").count().collect()}
    parts = [max(1, -(-sizes.get(c, 0) // part_rows)) for c in range(len(book.cells))]
    part = F.pmod(F.xxhash64("item", F.lit(seed + 1)), _constant(parts, F.col("cell"))).cast("int")
    return VectorIndex(book, coded.withColumn("part", part), parts, rows)


def _meet(table: pa.Table, book: Codebook, again: int) -> pa.Table:
    """The rows that codes rank first for each query of a cell's part."""
    asks = table.column("asks").to_numpy(zero_copy_only=False).astype(bool)
    ids = table.column("id").to_numpy()
    out: dict[str, list] = {"row": [], "item": [], "about": []}
    if asks.any() and not asks.all():
        at = pa.array(np.flatnonzero(asks))
        q = matrix(table.column("vector").take(at), book.width)
        code = np.frombuffer(b"".join(table.column("code").take(pa.array(np.flatnonzero(~asks))).to_pylist()), np.uint8).reshape(-1, len(book.names))
        items, rows = ids[~asks], ids[asks]
        by_item = np.argsort(items, kind="stable")
        items, code = items[by_item], code[by_item]
        base = q @ book.cells[table.column("cell")[0].as_py()]
        step = max(1, (4 << 20) // max(1, len(items)))
        for lo in range(0, len(rows), step):
            tables = book.tables(q[lo : lo + step])
            about = np.repeat(base[lo : lo + step, None], len(items), axis=1)
            for j in range(code.shape[1]):
                about += tables[:, j, code[:, j]]
            k = min(again, len(items))
            best = np.argpartition(-about, k - 1, axis=1)[:, :k]
            out["row"] += np.repeat(rows[lo : lo + step], k).tolist()
            out["item"] += items[best].ravel().tolist()
            out["about"] += np.take_along_axis(about, best, axis=1).ravel().tolist()
    return pa.table({"row": pa.array(out["row"], pa.int64()), "item": pa.array(out["item"], pa.int64()), "about": pa.array(out["about"], pa.float64())})


def probed(index: VectorIndex, queries: DataFrame, row: str, vector: str = "vector") -> DataFrame:
    """row, vector, cell: a row for each cell that a query looks at."""
    book = index.book

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cells = book.probed(matrix(b.column("vector"), book.width))
            at = pa.array(np.repeat(np.arange(b.num_rows), cells.shape[1]))
            yield pa.record_batch([b.column("id").take(at), b.column("vector").take(at), pa.array(cells.ravel(), pa.int32())], names=["id", "vector", "cell"])

    asked = queries.filter(F.col(vector).isNotNull()).select(F.col(row).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    return asked.mapInArrow(run, "id long, vector array<double>, cell int")


def search(index: VectorIndex, queries: DataFrame, row: str, k: int, item: str = "item", again: int = AGAIN) -> DataFrame:
    """row, item, score, rank: about the k greatest inner products of each query, found in the cells it looks at.

    Scores are those of whole vectors, rounded to six places as in an exact search.
    """
    book, wide = index.book, again * k
    n = queries.count()
    blocks = max(1, -(-n // BLOCK))
    each = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    left = probed(index, queries, row).select("id", "vector", F.lit(None).cast("binary").alias("code"), F.lit(True).alias("asks"), "cell", each(_constant(index.parts, F.col("cell"))).alias("part"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))
    right = index.codes.select(F.col("item").alias("id"), F.lit(None).cast("array<double>").alias("vector"), "code", F.lit(False).alias("asks"), "cell", "part", each(F.lit(blocks)).alias("block"))
    met = left.unionByName(right).groupBy("cell", "part", "block").applyInArrow(lambda t: _meet(t, book, wide), "row long, item long, about double")
    first = met.withColumn("__r", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("about"), "item"))).filter(F.col("__r") <= wide).select("row", "item")
    asked = queries.select(F.col(row).cast("long").alias("row"), F.col("vector").alias("__q"))
    scored = first.join(index.vectors, "item").join(asked, "row").select("row", "item", F.round(dot(F.col("__q"), F.col("vector")), 6).alias("score"))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "item")))
    return ranked.filter(F.col("rank") <= k).withColumnsRenamed({"row": row, "item": item})


def recall(found: DataFrame, exact: DataFrame, row: str, item: str = "item") -> DataFrame:
    """row, recall: the share of each query's exact results among those found."""
    hit = exact.select(row, item).join(found.select(row, item, F.lit(1).alias("__hit")), [row, item], "left")
    return hit.groupBy(row).agg((F.count("__hit") / F.count(F.lit(1))).alias("recall"))
