"""Sums of the vectors of lists: a row's vectors are shuffled as they are and added up where its list meets again.

A list is one row of its table, so that its items may meet in one task; they are added up batch by batch
and never held whole. What is shuffled for an item is its vector, not a state of as many sums and counts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Sums:
    """For rows and sides of lists: items found, vectors among them, zero vectors, and sums and numbers of their cells."""

    rows: pa.Array
    n: np.ndarray
    filled: np.ndarray
    zero: np.ndarray
    total: np.ndarray
    cells: np.ndarray

    def parts(self) -> list[np.ndarray]:
        return [self.n, self.filled, self.zero, self.total, self.cells]

    def cut(self, lo: int, hi: int) -> Sums:
        return Sums(self.rows.slice(lo, hi - lo), *[p[lo:hi] for p in self.parts()])

    def add(self, other: Sums) -> None:
        """The first row of another table, which is the last of this one, goes on."""
        for mine, more in zip(self.parts(), other.parts(), strict=True):
            mine[-1] += more[0]


@dataclass(frozen=True)
class Fold:
    """How the vectors of a list are added up: their width, whether at length 1, and what comes of the sums."""

    sides: int
    width: int
    unit: bool
    finish: Callable[[Sums], list[pa.Array]] = field(repr=False)


def matrix(vectors: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray | None]:
    """A row for each list, and which cells are there unless all are; places beyond a list and null cells are zero."""
    flat, sizes = vectors.flatten(), pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    if not flat.null_count and (sizes == width).all():
        return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), width), None
    at = np.repeat(np.arange(len(vectors)), sizes)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    valid = flat.is_valid().to_numpy(zero_copy_only=False)
    m, there = np.zeros((len(vectors), width)), np.zeros((len(vectors), width), bool)
    m[at, place] = np.where(valid, pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64), 0)
    there[at, place] = valid
    return m, there


def units(m: np.ndarray, there: np.ndarray | None, sizes: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero ones and those with a null cell are zero."""
    size = np.sqrt((m * m).sum(1))
    some = size > 0 if there is None else (size > 0) & (there.sum(1) == sizes)
    return np.divide(m, size[:, None], out=np.zeros(m.shape), where=some[:, None])


def _starts(rows: pa.Array) -> np.ndarray:
    """Where another row begins."""
    if len(rows) < 2:
        return np.zeros(len(rows), np.int64)
    a, b = rows.slice(1), rows.slice(0, len(rows) - 1)
    known = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    gap = a.is_null().to_numpy(zero_copy_only=False) != b.is_null().to_numpy(zero_copy_only=False)
    return np.concatenate(([0], np.flatnonzero(known | gap) + 1))


def _sums(batch: pa.RecordBatch, fold: Fold) -> Sums:
    """The sums of a batch whose rows lie together."""
    rows, side, found, vectors = batch.columns
    starts = _starts(rows)
    lists, shape = np.repeat(np.arange(len(starts)), np.diff([*starts, len(rows)])), (len(starts), fold.sides)
    side, found = side.to_numpy(zero_copy_only=False), found.to_numpy(zero_copy_only=False).astype(bool)
    n = np.zeros(shape, np.int64)
    np.add.at(n, (lists[found], side[found].astype(np.int64)), 1)
    filled, zero = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
    total, cells = np.zeros((*shape, fold.width)), np.zeros((*shape, fold.width), np.int64)
    full = vectors.is_valid().to_numpy(zero_copy_only=False)
    here = vectors.filter(pa.array(full))
    m, there = matrix(here, fold.width)
    if fold.unit:
        m = units(m, there, pc.list_value_length(here).to_numpy(zero_copy_only=False))
    of, sides = lists[full], side[full]
    for s in range(fold.sides):
        mine = np.flatnonzero(sides == s)
        if not len(mine):
            continue
        first = np.concatenate(([0], np.flatnonzero(np.diff(of[mine])) + 1))
        at = of[mine][first]
        total[at, s] = np.add.reduceat(m[mine], first)
        filled[at, s] = np.diff([*first, len(mine)])
        cells[at, s] = filled[at, s, None] if there is None else np.add.reduceat(there[mine].astype(np.int64), first)
        if fold.unit:
            zero[at, s] = np.add.reduceat((m[mine] == 0).all(1).astype(np.int64), first)
    return Sums(rows.take(pa.array(starts)), n, filled, zero, total, cells)


def _folded(batches: Iterator[pa.RecordBatch], fold: Fold, names: list[str]) -> Iterator[pa.RecordBatch]:
    held: Sums | None = None
    give = lambda s: pa.RecordBatch.from_arrays([s.rows, *fold.finish(s)], names=names)
    for batch in batches:
        if not batch.num_rows:
            continue
        sums = _sums(batch, fold)
        if held is not None:
            if len(_starts(pa.concat_arrays([held.rows, sums.rows.slice(0, 1)]))) == 1:
                held.add(sums)
                sums = sums.cut(1, len(sums.rows))
            if not len(sums.rows):
                continue
            yield give(held)
        # the last row may go on in the next batch
        last = len(sums.rows) - 1
        if last:
            yield give(sums.cut(0, last))
        held = sums.cut(last, last + 1)
    if held is not None:
        yield give(held)


def folded(lists: DataFrame, vectors: DataFrame, row: str, sides: list[str], item: str, vector: str, unit: bool, finish: Callable[[Sums], list[pa.Array]], schema: str) -> DataFrame:
    """row and the columns of the schema, for every row of lists, in one pass over them: what `finish` makes of the sums.

    Each list of `sides` is added up by itself. Rows of lists are taken to differ.
    """
    width = vectors.agg(F.max(F.size(F.col(vector)))).first()[0] or 0
    tag = lambda i: lambda x: F.struct(F.lit(i).alias("side"), x.alias("x"))
    tagged = [F.transform(F.coalesce(F.col(c), F.array().cast(dict(lists.dtypes)[c])), tag(i)) for i, c in enumerate(sides)]
    each = lists.select(F.col(row).alias("__row"), F.posexplode_outer(F.concat(*tagged)).alias("__pos", "__s"))
    each = each.select("__row", F.coalesce("__pos", F.lit(0)).alias("__pos"), F.coalesce("__s.side", F.lit(0)).alias("__side"), F.col("__s.x").alias("__item"))
    known = vectors.select(F.col(item).alias("__of"), F.col(vector).alias("__vector"), F.lit(True).alias("__found"))
    known = known.filter("__vector is not null") if unit else known
    joined = each.join(known, F.col("__item") == F.col("__of"), "left")
    # one item without a vector is enough to have the row
    some = joined.filter(F.col("__found") | (F.col("__pos") == 0)).select("__row", "__pos", "__side", F.coalesce("__found", F.lit(False)).alias("__found"), "__vector")
    dealt = some.repartition("__row").sortWithinPartitions("__row", "__pos").select("__row", "__side", "__found", "__vector")
    names = [row, *[c.split()[0] for c in schema.split(", ")]]
    fold = Fold(len(sides), max(width, 0), unit, finish)
    return dealt.mapInArrow(partial(_folded, fold=fold, names=names), f"`{row}` {dict(lists.dtypes)[row]}, {schema}")
