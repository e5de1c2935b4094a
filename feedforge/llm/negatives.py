"""Hard-negative mining with vantage-point trees over norm-augmented vectors (operator 11).

Inner products become distances: every vector x of squared length n gets one more component,
sqrt(M - n), M being the greatest squared length, and a query q gets a zero there. Then
|q' - x'|^2 = |q|^2 + M - 2 <q, x>, so that higher scores are nearer, and a window of scores
[low, high] is an annulus around the query.

The index is a tree in two storeys. The upper one has at most CELLS leaves and is fitted on at most
SAMPLE rows; every row is routed down it. Each of its cells is dealt into pages of about PAGE_ROWS
rows, and each page becomes a tree of its own, a row of the index. A query first visits the page that
it lies in, which bounds what it still needs; the upper storey then names the pages that its annuli
can reach. Inside a page the leaves are visited nearest first, those inside the inner radius are
passed over, and a query stops at the first leaf that is farther than all it still needs. Bounds come
from the triangle inequality with room for rounding; scores are exact integers, so the rows are those
of a full scan. Nothing is capped: where vectors have no structure, more leaves are visited.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part;
shorter vectors count as padded with zeros; a null id comes last among ties, is no anchor unless the
caller's condition says so, and is returned as null; rows that repeat an id are rows of their own, so
that a repeated anchor is asked once for each; equal scores go by id; a negative positive score has
no window (80 % of it lies above it); an empty table gives an empty result; columns beyond those
named are left aside. Squared lengths of 2^53 and more raise an error, as scores would not be exact.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from feedforge.llm.common import checkpoint

#: Rows that the upper storey is fitted on at most, and its greatest number of leaves.
SAMPLE, CELLS = 4096, 64
#: Rows of a page, about, and of a leaf at most, equal vectors aside.
PAGE_ROWS, LEAF_ROWS = 8192, 128
#: Queries that meet a page at a time.
BLOCK = 256
#: Stands for a null id: greater than all others, so that it comes last.
NO_ID = np.iinfo(np.int64).max


class Tree:
    """A vantage-point tree as arrays: a node has a vantage and two children, or a range of rows.

    low and high are the distances from the parent's vantage between which a node's rows lie.
    """

    def __init__(self, parts: dict[str, np.ndarray]) -> None:
        self.parts = parts
        self.vantage, self.inner, self.outer, self.low, self.high, self.radius, self.range = (parts[n] for n in ("vantage", "inner", "outer", "low", "high", "radius", "range"))
        self.leaves = np.flatnonzero(self.inner < 0)

    @classmethod
    def grow(cls, x: np.ndarray, most: float, leaf: int, routed: bool = False) -> tuple[Tree, np.ndarray]:
        """A tree over the rows of x, and their order in it; routed: bounds hold for rows that come later, too."""
        flat = np.sqrt(np.maximum(most - (x * x).sum(1), 0))
        order = np.arange(len(x))
        nodes: list[list] = []  # vantage row, inner, outer, low, high, radius, start, stop
        todo = [(0, len(x), 0.0, np.inf, -1, False)]
        while todo:
            start, stop, low, high, parent, is_outer = todo.pop()
            if parent >= 0:
                nodes[parent][2 if is_outer else 1] = len(nodes)
            at = len(nodes)
            nodes.append([0, -1, -1, low, high, 0.0, start, stop])
            if stop - start <= leaf:
                continue
            own = order[start:stop]
            away = lambda r: np.sqrt(np.maximum(2 * (most - x[own] @ x[r] - flat[own] * flat[r]), 0))  # noqa: E731, B023
            # a row at the edge parts the others better than one in their middle
            vantage = own[int(np.argmax(away(own[0])))]
            d = away(vantage)
            by = np.argsort(d, kind="stable")
            order[start:stop], d = own[by], d[by]
            cut = int(np.searchsorted(d, d[len(d) // 2], "right")) if routed else len(d) // 2
            if d[0] == d[-1] or cut in (0, len(d)):
                continue
            nodes[at][0], nodes[at][5] = int(vantage), float(d[cut - 1])
            bounds = ((0.0, d[cut - 1]), (d[cut - 1], np.inf)) if routed else ((d[0], d[cut - 1]), (d[cut], d[-1]))
            todo += [(start, start + cut, *bounds[0], at, False), (start + cut, stop, *bounds[1], at, True)]
        cols = list(zip(*nodes, strict=True))
        vantages = np.array(cols[0])
        parts = {"vantage": x[vantages], "inner": np.array(cols[1]), "outer": np.array(cols[2]), "low": np.array(cols[3], float), "high": np.array(cols[4], float), "radius": np.array(cols[5], float), "range": np.array(cols[6:8]).T}
        return cls(parts), order

    def bounds(self, q: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """For each query and node the greatest and the smallest score that a row of the node can have."""
        base = (q * q).sum(1) + most
        d = np.sqrt(np.maximum(base[:, None] - 2 * (q @ self.vantage.T), 0))
        near, far = np.zeros(d.shape), np.full(d.shape, np.inf)
        for n in np.flatnonzero(self.inner >= 0):  # parents come before their children
            for c in (self.inner[n], self.outer[n]):
                near[:, c] = np.maximum(near[:, n], np.maximum(d[:, n] - self.high[c], self.low[c] - d[:, n]))
                far[:, c] = np.minimum(far[:, n], d[:, n] + self.high[c])
        room = 2e-7 * (base[:, None] + most) + 1e-3  # distances near 0 carry the greatest errors
        return (base[:, None] - near**2) / 2 + room, (base[:, None] - far**2) / 2 - room

    def route(self, x: np.ndarray, most: float) -> np.ndarray:
        """The number of the leaf, among leaves, of each row."""
        flat = np.sqrt(np.maximum(most - (x * x).sum(1), 0))
        lifted = np.sqrt(np.maximum(most - (self.vantage * self.vantage).sum(1), 0))
        d = np.sqrt(np.maximum(2 * (most - x @ self.vantage.T - flat[:, None] * lifted), 0))
        at = np.zeros(len(x), int)
        while len(going := np.flatnonzero(self.inner[at] >= 0)):
            n = at[going]
            at[going] = np.where(d[going, n] <= self.radius[n], self.inner[n], self.outer[n])
        return np.searchsorted(self.leaves, at)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as float64 rows, padded with zeros."""
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _build(table: pa.Table, width: int, most: float, leaf_rows: int) -> pa.Table:
    """The rows of a page as one row of the index."""
    table = table.combine_chunks()
    x = _matrix(table.column("v").chunk(0), width)
    tree, order = Tree.grow(x, most, leaf_rows)
    whole = x[order].astype(np.int64)
    kind = next(t for t in (np.int8, np.int16, np.int32) if np.abs(whole).max(initial=0) <= np.iinfo(t).max)
    cols = {n: table.column(n).to_numpy()[order] for n in ("uid", "id", "label")}
    buffer = io.BytesIO()
    np.savez(buffer, x=whole.astype(kind), **cols, **tree.parts)
    return pa.table({"page": pa.array([table.column("page")[0].as_py()], pa.int32()), "tree": pa.array([buffer.getvalue()], pa.binary())})


class Page:
    """A page of the index, opened."""

    def __init__(self, data: bytes) -> None:
        with np.load(io.BytesIO(data)) as f:
            parts = {n: f[n] for n in f.files}
        self.x = parts.pop("x").astype(np.float64)
        self.uid, self.id, self.label = (parts.pop(n) for n in ("uid", "id", "label"))
        self.tree = Tree(parts)
        ends = self.tree.range[self.tree.leaves]
        self.labels = [set(self.label[a:b].tolist()) for a, b in ends.tolist()]
        self.ends = ends.tolist()

    def search(self, q: np.ndarray, most: float, asked: list[dict], k: int, same: bool) -> Iterator[tuple]:
        """(query's uid, window, score, id, uid) of the first k rows of each window on this page."""
        upper, lower = self.tree.bounds(q, most)
        upper, lower = upper[:, self.tree.leaves], lower[:, self.tree.leaves]
        nearest = np.argsort(-upper, axis=1, kind="stable").tolist()
        upper, lower = upper.tolist(), lower.tolist()
        for i, a in enumerate(asked):
            found: list[list[tuple]] = [[] for _ in a["windows"]]
            needs = [w["need"] for w in a["windows"]]
            highs = [w["high"] for w in a["windows"]]
            least, top = min(needs), max(highs)
            for leaf in nearest[i]:
                if upper[i][leaf] < least:
                    break
                if lower[i][leaf] > top or (a["label"] not in self.labels[leaf] if same else self.labels[leaf] == {a["label"]}):
                    continue
                start, stop = self.ends[leaf]
                scores = self.x[start:stop] @ q[i]
                fits = (scores >= least) & (scores <= top) & ((self.label[start:stop] == a["label"]) == same)
                if same:
                    fits &= self.uid[start:stop] != a["uid"]
                hits = np.flatnonzero(fits)
                if not len(hits):
                    continue
                rows = [(-s, n, u) for s, n, u in zip(scores[hits].tolist(), self.id[start:stop][hits].tolist(), self.uid[start:stop][hits].tolist(), strict=True)]
                for w, (need, high) in enumerate(zip(needs, highs, strict=True)):
                    new = [r for r in rows if need <= -r[0] <= high]
                    if new:
                        found[w] = sorted(found[w] + new)[:k]
                        if len(found[w]) == k:
                            needs[w] = max(need, -found[w][-1][0])
                least = min(needs)
            for w, best in enumerate(found):
                yield from ((a["uid"], w, int(-s), n, u) for s, n, u in best)


def _met(left: DataFrame, right: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """A join that shuffles both sides: what queries carry grows with queries and pages, and no driver should hold it."""
    return left.hint("merge").join(right, on, how)


FOUND = "asked long, w int, score long, id long, uid long"


def _searcher(width: int, most: float, k: int, same: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, page = None, None
        for batch in batches:
            for number, data, asked in zip(*(batch.column(c) for c in ("page", "tree", "asked")), strict=True):
                if number.as_py() != last:
                    last, page = number.as_py(), Page(data.as_py())
                q = _matrix(asked.values.field("v"), width)
                rows = list(page.search(q, most, asked.as_py(), k, same))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["asked", "w", "score", "id", "uid"])

    return run


class Index:
    """Pages of vantage-point trees over rows of uid, id, label and v (integers)."""

    def __init__(self, rows: DataFrame, page_rows: int = PAGE_ROWS, leaf_rows: int = LEAF_ROWS) -> None:
        size = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
        facts = rows.agg(F.count(F.lit(1)).alias("n"), F.max(size).alias("most"), F.max(F.size("v")).alias("width")).first()
        self.n, self.most, self.width = facts["n"], float(facts["most"] or 0), facts["width"] or 0
        if self.most >= 2**53:
            raise ValueError("squared lengths of 2^53 and more have no exact scores")
        few = rows.sample(min(1.0, SAMPLE / max(self.n, 1)), seed=1).limit(SAMPLE).select("v").toArrow().combine_chunks()
        x = _matrix(few.column("v").chunk(0), self.width) if few.num_rows else np.zeros((1, self.width))
        cells = min(CELLS, 1 + self.n // page_rows)
        self.top, _ = Tree.grow(x, self.most, max(1, -(-len(x) // cells)), routed=True)
        routed = checkpoint(self._routed(rows))
        counts = {r["cell"]: r["n"] for r in routed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect()}
        self.pages = [-(-counts.get(c, 0) // page_rows) for c in range(len(self.top.leaves))]
        self.first = [sum(self.pages[:c]) for c in range(len(self.pages))]
        here = F.get(F.array(*map(F.lit, self.first)), F.col("cell")) + F.pmod(F.xxhash64("uid"), F.get(F.array(*map(F.lit, self.pages)), F.col("cell")))
        self.rows = routed.withColumn("page", here.cast("int"))
        width, most = self.width, self.most
        self.table = checkpoint(self.rows.groupBy("page").applyInArrow(lambda t: _build(t, width, most, leaf_rows), "page int, tree binary"))

    def _routed(self, rows: DataFrame) -> DataFrame:
        top, width, most = self.top, self.width, self.most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cells = top.route(_matrix(b.column("v"), width), most) if b.num_rows else np.zeros(0)
                yield pa.record_batch([*b.columns, pa.array(cells.astype(np.int32))], names=[*b.schema.names, "cell"])

        cols = ["uid", "id", "label", "asks", "v"]
        return rows.select(*cols).mapInArrow(run, "uid long, id long, label long, asks boolean, v array<long>, cell int")

    def _visit(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """What the queries find on the pages that their rows name."""
        part = F.pmod(F.xxhash64("uid"), F.lit(-(-max(self.n, 1) // BLOCK)))
        blocks = asked.groupBy("page", part.alias("part")).agg(F.collect_list(F.struct("uid", "label", "v", "windows")).alias("asked"))
        both = _met(blocks, self.table, "page").select("page", "tree", "asked")
        return both.mapInArrow(_searcher(self.width, self.most, k, same), FOUND)

    def _reached(self, asked: DataFrame) -> DataFrame:
        """A row for each query and page that its windows can reach, the query's own page aside."""
        top, first, pages, width, most = self.top, self.first, self.pages, self.width, self.most

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                upper, lower = (m[:, top.leaves] for m in top.bounds(_matrix(b.column("v"), width), most))
                takes, gets = [], []
                for i, (home, windows) in enumerate(zip(b.column("page").to_pylist(), b.column("windows").to_pylist(), strict=True)):
                    for c in range(len(top.leaves)):
                        if any(upper[i, c] >= w["need"] and lower[i, c] <= w["high"] for w in windows):
                            new = [p for p in range(first[c], first[c] + pages[c]) if p != home]
                            takes += [i] * len(new)
                            gets += new
                kept = b.drop_columns(["page"]).take(pa.array(takes, pa.int64()))
                yield pa.record_batch([*kept.columns, pa.array(gets, pa.int32())], names=[*kept.schema.names, "page"])

        kinds = "uid long, label long, v array<long>, windows array<struct<need:bigint,high:bigint>>, page int"
        return asked.select("uid", "label", "v", "windows", "page").mapInArrow(run, kinds)

    def search(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """asked (a query's uid), w, rank, score, id, uid: the first k rows of each of the query's windows.

        asked has uid, label, v, page and windows, an array of the least score needed and the greatest.
        """
        home = checkpoint(self._visit(asked, k, same))
        full = home.groupBy("asked", "w").agg(F.min("score").alias("s"), F.count(F.lit(1)).alias("c")).filter(F.col("c") >= k)
        known = full.groupBy("asked").agg(F.map_from_entries(F.collect_list(F.struct("w", "s"))).alias("known"))
        better = F.transform("windows", lambda w, i: F.struct(F.greatest(w["need"], F.try_element_at("known", i)).alias("need"), w["high"].alias("high")))
        rest = _met(asked, known, F.col("uid") == F.col("asked"), "left").drop("asked").withColumn("windows", better)
        both = home.unionByName(self._visit(self._reached(rest), k, same))
        order = Window.partitionBy("asked", "w").orderBy(F.desc("score"), "id")
        return checkpoint(both.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k))


def quantised(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null where one is null or not finite."""
    good = lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))
    return F.when(F.forall(vector, good), F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def mine_negatives(rows: DataFrame, anchors: Column, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, page_rows: int = PAGE_ROWS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Vectors are of integers; anchors is a condition on the table's rows. An anchor's positives are its
    first rows of the same label; the negatives of a pair are the first rows of other labels whose
    score is at most the positive's and at least `low` per cent of it.
    """
    whole = quantised(F.col(vector_col), 1)
    used = rows.filter(F.col(label_col).isNotNull() & whole.isNotNull())
    named = used.select(F.coalesce(F.col(id_col).cast("long"), F.lit(int(NO_ID))).alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchors, F.lit(False)).alias("asks"), whole.alias("v"))
    # numbers of rows that no repeated task can change
    index = Index(checkpoint(named).withColumn("uid", F.monotonically_increasing_id()), page_rows, leaf_rows)
    asked = checkpoint(index.rows.filter("asks").select("uid", "id", "label", "v", "page"))
    window = lambda need, high: F.struct(need.cast("long").alias("need"), high.cast("long").alias("high"))
    wide = F.array(window(F.lit(-(1 << 60)), F.lit(1 << 60)))
    near = index.search(asked.withColumn("windows", wide), positives, same=True)
    # windows in the order of the positives; one of a negative score holds nothing
    pairs = near.filter("score >= 0").groupBy("asked").agg(F.sort_array(F.collect_list(F.struct("rank", "score", "id"))).alias("pairs"))
    least = lambda s: F.call_function("div", s * low + 99, F.lit(100))
    windows = F.transform("pairs", lambda p: window(least(p["score"]), p["score"]))
    known = checkpoint(_met(asked, pairs, F.col("uid") == F.col("asked")).drop("asked").withColumn("windows", windows))
    found = index.search(known, negatives, same=False)
    negative = found.select("asked", "w", "rank", F.col("id").alias("n"), F.col("score").alias("negative_score"))
    both = _met(negative, known.select(F.col("uid").alias("asked"), F.col("id").alias("a"), "pairs"), "asked")
    both = both.withColumn("p", F.get("pairs", F.col("w")))
    back = lambda c: F.when(c != int(NO_ID), c)
    return both.select(back(F.col("a")).alias("anchor_id"), back(F.col("p.id")).alias("positive_id"), "rank", back(F.col("n")).alias("negative_id"), F.col("p.score").alias("positive_score"), "negative_score")
