"""MinHash near-dedup with SetSketch registers (operator 1).

Every document's set of word shingles becomes SetSketch registers: minima of universal hashes,
truncated onto exponentially spaced levels (base 1.001), which merge by maximum and collide about
as often as two sets overlap. Equal sets collapse into one node first, so that copies are never
paired with each other. Bands of four registers deal the nodes into buckets; there are as many bands
as leave a pair at the limit without a common one in under MISS of the cases. A bucket links its
members to its smallest one (a star, not all pairs): candidate pairs pass a likelihood test on their
registers and are then confirmed on full sets.

Where a bucket still holds several components, its members outside the largest one are compared with
all its members, and only links that connect something are emitted. Both sides are dealt by a hash of
the node into blocks of about BLOCK_SHINGLES shingles, and a task compares two blocks: first by the
likelihood test, then on full sets. So no link between different components goes untested, a bucket
of any size is spread over tasks, and a group of near copies in one component costs a pass over it.
Components come from star contraction.

The likelihood test drops a pair only if its registers are over e ** 12 times likelier under another
similarity.

Edge cases: a text without words (or null) has an empty set, is linked with nothing and is kept;
one to four words are one shingle; repeated rows share one node; where one doc_id has different
texts, each links by itself, and a component's id is the smallest doc_id in it; a null doc_id takes
no part (component null, kept); an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedforge.llm.common import checkpoint, flag_members, fresh, give_back, release, slices
from feedforge.llm.graph import components
from feedforge.llm.shingles import WIDTH, jaccard_counts, minima, set_digest, shingle_sets

#: Registers of a band.
ROWS = 4
#: Share of pairs at the limit that may have no band in common.
MISS = 1e-5
#: SetSketch parameters: level base, rate and highest level of 16-bit registers.
BASE, RATE, TOP = 1.001, 20.0, 65535
SEED = 20210101
#: A pair goes on unless its log-likelihood at the limit is this much under its best.
SLACK = 12.0
#: Shingles of a block.
BLOCK_SHINGLES = 500_000


def bands(percent: int) -> int:
    """Bands that leave a pair of this similarity without a common one in under MISS of the cases."""
    return math.ceil(math.log(MISS) / math.log(1 - min(percent / 100, 0.99) ** ROWS))


def registers(sets: list[np.ndarray], count: int) -> np.ndarray:
    """SetSketch registers: levels of minima that are exponential with the set's size as rate."""
    low = (minima(sets, count, SEED) >> np.uint64(11)).astype(np.float64)
    least = -np.log1p(-(low + 0.5) / 2.0**53)
    level = np.floor(1 - np.log(least / RATE) / np.log(BASE))
    level = np.clip(level, 0, TOP)
    level[[i for i, s in enumerate(sets) if not len(s)]] = 0
    return level.astype("<u2")


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of a union."""
    return np.maximum(a, b)


def log_likelihood(j: np.ndarray, n1: np.ndarray, n2: np.ndarray, over: np.ndarray, under: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Joint log-likelihood of similarity j for counts of greater, smaller and equal registers, set sizes known."""
    u = n1 / (n1 + n2)
    v = 1 - u
    level = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / np.log(BASE)
    p, q = level(u - v * j), level(v - u * j)
    return over * np.log(p) + under * np.log(q) + same * np.log(np.clip(1 - p - q, 1e-12, 1))


def plausible(n1: np.ndarray, n2: np.ndarray, r1: np.ndarray, r2: np.ndarray, limit: float) -> np.ndarray:
    """Pairs whose sizes allow the limit and whose registers don't speak against it."""
    grid = np.linspace(0.02, 1, 50)[:, None]
    over, under = (r1 > r2).sum(1), (r1 < r2).sum(1)
    counts = (over, under, r2.shape[1] - over - under)
    top = np.minimum(n1, n2) / np.maximum(n1, n2)  # no similarity is greater
    best = log_likelihood(np.minimum(grid, top), n1, n2, *counts).max(0)
    inside = np.linspace(0, 1, 8)[:, None]
    here = log_likelihood(np.minimum(limit + (top - limit) * inside, top), n1, n2, *counts).max(0)
    return (top >= limit) & (here >= best - SLACK)


#: (n1, n2, registers, registers, limit) -> which pairs to verify.
Test = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float], np.ndarray]


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _levels(column: pa.Array) -> np.ndarray:
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), "<u2").reshape(len(raw), -1)


def _sketch(batches: Iterator[pa.RecordBatch], width: int, make: Callable, count: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 1):
        sets = shingle_sets(_bytes(batch.column(1)), width)
        levels = make(sets, count)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_digest(s) for s in sets], pa.binary()), pa.array([x.tobytes() for x in levels], pa.binary())],
            names=["doc_id", "text_hash", "n", "digest", "sketch"],
        )
        give_back(0)


def sketches(docs: DataFrame, id_col: str, text_col: str, width: int, make: Callable, count: int) -> DataFrame:
    """doc_id, text hash, number of shingles, digest of the set, registers."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_hash")).mapInArrow(
        partial(_sketch, width=width, make=make, count=count), "doc_id long, text_hash long, n long, digest binary, sketch binary"
    )


def _likely(batches: Iterator[pa.RecordBatch], test: Test, limit: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sizes = [x.to_numpy(zero_copy_only=False).astype(float) for x in batch.columns[2:4]]
            yield batch.select([0, 1]).filter(pa.array(test(*sizes, _levels(batch.column(4)), _levels(batch.column(5)), limit)))


def _confirm(batches: Iterator[pa.RecordBatch], percent: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2, 3):
        texts: dict[bytes, int] = {}
        pairs = [tuple(texts.setdefault(t, len(texts)) for t in both) for both in zip(_bytes(batch.column(2)), _bytes(batch.column(3)), strict=True)]
        sets = shingle_sets(list(texts), width)
        ok = []
        for i, k in pairs:
            both, either = jaccard_counts(sets[i], sets[k])
            ok.append(100 * both >= percent * either)
        yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))
        give_back(0)


def _verified(pairs: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, width: int, test: Test) -> DataFrame:
    """The pairs (a, b) that pass the size bound, the likelihood test and the comparison of full sets."""
    side = lambda c: nodes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    rated = pairs.join(side("a"), "a").join(side("b"), "b").filter((100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")))
    likely = checkpoint(rated.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(partial(_likely, test=test, limit=percent / 100), "a long, b long"))
    asked = likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    some = texts.join(asked, "node", "left_semi")
    whole = likely.join(some.select(F.col("node").alias("a"), F.col("text").alias("t_a")), "a").join(some.select(F.col("node").alias("b"), F.col("text").alias("t_b")), "b")
    return checkpoint(whole.select("a", "b", "t_a", "t_b").mapInArrow(partial(_confirm, percent=percent, width=width), "a long, b long"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def _buckets(nodes: DataFrame, count: int) -> DataFrame:
    keys = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(sketch, {1 + 2 * ROWS * i}, {2 * ROWS})")) for i in range(count)])
    return nodes.select("node", F.explode(keys).alias("bucket"))


def _shared(members: DataFrame) -> DataFrame:
    """bucket, node, hub (smallest node): of buckets with two members or more."""
    hubs = members.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1")
    return members.join(hubs.drop("size"), "bucket")


def grouped(
    docs: DataFrame, id_col: str, text_col: str, percent: int, width: int = WIDTH, make: Callable = registers, test: Test = plausible, known: DataFrame | None = None
) -> DataFrame:
    """doc_id, text_hash, n, and for each filled set node, component (nodes linked) and component_id (their smallest doc_id).

    known: a checkpointed table with the columns of sketches() for these documents, where there is one
    already; columns beyond those stay.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    if known is None:
        known = checkpoint(sketches(base, "doc_id", "text", width, make, ROWS * bands(percent)))
    filled = known.filter("n > 0 and doc_id is not null")
    sets = filled.groupBy("digest").agg(F.min(F.struct("doc_id", "text_hash")).alias("at"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    # the checkpoint fixes the numbers of the different sets
    nodes = checkpoint(sets.select(F.monotonically_increasing_id().alias("node"), "digest", "at.doc_id", "at.text_hash", "n", "sketch"))

    shared = checkpoint(_shared(_buckets(nodes, bands(percent))))
    # texts of the nodes that share a bucket, shuffled once for all comparisons
    asked = checkpoint(shared.select("node").distinct().join(nodes.select("node", "doc_id", "text_hash"), "node"))
    # most texts share no bucket and need no shuffle
    keyed = flag_members(base.withColumn("text_hash", F.xxhash64("text")), F.xxhash64("doc_id", "text_hash"), asked.select(F.xxhash64("doc_id", "text_hash")), "asked").filter("asked").drop("asked")
    texts = checkpoint(keyed.join(asked, ["doc_id", "text_hash"]).groupBy("node").agg(F.first("text").alias("text")))
    release(docs.sparkSession)
    stars = _ordered(shared.select(F.col("node").alias("a"), F.col("hub").alias("b")))
    links = _verified(stars, nodes, texts, percent, width, test)

    linked = components(links)
    more = checkpoint(_between(shared.select("bucket", "node"), linked, nodes, texts, percent, width, test))
    release(docs.sparkSession)
    # a node's link to the smallest of its component stands for all links found before
    final = components(linked.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    labelled = nodes.select("digest", "node", "doc_id").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = labelled.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    by_set = labelled.join(least, "component").select("digest", "node", "component", "component_id")
    return known.join(by_set.withColumnRenamed("digest", "d"), (known["digest"] == F.col("d")) & known["doc_id"].isNotNull() & (known["n"] > 0), "left").drop("d", "digest", "sketch")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, width: int = WIDTH, make: Callable = registers, test: Test = plausible) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row; documents link at `percent` similarity."""
    component = F.coalesce("component_id", "doc_id")
    return grouped(docs, id_col, text_col, percent, width, make, test).select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )


def _links_of_blocks(table: pa.Table, percent: int, width: int, test: Test) -> pa.Table:
    """Links between different components, as a spanning forest, of one block of some members and one of all members."""
    node, comp = (table.column(c).to_numpy() for c in ("node", "component"))
    asks, both_ask = (table.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("asks", "outside"))
    sets = shingle_sets(_bytes(table.column("text")), width)
    levels = _levels(table.column("sketch"))
    sizes = np.array([len(x) for x in sets])
    left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
    found: list[tuple[int, int]] = []
    give_back(0)
    if len(left) and len(right):
        values, flat = np.unique(np.concatenate(sets), return_inverse=True)
        ends = np.cumsum(sizes)
        ids = [flat[e - n : e] for e, n in zip(ends, sizes, strict=True)]
        mark = np.zeros(len(values), np.int32)
        root = comp.copy()
        for i in left:
            # a pair that both sides ask for is compared from its smaller node
            open_ = right[(root[right] != root[i]) & ~(both_ask[right] & (node[right] < node[i])) & (100 * np.minimum(sizes[right], sizes[i]) >= percent * np.maximum(sizes[right], sizes[i]))]
            if len(open_):
                open_ = open_[test(sizes[i].astype(float), sizes[open_].astype(float), levels[i][None, :], levels[open_], percent / 100)]
            if not len(open_):
                continue
            mark[ids[i]] = 1
            at = np.concatenate(([0], np.cumsum(sizes[open_])[:-1]))
            both = np.add.reduceat(mark[np.concatenate([ids[k] for k in open_])], at)
            mark[ids[i]] = 0
            for k in open_[100 * both >= percent * (sizes[open_] + sizes[i] - both)]:
                if root[k] != root[i]:
                    found.append((node[i], node[k]))
                    root[root == root[k]] = root[i]
    return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([x for _, x in found], pa.int64())})


def _between(shared: DataFrame, known: DataFrame, nodes: DataFrame, texts: DataFrame, percent: int, width: int, test: Test) -> DataFrame:
    """Links between the components that share a bucket."""
    placed = shared.join(known, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")).join(nodes.select("node", "n", "sketch"), "node")
    per = placed.groupBy("bucket", "component").agg(F.sum("n").alias("n"))
    most = per.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("most"), F.max("n").alias("n_most"), F.sum("n").alias("n_all"), F.count(F.lit(1)).alias("c"))
    blocks = lambda n: F.ceil(n / BLOCK_SHINGLES).cast("int")
    cut = most.filter("c > 1").select("bucket", "most", blocks(F.col("n_all") - F.col("n_most")).alias("n_left"), blocks(F.col("n_all")).alias("n_right"))
    open_ = placed.join(cut, "bucket")
    of = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = open_.filter("component <> most").select("bucket", "node", "component", "sketch", F.lit(True).alias("asks"), F.lit(True).alias("outside"), of("n_left").alias("left"), each("n_right").alias("right"))
    others = open_.select("bucket", "node", "component", "sketch", F.lit(False).alias("asks"), (F.col("component") != F.col("most")).alias("outside"), of("n_right").alias("right"), each("n_left").alias("left"))
    whole = asking.unionByName(others).join(texts, "node")
    return whole.groupBy("bucket", "left", "right").applyInArrow(lambda t: _links_of_blocks(t, percent, width, test), "a long, b long")


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """One document of each near-duplicate class, with all its columns.

    Of a class, the smallest id stays, and of its rows one; rows without words or without an id all stay.
    """
    key, digest, here = (fresh(docs, x) for x in ("id", "hash", "here"))
    linked = grouped(docs, id_col, text_col, percent).filter("component_id is not null")
    stays = linked.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("at")).select(F.col("at.doc_id").alias(key), F.col("at.text_hash").alias(digest))
    marked = docs.withColumn(here, F.xxhash64(text_col))
    kept = marked.join(stays, (F.col(id_col).cast("long") == F.col(key)) & (F.col(here) == F.col(digest)), "left_semi").dropDuplicates([id_col, here])
    wordless = F.col(id_col).isNull() | ~F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.unionByName(marked.filter(wordless)).drop(here)
