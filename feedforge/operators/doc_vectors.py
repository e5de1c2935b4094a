"""Vectors of documents: a truncated singular value decomposition of their TF-IDF matrix.

The matrix is a table of tiles, each of a block of documents and a group of words, so that what is
multiplied is shuffled once for each document and group, and not for each word. A randomised range finder multiplies it with
random signs that follow from a hash of the term, a few rounds of multiplying back and forth sharpen
the range, and an eigenproblem of as many rows as vectors have components gives the rest. All that
reaches the driver are matrices of that size; everything that grows with the corpus is joined, summed
in partial aggregates, and kept in Spark.

A document without words, or with null text, has a zero vector; rows of equal ids are one document;
an empty table gives an empty result. The signs of components are fixed so that each sums to at least
zero over the documents.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedforge.functions.lists import run_lengths
from feedforge.functions.text import tokens

#: Components beyond those asked for that the range finder carries, and rounds that sharpen it.
SPARE, ROUNDS = 10, 2
#: Words and documents of a block at most, if it has more than one document.
BLOCK_WEIGHTS, BLOCK_DOCS = 3 << 19, 1 << 15
#: Bytes of the vectors of a group's words, about; and, where these ask for fewer groups, words of blocks for each task, and most tasks.
GROUP_BYTES, TASK_WORDS, MOST_TASKS = 192 << 20, 1 << 16, 6
#: What a tile holds: its words' numbers in their group and the documents that have them, the words of each document and their weights, and what a document's are multiplied by.
TILE = ["codes", "df", "counts", "col", "val", "inv"]


def kept(df: DataFrame) -> DataFrame:
    """A table that later steps read again: a checkpoint where the session has a folder for it, else cached."""
    context = df.sparkSession.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None and named is None:
        return df.persist()
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Have Spark delete the shuffle files and checkpoints of tables that nothing refers to any more.

    Its cleaner follows the driver's garbage collection, which may not come before the disk is full.
    """
    gc.collect()
    # Python tells the JVM of what it let go of once a second
    time.sleep(1.5)
    spark.sparkContext._jvm.System.gc()
    time.sleep(0.5)


def tf_idf(corpus: DataFrame, doc: str, text: str, remove_stopwords: bool = True) -> DataFrame:
    """doc, term, weight: counts times ln((1 + n) / (1 + df)) + 1, at length 1 for each document."""
    words = corpus.select(F.col(doc).alias("doc"), F.sort_array(tokens(F.col(text), remove_stopwords)).alias("words"))
    counted = words.select("doc", F.inline(run_lengths(F.col("words")))).toDF("doc", "term", "tf").groupBy("doc", "term").agg(F.sum("tf").alias("tf"))
    n = corpus.select(doc).distinct().count()
    df = counted.groupBy("term").agg((F.log((1 + n) / (1 + F.count(F.lit(1)))) + 1).alias("idf"))
    raw = counted.join(df, "term").select("doc", "term", (F.col("tf") * F.col("idf")).alias("raw"))
    size = raw.groupBy("doc").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("size"))
    return raw.join(size, "doc").select("doc", "term", (F.col("raw") / F.col("size")).alias("weight"))


def _rows(batch: pa.RecordBatch, width: int) -> np.ndarray:
    """The vectors of a batch, of which a list may hold several, one after the other."""
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _list(matrix: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """Lists of a row each, or of the rows up to each of the ends."""
    ends = np.arange(1, len(matrix) + 1) if ends is None else ends
    flat = pa.array(np.ascontiguousarray(matrix, dtype=np.float64).ravel())
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32) * matrix.shape[1], pa.int32()), flat)


def times(table: DataFrame, small: np.ndarray) -> DataFrame:
    """key, v: every vector multiplied by a small matrix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ends = np.cumsum(b.column("v").value_lengths().to_numpy()) // len(small)
            yield pa.record_batch([b.column("key"), _list(_rows(b, len(small)) @ small, ends)], names=["key", "v"])

    return table.mapInArrow(run, table.schema)


def _summed(table: DataFrame, width: int, of: Callable[[np.ndarray], np.ndarray], size: int) -> np.ndarray:
    """The sum over all batches of `size` numbers made of their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for b in batches:
            total += of(_rows(b, width))
        yield pa.record_batch([pa.array(np.arange(size)), pa.array(total)], names=["at", "x"])

    out = np.zeros(size)
    for r in table.mapInArrow(run, "at long, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r["x"]
    return out


def gram(table: DataFrame, width: int) -> np.ndarray:
    """The inner products of all pairs of components over the rows: a width x width matrix."""
    return _summed(table, width, lambda m: (m.T @ m).ravel(), width * width).reshape(width, width)


def whitened(g: np.ndarray) -> np.ndarray:
    """What makes columns with these inner products orthonormal; columns of no length of their own go."""
    values, vectors = np.linalg.eigh(g)
    good = values > max(values.max(initial=0), 0) * 1e-12
    return vectors[:, good] / np.sqrt(values[good])


class Blocks:
    """Documents and the weights of their words in blocks, which are made where the documents lie.

    A block is cut into tiles, one for each group of words, and one of its own words, which no other block has.
    What is multiplied goes once to each group for each document, and is not shuffled for each word of a block.

    rows: doc, words, and their weights, or null for 1 each; rows are documents. With `idf`, sums of equal words
    are multiplied by ln((1 + n) / (1 + df)) + 1 and brought to length 1 for each document.
    """

    def __init__(self, rows: DataFrame, idf: bool = False, width: int = 64 + SPARE, seed: int = 0, block_weights: int = BLOCK_WEIGHTS, block_docs: int = BLOCK_DOCS, group_bytes: int = GROUP_BYTES) -> None:
        if "term" in rows.columns:
            rows, both = kept(rows), F.collect_list(F.struct("term", "weight"))
            facts = rows.agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("doc").alias("docs")).first()
            rows = rows.repartition(max(1, -(-facts["n"] // block_weights), -(-facts["docs"] // block_docs)), "doc").groupBy("doc").agg(both.alias("all")).select("doc", F.col("all.term").alias("words"), F.col("all.weight").alias("weights"))
        spark, self.kind, self.width = rows.sparkSession, dict(rows.dtypes)["doc"], width
        names = "docs array<{}>, n int, terms binary, df binary, counts binary, col binary, val binary".format(self.kind)
        blocks = kept(rows.select("doc", "words", "weights").mapInArrow(partial(_packed, block_weights, block_docs), f"key long, {names}"))
        #: A row for each word of a block, with the number of the block's documents that have it.
        self.words = blocks.select("key", "terms", "df").mapInArrow(_words, "key long, at int, term string, n int")
        facts = blocks.agg(F.sum(F.size("docs")).alias("docs"), F.sum("n").alias("words")).first()
        vocabulary = self.words.agg(F.approx_count_distinct("term")).first()[0] if facts["words"] else 0
        tasks = min(spark.sparkContext.defaultParallelism, MOST_TASKS, -(-(facts["words"] or 0) // TASK_WORDS))
        self.places = _places(spark, max(1, tasks, -(-vocabulary * width * 8 // group_bytes)))
        place = F.element_at(self._groups(), F.pmod(F.xxhash64("term"), F.lit(len(self.places))).cast("int") + 1)
        hashes = [F.xxhash64("term", F.lit(seed), F.lit(j // 64)).alias(f"h{j // 64}") for j in range(0, width, 64)]
        dealt = self.words.select("key", "at", place.alias("t"), "term", "n", *hashes).repartition(len(self.places), "t").sortWithinPartitions("term")
        numbered = dealt.mapInArrow(_numbered, "key long, at int, t long, code int, df int, " + ", ".join(f"h{j} long" for j in range(len(hashes))))
        settled = numbered.groupBy("key").cogroup(blocks.groupBy("key")).applyInArrow(
            partial(_settled, facts["docs"] or 0, idf, width), f"key long, t long, docs array<{self.kind}>, v array<double>, {', '.join(f'{c} binary' for c in TILE)}"
        )
        #: A row for each group of words that a block has, and one, of t = -1, of its own words, with its documents.
        self.table = kept(settled)
        self.n = facts["docs"] if idf else None

    def _groups(self) -> Column:
        return F.array(*map(F.lit, self.places)).cast("array<long>")

    def signs(self) -> DataFrame:
        """key, v: sums by weight of the random signs of a document's words."""
        return self.table.filter("t = -1").select("key", "v")

    def _met(self, other: DataFrame, *order: str) -> DataFrame:
        """The tiles of each group of words and rows of other(t, part, key, v) in one task, in order."""
        tiles = self.table.filter("t >= 0").select("t", F.lit(-1).alias("part"), "key", F.lit(None).cast("array<double>").alias("v"), *TILE)
        both = tiles.unionByName(other.select("t", "part", "key", "v"), allowMissingColumns=True)
        return both.repartition(len(self.places), "t").sortWithinPartitions("t", *order)

    def of_terms(self, documents: DataFrame, width: int) -> DataFrame:
        """t, part, v: for the words of each group, in parts, sums by weight of the vectors of documents(key, v), a list for each block."""
        copies = documents.select(F.explode(self._groups()).alias("t"), F.lit(0).alias("part"), "key", "v")
        return self._met(copies, "key", F.desc("part")).mapInArrow(partial(_term_sums, self.n, width), "t long, part int, v array<double>")

    def of_own(self, documents: DataFrame, width: int) -> DataFrame:
        """key, v, gram: what a block's own words give back to its documents, and inner products of their vectors."""
        n = self.n

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    one = b.slice(i, 1)
                    tile, y = _Tile(one, 0, n), _rows(one, width)
                    z = tile.of_terms(y)
                    yield pa.record_batch([one.column("key"), _list(out := tile.of_documents(z), np.array([len(out)])), _list((z.T @ z).reshape(1, -1))], names=["key", "v", "gram"])

        own = self.table.filter("t = -1").select("key", *TILE).hint("merge")
        return own.join(documents.select("key", "v"), "key").mapInArrow(run, "key long, v array<double>, gram array<double>")

    def of_documents(self, terms: DataFrame, own: DataFrame, back: np.ndarray) -> DataFrame:
        """key, v: sums by weight of the vectors of terms(t, part, v) and of a block's own words, times a matrix, for each document."""
        width = len(back)

        def run(parts: pa.Table) -> pa.Table:
            total = sum(parts.column("v")[i].values.to_numpy() for i in range(parts.num_rows)).reshape(-1, width) @ back
            return pa.table([parts.column("key").slice(0, 1), _list(total, np.array([len(total)]))], names=["key", "v"])

        shared = self._met(terms.withColumn("key", F.lit(None).cast("long")), F.desc(F.col("part") >= 0), "part", "key")
        sums = shared.mapInArrow(partial(_document_sums, self.n, width), "key long, v array<double>")
        return sums.unionByName(own.select("key", "v")).groupBy("key").applyInArrow(run, "key long, v array<double>")

    def unpacked(self, documents: DataFrame) -> DataFrame:
        """key (a document), v."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    one = b.slice(i, 1)
                    docs = one.column("docs").flatten()
                    yield pa.record_batch([docs, _list(one.column("v").flatten().to_numpy().reshape(len(docs), -1))], names=["key", "v"])

        both = self.table.filter("t = -1").select("key", "docs").hint("merge").join(documents, "key").select("docs", "v")
        return both.mapInArrow(run, f"key {self.kind}, v array<double>")


def _wrap(values: np.ndarray | pa.Array) -> bytes:
    """An array as compressed bytes."""
    values, sink = values if isinstance(values, pa.Array) else pa.array(values), pa.BufferOutputStream()
    batch = pa.record_batch([values], names=["x"])
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _open(found: pa.Scalar) -> pa.Array:
    return pa.ipc.open_stream(found.as_buffer()).read_next_batch().column(0)


def _numbers(found: pa.Scalar) -> np.ndarray:
    return _open(found).to_numpy()


def _places(spark: SparkSession, count: int) -> list[int]:
    """As many numbers, which as keys of a shuffle of that many partitions go to one each."""
    found: dict[int, int] = {}
    n = 16 * count + 64
    while len(found) < count:
        found = {r["p"]: r["id"] for r in spark.range(n).select("id", F.pmod(F.hash("id"), F.lit(count)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).collect()}
        n *= 2
    return sorted(found.values())


def _packed(most_weights: int, most_docs: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of documents that follow each other in a partition; weights of equal words are added up."""
    first, made, held, n_held = TaskContext.get().partitionId() << 32, 0, [], 0

    def block() -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        docs, words, weights = (table.column(c).combine_chunks() for c in ("doc", "words", "weights"))
        sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy()
        found = pc.dictionary_encode(words.flatten())
        value = np.ones(len(found))
        value[np.repeat(pc.is_valid(weights).to_numpy(zero_copy_only=False), sizes)] = weights.flatten().to_numpy(zero_copy_only=False)
        n = max(1, len(found.dictionary))
        at = np.repeat(np.arange(len(docs)), sizes) * n + found.indices.to_numpy()
        order = np.argsort(at, kind="stable")
        at = at[order]
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        value = np.add.reduceat(value[order], starts) if len(starts) else np.zeros(0)
        row, col = np.divmod(at[starts], n)
        parts = [found.dictionary, np.bincount(col, minlength=len(found.dictionary)).astype(np.int32), np.bincount(row, minlength=len(docs)).astype(np.int32), np.diff(col, prepend=0).astype(np.int32), value]
        docs = pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)
        blobs = [pa.array([_wrap(x)], pa.binary()) for x in parts]
        return pa.record_batch([pa.array([first + made]), docs, pa.array([len(found.dictionary)], pa.int32()), *blobs], names=["key", "docs", "n", "terms", "df", "counts", "col", "val"])

    for b in batches:
        ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(b.column("words")), 0).to_numpy())])
        lo = 0
        while lo < b.num_rows:
            fits = int(np.searchsorted(ends, ends[lo] + most_weights - n_held, "right")) - 1 - lo
            fits = min(max(fits, 0 if held else 1), most_docs - sum(x.num_rows for x in held), b.num_rows - lo)
            if fits > 0:
                held.append(b.slice(lo, fits))
                n_held, lo = n_held + int(ends[lo + fits] - ends[lo]), lo + fits
            else:
                yield block()
                made, held, n_held = made + 1, [], 0
                pa.default_memory_pool().release_unused()
    if held:
        yield block()


def _words(batches: Iterator[pa.RecordBatch], step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(b.num_rows):
            terms, df = _open(b.column("terms")[i]), _open(b.column("df")[i])
            for lo in range(0, len(terms), step):
                some = terms.slice(lo, step)
                yield pa.record_batch([pa.array(np.full(len(some), b.column("key")[i].as_py())), pa.array(np.arange(lo, lo + len(some), dtype=np.int32)), some, df.slice(lo, step)], names=["key", "at", "term", "n"])


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words in order of term, with the documents that have a term, and its number in the group, -1 in a single block."""
    last, used = None, {}

    def run(table: pa.Table) -> pa.RecordBatch:
        codes = pc.dictionary_encode(table.column("term").combine_chunks()).indices.to_numpy()
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        size = np.diff(starts, append=len(codes))
        t, df, code = table.column("t").to_numpy(), np.add.reduceat(table.column("n").to_numpy(), starts), np.full(len(starts), -1, np.int32)
        for group in np.unique(t[starts]).tolist():
            some = np.flatnonzero((size > 1) & (t[starts] == group))
            code[some] = used.get(group, 0) + np.arange(len(some))
            used[group] = used.get(group, 0) + len(some)
        code = np.repeat(code, size)
        signs = [c for c in table.column_names if c[0] == "h"]
        columns = [table.column("key"), table.column("at"), pa.array(np.where(code < 0, -1, t)), pa.array(code), pa.array(np.repeat(df, size).astype(np.int32)), *table.select(signs).columns]
        return pa.table(columns, names=["key", "at", "t", "code", "df", *signs]).combine_chunks().to_batches()[0]

    for b in batches:
        if not b.num_rows:
            continue
        table = pa.Table.from_batches([b] if last is None else [*last.to_batches(), b])
        # the last term's rows may go on in the next batch
        terms = table.column("term")
        lo = pc.index(terms, terms[-1]).as_py()
        if lo:
            yield run(table.slice(0, lo).combine_chunks())
        last = table.slice(lo)
    if last is not None:
        yield run(last.combine_chunks())


def _settled(n: int, idf: bool, width: int, words: pa.Table, block: pa.Table) -> pa.Table:
    """A block's tiles, and its documents with the sums of their words' signs."""
    words = words.combine_chunks()
    docs, counts = block.column("docs")[0].values, _numbers(block.column("counts")[0])
    row, col = np.repeat(np.arange(len(docs), dtype=np.int32), counts), np.cumsum(_numbers(block.column("col")[0]), dtype=np.int32)
    val = _numbers(block.column("val")[0])
    order = np.argsort(words.column("at").to_numpy())
    t, code, df = (words.column(c).to_numpy()[order] for c in ("t", "code", "df"))
    h = np.stack([words.column(c).to_numpy()[order] for c in words.column_names if c[0] == "h"], 1)
    weight = val * _idf(df, n if idf else None)[col]
    length = np.sqrt(np.bincount(row, weight * weight, len(docs))) if idf else np.ones(len(docs))
    inv = np.divide(1, length, out=np.zeros(len(docs)), where=length > 0)
    bit = np.arange(width)
    weight *= inv[row]
    v = _sums(row, col, weight, len(docs), lambda at: 1.0 - 2 * ((h[at][:, bit // 64] >> (bit % 64)) & 1), width)
    del weight, h
    out = {"key": [], "t": [], "docs": [], "v": []} | {c: [] for c in TILE}
    of = t[col]
    for group in sorted({-1, *np.unique(t).tolist()}):
        some = np.flatnonzero(of == group)
        has = np.flatnonzero(t == group)
        # words in the order of their numbers in the group
        has = has[np.argsort(code[has], kind="stable")]
        place = np.zeros(len(t), np.int32)
        place[has] = np.arange(len(has), dtype=np.int32)
        at = place[col[some]]
        by = np.lexsort((at, row[some]))
        tile = (code[has], df[has], np.bincount(row[some], minlength=len(docs)).astype(np.int32), np.diff(at[by], prepend=0).astype(np.int32), val[some][by], inv)
        out["key"].append(block.column("key")[0].as_py())
        out["t"].append(group)
        for c, x in zip(TILE, tile, strict=True):
            out[c].append(_wrap(x))
    many = len(out["key"])
    first = lambda values: pa.ListArray.from_arrays(pa.array([0, *[len(values)] * many], pa.int32()), values)
    columns = [pa.array(out["key"], pa.int64()), pa.array(out["t"], pa.int64()), first(docs), first(pa.array(v.ravel())), *[pa.array(out[c], pa.binary()) for c in TILE]]
    return pa.table(columns, names=list(out))


def _idf(df: np.ndarray, n: int | None) -> np.ndarray:
    return np.ones(len(df)) if n is None else np.log((1 + n) / (1 + df)) + 1


class _Tile:
    """The weights of a block's documents for some words; n: of documents, or null where weights are as given."""

    def __init__(self, batch: pa.RecordBatch, i: int, n: int | None) -> None:
        self.codes, df, counts, col, val, inv = (_numbers(batch.column(c)[i]) for c in TILE)
        self.row, self.col, self.docs = np.repeat(np.arange(len(counts), dtype=np.int32), counts), np.cumsum(col, dtype=np.int32), len(counts)
        self.weight = val * _idf(df, n)[self.col] * inv[self.row]

    def of_terms(self, y: np.ndarray) -> np.ndarray:
        order = np.argsort(self.col, kind="stable")
        return _sums(self.col[order], self.row[order], self.weight[order], len(self.codes), y.__getitem__, y.shape[1])

    def of_documents(self, z: np.ndarray) -> np.ndarray:
        return _sums(self.row, self.col, self.weight, self.docs, z.__getitem__, z.shape[1])


def _term_sums(n: int | None, width: int, batches: Iterator[pa.RecordBatch], step: int = 1 << 14) -> Iterator[pa.RecordBatch]:
    """Rows in order of group and block, a block's vectors before its tile."""
    group, used, z, key, y = None, 0, np.zeros((0, width)), None, None

    def ended() -> Iterator[pa.RecordBatch]:
        for lo in range(0, used, step):
            some = z[lo : min(used, lo + step)]
            yield pa.record_batch([pa.array([group]), pa.array([lo // step], pa.int32()), _list(some, np.array([len(some)]))], names=["t", "part", "v"])

    for b in batches:
        for i in range(b.num_rows):
            if b.column("t")[i].as_py() != group:
                yield from ended()
                group, used, z = b.column("t")[i].as_py(), 0, np.zeros((0, width))
            if b.column("part")[i].as_py() >= 0:
                key, y = b.column("key")[i].as_py(), b.column("v")[i].values.to_numpy().reshape(-1, width)
            else:
                assert key == b.column("key")[i].as_py()
                tile = _Tile(b, i, n)
                used = max(used, int(tile.codes.max(initial=-1)) + 1)
                if used > len(z):
                    z = np.concatenate([z, np.zeros((max(used, len(z) * 5 // 4) - len(z), width))])
                z[tile.codes] += tile.of_terms(y)
    yield from ended()


def _document_sums(n: int | None, width: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of group, the vectors of its words before its tiles."""
    group, parts, z = None, [], None
    for b in batches:
        for i in range(b.num_rows):
            if b.column("t")[i].as_py() != group:
                group, parts, z = b.column("t")[i].as_py(), [], None
            if b.column("part")[i].as_py() >= 0:
                parts.append(b.column("v")[i].values.to_numpy().reshape(-1, width).copy())
            else:
                if z is None:
                    z, parts = np.concatenate(parts), []
                tile = _Tile(b, i, n)
                out = _sums(tile.row, tile.col, tile.weight, tile.docs, lambda at, of=z, by=tile.codes: of[by[at]], width)
                yield pa.record_batch([b.column("key").slice(i, 1), _list(out, np.array([len(out)]))], names=["key", "v"])


def _sums(to: np.ndarray, source: np.ndarray, weight: np.ndarray, count: int, take: Callable[[np.ndarray], np.ndarray], width: int, step: int = 1 << 14) -> np.ndarray:
    """Sums by weight of the vectors that sources name, for each of `count` rows that they go to, which ascend."""
    out = np.zeros((count, width))
    for lo in range(0, len(to), step):
        some = slice(lo, lo + step)
        starts = np.flatnonzero(np.diff(to[some], prepend=-1))
        out[to[some][starts]] += np.add.reduceat(take(source[some]) * weight[some, None], starts)
    return out


def fit(weights: DataFrame, k: int, spare: int = SPARE, rounds: int = ROUNDS, seed: int = 0, **sizes: int) -> tuple[DataFrame, np.ndarray]:
    """key (the document), v: coordinates along the k leading directions; and the singular values.

    weights has doc, term and weight.
    """
    found, values = _fitted(Blocks(weights, False, k + spare, seed, **sizes), k, rounds)
    return (found, values) if len(values) else (found.limit(0), values)


def _fitted(blocks: Blocks, k: int, rounds: int) -> tuple[DataFrame, np.ndarray]:
    y, spark = blocks.signs(), blocks.table.sparkSession
    # what the tiles were made of
    blocks.words = None
    release(spark)
    small = whitened(gram(y, blocks.width))
    if not small.size:
        return blocks.unpacked(times(y, np.zeros((blocks.width, 0)))), np.zeros(0)
    for _ in range(rounds):
        y = times(y, small)
        z, own = kept(blocks.of_terms(y, small.shape[1])), kept(blocks.of_own(y, small.shape[1]))
        y = None
        release(spark)
        back = whitened(gram(z, small.shape[1]) + _added(own, small.shape[1]))
        y = kept(blocks.of_documents(z, own, back))
        z = own = None
        release(spark)
        small = whitened(gram(y, back.shape[1]))
    basis, width = times(y, small), small.shape[1]
    values, turn = np.linalg.eigh(gram(blocks.of_terms(basis, width), width) + _added(blocks.of_own(basis, width), width))
    turn, values = turn[:, ::-1][:, :k], np.sqrt(np.maximum(values[::-1][:k], 0))
    turned = kept(times(basis, turn * values))
    totals = _summed(turned, len(values), lambda m: m.sum(0), len(values))
    flip = np.where(totals < 0, -1.0, 1.0)
    return blocks.unpacked(times(turned, np.diag(flip))), values


def _added(own: DataFrame, width: int) -> np.ndarray:
    """The sum of the inner products that blocks' own words have."""
    return _summed(own.select(F.col("gram").alias("v")), width * width, lambda m: m.sum(0), width * width).reshape(width, width)


def bags(corpus: DataFrame, doc: str, text: str, remove_stopwords: bool = True) -> DataFrame:
    """doc, words, weights: a row for each document; weights are null where each word counts for 1.

    Documents whose id no other row has stay where they lie; the words of the others are counted in a shuffle.
    """
    each = corpus.select(F.col(doc).alias("doc"), tokens(F.col(text), remove_stopwords).alias("words"))
    none = F.lit(None).cast("array<double>").alias("weights")
    again = corpus.groupBy(F.col(doc).alias("__doc")).count().filter("count > 1").select("__doc")
    if again.isEmpty():
        return each.select("doc", "words", none)
    again, same = kept(again), F.col("doc").eqNullSafe(F.col("__doc"))
    counted = each.join(again, same, "left_semi").select("doc", F.explode_outer("words").alias("term")).groupBy("doc", "term").count()
    lists = counted.groupBy("doc").agg(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", F.col("count").cast("double").alias("n")))).alias("all"))
    return each.join(again, same, "left_anti").select("doc", "words", none).unionByName(lists.select("doc", F.col("all.term").alias("words"), F.col("all.n").alias("weights")))


def document_vectors(corpus: DataFrame, doc: str, text: str, k: int = 64, remove_stopwords: bool = True, **kw: int) -> DataFrame:
    """doc, vector: k components for each document; fewer directions than k are filled with zeros."""
    sizes = {name: kw.pop(name) for name in list(kw) if name not in ("spare", "rounds")}
    blocks = Blocks(bags(corpus, doc, text, remove_stopwords), True, k + kw.get("spare", SPARE), **sizes)
    found, values = _fitted(blocks, k, kw.get("rounds", ROUNDS))
    padded = F.concat("v", F.array_repeat(F.lit(0.0), k - len(values))) if len(values) < k else F.col("v")
    # an id that is null equals none
    vector = F.when(F.col("key").isNotNull(), padded).otherwise(F.array_repeat(F.lit(0.0), k))
    return found.select(F.col("key").alias(doc), vector.alias("vector"))
