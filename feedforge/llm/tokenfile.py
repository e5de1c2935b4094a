"""Token-id files of directly addressable codes (operator 8).

A file is a table of segments in ascending doc_id order, written by Spark, so that a task that an
executor's loss repeats leaves no half-written part. Segments are stored uncompressed beside their
smallest and largest doc_id, so that a reader of one token opens the pages of one segment alone. A
segment holds the ids of several documents:

    "DAC1", then two little-endian unsigned 32-bit numbers: documents, levels
    doc_ids (signed 64-bit), a bitmap of null ones (lowest bit first), first ids (unsigned 64-bit,
    one more than documents)
    for each level: number of codes (unsigned 64-bit), one byte a code, the continuation bitmap
    (first code in the lowest bit), the rank directory (unsigned 32-bit: bits set before each 512)

A code is eight bits of an id, lowest first; its bit says whether the id goes on in the next level,
at the place that the rank of the bit gives. So any id is found by one look at each level, and any
stretch of ids by one stretch of each level.

Edge cases: null and empty texts have the end id only; rows with one doc_id follow each other, by
the hash of their text; null ids come first; an empty table writes no segment.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedforge.llm.common import bucket_of, range_count, ranges, slices
from feedforge.llm.tokens import library_encoder, texts_of

MAGIC = b"DAC1"
RANK_BITS = 512
#: Ids after which a segment ends; a longer document is one segment.
SEGMENT_IDS = 1 << 18


def pack(doc_ids: list[int | None], docs: list[np.ndarray]) -> bytes:
    """A segment of documents' ids."""
    ids = np.concatenate(docs).astype(np.uint32) if docs else np.zeros(0, np.uint32)
    starts = np.concatenate(([0], np.cumsum([len(d) for d in docs]))).astype("<u8")
    levels = []
    rest = ids
    while len(rest) or not levels:
        on = rest > 255
        bits = np.packbits(on, bitorder="little")
        filled = np.zeros(-(-len(bits) // (RANK_BITS // 8)) * (RANK_BITS // 8), np.uint8)
        filled[: len(bits)] = bits
        counts = np.bitwise_count(filled).reshape(-1, RANK_BITS // 8).sum(1)
        rank = np.concatenate(([0], np.cumsum(counts)))[:-1].astype("<u4")
        levels.append(struct.pack("<Q", len(rest)) + (rest & 255).astype(np.uint8).tobytes() + bits.tobytes() + rank.tobytes())
        rest = rest[on] >> 8
        if not len(rest):
            break
    head = MAGIC + struct.pack("<2I", len(docs), len(levels))
    known = np.array([i or 0 for i in doc_ids], "<i8")
    null = np.packbits(np.array([i is None for i in doc_ids], bool), bitorder="little")
    return head + known.tobytes() + null.tobytes() + starts.tobytes() + b"".join(levels)


class Segment:
    """Reads a segment without decoding it."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of token ids")
        n, levels = struct.unpack_from("<2I", raw, 4)
        at = 12
        ids, empty = np.frombuffer(raw, "<i8", n, at).tolist(), -(-n // 8)
        null = np.unpackbits(np.frombuffer(raw, np.uint8, empty, at + 8 * n), count=n, bitorder="little")
        self.doc_ids = [None if absent else i for i, absent in zip(ids, null.tolist(), strict=True)]
        at += 8 * n + empty
        self.starts = np.frombuffer(raw, "<u8", n + 1, at).astype(np.int64)
        at += 8 * n + 8
        self.levels = []
        for _ in range(levels):
            (count,) = struct.unpack_from("<Q", raw, at)
            size = -(-count // 8)
            codes, bits = np.frombuffer(raw, np.uint8, count, at + 8), np.frombuffer(raw, np.uint8, size, at + 8 + count)
            blocks = -(-size // (RANK_BITS // 8))
            rank = np.frombuffer(raw, "<u4", blocks, at + 8 + count + size)
            self.levels.append((codes, bits, rank))
            at += 8 + count + size + 4 * blocks

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def _rank(self, level: int, i: int) -> int:
        """Continuation bits before the i-th code of a level, by its rank directory."""
        _, bits, rank = self.levels[level]
        block = i // RANK_BITS
        lo = block * RANK_BITS // 8
        inside = int(np.bitwise_count(bits[lo : i >> 3]).sum())
        rest = int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0
        return int(rank[block]) + inside + rest

    def at(self, i: int) -> int:
        """The i-th id, by one look at each level it reaches."""
        value = 0
        for level, (codes, bits, _) in enumerate(self.levels):
            value |= int(codes[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def ids(self, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The ids from lo to hi: the codes of a stretch go on in one stretch of the next level."""
        hi = len(self) if hi is None else hi
        out = np.zeros(hi - lo, np.uint32)
        where = np.arange(hi - lo)
        for level, (codes, bits, _) in enumerate(self.levels):
            out[where] |= codes[lo:hi].astype(np.uint32) << np.uint32(8 * level)
            on = np.unpackbits(bits[lo >> 3 : -(-hi // 8)], bitorder="little").view(bool)[lo & 7 : (lo & 7) + hi - lo]
            where = where[on]
            if not len(where):
                break
            lo = self._rank(level, lo)
            hi = lo + len(where)
        return out


SEGMENTS = "bucket int, number long, before long, n_ids long, low long, high long, data binary"


def _segments(batches: Iterator[pa.RecordBatch], path: str, end: bytes, limit: int) -> Iterator[pa.RecordBatch]:
    """(bucket, doc_id, text) in order -> segments, with the ids before each in its bucket and its doc_ids' bounds."""
    encode = library_encoder(path, "byte")
    bucket, before, held, size, number = None, 0, [], 0, 0

    def done() -> pa.RecordBatch:
        raw = pack([i for i, _ in held], [np.frombuffer(x, "<u2") for _, x in held])
        known = [i for i, _ in held if i is not None]
        row = [bucket, number, before, size, min(known, default=None), max(known, default=None)]
        return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int32()), *(pa.array([x], pa.int64()) for x in row[1:]), pa.array([raw], pa.binary())], names=["bucket", "number", "before", "n_ids", "low", "high", "data"])

    for batch in slices(batches, 2, rows=600):
        coded = encode(texts_of(batch.column(2)))
        for b, i, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), coded, strict=True):
            if held and (b != bucket or size >= limit):
                yield done()
                before, number, held, size = (before + size, number + 1, [], 0) if b == bucket else (0, 0, [], 0)
            bucket = b
            held.append((i, ids + end))
            size += len(ids) // 2 + 1
    if held:
        yield done()


def write_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", segment_ids: int = SEGMENT_IDS) -> None:
    """Encode every text with a byte-level BPE and write the table of segments."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = range_count(docs.sparkSession)
    bounds = ranges(base, "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)) + 8, n)
    placed = base.withColumn("bucket", bucket_of(F.col("doc_id"), bounds)).repartitionById(n, "bucket").sortWithinPartitions("bucket", "doc_id", F.xxhash64("text"))
    code = partial(_segments, path=tokenizer, end=end_id.to_bytes(2, "little"), limit=segment_ids)
    placed.select("bucket", "doc_id", "text").mapInArrow(code, SEGMENTS).write.option("compression", "uncompressed").parquet(folder)


def id_at(spark: SparkSession, folder: str, doc_id: int, i: int) -> int:
    """The i-th id of a document (of the first, where rows share its doc_id), from its segment alone."""
    hit = spark.read.parquet(folder).filter((F.col("low") <= doc_id) & (F.col("high") >= doc_id)).orderBy("bucket", "number").select("data").limit(1).collect()
    seg = Segment(bytes(hit[0]["data"])) if hit else None
    if seg is None or doc_id not in seg.doc_ids:
        raise KeyError(doc_id)
    k = seg.doc_ids.index(doc_id)
    if not 0 <= i < seg.starts[k + 1] - seg.starts[k]:
        raise IndexError(i)
    return seg.at(int(seg.starts[k]) + i)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2, rows=4):
        for bucket, before, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            seg = Segment(raw)
            at = seg.starts
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([bucket] * len(seg.doc_ids), pa.int32()),
                    pa.array(seg.doc_ids, pa.int64()),
                    pa.array(before + at[:-1], pa.int64()),
                    pa.array(np.diff(at), pa.int64()),
                    pa.array([seg.ids(a, b).astype("<u4").tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.binary()),
                ],
                names=["bucket", "doc_id", "start", "n_tokens", "ids"],
            )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _documents(batches):
        crc = pa.array([zlib.crc32(x) for x in batch.column(4).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([*batch.columns[:4], crc], names=["bucket", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_ids(spark: SparkSession, folder: str, digest: bool = False) -> DataFrame:
    """doc_id, start in the whole file, n_tokens and ids (four bytes each), or ids_crc32 in their place."""
    table = spark.read.parquet(folder)
    sums = sorted((r["bucket"], r["n"]) for r in table.groupBy("bucket").agg(F.sum("n_ids").alias("n")).collect())  # a row a bucket
    starts, total = [], 0
    for b, n in sums:
        starts.append((b, total))
        total += n
    last = "ids_crc32 long" if digest else "ids binary"
    docs = table.select("bucket", "before", "data").mapInArrow(_digests if digest else _documents, f"bucket int, doc_id long, start long, n_tokens long, {last}")
    offsets = F.broadcast(spark.createDataFrame(starts, "bucket int, offset long"))
    return docs.join(offsets, "bucket").withColumn("start", F.col("start") + F.col("offset")).drop("bucket", "offset")
