"""Packing along a space-filling curve (operator 4).

A document's tokens are hashed into a vector of signs that is projected onto three dimensions. Its
mean over the tokens, less the mean of the corpus, is scaled to length one, so that the direction
tells what the document is about and its length in tokens has no part in it. The cell that the
direction falls in has a Hilbert key, and documents are range-sorted by that key, so that neighbours
on the curve, which share vocabulary, land in the same sequences. The order is cut every 2048 ids.
Where a range ends, the remainder is cut at powers of two, which need no padding; so nothing is padded.

Every document is encoded once, into a checkpoint. The corpus mean is the mean over all its tokens, from
sums of whole numbers, so that it is the same in any order. The bounds of the ranges come from a
mergeable sketch of all keys and from the tokens that all documents have between its quantiles
(`common.ranges`); they balance the tasks and decide where ranges end. Equal texts share a key; a hash
of doc_id below it spreads them over as many ranges as they fill.

Edge cases: a null or empty text has the end id only; null ids sort first among equal keys; repeated
rows are packed each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedforge.llm.common import bucket_of, checkpoint, range_count, ranges, slices
from feedforge.llm.shingles import mix
from feedforge.llm.tokens import library_encoder, texts_of

LENGTH = 2048
DIMENSIONS, BITS = 3, 10
_SEED = np.uint64(0xA0761D6478BD642F)


def projections(size: int) -> np.ndarray:
    """A row of signs for each of `size` hashed tokens."""
    ids = np.arange(size * DIMENSIONS, dtype=np.uint64) + _SEED
    return ((mix(ids) >> np.uint64(63)).astype(np.float32) * 2 - 1).reshape(size, DIMENSIONS)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of cells (rows of coordinates under 2 ** bits).

    From the highest bit down, each coordinate's bit either reflects the lower bits of the first
    axis or swaps them with its own; a Gray code of what is left gives the key.
    """
    x = [cells[:, d].astype(np.uint64) for d in range(cells.shape[1])]
    one = np.uint64(1)
    for b in range(bits - 1, 0, -1):
        high, low = np.uint64(1 << b), np.uint64((1 << b) - 1)
        for d in range(len(x)):
            on = (x[d] & high) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if d:
                x[d] = x[d] ^ swap
    for d in range(1, len(x)):
        x[d] = x[d] ^ x[d - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip = np.where((x[-1] >> np.uint64(b)) & one != 0, flip ^ np.uint64((1 << b) - 1), flip)
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for c in x:
            key = key << one | ((c ^ flip) >> np.uint64(b)) & one
    return key


_signs: dict[int, np.ndarray] = {}


def directions(ids: list[np.ndarray]) -> np.ndarray:
    """The sums of the signs of each document's tokens."""
    size = 1 << 16
    if size not in _signs:
        _signs[size] = projections(size)
    flat = np.concatenate(ids)
    at = np.concatenate(([0], np.cumsum([len(x) for x in ids])[:-1]))
    return np.add.reduceat(_signs[size][flat], at, axis=0, dtype=np.float64).astype(np.int64)


def curve_keys(means: np.ndarray, center: np.ndarray, doc_ids: np.ndarray) -> np.ndarray:
    """Hilbert key of the direction from the centre above, hash of doc_id below, as one signed 64-bit key."""
    away = means - center
    unit = away / np.maximum(np.sqrt((away * away).sum(1)), 1e-12)[:, None]
    cells = np.clip((0.5 + 0.5 * unit) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.uint64)
    return ((hilbert(cells) << np.uint64(32)) | (mix(doc_ids.astype(np.uint64)) >> np.uint64(32))).astype(np.int64)


def _known(column: pa.Array) -> np.ndarray:
    """Ids to hash; where they are null, the rows' places in the batch."""
    ids = column.fill_null(0).to_numpy(zero_copy_only=False)
    return np.where(column.is_null().to_numpy(zero_copy_only=False), np.arange(len(ids)), ids)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, end: int) -> Iterator[pa.RecordBatch]:
    encode, last = library_encoder(path, "word"), end.to_bytes(2, "little")
    for batch in slices(batches, 1, rows=600):
        raw = [x + last for x in encode(texts_of(batch.column(1)))]
        sums = directions([np.frombuffer(x, "<u2") for x in raw])
        sizes = pa.array([len(x) // 2 for x in raw], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_known(batch.column(0)), pa.int64()), pa.array(raw, pa.binary()), sizes, *map(pa.array, sums.T)], names=["doc_id", "known", "ids", "n", *"xyz"])


def _key(center: np.ndarray) -> Column:
    """The key of a row of _encoded(); its ids stay where they are."""

    @F.pandas_udf("long")
    def key(known, n, x, y, z):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series(curve_keys(np.stack([x, y, z], 1) / n.to_numpy()[:, None], center, known.to_numpy()))

    return key("known", "n", *"xyz")


def corpus_center(coded: DataFrame) -> np.ndarray:
    """The mean signs of all tokens."""
    n, *sums = coded.agg(*[F.sum(F.col(c)) for c in ("n", *"xyz")]).first()
    return np.array(sums, np.float64) / n if n else np.zeros(DIMENSIONS)


class _Packer:
    """Cuts one range after another into sequences; the open sequence's pieces are held until it is full."""

    def __init__(self, length: int):
        self.length, self.bucket, self.done = length, None, []
        self.begin(None)

    def begin(self, bucket: int | None) -> None:
        self.bucket, self.number, self.open, self.filled = bucket, 0, [], 0

    def close(self, pieces: list[tuple]) -> None:
        name, offset = (self.bucket << 40) + self.number, 0
        for doc, start, data, total in pieces:
            n = len(data) // 4
            self.done.append((doc, start, n, zlib.crc32(data), total, name, offset, data))
            offset += n
        self.number += 1

    def add(self, doc: int | None, raw: bytes) -> None:
        data = np.frombuffer(raw, "<u2").astype("<u4").tobytes()
        total, at = len(data) // 4, 0
        while at < total:
            n = min(total - at, self.length - self.filled)
            self.open.append((doc, at, data[4 * at : 4 * (at + n)], total))
            self.filled += n
            at += n
            if self.filled == self.length:
                self.close(self.open)
                self.open, self.filled = [], 0

    def end(self) -> None:
        """Cut what is left at powers of two."""
        while self.filled:
            size = 1 << (self.filled.bit_length() - 1)
            taken, n = [], 0
            while n < size:
                doc, at, data, total = self.open.pop(0)
                fit = min(len(data) // 4, size - n)
                taken.append((doc, at, data[: 4 * fit], total))
                if 4 * fit < len(data):
                    self.open.insert(0, (doc, at + fit, data[4 * fit :], total))
                n += fit
            self.close(taken)
            self.filled -= size

    def batch(self, digest: bool) -> pa.RecordBatch:
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        columns = list(zip(*self.done, strict=True)) or [()] * 8
        arrays = [pa.array(c, pa.int64()) for c in columns[:7]]
        self.done = []
        return pa.RecordBatch.from_arrays(arrays, names=names) if digest else pa.RecordBatch.from_arrays([*arrays, pa.array(columns[7], pa.binary())], names=[*names, "ids"])


def _packed(batches: Iterator[pa.RecordBatch], length: int, digest: bool) -> Iterator[pa.RecordBatch]:
    packer = _Packer(length)
    for batch in slices(batches, 2, rows=600):
        for bucket, doc, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != packer.bucket:
                packer.end()
                packer.begin(bucket)
            packer.add(doc, raw)
        yield packer.batch(digest)
    packer.end()
    yield packer.batch(digest)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids unless digest."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    n = range_count(docs.sparkSession)
    coded = checkpoint(base.mapInArrow(partial(_encoded, path=tokenizer, end=end_id), "doc_id long, known long, ids binary, n long, x long, y long, z long"))
    key = _key(corpus_center(coded)).alias("key")
    bounds = ranges(checkpoint(coded.select(key, "n")), "key", F.col("n"), n)
    dealt = coded.select(key, "doc_id", "ids").withColumn("bucket", bucket_of(F.col("key"), bounds)).repartitionById(n, "bucket").sortWithinPartitions("bucket", "key", "doc_id")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.select("bucket", "doc_id", "ids").mapInArrow(partial(_packed, length=length, digest=digest), schema if digest else f"{schema}, ids binary")
