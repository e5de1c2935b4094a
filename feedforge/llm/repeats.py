"""Removal of repeated byte strings by suffix arrays (operator 7).

Every window of 200 bytes has an anchor: the smallest hash of its 32-byte strings, the leftmost on
ties. Equal windows have equal anchors at equal places, so windows are dealt into shards by anchor,
and a run of windows with one anchor is cut out as one slice. Anchors that occur once are dropped;
equal slices of an anchor collapse into one with a count. Slices whose anchor, with half of what a
window has besides on either side, is in no other slice share no window and are dropped too. Shards of
the others get a suffix array by induced sorting and permuted common prefixes (`suffix`); windows that
share 200 bytes with another one, or lie in a slice with a count over one, are repeats. What repeats
cover is removed from every document.

Shards are made of whole anchors and hold about SHARD_BYTES. An anchor with more than WIDE different
slices would be too much for one task; its slices are dealt again as texts with a count, by longer
anchors that close half of what is missing to a window. What the longer anchor tells apart is dropped
or collapses as before, and the rest goes through suffix arrays; at last an anchor is a whole window
and has one slice. Slices are told apart inside one anchor by 64-bit hashes of their bytes, so that a
false match needs two strings around the same 32 bytes to agree in 64 more bits: one in 10 ** 7 for
10 ** 12 such pairs.

Edge cases: null and empty texts, and texts under 200 bytes, lose nothing; repeated rows repeat each
other whole; cuts inside a UTF-8 character drop the rest of it from the returned text, while byte
counts and the digest are of the bytes left; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from feedforge.llm.common import checkpoint, flag_members, fresh, give_back, range_count, release, slices
from feedforge.llm.shingles import mix, powers
from feedforge.llm.suffix import permuted_common_prefixes, suffix_array

LENGTH = 200
GRAM = 32
SHARD_BYTES = 2 << 20
WIDE = 8_000
#: Crowded anchors, of eight bytes each, that are broadcast at most.
FEW = 1_000_000
#: An anchor that lacks fewer bytes than this to a window is followed by whole windows.
LAST = 24
#: Bytes that are hashed at a time; longer texts go in overlapping parts.
PART = 1 << 20
#: Bits of a slice's number of windows; its anchor's place stands above them.
SPAN = 15
_PLACE = np.uint64((1 << 24) - 1)


class _Hashes:
    """Hashes of any stretch of a part, from prefix sums."""

    def __init__(self, raw: bytes):
        self.bytes = np.frombuffer(raw, np.uint8)
        up, self.down = powers(len(self.bytes) + 1)
        values = (self.bytes.astype(np.uint64) + np.uint64(1)) * up[: len(self.bytes)]
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        return mix((self.sums[hi] - self.sums[lo]) * self.down[lo] + (hi - lo).astype(np.uint64))


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each stretch of `width` values, by minima from both ends of blocks of that width."""
    n = len(x)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    table = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(table, 1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _cut(raw: bytes, ends: np.ndarray, length: int, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: anchor hash, slice hash, first window, number of windows and above it the anchor's place in the slice (SPAN), document."""
    n = len(raw)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty
    h = _Hashes(raw)
    at = np.arange(n - gram + 1)
    grams = h.of(at, at + gram)
    low = _sliding_min((grams & ~_PLACE) | at.astype(np.uint64), length - gram + 1)
    place = (low & _PLACE).astype(np.int64)
    windows = np.arange(len(place))
    doc = np.searchsorted(ends, windows, "right")
    whole = windows + length <= ends[doc]
    new = np.ones(len(place), bool)
    new[1:] = (place[1:] != place[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
    first = np.flatnonzero(new & whole)
    # a run ends before the next one begins or where windows leave the document
    bound = np.flatnonzero(np.append(new | ~whole, True))
    count = bound[np.searchsorted(bound, first, "right")] - first
    return grams[place[first]], h.of(first, first + count + length - 1), first, count + ((place[first] - first) << SPAN), doc[first]


def _anchored(batches: Iterator[pa.RecordBatch], length: int, gram: int) -> Iterator[pa.RecordBatch]:
    """A row a text, the third column, with the first two and the arrays of its slices."""
    for batch in slices(batches, 2):
        texts = [x or b"" for x in batch.column(2).cast(pa.binary()).to_pylist()]
        found: list[list[np.ndarray]] = [[] for _ in texts]

        def flush(group: list[tuple[int, int, bytes]]) -> None:
            ends = np.cumsum([len(t) for _, _, t in group])
            anchor, cut, first, count, doc = _cut(b"".join(t for _, _, t in group), ends, length, gram)
            at = np.searchsorted(doc, np.arange(len(group) + 1))
            begins = np.concatenate(([0], ends[:-1]))
            for k, (i, offset, _) in enumerate(group):
                s = slice(at[k], at[k + 1])
                found[i].append([anchor[s].view(np.int64), cut[s].view(np.int64), first[s] - begins[k] + offset, count[s]])

        group, size = [], 0
        for i, t in enumerate(texts):
            # parts overlap by one window less a byte, so that each window is in one part
            for lo in range(0, max(1, len(t) - length + 1), PART):
                part = t[lo : lo + PART + length - 1]
                if size + len(part) > PART and group:
                    flush(group)
                    group, size = [], 0
                group.append((i, lo, part))
                size += len(part)
        if group:
            flush(group)
        columns = [[np.concatenate([p[c] for p in parts]) for parts in found] for c in range(4)]
        as_list = lambda xs, kind: pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in xs]))), pa.int32()), pa.array(np.concatenate(xs), kind))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), *(as_list(xs, kind) for xs, kind in zip(columns, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True))],
            names=[*batch.schema.names[:2], "anchor", "slice", "first", "windows"],
        )
        give_back(0)


def _pieces(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the slices asked for."""
    for batch in slices(batches, 0):
        out: list[tuple] = []
        for text, asked in zip((x or b"" for x in batch.column(0).cast(pa.binary()).to_pylist()), batch.column(1).to_pylist(), strict=True):
            out += [(a["anchor"], a["slice"], a["n"], a["windows"] >> SPAN, text[a["first"] : a["first"] + (a["windows"] & ((1 << SPAN) - 1)) + length - 1]) for a in asked]
        columns = list(zip(*out, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["anchor", "slice", "n", "place", "data"])


def repeated_windows(slices: list[bytes], counts: list[int], length: int) -> list[np.ndarray]:
    """For each of some different slices, which of its windows occur elsewhere, counting equal slices."""
    text = np.frombuffer(b"".join(slices), np.uint8)
    sizes = np.array([len(s) for s in slices])
    ends = np.cumsum(sizes)
    order = suffix_array(text).astype(np.int64)
    shared = permuted_common_prefixes(text, order, length)
    # neighbours in the array with `length` bytes in common are one class of windows
    label = np.cumsum(shared[order] < length)
    owner = np.repeat(np.arange(len(slices)), sizes)[order]
    inside = order + length <= ends[owner]
    weight = np.bincount(label[inside], np.array(counts)[owner[inside]], minlength=label[-1] + 1)
    hit = np.zeros(len(text), bool)
    hit[order[inside]] = weight[label[inside]] > 1
    return [hit[e - n : e - length + 1] for e, n in zip(ends, sizes, strict=True)]


def may_repeat(anchors: list[int], counts: list[int], places: list[int], slices: list[bytes], length: int, gram: int) -> np.ndarray:
    """False only for slices, different under each anchor, that share no window with another one.

    A window has at least half of what it is longer than its anchor on the anchor's left or on its
    right, so that two slices with a common window have one of these longer strings in common.
    """
    sizes = np.array([len(x) for x in slices])
    half = (length - gram) // 2
    left, right = np.empty(len(slices), np.uint64), np.empty(len(slices), np.uint64)
    # slices are hashed in parts, so that prefix sums stay small
    part = np.cumsum(sizes) // (PART // 2)
    for some in np.split(np.arange(len(slices)), np.flatnonzero(np.diff(part)) + 1):
        h = _Hashes(b"".join(slices[some[0] : some[-1] + 1]))
        ends = np.cumsum(sizes[some])
        begins = ends - sizes[some]
        at = begins + np.array(places[some[0] : some[-1] + 1])
        left[some] = h.of(np.maximum(at - half, begins), at + gram)
        right[some] = h.of(at, np.minimum(at + gram + half, ends))
    place = np.array(places)
    key = mix(np.array(anchors, np.int64).view(np.uint64))
    often = np.array(counts) > 1
    for found, whole in ((left, place >= half), (right, place + gram + half <= sizes)):
        some = np.flatnonzero(whole)
        _, which, n = np.unique(found[some] ^ key[some], return_inverse=True, return_counts=True)
        often[some] |= n[which] > 1
    return often


def _runs(flags: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Runs of true in each of some arrays: which array, first and last place in it."""
    # a false before each array keeps runs apart
    begins = np.cumsum([0] + [len(f) + 1 for f in flags])
    marks = np.zeros(begins[-1] + 1, np.int8)
    joined = np.ones(begins[-1] + 1, bool)
    joined[begins] = False
    marks[joined] = np.concatenate(flags)
    edge = np.diff(marks)
    first, last = np.flatnonzero(edge == 1) + 1, np.flatnonzero(edge == -1)
    owner = np.searchsorted(begins, first, "right") - 1
    return owner, first - begins[owner] - 1, last - begins[owner] - 1


def _shards(batches: Iterator[pa.RecordBatch], length: int, gram: int, shard_bytes: int) -> Iterator[pa.RecordBatch]:
    """(anchor, slice, n, place, data) sorted by anchor -> (anchor, slice, lo, hi) of runs of repeated windows."""
    held: list[tuple] = []
    size = 0

    def done() -> pa.RecordBatch:
        anchors, hashes, counts, places, data = zip(*held, strict=True)
        keep = np.flatnonzero(may_repeat(anchors, counts, places, data, length, gram)).tolist()
        give_back(0)
        names, kinds = ["anchor", "slice", "lo", "hi"], (pa.int64(), pa.int64(), pa.int32(), pa.int32())
        if not keep:
            return pa.RecordBatch.from_arrays([pa.array([], t) for t in kinds], names=names)
        owner, lo, hi = _runs(repeated_windows([data[i] for i in keep], [counts[i] for i in keep], length))
        of = lambda xs: np.array([xs[i] for i in keep], np.int64)[owner]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((of(anchors), of(hashes), lo, hi), kinds, strict=True)], names=names)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and row[:2] == held[-1][:2]:
                continue  # the same slice from a repeated row
            if size >= shard_bytes and row[0] != held[-1][0]:
                yield done()
                held, size = [], 0
                give_back(0)
            held.append(row)
            size += len(row[4])
    if held:
        yield done()


def _sliced(texts: DataFrame, length: int, gram: int) -> DataFrame:
    """The first two columns of texts (two longs and the text), an id, and the arrays of slices of those that have any."""
    keys = ", ".join(f"{c} long" for c in texts.columns[:2])
    row = texts.mapInArrow(partial(_anchored, length=length, gram=gram), f"{keys}, anchor array<long>, slice array<long>, first array<int>, windows array<int>")
    # the numbers of rows are fixed by the checkpoint; each is one word where id and hash are two
    return checkpoint(row.filter(F.size("anchor") > 0).withColumn("rid", F.monotonically_increasing_id()))


def _hits(packed: DataFrame, texts: Callable[[DataFrame], DataFrame], weight: Column, length: int, shard_bytes: int, wide: int, gram: int) -> DataFrame:
    """rid, lo, hi of runs of repeated windows, from _sliced().

    texts: from a table asked(rid, asked) to (text, asked); it may repeat rows. weight: how often each
    row's text counts, a column of packed.
    """
    # a table of its own, so that a skewed join with it can be split
    often = packed.select(weight.alias("c"), F.explode("anchor").alias("anchor")).groupBy("anchor").agg(F.sum("c").alias("c"))
    often = checkpoint(often.filter("c > 1").select("anchor"))
    counted = [c for c in ("rid", "n") if c in packed.columns]
    twice = checkpoint(packed.select(*counted, F.inline(F.arrays_zip("anchor", "slice", "first", "windows"))).join(often, "anchor"))

    kinds = twice.groupBy("anchor", "slice").agg(F.sum(weight).alias("n"), F.min(F.struct("rid", "first", "windows")).alias("at"))
    kinds = checkpoint(kinds.select("anchor", "slice", "n", "at.*"))
    release(packed.sparkSession)
    crowded = checkpoint(kinds.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter(F.col("kinds") > wide).select("anchor"))
    n_crowded = 0 if gram >= length else crowded.count()
    finest = not n_crowded
    # each has over `wide` slices; beyond FEW of them the joins below are Spark's to plan
    few = F.broadcast(crowded) if n_crowded <= FEW else crowded

    def pieces(some: DataFrame) -> DataFrame:
        asked = some.groupBy("rid").agg(F.collect_list(F.struct("anchor", "slice", "n", "first", "windows")).alias("asked"))
        return texts(asked).mapInArrow(partial(_pieces, length=length), "anchor long, slice long, n long, place int, data binary")

    usual = pieces(kinds if finest else kinds.join(few, "anchor", "left_anti"))
    sorted_ = usual.repartition(range_count(packed.sparkSession), "anchor").sortWithinPartitions("anchor", "slice")
    found = sorted_.mapInArrow(partial(_shards, length=length, gram=gram, shard_bytes=shard_bytes), "anchor long, slice long, lo int, hi int")
    if not finest:
        longer = (gram + length) // 2 if length - gram > LAST else length
        rest = checkpoint(pieces(kinds.join(few, "anchor", "left_semi")).dropDuplicates(["anchor", "slice"]).withColumn("row", F.monotonically_increasing_id()))
        again = _sliced(rest.select("row", "n", "data"), length, longer)
        rows = again.select("rid", F.col("row").alias("of"))

        def data(asked: DataFrame) -> DataFrame:
            return rest.join(asked.join(rows, "rid"), F.col("row") == F.col("of")).select(F.col("data").alias("text"), "asked")

        hits = _hits(again, data, F.col("n"), length, shard_bytes, wide, longer).join(rows, "rid")
        found = found.unionByName(rest.join(hits, F.col("row") == F.col("of")).select("anchor", "slice", F.col("lo").cast("int"), F.col("hi").cast("int")))
    found = checkpoint(found)
    release(packed.sparkSession)
    return twice.join(found, ["anchor", "slice"]).select("rid", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))


def repeats(docs: DataFrame, length: int = LENGTH, shard_bytes: int = SHARD_BYTES, wide: int = WIDE) -> DataFrame:
    """doc_id, text_hash, runs of the rows of docs(doc_id, text_hash, text) that have repeats: each run's first and last window, in 32 bits each."""
    packed = _sliced(docs.select("doc_id", "text_hash", "text"), length, GRAM)
    names = packed.select("rid", F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))

    def texts(asked: DataFrame) -> DataFrame:
        asked = checkpoint(asked.join(names, "rid"))
        # most texts are not asked for and need no shuffle
        mark = fresh(docs, "asked")
        near = flag_members(docs, _row_key("doc_id", "text_hash"), asked.select(_row_key("i", "h")), mark).filter(mark)
        return near.join(asked, near["doc_id"].eqNullSafe(asked["i"]) & (near["text_hash"] == asked["h"])).select("text", "asked")

    hits = _hits(packed, texts, F.lit(1), length, shard_bytes, wide, GRAM)
    # a run is one word: its first window above, its last below
    runs = hits.groupBy("rid").agg(F.collect_list(F.shiftleft(F.col("lo").cast("long"), 32) + F.col("hi")).alias("runs"))
    # repeated rows have the same runs
    rows = packed.groupBy("doc_id", "text_hash").agg(F.min("rid").alias("rid"))
    return checkpoint(runs.join(rows, "rid").select("doc_id", "text_hash", "runs"))


def _kept(text: bytes, runs: np.ndarray | None, length: int) -> tuple[bytes, int, int]:
    """What is left, bytes removed, maximal removed runs."""
    if runs is None or not len(runs):
        return text, 0, 0
    edge = np.zeros(len(text) + 1, np.int32)
    np.add.at(edge, runs >> 32, 1)
    np.add.at(edge, (runs & 0xFFFFFFFF) + length, -1)
    gone = np.cumsum(edge[:-1]) > 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())


def _cleaned(batches: Iterator[pa.RecordBatch], length: int, digest: bool) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        *keys, texts, runs = batch.columns
        raw = [x or b"" for x in texts.cast(pa.binary()).to_pylist()]
        done = [_kept(t, None if r is None else np.array(r, np.int64), length) for t, r in zip(raw, runs.to_pylist(), strict=True)]
        sizes = [pa.array([len(x) for x in raw], pa.int64()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())]
        last = [hashlib.sha256(d[0]).hexdigest() for d in done] if digest else [d[0].decode("utf-8", "ignore") for d in done]
        yield pa.RecordBatch.from_arrays([*keys, *sizes, pa.array(last, pa.string())], names=["doc_id", "text_hash", "n_bytes", "n_removed", "n_spans", "kept"])


def _row_key(doc_id: str, text_hash: str) -> Column:
    return F.xxhash64(doc_id, text_hash)


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """A row for each row: doc_id, n_bytes, n_removed, n_spans, and the text kept or its digest."""
    base = _keyed(docs, id_col, text_col)
    runs = repeats(base, length).withColumnsRenamed({"doc_id": "i", "text_hash": "h"})
    flagged = flag_members(base, _row_key("doc_id", "text_hash"), runs.select(_row_key("i", "h")), "some")
    some, whole = flagged.filter("some").drop("some"), flagged.filter("not some")
    both = some.join(runs, some["doc_id"].eqNullSafe(runs["i"]) & (some["text_hash"] == runs["h"]), "left").select("doc_id", "text_hash", "text", "runs")
    out = both.mapInArrow(partial(_cleaned, length=length, digest=digest), "doc_id long, text_hash long, n_bytes long, n_removed long, n_spans long, kept string")
    text = F.coalesce("text", F.lit(""))
    kept = F.sha2(text, 256) if digest else text
    # texts without repeats are not shuffled
    rest = whole.select("doc_id", "text_hash", F.octet_length(text).cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), kept.alias("kept"))
    out = out.unionByName(rest)
    return out.withColumnRenamed("kept", "kept_sha256") if digest else out


def dedup_repeats(docs: DataFrame, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without repeated strings, with all their columns."""
    i, h, r, some = (fresh(docs, x) for x in ("id", "hash", "runs", "some"))
    runs = repeats(_keyed(docs, id_col, text_col), length).withColumnsRenamed({"doc_id": i, "text_hash": h, "runs": r})
    key = F.xxhash64(F.col(id_col).cast("long"), F.xxhash64(text_col))
    flagged = flag_members(docs, key, runs.select(_row_key(i, h)), some)
    near = flagged.filter(some)
    both = near.join(runs, near[id_col].cast("long").eqNullSafe(runs[i]) & (F.xxhash64(near[text_col]) == runs[h]), "left")

    @F.pandas_udf("string")
    def left(text, found):  # noqa: ANN001, ANN202
        import pandas as pd

        return pd.Series([t if x is None else _kept(t.encode(), np.array(x, np.int64), length)[0].decode("utf-8", "ignore") for t, x in zip(text, found, strict=True)])

    cleaned = both.withColumn(text_col, F.when(F.col(r).isNull(), F.col(text_col)).otherwise(left(F.col(text_col), F.col(r)))).drop(i, h, r)
    return cleaned.unionByName(flagged.filter(~F.col(some))).drop(some)
