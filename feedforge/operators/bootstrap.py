"""Bootstrap confidence intervals.

`mean_ci` draws numpy's sequence for a seed, as published results do. The sequence is cut into
stretches, as its generator can be set ahead and a draw is taken or not by its own bits only; counts
of the draws taken in each stretch say which run and place its draws belong to. `poisson_ci` resamples without bringing
rows together: each row counts a Poisson(1) number of times in each run, drawn from a digest.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from feedforge.operators.doc_vectors import kept
from feedforge.operators.order import numbered


def numpy_mean_ci(values: np.ndarray, runs: int = 1000, seed: int = 42, chunk: int = 100) -> tuple[float | None, float | None, float | None]:
    """Mean and the 2.5 and 97.5 percentiles of resampled means; nulls for no values."""
    if not len(values):
        return None, None, None
    rng, means = np.random.default_rng(seed), []
    for lo in range(0, runs, chunk):
        means.append(values[rng.integers(0, len(values), size=(min(chunk, runs - lo), len(values)))].mean(axis=1))
    low, high = np.percentile(np.concatenate(means), [2.5, 97.5])
    return float(values.mean()), float(low), float(high)


def _raws(seed: int, start: int, count: int) -> np.ndarray:
    """32-bit draws start to start + count of numpy's generator, start being even: halves of its words, lower ones first."""
    words = np.random.PCG64(seed).advance(start // 2).random_raw(-(-count // 2))
    return words.astype("<u8", copy=False).view("<u4")[:count]


def _placed(raws: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The place below n that each draw names, and whether numpy takes the draw (Lemire's rule), whatever went before."""
    wide = raws.astype(np.uint64) * np.uint64(n)
    return (wide >> np.uint64(32)).astype(np.int64), wide.astype(np.uint32) >= np.uint32((1 << 32) % n)


def _raw_count(n: int, runs: int) -> int:
    """Draws that give n * runs taken ones but for a chance of 20 standard deviations."""
    share = 1 - ((1 << 32) % n) / (1 << 32)
    return int(n * runs / share + 20 * (n * runs) ** 0.5 * (1 - share) ** 0.5 / share) + 64


def mean_ci(df: DataFrame, group: str, order: str, value: str, runs: int = 1000, seed: int = 42, block_rows: int = 1 << 23, stretch: int = 1 << 22, parts: int = 16) -> DataFrame:
    """group, value, ci_low, ci_high; null values stay out.

    A task has a block of a group's values and a share of the stretches of draws, and sums what the
    stretches draw from the block; sums of runs are added up in a fixed order.
    """
    kind, packed_rows, spread = dict(df.dtypes)[group], min(block_rows, 1 << 16), 2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(group).alias("__g"), F.col(order).alias("__by"), F.col(value).cast("double").alias("__v"))
    known = rows.filter(F.col("__v").isNotNull())
    # nulls of the order last, as in a table that is sorted by it
    at = kept(numbered(known, F.struct("__g", F.col("__by").isNull().alias("n"), "__by"), "__ix").select("__g", "__ix", "__v"))
    sizes = at.groupBy("__g").agg(F.min("__ix").alias("__first"), F.count(F.lit(1)).alias("__n"))
    if sizes.filter(F.col("__n") > 1 << 32).limit(1).count():
        raise ValueError("numpy draws places above 2^32 in another way")
    total = F.udf(lambda n: _raw_count(n, runs), "long")
    pieces = sizes.select("__g", "__n", total("__n").alias("__raws")).withColumn("__of", F.explode(F.sequence(F.lit(0), F.expr(f"(__raws - 1) div {stretch}"))))

    def count(batches):  # noqa: ANN001, ANN202
        for b in batches:
            cols = (b.column(c).to_pylist() for c in ("__n", "__raws", "__of"))
            taken = [int(_placed(_raws(seed, i * stretch, min(stretch, raws - i * stretch)), n)[1].sum()) for n, raws, i in zip(*cols, strict=True)]
            yield pa.record_batch([b.column("__g"), b.column("__of"), pa.array(taken, pa.int64())], names=["__g", "__of", "__taken"])

    counted = pieces.repartition(spread, "__g", "__of").mapInArrow(count, f"__g {kind}, __of long, __taken long")
    taken = counted.groupBy("__g").agg(F.transform(F.sort_array(F.collect_list(F.struct("__of", "__taken"))), lambda x: x["__taken"]).alias("__taken"))
    facts = sizes.join(taken.withColumnRenamed("__g", "__h"), F.col("__g").eqNullSafe(F.col("__h"))).drop("__h").withColumnRenamed("__g", "__h")
    placed = at.join(facts.select("__h", "__first"), F.col("__g").eqNullSafe(F.col("__h"))).select("__g", (F.col("__ix") - F.col("__first")).alias("__at"), "__v")

    def pack(key, table):  # noqa: ANN001, ANN202
        v = table.column("__v").to_numpy()[np.argsort(table.column("__at").to_numpy())]
        return pa.table({"__g": pa.array([key[0].as_py()], table.schema.field("__g").type), "__c": pa.array([key[1].as_py()], pa.int64()), "__b": pa.array([v.tobytes()], pa.binary())})

    packed = placed.withColumn("__c", F.expr(f"__at div {packed_rows}")).groupBy("__g", "__c").applyInArrow(pack, f"__g {kind}, __c long, __b binary")
    block = F.expr(f"(__c * {packed_rows}) div {block_rows}")
    share = F.explode(F.sequence(F.lit(0), F.least(F.size("__taken"), F.lit(parts)) - 1))
    dealt = packed.join(facts, F.col("__g").eqNullSafe(F.col("__h"))).select("__g", block.alias("__block"), "__c", "__b", "__n", "__taken", share.alias("__part"))

    def sums(key, table):  # noqa: ANN001, ANN202
        table = table.sort_by("__c")
        v = np.concatenate([np.frombuffer(x.as_py()) for x in table.column("__b")])
        low, n, taken = table.column("__c")[0].as_py() * packed_rows, table.column("__n")[0].as_py(), table.column("__taken")[0].values.to_numpy()
        starts, raws = np.cumsum(taken) - taken, _raw_count(n, runs)
        if taken.sum() < n * runs:
            raise ValueError("too few draws were taken")
        out: list[tuple[int, int, float]] = []
        for i in range(key[2].as_py(), len(taken), parts):
            place, good = _placed(_raws(seed, i * stretch, min(stretch, raws - i * stretch)), n)
            place = place[good] - low
            first, last = int(starts[i]), min(int(starts[i] + taken[i]), n * runs)
            for r in range(first // n, -(-last // n)):
                mine = place[max(r * n - first, 0) : min((r + 1) * n, last) - first]
                out.append((r, i, float(v[mine[(mine >= 0) & (mine < len(v))]].sum())))
        # the values' own sum goes as run -1, once for each block
        out += [(-1, 0, float(v.sum()))] if key[2].as_py() == 0 else []
        of, at, s = zip(*out, strict=True) if out else ((), (), ())
        same = lambda x, t: pa.array([x] * len(out), t)
        return pa.table({"__g": same(key[0].as_py(), table.schema.field("__g").type), "__block": same(key[1].as_py(), pa.int64()), "__n": same(n, pa.int64()), "__run": pa.array(of, pa.int32()), "__of": pa.array(at, pa.int64()), "__s": pa.array(s, pa.float64())})

    parted = dealt.repartition(spread, "__g", "__block", "__part").groupBy("__g", "__block", "__part").applyInArrow(sums, f"__g {kind}, __block long, __n long, __run int, __of long, __s double")
    added = F.aggregate(F.sort_array(F.collect_list(F.struct("__of", "__block", "__s"))), F.lit(0.0), lambda a, x: a + x["__s"])
    means = parted.groupBy("__g", "__n", "__run").agg((added / F.first("__n")).alias("__m"))

    def ends(key, table):  # noqa: ANN001, ANN202
        run, m = table.column("__run").to_numpy(), table.column("__m").to_numpy()
        lo, hi = np.percentile(m[run >= 0], [2.5, 97.5])
        return pa.table({"__g": pa.array([key[0].as_py()], table.schema.field("__g").type), "value": pa.array(m[run < 0]), "ci_low": pa.array([lo], pa.float64()), "ci_high": pa.array([hi], pa.float64())})

    found = means.groupBy("__g").applyInArrow(ends, f"__g {kind}, value double, ci_low double, ci_high double")
    every = rows.select(F.col("__g").alias(group)).distinct()
    return every.join(found, F.col(group).eqNullSafe(F.col("__g")), "left").select(group, "value", "ci_low", "ci_high")


def poisson_steps(most: int = 8) -> list[float]:
    """The cumulative shares of a Poisson(1) number at which it grows by one, up to `most`."""
    out, p = [], float(np.exp(-1))
    for k in range(1, most + 1):
        out.append((out[-1] if out else 0.0) + p)
        p /= k
    return out


def draws(key: Column, runs: int, seed: int) -> Column:
    """The first 32 bits of each run's digest of a row, runs from 1, as one binary value of 4 * runs bytes."""
    one = lambda r: F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), r.cast("string"))), 1, 8)
    return F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(runs)), one), ""))


def poisson_ci(df: DataFrame, group: str, key: str, value: str, runs: int = 200, seed: int = 42, drawn: str | None = None) -> DataFrame:
    """group, value, ci_low, ci_high from weighted means that are summed before they are shuffled.

    Each batch of rows becomes one row of sums for each of its groups, with a number for each run; rows
    are never repeated by run. `drawn` names a column of `draws` where rows of one key have several
    groups and should draw once. Null values stay out; a group of nulls only has no interval.
    """
    steps = np.array(poisson_steps())
    kind = dict(df.dtypes)[group]

    def sums(batches):  # noqa: ANN001, ANN202
        for b in batches:
            if not b.num_rows:
                continue
            u = np.frombuffer(b"".join(b.column("__u").to_pylist()), ">u4").reshape(-1, runs) / 4294967296.0
            w = np.searchsorted(steps, u, side="right").astype(np.float64)
            codes = pc.dictionary_encode(b.column(group), null_encoding="encode")
            ids, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary
            v = b.column("__v").to_numpy(zero_copy_only=False)
            hits = [np.flatnonzero(ids == g) for g in range(len(names))] if len(names) < 64 else np.split(np.argsort(ids, kind="stable"), np.cumsum(np.bincount(ids, minlength=len(names)))[:-1])
            yield pa.RecordBatch.from_arrays([names, pa.array([v[h] @ w[h] for h in hits], pa.list_(pa.float64())), pa.array([w[h].sum(axis=0) for h in hits], pa.list_(pa.float64()))], names=[group, "s", "w"])

    known = df.filter(F.col(value).isNotNull())
    rows = known.select(group, F.col(value).cast("double").alias("__v"), (F.col(drawn) if drawn else draws(F.col(key), runs, seed)).alias("__u"))
    partial = rows.mapInArrow(sums, f"`{group}` {kind}, s array<double>, w array<double>")
    each = partial.select(group, F.posexplode(F.arrays_zip("s", "w")).alias("run", "z"))
    weighted = each.groupBy(group, "run").agg((F.sum("z.s") / F.nullif(F.sum("z.w"), F.lit(0.0))).alias("m"))
    ci = weighted.groupBy(group).agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return df.groupBy(group).agg(F.avg(value).alias("value")).join(ci, group).select(group, "value", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


#: MD5's shifts and constants, a step each.
_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def _head(words: list, n: int) -> np.ndarray:
    """The first 32 bits of the MD5 of n blocks, whose words are arrays or, where all blocks have the same one, numbers."""
    start = [np.full(n, x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)]
    a, b, c, d = start
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        if isinstance(words[g], int):
            f += np.uint32((words[g] + _SINES[i]) & 0xFFFFFFFF)
        else:
            f += words[g]
            f += np.uint32(_SINES[i])
        low = f >> np.uint32(32 - _TURNS[i])
        f <<= np.uint32(_TURNS[i])
        f |= low
        f += b
        a, b, c, d = d, f, b, c
    return (a + start[0]).byteswap()


def md5_heads(keys: list[bytes], runs: int) -> np.ndarray:
    """The first 32 bits of the MD5 of "key|run" for each key and each run from 1, as `draws` has them.

    Keys of one length go together, as their blocks differ in few words; 64 digests of a row are most of
    what a resample costs.
    """
    out, lengths = np.empty((len(keys), runs), np.uint32), np.array([len(k) for k in keys])
    for size in np.unique(lengths):
        at = np.flatnonzero(lengths == size)
        mine = [keys[i] for i in at]
        for r in range(1, runs + 1):
            tail = b"|%d\x80" % r
            if size + len(tail) > 56:
                # more than one block
                out[at, r - 1] = [int.from_bytes(hashlib.md5(k + tail[:-1], usedforsecurity=False).digest()[:4]) for k in mine]
                continue
            if r == 1:
                block = np.zeros((len(at), 64), np.uint8)
                block[:, :size] = np.frombuffer(b"".join(mine), np.uint8).reshape(len(at), size)
            block[:, size : size + len(tail)] = np.frombuffer(tail, np.uint8)
            block[:, 56:58] = np.frombuffer((8 * (int(size) + len(tail) - 1)).to_bytes(2, "little"), np.uint8)
            words = block.view("<u4")
            out[at, r - 1] = _head([np.ascontiguousarray(words[:, i]) if 4 * i < size else int(words[0, i]) for i in range(16)], len(at))
    return out


def poisson_weights(rows: DataFrame, key: str, runs: int, seed: int) -> DataFrame:
    """rows with __weights, the Poisson(1) number of each run as a byte, and __drawn, the runs in which it is above zero as bits of long words."""
    steps, width = np.array(poisson_steps()), 8 * -(-runs // 64)
    kinds = StructType([*rows.schema.fields, StructField("__weights", BinaryType()), StructField("__drawn", ArrayType(LongType()))])

    def draw(batches):  # noqa: ANN001, ANN202
        for b in batches:
            if not b.num_rows:
                continue
            u = md5_heads([k.encode() for k in b.column("__u").to_pylist()], runs) / 4294967296.0
            w = np.searchsorted(steps, u, side="right").astype(np.uint8)
            bits = np.zeros((b.num_rows, width), np.uint8)
            some = np.packbits(w > 0, axis=1, bitorder="little")
            bits[:, : some.shape[1]] = some
            words = pa.ListArray.from_arrays(pa.array(np.arange(0, bits.size // 8 + 1, width // 8), pa.int32()), pa.array(bits.reshape(-1).view("<i8")))
            rest = [c for c in b.schema.names if c != "__u"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in rest), pa.array([x.tobytes() for x in w], pa.binary()), words], names=[*rest, "__weights", "__drawn"])

    return rows.withColumn("__u", F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))).mapInArrow(draw, kinds)


def weighted_ci(rows: DataFrame, group: str, metrics: list[str], runs: int, total: str | None = None) -> DataFrame:
    """group, metric, n, value, ci_low, ci_high of each metric's mean over rows(group, __weights, metrics).

    A row crosses to Python once with all its metrics. Each batch becomes one row of sums for each of
    its groups and metrics; `total` names a group that all rows belong to besides. Nulls stay out.
    """
    kind = dict(rows.dtypes)[group]

    def sums(batches):  # noqa: ANN001, ANN202
        for b in batches:
            if not b.num_rows:
                continue
            w = np.frombuffer(b"".join(b.column("__weights").to_pylist()), np.uint8).reshape(-1, runs).astype(np.float64)
            codes = pc.dictionary_encode(b.column(group), null_encoding="encode")
            ids, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
            out: list[tuple] = []
            known = np.array([b.column(m).is_valid().to_numpy(zero_copy_only=False) for m in metrics])
            v = np.where(known, np.array([b.column(m).to_numpy(zero_copy_only=False) for m in metrics], np.float64), 0.0)
            for g, name in enumerate(names):
                at = np.flatnonzero(ids == g)
                mine, some, values = w[at], known[:, at].astype(np.float64), v[:, at]
                out += [x for x in zip([name] * len(metrics), metrics, some.sum(axis=1).astype(int), values.sum(axis=1), values @ mine, some @ mine, strict=True) if x[2]]
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = [codes.dictionary.type, pa.string(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], names=[group, "metric", "n", "v", "s", "w"])

    wide = rows.select(group, "__weights", *[F.col(m).cast("double").alias(m) for m in metrics])
    partial = wide.mapInArrow(sums, f"`{group}` {kind}, metric string, n long, v double, s array<double>, w array<double>")
    # sums of few rows, which are read twice
    partial = kept(partial.withColumn(group, F.explode(F.array(F.lit(total), group))) if total is not None else partial)
    each = partial.select(group, "metric", F.posexplode(F.arrays_zip("s", "w")).alias("run", "z"))
    means = each.groupBy(group, "metric", "run").agg((F.sum("z.s") / F.nullif(F.sum("z.w"), F.lit(0.0))).alias("m"))
    ci = means.groupBy(group, "metric").agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    value = partial.groupBy(group, "metric").agg(F.sum("n").alias("n"), (F.sum("v") / F.sum("n")).alias("value"))
    return value.join(ci, [group, "metric"]).select(group, "metric", "n", "value", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def merged_draws(items: DataFrame, *by: str, words: int = 1) -> DataFrame:
    """The runs in which any row of items(*by, __drawn) is drawn, merged by or before they are shuffled, too."""
    return items.groupBy(*by).agg(F.array(*[F.bit_or(F.get("__drawn", F.lit(w))) for w in range(words)]).alias("__drawn"))


def covered_ci(merged: DataFrame, group: str, size: DataFrame, runs: int) -> DataFrame:
    """group, value, ci_low, ci_high of the share of size(size) that merged(group, __drawn), a row an item, covers."""
    bit = lambda r: F.coalesce(F.sum(F.getbit(F.get("__drawn", F.lit(r // 64)), F.lit(r % 64)).cast("long")), F.lit(0).cast("long"))
    # a column for each run, so that no run's items are listed
    counts = merged.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.array(*[bit(r) for r in range(runs)]).alias("__ns"))
    share = lambda n: n / F.nullif(F.col("size"), F.lit(0))
    shares = counts.crossJoin(F.broadcast(size)).select(group, share(F.col("n")).alias("value"), F.explode(F.transform("__ns", share)).alias("share"))
    ci = shares.groupBy(group).agg(F.first("value").alias("value"), F.percentile("share", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return ci.select(group, "value", F.col("q")[0].alias("ci_low"), F.col("q")[1].alias("ci_high"))


def coverage_ci(items: DataFrame, group: str, key: str, item: str, size: DataFrame, runs: int = 200, seed: int = 42, drawn: str | None = None) -> DataFrame:
    """group, value, ci_low, ci_high of the share of size(size) that the rows' items cover, for items(group, key, item).

    Each row holds the runs it is drawn in as bits of long words, and an item's words are merged by or,
    so that a row costs the same in every run. `drawn` names the column of `poisson_weights`
    where the items have their rows' already; else the items are read twice.
    """
    if drawn is None:
        rows = poisson_weights(items.select(F.col(key)).distinct(), key, runs, seed).select(key, "__drawn")
        items = items.join(rows, key)
    else:
        items = items.withColumn("__drawn", F.col(drawn))
    return covered_ci(merged_draws(items, group, item, words=-(-runs // 64)), group, size, runs)
