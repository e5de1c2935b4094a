"""What several operators of this subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Space and the ASCII controls 9 to 13, the separators of words.
WORD_BREAK = r"[\x20\x09-\x0D]+"


#: Gives freed memory back to the system, where the C library can, for workers that idle between tasks.
give_back = getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named in spark.checkpoint.dir.

    Only a local session, as in tests, gets a folder of this machine where none is named; it goes when
    the driver ends. On a cluster that is an error.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="feedforge-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)
    return named


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared folder, eagerly.

    The files outlive a lost executor. Spark deletes them once nothing refers to them any more if the
    session was started with spark.cleaner.referenceTracking.cleanCheckpoints, as build_session does.
    """
    context = df.sparkSession.sparkContext
    folder = shared_folder(df.sparkSession)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def release(spark: SparkSession, rounds: int = 1) -> None:
    """Have Spark delete the shuffle files of tables that nothing refers to any more.

    Its cleaner follows the driver's garbage collection, which a large heap may not need for hours.
    The last job's tables may be held for a moment after it; more rounds, half a second apart, get
    these too.
    """
    for i in range(rounds):
        if i:
            time.sleep(0.5)
        gc.collect()
        spark.sparkContext._jvm.System.gc()


def delete_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder that this library wrote, on whatever file system it is."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that the table has not, whatever its case."""
    taken = {c.lower() for c in df.columns}
    name = f"__{stem}"
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate a value once and use it several times inside one expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def slices(batches: Iterator[pa.RecordBatch], *columns: int, rows: int = 512, size: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut into parts of bounded rows and, as far as single rows allow, bytes of the columns given.

    A batch that Spark sends has a bounded size too; the session's settings for it stay as they are.
    """
    for batch in batches:
        ends = np.zeros(batch.num_rows, np.int64)
        for c in columns:
            ends += pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(ends)
        at, before = 0, 0
        while at < batch.num_rows:
            stop = min(at + rows, max(at + 1, int(np.searchsorted(ends, before + size, "right"))))
            yield batch.slice(at, stop - at)
            at, before = stop, int(ends[stop - 1])


def ranges(df: DataFrame, key: str, weight: Column, buckets: int) -> list[int]:
    """Ascending upper bounds that deal a long key into ranges of about equal weight.

    Eight times as many ranges of about equal rows come from a mergeable sketch; their weights are
    summed, and neighbours are joined. What reaches the driver grows with the number of ranges, not
    with the rows.
    """
    shares = [i / (8 * buckets) for i in range(1, 8 * buckets)]
    if buckets < 2:
        return []
    found = df.agg(F.percentile_approx(F.col(key), F.lit(shares), F.lit(max(10_000, 40 * buckets))).alias("q")).first()["q"]
    fine = sorted(set(found or []))
    sums = {r["b"]: r["w"] for r in df.groupBy(bucket_of(F.col(key), fine).alias("b")).agg(F.sum(weight).alias("w")).collect()}
    return joined_ranges(fine, [sums.get(i, 0) or 0 for i in range(len(fine) + 1)], buckets)


def joined_ranges(bounds: list[int], weights: list[int], buckets: int) -> list[int]:
    """Bounds that leave about equal sums of the weights of the ranges between all bounds."""
    up_to = np.cumsum(weights[:-1]) if bounds else np.zeros(0)
    at = np.searchsorted(up_to, np.arange(1, buckets) * (sum(weights) / buckets))
    return [bounds[i] for i in sorted(set(at[at < len(bounds)].tolist()))]


def bucket_of(key: Column, bounds: list[int]) -> Column:
    """The number of bounds below the key, 0 for null: a search in two steps over a constant array."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    constant = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    below = lambda xs, k: F.size(F.filter(xs, lambda b: b < k))
    coarse, fine = constant(bounds[step - 1 :: step]), constant(bounds)
    if len(bounds) < step:
        return F.coalesce(below(fine, key), F.lit(0))
    found = let(key, lambda k: let(below(coarse, k) * step, lambda lo: lo + below(F.slice(fine, lo + 1, F.lit(step)), k)))
    return F.when(key.isNull(), 0).otherwise(found).cast("int")


def range_count(spark: SparkSession) -> int:
    """Ranges that a table is dealt into: two for each shuffle partition."""
    return 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))


def flag_members(df: DataFrame, key: Column, keys: DataFrame, name: str, per_key: int = 8, most_bits: int = 1 << 26) -> DataFrame:
    """df with a boolean column: false only where the 64-bit key is certainly not among the keys (one long column).

    The keys become a bitmap of `per_key` bits each or more, up to `most_bits`, so that what is broadcast
    has at most 8 MB at any scale; beyond that the flag is true more often and never wrong.
    """
    bits = 1 << 15
    n = keys.count()
    while bits < min(per_key * n, most_bits):
        bits *= 2
    place = lambda k: F.pmod(k, F.lit(bits))
    at, bucket, map_ = (fresh(df, x) for x in ("at", "bucket", "bits"))
    set_ = keys.select(place(F.col(keys.columns[0])).alias("p"))
    maps = set_.groupBy(F.expr("p div 32768").alias(bucket)).agg(F.bitmap_construct_agg(F.expr("p % 32768")).alias(map_))
    placed = df.withColumn(at, place(key))
    joined = placed.join(F.broadcast(maps), F.expr(f"`{at}` div 32768") == F.col(bucket), "left")
    byte = F.conv(F.hex(F.expr(f"substring(`{map_}`, cast((`{at}` % 32768) div 8 as int) + 1, 1)")), 16, 10).cast("int")
    on = F.expr(f"shiftleft(1, cast(`{at}` % 8 as int))")
    return joined.withColumn(name, F.coalesce(byte.bitwiseAND(on) != 0, F.lit(False))).drop(at, bucket, map_)
