"""Filters, partitions and reshaping of whole tables."""

from __future__ import annotations

import math
from collections.abc import Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from feedforge.functions.scalars import digest_order
from feedforge.operators.order import numbered


def rename_known(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns renamed where they exist."""
    return df.withColumnsRenamed({k: v for k, v in names.items() if k in df.columns})


def from_pairs(spark: SparkSession, pairs: dict, key: str = "keys", value: str = "values") -> DataFrame:
    """A table of a driver-side dictionary's keys and values."""
    keys, values = spark.createDataFrame([(k,) for k in pairs] or [("",)], [key]).schema[0], spark.createDataFrame([(v,) for v in pairs.values()] or [("",)], [value]).schema[0]
    return spark.createDataFrame(list(pairs.items()), f"{key} {keys.dataType.simpleString()}, {value} {values.dataType.simpleString()}")


def at_least(df: DataFrame, col: str, n: float | None) -> DataFrame:
    """Rows whose value (a read time, say) is n or more; no filter without the column, without n, or for n of zero or less."""
    return df.filter(F.col(col) >= n) if col in df.columns and n is not None and n > 0 else df


def with_text(df: DataFrame, col: str) -> DataFrame:
    """Rows whose text has a character or more."""
    return df.filter(F.length(col) > 0)


def split_by(df: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """Rows where the condition holds, and all others, those where it is null among them."""
    holds = F.coalesce(condition, F.lit(False))
    return df.filter(holds), df.filter(~holds)


def split_null(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """Rows without and with a value."""
    return df.filter(F.col(col).isNull()), df.filter(F.col(col).isNotNull())


def last_days(df: DataFrame, time: str, days: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows of dates before the last `days` days up to the latest date, and the rows of those days."""
    latest = df.agg(F.max(F.to_date(time)).cast("string")).first()[0]
    if latest is None:
        return df, df.limit(0)
    return split_by(df, F.to_date(time) < F.date_sub(F.lit(latest).cast("date"), days))


def stack(frames: Iterable[DataFrame]) -> DataFrame:
    """Rows of all tables; columns that a table lacks are null in its rows."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def repeat_rows(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as the number says; rows with zero, less or null go."""
    n = F.greatest(F.coalesce(times, F.lit(0)), F.lit(0))
    return df.withColumn("__i", F.explode(F.array_repeat(F.lit(1), n))).drop("__i")


def fraction(df: DataFrame, share: float, seed: int, *keys: str) -> DataFrame:
    """Exactly int(n * share) rows, those that come first by a digest of seed and keys."""
    ordered = numbered(df, F.struct(digest_order(seed, *[F.col(k) for k in keys]), *keys), "__ix", "__n")
    return ordered.filter(F.col("__ix") < F.floor(F.col("__n") * share)).drop("__ix", "__n")


def top_slate(df: DataFrame, key: str, score: str, n: int) -> DataFrame:
    """The n rows with the greatest score, equal ones by key."""
    return df.orderBy(F.desc_nulls_last(score), key).limit(n)


#: Rounds of the permutation, each with 32 bits of the user's SHA-256 as its key, and the prime of its arithmetic.
ROUNDS, PRIME = 8, 2**31 - 1


def feistel(x: np.ndarray, keys: np.ndarray, size: int) -> np.ndarray:
    """Images of the places x under a permutation of range(size) for each column of keys (ROUNDS x len(x)).

    A place is a pair of digits to the bases of about the root of size, and rounds add a keyed number
    of one digit to the other. What falls on the few pairs beyond size goes on until it falls inside.
    """
    rows, cols = bases(size)
    out, open_ = x.astype(np.int64), np.arange(len(x))
    while len(open_):
        high, low = np.divmod(out[open_], cols)
        for i in range(ROUNDS):
            k = keys[i, open_] % PRIME
            t = ((low if i % 2 == 0 else high) + k) % PRIME
            t = (t * t % PRIME * t + k) % PRIME
            if i % 2 == 0:
                high = (high + t) % rows
            else:
                low = (low + t) % cols
        out[open_] = high * cols + low
        open_ = open_[out[open_] >= size]
    return out


def bases(size: int) -> tuple[int, int]:
    """Two bases near the root of size whose product is size or a little more."""
    rows = max(1, math.isqrt(size))
    return rows, -(-size // rows)


def random_slates(df: DataFrame, key: str, users: DataFrame, user: str, n: int, seed: int) -> DataFrame:
    """user, slate: for each user n items of the table, drawn without replacement among all and in an order of its own.

    Items are put into one order of the seed. A user's slate is what the first n places become under
    the user's own permutation of all places, whose round keys are the SHA-256 of seed and user: no
    item fixes the next one, and no user is paired with all items. Null items are items like others;
    users that are null or repeated have one slate, as equal keys have equal permutations.
    """
    ring = numbered(df.select(F.col(key).alias("__item")).distinct(), F.struct(digest_order(seed, F.col("__item")), "__item"), "__ix", "__n")
    size = ring.count()
    take = min(n, size)
    if size > PRIME:
        raise ValueError(f"places are permuted by numbers below {PRIME}")
    asked = users.select(user).distinct()
    if not take:
        return asked.select(user, F.expr("array()").cast(f"array<{dict(df.dtypes)[key]}>").alias("slate"))
    digest = F.unhex(F.sha2(F.concat_ws("|", F.lit(str(seed)), F.col(user).cast("string")), 256)).alias("__keys")

    def place(batches):  # noqa: ANN001, ANN202
        for b in batches:
            keys = np.frombuffer(b"".join(b.column("__keys").to_pylist()), ">u4").reshape(-1, ROUNDS).T.astype(np.int64)
            which = np.repeat(np.arange(b.num_rows), take)
            p = np.tile(np.arange(take, dtype=np.int64), b.num_rows)
            at = feistel(p, keys[:, which], size)
            yield pa.RecordBatch.from_arrays([b.column(user).take(pa.array(which)), pa.array(p), pa.array(at)], names=[user, "__p", "__at"])

    placed = asked.select(user, digest).mapInArrow(place, f"`{user}` {dict(users.dtypes)[user]}, __p long, __at long")
    found = placed.join(ring, F.col("__at") == F.col("__ix"))
    return found.groupBy(user).agg(F.transform(F.array_sort(F.collect_list(F.struct("__p", "__item"))), lambda s: s["__item"]).alias("slate"))
