"""Runs the stages of a store and skips those that are up to date.

A stage's signature is a digest of its name, its settings and the signatures of its inputs; that of a
source is a digest of the rows it holds, whatever their order and files. A stage's result lies in a
folder named by its signature, so a changed row, setting or earlier stage leads to another folder, and
a folder without its mark of success, as a lost driver leaves it, is written again. All paths are
opened by Spark's file systems, so that they may be anywhere that a cluster reads.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parts between and in place of values; control characters that texts seldom hold.
BETWEEN, NULL = "\x1f", "\x1e"


def table_fingerprint(df: DataFrame) -> DataFrame:
    """One row, n and digest: the rows as a multiset, in any order and with columns in any order.

    Each row's MD5 is cut into four numbers of 32 bits, which are summed apart, so that partial sums
    meet and repeated rows count.
    """
    cell = lambda c, t: F.hex(F.col(f"`{c}`")) if t == "binary" else F.to_json(F.struct(F.col(f"`{c}`"))) if t.startswith("map") else F.col(f"`{c}`").cast("string")
    row = F.concat_ws(BETWEEN, *[F.coalesce(cell(c, t), F.lit(NULL)) for c, t in sorted(df.dtypes)])
    hashed = df.select(F.md5(row).alias("h"))
    lane = lambda i: F.conv(F.substring("h", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")
    sums = hashed.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(lane(i)), F.lit(0)).alias(f"s{i}") for i in range(4)])
    text = [F.lpad(F.lower(F.hex((F.col(f"s{i}") % F.lit(1 << 32)).cast("long"))), 8, "0") for i in range(4)]
    return sums.select("n", F.concat(*text).alias("digest"))


@dataclass(frozen=True)
class Stage:
    """A named step: build gets its inputs, in order, and its settings."""

    name: str
    inputs: tuple[str, ...]
    build: Callable[..., DataFrame]
    settings: Mapping[str, object] = field(default_factory=dict)


@dataclass(frozen=True)
class Done:
    """What a run gave: tables by name, signatures by name, and the stages that were built and not skipped."""

    tables: dict[str, DataFrame]
    signatures: dict[str, str]
    built: list[str]


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _files(spark, path)
    return fs.exists(p)


def found(spark: SparkSession, pattern: str) -> list[str]:
    """Paths that match a pattern, sorted, on any file system."""
    fs, p = _files(spark, pattern)
    return sorted(s.getPath().toString() for s in fs.globStatus(p) or [])


def signature(stage: Stage, inputs: list[str]) -> str:
    told = json.dumps([stage.name, dict(stage.settings), inputs], sort_keys=True, default=str)
    return hashlib.sha256(told.encode()).hexdigest()[:32]


def run_stages(spark: SparkSession, stages: list[Stage], sources: Mapping[str, DataFrame], folder: str, force: bool = False) -> Done:
    """Build what is not up to date, in the order given, and read all of it; raises on an unknown input.

    What an earlier signature of a stage left goes once the new result is whole.
    """
    known = {s.name for s in stages} | set(sources)
    for s in stages:
        if missing := [i for i in s.inputs if i not in known]:
            raise KeyError(f"{s.name} asks for {missing}")
    tables, signed, built = dict(sources), {}, []
    for s in stages:
        for i in s.inputs:
            if i not in signed:
                r = table_fingerprint(tables[i]).first()
                signed[i] = f"{r['n']}-{r['digest']}"
        signed[s.name] = signature(s, [signed[i] for i in s.inputs])
        path = f"{folder}/{s.name}/{signed[s.name]}"
        if force or not exists(spark, f"{path}/_SUCCESS"):
            s.build(*[tables[i] for i in s.inputs], **s.settings).write.mode("overwrite").parquet(path)
            built.append(s.name)
            for old in found(spark, f"{folder}/{s.name}/*"):
                if not old.endswith(signed[s.name]):
                    fs, p = _files(spark, old)
                    fs.delete(p, True)
        tables[s.name] = spark.read.parquet(path)
    return Done(tables, signed, built)
