"""Sinks: tables, candidates by split, submissions."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_candidates(df: DataFrame, path: str) -> None:
    """One folder a split; splits of earlier runs go."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("split").parquet(path)


def read_candidates(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One split, by partition pruning; raises where there is none."""
    out = spark.read.parquet(path).filter(F.col("split") == split)
    if out.isEmpty():
        raise ValueError(f"no candidates of split {split} in {path}")
    return out


def write_submission(lines: DataFrame, path: str, order: str, header: str | None = None) -> None:
    """Lines of text in order of a column, with a header where the format has one."""
    body = lines.select(F.col(order).alias("__o"), F.col("line").alias("value"))
    if header is not None:
        top = lines.sparkSession.createDataFrame([(header,)], "value string").select(F.lit(None).cast(dict(lines.dtypes)[order]).alias("__o"), "value")
        body = top.unionByName(body)
    body.orderBy(F.asc_nulls_first("__o")).select("value").write.mode("overwrite").text(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def zip_file(source: str, target: str) -> None:
    """A zip archive of a local file."""
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        z.write(source, os.path.basename(source))


def write_vectors(df: DataFrame, path: str, key: str = "article_id", vector: str | None = None) -> None:
    """key and vector as floats: of the column named, else of document_vector, else of the last one; null keys and vectors go."""
    column = vector or ("document_vector" if "document_vector" in df.columns else df.columns[-1])
    df.select(F.col(key).cast("string").alias(key), F.col(column).cast("array<float>").alias("vector")).dropna().write.mode("overwrite").parquet(path)
