"""From raw documents to packed training sequences.

STAGES are functions of (spark, docs, sf_dir). All but the last return the columns of documents, and
each works on what the one before has kept; `run` writes every stage's result to the shared folder
and reads it again, so that a lost executor costs no more than the stage at hand. Its folder is
deleted stage by stage and goes at the end.

In every stage columns beyond those of documents stay, whatever their names; an empty table gives an
empty table; a null text counts as an empty one. What else each does with odd rows is said below.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from feedforge.llm.common import checkpoint, delete_folder, shared_folder
from feedforge.llm.lines import dedup_lines
from feedforge.llm.neardup import dedup_near
from feedforge.llm.packing import pack_documents
from feedforge.llm.quality import filter_quality
from feedforge.llm.repeats import dedup_repeats


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the fences of their language and source.

    Null and empty texts, having under 50 words, go; a null language or source counts as ''; repeated
    rows stay or go together, and each row by its own language and source; a null doc_id is no matter.
    """
    return filter_quality(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without boilerplate lines; no document goes.

    A null text stays null; a text of boilerplate alone becomes empty; a null source is a site of its
    own; repeated rows count as one text of it and lose the same lines.
    """
    return dedup_lines(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, at a similarity of 0.8.

    The smallest doc_id of a class stays, and of repeated rows one; rows without words or without a
    doc_id all stay; different texts under one doc_id are classed apart.
    """
    return dedup_near(docs, percent=80)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without byte strings that repeat; no document goes.

    A null text stays null; texts under 200 bytes stay whole; repeated rows repeat each other and lose
    all that is 200 bytes or longer; the rest of a character that was cut goes too.
    """
    return dedup_repeats(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids along the curve.

    A null or empty text is one piece of its end id; a null doc_id stays null; repeated rows are packed
    each on its own; a long text becomes several pieces; the order of equal keys follows the doc_id.
    """
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), digest=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("packing", packing),
]

#: Suffix arrays, near copies and packing have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    try:
        for i, (name, stage) in enumerate(STAGES[:-1]):
            here = f"{folder}/{i}-{name}"
            stage(spark, docs, sf_dir).write.parquet(here)
            docs = spark.read.parquet(here)
            if last:
                delete_folder(spark, last)
            last = here
        return checkpoint(STAGES[-1][1](spark, docs, sf_dir))
    finally:
        delete_folder(spark, folder)
