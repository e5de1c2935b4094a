"""The registered queries of this subpackage; their SQL is in `oracles`."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedforge.llm import bpe, fingerprints, licenses, lines, neardup, negatives, packing, quality, repeats, secrets, tokenfile, toxicity, turns
from feedforge.llm.common import checkpoint, delete_folder, read, shared_folder


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.verdicts(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(read(spark, sf_dir, "documents"), percent=85)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"), percent=85)


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(read(spark, sf_dir, "documents"))


def op4_curve_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digest=True)


def op5_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(read(spark, sf_dir, "documents"), digest=True).drop("text_hash")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-ids-{uuid.uuid4().hex}"
    try:
        tokenfile.write_ids(read(spark, sf_dir, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
        return checkpoint(tokenfile.read_ids(spark, folder, digest=True))
    finally:
        delete_folder(spark, folder)


def fingerprint_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The classes of operator 2 by themselves, without the edited texts."""
    return fingerprints.near_classes(read(spark, sf_dir, "documents"), percent=85)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = lines.dedup_lines(read(spark, sf_dir, "documents"), counts=True)
    return cleaned.select("doc_id", "n_lines", "n_removed_lines", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vec = read(spark, sf_dir, "embeddings"), F.col("vec_id")
    label = F.when(vec % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = rows.select("vec_id", label.alias("label"), negatives.quantised(F.col("embedding"), 256).alias("embedding"))
    return negatives.mine_negatives(rows, vec % 100 == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair(turns.damaged(read(spark, sf_dir, "conversations")), times=F.col("times"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan_secrets(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    base = secrets.KINDS[:3]
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base], F.sha2(listed(of(*base)), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_near_dedup, op2_fingerprints, op3_license_scan, op4_curve_packing, op5_bpe_codec, op6_toxicity, op7_suffix_dedup, op8_token_files, op9_line_dedup, op10_quality_rules, op11_hard_negatives, op12_conversation_repair, op13_secret_scan, fingerprint_classes)}
