"""The registered queries of this subpackage: thin, whole tables in, digests out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folia.llm import bpe, byte_bpe, decontaminate, filter_audit, hard_negatives, langid, licenses, pii, quality, secrets, simhash, token_counts, topk
from folia.llm.oracle import ORACLE_SQL


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), keep=["doc_id"])


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = topk.binary_codes(_table(spark, sf_dir, "embeddings"), keep=["vec_id"])
    return topk.top_k(codes, codes.where(F.col("vec_id") % 20 == 0))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"), keep=["doc_id"]).select("doc_id", "held_out", "lang_pred", "score")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), keep=["doc_id"], digests=True)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_table(spark, sf_dir, "documents"), keep=["doc_id"])


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digests(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return quality.quality(_table(spark, sf_dir, "documents"), trusted)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.document_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = hard_negatives.whole_vectors(_table(spark, sf_dir, "embeddings"), label=shifted)
    return hard_negatives.hard_negatives(rows, F.col("id") % 100 == 0)


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe.byte_bpe_encode(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], digests=True)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_token_counts": op2_token_counts,
    "op3_topk": op3_topk,
    "op4_langid": op4_langid,
    "op5_secrets": op5_secrets,
    "op6_bpe": op6_bpe,
    "op7_licenses": op7_licenses,
    "op8_pii": op8_pii,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op11_filter_audit": op11_filter_audit,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_byte_bpe": op13_byte_bpe,
}

__all__ = ["ORACLE_SQL", "QUERIES"]
