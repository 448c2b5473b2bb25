"""One query for each operator of this subpackage, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bagminhash, bpe, divergence, langid, linedup, mixing, nndescent, pii, quality, repeats, sharding, suffixtree, toxicity
from .common import crc_fold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_tree_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(_table(spark, sf_dir, "documents"), crc_fold("doc_id", 5) == 1)


def op2_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linedup.dedup_lines(_table(spark, sf_dir, "documents"), keep=["doc_id", "text"])
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op3_weak_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(_table(spark, sf_dir, "documents")))


def op4_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bagminhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "kept")


def op5_pfair_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.near_vectors(_table(spark, sf_dir, "embeddings"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = bpe.encode_decode(_table(spark, sf_dir, "documents"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_compression_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    known = langid.train(docs, crc_fold("doc_id", 4) != 2)
    return langid.identify(docs, known, keep=["doc_id"]).select("doc_id", (crc_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op9_adaptive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def op10_extendible_hash_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(_table(spark, sf_dir, "documents"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.collapse_runs(repeats.with_planted_runs(_table(spark, sf_dir, "documents"))))


def op13_toxicity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = crc_fold("doc_id", 5) == 0
    machine = toxicity.train(docs, _table(spark, sf_dir, "labels"), ~held_out)
    return toxicity.score(docs, machine).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_tree_score": op1_suffix_tree_score,
        "op2_fuzzy_lines": op2_fuzzy_lines,
        "op3_weak_pii": op3_weak_pii,
        "op4_bag_minhash": op4_bag_minhash,
        "op5_pfair_mixing": op5_pfair_mixing,
        "op6_nn_descent": op6_nn_descent,
        "op7_bpe_round_trip": op7_bpe_round_trip,
        "op8_compression_language": op8_compression_language,
        "op9_adaptive_quality": op9_adaptive_quality,
        "op10_extendible_hash_shards": op10_extendible_hash_shards,
        "op11_source_divergence": op11_source_divergence,
        "op12_periodic_runs": op12_periodic_runs,
        "op13_toxicity_machine": op13_toxicity_machine,
    }


def oracle_sql() -> dict[str, str]:
    return {"op9_adaptive_quality": quality.SQL, "op10_extendible_hash_shards": sharding.SQL, "op11_source_divergence": divergence.SQL}
