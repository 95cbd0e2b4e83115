"""The registered queries of the operators: each applies its operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from varsparq.llm import ann, divergence, maintext, mixing, neardup, packing, quality, secretscan, tokencounts, tokenfiles, toxicity, urlfilter, vectorcodes
from varsparq.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES", "MIX"]

#: Target shares of tokens by domain.
MIX = {"low": 0.02, "ordinary": 0.96, "toxic": 0.02}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), words=2, percent=80)


def op3_mixing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), MIX)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), size=2048, end_id=0)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filter(_table(spark, sf_dir, "pages"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.secret_scan(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_files(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=2)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maintext.extract(_table(spark, sf_dir, "pages"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectorcodes.vector_codes(_table(spark, sf_dir, "embeddings"), parts=4, entries=256, rounds=4, scale=1024)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencounts.token_counts(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), limit=512)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"), least=30, smooth=5, ranks=50)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_minhash_near_dedup,
        op3_mixing_rates,
        op4_best_fit_packing,
        op5_url_filter,
        op6_secret_scan,
        op7_toxicity,
        op8_nearest_neighbours,
        op9_token_files,
        op10_main_text,
        op11_vector_codes,
        op12_token_counts,
        op13_source_divergence,
    )
}
