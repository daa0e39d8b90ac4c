"""Registered queries of the training-data operators: each reads whole tables under ``sf_dir``."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yieldloom.llm import exact_dedup, html_extract, language, lexical, merkle, minhash, mixing, packing, quality, secrets, token_counts, token_output, toxicity
from yieldloom.llm.common import fold

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_documents(spark, sf_dir), width=3, percent=85)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.schedule(_documents(spark, sf_dir), cut=True)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(_documents(spark, sf_dir))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir), RANKS, public_tokenizers.PATTERN)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    held_out = fold(F.col("doc_id")) == 0
    trees = language.learn(docs.where(~held_out))
    return language.detect(docs.select("doc_id", "text"), trees).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), VOCABULARY)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    rules = quality.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judge(docs, rules)


def op9_token_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_matrices(_documents(spark, sf_dir), VOCABULARY)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold(F.col("doc_id")) == 0
    model = toxicity.learn(docs, labels.where(~held_out))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"), "offending")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.manifest(_documents(spark, sf_dir), merkle.tampered(F.col("text")))
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_documents(spark, sf_dir), PIECES)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_mix_sources": op2_mix_sources,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_secret_scan": op4_secret_scan,
        "op5_language_id": op5_language_id,
        "op6_html_extract": op6_html_extract,
        "op7_pack": op7_pack,
        "op8_quality_rules": op8_quality_rules,
        "op9_token_matrices": op9_token_matrices,
        "op10_toxicity": op10_toxicity,
        "op11_merkle_manifest": op11_merkle_manifest,
        "op12_lexical_search": op12_lexical_search,
        "op13_token_counts": op13_token_counts,
    }
