"""Queries of the training-data operators, with their checking SQL (None: tested by brute force)."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddsloom.llm import (
    chat,
    divergence,
    jaccard,
    langid,
    licenses,
    mtree,
    nbest,
    packing,
    quality,
    sharding,
    token_counts,
    token_files,
    whitening,
)
from oddsloom.session import apply_engine_conf, stage_path

Build = Callable[[SparkSession, str], DataFrame]
LLM_CATALOG: dict[str, tuple[Build, str | None]] = {}


def importable(spark: SparkSession) -> None:
    """Puts this repository on the import path of Python workers (a cluster may ship it otherwise)."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p and p != root]
    env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def register(name: str, sql: str | None = None):
    def wrap(build: Build) -> Build:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return build(apply_engine_conf(spark), sf_dir)

        LLM_CATALOG[name] = (run, sql)
        return build

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@register("op1_quality_rules", quality.QUERY_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


@register("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.HashTree.even(4, 2, 5))


def byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@register("op4_token_files")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = stage_path(spark, "token-files")
    files = token_files.write(table(spark, sf_dir, "documents"), folder, byte_bpe())
    return token_files.read(spark, folder, files)


@register("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs.select("doc_id", "text"), docs).select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"
    )


@register("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe())


@register("op6_preference_pairs", chat.QUERY_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = chat.conversations(table(spark, sf_dir, "conversations"))
    return chat.preference_pairs(chat.with_borrowed_replies(convs)).select(
        "conv_id",
        "n_common",
        "prompt",
        chat.rendered(F.col("chosen_segments")).alias("chosen"),
        chat.rendered(F.col("rejected_segments")).alias("rejected"),
        chat.mask(F.col("chosen_segments")).alias("chosen_mask"),
        chat.mask(F.col("rejected_segments")).alias("rejected_mask"),
        "usable",
    )


@register("op7_exact_top_k", mtree.QUERY_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        "vec_id", mtree.quantized(F.col("embedding")).alias("vector")
    )
    return mtree.top_k(vectors, vectors.filter("vec_id % 50 = 0"))


@register("op3_ngram_jaccard")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(table(spark, sf_dir, "documents"), words=4, percent=85)


@register("op5_license_scan")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), licenses.ALL_NOTICES)


@register("op10_nbest_segmentation")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    return nbest.segment(table(spark, sf_dir, "documents"), model)


@register("op11_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@register("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    counted = token_counts.prefix_counts(table(spark, sf_dir, "documents"), model)
    return counted.select("doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars")


@register("op13_source_divergence", divergence.QUERY_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))
