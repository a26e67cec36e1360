"""Registered queries of the training-data operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyrook.llm.langid import identify

    return identify(_table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyrook.llm.jaccard_join import jaccard_join

    return jaccard_join(_table(spark, sf_dir, "documents"), shingle=3, num=90, den=100)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyrook.llm.token_files import token_counts

    return token_counts(_table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyrook.llm.licenses import scan

    return scan(_table(spark, sf_dir, "documents"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyrook.llm.url_filter import filter_urls

    return filter_urls(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyrook.llm.repetition import quality_rules

    return quality_rules(_table(spark, sf_dir, "documents")).drop("longest_repeat")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyrook.llm.mixing import mix_plan

    return mix_plan(_table(spark, sf_dir, "documents"))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyrook.llm.suffix_dedup import removal_digests

    return removal_digests(_table(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyrook.llm.decontaminate import containment_search

    return containment_search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyrook.llm.chat import format_digests, with_probe

    return format_digests(with_probe(_table(spark, sf_dir, "conversations")))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyrook.llm.filter_audit import filter_audit

    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyrook.llm.quality_rank import rank_quality

    return rank_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tallyrook.llm.prefix_trie import prefix_trie

    return prefix_trie(_table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    named = (
        op1_language_id,
        op2_ngram_jaccard_join,
        op3_token_counts,
        op4_license_scans,
        op5_url_filters,
        op6_quality_rules,
        op7_source_mixing,
        op8_suffix_array_dedup,
        op9_benchmark_decontamination,
        op10_chat_formatting,
        op11_filter_audit,
        op12_quality_rank,
        op13_prefix_trie,
        pipeline,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from tallyrook.llm import chat, decontaminate, filter_audit, mixing, prefix_trie, repetition, url_filter

    return {
        "op5_url_filters": url_filter.ORACLE,
        "op6_quality_rules": repetition.ORACLE,
        "op7_source_mixing": mixing.ORACLE,
        "op9_benchmark_decontamination": decontaminate.ORACLE,
        "op10_chat_formatting": chat.ORACLE,
        "op11_filter_audit": filter_audit.ORACLE,
        "op13_prefix_trie": prefix_trie.ORACLE,
    }
