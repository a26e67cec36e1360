"""A corpus pipeline of five operators: each stage works on what the one before has kept, written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallyrook.llm import decontaminate, jaccard_join, mixing, repetition, suffix_dedup
from tallyrook.session import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules. A null or empty text fails them; a null doc_id is judged like any; repeated rows
    are judged one by one; an empty table stays empty; other columns stay as they are."""
    return repetition.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the least doc_id, of each group of near duplicates (five words, 0.8). A null doc_id stays."""
    return jaccard_join.keep_one(docs, shingle=5, num=80, den=100)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-byte strings that start in an earlier document too; all rows and columns stay, n_chars follows.
    A null text stays null; a null doc_id counts as later than any; rows of one doc_id don't count against each other."""
    return suffix_dedup.cut_texts(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null texts and items hold nothing; without items all rows stay; other columns too."""
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the mix, with the words taken of each (size, source_size, target, taken replace columns of these names). A
    null source is a source of its own, a null text has no words and isn't taken."""
    return mixing.mixed(docs)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("benchmark decontamination", decontaminated),
    ("mixing to target weights", mix),
]

#: Components and column-wise dedup can't be put in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs, _ = materialize(docs, f"pipeline-{k}")
    return docs
