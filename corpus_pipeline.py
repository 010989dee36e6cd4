"""A corpus pipeline: language ID, exact dedup, n-gram Jaccard dedup, decontamination, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veinwork.llm.byte_bpe import token_table
from veinwork.llm.decontaminate import without_benchmark
from veinwork.llm.exact_dedup import distinct_documents
from veinwork.llm.language_id import known_languages
from veinwork.llm.ngram_join import one_of_each_group
from veinwork.llm.workspace import shared_folder, written

STAGES = [
    ("language_id", known_languages),
    ("exact_dedup", distinct_documents),
    ("ngram_join", one_of_each_group),
    ("decontaminate", without_benchmark),
    ("byte_bpe", token_table),
]

#: Language prediction and encoding are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared_folder(spark)
    for k, (name, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/{k}_{name}")
    return docs
