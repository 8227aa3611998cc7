"""The corpus pipeline: documents through quality rules, line dedup, near-duplicate removal,
benchmark decontamination and packing. Each stage takes what its predecessor kept.

All stages but the last return the columns of documents. Quality rules drop rejected documents;
line dedup deletes later repeated runs of lines and keeps every document; of each group of
near duplicates the document of the smallest id stays; documents that hold a benchmark item go;
packing returns a row per piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import common
from quillon.llm.op01_decontamination import clean_rows
from quillon.llm.op04_jaccard import survivors
from quillon.llm.op05_lines import cleaned
from quillon.llm.op06_quality import kept_rows
from quillon.llm.op08_packing import pack


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return kept_rows(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return cleaned(docs).select(*docs.columns)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return survivors(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_rows(docs, common.table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]
# Tokens and the packing's assignment are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
