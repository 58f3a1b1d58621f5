"""A training corpus from raw documents: five stages, each over all rows that the one before kept.

Each stage takes ``(spark, docs, sf_dir)``; its result is written as Parquet and read again as the next one's ``docs``.
All but the last return the columns of ``documents``. Models are fitted on the tables in ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from changeloom.llm import common, decontaminate, language_id, near_dedup, packing, toxicity
from changeloom.llm.queries import language_model, tokenizer_file, toxicity_model


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language stays unsure, go."""
    return language_id.keep_identified(docs, language_model(common.table(spark, sf_dir, "documents")))


def filter_toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go."""
    return toxicity.keep_clean(docs, toxicity_model(spark, common.table(spark, sf_dir, "documents"), sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest doc_id stays."""
    return near_dedup.drop_near_duplicates(docs)


def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; documents in which nothing else was go."""
    return decontaminate.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences."""
    return packing.pack_documents(docs, tokenizer_file())


STAGES = [
    ("language_id", identify_language),
    ("toxicity", filter_toxicity),
    ("near_dedup", drop_near_copies),
    ("decontamination", remove_benchmark),
    ("packing", pack),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = common.table(spark, sf_dir, "documents"), common.Scratch(spark)
    for _, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), "stage")  # and delete the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
