"""Documents to packed training sequences: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before wrote, and returns a DataFrame; all but the last return
the columns of documents. Nulls, empty texts, repeated rows and empty tables behave as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm import decontam, langid, neardup, packing, pii
from trialgrid.llm.common import free_name, stored
from trialgrid.llm.registry import tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a language (`und`: null or no letters); an unknown lang becomes the predicted one. Repeated rows are judged alike; other columns stay, whatever their names."""
    lang, score = free_name(docs, "found_lang"), free_name(docs, "found_score")
    found = langid.identify(docs, (lang, score)).filter(F.col(lang) != "und")
    return found.withColumn("lang", F.coalesce("lang", lang)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (from 0.80): the smallest doc_id, null last, of those with ties and of repeated rows the first. Documents without words all stay."""
    return neardup.one_of_each(docs, 80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark passage occurs. Null and empty texts have none and stay; repeated rows go or stay together; no items drop nothing."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind, in every row, and counts n_chars anew where there is such a column. Null texts stay null; overlapping spans become one."""
    clean = pii.redact(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 ids, neighbours along the curve together. Null texts are empty, each row is packed, ties of the key go by doc_id and text."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), end_id=2, length=4096, digest=True)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("benchmark", benchmark), ("personal_data", personal_data), ("packing", packed)]

#: Naive Bayes, the random field and tokenizers have no SQL; tests/llm/test_pipeline.py compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
