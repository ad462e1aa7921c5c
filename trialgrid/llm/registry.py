"""Queries of the operators in this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialgrid.llm import decontam, htmltext, infill, langid, lines, media, neardup, packing, pii, ranked, secrets, substrings, token_store


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=2, length=4096, digest=True)


def op2_media_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.read_archives(spark, media.write_archives(_table(spark, sf_dir, "documents"))))


def op3_linked_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.find(_table(spark, sf_dir, "documents")))


def op4_language_naive_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = langid.identify(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_pii_skip_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_prefix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_minhash_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op8_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(substrings.remove_repeats(_table(spark, sf_dir, "documents")))


def op9_html_subsequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(_table(spark, sf_dir, "pages"))


def op10_content_addressed_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_store.write_store(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0)
    return token_store.document_digests(spark, path)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(infill.fill_in_middle(_table(spark, sf_dir, "documents")))


def op13_reversible_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lines.digests(lines.LineIndex.build(docs).clean(docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (
        op1_hilbert_packing, op2_media_archives, op3_linked_secrets, op4_language_naive_bayes, op5_pii_skip_chain,
        op6_prefix_decontamination, op7_minhash_inverted_join, op8_super_kmers, op9_html_subsequence, op10_content_addressed_store,
        op11_ranked_search, op12_fill_in_middle, op13_reversible_line_dedup,
    )
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    return {
        "op6_prefix_decontamination": decontam.ORACLE,
        "op11_ranked_search": ranked.ORACLE,
        "op12_fill_in_middle": infill.ORACLE,
        "op13_reversible_line_dedup": lines.ORACLE,
    }
