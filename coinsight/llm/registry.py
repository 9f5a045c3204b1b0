"""Registered queries of the text operators and their DuckDB equivalents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, jaccard, language, licenses, merkle, pieces, recurrent, secrets, shared, toxicity, urls

PIECE_MODEL = "piece_bpe_32k.model"


def op1_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict for every page url, blocks passed on to aliases."""
    return urls.judge(shared.table(spark, sf_dir, "pages"))


def op2_piece_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every document; digests of ids and decoded text."""
    return pieces.digests(shared.table(spark, sf_dir, "documents"), public_tokenizers.path(PIECE_MODEL))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from three quarters of them."""
    return language.predict_corpus(shared.table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from labelled ones."""
    return toxicity.score_corpus(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "labels"))


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose 5-word shingle sets reach Jaccard 0.75."""
    return jaccard.linked_components(shared.table(spark, sf_dir, "documents"))


def op6_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle fingerprints of documents and of their edited texts."""
    return merkle.fingerprints(shared.table(spark, sf_dir, "documents"))


def op7_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Find secrets in every document, inside encoded runs too."""
    return secrets.find(shared.table(spark, sf_dir, "documents"))


def op8_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a test item, with the item and the overlaps."""
    return decontaminate.find_leaks(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


def op9_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and recurrent log10 probability of every document."""
    return recurrent.score_corpus(shared.table(spark, sf_dir, "documents").select("doc_id", "text"))


def op10_license_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    return licenses.scan(shared.table(spark, sf_dir, "documents"))


def queries() -> dict:
    """Every text query, by name."""
    return {f.__name__: f for f in (op1_url_verdicts, op2_piece_tokens, op3_language, op4_toxicity, op5_jaccard_components, op6_merkle_fingerprints, op7_secret_spans, op8_benchmark_leaks, op9_recurrent_scores, op10_license_labels)}


def oracle_sql() -> dict[str, str]:
    """SQL for the text queries that it can express."""
    return {"op1_url_verdicts": urls.SQL, "op5_jaccard_components": jaccard.SQL, "op6_merkle_fingerprints": merkle.SQL}
