"""A corpus pipeline: known languages, one of each group of near copies, no
benchmark items, no secrets, token ids.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept. All but the last return the columns of ``documents``; further columns are
kept as they are, whatever their names. Rows of null or empty text, or of text
without a letter, go in the first stage; the others keep them. Rows that repeat
an id and text stay together, as copies of one document; rows of null id are
kept. Texts of any length are taken whole, and empty tables give empty tables.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coinsight.llm import decontaminate, jaccard, language, pieces, secrets, shared


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified; others go."""
    return language.known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    return jaccard.one_of_each(docs)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of ``benchmark``."""
    return decontaminate.without_leaks(docs, shared.table(spark, sf_dir, "benchmark"))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced in the text and n_chars renewed."""
    return secrets.redacted(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token_ids, the end id last, and n_tokens."""
    found = pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("language identification", known_languages),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("secret scan", secrets_redacted),
    ("SentencePiece encoding", encoded),
]

#: Trained models and library-exact encoding are beyond SQL; a test compares
#: the rows with a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = shared.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = shared.stored(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
