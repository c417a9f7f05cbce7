"""A training corpus from raw documents: five stages, each applied to all that the one before it kept.

Toxic documents go, of equal texts and of near duplicates one document stays, sources are mixed to their weights, and what is
left is encoded. Stages hand over Parquet tables in the shared folder, so that a lost executor costs at most a stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tapewright.llm import bpe, exact_dedup, mixing, ngram_join, toxicity
from tapewright.llm.common import table
from tapewright.llm.queries import MULTI_RANKS
from tapewright.session import stage

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is at least 0.5 go, with all rows of that id and text."""
    return toxicity.without_toxic(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id stays."""
    return exact_dedup.keep_one(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by word shingles (five words, similarity 0.8) the one with the smallest id stays."""
    return ngram_join.keep_one(docs, width=5, percent=80).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, up to three times."""
    return mixing.take_mix(docs).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per row: its tokens' number, ids and digests."""
    out = bpe.encode_documents(docs, path=public_tokenizers.path(MULTI_RANKS), pattern=public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources", mix_sources),
    ("byte-level BPE", encode),
]

# Tokens and nearest neighbours are beyond SQL; a brute-force version in tests/llm stands in.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "corpus-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
