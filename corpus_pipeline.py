"""From documents to encoded training text in five stages, each one operator of corridor_jobs.llm.

Each stage gets what its predecessor kept and returns the columns of documents; the last returns the encoded texts.
In every stage a null text counts as empty, very long texts are read whole, rows that share an id (or have none) are each
judged by their own text, and no documents give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corridor_jobs.llm import exact_dedup, mixing, pieces, simhash, toxicity
from corridor_jobs.llm.common import table, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the largest doc_id stays."""
    return exact_dedup.drop_exact(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word Jaccard 0.8 or more) the least doc_id stays."""
    return simhash.drop_near(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.draw(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, each text's pieces with their source bytes, their number, and digests of ids and decoded text."""
    return pieces.encode(docs, ["pieces", "starts", "ends", "n_tokens", "ids_sha256", "decoded_sha256"], keep=("doc_id", "source"))


STAGES = [
    ("toxicity", reject_toxic),
    ("exact dedup", drop_exact_copies),
    ("near dedup", drop_near_copies),
    ("source mix", mix_sources),
    ("encoding", encode_pieces),
]

#: No SQL: toxicity, fingerprints and pieces are beyond it. tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
