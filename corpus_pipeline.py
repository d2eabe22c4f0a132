"""A corpus pipeline over `documents`: quality rules, near-duplicates, repeated passages, benchmark
passages, token ids. Each stage takes what the one before it kept.

Cases: an empty table passes through every stage; null texts fail the quality rules' word count and go
there; repeated rows are near-duplicates of each other, so one stays; columns with any name are carried
by position to the stage before the last. A text that a stage shortens keeps its row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm import bpe, decontaminate, neardup, quality, substrings
from chronoweave.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the production policy keeps."""
    return quality.apply_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return neardup.deduplicate(spark, docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the bytes of strings of 200 bytes that stand elsewhere too."""
    return substrings.cut_documents(spark, docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are not contaminated by benchmark items."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, the digests, and the ids as packed little-endian 32-bit integers."""
    import public_tokenizers as P

    rows = bpe.encode_documents(docs.select("doc_id", "text"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN, with_ids=True)
    return rows.drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark decontamination", benchmark_passages),
    ("byte-level BPE", token_ids),
]

#: Components of near-duplicates, byte ranges and tokens are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each one's rows written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(spark, docs, f"stage-{k}")
    return docs
