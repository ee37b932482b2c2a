"""The corpus pipeline: each stage works on all that the one before it kept.

1. Documents that the quality classifier rejects go.
2. Of each class of near duplicates the first document stays.
3. Documents in which a window of a benchmark item occurs go.
4. Secrets in the texts are replaced by a mark.
5. What is left is packed into sequences.

Every stage but the last returns the columns of its input.  Null and empty
texts are documents like any other; empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.llm import dart, decontaminate, near, packing, quality, queries, secrets
from tidepool.llm.cluster import settle, table


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near.keep_one(docs, dart.signer)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [
    ("quality classifier", good),
    ("MinHash near-dedup", distinct),
    ("benchmark decontamination", unseen),
    ("secret scans", redacted),
    ("best-fit packing", packed),
]

#: Signatures, hashes and token ids have no SQL form; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = settle(docs)  # no stage runs twice, whatever the next one reads
    return docs
