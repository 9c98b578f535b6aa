"""A training corpus from raw documents, in five stages.

Quality rules reject documents; of each group of near-duplicates one document
stays; documents with benchmark passages go; secrets are masked; what is left is
encoded. Each stage takes the table that the stage before it left and returns
the columns of documents, but for the last, which returns the encoding.

All stages read whole texts of any length, take extra columns along whatever
their names, and return no rows for a table without rows. What they do with
nulls, ties and repeated rows stands with each.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, decontaminate, quality_rules, secrets, simhash
from ledgerloom.llm.common import remember, shared_dir, table
from ledgerloom.llm.queries import vocabulary

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; thresholds come from the documents given.

    Null and empty texts have no words and go. Null languages and sources are groups of their own. Equal rows are
    judged alike, and all stay or go; a document exactly at a threshold stays.
    """
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the smallest id.

    Null texts and texts without words are copies of each other. Null ids come last; of rows with the same id the
    one with the smallest hash of its text stays, then that with the smallest hash of all columns.
    """
    return simhash.deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark passage.

    Null texts have no words and stay; items without words contaminate nothing. Equal rows all stay or go.
    """
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts masked and n_chars set anew.

    Null texts stay null, and a text without secrets stays as it is, with its n_chars. Spans that overlap are masked
    as one. Equal rows stay equal.
    """
    return secrets.redact(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text.

    Null texts count as empty: no tokens. There is one row for each row, equal rows give equal ones; null ids stay.
    """
    return bpe.encode(docs, vocabulary("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("BPE encoding and decoding", encoding),
]

#: Fingerprints and tokenizers have no SQL form; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of ``sf_dir``, each written as Parquet to the shared folder and read again; the folder goes when the process ends."""
    docs = table(spark, sf_dir, "documents")
    folder = remember(spark, f"{shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.schema(out.schema).parquet(f"{folder}/{k}")
    return docs
