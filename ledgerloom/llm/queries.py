"""The operators' queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm import bpe, decontaminate, language, merkle, quality_classifier, quality_rules, secrets, simhash, token_counts, toxicity
from ledgerloom.llm.common import table


def vocabulary(name: str) -> str:
    """The place of an installed vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), evidence=False)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages as WARC records, audited against a replica in which of 97 records about one is changed, one missing, one under another key and one there twice."""
    pages = table(spark, sf_dir, "pages")
    return merkle.digest(merkle.audit_replica(pages, merkle.damaged(pages)))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.rate(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_toxicity, op2_bpe, op3_simhash, op4_decontaminate, op5_language, op6_merkle, op7_token_counts, op8_secrets, op9_quality_rules, op10_quality_classifier)
}

ORACLES: dict[str, str] = {
    "op4_decontaminate": decontaminate.oracle_sql(),
    "op5_language": language.oracle_sql(),
    "op6_merkle": merkle.oracle_sql(),
    "op8_secrets": secrets.oracle_sql(),
    "op9_quality_rules": quality_rules.oracle_sql(),
}
