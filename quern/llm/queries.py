"""The numbered queries op1 to op13: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, jaccard, phrases
from ._tables import table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import secret_spans

    return secret_spans(table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_counts

    return mix_counts(table(spark, sf_dir, "documents"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_model import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(table(spark, sf_dir, "conversations"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked_classes(table(spark, sf_dir, "documents"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import query

    return query(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .rules import query

    return query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import query

    return query(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality_scores

    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .whitening import query

    return query(table(spark, sf_dir, "embeddings"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .pieces import digests

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_mixing, op3_language_model, op4_decontaminate, op5_chat, op6_jaccard, op7_personal_data, op8_quality_rules, op9_licenses, op10_quality, op11_whitening, op12_collocations, op13_sentencepiece)}
ORACLE = {"op4_decontaminate": decontaminate.ORACLE, "op5_chat": chat.ORACLE, "op6_jaccard": jaccard.ORACLE, "op12_collocations": phrases.ORACLE}
