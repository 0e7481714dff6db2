"""The stages of the corpus pipeline; each takes what its predecessor kept and returns documents, the last one the written ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontamination, jaccard_join, mixing, quality_model, token_shards
from .common import forget, table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null and empty texts are scored as empty, repeated rows each, and without labels all stay."""
    return quality_model.accepted(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; rows without words or without a doc_id are no copies, of rows that repeat a doc_id one stays."""
    return jaccard_join.one_of_each(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window, each row decided by itself; null and empty texts stay, and with an empty benchmark all do."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix by source weights: a row for each time a document, or a part of it, is taken.

    Nothing is taken of null and empty texts; a null source is a source; rows that repeat a doc_id are mixed each; an empty table gives no rows.
    """
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the written shards hold of each row: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts are the end id alone; rows that repeat a doc_id, and those without one, are written each; an empty table gives no rows.
    """
    import public_tokenizers

    return token_shards.token_output(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]
#: Shingle components, fitted scores and tokenizers are beyond SQL; tests hold their operators against brute force, round trips or held-out labels, and check that each stage takes effect.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = written(docs, name)
            if before is not None:
                forget(before)  # the next stage's documents are written: nothing reads these again
            before = docs
    return docs
