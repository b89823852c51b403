"""From raw documents to token files: quality, near-duplicates, benchmark decontamination, source mix, token ids.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage before it kept. All but the last
return the columns of ``docs``; the last writes the token files and returns what it reads back from them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from glintframe.llm import decontam, mixing, nbsvm, repair, simhash
from glintframe.llm.common import table, text_session
from glintframe.llm.queries import word_tokenizer
from glintframe.session import materialize, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from the labelled ones among them."""
    return nbsvm.accepted(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    text_session(spark)
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark, unchanged."""
    return decontam.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    text_session(spark)
    return mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all rows, and per row ``doc_id, start, n_tokens, ids_crc32`` as read back from them."""
    path = f"{shared_dir(text_session(spark))}/tokens-{uuid.uuid4().hex}"
    repair.write_tokens(docs, path, word_tokenizer())
    return repair.read_tokens(spark, path, digest=True)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("tokens", tokens)]

ORACLE_SQL = None  # the classifier, the fingerprints and the tokenizer have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
