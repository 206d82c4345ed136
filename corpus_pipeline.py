"""The pipeline from raw documents to packed training sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from presssignal.llm import mixing, near_dedup, packing, quality_crf
from presssignal.llm.support import stored, table
from presssignal.llm.tokens import read_tokenizer

#: None: trained marginals, near duplicates, the mix and the tokens have no SQL form; a test holds
#: run() against a brute-force version of its stages.
ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier rejects go. Scores depend on the text alone, so equal texts fare alike."""
    labels = table(spark, sf_dir, "labels")
    return quality_crf.accepted(docs, quality_crf.train(docs, labels))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near duplicates, three words and two bits, the document with the smallest id stays."""
    return near_dedup.representatives(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, as documents: one row for each pass over their source."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids, packed into sequences."""
    return packing.pack_documents(docs, read_tokenizer(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
