"""A corpus from raw documents to token ids, as a chain of stages.

Each stage reads the rows that its predecessor kept; every one but the last returns the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lumenreel.llm.common import durable, table
from lumenreel.llm.lines import dedup_lines
from lumenreel.llm.mixing import mixed_documents
from lumenreel.llm.pieces import encode_documents
from lumenreel.llm.simhash import near_dedup
from lumenreel.llm.toxicity import clean_documents

MODEL = "piece_bpe_32k.model"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return clean_documents(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go, within one word if they have five or more; documents stay."""
    return dedup_lines(docs)


def near_dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix to target weights takes them."""
    return mixed_documents(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers), n_tokens and the decoded text."""
    with open(public_tokenizers.path(MODEL), "rb") as f:
        return encode_documents(docs, f.read())


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup_documents),
    ("mixing", mix_sources),
    ("sentencepiece", sentencepiece),
]

#: Trained scores, text hashes and the tokenizer are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = durable(docs)
    return docs
