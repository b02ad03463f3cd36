"""The corpus pipeline: five stages over ``documents``, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from listingspark.llm.binrecords import token_records
from listingspark.llm.common import Scratch, read
from listingspark.llm.decontam import decontaminate
from listingspark.llm.mixing import mixed_documents
from listingspark.llm.neardup import drop_near_duplicates
from listingspark.llm.queries import vocabulary_path
from listingspark.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic."""
    return drop_toxic(docs, read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, 0.8 and more."""
    return drop_near_duplicates(docs, shingle=5, similarity=(80, 100), bands=30, width=4)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak no benchmark item."""
    return decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixed_documents(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token-id records of the mix, written and read back."""
    return token_records(docs, vocabulary_path(), end_id=1)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

#: The learned lexicon, the alignment and the tokenizer have no SQL form; the tests compare each
#: stage on its own input with a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's table goes once the next one is written."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    written: list[str] = []
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = scratch.table(docs, name)
            scratch.drop(*written)
            written = [name]
    return docs
