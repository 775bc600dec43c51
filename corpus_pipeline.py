"""A corpus pipeline: toxic documents, near-copies, repeated strings and benchmark text go; what is left is packed.

Every stage takes (spark, docs, sf_dir), works on all documents that the one before kept and returns documents with
their own columns; the last returns packed pieces. Between stages the documents are written as Parquet below the
shared checkpoint folder, so a lost executor repeats one stage at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pactscope.llm.common import freeze, read
from pactscope.llm.decontamination import remove_contamination
from pactscope.llm.near_dedup import drop_near_duplicates
from pactscope.llm.packing import pack_documents
from pactscope.llm.queries import tokenizer_path
from pactscope.llm.suffix_dedup import remove_repeats
from pactscope.llm.toxicity import drop_toxic, learn_lexicon


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learnt from labelled documents that are not held out, doesn't reject."""
    return drop_toxic(docs, learn_lexicon(docs, read(spark, sf_dir, "labels")))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return drop_near_duplicates(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without strings of 200 bytes that start elsewhere too; empty ones go."""
    return remove_repeats(docs)


def benchmark_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the words that benchmark windows cover; empty ones go."""
    return remove_contamination(docs, read(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document in a sequence of at most 4096 tokens."""
    return pack_documents(docs, tokenizer_path()).withColumnRenamed("id", "doc_id")


STAGES = [
    ("toxicity", toxicity),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("benchmark_text", benchmark_text),
    ("packing", packing),
]

#: SQL can express neither the learnt lexicon nor the signatures; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = freeze(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
