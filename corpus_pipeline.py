"""The training-data pipeline: each stage is one operator of tidegraph.llm over what its predecessor kept.

Defined results: null text counts as empty and, like an empty one, fails the quality rules; of repeated rows, and of
rows that share an id and a text, one is left by the Jaccard stage; rows that share an id with different texts go on
as documents of their own, and share their Poisson draw; a null id is an id like any other; an empty table gives no
piece; texts may be of any length; extra columns of any names go along to the last stage, which returns its own.
Packing comes after mixing, so it is packing's scattered numbering that keeps copies of a document and documents of a
length apart in the order of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import jaccard, mixing, packing, rules, surrogates
from tidegraph.llm.common import stage


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule."""
    return rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of texts linked by a similarity of 0.8 or more."""
    return jaccard.keep_one(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their entities replaced; the other columns stay as they are."""
    return surrogates.pseudonymize(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its Poisson draw says, shuffled; copies keep their doc_id."""
    return mixing.replicate(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("PII", private_data),
    ("mixing sources", mix_sources),
    ("packing", pack_sequences),
]

#: Token ids of the vocabulary's merges can't be had in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
