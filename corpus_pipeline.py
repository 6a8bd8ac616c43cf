"""The corpus pipeline: language ID, toxicity, line dedup, near dedup, packing.

Each stage takes the documents its predecessor kept, as written; all but the last return the
columns of documents, extra ones included. Empty tables give empty results, repeated rows are
judged alike, texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import langid, linededup, ngram_join, packing, toxicity
from recollect.llm._common import materialize, table
from recollect.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: null texts, those without a letter, those far from every
    profile. Languages as near as each other go by name."""
    return langid.keep_known(docs)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; empty texts are judged by the base rate and stay where it is low."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines leave the texts, in the order of (doc_id, line), a null doc_id
    first; texts that were nothing else go, null and empty ones stay."""
    return linededup.drop_repeated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: all rows of the smallest doc_id. Rows without
    a doc_id or without words stay."""
    return ngram_join.drop_similar(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences; null texts count as empty."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("language_id", language),
    ("toxicity", toxic),
    ("line_dedup", lines),
    ("near_dedup", near_duplicates),
    ("packing", sequences),
]

#: SQL can't express the classifiers and the packing; tests/llm/test_twins.py holds run() against
#: a plain twin of every stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
