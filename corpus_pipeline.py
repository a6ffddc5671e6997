"""A training-data pipeline over ``documents``: filter, deduplicate, mix, pack."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm.common import saved_in_steps
from tidemark.llm.exact_dedup import deduplicated
from tidemark.llm.mixing import mixture
from tidemark.llm.ngram_jaccard import representatives
from tidemark.llm.packing import packed
from tidemark.llm.toxicity import clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Rows are judged one by one by their whole texts: null and empty ones by the model's
    bias, repeated rows alike; columns of any name are kept; no rows give none.
    """
    return clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts one stays: the longest, then the least id, null last.

    Null texts are empty ones, of rows that tie in all of this one stays, whichever it is;
    columns of any name are kept; no rows give none.
    """
    return deduplicated(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the document with the least id stays, null last.

    Rows that share an id but not their text are decided on one by one; null and blank texts
    are near nothing and all stay; columns of any name are kept; no rows give none.
    """
    return representatives(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn so that sources, languages and topics meet their targets.

    Null sources and languages are values of their own; null and empty texts weigh nothing
    and stay; rows with equal ids have equal draws; columns of any name are kept; no rows
    give none.
    """
    return mixture(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and offsets.

    Null and empty texts are one closing token each, long ones several pieces; repeated rows
    are documents of their own; a null id stays null; no rows give none.
    """
    return packed(docs)


STAGES = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("ngram_jaccard", ngram_jaccard), ("mixing", mixing), ("packing", packing)]

#: The classifier and the tokenizer have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        # A stage's own tables go when its result is written; the results of all stages stay.
        docs = saved_in_steps(partial(stage, spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
