"""A corpus pipeline over the documents table: rules, near duplicates, personal data, mixing, packing.

Each stage gets all rows that its predecessor kept; run() writes every stage's result as Parquet to
the shared folder and reads it again, so no stage is computed twice and a lost executor costs one
stage's tasks; what a stage read or left behind is deleted once its result is written.  All stages but the
last return the columns of documents; the last returns one row a piece of a packed sequence, with its ids.  Null and empty texts fail the quality rules and end there; every stage
keeps its operator's defined results for ties, repeated rows, empty tables and further columns.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from itemforge.llm import mixing, ngram_join, packing, pii, quality_rules
from itemforge.llm.common import MADE, discard, shared_dir, ship
from itemforge.llm.queries import key_of

#: Near-duplicate documents: shingles of five words, similarity of 0.8.
WORDS, SIMILARITY, SCALE = 5, 80, 100


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules judge good."""
    return quality_rules.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the document of the smallest id."""
    ship(spark)
    return ngram_join.first_of_each(docs, words=WORDS, similarity=SIMILARITY, scale=SCALE)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, personal data replaced."""
    return pii.pseudonymise(docs, key_of(spark))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.sample(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents, packed into sequences."""
    ship(spark)
    return packing.pack(docs, with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_join", near_duplicates),
    ("pii", personal_data),
    ("mixing", mixture),
    ("packing", sequences),
]
#: Hashing, tokenizing and packing can't be said in SQL; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, old = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path, before = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}", len(MADE)
        out = stage(spark, docs, sf_dir)
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
        discard(spark, old + MADE[before:])
        del MADE[before:]
        old = [path]
    return docs
