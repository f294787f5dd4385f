"""The thin queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import language_id, mixing, nearest, ngram_join, packing, pii, quality_classifier, quality_rules, sharding, url_filters
from .common import ship, table


def key_of(spark: SparkSession) -> str:
    """The key of surrogates: spark.itemforge.pii.key of the session; a published one for test tables only."""
    return spark.conf.get("spark.itemforge.pii.key", "key-of-the-test-tables")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    forest = quality_classifier.train(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score(docs, forest)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, key_of(spark))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return ngram_join.join(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.train(docs))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = table(spark, sf_dir, "embeddings")
    return nearest.search(rows, nearest.every_nth(rows))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(table(spark, sf_dir, "pages"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_surrogates": op2_surrogates,
        "op3_mixing": op3_mixing,
        "op4_ngram_join": op4_ngram_join,
        "op5_sharding": op5_sharding,
        "op6_language_id": op6_language_id,
        "op7_nearest": op7_nearest,
        "op8_url_filters": op8_url_filters,
        "op9_quality_rules": op9_quality_rules,
        "op10_packing": op10_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_mixing": mixing.oracle(),
        "op5_sharding": sharding.oracle(),
        "op8_url_filters": url_filters.oracle(),
        "op9_quality_rules": quality_rules.oracle(),
    }
