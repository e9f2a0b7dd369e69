"""Queries of the problems on texts, vectors and sketches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeframe.llm import clusters, cutoffs, leaks, percentiles, tokens
from lodeframe.sources.tables import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The cluster of each node of a cluster of two or more."""
    return clusters.found(table(spark, d, "hnsw_nodes"))


def p2_described(spark: SparkSession, d: str) -> DataFrame:
    """Size and most typical members of each cluster."""
    return clusters.described(table(spark, d, "hnsw_nodes"))


def p7_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """50th, 90th and 99th percentile per name and def, from the sketches of all days."""
    values = percentiles.values_of(table(spark, d, "projected_columns"), table(spark, d, "beings"))
    return percentiles.percentiles(percentiles.day_sketches(values))


def p7_days(spark: SparkSession, d: str) -> DataFrame:
    """Number of values in the sketch of each name, def and day."""
    values = percentiles.values_of(table(spark, d, "projected_columns"), table(spark, d, "beings"))
    return percentiles.day_sketches(values).selectExpr("name", "def", "cast(day as string) as day", "n")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The byte_bpe_50k ids of every text."""
    return tokens.token_ids(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that contain passages of held-out items."""
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents whose text was cut off."""
    return cutoffs.cut_texts(table(spark, d, "documents")).select("doc_id")


def p10_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each source's share of cut texts."""
    docs = table(spark, d, "documents")
    return cutoffs.cut_shares(docs, cutoffs.cut_texts(docs))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    fs = (p2_found, p2_described, p7_percentiles, p7_days, p8_ids, p9_found, p10_found, p10_sources)
    return {f.__name__: f for f in fs}
