"""Queries on texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import leakage, packing, truncation
from plumbline.plans.registry import Registry
from plumbline.sources.tables import table

REGISTRY = Registry()


@REGISTRY.add("p7_contexts")
def p7_contexts(spark: SparkSession, d: str) -> DataFrame:
    """The context of each text or piece, for each capacity."""
    return packing.packed_contexts(table(spark, d, "documents"), table(spark, d, "context_sizes"))


@REGISTRY.add("p7_fill")
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Contexts, tokens and unused share per capacity."""
    sizes = table(spark, d, "context_sizes")
    return packing.fill_report(packing.packed_contexts(table(spark, d, "documents"), sizes), sizes)


@REGISTRY.add("p8_found")
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_passages(table(spark, d, "documents"), table(spark, d, "eval_items"))


@REGISTRY.add("p8_items")
def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Documents per leaked passage."""
    return leakage.leak_counts(table(spark, d, "documents"), table(spark, d, "eval_items"))


@REGISTRY.add("p9_found")
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return truncation.truncated_texts(table(spark, d, "documents")).where("truncated").select("doc_id").distinct()


@REGISTRY.add("p9_sources")
def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    """Each source's share of truncated texts."""
    return truncation.truncation_report(table(spark, d, "documents"))
