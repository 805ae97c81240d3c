"""The passage table: upsert, delete, replacement, in-batch order, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_first(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """First row of each key in the given order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("__n = 1").drop("__n")


def upsert(stored: DataFrame, incoming: DataFrame, key: str = "chunk_id") -> DataFrame:
    """Incoming rows replace stored ones of the same key."""
    return stored.join(incoming.select(key), key, "left_anti").unionByName(incoming)


def delete_by_document(stored: DataFrame, source_doc: str, scope: str) -> DataFrame:
    return stored.filter(~((F.col("source_doc") == source_doc) & (F.col("corpus_scope") == scope)))


def replace_documents(stored: DataFrame, incoming: DataFrame, succeeded: DataFrame) -> DataFrame:
    """Old rows of the documents that succeeded go; those of failed ones stay."""
    kept = stored.join(succeeded.select("source_doc"), "source_doc", "left_anti")
    return kept.unionByName(incoming.join(succeeded.select("source_doc"), "source_doc", "left_semi"))


def documents(stored: DataFrame) -> DataFrame:
    """source_doc, chunk_count, pages (null when no row has one), extraction_methods."""
    pages = F.count_distinct("page")
    return stored.groupBy("source_doc").agg(F.count(F.lit(1)).alias("chunk_count"), F.nullif(pages, F.lit(0)).alias("pages"), F.array_sort(F.collect_set("extraction_method")).alias("extraction_methods"))


def report(stored: DataFrame) -> DataFrame:
    """Counts by method, by type and by both, in one pass."""
    sets = stored.groupingSets([["extraction_method"], ["chunk_type"], ["extraction_method", "chunk_type"]], "extraction_method", "chunk_type")
    return sets.agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def method_counts(rows: DataFrame, methods: tuple[str, ...] = ("text", "ocr", "vision")) -> DataFrame:
    """One row with a count per method, zero where there is none."""
    return rows.agg(*[F.coalesce(F.sum((F.col("extraction_method") == m).cast("long")), F.lit(0)).alias(m) for m in methods])


def invalidate(cache: DataFrame, document: str, scope: str | None = None) -> DataFrame:
    """The cache without entries that cite the document (in one scope)."""
    hit = F.array_contains("cited_docs", document)
    if scope is not None:
        hit = hit & (F.col("corpus_scope") == scope)
    return cache.filter(~F.coalesce(hit, F.lit(False)))


def misses(wanted: DataFrame, memo: DataFrame, key: str = "key") -> DataFrame:
    """Distinct keys that the memo table lacks: what has to be computed."""
    return wanted.select(key).distinct().join(memo.select(key), key, "left_anti")
