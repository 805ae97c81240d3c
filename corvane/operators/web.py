"""Normalisation and filtering of web results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import canonical_url, collapse, valid_url
from corvane.operators.dense import dot


def normalize(results: DataFrame, key: str = "qid") -> DataFrame:
    """key, web_id, rank, url, ...: bad urls, empty contents and repeats dropped; ranks keep their gaps.

    Results have key, position (from 0), url and content.
    """
    rows = results.filter(valid_url(F.col("url")) & (F.trim(F.coalesce("content", F.lit(""))) != ""))
    rows = rows.withColumn("canonical", canonical_url(F.col("url")))
    first = Window.partitionBy(key, "canonical").orderBy("position")
    rows = rows.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")
    return rows.withColumn("web_id", F.concat(F.lit("web:"), F.substring(F.sha2("canonical", 256), 1, 16))).withColumn("rank", F.col("position") + 1)


def relevant(results: DataFrame, least: float = 0.30) -> DataFrame:
    """Only where the query was rewritten does a low relevance drop a result."""
    return results.filter(~F.col("rewritten") | F.col("relevance").isNull() | (F.col("relevance") >= least))


# fixed values: excerpts that a web query is written from
EXCERPTS = 3
EXCERPT_CHARS = 300
QUERY_CHARS = 400


def excerpts(candidates: DataFrame, most: int = EXCERPTS, chars: int = EXCERPT_CHARS) -> DataFrame:
    """qid, excerpts: the first passages of the corpus, one line each under document and place."""
    first = Window.partitionBy("qid").orderBy("position", "chunk_id")
    rows = candidates.filter("source = 'corpus'").withColumn("n", F.row_number().over(first)).filter(F.col("n") <= most)
    title = F.concat_ws(" / ", F.nullif("source_doc", F.lit("")), F.nullif("location", F.lit("")))
    line = F.concat(F.lit("["), title, F.lit("] "), F.substring(collapse(F.col("text")), 1, chars))
    ordered = F.array_sort(F.collect_list(F.struct("n", line.alias("line"))))
    return rows.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("excerpts"))


def web_query(question: Column, rewritten: Column, excerpts_: Column, most: int = QUERY_CHARS) -> Column:
    """(query, contextual): the rewrite without quotes, where there were excerpts and it says something; else the question."""
    plain = F.substring(question, 1, most)
    clean = F.substring(F.regexp_replace(collapse(F.coalesce(rewritten, F.lit(""))), "^[\"'` ]+|[\"'` ]+$", ""), 1, most)
    query = F.when(F.coalesce(excerpts_ != "", F.lit(False)) & (clean != ""), clean).otherwise(plain)
    return F.struct(query.alias("query"), (query != plain).alias("contextual"))


def score_relevance(results: DataFrame) -> DataFrame:
    """Results (query_vector, vector, both of unit length) with their relevance; null where a vector is missing, which keeps them."""
    return results.withColumn("relevance", F.when(F.col("query_vector").isNotNull() & F.col("vector").isNotNull(), F.round(dot(F.col("query_vector"), F.col("vector")), 6)))


def outcome(results: DataFrame, searches: DataFrame, least: float = 0.30) -> DataFrame:
    """qid, status, failure, usable, dropped for searches (qid, error): a failed one is empty and never an error."""
    kept = relevant(results, least).groupBy("qid").agg(F.count(F.lit(1)).alias("usable"))
    seen = results.groupBy("qid").agg(F.count(F.lit(1)).alias("seen"))
    rows = searches.join(kept, "qid", "left").join(seen, "qid", "left")
    usable, found = F.coalesce("usable", F.lit(0)), F.coalesce("seen", F.lit(0))
    bad = F.col("error").isNotNull()
    return rows.select("qid", F.when(bad, "failed").otherwise("ok").alias("status"), failure_kind(F.col("error")).alias("failure"), F.when(bad, 0).otherwise(usable).alias("usable"), F.when(bad, 0).otherwise(found - usable).alias("dropped"))


def failure_kind(error: Column) -> Column:
    """What kind of failure an error ('Class: message') is; null for none."""
    low = F.lower(error)
    limit = low.startswith("usagelimit") | (low.startswith("forbidden") & low.contains("limit"))
    return F.when(low.startswith("allkeysblocked"), "all_keys_blocked").when(low.contains("timeout"), "timeout").when(limit, "quota").when(low.startswith("forbidden") | low.startswith("http") | low.startswith("connection"), "http_error").when(error.isNotNull(), "unexpected")
