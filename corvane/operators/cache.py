"""The answer cache: lookup by similarity with equal numbers, and write-back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import entry_id, numbers


def lookup(candidates: DataFrame, threshold: float = 0.96, most: int = 5, key: str = "qid") -> DataFrame:
    """Best acceptable entry of each question among its ``most`` nearest.

    Candidates have key, question, entry_id, entry_question, score, of one scope.
    """
    near = Window.partitionBy(key).orderBy(F.desc("score"), "entry_id")
    rows = candidates.withColumn("n", F.row_number().over(near)).filter(F.col("n") <= most)
    rows = rows.filter((F.col("score") >= threshold) & (numbers(F.col("question")) == numbers(F.col("entry_question"))))
    return rows.groupBy(key).agg(F.min_by("entry_id", "n").alias("entry_id"), F.max("score").alias("score"))


def entries(answers: DataFrame) -> DataFrame:
    """Rows of the cache table from scope, question, answer, citations (array of kind, source_doc)."""
    docs = F.array_sort(F.array_distinct(F.transform(F.filter("citations", lambda c: c["kind"] == "corpus"), lambda c: c["source_doc"])))
    return answers.select(entry_id(F.col("corpus_scope"), F.col("question")).alias("entry_id"), "corpus_scope", "question", "answer", docs.alias("cited_docs"))


def cacheable(session: Column, bypass: Column, web: Column, passed: Column, non_answer: Column, history: Column) -> Column:
    """None of the six blockers holds."""
    return ~(session | bypass | web | ~passed | non_answer | history)


def put(cache: DataFrame, answers: DataFrame) -> DataFrame:
    """The cache with the answers' entries: a question asked again in its scope replaces its entry, the last of equal ones stands.

    Answers have corpus_scope, question, answer, citations and seq, their order.
    """
    last = Window.partitionBy("corpus_scope", "question").orderBy(F.desc("seq"))
    newest = answers.withColumn("n", F.row_number().over(last)).filter("n = 1")
    new = entries(newest)
    return cache.join(new.select("entry_id"), "entry_id", "left_anti").unionByName(new)


def citations_json(citations: Column) -> Column:
    """Citations as they are kept in a cache row."""
    return F.to_json(citations)


def citations_from(text: Column, schema: str = "array<struct<kind:string,source_doc:string>>") -> Column:
    return F.from_json(text, schema)
