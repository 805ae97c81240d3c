"""Evaluation runs: aggregates, splits, comparison, drift, resume, calibration, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import let, word_set

SOURCES = ("corpus", "web", "mixed", "none")


def answer_source(sources: Column) -> Column:
    kinds = F.array_distinct(sources)
    return F.when(F.size(kinds) == 0, "none").when(F.size(kinds) > 1, "mixed").when(kinds[0] == "corpus", "corpus").when(kinds[0] == "web", "web").otherwise("mixed")


def aggregate(rows: DataFrame, metrics: list[str]) -> DataFrame:
    """Mean (4 digits) and count of each metric overall and by answer_source, in one pass."""
    out = rows.rollup("answer_source").agg(F.grouping("answer_source").alias("overall"), F.count(F.lit(1)).alias("questions"), *[x for m in metrics for x in (F.round(F.avg(m), 4).alias(m), F.count(m).alias(f"{m}_n"))])
    return out.select(F.when(F.col("overall") == 1, "overall").otherwise(F.coalesce("answer_source", F.lit("none"))).alias("slice"), "questions", *[x for m in metrics for x in (m, f"{m}_n")])


def split_summary(records: DataFrame, least_coverage: float = 80.0, most_errors: float = 0.10) -> DataFrame:
    """One row from records (id, answer_source, failed)."""
    ok = ~F.col("failed")
    counts = [F.sum((ok & (F.col("answer_source") == s)).cast("long")).alias(f"n_{s}") for s in SOURCES]
    out = records.agg(F.sum(ok.cast("long")).alias("questions"), *counts, F.sum(F.col("failed").cast("long")).alias("errors"), F.count(F.lit(1)).alias("total_questions"))
    percent = lambda s: F.when(F.col("questions") > 0, F.round(100.0 * F.col(f"n_{s}") / F.col("questions"), 1)).otherwise(0.0)
    out = out.select("*", *[percent(s).alias(f"pct_{s}") for s in SOURCES])
    return out.withColumn("low_corpus_coverage", (F.col("questions") > 0) & (F.col("pct_corpus") < least_coverage)).withColumn("run_invalid", (F.col("total_questions") > 0) & (F.col("errors") / F.col("total_questions") > most_errors))


def compare(a: DataFrame, b: DataFrame, metrics: list[str]) -> DataFrame:
    """metric, mean_a, mean_b, delta, n over ids present in both with both values."""
    pairs = a.select("id", *[F.col(m).alias(f"a_{m}") for m in metrics]).join(b.select("id", *[F.col(m).alias(f"b_{m}") for m in metrics]), "id")
    rows = pairs.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").cast("double").alias("va"), F.col(f"b_{m}").cast("double").alias("vb")) for m in metrics])).alias("x")).select("x.*")
    out = rows.filter(F.col("va").isNotNull() & F.col("vb").isNotNull()).groupBy("metric").agg(F.round(F.avg("va"), 4).alias("mean_a"), F.round(F.avg("vb"), 4).alias("mean_b"), F.round(F.avg("vb") - F.avg("va"), 4).alias("delta"), F.count(F.lit(1)).alias("n"))
    return out


def config_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose values differ between two (key, value) tables, absent ones included."""
    both = old.select("key", F.col("value").alias("stored")).join(new.select("key", F.col("value").alias("current")), "key", "full")
    return both.filter(~F.col("stored").eqNullSafe(F.col("current")))


def pending(questions: DataFrame, finished: DataFrame) -> DataFrame:
    return questions.join(finished.select("id"), "id", "left_anti")


def resolution(rows: DataFrame, low: float, high: float) -> DataFrame:
    """Five-way tally of (top_dense, expected) under two thresholds."""
    up, down, right = F.col("top_dense") >= high, F.col("top_dense") < low, F.col("expected")
    tally = {"auto_sufficient_right": up & right, "auto_sufficient_wrong": up & ~right, "auto_insufficient_right": ~up & down & ~right, "auto_insufficient_wrong": ~up & down & right, "grey": ~up & ~down}
    return rows.agg(*[F.sum(c.cast("long")).alias(k) for k, c in tally.items()])


def suggest_thresholds(rows: DataFrame, margin: float = 0.02, trim: bool = False) -> DataFrame:
    """low, high, shape from (top_dense, expected); with ``trim`` one outlier on the overlapping side of each label goes."""
    if trim:
        inner = Window.partitionBy("expected").orderBy(F.when(F.col("expected"), F.col("top_dense")).otherwise(-F.col("top_dense")))
        rows = rows.withColumn("n", F.row_number().over(inner)).filter("n > 1")
    ends = rows.agg(F.min(F.when(F.col("expected"), F.col("top_dense"))).alias("lowest_in"), F.max(F.when(~F.col("expected"), F.col("top_dense"))).alias("highest_out"))
    gap = F.col("lowest_in") > F.col("highest_out")
    step = F.least(F.lit(margin), (F.col("lowest_in") - F.col("highest_out")) / 4)
    return ends.select(
        F.when(gap, F.col("highest_out") + step).otherwise(F.col("lowest_in") - margin).alias("low"),
        F.when(gap, F.col("lowest_in") - step).otherwise(F.col("highest_out") + margin).alias("high"),
        F.when(gap, "clean gap between the labels").otherwise("labels overlap").alias("shape"),
    )


def source_problems(sources: DataFrame, manifest: DataFrame) -> DataFrame:
    """id, source_doc, issue: sources (id, source_doc, page) not in the manifest or with a page outside it."""
    rows = sources.join(manifest.select("source_doc", "pages"), "source_doc", "left")
    out = rows.filter(F.col("pages").isNull() | (F.col("page") < 1) | (F.col("page") > F.col("pages")))
    return out.select("id", "source_doc", F.when(F.col("pages").isNull(), "not in manifest").otherwise("page outside").alias("issue")).distinct()


def file_differences(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """source_doc, side: in one of the two only."""
    a = files.select("source_doc").join(manifest.select("source_doc"), "source_doc", "left_anti").distinct().withColumn("side", F.lit("not_in_manifest"))
    return a.unionByName(manifest.select("source_doc").join(files.select("source_doc"), "source_doc", "left_anti").distinct().withColumn("side", F.lit("missing_file")))


def spread(rows: DataFrame) -> DataFrame:
    """label, least, median, most of top_dense by expected."""
    return rows.groupBy("expected").agg(F.min("top_dense").alias("least"), F.round(F.median("top_dense"), 6).alias("median"), F.max("top_dense").alias("most"), F.count(F.lit(1)).alias("n"))


def select_questions(questions: DataFrame, ids: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Questions of the ids, in their file's order (ordinal), at most so many."""
    rows = questions if ids is None else questions.filter(F.col("id").isin(*ids))
    return rows if most is None else rows.orderBy("ordinal").limit(most)


def resume(questions: DataFrame, finished: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """What is left of a run; a run under other settings is refused, with the settings that differ."""
    changed = [r["key"] for r in config_diff(old, new).select("key").orderBy("key").limit(20).collect()]
    if changed:
        raise ValueError(f"the run was begun with other settings: {', '.join(changed)}")
    return pending(questions, finished)


def overlap_metrics(records: DataFrame) -> DataFrame:
    """``records`` (question, answer, ground_truth, contexts, each a text) with four stand-ins for judged metrics.

    Shares of word sets, no model's judgement: of the answer in the contexts,
    of the question in the answer, of the contexts in the reference, of the
    reference in the contexts; null where the whole has no words.
    """
    part = lambda a, b: let(a, lambda x: F.when(F.size(x) > 0, F.round(F.size(F.array_intersect(x, b)) / F.size(x), 6)))
    w = {c: word_set(F.coalesce(F.col(c), F.lit(""))) for c in ("question", "answer", "ground_truth", "contexts")}
    return records.select(
        "*", part(w["answer"], w["contexts"]).alias("faithfulness_overlap"), part(w["question"], w["answer"]).alias("relevancy_overlap"),
        part(w["contexts"], w["ground_truth"]).alias("precision_overlap"), part(w["ground_truth"], w["contexts"]).alias("recall_overlap"),
    )
