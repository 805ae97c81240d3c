"""Citation markers: validity, grouping, claims, verdicts and rewriting."""

from __future__ import annotations

import re
from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import MARKER_GROUP, first_json, markers, tidy
from corvane.operators.guardrails import has_marker, is_substantive

# fixed values: a group of markers, and a marker that repeats itself
_GROUP = re.compile(MARKER_GROUP)
_REPEAT = re.compile(r"(\[\d+\])(?:\s*\1)+")


def rewrite_text(text: str, mapping: Mapping[int, int]) -> str:
    """Each marker through the mapping: unmapped numbers go, an emptied group vanishes, adjacent repeats collapse."""

    def one(group: re.Match[str]) -> str:
        targets = [mapping[int(n)] for n in re.findall(r"\d+", group[1]) if int(n) in mapping]
        return f"[{', '.join(str(t) for t in dict.fromkeys(targets))}]" if targets else ""

    return _REPEAT.sub(r"\1", _GROUP.sub(one, text))


def _rewrite(text: pd.Series, mapping: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else rewrite_text(t, {int(k): int(v) for k, v in dict(m or {}).items()}) for t, m in zip(text, mapping, strict=True)])


def rewrite(text: Column | str, mapping: Column | str) -> Column:
    """``rewrite_text`` over columns."""
    return F.pandas_udf(_rewrite, "string")(text, mapping)


def marker_rows(answers: DataFrame, key: str = "qid", answer: str = "answer") -> DataFrame:
    """key, number, first_at: distinct markers by first appearance."""
    return answers.select(key, F.posexplode(markers(F.col(answer))).alias("first_at", "number"))


def invalid_markers(found: DataFrame, passages: DataFrame, key: str = "qid") -> DataFrame:
    return found.join(passages.select(key, "number"), [key, "number"], "left_anti")


def citation_groups(found: DataFrame, passages: DataFrame, key: str = "qid") -> DataFrame:
    """key, number, citation, best_number: numbers of one (document, page) or url share a citation.

    Citations count by first appearance; the best passage has the highest
    score, then the lowest number.
    """
    rows = found.join(passages, [key, "number"]).withColumn("grp", F.when(F.col("kind") == "web", F.concat(F.lit("web "), F.col("source_url"))).otherwise(F.concat_ws("\x00", F.lit("corpus"), F.col("source_doc"), F.coalesce(F.col("page").cast("string"), F.lit("")))))
    firsts = rows.groupBy(key, "grp").agg(F.min("first_at").alias("grp_first"), F.min_by("number", F.struct(-F.col("score"), "number")).alias("best_number"))
    firsts = firsts.withColumn("citation", F.row_number().over(Window.partitionBy(key).orderBy("grp_first")))
    return rows.join(firsts, [key, "grp"]).select(key, "number", "citation", "best_number")


def paragraphs(answers: DataFrame, key: str = "qid", answer: str = "answer") -> DataFrame:
    """key, line, paragraph, status: 'kept' or 'uncited' (substantive and without a marker)."""
    lines = answers.select(key, F.posexplode(F.split(F.coalesce(F.col(answer), F.lit("")), "\n")).alias("line", "raw"))
    lines = lines.select(key, "line", tidy(F.col("raw")).alias("paragraph")).filter("paragraph <> ''")
    drop = is_substantive(F.col("paragraph")) & ~has_marker(F.col("paragraph"))
    return lines.withColumn("status", F.when(drop, "uncited").otherwise("kept"))


def claims(answers: DataFrame, key: str = "qid", answer: str = "answer") -> DataFrame:
    """key, claim, text, markers: the marker-bearing lines, counted from 0."""
    lines = answers.select(key, F.posexplode(F.split(F.coalesce(F.col(answer), F.lit("")), "\n")).alias("line", "raw"))
    lines = lines.select(key, "line", F.trim("raw").alias("text")).filter(has_marker(F.col("text")))
    at = Window.partitionBy(key).orderBy("line")
    return lines.select(key, (F.row_number().over(at) - 1).alias("claim"), "text", markers(F.col("text")).alias("markers"))


def verdicts(replies: DataFrame, key: str = "qid", reply: str = "reply") -> DataFrame:
    """key, claim, supported from the first JSON object of each reply; repeated claims are AND-ed, malformed entries ignored."""
    schema = "struct<claims:array<struct<index:int,supported:boolean,reason:string>>>"
    rows = replies.select(key, F.explode(F.from_json(first_json(F.col(reply)), schema)["claims"]).alias("c")).filter(F.col("c.index").isNotNull() & (F.col("c.index") >= 0))
    return rows.groupBy(key, F.col("c.index").alias("claim")).agg(F.bool_and(F.coalesce("c.supported", F.lit(False))).alias("supported"))


def apply_verdicts(claim_rows: DataFrame, found: DataFrame, key: str = "qid") -> DataFrame:
    """Claims with their verdict; a claim without one is unsupported."""
    return claim_rows.join(found, [key, "claim"], "left").withColumn("supported", F.coalesce("supported", F.lit(False)))


def groundedness(judged: DataFrame, key: str = "qid") -> DataFrame:
    return judged.groupBy(key).agg(F.avg(F.col("supported").cast("int")).alias("score"), F.count(F.lit(1)).alias("claims"))


def marker_map(groups: DataFrame, key: str = "qid") -> Column:
    return F.map_from_entries(F.collect_list(F.struct("number", "citation")))


def filter_structural(answers: DataFrame, passages: DataFrame, key: str = "qid") -> DataFrame:
    """key, answer, n_citations, invalid, removed: the answer with valid, renumbered markers and without uncited claims."""
    return filter_with_citations(answers, passages, key)[0]


def filter_with_citations(answers: DataFrame, passages: DataFrame, key: str = "qid") -> tuple[DataFrame, DataFrame]:
    """``filter_structural`` and the citations that the filtered answers have: key, number (as in the answer), passage (the best one's number)."""
    valid = passages.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("number", F.col("number").alias("same")))).alias("valid"))
    first = answers.join(valid, key, "left").withColumn("stripped", rewrite("answer", F.coalesce("valid", F.create_map().cast("map<int,int>"))))
    kept = paragraphs(first.select(key, F.col("stripped").alias("answer")), key)
    text = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("status") == "kept", F.struct("line", "paragraph")))), lambda x: x["paragraph"]), "\n").alias("kept_text"), F.sum((F.col("status") == "uncited").cast("int")).alias("removed"))
    groups = citation_groups(marker_rows(text.withColumnRenamed("kept_text", "answer"), key), passages, key)
    maps = groups.groupBy(key).agg(marker_map(groups).alias("m"), F.max("citation").alias("n_citations"))
    bad = invalid_markers(marker_rows(answers, key), passages, key).groupBy(key).agg(F.array_sort(F.collect_list("number")).alias("invalid"))
    out = answers.select(key).join(text, key, "left").join(maps, key, "left").join(bad, key, "left")
    done = out.select(key, F.when(F.col("n_citations").isNull(), F.lit("The retrieved context doesn't support an answer to this question.")).otherwise(rewrite("kept_text", "m")).alias("answer"), F.coalesce("n_citations", F.lit(0)).alias("n_citations"), F.coalesce("invalid", F.array().cast("array<int>")).alias("invalid"), F.coalesce("removed", F.lit(0)).alias("removed"))
    cited = groups.select(key, F.col("citation").alias("number"), F.col("best_number").alias("passage")).distinct()
    return done, cited
