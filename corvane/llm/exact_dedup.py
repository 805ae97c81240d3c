"""Exact deduplication by distributed most-significant-digit radix partitioning.

The texts, stripped of ASCII white space and taken as UTF-8, are split by
successive bytes.  A digit is a run of bytes: 48 at first, sixteen times longer
each round (768, 12,288, ...).  Rows of one group with one digit form a group
of the next round; a group of one row, or one whose texts have ended, is
finished.  Equal texts are those that end together, so no digest decides
anything.  The text's length in bytes is digit one, of the same key as the
first bytes, and ends most groups in the first round.  Digits meet by a hash
shuffle, which deals them to tasks; it compares the bytes themselves.

Each round is one map-side-combined count and one join on (group, digit), in
which the rows of a large group are dealt to several tasks.

Defined results: null counts as the empty text; texts of any length are read
whole; of rows that tie in length and doc_id one is kept, repeated rows
included; a null doc_id sorts last; an empty table gives no rows; columns other
than doc_id, text and the row number ``common.ROW`` are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import materialize, row_id, skew_join, text_or_empty

FIRST_DIGIT = 48
GROWTH = 16
WHITE = r"[\x20\x09-\x0D]"


def normalized(text: Column) -> Column:
    return F.regexp_replace(text, WHITE, "")


def _round(state: DataFrame, keys: list[str], total: int) -> DataFrame:
    """Group rows by (keys); gid_next becomes the least row id of the group, members its rows."""
    counts = state.groupBy(*keys).agg(F.min("rid").alias("gid_next"), F.count(F.lit(1)).alias("members"))
    return skew_join(state.drop("members"), counts, keys, "members", total, ["rid"])


def equal_groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_points (of the text), text_sha256, rid, gid (equal for equal texts, unique otherwise)."""
    body = text_or_empty()
    rest = F.encode(normalized(body), "UTF-8")
    rows = docs.select("doc_id", F.char_length(body).cast("long").alias("n_points"), rest.alias("rest"), row_id(docs).alias("rid"))
    rows = rows.withColumn("text_sha256", F.sha2("rest", 256)).withColumn("n_bytes", F.octet_length("rest")).withColumn("digit", F.substring("rest", 1, FIRST_DIGIT))
    total = docs.count()
    state = _round(rows, ["n_bytes", "digit"], total)
    keep = ["doc_id", "n_points", "text_sha256", "rid"]
    at, used, done = FIRST_DIGIT, FIRST_DIGIT, []
    while True:
        ended = (F.col("members") == 1) | (F.col("n_bytes") <= at)
        state = state.withColumn("gid", F.col("gid_next")).withColumn("ended", ended).withColumn("rest", F.when(~ended, F.expr(f"substring(rest, {used + 1})")))
        state = materialize(state.select(*keep, "n_bytes", "rest", "gid", "members", "ended"), "radix", ("ended",))
        done.append(state.filter("ended").select(*keep, F.struct(F.lit(len(done)).alias("round"), "gid").alias("gid")))
        state = state.filter("NOT ended")
        left = state.count()
        if not left:
            break
        used *= GROWTH
        state = state.withColumn("digit", F.substring("rest", 1, used))
        state = _round(state.drop("ended"), ["gid", "digit"], total)
        at += used
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def dedup_exact(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, n_points, rid for every row of ``docs``."""
    rows = equal_groups(docs)
    total = docs.count()
    rank = F.struct((-F.col("n_points")).alias("p"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("d"), F.col("rid").alias("r"))
    best = rows.groupBy("gid").agg(F.count(F.lit(1)).alias("group_size"), F.min(rank).alias("best"))
    # singletons need no join, but asking which they are costs the same shuffle
    joined = skew_join(rows, best, ["gid"], "group_size", total, ["rid"])
    return joined.select("doc_id", F.col("best.d").alias("keep_id"), "group_size", (F.col("rid") == F.col("best.r")).alias("kept"), "text_sha256", "n_points", "rid")
