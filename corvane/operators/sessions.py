"""Sessions: their ids and scopes, the documents that they hold, history, and what goes when they end."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what a session id may look like, and what one that was issued looks like
SAFE_ID = r"^[A-Za-z0-9][A-Za-z0-9_-]{0,63}$"
ISSUED_ID = r"^[0-9a-f]{32}$"
MOST_DOCUMENTS = 5
MOST_CHATS = 50


def new_session_id() -> str:
    return uuid.uuid4().hex


def scope_for(session_id: str) -> str:
    """The scope of a session's passages; an id that could not be a folder's name is refused."""
    if not re.match(SAFE_ID, session_id) or session_id.endswith("\n"):
        raise ValueError("a session id has 1 to 64 letters, digits, hyphens or underscores and begins with a letter or digit")
    return f"session:{session_id}"


def id_kind(session_id: Column) -> Column:
    """'issued', 'safe' or 'refused'."""
    return F.when(session_id.rlike(ISSUED_ID), "issued").when(session_id.rlike(SAFE_ID), "safe").otherwise("refused")


def held_documents(passages: DataFrame) -> DataFrame:
    """corpus_scope, held: the distinct documents of each scope."""
    return passages.groupBy("corpus_scope").agg(F.array_sort(F.collect_set("source_doc")).alias("held"))


def admit(uploads: DataFrame, passages: DataFrame, most: int = MOST_DOCUMENTS) -> DataFrame:
    """corpus_scope, n_held, n_new, admitted for uploads (corpus_scope, source_doc): all of an upload or nothing, by the size of the union."""
    incoming = uploads.groupBy("corpus_scope").agg(F.array_sort(F.collect_set("source_doc")).alias("incoming"))
    rows = incoming.join(held_documents(passages), "corpus_scope", "left").withColumn("held", F.coalesce("held", F.array().cast("array<string>")))
    return rows.select("corpus_scope", F.size("held").alias("n_held"), F.size(F.array_except("incoming", "held")).alias("n_new"), (F.size(F.array_union("held", "incoming")) <= most).alias("admitted"))


def holds(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """The (corpus_scope, source_doc) pairs that are asked for and there."""
    return questions.join(passages.select("corpus_scope", "source_doc"), ["corpus_scope", "source_doc"], "left_semi")


def drop_session(passages: DataFrame, cache: DataFrame, turns: DataFrame, session_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without the session's passages, cached answers and turns; a session that is not there changes nothing."""
    scope = scope_for(session_id)
    other = ~F.coalesce(F.col("corpus_scope") == scope, F.lit(False))
    return passages.filter(other), cache.filter(other), turns.filter(~F.coalesce(F.col("session_id") == session_id, F.lit(False)))


def record_turn(turns: DataFrame, new: DataFrame, most_turns: int = 3, most_sessions: int = 1_000, idle_seconds: float = 24 * 3600) -> DataFrame:
    """History after new turns: the latest of each session, of sessions not idle at the latest time, and of these the most recently used."""
    both = turns.unionByName(new)
    latest = Window.partitionBy("session_id").orderBy(F.desc("ts"), F.desc("turn"))
    rows = both.withColumn("n", F.row_number().over(latest)).filter(F.col("n") <= most_turns).drop("n")
    used = both.groupBy("session_id").agg(F.max("ts").alias("last_used"))
    now = F.broadcast(both.agg(F.max("ts").alias("now")))  # one row
    live = used.join(now).filter(F.col("now") - F.col("last_used") < idle_seconds)
    keep = live.orderBy(F.desc("last_used"), "session_id").limit(most_sessions)
    return rows.join(keep.select("session_id"), "session_id", "left_semi")


def purge(sessions: DataFrame, now: float, ttl_seconds: float) -> DataFrame:
    """name, fate of session folders (name, updated_at): what is left of deleted ones always goes, unknown names always stay."""
    name = F.col("name")
    fate = F.when(name.startswith(".deleted-"), "removed").when(~name.rlike(SAFE_ID), "left").when(F.col("updated_at") >= now - ttl_seconds, "left").otherwise("removed")
    return sessions.select("name", fate.alias("fate"))


def recent_chats(chats: DataFrame, most: int = MOST_CHATS) -> DataFrame:
    """Of each user the chats last used."""
    latest = Window.partitionBy("user_id").orderBy(F.desc("updated_at"), "chat_id")
    return chats.withColumn("n", F.row_number().over(latest)).filter(F.col("n") <= most)
