"""From ranked passages to a checked answer: prompts, verdicts, verification, and what is returned and kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import collapse, first_json, let, markers, sanitize
from corvane.operators.citations import apply_verdicts, claims, groundedness, has_marker, marker_rows, rewrite

# fixed values: limits of what a model is shown, and the answer that nothing supports
GATE_PASSAGES = 5
GATE_CHARS = 4_000
EVIDENCE_CHARS = 1_500
REASON_CHARS = 300
NO_SUPPORT = "The retrieved context doesn't support an answer to this question."
NO_RELEVANT_WEB = "The web search found nothing relevant to this topic, so this answer comes from the document alone."
UNAVAILABLE = "verification unavailable"
VERDICTS = ("sufficient", "partial", "insufficient")


# ---- prompts


def passage_label(number: Column, kind: Column, source_doc: Column, page: Column, source_url: Column) -> Column:
    """'[3] report.pdf, page 7' or '[3] https://...'."""
    place = F.when(kind == "web", source_url).otherwise(F.concat(F.coalesce(source_doc, F.lit("")), F.coalesce(F.concat(F.lit(", page "), page.cast("string")), F.lit(""))))
    return F.concat(F.lit("["), number.cast("string"), F.lit("] "), place)


def render_contexts(passages: DataFrame, keys: list[str]) -> DataFrame:
    """keys, context: the passages of each group under their labels, in order of number, a blank line between them."""
    label = passage_label(F.col("number"), F.col("kind"), F.col("source_doc"), F.col("page"), F.col("source_url"))
    block = F.concat(label, F.lit("\n"), F.trim("text"))
    ordered = F.array_sort(F.collect_list(F.struct("number", block.alias("block"))))
    return passages.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("context"))


def sub_question_sections(questions: DataFrame, passages: DataFrame) -> DataFrame:
    """qid, sections: every sub-question with its own context, or the note that it has none; questions have qid, sub, text."""
    own = questions.join(render_contexts(passages, ["qid", "sub"]), ["qid", "sub"], "left")
    n = F.col("sub").cast("string")
    tag = lambda name, body: F.concat(F.lit(f"<{name}_"), n, F.lit(">\n"), body, F.lit(f"\n</{name}_"), n, F.lit(">"))
    section = F.concat(tag("sub_question", F.col("text")), F.lit("\n"), tag("context", F.coalesce("context", F.lit("(no passages found)"))))
    ordered = F.array_sort(F.collect_list(F.struct("sub", section.alias("section"))))
    return own.groupBy("qid").agg(F.array_join(F.transform(ordered, lambda x: x["section"]), "\n\n").alias("sections"))


def gate_passages(candidates: DataFrame, most: int = GATE_PASSAGES, chars: int = GATE_CHARS) -> DataFrame:
    """The first passages of each question, cut, as the sufficiency model sees them."""
    first = Window.partitionBy("qid").orderBy("position", "chunk_id")
    rows = candidates.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= most)
    return rows.withColumn("text", F.substring("text", 1, chars))


# ---- replies


def parse_verdict(reply: Column) -> Column:
    """(verdict, reason, missing) of a reply's first JSON object; the older boolean is understood, anything else has no verdict."""

    def read(parsed: Column) -> Column:
        named = F.coalesce(parsed["verdict"], F.when(parsed["sufficient"], "sufficient").when(~parsed["sufficient"], "insufficient"))
        known = F.when(named.isin(*VERDICTS), named)
        trimmed = lambda c: F.trim(F.coalesce(c, F.lit("")))
        return F.struct(known.alias("verdict"), F.when(known.isNotNull(), trimmed(parsed["reason"])).alias("reason"), F.when(known == "partial", trimmed(parsed["missing"])).otherwise("").alias("missing"))

    return let(F.from_json(first_json(reply), "struct<verdict:string,sufficient:boolean,reason:string,missing:string>"), read)


def unsafe_input(reply: Column) -> Column:
    """Only an explicit safe=false, however it is wrapped, rejects a question: the classifier fails open."""
    return ~F.coalesce(F.from_json(first_json(reply), "struct<safe:boolean>")["safe"], F.lit(True))


def safety(reply: Column) -> Column:
    """'pass' or 'fail' of a verification reply, null where it has neither."""
    verdict = F.from_json(first_json(reply), "struct<safety:struct<verdict:string,reason:string>>")["safety"]["verdict"]
    return F.when(verdict.isin("pass", "fail"), verdict)


def clip(reason: Column, chars: int = REASON_CHARS) -> Column:
    return F.substring(collapse(F.coalesce(reason, F.lit(""))), 1, chars)


# ---- questions


def resolved_question(question: Column, rewritten: Column, turns: Column, most_chars: int = 2_000) -> Column:
    """A rewrite of one line and fair length replaces the question, where there are turns to resolve it by."""
    usable = rewritten.isNotNull() & (F.length(rewritten) <= most_chars) & ~F.trim(rewritten).contains("\n")
    clean = F.regexp_replace(sanitize(rewritten), "^[\"'` ]+|[\"'` ]+$", "")
    return F.when((turns > 0) & usable & (clean != ""), clean).otherwise(question)


def render_turns(turns: DataFrame, session: str = "session_id") -> DataFrame:
    """session, conversation: Q and A lines in order of turn; a turn without a summary has no A line."""
    line = F.concat(F.lit("Q: "), F.col("resolved_question"), F.coalesce(F.when(F.col("answer_summary") != "", F.concat(F.lit("\nA: "), F.col("answer_summary"))), F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return turns.groupBy(session).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("conversation"))


def select_scope(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """``questions`` (qid, session_id) with the scope that they search: their session's where it holds a passage, else the corpus."""
    held = documents.filter(F.col("corpus_scope").startswith("session:")).select(F.col("corpus_scope").alias("own")).distinct()
    own = F.concat(F.lit("session:"), F.col("session_id"))
    return questions.join(held, own == F.col("own"), "left").withColumn("scope", F.coalesce("own", F.lit("persistent"))).drop("own")


# ---- verification


def evidence(claim_rows: DataFrame, citations: DataFrame, texts: DataFrame, chars: int = EVIDENCE_CHARS) -> DataFrame:
    """qid, claim, evidence: each claim's cited passages, whole where the text is known and else the snippet.

    Claims have qid, claim, markers; citations qid, number, kind, key (of the
    text), source_doc, page, source_url, snippet; texts key, text.
    """
    asked = claim_rows.select("qid", "claim", F.posexplode("markers").alias("at", "number"))
    rows = asked.join(citations, ["qid", "number"], "left").join(texts.select("key", F.col("text").alias("full")), "key", "left")
    label = passage_label(F.col("number"), F.col("kind"), F.col("source_doc"), F.col("page"), F.col("source_url"))
    body = F.substring(collapse(F.coalesce(F.when(F.col("full") != "", F.col("full")), F.col("snippet"), F.lit(""))), 1, chars)
    none = F.concat(F.lit("["), F.col("number").cast("string"), F.lit("] (passage unavailable)"))
    block = F.when(F.col("kind").isNull(), none).otherwise(F.concat(label, F.lit("\n"), body))
    ordered = F.array_sort(F.collect_list(F.struct("at", block.alias("block"))))
    return rows.groupBy("qid", "claim").agg(F.array_join(F.transform(ordered, lambda x: x["block"]), "\n\n").alias("evidence"))


def verify(claim_rows: DataFrame, replies: DataFrame, verdicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(claims with supported, and per question score, claims and safety).  It fails closed: no usable reply supports nothing.

    ``replies`` have qid and reply, ``verdicts`` what ``citations.verdicts`` read from them.
    """
    usable = replies.select("qid", safety(F.col("reply")).alias("safety")).filter("safety IS NOT NULL").groupBy("qid").agg(F.min("safety").alias("safety"))
    judged = apply_verdicts(claim_rows, verdicts.join(usable.select("qid"), "qid", "left_semi"))
    scores = groundedness(judged).join(usable, "qid", "left")
    return judged, scores.withColumn("safety", F.coalesce("safety", F.lit("fail")))


def drop_unsupported(answers: DataFrame, judged: DataFrame) -> DataFrame:
    """qid, answer, n_citations, removed, is_non_answer: the answer without unsupported claims, its citations numbered again.

    Answers have qid, answer, n_citations; judged claims qid, claim, supported.
    """
    lines = answers.select("qid", F.posexplode(F.split(F.coalesce("answer", F.lit("")), "\n")).alias("line", "raw"))
    lines = lines.select("qid", "line", F.trim("raw").alias("text")).filter("text <> ''").withColumn("marked", has_marker(F.col("text")))
    at = Window.partitionBy("qid").orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("claim", F.when(F.col("marked"), F.sum(F.col("marked").cast("int")).over(at) - 1).cast("int"))
    bad = judged.filter(~F.col("supported")).select("qid", F.col("claim").cast("int").alias("claim"), F.lit(True).alias("bad"))
    rows = lines.join(bad, ["qid", "claim"], "left")
    kept = F.array_sort(F.collect_list(F.when(F.col("bad").isNull(), F.struct("line", "text"))))
    out = rows.groupBy("qid").agg(F.array_join(F.transform(kept, lambda x: x["text"]), "\n").alias("kept"), F.sum(F.col("bad").cast("int")).alias("removed"))
    own = answers.select("qid", "n_citations", F.when(F.col("answer").contains("\n\n"), "\n\n").otherwise("\n").alias("gap")).join(out, "qid", "left")
    own = own.withColumn("kept", F.when(F.col("removed") > 0, F.replace("kept", F.lit("\n"), F.col("gap"))).otherwise(F.col("kept")))
    numbers = marker_rows(own.select("qid", F.coalesce("kept", F.lit("")).alias("answer"), "n_citations").filter("n_citations > 0"), "qid")
    numbers = numbers.join(own.select("qid", "n_citations"), "qid").filter("number BETWEEN 1 AND n_citations")
    place = Window.partitionBy("qid").orderBy("first_at")
    numbers = numbers.withColumn("new", F.row_number().over(place).cast("int"))
    maps = numbers.groupBy("qid").agg(F.map_from_entries(F.collect_list(F.struct("number", "new"))).alias("m"), F.max("new").alias("left"))
    done = own.join(maps, "qid", "left")
    lost = F.col("left").isNull()
    return done.select("qid", F.when(lost, NO_SUPPORT).otherwise(rewrite("kept", "m")).alias("answer"), F.coalesce("left", F.lit(0)).alias("n_citations"), F.coalesce("removed", F.lit(0)).cast("int").alias("removed"), lost.alias("is_non_answer"))


# ---- results


def blockers(passed: Column, non_answer: Column, n_citations: Column, verified: Column, scope: Column, web: Column, empty_web: Column) -> Column:
    """The reasons for which an answer is not kept for later; null columns count as false."""
    rules = {
        "output guardrail failed": ~F.coalesce(passed, F.lit(False)),
        "non-answer": non_answer,
        "no citations": n_citations == 0,
        UNAVAILABLE: ~F.coalesce(verified, F.lit(False)),
        "session-scoped answer": scope != "persistent",
        "answer cites web sources": web,
        "web search found nothing relevant": empty_web,
    }
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(k)) for k, c in rules.items()]), lambda x: x.isNotNull())


def note_empty_web(answer: Column, n_citations: Column, empty_web: Column) -> Column:
    """A real answer whose web search found only off-topic results says so."""
    return F.when((n_citations > 0) & empty_web, F.concat(answer, F.lit("\n\n" + NO_RELEVANT_WEB))).otherwise(answer)


def response(answers: DataFrame, events: DataFrame) -> DataFrame:
    """``answers`` with their stages in order (stage, status, duration_ms); what only began is left out."""
    done = events.filter("status <> 'started'").groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("seq", "stage", "status", "duration_ms"))).alias("stages"))
    done = done.withColumn("stages", F.transform("stages", lambda x: F.struct(x["stage"].alias("stage"), x["status"].alias("status"), x["duration_ms"].alias("duration_ms"))))
    return answers.join(done, "qid", "left")


def merge_sub_contexts(contexts: DataFrame, failures: DataFrame) -> DataFrame:
    """Passages of all sub-questions (qid, sub, chunk_id, position, ...), first one of a chunk, of questions none of whose parts failed."""
    whole = contexts.join(failures.select("qid").distinct(), "qid", "left_anti")
    first = Window.partitionBy("qid", "chunk_id").orderBy("sub", "position")
    return whole.withColumn("n", F.row_number().over(first)).filter("n = 1").drop("n")


def citation_counts(citations: DataFrame) -> DataFrame:
    """qid, corpus, web: what an answer cites, by kind."""
    return citations.groupBy("qid").agg(F.count_if(F.col("kind") == "corpus").alias("corpus"), F.count_if(F.col("kind") != "corpus").alias("web"))


def claim_markers(answers: DataFrame) -> DataFrame:
    """Claims of filtered answers with the passages they cite."""
    return claims(answers).withColumn("markers", markers(F.col("text")))


def badge(score: Column) -> Column:
    """How a share of supported claims is shown."""
    return F.when(score >= 0.8, "good").when(score >= 0.5, "warn").when(score.isNotNull(), "bad")
