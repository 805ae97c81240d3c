"""Registered queries of the answer path, extraction and sessions, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import answering, cache, citations, dense, extraction, ledger, sessions, web
from corvane.queries import _ANS, _BM25, _COS, _DENSE, _PAGES, _answers, _calls, _CALLS, _collapse, _dense_hits, _keyword_hits, _pages, _refs, _with_text, as_models_write, query, table
from corvane.sources.tables import saved

# ---- prompts

_LABEL_SQL = "concat('[', number, '] ', CASE WHEN kind = 'web' THEN source_url ELSE concat(coalesce(source_doc, ''), coalesce(concat(', page ', page::VARCHAR), '')) END)"
_LABELLED = "l AS (SELECT doc_id, doc_id % 9 + 1 AS number, CASE WHEN doc_id % 4 = 0 THEN 'web' ELSE 'corpus' END AS kind, source AS source_doc, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 11)::INT END AS page, concat('https://e.org/', doc_id) AS source_url, text FROM documents)"


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return table(spark, sf, "documents").select("doc_id", (d % 9 + 1).alias("number"), F.when(d % 4 == 0, "web").otherwise("corpus").alias("kind"), F.col("source").alias("source_doc"), F.when(d % 3 != 0, (d % 11).cast("int")).alias("page"), F.concat(F.lit("https://e.org/"), d.cast("string")).alias("source_url"), "text")


@query(f"WITH {_LABELLED} SELECT doc_id, CASE WHEN kind = 'corpus' AND page IS NULL THEN concat('[', number, '] ', coalesce(source_doc, '')) ELSE {_LABEL_SQL} END AS label FROM l")
def q_passage_label(spark: SparkSession, sf: str) -> DataFrame:
    label = answering.passage_label(F.col("number"), F.col("kind"), F.col("source_doc"), F.col("page"), F.col("source_url"))
    return _labelled(spark, sf).select("doc_id", label.alias("label"))


_CONTEXT = f"""{_BM25}, p AS (SELECT k.item_id AS qid, k.rank % 2 + 1 AS sub, k.rank AS number, l.kind, l.source_doc, l.page, l.source_url, l.text FROM kw k JOIN l USING (doc_id)),
blocks AS (SELECT qid, sub, number, concat({_LABEL_SQL.replace("concat(', page ', page::VARCHAR)", "', page ' || page::VARCHAR")}, chr(10), trim(text)) AS block FROM p WHERE text IS NOT NULL)"""


def _prompt_passages(spark: SparkSession, sf: str) -> DataFrame:
    hits = _keyword_hits(spark, sf).select(F.col("item_id").alias("qid"), "doc_id", F.col("rank"))
    return hits.join(_labelled(spark, sf).drop("number"), "doc_id").withColumn("number", F.col("rank")).withColumn("sub", F.col("rank") % 2 + 1)


@query(f"WITH {_LABELLED}, {_CONTEXT} SELECT qid, sha256(string_agg(block, chr(10) || chr(10) ORDER BY number)) AS digest, count(*) AS passages FROM blocks GROUP BY qid")
def q_prompt_context(spark: SparkSession, sf: str) -> DataFrame:
    rows = _prompt_passages(spark, sf).filter("text IS NOT NULL")
    out = answering.render_contexts(rows, ["qid"]).join(rows.groupBy("qid").agg(F.count(F.lit(1)).alias("passages")), "qid")
    return out.select("qid", F.sha2("context", 256).alias("digest"), "passages")


@query(f"""WITH {_LABELLED}, {_CONTEXT}, c AS (SELECT qid, sub, string_agg(block, chr(10) || chr(10) ORDER BY number) AS context FROM blocks GROUP BY ALL),
q AS (SELECT item_id AS qid, s AS sub, concat('part ', s) AS text FROM benchmark, (SELECT unnest([1, 2, 3]) AS s)),
s AS (SELECT qid, sub, concat('<sub_question_', sub, '>', chr(10), text, chr(10), '</sub_question_', sub, '>', chr(10), '<context_', sub, '>', chr(10), coalesce(context, '(no passages found)'), chr(10), '</context_', sub, '>') AS section FROM q LEFT JOIN c USING (qid, sub))
SELECT qid, sha256(string_agg(section, chr(10) || chr(10) ORDER BY sub)) AS digest FROM s GROUP BY qid""")
def q_prompt_sections(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("sub")).withColumn("text", F.concat(F.lit("part "), F.col("sub").cast("string")))
    out = answering.sub_question_sections(asked, _prompt_passages(spark, sf).filter("text IS NOT NULL"))
    return out.select("qid", F.sha2("sections", 256).alias("digest"))


@query(f"WITH {_BM25} SELECT item_id AS qid, doc_id AS chunk_id, rank AS place, length(substr(text, 1, 4000)) AS chars FROM kw JOIN documents USING (doc_id) WHERE rank <= 5")
def q_gate_passages(spark: SparkSession, sf: str) -> DataFrame:
    return answering.gate_passages(_with_text(spark, sf)).select("qid", "chunk_id", "place", F.length("text").alias("chars"))


# ---- replies


def _verdict_replies(spark: SparkSession, sf: str) -> DataFrame:
    forms = ['{"verdict": "sufficient", "reason": " r "}', '{"sufficient": false, "safe": false}', '{"verdict": "partial", "missing": " m ", "safe": true}', "no json", '{"verdict": "maybe"}', '{"sufficient": true, "reason": 3}']
    form = F.element_at(F.array(*map(F.lit, forms)), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, sf, "labels").select("doc_id", as_models_write(form, F.col("doc_id")).alias("reply")).distinct()


@query("""SELECT DISTINCT doc_id, [('sufficient'), 'insufficient', 'partial', NULL, NULL, 'sufficient'][doc_id % 6 + 1] AS verdict, ['r', '', '', NULL, NULL, '3'][doc_id % 6 + 1] AS reason, CASE WHEN doc_id % 6 = 2 THEN 'm' ELSE '' END AS missing FROM labels""")
def q_verdict_parse(spark: SparkSession, sf: str) -> DataFrame:
    return _verdict_replies(spark, sf).select("doc_id", answering.parse_verdict(F.col("reply")).alias("v")).select("doc_id", "v.verdict", "v.reason", "v.missing")


@query("SELECT DISTINCT doc_id, doc_id % 6 = 1 AS rejected FROM labels")
def q_input_classifier(spark: SparkSession, sf: str) -> DataFrame:
    return _verdict_replies(spark, sf).select("doc_id", answering.unsafe_input(F.col("reply")).alias("rejected"))


@query("""WITH v AS (SELECT doc_id, bool_and(quality = 1) AS a, bool_and(toxic = 0) AS b FROM labels GROUP BY doc_id)
SELECT doc_id AS qid, round(CASE WHEN doc_id % 3 = 0 THEN 0 ELSE (a::INT + b::INT) / 3 END, 6)::DOUBLE AS score, 3 AS claims, CASE WHEN doc_id % 3 = 1 THEN 'pass' ELSE 'fail' END AS safety FROM v""")
def q_verify_fail_closed(spark: SparkSession, sf: str) -> DataFrame:
    """Verdicts of labels; a third of the replies has no safety verdict and so supports nothing."""
    entry = lambda i, ok: F.struct(F.lit(i).alias("index"), ok.alias("supported"), F.lit("").alias("reason"))
    safe = F.when(F.col("doc_id") % 3 == 1, "pass").when(F.col("doc_id") % 3 == 2, "fail").otherwise("unsure")
    body = F.to_json(F.struct(F.array(entry(0, F.col("quality") == 1), entry(1, F.col("toxic") == 0)).alias("claims"), F.struct(safe.alias("verdict")).alias("safety")))
    replies = table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), as_models_write(body, F.col("doc_id")).alias("reply"))
    claim_rows = replies.select("qid").distinct().select("qid", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("claim"))
    scores = answering.verify(claim_rows, replies, citations.verdicts(replies))[1]
    return scores.select("qid", F.round("score", 6).alias("score"), "claims", "safety")


# ---- questions


@query(f"""WITH u AS (SELECT conv_id, turn, text AS question, turn % 5 AS k FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN turn > 0 AND k = 2 AND length(concat(' "', question, '" ')) <= 2000 AND NOT contains(question, chr(10)) AND {_collapse("question")} <> '' THEN trim({_collapse("question")}, '"''` ') WHEN turn > 0 AND k = 3 THEN 'a new question' ELSE question END AS resolved FROM u""")
def q_resolve_question(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").filter("role = 'user'")
    k = F.col("turn") % 5
    rewritten = F.when(k == 1, "two\nlines").when(k == 2, F.concat(F.lit(' "'), F.col("text"), F.lit('" '))).when(k == 3, "`a new question`").when(k == 4, "x" * 2_001)
    return rows.select("conv_id", "turn", answering.resolved_question(F.col("text"), rewritten, F.col("turn")).alias("resolved"))


@query("SELECT conv_id, sha256(string_agg(concat('Q: ', text, CASE WHEN turn % 2 = 0 THEN concat(chr(10), 'A: ', role) ELSE '' END), chr(10) ORDER BY turn)) AS digest FROM conversations GROUP BY conv_id")
def q_render_turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("resolved_question"), F.when(F.col("turn") % 2 == 0, F.col("role")).alias("answer_summary"))
    return answering.render_turns(rows, "conv_id").select("conv_id", F.sha2("conversation", 256).alias("digest"))


@query("""WITH h AS (SELECT DISTINCT concat('session:', doc_id % 5) AS s FROM documents WHERE doc_id % 10 < 7 AND doc_id % 5 <> 3)
SELECT item_id AS qid, CASE WHEN concat('session:', item_id % 7) IN (SELECT s FROM h) THEN concat('session:', item_id % 7) ELSE 'persistent' END AS scope FROM benchmark""")
def q_select_scope(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("doc_id % 10 < 7 AND doc_id % 5 <> 3").select(F.concat(F.lit("session:"), (F.col("doc_id") % 5).cast("string")).alias("corpus_scope"))
    asked = table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), (F.col("item_id") % 7).cast("string").alias("session_id"))
    return answering.select_scope(asked, docs).select("qid", "scope")


# ---- verification


@query(rf"""WITH {_ANS}, n AS (SELECT qid, i AS claim, 0 AS pos, (qid + i) % 6 AS number FROM lines UNION ALL SELECT qid, i, 1, (qid * 3 + i * 2) % 9 FROM lines WHERE (qid * 3 + i * 2) % 9 <> (qid + i) % 6),
b AS (SELECT qid, claim, pos, concat('[', number, '] ', CASE WHEN number NOT BETWEEN 1 AND 6 THEN '(passage unavailable)' ELSE concat(CASE WHEN number > 4 THEN 'https://example.org/page' ELSE concat('doc', number % 2, ', page ', CASE WHEN number <= 2 THEN 1 ELSE number % 2 END) END, chr(10), CASE WHEN number % 2 = 0 THEN concat('full text of ', number) ELSE concat('snippet ', number) END) END) AS block FROM n)
SELECT qid, claim, string_agg(block, chr(10) || chr(10) ORDER BY pos) AS evidence FROM b GROUP BY ALL""")
def q_claim_evidence(spark: SparkSession, sf: str) -> DataFrame:
    answers = _answers(spark, sf)
    n = F.col("number").cast("string")
    refs = _refs(answers).withColumn("key", F.concat(F.lit("k"), n)).withColumn("snippet", F.concat(F.lit("snippet "), n))
    texts = spark.range(1, 7).filter("id % 2 = 0").select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("full  text\tof "), F.col("id").cast("string")).alias("text"))
    return answering.evidence(answering.claim_markers(answers), refs, texts)


@query(f"""WITH {_ANS}, k AS (SELECT qid, i, (qid + i) % 6 AS number FROM lines WHERE i % 3 <> 1 UNION ALL SELECT qid, i, (qid * 3 + i * 2) % 9 FROM lines WHERE i % 3 <> 1)
SELECT l.qid, coalesce(n, 0) AS n_citations, removed, coalesce(n, 0) = 0 AS is_non_answer FROM (SELECT qid, (count(*) FILTER (i % 3 = 1))::INT AS removed FROM lines GROUP BY qid) l
LEFT JOIN (SELECT qid, count(DISTINCT number) AS n FROM k WHERE number BETWEEN 1 AND 5 GROUP BY qid) USING (qid)""")
def q_drop_unsupported(spark: SparkSession, sf: str) -> DataFrame:
    answers = _answers(spark, sf).withColumn("n_citations", F.lit(5))
    judged = answering.claim_markers(answers).select("qid", "claim", (F.col("claim") % 3 != 1).alias("supported"))
    return answering.drop_unsupported(answers, judged).select("qid", "n_citations", "removed", "is_non_answer")


# ---- results


@query("""SELECT DISTINCT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 2 = 0 THEN 'output guardrail failed' END, CASE WHEN doc_id % 3 = 0 THEN 'non-answer' END, CASE WHEN doc_id % 5 = 0 THEN 'no citations' END, CASE WHEN doc_id % 7 = 0 THEN 'verification unavailable' END,
 CASE WHEN doc_id % 11 = 0 THEN 'session-scoped answer' END, CASE WHEN doc_id % 13 = 0 THEN 'answer cites web sources' END, CASE WHEN doc_id % 17 = 0 THEN 'web search found nothing relevant' END], lambda x: x IS NOT NULL), ',') AS reasons FROM labels""")
def q_cache_blockers(spark: SparkSession, sf: str) -> DataFrame:
    by = lambda n: F.col("doc_id") % n == 0
    scope = F.when(by(11), "session:x").otherwise("persistent")
    found = answering.blockers(~by(2), by(3), F.when(by(5), 0).otherwise(2), ~by(7), scope, by(13), by(17))
    return table(spark, sf, "labels").select("doc_id", F.array_join(found, ",").alias("reasons")).distinct()


@query(f"SELECT doc_id, length(coalesce(text, '')) + CASE WHEN doc_id % 2 = 0 AND doc_id % 3 > 0 THEN {len(answering.NO_RELEVANT_WEB) + 2} ELSE 0 END AS chars FROM documents")
def q_empty_web_note(spark: SparkSession, sf: str) -> DataFrame:
    noted = answering.note_empty_web(F.coalesce("text", F.lit("")), F.col("doc_id") % 3, F.col("doc_id") % 2 == 0)
    return table(spark, sf, "documents").select("doc_id", F.length(noted).alias("chars"))


@query("""WITH s AS (SELECT user_id AS qid, event_id, event_type, round(value, 1) AS ms, CASE event_id % 3 WHEN 0 THEN 'started' WHEN 1 THEN 'completed' ELSE 'failed' END AS status FROM events)
SELECT user_id AS qid, (SELECT string_agg(concat(event_type, ':', status), ',' ORDER BY event_id) FROM s WHERE s.qid = u.user_id AND status <> 'started') AS stages FROM (SELECT DISTINCT user_id FROM events) u""")
def q_response_stages(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    status = F.when(F.col("event_id") % 3 == 0, "started").when(F.col("event_id") % 3 == 1, "completed").otherwise("failed")
    rows = events.select(F.col("user_id").alias("qid"), F.col("event_id").alias("seq"), F.col("event_type").alias("stage"), status.alias("status"), T.elapsed_ms(F.lit(0.0), F.col("value")).alias("duration_ms"))
    out = answering.response(events.select(F.col("user_id").alias("qid")).distinct(), rows)
    return out.select("qid", F.array_join(F.transform("stages", lambda x: F.concat(x["stage"], F.lit(":"), x["status"])), ",").alias("stages"))


@query(f"""WITH {_BM25}, {_DENSE}, r AS (SELECT item_id AS qid, 1 AS sub, doc_id AS chunk_id, rank AS position FROM kw UNION ALL SELECT item_id, 2, doc_id, rank FROM dn)
SELECT qid, chunk_id, sub, position FROM r WHERE qid % 4 <> 0 QUALIFY row_number() OVER (PARTITION BY qid, chunk_id ORDER BY sub, position) = 1""")
def q_sub_contexts(spark: SparkSession, sf: str) -> DataFrame:
    one = _keyword_hits(spark, sf).select(F.col("item_id").alias("qid"), F.lit(1).alias("sub"), F.col("doc_id").alias("chunk_id"), F.col("rank").alias("position"))
    two = _dense_hits(spark, sf).select(F.col("item_id").alias("qid"), F.lit(2).alias("sub"), F.col("vec_id").alias("chunk_id"), F.col("rank").alias("position"))
    failed = table(spark, sf, "benchmark").filter("item_id % 4 = 0").select(F.col("item_id").alias("qid"))
    return answering.merge_sub_contexts(one.unionByName(two), failed).select("qid", "chunk_id", "sub", "position")


@query("SELECT item_id AS qid, 4 AS corpus, 2 AS web FROM benchmark")
def q_citation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return answering.citation_counts(_refs(table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"))))


@query("SELECT DISTINCT doc_id, CASE WHEN doc_id % 11 = 10 THEN NULL WHEN (doc_id % 11) / 10 >= 0.8 THEN 'good' WHEN (doc_id % 11) / 10 >= 0.5 THEN 'warn' ELSE 'bad' END AS badge FROM labels")
def q_fact_badge(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id") % 11
    return table(spark, sf, "labels").select("doc_id", answering.badge(F.when(d < 10, d / 10)).alias("badge")).distinct()


@query("""WITH e AS (SELECT sha256(concat('persistent', chr(0), text)) AS entry_id, text, conv_id, turn FROM conversations WHERE role = 'user' AND text IS NOT NULL),
n AS (SELECT entry_id, conv_id AS source FROM e WHERE (conv_id + turn) % 2 = 0 QUALIFY row_number() OVER (PARTITION BY text ORDER BY conv_id * 1000 + turn DESC) = 1),
o AS (SELECT DISTINCT entry_id FROM e)
SELECT entry_id, 'new' AS answer, concat('src', source % 5) AS docs FROM n UNION ALL SELECT entry_id, 'old', '' FROM o WHERE entry_id NOT IN (SELECT entry_id FROM n)""")
def q_cache_put(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").filter("role = 'user' AND text IS NOT NULL")
    cited = F.array(F.struct(F.lit("corpus").alias("kind"), F.concat(F.lit("src"), (F.col("conv_id") % 5).cast("string")).alias("source_doc")))
    fresh = rows.filter("(conv_id + turn) % 2 = 0").select(F.lit("persistent").alias("corpus_scope"), F.col("text").alias("question"), F.lit("new").alias("answer"), cache.citations_from(cache.citations_json(cited)).alias("citations"), (F.col("conv_id") * 1000 + F.col("turn")).alias("seq"))
    none = F.filter(cited, lambda x: F.lit(False))
    held = cache.entries(rows.select(F.lit("persistent").alias("corpus_scope"), F.col("text").alias("question"), F.lit("old").alias("answer"), none.alias("citations")).distinct())
    return cache.put(held, fresh).select("entry_id", "answer", F.array_join("cited_docs", ",").alias("docs"))


# ---- extraction

_IMAGES = "im AS (SELECT l_orderkey AS source_doc, l_linenumber % 3 AS page, l_quantity::DOUBLE AS x0, l_discount::DOUBLE * 100 AS y0, l_quantity::DOUBLE + l_tax::DOUBLE * 500 AS x1, l_discount::DOUBLE * 100 + 20 AS y1 FROM lineitem)"


@query(f"WITH {_IMAGES}, c AS (SELECT source_doc, page, sum(abs((x1 - x0) * (y1 - y0))) AS covered FROM im GROUP BY ALL), p AS (SELECT o_orderkey AS source_doc, g AS page, (o_orderkey % 40)::DOUBLE AS w FROM orders, (SELECT unnest([0, 1, 2]) AS g)) SELECT source_doc, page, round(CASE WHEN w = 0 THEN 0 ELSE least(coalesce(covered, 0) / abs(w * 50), 1) END, 6)::DOUBLE AS image_coverage FROM p LEFT JOIN c USING (source_doc, page)")
def q_page_coverage(spark: SparkSession, sf: str) -> DataFrame:
    d = lambda c: F.col(c).cast("double")
    images = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("source_doc"), (F.col("l_linenumber") % 3).alias("page"), d("l_quantity").alias("x0"), (d("l_discount") * 100).alias("y0"), (d("l_quantity") + d("l_tax") * 500).alias("x1"), (d("l_discount") * 100 + 20).alias("y1"))
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("source_doc"), (F.col("o_orderkey") % 40).cast("double").alias("width"), F.lit(50.0).alias("height"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("page"))
    return extraction.page_coverage(images, pages).withColumn("image_coverage", F.round("image_coverage", 6))


@query(f"WITH {_PAGES}, r AS (SELECT source_doc, page, text_chars < 50 AND cov >= 0.5 AS scan, text_chars < 50 AS empty, (source_doc + page) % 3 = 0 AS planned FROM pg) SELECT source_doc, page, scan AS to_ocr, NOT scan AND planned AS to_vision, NOT scan AND NOT (planned AND empty) AS keeps_text FROM r")
def q_route_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf).select("source_doc", "page", F.repeat(F.lit("x"), F.col("text_chars")).alias("text"), "image_coverage")
    plan = pages.filter((F.col("source_doc") + F.col("page")) % 3 == 0)
    return extraction.route_pages(pages, plan).select("source_doc", "page", "to_ocr", "to_vision", "keeps_text")


_REPLIES = r"""rp AS (SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN concat('content_type: Table', chr(10), text) WHEN 1 THEN 'CONTENT_TYPE: chart' WHEN 2 THEN NULL WHEN 3 THEN 'short' WHEN 4 THEN text WHEN 5 THEN concat('A Bar Chart of ', text) ELSE concat('| a | b |', chr(10), '| c | d |', chr(10), text) END AS reply FROM documents WHERE text IS NOT NULL),
tg AS (SELECT doc_id, coalesce(reply, '') AS raw, lower(regexp_extract(substr(coalesce(reply, ''), 1, 120), '(?i)CONTENT_TYPE:\s*(table|chart|figure)\s*\n?', 1)) AS kind FROM rp),
bd AS (SELECT doc_id, raw, kind, regexp_replace(CASE WHEN kind = '' THEN raw ELSE regexp_replace(raw, '(?s)^.*?(?i)CONTENT_TYPE:\s*(table|chart|figure)\s*\n?', '') END, '^\s+|\s+$', '', 'g') AS body FROM tg),
pb AS (SELECT *, CASE WHEN regexp_replace(raw, '^\s+|\s+$', '', 'g') = '' THEN 'empty response' WHEN length(body) < 12 AND kind <> '' THEN 'tag without transcription' WHEN length(body) < 12 THEN 'too short' END AS problem,
 CASE WHEN kind <> '' THEN CASE kind WHEN 'figure' THEN 'image_caption' ELSE kind END WHEN len(list_filter(regexp_split_to_array(body, '\r\n|[\r\n]'), lambda x: length(x) - length(replace(x, '|', '')) >= 2)) >= 2 THEN 'table'
 WHEN len(list_filter(['chart type', 'x-axis', 'y-axis', 'x axis', 'y axis', 'axis label', 'data point', 'bar chart', 'line chart', 'scatter plot', 'pie chart'], lambda w: contains(lower(body), w))) > 0 THEN 'chart' ELSE 'image_caption' END AS found FROM bd)"""


def _vision_replies(spark: SparkSession, sf: str) -> DataFrame:
    k, t = F.col("doc_id") % 7, F.col("text")
    reply = F.when(k == 0, F.concat(F.lit("content_type: Table\n"), t)).when(k == 1, "CONTENT_TYPE: chart").when(k == 2, F.lit(None).cast("string")).when(k == 3, "short").when(k == 4, t).when(k == 5, F.concat(F.lit("A Bar Chart of "), t)).otherwise(F.concat(F.lit("| a | b |\n| c | d |\n"), t))
    return table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", "source", reply.alias("reply"))


@query(f"WITH {_REPLIES} SELECT doc_id, CASE WHEN problem IS NULL THEN found END AS chunk_type, CASE WHEN problem IS NULL THEN length(body) END AS chars, problem FROM pb")
def q_vision_reply(spark: SparkSession, sf: str) -> DataFrame:
    rows = _vision_replies(spark, sf).select("doc_id", extraction.parse_vision_reply(F.col("reply")).alias("v"))
    return rows.select("doc_id", "v.chunk_type", F.length("v.body").alias("chars"), "v.problem")


@query(f"WITH {_REPLIES} SELECT doc_id AS page, CASE WHEN problem IS NULL THEN found WHEN doc_id % 2 = 0 THEN 'text' END AS chunk_type, CASE WHEN problem IS NULL THEN 'vision' WHEN doc_id % 2 = 0 THEN 'ocr' END AS extraction_method, CASE WHEN problem IS NOT NULL AND doc_id % 2 <> 0 THEN concat('vision and OCR both unavailable: ', problem) END AS error FROM pb WHERE problem IS NULL OR doc_id % 2 = 0 OR doc_id % 3 <> 0")
def q_vision_or_ocr(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    units = _vision_replies(spark, sf).select(F.col("source").alias("source_doc"), d.alias("page"), F.lit(None).cast("string").alias("location"), "reply", F.when(d % 2 == 0, "read by OCR").alias("ocr_text"), (d % 3 == 0).alias("skip_failures"))
    return extraction.vision_pieces(units).select("page", "chunk_type", "extraction_method", "error")


@query(f"""WITH {_PAGES}, r AS (SELECT *, (source_doc + page) % 3 = 0 AS planned, text_chars < 50 AND cov >= 0.5 AS scan FROM pg),
p AS (SELECT source_doc, page, 'text' AS extraction_method FROM r WHERE NOT scan AND NOT (planned AND text_chars < 50) AND text_chars > 0 UNION ALL SELECT source_doc, page, CASE WHEN scan THEN 'ocr' ELSE 'vision' END FROM r WHERE (scan OR planned) AND page % 2 = 1)
SELECT source_doc, page, extraction_method, row_number() OVER (PARTITION BY source_doc ORDER BY page, extraction_method <> 'text', extraction_method) - 1 AS order_in_doc FROM p""")
def q_assemble_pages(spark: SparkSession, sf: str) -> DataFrame:
    pages = _pages(spark, sf).select("source_doc", "page", F.repeat(F.lit("x"), F.col("text_chars")).alias("text"), "image_coverage")
    routed = extraction.route_pages(pages, pages.filter((F.col("source_doc") + F.col("page")) % 3 == 0))
    pieces = routed.filter("to_ocr OR to_vision").select("source_doc", "page", F.when(F.col("page") % 2 == 1, "seen").otherwise(" ").alias("text"), F.lit("text").alias("chunk_type"), F.when(F.col("to_ocr"), "ocr").otherwise("vision").alias("extraction_method"))
    return extraction.assemble_pages(routed, pieces).select("source_doc", "page", "extraction_method", "order_in_doc")


@query("""WITH k AS (SELECT doc_id, encode(text) AS c, doc_id IN (SELECT doc_id FROM labels) AS known FROM documents WHERE text IS NOT NULL), m AS (SELECT DISTINCT c FROM k WHERE known)
SELECT doc_id, CASE WHEN c IN (SELECT c FROM m) THEN 'kept' WHEN octet_length(c) % 5 = 0 THEN NULL ELSE octet_length(c)::VARCHAR END AS value FROM k""")
def q_memo_write(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.col("text").cast("binary").alias("content"))
    memo = docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi").select(extraction.memo_key("m1", F.col("content")).alias("key"), F.lit("kept").alias("value")).distinct()
    return extraction.memoised(docs, memo, _size_unless_five, "m1")[0].select("doc_id", "value")


def _size_unless_five(content: bytes) -> str | None:
    return str(len(content)) if len(content) % 5 else None


@query("""WITH e AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'vision' ELSE 'ocr' END AS kind, event_id % 7 = 0 AS failed, event_id % 5 = 0 AS retried, round(value, 3)::DOUBLE AS s FROM events)
SELECT count(*) FILTER (kind = 'vision') AS vision_calls, count(*) FILTER (kind = 'vision' AND failed) AS vision_failures, count(*) FILTER (retried) AS transient_retries, count(*) FILTER (kind = 'ocr') AS ocr_calls, round(sum(s) FILTER (kind = 'ocr'), 1) AS ocr_seconds, round(median(s) FILTER (kind = 'ocr'), 1) AS ocr_median, round(max(s) FILTER (kind = 'ocr'), 1) AS ocr_longest FROM e""")
def q_failure_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.when(F.col("user_id") % 2 == 0, "vision").otherwise("ocr").alias("kind"), (F.col("event_id") % 7 == 0).alias("failed"), (F.col("event_id") % 5 == 0).alias("retried"), F.round("value", 3).alias("seconds"))
    return extraction.failure_counts(rows)


# ---- sessions


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'issued' WHEN 1 THEN 'safe' ELSE 'refused' END AS kind FROM documents")
def q_session_ids(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.when(d % 4 == 0, F.md5(F.coalesce("text", F.lit("")))).when(d % 4 == 1, F.concat(F.lit("user_"), d.cast("string"))).when(d % 4 == 2, F.concat(F.lit("../"), d.cast("string"))).otherwise(F.repeat(F.lit("x"), F.lit(65)))
    return table(spark, sf, "documents").select("doc_id", sessions.id_kind(name).alias("kind"))


_HELD = "h AS (SELECT DISTINCT concat('session:', doc_id % 9) AS s, source AS d FROM documents WHERE doc_id % 4 = 0 AND doc_id % 9 < 7 AND source IS NOT NULL)"


def _session_passages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").filter("doc_id % 4 = 0 AND doc_id % 9 < 7 AND source IS NOT NULL").select("doc_id", F.concat(F.lit("session:"), (F.col("doc_id") % 9).cast("string")).alias("corpus_scope"), F.col("source").alias("source_doc"))


@query(f"""WITH {_HELD}, i AS (SELECT concat('session:', item_id % 9) AS s, concat('src', item_id % 25) AS d FROM benchmark GROUP BY ALL),
u AS (SELECT s, count(*) AS n FROM (SELECT s, d FROM h UNION SELECT s, d FROM i) GROUP BY s)
SELECT i.s AS corpus_scope, (SELECT count(*) FROM h WHERE h.s = i.s)::INT AS n_held, (count(*) FILTER (NOT EXISTS (SELECT 1 FROM h WHERE h.s = i.s AND h.d = i.d)))::INT AS n_new, any_value(u.n) <= 20 AS admitted FROM i JOIN u USING (s) GROUP BY i.s""")
def q_session_admit(spark: SparkSession, sf: str) -> DataFrame:
    uploads = table(spark, sf, "benchmark").select(F.concat(F.lit("session:"), (F.col("item_id") % 9).cast("string")).alias("corpus_scope"), F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string")).alias("source_doc"))
    return sessions.admit(uploads, _session_passages(spark, sf), 20)


@query(f"WITH {_HELD} SELECT item_id, concat('session:', item_id % 9) AS corpus_scope, concat('src', item_id % 25) AS source_doc FROM benchmark WHERE EXISTS (SELECT 1 FROM h WHERE s = concat('session:', item_id % 9) AND d = concat('src', item_id % 25))")
def q_session_holds(spark: SparkSession, sf: str) -> DataFrame:
    asked = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("session:"), (F.col("item_id") % 9).cast("string")).alias("corpus_scope"), F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string")).alias("source_doc"))
    return sessions.holds(asked, _session_passages(spark, sf)).select("item_id", "corpus_scope", "source_doc")


@query(f"WITH {_HELD} SELECT 'passages' AS part, count(*) AS n FROM documents WHERE doc_id % 4 = 0 AND doc_id % 9 < 7 AND source IS NOT NULL AND doc_id % 9 <> 4 UNION ALL SELECT 'turns', count(*) FROM conversations WHERE conv_id % 9 <> 4")
def q_session_drop(spark: SparkSession, sf: str) -> DataFrame:
    own = _session_passages(spark, sf)
    turns = table(spark, sf, "conversations").withColumn("session_id", (F.col("conv_id") % 9).cast("string"))
    passages, _, left = sessions.drop_session(own, own, turns, "4")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return count(passages, "passages").unionByName(count(left, "turns"))


@query("""WITH t AS (SELECT user_id AS session_id, event_id AS turn, epoch_us(ts) / 1e6 AS sec FROM events), u AS (SELECT session_id, max(sec) AS last_used FROM t GROUP BY ALL), n AS (SELECT max(sec) AS now FROM t),
live AS (SELECT session_id FROM u, n WHERE now - last_used < 14400 ORDER BY last_used DESC, session_id LIMIT 25)
SELECT session_id, turn FROM t WHERE session_id IN (SELECT session_id FROM live) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY sec DESC, turn DESC) <= 3""")
def q_history_record(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    return sessions.record_turn(rows.filter("turn % 2 = 0"), rows.filter("turn % 2 = 1"), 3, 25, 14_400).select("session_id", "turn")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 5 = 1 THEN 'left' WHEN n_chars >= 1000 THEN 'left' ELSE 'removed' END AS fate FROM documents")
def q_session_purge(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 5
    name = F.when(k == 0, F.concat(F.lit(".deleted-"), d)).when(k == 1, F.concat(F.lit("not ours "), d)).otherwise(F.concat(F.lit("s"), d))
    rows = table(spark, sf, "documents").select(name.alias("name"), F.col("n_chars").cast("double").alias("updated_at"))
    out = sessions.purge(rows, 1_500.0, 500.0)
    return out.select(F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("doc_id"), "fate")


@query("SELECT user_id, event_id AS chat_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 5")
def q_recent_chats(spark: SparkSession, sf: str) -> DataFrame:
    return sessions.recent_chats(table(spark, sf, "events").select("user_id", F.col("event_id").alias("chat_id"), F.col("ts").alias("updated_at")), 5).select("user_id", "chat_id")


# ---- web


@query(f"""WITH {_BM25}, e AS (SELECT item_id AS qid, row_number() OVER (PARTITION BY item_id ORDER BY rank) AS n, concat('[', concat_ws(' / ', nullif(source, ''), CASE WHEN doc_id % 2 = 0 THEN 'Part' END), '] ', substr({_collapse("text")}, 1, 300)) AS line FROM kw JOIN documents USING (doc_id) WHERE doc_id % 4 <> 0 AND text IS NOT NULL QUALIFY n <= 3)
SELECT qid, sha256(string_agg(line, chr(10) ORDER BY n)) AS digest FROM e GROUP BY qid""")
def q_web_excerpts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_text(spark, sf).filter("text IS NOT NULL").withColumn("source", F.when(F.col("chunk_id") % 4 == 0, "web").otherwise("corpus")).withColumn("location", F.when(F.col("chunk_id") % 2 == 0, "Part").otherwise(""))
    return web.excerpts(rows).select("qid", F.sha2("excerpts", 256).alias("digest"))


@query("""WITH q AS (SELECT item_id AS qid, substr(text, 1, 400) AS plain, item_id % 4 AS k FROM benchmark)
SELECT qid, CASE WHEN k = 0 THEN 'a better query' ELSE plain END AS query, k = 0 AS contextual FROM q""")
def q_web_query(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("item_id") % 4
    rewritten = F.when(k == 0, ' "a  better query"\n').when(k == 1, "ignored").when(k == 2, " ' ")
    found = web.web_query(F.col("text"), rewritten, F.when(k != 1, "some"))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), found.alias("w")).select("qid", "w.query", "w.contextual")


_WEB = f"""r AS (SELECT a.vec_id % 10 AS qid, a.vec_id AS position, a.vec_id % 3 <> 0 AS rewritten, CASE WHEN a.vec_id % 7 <> 0 THEN round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) END AS relevance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id % 10)"""


def _web_results(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    asked = vectors.filter("vec_id < 10").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector"))
    rows = vectors.select((F.col("vec_id") % 10).alias("qid"), F.col("vec_id").alias("position"), (F.col("vec_id") % 3 != 0).alias("rewritten"), F.when(F.col("vec_id") % 7 != 0, F.col("embedding")).alias("vector"))
    return web.score_relevance(rows.join(F.broadcast(asked), "qid"))  # ten vectors


@query(f"WITH {_WEB} SELECT qid, position, relevance FROM r WHERE NOT rewritten OR relevance IS NULL OR relevance >= 0.30")
def q_web_relevance(spark: SparkSession, sf: str) -> DataFrame:
    return web.relevant(_web_results(spark, sf)).select("qid", "position", "relevance")


@query(f"""WITH {_WEB}, k AS (SELECT qid, count(*) AS seen, count(*) FILTER (NOT rewritten OR relevance IS NULL OR relevance >= 0.30) AS usable FROM r GROUP BY qid)
SELECT qid, CASE WHEN qid < 5 THEN 'failed' ELSE 'ok' END AS status, CASE qid WHEN 0 THEN 'all_keys_blocked' WHEN 1 THEN 'timeout' WHEN 2 THEN 'quota' WHEN 3 THEN 'http_error' WHEN 4 THEN 'unexpected' END AS failure, CASE WHEN qid < 5 THEN 0 ELSE usable END AS usable, CASE WHEN qid < 5 THEN 0 ELSE seen - usable END AS dropped FROM k""")
def q_web_outcome(spark: SparkSession, sf: str) -> DataFrame:
    errors = ["AllKeysBlocked: none left", "SearchTimeout: after 20 s", "ForbiddenError: plan limit reached", "ForbiddenError: 403", "KeyError: 'results'"]
    results = _web_results(spark, sf)
    searches = results.select("qid").distinct().withColumn("error", F.get(F.array(*map(F.lit, errors)), F.col("qid").cast("int")))
    return web.outcome(results, searches)


# ---- ledger


@query(f"""WITH {_CALLS}, p AS (SELECT *, CASE model WHEN 'model0' THEN (prompt_tokens * 1.5 + output_tokens * 9.0) / 1e6 WHEN 'model1' THEN (prompt_tokens * 0.3 + output_tokens * 2.5) / 1e6 WHEN 'model2' THEN 0.008 END AS usd FROM c)
SELECT stage, array_to_string(list_sort(list_distinct(list(model))), ',') AS models, sum(prompt_tokens)::BIGINT AS prompt, sum(output_tokens)::BIGINT AS output, count(*) AS calls, round(sum(coalesce(usd, 0)), 6) AS cost, bool_or(usd IS NULL) AS unpriced FROM p GROUP BY stage""")
def q_usage_panel(spark: SparkSession, sf: str) -> DataFrame:
    prices = spark.createDataFrame([("model0", 1.5, 9.0, None), ("model1", 0.3, 2.5, None), ("model2", None, None, 0.008)], "model string, input double, output double, per_call double")
    return ledger.usage_panel(_calls(spark, sf), F.broadcast(prices)).withColumn("models", F.array_join("models", ","))


@query("SELECT event_id, coalesce((props->>'$.k')::BIGINT, 0) + CASE WHEN event_id % 3 = 0 THEN 7 ELSE 0 END AS billed FROM events")
def q_billed_tokens(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events")
    return rows.select("event_id", T.billed_tokens(F.get_json_object("props", "$.k").cast("long"), F.when(F.col("event_id") % 3 == 0, F.lit(7))).alias("billed"))


@query("SELECT doc_id, ['daily_quota', 'rate_limit', 'overload', 'overload', 'other', 'rate_limit'][doc_id % 6 + 1] AS kind FROM documents")
def q_error_kinds(spark: SparkSession, sf: str) -> DataFrame:
    says = ["429 GenerateRequestsPerDay exceeded", "HTTP 429: slow down", "503 Service Unavailable", "model is OVERLOADED", "400 bad request", "RESOURCE_EXHAUSTED"]
    return table(spark, sf, "documents").select("doc_id", T.error_kind(F.element_at(F.array(*map(F.lit, says)), (F.col("doc_id") % 6 + 1).cast("int"))).alias("kind"))


@query("SELECT doc_id, [90.0, 0.25, 12.5, 60.0][doc_id % 4 + 1]::DOUBLE AS wait FROM documents")
def q_reset_seconds(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("doc_id") % 4
    wait = T.reset_seconds(F.when(k == 0, "1m30s"), F.when(k == 1, "250ms").when(k == 3, "soon"), F.when(k == 2, "12.5"))
    return table(spark, sf, "documents").select("doc_id", wait.alias("wait"))


@query("SELECT event_id, event_type AS event, props AS data FROM events")
def q_sse_frames(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", T.sse_parts(T.sse_frame(F.col("event_type"), F.col("props"))).alias("p"))
    return rows.select("event_id", "p.event", "p.data")


@query(f"WITH h AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) <= 3) SELECT query_id, min(score) AS third, max(score) AS best FROM h GROUP BY query_id")
def q_dense_spread(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return saved(dense.cosine_top_k(vectors, asked, 3), "near").groupBy("query_id").agg(F.min("score").alias("third"), F.max("score").alias("best"))
