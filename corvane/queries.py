"""The engine's registered queries over the driver's tables, and the SQL that checks them.

Pairings that carry no meaning, such as documents with vectors of the same
number or ship lines as page measurements, only give the operators input of
the right shape; every query reads its tables whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import bm25, cache, chunking, citations, context, dense, fusion, guardrails, ledger, runs, segments, state, store, sufficiency, vision, web
from corvane.operators import vectors as vectors_index
from corvane.sources.tables import file_system, kept, saved, table_root
from corvane.sources.versions import VersionedTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL fragments


def _tok(t: str) -> str:
    return rf"list_filter(regexp_split_to_array(regexp_replace(lower(coalesce({t}, '')), '[!-/:-@\[-`{{-~]', '', 'g'), '\s+'), lambda x: x <> '')"


def _collapse(t: str) -> str:
    return rf"trim(regexp_replace({t}, '\s+', ' ', 'g'))"


def _words(t: str) -> str:
    return rf"list_filter(regexp_split_to_array({t}, '\s+'), lambda x: x <> '')"


def _wset(t: str) -> str:
    return f"list_sort(list_distinct(regexp_extract_all(lower({t}), '[A-Za-z0-9_À-ÿ]+')))"


def _numbers(t: str) -> str:
    return rf"list_sort(list_transform(regexp_extract_all({t}, '\d+(?:[.,]\d+)*'), lambda x: replace(x, ',', '')))"


def _strip(t: str) -> str:
    return _collapse(rf"regexp_replace({t}, '\[\s*(\d+(?:\s*[,;]\s*\d+)*)\s*\]', ' ', 'g')")


_BM25 = f"""
toks AS MATERIALIZED (SELECT doc_id, len(tk) AS dl, tk FROM (SELECT doc_id, {_tok("text")} AS tk FROM documents)),
post AS MATERIALIZED (SELECT doc_id, dl, token, count(*) AS tf FROM (SELECT doc_id, dl, unnest(tk) AS token FROM toks) GROUP BY ALL),
st AS (SELECT count(*) AS n_docs, avg(dl) AS avgdl FROM toks),
raw AS MATERIALIZED (SELECT token, count(*) AS df, ln(any_value(n_docs) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, st GROUP BY token),
idf AS MATERIALIZED (SELECT token, df, CASE WHEN r.raw < 0 THEN 0.25 * m.mean ELSE r.raw END AS idf FROM raw r, (SELECT avg(raw) AS mean FROM raw) m),
asked AS (SELECT item_id, token, count(*) AS times FROM (SELECT item_id, unnest({_tok("text")}) AS token FROM benchmark) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 5) AS score
       FROM post JOIN idf USING (token) JOIN asked USING (token), st GROUP BY ALL),
kw AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc QUALIFY rank <= 20)"""
_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_DENSE = f"""
asked_v AS (SELECT item_id, embedding FROM benchmark JOIN embeddings ON vec_id = item_id),
dn AS (SELECT item_id, vec_id AS doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, vec_id) AS rank
       FROM (SELECT a.item_id, b.vec_id, {_COS} AS score FROM asked_v a, embeddings b) QUALIFY rank <= 20)"""


def _fused(weight: str) -> str:
    return f"""
parts AS (SELECT item_id AS qid, doc_id AS chunk_id, 'keyword' AS retriever, rank, score, (1 - {weight}) / (60 + rank) AS part FROM kw
          UNION ALL SELECT item_id, doc_id, 'vector', rank, score, {weight} / (60 + rank) FROM dn),
fused AS (SELECT qid, chunk_id, round(sum(part), 9) AS fused FROM parts GROUP BY ALL HAVING round(sum(part), 9) > 0),
ordered AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY fused DESC, chunk_id) AS position FROM fused)"""


# ---- shared inputs


def _index(spark: SparkSession, sf: str) -> bm25.Index:
    """The keyword index of the documents, written by the first query of an application that needs it."""
    return kept(table(spark, sf, "documents"), "bm25", lambda docs: bm25.build(docs, carry=("lang",)))


def _keyword_hits(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    """Written, as it is small and queries name it more than once: k rows a question."""
    return saved(bm25.search(_index(spark, sf), table(spark, sf, "benchmark"), k), "keyword-hits")


def _question_vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return table(spark, sf, "benchmark").join(vectors, F.col("item_id") == F.col("vec_id")).select("item_id", F.col("embedding").alias("query_vector"))


def _dense_hits(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    return dense.cosine_top_k(table(spark, sf, "embeddings"), _question_vectors(spark, sf), k, query_key="item_id")


def _hits(spark: SparkSession, sf: str) -> DataFrame:
    """The long table of both channels: qid, retriever, query, chunk_id, score."""
    kw = _keyword_hits(spark, sf).select(F.col("item_id").alias("qid"), F.lit("keyword").alias("retriever"), F.lit("main").alias("query"), F.col("doc_id").alias("chunk_id"), "score")
    dn = _dense_hits(spark, sf).select(F.col("item_id").alias("qid"), F.lit("vector").alias("retriever"), F.lit("main").alias("query"), F.col("vec_id").alias("chunk_id"), "score")
    return kw.unionByName(dn)


# ---- text and keyword retrieval


@query(f"SELECT doc_id, len(tk) AS n_tokens, len(list_distinct(tk)) AS n_distinct FROM (SELECT doc_id, {_tok('text')} AS tk FROM documents)")
def q_tokenize_stats(spark: SparkSession, sf: str) -> DataFrame:
    tokens = T.tokenize(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.size(tokens).alias("n_tokens"), F.size(F.array_distinct(tokens)).alias("n_distinct"))


@query(f"WITH {_BM25} SELECT token, df, round(idf, 6) AS idf FROM idf")
def q_bm25_df_idf(spark: SparkSession, sf: str) -> DataFrame:
    return _index(spark, sf).terms.select("token", "df", F.round("idf", 6).alias("idf"))


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM kw")
def q_bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _keyword_hits(spark, sf).select("item_id", "doc_id", "score", "rank")


@query(f"WITH {_BM25} SELECT item_id, lang, doc_id, score, row_number() OVER (PARTITION BY item_id, lang ORDER BY score DESC, doc_id) AS rank FROM sc JOIN documents USING (doc_id) QUALIFY rank <= 5")
def q_bm25_scoped(spark: SparkSession, sf: str) -> DataFrame:
    return bm25.search(_index(spark, sf), table(spark, sf, "benchmark"), 5, scope="lang").select("item_id", "lang", "doc_id", "score", "rank")


def _segmented(spark: SparkSession, sf: str) -> segments.SegmentedIndex:
    """All documents in three batches, those of one with other texts first, which a later batch replaces."""
    docs, root = table(spark, sf, "documents"), f"{table_root(spark)}/tables/segments-{uuid.uuid4().hex}"
    store = VersionedTable(spark, root)
    store.system.deleteOnExit(file_system(spark, root)[1])
    batch = lambda n: docs.filter(F.pmod("doc_id", F.lit(3)) == n)
    stale = batch(1).withColumn("text", F.reverse("text"))
    index = segments.SegmentedIndex(store, segments.SegmentConfig(fan=2)).add(batch(0)).add(stale).add(batch(2))
    return index.replace(stale, batch(1))


@query(f"WITH {_BM25} SELECT item_id, doc_id, score, rank FROM kw")
def q_bm25_segmented(spark: SparkSession, sf: str) -> DataFrame:
    """The pruned top-k over an index that was built batch by batch, with deletions and merges."""
    return _segmented(spark, sf).top_k(table(spark, sf, "benchmark"))


# ---- vectors


@query(f"SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 20")
def q_dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return dense.cosine_top_k(vectors, asked)


def _ivf(spark: SparkSession, sf: str) -> vectors_index.IvfIndex:
    root = f"{table_root(spark)}/tables/lists-{uuid.uuid4().hex}"
    system, at = file_system(spark, root)
    system.deleteOnExit(at)
    return vectors_index.build(table(spark, sf, "embeddings"), root)


@query(f"SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 20")
def q_ivf_all_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The approximate index with every list probed, which is exact."""
    index, vectors = _ivf(spark, sf), table(spark, sf, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return index.top_k(asked, probes=len(index.centroids))


@query()
def q_ivf_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The approximate index with as many probes as a recall of 0.9 takes on a sample; its recall is tested."""
    index, vectors = _ivf(spark, sf), table(spark, sf, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return index.top_k(asked, probes=vectors_index.probes_for(index, vectors))


@query(f"SELECT a.vec_id AS query_id, b.label, b.vec_id, {_COS} AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b USING (label) WHERE a.vec_id % 20 = 0 QUALIFY rank <= 10")
def q_dense_scoped(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    asked = vectors.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), F.col("label").alias("wanted"))
    return dense.cosine_top_k(vectors, asked.withColumnRenamed("wanted", "label"), 10, scope="label").join(asked.select("query_id", F.col("wanted").alias("label")), "query_id")


@query(f"""
WITH h AS (SELECT a.vec_id AS query_id, b.label, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 QUALIFY rank <= 20)
SELECT query_id, label, votes FROM (SELECT query_id, label, count(*) AS votes FROM h GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY votes DESC, label) = 1""")
def q_dense_label_vote(spark: SparkSession, sf: str) -> DataFrame:
    return dense.label_vote(q_dense_topk(spark, sf), table(spark, sf, "embeddings").select("vec_id", "label"))


# ---- fusion and sufficiency


@query(f"WITH {_BM25}, {_DENSE}, {_fused('0.5')} SELECT qid, chunk_id, fused, position FROM ordered")
def q_rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(_hits(spark, sf)).select("qid", "chunk_id", "fused", "position")


@query(f"""WITH {_BM25}, {_DENSE}, w AS (SELECT unnest([0.0, 0.25, 0.5, 0.75, 1.0]) AS dense_weight),
parts AS (SELECT dense_weight, item_id AS qid, doc_id AS chunk_id, (1 - dense_weight) / (60 + rank) AS part FROM kw, w UNION ALL SELECT dense_weight, item_id, doc_id, dense_weight / (60 + rank) FROM dn, w),
f AS (SELECT dense_weight::DOUBLE AS dense_weight, qid, chunk_id, round(sum(part), 9)::DOUBLE AS fused FROM parts GROUP BY ALL HAVING round(sum(part), 9) > 0)
SELECT *, row_number() OVER (PARTITION BY dense_weight, qid ORDER BY fused DESC, chunk_id) AS position FROM f QUALIFY position <= 10""")
def q_rrf_weight_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.sweep(_hits(spark, sf), (0.0, 0.25, 0.5, 0.75, 1.0)).filter("position <= 10").select("dense_weight", "qid", "chunk_id", "fused", "position")


@query(f"WITH {_BM25}, {_DENSE}, {_fused('0.5')} SELECT o.qid, o.chunk_id, o.position, p.retriever, p.rank, p.score FROM ordered o JOIN parts p USING (qid, chunk_id)")
def q_rrf_provenance(spark: SparkSession, sf: str) -> DataFrame:
    out = fusion.fuse(_hits(spark, sf)).select("qid", "chunk_id", "position", F.explode("provenance").alias("p"))
    return out.select("qid", "chunk_id", "position", "p.retriever", "p.rank", "p.score")


_SUFF = f"""WITH {_BM25}, {_DENSE}, h AS (SELECT item_id AS qid, doc_id, 'keyword' AS r, score FROM kw UNION ALL SELECT item_id, doc_id, 'vector', score FROM dn),
c AS (SELECT qid, doc_id, max(CASE WHEN r = 'vector' THEN score END) AS d, max(CASE WHEN r = 'keyword' THEN score END) AS k FROM h GROUP BY ALL),
s AS (SELECT qid, max(d) AS top_dense, round(list_avg(list_slice(list_reverse_sort(list(d) FILTER (d IS NOT NULL)), 1, 3)), 6) AS mean_top3_dense, max(k) AS top_keyword, count(*) AS candidates FROM c GROUP BY qid)"""


@query(_SUFF + " SELECT * FROM s")
def q_sufficiency_scores(spark: SparkSession, sf: str) -> DataFrame:
    return sufficiency.compute_scores(_hits(spark, sf)).select("qid", "top_dense", F.round("mean_top3_dense", 6).alias("mean_top3_dense"), "top_keyword", "candidates")


@query(_SUFF + """ SELECT qid, top_dense >= 0.9 OR (coalesce(top_dense, 0.8) >= 0.78 OR qid % 5 = 0) AND coalesce(top_dense < 0.9, true) AND qid % 3 = 0 AS sufficient,
 NOT coalesce(top_dense >= 0.9, false) AND (coalesce(top_dense, 0.8) >= 0.78 OR qid % 5 = 0) AND qid % 3 = 1 AS partial,
 CASE WHEN top_dense >= 0.9 OR (top_dense < 0.78 AND qid % 5 <> 0) THEN 'score' WHEN qid % 3 < 2 THEN 'llm' ELSE 'fallback' END AS method FROM s""")
def q_sufficiency_gate(spark: SparkSession, sf: str) -> DataFrame:
    verdict = F.when(F.col("qid") % 3 == 0, "sufficient").when(F.col("qid") % 3 == 1, "partial")
    out = sufficiency.decide(sufficiency.compute_scores(_hits(spark, sf)), session=F.col("qid") % 5 == 0, verdict=verdict)
    return out.select("qid", "sufficient", "partial", "method")


# ---- context


def _with_text(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword candidates with their texts: qid, chunk_id, position, text."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", F.col("source").alias("source_doc"))
    return _keyword_hits(spark, sf).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("chunk_id"), F.col("rank").alias("position")).join(docs, "chunk_id")


@query(f"""WITH {_BM25}, c AS (SELECT item_id AS qid, doc_id AS chunk_id, rank AS position, CASE WHEN doc_id % 4 = 0 THEN 'web' ELSE 'corpus' END AS source FROM kw),
n AS (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY position, chunk_id) AS n FROM c QUALIFY source <> 'web' OR n <= 5)
SELECT qid, chunk_id, source, row_number() OVER (PARTITION BY qid ORDER BY source <> 'web', n) AS pool_position FROM n QUALIFY pool_position <= 20""")
def q_rerank_pool(spark: SparkSession, sf: str) -> DataFrame:
    rows = _keyword_hits(spark, sf).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("chunk_id"), F.col("rank").alias("position"), F.when(F.col("doc_id") % 4 == 0, "web").otherwise("corpus").alias("source"))
    return context.rerank_pool(rows).select("qid", "chunk_id", "source", "pool_position")


@query(f"""WITH RECURSIVE {_BM25}, it AS (SELECT item_id AS qid, doc_id, rank AS pos, len({_words("coalesce(text, '')")}) AS tokens, {_wset("coalesce(text, '')")} AS w FROM kw JOIN documents USING (doc_id)),
fold AS (SELECT DISTINCT qid, 0 AS pos, []::BIGINT[] AS ids, []::BIGINT[] AS sizes, []::VARCHAR[][] AS sets, 0::BIGINT AS used FROM it
 UNION ALL SELECT qid, pos, CASE WHEN take THEN list_append(ids, doc_id) ELSE ids END, CASE WHEN take THEN list_append(sizes, tokens) ELSE sizes END, CASE WHEN take THEN list_append(sets, w) ELSE sets END, CASE WHEN take THEN used + tokens ELSE used END
 FROM (SELECT s.qid, i.pos, s.ids, s.sizes, s.sets, s.used, i.doc_id, i.tokens, i.w, len(s.ids) < 8 AND s.used + i.tokens <= 3000 AND len(list_filter(s.sets, lambda k: len(list_distinct(list_concat(k, i.w))) > 0 AND len(list_intersect(k, i.w)) / greatest(len(list_distinct(list_concat(k, i.w))), 1) >= 0.9)) = 0 AS take
  FROM fold s JOIN it i ON i.qid = s.qid AND i.pos = s.pos + 1)),
e AS (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY qid ORDER BY pos DESC) = 1)
SELECT qid, generate_subscripts(ids, 1) AS passage, unnest(ids) AS chunk_id, unnest(sizes) AS tokens, used FROM e""")
def q_consolidate(spark: SparkSession, sf: str) -> DataFrame:
    return context.consolidate(_with_text(spark, sf).withColumn("text", F.coalesce("text", F.lit(""))))


@query(f"""WITH {_BM25}, c AS (SELECT item_id AS qid, doc_id, {_wset("text")} AS w FROM kw JOIN documents USING (doc_id))
SELECT a.qid, a.doc_id AS a, b.doc_id AS b FROM c a JOIN c b ON a.qid = b.qid AND a.doc_id < b.doc_id
WHERE len(list_distinct(list_concat(a.w, b.w))) > 0 AND len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) >= 0.9""")
def q_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    rows = _with_text(spark, sf).select("qid", "chunk_id", T.word_set(F.col("text")).alias("w"))
    other = rows.select("qid", F.col("chunk_id").alias("b"), F.col("w").alias("wb"))
    return rows.join(other, "qid").filter((F.col("chunk_id") < F.col("b")) & T.alike(F.col("w"), F.col("wb"), context.NEAR_DUPLICATE)).select("qid", F.col("chunk_id").alias("a"), "b")


@query(f"""WITH {_BM25}, {_DENSE}, r AS (SELECT item_id AS qid, doc_id AS chunk_id, 0 AS list_no, rank AS position, 'keyword' AS source FROM kw UNION ALL SELECT item_id, doc_id, 1, rank, 'vector' FROM dn)
SELECT qid, chunk_id, list_no, position, source FROM r QUALIFY row_number() OVER (PARTITION BY qid, chunk_id ORDER BY list_no, position) = 1""")
def q_context_union(spark: SparkSession, sf: str) -> DataFrame:
    main = _keyword_hits(spark, sf).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("chunk_id"), F.lit(0).alias("list_no"), F.col("rank").alias("position"), F.lit("keyword").alias("source"))
    more = _dense_hits(spark, sf).select(F.col("item_id").alias("qid"), F.col("vec_id").alias("chunk_id"), F.lit(1).alias("list_no"), F.col("rank").alias("position"), F.lit("vector").alias("source"))
    return context.union_contexts(main, more).select("qid", "chunk_id", "list_no", "position", "source")


@query(f"""WITH {_BM25}, {_DENSE}, r AS (SELECT item_id AS qid, doc_id AS chunk_id, 0 AS list_no, rank AS position FROM kw UNION ALL SELECT item_id, doc_id, 1, rank FROM dn),
f AS (SELECT qid, chunk_id, min(list_no * 1000 + position) AS seen FROM r GROUP BY ALL) SELECT qid, chunk_id, row_number() OVER (PARTITION BY qid ORDER BY seen, chunk_id) AS number FROM f""")
def q_passage_numbers(spark: SparkSession, sf: str) -> DataFrame:
    main = _keyword_hits(spark, sf).select(F.col("item_id").alias("qid"), F.col("doc_id").alias("chunk_id"), F.lit(0).alias("list_no"), F.col("rank").alias("position"))
    more = _dense_hits(spark, sf).select(F.col("item_id").alias("qid"), F.col("vec_id").alias("chunk_id"), F.lit(1).alias("list_no"), F.col("rank").alias("position"))
    return context.number_passages(main.unionByName(more)).select("qid", "chunk_id", "number")


# ---- passage table


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as passages: the source is the document, the language the extraction method."""
    page = F.when(F.col("doc_id") % 3 != 0, (F.col("doc_id") % 11).cast("int"))
    docs = table(spark, sf, "documents").withColumn("page", page)
    kind = F.when(F.col("doc_id") % 7 == 0, "table").otherwise("text")
    ids = T.chunk_id(F.lit("persistent"), F.col("source"), F.col("lang"), kind, F.col("page"), F.lit(None), F.col("doc_id"), F.coalesce("text", F.lit("")))
    return docs.select(ids.alias("chunk_id"), "doc_id", F.col("source").alias("source_doc"), F.col("lang").alias("extraction_method"), kind.alias("chunk_type"), "page", F.lit("persistent").alias("corpus_scope"), "n_chars", "text")


_CHUNKS = """c AS (SELECT *, source AS source_doc, lang AS extraction_method, CASE WHEN doc_id % 7 = 0 THEN 'table' ELSE 'text' END AS chunk_type, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 11)::INTEGER END AS page FROM documents)"""
_CHUNK_ID = "substr(sha256(concat('persistent', chr(31), coalesce(source, ''), chr(31), coalesce(lang, ''), chr(31), chunk_type, chr(31), coalesce(page::VARCHAR, ''), chr(31), '', chr(31), doc_id::VARCHAR, chr(31), sha256(coalesce(text, '')))), 1, 24)"


@query(f"WITH {_CHUNKS} SELECT doc_id, {_CHUNK_ID} AS chunk_id FROM c")
def q_chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("doc_id", "chunk_id")


@query("SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) = 1")
def q_dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"))
    return store.keep_first(rows, ["h"], ["doc_id"]).select("doc_id", "source")


@query("SELECT doc_id, CASE WHEN l.doc_id IS NULL THEN n_chars ELSE n_chars * 10 + l.quality END AS n_chars, CASE WHEN l.doc_id IS NULL THEN 'stored' ELSE 'incoming' END AS version FROM documents LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)")
def q_upsert_latest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    fresh = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    incoming = docs.join(fresh, "doc_id").select("doc_id", (F.col("n_chars") * 10 + F.col("quality")).alias("n_chars"), F.lit("incoming").alias("version"))
    return store.upsert(docs.withColumn("version", F.lit("stored")), incoming, "doc_id")


@query(f"WITH {_CHUNKS} SELECT doc_id, source_doc FROM c WHERE coalesce(source_doc <> 'src3', false)")
def q_delete_document(spark: SparkSession, sf: str) -> DataFrame:
    return store.delete_by_document(_chunks(spark, sf), "src3", "persistent").select("doc_id", "source_doc")


@query("""WITH good AS (SELECT source FROM documents GROUP BY source HAVING min(doc_id) % 2 = 0)
SELECT doc_id, source AS source_doc, 'stored' AS version FROM documents WHERE source NOT IN (SELECT source FROM good WHERE source IS NOT NULL) OR source IS NULL
UNION ALL SELECT doc_id, source, 'incoming' FROM documents WHERE source IN (SELECT source FROM good) AND n_chars > 100""")
def q_replace_on_reingest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("source_doc"), "n_chars")
    good = docs.groupBy("source_doc").agg(F.min("doc_id").alias("m")).filter("m % 2 = 0").filter("source_doc IS NOT NULL")
    incoming = docs.filter("n_chars > 100").withColumn("version", F.lit("incoming"))
    return store.replace_documents(docs.withColumn("version", F.lit("stored")), incoming, good).select("doc_id", "source_doc", "version")


@query(f"WITH {_CHUNKS} SELECT source_doc, count(*) AS chunk_count, nullif(count(DISTINCT page), 0) AS pages, array_to_string(list_sort(list_distinct(list(extraction_method))), ',') AS extraction_methods FROM c GROUP BY source_doc")
def q_document_summary(spark: SparkSession, sf: str) -> DataFrame:
    return store.documents(_chunks(spark, sf)).withColumn("extraction_methods", F.array_join("extraction_methods", ","))


@query(f"WITH {_CHUNKS} SELECT extraction_method, chunk_type, count(*) AS n, grouping(extraction_method, chunk_type) AS level FROM c GROUP BY GROUPING SETS ((extraction_method), (chunk_type), (extraction_method, chunk_type))")
def q_store_report(spark: SparkSession, sf: str) -> DataFrame:
    return store.report(_chunks(spark, sf))


@query("SELECT count(*) FILTER (lang = 'en') AS en, count(*) FILTER (lang = 'fr') AS fr, count(*) FILTER (lang = 'de') AS de, count(*) FILTER (lang = 'xx') AS xx FROM documents")
def q_method_counts(spark: SparkSession, sf: str) -> DataFrame:
    return store.method_counts(_chunks(spark, sf), ("en", "fr", "de", "xx"))


@query("SELECT DISTINCT sha256(text) AS key FROM documents WHERE text IS NOT NULL AND sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL)")
def q_memo_misses(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").filter("text IS NOT NULL").select("doc_id", F.sha2("text", 256).alias("key"))
    return store.misses(docs, docs.join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_semi"))


# ---- chunking


@query(f"""WITH w AS (SELECT doc_id, {_words("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT doc_id, w, unnest(CASE WHEN len(w) <= 400 THEN [0] ELSE range(0, (ceil((len(w) - 400) / 350.0) * 350 + 1)::BIGINT, 350) END) AS start FROM w)
SELECT doc_id, (start / 350)::BIGINT AS window_no, len(w[start + 1 : start + 400]) AS tokens, sha256(array_to_string(w[start + 1 : start + 400], ' ')) AS digest FROM s""")
def q_fixed_windows(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.fixed_windows(table(spark, sf, "documents")).select("doc_id", F.col("window").alias("window_no"), "tokens", F.sha2("text", 256).alias("digest"))


@query(rf"""WITH p AS (SELECT page_id, string_split(concat('T', regexp_replace(regexp_replace(html, '(?i)<h[1-6][^>]*>', concat(chr(1), 'H'), 'g'), '(?i)</h[1-6]>', concat(chr(1), 'T'), 'g')), chr(1)) AS parts FROM pages),
r AS (SELECT page_id, unnest(parts) AS raw, generate_subscripts(parts, 1) - 1 AS piece FROM p),
t AS (SELECT page_id, piece, raw[1] = 'H' AS head, {_collapse("regexp_replace(substr(raw, 2), '<[^>]*>', ' ', 'g')")} AS txt FROM r),
c AS (SELECT *, last_value(CASE WHEN head THEN txt END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY piece ROWS UNBOUNDED PRECEDING) AS location FROM t WHERE txt <> '')
SELECT page_id, piece, location, length(txt) AS chars FROM c WHERE NOT head""")
def q_sections_from_pages(spark: SparkSession, sf: str) -> DataFrame:
    """All text of the pages, cut at headings, with the heading that stands before it."""
    marked = F.regexp_replace(F.regexp_replace("html", "(?i)<h[1-6][^>]*>", "\x01H"), "(?i)</h[1-6]>", "\x01T")
    rows = table(spark, sf, "pages").select("page_id", F.posexplode(F.split(F.concat(F.lit("T"), marked), "\x01")).alias("piece", "raw"))
    plain = T.collapse(F.regexp_replace(F.substring("raw", 2, 1 << 30), "<[^>]*>", " "))
    rows = rows.select("page_id", "piece", plain.alias("txt"), F.col("raw").startswith("H").alias("head")).filter("txt <> ''")
    rows = rows.withColumn("heading", F.when(F.col("head"), F.col("txt"))).withColumn("location", F.lit(None).cast("string"))
    return chunking.carry_headings(rows, "page_id").filter("NOT head").select("page_id", "piece", "location", F.length("txt").alias("chars"))


def _order_texts(spark: SparkSession, sf: str) -> DataFrame:
    """One text per order: a note, its lines as a |...| table where the flag is not N, and a closing line."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_returnflag").alias("flag"))
    cell = F.when(F.col("flag") == "N", F.concat(F.lit("note "), F.col("l_linenumber"))).otherwise(F.concat(F.lit("| "), F.col("l_linenumber"), F.lit(" | "), F.col("flag"), F.lit(" |")))
    items = F.array_sort(F.collect_list(F.struct("l_linenumber", cell.alias("cell"))))
    return lines.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("begin\n"), F.array_join(F.transform(items, lambda x: x["cell"]), "\n"), F.lit("\nend")).alias("text"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS flag FROM lineitem GROUP BY ALL),
cells AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS line, flag <> 'N' AS piped FROM l),
lines AS (SELECT * FROM cells UNION ALL SELECT DISTINCT doc_id, 0, false FROM cells UNION ALL SELECT doc_id, max(line) + 1, false FROM cells GROUP BY doc_id),
r AS (SELECT *, sum(ch) OVER (PARTITION BY doc_id ORDER BY line) AS run FROM (SELECT *, coalesce((piped <> lag(piped) OVER (PARTITION BY doc_id ORDER BY line))::INT, 1) AS ch FROM lines)),
k AS (SELECT doc_id, line, CASE WHEN piped AND count(*) OVER (PARTITION BY doc_id, run) >= 2 THEN 'table' ELSE 'text' END AS kind FROM r),
b AS (SELECT doc_id, line, kind, sum(ch) OVER (PARTITION BY doc_id ORDER BY line) - 1 AS block FROM (SELECT *, coalesce((kind <> lag(kind) OVER (PARTITION BY doc_id ORDER BY line))::INT, 1) AS ch FROM k))
SELECT doc_id, block, kind, min(line) AS first_line, count(*) AS lines FROM b GROUP BY ALL""")
def q_table_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.line_blocks(_order_texts(spark, sf))


@query()
def q_structure_split(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.split_documents(table(spark, sf, "documents")).select("doc_id", "chunk_index", "chunk_type", "location", F.length("text").alias("chars"), F.sha2("text", 256).alias("digest"))


def _merge(lists: pd.Series) -> pd.Series:
    return lists.map(lambda x: chunking.merge_overlapping(list(x)))


@query()
def q_overlap_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Fixed windows of every document merged again; equal says whether its words came back."""
    wins = chunking.fixed_windows(table(spark, sf, "documents"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("window", "text"))), lambda x: x["text"])

    merged = wins.groupBy("doc_id").agg(F.count(F.lit(1)).alias("windows"), parts.alias("parts")).withColumn("merged", F.pandas_udf(_merge, "string")("parts"))
    docs = table(spark, sf, "documents").select("doc_id", F.array_join(T.words(F.coalesce("text", F.lit(""))), " ").alias("want"))
    return merged.join(docs, "doc_id").select("doc_id", "windows", F.length("merged").alias("chars"), (F.regexp_replace("merged", "\n", " ") == F.col("want")).alias("equal"))


# ---- page selection


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """Ship lines as page measurements."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("source_doc"), F.col("l_linenumber").alias("page")).agg(F.max("l_quantity").alias("q"), F.max("l_discount").alias("d"), F.max("l_partkey").alias("p"), F.max("l_suppkey").alias("s"))
    return rows.select("source_doc", "page", (F.col("q") * 4).cast("int").alias("text_chars"), (F.col("d") * 10).alias("image_coverage"), (F.col("p") % 400).cast("int").alias("drawings"), F.array(F.struct((F.col("s") % 6).cast("int").alias("r"), (F.col("p") % 5).cast("int").alias("c"))).alias("tables"), (F.col("source_doc") % 2 == 0).alias("chart_dense"))


_PAGES = """g AS (SELECT l_orderkey AS source_doc, l_linenumber AS page, max(l_quantity) AS q, max(l_discount) AS d, max(l_partkey) AS p, max(l_suppkey) AS s FROM lineitem GROUP BY ALL),
pg AS (SELECT source_doc, page, (q * 4)::INT AS text_chars, d * 10 AS cov, (p % 400)::INT AS drawings, (s % 6)::INT AS r, (p % 5)::INT AS c, source_doc % 2 = 0 AS dense FROM g),
r0 AS (SELECT *, text_chars < 50 AND cov >= 0.5 AS scanned, CASE WHEN r >= 4 AND c >= 3 THEN 3.0 ELSE 0 END + CASE WHEN drawings >= 300 THEN 3.0 ELSE 0 END + CASE WHEN cov >= 0.5 THEN 3.0 WHEN text_chars < 100 AND cov >= 0.02 THEN 1.0 ELSE 0 END AS raw FROM pg),
scored AS (SELECT *, (CASE WHEN scanned THEN 0 ELSE raw + CASE WHEN raw > 0 AND dense THEN 0.5 ELSE 0 END END)::DOUBLE AS score FROM r0),
ranked AS (SELECT *, max(score) OVER (PARTITION BY source_doc) AS strongest, row_number() OVER (PARTITION BY source_doc ORDER BY score DESC, drawings DESC, cov DESC, r * c DESC, page) AS n FROM scored WHERE NOT scanned),
cand AS (SELECT source_doc, page, score, false AS fallback FROM ranked WHERE score > 0
         UNION ALL SELECT source_doc, page, 2.0, true FROM ranked WHERE strongest < 3 AND n = 1 AND dense AND (cov >= 0.25 OR drawings >= 100 OR (r >= 3 AND c >= 3))),
qual AS (SELECT *, row_number() OVER (PARTITION BY source_doc ORDER BY score DESC, page) AS n FROM cand WHERE score >= 3 OR fallback),
kept AS (SELECT *, n <= 6 AS kept FROM qual),
deep AS (SELECT *, CASE WHEN fallback THEN 0 ELSE row_number() OVER (PARTITION BY source_doc, kept, fallback ORDER BY score DESC, page) - 1 END AS depth FROM kept)"""


@query(f"WITH {_PAGES} SELECT source_doc, page, scanned, score FROM scored")
def q_vision_score(spark: SparkSession, sf: str) -> DataFrame:
    return vision.score_pages(_pages(spark, sf)).select("source_doc", "page", "scanned", "score")


@query(f"WITH {_PAGES} SELECT source_doc, page, score::DOUBLE AS score, fallback, kept FROM kept")
def q_vision_plan(spark: SparkSession, sf: str) -> DataFrame:
    found = vision.candidates(vision.score_pages(_pages(spark, sf)))
    return vision.select(found, 100).select("source_doc", "page", "score", "fallback", "kept")


@query(f"WITH {_PAGES} SELECT source_doc, page, score::DOUBLE AS score, fallback FROM deep WHERE kept ORDER BY fallback, depth, score DESC, source_doc, page LIMIT 500")
def q_vision_round_robin(spark: SparkSession, sf: str) -> DataFrame:
    found = vision.candidates(vision.score_pages(_pages(spark, sf)))
    return vision.select(found, 500).filter("chosen").select("source_doc", "page", "score", "fallback")


@query(f"WITH {_PAGES} SELECT source_doc, page FROM cand WHERE fallback")
def q_vision_fallback(spark: SparkSession, sf: str) -> DataFrame:
    return vision.candidates(vision.score_pages(_pages(spark, sf))).filter("fallback").select("source_doc", "page")


# ---- guardrails


_SAN = _collapse(r"regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g')")
_ATTACK = " OR ".join(f"regexp_matches({_SAN}, '(?i){p.replace(chr(39), chr(39) * 2)}')" for p in guardrails.INJECTION)


@query(f"SELECT conv_id, turn, CASE WHEN length(text) > 2000 THEN 'too_long' WHEN {_SAN} = '' THEN 'empty' WHEN {_ATTACK} THEN 'injection' ELSE 'allowed' END AS verdict FROM conversations")
def q_guardrail_input(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", guardrails.input_verdict(F.col("text")).alias("verdict"))


@query(rf"""WITH p AS (SELECT conv_id, turn, {_collapse(r"regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g')")} AS p FROM conversations)
SELECT conv_id, turn, CASE WHEN p IN {guardrails.GREETING} THEN 'greeting' WHEN p IN {guardrails.THANKS} THEN 'thanks' WHEN p IN {guardrails.FAREWELL} THEN 'farewell' END AS kind FROM p""")
def q_greeting(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", guardrails.greeting_kind(F.col("text")).alias("kind"))


@query(f"SELECT conv_id, turn, len({_words('text')}) >= 6 AND regexp_matches(text, '(?i){guardrails.COMPOUND}') AS compound FROM conversations")
def q_compound(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", guardrails.looks_compound(F.col("text")).alias("compound"))


_LEAK = " OR ".join(f"contains(lower({_collapse('t')}), '{p}')" for p in guardrails.LEAKS)
_NON = "(" + ", ".join("'" + x.replace("'", "''") + "'" for x in guardrails.NON_ANSWERS) + ")"


@query(rf"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, {_strip("coalesce(text, '')")} AS bare FROM documents),
f AS (SELECT doc_id, max(c) AS best, sum(c) AS total FROM (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(regexp_split_to_array(bare, '[.!?\n]+'), lambda x: lower({_collapse("x")}))) AS x FROM a) WHERE x <> '' GROUP BY ALL) GROUP BY doc_id),
w AS (SELECT doc_id, {_words("lower(bare)")} AS w FROM a),
u AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
r AS (SELECT doc_id, max(c) AS run FROM (SELECT doc_id, x, i - n AS g, count(*) AS c FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, x ORDER BY i) AS n FROM u) GROUP BY ALL) GROUP BY doc_id)
SELECT doc_id, CASE WHEN {_collapse("t")} = '' THEN 'empty' WHEN bare = '' THEN 'markers_only' WHEN lower(bare) IN {_NON} THEN 'non_answer' WHEN length(bare) < 10 THEN 'short'
 WHEN {_LEAK} OR regexp_matches(t, '{guardrails.LEAK_TAG}') THEN 'leak' WHEN best >= 3 AND best * 2 > total THEN 'repeated_fragment' WHEN run >= 8 THEN 'repeated_word'
 WHEN len(w) >= 50 AND len(list_distinct(w)) / len(w) < 0.2 THEN 'few_words' WHEN regexp_matches(regexp_replace(t, '\s+$', ''), '[,;(\[{{]$') OR regexp_matches(regexp_replace(t, '\s+$', ''), '\[[^\]]*$') THEN 'truncated' ELSE 'ok' END AS verdict
FROM a LEFT JOIN f USING (doc_id) JOIN w USING (doc_id) LEFT JOIN r USING (doc_id)""")
def q_output_guardrail(spark: SparkSession, sf: str) -> DataFrame:
    return guardrails.output_verdicts(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "verdict")


# ---- cache


@query(f"SELECT doc_id, array_to_string({_numbers('text')}, '|') AS numbers FROM documents")
def q_number_multiset(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.numbers(F.col("text")), "|").alias("numbers"))


_CACHE = f"""q AS (SELECT v.vec_id AS qid, v.embedding, d.text FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id WHERE v.vec_id % 20 = 0),
e AS (SELECT v.vec_id AS entry_id, v.embedding, d.text FROM embeddings v JOIN documents d ON d.doc_id = v.vec_id WHERE v.vec_id % 20 <> 0),
c AS (SELECT a.qid, b.entry_id, a.text, b.text AS entry_text, {_COS} AS score, row_number() OVER (PARTITION BY a.qid ORDER BY {_COS} DESC, b.entry_id) AS n FROM q a, e b QUALIFY n <= 5)"""


@query(f"WITH {_CACHE} SELECT qid, min_by(entry_id, n) AS entry_id, max(score) AS score FROM c WHERE score >= 0.1 AND {_numbers('text')} = {_numbers('entry_text')} GROUP BY qid")
def q_cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    vectors, docs = table(spark, sf, "embeddings"), table(spark, sf, "documents")
    asked = vectors.filter("vec_id % 20 = 0").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query_vector"))
    held = vectors.filter("vec_id % 20 <> 0").join(docs.select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    near = dense.cosine_top_k(held, asked, 5, query_key="qid").select("qid", F.col("vec_id").alias("entry_id"), "score")
    texts = docs.select("doc_id", "text")
    rows = near.join(texts.select(F.col("doc_id").alias("qid"), F.col("text").alias("question")), "qid").join(texts.select(F.col("doc_id").alias("entry_id"), F.col("text").alias("entry_question")), "entry_id")
    return cache.lookup(rows, 0.1)


@query("SELECT conv_id, sha256(concat('persistent', chr(0), text)) AS entry_id, turn FROM conversations WHERE role = 'user' AND NOT (conv_id % 5 = 2 OR (conv_id + turn) % 5 = 2)")
def q_cache_invalidate(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "conversations").filter("role = 'user'")
    docs = F.transform(F.array(F.col("conv_id") % 5, (F.col("conv_id") + F.col("turn")) % 5), lambda x: F.struct(F.lit("corpus").alias("kind"), F.concat(F.lit("src"), x.cast("string")).alias("source_doc")))
    rows = rows.select("conv_id", "turn", F.lit("persistent").alias("corpus_scope"), F.col("text").alias("question"), F.lit("").alias("answer"), docs.alias("citations"))
    entries = cache.entries(rows).join(rows.select("conv_id", "turn", T.entry_id(F.col("corpus_scope"), F.col("question")).alias("entry_id")).distinct(), "entry_id")
    wanted = F.array_sort(F.array_distinct(F.array(F.concat(F.lit("src"), (F.col("conv_id") % 5).cast("string")), F.concat(F.lit("src"), ((F.col("conv_id") + F.col("turn")) % 5).cast("string")))))
    entries = entries.filter(F.col("cited_docs") == wanted).dropDuplicates(["conv_id", "turn", "entry_id"])
    return store.invalidate(entries, "src2").select("conv_id", "entry_id", "turn")


# ---- citations


def _answers(spark: SparkSession, sf: str) -> DataFrame:
    """Assistant turns as answers: a marker group ends every line, numbers follow from the line's place."""
    rows = table(spark, sf, "conversations").filter("role = 'assistant'")
    qid = F.col("conv_id") * 100 + F.col("turn")
    mark = lambda x, i: F.concat(x, F.lit(" ["), ((qid + i) % 6).cast("string"), F.lit(", "), ((qid * 3 + i * 2) % 9).cast("string"), F.lit("]"))
    return rows.select(qid.alias("qid"), F.array_join(F.transform(F.split("text", "\n"), mark), "\n").alias("answer"))


def _refs(answers: DataFrame) -> DataFrame:
    """Passages 1 to 6 of every answer; two share a page, two are one web page."""
    n = F.col("number")
    rows = answers.select("qid", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("number"))
    return rows.select("qid", "number", F.when(n <= 4, "corpus").otherwise("web").alias("kind"), F.when(n <= 4, F.concat(F.lit("doc"), (n % 2).cast("string"))).alias("source_doc"), F.when(n <= 2, 1).when(n <= 4, n % 2).cast("int").alias("page"), F.when(n > 4, F.lit("https://example.org/page")).alias("source_url"), ((F.col("qid") * n) % 10 / 10).alias("score"))


_ANS = r"""lines AS (SELECT conv_id * 100 + turn AS qid, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM conversations WHERE role = 'assistant'),
nums AS (SELECT qid, i * 2 AS seen, (qid + i) % 6 AS number FROM lines UNION ALL SELECT qid, i * 2 + 1, (qid * 3 + i * 2) % 9 FROM lines),
mk AS (SELECT qid, number, min(seen) AS seen FROM nums GROUP BY ALL),
mks AS (SELECT qid, number, seen FROM mk)"""


@query(f"WITH {_ANS} SELECT qid, number, row_number() OVER (PARTITION BY qid ORDER BY seen) - 1 AS first_at FROM mks")
def q_markers(spark: SparkSession, sf: str) -> DataFrame:
    return citations.marker_rows(_answers(spark, sf)).select("qid", "number", "first_at")


@query(f"WITH {_ANS} SELECT qid, number FROM mks WHERE number NOT BETWEEN 1 AND 6")
def q_invalid_markers(spark: SparkSession, sf: str) -> DataFrame:
    answers = _answers(spark, sf)
    return citations.invalid_markers(citations.marker_rows(answers), _refs(answers)).select("qid", "number")


@query(f"""WITH {_ANS}, v AS (SELECT *, CASE WHEN number > 4 THEN 'web' WHEN number <= 2 THEN concat('doc', number % 2, '/1') ELSE concat('doc', number % 2, '/', number % 2) END AS grp, ((qid * number) % 10) / 10 AS score FROM mks WHERE number BETWEEN 1 AND 6),
g AS (SELECT qid, grp, min(seen) AS seen, arg_min(number, -score * 100 + number) AS best_number FROM v GROUP BY ALL)
SELECT v.qid, v.number, dense_rank() OVER (PARTITION BY v.qid ORDER BY g.seen) AS citation, g.best_number FROM v JOIN g USING (qid, grp)""")
def q_citation_groups(spark: SparkSession, sf: str) -> DataFrame:
    answers = _answers(spark, sf)
    return citations.citation_groups(citations.marker_rows(answers), _refs(answers))


@query()
def q_citation_filter(spark: SparkSession, sf: str) -> DataFrame:
    answers = _answers(spark, sf)
    return citations.filter_structural(answers, _refs(answers)).withColumn("invalid", F.array_join("invalid", ","))


@query("SELECT doc_id AS qid, 0 AS claim, bool_and(quality = 1) AS supported FROM labels GROUP BY doc_id UNION ALL SELECT doc_id, 1, bool_and(toxic = 0) FROM labels GROUP BY doc_id")
def q_claim_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return citations.verdicts(_replies(spark, sf))


def _replies(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as verdict replies in JSON, with a malformed entry in each."""
    entry = lambda i, ok: F.struct(F.lit(i).alias("index"), ok.alias("supported"), F.lit("").alias("reason"))
    body = F.to_json(F.struct(F.array(entry(0, F.col("quality") == 1), entry(1, F.col("toxic") == 0), entry(-1, F.lit(True))).alias("claims")))
    return table(spark, sf, "labels").select(F.col("doc_id").alias("qid"), as_models_write(body, F.col("doc_id")).alias("reply"))


def as_models_write(body: Column, number: Column) -> Column:
    """A JSON reply as it is, in a code fence, or amid prose with brackets of its own."""
    fenced = F.concat(F.lit("```json\n"), body, F.lit("\n```"))
    prose = F.concat(F.lit("As [1] and {this} say: "), body, F.lit(" (see {2})"))
    return F.when(F.floor(number / 7) % 3 == 0, body).when(F.floor(number / 7) % 3 == 1, fenced).otherwise(prose)


@query("""WITH v AS (SELECT doc_id, bool_and(quality = 1) AS a, bool_and(toxic = 0) AS b FROM labels GROUP BY doc_id)
SELECT doc_id AS qid, round((a::INT + b::INT) / 3, 6) AS score, 3 AS claims, ((a::INT + b::INT) / 3) >= 0.5 AS badge_ok FROM v""")
def q_groundedness(spark: SparkSession, sf: str) -> DataFrame:
    replies = _replies(spark, sf)
    claims = replies.select("qid").distinct().select("qid", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("claim"))
    judged = citations.apply_verdicts(claims, citations.verdicts(replies))
    return citations.groundedness(judged).select("qid", F.round("score", 6).alias("score"), "claims", (F.col("score") >= 0.5).alias("badge_ok"))


# ---- state


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS age FROM conversations QUALIFY age <= 3")
def q_history_last3(spark: SparkSession, sf: str) -> DataFrame:
    return state.last_turns(table(spark, sf, "conversations")).select("conv_id", "turn", "role", "age")


_LIVE = """WITH u AS (SELECT user_id, max(ts) AS last_used FROM events GROUP BY user_id), n AS (SELECT max(ts) AS now FROM events),
x AS (SELECT user_id, last_used, epoch_us(now) - epoch_us(last_used) >= {idle} AS expired FROM u, n)
SELECT user_id, CASE WHEN expired THEN 'expired' WHEN row_number() OVER (PARTITION BY expired ORDER BY last_used DESC, user_id) <= {most} THEN 'live' ELSE 'evicted' END AS status FROM x"""


@query(_LIVE.format(idle=10**15, most=20))
def q_session_lru(spark: SparkSession, sf: str) -> DataFrame:
    return state.live_sessions(table(spark, sf, "events"), 1e9, 20).select("user_id", "status")


@query(_LIVE.format(idle=4 * 3600 * 10**6, most=1000))
def q_idle_expiry(spark: SparkSession, sf: str) -> DataFrame:
    return state.live_sessions(table(spark, sf, "events"), 4 * 3600, 1000).select("user_id", "status")


# ---- ledger


def _calls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_type").alias("stage"), F.concat(F.lit("model"), (F.col("user_id") % 4).cast("string")).alias("model"), F.floor(F.col("value") * 100).cast("long").alias("prompt_tokens"), F.get_json_object("props", "$.k").cast("long").alias("output_tokens"))


_CALLS = "c AS (SELECT event_type AS stage, concat('model', user_id % 4) AS model, floor(value * 100)::BIGINT AS prompt_tokens, (props->>'$.k')::BIGINT AS output_tokens FROM events)"


@query(f"WITH {_CALLS} SELECT CASE WHEN grouping(stage) = 1 THEN 'total' ELSE stage END AS stage, count(*) AS calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(output_tokens)::BIGINT AS output_tokens, (sum(prompt_tokens) + sum(output_tokens))::BIGINT AS total_tokens FROM c GROUP BY ROLLUP (stage)")
def q_usage_by_stage(spark: SparkSession, sf: str) -> DataFrame:
    return ledger.usage_by_stage(_calls(spark, sf))


@query(f"WITH {_CALLS} SELECT model, count(*) AS calls, round(CASE model WHEN 'model0' THEN sum(prompt_tokens * 1.5 + output_tokens * 9.0) / 1e6 WHEN 'model1' THEN sum(prompt_tokens * 0.3 + output_tokens * 2.5) / 1e6 WHEN 'model2' THEN 0.008 * count(*) END, 6) AS usd, model = 'model3' AS any_unpriced FROM c GROUP BY model")
def q_usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    prices = spark.createDataFrame([("model0", 1.5, 9.0, None), ("model1", 0.3, 2.5, None), ("model2", None, None, 0.008)], "model string, input double, output double, per_call double")
    return ledger.cost(_calls(spark, sf), F.broadcast(prices))


@query("SELECT user_id, user_id % 3 AS sub_question, arg_max(event_type, event_id) AS status, min(event_id) AS first_seq, count(*) AS events FROM events GROUP BY user_id")
def q_stage_latest(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("user_id", (F.col("user_id") % 3).alias("sub_question"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return ledger.latest_stages(rows, ["user_id", "sub_question"])


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, coalesce((props->>'$.k')::BIGINT >= 50, false) AS high FROM events")
def q_json_props(spark: SparkSession, sf: str) -> DataFrame:
    parsed = F.from_json("props", "struct<k:bigint>")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), F.coalesce(parsed["k"] >= 50, F.lit(False)).alias("high"))


# ---- evaluation


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """Labels as evaluation rows with two metrics, one of them with gaps."""
    d = F.col("doc_id")
    source = F.when(d % 10 < 8, "corpus").when(d % 10 == 8, "web").otherwise("mixed")
    rows = table(spark, sf, "labels").groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return rows.select(d.alias("id"), source.alias("answer_source"), (d % 13 == 0).alias("failed"), F.when(d % 4 != 0, F.col("quality").cast("double")).alias("faithfulness"), (F.col("toxic") + d % 7 / 10).alias("relevancy"))


_REC = """r0 AS (SELECT doc_id AS id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id),
r AS (SELECT id, CASE WHEN id % 10 < 8 THEN 'corpus' WHEN id % 10 = 8 THEN 'web' ELSE 'mixed' END AS answer_source, id % 13 = 0 AS failed, CASE WHEN id % 4 <> 0 THEN quality::DOUBLE END AS faithfulness, (toxic + (id % 7) / 10)::DOUBLE AS relevancy FROM r0)"""


@query(f"WITH {_REC} SELECT CASE WHEN grouping(answer_source) = 1 THEN 'overall' ELSE answer_source END AS slice, count(*) AS questions, round(avg(faithfulness), 4) AS faithfulness, count(faithfulness) AS faithfulness_n, round(avg(relevancy), 4) AS relevancy, count(relevancy) AS relevancy_n FROM r WHERE NOT failed GROUP BY ROLLUP (answer_source)")
def q_eval_aggregate(spark: SparkSession, sf: str) -> DataFrame:
    return runs.aggregate(_records(spark, sf).filter("NOT failed"), ["faithfulness", "relevancy"])


@query(f"""WITH {_REC}, s AS (SELECT count(*) FILTER (NOT failed) AS questions, count(*) FILTER (NOT failed AND answer_source = 'corpus') AS n_corpus, count(*) FILTER (NOT failed AND answer_source = 'web') AS n_web, count(*) FILTER (NOT failed AND answer_source = 'mixed') AS n_mixed, count(*) FILTER (NOT failed AND answer_source = 'none') AS n_none, count(*) FILTER (failed) AS errors, count(*) AS total_questions FROM r),
p AS (SELECT *, round(100.0 * n_corpus / questions, 1) AS pct_corpus, round(100.0 * n_web / questions, 1) AS pct_web, round(100.0 * n_mixed / questions, 1) AS pct_mixed, round(100.0 * n_none / questions, 1) AS pct_none FROM s)
SELECT *, questions > 0 AND pct_corpus < 80 AS low_corpus_coverage, total_questions > 0 AND errors / total_questions > 0.1 AS run_invalid FROM p""")
def q_eval_split(spark: SparkSession, sf: str) -> DataFrame:
    return runs.split_summary(_records(spark, sf))


@query(f"""WITH {_REC}, a AS (SELECT * FROM r WHERE NOT failed AND answer_source = 'corpus'), b AS (SELECT id, faithfulness * 0.5 AS faithfulness, relevancy + 0.1 AS relevancy FROM r WHERE id % 5 <> 0 AND answer_source = 'corpus'),
j AS (SELECT a.faithfulness AS fa, b.faithfulness AS fb, a.relevancy AS ra, b.relevancy AS rb FROM a JOIN b USING (id)),
l AS (SELECT 'faithfulness' AS metric, fa AS va, fb AS vb FROM j UNION ALL SELECT 'relevancy', ra, rb FROM j)
SELECT metric, round(avg(va), 4) AS mean_a, round(avg(vb), 4) AS mean_b, round(avg(vb) - avg(va), 4) AS delta, count(*) AS n FROM l WHERE va IS NOT NULL AND vb IS NOT NULL GROUP BY metric""")
def q_run_compare(spark: SparkSession, sf: str) -> DataFrame:
    rows = _records(spark, sf).filter("answer_source = 'corpus'")
    other = rows.filter("id % 5 <> 0").select("id", (F.col("faithfulness") * 0.5).alias("faithfulness"), (F.col("relevancy") + 0.1).alias("relevancy"))
    return runs.compare(rows.filter("NOT failed"), other, ["faithfulness", "relevancy"])


@query("""WITH o AS (SELECT p_brand AS key, max(p_size)::VARCHAR AS value FROM part WHERE p_partkey % 2 = 0 GROUP BY p_brand), n AS (SELECT p_type AS key, max(p_size)::VARCHAR AS value FROM part GROUP BY p_type UNION ALL SELECT p_brand, max(p_size)::VARCHAR FROM part GROUP BY p_brand)
SELECT coalesce(o.key, n.key) AS key, o.value AS stored, n.value AS current FROM o FULL JOIN n USING (key) WHERE o.value IS DISTINCT FROM n.value""")
def q_config_diff(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    pairs = lambda df, c: df.groupBy(F.col(c).alias("key")).agg(F.max("p_size").cast("string").alias("value"))
    return runs.config_diff(pairs(part.filter("p_partkey % 2 = 0"), "p_brand"), pairs(part, "p_type").unionByName(pairs(part, "p_brand")))


@query("SELECT doc_id AS id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_resume_pending(spark: SparkSession, sf: str) -> DataFrame:
    return runs.pending(table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang"), table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


def _calibration(spark: SparkSession, sf: str) -> DataFrame:
    """Labels with a made score; in-corpus is quality 1."""
    score = F.round(0.7 + (F.col("doc_id") % 29) / 100 + F.col("quality") * 0.05, 4)
    return table(spark, sf, "labels").select(score.alias("top_dense"), (F.col("quality") == 1).alias("expected"))


_CAL = "c AS (SELECT round(0.7 + (doc_id % 29) / 100 + quality * 0.05, 4)::DOUBLE AS s, quality = 1 AS e FROM labels)"


@query(f"WITH {_CAL} SELECT count(*) FILTER (s >= 0.9 AND e) AS auto_sufficient_right, count(*) FILTER (s >= 0.9 AND NOT e) AS auto_sufficient_wrong, count(*) FILTER (s < 0.78 AND NOT e) AS auto_insufficient_right, count(*) FILTER (s < 0.78 AND e) AS auto_insufficient_wrong, count(*) FILTER (s >= 0.78 AND s < 0.9) AS grey FROM c")
def q_calibration_tally(spark: SparkSession, sf: str) -> DataFrame:
    return runs.resolution(_calibration(spark, sf), 0.78, 0.90)


@query(f"WITH {_CAL}, m AS (SELECT min(s) FILTER (e) AS i, max(s) FILTER (NOT e) AS o FROM c) SELECT round(CASE WHEN i > o THEN o + least(0.02, (i - o) / 4) ELSE i - 0.02 END, 6) AS low, round(CASE WHEN i > o THEN i - least(0.02, (i - o) / 4) ELSE o + 0.02 END, 6) AS high, CASE WHEN i > o THEN 'clean gap between the labels' ELSE 'labels overlap' END AS shape FROM m")
def q_threshold_suggest(spark: SparkSession, sf: str) -> DataFrame:
    return runs.suggest_thresholds(_calibration(spark, sf)).select(F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "shape")


@query(f"WITH {_CAL} SELECT e AS expected, min(s) AS least, round(median(s), 6) AS median, max(s) AS most, count(*) AS n FROM c GROUP BY e")
def q_calibration_spread(spark: SparkSession, sf: str) -> DataFrame:
    return runs.spread(_calibration(spark, sf))


def _manifest(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy(F.col("source").alias("source_doc")).agg((F.count(F.lit(1)) % 9).cast("int").alias("pages")).filter("source_doc IS NOT NULL AND source_doc NOT IN ('src4', 'src9')")


_MAN = "m AS (SELECT source AS source_doc, (count(*) % 9)::INT AS pages FROM documents WHERE source IS NOT NULL AND source NOT IN ('src4', 'src9') GROUP BY source)"


@query(f"WITH {_MAN}, s AS (SELECT item_id AS id, concat('src', item_id % 25) AS source_doc, (item_id % 12)::INT AS page FROM benchmark) SELECT DISTINCT id, source_doc, CASE WHEN pages IS NULL THEN 'not in manifest' ELSE 'page outside' END AS issue FROM s LEFT JOIN m USING (source_doc) WHERE pages IS NULL OR page < 1 OR page > pages")
def q_reference_audit(spark: SparkSession, sf: str) -> DataFrame:
    sources = table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string")).alias("source_doc"), (F.col("item_id") % 12).cast("int").alias("page"))
    return runs.source_problems(sources, _manifest(spark, sf))


@query(f"WITH {_MAN}, f AS (SELECT DISTINCT concat('src', item_id % 25) AS source_doc FROM benchmark) SELECT source_doc, 'not_in_manifest' AS side FROM f WHERE source_doc NOT IN (SELECT source_doc FROM m) UNION ALL SELECT source_doc, 'missing_file' FROM m WHERE source_doc NOT IN (SELECT source_doc FROM f)")
def q_manifest_anti(spark: SparkSession, sf: str) -> DataFrame:
    files = table(spark, sf, "benchmark").select(F.concat(F.lit("src"), (F.col("item_id") % 25).cast("string")).alias("source_doc"))
    return runs.file_differences(files, _manifest(spark, sf))


# ---- web


@query(r"""WITH r AS (SELECT page_id % 10 AS qid, page_id AS position, url, regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS canonical FROM pages WHERE regexp_matches(url, '(?i)^\s*https?://[^/?#\s]+') AND trim(html) <> '')
SELECT qid, concat('web:', substr(sha256(canonical), 1, 16)) AS web_id, position + 1 AS rank, url FROM r QUALIFY row_number() OVER (PARTITION BY qid, canonical ORDER BY position) = 1""")
def q_web_normalise(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "pages").select((F.col("page_id") % 10).alias("qid"), F.col("page_id").alias("position"), "url", F.col("html").alias("content"))
    return web.normalize(rows).select("qid", "web_id", "rank", "url")
