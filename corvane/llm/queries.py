"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import exact_dedup, flac, langid, lexical, mixing, packing, pii, sentence_dedup, sharding, simhash, suffix_dedup, warc, whitening


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_best_fit_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(_docs(spark, sf_dir), 16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_docs(spark, sf_dir), packing.PackConfig(tokenizer=packing.default_tokenizer()))


def op3_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_dedup.dedup_spans(_docs(spark, sf_dir))


def op4_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_exact(_docs(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_suffix_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeated(_docs(spark, sf_dir))


def op6_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flac.digest(_docs(spark, sf_dir))


def op7_compression_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = langid.train(docs, ~held_out)
    return langid.classify(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(_docs(spark, sf_dir))
    return out.select("doc_id", F.lower(F.lpad(F.hex("w0"), 16, "0")).alias("fingerprint"), "component_id")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_docs(spark, sf_dir))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"), "copies", "shards", "order_key")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_spans(_docs(spark, sf_dir)))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_inverted_treaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return lexical.search(lexical.build(_docs(spark, sf_dir), queries=items), items)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_sharding, op2_nnls_packing, op3_sentence_spans, op4_radix_dedup, op5_suffix_family, op6_flac, op7_compression_langid,
        op8_simhash, op9_mixing, op10_pii, op11_warc, op12_whitening, op13_inverted_treaps,
    )
}

ORACLE_SQL: dict[str, str] = {
    "op4_radix_dedup": r"""
        WITH n AS (
            SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER g AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER g = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM n WINDOW g AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
    """,
    "op11_warc": r"""
        WITH p AS (
            SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, '')) AS n FROM pages
        ), g AS (
            SELECT page_id, n, sha1(body) AS d, max(page_id) OVER (PARTITION BY body) AS lead FROM p
        )
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN n >= 1000 AND page_id <> lead THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND page_id <> lead THEN lead END AS refers_to
        FROM g
    """,
    "op13_inverted_treaps": r"""
        WITH words AS (
            SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+') AS ts
            FROM documents WHERE text IS NOT NULL
        ), d AS (
            SELECT row_number() OVER () AS row, doc_id, ts, CAST(len(ts) AS BIGINT) AS n FROM words WHERE len(ts) > 0
        ), corpus AS (
            SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS l FROM d
        ), asked AS (
            SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9A-Za-z\x{80}-\x{10FFFF}]+')) AS term
            FROM benchmark WHERE text IS NOT NULL
        ), times AS (
            SELECT item_id, term, count(*) AS c FROM asked GROUP BY ALL
        ), post AS (
            SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(ts) AS term FROM d) WHERE term IN (SELECT term FROM asked) GROUP BY ALL
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln(CAST(2 * max(nd) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM post, corpus GROUP BY term
        ), impacts AS (
            SELECT row, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * nd) // l)) AS i FROM post, corpus
        ), scores AS (
            SELECT item_id, row, doc_id, CAST(sum(c * w * i) AS BIGINT) AS score FROM times JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL
        )
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id, row) AS rank FROM scores WHERE score > 0) WHERE rank <= 20
    """,
}
