"""Language identification of texts so short that whole bytes tie."""

import corpus_pipeline as P
import pytest
from pyspark.sql import functions as F

from corvane.llm import langid


@pytest.fixture(scope="module")
def short(spark, sf):
    """Opening words of the tables' own rows, which carry a label."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("text IS NOT NULL AND lang IS NOT NULL")
    words = F.filter(F.split(F.regexp_replace("text", r"[^\p{L}]+", " "), " "), lambda w: w != "")
    return docs.filter(F.size(words) >= 50).select("doc_id", F.array_join(F.slice(words, 1, 6), " ").alias("text"), "lang", "source", "n_chars")


def test_short_texts_stay_and_are_right(spark, sf, short):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.classify(short, langid.train(docs, F.lit(True))).collect()
    assert len(got) >= 100
    assert sum(r.rejected for r in got) <= 0.02 * len(got)
    assert sum(r.lang_pred == r.lang for r in got) >= 0.9 * len(got)


def test_stage_keeps_short_rows(spark, sf, short):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select(*P.COLUMNS)
    extra = short.select((F.col("doc_id") + 10_000_000).alias("doc_id"), "text", "lang", "source", "n_chars")
    kept = P.identify_language(spark, docs.unionByName(extra), sf).filter("doc_id >= 10000000").count()
    assert kept >= 0.98 * short.count()


def test_what_nobody_knows_is_rejected():
    model = [("de", b" der die das und ist nicht ein eine "), ("en", b" the and of to in is that it for ")]
    guess = langid.guesser(model)
    assert guess("\u6771\u4eac")[2] and guess("12 34")[0] == "und"
    assert guess("nicht eine")[0] == "de" and guess("that for")[0] == "en"
