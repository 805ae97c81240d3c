"""A corpus pipeline of five stages; each calls one operator of ``corvane.llm``.

Stages take (spark, docs, sf_dir) and return a DataFrame, which is written and
read again as the next one's documents.  All but the last return the columns
of documents.  As each stage's result is written before the next begins, a
stage first deletes its predecessor's scratch tables, and no others.

Defined results, for every stage: an empty table gives no rows; of the input's
columns only those of documents are used and returned, whatever else there is;
texts of any length are taken whole; rows are told apart by number, so repeated
rows and null or repeated doc_ids are separate documents.  A null or empty text
has no language and goes at the first stage; given to a later one it is the
empty text, equal to other empty texts, a near duplicate of wordless ones, of
size 0, and packed as its end id alone.  Null lang teaches nothing, null source
is a source, null n_chars stays.  Of ties the least doc_id stays (null last),
then the first row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import exact_dedup, langid, mixing, packing, simhash
from corvane.llm.common import ROW, materialize, number_rows, scratch_run

OWNER = "pipeline"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: SimHash of a document's distinct words, 128 bits: the radius within which five-word shingles have a similarity of 0.8 or more.
NEAR = simhash.SimHashConfig(shingle=1, radius=10, words64=2, distinct=True)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents whose language is rejected: no letters, or a narrow margin."""
    with scratch_run(spark, OWNER):
        model = langid.train(docs, F.lit(True))
        return langid.classify(docs, model).filter("NOT rejected").select(*COLUMNS)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts."""
    with scratch_run(spark, OWNER):
        rows = number_rows(docs.select(*COLUMNS))
        kept = exact_dedup.dedup_exact(rows).filter("kept").select(F.col("rid").alias(ROW))
        return rows.join(kept, ROW, "left_semi").select(*COLUMNS)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near duplicates; doc_ids may be null or repeat."""
    with scratch_run(spark, OWNER):
        rows = number_rows(docs.select(*COLUMNS))
        first = simhash.first_rows(rows, NEAR).select(F.col("rid").alias(ROW))
        return rows.join(first, ROW, "left_semi").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources come near their target weights."""
    with scratch_run(spark, OWNER):
        rows = number_rows(docs.select(*COLUMNS))
        plan = mixing.mix(rows).filter("copies > 0").select(F.col("rid").alias(ROW), "order_key", F.posexplode("shards").alias("copy", "shard"))
        plan = materialize(plan.withColumn("order_key", F.xxhash64("order_key", "copy")), "mix-plan")
        return mixing.shuffled(rows.join(plan, ROW), plan.count()).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences; one row per piece."""
    with scratch_run(spark, OWNER):
        return packing.pack(docs, packing.PackConfig(tokenizer=packing.default_tokenizer()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("exact_dedup", drop_exact),
    ("near_dedup", drop_near),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: The stages are not expressible in SQL; they are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
