"""Budgeted choice of pages for expensive extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what makes a page a scan, what its signals are worth, and the weaker ones of a fallback page
SCANNED_CHARS, LARGE_IMAGE = 50, 0.5
TABLE_ROWS, TABLE_COLUMNS, MANY_DRAWINGS, STRONG = 4, 3, 300, 3.0
FEW_CHARS, SMALL_IMAGE, WEAK = 100, 0.02, 1.0
CHART_DENSE_BONUS = 0.5
RELAXED_IMAGE, RELAXED_DRAWINGS, RELAXED_TABLE = 0.25, 100, 3
SELECT_SCORE = 3.0
FALLBACK_SCORE = 2.0
PER_DOCUMENT = 6


def flag_chart_dense(pages: DataFrame, manifest: DataFrame) -> DataFrame:
    """Pages with chart_dense: whether the manifest says that their document has tables or charts."""
    dense = manifest.filter(F.col("has_tables_charts") == "yes").select(F.col("filename").alias("source_doc"), F.lit(True).alias("chart_dense")).distinct()
    return pages.join(dense, "source_doc", "left").withColumn("chart_dense", F.coalesce("chart_dense", F.lit(False)))


def score_pages(pages: DataFrame) -> DataFrame:
    """score and scanned from text_chars, image_coverage, drawings, tables array<struct<r,c>>, chart_dense."""
    scanned = (F.col("text_chars") < SCANNED_CHARS) & (F.col("image_coverage") >= LARGE_IMAGE)
    table = F.exists("tables", lambda t: (t["r"] >= TABLE_ROWS) & (t["c"] >= TABLE_COLUMNS))
    image = F.when(F.col("image_coverage") >= LARGE_IMAGE, STRONG).when((F.col("text_chars") < FEW_CHARS) & (F.col("image_coverage") >= SMALL_IMAGE), WEAK).otherwise(0.0)
    raw = F.when(table, STRONG).otherwise(0.0) + F.when(F.col("drawings") >= MANY_DRAWINGS, STRONG).otherwise(0.0) + image
    return pages.withColumn("scanned", scanned).withColumn("score", F.when(scanned, 0.0).otherwise(raw + F.when((raw > 0) & F.col("chart_dense"), CHART_DENSE_BONUS).otherwise(0.0)))


def candidates(scored: DataFrame) -> DataFrame:
    """source_doc, page, score, fallback: scored pages, and one fallback page of a chart-dense document without a strong one."""
    area = F.coalesce(F.array_max(F.transform("tables", lambda t: t["r"] * t["c"])), F.lit(0))
    relaxed = (F.col("image_coverage") >= RELAXED_IMAGE) | (F.col("drawings") >= RELAXED_DRAWINGS) | F.exists("tables", lambda t: (t["r"] >= RELAXED_TABLE) & (t["c"] >= RELAXED_TABLE))
    rows = scored.filter(~F.col("scanned")).withColumn("relaxed", relaxed).withColumn("area", area)
    by_doc = Window.partitionBy("source_doc")
    best = by_doc.orderBy(F.desc("score"), F.desc("drawings"), F.desc("image_coverage"), F.desc("area"), "page")
    rows = rows.withColumn("strongest", F.max("score").over(by_doc)).withColumn("n", F.row_number().over(best))
    own = rows.filter("score > 0").select("source_doc", "page", "score", F.lit(False).alias("fallback"))
    spare = rows.filter((F.col("strongest") < SELECT_SCORE) & (F.col("n") == 1) & F.col("chart_dense") & F.col("relaxed"))
    return own.unionByName(spare.select("source_doc", "page", F.lit(FALLBACK_SCORE).alias("score"), F.lit(True).alias("fallback")))


def select(found: DataFrame, cap: int, per_doc: int = PER_DOCUMENT) -> DataFrame:
    """All qualified candidates with chosen: the ceiling per document, then rounds over documents, fallbacks last.

    When everything under the ceiling fits the cap, all of it is chosen.  The
    global order is a top-k of at most ``cap`` rows.
    """
    rows = found.filter((F.col("score") >= SELECT_SCORE) | F.col("fallback"))
    doc = Window.partitionBy("source_doc").orderBy(F.desc("score"), "page")
    rows = rows.withColumn("n", F.row_number().over(doc)).withColumn("kept", F.col("n") <= per_doc)
    depth = Window.partitionBy("source_doc", "kept", "fallback").orderBy(F.desc("score"), "page")
    rows = rows.withColumn("depth", F.row_number().over(depth) - 1)
    order = [F.col("fallback").cast("int"), F.when(F.col("fallback"), 0).otherwise(F.col("depth")), F.desc("score"), F.col("source_doc"), F.col("page")]
    chosen = rows.filter("kept").orderBy(*order).limit(cap).select("source_doc", "page", "fallback", F.lit(True).alias("chosen"))
    out = rows.join(chosen, ["source_doc", "page", "fallback"], "left")
    return out.select("source_doc", "page", "score", "fallback", "kept", F.coalesce("chosen", F.lit(False)).alias("chosen"))
