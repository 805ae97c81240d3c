"""From pages and pictures to pieces of text: routing, model replies, fallbacks, memo tables.

What needs a library or a model (page text, rendering, OCR, vision) comes in as
columns or provider functions; what is decided from it is here.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import let

# fixed values: when a page is a scan, when a reply is too short, its declared types, and what a chart's text says
SCANNED_CHARS = 50
LARGE_IMAGE = 0.5
LEAST_REPLY = 12
TAG = r"(?i)CONTENT_TYPE:\s*(table|chart|figure)\s*\n?"
TAG_WITHIN = 120
ATOMIC = ("chart", "image_caption")  # types that are passages as they are
DECLARED = {"table": "table", "chart": "chart", "figure": "image_caption"}
CHART_WORDS = ("chart type", "x-axis", "y-axis", "x axis", "y axis", "axis label", "data point", "bar chart", "line chart", "scatter plot", "pie chart")


def page_coverage(images: DataFrame, pages: DataFrame, keys: tuple[str, ...] = ("source_doc", "page")) -> DataFrame:
    """keys, image_coverage: the share of each page's area under pictures, at most 1; images have x0, y0, x1, y1, pages width and height."""
    area = F.abs((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    covered = images.groupBy(*keys).agg(F.sum(area).alias("covered"))
    page = F.abs(F.col("width") * F.col("height"))
    rows = pages.join(covered, list(keys), "left")
    return rows.select(*keys, F.when(page == 0, 0.0).otherwise(F.least(F.coalesce("covered", F.lit(0.0)) / page, F.lit(1.0))).alias("image_coverage"))


def route_pages(pages: DataFrame, plan: DataFrame) -> DataFrame:
    """source_doc, page, to_ocr, to_vision, keeps_text for pages (text, image_coverage) and the planned units (source_doc, page).

    A scan goes to OCR alone.  A planned page goes to vision, and keeps its
    text unless that is nearly empty.
    """
    planned = plan.select("source_doc", "page", F.lit(True).alias("planned")).distinct()
    chars = F.length(F.trim(F.coalesce("text", F.lit(""))))
    scanned = (chars < SCANNED_CHARS) & (F.col("image_coverage") >= LARGE_IMAGE)
    vision = ~scanned & F.coalesce("planned", F.lit(False))
    rows = pages.join(planned, ["source_doc", "page"], "left")
    return rows.select(*pages.columns, scanned.alias("to_ocr"), vision.alias("to_vision"), (~scanned & ~(vision & (chars < SCANNED_CHARS))).alias("keeps_text"))


def heuristic_type(text: Column) -> Column:
    """Table by two lines with two pipes, chart by its words, else a caption."""
    rows = F.size(F.filter(F.split(text, r"\r\n|[\r\n]"), lambda x: F.length(x) - F.length(F.replace(x, F.lit("|"), F.lit(""))) >= 2))
    chart = F.lit(False)
    for phrase in CHART_WORDS:
        chart = chart | F.lower(text).contains(phrase)
    return F.when(rows >= 2, "table").when(chart, "chart").otherwise("image_caption")


def parse_vision_reply(reply: Column) -> Column:
    """(chunk_type, body, problem): the declared type or a guess, and the transcription; a problem leaves both null."""
    raw = F.coalesce(reply, F.lit(""))
    kind = F.lower(F.regexp_extract(F.substring(raw, 1, TAG_WITHIN), TAG, 1))

    def read(declared: Column) -> Column:
        body = trim_all(F.when(declared == "", raw).otherwise(F.regexp_replace(raw, f"(?s)^.*?{TAG}", "")))
        problem = F.when(trim_all(raw) == "", "empty response").when((F.length(body) < LEAST_REPLY) & (declared != ""), "tag without transcription").when(F.length(body) < LEAST_REPLY, "too short")
        named = F.element_at(F.create_map(*[F.lit(x) for k, v in DECLARED.items() for x in (k, v)]), declared)
        found = F.when(declared == "", heuristic_type(body)).otherwise(named)
        return F.struct(F.when(problem.isNull(), found).alias("chunk_type"), F.when(problem.isNull(), body).alias("body"), problem.alias("problem"))

    return let(kind, read)


def trim_all(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def vision_pieces(units: DataFrame) -> DataFrame:
    """source_doc, page, location, text, chunk_type, extraction_method, error for units with a vision reply and an OCR text.

    Vision first, OCR where its reply is unusable, an error where there is
    neither; units have source_doc, page, location, reply, ocr_text, skip_failures.
    """
    rows = units.withColumn("v", parse_vision_reply(F.col("reply")))
    seen = F.col("v.problem").isNull()
    error = F.when(~seen & F.col("ocr_text").isNull(), F.concat(F.lit("vision and OCR both unavailable: "), F.col("v.problem")))
    rows = rows.select(
        "source_doc", "page", "location",
        F.when(seen, F.col("v.body")).otherwise(F.col("ocr_text")).alias("text"),
        F.when(seen, F.col("v.chunk_type")).when(F.col("ocr_text").isNotNull(), "text").alias("chunk_type"),
        F.when(seen, "vision").when(F.col("ocr_text").isNotNull(), "ocr").alias("extraction_method"),
        error.alias("error"), "skip_failures",
    )
    return rows.filter(F.col("error").isNull() | ~F.col("skip_failures")).drop("skip_failures")


def assemble_pages(routed: DataFrame, pieces: DataFrame) -> DataFrame:
    """Text pieces of the pages that keep their text, and the pieces of OCR and vision, in order of page (order_in_doc from 0); blank ones go."""
    own = routed.filter("keeps_text").select("source_doc", "page", F.trim("text").alias("text"), F.lit("text").alias("chunk_type"), F.lit("text").alias("extraction_method"))
    rows = own.unionByName(pieces.select("source_doc", "page", "text", "chunk_type", "extraction_method")).filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    order = Window.partitionBy("source_doc").orderBy("page", F.col("extraction_method") != "text", "extraction_method")
    return rows.withColumn("order_in_doc", F.row_number().over(order) - 1)


def keep_planned_images(images: DataFrame, plan: DataFrame) -> DataFrame:
    """Standalone pictures that the plan has; their mime type by the leading bytes."""
    mime = F.when(F.hex(F.substring("content", 1, 3)) == "FFD8FF", "image/jpeg").otherwise("image/png")
    return images.join(plan.select("source_doc").distinct(), "source_doc", "left_semi").withColumn("mime_type", mime)


def first_images(planned: DataFrame, most: int) -> DataFrame:
    """The first ``most`` embedded images of each document that no rule skips."""
    order = Window.partitionBy("source_doc").orderBy("number")
    return planned.filter("skipped IS NULL").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= most).drop("n")


# ---- memo tables of costly calls


def memo_key(model: str, content: Column) -> Column:
    """SHA-256 of model and content: another model's results are other entries."""
    return F.sha2(F.concat(F.lit(model.encode() + b"\x00"), content.cast("binary")), 256)


def memoised(wanted: DataFrame, memo: DataFrame, call: Callable[[bytes], str | None], model: str, content: str = "content") -> tuple[DataFrame, DataFrame]:
    """(``wanted`` with value, and the memo with what was missing): each distinct content is asked once; a failed call (None) is not kept."""
    keyed = wanted.withColumn("key", memo_key(model, F.col(content)))

    def ask(contents: pd.Series) -> pd.Series:
        return contents.map(lambda x: call(bytes(x)))

    new = keyed.select("key", F.col(content).cast("binary").alias("c")).dropDuplicates(["key"]).join(memo.select("key"), "key", "left_anti")
    new = new.withColumn("value", F.pandas_udf(ask, "string")("c")).select("key", "value").filter("value IS NOT NULL")
    both = memo.select("key", "value").unionByName(new)
    return keyed.join(both, "key", "left").drop("key"), both


# ---- failures


def failure_counts(events: DataFrame) -> DataFrame:
    """One row from calls (kind, failed, retried, seconds): calls, failures, retries, median and longest seconds of OCR."""
    ocr = F.when(F.col("kind") == "ocr", F.col("seconds"))
    return events.agg(
        F.count_if(F.col("kind") == "vision").alias("vision_calls"), F.count_if((F.col("kind") == "vision") & F.col("failed")).alias("vision_failures"),
        F.count_if(F.col("retried")).alias("transient_retries"), F.count(ocr).alias("ocr_calls"), F.round(F.sum(ocr), 1).alias("ocr_seconds"),
        F.round(F.median(ocr), 1).alias("ocr_median"), F.round(F.max(ocr), 1).alias("ocr_longest"),
    )
