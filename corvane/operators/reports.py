"""Reports over runs, manifests, plans and stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import suffix
from corvane.operators.ranks import placed

UNSCORED = ("out_of_corpus",)  # fixed value: the category without a reference answer
SHORT_TOKENS = 200
LOG_LINES = 40


# ---- evaluation records


def is_error(record_error: Column, terminated_at: Column) -> Column:
    return record_error.isNotNull() | F.coalesce(terminated_at == "error", F.lit(False))


def scorable(records: DataFrame) -> Column:
    """A graded category, retrieved, and an answer, contexts and a reference are there."""
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    return ~F.coalesce(F.col("category").isin(*UNSCORED), F.lit(False)) & (F.col("terminated_at") == "retrieved") & some("answer") & (F.col("n_contexts") > 0) & some("ground_truth")


def skip_reason(records: DataFrame) -> DataFrame:
    """``records`` (category, error, terminated_at, answer, n_contexts, ground_truth) with the first reason for which one is not scored, null where it is."""
    some = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    why = (
        F.when(F.col("category").isin(*UNSCORED), "out_of_corpus")
        .when(is_error(F.col("error"), F.col("terminated_at")), F.concat(F.lit("error: "), F.coalesce("error", F.lit("pipeline call failed"))))
        .when(F.col("terminated_at") != "retrieved", F.col("terminated_at"))
        .when(~some("answer"), "no answer")
        .when(F.col("n_contexts") == 0, "no contexts")
        .when(~some("ground_truth"), "no reference answer")
    )
    return records.withColumn("skip_reason", why)


def out_of_corpus_outcome(error: Column, answer_source: Column, non_answer: Column, answer: Column) -> Column:
    declined = F.coalesce(non_answer, F.lit(False)) | (F.coalesce(answer, F.lit("")) == "")
    return F.when(error, "error").when(answer_source.isin("web", "mixed"), "web_fallback").when(declined, "declined").otherwise("answered_from_corpus")


def join_scores(records: DataFrame, logged: DataFrame, scored: DataFrame) -> DataFrame:
    """``records`` (id, ...) with status and score: from the scored run, else from its log, else 'unscored'."""
    a = logged.select("id", F.col("status").alias("s1"), F.col("score").alias("v1"))
    b = scored.select("id", F.col("status").alias("s2"), F.col("score").alias("v2"))
    rows = records.join(a, "id", "left").join(b, "id", "left")
    from_run = F.col("s2").isNotNull()
    return rows.withColumn("status", F.coalesce("s2", "s1", F.lit("unscored"))).withColumn("score", F.when(from_run, F.col("v2")).otherwise(F.col("v1"))).drop("s1", "s2", "v1", "v2")


def judge_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("http_429").alias("http_429"), F.round(F.sum("seconds"), 1).alias("scoring_seconds"))


def shared_corpus_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids answered from the corpus in both runs: the only fair ground for a difference."""
    fair = lambda df: df.filter((F.col("answer_source") == "corpus") & (F.col("status") == "ok")).select("id").distinct()
    return fair(a).join(fair(b), "id", "left_semi")


def category_table(questions: DataFrame, metrics: list[str]) -> DataFrame:
    """category, questions, scored, and the mean of each metric over those with status ok."""
    ok = F.col("status") == "ok"
    return questions.groupBy(F.coalesce("category", F.lit("uncategorised")).alias("category")).agg(F.count(F.lit(1)).alias("questions"), F.count_if(ok).alias("scored"), *[F.round(F.avg(F.when(ok, F.col(m))), 6).alias(m) for m in metrics])


def filter_questions(questions: DataFrame, category: str | None = None, source: str | None = None, sort: str | None = None) -> DataFrame:
    """Questions of a category and source with their place: lowest score first, those without one last."""
    rows = questions
    if category is not None:
        rows = rows.filter(F.coalesce("category", F.lit("uncategorised")) == category)
    if source is not None:
        rows = rows.filter(F.col("answer_source") == source)
    order = [F.asc_nulls_last(sort), F.col("id")] if sort else [F.col("id")]
    return placed(rows, order)


def reference_summary(questions: DataFrame) -> DataFrame:
    """category, questions, visual, without_sources by category and in all (category 'all')."""
    out = questions.withColumn("category", F.coalesce("category", F.lit("uncategorised"))).rollup("category")
    out = out.agg(F.grouping("category").alias("g"), F.count(F.lit(1)).alias("questions"), F.count_if("visual").alias("visual"), F.count_if(F.col("n_sources") == 0).alias("without_sources"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("category")).alias("category"), "questions", "visual", "without_sources")


def source_counts(questions: DataFrame) -> DataFrame:
    return questions.groupBy(F.coalesce("answer_source", F.lit("none")).alias("answer_source")).agg(F.count(F.lit(1)).alias("questions"))


# ---- runs


def run_names(files: DataFrame) -> DataFrame:
    """Names of the runs that have a raw or a scored file."""
    found = F.regexp_extract("filename", r"^(.+)\.(?:raw|scored)\.json$", 1)
    return files.select(found.alias("run")).filter("run <> ''").distinct()


def run_summary(files: DataFrame, questions: DataFrame) -> DataFrame:
    """run, status, updated_at, questions, place (newest first) from files (filename, modified) and their questions (run, id, scored)."""
    name = F.regexp_extract("filename", r"^(.+)\.(raw|scored)\.json$", 1)
    kind = F.regexp_extract("filename", r"^(.+)\.(raw|scored)\.json$", 2)
    runs = files.select(name.alias("run"), kind.alias("kind"), "modified").filter("run <> ''").groupBy("run").agg(F.max("modified").alias("updated_at"), F.bool_or(F.col("kind") == "scored").alias("scored"))
    counts = questions.groupBy("run").agg(F.count(F.lit(1)).alias("questions"))
    out = runs.join(counts, "run", "left").select("run", F.when(F.col("scored"), "scored").otherwise("partial").alias("status"), "updated_at", F.coalesce("questions", F.lit(0)).alias("questions"))
    return out.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("updated_at"), "run")))  # one row a run


def job_progress(records: DataFrame, scores: DataFrame, totals: DataFrame) -> DataFrame:
    """run, total, answered, scored, phase: no count above the total."""
    answered = records.filter("error IS NULL").groupBy("run").agg(F.count(F.lit(1)).alias("a"))
    scored = scores.groupBy("run").agg(F.count(F.lit(1)).alias("s"))
    rows = totals.join(answered, "run", "left").join(scored, "run", "left")
    upto = lambda c: F.least(F.coalesce(c, F.lit(0)), F.col("total"))
    return rows.select("run", "total", upto("a").alias("answered"), upto("s").alias("scored"), F.when(F.coalesce("a", F.lit(0)) < F.col("total"), "answering").otherwise("scoring").alias("phase"))


def log_tail(lines: DataFrame, most: int = LOG_LINES) -> DataFrame:
    """The last lines that are not blank, of each run."""
    last = Window.partitionBy("run").orderBy(F.desc("line"))
    return lines.filter(F.trim("text") != "").withColumn("n", F.row_number().over(last)).filter(F.col("n") <= most).drop("n")


# ---- calibration


def interleave(questions: DataFrame) -> DataFrame:
    """Questions with their place when those of the corpus and others take turns, the corpus first."""
    outside = (F.col("label") != "in_corpus").cast("int")
    rows = placed(questions.withColumn("__outside", outside), ["__outside", "ordinal"], "__turn")
    counts = rows.agg(F.count_if(F.col("__outside") == 0).alias("__in"), F.count_if(F.col("__outside") == 1).alias("__out"))  # one row
    rows = rows.crossJoin(F.broadcast(counts)).withColumn("__turn", F.col("__turn") - F.col("__outside") * F.col("__in"))
    # before the t-th of the corpus are t - 1 of the others, before the t-th other t of the corpus, or all there are
    place = F.col("__turn") + F.when(F.col("__outside") == 0, F.least(F.col("__turn") - 1, "__out")).otherwise(F.least("__turn", "__in"))
    return rows.withColumn("place", place.cast("int")).drop("__outside", "__turn", "__in", "__out")


def project(rows: DataFrame, low: float, high: float) -> DataFrame:
    """What rows (top_dense, method, verdict) would be under other thresholds, by the evidence at hand: sufficient, basis."""
    s = F.col("top_dense")
    llm = F.col("method") == "llm"
    sufficient = F.when(s >= high, True).when(s < low, False).when(llm, F.col("verdict"))
    basis = F.when((s >= high) | (s < low), "score").when(llm, "recorded verdict").otherwise("pending")
    return rows.withColumn("sufficient", sufficient).withColumn("basis", basis)


def original_dense(provenance: DataFrame) -> DataFrame:
    """qid, top_dense_original: the best vector hit of the question itself, not of its variants."""
    own = provenance.filter((F.col("retriever") == "vector") & (F.col("query") == F.col("question")))
    return own.groupBy("qid").agg(F.max("score").alias("top_dense_original"))


# ---- stores, plans and manifests


def store_report(passages: DataFrame) -> DataFrame:
    """part, value, n: passages by method, type, both, suffix, suffix and method, and model, and the number of documents, in one pass."""
    rows = passages.withColumn("suffix", suffix(F.col("source_doc")))
    sets = [["extraction_method"], ["chunk_type"], ["extraction_method", "chunk_type"], ["suffix"], ["suffix", "extraction_method"], ["embedding_model"], ["source_doc"]]
    columns = ["extraction_method", "chunk_type", "suffix", "embedding_model", "source_doc"]
    out = rows.groupingSets([[F.col(c) for c in s] for s in sets], *columns).agg(F.count(F.lit(1)).alias("n"), *[F.grouping(c).alias(f"g_{c}") for c in columns])
    used = lambda c: F.when(F.col(f"g_{c}") == 0, F.coalesce(F.col(c), F.lit("none")))
    name = F.concat_ws("/", *[F.when(F.col(f"g_{c}") == 0, F.lit(c)) for c in columns])
    value = F.concat_ws("/", *[used(c) for c in columns])
    parts = out.select(name.alias("part"), value.alias("value"), "n")
    docs = parts.filter("part = 'source_doc'").agg(F.count(F.lit(1)).alias("n")).select(F.lit("documents").alias("part"), F.lit("").alias("value"), "n")
    return parts.filter("part <> 'source_doc'").unionByName(docs)


def token_spread(passages: DataFrame, tokens: Column) -> DataFrame:
    """suffix, passages, least, median, most, short: token counts by kind of document."""
    rows = passages.select(suffix(F.col("source_doc")).alias("suffix"), tokens.alias("t"))
    return rows.groupBy("suffix").agg(F.count(F.lit(1)).alias("passages"), F.min("t").alias("least"), F.floor(F.median("t")).cast("long").alias("median"), F.max("t").alias("most"), F.count_if(F.col("t") < SHORT_TOKENS).alias("short"))


def plan_summary(chosen: DataFrame, documents: DataFrame) -> DataFrame:
    """source_doc, chart_dense, selected, fallback, lowest, covered for every document of a page plan."""
    per = chosen.groupBy("source_doc").agg(F.count(F.lit(1)).alias("selected"), F.count_if("fallback").alias("fallback"), F.min("score").alias("lowest"))
    rows = documents.select("source_doc", "chart_dense").join(per, "source_doc", "left")
    return rows.select("source_doc", "chart_dense", F.coalesce("selected", F.lit(0)).alias("selected"), F.coalesce("fallback", F.lit(0)).alias("fallback"), "lowest", F.col("selected").isNotNull().alias("covered"))


def kind_counts(chosen: DataFrame) -> DataFrame:
    return chosen.groupBy("kind").agg(F.count(F.lit(1)).alias("pages"), F.count_distinct("source_doc").alias("documents"))


def manifest_counts(manifest: DataFrame) -> DataFrame:
    """doc_type, documents, chart_dense, pages by type and in all (doc_type 'all')."""
    out = manifest.rollup("doc_type").agg(F.grouping("doc_type").alias("g"), F.count(F.lit(1)).alias("documents"), F.count_if(F.col("has_tables_charts") == "yes").alias("chart_dense"), F.sum("pages").alias("pages"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("doc_type")).alias("doc_type"), "documents", "chart_dense", F.coalesce("pages", F.lit(0)).alias("pages"))


def manifest_findings(manifest: DataFrame, least: int, most: int, least_dense: int, types: tuple[str, ...] = ("pdf", "docx", "image")) -> DataFrame:
    """What is wrong with the whole: number of documents, chart-dense ones, types that are missing."""
    one = manifest.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("has_tables_charts") == "yes").alias("dense"), F.collect_set("doc_type").alias("types"))
    rules = [F.when(~F.col("n").between(least, most), F.lit("document count")), F.when(F.col("dense") < least_dense, F.lit("chart-dense documents")), *[F.when(~F.array_contains("types", t), F.lit(f"no {t}")) for t in types]]
    return one.select(F.explode(F.filter(F.array(*rules), lambda x: x.isNotNull())).alias("finding"))


def rewrite_pages(manifest: DataFrame, measured: DataFrame) -> DataFrame:
    """The manifest with the page counts that were measured."""
    new = measured.select("filename", F.col("pages").alias("new"))
    return manifest.join(new, "filename", "left").withColumn("pages", F.coalesce("new", "pages")).select(*manifest.columns)


def manifest_markdown(manifest: DataFrame) -> DataFrame:
    """One row: the manifest as a markdown table under its totals."""
    line = F.concat(F.lit("| "), F.concat_ws(" | ", "filename", "doc_type", F.coalesce(F.col("pages").cast("string"), F.lit("")), "has_tables_charts"), F.lit(" |"))
    out = manifest.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("pages"), F.lit(0)).alias("p"), F.array_sort(F.collect_list(line)).alias("lines"))  # a manifest is a short table
    head = F.concat(F.col("n").cast("string"), F.lit(" documents, "), F.col("p").cast("string"), F.lit(" pages\n\n| file | type | pages | tables or charts |\n| --- | --- | --- | --- |\n"))
    return out.select(F.concat(head, F.array_join("lines", "\n")).alias("markdown"))


def is_rechunked(passages: DataFrame) -> Column:
    """Passages that the naive baseline cuts anew; the others are taken over as they are."""
    return (F.col("chunk_type") == "text") & F.col("extraction_method").isin("text", "ocr")


def mark_chunking(passages: DataFrame, mark: str = "fixed") -> DataFrame:
    """Every row carries the mark; marked says which rows did not before."""
    own = F.coalesce(F.col("chunking") == mark, F.lit(False))
    return passages.withColumn("marked", ~own).withColumn("chunking", F.lit(mark))


def rebuild_stats(passages: DataFrame, pairs: DataFrame, windows: DataFrame) -> DataFrame:
    """One row: passages, groups and characters before, overlaps removed, windows and characters after a naive rebuild.

    Pairs are neighbours (overlap characters), windows the new passages (text).
    """
    before = passages.agg(F.count(F.lit(1)).alias("passages"), F.count_if(is_rechunked(passages)).alias("rechunked"), F.coalesce(F.sum(F.when(is_rechunked(passages), F.length("text"))), F.lit(0)).alias("chars"))
    lap = pairs.agg(F.count(F.lit(1)).alias("pairs"), F.count_if(F.col("overlap") > 0).alias("overlapping"), F.coalesce(F.sum("overlap"), F.lit(0)).alias("duplicate_chars"))
    after = windows.agg(F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("window_chars"))
    return before.join(F.broadcast(lap)).join(F.broadcast(after)).withColumn("merged_chars", F.col("chars") - F.col("duplicate_chars"))  # one row each
