"""The engine's facade: ingest texts, answer a batch of questions.

Everything is one DataFrame plan per batch; a single question is a batch of
one.  Early exits are filters, model-backed steps are provider functions.  An
engine is a value: what changes passages, cache or history gives a new one.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import chunk_id, sanitize, snippet, summarize_answer
from corvane.operators import answering, bm25, cache, chunking, citations, context, dense, extraction, fusion, guardrails, segments, sessions, store, sufficiency, web
from corvane.plans.providers import Providers, clean_variants, parse_json
from corvane.plans.stages import CallPolicy, called, events, log_of
from corvane.sources import documents
from corvane.sources.tables import file_system, saved, table_root
from corvane.sources.versions import VersionConflict, VersionedTable

TURNS = "session_id string, turn long, ts double, resolved_question string, answer_summary string"
CACHE = "entry_id string, corpus_scope string, question string, answer string, cited_docs array<string>, embedding array<double>"


@dataclass(frozen=True)
class Settings:
    top_k: int = 20
    dense_weight: float = 0.5
    rrf_k: int = 60
    shortlist: int = 20
    passages: int = 8
    budget: int = 3_000
    chunk_size: int = 500
    chunk_overlap: int = 50
    chunk_least: int = 200
    cache_threshold: float = 0.96
    cache_most: int = 5
    sub_questions: int = 3
    web_results: int = 5
    web_relevance: float = 0.30
    gate: sufficiency.Gate = field(default_factory=sufficiency.Gate)

    def __post_init__(self) -> None:
        if not 0 <= self.dense_weight <= 1:
            raise ValueError("dense_weight lies between 0 and 1")
        if not self.chunk_overlap < self.chunk_size:
            raise ValueError("the overlap is shorter than the chunk")
        if not self.gate.low <= self.gate.high:
            raise ValueError("the low threshold is not above the high one")

    def override(self, **values: object) -> Settings:
        """A copy with allow-listed values cast to the field's type."""
        unknown = set(values) - set(self.__dataclass_fields__)
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **{k: type(getattr(self, k))(v) if k != "gate" else v for k, v in values.items()})


CALLS = "qid string, stage string, error string, attempts int, seconds double, prompt_tokens long, output_tokens long"


def twice(verify: Callable[[], str | None]) -> str | None:
    """A verifier's reply, asked for once more where it has no safety verdict."""
    reply = None
    for _ in range(2):
        reply = verify()
        parsed = parse_json(reply) if isinstance(reply, str) else None
        said = parsed.get("safety") if isinstance(parsed, dict) else None
        if isinstance(said, dict) and said.get("verdict") in ("pass", "fail"):
            break
    return reply


class Engine:
    """Passages (chunk_id, source_doc, corpus_scope, text, embedding, ...), cached answers, history, and the operations on them."""

    def __init__(self, spark: SparkSession, passages: DataFrame | None = None, settings: Settings = Settings(), providers: Providers = Providers(), cached: DataFrame | None = None, turns: DataFrame | None = None, policy: CallPolicy = CallPolicy()) -> None:
        self.spark, self.passages, self.settings, self.providers, self.policy = spark, passages, settings, providers, policy
        self._log: list[DataFrame] = []
        self.cached = spark.createDataFrame([], CACHE) if cached is None else cached
        self.turns = spark.createDataFrame([], TURNS) if turns is None else turns
        self._index: segments.SegmentedIndex | None = None

    def _with(self, **changes: DataFrame) -> Engine:
        own = {"passages": self.passages, "cached": self.cached, "turns": self.turns} | changes
        new = Engine(self.spark, own["passages"], self.settings, self.providers, own["cached"], own["turns"], self.policy)
        if "passages" not in changes:
            new._index = self._index
        return new

    @property
    def index(self) -> segments.SegmentedIndex:
        """The keyword index of all passages, written when it is first asked for; later changes of the passages add to it."""
        if self._index is None:
            root = f"{table_root(self.spark)}/tables/keywords-{uuid.uuid4().hex}"
            store = VersionedTable(self.spark, root)
            store.system.deleteOnExit(file_system(self.spark, root)[1])
            self._index = segments.SegmentedIndex(store).add(self.passages, "chunk_id")
        return self._index

    def _changed(self, passages: DataFrame, gone: DataFrame, new: DataFrame | None = None, **changes: DataFrame) -> Engine:
        """With other passages; an index that exists gets tombstones for those gone and a segment of the new.

        Its versions form a line: where a second engine is made from one, its index is built anew when asked for.
        """
        out = self._with(passages=passages, **changes)
        if self._index is not None:
            with contextlib.suppress(VersionConflict):
                out._index = self._index.delete(gone, "chunk_id") if new is None else self._index.replace(gone, new, "chunk_id")
        return out

    def _call(self, stage: str, call: Callable, kind: str, *columns: Column | str) -> Column:
        """The struct of a provider's call for each row: a failing one has no value, and its row alone."""
        return called(call, kind, *columns, policy=self.policy, scope=stage)

    @property
    def calls(self) -> DataFrame:
        """The provider calls of the run that gave this engine: qid, stage, error, attempts, seconds, tokens."""
        return reduce(DataFrame.unionByName, self._log) if self._log else self.spark.createDataFrame([], CALLS)

    # ---- documents

    def ingest(self, files: DataFrame, scope: str = "persistent") -> Engine:
        """Texts (source_doc, text) replace earlier versions of their documents; files without text keep theirs."""
        s = self.settings
        good = files.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
        cut = chunking.split_documents(good, "source_doc", s.chunk_size, s.chunk_overlap, s.chunk_least)
        cut = cut.withColumn("extraction_method", F.lit("text")).withColumn("page", F.lit(None).cast("int"))
        return self._stored(cut, good.select("source_doc").distinct(), scope)

    def _stored(self, cut: DataFrame, done: DataFrame, scope: str) -> Engine:
        """Passages without ids (source_doc, extraction_method, chunk_type, page, location, chunk_index, text) in the place of those of the documents that are done."""
        ids = chunk_id(F.lit(scope), F.col("source_doc"), F.col("extraction_method"), F.col("chunk_type"), F.col("page"), F.col("location"), F.col("chunk_index"), F.col("text"))
        rows = cut.select(ids.alias("chunk_id"), "source_doc", F.lit(scope).alias("corpus_scope"), "extraction_method", "chunk_type", "page", "location", "text", "chunk_index")
        rows = store.keep_first(rows, ["chunk_id"], ["source_doc", "chunk_index"]).drop("chunk_index")
        # one embedding per distinct text
        rows = rows.join(self._embedded(rows.select("text").distinct(), "text"), "text")
        rows = saved(rows, "passages")
        if self.passages is None:
            return self._with(passages=rows)
        other = self.passages.filter(F.col("corpus_scope") != scope)
        held = self.passages.filter(F.col("corpus_scope") == scope)
        own = store.replace_documents(held, rows, done)
        return self._changed(saved(own.unionByName(other), "passages"), held.join(done, "source_doc", "left_semi"), rows)

    def ingest_pieces(self, pieces: DataFrame, done: DataFrame, scope: str = "persistent") -> Engine:
        """Pieces (source_doc, page, location, text, chunk_type, extraction_method) of the documents that are ``done`` (source_doc).

        Charts and captions are passages as they are, all else is split; blank
        pieces go.  A document that is done loses its earlier passages even
        where it has no piece; of others nothing is stored or lost.
        """
        s = self.settings
        good = pieces.join(done.select("source_doc").distinct(), "source_doc", "left_semi").filter(extraction.trim_all(F.coalesce("text", F.lit(""))) != "")
        atomic = F.col("chunk_type").isin(*extraction.ATOMIC)
        whole = good.filter(atomic).select("source_doc", "page", "location", "extraction_method", "chunk_type", F.lit(0).alias("chunk_index"), "text")
        keyed = good.filter(~F.coalesce(atomic, F.lit(False))).select(F.struct("source_doc", "page", "location", "extraction_method").alias("piece"), "text")
        cut = chunking.split_documents(keyed, "piece", s.chunk_size, s.chunk_overlap, s.chunk_least)
        place = F.coalesce("location", F.col("piece.location"))
        cut = cut.select("piece.source_doc", "piece.page", place.alias("location"), "piece.extraction_method", "chunk_type", "chunk_index", "text")
        return self._stored(whole.unionByName(cut), done.select("source_doc").distinct(), scope)

    def ingest_folder(self, path: str, plan: DataFrame | None = None, seen: DataFrame | None = None, scope: str = "persistent") -> tuple[Engine, DataFrame, DataFrame]:
        """A folder's DOCX and PDF files; (engine, outcomes, units).

        ``outcomes`` has a row for each file, with its error where it failed; a
        failed file keeps its earlier passages.  ``units`` are what needs a
        model: source_doc, page or picture number, and whether OCR or vision
        should read it; ``plan`` (source_doc, page) says which pages go to
        vision.  What was read of such units comes in as ``seen`` pieces.
        """
        found = saved(documents.read_documents(self.spark, path), "pieces")
        outcomes = documents.outcomes(found)
        plan = self.spark.createDataFrame([], "source_doc string, page int") if plan is None else plan
        pages = extraction.route_pages(documents.pdf_pages(found), plan)
        texts = pages.filter("keeps_text").select("source_doc", "page", "text").unionByName(found.filter("kind = 'text'").select(F.col("filename").alias("source_doc"), F.lit(None).cast("int").alias("page"), "text"))
        texts = texts.select("*", F.lit(None).cast("string").alias("location"), F.lit("text").alias("chunk_type"), F.lit("text").alias("extraction_method"))
        pieces = texts if seen is None else texts.unionByName(seen.select(*texts.columns))
        none = F.lit(None).cast("int")
        units = pages.filter("to_ocr OR to_vision").select("source_doc", "page", none.alias("number"), F.when(F.col("to_ocr"), "ocr").otherwise("vision").alias("reader"))
        units = units.unionByName(found.filter("kind = 'picture'").select(F.col("filename").alias("source_doc"), none.alias("page"), "number", F.lit("vision").alias("reader")))
        done = outcomes.filter("error IS NULL").select(F.col("filename").alias("source_doc"))
        return self.ingest_pieces(pieces, done, scope), outcomes, units

    def delete(self, source_doc: str, scope: str = "persistent") -> Engine:
        """Without the document's passages, and without cached answers of the scope that cite it."""
        gone = self.passages.filter((F.col("source_doc") == source_doc) & (F.col("corpus_scope") == scope))
        return self._changed(store.delete_by_document(self.passages, source_doc, scope), gone, cached=store.invalidate(self.cached, source_doc, scope))

    def remove(self, source_doc: str, scope: str = "persistent") -> tuple[Engine, dict[str, int]]:
        """``delete``, with how many passages and cached answers went; a document that is not there is a LookupError."""
        gone = self.passages.filter((F.col("source_doc") == source_doc) & (F.col("corpus_scope") == scope)).count()
        if not gone:
            raise LookupError(f"no document named {source_doc!r} in {scope}")
        out = self.delete(source_doc, scope)
        return out, {"deleted_chunks": gone, "invalidated_cache_entries": self.cached.count() - out.cached.count()}

    def drop_session(self, session_id: str) -> Engine:
        passages, cached, turns = sessions.drop_session(self.passages, self.cached, self.turns, session_id)
        gone = self.passages.filter(F.col("corpus_scope") == f"session:{session_id}")
        return self._changed(passages, gone, cached=cached, turns=turns)

    def documents(self, scope: str | None = None) -> DataFrame:
        return store.documents(self.passages if scope is None else self.passages.filter(F.col("corpus_scope") == scope))

    def _embedded(self, rows: DataFrame, text: str, out: str = "embedding") -> DataFrame:
        """With a vector of the text, null where the provider failed: such rows are met by keywords alone."""
        return rows.withColumn(out, self._call("embedding", self.providers.embed, "array<double>", text)["value"])

    # ---- before retrieval

    def screen(self, questions: DataFrame) -> DataFrame:
        """qid, question, verdict, reply kind: the checks that need no retrieval.  The classifier fails open."""
        clean = sanitize(F.col("question"))
        verdict = guardrails.input_verdict(F.col("question"))
        rows = questions.select("qid", clean.alias("question"), verdict.alias("verdict"), guardrails.greeting_kind(F.col("question")).alias("small_talk"), guardrails.looks_compound(clean).alias("compound"))
        rows = saved(rows.withColumn("guard_call", self._call("input_guardrail", self.providers.unsafe, "string", "question")), "guarded")
        unsafe = answering.unsafe_input(F.col("guard_call.value"))
        return rows.withColumn("verdict", F.when((F.col("verdict") == "allowed") & unsafe, "unsafe").otherwise(F.col("verdict")))

    def resolve(self, questions: DataFrame) -> DataFrame:
        """Questions (qid, question, session_id) with the question that their session's last turns make of it; raw_question is as asked."""
        resolve = self.providers.resolve
        told = answering.render_turns(self.turns, "session_id").join(self.turns.groupBy("session_id").agg(F.count(F.lit(1)).alias("n_turns")), "session_id")
        rows = questions.join(told, "session_id", "left")
        rows = saved(rows.withColumn("resolve_call", self._call("query_history", lambda q, c: None if c is None else resolve(q, c), "string", "question", "conversation")), "told")
        rows = rows.withColumn("rewritten", F.col("resolve_call.value")).withColumn("raw_question", F.col("question"))
        return rows.withColumn("question", answering.resolved_question(F.col("question"), F.col("rewritten"), F.coalesce("n_turns", F.lit(0)))).drop("rewritten", "conversation", "n_turns")

    def lookup(self, questions: DataFrame) -> DataFrame:
        """qid, entry_id, score: the cached answer to each question (qid, question, scope), by likeness and equal numbers."""
        s = self.settings
        asked = self._embedded(questions.select("qid", "question", F.col("scope").alias("corpus_scope")), "question", "query_vector")
        near = dense.cosine_top_k(self.cached.filter("embedding IS NOT NULL"), asked, s.cache_most, key="entry_id", query_key="qid", scope="corpus_scope")
        rows = near.select("qid", "entry_id", "score").join(questions.select("qid", "question"), "qid").join(self.cached.select("entry_id", F.col("question").alias("entry_question")), "entry_id")
        return cache.lookup(rows, s.cache_threshold, s.cache_most)

    def sub_questions(self, questions: DataFrame) -> DataFrame:
        """(qid, part, sub, question, scope): the parts of compound questions, else the question itself as part 0; ``part`` is a key of its own."""
        decompose, most = self.providers.decompose, self.settings.sub_questions
        split = lambda q, compound: clean_variants(decompose(q), q, most) if compound else []
        rows = saved(questions.withColumn("decompose_call", self._call("decomposition", split, "array<string>", "question", "compound")), "decomposed")
        self._log.append(log_of(rows, "decomposition", "decompose_call"))
        rows = rows.withColumn("parts", F.coalesce("decompose_call.value", F.array().cast("array<string>")))
        parts = F.when(F.size("parts") > 1, F.transform("parts", lambda x, i: F.struct((i + 1).cast("int").alias("sub"), x.alias("q")))).otherwise(F.array(F.struct(F.lit(0).alias("sub"), F.col("question").alias("q"))))
        rows = rows.select("qid", "scope", F.explode(parts).alias("p"))
        return rows.select("qid", F.concat_ws("/", F.col("qid").cast("string"), F.col("p.sub").cast("string")).alias("part"), "p.sub", F.col("p.q").alias("question"), "scope")

    # ---- retrieval

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """The long table of hits of both channels for questions (qid, question, scope), each in its scope; keyword statistics span all scopes."""
        s, expand = self.settings, self.providers.expand
        rows = self.passages
        asked = questions.select(F.col("qid").alias("item_id"), F.col("question").alias("text"))
        kw = self.index.scores(asked, key="chunk_id").join(rows.select("chunk_id", "corpus_scope"), "chunk_id")
        kw = kw.join(questions.select(F.col("qid").alias("item_id"), F.col("scope").alias("corpus_scope")), ["item_id", "corpus_scope"], "left_semi")
        kw = bm25.top_k(kw, s.top_k, key="chunk_id").select(F.col("item_id").alias("qid"), F.lit("keyword").alias("retriever"), F.lit("").alias("query"), "chunk_id", "score")
        variants = self._call("query_expansion", lambda q: list(expand(q)), "array<string>", "question")
        lists = saved(questions.select("qid", F.col("scope").alias("corpus_scope"), "question", variants.alias("expand_call")), "expanded")
        self._log.append(log_of(lists, "query_expansion", "expand_call"))
        every = F.array_distinct(F.concat(F.array("question"), F.coalesce("expand_call.value", F.array().cast("array<string>"))))
        lists = lists.select("qid", "corpus_scope", F.explode(every).alias("query"))
        lists = saved(self._embedded(lists.withColumn("list", F.sha2(F.concat_ws("\x00", F.col("qid").cast("string"), "query"), 256)), "query", "query_vector"), "lists")
        near = dense.cosine_top_k(rows, lists, s.top_k, key="chunk_id", query_key="list", scope="corpus_scope")
        near = near.join(lists.select("list", "qid", "query"), "list").select("qid", F.lit("vector").alias("retriever"), "query", "chunk_id", "score")
        return kw.unionByName(near)

    def assess(self, questions: DataFrame, hits: DataFrame, candidates: DataFrame) -> DataFrame:
        """Scores and decision per question; a grey one asks the provider, which sees the first passages; a session's low score does not decide."""
        s, verdict = self.settings, self.providers.verdict
        scores = questions.select("qid", "question", F.col("scope").startswith("session:").alias("session")).join(sufficiency.compute_scores(hits), "qid", "left").withColumn("candidates", F.coalesce("candidates", F.lit(0)))
        first = sufficiency.decide(scores, s.gate, session=F.col("session"))
        shown = answering.gate_passages(candidates).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("place", "text"))).alias("p"))
        grey = first.filter("method = 'fallback'").select("qid", "question").join(shown, "qid", "left")
        texts = F.coalesce(F.transform("p", lambda x: x["text"]), F.array().cast("array<string>"))
        said = saved(grey.select("qid", self._call("sufficiency", lambda q, t: verdict(q, list(t)), "string", "question", texts).alias("call")), "verdicts")
        self._log.append(log_of(said, "sufficiency", "call"))
        said = said.select("qid", F.coalesce(answering.parse_verdict(F.col("call.value"))["verdict"], F.col("call.value")).alias("verdict"))
        return sufficiency.decide(scores.join(said, "qid", "left"), s.gate, session=F.col("session"), verdict=F.col("verdict"))

    def search_web(self, questions: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(qid, chunk_id, text, title, source_url, position of web results for questions (qid, question), the qids of which nothing found was relevant); whatever fails finds nothing."""
        p = self.providers
        rows = questions.join(web.excerpts(candidates.withColumn("source", F.lit("corpus"))), "qid", "left")
        rows = saved(rows.withColumn("rewrite_call", self._call("web_query", lambda q, e: p.rewrite(q, e) if e else None, "string", "question", "excerpts")), "rewritten")
        self._log.append(log_of(rows, "web_query", "rewrite_call"))
        rows = rows.withColumn("rewritten", F.col("rewrite_call.value"))
        rows = rows.withColumn("w", web.web_query(F.col("question"), F.col("rewritten"), F.col("excerpts"))).select("qid", "w.query", "w.contextual")

        def search(query: str) -> list[dict]:
            return [{k: str(r.get(k) or "") for k in ("url", "title", "content")} for r in p.web(query)]

        found = saved(rows.withColumn("web_call", self._call("web_search", search, "array<struct<url:string,title:string,content:string>>", "query")), "web")
        self._log.append(log_of(found, "web_search", "web_call"))
        each = found.select("qid", "query", F.col("contextual").alias("rewritten"), F.posexplode("web_call.value").alias("position", "x")).select("qid", "query", "rewritten", "position", "x.*")
        each = self._embedded(web.normalize(each), "query", "query_vector").withColumn("vector", self._call("web_relevance", p.embed, "array<double>", F.concat_ws(". ", "title", "content"))["value"])
        scored = saved(web.score_relevance(each), "web-scored")
        kept = web.relevant(scored, self.settings.web_relevance)
        off_topic = scored.select("qid").distinct().join(kept.select("qid"), "qid", "left_anti")
        return kept.select("qid", F.col("web_id").alias("chunk_id"), F.col("content").alias("text"), "title", F.col("canonical").alias("source_url"), F.col("rank").alias("position")), off_topic

    def rank(self, questions: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(passages of the prompt, decision) for questions (qid, question, scope): both channels fused, the web where they do not suffice, ranked anew.

        The decision has ``empty_web``, where the web had only what is off the
        topic.  A question whose reranking failed keeps the fused order.
        """
        s, score = self.settings, self.providers.rerank
        hits = saved(self.retrieve(questions), "hits")
        fused = fusion.fuse(hits, s.dense_weight, s.rrf_k).filter(F.col("position") <= s.shortlist)
        texts = saved(fused.join(self.passages.select("chunk_id", "text", "source_doc", "location", "page"), "chunk_id"), "fused")
        enough = saved(self.assess(questions, hits, texts), "decided")
        asking = questions.join(enough.filter("NOT sufficient").select("qid"), "qid", "left_semi")
        found, off_topic = self.search_web(asking, texts)
        found = found.filter(F.col("position") <= s.web_results)
        enough = enough.join(off_topic.withColumn("empty_web", F.lit(True)), "qid", "left").withColumn("empty_web", F.coalesce("empty_web", F.lit(False)))
        corpus = texts.select("qid", "chunk_id", F.lit("corpus").alias("source"), "position", "text", "source_doc", "page", F.lit(None).cast("string").alias("source_url"))
        both = corpus.unionByName(found.select("qid", "chunk_id", F.lit("web").alias("source"), "position", "text", F.lit(None).cast("string").alias("source_doc"), F.lit(None).cast("int").alias("page"), "source_url"))
        pool = context.rerank_pool(both).join(questions.select("qid", "question"), "qid")
        pool = saved(pool.withColumn("rerank_call", self._call("rerank", lambda q, t: float(score(q, t)), "double", "question", "text")), "candidates")
        self._log.append(log_of(pool, "rerank", "rerank_call"))
        broken = pool.filter("rerank_call.error IS NOT NULL").select("qid").distinct().withColumn("broken", F.lit(True))
        pool = pool.join(broken, "qid", "left").withColumn("score", F.when(F.col("broken"), 0.0).otherwise(F.col("rerank_call.value")))
        order = F.struct((-F.col("score")).alias("s"), "pool_position").alias("position")
        kept = context.consolidate(pool.select("qid", "chunk_id", "text", order), s.passages, s.budget)
        fields = pool.select("qid", "chunk_id", "text", F.col("source").alias("kind"), "source_doc", "page", "source_url", "score")
        return saved(kept.select("qid", "passage", "chunk_id").join(fields, ["qid", "chunk_id"]), "context"), enough

    # ---- answers

    def run(self, questions: DataFrame, bypass_cache: bool = False) -> tuple[DataFrame, Engine]:
        """(results, engine afterwards) for questions (qid, question and, if any, session_id).

        Results: qid, status (failed where no answer could be generated), answer, sufficient, n_citations, removed,
        groundedness, output_verdict, cache_hit, not_cached (why the answer is
        not kept).  ``bypass_cache`` skips both its lookup and its write.
        """
        if "session_id" not in questions.columns:
            questions = questions.withColumn("session_id", F.lit(None).cast("string"))
        self._log = []
        seen = saved(self.screen(questions).join(questions.select("qid", "session_id"), "qid"), "screened")
        self._log.append(log_of(seen, "input_guardrail", "guard_call"))
        open_ = seen.filter((F.col("verdict") == "allowed") & F.col("small_talk").isNull())
        asked = saved(answering.select_scope(self.resolve(open_), self.passages), "resolved")
        self._log.append(log_of(asked, "query_history", "resolve_call"))
        held = self.spark.createDataFrame([], f"qid {dict(asked.dtypes)['qid']}, entry_id string, score double") if bypass_cache else self.lookup(asked)
        held = saved(held, "cache-hits")
        todo = asked.join(held.select("qid"), "qid", "left_anti")
        parts = saved(self.sub_questions(todo), "parts")
        passages, enough = self.rank(parts.select(F.col("part").alias("qid"), "question", "scope"))
        own = passages.withColumnRenamed("qid", "part").join(parts.select("part", "qid", "sub"), "part")
        numbered = context.number_passages(own.select("qid", "chunk_id", F.col("sub").alias("list_no"), F.col("passage").alias("position")))
        refs = saved(answering.merge_sub_contexts(own.withColumnRenamed("passage", "position"), todo.filter("false")).join(numbered, ["qid", "chunk_id"]), "refs")
        decided = enough.withColumnRenamed("qid", "part").join(parts.select("part", "qid"), "part").groupBy("qid").agg(F.bool_and("sufficient").alias("sufficient"), F.bool_or("empty_web").alias("empty_web"))
        decided = saved(decided, "decisions")
        final = self._answers(todo, refs, decided)
        final = saved(final.join(decided.drop("empty_web"), "qid", "left"), "answers")
        results = saved(self._results(seen, held, final), "results")
        after = self._after(asked, final, results, bypass_cache)
        after._log = list(self._log)
        return results, after

    def responses(self, results: DataFrame) -> DataFrame:
        """What ``run`` returned, asked of the engine that it returned, with the stages of each question in order: stage, status, duration_ms."""
        rows = results.withColumn("__qid", F.col("qid")).withColumn("qid", F.col("qid").cast("string"))
        return answering.response(rows, events(self.calls)).drop("qid").withColumnRenamed("__qid", "qid")

    def answer(self, questions: DataFrame, bypass_cache: bool = False) -> DataFrame:
        return self.run(questions, bypass_cache)[0]

    def _answers(self, asked: DataFrame, refs: DataFrame, decided: DataFrame) -> DataFrame:
        """Drafts, checked for structure, support and form: qid, answer, n_citations, removed, groundedness, output_verdict, blockers, cited."""
        p = self.providers
        lists = refs.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("number", "text"))).alias("p"))
        drafts = asked.join(lists, "qid", "left").withColumn("texts", F.coalesce(F.transform("p", lambda x: x["text"]), F.array().cast("array<string>")))
        none = guardrails.NON_ANSWERS[0]
        drafts = saved(drafts.select("qid", "scope", self._call("generation", lambda q, t: p.answer(q, list(t)) if len(t) else none, "string", "question", "texts").alias("call")), "drafts")
        self._log.append(log_of(drafts, "generation", "call"))
        drafts = drafts.select("qid", "scope", F.col("call.value").alias("answer"), F.col("call.error").isNotNull().alias("failed"))
        checked, cited = citations.filter_with_citations(drafts.select("qid", "answer"), refs.select("qid", "number", "kind", "source_doc", "page", "source_url", "score"))
        checked, cited = saved(checked, "checked"), saved(cited.join(refs.drop("position").withColumnRenamed("number", "passage"), ["qid", "passage"]), "cited")
        # every claim with its evidence goes to the verifier, all of an answer at once
        claim_rows = answering.claim_markers(checked)
        proof = answering.evidence(claim_rows, cited.select("qid", "number", "kind", F.col("chunk_id").alias("key"), "source_doc", "page", "source_url", snippet(F.col("text")).alias("snippet")), refs.select(F.col("chunk_id").alias("key"), "text").distinct())
        sides = claim_rows.join(proof, ["qid", "claim"]).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("claim", "text", "evidence"))).alias("c"))
        sides = sides.select("qid", F.transform("c", lambda x: x["text"]).alias("claims"), F.transform("c", lambda x: x["evidence"]).alias("evidence"))
        replies = saved(sides.select("qid", self._call("verification", lambda c, e: twice(lambda: p.verify(list(c), list(e))), "string", "claims", "evidence").alias("call")), "replies")
        self._log.append(log_of(replies, "verification", "call"))
        replies = replies.select("qid", F.col("call.value").alias("reply"))
        judged, scores = answering.verify(claim_rows.select("qid", "claim"), replies, citations.verdicts(replies))
        kept = answering.drop_unsupported(checked, judged)
        rows = checked.select("qid", F.col("n_citations").alias("before"), F.col("removed").alias("uncited")).join(kept, "qid", "left").join(scores.select("qid", F.col("score").alias("groundedness"), "safety"), "qid", "left")
        rows = rows.join(drafts.select("qid", "scope", "failed"), "qid").join(decided.select("qid", "empty_web"), "qid", "left")
        rows = guardrails.output_verdicts(rows, "answer", "output_verdict")
        webs = cited.groupBy("qid").agg(F.bool_or(F.col("kind") == "web").alias("web"), F.array_sort(F.collect_set("source_doc")).alias("docs"))
        rows = rows.join(webs, "qid", "left")
        passed = F.col("output_verdict").isin("ok", "non_answer") & (F.coalesce("safety", F.lit("pass")) == "pass")
        why = answering.blockers(passed, F.col("is_non_answer") | (F.col("output_verdict") == "non_answer"), F.col("n_citations"), F.col("safety").isNotNull(), F.col("scope"), F.col("web"), F.col("empty_web"))
        noted = answering.note_empty_web(F.col("answer"), F.col("n_citations"), F.coalesce("empty_web", F.lit(False)))
        return rows.select("qid", noted.alias("answer"), "failed", "n_citations", (F.col("removed") + F.col("uncited")).alias("removed"), "groundedness", F.when(passed, F.col("output_verdict")).otherwise(F.when(F.col("output_verdict").isin("ok", "non_answer"), "unsafe").otherwise(F.col("output_verdict"))).alias("output_verdict"), why.alias("not_cached"), F.coalesce("docs", F.array().cast("array<string>")).alias("docs"))

    def _results(self, seen: DataFrame, held: DataFrame, final: DataFrame) -> DataFrame:
        from_cache = held.join(self.cached.select("entry_id", F.col("answer").alias("cached_answer")), "entry_id").select("qid", "cached_answer")
        out = seen.join(final.drop("docs"), "qid", "left").join(from_cache, "qid", "left")
        hit = F.col("cached_answer").isNotNull()
        status = (
            F.when(F.col("verdict") != "allowed", F.concat(F.lit("rejected:"), "verdict"))
            .when(F.col("small_talk").isNotNull(), F.col("small_talk"))
            .when(hit, "cached")
            .when(F.col("failed"), "failed")
            .when(F.col("output_verdict").isin("ok", "non_answer"), "answered")
            .otherwise("fallback")
        )
        answer = F.when(hit, F.col("cached_answer")).when(status == "answered", F.col("answer"))
        return out.select("qid", status.alias("status"), answer.alias("answer"), "sufficient", "n_citations", "removed", "groundedness", "output_verdict", hit.alias("cache_hit"), "not_cached")

    def _after(self, asked: DataFrame, final: DataFrame, results: DataFrame, bypass_cache: bool) -> Engine:
        """The engine with new cache entries and turns."""
        rows = asked.join(final.select("qid", "answer", "not_cached", "docs"), "qid")
        good = rows.filter(F.size("not_cached") == 0)
        cites = F.transform("docs", lambda d: F.struct(F.lit("corpus").alias("kind"), d.alias("source_doc")))
        fresh = good.select(F.col("scope").alias("corpus_scope"), "question", "answer", cites.alias("citations"), F.col("qid").alias("seq"))
        cached = self.cached
        if not bypass_cache:
            entries = cache.put(self.cached.drop("embedding"), fresh)
            known = self.cached.select("entry_id", "question", F.col("embedding").alias("held"))
            entries = entries.join(known, ["entry_id", "question"], "left").withColumn("embedding", F.coalesce("held", self._call("embedding", self.providers.embed, "array<double>", "question")["value"])).drop("held")
            cached = saved(entries.select(*self.cached.columns), "cache")
        told = results.filter("status IN ('answered', 'cached')").select("qid", F.col("answer").alias("said"))
        new = asked.filter("session_id IS NOT NULL").join(told, "qid")
        last = self.turns.groupBy("session_id").agg(F.max("turn").alias("last"))
        new = new.join(last, "session_id", "left").select("session_id", (F.coalesce("last", F.lit(0)) + F.row_number().over(Window.partitionBy("session_id").orderBy("qid"))).cast("long").alias("turn"), F.unix_micros(F.current_timestamp()).cast("double").alias("us"), F.col("question").alias("resolved_question"), summarize_answer(F.col("said")).alias("answer_summary"))
        new = new.select("session_id", "turn", (F.col("us") / 1e6).alias("ts"), "resolved_question", "answer_summary")
        return self._with(cached=cached, turns=saved(sessions.record_turn(self.turns, new), "turns"))
