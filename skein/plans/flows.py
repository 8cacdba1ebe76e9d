"""Whole runs: building an index of a project, retrieving, answering, analysing.

Each recall is one Spark job over all given questions; which recall comes next
may depend on the rows of the one before, so the driver decides between jobs.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from skein import schema as S
from skein.functions import text as T
from skein.functions.state import durable
from skein.models import ChatModel, Embedder
from skein.operators import assist, context, diversify, rank, search, vector, vocab
from skein.operators.index import Index, embed
from skein.sources import config, parse, scan

STATE = T_.StructType().add("project", "string").add("relative_path", "string").add("mtime_ms", "double").add("size", "long")
_FIELDS = ("project", "file_path", "type", "name", "content", "start_line", "end_line")


@dataclass
class Stats:
    """Counters of embedding calls, of the driver and of index builds."""

    calls: int = 0
    failed: int = 0
    attempts: int = 0
    first: int = 0
    ms: float = 0.0

    def add(self, calls: int, failed: int, attempts: float, first: float, ms: float) -> None:
        self.calls += calls
        self.failed += failed
        self.attempts += round(attempts)
        self.first += round(first)
        self.ms += ms

    def summary(self) -> dict:
        n = self.calls - self.failed
        return {"calls": self.calls, "failed": self.failed, "average_attempts": round(self.attempts / n, 2) if n else 0.0, "first_try_percent": round(100 * self.first / n, 1) if n else 0.0, "average_ms": round(self.ms / n, 1) if n else 0.0}


@dataclass
class Engine:
    """An index in ``root`` with its models."""

    spark: SparkSession
    root: str
    embedder: Embedder
    chat_model: ChatModel | None = None
    stats: Stats = field(default_factory=Stats)

    @property
    def index(self) -> Index:
        return Index(self.spark, f"{self.root}/units")

    def units(self) -> DataFrame:
        found = self.index.read()
        return found if found is not None else self.spark.createDataFrame([], S.UNITS)

    # building -------------------------------------------------------------

    def build(self, project: config.Project, incremental: bool = False, limit: int | None = None) -> dict:
        """Indexes a project's folder; of an incremental run only new, changed and deleted files.

        State is kept for files whose units were all embedded, so the others are
        tried again by the next incremental run.
        """
        listed = durable(scan.scan(self.spark, project.path, content=False).select(F.lit(project.id).alias("project"), "path", "relative_path", "extension", "size", "mtime_ms"))
        keys, state = ["project", "relative_path"], self.state(project.id)
        partial = incremental and state is not None
        if partial:
            both = listed.alias("n").join(state.alias("o"), keys, "full_outer")
            same = F.col("n.mtime_ms").eqNullSafe(F.col("o.mtime_ms")) & F.col("n.size").eqNullSafe(F.col("o.size"))
            touched = both.where(~same).select(*keys)
            chosen = listed.join(touched, keys, "left_semi")
        else:
            chosen = listed.orderBy("path").limit(limit) if limit else listed
            touched = chosen.select(*keys)
        chosen = durable(scan.with_texts(chosen)) if partial or limit else scan.with_texts(chosen)
        done = durable(embed(parse.parsed(chosen), self.embedder))
        failed = done.where("error is not null")
        good = F.col("error").isNull()
        row = done.agg(F.count_if(good).alias("units"), F.count_if(~good).alias("failed"), F.sum(F.when(good, F.col("attempts"))).alias("attempts"), F.count_if(good & (F.col("attempts") == 1)).alias("first"), F.sum(F.when(good, F.col("ms"))).alias("ms")).first()
        counts = {"units": row.units, "failed": row.failed, "files": chosen.count()}
        self.stats.add(row.units + row.failed, row.failed, row.attempts or 0, row.first or 0, row.ms or 0.0)
        kept = listed.join(chosen.select(*keys), keys, "left_semi").join(failed.select(*keys).distinct(), keys, "left_anti").select(*keys, "mtime_ms", "size")
        if partial:
            self.index.replace(done.where("error is null"), touched)
            kept = kept.unionByName(state.join(touched, keys, "left_anti").select(*kept.columns))
        else:
            self.index.replace_project(project.id, done.where("error is null"))
        try:
            self._state._manifest()
        except Exception:  # a state that cannot be read is begun anew
            self._state.clear()
        self._state.replace_project(project.id, kept)
        for stored in (self.index, self._state):
            stored.vacuum()
        return counts

    @property
    def _state(self) -> Index:
        return Index(self.spark, f"{self.root}/state", STATE)

    def state(self, project: str | None = None) -> DataFrame | None:
        """What the last build recorded about files, of one project or of all; None where nothing was or it cannot be read."""
        try:
            if project is not None and self._state._folder(project) not in self._state._manifest():
                return None
            return self._state.read([project] if project is not None else None)
        except Exception:
            return None

    # retrieving -----------------------------------------------------------

    def embedded(self, questions: list[str]) -> DataFrame:
        began = time.perf_counter()
        vectors = self.embedder.embed(questions)
        attempts = list(getattr(self.embedder, "attempts", None) or [1] * len(questions))
        self.stats.add(len(questions), 0, sum(attempts), attempts.count(1), 1000 * (time.perf_counter() - began))
        return self.spark.createDataFrame([(i, q, [float(x) for x in v]) for i, (q, v) in enumerate(zip(questions, vectors))], "query_id long, query string, vector array<float>")

    def search(self, questions: list[str], limit: int = 10, **filters) -> DataFrame:
        """(query_id, query, rank, score and fields of units)."""
        q, u = self.embedded(questions), self.units()
        hits = vector.search(q, u, limit, **filters).select("query_id", "id", "score", "rank")
        rows = vector.with_fields(hits, u, *_FIELDS, "dependencies")
        return rows.join(q.select("query_id", "query"), "query_id").withColumn("similarity", 1 - F.col("score"))

    def display(self, questions: list[str], limit: int = 10, verbose: bool = False, **filters) -> DataFrame:
        """Results as they are shown, content cut; ``verbose``: also the whole text of each file, null where it cannot be read."""
        rows = context.shown(self.search(questions, limit, **filters))
        return scan.with_texts(rows, "file_path", "file_text") if verbose else rows

    def smart_search(self, questions: list[str], limit: int = S.DEFAULT_LIMIT, rerank: bool = True, **filters) -> list[list[dict]]:
        """For each question results of vector and keyword recall, with expansions and keywords from the model, scored again by it if ``rerank``."""
        asked = [assist.expand_query(self.chat_model, q) for q in questions]
        rows = []
        for i, (q, a) in enumerate(zip(questions, asked)):
            texts = [q, *[x for x in a["expanded"] if x != q]]
            vectors = self.embedder.embed(texts)
            rows.append((i, q, [float(x) for x in vectors[0]], [(t, [float(x) for x in v]) for t, v in zip(texts[1:], vectors[1:])], [str(k) for k in a["keywords"]]))
        q = self.spark.createDataFrame(rows, "query_id long, query string, vector array<float>, expansions array<struct<query:string,vector:array<float>>>, keywords array<string>")
        found = search.smart_search(q, self.units(), limit, fields=_FIELDS, **filters).orderBy("query_id", "rank")
        lists: list[list[dict]] = [[] for _ in questions]
        for r in found.collect():  # at most ``limit`` a question
            lists[r.query_id].append(r.asDict())
        return [assist.model_rerank(self.chat_model, q, some, limit) if rerank and some else some for q, some in zip(questions, lists)]

    def rewrite(self, question: str) -> str:
        return assist.rewrite(self.chat_model, question)

    def embedding(self, text: str) -> DataFrame:
        """(vector, dimensions, preview) of a text."""
        return self.embedded([text]).select("vector", *context.vector_preview("vector"))

    def rerank(self, questions: list[str], recall: int = 30, top: int = 10, **filters) -> DataFrame:
        return rank.rule_rerank(self.search(questions, max(1, recall), **filters), top=max(1, top)).withColumn("rank", F.col("new_rank"))

    def context(self, questions: list[str], recall: int = 30, top: int = 10, snippet_chars: int = S.SNIPPET_CHARS, model_context: int = S.CONTEXT_LIMIT) -> DataFrame:
        """(query_id, context, prompt, tokens, usage, remaining)."""
        blocks = context.context(self.rerank(questions, recall, top), snippet_chars)
        q = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, query string")
        rows = q.join(blocks, "query_id").withColumn("prompt", context.chat_prompt(F.col("query"), F.col("context")))
        return rows.select("query_id", "context", "prompt", *context.budget(F.col("prompt"), model_context))

    def answer(self, question: str, recall: int = 30, top: int = 10, snippet_chars: int = S.SNIPPET_CHARS) -> str:
        row = self.context([question], recall, top, snippet_chars).first()
        return assist.ask(self.chat_model, row.prompt) if row else context.fallback_answer(question, [])

    def chat(self, question: str, limit: int = 8, keep: int = 6, snippet_chars: int = 1400, fast: bool = False) -> dict:
        """An answer with citations from a recall in stages: question, its concepts, names of what was found, and more if evidence is thin."""
        began = time.perf_counter()
        if fast:
            keep, snippet_chars = min(keep, 3), min(snippet_chars, 320)
        base = self.search([question], max(3 * limit, 24))
        wider = self.spark.createDataFrame([(question,)], "q string").select(T.recall_query("q")).first()[0]
        found = base
        if wider != question:
            found = rank.merge_unique(base, self.search([wider], max(2 * limit, 16))).withColumn("rank", F.col("merged_rank")).drop("merged_rank", "side")
        asked = found.withColumn("query", F.lit(question))
        ranked = rank.rule_rerank(asked, fill_matches=False).withColumn("rank", F.col("new_rank"))
        terms = rank.bridge_terms(ranked).first()
        if terms and terms.terms:
            second = self.search([f"{question} {terms.terms}"], max(3 * limit, 24))
            asked = rank.merge_unique(asked, second).withColumn("rank", F.col("merged_rank")).drop("merged_rank", "side").withColumn("query", F.lit(question))
            ranked = rank.rule_rerank(asked, fill_matches=False).withColumn("rank", F.col("new_rank"))
        enough = rank.enough_evidence(ranked).first()
        if not (enough and enough.enough):
            asked = rank.merge_unique(asked, self.search([question], max(5 * limit, 40))).withColumn("rank", F.col("merged_rank")).drop("merged_rank", "side").withColumn("query", F.lit(question))
            ranked = rank.rule_rerank(asked, fill_matches=False).withColumn("rank", F.col("new_rank"))
        chosen = diversify.select_context(ranked, max(keep + 2, min(limit + 2, 8))).select("id", F.col("position").alias("rank"))
        rows = chosen.join(ranked.drop("rank"), "id").orderBy("rank").withColumn("content", T.snippet("content", T.tokens("query"), max(200, snippet_chars)))
        results = [r.asDict() for r in rows.select("id", "rank", "query_id", "query", *_FIELDS).collect()]
        retrieved = time.perf_counter()

        def prompt(some: list[dict]) -> str:
            text = S.BLOCK_SEPARATOR.join(f"来源[{i}]\n文件: {r['file_path']}:{r['start_line']}-{r['end_line']}\n名称: {r['name']}\n类型: {r['type']}\n代码片段:\n{r['content']}" for i, r in enumerate(some, 1))
            return S.CHAT_PROMPT.replace("{question}", question).replace("{context}", text)

        sources = results[:keep]
        text, calls = assist.grounded_answer(self.chat_model, question, prompt(sources), sources, prompt(results), results)
        ended = time.perf_counter()
        return {"answer": text, "sources": sources, "calls": calls, "retrieval_s": retrieved - began, "answer_s": ended - retrieved, "total_s": ended - began}

    # vocabulary and analysis ----------------------------------------------

    def vocabulary_search(self, question: str, limit: int = S.DEFAULT_LIMIT, **filters) -> DataFrame:
        """Search with the question rewritten by the model and lifted by the vocabulary's words in it."""
        words = vocab.top_words(vocab.learn(self.units()), 100)
        understood = assist.understand(self.chat_model, question, [r.word for r in words.collect()])
        hits = self.search([understood["rewritten"]], limit * 2, **filters)
        lifted = search.keyword_bonus(hits.withColumn("keywords", F.array(*map(F.lit, understood["keywords"])) if understood["keywords"] else F.array().cast("array<string>")), confidence=F.lit(float(understood["confidence"])))
        return search.matched_first(lifted, limit)

    def analyze(self, report: str, most: int = 10) -> dict:
        """A report's analysis, code found in three rounds, places in it that are suspicious, and a summary."""
        bug = assist.analyze_report(self.chat_model, report)
        rounds = [(1, bug.component, 5), *((2, k, 3) for k in bug.keywords[:3]), (3, bug.symptom, 5)]
        rounds = [(n, q, k) for n, q, k in rounds if q and q != "unknown"]
        found = []
        if rounds:
            parts = [self.search([question], k).withColumn("round", F.lit(n)) for n, question, k in rounds]
            rows = durable(reduce(DataFrame.unionByName, parts))
            best = assist.rounds(rows.withColumn("query_id", F.lit(0)), most)
            fields = rows.groupBy("id").agg(*[F.max(c).alias(c) for c in _FIELDS])
            found = [r.asDict() for r in best.join(fields, "id").orderBy("score", "id").select("id", "score", "round", *_FIELDS).collect()]
        code = assist.analyze_code(self.chat_model, bug.symptom, bug.causes, found)
        return {"bug": bug, "results": found, "code": code, "summary": assist.summary(len(found), code["suspicious"])}
