"""Queries by name, with the SQL that gives the same rows where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import schema as S
from skein.functions import text as T
from skein.functions.rows import table
from skein.operators import assist, context, diversify, incremental, index, rank, search, vector, vocab
from skein.sources import config, parse, scan

KEYWORDS = [("k1", w) for w in ("login", "order", "cart", "coupon", "address", "member", "refund", "token")] + [("k2", w) for w in ("await", "template", "vector", "router", "订单", "登录", "filter", "upload")]
#: Filters of the registered searches.
FILE_TYPES, CODE_TYPES = [".js", ".vue", ".ts"], ["function", "component"]


def _units(s, d) -> DataFrame:
    return table(s, d, "code_units")


def _queries(s, d) -> DataFrame:
    """Every embedding whose id is divisible by 100, with the document of that id as its text."""
    e = table(s, d, "embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    t = table(s, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    return e.join(t, "query_id")


def _hits(s, d, k=30) -> DataFrame:
    """Nearest units of each query with their fields."""
    q, u = _queries(s, d), _units(s, d)
    rows = vector.with_fields(vector.knn(q, u, k), u, "project", "file_path", "type", "name", "content", "start_line", "end_line", "dependencies")
    return vector.projected(rows).join(q.select("query_id", "query"), "query_id")


def _files(s, d) -> DataFrame:
    """The present row of each file."""
    rows = table(s, d, "files")
    return rows.groupBy("file_id").agg(*[F.max_by(c, F.struct("scanned_at", "mtime_ms", "size")).alias(c) for c in ("project", "path", "relative_path", "extension", "size", "content")])


def _keywords(s) -> DataFrame:
    return s.createDataFrame(KEYWORDS, "query_id string, keyword string")


def _filtered(s, d):
    return vector.search(_queries(s, d), _units(s, d), file_types=FILE_TYPES, code_types=CODE_TYPES).select("query_id", "rank", "id", "score")


def _fused(s, d):
    q = _queries(s, d)
    words = q.select("query_id", F.explode(F.array(*map(F.lit, ["login", "order", "cart"]))).alias("keyword"))
    return search.fuse(vector.knn(q, _units(s, d), 20), search.keyword_scores(words, _units(s, d)))


def _matched(s, d):
    hits = _hits(s, d, 20).withColumn("keywords", F.array(*map(F.lit, ["login", "order", "cart", "refund", "处理"])))
    return search.matched_first(search.keyword_bonus(hits), 10).select("query_id", "rank", "id", "score", F.size("keyword_matches").alias("matches"))


def _boosted(s, d):
    hits = _hits(s, d, 20).withColumn("keywords", F.array(*map(F.lit, ["login", "order", "cart", "refund"]))).withColumn("confidence", F.lit(0.5))
    return search.keyword_bonus(hits, confidence="confidence").select("query_id", "id", F.round("score", 6).alias("score"))


def _evidence(s, d):
    u = _units(s, d).where("id is not null").withColumn("score", F.length("content").cast("double") % 1000)
    return u.select("id", F.round(rank.evidence_score(), 6).alias("evidence")).distinct()


def _reranked(s, d):
    return rank.rule_rerank(_hits(s, d), top=10).select("query_id", F.col("new_rank").alias("rank"), "id", F.round("relevance", 6).alias("relevance"))


def _merged(s, d):
    hits = _hits(s, d, 20).select("query_id", "id", "rank", "score")
    primary, fallback = hits.where("rank % 2 = 0"), hits.where("rank % 3 = 0").withColumn("score", F.col("score") + 1)
    return rank.merge_unique(primary, fallback).select("query_id", "id", "score", "merged_rank")


def _jaccard(s, d):
    hits = _hits(s, d, 10).select("query_id", "rank", "id", T.tokens(F.concat_ws(" ", "file_path", "name", "content")).alias("t"))
    first = hits.where("rank = 1").select("query_id", F.col("t").alias("t1"))
    return hits.join(first, "query_id").select("query_id", "id", F.round(T.jaccard(F.col("t1"), F.col("t")), 6).alias("similarity"))


def _snippets(s, d):
    return _hits(s, d, 10).select("query_id", "id", T.snippet("content", F.array(F.lit("return"), F.lit("export"), F.lit("const")), 400).alias("snippet"))


def _contexts(s, d):
    return context.context(_hits(s, d, 5).withColumn("query", F.lit("return export const")))


def _budget(s, d):
    return _contexts(s, d).select("query_id", *context.budget(context.chat_prompt(F.lit("q"), F.col("context"))))


def _answers(s, d) -> DataFrame:
    n = F.col("doc_id")
    cites = F.concat(F.lit("来源["), (n % 5).cast("string"), F.lit("]"))
    more = F.concat(F.lit("来源["), (n % 3 + 1).cast("string"), F.lit("]"))
    text = F.concat(F.when(n % 7 != 0, F.lit("## 结论\n")).otherwise(""), F.coalesce("text", F.lit("")), F.when(n % 2 == 0, cites).otherwise(""), F.lit("\n## 证据\n"), cites, more)
    return table(s, d, "documents").select("doc_id", text.alias("answer"), (n % 4).cast("int").alias("sources"))


def _history(s, d) -> DataFrame:
    e = table(s, d, "events")
    kind = F.when(F.col("event_type") == "purchase", "good").when(F.col("event_type") == "error", "bad")
    return e.select("event_id", F.col("user_id").alias("query_id"), "ts", kind.alias("feedback"))


def _parsed(s, d):
    return parse.parsed(_files(s, d)).groupBy("type").agg(F.count(F.lit(1)).alias("units"), F.countDistinct("id").alias("ids"))


def _next(s, d, i) -> DataFrame:
    """Of each query the vector of the query ``i`` hundreds of ids on, or its own where there is none."""
    q = _queries(s, d).select("query_id", "vector")
    other = q.select((F.col("query_id") - 100 * i).alias("query_id"), F.col("vector").alias("next"))
    return q.join(other, "query_id", "left").select("query_id", F.coalesce("next", "vector").alias("vector"))


def _rounds(s, d):
    """Of each query, searches of three rounds, the first that finds a unit keeping it; the ten nearest.  Later rounds search by the vectors of the next queries."""
    near = [vector.knn(_next(s, d, i), _units(s, d), k).withColumn("round", F.lit(i + 1)) for i, k in enumerate((5, 3, 5))]
    return assist.rounds(near[0].unionByName(near[1]).unionByName(near[2]))


def _expanded(s, d) -> DataFrame:
    """Queries with four expansions: the texts and vectors of the next queries, the text of the first joined to its own."""
    q = _queries(s, d)
    for i in (1, 2, 3):
        other = q.select((F.col("query_id") - 100 * i).alias("query_id"), F.struct(F.col("query").alias("query"), F.col("vector").alias("vector")).alias(f"e{i}"))
        q = q.join(other, "query_id", "left")
        q = q.withColumn(f"e{i}", F.coalesce(f"e{i}", F.struct(F.lit("").alias("query"), F.col("vector").alias("vector"))))
    own = F.struct(F.concat_ws(" ", F.substring("query", 1, 200), F.col("e1.query")).alias("query"), F.col("e1.vector").alias("vector"))
    return q.select("query_id", "query", "vector", F.array("e1", own, "e2", "e3").alias("expansions"))


def _trusted(s, d):
    return search.trusted(_expanded(s, d)).select("query_id", "n", F.md5("query").alias("hash"))


def _union(s, d):
    base = vector.knn(_queries(s, d), _units(s, d), 10)
    more = vector.knn(_next(s, d, 1), _units(s, d), 5).withColumn("n", F.lit(1)).unionByName(vector.knn(_next(s, d, 2), _units(s, d), 5).withColumn("n", F.lit(2)))
    return search.recall_union(base, more).select("query_id", "id", "score", "n")


def _extracted(s, d):
    """What is extracted from the files, for the functions that the table of functions names, one row each."""
    found = parse.extracted(_files(s, d)).select("file_id", "name", "start_line", "type", "end_line", "is_async", "is_exported", F.size("params").alias("params")).dropDuplicates(["file_id", "name", "start_line"])
    named = table(s, d, "functions").where("func_id is not null").select("func_id", "file_id", "name", "start_line").distinct()
    return named.join(found, ["file_id", "name", "start_line"]).select("func_id", "type", "start_line", "end_line", "is_async", "is_exported", "params")


def _file_units(s, d):
    u = parse.parsed(_files(s, d).where("relative_path is not null"), "file")
    meta = vector.projected(u.select("id", "metadata")).select("id", F.col("metadata")["extension"].alias("extension"), F.col("metadata")["size"].cast("bigint").alias("size"))
    return u.join(meta, "id").select("project", "relative_path", "type", "name", "start_line", "end_line", "extension", "size", F.md5("content").alias("hash"), F.array_join("dependencies", "|").alias("deps"))


def _lines(s, d):
    f = table(s, d, "functions").where("func_id is not null").select("func_id", "file_id", "start_line", "end_line").distinct()
    texts = _files(s, d).where(~F.lower("relative_path").endswith(".vue")).select("file_id", F.col("content").alias("text"))
    return f.join(texts, "file_id").select("func_id", F.md5(T.lines_of("text", F.col("start_line"), F.col("end_line"))).alias("hash"))


def _projected(s, d):
    u = vector.projected(_units(s, d).where("id is not null").select("id", "dependencies", "metadata"))
    return u.select("id", F.array_join("dependencies", "|").alias("deps"), F.col("metadata")["extension"].alias("extension"), F.col("metadata")["functionType"].alias("kind")).distinct()


def _summaries(s, d):
    f = table(s, d, "functions").where("file_id is not null").select("file_id", "func_id", "is_async", "is_exported").distinct()
    rate = F.when(F.col("is_async") & F.col("is_exported"), "high").when(F.col("is_async"), "medium").otherwise("low")
    n = f.groupBy("file_id").agg(F.count(F.lit(1)).cast("int").alias("results"))
    return assist.summaries(f.join(n, "file_id").select(F.col("file_id").alias("report_id"), "results", rate.alias("confidence")))


def _projects_of(s, d):
    keys = table(s, d, "projects").select(F.col("name").alias("key")).unionByName(table(s, d, "files").select(F.col("project").alias("key"))).unionByName(table(s, d, "index_runs").select(F.concat("project_id", F.lit("?")).alias("key"))).where("key is not null")
    return config.lookup(table(s, d, "projects"), keys).withColumn("indexed", F.col("indexed").cast("string"))


def _metrics(s, d):
    e = table(s, d, "events").select(F.when(F.col("event_type") == "error", "failed").alias("error"), (F.col("user_id") % 4 + 1).cast("int").alias("attempts"), F.col("value").alias("ms"))
    return index.embedding_stats(e)


def _texts(s, d):
    """Hits with the whole text of their files."""
    hits = vector.with_fields(vector.knn(_queries(s, d), _units(s, d), 10), _units(s, d), "file_path")
    return scan.texts_of(hits, _files(s, d)).select("query_id", "id", F.md5("file_text").alias("hash"))


def _shown(s, d):
    return context.shown(_hits(s, d, 10), S.SHOWN_RERANK).select("query_id", "id", "short_id", "short_path", F.md5("content").alias("hash"))


def _prompts(s, d):
    return _contexts(s, d).select("query_id", F.md5(context.chat_prompt(F.lit("q"), F.col("context"))).alias("hash"))


def _vocab_words(s, d):
    v = vocab.vocab_stats(vocab.learn(_units(s, d)))
    return v.select("total", F.posexplode("top").alias("n", "t")).select("total", "n", "t.word", "t.freq")


def _model_answers(s, d) -> DataFrame:
    """(doc_id, query, answer): answers of a model as they may come: an object, one within prose, a broken one, none, and one with few fields."""
    full = '{"keywords": ["k1", "login"], "expandedQueries": ["e"], "intent": "find", "rewrittenQuery": "r", "confidence": 0.75, "componentName": "Box", "steps": ["s"], "symptom": "y", "possibleCauses": ["c1", "c2"], "searchKeywords": ["w"]}'
    n = F.col("doc_id") % 5
    answer = F.when(n == 0, full).when(n == 1, f"Sure:\n{full} done").when(n == 2, '{"keywords": [broken}').when(n == 4, '{"keywords": ["a b"], "confidence": 0.9}')
    return table(s, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("query"), answer.alias("answer"))


def _expansions(s, d):
    a = _model_answers(s, d)
    return a.select("doc_id", *assist.expansion("answer", "query")).select("doc_id", _hashed(F.col("keywords")), F.md5(F.array_join("expanded", "|")).alias("expanded"))


def _understood(s, d):
    a = _model_answers(s, d)
    return a.select("doc_id", *assist.understanding("answer", "query", F.array_distinct(T.cjk_runs("query", 2, 4)))).select("doc_id", "intent", F.md5("rewritten").alias("rewritten"), _hashed(F.col("keywords")), "confidence")


def _analysed(s, d):
    a = _model_answers(s, d)
    return a.select("doc_id", *assist.report_analysis("answer", "query")).select("doc_id", "component", F.array_join("steps", "|").alias("steps"), "symptom", F.array_join("causes", "|").alias("causes"), F.array_join("keywords", "|").alias("keywords"))


def _scored(s, d):
    q = F.col("query_id") % 300
    answers = _queries(s, d).select("query_id", F.when(q == 0, "scores: [3, 9, 1, 7, 9] as asked").when(q == 100, "[8.5, 5]").alias("answer"))
    return assist.reranked(vector.knn(_queries(s, d), _units(s, d), 25).select("query_id", "id", "rank"), answers).withColumn("rerank_score", F.coalesce("rerank_score", F.lit(-1)))


def _fallbacks(s, d):
    return context.fallback_answers(_hits(s, d, 5)).select("query_id", F.md5("answer").alias("hash"))


def _clamped(s, d):
    """Blocks whose snippets would be shorter than the least."""
    return context.context(_hits(s, d, 5).withColumn("query", F.lit("return export const")), snippet_chars=50).select("query_id", F.md5("context").alias("hash"))


def _hashed(words):
    """A hash of a set of words, whatever their order."""
    return F.md5(F.array_join(F.array_sort(words), "|")).alias("hash")


def _projects(s, d) -> list[str]:
    """The two projects with the smallest ids."""
    return [r.id for r in table(s, d, "projects").select("id").orderBy("id").limit(2).collect()]


def queries() -> dict:
    t = table
    return {
        "knn_top20": lambda s, d: vector.knn(_queries(s, d).where("query_id = 0"), _units(s, d), 20),
        "knn_batch": lambda s, d: vector.knn(_queries(s, d), _units(s, d), 20),
        "knn_cosine": lambda s, d: vector.knn(_queries(s, d), _units(s, d), 10, "cosine"),
        "search_post_filter": _filtered,
        "outlier_cut": lambda s, d: vector.outlier_cut(vector.knn(_queries(s, d), _units(s, d), 200)).select("query_id", "id", "score"),
        "similarity_display": lambda s, d: vector.knn(_queries(s, d), _units(s, d), 5).select("query_id", "id", F.round(1 - F.col("score"), 6).alias("similarity")),
        "token_counts": lambda s, d: t(s, d, "documents").select("doc_id", F.size(T.tokens("text")).alias("tokens"), _hashed(T.tokens("text"))),
        "specificity": lambda s, d: _units(s, d).select("name", T.specificity("name").alias("weight")).distinct(),
        "overlap_ratio": lambda s, d: t(s, d, "functions").select("func_id", F.round(T.overlap(T.tokens(F.concat_ws(" ", "name", F.array_join("params", " "))), T.tokens("content")), 6).alias("ratio")).distinct(),
        "keyword_scores": lambda s, d: search.keyword_scores(_keywords(s), _units(s, d)).select("query_id", "id", F.col("match_score").cast("bigint").alias("match_score"), F.array_join("keyword_matches", "|").alias("matches"), "rank"),
        "fuse_hybrid": _fused,
        "matched_first": _matched,
        "keyword_boost": _boosted,
        "smart_search": lambda s, d: search.smart_search(_queries(s, d), _units(s, d), 10).select("query_id", "rank", "id", "score", "source"),
        "index_stats": lambda s, d: search.index_stats(_units(s, d)),
        "evidence_score": _evidence,
        "coverage_score": lambda s, d: _hits(s, d, 20).select("query_id", "id", rank.coverage_score(T.tokens("query"), T.haystack()).alias("coverage")),
        "rule_rerank": _reranked,
        "merge_unique": _merged,
        "evidence_sufficient": lambda s, d: rank.enough_evidence(_hits(s, d, 8)),
        "path_key": lambda s, d: _units(s, d).select("file_path", T.path_key("file_path").alias("module")).distinct(),
        "jaccard_pairs": _jaccard,
        "recall_expand": lambda s, d: t(s, d, "documents").select("doc_id", T.recall_query("text").alias("recall")),
        "mapped_keywords": lambda s, d: t(s, d, "documents").where("text is not null").select("doc_id", F.size(T.mapped_keywords("text")).alias("keywords"), _hashed(T.mapped_keywords("text"))),
        "bridge_terms": lambda s, d: rank.bridge_terms(_hits(s, d, 8)),
        "select_mmr": lambda s, d: diversify.select_mmr(rank.rule_rerank(_hits(s, d)), 10),
        "select_context": lambda s, d: diversify.select_context(rank.rule_rerank(_hits(s, d)), 8),
        "snippet": _snippets,
        "context_block": _contexts,
        "token_budget": _budget,
        "citation_valid": lambda s, d: _answers(s, d).select("doc_id", F.array_join(F.array_sort(context.citations(F.col("answer"), F.col("sources"))), "|").alias("cited"), context.valid_citation(F.col("answer"), F.col("sources")).alias("valid"), context.has_code_fence(F.col("answer")).alias("fenced")),
        "vocab_freq": lambda s, d: vocab.learn(_units(s, d)),
        "vocab_top": lambda s, d: vocab.top_words(vocab.learn(_units(s, d)), 50),
        "vocab_match": lambda s, d: vocab.match_words(_queries(s, d), vocab.learn(_units(s, d)), both_ways=False),
        "camel_words": lambda s, d: t(s, d, "functions").select("name", F.explode(T.camel_words("name")).alias("word")).distinct(),
        "query_stats": lambda s, d: vocab.query_stats(_history(s, d)),
        "feedback_latest": lambda s, d: vocab.latest_feedback(_history(s, d).where("feedback is not null")).select("query_id", "event_id", "feedback"),
        "p4_found": lambda s, d: incremental.pending(t(s, d, "files"), t(s, d, "index_state"), t(s, d, "index_runs")),
        "p4_changes": lambda s, d: incremental.changes(t(s, d, "files"), t(s, d, "index_state"), t(s, d, "index_runs")),
        "incremental_diff": lambda s, d: incremental.changes(t(s, d, "files"), t(s, d, "index_state"), t(s, d, "index_runs")).groupBy("project", "status").agg(F.count(F.lit(1)).alias("files")),
        "delete_by_path": lambda s, d: index.without_paths(_units(s, d), _units(s, d).where("type = 'component'").select("project", "file_path")).select("id", "project", "file_path", "type").distinct(),
        "file_filter": lambda s, d: t(s, d, "files").where(T.allowed_file("relative_path")).select("project", "relative_path").distinct(),
        "small_files": lambda s, d: scan.small_files(t(s, d, "files").select("path", "extension", "size").distinct()).select("path", "size"),
        "project_lookup": _projects_of,
        "ext_label": lambda s, d: t(s, d, "files").select("relative_path", T.type_label(T.extension("relative_path")).alias("label")).distinct(),
        "deps_extract": lambda s, d: t(s, d, "files").where("content is not null").select("file_id", F.array_join(T.dependencies("content"), "|").alias("deps")).distinct(),
        "props_emits": lambda s, d: t(s, d, "files").where("content is not null").select("file_id", F.array_join(T.declared_props("content"), "|").alias("props"), F.array_join(T.declared_emits("content"), "|").alias("emits")).distinct(),
        "file_hash": lambda s, d: t(s, d, "files").where("content is not null").select("file_id", T.content_hash("content").alias("hash"), F.size(F.split("content", "\n")).alias("lines")).distinct(),
        "file_text": lambda s, d: t(s, d, "files").where("content is not null").select("file_id", F.md5(T.file_text("relative_path", T.extension("relative_path"), "path", "content")).alias("hash")).distinct(),
        "semantic_text": lambda s, d: t(s, d, "functions").select("func_id", F.md5(T.function_text("name", "name", "type", "params", "is_async", "is_exported", "comments", "content")).alias("hash")).distinct(),
        "embed_text": lambda s, d: _units(s, d).select("id", F.length(T.embed_text("content")).alias("chars"), T.token_estimate("content").alias("tokens")).distinct(),
        "unit_tokens": lambda s, d: _units(s, d).select("id", F.size(T.tokens(F.concat_ws(" ", "file_path", "name", "content"))).alias("tokens"), _hashed(T.tokens(F.concat_ws(" ", "file_path", "name", "content")))).distinct(),
        "parse_units": _parsed,
        "multi_round": _rounds,
        "fallback_keywords": lambda s, d: t(s, d, "documents").select("doc_id", F.array_join(T.issue_keywords("text"), "|").alias("keywords")),
        "analysis_summary": _summaries,
        "search_project": lambda s, d: vector.search(_queries(s, d), _units(s, d), projects=_projects(s, d)).select("query_id", "rank", "id", "score"),
        "search_before": lambda s, d: vector.search(_queries(s, d), _units(s, d), 10, projects=_projects(s, d), code_types=CODE_TYPES, before=True, cut=False).select("query_id", "rank", "id", "score"),
        "search_bounds": lambda s, d: vector.search(_queries(s, d), _units(s, d), metric="cosine", min_score=0.2, path_pattern="/src/", cut=False).select("query_id", "rank", "id", "score"),
        "distance_top": lambda s, d: vector.distance_top(vector.knn(_queries(s, d), _units(s, d), 16), 6).select("query_id", "id", "score", "rank"),
        "trusted_expansions": _trusted,
        "recall_union": _union,
        "keyword_filters": lambda s, d: search.keyword_scores(_keywords(s), _units(s, d), file_types=FILE_TYPES, code_types=CODE_TYPES, projects=_projects(s, d)).select("query_id", "id", F.col("match_score").cast("bigint").alias("match_score"), "rank"),
        "keyword_scan_cap": lambda s, d: search.keyword_scores(_keywords(s), _units(s, d), scan_cap=10_000).select("query_id", "id", F.col("match_score").cast("bigint").alias("match_score"), "rank"),
        "smart_search_filtered": lambda s, d: search.smart_search(_queries(s, d), _units(s, d), 10, _projects(s, d), FILE_TYPES, CODE_TYPES).select("query_id", "rank", "id", "score", "source"),
        "parse_functions": _extracted,
        "file_units": _file_units,
        "function_lines": _lines,
        "result_projection": _projected,
        "embedding_stats": _metrics,
        "result_texts": _texts,
        "display_cut": _shown,
        "vector_preview": lambda s, d: _queries(s, d).select("query_id", *context.vector_preview("vector")),
        "chat_prompt": _prompts,
        "answer_expansion": _expansions,
        "answer_understanding": _understood,
        "answer_analysis": _analysed,
        "rerank_scores": _scored,
        "fallback_answer": _fallbacks,
        "context_clamp": _clamped,
        "vocab_set": lambda s, d: vocab.learn(_units(s, d), least=1, camel=True, once_a_batch=True),
        "vocab_match_both": lambda s, d: vocab.match_words(t(s, d, "functions").select(F.col("func_id").alias("query_id"), F.col("name").alias("query")), vocab.learn(_units(s, d))),
        "vocab_keywords": lambda s, d: vocab.keywords_of(_queries(s, d), vocab.learn(_units(s, d)), both_ways=False).select("query_id", _hashed(F.col("keywords"))),
        "vocab_stats": _vocab_words,
        "top_keywords": lambda s, d: vocab.top_keywords(search.keyword_scores(_keywords(s), _units(s, d), None)),
    }


def _tok(x: str) -> str:
    return f"list_distinct(list_concat(regexp_extract_all({x}, '[\\x{{4e00}}-\\x{{9fa5}}]{{2,8}}'), list_filter(string_split_regex(lower({x}), '[^a-z0-9_]+'), lambda w: length(w) >= 3)))"


def _hash_sql(words: str) -> str:
    return f"md5(array_to_string(list_sort({words}), '|')) AS hash"


def _round(i: int, k: int, name: str) -> str:
    """Of each query the k units nearest to the vector of the query i hundreds on, or to its own."""
    return f"{name}v AS (SELECT a.query_id, coalesce(b.v, a.v) AS v FROM q a LEFT JOIN q b ON b.query_id = a.query_id + {100 * i}), {name} AS (SELECT query_id, id, score FROM (SELECT q.query_id, v.id, min(round({_L2}, 6)) AS score FROM {name}v q, v GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, id) <= {k})"


_Q = """q AS (SELECT e.vec_id AS query_id, e.embedding AS v, coalesce(d.text, '') AS query FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id WHERE e.vec_id % 100 = 0)"""
_V = """v AS (SELECT id, vector FROM code_units WHERE id IS NOT NULL AND vector IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""
_DOT = "list_sum(list_transform(range(1, 65), lambda i: {a}[i]::DOUBLE * {b}[i]::DOUBLE))"
_L2 = "list_sum(list_transform(range(1, 65), lambda i: (v.vector[i]::DOUBLE - q.v[i]::DOUBLE) * (v.vector[i]::DOUBLE - q.v[i]::DOUBLE)))"


def _knn(k: int, where: str = "true", score: str = _L2, more: str = "true") -> str:
    return f"""{_Q}, {_V}, near AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INT AS rank FROM
      (SELECT q.query_id, v.id, min(round({score}, 6)) AS score FROM q, v WHERE {where} AND {more} GROUP BY 1, 2) QUALIFY rank <= {k})"""


_U = """u AS (SELECT id, max(project) AS project, max(file_path) AS file_path, max(type) AS type, max(name) AS name, max(content) AS content, max(start_line) AS start_line, max(end_line) AS end_line, max(dependencies) AS dependencies FROM code_units WHERE id IS NOT NULL GROUP BY id)"""
_HAY = "lower(concat_ws(' ', coalesce(file_path, ''), coalesce(name, ''), coalesce(content, '')))"


def _hit(k: int = 30) -> str:
    return f"{_knn(k)}, {_U}, hits AS (SELECT near.query_id, near.id, near.score, near.rank, q.query, u.project, u.file_path, u.type, u.name, u.content, u.start_line, u.end_line, u.dependencies FROM near JOIN u USING (id) JOIN q ON q.query_id = near.query_id)"


def _spec(x: str) -> str:
    k = f"lower(trim(coalesce({x}, '')))"
    generic = ", ".join(f"'{w}'" for w in S.GENERIC_KEYWORDS)
    return f"(CASE WHEN {k} = '' OR {k} IN ({generic}) THEN 0.0 WHEN length({k}) >= 6 THEN 1.2 WHEN length({k}) >= 4 THEN 1.0 WHEN length({k}) >= 2 THEN 0.8 ELSE 0.4 END)::DOUBLE"


def _evidence_sql(score: str, matches: str = "0") -> str:
    p, n, c = "lower(coalesce(file_path, ''))", "lower(coalesce(name, ''))", "lower(coalesce(content, ''))"
    base = f"regexp_extract({p}, '([^/\\\\]*)$', 1)"
    case = lambda cond, x: f"(CASE WHEN {cond} THEN {x} ELSE 0 END)"
    re_ = lambda x, pat: f"regexp_matches({x}, '{pat}')"
    return " + ".join(
        ["(CASE type WHEN 'function' THEN 120 WHEN 'component' THEN 100 WHEN 'file' THEN 20 ELSE 0 END)", case(f"contains({p}, '/src/')", 80), case(f"contains({p}, '/docs/')", -140), case(re_(base, S.GENERIC_FILE), -120), case(f"contains({base}, 'utilscategory')", -80)]
        + [case(re_(n, S.EVIDENCE_NAME), 40), case(re_(f"concat_ws(' ', {p}, {c})", S.EVIDENCE_TEXT), 30), case(re_(n, S.EVIDENCE_FLOW), 25), case(re_(c, S.EVIDENCE_CALL), 40), f"25 * {matches}", f"greatest(0.0::DOUBLE, 800.0::DOUBLE - {score}) * 0.1::DOUBLE"]
    )


def _words_sql(camel: bool = False) -> str:
    return """list_concat(list_concat(list_filter(list_transform(list_filter(string_split(coalesce(file_path, ''), '/'), lambda p: p <> '' AND NOT starts_with(p, '.')), lambda p: regexp_replace(p, '\\.(js|ts|vue|jsx|tsx|md)$', '')), lambda p: length(p) > 1),
      list_filter([coalesce(name, '')], lambda n: length(n) > 2)), regexp_extract_all(coalesce(content, ''), '[\\x{4e00}-\\x{9fa5}]{2,4}'))"""


_CHANGES = """
WITH now AS (
  SELECT project, replace(relative_path, chr(92), '/') AS relative_path, mtime_ms, size FROM files WHERE project IS NOT NULL AND relative_path IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY project, replace(relative_path, chr(92), '/') ORDER BY scanned_at DESC NULLS LAST, mtime_ms DESC NULLS LAST, size DESC NULLS LAST) = 1),
last AS (
  SELECT s.project_id AS project, replace(s.relative_path, chr(92), '/') AS relative_path, s.mtime_ms, s.size
  FROM index_state s JOIN index_runs r ON s.run_id = r.run_id AND s.project_id = r.project_id WHERE r.status = 'success'
  QUALIFY row_number() OVER (PARTITION BY s.project_id, replace(s.relative_path, chr(92), '/') ORDER BY r.finished_at DESC NULLS LAST, s.run_id DESC, s.mtime_ms DESC NULLS LAST, s.size DESC NULLS LAST) = 1),
changes AS (
  SELECT coalesce(n.project, l.project) AS project, coalesce(n.relative_path, l.relative_path) AS relative_path,
    CASE WHEN l.project IS NULL THEN 'added' WHEN n.project IS NULL THEN 'deleted'
         WHEN n.mtime_ms IS NOT DISTINCT FROM l.mtime_ms AND n.size IS NOT DISTINCT FROM l.size THEN 'unchanged' ELSE 'modified' END AS status
  FROM now n FULL OUTER JOIN last l ON n.project = l.project AND n.relative_path = l.relative_path)
"""
_EXT = "regexp_extract({x}, '[^/.][^/]*?(\\.[^./]*)$', 1)"


def _label(x: str) -> str:
    return "CASE " + x + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.TYPE_LABELS.items()) + f" ELSE '{S.DEFAULT_LABEL}' END"


_BRIDGE = f"""n AS (SELECT query_id, rank, list_concat(list_filter([regexp_replace(regexp_extract(file_path, '([^/\\\\]*)$', 1), '\\.[a-zA-Z0-9]+$', ''), coalesce(name, '')], lambda x: length(x) >= 5 AND NOT list_contains({S.BRIDGE_BLOCKED}, lower(x))),
      list_filter(regexp_extract_all(coalesce(content, ''), '[A-Za-z_][A-Za-z0-9_]{{4,}}')[1:16], lambda x: NOT list_contains({S.BRIDGE_BLOCKED}, lower(x)) AND regexp_matches(lower(x), '{S.BRIDGE_PATTERN}'))) AS t FROM hits WHERE rank <= 8),
      g AS (SELECT query_id, flatten(list(t ORDER BY rank)) AS f FROM n GROUP BY 1)"""
_BLOCKS = """s0 AS (SELECT *, coalesce(content, '') AS c, lower(coalesce(content, '')) AS lc FROM hits), s1 AS (SELECT *, list_filter(['return', 'export', 'const'], lambda t: contains(lc, t))[1] AS hit, length(c) AS n FROM s0), s2 AS (SELECT *, least(n, greatest(0, instr(lc, hit) - 1 - 600) + 1200) AS e FROM s1), s3 AS (SELECT *, greatest(0, e - 1200) AS s FROM s2),
      s4 AS (SELECT *, CASE WHEN n <= 1200 THEN c WHEN hit IS NULL THEN substring(c, 1, 1200) || '...' ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || substring(c, s + 1, e - s) || (CASE WHEN e < n THEN '...' ELSE '' END) END AS cut, json_extract_string(CASE WHEN coalesce(dependencies, '') = '' THEN '[]' ELSE dependencies END, '$[*]') AS deps FROM s3),
      blocks AS (SELECT query_id, rank, concat_ws(chr(10), '来源[' || rank || ']', '文件: ' || coalesce(file_path, '') || ':' || coalesce(start_line::VARCHAR, '') || '-' || coalesce(end_line::VARCHAR, ''), '名称: ' || coalesce(name, ''), '类型: ' || coalesce(type, ''), CASE WHEN len(deps) > 0 THEN '依赖: ' || array_to_string(deps, ', ') END, '代码片段:', cut) AS b FROM s4)"""


def oracle_sql() -> dict[str, str]:
    values = ", ".join(f"('{a}', '{b}')" for a, b in KEYWORDS)
    outlier = """, c AS (SELECT *, list_sort(list(score) OVER (PARTITION BY query_id)) AS s FROM {rows}), cut AS (SELECT * EXCLUDE s FROM c WHERE len(s) <= 3 OR score <= greatest(CASE WHEN s[len(s) // 2 + 1] = 0 THEN s[1] ELSE s[len(s) // 2 + 1] END * 2.2::DOUBLE, s[1] + 120.0::DOUBLE))"""
    kw = f"""k AS (SELECT * FROM (VALUES {values}) t(query_id, keyword)), h AS (SELECT DISTINCT id, {_HAY} AS hay FROM code_units WHERE id IS NOT NULL),
      m AS (SELECT query_id, id, sum(CASE WHEN contains(hay, keyword) THEN 10 * ((length(hay) - length(replace(hay, keyword, ''))) // length(keyword)) ELSE 0 END)::BIGINT AS match_score, coalesce(string_agg(keyword, '|' ORDER BY keyword) FILTER (contains(hay, keyword)), '') AS matches FROM k, h GROUP BY 1, 2)"""
    hits_kw = "['login', 'order', 'cart', 'refund'{more}]"
    concept = "[" + ", ".join(f"CASE WHEN contains(t, '{k}') THEN {v} ELSE []::VARCHAR[] END" for k, v in S.CONCEPT_MAP.items()) + "]"
    mapped = "[" + ", ".join(f"CASE WHEN contains(text, '{k}') THEN {[k, *v]} ELSE []::VARCHAR[] END" for k, v in S.KEYWORD_MAP.items()) + "]"
    denied = "|".join(S.DENIED_NAMES)
    rel = "replace(relative_path, chr(92), '/')"
    words = "WITH w AS (SELECT unnest(" + _words_sql() + ") AS word FROM code_units), f AS (SELECT word, count(*) AS freq FROM w GROUP BY 1 HAVING count(*) >= 3)"
    hist = "h AS (SELECT event_id, user_id AS query_id, ts, CASE event_type WHEN 'purchase' THEN 'good' WHEN 'error' THEN 'bad' END AS feedback FROM events)"
    answers = """a AS (SELECT doc_id, concat(CASE WHEN doc_id % 7 <> 0 THEN '## 结论\n' ELSE '' END, coalesce(text, ''), CASE WHEN doc_id % 2 = 0 THEN '来源[' || (doc_id % 5) || ']' ELSE '' END, '\n## 证据\n', '来源[' || (doc_id % 5) || ']', '来源[' || (doc_id % 3 + 1) || ']') AS answer, (doc_id % 4)::INT AS sources FROM documents),
      b AS (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(answer, '来源\\[(\\d{1,9})\\]', 1), lambda x: x::INT), lambda n: n >= 1 AND n <= sources)) AS cited FROM a)"""
    file_hash = f"md5('文件路径: ' || relative_path || chr(10) || '类型: ' || {_label(_EXT.format(x='relative_path'))} || chr(10) || '文件名: ' || regexp_extract(path, '([^/\\\\]*)$', 1) || chr(10) || chr(10) || '代码内容:' || chr(10) || content || chr(10))"
    two = "(SELECT id FROM projects ORDER BY id LIMIT 2)"
    kept = f"u.project IN {two} AND {_EXT.format(x='u.file_path')} IN ('.js', '.vue', '.ts') AND u.type IN ('function', 'component')"
    cosine = "1.0::DOUBLE - " + _DOT.format(a="v.vector", b="q.v") + " / sqrt(" + _DOT.format(a="v.vector", b="v.vector") + " * " + _DOT.format(a="q.v", b="q.v") + ")"
    prompt_parts = ["'" + x.replace("{question}", "q").replace("'", "''") + "'" for x in S.CHAT_PROMPT.split("{context}")]
    trust = f"list_filter(CASE WHEN len(f) > 0 THEN list_filter(f, lambda w, i: list_position(f, w) = i) ELSE list_concat(regexp_extract_all(query, '[\\x{{4e00}}-\\x{{9fa5}}]{{2,4}}'), [query]) END, lambda k: {_spec('k')} > 0)"
    smart = (
        f"WITH {_knn(40)}, {_U}, r AS (SELECT near.query_id, near.id, near.score FROM near JOIN u USING (id) WHERE @near@){outlier.format(rows='r')}, base AS (SELECT query_id, id, score FROM cut QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, id) <= @limit@), "
        f"x0 AS (SELECT query_id, query, flatten({mapped.replace('text', 'query')}) AS f FROM q), x1 AS (SELECT query_id, CASE WHEN len(f) = 0 THEN list_distinct({trust}) ELSE {trust} END AS ks0, {trust} AS t FROM x0), x2 AS (SELECT query_id, list_filter(t, lambda w, i: list_position(t, w) = i)[1:16] AS ks FROM x1), "
        f"kw AS (SELECT DISTINCT query_id, lower(unnest(ks)) AS keyword FROM x2), kd AS (SELECT DISTINCT keyword FROM kw WHERE trim(keyword) <> ''), h AS (SELECT DISTINCT id, {_HAY} AS hay FROM code_units WHERE id IS NOT NULL), "
        "c0 AS (SELECT id, keyword, max((length(hay) - length(replace(hay, keyword, ''))) // length(keyword)) AS n FROM h, kd WHERE contains(hay, keyword) GROUP BY 1, 2), m0 AS (SELECT query_id, id, (10 * sum(n))::INT AS match_score FROM c0 JOIN kw USING (keyword) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, id) <= 50), "
        "m AS (SELECT m0.* FROM m0 JOIN u USING (id) WHERE @words@), fu AS (SELECT coalesce(b.query_id, m.query_id) AS query_id, coalesce(b.id, m.id) AS id, CASE WHEN b.score IS NOT NULL AND m.match_score IS NOT NULL THEN b.score - 40.0::DOUBLE WHEN b.score IS NOT NULL THEN b.score ELSE 900.0::DOUBLE - m.match_score END AS score, CASE WHEN b.score IS NOT NULL AND m.match_score IS NOT NULL THEN 'hybrid' WHEN b.score IS NOT NULL THEN 'vector' ELSE 'keyword' END AS source FROM base b FULL OUTER JOIN m ON b.query_id = m.query_id AND b.id = m.id), "
        f"g AS (SELECT fu.*, list_filter(x2.ks, lambda k: contains({_HAY}, lower(k))) AS ms FROM fu JOIN u USING (id) JOIN x2 USING (query_id)), o AS (SELECT query_id, id, source, score - coalesce(list_sum(list_transform(ms, lambda k: round({_spec('k')} * 45.0::DOUBLE))), 0.0::DOUBLE) AS score, len(ms) AS n FROM g) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY n = 0, score, id)::INT AS rank, id, score, source FROM o QUALIFY rank <= @top@"
    )

    def fill(pattern: str) -> str:
        """A pattern with the fields of a hit in the place of their names."""
        out = "'" + pattern + "'"
        for k, v in {"i": "rank", "name": "coalesce(name, '')", "type": "coalesce(type, '')", "file_path": "coalesce(file_path, '')", "start_line": "coalesce(start_line::VARCHAR, '')", "end_line": "coalesce(end_line::VARCHAR, '')"}.items():
            out = out.replace("{" + k + "}", f"' || {v} || '")
        return out

    name_label = "CASE type WHEN 'function' THEN '函数声明' WHEN 'method' THEN '类方法' ELSE '箭头函数' END"
    return {
        "knn_top20": f"WITH {_knn(20, 'q.query_id = 0')} SELECT * FROM near",
        "knn_batch": f"WITH {_knn(20)} SELECT * FROM near",
        "knn_cosine": f"WITH {_knn(10, score=cosine, more=_DOT.format(a='v.vector', b='v.vector') + ' > 0')} SELECT * FROM near",
        "search_post_filter": f"WITH {_knn(40)}, {_U}, r AS (SELECT near.query_id, near.id, near.score FROM near JOIN u USING (id) WHERE {_EXT.format(x='u.file_path')} IN ('.js', '.vue', '.ts') AND u.type IN ('function', 'component')){outlier.format(rows='r')} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INT AS rank, id, score FROM cut QUALIFY rank <= 20",
        "outlier_cut": f"WITH {_knn(200)}{outlier.format(rows='near')} SELECT query_id, id, score FROM cut",
        "similarity_display": f"WITH {_knn(5)} SELECT query_id, id, round(1 - score, 6) AS similarity FROM near",
        "token_counts": f"SELECT doc_id, len({_tok("coalesce(text, '')")})::INT AS tokens, {_hash_sql(_tok("coalesce(text, '')"))} FROM documents",
        "specificity": f"SELECT DISTINCT name, {_spec('name')} AS weight FROM code_units",
        "overlap_ratio": f"WITH t AS (SELECT func_id, {_tok('concat_ws(chr(32), name, array_to_string(params, chr(32)))')} AS a, {_tok('coalesce(content, chr(32))')} AS b FROM functions) SELECT DISTINCT func_id, CASE WHEN least(len(a), len(b)) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)), 6) END AS ratio FROM t",
        "keyword_scores": f"WITH {kw} SELECT query_id, id, match_score, matches, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, id)::INT AS rank FROM m WHERE match_score > 0 QUALIFY rank <= 50",
        "fuse_hybrid": f"WITH {_knn(20)}, h AS (SELECT DISTINCT id, {_HAY} AS hay FROM code_units WHERE id IS NOT NULL), k AS (SELECT unnest(['login', 'order', 'cart']) AS keyword), m0 AS (SELECT id, sum(10 * ((length(hay) - length(replace(hay, keyword, ''))) // length(keyword)))::INT AS match_score FROM h, k GROUP BY 1), m1 AS (SELECT id, match_score FROM m0 WHERE match_score > 0 ORDER BY match_score DESC, id LIMIT 50), m AS (SELECT query_id, id, match_score FROM q, m1) SELECT coalesce(n.query_id, m.query_id) AS query_id, coalesce(n.id, m.id) AS id, CASE WHEN n.score IS NOT NULL AND m.match_score IS NOT NULL THEN n.score - 40.0::DOUBLE WHEN n.score IS NOT NULL THEN n.score ELSE 900.0::DOUBLE - m.match_score END AS score, CASE WHEN n.score IS NOT NULL AND m.match_score IS NOT NULL THEN 'hybrid' WHEN n.score IS NOT NULL THEN 'vector' ELSE 'keyword' END AS source FROM near n FULL OUTER JOIN m ON n.query_id = m.query_id AND n.id = m.id",
        "matched_first": f"WITH {_hit(20)}, b AS (SELECT *, list_filter({hits_kw.format(more=', ' + chr(39) + '处理' + chr(39))}, lambda k: contains({_HAY}, k)) AS ms FROM hits), c AS (SELECT query_id, id, score - coalesce(list_sum(list_transform(ms, lambda k: round({_spec('k')} * 45.0::DOUBLE))), 0.0::DOUBLE) AS score, len(ms)::INT AS matches FROM b) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY matches = 0, score, id)::INT AS rank, id, score, matches FROM c QUALIFY rank <= 10",
        "keyword_boost": f"WITH {_hit(20)} SELECT query_id, id, round(score - 100.0::DOUBLE * len(list_filter({hits_kw.format(more='')}, lambda k: contains({_HAY}, k))), 6) AS score FROM hits",
        "index_stats": f"WITH {_U} SELECT 'type' AS kind, type AS key, count(*) AS units FROM u GROUP BY type UNION ALL SELECT 'project', project, count(*) FROM u GROUP BY project UNION ALL SELECT 'total', '', count(*) FROM u HAVING count(*) > 0",
        "evidence_score": f"WITH x AS (SELECT *, length(content)::DOUBLE % 1000 AS score FROM code_units WHERE id IS NOT NULL) SELECT DISTINCT id, round({_evidence_sql('score')}, 6) AS evidence FROM x",
        "coverage_score": f"WITH {_hit(20)} SELECT query_id, id, (40 * len(list_filter({_tok('query')}, lambda t: contains({_HAY}, lower(t)))))::INT AS coverage FROM hits",
        "rule_rerank": f"WITH {_hit(30)}, m AS (SELECT *, len(list_filter({_tok('query')}, lambda t: contains({_HAY}, lower(t)))) AS n FROM hits), r AS (SELECT query_id, id, rank AS old, {_evidence_sql('score', 'n')} + 40 * n AS rel FROM m) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, old)::INT AS rank, id, round(rel, 6) AS relevance FROM r QUALIFY rank <= 10",
        "merge_unique": f"WITH {_knn(20)}, b AS (SELECT query_id, id, score, rank, 0 AS side FROM near WHERE rank % 2 = 0 UNION ALL SELECT query_id, id, score + 1, rank, 1 FROM near WHERE rank % 3 = 0), o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY side, rank) = 1) SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY side, rank, id)::INT AS merged_rank FROM o",
        "evidence_sufficient": f"WITH {_hit(8)} SELECT query_id, count(*) FILTER (type IN ('function', 'component') AND contains(lower(file_path), '/src/') AND NOT contains(lower(file_path), '/docs/') AND len(list_filter({_tok('query')}, lambda t: contains({_HAY}, lower(t)))) > 0 AND rank <= 4) >= 2 AS enough FROM hits GROUP BY 1",
        "path_key": "WITH p AS (SELECT DISTINCT file_path, lower(replace(file_path, chr(92), '/')) AS p FROM code_units), s AS (SELECT *, substring(p, instr(p, '/src/') + 5) AS sub, list_filter(string_split(p, '/'), lambda x: x <> '') AS w, list_filter(string_split(substring(p, instr(p, '/src/') + 5), '/'), lambda x: x <> '') AS i FROM p) SELECT file_path, CASE WHEN instr(p, '/src/') > 0 THEN CASE WHEN len(i) > 0 THEN array_to_string(i[1:2], '/') ELSE sub END ELSE array_to_string(w[greatest(1, len(w) - 2):len(w)], '/') END AS module FROM s",
        "jaccard_pairs": f"WITH {_hit(10)}, t AS (SELECT query_id, rank, id, {_tok('concat_ws(chr(32), file_path, name, content)')} AS t FROM hits) SELECT b.query_id, b.id, CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0::DOUBLE ELSE round(len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))), 6) END AS similarity FROM t a JOIN t b ON a.query_id = b.query_id AND a.rank = 1",
        "mapped_keywords": f"WITH x AS (SELECT doc_id, text, flatten({mapped}) AS f FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, list_distinct(CASE WHEN len(f) > 0 THEN f ELSE list_concat(regexp_extract_all(text, '[\\x{{4e00}}-\\x{{9fa5}}]{{2,4}}'), [text]) END) AS k FROM x) SELECT doc_id, len(k)::INT AS keywords, {_hash_sql('k')} FROM y",
        "recall_expand": f"WITH x AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), y AS (SELECT doc_id, t, flatten({concept}) AS f FROM x), z AS (SELECT doc_id, t, list_filter(f, lambda w, i: list_position(f, w) = i) AS g FROM y) SELECT doc_id, CASE WHEN len(g) > 0 THEN t || ' ' || array_to_string(g[1:6], ' ') ELSE t END AS recall FROM z",
        "snippet": f"WITH {_hit(10)}, x AS (SELECT query_id, id, content AS c, lower(content) AS lc FROM hits), y AS (SELECT *, list_filter(['return', 'export', 'const'], lambda t: contains(lc, t))[1] AS hit, length(c) AS n FROM x), z AS (SELECT *, greatest(0, instr(lc, hit) - 1 - 200) AS s0 FROM y), w AS (SELECT *, least(n, s0 + 400) AS e, greatest(0, least(n, s0 + 400) - 400) AS s FROM z) SELECT query_id, id, CASE WHEN n <= 400 THEN c WHEN hit IS NULL THEN substring(c, 1, 400) || '...' ELSE (CASE WHEN s > 0 THEN '...' ELSE '' END) || substring(c, s + 1, e - s) || (CASE WHEN e < n THEN '...' ELSE '' END) END AS snippet FROM w",
        "bridge_terms": f"WITH {_hit(8)}, {_BRIDGE} SELECT query_id, array_to_string(list_filter(f, lambda w, i: list_position(f, w) = i)[1:8], ' ') AS terms FROM g",
        "context_block": f"WITH {_hit(5)}, {_BLOCKS} SELECT query_id, string_agg(b, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context FROM blocks GROUP BY 1",
        "token_budget": f"WITH {_hit(5)}, {_BLOCKS}, x AS (SELECT query_id, {len(S.CHAT_PROMPT.replace('{question}', 'q').replace('{context}', ''))} + length(string_agg(b, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS n FROM blocks GROUP BY 1), y AS (SELECT query_id, ceil(n / 2.5)::BIGINT AS tokens FROM x) SELECT query_id, tokens, round(tokens * 100.0::DOUBLE / 32768, 2) AS usage, greatest(0, 32768 - tokens)::BIGINT AS remaining FROM y",
        "citation_valid": f"WITH {answers} SELECT doc_id, array_to_string(list_sort(cited), '|') AS cited, regexp_matches(answer, '##\\s*结论') AND regexp_matches(answer, '##\\s*证据') AND len(cited) >= least(2, sources) AND len(cited) > 0 AND regexp_matches(regexp_extract(answer, '##\\s*结论([\\s\\S]*?)(##\\s*证据|##\\s*不确定项|##\\s*建议|\\z)', 1), '来源\\[\\d+\\]') AS valid, contains(answer, '```') AS fenced FROM b",
        "vocab_freq": words + " SELECT word, freq FROM f",
        "vocab_top": words + " SELECT word, freq FROM f ORDER BY freq DESC, word LIMIT 50",
        "vocab_match": words + f", {_Q} SELECT DISTINCT query_id, word FROM q, f WHERE lower(word) <> '' AND contains(lower(query), lower(word))",
        "camel_words": "WITH x AS (SELECT DISTINCT name, string_split(regexp_replace(coalesce(name, ''), '([A-Z])', chr(1) || '\\1', 'g'), chr(1)) AS p FROM functions), y AS (SELECT name, unnest(list_filter(p, lambda w: length(w) > 2)) AS w FROM x) SELECT DISTINCT name, lower(w) AS word FROM y",
        "query_stats": f"WITH {hist} SELECT count(*) AS total, count(*) FILTER (feedback = 'good') AS good, count(*) FILTER (feedback = 'bad') AS bad FROM h",
        "feedback_latest": f"WITH {hist} SELECT query_id, event_id, feedback FROM h WHERE feedback IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY ts DESC, event_id DESC) = 1",
        "p4_found": _CHANGES + "SELECT project, relative_path FROM changes WHERE status IN ('added', 'modified')",
        "p4_changes": _CHANGES + "SELECT project, relative_path, status FROM changes",
        "incremental_diff": _CHANGES + "SELECT project, status, count(*) AS files FROM changes GROUP BY 1, 2",
        "delete_by_path": "SELECT DISTINCT id, project, file_path, type FROM code_units u WHERE NOT EXISTS (SELECT 1 FROM code_units c WHERE c.type = 'component' AND c.project = u.project AND c.file_path = u.file_path)",
        "file_filter": f"SELECT DISTINCT project, relative_path FROM files WHERE {_EXT.format(x=rel)} IN ({', '.join(repr(e) for e in S.EXTENSIONS)}) AND NOT list_has_any(string_split({rel}, '/')[1:-2], {S.PRUNED_DIRS}) AND NOT regexp_matches(regexp_extract({rel}, '([^/]*)$', 1), '{denied}')",
        "small_files": "SELECT DISTINCT path, size FROM files WHERE extension IN ('.vue', '.js') AND size > 100 AND size < 50000 ORDER BY path, size LIMIT 50",
        "project_lookup": "WITH k AS (SELECT name AS key FROM projects UNION SELECT project FROM files UNION SELECT project_id || '?' FROM index_runs), n AS (SELECT id, name, replace(path, chr(92), '/') AS path, indexed FROM projects WHERE id IS NOT NULL), b AS (SELECT id AS key, 0 AS w, * FROM n UNION ALL SELECT name, 1, * FROM n WHERE name IS NOT NULL), o AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY w, id) = 1) SELECT k.key, o.id, o.name, o.path, o.indexed::VARCHAR AS indexed FROM k LEFT JOIN o USING (key) WHERE k.key IS NOT NULL",
        "ext_label": f"SELECT DISTINCT relative_path, {_label(_EXT.format(x='relative_path'))} AS label FROM files",
        "deps_extract": "SELECT DISTINCT file_id, array_to_string(regexp_extract_all(content, '(?:import|require)\\s*\\(?[''\"]([^''\"]+)[''\"]\\)?', 1), '|') AS deps FROM files WHERE content IS NOT NULL",
        "props_emits": "SELECT DISTINCT file_id, array_to_string(list_filter(list_transform(string_split(regexp_extract(content, 'props:\\s*\\{([^}]+)\\}', 1), ','), lambda x: trim(regexp_replace(string_split(x, ':')[1], '\\s+', ' ', 'g'))), lambda x: x <> ''), '|') AS props, array_to_string(list_filter(list_transform(string_split(regexp_extract(content, 'emits:\\s*\\[([^\\]]+)\\]', 1), ','), lambda x: trim(regexp_replace(trim(x), '[''\"`]', '', 'g'))), lambda x: x <> ''), '|') AS emits FROM files WHERE content IS NOT NULL",
        "file_hash": "SELECT DISTINCT file_id, md5(content) AS hash, len(string_split(content, chr(10)))::INT AS lines FROM files WHERE content IS NOT NULL",
        "file_text": f"SELECT DISTINCT file_id, md5('文件路径: ' || relative_path || chr(10) || '类型: ' || {_label(_EXT.format(x='relative_path'))} || chr(10) || '文件名: ' || regexp_extract(path, '([^/\\\\]*)$', 1) || chr(10) || chr(10) || '代码内容:' || chr(10) || content || chr(10)) AS hash FROM files WHERE content IS NOT NULL",
        "semantic_text": f"SELECT DISTINCT func_id, md5(concat_ws(chr(10), '文件: ' || coalesce(name, ''), '函数签名: ' || CASE WHEN is_async THEN 'async ' ELSE '' END || coalesce(name, '') || '(' || coalesce(array_to_string(params, ', '), '') || ')', '类型: ' || {name_label}, CASE WHEN is_exported THEN '导出函数' ELSE '内部函数' END, CASE WHEN comments <> '' THEN chr(10) || '功能说明: ' || trim(regexp_replace(comments, '(?m)^\\s*\\*\\s*', '', 'g')) END, chr(10) || '代码摘要:' || chr(10) || substring(coalesce(content, ''), 1, 500) || CASE WHEN length(coalesce(content, '')) > 500 THEN '...' ELSE '' END)) AS hash FROM functions",
        "embed_text": "SELECT DISTINCT id, (CASE WHEN length(coalesce(content, '')) > 2990 THEN 2993 ELSE length(coalesce(content, '')) END)::INT AS chars, ceil(length(coalesce(content, '')) / 2.5)::BIGINT AS tokens FROM code_units",
        "unit_tokens": f"SELECT DISTINCT id, len({_tok('concat_ws(chr(32), file_path, name, content)')})::INT AS tokens, {_hash_sql(_tok('concat_ws(chr(32), file_path, name, content)'))} FROM code_units",
        "fallback_keywords": "WITH x AS (SELECT doc_id, regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\\S+', '', 'g'), '[【】\\[\\]]', ' ', 'g'), '[\\x{4e00}-\\x{9fa5}]{2,6}') AS f FROM documents) SELECT doc_id, array_to_string(list_filter(f, lambda w, i: list_position(f, w) = i)[1:5], '|') AS keywords FROM x",
        "analysis_summary": f"WITH f AS (SELECT DISTINCT file_id, func_id, is_async, is_exported FROM functions WHERE file_id IS NOT NULL), c AS (SELECT file_id, count(*) AS n, count(*) FILTER (is_async AND is_exported) AS h, count(*) FILTER (is_async AND NOT is_exported) AS m FROM f GROUP BY 1) SELECT file_id AS report_id, replace('{S.SUMMARY}', '{{n}}', n::VARCHAR) || CASE WHEN h > 0 THEN replace('{S.SUMMARY_HIGH}', '{{n}}', h::VARCHAR) WHEN m > 0 THEN replace('{S.SUMMARY_MEDIUM}', '{{n}}', m::VARCHAR) ELSE '{S.SUMMARY_NONE}' END AS summary FROM c",
        "search_project": f"WITH {_knn(40)}, {_U}, r AS (SELECT near.query_id, near.id, near.score FROM near JOIN u USING (id) WHERE u.project IN {two}){outlier.format(rows='r')} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INT AS rank, id, score FROM cut QUALIFY rank <= 20",
        "search_before": f"WITH {_Q}, v AS (SELECT * FROM ({_V[6:-1]}) JOIN (SELECT DISTINCT id FROM code_units WHERE project IN {two} AND type IN ('function', 'component')) USING (id)), near AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INT AS rank FROM (SELECT q.query_id, v.id, min(round({_L2}, 6)) AS score FROM q, v GROUP BY 1, 2) QUALIFY rank <= 10) SELECT query_id, rank, id, score FROM near",
        "search_bounds": f"WITH {_knn(40, score=cosine, more=_DOT.format(a='v.vector', b='v.vector') + ' > 0')}, {_U}, r AS (SELECT near.query_id, near.id, near.score FROM near JOIN u USING (id) WHERE 1 - near.score >= 0.2 AND contains(u.file_path, '/src/')) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INT AS rank, id, score FROM r QUALIFY rank <= 20",
        "distance_top": f"WITH {_knn(6)} SELECT query_id, id, score, rank FROM near",
        "trusted_expansions": f"WITH {_Q}, e AS (SELECT a.query_id, a.query, coalesce(b.query, '') AS e1, coalesce(c.query, '') AS e2, coalesce(d.query, '') AS e3, b.query IS NULL AS last FROM q a LEFT JOIN q b ON b.query_id = a.query_id + 100 LEFT JOIN q c ON c.query_id = a.query_id + 200 LEFT JOIN q d ON d.query_id = a.query_id + 300), l AS (SELECT query_id, query, unnest([e1, concat_ws(' ', substring(query, 1, 200), e1), e2, e3]) AS x, unnest([0, 1, 2, 3]) AS pos FROM e), t AS (SELECT query_id, pos, x, {_tok('query')} AS a, {_tok('x')} AS b FROM l), o AS (SELECT * FROM t WHERE least(len(a), len(b)) > 0 AND len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) >= 0.2) SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY pos)::INT AS n, md5(x) AS hash FROM o QUALIFY n <= 2",
        "recall_union": f"WITH {_Q}, {_V}, {_round(0, 10, 'r0')}, {_round(1, 5, 'r1')}, {_round(2, 5, 'r2')}, b AS (SELECT *, 0 AS n FROM r0 UNION ALL SELECT query_id, id, score * 1.1::DOUBLE, 1 FROM r1 UNION ALL SELECT query_id, id, score * 1.1::DOUBLE, 2 FROM r2) SELECT query_id, id, score, n::INT AS n FROM b QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY n, score) = 1",
        "multi_round": f"WITH {_Q}, {_V}, {_round(0, 5, 'r0')}, {_round(1, 3, 'r1')}, {_round(2, 5, 'r2')}, b AS (SELECT *, 1 AS round FROM r0 UNION ALL SELECT *, 2 FROM r1 UNION ALL SELECT *, 3 FROM r2), f AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY query_id, id ORDER BY round, score) = 1) SELECT query_id, id, round::INT AS round, score FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, id) <= 10",
        "select_mmr": f"WITH RECURSIVE {_hit(30)}, m AS (SELECT *, len(list_filter({_tok('query')}, lambda t: contains({_HAY}, lower(t)))) AS n, {_tok('concat_ws(chr(32), file_path, name, content)')} AS t FROM hits), e AS (SELECT query_id, id, t, rank AS old, {_evidence_sql('score', 'n')} + 40 * n AS rel FROM m), c AS (SELECT query_id, id, t, rel::DOUBLE AS rel, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, old)::INT AS i FROM e), p AS (SELECT a.query_id, a.i AS a, b.i AS b, CASE WHEN len(a.t) = 0 OR len(b.t) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a.t, b.t))::DOUBLE / len(list_distinct(list_concat(a.t, b.t))) END AS sim FROM c a JOIN c b ON a.query_id = b.query_id AND a.i <> b.i), r AS (SELECT query_id, 1 AS step, [i] AS chosen FROM c WHERE i = 1 UNION ALL SELECT query_id, step + 1, list_append(chosen, list(i ORDER BY gain DESC, i)[1]) FROM (SELECT r.query_id, r.step, r.chosen, c.i, 0.7::DOUBLE * c.rel - (1 - 0.7::DOUBLE) * max(p.sim) * 100 AS gain FROM r JOIN c ON c.query_id = r.query_id JOIN p ON p.query_id = r.query_id AND p.a = c.i AND list_contains(r.chosen, p.b) WHERE r.step < 10 AND NOT list_contains(r.chosen, c.i) GROUP BY r.query_id, r.step, r.chosen, c.i, c.rel) GROUP BY query_id, step, chosen), l AS (SELECT query_id, unnest(chosen) AS i, unnest(range(1, 11)) AS position FROM r WHERE step = 10) SELECT l.query_id::VARCHAR AS query_id, c.id, l.position::INT AS position FROM l JOIN c ON c.query_id = l.query_id AND c.i = l.i",
        "keyword_filters": f"WITH {kw}, b AS (SELECT query_id, id, match_score, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, id)::INT AS rank FROM m WHERE match_score > 0 QUALIFY rank <= 50), {_U} SELECT b.* FROM b JOIN u USING (id) WHERE {kept}",
        "keyword_scan_cap": f"WITH {kw}, c AS (SELECT DISTINCT id FROM code_units WHERE id IS NOT NULL ORDER BY id LIMIT 10000) SELECT query_id, id, match_score, row_number() OVER (PARTITION BY query_id ORDER BY match_score DESC, id)::INT AS rank FROM m JOIN c USING (id) WHERE match_score > 0 QUALIFY rank <= 50",
        "smart_search": smart.replace("@limit@", "20").replace("@top@", "10").replace("@near@", "true").replace("@words@", "true"),
        "smart_search_filtered": smart.replace("@limit@", "20").replace("@top@", "10").replace("@near@", kept).replace("@words@", kept),
        "parse_functions": "SELECT DISTINCT func_id, type, start_line, end_line, is_async, is_exported, len(params)::INT AS params FROM functions WHERE func_id IS NOT NULL",
        "file_units": f"WITH f AS (SELECT DISTINCT ON (file_id) * FROM files WHERE file_id IS NOT NULL ORDER BY file_id, scanned_at DESC NULLS LAST, mtime_ms DESC NULLS LAST, size DESC NULLS LAST) SELECT project, relative_path, 'file' AS type, regexp_extract(path, '([^/\\\\]*)$', 1) AS name, 1 AS start_line, len(string_split(content, chr(10)))::INT AS end_line, {_EXT.format(x='relative_path')} AS extension, size, {file_hash} AS hash, array_to_string(regexp_extract_all(content, '(?:import|require)\\s*\\(?[''\"]([^''\"]+)[''\"]\\)?', 1), '|') AS deps FROM f WHERE content IS NOT NULL AND relative_path IS NOT NULL",
        "function_lines": "SELECT DISTINCT func_id, md5(n.content) AS hash FROM functions n JOIN (SELECT DISTINCT file_id, relative_path FROM files WHERE content IS NOT NULL) f USING (file_id) WHERE func_id IS NOT NULL AND NOT lower(f.relative_path) LIKE '%.vue'",
        "result_projection": "SELECT DISTINCT id, array_to_string(json_extract_string(CASE WHEN coalesce(dependencies, '') = '' THEN '[]' ELSE dependencies END, '$[*]'), '|') AS deps, json_extract_string(CASE WHEN coalesce(metadata, '') = '' THEN '{}' ELSE metadata END, '$.extension') AS extension, json_extract_string(CASE WHEN coalesce(metadata, '') = '' THEN '{}' ELSE metadata END, '$.functionType') AS kind FROM code_units WHERE id IS NOT NULL",
        "embedding_stats": "WITH e AS (SELECT event_type = 'error' AS bad, user_id % 4 + 1 AS a, value AS ms FROM events) SELECT count(*) AS calls, count(*) FILTER (bad) AS failed, round(avg(a) FILTER (NOT bad), 2) AS average_attempts, round(100 * avg((a = 1)::INT) FILTER (NOT bad), 1) AS first_try_percent, round(avg(ms) FILTER (NOT bad), 1) AS average_ms FROM e",
        "result_texts": f"WITH {_knn(10)}, u AS (SELECT id, max(file_path) AS file_path FROM code_units WHERE id IS NOT NULL GROUP BY id), f AS (SELECT DISTINCT ON (file_id) * FROM files WHERE file_id IS NOT NULL ORDER BY file_id, scanned_at DESC NULLS LAST, mtime_ms DESC NULLS LAST, size DESC NULLS LAST), g AS (SELECT path, max(content) AS content FROM f GROUP BY 1) SELECT near.query_id, near.id, md5(g.content) AS hash FROM near JOIN u USING (id) LEFT JOIN g ON g.path = u.file_path",
        "display_cut": f"WITH {_hit(10)} SELECT query_id, id, substring(id, 1, 18) AS short_id, substring(file_path, 1, 38) AS short_path, md5(CASE WHEN length(content) > 300 THEN substring(content, 1, 300) || '...' ELSE content END) AS hash FROM hits",
        "vector_preview": f"WITH {_Q} SELECT query_id, len(v)::INT AS dimensions, '[' || array_to_string(list_transform(v[1:5], lambda x: printf('%.6f', x::DOUBLE)), ', ') || '...]' AS preview FROM q",
        "chat_prompt": f"WITH {_hit(5)}, {_BLOCKS} SELECT query_id, md5({prompt_parts[0]} || string_agg(b, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) || {prompt_parts[1]}) AS hash FROM blocks GROUP BY 1",
        "answer_expansion": f"WITH x AS (SELECT doc_id, coalesce(text, '') AS query, flatten({mapped.replace('text', "coalesce(text, '')")}) AS f FROM documents) SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN md5('k1|login') WHEN doc_id % 5 = 4 THEN md5('a b') ELSE md5(array_to_string(list_sort(list_distinct(CASE WHEN len(f) > 0 THEN f ELSE list_concat(regexp_extract_all(query, '[\\x{{4e00}}-\\x{{9fa5}}]{{2,4}}'), [query]) END)), '|')) END AS hash, CASE WHEN doc_id % 5 < 2 THEN md5('e') ELSE md5(query) END AS expanded FROM x",
        "answer_understanding": "WITH x AS (SELECT doc_id, doc_id % 5 AS n, coalesce(text, '') AS query FROM documents) SELECT doc_id, CASE WHEN n < 2 THEN 'find' ELSE 'search' END AS intent, CASE WHEN n < 2 THEN md5('r') ELSE md5(query) END AS rewritten, CASE WHEN n < 2 THEN md5('k1|login') WHEN n = 4 THEN md5('a b') ELSE md5(array_to_string(list_sort(list_distinct(regexp_extract_all(query, '[\\x{4e00}-\\x{9fa5}]{2,4}'))), '|')) END AS hash, CASE WHEN n < 2 THEN 0.75::DOUBLE WHEN n = 4 THEN 0.9::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM x",
        "answer_analysis": "WITH x AS (SELECT doc_id, doc_id % 5 AS n, coalesce(text, '') AS t, regexp_extract_all(regexp_replace(regexp_replace(coalesce(text, ''), 'https?://\\S+', '', 'g'), '[【】\\[\\]]', ' ', 'g'), '[\\x{4e00}-\\x{9fa5}]{2,6}') AS f FROM documents) SELECT doc_id, CASE WHEN n < 2 THEN 'Box' ELSE 'unknown' END AS component, CASE WHEN n < 2 THEN 's' ELSE '' END AS steps, CASE WHEN n < 2 THEN 'y' WHEN n = 4 THEN '' ELSE substring(t, 1, 100) END AS symptom, CASE WHEN n < 2 THEN 'c1|c2' ELSE '' END AS causes, CASE WHEN n < 2 THEN 'w' WHEN n = 4 THEN '' ELSE array_to_string(list_filter(f, lambda w, i: list_position(f, w) = i)[1:5], '|') END AS keywords FROM x",
        "rerank_scores": f"WITH {_knn(25)}, s AS (SELECT *, CASE WHEN query_id % 300 = 0 THEN coalesce([3, 9, 1, 7, 9][rank], 0) END AS rerank_score FROM near WHERE query_id % 300 <> 0 OR rank <= 20) SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, s.rank, id)::INT AS rank, coalesce(rerank_score, -1)::INT AS rerank_score FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC NULLS LAST, s.rank, id) <= 10",
        "fallback_answer": f"WITH {_hit(5)}, l AS (SELECT query_id, max(query) AS query, string_agg({fill(S.FALLBACK_CONCLUSION)} || chr(10), '' ORDER BY rank) FILTER (rank <= 2) AS c, string_agg({fill(S.FALLBACK_EVIDENCE)} || chr(10), '' ORDER BY rank) FILTER (rank <= 3) AS e FROM hits GROUP BY 1) SELECT query_id, md5('## 结论' || chr(10) || c || chr(10) || '## 证据' || chr(10) || e || chr(10) || '## 不确定项' || chr(10) || replace('{S.FALLBACK_UNSURE}', '{{question}}', query) || chr(10) || chr(10) || '## 建议' || chr(10) || '{S.FALLBACK_ADVICE}') AS hash FROM l",
        "context_clamp": f"WITH {_hit(5)}, {_BLOCKS.replace('1200', '200').replace('- 600', '- 100')} SELECT query_id, md5(string_agg(b, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS hash FROM blocks GROUP BY 1",
        "vocab_set": "WITH w AS (SELECT unnest(list_concat(" + _words_sql() + ", list_transform(list_filter(string_split(regexp_replace(coalesce(name, ''), '([A-Z])', chr(1) || '\\1', 'g'), chr(1)), lambda w: length(w) > 2), lambda w: lower(w)))) AS word FROM code_units) SELECT DISTINCT word, 1::BIGINT AS freq FROM w",
        "vocab_match_both": words + ", n AS (SELECT DISTINCT func_id AS query_id, lower(name) AS q FROM functions WHERE name <> ''), d AS (SELECT DISTINCT q FROM n), h AS (SELECT q, word FROM d, f WHERE lower(word) <> '' AND (contains(q, lower(word)) OR contains(lower(word), q))) SELECT DISTINCT query_id, word FROM n JOIN h USING (q)",
        "vocab_keywords": words + f", {_Q}, h AS (SELECT query_id, list_distinct(list(word)) AS w FROM q, f WHERE lower(word) <> '' AND contains(lower(query), lower(word)) GROUP BY 1) SELECT q.query_id, {_hash_sql('coalesce(w, list_distinct(regexp_extract_all(query, ' + chr(39) + '[' + chr(92) + 'x{4e00}-' + chr(92) + 'x{9fa5}]{2,4}' + chr(39) + ')))')} FROM q LEFT JOIN h USING (query_id)",
        "vocab_stats": words + " SELECT (SELECT count(*) FROM f) AS total, (row_number() OVER (ORDER BY freq DESC, word) - 1)::INT AS n, word, freq FROM f QUALIFY n < 20",
        "top_keywords": f"WITH {kw} SELECT keyword, count(*) AS n FROM k, h WHERE contains(hay, keyword) GROUP BY 1 ORDER BY n DESC, keyword LIMIT 20",
    }
