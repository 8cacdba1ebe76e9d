"""Steps that ask a chat model, each with what it falls back to when the answer cannot be used."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein import schema as S
from skein.functions import text as T
from skein.models import ChatModel, ask, json_integers, json_object
from skein.operators.context import fallback_answer

_CJK = re.compile(S.CJK_RUN + "{2,4}")


def simple_keywords(query: str) -> list[str]:
    found = [w for k, v in S.KEYWORD_MAP.items() if k in query for w in (k, *v)]
    return list(dict.fromkeys(found or [*_CJK.findall(query), query]))


def expand_query(chat: ChatModel, query: str) -> dict:
    """keywords and expanded queries; without a usable answer the dictionary's keywords and the query."""
    try:
        found = json_object(ask(chat, f"Give search keywords and up to three rewordings of this query about code as JSON {{\"keywords\": [...], \"expandedQueries\": [...]}}.\n{query}"))
        if found and isinstance(found.get("keywords"), list):
            return {"keywords": found["keywords"], "expanded": found.get("expandedQueries") or [query]}
    except Exception:
        pass
    return {"keywords": simple_keywords(query), "expanded": [query]}


def understand(chat: ChatModel, query: str, vocabulary: list[str]) -> dict:
    """intent, rewritten, keywords and confidence; the fallback has confidence 0.3 and the vocabulary's words in the query."""
    try:
        found = json_object(ask(chat, f"Vocabulary: {', '.join(vocabulary)}\nQuery: {query}\nAnswer as JSON {{\"intent\", \"rewrittenQuery\", \"keywords\", \"confidence\"}}."))
        if found:
            return {"intent": found.get("intent", "search"), "rewritten": found.get("rewrittenQuery", query), "keywords": found.get("keywords", []), "confidence": float(found.get("confidence", 0.5))}
    except Exception:
        pass
    low = query.lower()
    words = [w for w in vocabulary if w.lower() in low or low in w.lower()]
    return {"intent": "search", "rewritten": query, "keywords": words or _CJK.findall(query), "confidence": 0.3}


# The same readings of answers as columns, for tables of answers. ---------------


def _object(answer: Column | str) -> tuple[Column, Column]:
    """The outermost JSON object of an answer, and whether it can be read."""
    x = F.regexp_extract(F.coalesce(T.col(answer), F.lit("")), r"\{[\s\S]*\}", 0)
    return x, (x != "") & F.try_parse_json(x).isNotNull()


def expansion(answer: Column | str, query: Column | str) -> list[Column]:
    """Columns keywords and expanded of an answer to ``expand_query``; without a usable answer the dictionary's keywords and the query."""
    x, ok = _object(answer)
    found = F.from_json(x, "keywords array<string>, expandedQueries array<string>")
    ok = ok & found["keywords"].isNotNull()
    own = F.array(T.col(query))
    return [F.when(ok, found["keywords"]).otherwise(T.mapped_keywords(query)).alias("keywords"), F.when(ok & (F.size(found["expandedQueries"]) > 0), found["expandedQueries"]).otherwise(own).alias("expanded")]


def understanding(answer: Column | str, query: Column | str, words: Column) -> list[Column]:
    """Columns intent, rewritten, keywords and confidence of an answer to ``understand``; ``words`` are the keywords without a usable answer."""
    x, ok = _object(answer)
    found = F.from_json(x, "intent string, rewrittenQuery string, keywords array<string>, confidence double")
    none = F.array().cast("array<string>")
    return [
        F.when(ok, F.coalesce(found["intent"], F.lit("search"))).otherwise("search").alias("intent"), F.when(ok, F.coalesce(found["rewrittenQuery"], T.col(query))).otherwise(T.col(query)).alias("rewritten"),
        F.when(ok, F.coalesce(found["keywords"], none)).otherwise(words).alias("keywords"), F.when(ok, F.coalesce(found["confidence"], F.lit(0.5))).otherwise(0.3).alias("confidence"),
    ]


def report_analysis(answer: Column | str, report: Column | str) -> list[Column]:
    """Columns component, steps, symptom, causes and keywords of an answer to ``analyze_report``, or what the report alone gives."""
    x, ok = _object(answer)
    found = F.from_json(x, "componentName string, steps array<string>, symptom string, possibleCauses array<string>, searchKeywords array<string>")
    none, text = F.array().cast("array<string>"), F.coalesce(T.col(report), F.lit(""))
    return [
        F.when(ok, F.coalesce(found["componentName"], F.lit("unknown"))).otherwise("unknown").alias("component"), F.when(ok, F.coalesce(found["steps"], none)).otherwise(none).alias("steps"), F.when(ok, F.coalesce(found["symptom"], F.lit(""))).otherwise(F.substring(text, 1, 100)).alias("symptom"),
        F.when(ok, F.coalesce(found["possibleCauses"], none)).otherwise(none).alias("causes"), F.when(ok, F.coalesce(found["searchKeywords"], none)).otherwise(T.issue_keywords(text)).alias("keywords"),
    ]


def reranked(results: DataFrame, answers: DataFrame, top: int = 10, shown: int = 20) -> DataFrame:
    """(query_id, id, rank, rerank_score): the results of each query (query_id, id, rank) in the order of the scores in its answer (query_id, answer).

    As ``model_rerank``: of the first ``shown`` those without a score count 0; an
    answer without a list of whole numbers, or none, keeps the order and gives no score.
    """
    listed = F.from_json(F.regexp_extract(F.coalesce("answer", F.lit("")), r"\[[\d\s,]+\]", 0), "array<int>")
    scores = answers.select("query_id", listed.alias("__s")).groupBy("query_id").agg(F.max("__s").alias("__s"))
    rows = results.select("query_id", "id", "rank").join(scores, "query_id", "left").where(F.col("__s").isNull() | (F.col("rank") <= shown))
    rows = rows.withColumn("rerank_score", F.when(F.col("__s").isNotNull(), F.coalesce(F.get("__s", F.col("rank") - 1), F.lit(0))))
    n = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rank", "id"))
    return rows.withColumn("n", n).where(F.col("n") <= top).select("query_id", "id", F.col("n").alias("rank"), "rerank_score")


def model_rerank(chat: ChatModel, query: str, results: list[dict], top: int = 10, shown: int = 20) -> list[dict]:
    """The first ``shown`` results by the model's scores, best first; unscored count 0, and an unusable answer keeps their order."""
    some = results[:shown]
    listing = "\n".join(f"[{i}] {r['name']} ({r['type']}) {r['file_path']}\n{r['content'][:200]}..." for i, r in enumerate(some, 1))
    try:
        scores = json_integers(ask(chat, f"Query: {query}\n{listing}\nScore each result from 0 to 10. Answer with a JSON list only."))
    except Exception:
        scores = None
    if scores is None:
        return results[:top]
    scored = [r | {"rerank_score": scores[i] if i < len(scores) else 0} for i, r in enumerate(some)]
    return sorted(scored, key=lambda r: -r["rerank_score"])[:top]


@dataclass
class Analysis:
    component: str = "unknown"
    steps: list = field(default_factory=list)
    symptom: str = ""
    causes: list = field(default_factory=list)
    keywords: list = field(default_factory=list)


def analyze_report(chat: ChatModel, report: str) -> Analysis:
    try:
        found = json_object(ask(chat, f"Analyse this report; answer as JSON {{\"componentName\", \"steps\", \"symptom\", \"possibleCauses\", \"searchKeywords\"}}.\n{report}"))
        if found:
            return Analysis(found.get("componentName", "unknown"), found.get("steps", []), found.get("symptom", ""), found.get("possibleCauses", []), found.get("searchKeywords", []))
    except Exception:
        pass
    clean = re.sub(r"[【】\[\]]", " ", re.sub(r"https?://\S+", "", report))
    return Analysis(symptom=report[:100], keywords=list(dict.fromkeys(re.findall(S.CJK_RUN + "{2,6}", clean)))[:5])


def analyze_code(chat: ChatModel, symptom: str, causes: list, results: list[dict]) -> dict:
    """suspicious places, data flow, suggestions and related code; the fallback marks every snippet as of low confidence."""
    some = results[:5]
    try:
        found = json_object(ask(chat, f"Symptom: {symptom}\nCauses: {json.dumps(causes, ensure_ascii=False)}\nCode: {json.dumps([r['content'] for r in some], ensure_ascii=False)}\nAnswer as JSON {{\"suspiciousCode\", \"dataFlow\", \"fixSuggestions\", \"relatedCode\"}}."))
        if found and isinstance(found.get("suspiciousCode"), list):
            return {"suspicious": found["suspiciousCode"], "flow": found.get("dataFlow", []), "suggestions": found.get("fixSuggestions", []), "related": found.get("relatedCode", [])}
    except Exception:
        pass
    return {"suspicious": [{"filePath": r["file_path"], "startLine": r["start_line"], "endLine": r["end_line"], "reason": "", "confidence": "low"} for r in some], "flow": [], "suggestions": [], "related": []}


def rewrite(chat: ChatModel, question: str) -> str:
    """The question as English key words for a search, as the model gives it."""
    return chat.chat([{"role": "system", "content": S.REWRITE_PROMPT}, {"role": "user", "content": question}]).strip()


def _summary(results, high, medium) -> str:
    tail = S.SUMMARY_HIGH.format(n=high) if high else S.SUMMARY_MEDIUM.format(n=medium) if medium else S.SUMMARY_NONE
    return S.SUMMARY.format(n=results) + tail


def summary(results: int, suspicious: list[dict]) -> str:
    """One line on how many places are suspicious: the high ones, else the medium ones, else none."""
    return _summary(results, *(sum(c.get("confidence") == k for c in suspicious) for k in ("high", "medium")))


def summaries(places: DataFrame) -> DataFrame:
    """(report_id, summary) of suspicious places (report_id, results, confidence), as ``summary`` says it; the greatest ``results`` of a report counts."""
    counted = places.groupBy("report_id").agg(F.max("results").alias("n"), F.count_if(F.col("confidence") == "high").alias("high"), F.count_if(F.col("confidence") == "medium").alias("medium"))

    def said(text: str, n: str):
        before, after = text.split("{n}")
        return F.concat(F.lit(before), F.col(n).cast("string"), F.lit(after))

    tail = F.when(F.col("high") > 0, said(S.SUMMARY_HIGH, "high")).when(F.col("medium") > 0, said(S.SUMMARY_MEDIUM, "medium")).otherwise(S.SUMMARY_NONE)
    return counted.select("report_id", F.concat(said(S.SUMMARY, "n"), tail).alias("summary"))


def rounds(found: DataFrame, most: int = 10) -> DataFrame:
    """(query_id, id, round, score): results of several rounds (query_id, id, round, score), each id in the first round that found it, then its best score; the ``most`` best of a query by score, ties by id."""
    best = found.groupBy("query_id", "id").agg(F.min(F.struct("round", "score")).alias("b")).select("query_id", "id", "b.round", "b.score")
    n = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return best.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def cited(answer: str, sources: int) -> set[int]:
    return {int(n) for n in re.findall(r"来源\[(\d+)\]", answer) if 1 <= int(n) <= sources}


def is_grounded(answer: str, sources: int) -> bool:
    conclusion = re.search(r"##\s*结论([\s\S]*?)(?=##\s*证据|##\s*不确定项|##\s*建议|\Z)", answer)
    return bool(re.search(r"##\s*证据", answer) and conclusion and cited(answer, sources) and len(cited(answer, sources)) >= min(2, sources) and re.search(r"来源\[\d+\]", conclusion.group(1)))


def grounded_answer(chat: ChatModel, question: str, prompt: str, sources: list[dict], wider_prompt: str | None = None, wider: list[dict] | None = None) -> tuple[str, int]:
    """An answer that cites its sources, and the calls it took (at most five).

    Asks again more strictly if citations are wanting, then over a wider context
    if there is one, then strictly over that, then without code; in the end an
    answer made from the sources alone stands in for one that still lacks citations.
    """
    used, base, calls = sources, prompt, 0

    def once(more: str = "") -> str:
        nonlocal calls
        calls += 1
        return ask(chat, f"{base}\n\n{more.format(n=len(used))}" if more else base)

    answer = once()
    if not is_grounded(answer, len(used)):
        answer = once(S.STRICT_PROMPT)
    if wider_prompt and wider and len(cited(answer, len(used))) < min(2, len(used)) and len(wider) > len(used):
        used, base = wider, wider_prompt
        answer = once(S.WIDER_PROMPT)
        if not is_grounded(answer, len(used)):
            answer = once(S.STRICT_PROMPT)
    if "```" in answer:
        answer = once(S.NO_CODE_PROMPT)
    if not is_grounded(answer, len(used)):
        answer = fallback_answer(question, used)
    return answer, calls
