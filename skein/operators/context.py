"""Context blocks, prompts, budgets and checks of answers."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein import schema as S
from skein.functions import text as T


def block(position: Column, content: Column, with_dependencies: bool = True) -> Column:
    """One numbered source: place, name, type, dependencies if any, and code."""
    place = F.concat(F.lit("文件: "), F.coalesce("file_path", F.lit("")), F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("")))
    lines = [F.concat(F.lit("来源["), position.cast("string"), F.lit("]")), place, F.concat(F.lit("名称: "), F.coalesce("name", F.lit(""))), F.concat(F.lit("类型: "), F.coalesce("type", F.lit("")))]
    if with_dependencies:
        lines.append(F.when(F.size("dependencies") > 0, F.concat(F.lit("依赖: "), F.array_join("dependencies", ", "))))
    return F.concat_ws("\n", *lines, F.lit("代码片段:"), content)


def context(results: DataFrame, snippet_chars: int = S.SNIPPET_CHARS, with_dependencies: bool = True) -> DataFrame:
    """(query_id, context): the blocks of each query's results in the order of their rank.

    results: query_id, query, rank and unit fields with dependencies as an array.
    A query has as many results as it was given, a bounded list.
    """
    content = T.snippet("content", T.tokens("query"), max(200, snippet_chars))
    rows = results.select("query_id", F.struct("rank", block(F.col("rank"), content, with_dependencies).alias("b")).alias("r"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["b"]), S.BLOCK_SEPARATOR).alias("context"))


def chat_prompt(question: Column, text: Column) -> Column:
    before, rest = S.CHAT_PROMPT.split("{question}")
    between, after = rest.split("{context}")
    return F.concat(F.lit(before), F.coalesce(question, F.lit("")), F.lit(between), F.coalesce(text, F.lit("")), F.lit(after))


def budget(text: Column, limit: int = S.CONTEXT_LIMIT) -> list[Column]:
    """Columns tokens, usage (percent, two decimals) and remaining of a prompt."""
    n = T.token_estimate(text)
    return [n.alias("tokens"), F.round(n * 100.0 / limit, 2).alias("usage"), F.greatest(F.lit(0), limit - n).alias("remaining")]


def citations(answer: Column, sources: Column) -> Column:
    """Distinct source numbers in an answer that name one of its sources."""
    found = F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"来源\[(\d{1,9})\]"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda x: x.cast("int")), lambda n: (n >= 1) & (n <= sources)))


def valid_citation(answer: Column, sources: Column) -> Column:
    """Whether an answer has its two main sections, cites enough sources, and cites one in its conclusion."""
    a = F.coalesce(answer, F.lit(""))
    conclusion = F.regexp_extract(a, r"##\s*结论([\s\S]*?)(##\s*证据|##\s*不确定项|##\s*建议|$(?![\s\S]))", 1)
    return a.rlike(r"##\s*结论") & a.rlike(r"##\s*证据") & (F.size(citations(a, sources)) >= F.least(F.lit(2), sources)) & (F.size(citations(a, sources)) > 0) & conclusion.rlike(r"来源\[\d+\]")


def has_code_fence(answer: Column) -> Column:
    return F.contains(F.coalesce(answer, F.lit("")), F.lit("```"))


def fallback_answer(question: str, results: list[dict]) -> str:
    """An answer from the first results alone, for when the model's cannot be used."""
    parts = ["## 结论", *(S.FALLBACK_CONCLUSION.format(i=i, **r) for i, r in enumerate(results[:2], 1))]
    parts += ["", "## 证据", *(S.FALLBACK_EVIDENCE.format(i=i, **r) for i, r in enumerate(results[:3], 1))]
    parts += ["", "## 不确定项", S.FALLBACK_UNSURE.format(question=question), "", "## 建议", S.FALLBACK_ADVICE]
    return "\n".join(parts)


def fallback_answers(results: DataFrame) -> DataFrame:
    """(query_id, answer) of results (query_id, query, rank, name, type, file_path and lines), as ``fallback_answer`` makes it."""

    def line(pattern: str, row: Column) -> Column:
        parts = re.split(r"\{(\w+)\}", pattern)
        return F.concat(*[F.coalesce(row[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(parts)])

    rows = results.where("rank <= 3").select("query_id", "query", F.struct(F.col("rank").alias("i"), "name", "type", "file_path", "start_line", "end_line").alias("r"))
    lists = rows.groupBy("query_id").agg(F.max("query").alias("query"), F.array_sort(F.collect_list("r")).alias("r"))  # three a query
    said = lambda p, n: F.transform(F.slice("r", 1, n), lambda r: line(p, r))
    unsure = F.concat(*[F.coalesce("query", F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(re.split(r"(\{question\})", S.FALLBACK_UNSURE))])
    heads = [F.array(F.lit(x)) for x in ("## 结论", "## 证据", "## 不确定项", "## 建议")]
    blank = F.array(F.lit(""))
    return lists.select("query_id", F.array_join(F.concat(heads[0], said(S.FALLBACK_CONCLUSION, 2), blank, heads[1], said(S.FALLBACK_EVIDENCE, 3), blank, heads[2], F.array(unsure), blank, heads[3], F.array(F.lit(S.FALLBACK_ADVICE))), "\n").alias("answer"))


def shown(results: DataFrame, chars: int = S.SHOWN_SEARCH) -> DataFrame:
    """Results with their content cut for display, and an id and a path for a list; null content stays null."""
    cut = F.when(F.length("content") > chars, F.concat(F.substring("content", 1, chars), F.lit("..."))).otherwise(F.col("content"))
    return results.withColumn("content", cut).withColumn("short_id", F.substring("id", 1, S.SHOWN_ID)).withColumn("short_path", F.substring("file_path", 1, S.SHOWN_PATH))


def vector_preview(vector: Column | str) -> list[Column]:
    """Columns dimensions and preview, the first numbers of a vector at six decimals; null for a null vector."""
    v = T.col(vector)
    some = F.transform(F.slice(v, 1, S.SHOWN_NUMBERS), lambda x: F.format_string("%.6f", x.cast("double")))
    return [F.when(v.isNotNull(), F.size(v)).alias("dimensions"), F.when(v.isNotNull(), F.concat(F.lit("["), F.array_join(some, ", "), F.lit("...]"))).alias("preview")]
