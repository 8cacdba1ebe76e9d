"""Rule-based ranking of search results, recall expansion and merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein import schema as S
from skein.functions import text as T


def evidence_score(score: Column | str = "score", matches: Column | None = None) -> Column:
    """Points of a result from its type, place, name, content, distance and keyword matches; null fields add nothing."""
    path, name, content = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("file_path", "name", "content"))
    kind = F.lit(0)
    for t, points in S.EVIDENCE_TYPES.items():
        kind = F.when(F.col("type") == t, points).otherwise(kind)

    def points(condition: Column, n: int) -> Column:
        return F.when(condition, n).otherwise(0)

    fixed = (
        kind
        + points(F.contains(path, F.lit("/src/")), S.SRC_POINTS)
        + points(F.contains(path, F.lit("/docs/")), S.DOCS_POINTS)
        + points(T.base_name(path).rlike(S.GENERIC_FILE), S.GENERIC_FILE_POINTS)
        + points(F.contains(T.base_name(path), F.lit("utilscategory")), S.UTILS_POINTS)
        + points(name.rlike(S.EVIDENCE_NAME), 40)
        + points(F.concat_ws(" ", path, content).rlike(S.EVIDENCE_TEXT), 30)
        + points(name.rlike(S.EVIDENCE_FLOW), 25)
        + points(content.rlike(S.EVIDENCE_CALL), 40)
    )
    n = F.coalesce(F.size(matches), F.lit(0)) if matches is not None else F.lit(0)
    return fixed + n * S.KEYWORD_POINTS + F.greatest(F.lit(0.0), 800.0 - T.col(score)) * 0.1


def matched(tokens: Column, hay: Column) -> Column:
    return F.filter(tokens, lambda t: F.contains(hay, F.lower(t)))


def coverage_score(tokens: Column, hay: Column) -> Column:
    return F.size(matched(tokens, hay)) * S.COVERAGE_POINTS


def rule_rerank(results: DataFrame, fill_matches: bool = True, top: int | None = None) -> DataFrame:
    """Results (query_id, query, rank and unit fields) by evidence plus coverage, best first; ties keep their rank."""
    tokens, hay = T.tokens("query"), T.haystack()
    out = results.withColumn("keyword_matches", matched(tokens, hay) if fill_matches else F.lit(None).cast("array<string>"))
    out = out.withColumn("evidence", evidence_score(matches=F.col("keyword_matches"))).withColumn("coverage", coverage_score(tokens, hay))
    out = out.withColumn("relevance", F.col("evidence") + F.col("coverage"))
    out = out.withColumn("new_rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("relevance").desc(), "rank")))
    return out.where(F.col("new_rank") <= top) if top else out


def merge_unique(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Both lists one after the other, each id of a query once; the primary's row wins."""
    both = primary.withColumn("side", F.lit(0)).unionByName(fallback.withColumn("side", F.lit(1)), allowMissingColumns=True)
    first = F.row_number().over(W.partitionBy("query_id", "id").orderBy("side", "rank"))
    order = F.row_number().over(W.partitionBy("query_id").orderBy("side", "rank", "id"))
    return both.withColumn("__n", first).where("__n = 1").drop("__n").withColumn("merged_rank", order)


def enough_evidence(results: DataFrame) -> DataFrame:
    """(query_id, enough): whether two of the first four are covered code units under /src/, not /docs/."""
    path = F.lower(F.coalesce(F.col("file_path"), F.lit("")))
    good = F.col("type").isin("function", "component") & F.contains(path, F.lit("/src/")) & ~F.contains(path, F.lit("/docs/")) & (coverage_score(T.tokens("query"), T.haystack()) > 0)
    return results.groupBy("query_id").agg((F.count_if(good & (F.col("rank") <= 4)) >= 2).alias("enough"))


def bridge_terms(results: DataFrame, most: int = 8) -> DataFrame:
    """(query_id, terms): names worth a second search from the first eight results of each query, in order, space-joined."""
    base = F.regexp_replace(T.base_name("file_path"), r"(?i)\.[a-z0-9]+$", "")
    blocked = F.array(*map(F.lit, S.BRIDGE_BLOCKED))

    def usable(x: Column) -> Column:
        return ~F.array_contains(blocked, F.lower(x))

    names = F.filter(F.array(base, F.coalesce(F.col("name"), F.lit(""))), lambda x: (F.length(x) >= 5) & usable(x))
    found = F.slice(F.regexp_extract_all(F.coalesce(F.col("content"), F.lit("")), F.lit("[A-Za-z_][A-Za-z0-9_]{4,}"), F.lit(0)), 1, 16)
    idents = F.filter(found, lambda x: usable(x) & F.lower(x).rlike(S.BRIDGE_PATTERN))
    own = results.where("rank <= 8").select("query_id", F.struct("rank", F.concat(names, idents).alias("t")).alias("r"))
    all_terms = F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["t"])))
    return own.groupBy("query_id").agg(F.array_join(F.slice(all_terms, 1, most), " ").alias("terms"))
