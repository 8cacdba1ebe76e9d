"""Keyword search, fusion with vector search, and statistics of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein import schema as S
from skein.functions import text as T
from skein.functions.lookup import holds
from skein.operators import vector


#: Up to so many keywords are looked up by expressions in the JVM; more by an automaton.
FEW = 64


def keyword_scores(keywords: DataFrame, units: DataFrame, limit: int | None = S.KEYWORD_LIMIT, regex_count: bool = False, scan_cap: int | None = None, **filters) -> DataFrame:
    """(query_id, id, match_score, keyword_matches, rank): ten points for each occurrence of a keyword.

    keywords: query_id, keyword.  Different keywords are looked up once for all
    queries and only hits are joined to the queries; many keywords make one
    automaton, in blocks of bounded size.  They are counted as literal text
    (``regex_count``: the keywords of a text that holds them are counted as
    regular expressions).  Blank keywords count nothing; repeated rows of one id
    count once.  ``scan_cap``: only so many units, those with the smallest ids,
    are looked at; none by default.  ``filters`` (projects, file_types,
    code_types) apply to the ``limit`` best.
    """
    asked = keywords.where("keyword is not null and trim(keyword) <> ''").select("query_id", F.lower("keyword").alias("keyword")).distinct()
    hay = units.where("id is not null").select("id", T.haystack().alias("__h"))
    if scan_cap is not None:
        hay = hay.dropDuplicates(["id"]).orderBy("id").limit(scan_cap)
    words = [r[0] for r in asked.select("keyword").distinct().limit(FEW + 1).collect()]
    if len(words) <= FEW:

        def count(k):
            return F.struct(k.alias("keyword"), ((F.length("__h") - F.length(F.replace(F.col("__h"), k, F.lit("")))) / F.length(k)).cast("int").alias("n"))

        listed = F.array(*map(F.lit, sorted(words) or [""]))
        found = hay.select("id", F.explode(F.transform(F.filter(listed, lambda k: (k != "") & F.contains(F.col("__h"), k)), count)).alias("hit")).select("id", "hit.keyword", "hit.n")
    else:
        found = holds(hay.select(F.col("id").alias("key"), F.col("__h").alias("text")), asked.select(F.col("keyword").alias("pattern"))).select(F.col("key").alias("id"), F.col("pattern").alias("keyword"), "n")
    if regex_count:
        found = found.join(hay, "id").select("id", "keyword", F.regexp_count(F.col("__h"), F.col("keyword")).alias("n"))
    once = found.groupBy("id", "keyword").agg(F.max("n").alias("n"))
    best = once.join(asked, "keyword").groupBy("query_id", "id").agg((F.sum("n") * S.KEYWORD_WEIGHT).cast("int").alias("match_score"), F.array_sort(F.collect_list("keyword")).alias("keyword_matches")).where("match_score > 0")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("match_score").desc(), "id"))
    out = best.withColumn("rank", rank)
    out = out.where(F.col("rank") <= limit) if limit else out
    if any(filters.values()):
        out = vector.filtered(vector.with_fields(out, units, "project", "file_path", "type"), **filters).drop("project", "file_path", "type")
    return out


def fuse(vectors: DataFrame, keywords: DataFrame) -> DataFrame:
    """(query_id, id, score, source): lower is better; a unit found by both is better by a bonus, one by keywords alone starts from a base."""
    both = vectors.select("query_id", "id", "score").join(keywords.select("query_id", "id", "match_score"), ["query_id", "id"], "full_outer")
    hit, near = F.col("match_score").isNotNull(), F.col("score").isNotNull()
    score = F.when(hit & near, F.col("score") - S.HYBRID_BONUS).when(near, F.col("score")).otherwise(S.KEYWORD_ONLY_BASE - F.col("match_score"))
    source = F.when(hit & near, "hybrid").when(near, "vector").otherwise("keyword")
    return both.select("query_id", "id", score.alias("score"), source.alias("source"))


def keyword_bonus(rows: DataFrame, keywords: str = "keywords", confidence=None) -> DataFrame:
    """Lowers each row's score for the keywords in its haystack: by their specificity, or by a fixed boost times ``confidence``."""
    hits = F.filter(keywords, lambda k: F.contains(T.haystack(), F.lower(k)))
    out = rows.withColumn("keyword_matches", hits)
    if confidence is None:
        off = F.aggregate(F.transform("keyword_matches", lambda k: F.round(T.specificity(k) * S.KEYWORD_BONUS)), F.lit(0.0), lambda a, b: a + b)
    else:
        off = F.size("keyword_matches") * S.VOCABULARY_BOOST * T.col(confidence)
    return out.withColumn("score", F.col("score") - off)


def matched_first(rows: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each query, those with keyword matches before those without, then by score."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.size("keyword_matches") == 0, "score", "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def trusted(queries: DataFrame, most: int = S.TRUSTED_EXPANSIONS) -> DataFrame:
    """(query_id, n, query, vector): of each query's ``expansions`` (structs of query and vector) the first ``most`` that overlap the query, numbered from 1."""
    more = queries.select("query_id", "query", F.posexplode("expansions").alias("at", "e")).where(T.overlap(T.tokens("query"), T.tokens(F.col("e.query"))) >= S.TRUSTED_OVERLAP)
    n = F.row_number().over(W.partitionBy("query_id").orderBy("at"))
    return more.withColumn("n", n).where(F.col("n") <= most).select("query_id", "n", "e.query", "e.vector")


def recall_union(base: DataFrame, more: DataFrame) -> DataFrame:
    """Results of a query and of its expansions (with their number ``n``), each id once: the query's own first, then by number; scores of expansions weigh more, so they rank lower."""
    both = base.select("query_id", "id", "score", F.lit(0).alias("n")).unionByName(more.select("query_id", "id", (F.col("score") * S.EXPANSION_WEIGHT).alias("score"), "n"))
    return both.withColumn("k", F.row_number().over(W.partitionBy("query_id", "id").orderBy("n", "score"))).where("k = 1").drop("k")


def smart_search(queries: DataFrame, units: DataFrame, limit: int = S.DEFAULT_LIMIT, projects=None, file_types=None, code_types=None, fields: tuple[str, ...] = ()) -> DataFrame:
    """Vector recall, keyword recall, fusion, keyword bonus and matched-first selection, without models.

    queries: query_id, query, vector, and optionally expansions, (query, vector)
    structs, and keywords, a list from a model; without it keywords come from the
    fixed dictionary.  The filters apply to both recalls, each after its limit.
    ``fields``: further attributes of the units in the result.
    """
    filters = {"projects": projects, "file_types": file_types, "code_types": code_types}
    base = vector.search(queries.select("query_id", "vector"), units, limit * 2, **filters).select("query_id", "id", "score")
    if "expansions" in queries.columns:
        more = trusted(queries)
        near = vector.search(more.select(F.to_json(F.struct("query_id", "n")).alias("query_id"), "vector"), units, limit, **filters)
        kind = queries.schema["query_id"].dataType.simpleString()
        near = near.select(F.get_json_object("query_id", "$.query_id").cast(kind).alias("query_id"), "id", "score", F.get_json_object("query_id", "$.n").cast("int").alias("n"))
        base = recall_union(base, near).drop("n")
    given = F.col("keywords") if "keywords" in queries.columns else T.mapped_keywords("query")
    wanted = queries.select("query_id", F.slice(F.filter(given, lambda k: T.specificity(k) > 0), 1, S.TRUSTED_KEYWORDS).alias("keywords"))
    hits = keyword_scores(wanted.select("query_id", F.explode("keywords").alias("keyword")), units, **filters)
    rows = vector.with_fields(fuse(base, hits), units, *dict.fromkeys(("project", "file_path", "type", "name", "content", *fields))).join(wanted, "query_id")
    return matched_first(keyword_bonus(rows), limit).select("query_id", "rank", "id", "score", "source", "keyword_matches", *fields)


def index_stats(units: DataFrame) -> DataFrame:
    """(kind, key, units): counts by type, by project and in total, in one pass; each id counts once, nulls as a key of their own."""
    once = units.where("id is not null").groupBy("id").agg(F.max("type").alias("type"), F.max("project").alias("project"))
    kinds = F.array(F.struct(F.lit("type").alias("kind"), F.col("type").alias("key")), F.struct(F.lit("project").alias("kind"), F.col("project").alias("key")), F.struct(F.lit("total").alias("kind"), F.lit("").alias("key")))
    return once.select(F.explode(kinds).alias("k")).groupBy(F.col("k.kind").alias("kind"), F.col("k.key").alias("key")).agg(F.count(F.lit(1)).alias("units"))
