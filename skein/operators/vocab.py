"""Vocabulary of a code base, its use in queries, and feedback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein import schema as S
from skein.functions import text as T
from skein.functions.lookup import holds


def words(camel: bool = False) -> Column:
    """Words of a unit: path segments, its name, and ideograph runs of its content; ``camel``: also the parts of its name."""
    ending = r"\.(js|ts|vue|jsx|tsx|md)$"
    parts = F.transform(F.filter(F.split(F.coalesce("file_path", F.lit("")), "/"), lambda p: (p != "") & ~F.startswith(p, F.lit("."))), lambda p: F.regexp_replace(p, ending, ""))
    found = [F.filter(parts, lambda p: F.length(p) > 1), F.filter(F.array(F.coalesce("name", F.lit(""))), lambda n: F.length(n) > 2), T.cjk_runs("content", 2, 4)]
    return F.concat(*found, T.camel_words("name")) if camel else F.concat(*found)


def learn(units: DataFrame, least: int = S.LEAST_FREQUENCY, camel: bool = False, once_a_batch: bool = False) -> DataFrame:
    """(word, freq) of the words that occur at least ``least`` times; counts are combined before the shuffle.

    ``once_a_batch``: a word counts once however often it occurs, as in a set.
    Rows are counted as they are; give one row a unit.
    """
    all_words = units.select(F.explode(words(camel)).alias("word"))
    freq = F.lit(1).cast("bigint") if once_a_batch else F.count(F.lit(1))
    return all_words.groupBy("word").agg(freq.alias("freq")).where(F.col("freq") >= least)


def top_words(vocabulary: DataFrame, n: int) -> DataFrame:
    return vocabulary.orderBy(F.col("freq").desc(), "word").limit(n)


def match_words(queries: DataFrame, vocabulary: DataFrame, both_ways: bool = True) -> DataFrame:
    """(query_id, word): vocabulary that a query contains, or (``both_ways``) that contains a whole query; case does not count, blank queries and words match nothing.

    Each direction is one pass of an automaton over the longer texts, in blocks
    of patterns of bounded size.
    """
    q = queries.select("query_id", F.lower(F.coalesce("query", F.lit(""))).alias("q")).where("q <> ''")
    v = vocabulary.select("word", F.lower("word").alias("w")).where("w <> ''")
    held = holds(q.select(F.col("query_id").alias("key"), F.col("q").alias("text")), v.select(F.col("w").alias("pattern")))
    out = held.join(v, held["pattern"] == v["w"]).select(F.col("key").alias("query_id"), "word")
    if both_ways:
        inside = holds(v.select(F.col("word").alias("key"), F.col("w").alias("text")), q.select(F.col("q").alias("pattern")))
        out = out.unionByName(inside.join(q, inside["pattern"] == q["q"]).select("query_id", F.col("key").alias("word")))
    return out.distinct()


def keywords_of(queries: DataFrame, vocabulary: DataFrame, both_ways: bool = True) -> DataFrame:
    """(query_id, keywords): the sorted words of the vocabulary that match each query, else its ideograph runs in order."""
    found = match_words(queries, vocabulary, both_ways).groupBy("query_id").agg(F.array_sort(F.collect_set("word")).alias("words"))
    runs = F.array_distinct(T.cjk_runs("query", 2, 4))
    return queries.select("query_id", "query").join(found, "query_id", "left").select("query_id", F.coalesce("words", runs).alias("keywords"))


def save(vocabulary: DataFrame, folder: str) -> None:
    """Writes words and frequencies as JSON lines, in the place of what is there."""
    vocabulary.select("word", F.col("freq").cast("long").alias("freq")).write.mode("overwrite").json(folder)


def load(spark, folder: str, units: DataFrame | None = None) -> DataFrame | None:
    """The saved vocabulary; where there is none, that of the units, which is then saved; None without units."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        if units is None:
            return None
        save(learn(units), folder)
    return spark.read.schema("word string, freq long").json(folder)


def to_map(vocabulary: DataFrame, most: int) -> dict[str, int]:
    """The ``most`` frequent words as a JSON-like object, for export."""
    return {r.word: r.freq for r in top_words(vocabulary, most).collect()}


def merged(vocabulary: DataFrame, words: dict[str, int]) -> DataFrame:
    """A vocabulary into which an object of words and frequencies was imported: its frequencies replace those of the same words."""
    other = vocabulary.sparkSession.createDataFrame(list(words.items()), "word string, freq long")
    return vocabulary.select("word", F.col("freq").cast("long").alias("freq")).join(other, "word", "left_anti").unionByName(other)


def vocab_stats(vocabulary: DataFrame, most: int = 20) -> DataFrame:
    """(total, top): how many words there are, and the most frequent as structs of word and freq, ties by word."""
    top = vocabulary.select(F.struct((-F.col("freq")).alias("m"), "word").alias("t")).orderBy("t").limit(most).agg(F.array_sort(F.collect_list("t")).alias("t"))
    listed = F.transform("t", lambda t: F.struct(t["word"].alias("word"), (-t["m"]).alias("freq")))
    return vocabulary.agg(F.count(F.lit(1)).alias("total")).join(top.select(listed.alias("top")), F.lit(True), "left")  # one row each


FEEDBACK = "query_id long, event_id long, ts timestamp, feedback string"


def record_feedback(history: DataFrame, feedback: DataFrame, folder: str) -> None:
    """Appends rows (query_id, event_id, ts, feedback) to the feedback kept in ``folder``; those that are neither good nor bad, or of a query that the history does not hold, are ignored."""
    known = feedback.where(F.col("feedback").isin("good", "bad")).join(history.select("query_id").distinct(), "query_id", "left_semi")
    known.select("query_id", "event_id", "ts", "feedback").write.mode("append").parquet(folder)


def latest_feedback(feedback: DataFrame) -> DataFrame:
    """The last feedback on each query: (query_id, feedback, ts)."""
    last = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("ts").desc(), F.col("event_id").desc()))
    return feedback.withColumn("__n", last).where("__n = 1").drop("__n")


def query_stats(history: DataFrame) -> DataFrame:
    """Totals of a history (query_id, feedback)."""
    return history.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("feedback") == "good").alias("good"), F.count_if(F.col("feedback") == "bad").alias("bad"))


def top_keywords(results: DataFrame, most: int = 20) -> DataFrame:
    """(keyword, n) of the keywords that most results of the history matched (``keyword_matches``), ties by keyword."""
    rows = results.select(F.explode("keyword_matches").alias("keyword"))
    return rows.groupBy("keyword").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "keyword").limit(most)
