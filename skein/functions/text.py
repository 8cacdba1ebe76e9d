"""Text of units and queries as Column expressions: everything stays in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skein import schema as S


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Distinct tokens in order: runs of 2 to 8 ideographs, then lower-case words of at least 3 of a-z, 0-9 and _; null text has none."""
    t = F.coalesce(col(text), F.lit(""))
    words = F.filter(F.split(F.lower(t), "[^a-z0-9_]+"), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.concat(F.regexp_extract_all(t, F.lit(S.CJK_RUN + "{2,8}"), F.lit(0)), words))


def cjk_runs(text: Column | str, least: int, most: int) -> Column:
    return F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(f"{S.CJK_RUN}{{{least},{most}}}"), F.lit(0))


def specificity(keyword: Column | str) -> Column:
    """Weight of a keyword: 0 if blank or generic, else by length."""
    k = F.lower(F.trim(F.coalesce(col(keyword), F.lit(""))))
    n = F.length(k)
    return F.when((n == 0) | k.isin(S.GENERIC_KEYWORDS), 0.0).when(n >= 6, 1.2).when(n >= 4, 1.0).when(n >= 2, 0.8).otherwise(0.4)


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient of two token arrays; 0 if either is empty."""
    small = F.least(F.size(a), F.size(b))
    return F.when(small <= 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / small)


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two token arrays; 0 if either is empty."""
    return F.when((F.size(a) <= 0) | (F.size(b) <= 0), 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def haystack(path: Column | str = "file_path", name: Column | str = "name", content: Column | str = "content") -> Column:
    """Lower-case text that keywords are looked up in; null parts are empty."""
    return F.lower(F.concat_ws(" ", *[F.coalesce(col(c), F.lit("")) for c in (path, name, content)]))


def base_name(path: Column | str) -> Column:
    return F.regexp_extract(col(path), r"([^/\\]*)$", 1)


def extension(path: Column | str) -> Column:
    """Ending of the base name with its dot; empty for names that only begin with a dot."""
    return F.regexp_extract(col(path), r"[^/.][^/]*?(\.[^./]*)$", 1)


def type_label(ext: Column | str) -> Column:
    pairs = [F.lit(x) for kv in S.TYPE_LABELS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), col(ext)), F.lit(S.DEFAULT_LABEL))


def allowed_file(relative_path: Column | str) -> Column:
    """Whether the scan keeps a file: its ending, no pruned folder above it, no denied base name."""
    p = F.regexp_replace(col(relative_path), r"\\", "/")
    parts = F.split(p, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    return extension(p).isin(S.EXTENSIONS) & ~F.arrays_overlap(folders, F.array(*map(F.lit, S.PRUNED_DIRS))) & ~base_name(p).rlike("|".join(S.DENIED_NAMES))


def dependencies(content: Column | str) -> Column:
    """Module names directly after import or require, in order, repeats kept."""
    return F.regexp_extract_all(F.coalesce(col(content), F.lit("")), F.lit(S.DEPENDENCY), F.lit(1))


def declared_props(script: Column | str) -> Column:
    body = F.regexp_extract(F.coalesce(col(script), F.lit("")), r"props:\s*\{([^}]+)\}", 1)
    return F.filter(F.transform(F.split(body, ","), lambda x: F.trim(F.regexp_replace(F.split(x, ":")[0], r"\s+", " "))), lambda x: x != "")


def declared_emits(script: Column | str) -> Column:
    body = F.regexp_extract(F.coalesce(col(script), F.lit("")), r"emits:\s*\[([^\]]+)\]", 1)
    return F.filter(F.transform(F.split(body, ","), lambda x: F.trim(F.regexp_replace(F.trim(x), "['\"`]", ""))), lambda x: x != "")


def camel_words(name: Column | str) -> Column:
    """Lower-case parts of a name, cut before capitals, longer than two characters."""
    return F.transform(F.filter(F.split(F.coalesce(col(name), F.lit("")), "(?=[A-Z])"), lambda w: F.length(w) > 2), lambda w: F.lower(w))


def path_key(path: Column | str) -> Column:
    """Module of a path: the two segments after the first /src/, else the last three; lower case."""
    p = F.lower(F.regexp_replace(col(path), r"\\", "/"))
    at = F.instr(p, "/src/")
    sub = F.substring(p, at + 5, F.length(p))

    def parts(x: Column) -> Column:
        return F.filter(F.split(x, "/"), lambda y: y != "")

    whole = parts(p)
    tail = F.array_join(F.slice(whole, F.greatest(F.lit(1), F.size(whole) - 2), F.lit(3)), "/")
    inner = F.array_join(F.slice(parts(sub), 1, 2), "/")
    return F.when(at > 0, F.when(inner != "", inner).otherwise(sub)).otherwise(tail)


def snippet(content: Column | str, query_tokens: Column, limit: int) -> Column:
    """At most ``limit`` characters around the first token, in token order, that occurs; marks where text was left out."""
    text = F.coalesce(col(content), F.lit(""))
    low = F.lower(text)
    hit = F.try_element_at(F.filter(query_tokens, lambda t: F.contains(low, F.lower(t))), F.lit(1))
    at = F.instr(low, F.lower(hit)) - 1
    n = F.length(text)
    start = F.greatest(F.lit(0), at - limit // 2)
    end = F.least(n, start + limit)
    start = F.greatest(F.lit(0), end - limit)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(text, start + 1, end - start), F.when(end < n, "...").otherwise(""))
    return F.when(n <= limit, text).when(hit.isNull(), F.concat(F.substring(text, 1, limit), F.lit("..."))).otherwise(cut)


def embed_text(text: Column | str, context: int = 4096) -> Column:
    """Input of the embedding model, cut to what its context bears."""
    cap = max(1800, min(3000, int(context * 0.73)))
    t = F.coalesce(col(text), F.lit(""))
    return F.when(F.length(t) > cap, F.concat(F.substring(t, 1, cap), F.lit("..."))).otherwise(t)


def token_estimate(text: Column | str) -> Column:
    return F.ceil(F.length(F.coalesce(col(text), F.lit(""))) / S.CHARS_PER_TOKEN).cast("bigint")


def function_text(relative_path, name, kind, params, is_async, is_exported, comments, content) -> Column:
    """Text that a function is embedded by: signature, kind, comment and the first 500 characters of its code."""
    kind = col(kind)
    signature = F.concat(F.when(col(is_async), "async ").otherwise(""), F.coalesce(col(name), F.lit("")), F.lit("("), F.array_join(F.coalesce(col(params), F.array().cast("array<string>")), ", "), F.lit(")"))
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in S.KIND_LABELS.items() for x in kv]), kind), F.lit(S.KIND_DEFAULT))
    note = F.trim(F.regexp_replace(col(comments), r"(?m)^\s*\*\s*", ""))
    text = F.coalesce(col(content), F.lit(""))
    return F.concat_ws(
        "\n", F.concat(F.lit(S.LABEL_FILE), F.coalesce(col(relative_path), F.lit(""))), F.concat(F.lit(S.LABEL_SIGNATURE), signature), F.concat(F.lit(S.LABEL_KIND), label), F.when(col(is_exported), S.LABEL_EXPORTED).otherwise(S.LABEL_INTERNAL),
        F.when(col(comments) != "", F.concat(F.lit(S.LABEL_NOTE), note)), F.concat(F.lit(S.LABEL_CODE), F.substring(text, 1, 500), F.when(F.length(text) > 500, "...").otherwise("")),
    )


def file_text(relative_path, ext, path, content) -> Column:
    return F.concat(F.lit(S.LABEL_PATH), F.coalesce(col(relative_path), F.lit("")), F.lit("\n" + S.LABEL_KIND), type_label(ext), F.lit("\n" + S.LABEL_NAME), base_name(path), F.lit("\n\n" + S.LABEL_CONTENT + "\n"), F.coalesce(col(content), F.lit("")), F.lit("\n"))


def mapped_keywords(query: Column | str) -> Column:
    """Keywords of the fixed dictionary whose entry the query holds; without any, ideograph runs and the query itself."""
    q = F.coalesce(col(query), F.lit(""))
    hits = F.flatten(F.array(*[F.when(F.contains(q, F.lit(k)), F.array(*map(F.lit, [k, *v]))).otherwise(F.array().cast("array<string>")) for k, v in S.KEYWORD_MAP.items()]))
    return F.array_distinct(F.when(F.size(hits) > 0, hits).otherwise(F.concat(cjk_runs(q, 2, 4), F.array(q))))


def recall_query(question: Column | str) -> Column:
    """The question with up to six synonyms of the concepts that it names."""
    q = F.coalesce(col(question), F.lit(""))
    found = F.array_distinct(F.flatten(F.array(*[F.when(F.contains(q, F.lit(k)), F.array(*map(F.lit, v))).otherwise(F.array().cast("array<string>")) for k, v in S.CONCEPT_MAP.items()])))
    return F.when(F.size(found) > 0, F.concat_ws(" ", q, F.array_join(F.slice(found, 1, 6), " "))).otherwise(q)


def issue_keywords(text: Column | str) -> Column:
    """First five distinct ideograph runs of a report, links and brackets apart."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"https?://[^\s]+", ""), r"[【】\[\]]", " ")
    return F.slice(F.array_distinct(cjk_runs(clean, 2, 6)), 1, 5)


def lines_of(content: Column | str, first: Column, last: Column) -> Column:
    """Lines ``first`` to ``last`` of a text, counted from 1, whole; null if anything is."""
    return F.array_join(F.slice(F.split(col(content), "\n"), first, F.greatest(F.lit(0), last - first + 1)), "\n")


def content_hash(content: Column | str) -> Column:
    """MD5 of a text, by which changed files are told."""
    return F.md5(col(content))
