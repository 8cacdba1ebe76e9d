"""Exact nearest-neighbour search of many queries at once, and what follows it."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein import schema as S
from skein.functions.rows import ship
from skein.functions.state import durable
from skein.functions.text import extension

#: Queries a pass over the units serves; more are served in blocks, so what is sent to the tasks is bounded.
BLOCK = 4096
#: Numbers in a matrix of distances.
CELLS = 2_000_000
#: Rows of results that are sent to every task, instead of the units to where the results are.
SMALL = 1_000_000


def knn(queries: DataFrame, units: DataFrame, k: int, metric: str = "l2", dimensions: int = 64) -> DataFrame:
    """(query_id, id, score, rank): the k nearest units of each query; score is the squared distance, or 1 - cosine.

    queries: query_id, vector.  Units and queries whose vector is null, of
    another length, not finite (or all zero, for cosine) take no part; repeated
    rows of one id count once, with their least distance.  Scores are rounded to
    six decimals before they are compared; ties go to the smaller id.

    Units are read once for a block of ``BLOCK`` queries.  Each task keeps its
    own k best of each query, so what is shuffled is bounded by tasks × queries
    × k, not by the units.
    """
    ship(units.sparkSession)
    if metric not in ("l2", "cosine"):
        raise ValueError(metric)

    def clean(vectors) -> tuple[np.ndarray, np.ndarray]:
        ok = np.array([v is not None and len(v) == dimensions for v in vectors], dtype=bool)
        x = np.array([v for v, good in zip(vectors, ok) if good], dtype=np.float64).reshape(-1, dimensions)
        good = np.isfinite(x).all(axis=1)
        if metric == "cosine":
            good &= np.abs(x).sum(axis=1) > 0
        ok[ok] = good
        x = x[good]
        return ok, x / np.sqrt((x * x).sum(axis=1, keepdims=True)) if metric == "cosine" else x

    rows = queries.where("query_id is not null and vector is not null").select(F.col("query_id").cast("string"), "vector").dropDuplicates(["query_id"])
    kind = queries.schema["query_id"].dataType
    parts = []
    blocks = max(1, -(-rows.count() // BLOCK))
    for b in range(blocks):
        block = rows.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas().sort_values("query_id")
        ok, q = clean(list(block["vector"]))
        names = block["query_id"].to_numpy(dtype=object)[ok]

        def scan(batches, q=q, names=names):
            if not len(q):
                return
            q2 = (q * q).sum(axis=1)
            rows = max(16, CELLS // len(q))
            bound = np.full(len(q), np.inf)  # no unit farther than this can be among a query's k nearest
            held: list[pd.DataFrame] = []
            waiting = 0

            def best() -> pd.DataFrame:
                both = pd.concat(held).sort_values(["q", "score", "id"]).drop_duplicates(["q", "id"])
                return both.groupby("q", sort=False).head(k)

            for pdf in batches:
                ok, all_x = clean(list(pdf["vector"]))
                all_ids = pdf["id"].to_numpy(dtype=object)[ok]
                for at in range(0, len(all_x), rows):
                    x, ids = all_x[at : at + rows], all_ids[at : at + rows]
                    d = 1.0 - x @ q.T if metric == "cosine" else np.maximum(0.0, (x * x).sum(axis=1)[:, None] + q2[None, :] - 2.0 * (x @ q.T))
                    d = np.round(d, 6)
                    most = pd.Series(ids).value_counts().iloc[0]  # rows that one id has here
                    if len(x) > k * most:
                        bound = np.minimum(bound, np.partition(d, k * most - 1, axis=0)[k * most - 1])
                    r, c = np.nonzero(d <= bound[None, :])
                    held.append(pd.DataFrame({"q": c, "id": ids[r], "score": d[r, c]}))
                    waiting += len(r)
                    if waiting > 4 * k * len(q) + 100_000:
                        held = [best()]
                        waiting = len(held[0])
                        full = held[0].groupby("q")["score"].agg(["size", "max"])
                        full = full[full["size"] == k]
                        bound[full.index] = np.minimum(bound[full.index], full["max"])
            if held:
                out = best()
                yield pd.DataFrame({"query_id": names[out["q"].to_numpy()], "id": out["id"].to_numpy(), "score": out["score"].to_numpy()})

        parts.append(units.where("id is not null and vector is not null").select("id", "vector").mapInPandas(scan, "query_id string, id string, score double"))
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    near = near.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).withColumn("query_id", F.col("query_id").cast(kind))


def knn_columns(queries: DataFrame, units: DataFrame, k: int, dimensions: int = 64) -> DataFrame:
    """``knn`` by expressions in the JVM, for at most ``BLOCK`` queries: each task compares its units with the queries sent to it.

    The result is that of ``knn``, but for the last decimal where sums are rounded in another order.
    """
    usable = lambda v: (F.size(v) == dimensions) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    asked = queries.where(F.col("query_id").isNotNull() & F.col("vector").isNotNull() & usable("vector")).select("query_id", F.col("vector").alias("__q")).dropDuplicates(["query_id"]).limit(BLOCK + 1)
    if asked.count() > BLOCK:
        raise ValueError(f"more than {BLOCK} queries; use knn")
    rows = units.where(F.col("id").isNotNull() & F.col("vector").isNotNull() & usable("vector")).select("id", "vector")
    square = F.aggregate(F.zip_with("vector", "__q", lambda a, b: (a.cast("double") - b.cast("double")) * (a.cast("double") - b.cast("double"))), F.lit(0.0), lambda a, x: a + x)
    scored = rows.join(F.broadcast(asked), F.lit(True)).select("query_id", "id", F.round(square, 6).alias("score"))
    near = scored.groupBy("query_id", "id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k)


def unit_rows(units: DataFrame, ids: DataFrame, *columns: str) -> DataFrame:
    """One row of attributes for each id in ``ids``; of repeated rows the greatest values."""
    wanted = ids.select("id").distinct()
    return units.select("id", *columns).join(wanted, "id", "left_semi").groupBy("id").agg(*[F.max(c).alias(c) for c in columns])


def with_fields(near: DataFrame, units: DataFrame, *columns: str) -> DataFrame:
    """Results (query_id, id and others) with attributes of their units; of repeated rows of an id the greatest values.

    The results are written first, so what they come from is not computed
    twice.  Up to ``SMALL`` of them go to the tasks that read the units, so no
    text is shuffled but that of the results; more are joined by their ids.
    """
    near = durable(near)
    ids = near.select("id").distinct()
    if near.count() <= SMALL:
        ids = F.broadcast(ids)
    fields = units.select("id", *columns).join(ids, "id", "left_semi").groupBy("id").agg(*[F.max(c).alias(c) for c in columns])
    return near.join(fields, "id")


def filtered(rows: DataFrame, projects=None, file_types=None, code_types=None) -> DataFrame:
    """Rows of the given projects, endings of file_path and types of unit; an empty list filters nothing."""
    if projects:
        rows = rows.where(F.col("project").isin(list(projects)))
    if file_types:
        rows = rows.where(extension("file_path").isin(list(file_types)))
    if code_types:
        rows = rows.where(F.col("type").isin(list(code_types)))
    return rows


def search(queries: DataFrame, units: DataFrame, limit: int = S.DEFAULT_LIMIT, projects=None, file_types=None, code_types=None, fetch_factor: int = S.FETCH_FACTOR, cut: bool = True, metric: str = "l2", min_score: float | None = None, path_pattern: str | None = None, before: bool = False) -> DataFrame:
    """Nearest units with filters after the ranking, the adaptive cut and the limit.

    As filters come after ``fetch_factor * limit`` units are taken, fewer than
    ``limit`` may remain; with ``before`` they come before the ranking and reach
    the scan.  ``min_score`` (on 1 - score) and ``path_pattern`` (a regular
    expression) are further filters, off by default.
    """
    if before:
        units = filtered(units, projects, file_types, code_types)
        if path_pattern:
            units = units.where(F.col("file_path").rlike(path_pattern))
    rows = with_fields(knn(queries, units, limit * fetch_factor, metric), units, "project", "file_path", "type", "name")
    rows = filtered(rows, projects, file_types, code_types)
    if min_score is not None:
        rows = rows.where(1 - F.col("score") >= min_score)
    if path_pattern:
        rows = rows.where(F.col("file_path").rlike(path_pattern))
    if cut:
        rows = outlier_cut(rows)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def distance_top(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` rows of each query with the least score, of equal ones the smaller id; no other evidence counts."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= k)


def projected(rows: DataFrame) -> DataFrame:
    """Results with dependencies as an array and metadata as a map, empty where the stored JSON is null, empty or malformed."""

    def parsed(name: str, kind: str, none: str):
        if dict(rows.dtypes)[name] != "string":
            return F.col(name)
        return F.coalesce(F.from_json(F.coalesce(F.nullif(F.col(name), F.lit("")), F.lit(none)), kind), F.from_json(F.lit(none), kind))

    for name, kind, none in (("dependencies", "array<string>", "[]"), ("metadata", "map<string,string>", "{}")):
        if name in rows.columns:
            rows = rows.withColumn(name, parsed(name, kind, none))
    return rows


def outlier_cut(rows: DataFrame) -> DataFrame:
    """Rows of each query with a score up to the bound: the larger of a multiple of the upper median and the minimum plus a slack; of three or fewer, all."""
    scores = F.sort_array(F.collect_list("score").over(W.partitionBy("query_id")))
    out = rows.withColumn("__s", scores)
    n = F.size("__s")
    median = F.element_at("__s", (F.floor(n / 2) + 1).cast("int"))
    least = F.element_at("__s", 1)
    bound = F.greatest(F.when(median == 0, least).otherwise(median) * S.OUTLIER_RATIO, least + S.OUTLIER_SLACK)
    return out.where((n <= 3) | (F.col("score") <= bound)).drop("__s")
