"""Greedy selection of varied results: sequential by nature, so one grouped function a query over its bounded candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import schema as S
from skein.functions import text as T
from skein.functions.rows import ship

_FIELDS = "query_id string, id string, position int"


def similarity(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a and b else 0.0


def mmr(relevance: list[float], sets: list[set], top: int, balance: float = S.MMR_LAMBDA) -> list[int]:
    """Indices in order of choice; all of them, in their order, if there are no more than ``top``.

    Each candidate's largest similarity to what is chosen is kept up to date, so
    a round costs one comparison a candidate.
    """
    n = len(relevance)
    if n <= top:
        return list(range(n))
    order = sorted(range(n), key=lambda i: -relevance[i])
    chosen = [order.pop(0)] if top > 0 else []
    nearest = {i: 0.0 for i in order}
    while len(chosen) < top and order:
        last = sets[chosen[-1]]
        for i in order:
            nearest[i] = max(nearest[i], similarity(sets[i], last))
        best = max(order, key=lambda i: balance * relevance[i] - (1 - balance) * nearest[i] * 100)
        order.remove(best)
        chosen.append(best)
    return chosen


def _context(rows: pd.DataFrame, limit: int) -> list[str]:
    """Ids of the context of one query, from its candidates in ranked order."""
    by_id = {r.id: r for r in rows.itertuples()}
    sets = {r.id: set(r.tokens) for r in rows.itertuples()}
    ids = list(rows["id"])

    def pick(some: list[str], top: int) -> list[str]:
        return [some[i] for i in mmr([by_id[x].relevance for x in some], [sets[x] for x in some], top)]

    chosen = pick(ids, limit)
    modules = {by_id[x].module for x in chosen}
    code = [r for r in rows.itertuples() if r.type in ("function", "component") and "/src/" in (r.file_path or "").lower() and "/docs/" not in (r.file_path or "").lower()]
    for r in sorted(code, key=lambda r: (-r.coverage, -r.evidence, r.score)):
        if len(chosen) >= limit:
            break
        if r.id not in chosen and (r.coverage > 0 or r.module in modules and r.evidence >= 170 or r.evidence >= 220):
            chosen.append(r.id)
            modules.add(r.module)
    # widen to three modules and two types, then fill up
    rest = [x for x in sorted(ids, key=lambda x: -by_id[x].relevance) if x not in chosen]
    kinds = {by_id[x].type for x in chosen}
    for only_new in (True, False):
        for x in list(rest):
            if len(chosen) >= limit:
                break
            r = by_id[x]
            new = len(modules) < min(3, limit) and r.module not in modules or len(kinds) < min(2, limit) and r.type not in kinds
            if new or not only_new:
                chosen.append(x)
                rest.remove(x)
                modules.add(r.module)
                kinds.add(r.type)
    return pick(chosen[:limit], limit)


def _prepared(ranked: DataFrame) -> DataFrame:
    ship(ranked.sparkSession)
    own = T.tokens(F.concat_ws(" ", "file_path", "name", "content"))
    return ranked.select(F.col("query_id").cast("string"), "id", "type", "file_path", "score", "evidence", "coverage", "relevance", F.col("new_rank").alias("order"), T.path_key("file_path").alias("module"), own.alias("tokens"))


def select_mmr(ranked: DataFrame, top: int) -> DataFrame:
    """(query_id, id, position) chosen from the rows of ``rule_rerank`` for relevance and variety."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("order").reset_index(drop=True)
        at = mmr(list(pdf["relevance"]), [set(t) for t in pdf["tokens"]], top)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[:1].repeat(len(at)).to_numpy(), "id": pdf["id"].to_numpy()[at], "position": range(1, len(at) + 1)})

    return _prepared(ranked).groupBy("query_id").applyInPandas(choose, _FIELDS)


def select_context(ranked: DataFrame, limit: int) -> DataFrame:
    """(query_id, id, position) of the context of each query: varied results, admitted neighbours, wider modules and types."""

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = _context(pdf.sort_values("order").drop_duplicates("id").reset_index(drop=True), limit)
        return pd.DataFrame({"query_id": [pdf["query_id"].iloc[0]] * len(ids), "id": ids, "position": range(1, len(ids) + 1)})

    return _prepared(ranked).groupBy("query_id").applyInPandas(choose, _FIELDS)
