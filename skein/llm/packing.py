"""Problem 9: texts into containers of a fixed number of tokens.

Only the histogram of lengths (at most one row a length) goes to the driver.
There best-fit decreasing runs over counts: equal items are placed together, as
runs of (length, ranks, containers).  Items then find their slot by their rank
within their length.  Ranks are counted in salted groups of about ``GROUP``
items of the commonest length, so a length that a third of all texts share is
ranked by many tasks.
"""

from __future__ import annotations

import bisect
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.rows import map_rows
from skein.functions.state import durable
from skein.llm import bpe

CAPACITY, SALTS, GROUP = 2048, 64, 200_000


class Run(NamedTuple):
    """Items with ranks from ``rank`` on: ``containers`` × ``each`` of them, going round the containers from ``container`` on, the first at ``start``."""

    rank: int
    containers: int
    each: int
    container: int
    start: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[dict[int, list[Run]], int]:
    """Runs by length, and the number of containers.

    Best fit, longest first: an item goes to the fullest container that it fits
    in.  The number of runs is bounded by the capacity, whatever the counts.
    """
    runs: dict[int, list[Run]] = {}
    rooms: list[int] = []  # sorted rooms that some container has
    groups: dict[int, list[tuple[int, int]]] = {}  # room: (first container, containers)
    total = 0

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in groups:
                bisect.insort(rooms, room)
                groups[room] = []
            groups[room].append((first, n))

    for length in sorted((x for x in counts if 0 < x <= capacity and counts[x] > 0), reverse=True):
        left, rank = counts[length], 0
        mine = runs.setdefault(length, [])

        def fill(room: int, first: int, n: int) -> None:
            nonlocal left, rank
            each = room // length
            whole = min(n, left // each)
            if whole:
                mine.append(Run(rank, whole, each, first, capacity - room))
                put(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and left:  # the last items, fewer than fit in one container
                mine.append(Run(rank, 1, left, first + whole, capacity - room))
                put(room - left * length, first + whole, 1)
                rank, left, whole = rank + left, 0, whole + 1
            put(room, first + whole, n - whole)

        while left:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms.pop(at)
                waiting = groups.pop(room)
                for i, (first, n) in enumerate(waiting):
                    if not left:
                        for f, m in waiting[i:]:
                            put(room, f, m)
                        break
                    fill(room, first, n)
            else:
                n = -(-left // (capacity // length))
                fill(capacity, total, n)
                total += n
    return runs, total


def items(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, tokens): texts as they are, but those over the capacity as full parts and a rest."""
    n = F.ceil(F.col("tokens") / capacity).cast("int")
    parts = sizes.where("tokens > 0").select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), n - 1)).alias("part"))
    return parts.select("doc_id", "part", F.least(F.lit(capacity), F.col("tokens") - F.col("part") * capacity).cast("int").alias("tokens"))


def packed(documents: DataFrame, capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """(doc_id, part, tokens, container, start): where each text, or part of a long one, lies.

    Null and empty texts take no room and have no row.  Rows are told by
    doc_id; of rows with one doc_id each is placed.
    """
    each = items(durable(bpe.counted(documents, path)), capacity)
    counts = {r["tokens"]: r["n"] for r in each.groupBy("tokens").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs, _ = plan(counts, capacity)
    firsts = {length: [r.rank for r in rs] for length, rs in runs.items()}
    salts = max(SALTS, -(-max(counts.values(), default=0) // GROUP))
    salted = each.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).cast("int"))
    before = W.partitionBy("tokens").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = salted.groupBy("tokens", "salt").agg(F.count(F.lit(1)).alias("n")).select("tokens", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(W.partitionBy("tokens", "salt").orderBy("doc_id", "part")) - 1
    ranked = salted.withColumn("rank", rank).join(offsets, ["tokens", "salt"]).select("doc_id", "part", "tokens", (F.col("rank") + F.col("offset")).alias("rank"))

    def place(rows):
        for doc_id, part, tokens, r in rows:
            run = runs[tokens][bisect.bisect_right(firsts[tokens], r) - 1]
            slot, container = divmod(r - run.rank, run.containers)
            yield doc_id, part, tokens, run.container + container, run.start + slot * tokens

    return map_rows(ranked, place, "doc_id long, part int, tokens int, container long, start int")
