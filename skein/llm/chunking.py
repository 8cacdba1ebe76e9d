"""Problem 1: cutting units that are too long, at valleys of lexical cohesion.

A boundary between two lines is scored by the cosine of the words in the block
of lines before it and in the block after it.  Where the score dips, the topic
changes; within each window of allowed sizes the unit is cut at the deepest
dip.  A piece after the first begins with up to ``overlap`` characters from the
end of its predecessor.  Windows are scored one at a time, so a unit takes time
in proportion to its length and memory for one window.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.rows import map_rows

LIMIT, OVERLAP, BLOCK, BUCKETS, LEAST = 2990, 200, 6, 128, 0.5
_WORD = re.compile(r"[^\W\d_]{2,}")
_buckets: dict[str, int] = {}


def _bucket(word: str) -> int:
    found = _buckets.get(word)
    if found is None:
        if len(_buckets) > 100_000:
            _buckets.clear()
        found = _buckets[word] = zlib.crc32(word.lower().encode("utf-8", "surrogatepass")) % BUCKETS
    return found


def _depths(lines: list[str], first: int, last: int) -> np.ndarray:
    """Depth of the dip at the boundaries before lines ``first`` to ``last``."""
    a, b = max(0, first - 2 * BLOCK), min(len(lines), last + 2 * BLOCK)
    rows, cols = [], []
    for i in range(a, b):
        found = _WORD.findall(lines[i])
        rows.extend([i - a] * len(found))
        cols.extend(map(_bucket, found))
    n = b - a
    counts = np.bincount(np.asarray(rows, dtype=np.int64) * BUCKETS + np.asarray(cols, dtype=np.int64), minlength=n * BUCKETS).reshape(n, BUCKETS) if rows else np.zeros((n, BUCKETS))
    total = np.zeros((n + 1, BUCKETS))
    np.cumsum(counts, axis=0, out=total[1:])
    at = np.arange(n + 1)
    left = total - total[np.maximum(0, at - BLOCK)]
    right = total[np.minimum(n, at + BLOCK)] - total
    norm = np.sqrt((left * left).sum(1) * (right * right).sum(1))
    score = np.where(norm > 0, (left * right).sum(1) / np.where(norm > 0, norm, 1), 0.0)
    reach = 2 * BLOCK
    padded = np.pad(score, reach, constant_values=-1.0)
    views = np.lib.stride_tricks.sliding_window_view(padded, reach + 1)
    before, after = views[: n + 1].max(1), views[reach : reach + n + 1].max(1)
    return (before - score + after - score)[first - a : last - a + 1]


def _soft(text: str, start: int, stop: int) -> int:
    """A place to cut inside a line: after the last blank or mark, else at ``stop``; never within a line end."""
    for mark in (" ", "\t", ";", ",", "。", "，", "、", "}", ")"):
        at = text.rfind(mark, start + (stop - start) // 2, stop)
        if at > start:
            return at + 1
    return stop - 1 if stop > start + 1 and text[stop - 1 : stop + 1] == "\r\n" else stop


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> Iterator[tuple[int, int, int]]:
    """(start, first new character, end) of each piece; the whole text if it is not longer than ``limit``."""
    n = len(text)
    if n <= limit:
        yield 0, 0, n
        return
    lines = text.splitlines(keepends=True) if "\x0b" not in text and "\x0c" not in text and "\x85" not in text else re.findall(r"[^\n]*\n|[^\n]+", text)
    ends = np.cumsum([len(x) for x in lines])
    start = fresh = 0
    while True:
        room = limit - (fresh - start)
        if n - fresh <= room:
            yield start, fresh, n
            return
        # boundaries after which a piece may end: those between half of the room and all of it
        low = int(np.searchsorted(ends, fresh + max(1, int(room * LEAST)), "left"))
        high = int(np.searchsorted(ends, fresh + room, "right"))
        if low < high:
            depth = _depths(lines, low + 1, high)
            end = int(ends[low + len(depth) - 1 - int(np.argmax(depth[::-1]))])
        else:
            earlier = int(np.searchsorted(ends, fresh, "right"))
            end = int(ends[high - 1]) if high > earlier else _soft(text, fresh, fresh + room)
        yield start, fresh, end
        cut = end - overlap
        at = int(np.searchsorted(ends, cut, "left"))
        start = int(ends[at]) if at < len(ends) and ends[at] < end else max(fresh, cut)
        if start > 0 and text[start - 1 : start + 1] == "\r\n":
            start += 1
        start = max(start, cut, 0)
        fresh = end


def split(units: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece, start_line, end_line, content) of every unit longer than ``limit`` characters.

    Units are told by id; repeated rows give one result, and of several contents
    under one id the one with the smallest hash is cut.  Null content or id gives none; a null start_line counts as 1.  Only long units leave the JVM.
    """

    def cut(rows):
        for id_, first_line, text in rows:
            line = first_line if first_line is not None else 1
            version = xxhash.xxh3_64_intdigest(f"{line}\0{text}".encode("utf-8", "surrogatepass")) >> 1
            at = 0
            for k, (a, fresh, b) in enumerate(pieces(text, limit, overlap)):
                line += text.count("\n", at, a) if a >= at else -text.count("\n", a, at)
                at = a
                last = line + text.count("\n", a, b) - (text[b - 1 : b] == "\n")
                yield id_, k, line, max(line, last), text[a:b], version

    # one shuffle by id serves the choice of a version and the removal of repeats
    return map_rows(_long(units, limit), cut, "id string, piece int, start_line int, end_line int, content string, version long").withColumn("kept", F.min("version").over(W.partitionBy("id"))).where("version = kept").drop("version", "kept").dropDuplicates(["id", "piece"])


def _long(units: DataFrame, limit: int) -> DataFrame:
    return units.where(F.col("id").isNotNull() & (F.length("content") > limit)).select("id", F.col("start_line").cast("int"), "content")


def found(units: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ids of the units that were cut."""

    def cut(rows):
        for id_, _, text in rows:
            if sum(1 for _ in pieces(text, limit, overlap)) > 1:
                yield (id_,)

    return map_rows(_long(units, limit), cut, "id string").distinct()
