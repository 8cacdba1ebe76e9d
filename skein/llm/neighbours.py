"""Problem 6: the most similar vectors of every vector, by a hash-prefix forest.

Each tree gives every vector a long hash string of bits of random directions
and keeps the strings in a sorted array.  A bit is cut where it halves the points
that share the prefix before it, as a sample shows, so strings tell the vectors
of a dense group apart too, and a prefix of a length holds about as many points
in every tree.  The search goes down to the longest prefix that at least
``REACH`` points share, of whatever length that is, and then up bit by bit, in
all trees by the same lengths: the points that share one bit less are scored
exactly, until going up twice no longer betters a vector's k best, at most to
the whole range partition of the sorted array (about ``RUN`` points).  What a
partition's edge cuts off in one tree is left to the others, so beyond ``RUN``
points recall is not complete.

Vectors that are null, of another length, not finite or all zero have no
neighbours.  Equal directions are one point with many ids; among the ids of a
point and of equally similar points, smaller ids come first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from skein.functions.rows import ship

DIMENSIONS, TREES, BITS, REACH, SEED = 64, 6, 48, 640, 20240917
#: Ids of one vector from which they are spread over ``SALTS`` tasks.
HOT, SALTS = 100_000, 64
#: Points of a sorted run that are kept together, and points of the sample that the bits are centred on.
RUN, SAMPLE = 80_000, 16_384
K, LEAST = 5, 0.9
#: Under every cosine.
NO_BOUND = -1.5


def usable(units: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, unit, point) with each id once, its vector brought to unit length, as the bytes of float32 numbers, and their 128-bit hash."""

    def scale(batches):
        for pdf in batches:
            keep, out = [], []
            for i, v in zip(pdf["id"], pdf["vector"]):
                if i is None or v is None or len(v) != dimensions:
                    continue
                x = np.asarray(v, dtype=np.float64)
                size = float(np.sqrt((x * x).sum())) if np.isfinite(x).all() else 0.0
                if 0.0 < size < float("inf"):
                    keep.append(i)
                    out.append(np.round(x / size, 6).astype(np.float32).tobytes())
            yield pd.DataFrame({"id": keep, "unit": out})

    ship(units.sparkSession)
    rows = units.where("id is not null and vector is not null").select("id", "vector")
    return rows.mapInPandas(scale, "id string, unit binary").groupBy("id").agg(F.min("unit").alias("unit")).withColumn("point", F.unhex(F.md5("unit")))


def points(ids: DataFrame, k: int = K) -> DataFrame:
    """(point, unit, rep, ids): each direction once, its smallest id, and its k + 1 smallest ids.

    The ranks are limited before the shuffle, so of however many equal vectors each task sends k + 1.
    """
    n = F.row_number().over(W.partitionBy("point").orderBy("id"))
    few = ids.withColumn("n", n).where(F.col("n") <= k + 1)
    return few.groupBy("point").agg(F.first("unit").alias("unit"), F.array_sort(F.collect_list("id")).alias("ids")).select("point", "unit", F.element_at("ids", 1).alias("rep"), "ids")


def sample(pts: DataFrame, n: int, size: int, dimensions: int) -> np.ndarray:
    """Unit vectors of about ``size`` of the ``n`` points (up to twice as many), chosen by their hashes."""
    rows = pts.where(F.pmod(F.xxhash64("point"), F.lit(max(1, n // size))) == 0).select("unit").toPandas()
    return np.frombuffer(b"".join(rows["unit"]), dtype=np.float32).reshape(len(rows), dimensions)


def _planes(tree: int, dimensions: int, bits: int, seed: int) -> np.ndarray:
    return np.random.default_rng((seed, tree)).standard_normal((dimensions, bits)).astype(np.float32)


def _centre(planes: np.ndarray, some: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Where the bits of a string are cut, by what stands before them.

    A bit of the first levels is cut at the median of the sample points that
    share its prefix, so no prefix of a dense group stays long; the later bits
    are cut at the mean of those that share all these levels.
    """
    bits = planes.shape[1]
    depth = min(bits, max(0, int(np.log2(max(1, len(some)) / 16))))
    along = some @ planes
    levels, at = [], np.zeros(len(some), dtype=np.int64)
    for i in range(depth):
        cuts = np.zeros(1 << i, dtype=np.float32)
        order = np.argsort(at, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            cuts[at[part[0]]] = np.median(along[part, i])
        levels.append(cuts)
        at = at * 2 + (along[:, i] > cuts[at])
    counts = np.maximum(1, np.bincount(at, minlength=1 << depth))[:, None]
    sums = np.zeros((1 << depth, bits - depth))
    np.add.at(sums, at, along[:, depth:])
    return levels, (sums / counts).astype(np.float32)


def _keys(x: np.ndarray, planes: np.ndarray, levels: list[np.ndarray], rest: np.ndarray) -> np.ndarray:
    along = x @ planes
    key = np.zeros(len(x), dtype=np.int64)
    for i, cuts in enumerate(levels):
        key = key * 2 + (along[:, i] > cuts[key])
    low = along[:, len(levels) :] > rest[key]
    for i in range(low.shape[1]):
        key = key * 2 + low[:, i]
    return key


def forest(pts: DataFrame, some: np.ndarray, trees: int, bits: int, dimensions: int, seed: int) -> DataFrame:
    """(tree, key, pid, unit): the hash string of each point in each tree, as a number."""
    planes = [_planes(t, dimensions, bits, seed) for t in range(trees)]
    cuts = pts.sparkSession.sparkContext.broadcast([_centre(p, some) for p in planes])

    def hash_all(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            x = np.frombuffer(b"".join(pdf["unit"]), dtype=np.float32).reshape(len(pdf), dimensions)
            for t in range(trees):
                yield pd.DataFrame({"tree": np.full(len(pdf), t, np.int32), "key": _keys(x, planes[t], *cuts.value[t]), "pid": pdf["pid"], "unit": pdf["unit"]})

    return pts.select("pid", "unit").mapInPandas(hash_all, "tree int, key long, pid long, unit binary")


def _shared(keys: np.ndarray, a: int, b: int, length: int, bits: int) -> tuple[int, int]:
    """The range of a sorted array whose strings share ``length`` bits with those of some row from a to b."""
    drop = bits - length
    first, last = int(keys[a]) >> drop, int(keys[b - 1]) >> drop
    return int(np.searchsorted(keys, first << drop, "left")), int(np.searchsorted(keys, ((last + 1) << drop) - 1, "right"))


def _longest(keys: np.ndarray, a: int, b: int, least: int, bits: int) -> int:
    """The greatest length of a prefix, by halving, whose range has ``least`` rows more than a to b, or 0."""
    low, high = 0, bits
    while low < high:
        mid = (low + high + 1) // 2
        u, v = _shared(keys, a, b, mid, bits)
        low, high = (mid, high) if v - u >= b - a + least else (low, mid - 1)
    return low


def _ascend(x: np.ndarray, keys: np.ndarray, a: int, b: int, k: int, least: float, reach: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and score of the k best of each of the rows a to b of a sorted array.

    The first range is that of the longest prefix with ``reach`` rows more; each
    further one shares a bit less, for as long as that bettered the row's k best
    in one of the last two steps, up to the whole array.
    """
    n, m = len(x), b - a
    best = np.full((m, k), least, dtype=np.float32)
    cols = np.full((m, k), -1, dtype=np.int64)
    active = np.arange(m)
    length = _longest(keys, a, b, reach, bits)
    lo, hi = _shared(keys, a, b, length, bits)
    strips = [(lo, hi)]
    idle = np.zeros(m, dtype=np.int8)
    while len(active) and strips:
        bettered = np.zeros(m, dtype=bool)
        for u, v in strips:
            for c in range(u, v, 4096):
                d = min(v, c + 4096)
                scores = x[a + active] @ x[c:d].T
                if c < b and d > a:
                    own = np.flatnonzero((a + active >= c) & (a + active < d))
                    scores[own, a + active[own] - c] = -2.0
                take = min(k, d - c)
                over = scores > best[active, -1][:, None]
                some = np.flatnonzero(over.any(axis=1))
                if not len(some):
                    continue
                if over.sum() > 4 * k * len(active):  # at the start: many
                    top = np.argpartition(-scores[some], take - 1, axis=1)[:, :take]
                    values = np.take_along_axis(scores[some], top, 1)
                else:
                    r, q = np.nonzero(over[some])
                    s = scores[some[r], q]
                    order = np.lexsort((-s, r))
                    r, q, s = r[order], q[order], s[order]
                    place = np.arange(len(r)) - np.searchsorted(r, r)
                    ok = place < k
                    top = np.zeros((len(some), k), dtype=np.int64)
                    values = np.full((len(some), k), -2.0, dtype=np.float32)
                    top[r[ok], place[ok]], values[r[ok], place[ok]] = q[ok], s[ok]
                rows = active[some]
                values = np.where(values > best[rows, -1][:, None], values, -3.0)
                both, at = np.hstack([best[rows], values]), np.hstack([cols[rows], top + c])
                order = np.argsort(-both, axis=1, kind="stable")[:, :k]
                best[rows], cols[rows] = np.take_along_axis(both, order, 1), np.take_along_axis(at, order, 1)
                bettered[rows] = True
        idle[bettered] = 0
        idle[~bettered] += 1
        active = active[idle[active] < 2]
        left, right, strips = lo, hi, []
        while length and not strips:  # bits that tell no more points apart are passed over
            length -= 1
            left, right = _shared(keys, a, b, length, bits)
            strips = [(u, v) for u, v in ((left, lo), (hi, right)) if u < v]
        lo, hi = left, right
    r, q = np.nonzero(cols >= 0)
    return a + r, cols[r, q], best[r, q]


def candidates(hashed: DataFrame, partitions: int, k: int, least: float, reach: int, dimensions: int, bits: int) -> DataFrame:
    """(a, b, cos) of the k best points around each point in each tree.

    Ties beyond k at the same similarity may be broken either way here; equal
    points have been joined before, so they are ties of different directions.
    """

    def one_run(pids: np.ndarray, keys: np.ndarray, x: np.ndarray):
        for a in range(0, len(x), 512):
            rows, cols, scores = _ascend(x, keys, a, min(len(x), a + 512), k, least - 1e-4, reach, bits)
            if len(rows):
                yield pd.DataFrame({"a": pids[rows], "b": pids[cols], "cos": scores})

    def scan(batches):
        tree, held = None, []

        def flush(keep: int):
            nonlocal held
            if not held:
                return
            pids, keys, x = (np.concatenate(part) for part in zip(*held))
            yield from one_run(pids, keys, x)
            held = [(pids[-keep:], keys[-keep:], x[-keep:])] if keep else []

        for pdf in batches:
            for t, part in pdf.groupby("tree", sort=True):
                if t != tree:
                    yield from flush(0)
                    tree = t
                held.append((part["pid"].to_numpy(), part["key"].to_numpy(), np.frombuffer(b"".join(part["unit"]), dtype=np.float32).reshape(len(part), dimensions)))
                if sum(len(h[0]) for h in held) > 2 * RUN:
                    yield from flush(reach)
        yield from flush(0)

    ordered = hashed.repartitionByRange(partitions, "tree", "key").sortWithinPartitions("tree", "key")
    return ordered.select("tree", "key", "pid", "unit").mapInPandas(scan, "a long, b long, cos float")


def neighbours(units: DataFrame, k: int = K, least: float = NO_BOUND, trees: int = TREES, bits: int = BITS, reach: int = REACH, dimensions: int = DIMENSIONS) -> DataFrame:
    """(id, other, cos): for every id its k most similar others, those with a cosine of at least ``least`` if it is given; of equal cosines the smaller id."""
    from skein.functions.state import durable

    ids = durable(usable(units, dimensions))
    # numbers in the order of rep, fixed by writing them
    pts = durable(points(ids, k).orderBy("rep").withColumn("pid", F.monotonically_increasing_id()))
    n = pts.count()
    partitions = max(1, -(-n * trees // RUN))
    near = candidates(forest(pts, sample(pts, n, SAMPLE, dimensions), trees, bits, dimensions, SEED), partitions, k, least, reach, dimensions, bits)
    best = near.groupBy("a", "b").agg(F.max(F.round(F.col("cos").cast("double"), 5)).alias("cos")).groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("m"), "b"))), 1, k).alias("top"))
    best = best.select("a", F.explode("top").alias("t")).select("a", F.col("t.b").alias("b"), (-F.col("t.m")).alias("cos"))
    # from points to ids: an id's own copies first, then the ids of near points, both in bounded arrays
    other = pts.select(F.col("pid").alias("b"), F.col("ids").alias("others"))
    around = best.join(other, "b").groupBy("a").agg(F.collect_list(F.struct((-F.col("cos")).alias("m"), "others")).alias("around"))
    flat = F.flatten(F.transform("around", lambda g: F.transform(g["others"], lambda o: F.struct(g["m"].alias("m"), o.alias("o")))))
    lists = pts.select(F.col("pid").alias("a"), "point", "ids").join(around, "a", "left")
    lists = lists.select("point", F.concat(F.transform("ids", lambda o: F.struct(F.lit(-1.0).alias("m"), o.alias("o"))), F.coalesce(flat, F.array().cast("array<struct<m:double,o:string>>"))).alias("all"))
    # ids of a vector that very many share, at most one vector in HOT rows, are spread over tasks
    hot = F.broadcast(ids.groupBy("point").count().where(F.col("count") > HOT).select("point", F.lit(SALTS).alias("salts")))
    spread = lambda df: df.join(hot, "point", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    mine = spread(ids.select("id", "point")).select("id", "point", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    theirs = spread(lists.where(F.size("all") > 1)).select("point", "all", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    full = mine.join(theirs, ["point", "salt"]).select("id", F.slice(F.array_sort(F.filter("all", lambda o: o["o"] != F.col("id"))), 1, k).alias("top"))
    return full.select("id", F.explode("top").alias("t")).select("id", F.col("t.o").alias("other"), (-F.col("t.m")).alias("cos"))


def found(units: DataFrame, least: float = LEAST, **how) -> DataFrame:
    """(id_a, id_b) of different ids with a cosine of at least ``least``, one of them among the k most similar of the other; the smaller id first."""
    near = neighbours(units, least=least, **how)
    return near.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def asked(units: DataFrame) -> DataFrame:
    """(query_id, vector) of the units by which recall is measured: those whose id's MD5 begins with four digits divisible by 100."""
    return units.where(F.conv(F.substring(F.md5("id"), 1, 4), 16, 10).cast("int") % 100 == 0).select(F.col("id").alias("query_id"), "vector")


def exact(units: DataFrame, k: int = K) -> DataFrame:
    """(id, other, distance, rank): the k most similar others of the units of ``asked``, by comparing them with every unit; of equal ones the smaller id."""
    from skein.operators.vector import knn

    near = knn(asked(units), units, k + 1, "cosine").where(F.col("query_id") != F.col("id"))
    n = F.row_number().over(W.partitionBy("query_id").orderBy("score", "id"))
    return near.select(F.col("query_id").alias("id"), F.col("id").alias("other"), F.col("score").alias("distance"), n.alias("rank")).where(F.col("rank") <= k)


def recall(units: DataFrame, k: int = K, least: float = 0.9) -> DataFrame:
    """(queries, pairs, enough): units asked, their true neighbours, and whether the forest finds the share ``least`` of them."""
    got = measured_recall(units, k)
    return got.select("queries", "pairs", (F.col("hits") >= least * F.col("pairs")).alias("enough"))


def measured_recall(units: DataFrame, k: int = K) -> DataFrame:
    """(queries, pairs, hits): a found unit is a hit if it is as similar as the k-th true neighbour, to five decimals."""
    true = exact(units, k).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("last"))
    found_ = neighbours(units, k).join(F.broadcast(true), "id").groupBy("id").agg(F.count_if(1 - F.col("cos") <= F.col("last") + 2e-5).alias("h"))
    both = true.join(found_, "id", "left")
    return both.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.coalesce(F.sum(F.least("n", F.coalesce("h", F.lit(0)))), F.lit(0)).alias("hits"))
