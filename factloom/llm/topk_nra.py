"""Operator 7, exact top-k search by aggregation of sorted lists without random access (NRA).

Vectors are dealt into blocks by hash, and a block's rows into leaves of about LEAF rows that lie close together (the
rows are halved again and again along the component that varies most).  In a leaf every dimension has its components
as a sorted list, read from the top for queries with a positive weight there and from the bottom for negative ones.

Each query first visits the leaf of its greatest upper bound, which the heads of a leaf's lists give before anything
is read; then of the others only those whose bound reaches its k-th best score so far.  In a leaf, all queries that
visit it read in step, to doubling depths: what is read adds to a row's lower bound (its missing terms are at least
the last value of the list), and its upper bound is that with the value at the reading position for every list that
has not shown it.  A query stops reading when no row outside a few can reach its k-th best lower bound (k rows so far,
over all leaves): RESOLVE times k rows at most can then still qualify, and their final scores are resolved by reading
the rest of their entries.  Reads for many queries at once are matrix products of the components read so far, so the
bounds cost no Python loop over entries.  Where few queries of a block stop before the ends of the lists, as with
vectors that point anywhere, further leaves are read to the ends at once, one product each; so the bounds cost a small
multiple of the one product at most.  search_block() tells how many entries were read of how many.

The k best of each block meet by query: k rows for each block and query.  Queries are a stated set; they are dealt
into query blocks of QUERY_BLOCK rows and each data block is joined with each query block, never row with row.

Scores are whole numbers without rounding: where products could pass 2**53, blocks are searched in Python's whole
numbers, slower but exact.  Scores outside a long's range are ranked by their true value and reported as its limit.

Cases: null vectors and vectors with a null or non-finite component take no part, as query or candidate; vectors of
another length than the query's are no candidates; ties go to the smaller id, also within thousands of equal vectors;
repeated ids are separate candidates and a query leaves out every row of its own id; a repeated query id has k rows for
each of its rows; a null id is a candidate, at ties the smallest, and never a query; an empty table gives no rows.  A query's own rows are
those of its id: that is how "every row but the query's own" is read here where ids repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SCALE = 256
K = 5
QUERY_EVERY = 50
BLOCK = 4096
QUERY_BLOCK = 8192
LEAF = 256
FIRST_DEPTH = 0.125
RESOLVE = 4
#: Visits of leaves after which a block knows whether reading to a depth pays.
TRIED = 16
QUERIES_AT_ONCE = 1024
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)
NO_ID = LONG[0]  # stands for a null id while ids are whole numbers of numpy
#: Digits that hold any product of finite doubles.
DIGITS = 1400


def taking_part(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, x (doubles) and dim, of the vectors that take part."""
    finite = F.forall(F.col(vec_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(F.col(vec_col).isNotNull() & finite)
    x = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    return kept.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("vec_id"), x.alias("x"), F.size(vec_col).alias("dim"))


def quantised(x: np.ndarray, exact: bool = False) -> np.ndarray:
    """floor(256 x) of doubles: doubles, or with exact Python's whole numbers."""
    if not exact:
        return np.floor(x * SCALE)
    out = np.empty(x.shape, dtype=object)
    out.flat = [int(v) * SCALE if abs(v) >= EXACT else int(np.floor(v * SCALE)) for v in x.flat]
    return out


def leaves_of(x: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Row numbers of x in parts of at most leaf rows that lie close together."""
    near, done, todo = np.clip(x.astype(float), -1e100, 1e100), [], [np.arange(len(x))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf or not x.shape[1]:
            done += [rows[a : a + leaf] for a in range(0, len(rows), leaf)]
            continue
        own = near[rows]
        widest = own[:, int(own.std(axis=0).argmax())]
        half = np.argsort(widest, kind="stable")
        todo += [rows[half[: len(rows) // 2]], rows[half[len(rows) // 2 :]]]
    return done


class Leaf:
    """The rows of a leaf by ascending id, its sorted lists and, for each entry, its place in its list; lists are made when first read."""

    def __init__(self, ids: np.ndarray, x: np.ndarray) -> None:
        self.ids, self.x = ids, x
        self.high, self.low = x.max(axis=0), x.min(axis=0)
        self._lists: tuple[np.ndarray, np.ndarray] | None = None

    def lists(self) -> tuple[np.ndarray, np.ndarray]:
        if self._lists is None:
            order = np.argsort(self.x, axis=0, kind="stable")
            rank = np.empty_like(order)
            np.put_along_axis(rank, order, np.arange(len(order))[:, None], axis=0)
            self._lists = np.take_along_axis(self.x, order, axis=0), rank
        return self._lists


def _best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> list[tuple]:
    """The (-score, id) of the k best, ids ascending; own rows are left out."""
    rows = np.flatnonzero(~own)
    if len(rows) > 4 * k and scores.dtype != object:
        rows = rows[scores[rows] >= np.partition(scores[rows], len(rows) - k)[len(rows) - k]]
    return sorted(zip((-scores[rows]).tolist(), ids[rows].tolist(), strict=True))[:k]


def nra_leaf(leaf: Leaf, qids: np.ndarray, q: np.ndarray, k: int, reached: np.ndarray, whole: bool = False) -> tuple[list[list[tuple]], int, int]:
    """For each query the (-score, id) of the rows of a leaf that can be among its k best; how many entries were read, and how many queries stopped early.

    reached: each query's k-th best score elsewhere (minus infinity if it has fewer).  whole: the lists are read to
    their ends at once.
    """
    ids, x = leaf.ids, leaf.x
    n, dims = x.shape
    if whole or n < 8:
        scores = q @ x.T if dims else np.zeros((len(q), n))
        own = qids[:, None] == ids[None, :]
        some = ((scores >= reached[:, None]) & ~own).any(axis=1)
        return [_best(scores[i], ids, own[i], k) if some[i] else [] for i in range(len(q))], n * dims * len(q), 0
    number = object if x.dtype == object else float
    lists, rank = leaf.lists()
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    out: list = [[] for _ in range(len(q))]
    left, entries, early = np.arange(len(q)), 0, 0
    low = np.zeros((len(q), n), dtype=number)
    done, depth = 0, max(1, int(n * FIRST_DEPTH))
    while len(left):
        depth = min(depth, n)
        most = least = 0
        sides = ((up[left], n - 1 - rank, lists[n - depth], lists[0]), (down[left], rank, lists[depth - 1], lists[-1]))
        for w, seen_from, next_one, end in sides:
            new = np.where((seen_from >= done) & (seen_from < depth), x, 0)
            low = low + w @ new.T
            unseen = (seen_from >= depth).astype(number).T
            most, least = most + (w * next_one) @ unseen, least + (w * end) @ unseen
        upper, lower = low + most, low + least
        own = qids[left][:, None] == ids[None, :]
        lower[own] = upper[own] = -np.inf
        kth = reached[left]
        if n >= k:
            kth = np.maximum(kth, np.partition(lower, n - k, axis=1)[:, n - k] if number is float else np.sort(lower, axis=1)[:, n - k])
        can = (upper >= kth[:, None]) & ~own
        ready = (can.sum(axis=1) <= RESOLVE * k) if depth < n else np.ones(len(left), bool)
        for i in np.flatnonzero(ready):
            entries += depth * dims
            early += depth < n
            rows = np.flatnonzero(can[i])
            if len(rows):
                entries += (n > depth) * dims * len(rows)
                score = x[rows] @ q[left[i]] if dims else np.zeros(len(rows))
                out[left[i]] = _best(score, ids[rows], np.zeros(len(rows), bool), k)
        left, low, done, depth = left[~ready], low[~ready], depth, depth * 2
    return out, entries, early


def search_block(ids: np.ndarray, x: np.ndarray, qids: np.ndarray, q: np.ndarray, k: int = K, leaf: int = LEAF) -> tuple[list[list[tuple]], int, int]:
    """For each query the (-score, id) of its k best rows of the block; entries read, and entries that there are to read.

    First each query visits the leaf of its greatest bound, then the others in the order of their greatest bounds, all
    queries together whose k-th best the leaf's bound for them reaches: nothing of a leaf is read for the rest.
    Reading to a depth costs products of its own, so it goes on only while it lets a half of the queries stop early.
    """
    keep = np.argsort(ids, kind="stable")
    ids, x = ids[keep], x[keep]
    parts = [Leaf(ids[p], x[p]) for p in (np.sort(p) for p in leaves_of(x, leaf))]
    up, down = np.maximum(q, 0), np.minimum(q, 0)
    bound = np.stack([up @ p.high + down @ p.low for p in parts], axis=1)
    reached = np.full(len(q), -np.inf, dtype=x.dtype)
    best: list[list[tuple]] = [[] for _ in range(len(q))]
    first = bound.argmax(axis=1)
    asked = stopped = entries = 0

    def visit(p: int, who: np.ndarray) -> None:
        nonlocal asked, stopped, entries
        whole = asked >= TRIED and stopped * 2 < asked
        found, read, early = nra_leaf(parts[p], qids[who], q[who], k, reached[who], whole)
        entries += read
        if not whole:
            asked, stopped = asked + len(who), stopped + early
        for i, new in zip(who.tolist(), found, strict=True):
            if new:
                best[i] = sorted(best[i] + new)[:k]
                if len(best[i]) == k:
                    reached[i] = -best[i][-1][0]

    for p in range(len(parts)):
        who = np.flatnonzero(first == p)
        if len(who):
            visit(p, who)
    for p in sorted(range(len(parts)), key=lambda p: -max(bound[:, p], default=0)):
        who = np.flatnonzero((first != p) & (bound[:, p] >= reached))
        if len(who):
            visit(p, who)
    return best, entries, len(q) * x.size


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY, block: int = BLOCK, query_block: int = QUERY_BLOCK, leaf: int = LEAF) -> DataFrame:
    """query_id, rank, vec_id, score: the k greatest inner products of each query row with all other rows."""
    rows = taking_part(vectors)
    n = rows.count()
    blocks, query_blocks = max(1, -(-n // block)), max(1, -(-n // every // query_block))
    uid = F.xxhash64("vec_id", "x", F.monotonically_increasing_id())
    data = rows.withColumn("block", F.pmod(uid, F.lit(blocks)).cast("int"))
    asked = rows.where((F.col("vec_id") != NO_ID) & (F.col("vec_id") % every == 0)).withColumn("q_row", F.monotonically_increasing_id()).withColumn("q_block", F.pmod(F.xxhash64("vec_id", "q_row"), F.lit(query_blocks)).cast("int"))
    data = data.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))))
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def found(c: pd.DataFrame, q: pd.DataFrame, dim: int) -> Iterator[tuple]:
        ids, cx = c["vec_id"].to_numpy(), np.stack(c["x"].to_list()).reshape(len(c), dim)
        top = np.abs(cx).max(initial=0) * SCALE + 1
        for at in range(0, len(q), QUERIES_AT_ONCE):
            some = q.iloc[at : at + QUERIES_AT_ONCE]
            qx = np.stack(some["x"].to_list()).reshape(len(some), dim)
            with np.errstate(over="ignore"):
                exact = bool(top * (np.abs(qx).max(initial=0) * SCALE + 1) * max(dim, 1) >= EXACT)
            best, _, _ = search_block(ids, quantised(cx, exact), some["vec_id"].to_numpy(), quantised(qx, exact), k, leaf)
            for q_row, query, near in zip(some["q_row"], some["vec_id"], best, strict=True):
                for minus, i in near:
                    score = -int(minus)
                    beyond = "" if LONG[0] <= score <= LONG[1] else f"{score % 10**DIGITS:0{DIGITS}d}"
                    yield q_row, query, i, min(max(score, LONG[0]), LONG[1]), beyond

    def search(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for dim in sorted(set(left["dim"]) & set(right["dim"])):
            out += found(left[left["dim"] == dim], right[right["dim"] == dim], dim)
        told = pd.DataFrame(out, columns=["q_row", "query_id", "vec_id", "score", "beyond"])
        return told.astype({"q_row": "int64", "query_id": "int64", "vec_id": "int64", "score": "int64"})

    best = data.groupBy("block", "q_block").cogroup(asked.groupBy("block", "q_block")).applyInPandas(search, "q_row long, query_id long, vec_id long, score long, beyond string")
    w = Window.partitionBy("q_row").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return best.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), F.nullif("vec_id", F.lit(NO_ID)).alias("vec_id"), "score")
