"""Operator 13, compression of vectors to codes by Lloyd's rounds on heaps.

A vector is cut into PARTS equal consecutive parts of whole numbers; every part position has a codebook of ENTRIES
entries.  Rows are put together in chunks of CHUNK vectors.  For each part position and entry a chunk has a heap of the
parts assigned to it, keyed by slack: the lower bound of a part's distance to any other entry, less the upper bound of
its distance to its own.  When entries move, every slack of a heap shrinks by at most its own entry's drift and the
largest drift of another; so drifts are added up for each heap instead, and keys are slacks with what had been added up
when they went in.  Only parts at the top of a heap, whose key the sum has reached, can have another nearest entry:
they are popped and measured against all entries exactly, in whole numbers, ties to the lower index.  Sums and counts
of each entry follow from what changed.  Slacks are doubles and compared with a margin far above their rounding.

A round is one pass over the chunks, which writes them with their heaps to the shared folder, and one aggregation of
the chunks' sums, which gives the driver PARTS x ENTRIES entries, whatever the number of rows; the codebooks go back
with the next pass's tasks.  So a lost executor costs one pass over its chunks, and nothing is kept in executors.

Numbers are int64 where all of a chunk's components are under SAFE; else the chunk's parts are all measured in every
round in Python's whole numbers, slower but exact, and errors beyond a long's range are reported as its limit.

Cases: rows whose vector is null, empty, or holds null or non-finite components take no part; nor do rows of another length
than the row of the smallest vec_id, which gives the codebooks their length.  A length that PARTS does not divide is cut as evenly as it goes, the
longer parts first.  With fewer than ENTRIES rows there are as many entries as rows.  Null ids come last; equal ids are separate rows,
ordered by their vectors.  Null labels are summed together; other columns of any name are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
CHUNK = 4096
#: Components up to here have squared distances that a long holds, for parts of up to 2**10 components.
SAFE = 1 << 25
#: Whole numbers are summed over chunks in digits of so many bits, which a long holds for 2**23 chunks.
LIMB = 40
MARGIN = 1e-9
MOST_LONG = (1 << 63) - 1
#: Totals of labels are broadcast up to this number of labels.
MOST_LABELS = 100_000

Codebooks = list[list[list[int]]]  # part, entry, component


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE x) of doubles: int64 under SAFE, else Python's whole numbers."""
    if not x.size or np.abs(x).max() < SAFE / SCALE:
        return np.floor(x * SCALE).astype(np.int64)
    out = np.empty(x.shape, dtype=object)
    out.flat = [int(v) * SCALE if abs(v) >= 2.0**52 else math.floor(v * SCALE) for v in x.flat]
    return out


def cuts(dim: int, parts: int = PARTS) -> list[int]:
    """The ends of the parts."""
    return np.cumsum([0] + [dim // parts + (i < dim % parts) for i in range(parts)]).tolist()


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its squared distances to the entries, and the index of the nearest one (ties: the lower)."""
    far = np.stack([((x - e) ** 2).sum(axis=1) if x.shape[1] else np.zeros(len(x), dtype=x.dtype) for e in entries], axis=1)
    best = far.argmin(axis=1)
    return far, best


def drifts(old: Codebooks, new: Codebooks) -> np.ndarray:
    """By how much at most a slack shrinks, for each part and entry: the entry's own drift and the largest of the others."""
    root = lambda n: math.sqrt(n) if n < 1 << 1000 else math.inf
    moved = np.array([[root(sum((a - b) ** 2 for a, b in zip(x, y, strict=True))) for x, y in zip(o, n, strict=True)] for o, n in zip(old, new, strict=True)])
    order = np.sort(moved, axis=1)
    others = np.where(moved == order[:, -1:], order[:, -2:-1], order[:, -1:]) if moved.shape[1] > 1 else np.zeros_like(moved)
    return moved + others


class Chunk:
    """Vectors of a chunk with their codes, the keys of their heaps, and the entries' sums and counts."""

    def __init__(self, x: np.ndarray, codes: np.ndarray, keys: np.ndarray, order: np.ndarray) -> None:
        self.x, self.codes, self.keys, self.order = x, codes, keys, order

    @classmethod
    def fresh(cls, x: np.ndarray, entries: int) -> Chunk:
        """All parts at the first entry, with keys that any sum of drifts reaches."""
        n = len(x)
        return cls(x, np.zeros((n, PARTS), dtype=np.uint8), np.full((PARTS, n), -np.inf), np.tile(np.arange(n, dtype=np.uint16), (PARTS, 1)))

    def heaps(self, part: int, entries: int) -> list[list[tuple[float, int]]]:
        """Each entry's heap; order has all rows of a part, heap by heap, in heap order."""
        order = self.order[part].astype(np.int64)
        keys, codes = self.keys[part][order].tolist(), self.codes[order, part].tolist()
        out: list[list[tuple[float, int]]] = [[] for _ in range(entries)]
        for code, pair in zip(codes, zip(keys, order.tolist(), strict=True), strict=True):
            out[code].append(pair)
        return out

    def assign(self, books: Codebooks, gone: np.ndarray) -> int:
        """Pop what the summed drifts (part, entry) have reached, measure it, and put it where it belongs; how many parts were measured."""
        ends, measured = cuts(self.x.shape[1]), 0
        for p, book in enumerate(books):
            safe = self.x.dtype != object and _safe(book)
            entries = np.array(book, dtype=np.int64 if safe else object).reshape(len(book), -1)
            heaps, popped = self.heaps(p, len(book)), []
            for a, heap in enumerate(heaps):
                bounded, reached = safe and math.isfinite(gone[p, a]), gone[p, a] + MARGIN * (1 + abs(gone[p, a]))
                while heap and (not bounded or heap[0][0] - MARGIN * abs(heap[0][0]) <= reached):
                    popped.append(heapq.heappop(heap)[1])
            if popped:
                measured += len(popped)
                far, best = nearest(self.x[popped, ends[p] : ends[p + 1]], entries)
                self.codes[popped, p] = best
                self.keys[p][popped] = keys = self._keys(far, best, gone[p]) if safe else np.full(len(popped), -np.inf)
                for row, a, key in zip(popped, best.tolist(), keys.tolist(), strict=True):
                    heapq.heappush(heaps[a], (key, row))
                self.order[p] = [row for heap in heaps for _, row in heap]
        return measured

    @staticmethod
    def _keys(far: np.ndarray, best: np.ndarray, gone: np.ndarray) -> np.ndarray:
        """Slacks with what has been added up for the heap; a part of a lone entry is never popped again."""
        rows, own, rest = np.arange(len(far)), far[np.arange(len(far)), best], far.astype(float)
        rest[rows, best] = np.inf
        return np.where(np.isfinite(gone[best]), np.sqrt(rest.min(axis=1)) - np.sqrt(own.astype(float)) + gone[best], -np.inf)

    def sums(self, books: Codebooks, limbs: int) -> np.ndarray:
        """Counts and sums of each entry's parts, each in ``limbs`` digits of LIMB bits: part by part, entry by entry."""
        ends, out = cuts(self.x.shape[1]), []
        for p, book in enumerate(books):
            own = self.x[:, ends[p] : ends[p + 1]]
            for a in range(len(book)):
                mine = own[self.codes[:, p] == a]
                for total in [len(mine), *(mine.sum(axis=0).tolist() if len(mine) else [0] * own.shape[1])]:
                    for i in range(limbs):
                        out.append(total & ((1 << LIMB) - 1) if i < limbs - 1 else total)
                        total >>= LIMB
        return np.array(out, dtype=np.int64)

    def errors(self, books: Codebooks) -> list[int]:
        ends, total = cuts(self.x.shape[1]), [0] * len(self.x)
        for p, book in enumerate(books):
            safe = self.x.dtype != object and _safe(book)
            own = np.array(book, dtype=np.int64 if safe else object).reshape(len(book), -1)[self.codes[:, p]]
            far = ((self.x[:, ends[p] : ends[p + 1]] - own) ** 2).sum(axis=1).tolist()
            total = [a + int(b) for a, b in zip(total, far, strict=True)]
        return [min(e, MOST_LONG) for e in total]


def _safe(book: list[list[int]]) -> bool:
    return all(abs(v) < SAFE * 2 for e in book for v in e)


def from_digits(digits: list[int], limbs: int) -> list[int]:
    """The whole numbers that Chunk.sums() wrote in digits."""
    return [sum(d << (LIMB * i) for i, d in enumerate(digits[at : at + limbs])) for at in range(0, len(digits), limbs)]


def limbs_for(most: float, chunk: int) -> int:
    """Digits for the sums of a chunk of vectors whose components are up to ``most``."""
    return -(-(math.frexp(max(most, 1.0))[1] + (SCALE * chunk).bit_length()) // LIMB)


def moved(books: Codebooks, digits: list[int], limbs: int) -> Codebooks:
    """Each entry replaced by its parts' componentwise floor(sum / count); unused entries stay."""
    numbers, at, out = from_digits(digits, limbs), 0, []
    for book in books:
        new = []
        for e in book:
            count, sums = numbers[at], numbers[at + 1 : at + 1 + len(e)]
            new.append([s // count for s in sums] if count else e)
            at += 1 + len(e)
        out.append(new)
    return out


def _pack(x: np.ndarray) -> bytes:
    """A chunk's numbers in the fewest bytes that hold them; beyond int64 as text."""
    if x.dtype == object:
        return b"t" + ",".join(map(str, x.ravel().tolist())).encode()
    most = int(np.abs(x).max(initial=0))
    kind = "h" if most < 1 << 15 else "i" if most < 1 << 31 else "q"
    return kind.encode() + x.astype(f"<{np.dtype(kind).str[1:]}").tobytes()


def _unpack(told: bytes, dim: int) -> np.ndarray:
    if told[:1] == b"t":
        return np.array([int(v) for v in told[1:].decode().split(",")], dtype=object).reshape(-1, dim)
    return np.frombuffer(told, dtype=f"<{np.dtype(told[:1].decode()).str[1:]}", offset=1).astype(np.int64).reshape(-1, dim)


def taking_part(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label and x (doubles) of the rows that take part, but for their length."""
    finite = F.forall(F.col(vec_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    kept = vectors.where(F.col(vec_col).isNotNull() & (F.size(vec_col) > 0) & finite)
    return kept.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.transform(F.col(vec_col), lambda v: v.cast("double")).alias("x"))


_NAMES = ["ids", "labels", "x", "codes", "keys", "heap", "sums", "measured"]


def _schema(kind: str) -> str:
    return f"ids array<long>, labels array<{kind}>, x binary, codes binary, keys binary, heap binary, sums array<long>, measured long"


def compress(vectors: DataFrame, rounds: int = ROUNDS, entries: int = ENTRIES, chunk: int = CHUNK, measures: list | None = None) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each row that takes part.

    measures, if given, gets how many parts each assignment measured of how many.
    """
    spark, rows = vectors.sparkSession, taking_part(vectors)
    label = vectors.schema["label"].dataType.simpleString()
    fields = f"vec_id long, code string, error decimal(38,0), label {label}"
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(1).collect()
    if not first:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    dim = len(first[0]["x"])
    rows = rows.where(F.size("x") == dim)
    seeds = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(entries).collect()
    ends = cuts(dim)
    start = whole_numbers(np.array([r["x"] for r in seeds], dtype=float)).tolist()
    books: Codebooks = [[v[ends[p] : ends[p + 1]] for v in start] for p in range(PARTS)]
    n_entries = len(seeds)
    limbs = limbs_for(rows.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0], chunk)
    def batch(ids, labels, c: Chunk, told: Codebooks, measured: int) -> pa.RecordBatch:
        held = [_pack(c.x), c.codes.tobytes(), c.keys.tobytes(), c.order.tobytes()]
        arrays = [pa.array([v], pa.binary()) for v in held]
        return pa.RecordBatch.from_arrays([ids, labels, *arrays, pa.array([c.sums(told, limbs)], pa.list_(pa.int64())), pa.array([measured], pa.int64())], names=_NAMES)

    def one_list(a: pa.Array) -> pa.ListArray:
        return pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)

    def begin(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, chunk):
                part = b.slice(at, chunk)
                flat = part.column("x").flatten().to_numpy(zero_copy_only=False)
                c = Chunk.fresh(whole_numbers(flat.reshape(-1, dim)), n_entries)
                measured = c.assign(books, np.zeros((PARTS, n_entries)))
                yield batch(one_list(part.column("vec_id")), one_list(part.column("label")), c, books, measured)

    def read(b: pa.RecordBatch, i: int) -> Chunk:
        x, codes, keys, order = (b.column(name)[i].as_py() for name in _NAMES[2:6])
        x = _unpack(x, dim)
        n = len(x)
        return Chunk(x, np.frombuffer(codes, dtype=np.uint8).reshape(n, PARTS).copy(), np.frombuffer(keys).reshape(PARTS, n).copy(), np.frombuffer(order, dtype=np.uint16).reshape(PARTS, n).copy())

    table = materialize(rows.mapInArrow(begin, _schema(label)), "chunks")
    gone = np.zeros((PARTS, n_entries))
    for _ in range(rounds):
        if measures is not None:
            measures.append(tuple(table.agg(F.sum("measured"), F.sum(F.size("ids") * PARTS)).first()))
        digits = table.select(F.posexplode("sums").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("v"))
        new = moved(books, [r["v"] for r in sorted(digits.collect())], limbs)
        gone, books = gone + drifts(books, new), new

        def step(batches: Iterator[pa.RecordBatch], books: Codebooks = books, gone: np.ndarray = gone) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(b.num_rows):
                    c = read(b, i)
                    measured = c.assign(books, gone)
                    yield batch(b.column("ids").slice(i, 1), b.column("labels").slice(i, 1), c, books, measured)

        old, table = table, materialize(table.mapInArrow(step, _schema(label)), "chunks")
        discard(old)
    if measures is not None:
        measures.append(tuple(table.agg(F.sum("measured"), F.sum(F.size("ids") * PARTS)).first()))

    def codes(batches: Iterator[pa.RecordBatch], books: Codebooks = books) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                c = read(b, i)
                told = pa.array([row.tobytes().hex() for row in c.codes], pa.string())
                error = pa.array([Decimal(e) for e in c.errors(books)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([b.column("ids").slice(i, 1).flatten(), told, error, b.column("labels").slice(i, 1).flatten()], names=["vec_id", "code", "error", "label"])

    told = materialize(table.mapInArrow(codes, fields), "codes")
    discard(table)
    totals = told.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label")
    n_labels = totals.limit(MOST_LABELS + 1).count()
    totals = F.broadcast(totals) if n_labels <= MOST_LABELS else totals
    sha = hashlib.sha256(",".join(str(v) for book in books for e in book for v in e).encode()).hexdigest()
    clip = lambda c: F.least(F.col(c), F.lit(MOST_LONG)).cast("long").alias(c)
    out = told.join(totals, F.col("label").eqNullSafe(F.col("_label")), "left")
    return out.select("vec_id", "code", clip("error"), clip("label_error"), F.lit(sha).alias("codebooks_sha256"))
