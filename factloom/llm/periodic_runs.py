r"""Operator 11, periodic runs of words by the algorithm of Kolpakov and Kucherov.

Words are ``[^\x20\x09-\x0D]+`` of the whole text.  A run is a stretch of words with smallest period q that no
neighbouring word extends; those of LEAST_LENGTH words and LEAST_EXPONENT periods or more are wanted.

1. A suffix automaton gives the LZ factorisation: each factor is the longest stretch that has begun before, or a new word.
2. Main's algorithm finds, in time linear in the two factors, the runs that cross or touch the border between a factor
   and the one before it: longest common extensions to both sides of the border for every period at once.
3. A run strictly inside a factor occurs in the factor's earlier occurrence too, so it is copied from there.

A wanted run of period q holds, at each of its first places, a gram of GRAM words that stands again q words on (its
length less q is at least GRAM).  So runs lie within stretches that are covered by grams which the text holds twice.
Stretches are found by hashes, which can only add to them, and the algorithm runs on the words of each stretch; texts
without a repeated gram need no automaton.  Time is linear in the text but for sorting its hashes, and memory is of the
order of the longest stretch.

With rewrites on (the contract's), a text whose document number says so has its tail made periodic first.

Cases: null or empty texts and texts of white space have no words, no run, and the hash of nothing; a null doc_id is
kept, and its text is never rewritten; texts of any length are read whole; repeated rows are judged row by row; other columns of any
name are ignored; an empty table gives no rows.  Rows are judged one by one in Arrow batches, without a shuffle, so a
lost executor costs its own tasks only.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import text_of

LEAST_LENGTH = 24
LEAST_EXPONENT = 3
#: Words of a gram: a run's length less its period is never under it.
GRAM = LEAST_LENGTH - LEAST_LENGTH // LEAST_EXPONENT
_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)

Run = tuple[int, int, int]


def words_of(text: bytes) -> list[bytes]:
    """bytes.split() splits at the six white signs of ASCII, which are those of the contract."""
    return text.split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the place of its first occurrence."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, range(len(words))), dtype=np.int64, count=len(words))


def rewritten(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The contract's periodic tail."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def stretches(x: np.ndarray, gram: int = GRAM) -> list[tuple[int, int]]:
    """The maximal stretches of x that grams cover which x holds twice."""
    n = len(x)
    if n <= gram:
        return []
    h, size, rest = x.astype(np.uint64), 1, gram
    with np.errstate(over="ignore"):
        h = (h + np.uint64(1)) * _MIX
        h ^= h >> np.uint64(29)
        tail, done = None, 0
        while rest:
            if rest & 1:  # the gram is put together from powers of two
                tail, done = (h, size) if tail is None else (_joined(tail[: len(h) - done], h[done:]), done + size)
            rest >>= 1
            if rest:
                h, size = _joined(h[:-size], h[size:]), size * 2
    order = np.argsort(tail, kind="stable")
    same = tail[order[1:]] == tail[order[:-1]]
    if not same.any():
        return []
    twice = np.zeros(n + 1, dtype=np.int64)
    held = np.zeros(len(tail), dtype=bool)
    held[order[1:][same]] = True
    held[order[:-1][same]] = True
    at = np.flatnonzero(held)
    twice[at] += 1
    np.subtract.at(twice, at + gram, 1)
    covered = np.concatenate([[0], (np.cumsum(twice[:n]) > 0).astype(np.int8), [0]])
    edge = np.diff(covered)
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = a * _MIX2 + b
    h ^= h >> np.uint64(31)
    return h * _MIX


class Automaton:
    """The suffix automaton of a sequence: for each state its length, suffix link, end of its first occurrence and steps.

    Most states have one step, which stands in two arrays; only further steps take a dictionary.
    """

    def __init__(self, x: list[int]) -> None:
        self.length, self.link, self.first_end = array("q", [0]), array("q", [-1]), array("q", [-1])
        self.symbol, self.target, self.more = array("q", [-1]), array("q", [-1]), {}
        length, link, first_end, last = self.length, self.link, self.first_end, 0
        step, put = self.step, self._put
        for i, c in enumerate(x):
            own = self._state(i + 1, 0, i)
            p = last
            while p != -1 and (q := step(p, c)) == -1:
                put(p, c, own)
                p = link[p]
            if p != -1:
                if length[q] == length[p] + 1:
                    link[own] = q
                else:
                    twin = self._state(length[p] + 1, link[q], first_end[q])
                    self.symbol[twin], self.target[twin] = self.symbol[q], self.target[q]
                    if q in self.more:
                        self.more[twin] = self.more[q].copy()
                    while p != -1 and step(p, c) == q:
                        put(p, c, twin)
                        p = link[p]
                    link[q] = link[own] = twin
            last = own

    def _state(self, length: int, link: int, first_end: int) -> int:
        for column, v in ((self.length, length), (self.link, link), (self.first_end, first_end), (self.symbol, -1), (self.target, -1)):
            column.append(v)
        return len(self.length) - 1

    def step(self, state: int, c: int) -> int:
        if self.symbol[state] == c:
            return self.target[state]
        more = self.more.get(state)
        return more.get(c, -1) if more else -1

    def _put(self, state: int, c: int, to: int) -> None:
        if self.symbol[state] in (-1, c):
            self.symbol[state], self.target[state] = c, to
        else:
            self.more.setdefault(state, {})[c] = to


def factors(x: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, start of the earlier occurrence or -1) of the LZ factors of x (numbers from 0)."""
    whole = Automaton(x)
    step, first_end = whole.step, whole.first_end
    out, i, n = [], 0, len(x)
    while i < n:
        state, k, source = 0, 0, -1
        while i + k < n:
            state = step(state, x[i + k])  # all of x is in the automaton
            begins = first_end[state] - k
            if begins >= i:
                break
            source, k = begins, k + 1
        out.append((i, max(k, 1), source))
        i += max(k, 1)
    return out


def z_values(x: list[int]) -> list[int]:
    """For each place of x, how long what begins there goes on like x itself."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def at_border(x: list[int], b: int, left: int, right: int, most: int, found: dict[tuple[int, int], int]) -> None:
    """Main's step: put the wanted runs of x that cross or touch b, lie in x[left:right] and have a period of at most ``most``, into found."""
    t, v, n = x[left:b], x[b:right], len(x)
    back = t[::-1]

    def keep(s: int, e: int, q: int) -> None:
        if e - s >= max(LEAST_LENGTH, LEAST_EXPONENT * q) and found.get((s, e), q) >= q:
            if (s == 0 or x[s - 1] != x[s - 1 + q]) and (e == n or x[e] != x[e - q]):  # else it goes on beyond what is looked at
                found[s, e] = q

    ahead = z_values(v)  # v against itself
    behind = z_values([*back, -1, *v[::-1], *back])  # t backwards against what ends q words right of the border
    for q in range(1, min(len(v), most) + 1):
        on, off = ahead[q] if q < len(v) else 0, behind[len(t) + 1 + len(v) - q]
        if on + off >= (LEAST_EXPONENT - 1) * q:
            keep(b - off, b + q + on, q)
    ahead = z_values([*v, -1, *t, *v])  # v against what begins q words left of the border
    behind = z_values(back)
    for q in range(1, min(len(t), most) + 1):
        on, off = ahead[len(v) + 1 + len(t) - q], behind[q] if q < len(t) else 0
        if on + off >= (LEAST_EXPONENT - 1) * q:
            keep(b - q - off, b + on, q)


def runs_of(x: list[int]) -> list[Run]:
    """(start, length, period) of every wanted run of x, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    starts: dict[int, list[tuple[int, int]]] = {}  # of every run so far: its start, with ends and periods
    before = 0
    for b, size, source in [*factors(x), (len(x), 0, -1)]:
        # A run that ends in this factor begins less than its period before the last one, which is longest; so three
        # periods fit in half of both factors, and the whole in one and a half of them.
        both = before + size
        if both * 3 > LEAST_LENGTH * 2:
            new: dict[tuple[int, int], int] = {}
            at_border(x, b, max(0, b - before - both // 2), b + size, both // 2, new)
            for (s, e), q in new.items():
                if (s, e) not in found:
                    found[s, e] = q
                    starts.setdefault(s, []).append((e, q))
        if size > LEAST_LENGTH:
            for i in range(1, size):
                for e, q in starts.get(source + i, ()):
                    if e < source + size and (b + i, e + b - source) not in found:
                        found[b + i, e + b - source] = q
                        starts.setdefault(b + i, []).append((e + b - source, q))
        before = size
    return sorted((s, e - s, q) for (s, e), q in found.items())


def text_runs(words: list[bytes]) -> list[Run]:
    """(start, length, period) of every wanted run of the words, by start, then period."""
    if len(words) < LEAST_LENGTH:
        return []
    x = numbered(words)
    return [(a + s, n, q) for a, z in stretches(x) if z - a >= LEAST_LENGTH for s, n, q in runs_of(x[a:z].tolist())]


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, dtype=np.int64)
    for s, n, q in runs:
        gone[s + q] += 1
        gone[s + n] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


FIELDS = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def find_runs(docs: DataFrame, rewrite: bool = False, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """FIELDS of each row of docs: the run of greatest exponent (then smallest start, then period), and hashes of all.

    With spans, also all runs and the collapsed text.
    """

    def judged(doc_id: int | None, text: bytes) -> tuple:
        words = words_of(text)
        words = rewritten(words, doc_id) if rewrite else words
        runs = text_runs(words)
        kept = b" ".join(collapsed(words, runs))
        top = (None,) * 4
        if runs:
            s, n, q = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
            top = (s, n, q, 1000 * n // q)
        told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        out = (doc_id, len(runs), *top, hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())
        return (*out, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], kept.decode(errors="replace")) if spans else out

    fields = FIELDS + (", runs array<struct<start:long,length:long,period:long>>, collapsed string" if spans else "")
    kinds = [pa.int64()] * 6 + [pa.string()] * 2 + ([pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])), pa.string()] if spans else [])
    names = [f.split()[0] for f in FIELDS.split(", ")] + (["runs", "collapsed"] if spans else [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [judged(i, bytes(t.as_buffer() or b"")) for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).cast("binary").alias("text")).mapInArrow(run, fields)
