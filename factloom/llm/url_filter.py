"""Operator 5, URL filters: cascades of Bloom filters that are exact over the corpus's complete key universe.

A key is a host suffix and a path prefix that ends in ``/``.  Level 0 of a list's cascade encodes the listed keys;
level 1 the keys of the universe that level 0 wrongly passes; level 2 the listed keys that level 1 wrongly passes, and
so on until no key is passed wrongly.  A key's membership is then told by the parity of the first level that rejects
it, for every key of the universe without error, and URLs are judged without a join.

There are three cascades: one of the hosts that rules name, over all host suffixes of the corpus, and one of the keys
of each verdict, over all keys of the corpus whose host the first passes.  So a URL has as many keys as its path has
parts for each of its suffixes that a rule names, and not for each of its suffixes.  Keys are 128-bit hashes made by a
running hash over the labels and parts, so time and memory follow a URL's length.

Building: each level is one pass over the surviving keys; a task sets bits in its own array and sends the words that
are not zero, which are combined by bitwise or.  Only bit arrays reach the driver, never keys.  Rules are halved by
hash until every level of a part, counted before it is made, stays under MAX_BYTES; a part's arrays are broadcast
for one pass over the URLs, so no list is too long, no corpus too large, and there is no other way for long ones.

Cases: a null url, or one without ``://``, has empty host and path, no rule and the default verdict; an empty path
fits no rule (rules' paths start with ``/``); the longest key wins, of equally long ones that with the longer host; a
key on both lists is allowed; repeated rows are judged row by row; other columns of any name are ignored; empty tables
and empty lists give empty cascades.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, materialize

#: The rules that the contract fixes: (key, verdict).
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
DEFAULT = "allow"
BITS_PER_KEY = 10
HASHES = 4
LEAST_BITS = 512
#: Most bytes of a level's bit array; a part of the rules has three cascades, whose later levels are shorter than their first.
MAX_BYTES = 64 << 20
LOWER = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), *LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _running(parts: list[str], salt: bytes) -> np.ndarray:
    """Two 64-bit hashes of parts[:1], parts[:2], ... as rows."""
    h, out = hashlib.blake2b(salt, digest_size=16), []
    for p in parts:
        h.update(p.encode("utf-8", "surrogatepass") + b"\0")
        out.append(h.digest())
    return np.frombuffer(b"".join(out), dtype="<u8").reshape(-1, 2)


def host_suffixes(host: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and lengths of all suffixes of the host that begin at a label, the shortest first."""
    labels = host.split(".")[::-1]
    return _running(labels, b"host"), np.cumsum([len(x) + 1 for x in labels]) - 1


def path_prefixes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and lengths of all prefixes of the path that end in a slash, the shortest first."""
    parts = path.split("/")[:-1]
    return _running(parts, b"path"), np.cumsum([len(x) + 1 for x in parts], dtype=np.int64)


def joined(host: np.ndarray, path: np.ndarray) -> np.ndarray:
    """The hashes of keys from those of their hosts and paths."""
    with np.errstate(over="ignore"):
        x = (host ^ (path * _ODD + (path >> np.uint64(29)))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(31))


def _positions(h1: np.ndarray, h2: np.ndarray, level: int, bits: int, hashes: int = HASHES) -> np.ndarray:
    """Bit positions of each key; every level mixes anew."""
    a, b = h1.astype(np.uint64), h2.astype(np.uint64)
    with np.errstate(over="ignore"):
        b = (b ^ np.uint64(level + 1) * _ODD) | np.uint64(1)
        a = a ^ (b >> np.uint64(17)) * np.uint64(0xBF58476D1CE4E5B9)
        steps = a[:, None] + b[:, None] * np.arange(1, hashes + 1, dtype=np.uint64)[None, :]
        steps ^= steps >> np.uint64(31)
        steps *= np.uint64(0x94D049BB133111EB)
        steps ^= steps >> np.uint64(29)
    return (steps % np.uint64(bits)).astype(np.int64)


@dataclass
class Cascade:
    """Bit arrays of the levels, 64 bits a word, and how many bits a key has in the first one (HASHES in the others)."""

    levels: list[np.ndarray]
    hashes: int = HASHES

    def passes(self, level: int, keys: np.ndarray) -> np.ndarray:
        words = self.levels[level]
        at = _positions(keys[:, 0], keys[:, 1], level, len(words) * 64, HASHES if level else self.hashes)
        return ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)

    def listed(self, keys: np.ndarray) -> np.ndarray:
        """Whether each key (rows of two hashes) of the universe is listed."""
        first = np.full(len(keys), len(self.levels))
        for level in range(len(self.levels) - 1, -1, -1):
            first[~self.passes(level, keys)] = level
        return first % 2 == 1

    @property
    def nbytes(self) -> int:
        return sum(x.nbytes for x in self.levels)


def _hashes(b: pd.DataFrame) -> np.ndarray:
    return b[["h1", "h2"]].to_numpy(dtype=np.int64).view(np.uint64)


def _frame(keys: np.ndarray, **more: object) -> pd.DataFrame:
    return pd.DataFrame({"h1": keys[:, 0].astype(np.int64), "h2": keys[:, 1].astype(np.int64), **more})


class TooLong(Exception):
    """A level's array would be longer than it may be."""


def build_cascade(keys: DataFrame, listed: str, max_bytes: int = MAX_BYTES) -> Cascade:
    """The cascade of the keys (h1, h2) for which the boolean column ``listed`` holds, over all the keys.

    The first level has so many bits a key that it wrongly passes about as many keys of the universe as are listed,
    however large the universe is; so all levels follow the list's length, times the logarithm of the universe's.  No
    level over max_bytes is made or fetched, unless it encodes one key: TooLong is raised.
    """
    spark, alive, first = keys.sparkSession, keys.select("h1", "h2", F.col(listed).alias("in_list")), True
    levels: list[np.ndarray] = []
    hashes = HASHES
    while True:
        level, encodes = len(levels), len(levels) % 2 == 0
        some = alive.where(F.col("in_list") == encodes)
        n = some.count()
        if not n:
            if not first:
                discard(alive)
            return Cascade(levels, hashes)
        per_key, used = BITS_PER_KEY, HASHES
        if first:
            per_key = max(BITS_PER_KEY, 1.45 * math.log2(max(alive.count() / n, 1)))
            hashes = used = max(HASHES, round(per_key * math.log(2))) if per_key > BITS_PER_KEY else HASHES
        words = max(LEAST_BITS, int(n * per_key)) // 64 + 1
        if 8 * words > max_bytes and n > 1:
            if not first:
                discard(alive)
            raise TooLong(f"level {level} of {n} keys")

        def set_bits(batches: Iterator[pd.DataFrame], level: int = level, words: int = words, used: int = used) -> Iterator[pd.DataFrame]:
            own = np.zeros(words, dtype=np.uint64)
            for b in batches:
                h = _hashes(b)
                at = _positions(h[:, 0], h[:, 1], level, words * 64, used).ravel()
                np.bitwise_or.at(own, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
            full = np.flatnonzero(own)
            yield pd.DataFrame({"at": full, "word": own[full].astype(np.int64)})

        parts = some.select("h1", "h2").mapInPandas(set_bits, "at long, word long")
        got = parts.groupBy("at").agg(F.bit_or("word").alias("word")).toPandas()
        array = np.zeros(words, dtype=np.uint64)
        array[got["at"].to_numpy(dtype=np.int64)] = got["word"].to_numpy(dtype=np.int64).astype(np.uint64)
        levels.append(array)
        told = spark.sparkContext.broadcast(Cascade([array]))
        skip = level

        def survive(batches: Iterator[pd.DataFrame], level: int = skip, encodes: bool = encodes, used: int = used, told=told) -> Iterator[pd.DataFrame]:
            # what the level encodes, and of the rest what it passes wrongly
            only = told.value.levels[0]
            for b in batches:
                h = _hashes(b)
                at = _positions(h[:, 0], h[:, 1], level, len(only) * 64, used)
                passed = ((only[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
                yield b[(b["in_list"] == encodes).to_numpy() | passed]

        old, alive = alive, materialize(alive.mapInPandas(survive, "h1 long, h2 long, in_list boolean"), "keys")
        told.destroy()
        if not first:
            discard(old)
        first = False


def hashed_rules(rules: DataFrame) -> DataFrame:
    """key, verdict, the hashes of its host (g1, g2) and of the whole key (h1, h2) of each rule."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            split = [k.partition("/") for k in b["key"]]
            hosts = [host_suffixes(h)[0][-1] for h, _, _ in split]
            keys = [joined(h, path_prefixes("/" + p)[0][-1]) for h, (_, _, p) in zip(hosts, split, strict=True)]
            hosts, keys = (np.array(x, dtype=np.uint64).reshape(-1, 2) for x in (hosts, keys))
            yield _frame(keys, g1=hosts[:, 0].astype(np.int64), g2=hosts[:, 1].astype(np.int64), verdict=b["verdict"].to_numpy())

    return rules.where(F.col("key").like("%/")).mapInPandas(run, "h1 long, h2 long, g1 long, g2 long, verdict string")


def _marked(universe: DataFrame, rules: DataFrame, names: list[str], verdicts: bool) -> DataFrame:
    """The distinct keys of the universe and of rules, with what lists they are on."""
    flags = [F.lit(False).alias("block"), F.lit(False).alias("allow")]
    own = [(F.col("verdict") == v).alias(v) if verdicts else F.lit(True).alias(v) for v in ("block", "allow")]
    every = universe.select("h1", "h2", *flags).unionByName(rules.select(F.col(names[0]).alias("h1"), F.col(names[1]).alias("h2"), *own))
    return materialize(every.groupBy("h1", "h2").agg(F.max("block").alias("block"), F.max("allow").alias("allow")), "keys")


def _host_universe(urls: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hosts = b["host"].unique().tolist()
            for part in _portions(hosts, [""] * len(hosts)):
                yield _frame(np.unique(np.concatenate([host_suffixes(h)[0] for h in hosts[part]]), axis=0))

    return urls.select("host").mapInPandas(run, "h1 long, h2 long").distinct()


#: Characters of URLs whose keys a task makes at once.
PORTION = 1 << 20


def _portions(hosts: list[str], paths: list[str]) -> Iterator[slice]:
    start = held = 0
    for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
        held += len(h) + len(p)
        if held >= PORTION:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(hosts):
        yield slice(start, len(hosts))


def _keys_of(hosts: list[str], paths: list[str], named: Cascade) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The keys of URLs whose hosts a rule names: their URL's number, hashes, lengths, and lengths of their hosts."""
    suffixes, long = zip(*map(host_suffixes, hosts), strict=True) if hosts else ((), ())
    ends = np.cumsum([0, *map(len, long)])
    hit = named.listed(np.concatenate([np.zeros((0, 2), np.uint64), *suffixes]))
    some = np.add.reduceat(np.append(hit, False), ends[:-1]) > 0 if hosts else np.zeros(0, bool)
    owner, keys, n, of_host = [np.zeros(0, np.int64)], [np.zeros((0, 2), np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in np.flatnonzero(some):
        if paths[i]:
            mine = hit[ends[i] : ends[i + 1]]
            prefixes, deep = path_prefixes(paths[i])
            keys.append(joined(suffixes[i][mine][:, None, :], prefixes[None, :, :]).reshape(-1, 2))
            n.append((long[i][mine][:, None] + deep[None, :]).ravel())
            of_host.append(np.repeat(long[i][mine], len(deep)))
            owner.append(np.full(len(keys[-1]), i))
    return tuple(map(np.concatenate, (owner, keys, n, of_host)))


def _judge(told: Broadcast) -> Callable[..., Column]:
    """The better of what is known of a URL and the longest key that the cascades list."""

    @F.pandas_udf("n int, h int, verdict string")
    def judge(host: pd.Series, path: pd.Series, best: pd.DataFrame) -> pd.DataFrame:
        found, hosts, paths = told.value, host.tolist(), path.tolist()
        n, h, verdict = np.zeros(len(hosts), np.int32), np.zeros(len(hosts), np.int32), np.full(len(hosts), None, dtype=object)
        for part in _portions(hosts, paths):
            owner, keys, long, of_host = _keys_of(hosts[part], paths[part], found["hosts"])
            allow, block = found["allow"].listed(keys), found["block"].listed(keys)
            at = np.flatnonzero(allow | block)
            at = at[np.lexsort((of_host[at], long[at], owner[at]))]  # a URL's best key is its last
            last = at[np.append(owner[at][1:] != owner[at][:-1], True)] if len(at) else at
            row = owner[last] + part.start
            n[row], h[row], verdict[row] = long[last], of_host[last], np.where(allow[last], "allow", "block")
        new = pd.DataFrame({"n": n, "h": h, "verdict": verdict})
        old = best.reset_index(drop=True)
        # of equal keys that allows (a key on both lists is in one part or, told twice, in two)
        better = (new["n"] > old["n"]) | ((new["n"] == old["n"]) & ((new["h"] > old["h"]) | ((new["h"] == old["h"]) & (new["verdict"] == "allow"))))
        return new.where(better, old).astype({"n": "int32", "h": "int32"})

    return judge


def _cascades(rows: DataFrame, universe: DataFrame, own: DataFrame, max_bytes: int) -> dict[str, Cascade]:
    """The cascades of hosts, allowed and blocked keys of some rules (own), over the URLs (rows) and their host suffixes."""
    suffixes = _marked(universe, own, ["g1", "g2"], False)
    try:
        hosts = build_cascade(suffixes, "block", max_bytes)
    finally:
        discard(suffixes)
    named = rows.sparkSession.sparkContext.broadcast(hosts)

    def every_key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            urls = b[["host", "path"]].drop_duplicates()
            hosts, paths = urls["host"].tolist(), urls["path"].tolist()
            for part in _portions(hosts, paths):
                yield _frame(np.unique(_keys_of(hosts[part], paths[part], named.value)[1], axis=0))

    keys = _marked(rows.select("host", "path").mapInPandas(every_key, "h1 long, h2 long"), own, ["h1", "h2"], True)
    try:
        return {"hosts": hosts, "allow": build_cascade(keys, "allow", max_bytes), "block": build_cascade(keys, "block", max_bytes)}
    finally:
        discard(keys)


def url_filter(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, max_bytes: int = MAX_BYTES) -> DataFrame:
    """page_id, host, path, rule, verdict for each row of pages.  rules: key (host and path that ends in /), verdict."""
    spark, url = pages.sparkSession, F.col("url").cast("string")
    best = F.struct(F.lit(0).alias("n"), F.lit(0).alias("h"), F.lit(None).cast("string").alias("verdict"))
    rows = materialize(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), best.alias("best")), "urls")
    told_rules = materialize(hashed_rules(rules), "rules")
    universe = materialize(_host_universe(rows), "suffixes")
    todo = [(1, 0)]  # parts of the rules by their hash: of how many, which
    while todo:
        parts, part = todo.pop()
        own = told_rules.where(F.pmod(F.xxhash64("g1", "g2", "h1", "h2"), F.lit(parts)) == part)
        try:
            cascades = _cascades(rows, universe, own, max_bytes)
        except TooLong:
            todo += [(2 * parts, part + parts), (2 * parts, part)]
            continue
        told = spark.sparkContext.broadcast(cascades)
        judged = rows.withColumn("best", _judge(told)("host", "path", "best"))
        rows = materialize(judged, "urls") if todo else judged
    h, n = F.col("best.h"), F.col("best.n")
    rule = F.concat(F.right("host", h), F.left("path", n - h))
    return rows.select(
        "page_id", "host", "path",
        F.when(F.col("best.verdict").isNotNull(), rule).alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def rule_table(spark: SparkSession, rules: tuple = RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "key string, verdict string")
