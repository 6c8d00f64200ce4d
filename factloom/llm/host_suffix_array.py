"""Operator 12, extraction of main texts from pages by a suffix array over each host's token streams.

A page's stream is its tags and words; the text of a part that its name tells to be a menu, header, footer, sidebar,
notice, advert, form or comment is one sign ``#`` for each piece, since sites fill the same part with other words on every
page (page_parts.py).  Of the main element the stream has tags and what links say, as signs of their own; its other
text stands there as signs that are like no other, since the article's text stays whatever pages share.

The streams of a host are put together and their suffixes sorted, by doubling the length that ranks compare.  From the
common prefixes of neighbours follows for each token the longest stretch that begins there and stands on another page
too, by the nearest suffix of another page to either side.  What stretches of LONG tokens or more cover is boilerplate.
In the main element, a list of LINKS links or more without other words goes as a menu that no name tells if most of it
(COVERED) is boilerplate; a list that only this article holds (references, say) stays, and so does one that is all that the
main element has.  An exact check by names follows: it keeps the other text of the main element, where a page has one,
whatever pages share (copied articles stay), and drops parts that repetition cannot see, as on a host with one page.  Where
a page has no main element, blocks outside of parts stay unless most of their words (COVERED) are boilerplate.

Pages are dealt by host and block: a host with more than BLOCK_BYTES of text has several blocks, dealt by hash, so no
task takes a whole hot host.  What stands on two pages of a block is found by the block's array.  Blocks of one host
then exchange the grams of LONG tokens that only one of their pages has, by an aggregation that combines in the map
step, so a stretch that stands once in each of two blocks is found as well and the result does not depend on the deal.
Several small hosts share one array, in which their tokens differ.

Pages with the same stream are one page, and so are pages whose main elements begin with the same text: a copy is no
evidence of boilerplate, nor is an article that was edited further down.

Cases: null html is empty and gives an empty text; a null url has the empty host; broken markup is read to its end
(unclosed tags, comments, quotes and scripts); very long pages are read whole; repeated rows are judged row by row;
other columns of any name are ignored; an empty table gives no rows.  All steps are joins, aggregations and one shuffle
of the pages, so lost executors cost recomputed tasks only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .page_parts import Page, page_parts
from .url_filter import host_of

LONG = 12
COVERED = 0.8
#: Least number of links of a list in the main element that can be a menu.
LINKS = 3
BLOCK_BYTES = 2 << 20
#: Characters of pages whose array a task builds at once, unless one block is larger.
PORTION = 2 << 20
#: Hot hosts up to this number are broadcast; more are joined by a shuffle.
MOST_BROADCAST = 100_000
_PRIME = np.uint64(0x100000001B3)


def suffix_array(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of x, and for each but the first how many tokens it shares with the one before it."""
    n = len(x)
    rank = np.unique(x, return_inverse=True)[1].astype(np.int64)
    ranks, k = [rank], 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order[1:]] != key[order[:-1]])])
        if new[-1] == n - 1 or k >= n:
            break
        rank = np.empty(n, dtype=np.int64)
        rank[order] = new
        ranks.append(rank)
        k *= 2
    a, b = order[:-1], order[1:]
    shared = np.zeros(n - 1, dtype=np.int64)
    for level in range(len(ranks) - 1, -1, -1):
        i, j = a + shared, b + shared
        fits = np.maximum(i, j) + (1 << level) <= n
        same = fits.copy()
        same[fits] = ranks[level][i[fits]] == ranks[level][j[fits]]
        shared += same.astype(np.int64) << level
    return order, shared


def _least_since_other(shared: np.ndarray, page: np.ndarray) -> np.ndarray:
    """For each suffix in order (of page), what it shares with the nearest one before it that is of another page."""
    n = len(page)
    least = np.concatenate([[0], shared])
    begins = np.concatenate([[True], page[1:] != page[:-1]])
    start = np.maximum.accumulate(np.where(begins, np.arange(n), 0))
    longest, step = int((np.arange(n) - start).max(initial=0)), 1
    while step <= longest:
        at = np.flatnonzero(np.arange(n) - step >= start)
        least[at] = np.minimum(least[at], least[at - step])
        step *= 2
    return least


def repeated(x: np.ndarray, page: np.ndarray, long: int = LONG) -> np.ndarray:
    """Which tokens of x stand in a stretch of ``long`` tokens or more that two pages hold (x ends each page with a token of its own)."""
    covered = np.zeros(len(x), dtype=bool)
    if len(x) < 2:
        return covered
    order, shared = suffix_array(x)
    own = page[order]
    size = np.maximum(_least_since_other(shared, own), _least_since_other(shared[::-1], own[::-1])[::-1])
    change, hit = np.zeros(len(x) + 1, dtype=np.int64), size >= long
    np.add.at(change, order[hit], 1)
    np.add.at(change, order[hit] + size[hit], -1)
    return np.cumsum(change[:-1]) > 0


def gram_hashes(stream: list[str | None], known: dict[str, int], long: int = LONG) -> np.ndarray:
    """64-bit hashes of the grams of a stream that hold no sign like no other, one for each place; 0 where there is none."""
    n = len(stream)
    out = np.zeros(n, dtype=np.uint64)
    if n < long:
        return out
    one = np.fromiter((known.get(t) or known.setdefault(t, int.from_bytes(hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")) for t in stream), dtype=np.uint64, count=n)
    with np.errstate(over="ignore"):
        h = np.zeros(n - long + 1, dtype=np.uint64)
        for i in range(long):
            h = (h ^ (one[i : n - long + 1 + i] + np.uint64(i))) * _PRIME
            h ^= h >> np.uint64(29)
    open_ = np.concatenate([[0], np.cumsum([t is None for t in stream])])
    out[: n - long + 1] = np.where(open_[long:] == open_[: n - long + 1], h | np.uint64(1), np.uint64(0))
    return out


def _signature(page: Page) -> int:
    """The same for copies of a page and for pages of one article."""
    told = "\0".join("\1" if t is None else t for t in page.stream) if page.lead is None else "\2" + page.lead
    return int.from_bytes(hashlib.blake2b(told.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def boilerplate(groups: list[tuple[list[Page], np.ndarray]], long: int = LONG) -> list[np.ndarray]:
    """For each page of groups (the pages of a host's block, and the grams that its other blocks hold too): which tokens are boilerplate."""
    numbers: dict[str, int] = {}
    tokens, page_of, ends, hosts = [], [], [0], []
    signs: dict[tuple[int, int], int] = {}
    for g, (pages, _) in enumerate(groups):
        for p in pages:
            tokens.extend(-1 if t is None else numbers.setdefault(t, len(numbers)) for t in p.stream)
            tokens.append(-1)
            ends.append(len(tokens))
            page_of.append(signs.setdefault((g, _signature(p)), len(signs)))
            hosts.append(g)
    x, sizes = np.array(tokens, dtype=np.int64), np.diff(ends)
    x = np.where(x >= 0, np.repeat(hosts, sizes) * max(len(numbers), 1) + x, len(groups) * max(len(numbers), 1) + np.arange(len(x)))
    covered = repeated(x, np.repeat(page_of, sizes), long)
    out, known, i = [], {}, 0
    for pages, foreign in groups:
        for p in pages:
            own = covered[ends[i] : ends[i + 1] - 1]
            if len(foreign):
                for at in np.flatnonzero(np.isin(gram_hashes(p.stream, known, long), foreign)):
                    own[at : at + long] = True
            out.append(own)
            i += 1
    return out


def _menus(page: Page, covered: np.ndarray, least: float) -> set[int]:
    """The places of the main element's blocks that are lists of links which pages of other articles hold too."""
    out: set[int] = set()
    if page.lead is None:
        return out
    for listed, run in groupby(enumerate(page.blocks), lambda at: at[1].links is not None):
        if listed:
            places, blocks = zip(*run, strict=True)
            if sum(b.links for b in blocks) >= LINKS and covered[blocks[0].first : blocks[-1].end].mean() >= least:
                out.update(places)
    return out


def main_text(page: Page, has_main: bool, covered: np.ndarray, least: float = COVERED) -> tuple[str, int, int]:
    """The kept blocks' text, how many signs or words went as boilerplate, and how many blocks or parts by their names alone."""
    kept, by_name = [], 0
    menus = _menus(page, covered, least) if has_main else ()
    for at, b in enumerate(page.blocks):
        if has_main:
            stays = b.main and at not in menus
            by_name += not b.main and not covered[b.first : b.end].any()
        else:
            stays = covered[b.first : b.end].mean() < least if b.end > b.first else True
        if stays:
            kept.append(b.text)
    signs = np.array([t == "#" for t in page.stream], dtype=bool)
    return "\n".join(kept), int(covered.sum()), by_name + int((signs & ~covered).sum())


def _grams(dealt: DataFrame) -> DataFrame:
    """host, block, gram: the grams that one page of the block holds and another block's page holds too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            if len(known) > 1 << 20:
                known.clear()
            host, block, gram, page = [], [], [], []
            for h, k, source in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                told = page_parts(source)[0]
                own = np.unique(gram_hashes(told.stream, known))
                own = own[own != 0].view(np.int64)
                host += [h] * len(own)
                block += [k] * len(own)
                gram.append(own)
                page.append(np.full(len(own), _signature(told), dtype=np.int64))
            flat = [np.concatenate([np.zeros(0, np.int64), *c]) for c in (gram, page)]
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(block, pa.int32()), *map(pa.array, flat)], names=["host", "block", "gram", "page"])

    held = dealt.select("host", "block", "html").mapInArrow(run, "host string, block int, gram long, page long")
    by_block = held.groupBy("host", "gram", "block").agg(F.min("page").alias("lo"), F.max("page").alias("hi"))
    whole = by_block.groupBy("host", "gram").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).where("least <> most")
    return by_block.where("lo = hi").join(whole, ["host", "gram"], "left_semi").select("host", "block", "gram")


def extract(pages: DataFrame, counts: bool = False, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages; with counts also n_repeated (tokens) and n_named (blocks and parts)."""
    spark = pages.sparkSession
    url, html = F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), url.alias("url"), F.coalesce(host_of(url), F.lit("")).alias("host"), html.alias("html"))
    sizes = rows.groupBy("host").agg(F.sum(F.length("html")).alias("size"))
    hot = sizes.where(F.col("size") > block_bytes).select(F.col("host").alias("hot"), F.ceil(F.col("size") / block_bytes).cast("int").alias("blocks"))
    some = hot.limit(MOST_BROADCAST + 1).collect()
    if not some:
        dealt = rows.withColumn("block", F.lit(0))
    else:
        few = len(some) <= MOST_BROADCAST
        many = F.broadcast(spark.createDataFrame(some, hot.schema)) if few else hot
        dealt = rows.join(many, F.col("host") == F.col("hot"), "left")
        dealt = dealt.withColumn("block", F.coalesce(F.pmod(F.xxhash64("page_id", "url", "html"), F.col("blocks")).cast("int"), F.lit(0)))
    none = F.lit(None).cast("long").alias("gram")
    every = dealt.select("host", "block", "page_id", "url", "html", none)
    if some:
        grams = _grams(dealt.where("blocks is not null"))
        empty = [F.lit(None).cast(t).alias(c) for c, t in (("page_id", "long"), ("url", "string"), ("html", "string"))]
        every = every.unionByName(grams.select("host", "block", *empty, "gram"))
    grouped = every.repartition("host", "block").sortWithinPartitions("host", "block", F.col("gram").asc_nulls_last())
    fields = "page_id long, url string, text string, n_chars long, n_repeated long, n_named long"

    def judged(groups: list[dict]) -> pa.RecordBatch:
        ids, urls, told = [], [], []
        read = [[page_parts(s) for s in g["html"]] for g in groups]
        covered = iter(boilerplate([([p for p, _ in own], np.array(g["gram"], dtype=np.int64).view(np.uint64)) for own, g in zip(read, groups, strict=True)]))
        for own, g in zip(read, groups, strict=True):
            ids += g["page_id"]
            urls += g["url"]
            told += [main_text(p, has_main, next(covered)) for p, has_main in own]
        text, n_repeated, n_named = zip(*told, strict=True) if told else ((), (), ())
        columns = [ids, urls, text, list(map(len, text)), n_repeated, n_named]
        kinds = [pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in fields.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups, held, key = [], 0, None
        for b in batches:
            for h, k, page_id, u, source, gram in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                if (h, k) != key:
                    if held >= PORTION:
                        yield judged(groups)
                        groups, held = [], 0
                    key = (h, k)
                    groups.append({"page_id": [], "url": [], "html": [], "gram": []})
                if gram is not None:
                    groups[-1]["gram"].append(gram)
                    held += 8
                else:
                    groups[-1]["page_id"].append(page_id)
                    groups[-1]["url"].append(u)
                    groups[-1]["html"].append(source)
                    held += len(source)
        if groups:
            yield judged(groups)

    out = grouped.mapInArrow(run, fields)
    return out if counts else out.select("page_id", "url", "text", "n_chars")
