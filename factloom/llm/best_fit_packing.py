"""Operator 9, best-fit packing by a grouping genetic algorithm with islands and elite migration.

Documents become token ids and an end id; longer ones are cut so that only their first piece is shorter than a
sequence.  Full pieces are sequences of their own.  The others are dealt at random into blocks of about BLOCK pieces,
and every block is packed by ISLANDS islands.  An island's chromosomes are packings, their genes whole bins.  A
crossover injects well-filled bins of one parent into the other, drops the bins that hold a duplicate and puts their
displaced pieces back by best fit, largest first; a mutation breaks up the emptiest bins.  After each epoch the elite
of an island also migrates to the next one.  Fewer bins are better, then bins of greater summed squares, so that the
room left over gathers in few bins.  A search ends early only at a packing that no other beats: the fewest bins that
can be, all but one full.

Blocks are then packed together: the open bins of all blocks (less than OPEN full) are dealt, bin by bin, into new
blocks and packed again by the same search, which begins with the bins as they are and so never needs more.  This goes
on while it leaves less than half of the pieces to pack, until one block is left, so what is left over does not grow
with the number of blocks.

Nothing but the numbers of a block's pieces meets in one task.  Texts are read once; only piece numbers are shuffled.

Token ids are those of the tokenizers file.  Texts with runs of white space, or with the strings of special tokens, are
encoded by that library; others by a faster library from the same merges, which gives the same ids (tested).

Cases: null text is empty and is the end id alone; a null doc_id is kept; repeated rows are packed one by one; a text
of any length is read whole; an empty table gives none; other columns of any name are ignored.
"""

from __future__ import annotations

import json
import random
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, materialize, text_of

SEQUENCE = 2048
END = 0
BLOCK = 4096
ISLANDS = 2
EPOCHS = 2
POPULATION = 4
#: A search goes on until so many offspring in succession are no better than the best packing, and makes so many at least.
OFFSPRING = 12
#: A bin less full than this share of a sequence is packed again with those of other blocks.
OPEN = 0.97
_ODD = re.compile(r"\s\s")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, by the tokenizers file."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        # the file writes bytes as printable characters: those that are printable as themselves, the others from 256 on
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(x for x in range(256) if x not in plain)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.ordinary = tiktoken.Encoding("ids", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __call__(self, text: str) -> bytes:
        if _ODD.search(text) or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return np.array(self.ordinary(text), dtype="<u4").tobytes()


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def cuts(n: int, sequence: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first can be shorter than a sequence."""
    short = n % sequence
    return ([(0, short)] if short else []) + [(a, sequence) for a in range(short, n, sequence)]


def pieces(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids, little-endian) for every piece of every row of docs."""
    path = path or tokenizer_path()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for b in batches:
            rows: list[list] = [[] for _ in names]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encode(text.as_py()) + struct.pack("<I", END)
                for nth, (start, length) in enumerate(cuts(len(ids) // 4, sequence)):
                    own = ids[4 * start : 4 * (start + length)]
                    for column, value in zip(rows, (doc, nth, start, length, zlib.crc32(own), own), strict=False):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(r, k) for r, k in zip(rows, kinds, strict=False)], names=names)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, schema)


Packing = tuple[list[list[int]], list[int]]  # bins of item numbers, and their loads


def best_fit(items: list[int], sizes: list[int], bins: list[list[int]], loads: list[int], room: int) -> Packing:
    """Put items, in their order, each into the fullest bin that can take it.  bins and loads are changed."""
    by_room: list[list[int]] = [[] for _ in range(room + 1)]
    free = 0  # bit r: some bin has room for exactly r
    for b, load in enumerate(loads):
        by_room[room - load].append(b)
        free |= 1 << (room - load)
    for i in items:
        size = sizes[i]
        fits = free >> size
        if fits:
            r = size + (fits & -fits).bit_length() - 1
            b = by_room[r].pop()
            if not by_room[r]:
                free ^= 1 << r
            bins[b].append(i)
            loads[b] += size
        else:
            b = len(bins)
            bins.append([i])
            loads.append(size)
        left = room - loads[b]
        by_room[left].append(b)
        free |= 1 << left
    return bins, loads


def quality(p: Packing) -> tuple[int, int]:
    """Fewer bins, then fuller ones, are greater."""
    return -len(p[0]), sum(x * x for x in p[1])


def _without(p: Packing, gone: set[int], sizes: list[int], r: random.Random, more: int = 0) -> tuple[Packing, list[int]]:
    """p without the bins that hold an item of gone or are among the `more` emptiest, and the items displaced by that."""
    broken = set(sorted(range(len(p[0])), key=lambda b: (p[1][b], r.random()))[:more]) if more else set()
    bins, loads, displaced = [], [], []
    for b, (own, load) in enumerate(zip(*p, strict=True)):
        if b in broken or not gone.isdisjoint(own):
            displaced += [i for i in own if i not in gone]
        else:
            bins.append([*own]), loads.append(load)
    displaced.sort(key=lambda i: -sizes[i])
    return (bins, loads), displaced


def crossover(a: Packing, b: Packing, sizes: list[int], room: int, r: random.Random) -> Packing:
    """a with some of b's well-filled bins; duplicates' bins go and their other items are best-fitted."""
    full = sorted(range(len(b[0])), key=lambda i: -b[1][i])[: max(1, len(b[0]) * 2 // 3)]
    chosen = r.sample(full, max(1, len(full) // r.randint(2, 6)))
    (bins, loads), displaced = _without(a, {i for c in chosen for i in b[0][c]}, sizes, r)
    for c in chosen:
        bins.append([*b[0][c]]), loads.append(b[1][c])
    return best_fit(displaced, sizes, bins, loads, room)


def mutate(p: Packing, sizes: list[int], room: int, r: random.Random) -> Packing:
    """p with its emptiest bins and some others broken up and best-fitted."""
    some = set(r.choice(p[0])) if p[0] else set()
    (bins, loads), displaced = _without(p, some, sizes, r, more=max(1, len(p[0]) // 20))
    return best_fit(sorted(displaced + list(some), key=lambda i: -sizes[i]), sizes, bins, loads, room)


def is_best(p: Packing, least: int, room: int) -> bool:
    """Whether no packing beats p: as few bins as can be, and all but one of them full."""
    return len(p[0]) == least and sum(load < room for load in p[1]) <= 1


@dataclass
class Search:
    """What an island did: offspring made, and how many of them took a place among its packings."""

    crossovers: int = 0
    mutations: int = 0
    taken: int = 0


def evolve(sizes: list[int], room: int, seed: int, elites: list[Packing], population: int = POPULATION, offspring: int = OFFSPRING, did: Search | None = None) -> Packing:
    """The best packing that an island finds from the elites it was sent and best fit."""
    r, did = random.Random(seed), did or Search()
    least = -(-sum(sizes) // room)
    people = [*elites]
    if not elites or len(elites) < population:
        people.append(best_fit(sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), sizes, [], [], room))
    while len(people) < population and not any(is_best(p, least, room) for p in people):
        loose = sorted(range(len(sizes)), key=lambda i: -sizes[i] * r.uniform(0.8, 1.0))
        people.append(best_fit(loose, sizes, [], [], room))
    people.sort(key=quality, reverse=True)
    idle = 0
    while idle < offspring and len(people) > 1 and not is_best(people[0], least, room):
        idle, top = idle + 1, len(people[0][0])
        a, b = sorted(r.sample(range(len(people)), 2))
        if r.random() < 0.7:
            did.crossovers += 1
            child = crossover(people[a], people[b], sizes, room, r)
        else:
            did.mutations += 1
            child = mutate(people[a], sizes, room, r)
        if quality(child) > quality(people[-1]):
            did.taken += 1
            people[-1] = child
            people.sort(key=quality, reverse=True)
            if len(people[0][0]) < top:
                idle = 0
    return people[0]


def pack_sizes(items: DataFrame, room: int, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """uid, length, block, bin, offset, load (of the bin), offspring (made by the busiest island of the block) of items (block, uid, length, was).

    was: the bin that an item is in so far, null where it is in none.  Each block is packed by islands that exchange
    their elites.
    """
    schema = "block long, island int, uid long, length long, was long, bin long, offset long, load long, n_bins long, squares long, offspring long"

    def held_in(column: pd.Series, sizes: list[int]) -> Packing:
        number = pd.factorize(column)[0].tolist()
        bins: list[list[int]] = [[] for _ in range(max(number, default=-1) + 1)]
        for i, b in enumerate(number):
            bins[b].append(i)
        return bins, [sum(sizes[i] for i in b) for b in bins]

    def epoch(nth: int):
        def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            block, island, did = int(key[0]), int(key[1]), Search()
            g = g.sort_values(["source", "uid"], kind="stable")
            own = g[g["source"] == g["source"].iloc[0]]
            uid, sizes = own["uid"].to_numpy(), own["length"].tolist()
            if nth:
                elites = [held_in(sent["bin"], sizes) for _, sent in g.groupby("source", sort=True)]
            else:
                elites = [held_in(own["was"], sizes)] if own["was"].notna().all() else []
            bins, loads = evolve(sizes, room, block * 1_000_003 + island * 1009 + nth, elites, did=did)
            place, offset, load = (np.zeros(len(sizes), np.int64) for _ in range(3))
            for b, held in enumerate(bins):
                at = 0
                for i in sorted(held):
                    place[i], offset[i], load[i] = b, at, loads[b]
                    at += sizes[i]
            made = did.crossovers + did.mutations
            told = {"block": block, "island": island, "uid": uid, "length": sizes, "was": own["was"].to_numpy(), "bin": place, "offset": offset, "load": load}
            return pd.DataFrame(told | {"n_bins": len(bins), "squares": sum(x * x for x in loads), "offspring": made + (int(own["offspring"].iloc[0]) if nth else 0)})

        return run

    start = items.select("block", "uid", "length", "was", F.lit(0).cast("long").alias("bin"), F.lit(0).cast("long").alias("offspring"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    now = materialize(start.withColumn("source", F.col("island")).groupBy("block", "island").applyInPandas(epoch(0), schema), "epoch")
    for nth in range(1, epochs):
        sent = now.select("block", "uid", "length", "was", "bin", "offspring", F.col("island").alias("source"), F.explode(F.array("island", (F.col("island") + 1) % islands)).alias("island"))
        before, now = now, materialize(sent.distinct().groupBy("block", "island").applyInPandas(epoch(nth), schema), "epoch")
        discard(before)
    best = now.groupBy("block").agg(F.min(F.struct("n_bins", (-F.col("squares")).alias("rest"), "island")).alias("best"), F.max("offspring").alias("made"))
    told = now.drop("offspring").join(best.select("block", F.col("best.island").alias("island"), "made"), ["block", "island"])
    return told.select("uid", "length", "block", "bin", "offset", "load", F.col("made").alias("offspring"))


def pack_all(items: DataFrame, room: int, block: int = BLOCK, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """uid, level, block, bin, offset of items (uid, length): blocks packed, then their open bins together, level by level."""
    n, level, done = items.count(), 0, None
    dealt, was = F.xxhash64("uid"), F.lit(None).cast("long")
    while True:
        blocks = max(1, round(n / block))
        placed = materialize(pack_sizes(items.select(F.pmod(dealt, F.lit(blocks)).cast("long").alias("block"), "uid", "length", was.alias("was")), room, islands, epochs), "packed")
        opened = placed.where(F.col("load") < OPEN * room)
        more = 0 if blocks == 1 else opened.count()
        again = 0 < more < n / 2
        kept = (placed.where(F.col("load") >= OPEN * room) if again else placed).select("uid", F.lit(level).alias("level"), "block", "bin", "offset")
        done = kept if done is None else done.unionByName(kept)
        if not again:
            return done
        # bins are dealt whole, and come as the packing to begin with
        bin_number = F.col("block") * (1 << 31) + F.col("bin")
        items, n, level, dealt, was = opened.select("uid", "length", bin_number.alias("from")), more, level + 1, F.xxhash64("from"), F.col("from")


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE, block: int = BLOCK) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    every = materialize(pieces(docs, path, sequence).withColumn("uid", F.monotonically_increasing_id()), "pieces")
    short = every.where(F.col("length") < sequence)
    placed = pack_all(short.select("uid", "length"), sequence, block)
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    own = every.where(F.col("length") == sequence).select(*names, (-1 - F.col("uid")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    number = F.col("level").cast("long") * (1 << 58) + F.col("block") * (1 << 20) + F.col("bin")
    return short.join(placed, "uid").select(*names, number.alias("sequence_id"), "offset").unionByName(own)
