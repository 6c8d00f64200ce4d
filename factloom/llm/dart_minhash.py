"""Operator 2, near-duplicate detection with DartMinHash signatures.

A document is the bag of its five-word shingles: a shingle weighs as often as it occurs (with weighting="set" once).
Similarity is the weighted Jaccard of bags, common weight over joint weight.  For every element, hashed darts fall on its weight axis, cut into the regions [0, 1), [1, 2), [2, 4), ..., as a Poisson process in rank: the gaps
between a region's darts are exponential with the region's length as rate, all taken from the element's hash, so any
two documents throw the same darts at an element they share.  A document keeps the darts below its element's weight,
each dart belongs to one of K coordinates, and the earliest dart of each coordinate is the signature.  Two signatures
agree in a coordinate with probability equal to the (weighted) Jaccard similarity.  Only darts up to the rank at which
about K (ln K + SLACK) are kept are made, so a signature costs one exponential for each element and a few more for the
darts it needs, not K hashes for each element.

BANDS bands of ROWS coordinates make buckets (at similarity 0.8 a pair shares none with probability 3e-6).  Documents
with equal bags are one node first.  In a bucket every member is compared with a leader, the member that meets
the most others over all its bands, so a family of copies of one text is linked through it without listing its pairs.
Members that are not similar to their leader can still be similar to another member; where a bucket's members are not
in one component afterwards, a prefix join over their shingles finds the pairs that can be, and leaves none out.
Every comparison is the exact (weighted) Jaccard similarity of whole texts.  Components of the links are the classes.

Cases: null text is empty; a text of 1 to 4 words is one shingle; a text without words is alone in its class; a null
doc_id sorts after others; rows that share a doc_id but not the text are separate rows; repeated rows share a class; of
every class exactly one row is kept, that with the smallest doc_id, also where ids repeat; an empty table gives none;
other columns of any name are ignored, and keep_one() returns them as they are.  Texts of any length are read whole.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import discard, materialize, only_kept, text_of, whole_text

SHINGLE = 5
LEAST = 0.8
BANDS = 32
ROWS = 5
K = BANDS * ROWS
SLACK = 3.0
#: Whole numbers that doubles miss by rounding count as reached.
TINY = 1e-9
#: Rows whose shingles a task makes at once, so that what a worker holds does not follow the size of Arrow's batches.
ROWS_AT_ONCE = 256
#: By shingle counts; "set" counts each shingle once.
WEIGHTING = "tf"

_GOLD, _M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits look independent (the splitmix64 finaliser)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def dart_signature(elements: np.ndarray, weights: np.ndarray | None = None, k: int = K) -> np.ndarray:
    """k coordinates (64-bit numbers) of a weighted set: distinct 64-bit element hashes, and weights (1 each if None)."""
    if weights is not None and len(weights) and weights.max() <= 1:
        weights = None  # one region each, and all of it
    with np.errstate(over="ignore"):
        if weights is None:
            seed, start, length, weight, total = mix(elements), None, np.ones(len(elements)), None, float(len(elements))
        else:
            regions = np.where(weights <= 1, 1, np.ceil(np.log2(np.maximum(weights, 1))).astype(int) + 1)
            owner = np.repeat(np.arange(len(elements)), regions)
            region = np.arange(len(owner)) - np.repeat(np.cumsum(regions) - regions, regions)
            seed = mix(elements[owner] + mix(region.astype(np.uint64) * _GOLD))
            start = np.where(region == 0, 0.0, 2.0 ** (region - 1.0))
            length = np.where(region == 0, 1.0, start)
            weight, total = weights[owner].astype(float), float(weights.sum())
        reach = k * (math.log(k) + SLACK) / total
        while True:
            ids, ranks = [], []
            live, at, number = seed, np.zeros(len(seed)), 0
            if reach > 4:  # few elements, many darts each: all gaps at once
                m = int(reach * length.max() + 8 * math.sqrt(reach * length.max()) + 16)
                dart = mix(seed[:, None] + np.arange(1, m + 1, dtype=np.uint64)[None, :] * _GOLD)
                when = np.cumsum(-np.log(_unit(dart)), axis=1) / length[:, None]
                row, col = np.nonzero(when < reach)
                ids, ranks, of = [dart[row, col]], [when[row, col]], [row]
            else:
                of, who, rate = [], np.arange(len(seed)), length
                while len(live):
                    number += 1
                    dart = mix(live + np.uint64(number) * _GOLD)
                    at = at - np.log(_unit(dart)) / rate
                    near = at < reach
                    live, at, who, rate, dart = live[near], at[near], who[near], rate[near], dart[near]
                    ids.append(dart), ranks.append(at), of.append(who)
            dart, rank, who = np.concatenate(ids), np.concatenate(ranks), np.concatenate(of)
            if weight is not None:
                hit = start[who] + _unit(mix(dart ^ _M1)) * length[who] < weight[who]
                dart, rank = dart[hit], rank[hit]
            late = np.argsort(-rank, kind="stable")
            coordinate = (mix(dart ^ _M2) % np.uint64(k)).astype(np.int64)[late]
            signature = np.zeros(k, dtype=np.uint64)
            signature[coordinate] = dart[late]  # the earliest is written last
            if len(np.unique(coordinate)) == k:
                return signature
            reach *= 2


def _shingles(flat: np.ndarray, width: int = SHINGLE) -> np.ndarray:
    """Hash of each run of width word hashes."""
    with np.errstate(over="ignore"):
        h = flat[: len(flat) - width + 1] + _GOLD
        for i in range(1, width):
            h = mix(h) + flat[i : len(flat) - width + 1 + i]
        return mix(h)


def shingle_sets(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of a list<int64> array of word hashes: the sorted distinct shingles and how often each occurs."""
    flat = words.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.concatenate([[0], np.cumsum(words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
    every = _shingles(flat) if len(flat) >= SHINGLE else np.zeros(0, np.uint64)
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        own = every[a : b - SHINGLE + 1] if b - a >= SHINGLE else _shingles(flat[a:b], int(b - a)) if b > a else every[:0]
        yield np.unique(own, return_counts=True)


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _portions(batches: Iterator[pa.RecordBatch], rows: int = ROWS_AT_ONCE) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _digest(own: np.ndarray, counts: np.ndarray | None) -> bytes:
    h = hashlib.blake2b(own.tobytes(), digest_size=16)
    if counts is not None:
        h.update(counts.tobytes())
    return h.digest()


def signatures(docs: DataFrame, weighting: str = WEIGHTING, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, text_check, n_shingles, digest of the shingles (null if none) and the band keys."""
    text = text_of()
    schema = "doc_id long, text_hash long, text_check long, n_shingles int, digest binary, bands array<long>"

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for b in _portions(batches):
            n, digests, keys = [], [], []
            for own, counts in shingle_sets(b.column("words")):
                bag = counts if weighting == "tf" else None
                n.append(len(own))
                digests.append(_digest(own, bag) if len(own) else None)
                if len(own):
                    part = dart_signature(own, bag, bands * rows).reshape(bands, rows)
                    with np.errstate(over="ignore"):
                        h = salt.copy()
                        for i in range(rows):
                            h = mix(h + part[:, i])
                    keys.append(h.view(np.int64))
                else:
                    keys.append(np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("text_hash"), b.column("text_check"), pa.array(n, pa.int32()), pa.array(digests, pa.binary()), lists],
                names=["doc_id", "text_hash", "text_check", "n_shingles", "digest", "bands"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), *whole_text(), word_hashes(text).alias("words")).mapInArrow(sign, schema)


def _sets_of(docs: DataFrame, wanted: DataFrame, weighting: str) -> DataFrame:
    """digest, own (sorted shingles; in bags the k-th copy of a shingle is an element of its own) of the wanted nodes (digest, rep)."""
    ids = wanted.select(F.col("rep").alias("_rep")).distinct()
    some = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    some = some.join(ids, F.col("doc_id").eqNullSafe(F.col("_rep")), "left_semi").select(word_hashes(F.col("text")).alias("words"))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _portions(batches):
            digests, sets = [], []
            for own, counts in shingle_sets(b.column("words")):
                if len(own):
                    bag = counts if weighting == "tf" else None
                    digests.append(_digest(own, bag))
                    if bag is not None:
                        nth = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                        with np.errstate(over="ignore"):
                            own = mix(np.repeat(own, counts) + nth.astype(np.uint64) * _GOLD)
                    sets.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "own"])

    found = some.mapInArrow(expand, "digest binary, own array<long>").dropDuplicates(["digest"])
    return found.join(wanted.select("digest"), "digest", "left_semi")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of pairs (a, b) of nodes, those whose sets are similar."""
    met = pairs.join(sets.toDF("a", "a_own"), "a").join(sets.toDF("b", "b_own"), "b")
    common = F.size(F.array_intersect("a_own", "b_own"))
    return met.where(common >= least * (F.size("a_own") + F.size("b_own") - common) - TINY).select("a", "b")


def _by_prefix(nodes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b) of nodes (node, comp) of different components that can be similar: no similar pair is left out.

    Shingles are ordered by how many of the nodes have them, the rarest first.  Two sets of similarity s share at
    least 2 s / (1 + s) of the smaller and s of the larger, so the first shingle that they share stands among the
    first (1 - 2 s / (1 + s)) n + 1 of the smaller and the first (1 - s) n + 1 of the larger, and at most the rest of
    either from there on is shared.  A text that differs from a whole family in shingles of its own meets none of it.
    """
    own = nodes.join(sets.withColumnRenamed("digest", "node"), "node").select("node", "comp", F.size("own").alias("n"), F.explode("own").alias("shingle"))
    often = own.groupBy("shingle").agg(F.count("*").alias("df")).where("df > 1")
    order = F.sort_array(F.collect_list(F.struct("df", "shingle")))
    ranked = own.join(often, "shingle").groupBy("node", "comp", "n").agg(order.alias("shared"))
    first = F.col("n") - F.size("shared")  # shingles that no other node has come before
    at = ranked.select("node", "comp", "n", F.posexplode("shared").alias("i", "s"), first.alias("alone"))
    at = materialize(at.select("node", "comp", "n", (F.col("alone") + F.col("i")).alias("at"), F.col("s.shingle").alias("shingle")).where(F.col("at") <= (1 - least) * F.col("n") + TINY), "prefixes")
    share = least / (1 + least)
    small = at.where(F.col("at") <= (1 - 2 * share) * F.col("n") + TINY).toDF("a", "a_comp", "a_n", "a_at", "shingle")
    large = at.toDF("b", "b_comp", "b_n", "b_at", "shingle")
    ordered = (F.col("a_n") < F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b")))
    rest = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at"))
    can = ordered & (F.col("a_comp") != F.col("b_comp")) & (F.col("a_n") >= least * F.col("b_n") - TINY) & (rest >= share * (F.col("a_n") + F.col("b_n")) - TINY)
    met = small.join(large.withColumnRenamed("shingle", "b_shingle"), (F.col("shingle") == F.col("b_shingle")) & can)
    return met.select("a", "b").distinct()


def links_and_nodes(docs: DataFrame, least: float = LEAST, weighting: str = WEIGHTING) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """rows (signatures), nodes (distinct shingle bags: digest, first, rep, size, bands) and the components of their links (node, comp)."""
    rows = materialize(signatures(docs, weighting).withColumn("uid", F.monotonically_increasing_id()), "signatures")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash", "uid"))
    nodes = rows.where("digest is not null").groupBy("digest").agg(first.alias("first"), F.count("*").alias("size"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.withColumn("rep", F.col("first.doc_id")), "nodes")
    every = nodes.select(F.col("digest").alias("node"), F.explode("bands").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    members = every.join(shared, "bucket")
    fame = members.groupBy("node").agg(F.sum("n").alias("fame"))
    members = materialize(members.join(fame, "node"), "members")
    known = members.select(F.col("node").alias("digest")).distinct().join(nodes.select("digest", "rep"), "digest")
    known = materialize(known, "known")
    sets = materialize(_sets_of(docs, known, weighting), "sets")
    discard(known)

    # first every member with its bucket's leader
    leaders = members.groupBy("bucket").agg(F.max_by("node", F.struct("fame", "node")).alias("leader"))
    led = members.select("bucket", "node", "n").join(leaders, "bucket").where("node != leader")
    links = materialize(_similar(led.select(F.col("node").alias("a"), F.col("leader").alias("b")).distinct(), sets, least), "links")
    comp = components(links)
    # then, of buckets of three and more whose members are not yet in one component, the members of different components
    label = F.coalesce("comp", "node")
    split = members.where("n > 2").select("bucket", "node").join(comp, "node", "left").select("bucket", "node", label.alias("comp"))
    spread = split.groupBy("bucket").agg((F.min("comp") != F.max("comp")).alias("open")).where("open")
    still = materialize(split.join(spread, "bucket", "left_semi").select("node", "comp").distinct(), "open")
    discard(members)
    more = materialize(_similar(_by_prefix(still, sets, least), sets, least), "links")
    discard(sets)
    if more.limit(1).count():
        links = links.union(more)
        comp = components(links)
    return rows, nodes, comp, links


def _judged(docs: DataFrame, least: float, weighting: str, counted: bool = False) -> DataFrame:
    rows, nodes, comp, links = links_and_nodes(docs, least, weighting)
    classed = nodes.select("digest", "first", "size").join(comp.withColumnRenamed("node", "digest"), "digest", "left")
    linked = classed.where("comp is not null")
    whole = linked.groupBy("comp").agg(F.sum("size").alias("class_size"), F.min("first").alias("first"))
    special = linked.select("digest", "comp").join(whole, "comp").select("digest", "class_size", "first")
    special = special.union(classed.where("comp is null and size > 1").select("digest", F.col("size").alias("class_size"), "first"))
    if counted:
        both = links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).distinct()  # dealt by both ends, so a leader's many links are spread
        degree = both.select(F.explode(F.array("lo", "hi")).alias("digest")).groupBy("digest").agg(F.count("*").alias("n_links"))
        special = materialize(special.join(degree, "digest", "left"), "classes")  # so that a text of many copies can be split where rows meet it
    own = F.col("class_size").isNull()
    return rows.drop("bands").join(special, "digest", "left").select(
        "doc_id", "text_hash", "text_check", "n_shingles",
        F.when(own, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
        F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        (own | (F.col("uid") == F.col("first.uid"))).alias("kept"),
        *([F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")] if counted else []),
    )


def near_dedup(docs: DataFrame, least: float = LEAST, weighting: str = WEIGHTING) -> DataFrame:
    """One row for each row of docs: doc_id, text_hash, n_shingles, class_id (smallest doc_id of the class), class_size, kept, n_links.

    n_links counts the other texts that the row's text was compared with and is similar to: the links that its class
    stands on, not all similar pairs.  Copies of one text share their links.
    """
    return _judged(docs, least, weighting, counted=True).drop("text_check")


def keep_one(docs: DataFrame, least: float = LEAST, weighting: str = WEIGHTING) -> DataFrame:
    """The rows of docs without those whose class has another that stays, with all their columns."""
    return only_kept(docs, _judged(docs, least, weighting))
