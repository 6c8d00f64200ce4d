"""Operator 6, sharding: Hilbert-curve order over several metadata dimensions, cut into runs.

Dimensions (lang, source, text size, doc_id) are quantised to 2**BITS cells each at quantiles over all rows, so that
cells hold about equal numbers of rows; strings are compared whole, so sources with a long common start still differ.
Rows are sorted by the index of their cell on the Hilbert curve and the order is cut into runs; neighbours on the curve
are neighbours in every dimension, so the files of a shard span little of each and can be skipped by their column
statistics.

Rows with equal texts are a group and take one place: the cell of the row with the smallest doc_id.  The order is
(curve index, text hashes, doc_id), so a group's rows follow each other and only the end of a run can cut a group.

The law that holds is ``rows``: shard sizes differ by at most one row.  Rows are dealt by range over the whole order,
so a cell, a source or a group that holds a third of all rows is spread over tasks.  Ranks need no global window: the
sorted rows are written to the shared folder and a row's rank is the number of rows in earlier files plus its place in
its own file.  Quantiles of strings come in the same way from the sorted distinct values with their counts; at most
2**BITS values of each dimension go to the driver.

Cases: null text has size 8 and the checksum of nothing, and is in the group of empty texts; null lang, source or
doc_id take the lowest cell; repeated rows each have a place; an empty table gives none; other columns of any name are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import discard, input_partitions, materialize, text_of, whole_text

SHARDS = 24
BITS = 4
#: Bytes that count for every row besides its text.
ROW_BYTES = 8


def hilbert_index(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells (n x dimensions, values below 2**bits).

    The cell coordinates become transposed curve coordinates by undoing, from the highest bit down, the reflection or
    the exchange of axes that each quadrant applies; then a Gray decoding gives the digits.
    """
    x = cells.astype(np.int64).T.copy()
    n = len(x)
    for level in range(bits - 1, 0, -1):
        low = (1 << level) - 1
        for axis in range(n):
            upper = (x[axis] >> level & 1).astype(bool)
            swap = np.where(upper, 0, (x[0] ^ x[axis]) & low)
            x[0] = np.where(upper, x[0] ^ low, x[0] ^ swap)
            x[axis] ^= swap
    for axis in range(1, n):
        x[axis] ^= x[axis - 1]
    flip = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] >> level & 1, (1 << level) - 1, 0)
    x ^= flip
    index = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for axis in range(n):
            index = index << 1 | (x[axis] >> level & 1)
    return index


def _in_files(ordered: DataFrame) -> tuple[DataFrame, Column]:
    """The rows of a table written in order, with the column ``file``, and their place in their own file."""
    return ordered.select("*", F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row")), F.col("row")


def _written_order(file: str) -> tuple[int, int]:
    """The task and the part of the task's output that a file holds, as numbers: names do not sort beyond 99,999 tasks."""
    parts = file.split(".")[0].split("-")
    return int(parts[1]), int(parts[-1].lstrip("c") or 0)


def string_cuts(narrow: DataFrame, names: list[str], cells: int) -> dict[str, list[str]]:
    """For each named string column the values at which its rows pass 1/cells, 2/cells, ... of all: at most cells each."""
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("dim"), F.col(n).alias("value")) for n in names]))
    counted = narrow.select(pairs.alias("p")).groupBy("p.dim", "p.value").agg(F.count("*").alias("n"))
    order = ["dim", "value"]
    sorted_values = materialize(counted.repartitionByRange(input_partitions(narrow), *order).sortWithinPartitions(*order), "values")
    rows, place = _in_files(sorted_values)
    sums = rows.groupBy("file", "dim").agg(F.sum("n").alias("n")).collect()  # one number a file and dimension
    total, before = dict.fromkeys(names, 0), []
    for r in sorted(sums, key=lambda r: _written_order(r["file"])):
        before.append((r["file"], r["dim"], total[r["dim"]]))
        total[r["dim"]] += r["n"]
    starts = narrow.sparkSession.createDataFrame(before, "file string, dim string, before long")
    totals = F.create_map(*[F.lit(x) for n in names for x in (n, max(total[n], 1))])
    here = Window.partitionBy("file", "dim").orderBy(place)
    passed = rows.join(F.broadcast(starts), ["file", "dim"]).withColumn("upto", F.col("before") + F.sum("n").over(here))
    share = lambda upto: F.floor(upto * cells / totals[F.col("dim")])
    at = passed.where(share(F.col("upto")) > share(F.col("upto") - F.col("n"))).select("dim", "value").collect()
    discard(sorted_values)
    return {n: sorted(r["value"] for r in at if r["dim"] == n) for n in names}


def _cell(column: Column, cuts: list) -> Column:
    """How many of the cuts lie below the column's value."""
    cell = F.lit(0)
    for c in cuts:
        cell = cell + (column > F.lit(c)).cast("int")
    return cell


def shard(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the curve index, one row for each row of docs."""
    text = text_of("text")
    narrow = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        *whole_text("text"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
    )
    narrow = materialize(narrow, "narrow")
    cells = 1 << bits
    words = string_cuts(narrow, ["lang", "source"], cells)
    at = [i / cells for i in range(1, cells)]
    number = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double")
    numbers = narrow.agg(F.percentile_approx("size", at, 1000).alias("size"), F.percentile_approx(number, at, 1000).alias("doc_id")).first()
    # the greatest cut of strings has no rows above it
    own = [
        _cell(F.col("lang"), words["lang"][: cells - 1]), _cell(F.col("source"), words["source"][: cells - 1]),
        _cell(F.col("size"), sorted(set(numbers["size"] or []))), _cell(number, sorted(set(numbers["doc_id"] or []))),
    ]
    celled = narrow.select("doc_id", "size", "text_crc32", "text_hash", "text_check", F.array(*own).alias("cells"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            grid = np.stack(b["cells"].to_list()) if len(b) else np.zeros((0, 4), int)
            yield b.drop(columns="cells").assign(hilbert=hilbert_index(grid, bits))

    # a null doc_id keeps its place among nullable numbers, so pandas is given it as text
    schema = "doc_id string, size long, text_crc32 long, text_hash long, text_check long, hilbert long"
    placed = celled.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(place, schema).withColumn("doc_id", F.col("doc_id").cast("long"))
    placed = materialize(placed, "placed")
    group = ["text_hash", "text_check", "size"]
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "hilbert"))
    groups = placed.groupBy(*group).agg(F.count("*").alias("n"), first.alias("first")).where("n > 1")
    # a group has one row on the right side, a table of its own, so adaptive execution can split a hot group on the left
    groups = materialize(groups.select(*group, F.col("first.hilbert").alias("of_group")), "groups")
    together = placed.join(groups, group, "left").withColumn("hilbert", F.coalesce("of_group", "hilbert"))
    order = ["hilbert", "text_hash", "text_check", "doc_id"]
    columns = ["doc_id", "size", "text_crc32", "hilbert"]
    ordered = materialize(together.repartitionByRange(input_partitions(docs), *order).sortWithinPartitions(*order).select(*columns), "ordered")
    for table in (narrow, placed, groups):
        discard(table)
    return _cut(ordered, shards)


def _cut(ordered: DataFrame, shards: int) -> DataFrame:
    """Cut the order that the files of ordered hold into runs of equal length; one number for each file goes to the driver."""
    rows, place = _in_files(ordered)
    counts = sorted(((r["file"], r["count"]) for r in rows.groupBy("file").count().collect()), key=lambda c: _written_order(c[0]))
    first, total = [], 0
    for name, count in counts:
        first.append((name, total))
        total += count
    q, more = divmod(total, shards)
    offsets = ordered.sparkSession.createDataFrame(first, "file string, first long")
    rank = F.col("first") + place
    #: The first `more` shards hold q + 1 rows, the others q.
    head = F.lit(more * (q + 1)).cast("long")
    in_head = rank < head
    number = F.when(in_head, F.floor(rank / (q + 1))).otherwise(more + F.floor((rank - head) / max(q, 1))).cast("int")
    slot = F.when(in_head, rank % (q + 1)).otherwise((rank - head) % max(q, 1)).cast("long")
    return rows.join(F.broadcast(offsets), "file").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), number.alias("shard"), slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )
