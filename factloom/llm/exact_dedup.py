"""Operator 1, exact dedup: a tree-merge of sorted digest runs.

Every input partition is a run: the map side of a round sorts its digests and keeps one entry for each, with the
best row so far and the number of copies.  Partitions then exchange runs in binomial rounds: in each round the runs
whose numbers differ only in the next ``log2(fan_in)`` bits meet, dealt over tasks by digest so that no task holds a
whole run, and are merged ``fan_in`` ways: the tasks sort what they got and fold equal neighbours (sorted aggregates,
which no hash table holds).  There are as many rounds as it takes until one run is left, so no two runs meet before
their round, however many there are.  An entry is merged only with an entry whose SHA-256, 64-bit check hash and
normalised length all agree, so a false meeting of digests is seen on every level.  The entries of the last run name
the row that stays.

A digest that a third of all rows carry costs one entry for each task and round.  The last join deals rows by
digest; its right side has one row for each group of copies, so adaptive execution splits a hot digest on the left.

Cases: null text is empty; rows with empty texts are one group; a null doc_id sorts after all others; of repeated
rows (same doc_id and text) exactly one is kept; other columns of any name are ignored, and keep_one() returns them
as they are; an empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, only_kept, text_of, whole_text

#: The characters that do not count: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = r"[\x20\x09-\x0D]+"
FAN_IN = 16

KEY = ("digest", "check", "n_norm")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, code points, what tells the whole text, digest of the normalised text and what verifies it, for every row."""
    norm = F.regexp_replace(text_of(text_col), SPACE, "")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.length(text_of(text_col)).alias("n_points"), *whole_text(text_col), norm.alias("norm")
    ).select(
        "doc_id", "n_points", "text_hash", "text_check",
        F.unhex(F.sha2("norm", 256)).alias("digest"),
        F.xxhash64("norm").alias("check"),
        F.length("norm").alias("n_norm"),
    )


def rounds_for(runs: int, fan_in: int = FAN_IN) -> int:
    """How many rounds of fan_in-way merges leave one of so many runs."""
    n = 1
    while fan_in**n < runs:
        n += 1
    return n


def tree_merge(rows: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row for each group of equal texts: its key, best (the row that stays) and size.

    rows: as fingerprints() gives them, with a unique ``uid`` and the number ``run`` of the run they belong to.
    """
    last = rows.agg(F.max("run").alias("last")).first()["last"] or 0
    level = rows.select(
        "run",
        *KEY,
        F.struct((-F.col("n_points")).alias("rank"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid").alias("best"),
        F.lit(1).cast("long").alias("size"),
    )
    for _ in range(rounds_for(last + 1, fan_in)):
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy("run", *KEY)
            .agg(F.min("best").alias("best"), F.sum("size").alias("size"))
        )
    return level.drop("run")


def _judged(docs: DataFrame, id_col: str, text_col: str, fan_in: int) -> DataFrame:
    numbered = fingerprints(docs, id_col, text_col).select("*", F.monotonically_increasing_id().alias("uid"), F.spark_partition_id().alias("run"))
    rows = materialize(numbered, "digests")
    groups = tree_merge(rows, fan_in).where("size > 1")
    own = F.col("size").isNull()
    return rows.join(groups, list(KEY), "left").select(
        "doc_id",
        F.when(own, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        (own | (F.col("best.uid") == F.col("uid"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "text_hash",
        "text_check",
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan_in: int = FAN_IN) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    return _judged(docs, id_col, text_col, fan_in).drop("text_hash", "text_check")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group the very row that exact_dedup() marks kept."""
    return only_kept(docs, _judged(docs, id_col, text_col, FAN_IN), id_col, text_col)
