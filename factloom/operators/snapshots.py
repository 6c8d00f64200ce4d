"""Writes as folds of a log into a new snapshot: first wins, last wins, upserts, merges, versions, newest rows.

Plain files have no row update, so a write is a DataFrame of the state after it.  Folds are aggregates with a partial
step on the map side wherever the semantics allow, so a key with very many writes costs one row for each task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _fold(log: DataFrame, keys: list[str], order: list[str], pick) -> DataFrame:
    row, seq = F.struct(*log.columns), F.struct(*order)
    return log.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(pick(row, seq).alias("r")).select("r.*")


def first_write(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or ignore: of each key the first row stays.  order must be total."""
    return _fold(log, keys, order, F.min_by)


def last_write(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Insert or replace: of each key the last whole row stays.  order must be total."""
    return _fold(log, keys, order, F.max_by)


def fieldwise(log: DataFrame, keys: list[str], order: list[str], fields: list[str]) -> DataFrame:
    """Each field's last value that is not null."""
    seq = F.struct(*order)
    return log.groupBy(*keys).agg(*[F.max_by(f, F.when(F.col(f).isNotNull(), seq)).alias(f) for f in fields])


def upsert(base: DataFrame, batch: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """base after batch (one row a key): the batch's values that are not null win."""
    new = batch.select(*keys, *[F.col(f).alias(f"_new_{f}") for f in fields])
    return base.join(new, keys, "full").select(*keys, *[F.coalesce(f"_new_{f}", f).alias(f) for f in fields])


def without(base: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return base.join(gone.select(*keys), keys, "left_anti")


def prefer(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Union in which the first table wins on the key."""
    return first.unionByName(without(second, first, keys))


def newest(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in that order, with their rank; cut on the map side too (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def versions(log: DataFrame, keys: list[str], order: list[str], at: str) -> DataFrame:
    """Every row with its version and when the next one superseded it (null: current)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return log.withColumn("version", F.row_number().over(w)).withColumn("superseded_at", F.lead(at).over(w))


def merge_attempts(log: DataFrame, key: str, owner: str, seq: str, fields: list[str]) -> DataFrame:
    """Fold of attempts: the first owner of a key holds it, their later rows fill in fields, others' rows are conflicts."""
    mine = log.groupBy(key, owner).agg(
        F.min(seq).alias("first"), F.count("*").alias("n"), *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col(seq))).alias(f) for f in fields]
    )
    held = mine.groupBy(key).agg(F.min_by(F.struct(owner, "n", *fields), "first").alias("h"), F.sum("n").alias("total"))
    return held.select(key, f"h.{owner}", *[f"h.{f}" for f in fields], F.col("h.n").alias("n_merged"), (F.col("total") - F.col("h.n")).alias("n_conflict"))


def diff_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows differ between two snapshots, by digest: what a slice replacement must keep to its own slice."""
    digest = lambda df: df.groupBy(*keys).agg(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")).alias("digest"))
    a, b = digest(old), digest(new).withColumnRenamed("digest", "new_digest")
    return a.join(b, keys, "full").where(~F.col("digest").eqNullSafe(F.col("new_digest"))).select(*keys)
