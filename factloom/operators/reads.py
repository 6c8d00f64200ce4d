"""Reads over operational tables: scopes, gates, sequences and lists that keep their order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def where_given(df: DataFrame, **wanted: object) -> DataFrame:
    """df where every argument that is not None equals its column: one conjunction that reaches the scan."""
    tests = [F.col(c) == F.lit(v) for c, v in wanted.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def exact_or_latest(asked: DataFrame, rows: DataFrame, key: str, wanted: str, at: str) -> DataFrame:
    """asked (key, wanted) with the row of its key at exactly that version, else at the latest (null wanted: the latest).

    rows are reduced to one of each key and version and one of each key before they are joined.  ``id`` decides ties.
    """
    exact = rows.groupBy(F.col(key), F.col(at).alias(wanted)).agg(F.max("id").alias("_exact"))
    latest = rows.groupBy(key).agg(F.max(F.struct(at, "id")).alias("_latest"))
    met = asked.join(exact, [key, wanted], "left").join(latest, key, "left")
    return met.select(*asked.columns, F.coalesce("_exact", "_latest.id").alias("id"), F.col("_exact").isNotNull().alias("exact"))


def wildcard(a: Column, b: Column) -> Column:
    """Whether two scopes are the same, where a blank on either side fits any."""
    return (a == "") | (b == "") | (a == b)


def present(c: Column) -> Column:
    """Not null and not an empty text."""
    return c.isNotNull() & (c != "")


def clamp(c: Column, low: int, high: int, default: int) -> Column:
    """A numeric parameter as whole number within bounds; what is no number is the default."""
    return F.least(F.greatest(F.coalesce(c.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def first_match(rules: tuple[tuple[str, str], ...], texts: list[Column], default: str) -> Column:
    """The label of the first pattern that fits the first text, else of the first that fits the next text, and so on."""
    out = F.lit(default)
    for text in reversed(texts):
        for pattern, label in reversed(rules):
            out = F.when(text.rlike(pattern), label).otherwise(out)
    return out


def gate(own: Column, inherited: Column, foreign: Column) -> Column:
    """DIRECT where its own words stand, REJECTED where another's do, INHERITED where only what leads to it says so."""
    return F.when(own & ~foreign, "DIRECT").when(foreign, "REJECTED").when(inherited, "INHERITED").otherwise("REJECTED")


def problems(**rules: Column) -> Column:
    """The names of the rules that a row breaks, in order, joined by commas; a rule that cannot be judged is broken."""
    return F.array_join(F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()])), ",")


def stale(checked: Column, now: Column, interval: int) -> Column:
    """Whether a check is due: never made, or longer ago than the interval."""
    return checked.isNull() | (now - checked > interval)


def upsert_list(items: Column, new: Column) -> Column:
    """An array of (id, value) after one more: it takes the place of the item with its id, else stands at the end."""
    held = F.exists(items, lambda x: x["id"] == new["id"])
    return F.when(held, F.transform(items, lambda x: F.when(x["id"] == new["id"], new).otherwise(x))).otherwise(F.concat(items, F.array(new)))


def place(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """df with the place of each row among those of its key, in that order."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))


def unique_ids(nodes: DataFrame, node: str, parent: str, order: str) -> DataFrame:
    """nodes with an ``id`` of their own: the first of a name keeps it, others are named by their parent, then numbered."""
    name = F.regexp_replace(F.lower(node), "[^a-z0-9]+", "-")
    told = nodes.withColumn("_name", name).withColumn("_nth", F.row_number().over(Window.partitionBy("_name").orderBy(order)))
    by = F.concat_ws("-", "_name", F.regexp_replace(F.lower(F.col(parent).cast("string")), "[^a-z0-9]+", "-"))
    later = told.withColumn("_by", F.when(F.col("_nth") > 1, by)).withColumn("_mth", F.row_number().over(Window.partitionBy("_name", "_by").orderBy(order)))
    number = F.when(F.col("_mth") > 1, F.concat(F.lit("-"), F.col("_mth").cast("string"))).otherwise("")
    return later.withColumn("id", F.when(F.col("_nth") == 1, F.col("_name")).otherwise(F.concat("_by", number))).drop("_name", "_nth", "_by", "_mth")
