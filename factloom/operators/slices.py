"""Records of slices (arrays of items by domain) with overlays laid over them item by item, and the proof that nothing else changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an overlay may do in which domain; another kind changes nothing and is told of.
ALLOWED = {
    "dates": ("REVISE", "ADD"),
    "posts": ("REVISE", "ADD", "REMOVE"),
    "fees": ("REVISE",),
    "stages": ("ADD", "REMOVE"),
    "syllabus": ("REVISE", "ADD", "REMOVE"),
}
ITEM = "struct<id:string,value:string>"


def in_force(overlays: DataFrame, record: str, allowed: dict[str, tuple[str, ...]] = ALLOWED) -> DataFrame:
    """record, domain, id, kind and value of the overlay that holds for each item: the last active one that its domain allows.

    overlays: record, domain, id, kind, value, seq and active.  Of a removed item a later overlay may add it anew.
    """
    fits = F.lit(False)
    for domain, kinds in allowed.items():
        fits = fits | ((F.col("domain") == domain) & F.col("kind").isin(*kinds))
    last = F.max_by(F.struct("kind", "value"), "seq")
    return overlays.where(F.col("active") & fits).groupBy(record, "domain", "id").agg(last.alias("x")).select(record, "domain", "id", "x.*")


def refused(overlays: DataFrame, allowed: dict[str, tuple[str, ...]] = ALLOWED) -> DataFrame:
    """The active overlays that their domain does not allow, or of no domain."""
    fits = F.lit(False)
    for domain, kinds in allowed.items():
        fits = fits | ((F.col("domain") == domain) & F.col("kind").isin(*kinds))
    return overlays.where(F.col("active") & ~F.coalesce(fits, F.lit(False)))


def _laid(items: Column, own: Column) -> Column:
    """Items with a domain's overlays (an array of id, kind, value): revised in place, removed, and those added that are not there, by id."""
    items = F.coalesce(items, F.array().cast(f"array<{ITEM}>"))
    of = lambda i: F.get(F.filter(own, lambda o: o["id"] == i), F.lit(0))
    kept = F.filter(items, lambda x: ~F.exists(own, lambda o: (o["id"] == x["id"]) & (o["kind"] == "REMOVE")))
    now = F.transform(kept, lambda x: F.struct(x["id"].alias("id"), F.when(of(x["id"]).isNotNull(), of(x["id"])["value"]).otherwise(x["value"]).alias("value")))
    new = F.filter(own, lambda o: (o["kind"] == "ADD") & ~F.exists(items, lambda x: x["id"] == o["id"]))
    return F.concat(now, F.array_sort(F.transform(new, lambda o: F.struct(o["id"].alias("id"), o["value"].alias("value")))))


def lay_over(records: DataFrame, held: DataFrame, record: str, domains: tuple[str, ...] = tuple(ALLOWED)) -> DataFrame:
    """records (record, and an array of items for each domain) with the overlays in force laid over them.

    Overlays meet by record in one group, so a record is joined once; what holds for one item is one overlay, so the group is
    no larger than what is laid over the record.  To lay the same over again changes nothing.
    """
    each = held.groupBy(F.col(record).alias("_record")).agg(F.collect_list(F.struct("domain", "id", "kind", "value")).alias("_over"))
    met = records.join(each, F.col(record) == F.col("_record"), "left").withColumn("_over", F.coalesce("_over", F.array().cast("array<struct<domain:string,id:string,kind:string,value:string>>")))
    own = lambda d: F.filter("_over", lambda o: o["domain"] == d)
    out = [_laid(F.col(d), own(d)).alias(d) for d in domains]
    return met.select(*[c for c in records.columns if c not in domains], *out)


def changed(before: DataFrame, after: DataFrame, record: str, domains: tuple[str, ...] = tuple(ALLOWED)) -> DataFrame:
    """record and domain of each slice whose items are not the same before and after."""
    prints = lambda df, n: df.select(F.col(record), F.explode(F.array(*[F.struct(F.lit(d).alias("domain"), F.xxhash64(F.to_json(F.coalesce(d, F.array().cast(f"array<{ITEM}>")))).alias(n)) for d in domains])).alias("x")).select(record, "x.*")
    return prints(before, "was").join(prints(after, "now"), [record, "domain"]).where("was <> now").select(record, "domain")


def isolated(before: DataFrame, after: DataFrame, held: DataFrame, record: str, domains: tuple[str, ...] = tuple(ALLOWED)) -> DataFrame:
    """record and domain of each slice that changed although no overlay is laid over it: empty if slices are isolated."""
    return changed(before, after, record, domains).join(held.select(record, "domain").distinct(), [record, "domain"], "left_anti")
