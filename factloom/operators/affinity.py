"""How near two items are, by what they share: weighted terms, and only pairs that their terms can bring over a threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Tasks over which the pairs of a key are dealt.
SHARES = 16


@dataclass(frozen=True)
class Cluster:
    """Categories that belong together: how much two items of it share, of one category and of two."""

    name: str
    categories: tuple[str, ...]
    same: float
    other: float


@dataclass(frozen=True)
class Weights:
    """What each term adds; of shared fields at most ``most_fields`` count."""

    authority: float = 0.35
    field: float = 0.15
    most_fields: int = 2
    qualification: float = 0.05
    #: The categories are compared by these names.
    clusters: tuple[Cluster, ...] = (Cluster("civil", ("CIVIL_SERVICES", "STATE_PSC"), 0.5, 0.4), Cluster("tests", ("STAFF_SELECTION", "BANKING"), 0.4, 0.4))


def affinities(items: DataFrame, weights: Weights = Weights(), least: float = 0.3) -> DataFrame:
    """a, b and affinity of the pairs of different items (id, authority, category, fields, qualification) that are nearer than least.

    An inverted index has, for each item, only keys that can bring a pair over the threshold: its authority, its cluster, and, where
    the fields that count can, each two of its fields, with its qualification if it takes that too.  So pairs that meet
    are near, and no others are built.  Items that are alike in all terms meet as one; two that share several keys meet at
    the first of them alone; a key's pairs are dealt over SHARES tasks.  Only what is returned is written out by items.
    """
    w = weights
    if min([w.authority, *[c.other for c in w.clusters]]) <= least or w.most_fields != 2:
        raise ValueError("a term that does not reach the threshold alone needs a key of several terms")
    cluster = F.lit(None).cast("string")
    for c in w.clusters:
        cluster = F.when(F.col("category").isin(*c.categories), c.name).otherwise(cluster)
    own = items.select("id", "authority", "category", cluster.alias("cluster"), F.array_sort(F.array_distinct(F.coalesce("fields", F.array().cast("array<string>")))).alias("fields"), "qualification")
    two = F.flatten(F.transform("fields", lambda x, i: F.transform(F.slice(F.col("fields"), i + 2, F.size("fields")), lambda y: F.concat_ws("\u0001", F.lit("f"), x, y))))
    by_fields = w.field * w.most_fields > least
    with_level = w.field * w.most_fields + w.qualification > least
    none = F.array().cast("array<string>")
    keys = F.array_compact(F.array(
        F.when(F.coalesce("authority", F.lit("")) != "", F.concat_ws("\u0001", F.lit("a"), F.col("authority"))), F.when(F.col("cluster").isNotNull(), F.concat_ws("\u0001", F.lit("c"), F.col("cluster"))),
    ))
    if by_fields:
        more = two
    elif with_level:
        more = F.when(F.coalesce("qualification", F.lit("")) != "", F.transform(two, lambda k: F.concat_ws("\u0001", k, F.col("qualification")))).otherwise(none)
    else:
        more = none
    terms = ["authority", "category", "cluster", "fields", "qualification"]
    alike = own.groupBy(*terms).agg(F.collect_list("id").alias("ids")).withColumn("keys", F.array_union(keys, more))
    side = lambda n: alike.select(F.explode("keys").alias("key"), *[F.col(c).alias(f"{n}_{c}") for c in [*terms, "ids", "keys"]])
    tasks = int(items.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = F.pmod(F.xxhash64("a_authority", "a_category", "a_fields", "a_qualification"), F.lit(SHARES)).cast("int")
    a = side("a").withColumn("share", share).repartition(tasks, "key", "share")
    b = side("b").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1)))).repartition(tasks, "key", "share")
    met = a.join(b, ["key", "share"]).where(F.get(F.array_intersect("a_keys", "b_keys"), F.lit(0)) == F.col("key"))
    near = met.select("a_ids", "b_ids", F.round(_score(w), 2).alias("affinity")).where(F.col("affinity") > least)
    pairs = near.select(F.explode("a_ids").alias("a"), "b_ids", "affinity").select("a", F.explode("b_ids").alias("b"), "affinity")
    return pairs.where("a <> b").select("a", "b", "affinity")


def _score(w: Weights) -> Column:
    same = lambda c: (F.col(f"a_{c}") == F.col(f"b_{c}")) & (F.col(f"a_{c}") != "")
    cluster = F.lit(0.0)
    for c in w.clusters:
        both = (F.col("a_cluster") == c.name) & (F.col("b_cluster") == c.name)
        cluster = F.when(both, F.when(same("category"), c.same).otherwise(c.other)).otherwise(cluster)
    shared = F.least(F.lit(w.most_fields), F.size(F.array_intersect("a_fields", "b_fields")))
    total = F.when(same("authority"), w.authority).otherwise(0.0) + cluster + shared * w.field + F.when(same("qualification"), w.qualification).otherwise(0.0)
    return F.least(F.lit(1.0), total)
