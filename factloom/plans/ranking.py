"""Behavioural ranking: decayed scores, affinity between items and transfer along it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import dates as D
from factloom.operators.affinity import affinities

from .registry import query, table

#: Our own mapping of the event types: weight, half-life in hours, strength.
KINDS = {"view": (1.0, 168.0, 1.0), "click": (2.0, 336.0, 1.0), "signup": (4.0, 4320.0, 1.2), "purchase": (5.0, 1440.0, 1.5), "error": (0.5, 24.0, 1.0)}
FLOOR = 5.0
STRONG, MODERATE = 70, 40
DAMPING, LEAST_AFFINITY, CAP = 0.65, 0.3, 0.8


def _of(kind: Column, place: int) -> Column:
    return F.create_map(*[x for k, v in KINDS.items() for x in (F.lit(k), F.lit(v[place]))])[kind]


_KIND_ROWS = ", ".join(f"('{k}', {w}, {h}, {s})" for k, (w, h, s) in KINDS.items())


@query(f"""WITH k(event_type, weight, half_life, strength) AS (VALUES {_KIND_ROWS}), ref AS (SELECT max(epoch_us(ts)) AS newest FROM events),
s AS (SELECT user_id, round(sum(CAST(weight AS DOUBLE) * pow(2.0, -((newest - epoch_us(ts)) / 3.6e9) / CAST(half_life AS DOUBLE)) * CAST(strength AS DOUBLE)), 4) AS score, count(*) AS hits FROM events JOIN k USING (event_type), ref GROUP BY 1),
n AS (SELECT user_id, score, hits, round(100 * score / greatest((SELECT max(score) FROM s), {FLOOR}), 2) AS normalised FROM s)
SELECT user_id, score, hits, normalised, CASE WHEN normalised >= {STRONG} THEN 'STRONG' WHEN normalised >= {MODERATE} THEN 'MODERATE' ELSE 'WEAK' END AS band FROM n""")
def k9_engagement_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", D.micros(F.col("ts")).alias("at"))
    ref = e.agg(F.max("at").alias("ref"))  # one row
    kind = F.col("event_type")
    one = _of(kind, 0) * D.decay((F.col("ref") - F.col("at")) / 3.6e9, _of(kind, 1)) * _of(kind, 2)
    scores = e.where(kind.isin(*KINDS)).crossJoin(F.broadcast(ref)).groupBy("user_id").agg(F.round(F.sum(one), 4).alias("score"), F.count("*").alias("hits"))
    top = scores.agg(F.greatest(F.max("score"), F.lit(FLOOR)).alias("top"), F.sum("hits").alias("every"))  # of the same columns, so that the scores are made once
    norm = F.round(100 * F.col("score") / F.col("top"), 2)
    band = F.when(F.col("normalised") >= STRONG, "STRONG").when(F.col("normalised") >= MODERATE, "MODERATE").otherwise("WEAK")
    return scores.crossJoin(F.broadcast(top)).withColumn("normalised", norm).select("user_id", "score", "hits", "normalised", F.when(F.col("every") > 0, band).alias("band"))


def affinity(items: DataFrame) -> DataFrame:
    """Pairs (a, b) of items whose affinity is over LEAST_AFFINITY: an equal region alone reaches it, so regions are joined."""
    a, b = items.toDF("a", "a_region", "a_group"), items.toDF("b", "b_region", "b_group")
    value = 0.35 + 0.15 * (F.col("a_group") == F.col("b_group")).cast("int")
    met = a.join(b, (F.col("a_region") == F.col("b_region")) & (F.col("a") != F.col("b")))
    return met.select("a", "b", F.round(value, 2).alias("affinity")).where(F.col("affinity") > LEAST_AFFINITY)


AFFINITY = "aff AS (SELECT x.n_nationkey AS a, y.n_nationkey AS b, round(0.35 * CAST(x.n_regionkey = y.n_regionkey AS INT) + 0.15 * CAST(x.n_nationkey % 3 = y.n_nationkey % 3 AS INT), 2) AS affinity FROM nation x, nation y WHERE x.n_nationkey <> y.n_nationkey)"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", F.col("n_nationkey") % 3)


@query(f"WITH {AFFINITY} SELECT a, b, CAST(affinity AS DOUBLE) AS affinity FROM aff WHERE affinity > {LEAST_AFFINITY}")
def j19_affinity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return affinity(_items(spark, sf_dir)).withColumn("affinity", F.col("affinity").cast("double"))


@query(f"""WITH {AFFINITY}, d AS (SELECT c_nationkey - c_nationkey % 2 AS n, CAST(count(*) AS DOUBLE) AS direct FROM customer GROUP BY 1), m AS (SELECT max(direct) AS top FROM d),
t AS (SELECT b AS n, sum(direct * affinity * {DAMPING}) AS moved FROM d JOIN aff ON a = d.n WHERE affinity > {LEAST_AFFINITY} GROUP BY 1)
SELECT n_nationkey, round(CAST(CASE WHEN direct IS NULL THEN least(coalesce(moved, 0), {CAP} * top) ELSE direct + coalesce(moved, 0) END AS DOUBLE), 4) AS score FROM nation LEFT JOIN d ON d.n = n_nationkey LEFT JOIN t ON t.n = n_nationkey, m""")
def a15_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = F.col("c_nationkey") - F.col("c_nationkey") % 2  # customers count for even nations, so that odd ones have no direct score
    direct = table(spark, sf_dir, "customer").groupBy(even.alias("n")).agg(F.count("*").cast("double").alias("direct"))
    moved = direct.join(affinity(_items(spark, sf_dir)), F.col("n") == F.col("a")).groupBy(F.col("b").alias("n")).agg(F.sum(F.col("direct") * F.col("affinity") * DAMPING).alias("moved"))
    top = direct.agg(F.max("direct").alias("top"))
    met = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_nationkey").alias("n")).join(direct, "n", "left").join(moved, "n", "left").crossJoin(F.broadcast(top))
    m = F.coalesce("moved", F.lit(0.0))
    return met.select("n_nationkey", F.round(F.when(F.col("direct").isNull(), F.least(m, CAP * F.col("top"))).otherwise(F.col("direct") + m), 4).alias("score"))


#: Suppliers as items: their nation is their authority, the rest follows from their number.
_CATEGORY = ("CIVIL_SERVICES", "STATE_PSC", "STAFF_SELECTION", "BANKING", "OTHER", "OTHER", "OTHER")
_CATEGORIES = "([" + ", ".join(f"'{c}'" for c in _CATEGORY) + "])"


@query(f"""WITH i AS (SELECT s_suppkey AS id, CASE WHEN s_suppkey % 5 > 0 THEN 'A' || s_nationkey END AS authority, {_CATEGORIES}[s_suppkey % 7 + 1] AS category, ['f' || s_suppkey % 3, 'f' || (3 + s_suppkey % 4), 'f' || (7 + s_nationkey % 2)] AS fields, CASE WHEN s_suppkey % 2 = 0 THEN 'GRADUATION' END AS level FROM supplier),
p AS (SELECT a.id AS a, b.id AS b, CASE WHEN a.authority = b.authority THEN 0.35 ELSE 0 END + CASE WHEN a.category IN ('CIVIL_SERVICES', 'STATE_PSC') AND b.category IN ('CIVIL_SERVICES', 'STATE_PSC') THEN CASE WHEN a.category = b.category THEN 0.5 ELSE 0.4 END WHEN a.category IN ('STAFF_SELECTION', 'BANKING') AND b.category IN ('STAFF_SELECTION', 'BANKING') THEN 0.4 ELSE 0 END
  + 0.15 * least(2, len(list_intersect(a.fields, b.fields))) + CASE WHEN a.level = b.level THEN 0.05 ELSE 0 END AS s FROM i a JOIN i b ON a.id <> b.id)
SELECT a, b, CAST(least(1.0, round(s, 2)) AS DOUBLE) AS affinity FROM p WHERE round(s, 2) > 0.3""")
def j19_all_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of suppliers that are near by authority, category, fields and level; no other pair is built."""
    k, n, text = F.col("s_suppkey"), F.col("s_nationkey"), lambda c: F.concat(F.lit("f"), c.cast("string"))
    items = table(spark, sf_dir, "supplier").select(
        k.alias("id"), F.when(k % 5 > 0, F.concat(F.lit("A"), n.cast("string"))).alias("authority"), F.element_at(F.array(*map(F.lit, _CATEGORY)), (k % 7 + 1).cast("int")).alias("category"),
        F.array(text(k % 3), text(3 + k % 4), text(7 + n % 2)).alias("fields"), F.when(k % 2 == 0, "GRADUATION").alias("qualification"),
    )
    return affinities(items)
