"""Queries over records of five domains made from orders and their lines, with overlays over some of their items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators import slices as S
from factloom.operators.stored import stored

from .registry import query, table


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k and the items of five domains of each order."""
    o, s = table(spark, sf_dir, "orders"), lambda c: c.cast("string")
    item = lambda i, v: F.struct((F.lit(i) if isinstance(i, str) else s(i)).alias("id"), s(v).alias("value"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(
        F.array_sort(F.collect_list(item(F.concat(s(F.col("l_linenumber")), F.lit("-"), s(F.col("l_partkey")), F.lit("-"), s(F.col("l_suppkey"))), F.col("l_quantity").cast("long")))).alias("posts")
    )
    own = o.select(
        F.col("o_orderkey").alias("k"), F.array(item("opens", F.date_format("o_orderdate", "yyyy-MM-dd")), item("closes", F.date_format(F.expr("o_orderdate + INTERVAL 30 DAY"), "yyyy-MM-dd"))).alias("dates"),
        F.array(item("general", F.floor("o_totalprice").cast("long"))).alias("fees"), F.array(item("I", F.lit("written"))).alias("stages"), F.array(item("1", F.col("o_orderpriority")), item("2", F.col("o_orderstatus"))).alias("syllabus"),
    )
    return own.join(lines, "k", "left").select("k", "dates", "posts", "fees", "stages", "syllabus")


def overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays over orders, by their numbers: revisions, additions, removals, one that is not allowed, one that is retired."""
    k = F.col("o_orderkey")
    told = (  # domain, id, kind, value, seq, active, for which orders
        ("dates", "closes", "REVISE", F.lit("2030-01-01"), 1, True, k % 2 == 0), ("dates", "closes", "REVISE", F.lit("2031-01-01"), 2, True, k % 4 == 0), ("dates", "held", "ADD", F.lit("2032-02-02"), 3, True, k % 3 == 0),
        ("fees", "general", "REVISE", F.concat(F.lit("fee of "), k.cast("string")), 4, True, k % 5 == 0), ("fees", "women", "ADD", F.lit("0"), 5, True, k % 2 == 0), ("stages", "II", "ADD", F.lit("interview"), 6, True, k % 3 == 1),
        ("stages", "I", "REMOVE", F.lit(None).cast("string"), 7, True, k % 7 == 0), ("syllabus", "2", "REMOVE", F.lit(None).cast("string"), 8, True, k % 4 == 1), ("syllabus", "1", "REVISE", F.lit("new"), 9, False, k % 2 == 1), ("other", "x", "ADD", F.lit("y"), 10, True, k % 2 == 1),
    )
    rows = [F.when(who, F.struct(F.lit(d).alias("domain"), F.lit(i).alias("id"), F.lit(kind).alias("kind"), v.alias("value"), F.lit(n).alias("seq"), F.lit(on).alias("active"))) for d, i, kind, v, n, on, who in told]
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.explode(F.array_compact(F.array(*rows))).alias("x")).select("k", "x.*")


#: i: the items of each record after its overlays.
ITEMS = """i AS (
  SELECT o_orderkey AS k, 'dates' AS domain, 'opens' AS id, strftime(o_orderdate, '%Y-%m-%d') AS value FROM orders
  UNION ALL SELECT o_orderkey, 'dates', 'closes', CASE WHEN o_orderkey % 4 = 0 THEN '2031-01-01' WHEN o_orderkey % 2 = 0 THEN '2030-01-01' ELSE strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END FROM orders
  UNION ALL SELECT o_orderkey, 'dates', 'held', '2032-02-02' FROM orders WHERE o_orderkey % 3 = 0
  UNION ALL SELECT o_orderkey, 'fees', 'general', CASE WHEN o_orderkey % 5 = 0 THEN 'fee of ' || o_orderkey ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR) END FROM orders
  UNION ALL SELECT o_orderkey, 'stages', 'I', 'written' FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL SELECT o_orderkey, 'stages', 'II', 'interview' FROM orders WHERE o_orderkey % 3 = 1
  UNION ALL SELECT o_orderkey, 'syllabus', '1', o_orderpriority FROM orders UNION ALL SELECT o_orderkey, 'syllabus', '2', o_orderstatus FROM orders WHERE o_orderkey % 4 <> 1
  UNION ALL SELECT l_orderkey, 'posts', l_linenumber || '-' || l_partkey || '-' || l_suppkey, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)
)"""


@query(f"WITH {ITEMS} SELECT * FROM i")
def x17_domain_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items of all five domains of every record, with what is in force laid over them."""
    whole = S.lay_over(records(spark, sf_dir), S.in_force(overlays(spark, sf_dir), "k"), "k")
    of = lambda d: F.transform(d, lambda x: F.struct(F.lit(d).alias("domain"), x["id"].alias("id"), x["value"].alias("value")))
    rows = F.concat(*map(of, S.ALLOWED))
    return whole.select("k", F.explode(rows).alias("x")).select("k", "x.*")


@query("""SELECT o_orderkey AS k, domain, false AS again, false AS stray FROM orders, (VALUES ('dates'), ('fees'), ('stages'), ('syllabus')) d(domain)
WHERE (domain = 'dates' AND (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0)) OR (domain = 'fees' AND o_orderkey % 5 = 0) OR (domain = 'stages' AND (o_orderkey % 3 = 1 OR o_orderkey % 7 = 0)) OR (domain = 'syllabus' AND o_orderkey % 4 = 1)""")
def w18_replaced_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slices that overlays replaced; whether one changes when they are laid over again, or changed without an overlay."""
    before, held = stored(records(spark, sf_dir), "records"), stored(S.in_force(overlays(spark, sf_dir), "k"), "held")
    after = stored(S.lay_over(before, held, "k"), "laid")
    twice = S.changed(after, S.lay_over(after, held, "k"), "k").withColumn("again", F.lit(True))
    stray = S.isolated(before, after, held, "k").withColumn("stray", F.lit(True))
    out = S.changed(before, after, "k").join(twice, ["k", "domain"], "full").join(stray, ["k", "domain"], "left")
    return out.select("k", "domain", F.coalesce("again", F.lit(False)).alias("again"), F.coalesce("stray", F.lit(False)).alias("stray"))


@query("SELECT o_orderkey AS k, 'fees' AS domain, 'women' AS id, 'ADD' AS kind FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, 'other', 'x', 'ADD' FROM orders WHERE o_orderkey % 2 = 1")
def x17_refused_overlays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlays that their domain does not allow."""
    return S.refused(overlays(spark, sf_dir)).select("k", "domain", "id", "kind")
