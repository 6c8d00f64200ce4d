"""Queries that look up by tiers, follow revisions and tally: what joins and aggregates say without reading a group at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from factloom.operators import joins as J

from .facts import r3_diagnostic
from .registry import QUERIES, query, table


@query("""WITH r AS (SELECT c_custkey, 'Brand#' || CAST(c_custkey % 60 AS VARCHAR) AS label, CAST(c_custkey % 55 AS INTEGER) AS code FROM customer), k AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey <= 4 THEN p_partkey + 50 ELSE p_size END AS p_size FROM part),
l AS (SELECT p_brand, min(p_partkey) AS by_label FROM k GROUP BY 1), c AS (SELECT p_size, min(p_partkey) AS by_code, count(*) AS n FROM k GROUP BY 1)
SELECT c_custkey, CASE WHEN by_label IS NOT NULL THEN 'LABEL' WHEN n = 1 THEN 'CODE' WHEN n > 1 THEN 'AMBIGUOUS' ELSE 'NONE' END AS tier, CASE WHEN by_label IS NOT NULL THEN by_label WHEN n = 1 THEN by_code END AS found
FROM r LEFT JOIN l ON label = p_brand LEFT JOIN c ON code = p_size""")
def j15_label_then_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Brand#"), (key % 60).cast("string")).alias("label"), (key % 55).cast("int").alias("code"))
    code = F.when(F.col("p_partkey") <= 4, F.col("p_partkey") + 50).otherwise(F.col("p_size"))  # 51 to 54 are codes of one part each
    known = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("label"), code.cast("int").alias("code"))
    return J.label_then_code(asked, known).select("c_custkey", "tier", "found")


@query("""WITH u AS (SELECT s_suppkey, s_nationkey, CASE s_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'BUILDING' ELSE 'MACHINERY' END AS post FROM supplier)
SELECT c_custkey, coalesce(min(CASE WHEN post = c_mktsegment THEN s_suppkey END), min(CASE WHEN post = '' THEN s_suppkey END), min(s_suppkey)) AS rule FROM customer LEFT JOIN u ON c_nationkey = s_nationkey GROUP BY 1""")
def j16_most_specific(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.col("s_suppkey") % 3
    rules = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("category"), F.when(by == 0, "").when(by == 1, "BUILDING").otherwise("MACHINERY").alias("post"), F.col("s_suppkey").alias("rule"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("category"), F.col("c_mktsegment").alias("post"))
    return J.most_specific(asked, rules).select("c_custkey", "rule")


@query("SELECT event_id, lag(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS revises FROM events")
def n4_revision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("event_id", F.lag("event_id").over(chain).alias("revises"))


@query("SELECT o_orderkey, coalesce(target, o_custkey) AS custkey FROM orders LEFT JOIN (SELECT c_custkey, c_custkey - 1 AS target FROM customer WHERE c_custkey % 10 = 0) ON o_custkey = c_custkey")
def w13_alias_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    alias = table(spark, sf_dir, "customer").where("c_custkey % 10 = 0").select("c_custkey", (F.col("c_custkey") - 1).alias("target"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return o.join(alias, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("target", "o_custkey").alias("custkey"))


@query(f"SELECT diagnostic, count(*) AS n FROM ({QUERIES['r3_diagnostic'].sql}) GROUP BY 1")
def a5_verdict_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r3_diagnostic(spark, sf_dir).groupBy("diagnostic").agg(F.count("*").alias("n"))


@query("SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def a6_count_by_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))


@query("SELECT source, count(*) AS n, count(*) FILTER (n_chars > 500) AS n_long FROM documents GROUP BY 1")
def a7_items_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("n_chars") > 500).alias("n_long"))


@query("SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS event_id FROM events GROUP BY 1, 2")
def a20_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min(F.struct("ts", "event_id"))["event_id"].alias("event_id"))
