"""Queries over the operational tables: writes as folds, latest and newest rows, counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions.dates import micros
from factloom.operators import snapshots as S

from .registry import query, table


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a write log: key and owner, sequence, and fields that only some writes state."""
    e = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    return e.select(
        "event_id", "user_id", "event_type", micros(F.col("ts")).alias("at"), F.get_json_object("props", "$.k").cast("long").alias("k"), "value",
        F.when(kind == "purchase", F.col("value")).alias("spent"), F.when(kind == "view", F.col("value")).alias("viewed"),
    )


LOG = """log AS (
  SELECT event_id, user_id, event_type, epoch_us(ts) AS t_us, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value,
    CASE WHEN event_type = 'purchase' THEN value END AS spent, CASE WHEN event_type = 'view' THEN value END AS viewed
  FROM events)"""


@query(f"WITH {LOG} SELECT event_id, user_id, event_type, value FROM log QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1")
def w2_insert_or_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.first_write(_log(spark, sf_dir), ["user_id", "event_type"], ["event_id"]).select("event_id", "user_id", "event_type", "value")


@query(f"WITH {LOG} SELECT event_id, user_id, event_type, value FROM log QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY t_us DESC, event_id DESC) = 1")
def w3_insert_or_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_write(_log(spark, sf_dir), ["user_id", "event_type"], ["at", "event_id"]).select("event_id", "user_id", "event_type", "value")


@query(f"""WITH {LOG}, base AS (SELECT user_id, max(value) AS value, min(k) AS k FROM log WHERE event_id % 3 <> 0 GROUP BY 1),
batch AS (SELECT user_id, max(spent) AS value, max(CASE WHEN event_type = 'error' THEN k END) AS k FROM log WHERE event_id % 3 = 0 GROUP BY 1)
SELECT user_id, coalesce(n.value, b.value) AS value, coalesce(n.k, b.k) AS k FROM base b FULL JOIN batch n USING (user_id)""")
def w4_upsert_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    base = log.where("event_id % 3 != 0").groupBy("user_id").agg(F.max("value").alias("value"), F.min("k").alias("k"))
    batch = log.where("event_id % 3 = 0").groupBy("user_id").agg(F.max("spent").alias("value"), F.max(F.when(F.col("event_type") == "error", F.col("k"))).alias("k"))
    return S.upsert(base, batch, ["user_id"], ["value", "k"])


@query(f"WITH {LOG} SELECT user_id, arg_max(spent, event_id) FILTER (spent IS NOT NULL) AS spent, arg_max(viewed, event_id) FILTER (viewed IS NOT NULL) AS viewed FROM log GROUP BY 1")
def w5_fieldwise_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.fieldwise(_log(spark, sf_dir), ["user_id"], ["event_id"], ["spent", "viewed"])


@query(f"""WITH {LOG}, owned AS (SELECT *, first_value(user_id) OVER (PARTITION BY k ORDER BY event_id) AS owner FROM log)
SELECT k, owner AS user_id, arg_max(spent, event_id) FILTER (spent IS NOT NULL AND user_id = owner) AS spent, arg_max(viewed, event_id) FILTER (viewed IS NOT NULL AND user_id = owner) AS viewed,
  count(*) FILTER (user_id = owner) AS n_merged, count(*) FILTER (user_id <> owner) AS n_conflict FROM owned GROUP BY 1, 2""")
def w6_attempt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.merge_attempts(_log(spark, sf_dir), "k", "user_id", "event_id", ["spent", "viewed"])


@query(f"""WITH {LOG} SELECT event_id, user_id, event_type, row_number() OVER w AS version, lead(t_us) OVER w AS superseded_at
FROM log WINDOW w AS (PARTITION BY user_id, event_type ORDER BY t_us, event_id)""")
def w8_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.versions(_log(spark, sf_dir), ["user_id", "event_type"], [F.col("at"), F.col("event_id")], "at")
    return v.select("event_id", "user_id", "event_type", F.col("version").cast("long").alias("version"), "superseded_at")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def w11_delete_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return S.without(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), gone, ["o_custkey"])


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15' THEN NULL ELSE props END AS props FROM events")
def w23_retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.when(old, F.lit(None)).otherwise(F.col("props")).alias("props"))


@query("""WITH a AS (SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders), b AS (SELECT o_orderkey, o_orderstatus, CASE WHEN o_custkey % 97 = 5 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_custkey % 101 <> 7)
SELECT a.o_orderkey FROM a LEFT JOIN b USING (o_orderkey) WHERE b.o_orderkey IS NULL OR a.o_totalprice <> b.o_totalprice""")
def w18_changed_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = o.where("o_custkey % 101 != 7").withColumn("o_totalprice", F.when(F.col("o_custkey") % 97 == 5, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return S.diff_keys(o.drop("o_custkey"), new.drop("o_custkey"), ["o_orderkey"])


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def n1_latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.last_write(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events QUALIFY rank <= 50")
def n2_newest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.newest(table(spark, sf_dir, "events"), ["user_id"], [F.desc("ts"), F.desc("event_id")], 50).select("event_id", "user_id", "rank")


@query("SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS INTEGER) AS rank FROM conversations QUALIFY rank <= 12")
def n14_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.newest(table(spark, sf_dir, "conversations"), ["conv_id"], [F.desc("turn"), F.col("role"), F.col("text")], 12).select("conv_id", "turn", "role", "rank")


@query("SELECT 'events' AS name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'documents', count(*) FROM documents UNION ALL SELECT 'pages', count(*) FROM pages")
def a1_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n") for t in ("events", "orders", "documents", "pages")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def a2_count_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT kind AS part_type, count(*) AS n FROM (SELECT p_type AS kind FROM part WHERE p_name NOT ILIKE 'SMALL%') GROUP BY 1")
def a3_count_unlike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(~F.col("p_name").ilike("SMALL%")).groupBy(F.col("p_type").alias("part_type")).agg(F.count("*").alias("n"))


@query("SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 100000) AS n_large, count(*) AS n FROM orders GROUP BY 1")
def a4_filtered_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(
        F.count_if(status == "O").alias("n_open"), F.count_if((status == "P") & (F.col("o_totalprice") > 100000)).alias("n_large"), F.count("*").alias("n")
    )


@query("SELECT c_nationkey, round(100.0 * count(*) FILTER (c_acctbal > 0 AND c_mktsegment <> 'BUILDING') / count(*), 4) AS percent FROM customer GROUP BY 1")
def a25_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.count_if((F.col("c_acctbal") > 0) & (F.col("c_mktsegment") != "BUILDING"))
    return table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.round(F.lit(100.0) * found / F.count("*"), 4).alias("percent"))


@query("SELECT o_custkey, min_by(o_orderkey, (CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 ELSE 2 END) * 1000000000000 + o_orderkey) AS weakest FROM orders GROUP BY 1")
def a23_weakest_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min(F.struct(rank.alias("r"), "o_orderkey")).alias("w")).select("o_custkey", F.col("w.o_orderkey").alias("weakest"))


@query("""SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY last ASC NULLS LAST, c_custkey) AS BIGINT) AS place
FROM customer LEFT JOIN (SELECT o_custkey, max(o_orderdate) AS last FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 300000 GROUP BY 1) ON c_custkey = o_custkey""")
def o2_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 300000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last"))
    w = Window.partitionBy("c_nationkey").orderBy(F.asc_nulls_last("last"), "c_custkey")
    return table(spark, sf_dir, "customer").join(last, "c_custkey", "left").select("c_custkey", F.row_number().over(w).cast("long").alias("place"))


@query("""WITH a AS (SELECT s_suppkey AS id, s_name AS name FROM supplier), b AS (SELECT c_custkey AS id, c_name AS name FROM customer)
SELECT id, name FROM a UNION ALL SELECT id, name FROM b WHERE id NOT IN (SELECT id FROM a)""")
def j6_authored_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    return S.prefer(a, b, ["id"])
