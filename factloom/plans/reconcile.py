"""Queries that bring statements together: dated events, milestones, results, facts, bodies of one name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import text as T
from factloom.operators import joins as J
from factloom.operators import ladders
from factloom.operators import reconcile as R

from .registry import QUERIES, query, table

#: Events as statements: a user's kind is one matter, k tells cycle, date, rank and revision.
STATED = """s AS (SELECT event_id, user_id, event_type AS kind, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events),
m AS (SELECT event_id, user_id, kind, CASE k % 4 WHEN 0 THEN '2024' WHEN 1 THEN '2025' ELSE '' END AS cycle, CASE WHEN k % 11 <> 0 THEN '2024-0' || (k % 3 + 1) || '-05' END AS date, CAST(k % 5 AS INTEGER) AS rank, value > 40 AND k % 7 < 2 AS revises FROM s)"""


def _stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("event_type").alias("kind"), k.alias("k"), "value")
    k = F.col("k")
    date = F.when(k % 11 != 0, F.concat(F.lit("2024-0"), (k % 3 + 1).cast("string"), F.lit("-05")))
    return e.select("event_id", "user_id", "kind", F.when(k % 4 == 0, "2024").when(k % 4 == 1, "2025").otherwise("").alias("cycle"), date.alias("date"), (k % 5).cast("int").alias("rank"), ((F.col("value") > 40) & (k % 7 < 2)).alias("revises"))


_FITS = "list_position(list_transform(f.heads, lambda h: h = '' OR n.cycle = '' OR h = n.cycle), true)"
BUCKETS = f"""n AS (SELECT *, row_number() OVER (PARTITION BY user_id, kind ORDER BY event_id) AS i FROM m),
f AS (SELECT user_id, kind, i, event_id, [cycle] AS heads, 0 AS bucket FROM n WHERE i = 1
UNION ALL SELECT n.user_id, n.kind, n.i, n.event_id, CASE WHEN {_FITS} IS NULL OR {_FITS} = 0 THEN list_append(f.heads, n.cycle) ELSE f.heads END, CAST(CASE WHEN {_FITS} IS NULL OR {_FITS} = 0 THEN len(f.heads) ELSE {_FITS} - 1 END AS INTEGER)
FROM f JOIN n ON n.user_id = f.user_id AND n.kind = f.kind AND n.i = f.i + 1)"""


@query(f"WITH RECURSIVE {STATED}, {BUCKETS} SELECT event_id, bucket FROM f")
def a11_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.bucketed(_stated(spark, sf_dir), ["user_id", "kind"], "cycle", ["event_id"]).select("event_id", "bucket")


@query(f"""WITH RECURSIVE {STATED}, {BUCKETS}, b AS (SELECT m.*, f.bucket FROM m JOIN f USING (event_id)),
g AS (SELECT *, count(*) OVER w AS n, count(date) OVER w AS dated, min(date) OVER w AS low, max(date) OVER w AS high, min(event_id) OVER w AS first, min(CASE WHEN revises AND date IS NOT NULL THEN event_id END) OVER w AS revision, min(rank) OVER w AS best FROM b WINDOW w AS (PARTITION BY user_id, kind, bucket)),
t AS (SELECT *, min(CASE WHEN rank = best THEN date END) OVER w AS top_low, max(CASE WHEN rank = best THEN date END) OVER w AS top_high, min(CASE WHEN rank = best AND date IS NOT NULL THEN event_id END) OVER w AS top, count(*) FILTER (rank > best AND rank < 2) OVER w AS between_n, max(CASE WHEN rank > best THEN date END) OVER w AS lower FROM g WINDOW w AS (PARTITION BY user_id, kind, bucket)),
v AS (SELECT *, CASE WHEN dated >= 2 AND revision IS NOT NULL THEN revision WHEN kind IN ('click', 'view') AND best < 2 AND top_low = top_high AND between_n = 0 AND NOT coalesce(lower > top_low, false) THEN top END AS governing FROM t),
d AS (SELECT *, max(CASE WHEN event_id = governing THEN date END) OVER (PARTITION BY user_id, kind, bucket) AS day FROM v)
SELECT event_id, bucket, CASE WHEN (dated = n AND low = high) OR dated = 0 THEN CASE WHEN event_id = first THEN 'KEPT' ELSE 'MERGED' END WHEN governing IS NULL THEN 'NEEDS_REVIEW' WHEN event_id = governing THEN 'GOVERNS' WHEN date = day THEN 'CORROBORATES' ELSE 'SUPERSEDED' END AS outcome FROM d""")
def x8_reconcile_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.reconcile_dates(_stated(spark, sf_dir), ["user_id", "kind"], "cycle", "event_id", ["click", "view"], "kind").select("event_id", "bucket", "outcome")


_KIND = "CASE kind WHEN 'view' THEN 'APPLICATION_WINDOW' WHEN 'click' THEN 'APPLICATION_START' WHEN 'signup' THEN 'APPLICATION_END' ELSE kind END"
_SAME = "(x.kind = n.kind OR (x.kind LIKE 'APPLICATION%' AND n.kind LIKE 'APPLICATION%' AND (x.kind = 'APPLICATION_WINDOW' OR n.kind = 'APPLICATION_WINDOW'))) AND (x.cycle = '' OR n.cycle = '' OR x.cycle = n.cycle)"
_FOUND = f"list_filter(f.free, lambda x: {_SAME})[1].id"
PAIRS = f"""q AS (SELECT event_id AS id, user_id, {_KIND} AS kind, cycle, date, revises, rank >= 2 AS inc FROM m),
n AS (SELECT *, CASE WHEN kind LIKE 'APPLICATION%' THEN 'APPLICATION' ELSE kind END AS family, row_number() OVER (PARTITION BY user_id, CASE WHEN kind LIKE 'APPLICATION%' THEN 'APPLICATION' ELSE kind END ORDER BY inc DESC, id) AS i FROM q),
f AS (SELECT user_id, family, i, id, inc, CASE WHEN inc THEN [{{'kind': kind, 'cycle': cycle, 'id': id}}] ELSE [] END AS free, CAST(NULL AS BIGINT) AS partner FROM n WHERE i = 1
UNION ALL SELECT n.user_id, n.family, n.i, n.id, n.inc, CASE WHEN n.inc THEN list_append(f.free, {{'kind': n.kind, 'cycle': n.cycle, 'id': n.id}}) ELSE list_filter(f.free, lambda x: x.id IS DISTINCT FROM {_FOUND.replace("x:", "y:").replace("x.", "y.")}) END, CASE WHEN n.inc THEN NULL ELSE {_FOUND} END
FROM f JOIN n ON n.user_id = f.user_id AND n.family = f.family AND n.i = f.i + 1),
p AS (SELECT id, partner FROM f WHERE NOT inc)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    kind = F.col("kind")
    name = F.when(kind == "view", "APPLICATION_WINDOW").when(kind == "click", "APPLICATION_START").when(kind == "signup", "APPLICATION_END").otherwise(kind)
    m = _stated(spark, sf_dir).select(F.col("event_id").alias("id"), "user_id", name.alias("kind"), "cycle", "date", "revises", "rank")
    return m.where("rank < 2"), m.where("rank >= 2")


@query(f"WITH RECURSIVE {STATED}, {PAIRS} SELECT id, partner FROM p")
def j10_milestone_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.pair_milestones(*_sides(spark, sf_dir), ["user_id"]).select("id", "partner")


@query(f"""WITH RECURSIVE {STATED}, {PAIRS}
SELECT p.id AS existing_id, w.id AS incoming_id, CASE WHEN p.id IS NULL THEN 'ADDED' WHEN w.date IS NULL THEN 'UNCHANGED' WHEN o.date = w.date THEN 'CONFIRMED' WHEN w.revises THEN 'SUPERSEDED' ELSE 'CONFLICTED' END AS action
FROM p JOIN q o ON o.id = p.id FULL JOIN (SELECT * FROM q WHERE inc) w ON w.id = p.partner""")
def x10_merge_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.merge_milestones(*_sides(spark, sf_dir), ["user_id"])


@query("""WITH r AS (SELECT o_custkey, o_orderpriority, o_orderkey, o_orderstatus <> 'F' AS incoming, CAST(floor(o_totalprice / 100000) AS INTEGER) AS value, o_orderstatus = 'P' AND o_totalprice < 90000 AS cancels, o_orderstatus = 'P' AND o_totalprice > 400000 AS revised, epoch_us(o_orderdate) AS published FROM orders),
n AS (SELECT *, row_number() OVER w AS nth, first_value(value) OVER w AS first FROM r WINDOW w AS (PARTITION BY o_custkey, o_orderpriority ORDER BY incoming, o_orderkey)),
b AS (SELECT *, max(CASE WHEN nth = 1 OR (value = first AND NOT cancels AND incoming) THEN published END) OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS by_then FROM n)
SELECT o_orderkey, CASE WHEN nth = 1 THEN 'ADDED' WHEN value = first AND NOT cancels THEN 'CONFIRMED' WHEN revised OR cancels OR published > by_then THEN 'SUPERSEDED' ELSE 'CONFLICTED' END AS decision FROM b WHERE incoming""")
def x15_merge_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    status, price = F.col("o_orderstatus"), F.col("o_totalprice")
    rows = table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderpriority", "o_orderkey", (status != "F").alias("incoming"), F.floor(price / 100000).cast("int").alias("value"),
        ((status == "P") & (price < 90000)).alias("cancels"), ((status == "P") & (price > 400000)).alias("revised"), F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("published"),
    )
    return R.merge_results(rows, ["o_custkey", "o_orderpriority"], "o_orderkey").select("o_orderkey", "decision")


@query("""WITH f AS (SELECT l_partkey, l_returnflag, l_linestatus AS value, CASE WHEN l_discount > 0.07 THEN 'VERIFIED' WHEN l_discount > 0.05 THEN 'NOT_PUBLISHED' ELSE 'NEEDS_REVIEW' END AS status FROM lineitem WHERE l_linestatus IS NOT NULL),
g AS (SELECT l_partkey, l_returnflag, count(*) FILTER (status = 'VERIFIED') AS n, min(value) FILTER (status = 'VERIFIED') AS low, max(value) FILTER (status = 'VERIFIED') AS high, count(*) FILTER (status = 'NOT_PUBLISHED') AS silent FROM f GROUP BY 1, 2)
SELECT l_partkey, l_returnflag, CASE WHEN n = 0 THEN CASE WHEN silent > 0 THEN 'NOT_PUBLISHED' ELSE 'NOT_EXTRACTED' END WHEN low = high THEN 'VERIFIED' ELSE 'NEEDS_REVIEW' END AS status, CASE WHEN n > 0 AND low = high THEN round(least(1.0, 0.6 + 0.2 * n), 2)::DOUBLE END AS confidence FROM g""")
def x16_merge_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("l_discount")
    facts = table(spark, sf_dir, "lineitem").select("l_partkey", "l_returnflag", F.col("l_linestatus").alias("value"), F.when(d > 0.07, "VERIFIED").when(d > 0.05, "NOT_PUBLISHED").otherwise("NEEDS_REVIEW").alias("status"), "l_orderkey")
    return R.merge_facts(facts, ["l_partkey", "l_returnflag"], "l_orderkey").select("l_partkey", "l_returnflag", "status", "confidence")


FACTS = """f AS (SELECT event_id, user_id, event_type, CASE WHEN value < 2 THEN ' ' WHEN event_type = 'signup' THEN '2024-0' || CAST(floor(value / 5) AS INTEGER) || '-10' WHEN event_type = 'purchase' THEN CASE WHEN value > 30 THEN 'http://a.b/' || CAST(floor(value / 20) AS INTEGER) ELSE 'a.b' END ELSE CAST(CAST(floor(value / 10) AS INTEGER) AS VARCHAR) END AS value,
CASE event_type WHEN 'signup' THEN 'DATE' WHEN 'purchase' THEN 'URL' ELSE 'INTEGER' END AS kind, CASE k % 9 WHEN 0 THEN NULL WHEN 1 THEN 'ftp://x' ELSE 'https://s' || k % 9 || '.example.org/' END AS source_url, k % 5 <> 3 AS reachable, CASE WHEN k % 3 = 0 THEN 0.5 ELSE 0.7 END AS confidence
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events))"""


def _facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, v, k = F.col("event_type"), F.col("value"), F.col("k")
    whole = lambda by: F.floor(v / by).cast("int").cast("string")
    value = (
        F.when(v < 2, " ").when(kind == "signup", F.concat(F.lit("2024-0"), whole(5), F.lit("-10")))
        .when(kind == "purchase", F.when(v > 30, F.concat(F.lit("http://a.b/"), whole(20))).otherwise("a.b")).otherwise(whole(10))
    )
    source = F.when(k % 9 == 0, F.lit(None)).when(k % 9 == 1, "ftp://x").otherwise(F.concat(F.lit("https://s"), (k % 9).cast("string"), F.lit(".example.org/")))
    return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long")).select(
        "event_id", "user_id", "event_type", value.alias("value"), F.when(kind == "signup", "DATE").when(kind == "purchase", "URL").otherwise("INTEGER").alias("kind"),
        source.alias("source_url"), (k % 5 != 3).alias("reachable"), F.when(k % 3 == 0, 0.5).otherwise(0.7).alias("confidence"),
    )


VALID = f"""{FACTS}, y AS (SELECT *, CASE WHEN trim(value) = '' OR source_url IS NULL THEN 'required' WHEN NOT starts_with(source_url, 'http') OR (kind = 'URL' AND NOT starts_with(value, 'http')) THEN 'url' WHEN kind = 'DATE' AND try_strptime(value, '%Y-%m-%d') IS NULL THEN 'date' END AS why FROM f),
u AS (SELECT *, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type, value, source_url, why IS NULL ORDER BY event_id) > 1 THEN 'duplicate' END) AS reason0 FROM y),
r AS (SELECT u.*, EXISTS (SELECT 1 FROM u o WHERE o.reason0 IS NULL AND o.user_id = u.user_id AND o.event_type = u.event_type AND o.value <> u.value AND o.source_url <> u.source_url) AS rival FROM u),
v AS (SELECT event_id, user_id, event_type, CASE WHEN reason0 = 'duplicate' THEN 'duplicate' WHEN reason0 IS NOT NULL THEN 'rejected' WHEN rival THEN 'conflicting' WHEN reachable AND confidence >= 0.6 THEN 'validated' ELSE 'pending' END AS status,
coalesce(reason0, CASE WHEN rival THEN 'rivals' WHEN NOT reachable THEN 'unreachable' WHEN confidence < 0.6 THEN 'confidence' ELSE '' END) AS reason FROM r)"""


@query(f"WITH {VALID} SELECT event_id, status, reason FROM v")
def x5_validate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.validate_facts(_facts(spark, sf_dir), ["user_id", "event_type"], "event_id").select("event_id", "status", "reason")


@query(f"WITH {VALID} SELECT user_id, status, count(*) AS n FROM v GROUP BY 1, 2")
def j3_facts_of_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = R.validate_facts(_facts(spark, sf_dir), ["user_id", "event_type"], "event_id")
    return v.groupBy("user_id", "status").agg(F.count("*").alias("n"))


@query("""WITH n AS (SELECT *, l_orderkey * 10 + l_linenumber AS ord FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ord > min(ord) OVER (PARTITION BY l_partkey, l_returnflag, l_linestatus, l_suppkey) AS duplicate FROM n""")
def j4_duplicate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ord_ = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    first = F.min(ord_).over(Window.partitionBy("l_partkey", "l_returnflag", "l_linestatus", "l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (ord_ > first).alias("duplicate"))


RIVALS = """r AS (SELECT f.l_orderkey, f.l_linenumber, f.l_partkey, f.l_suppkey, (SELECT count(*) FROM lineitem g WHERE g.l_partkey = f.l_partkey AND g.l_returnflag = f.l_returnflag AND g.l_linestatus <> f.l_linestatus AND g.l_suppkey <> f.l_suppkey) AS rivals FROM lineitem f)"""


def _rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ladders.rivals(table(spark, sf_dir, "lineitem"), ["l_partkey", "l_returnflag"], "l_linestatus", "l_suppkey")


@query(f"WITH {RIVALS} SELECT * FROM r")
def j5_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rivals(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "rivals")


@query(f"WITH {RIVALS} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN rivals > 0 THEN 'conflicting' ELSE 'pending' END AS status FROM r")
def w12_mark_rivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rivals(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("rivals") > 0, "conflicting").otherwise("pending").alias("status"))


@query("""WITH b AS (SELECT c_nationkey, c_mktsegment AS body, round(sum(c_acctbal), 2) AS score, bool_or(c_acctbal > 9990) AS named FROM customer GROUP BY 1, 2),
s AS (SELECT *, greatest(score, 0) / greatest(sum(greatest(score, 0)) OVER (PARTITION BY c_nationkey), 1e-9) AS share, row_number() OVER (PARTITION BY c_nationkey ORDER BY score DESC, body) AS place FROM b),
p AS (SELECT * FROM (SELECT *, count(*) FILTER (share >= 0.25) OVER (PARTITION BY c_nationkey) AS many FROM s) WHERE share >= 0.25 OR (many = 0 AND place = 1)),
g AS (SELECT c_nationkey, count(*) AS plausible, min(body) AS only_one, count(*) FILTER (named) AS n_named, min(body) FILTER (named) AS told FROM p GROUP BY 1)
SELECT c_nationkey, plausible, CASE WHEN plausible = 1 THEN only_one WHEN n_named = 1 THEN told END AS chosen, CASE WHEN plausible = 1 OR n_named = 1 THEN 'RESOLVED' ELSE 'AMBIGUOUS' END AS decision FROM g""")
def x25_decide_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("body")).agg(F.round(F.sum("c_acctbal"), 2).alias("score"), F.bool_or(F.col("c_acctbal") > 9990).alias("named"))
    return R.decide(b, ["c_nationkey"])


NAMES = r"""w AS (SELECT DISTINCT name, list_distinct(list_filter(string_split_regex(lower(name), '[^a-z0-9]+'), lambda x: length(x) >= 2)) AS words, side FROM (SELECT lower(p_type) || ' ' || p_name AS name, 'a' AS side FROM part UNION ALL SELECT p_name || ' ' || p_type, 'b' FROM part UNION ALL SELECT p_name, 'b' FROM part WHERE p_size > 45)),
p AS (SELECT a.name AS a, b.name AS b, len(list_intersect(a.words, b.words)) AS shared, least(len(a.words), len(b.words)) AS low, greatest(len(a.words), len(b.words)) AS high FROM w a JOIN w b ON a.side = 'a' AND b.side = 'b'),
s AS (SELECT a, b, CASE WHEN shared = low AND shared = high THEN 1.0 WHEN shared = low THEN CASE WHEN shared >= 2 THEN 0.9 ELSE 0.5 END ELSE 0.4 * shared / high END::DOUBLE AS score FROM p WHERE shared > 0),
g AS (SELECT a AS name, arg_min(b, (-score, b)) AS b, max(score) AS best, count(*) FILTER (score >= 0.85) AS good FROM s GROUP BY 1)"""


@query(f"WITH {NAMES} SELECT name, CASE WHEN good = 1 THEN b END AS match, CASE WHEN good > 0 THEN round(best, 4) ELSE 0.0::DOUBLE END AS score, CASE WHEN good = 0 THEN 'UNCHANGED' WHEN good > 1 THEN 'CONFLICTED' ELSE 'MATCHED' END AS verdict FROM g")
def j11_best_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    a = p.select(F.concat_ws(" ", F.lower("p_type"), "p_name").alias("name"))
    b = p.select(F.concat_ws(" ", "p_name", "p_type").alias("name")).union(p.where("p_size > 45").select("p_name"))
    return J.best_names(a, b, "name").withColumn("score", F.round("score", 4))


@query(f"""WITH {NAMES}, l AS (SELECT name, CASE WHEN good = 1 THEN b END AS match FROM g), o AS (SELECT lower(p_type) || ' ' || p_name AS name, max(p_size) AS size FROM part GROUP BY 1), i AS (SELECT p_name || ' ' || p_type AS name, max(CASE p_brand WHEN 'Brand#3' THEN p_size + 1 ELSE p_size END) AS size FROM part GROUP BY 1 UNION ALL SELECT p_name, 0 FROM part WHERE p_size > 45 GROUP BY 1)
SELECT o.name, i.name AS met, CASE WHEN i.name IS NULL THEN 'UNCHANGED' WHEN o.size = i.size OR i.size = 0 THEN 'CONFIRMED' ELSE 'CONFLICTED' END AS action FROM o LEFT JOIN l ON l.name = o.name LEFT JOIN i ON i.name = l.match""")
def x11_merge_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    old = p.groupBy(F.concat_ws(" ", F.lower("p_type"), "p_name").alias("name")).agg(F.max("p_size").alias("size"))
    both, short = F.concat_ws(" ", "p_name", "p_type"), p.where("p_size > 45").select("p_name").distinct()
    b = p.select(both.alias("name")).union(short)
    changed = F.when(F.col("p_brand") == "Brand#3", F.col("p_size") + 1).otherwise(F.col("p_size"))  # one brand's posts come with another figure
    new = p.groupBy(both.alias("met")).agg(F.max(changed).alias("new")).union(short.select("p_name", F.lit(0)))
    pairs = J.best_names(old, b, "name").select("name", F.col("match").alias("met"))
    met = old.join(pairs, "name", "left").join(new.withColumn("there", F.lit(True)), "met", "left")
    decision = F.when(F.col("new") == 0, "KEPT").otherwise(ladders.figure(F.col("size"), F.col("new")))
    action = F.when(F.col("there").isNull(), "UNCHANGED").when(decision == "UNDER_REVIEW", "CONFLICTED").otherwise("CONFIRMED")
    return met.select("name", F.when(F.col("there"), F.col("met")).alias("met"), action.alias("action"))


IDENTITY = """w AS (SELECT p_partkey, p_type AS code_a, CASE WHEN p_size > 25 THEN p_type WHEN p_size > 12 THEN '' ELSE 'PROMO' END AS code_b, string_split(p_name, ' ') AS a, list_distinct(string_split(CASE WHEN p_size % 3 = 0 THEN p_name || ' old' WHEN p_size % 3 = 1 THEN 'hot gear' ELSE p_name END, ' ')) AS b FROM part),
s AS (SELECT *, len(list_intersect(a, b)) AS shared, len(a) AS la, len(b) AS lb FROM w)"""


def _identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    size, name = F.col("p_size"), F.col("p_name")
    other = F.when(size % 3 == 0, F.concat(name, F.lit(" old"))).when(size % 3 == 1, "hot gear").otherwise(name)
    code = F.when(size > 25, F.col("p_type")).when(size > 12, "").otherwise("PROMO")
    return table(spark, sf_dir, "part").select("p_partkey", "p_type", code.alias("code"), T.words(name).alias("a"), T.words(other).alias("b"))


@query(f"""WITH {IDENTITY} SELECT p_partkey, round(CASE WHEN code_b <> '' THEN CASE WHEN code_a = code_b THEN 1.0 ELSE 0.0 END WHEN shared = 0 THEN 0.0 WHEN shared = la AND shared = lb THEN 1.0 WHEN shared = least(la, lb) THEN CASE WHEN shared >= 2 THEN 0.9 ELSE 0.5 END ELSE 0.4 * shared / greatest(la, lb) END, 4)::DOUBLE AS stage FROM s""")
def j13_stage_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far two stages are the same: their codes decide where both have one, else their words."""
    by_code = F.when(F.col("code") != "", (F.col("code") == F.col("p_type")).cast("double"))
    return _identity(spark, sf_dir).select("p_partkey", F.round(F.coalesce(by_code, T.name_score(F.col("a"), F.col("b"))), 4).alias("stage"))


@query(f"""WITH {IDENTITY} SELECT p_partkey, round(CASE WHEN shared = 0 THEN 0.0 WHEN shared = la AND shared = lb THEN 1.0 WHEN shared = least(la, lb) THEN CASE WHEN shared >= 2 THEN 0.9 ELSE 0.55 END ELSE 0.8 * shared / greatest(la, lb) END, 3)::DOUBLE AS topic FROM s""")
def j14_topic_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _identity(spark, sf_dir).select("p_partkey", F.round(T.name_score(F.col("a"), F.col("b"), one=0.55, share=0.8), 3).alias("topic"))


@query("""WITH n AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY 1, 2), c AS (SELECT p_brand, arg_min(p_name, (-n, p_name)) AS canon FROM n GROUP BY 1),
s AS (SELECT p_partkey, canon, len(list_intersect(string_split(p_name, ' '), string_split(canon, ' '))) AS shared FROM part JOIN c USING (p_brand))
SELECT p_partkey, canon, CASE shared WHEN 2 THEN 'SAME' WHEN 1 THEN 'RELATED' ELSE 'OTHER' END AS judged FROM s""")
def x24_designations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The designation that most of a brand's parts bear, and whether each part's is that, related to it or another."""
    p = table(spark, sf_dir, "part")
    names = p.groupBy("p_brand", "p_name").agg(F.count("*").alias("n"))
    canon = names.groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("n"), "p_name"))["p_name"].alias("canon"))
    score = T.name_score(T.words(F.col("p_name")), T.words(F.col("canon")))
    return p.join(canon, "p_brand").select("p_partkey", "canon", F.when(score == 1, "SAME").when(score > 0, "RELATED").otherwise("OTHER").alias("judged"))


@query(f"SELECT status, reason, count(*) AS n FROM ({QUERIES['x5_validate_facts'].sql}) GROUP BY 1, 2")
def a24_counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return x5_validate_facts(spark, sf_dir).groupBy("status", "reason").agg(F.count("*").alias("n"))
