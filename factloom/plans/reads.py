"""Queries that read operational tables: lookups, filters, gates, sequences, unions and lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import urls as U
from factloom.functions.dates import micros
from factloom.operators import reads as R
from factloom.operators import snapshots as S

from .registry import query, table


@query("SELECT c_custkey, c_name, c_nationkey FROM customer WHERE c_custkey = 42")
def s2_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.where_given(table(spark, sf_dir, "customer"), c_custkey=42).select("c_custkey", "c_name", "c_nationkey")


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS place FROM orders WHERE o_orderstatus <> 'P' AND o_totalprice > 0")
def s3_published(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = table(spark, sf_dir, "orders").where("o_orderstatus != 'P' AND o_totalprice > 0")
    return R.place(live, ["o_custkey"], F.col("o_orderdate"), F.col("o_orderkey")).select("o_custkey", "o_orderkey", "place")


@query("""WITH a AS (SELECT c_custkey AS k, CASE WHEN c_acctbal > 0 THEN 1993 + c_nationkey % 7 END AS wanted FROM customer), r AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, o_orderkey AS id FROM orders),
e AS (SELECT k, y, max(id) AS id FROM r GROUP BY 1, 2), l AS (SELECT k, arg_max(id, (y, id)) AS id FROM r GROUP BY 1)
SELECT a.k, wanted, coalesce(e.id, l.id) AS id, e.id IS NOT NULL AS exact FROM a LEFT JOIN e ON a.k = e.k AND a.wanted = e.y LEFT JOIN l ON a.k = l.k""")
def s4_latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_acctbal") > 0, 1993 + F.col("c_nationkey") % 7).alias("wanted"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.col("o_orderkey").alias("id"))
    return R.exact_or_latest(asked, rows, "k", "wanted", "y")




_WIDTHS = {"customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"), "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice")}
_SCANNED = " UNION ALL ".join(f"SELECT '{t}' AS table_name, '{c}' AS column_name, {i} AS place, count({c}) AS filled, approx_distinct AS distinct_values FROM {t}, (SELECT count(DISTINCT {c}) AS approx_distinct FROM {t}) GROUP BY approx_distinct" for t, cs in _WIDTHS.items() for i, c in enumerate(cs, 1))


@query(_SCANNED)
def s5_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan finds in each column of some tables: its place, how many rows have a value, and how many values there are."""
    out = None
    for name in _WIDTHS:
        t = table(spark, sf_dir, name)
        cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("place"), F.col(c).cast("string").alias("v")) for i, c in enumerate(t.columns, 1)]))
        # first each value once, in the map step too, then two plain counts
        values = t.select(cells.alias("x")).select("x.*").groupBy("column_name", "place", "v").agg(F.count("v").alias("n"))
        found = values.groupBy("column_name", "place").agg(F.sum("n").alias("filled"), F.count("v").alias("distinct_values")).select(F.lit(name).alias("table_name"), "*")
        out = found if out is None else out.unionByName(found)
    return out


@query("SELECT 'order' AS kind, o_orderkey AS id FROM orders UNION ALL SELECT 'event', event_id FROM events")
def w1_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda t, kind, c: table(spark, sf_dir, t).select(F.lit(kind).alias("kind"), F.col(c).alias("id"))
    return rows("orders", "order", "o_orderkey").unionByName(rows("events", "event", "event_id"))


@query("""SELECT user_id, event_type, event_id, CAST(row_number() OVER w AS BIGINT) AS version FROM events
WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id) QUALIFY lead(event_id) OVER w IS NOT NULL""")
def w9_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.versions(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "event_id")
    return v.where("superseded_at IS NOT NULL").select("user_id", "event_type", "event_id", F.col("version").cast("long").alias("version"))


@query("SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 400000) AS retired FROM customer")
def w10_soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "orders").where("o_orderstatus = 'P' AND o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("gone", F.lit(True))
    return table(spark, sf_dir, "customer").select("c_custkey").join(gone, "c_custkey", "left").select("c_custkey", F.coalesce("gone", F.lit(False)).alias("retired"))


@query("SELECT doc_id, coalesce(nullif(lang, ''), 'und') AS lang, coalesce(n_chars, length(text), 0) AS n_chars FROM documents")
def w14_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = F.when(R.present(F.col("lang")), F.col("lang")).otherwise("und")
    return table(spark, sf_dir, "documents").select("doc_id", lang.alias("lang"), F.coalesce("n_chars", F.length("text").cast("long"), F.lit(0)).alias("n_chars"))


@query("SELECT event_id, user_id, 'LATE' AS note FROM events WHERE event_type = 'error' UNION ALL SELECT o_orderkey, o_custkey, 'OPEN' FROM orders WHERE o_orderstatus = 'O'")
def w21_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "events").where("event_type = 'error'").select("event_id", "user_id", F.lit("LATE").alias("note"))
    return late.union(table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").select("o_orderkey", "o_custkey", F.lit("OPEN")))


@query("SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS INTEGER) AS rank FROM events WHERE event_type IN ('click', 'view') QUALIFY rank <= 100")
def w22_capped_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return S.newest(own, ["user_id"], [F.desc("ts"), F.desc("event_id")], 100).select("user_id", "event_id", "rank")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type AS kind FROM events")
def p1_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long").alias("p"), F.col("event_type").alias("kind")).select("event_id", "p.k", "kind")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority = '1-URGENT'")
def p2_given_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.where_given(table(spark, sf_dir, "orders"), o_orderstatus="O", o_orderpriority="1-URGENT", o_custkey=None).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority NOT IN ('5-LOW')")
def p3_status_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("O", "F") & ~F.col("o_orderpriority").isin("5-LOW")).select("o_orderkey", "o_orderstatus")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)")
def p4_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("l_suppkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(wanted, "l_suppkey", "left_semi")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE 'SMALL%' AND p_type NOT ILIKE '%promo%'")
def p5_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where(F.col("p_name").ilike("SMALL%") & ~F.col("p_type").ilike("%promo%")).select("p_partkey", "p_name")


@query("SELECT o_orderkey, o_orderpriority AS headline, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders WHERE regexp_matches(o_orderpriority, '(?i)urgent|high') AND o_orderdate >= TIMESTAMP '1997-06-01'")
def p6_keyword_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").rlike("(?i)urgent|high") & (F.col("o_orderdate") >= F.lit("1997-06-01").cast("timestamp_ntz")))
    return o.select("o_orderkey", F.col("o_orderpriority").alias("headline"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT page_id, least(greatest(coalesce(try_cast(nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS INTEGER), 1), 1), 5) AS page FROM pages")
def p7_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.nullif(F.regexp_extract("url", "[?&]page=([^&#]*)", 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", R.clamp(asked, 1, 5, 1).alias("page"))


@query("SELECT doc_id, text IS NOT NULL AND text <> '' AS has_text, lang IS NOT NULL AND lang <> '' AS has_lang FROM documents")
def p8_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.present(F.col("text")).alias("has_text"), R.present(F.col("lang")).alias("has_lang"))


@query("""WITH o AS (SELECT s_suppkey, s_nationkey AS n, CASE WHEN s_acctbal < 3000 THEN '' ELSE CASE s_suppkey % 2 WHEN 0 THEN 'BUILDING' ELSE 'MACHINERY' END END AS cycle, s_acctbal >= 0 AS active FROM supplier),
c AS (SELECT c_nationkey AS n, c_mktsegment AS cycle, count(*) AS m FROM customer GROUP BY 1, 2)
SELECT s_suppkey, CAST(coalesce(sum(m), 0) AS BIGINT) AS in_scope FROM o LEFT JOIN c ON o.n = c.n AND active AND (o.cycle = '' OR c.cycle = '' OR o.cycle = c.cycle) GROUP BY 1""")
def p9_overlay_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY")
    o = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("n"), F.when(F.col("s_acctbal") < 3000, "").otherwise(by).alias("cycle"), (F.col("s_acctbal") >= 0).alias("active"))
    c = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("m_n"), F.col("c_mktsegment").alias("m_cycle")).agg(F.count("*").alias("m"))
    met = o.join(c, (F.col("n") == F.col("m_n")) & F.col("active") & R.wildcard(F.col("cycle"), F.col("m_cycle")), "left")
    return met.groupBy("s_suppkey").agg(F.coalesce(F.sum("m"), F.lit(0)).alias("in_scope"))


@query("SELECT o_orderkey, coalesce(bool_or(l_returnflag = 'N' AND l_quantity > 10), false) AS publishable FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def p10_publishable(spark: SparkSession, sf_dir: str) -> DataFrame:
    cited = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.bool_or((F.col("l_returnflag") == "N") & (F.col("l_quantity") > 10)).alias("ok"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(cited, "o_orderkey", "left").select("o_orderkey", F.coalesce("ok", F.lit(False)).alias("publishable"))


@query("""WITH s AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS own FROM orders GROUP BY 1)
SELECT o_custkey, len(list_filter(['1-URGENT', '2-HIGH'], lambda x: NOT list_contains(own, x))) = 0 AS covers FROM s""")
def p11_scope_covers(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("own"))
    return own.select("o_custkey", (F.size(F.array_except(F.array(F.lit("1-URGENT"), F.lit("2-HIGH")), "own")) == 0).alias("covers"))


_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')), '^[a-z0-9+.-]*://(?:[^@]*@)?|:[0-9]*\z', '', 'g')"


@query(rf"SELECT page_id, CASE WHEN '.' || {_HOST} LIKE '%.example.org' THEN 'official' WHEN '.' || {_HOST} LIKE '%.example.com' THEN 'reviewed' ELSE 'unknown' END AS trust FROM pages")
def p12_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", U.trust(F.col("url")).alias("trust"))


_PROFILES = (("example.org", "PRIMARY_OFFICIAL", "authority"), ("example.com", "SECONDARY", "portal"))
_PROFILE_ROWS = ", ".join(str(p) for p in _PROFILES)


@query(rf"""WITH p(estate, klass, owner) AS (VALUES {_PROFILE_ROWS}), u AS (SELECT page_id, regexp_extract({_HOST}, '([^.]+\.[^.]+)\z', 1) AS estate FROM pages)
SELECT page_id, coalesce(klass, 'UNKNOWN') AS klass, owner FROM u LEFT JOIN p USING (estate)""")
def p13_source_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = F.broadcast(spark.createDataFrame(list(_PROFILES), "estate string, klass string, owner string"))  # a fixed table of two rows
    return table(spark, sf_dir, "pages").select("page_id", U.estate(F.col("url")).alias("estate")).join(profiles, "estate", "left").select("page_id", F.coalesce("klass", F.lit("UNKNOWN")).alias("klass"), "owner")


_ROLES = (("(?i)result|score", "RESULT"), ("(?i)news|notice", "NOTICE"), ("(?i)page=[0-9]+", "LISTING"), ("(?i)/(de|fr|en|es)/", "ARTICLE"))
_ROLE_SQL = lambda c: " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{r}'" for p, r in _ROLES)


@query(rf"SELECT page_id, CASE {_ROLE_SQL('title')} {_ROLE_SQL('url')} ELSE 'OTHER' END AS role FROM (SELECT page_id, url, regexp_extract(html, '(?is)<title>(.*?)</title>', 1) AS title FROM pages)")
def p14_link_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", R.first_match(_ROLES, [title, F.col("url")], "OTHER").alias("role"))


_PATH = r"regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"


@query(rf"""SELECT page_id, CASE WHEN regexp_matches({_PATH}, '/(en)/') AND NOT regexp_matches({_PATH}, '/(de|es)/') THEN 'DIRECT' WHEN regexp_matches({_PATH}, '/(de|es)/') THEN 'REJECTED' WHEN contains(url, 'ref=') THEN 'INHERITED' ELSE 'REJECTED' END AS gate FROM pages""")
def p15_isolation_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", R.gate(path.rlike("/(en)/"), F.contains("url", F.lit("ref=")), path.rlike("/(de|es)/")).alias("gate"))


@query(r"SELECT page_id, regexp_matches(coalesce(url, ''), '^(?i:https?)://[^/?#\s]+') AS valid FROM pages")
def p16_valid_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce("url", F.lit("")).rlike(r"^(?i:https?)://[^/?#\s]+").alias("valid"))


@query("SELECT conv_id, turn, role FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) = 1")
def p17_dedupe_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.newest(table(spark, sf_dir, "conversations"), ["conv_id", "role"], [F.col("turn"), F.col("text")], 1).select("conv_id", "turn", "role")


_BOUND = r"(?i)\b([0-9][0-9,]*)\s+(?:[a-z]+\s+){0,2}(?:page|pages|card|items?|rows?|posts?|vacancies)\b"


@query(rf"SELECT doc_id, coalesce(nullif(regexp_extract(text, '{_BOUND}', 1), ''), '') AS bound FROM documents")
def p18_bound_figure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.regexp_extract("text", _BOUND, 1), F.lit("")).alias("bound"))


@query("""WITH l AS (SELECT user_id, max(epoch_us(ts)) FILTER (event_type = 'view') AS seen FROM events GROUP BY 1), r AS (SELECT max(epoch_us(ts)) AS now FROM events)
SELECT user_id, seen IS NULL OR now - seen > 43200000000 AS due FROM l, r""")
def p19_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", micros(F.col("ts")).alias("t"))
    last = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("t"))).alias("seen"))
    now = F.broadcast(e.agg(F.max("t").alias("now")))  # one row
    return last.crossJoin(now).select("user_id", R.stale(F.col("seen"), F.col("now"), 12 * 3_600_000_000).alias("due"))


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]{9}$') THEN 'name' END, CASE WHEN NOT c_acctbal >= 0 THEN 'balance' END, CASE WHEN NOT c_mktsegment IN ('BUILDING', 'MACHINERY', 'AUTOMOBILE') THEN 'segment' END], lambda x: x IS NOT NULL), ',') AS problems FROM customer""")
def p20_rule_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = {"name": F.col("c_name").rlike("^Customer#[0-9]{9}$"), "balance": F.col("c_acctbal") >= 0, "segment": F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "AUTOMOBILE")}
    return table(spark, sf_dir, "customer").select("c_custkey", R.problems(**rules).alias("problems"))


@query("""SELECT event_id, CASE WHEN NOT json_valid(props) THEN 'NOT_JSON' WHEN json_extract(props, '$.k') IS NULL THEN 'MISSING' WHEN len(json_keys(props)) > 1 THEN 'UNKNOWN_KEY' WHEN json_type(props, '$.k') NOT IN ('UBIGINT', 'BIGINT') THEN 'TYPE' ELSE 'OK' END AS verdict FROM events""")
def p21_json_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, k = F.json_object_keys("props"), F.get_json_object("props", "$.k")
    verdict = F.when(keys.isNull(), "NOT_JSON").when(k.isNull(), "MISSING").when(F.size(keys) > 1, "UNKNOWN_KEY").when(~k.rlike("^-?[0-9]+$"), "TYPE").otherwise("OK")
    return table(spark, sf_dir, "events").select("event_id", verdict.alias("verdict"))


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20")
def o1_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(20).select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'P' THEN 99999999 ELSE year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) END, o_orderpriority, o_orderkey) AS place FROM orders")
def o3_missing_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("day", F.when(F.col("o_orderstatus") != "P", F.to_date("o_orderdate")))
    return R.place(o, ["o_custkey"], F.asc_nulls_last("day"), F.col("o_orderpriority"), F.col("o_orderkey")).select("o_orderkey", "place")


@query("""WITH s AS (SELECT user_id, event_type, count(*) AS hits, max(value) AS score, min(event_id) AS ord FROM events GROUP BY 1, 2)
SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, hits DESC, ord) AS place FROM s""")
def o4_stable_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("hits"), F.max("value").alias("score"), F.min("event_id").alias("ord"))
    return R.place(s, ["user_id"], F.desc("score"), F.desc("hits"), F.col("ord")).select("user_id", "event_type", "place")


@query("SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_type = 'ECONOMY' DESC, p_size DESC, p_partkey) AS place FROM part")
def o5_core_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    core = F.when(F.col("p_type") == "ECONOMY", 0).otherwise(1)
    return R.place(table(spark, sf_dir, "part"), ["p_brand"], core, F.desc("p_size"), F.col("p_partkey")).select("p_partkey", "place")


@query("""WITH n AS (SELECT s_nationkey, s_suppkey, CAST(count(DISTINCT l_returnflag || l_linestatus) AS BIGINT) AS names FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey GROUP BY 1, 2)
SELECT s_suppkey, names, row_number() OVER (PARTITION BY s_nationkey ORDER BY names DESC, s_suppkey) AS place FROM n""")
def o6_most_specific_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count_distinct(F.concat("l_returnflag", "l_linestatus")).alias("names"))
    n = table(spark, sf_dir, "supplier").join(names, "s_suppkey", "left").withColumn("names", F.coalesce("names", F.lit(0)))
    return R.place(n, ["s_nationkey"], F.desc("names"), F.col("s_suppkey")).select("s_suppkey", "names", "place")


@query("""WITH f AS (SELECT p_brand, p_type, min(p_partkey) AS first FROM part GROUP BY 1, 2)
SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_size <= 40, first, p_retailprice DESC, p_partkey) AS place FROM part JOIN f USING (p_brand, p_type)""")
def o7_study_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    met = p.join(p.groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("first")), ["p_brand", "p_type"])
    return R.place(met, ["p_brand"], F.col("p_size") <= 40, F.col("first"), F.desc("p_retailprice"), F.col("p_partkey")).select("p_partkey", "place")


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND user_id NOT IN (SELECT user_id FROM events WHERE event_type = 'signup' AND ts >= TIMESTAMP '2024-01-29') ORDER BY ts, event_id LIMIT 50")
def o8_queue_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    busy = e.where((F.col("event_type") == "signup") & (F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz"))).select("user_id")
    return e.where("event_type = 'error'").join(busy, "user_id", "left_anti").orderBy("ts", "event_id").limit(50).select("event_id", "user_id")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 4")
def o9_first_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.newest(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_orderkey")], 4).select("o_custkey", "o_orderkey")


@query("SELECT id, name FROM (SELECT s_suppkey AS id, s_name AS name, 0 AS src FROM supplier UNION ALL SELECT c_custkey, c_name, 1 FROM customer UNION ALL SELECT p_partkey, p_name, 2 FROM part) QUALIFY row_number() OVER (PARTITION BY id ORDER BY src) = 1")
def u1_union_by_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lambda t, k, n: table(spark, sf_dir, t).select(F.col(k).alias("id"), F.col(n).alias("name"))
    return S.prefer(S.prefer(rows("supplier", "s_suppkey", "s_name"), rows("customer", "c_custkey", "c_name"), ["id"]), rows("part", "p_partkey", "p_name"), ["id"])


@query("""WITH l AS (SELECT o_custkey, list({'id': o_orderkey, 'value': o_orderstatus} ORDER BY o_orderkey) AS items, max(o_orderkey) AS last, min(o_orderkey) AS first FROM orders GROUP BY 1)
SELECT o_custkey, array_to_string(list_transform(items, lambda x: x.id || ':' || CASE WHEN x.id = first THEN 'NEW' ELSE x.value END), ',') || CASE WHEN first % 2 = 0 THEN '' ELSE ',' || -1 || ':NEW' END AS items FROM l""")
def u2_upsert_into_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    item = F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("value"))
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list(item)).alias("items"), F.min("o_orderkey").alias("first"))
    new = lambda i: F.struct(i.alias("id"), F.lit("NEW").alias("value"))
    once = R.upsert_list(F.col("items"), new(F.col("first")))
    both = F.when(F.col("first") % 2 == 0, once).otherwise(R.upsert_list(once, new(F.lit(-1).cast("long"))))
    return own.select("o_custkey", F.array_join(F.transform(both, lambda x: F.concat_ws(":", x["id"].cast("string"), x["value"])), ",").alias("items"))


@query("""WITH s AS (SELECT o_custkey, o_orderstatus, list_distinct(list(o_orderpriority)) AS p FROM orders GROUP BY 1, 2), f AS (SELECT * FROM s WHERE o_orderstatus = 'F'), o AS (SELECT * FROM s WHERE o_orderstatus = 'O')
SELECT f.o_custkey, array_to_string(list_sort(list_intersect(f.p, o.p)), ',') AS shared FROM f JOIN o USING (o_custkey)""")
def u3_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    of = lambda s: F.collect_set(F.when(F.col("o_orderstatus") == s, F.col("o_orderpriority")))
    g = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(of("F").alias("f"), of("O").alias("o")).where((F.size("f") > 0) & (F.size("o") > 0))
    return g.select("o_custkey", F.array_join(F.sort_array(F.array_intersect("f", "o")), ",").alias("shared"))


@query("SELECT c_custkey AS id FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def u4_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    had = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")).distinct().join(had, "id", "left_anti")


@query("SELECT p_partkey, CAST(len(list_intersect(string_split(p_name, ' '), ['red', 'small', 'gear'])) AS INTEGER) AS hits FROM part")
def u5_token_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = F.array(*map(F.lit, ("red", "small", "gear")))
    return table(spark, sf_dir, "part").select("p_partkey", F.size(F.array_intersect(F.split("p_name", " "), wanted)).alias("hits"))


@query("""WITH b AS (SELECT p_partkey, p_brand, regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g') AS nm FROM part), a AS (SELECT *, row_number() OVER (PARTITION BY nm ORDER BY p_partkey) AS nth FROM b),
q AS (SELECT *, CASE WHEN nth > 1 THEN nm || '-' || regexp_replace(lower(p_brand), '[^a-z0-9]+', '-', 'g') END AS by_parent FROM a), m AS (SELECT *, row_number() OVER (PARTITION BY nm, by_parent ORDER BY p_partkey) AS mth FROM q)
SELECT p_partkey, CASE WHEN nth = 1 THEN nm ELSE by_parent || CASE WHEN mth > 1 THEN '-' || mth ELSE '' END END AS id FROM m""")
def n13_unique_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.unique_ids(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand"), "p_name", "p_brand", "p_partkey").select("p_partkey", "id")


@query("SELECT o_custkey, o_orderkey, row_number() OVER w AS version, lead(o_orderkey) OVER w AS superseded_by FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def n3_version_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = S.versions(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderkey")
    return v.select("o_custkey", "o_orderkey", F.col("version").cast("long").alias("version"), F.col("superseded_at").alias("superseded_by"))


@query("""WITH c AS (SELECT conv_id, turn, role, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
i AS (SELECT conv_id, turn, role, sum(new) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS UNBOUNDED PRECEDING) AS island FROM c)
SELECT conv_id, CAST(island AS BIGINT) AS island, role, min(turn) AS first_turn, count(*) AS n FROM i GROUP BY 1, 2, 3""")
def n10_role_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    new = (~F.lag("role").over(w).eqNullSafe(F.col("role"))).cast("int")
    island = F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", new.alias("new")).withColumn("island", island)
    return c.groupBy("conv_id", "island", "role").agg(F.min("turn").alias("first_turn"), F.count("*").alias("n"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS BIGINT) AS upto FROM lineitem")
def n12_running_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    upto = F.sum(F.col("l_quantity").cast("long")).over(Window.partitionBy("l_orderkey").orderBy("l_linenumber"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", upto.alias("upto"))
