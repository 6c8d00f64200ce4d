"""Queries over web pages and trees: links, nodes, duplicates, shares, ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import urls as U
from factloom.operators import graph as G

from .registry import query, table

_P = r"'(?is)^\s*(https?)://(?:[^/?#]*@)?([^/?#:@]*)(?::([0-9]*))?([^?#]*)(?:\?([^#]*))?.*\z'"
_NORMAL = (
    r"""CASE WHEN NOT regexp_matches({u}, '(?is)^\s*https?://') THEN trim({u}) ELSE lower(regexp_extract({u}, P, 1)) || '://' || lower(regexp_extract({u}, P, 2))
|| CASE WHEN regexp_extract({u}, P, 3) = '' OR lower(regexp_extract({u}, P, 1)) || regexp_extract({u}, P, 3) IN ('http80', 'https443') THEN '' ELSE ':' || regexp_extract({u}, P, 3) END
|| CASE WHEN rtrim(regexp_extract({u}, P, 4), '/') = '' THEN '/' ELSE rtrim(regexp_extract({u}, P, 4), '/') END
|| regexp_replace('?' || array_to_string(list_filter(string_split(regexp_extract({u}, P, 5), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?i:utm_\w+|fbclid|gclid|mc_cid|mc_eid|igshid|ref_src)(?:=|\z)')), '&'), '^\?\z', '') END"""
).replace("P,", _P + ",")
_HOST = r"regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')), '^[a-z0-9+.-]*://(?:[^@]*@)?|:[0-9]*\z', '', 'g')"


@query(rf"""SELECT page_id, {_NORMAL.format(u='url')} AS node, regexp_replace({_NORMAL.format(u='url')}, '^https?://(?:www\.)?', '') AS key, 'n-' || substr(sha256(regexp_replace({_NORMAL.format(u='url')}, '^https?://(?:www\.)?', '')), 1, 16) AS node_id, {_HOST} AS host, regexp_extract({_HOST}, '([^.]+\.[^.]+)\z', 1) AS estate,
CASE WHEN '.' || {_HOST} LIKE '%.example.org' THEN 'official' WHEN '.' || {_HOST} LIKE '%.example.com' THEN 'reviewed' ELSE 'unknown' END AS trust FROM pages""")
def f15_normal_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", U.normalise(u).alias("node"), U.key(u).alias("key"), U.node_id(u).alias("node_id"), U.host(u).alias("host"), U.estate(u).alias("estate"), U.trust(u).alias("trust"))


LINKS = rf"""h AS (SELECT page_id, url, generate_subscripts(hrefs, 1) - 1 AS pos, unnest(hrefs) AS href FROM (SELECT page_id, url, regexp_extract_all(html, '<a\s[^>]*?href="([^"]*)"', 1) AS hrefs FROM pages)),
a AS (SELECT page_id, url, pos, href, CASE WHEN regexp_matches(href, '^(?i:https?)://') THEN href WHEN starts_with(href, '//') THEN regexp_extract(url, '^[A-Za-z]+:') || href
  WHEN starts_with(href, '/') THEN lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*')) || href WHEN regexp_matches(href, '^(?i:[a-z][a-z0-9+.-]*:)|^#|^\z') THEN NULL
  ELSE regexp_replace(regexp_replace(url, '[?#].*\z', ''), '[^/]*\z', '') || href END AS target FROM h),
l AS (SELECT page_id, url, CAST(pos AS INTEGER) AS pos, href, {_NORMAL.format(u='target')} AS target FROM a)"""


@query(f"WITH {LINKS} SELECT page_id, pos, href, target FROM l")
def s11_page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.page_links(table(spark, sf_dir, "pages")).select("page_id", "pos", "href", "target")


@query(f"WITH {LINKS} SELECT {_NORMAL.format(u='url')} AS source, target, count(*) AS n FROM l WHERE {_NORMAL.format(u='url')} <> target GROUP BY 1, 2")
def g2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = G.page_links(table(spark, sf_dir, "pages"))
    return G.edges_of(links.select(U.normalise(F.col("url")).alias("source"), "target"))


@query(rf"""WITH {LINKS}, e AS (SELECT page_id, target, regexp_extract({_HOST}, '([^.]+\.[^.]+)\z', 1) AS estate FROM l), p AS (SELECT estate, count(DISTINCT page_id) AS pages FROM e GROUP BY 1),
c AS (SELECT estate, target FROM e JOIN p USING (estate) GROUP BY 1, 2, pages HAVING pages > 1 AND count(DISTINCT page_id) >= 0.5 * pages)
SELECT e.estate, e.page_id, e.target FROM e ANTI JOIN c ON e.estate = c.estate AND e.target = c.target""")
def g6_without_chrome(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = G.page_links(table(spark, sf_dir, "pages")).select(U.estate(F.col("url")).alias("estate"), "page_id", "target")
    return G.without_chrome(links).select("estate", "page_id", "target")


_RANK = {"official": 0, "reviewed": 1, "unknown": 2}


@query(rf"""WITH s AS (SELECT page_id, {_NORMAL.format(u='url')} AS node, CASE WHEN '.' || {_HOST} LIKE '%.example.org' THEN 0 WHEN '.' || {_HOST} LIKE '%.example.com' THEN 1 ELSE 2 END AS r,
  nullif(regexp_extract(url, '://[^/]*/([a-z]{{2}})/', 1), '') AS role, CAST(length(url) - length(replace(url, '/', '')) - 2 AS INTEGER) AS depth FROM pages)
SELECT node, CASE min(r) WHEN 0 THEN 'official' WHEN 1 THEN 'reviewed' ELSE 'unknown' END AS trust, min(role) AS role, min(depth) AS depth, min(page_id) AS first_page, count(*) AS n_seen FROM s GROUP BY 1""")
def g1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("url")
    role = F.regexp_extract(u, r"://[^/]*/([a-z]{2})/", 1)
    depth = F.length(u) - F.length(F.replace(u, F.lit("/"), F.lit(""))) - 2
    seen = table(spark, sf_dir, "pages").select("page_id", U.normalise(u).alias("node"), U.trust(u).alias("trust"), F.when(role != "", role).alias("role"), depth.alias("depth"))
    return G.merge_nodes(seen, _RANK)


@query("SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(coalesce(text, '')) ORDER BY doc_id) AS first_id FROM documents")
def g3_content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"))
    return d.join(d.groupBy("digest").agg(F.min("doc_id").alias("first_id")), "digest").select("doc_id", "first_id")


@query(f"WITH h AS (SELECT {_HOST} AS host, count(*) AS n FROM pages GROUP BY 1) SELECT host, n, round(n / (SELECT sum(n) FROM h), 6) AS share FROM h")
def a18_host_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "pages").groupBy(U.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))
    return h.crossJoin(F.broadcast(h.agg(F.sum("n").alias("total")))).select("host", "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))


@query("""WITH RECURSIVE t AS (SELECT 'world' AS node, CAST(NULL AS VARCHAR) AS parent UNION ALL SELECT 'r' || r_regionkey, 'world' FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier),
w AS (SELECT node, node AS path, node AS root, 0 AS level FROM t WHERE parent IS NULL UNION ALL SELECT t.node, w.path || '/' || t.node, w.root, w.level + 1 FROM t JOIN w ON t.parent = w.node)
SELECT node, root, CAST(level AS INTEGER) AS level, path FROM w""")
def g13_tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    tree = (
        table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("node"), F.lit("world").alias("parent"))
        .union(table(spark, sf_dir, "nation").select(name("n", "n_nationkey"), name("r", "n_regionkey")))
        .union(table(spark, sf_dir, "supplier").select(name("s", "s_suppkey"), name("n", "s_nationkey")))
        .union(spark.range(1).select(F.lit("world"), F.lit(None).cast("string")))
    )
    return G.ancestors(tree)
